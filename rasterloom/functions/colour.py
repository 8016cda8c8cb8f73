"""Palettes and colours as column expressions.

A palette is an array of (r, g, b) on the image's row; ``palette_join`` takes one from a
table of its own instead.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries a palette can have, which bounds what the join broadcasts.
MOST_ENTRIES = 256


def compose(r: Column, g: Column, b: Column) -> Column:
    """One number: r in the highest byte, then g, b, and an unused byte."""
    return F.shiftleft(r.cast("long"), 24) + F.shiftleft(g.cast("long"), 16) + F.shiftleft(b.cast("long"), 8)


def red(pixel: Column) -> Column:
    return F.shiftright(pixel.cast("long"), 24).bitwiseAND(F.lit(255))


def green(pixel: Column) -> Column:
    return F.shiftright(pixel.cast("long"), 16).bitwiseAND(F.lit(255))


def blue(pixel: Column) -> Column:
    return F.shiftright(pixel.cast("long"), 8).bitwiseAND(F.lit(255))


def fast_gray(pixel: Column) -> Column:
    """Green alone."""
    return green(pixel)


def weighted_gray(r: Column, g: Column, b: Column) -> Column:
    """(r + 2 g + b) div 4."""
    return F.floor((r.cast("long") + 2 * g.cast("long") + b.cast("long")) / 4)


def strip_16(sample: Column) -> Column:
    """The high byte of a 16-bit sample."""
    return F.shiftright(sample, 8)


def size(cmap: Column) -> Column:
    return F.size(cmap)


def entry(cmap: Column, index: Column) -> Column:
    """The colour at a 0-based index, null where there is none."""
    return F.get(cmap, index)


def channels(cmap: Column) -> tuple[Column, Column, Column]:
    """The palette as three arrays."""
    one = lambda n: F.transform(cmap, lambda c: c[n])
    return one("r"), one("g"), one("b")


def add(cmap: Column, r: int, g: int, b: int, depth: int) -> Column:
    """One more colour, while 2^depth has room for it."""
    new = F.struct(F.lit(r).cast("short").alias("r"), F.lit(g).cast("short").alias("g"), F.lit(b).cast("short").alias("b"))
    return F.when(F.size(cmap) < (1 << depth), F.array_append(cmap, new)).otherwise(cmap)


def has_colour(cmap: Column) -> Column:
    """Whether any entry isn't gray."""
    return F.exists(cmap, lambda c: (c["r"] != c["g"]) | (c["r"] != c["b"]))


def palette_join(pixels: DataFrame, palette: DataFrame, index: str = "v") -> DataFrame:
    """Pixels with r, g, b of a palette table (idx, r, g, b); 0 where the index is missing.

    The palette is broadcast after its size is checked.
    """
    if palette.limit(MOST_ENTRIES + 1).count() > MOST_ENTRIES:
        raise ValueError(f"a palette has {MOST_ENTRIES} entries at most")
    joined = pixels.join(F.broadcast(palette), pixels[index] == palette["idx"], "left")
    return joined.select(pixels["*"], *[F.coalesce(palette[c], F.lit(0)).alias(c) for c in ("r", "g", "b")])


def look_up(lines: DataFrame, palettes: DataFrame, values: str = "values", salts: int = 1) -> DataFrame:
    """Lines of palette indices (img_id, y, ``values``) with ``colours`` and ``missing`` (how many indices their palette lacks), by the palette of their own image.

    ``palettes`` (img_id, cmap) holds one row an image and is joined on img_id like any
    table, so palettes of all images together may be of any size. An index that the palette
    lacks gives black, as does every index of an image without one. ``salts`` deals the
    lines of an image, and copies of its palette, over so many tasks.
    """
    if salts > 1:
        lines = lines.withColumn("__salt", F.pmod(F.col("y"), F.lit(salts)))
        palettes = palettes.select("img_id", "cmap", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt"))
    on = ["img_id", "__salt"] if salts > 1 else ["img_id"]
    joined = lines.join(palettes.select(*on, F.col("cmap").alias("__cmap")), on, "left")
    black = F.struct(*[F.lit(0).cast("short").alias(c) for c in ("r", "g", "b")])
    found = lambda v: F.coalesce(F.when(v >= 0, F.get("__cmap", v.cast("int"))), black)
    lacks = lambda v: (v < 0) | (v >= F.coalesce(F.size("__cmap"), F.lit(0)))
    out = joined.withColumn("colours", F.transform(values, found)).withColumn("missing", F.size(F.filter(values, lacks)))
    return out.select(*[c for c in lines.columns if c != "__salt"], "colours", "missing")
