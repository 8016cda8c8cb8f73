"""Per-pixel operators over the pixel table (img_id, y, x, v), in DataFrame expressions.

Windows are over the lines and columns of an image. An operator that needs both deals its
pixels by image once, which serves all its windows and groups; a task then sorts one image
at a time, and may spill. One that needs lines or columns only is dealt by these. Megapixel
images are better served by ``kernels``, which the tests hold equal to these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .coder import TYPICAL
from .kernels import NEIGHBOURS


def _line() -> WindowSpec:
    return Window.partitionBy("img_id", "y").orderBy("x")


def _column() -> WindowSpec:
    return Window.partitionBy("img_id", "x").orderBy("y")


def by_image(px: DataFrame) -> DataFrame:
    """Dealt by image: the one exchange that windows over lines, columns and images share."""
    return px.repartition("img_id")


def threshold(px: DataFrame, t: int, value: str = "v") -> DataFrame:
    """``bit``: 1 where the value is below ``t``."""
    return px.select("img_id", "y", "x", (F.col(value) < t).cast("int").alias("bit"))


def invert(px: DataFrame, bit: str = "bit") -> DataFrame:
    """0 for 1 and 1 for 0."""
    return px.withColumn(bit, 1 - F.col(bit))


def invert_box(px: DataFrame, x: int, y: int, w: int, h: int, bit: str = "bit") -> DataFrame:
    """Inversion inside a box, which the image clips."""
    inside = F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1)
    return px.withColumn(bit, F.when(inside, 1 - F.col(bit)).otherwise(F.col(bit)))


def set_pixel(px: DataFrame, x: int, y: int, value: int, d: int, column: str = "v") -> DataFrame:
    """One pixel set to the low ``d`` bits of a value; nothing outside the image."""
    at = (F.col("x") == x) & (F.col("y") == y)
    return px.withColumn(column, F.when(at, F.lit(value & ((1 << d) - 1))).otherwise(F.col(column)))


def pack_bytes(px: DataFrame, bit: str = "bit") -> DataFrame:
    """``byte`` for each eight pixels of a line, the first in the high bit, missing ones 0."""
    weight = F.col(bit) * F.pow(F.lit(2), 7 - F.col("x") % 8)
    return px.groupBy("img_id", "y", F.expr("x div 8").alias("at")).agg(F.sum(weight).cast("long").alias("byte"))


def pack_words(px: DataFrame, bit: str = "bit") -> DataFrame:
    """``word`` for each 32 pixels of a line."""
    weight = F.col(bit) * F.pow(F.lit(2), 31 - F.col("x") % 32)
    return px.groupBy("img_id", "y", F.expr("x div 32").alias("at")).agg(F.sum(weight).cast("long").alias("word"))


def lines(px: DataFrame, bit: str = "bit") -> DataFrame:
    """The line table: words of each line in order."""
    by = pack_words(px, bit).groupBy("img_id", "y").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    return by.select("img_id", "y", F.col("w.word").alias("words"))


def pad_mask(w: Column, d: Column) -> Column:
    """The 32-bit mask that keeps the pixels of a line's last word."""
    used = (w * d) % 32
    return F.when(used == 0, F.lit(0xFFFFFFFF)).otherwise(F.lit(0xFFFFFFFF) - (F.pow(F.lit(2), 32 - used) - 1).cast("long")).cast("long")


def set_pad_bits(ls: DataFrame, w: Column, d: Column, value: int) -> DataFrame:
    """Line table with the bits behind the last pixel cleared or set."""
    mask = pad_mask(w, d)
    last = F.element_at("words", -1)
    fixed = last.bitwiseAND(mask) if value == 0 else last.bitwiseOR(F.lit(0xFFFFFFFF).cast("long").bitwiseXOR(mask))
    return ls.withColumn("words", F.concat(F.slice("words", 1, F.size("words") - 1), F.array(fixed)))


def typical(px: DataFrame, bit: str = "bit") -> DataFrame:
    """For each line: same (1 if it repeats the one before), change (the bit that is coded for it)."""
    repeats = F.coalesce(F.lag(bit).over(_column()) == F.col(bit), F.lit(False))
    same = by_image(px).withColumn("repeats", repeats).groupBy("img_id", "y").agg(F.bool_and("repeats").cast("int").alias("same"))
    above = Window.partitionBy("img_id").orderBy("y")
    return same.select("img_id", "y", "same", F.col("same").bitwiseXOR(F.coalesce(F.lag("same").over(above), F.lit(0))).alias("change"))


def contexts(px: DataFrame, bit: str = "bit") -> DataFrame:
    """``ctx``: the 16-bit neighbourhood of each pixel, and its bit; 0 outside the image."""

    def shifted(c: str, k: int, over) -> Column:
        return F.coalesce(F.lag(c, k).over(over) if k >= 0 else F.lead(c, -k).over(over), F.lit(0))

    def part(dy: int) -> Column:
        dxs = [dx for y, dx in NEIGHBOURS if y == dy]
        return sum((shifted(bit, -dx, _line()) * (1 << len(dxs) - 1 - i) for i, dx in enumerate(dxs)), F.lit(0))

    kept = [c for c in px.columns if c not in ("img_id", "y", "x", bit)]
    px = px if kept else by_image(px)
    across = px.select("img_id", "y", "x", bit, *kept, part(0).alias("here"), part(-1).alias("one"), part(-2).alias("two"))
    ctx = shifted("two", 2, _column()) * (1 << 11) + shifted("one", 1, _column()) * (1 << 4) + F.col("here")
    return across.select("img_id", "y", "x", ctx.cast("int").alias("ctx"), bit, *kept)


def context_histogram(px: DataFrame, bit: str = "bit", with_typical: bool = False) -> DataFrame:
    """How often each context meets each bit; ``with_typical`` leaves repeated lines out and counts the lines' own bits."""
    px = px.select("img_id", "y", "x", bit)
    if not with_typical:
        return contexts(px, bit).groupBy("ctx", bit).agg(F.count("*").alias("n"))
    repeats = F.coalesce(F.lag(bit).over(_column()) == F.col(bit), F.lit(False))
    # each pixel learns whether its line repeats, and the first of a line also speaks for the line
    told = contexts(by_image(px).withColumn("repeats", repeats), bit)
    told = told.withColumn("same", F.min(F.col("repeats").cast("int")).over(Window.partitionBy("img_id", "y")))
    told = told.withColumn("before", F.coalesce(F.lag("same").over(_column()), F.lit(0))).withColumn("nth", F.row_number().over(_line()))
    own = F.when(F.col("same") == 0, F.struct("ctx", F.col(bit).alias("b")))
    line = F.when(F.col("nth") == 1, F.struct(F.lit(TYPICAL).alias("ctx"), F.col("same").bitwiseXOR(F.col("before")).alias("b")))
    each = told.select(F.explode(F.array_compact(F.array(own, line))).alias("s"))
    return each.groupBy(F.col("s.ctx").alias("ctx"), F.col("s.b").alias(bit)).agg(F.count("*").alias("n"))


def upscale(px: DataFrame, factor: int, value: str = "v") -> DataFrame:
    """Linear interpolation to ``factor`` times the size, rounded down; the last line and column repeat."""
    v = F.col(value)
    right = by_image(px).withColumn("r", F.coalesce(F.lead(v).over(_line()), v))
    all_four = right.withColumn("b", F.coalesce(F.lead(v).over(_column()), v)).withColumn("c", F.coalesce(F.lead("r").over(_column()), F.col("r")))
    made = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.expr(f"({(factor - i) * (factor - j)} * {value} + {(factor - i) * j} * r + {i * (factor - j)} * b + {i * j} * c) div {factor * factor}").alias("g"))
            for i in range(factor)
            for j in range(factor)
        ]
    )
    each = all_four.select("img_id", "y", "x", F.explode(made).alias("p"))
    return each.select("img_id", (F.col("y") * factor + F.col("p.i")).cast("int").alias("y"), (F.col("x") * factor + F.col("p.j")).cast("int").alias("x"), F.col("p.g").cast("long").alias(value))


def filter_sub(px: DataFrame, value: str = "v") -> DataFrame:
    """PNG filter 1: the difference to the left, modulo 256."""
    return px.withColumn("f", F.pmod(F.col(value) - F.coalesce(F.lag(value).over(_line()), F.lit(0)), F.lit(256)).cast("long"))


def filter_up(px: DataFrame, value: str = "v") -> DataFrame:
    """PNG filter 2: the difference to the line above."""
    return px.withColumn("f", F.pmod(F.col(value) - F.coalesce(F.lag(value).over(_column()), F.lit(0)), F.lit(256)).cast("long"))


def filter_average(px: DataFrame, value: str = "v") -> DataFrame:
    """PNG filter 3: the difference to the mean of left and above."""
    pair = F.coalesce(F.lag(value).over(_line()), F.lit(0)) + F.coalesce(F.lag(value).over(_column()), F.lit(0))
    return by_image(px).withColumn("f", F.pmod(F.col(value) - F.floor(pair / 2), F.lit(256)).cast("long"))


def filter_paeth(px: DataFrame, value: str = "v") -> DataFrame:
    """PNG filter 4: the difference to whichever of left, above and corner is nearest to left + above - corner."""
    near = by_image(px).withColumn("a", F.coalesce(F.lag(value).over(_line()), F.lit(0))).withColumn("b", F.coalesce(F.lag(value).over(_column()), F.lit(0)))
    near = near.withColumn("c", F.coalesce(F.lag("a").over(_column()), F.lit(0)))
    pa, pb, pc = F.abs(F.col("b") - F.col("c")), F.abs(F.col("a") - F.col("c")), F.abs(F.col("a") + F.col("b") - 2 * F.col("c"))
    guess = F.when((pa <= pb) & (pa <= pc), F.col("a")).when(pb <= pc, F.col("b")).otherwise(F.col("c"))
    return near.withColumn("f", F.pmod(F.col(value) - guess, F.lit(256)).cast("long")).drop("a", "b", "c")


def unfilter_sub(px: DataFrame, filtered: str = "f") -> DataFrame:
    """Undo filter 1: running sums along the line, modulo 256."""
    so_far = _line().rowsBetween(Window.unboundedPreceding, 0)
    return px.withColumn("v", (F.sum(filtered).over(so_far) % 256).cast("long"))


def unfilter_up(px: DataFrame, filtered: str = "f") -> DataFrame:
    """Undo filter 2: running sums down the column, modulo 256."""
    so_far = _column().rowsBetween(Window.unboundedPreceding, 0)
    return px.withColumn("v", (F.sum(filtered).over(so_far) % 256).cast("long"))


def adam7_pass(x: Column, y: Column) -> Column:
    """The interlacing pass (1 to 7) that carries a pixel."""
    from ..sources.png import ADAM7

    out = F.lit(None).cast("int")
    for i, (y0, dy, x0, dx) in reversed(list(enumerate(ADAM7, 1))):
        out = F.when((x % dx == x0) & (y % dy == y0), i).otherwise(out)
    return out


def same_size(a: DataFrame, b: DataFrame) -> DataFrame:
    """``equal`` for each image of both image tables: whether width, height and depth agree."""
    names = ("w", "h", "d")
    left, right = a.select("img_id", *[F.col(c).alias(f"a_{c}") for c in names]), b.select("img_id", *[F.col(c).alias(f"b_{c}") for c in names])
    equal = F.lit(True)
    for c in names:
        equal = equal & (F.col(f"a_{c}") == F.col(f"b_{c}"))
    return left.join(right, "img_id").select("img_id", equal.alias("equal"))
