"""Line filters of PNG undone in DataFrame expressions, kinds mixed as files mix them.

Average and Paeth need the value to the left, which they themselves restore, and the line
above: a recurrence in two directions. It is a fold over the lines of an image that carries
the line above, and inside it a fold along the line that carries the value to the left and
the one above it. Arrays grow by chunks, so a line costs what its length says. Bytes of a
pixel's channels don't meet in any filter; ``channels`` deals them out, and each channel of
an image is a fold of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 64
_NONE = "array<array<int>>"


def guess(kind: Column, left: Column, above: Column, corner: Column) -> Column:
    """What a filter of ``kind`` adds: 1 left, 2 above, 3 their mean, 4 whichever of three is nearest to left + above - corner; else nothing."""
    far = [F.abs(above - corner), F.abs(left - corner), F.abs(left + above - 2 * corner)]
    nearest = F.when((far[0] <= far[1]) & (far[0] <= far[2]), left).when(far[1] <= far[2], above).otherwise(corner)
    return F.when(kind == 1, left).when(kind == 2, above).when(kind == 3, F.floor((left + above) / 2).cast("int")).when(kind == 4, nearest).otherwise(F.lit(0))


def _line(kind: Column, filtered: Column, above: Column, finish) -> Column:
    """``finish`` of the restored line."""
    both = F.arrays_zip(filtered.alias("f"), above.alias("b"))
    zero = F.lit(0)

    def value(s: Column, x: Column) -> Column:
        v = (x["f"] + guess(kind, s["left"], x["b"], s["corner"])).bitwiseAND(F.lit(255))
        return F.struct(v.alias("left"), x["b"].alias("corner"), F.array_append(s["out"], v).alias("out"))

    def chunk(s: Column, k: Column) -> Column:
        start = F.struct(s["left"].alias("left"), s["corner"].alias("corner"), F.array().cast("array<int>").alias("out"))
        done = lambda r: F.struct(r["left"].alias("left"), r["corner"].alias("corner"), F.array_append(s["out"], r["out"]).alias("out"))
        return F.aggregate(F.slice(both, k * CHUNK + 1, F.lit(CHUNK)), start, value, done)

    chunks = F.when(F.size(filtered) > 0, F.sequence(F.lit(0), F.floor((F.size(filtered) - 1) / CHUNK).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(chunks, F.struct(zero.alias("left"), zero.alias("corner"), F.array().cast(_NONE).alias("out")), chunk, lambda r: finish(F.flatten(r["out"])))


def unfilter(lines: DataFrame, keys: tuple[str, ...] = ("img_id",)) -> DataFrame:
    """keys, y, v of lines (keys, y, kind, f): all lines of an image have the same number of values; an image is one task's row while it is folded.

    Lines are taken in the order of y; the first has zeros above it. Kinds other than 1 to 4
    leave a line as it is.
    """
    images = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("y", "kind", F.col("f").cast("array<int>").alias("f")))).alias("lines"))
    first = F.transform(F.get("lines", F.lit(0))["f"], lambda _: F.lit(0))

    def line(s: Column, x: Column) -> Column:
        # a list of one names the line, so it is restored once
        out = lambda row: F.get(F.transform(F.array(row), lambda r: F.struct(r.alias("above"), F.array_append(s["out"], F.struct(x["y"].alias("y"), r.alias("v"))).alias("out"))), F.lit(0))
        return _line(x["kind"], x["f"], s["above"], out)

    start = F.struct(first.alias("above"), F.array().cast("array<struct<y:int,v:array<int>>>").alias("out"))
    return images.select(*keys, F.explode(F.aggregate("lines", start, line, lambda s: s["out"])).alias("line")).select(*keys, "line.y", "line.v")


def channels(lines: DataFrame, bpp: int, values: str = "f") -> DataFrame:
    """Lines of ``bpp`` bytes a pixel as a line for each ``channel``."""
    every = lambda c: F.filter(values, lambda _, i: i % bpp == c)
    parted = F.array(*[F.struct(F.lit(c).alias("channel"), every(c).alias(values)) for c in range(bpp)])
    kept = [c for c in lines.columns if c != values]
    return lines.select(*kept, F.explode(parted).alias("s")).select(*kept, "s.*")
