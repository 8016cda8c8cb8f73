"""Operators on packed lines: img_id, y, w, words, a line's pixels in 32-bit words, the first in the high bit.

A row is a line, so tables have a thirty-second of the pixel table's values and far fewer
rows. Boxes are masks over words, typical prediction compares words, and contexts are cut
from windows that roll over a word and what its neighbours lend it. Bits behind the last
pixel are 0 throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .coder import TYPICAL

FULL = 0xFFFFFFFF


def _left(x: Column, n: Column | int) -> Column:
    return F.call_function("shiftleft", x, F.lit(n) if isinstance(n, int) else n.cast("int"))


def _right(x: Column, n: Column | int) -> Column:
    return F.call_function("shiftright", x, F.lit(n) if isinstance(n, int) else n.cast("int"))


def _up_to(n: Column) -> Column:
    """0 to n - 1; nothing where n is 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def _word(words: Column, at: Column) -> Column:
    return F.coalesce(F.get(words, at), F.lit(0).cast("long"))


def threshold(gray: DataFrame, t: int, values: str = "values") -> DataFrame:
    """Packed lines of lines of gray (img_id, y, ``values``): 1 where a value is below ``t``."""
    v = F.col(values)

    def word(k: Column) -> Column:
        part = F.slice(v, k * 32 + 1, F.lit(32))
        return _left(F.aggregate(part, F.lit(0).cast("long"), lambda so_far, x: so_far * 2 + (x < t).cast("long")), 32 - F.size(part))

    return gray.select("img_id", "y", F.size(v).alias("w"), F.transform(_up_to(F.ceil(F.size(v) / 32)), word).alias("words"))


def bits(words: Column, w: Column) -> Column:
    """The pixels of a line as an array of 0 and 1."""
    return F.transform(_up_to(w), lambda x: _right(_word(words, F.floor(x / 32).cast("int")), 31 - x % 32).bitwiseAND(F.lit(1)).cast("int"))


def pixels(lines: DataFrame, value: str = "bit") -> DataFrame:
    """The pixel table."""
    return lines.select("img_id", "y", F.posexplode(bits(F.col("words"), F.col("w"))).alias("x", value))


def mask(k: Column, first: Column, stop: Column) -> Column:
    """Of word ``k``, the bits of pixels from ``first`` to before ``stop``."""
    low, high = (F.least(F.greatest(x - k * 32, F.lit(0)), F.lit(32)) for x in (first, stop))
    full = F.lit(FULL).cast("long")
    return F.when(high > low, _right(full, low) - _right(full, high)).otherwise(F.lit(0).cast("long"))


def box(lines: DataFrame, x: Column | int, y: Column | int, w: Column | int, h: Column | int, op: str = "invert") -> DataFrame:
    """Pixels inside a box, which the image clips, cleared (``clear``), set (``set``) or inverted (``invert``); the box may differ by line, and lie partly or wholly outside."""
    x, y, w, h = (F.lit(v) if isinstance(v, int) else v for v in (x, y, w, h))
    change = {"clear": lambda v, m: v - v.bitwiseAND(m), "set": lambda v, m: v.bitwiseOR(m), "invert": lambda v, m: v.bitwiseXOR(m)}[op]
    stop = F.least(x + w, F.col("w"))
    touched = F.transform("words", lambda v, k: change(v, mask(k, x, stop)))
    return lines.withColumn("words", F.when((F.col("y") >= y) & (F.col("y") < y + h), touched).otherwise(F.col("words")))


def invert(lines: DataFrame) -> DataFrame:
    """0 for 1 and 1 for 0; bits behind the last pixel stay 0."""
    return lines.withColumn("words", F.transform("words", lambda v, k: v.bitwiseXOR(mask(k, F.lit(0), F.col("w")))))


def _above() -> Window:
    return Window.partitionBy("img_id").orderBy("y")


def typical(lines: DataFrame) -> DataFrame:
    """For each line: same (1 if it repeats the one before), change (the bit that is coded for it)."""
    same = F.coalesce((F.lag("words").over(_above()) == F.col("words")).cast("int"), F.lit(0))
    told = lines.withColumn("same", same)
    return told.withColumn("change", F.col("same").bitwiseXOR(F.coalesce(F.lag("same").over(_above()), F.lit(0))))


def with_contexts(lines: DataFrame) -> DataFrame:
    """The lines with ``contexts``, the 16-bit neighbourhood of each pixel: 5 above two lines up, 7 a line up, 4 to the left; 0 outside."""
    near = lines.withColumn("one", F.lag("words", 1).over(_above())).withColumn("two", F.lag("words", 2).over(_above()))

    def rolled(words: Column, k: Column, before: int, after: int) -> Column:
        """A word between the last pixels of the one before and the first of the one after."""
        lent = _left(_word(words, k - 1).bitwiseAND(F.lit((1 << before) - 1)), 32 + after)
        out = lent + _left(_word(words, k), after)
        return out + _right(_word(words, k + 1), 32 - after) if after else out

    def window(k: Column) -> Column:
        rows = (("two", 2, 2), ("one", 3, 3), ("words", 4, 0))
        return F.struct(*[rolled(F.coalesce(F.col(c), F.array().cast("array<bigint>")), k, before, after).alias(c) for c, before, after in rows])

    def cut(s: Column, j: Column) -> Column:
        two, one, here = (_right(s[c], at - j).bitwiseAND(F.lit((1 << n) - 1)) for c, at, n in (("two", 31, 5), ("one", 31, 7), ("words", 32, 4)))
        return (_left(two, 11) + _left(one, 4) + here).cast("int")

    windows = F.transform(_up_to(F.size("words")), window)
    each = F.flatten(F.transform(windows, lambda s: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda j: cut(s, j))))
    return near.withColumn("contexts", F.slice(each, F.lit(1), F.col("w"))).drop("one", "two")


def contexts(lines: DataFrame) -> DataFrame:
    """img_id, y, x, ctx, bit of each pixel."""
    both = F.arrays_zip(F.col("contexts").alias("ctx"), bits(F.col("words"), F.col("w")).alias("bit"))
    return with_contexts(lines).select("img_id", "y", F.posexplode(both).alias("x", "s")).select("img_id", "y", "x", "s.*")


def context_histogram(lines: DataFrame, with_typical: bool = False) -> DataFrame:
    """How often each context meets each bit; ``with_typical`` leaves repeated lines out and counts the lines' own bits. Lines are dealt by image once; pixels leave their task as counts only."""
    own = F.arrays_zip(F.col("contexts").alias("ctx"), bits(F.col("words"), F.col("w")).alias("bit"))
    told = with_contexts(typical(lines) if with_typical else lines)
    if with_typical:
        line = F.array(F.struct(F.lit(TYPICAL).alias("ctx"), F.col("change").alias("bit")))
        own = F.concat(F.when(F.col("same") == 0, own).otherwise(F.slice(own, 1, 0)), line)
    return told.select(F.explode(own).alias("s")).groupBy("s.ctx", "s.bit").agg(F.count("*").alias("n")).select("ctx", "bit", "n")
