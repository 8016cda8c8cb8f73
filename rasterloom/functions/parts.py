"""Checksums of files in parts, as an aggregate that takes the parts in any order.

Both checksums of a part say what it adds to the whole once its distance from the file's
end is known. That distance is the length of the file, which only all parts tell, less
the part's own end. A CRC-32 is a polynomial that zero bytes multiply by a power of x, and
x has an inverse modulo the CRC's polynomial, so each part is carried back by its own end
and the exclusive or of all parts is carried forth by the length. An Adler-32 is linear in
the distance. What has to be added up is thus known part by part, and Spark combines it
before it shuffles.
"""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checksums import MODULUS

#: The CRC-32 polynomial with its bits mirrored; a register's low bit is the highest power.
_MIRRORED = 0xEDB88320
#: Bits of a length.
LENGTH_BITS = 40


def _forth(crc: int) -> int:
    """Times x."""
    return crc >> 1 ^ (_MIRRORED if crc & 1 else 0)


def _back(crc: int) -> int:
    """Divided by x."""
    return (crc ^ _MIRRORED) << 1 & 0xFFFFFFFF | 1 if crc >> 31 else crc << 1


@cache
def _table(back: bool) -> str:
    """For each k, each four bits of a register and each value of them, where carrying these over 2^k zero bytes leads: a JSON list, 128 numbers of one k after the other."""
    step = _back if back else _forth
    column = [1 << bit for bit in range(32)]
    for _ in range(8):
        column = [step(c) for c in column]
    out = []
    for _ in range(LENGTH_BITS):
        out += [_sum(column[at + b] for b in range(4) if value >> b & 1) for at in range(0, 32, 4) for value in range(16)]
        # twice the way: what the bits of the one result give
        column = [_sum(column[b] for b in range(32) if c >> b & 1) for c in column]
    return str(out)


def _sum(values) -> int:
    out = 0
    for v in values:
        out ^= v
    return out


def carried(crc: Column, length: Column, back: bool = False) -> Column:
    """``crc`` over ``length`` zero bytes (below 2^40), or ``back`` over them."""
    table = F.from_json(F.lit(_table(back)), "array<bigint>")
    size = length.cast("long")
    steps = F.filter(F.sequence(F.lit(0), F.lit(LENGTH_BITS - 1)), lambda k: F.call_function("shiftright", size, k).bitwiseAND(F.lit(1)) == 1)

    def over(register: Column, k: Column) -> Column:
        # eight look-ups, not a lambda for each bit: it runs for every part and bit of its end
        at = lambda i: F.get(table, k * 128 + 16 * i + F.call_function("shiftright", register, F.lit(4 * i)).bitwiseAND(F.lit(15)).cast("int"))
        return reduce(Column.bitwiseXOR, [at(i) for i in range(8)])

    return F.aggregate(steps, crc.cast("long"), over)


def crc32_combine(first: Column, second: Column, second_length: Column) -> Column:
    """The CRC-32 of two parts one after the other; null where any of them is."""
    return F.when(second_length.isNotNull(), carried(first, second_length).bitwiseXOR(second.cast("long")))


def with_offsets(parts: DataFrame, by: list[str], seq: str = "seq", length: str = "length") -> DataFrame:
    """Parts that know their number only, with ``offset``: what the parts before them take."""
    before = Window.partitionBy(*by).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("offset", F.coalesce(F.sum(length).over(before), F.lit(0)))


def combine(parts: DataFrame, by: list[str], offset: str = "offset", length: str = "length", crc: str = "crc", adler: str = "adler") -> DataFrame:
    """One row per file: by, parts, length, complete, crc, adler of all parts together.

    ``complete`` says whether the parts cover the file from 0 to its end, each place once;
    where they don't (a part is missing, overlaps or came twice) both checksums are null.
    Empty parts change nothing; a part with a null in any of its columns makes its file
    incomplete. The order of rows plays no part.
    """
    rows = parts.select(*by, *[F.col(c).cast("long").alias(f"__{k}") for k, c in (("n", length), ("start", offset), ("crc", crc), ("adler", adler))])
    n, start = F.col("__n"), F.col("__start")
    stop = start + n
    # carried before the sums: bit_xor asks for its column twice
    rows = rows.withColumn("__carried", carried(F.col("__crc"), stop, back=True))
    known = n.isNotNull() & start.isNotNull() & F.col("__crc").isNotNull() & F.col("__adler").isNotNull()
    a, b = F.col("__adler") % 65536 - 1, F.floor(F.col("__adler") / 65536)
    mark = lambda x: F.xxhash64(x.cast("long")).cast("decimal(20,0)")
    # parts lie end to end where starts and ends, but for the first start and the last end, are the same places as often
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("parts"),
        F.max(stop).alias("length"),
        F.bool_and(known & (n >= 0) & (start >= 0)).alias("known"),
        F.sum(mark(start) - mark(stop)).alias("marks"),
        F.bit_xor("__carried").alias("crc"),
        F.sum(F.pmod(a, F.lit(MODULUS))).alias("a"),
        F.sum(F.pmod(b - n, F.lit(MODULUS))).alias("b"),
        F.sum(F.pmod(a, F.lit(MODULUS)) * F.pmod(stop, F.lit(MODULUS)) % MODULUS).alias("c"),
    )
    size, m = F.col("length"), F.lit(MODULUS)
    complete = F.coalesce(F.col("known") & (F.col("marks") == mark(F.lit(0)) - mark(size)), F.lit(False))
    low = F.pmod(F.col("a") + 1, m)
    high = F.pmod(size % MODULUS + F.col("b") % MODULUS + size % MODULUS * (F.col("a") % MODULUS) - F.col("c") % MODULUS, m)
    return sums.select(*by, "parts", "length", complete.alias("complete"), F.when(complete, carried(F.col("crc"), size)).alias("crc"), F.when(complete, high * 65536 + low).cast("long").alias("adler"))
