"""Adler-32 and CRC-32 of binaries, as columns, with the rules that join parts."""

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODULUS = 65521
_POLYNOMIAL = 0x104C11DB7


def crc32(data: Column) -> Column:
    return F.crc32(data)


def adler32(data: Column) -> Column:
    """Adler-32 of each binary, in Arrow batches; null stays null."""
    return _adler32(data)


@F.pandas_udf(T.LongType())
def _adler32(data: pd.Series) -> pd.Series:
    return data.map(zlib.adler32, na_action="ignore").astype("Int64")


def adler32_native(data: Column) -> Column:
    """The same without Python: a = 1 + sum of the bytes, b = sum of all values of a, both modulo 65521. Slower, as each byte is an interpreted step."""
    digits = F.regexp_extract_all(F.hex(data), F.lit(".."), F.lit(0))
    start = F.struct(F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))

    def step(s: Column, x: Column) -> Column:
        a = (s["a"] + F.conv(x, 16, 10).cast("long")) % MODULUS
        return F.struct(a.alias("a"), ((s["b"] + a) % MODULUS).alias("b"))

    return F.aggregate(digits, start, step, lambda s: s["b"] * 65536 + s["a"])


def adler32_combine(first: Column, second: Column, second_length: Column) -> Column:
    """The checksum of two parts one after the other."""
    a1, b1 = first % 65536, F.floor(first / 65536)
    a2, b2 = second % 65536, F.floor(second / 65536)
    a = F.pmod(a1 + a2 - 1, F.lit(MODULUS))
    b = F.pmod(b1 + b2 + second_length % MODULUS * F.pmod(a1 - 1, F.lit(MODULUS)), F.lit(MODULUS))
    return (b * 65536 + a).cast("long")


# A CRC is the remainder of a polynomial over GF(2), its coefficients from x^0 in the top bit
# down to x^31. Below, polynomials are integers with the coefficient of x^k in bit k.


def _mirrored(crc: int) -> int:
    return int(f"{crc:032b}"[::-1], 2)


def _remainder(p: int) -> int:
    while p >> 32:
        p ^= _POLYNOMIAL << p.bit_length() - 33
    return p


def _product(p: int, q: int) -> int:
    """p * q modulo the CRC's polynomial."""
    out = 0
    while q:
        low = q & -q
        out ^= p * low
        q ^= low
    return _remainder(out)


def _power(bits: int) -> int:
    """x^bits modulo the CRC's polynomial: halves of the exponent, squared."""
    if bits < 32:
        return 1 << bits
    half = _power(bits // 2)
    return _remainder(_product(half, half) << bits % 2)


def crc32_shift(crc: int, length: int) -> int:
    """``crc`` carried over ``length`` zero bytes: times x^(8 * length)."""
    return _mirrored(_product(_mirrored(crc), _power(8 * length)))


def crc32_combine(first: int, second: int, second_length: int) -> int:
    """The CRC of two parts one after the other."""
    return crc32_shift(first, second_length) ^ second
