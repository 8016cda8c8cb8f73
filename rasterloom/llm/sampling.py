"""A bounded sample of labelled rows, for fitting classifiers on the driver."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keeps the choice apart from others made by a plain hash of the key.
_SALT = "bounded"


def place(key: str, salt: str = _SALT) -> Column:
    """A row's place in a fixed random order of the keys, over all 64-bit integers."""
    return F.xxhash64(F.col(key), F.lit(salt))


def limit(share: float, least: int | None) -> int:
    """The place below which a share of all rows lies; above ``least``, the first of them, so some row is always drawn."""
    share = int(min(share, 1.0) * 2.0**64) - (1 << 63)
    return min(max(share, share if least is None else least + 1), (1 << 63) - 1)


def level(sizes: list[int], most: float) -> float:
    """The cap under which ``sizes``, each cut to it, sum to ``most``; infinite where they are within it."""
    if sum(sizes) <= most:
        return float("inf")
    for i, size in enumerate(ordered := sorted(sizes)):
        if size * (len(ordered) - i) >= most:
            return most / (len(ordered) - i)
        most -= size
    return float("inf")


def bounded_by(rows: DataFrame, by: str, key: str, text: str, most_rows: int, most_bytes: int) -> pd.DataFrame:
    """As ``bounded``, with equal bounds for each value of ``by``; what small groups leave over goes to the others."""
    held = rows.groupBy(by).agg(F.count("*").alias("n"), F.sum(F.octet_length(text)).alias("size"), F.min(place(key)).alias("least")).collect()
    top, wide = level([r["n"] for r in held], most_rows), level([r["size"] for r in held], most_bytes)
    shares = [(r[by], min(1.0, top / r["n"], wide / max(r["size"], 1)), r["least"]) for r in held]
    if any(s < 1 for _, s, _ in shares):
        table = rows.sparkSession.createDataFrame([(v, s >= 1, limit(s, least)) for v, s, least in shares], f"`{by}` {rows.schema[by].dataType.simpleString()}, __all boolean, __most bigint")
        rows = rows.join(F.broadcast(table), by).where(F.col("__all") | (place(key) < F.col("__most"))).select(rows.columns)
    return rows.toPandas().sort_values(key).reset_index(drop=True)


def bounded(rows: DataFrame, key: str, text: str, most_rows: int, most_bytes: int) -> pd.DataFrame:
    """About ``most_rows`` rows or ``most_bytes`` of text at most, whichever is less, chosen by the hash of ``key``.

    The same rows give the same sample, in the order of ``key``. All rows are returned
    where both bounds hold them, and one at least where there are any. Texts are taken whole.
    """
    n, held, least = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)), F.min(place(key))).first()
    share = min(1.0, most_rows / max(n, 1), most_bytes / max(held, 1))
    if share < 1:
        rows = rows.where(place(key) < limit(share, least))
    return rows.toPandas().sort_values(key).reset_index(drop=True)
