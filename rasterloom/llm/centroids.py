"""Lloyd's clustering of integer vectors, with block-norm screening.

Vectors are quantized once and stored with a compressed form: for each segment its sum
and the norm of what the sum leaves. By Cauchy-Schwarz these bound every inner product
from above, so two compressed forms give a lower bound of the squared distance. In each
round a task bounds its vectors' distances to all centroids by one small product; the
centroid with the least bound gets the first exact distance, and of the others only
those whose bound doesn't exceed it get one. Exact distances are sums of integers.

Tasks add up counts and components for each centroid, so a round shuffles some rows for
each task and the driver holds the centroids alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import stage_table

DIMENSIONS = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
SEED = 1
#: Components in a segment of the compressed form.
SEGMENT = 8
#: Vectors that are compared at once.
BATCH = 8_192
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _narrow(dimensions: int) -> int:
    """Below this size of components squared distances fit 64 bits; others are compared as Python's integers."""
    return math.isqrt((1 << 60) // dimensions)


def compress(v: np.ndarray) -> np.ndarray:
    """For each row, the segments' sums over the root of their length, then the norms of what these leave."""
    at = range(0, v.shape[1], SEGMENT)
    parts = [v[:, i : i + SEGMENT].astype("f8") for i in at]
    sums = np.stack([p.sum(1) / np.sqrt(p.shape[1]) for p in parts], 1)
    rest = np.stack([np.sqrt(np.square(p - p.mean(1, keepdims=True)).sum(1)) for p in parts], 1)
    return np.concatenate([sums, rest], 1)


def nearest(v: np.ndarray, compressed: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each row's nearest centroid (ties: the smaller number), the squared distance (at most a long's greatest value), and how many exact distances that took."""
    if max(np.maximum(x, -(x + 1)).max() for x in (v, centroids)) >= _narrow(v.shape[1]):
        best, far, took = np.zeros(len(v), "i8"), np.zeros(len(v), "i8"), len(v) * len(centroids)
        for at in range(0, len(v), 256):  # exact at any size
            d = np.square(v[at : at + 256, None, :].astype(object) - centroids.astype(object)).sum(2)
            pick = np.array([min(range(len(centroids)), key=row.__getitem__) for row in d])
            best[at : at + 256] = pick
            far[at : at + 256] = [min(row[k], _MOST) for row, k in zip(d, pick, strict=True)]
        return best, far, took
    other = compress(centroids)
    size = np.square(compressed).sum(1)[:, None] + np.square(other).sum(1)
    # rounding is some 1e-15 of the size
    bound = size * (1 - 1e-9) - 2 * (compressed @ other.T)
    first = bound.argmin(1)
    least = np.square(v - centroids[first]).sum(1)
    exact = np.full(bound.shape, _MOST)
    exact[np.arange(len(v)), first] = least
    need = bound <= least[:, None]
    need[np.arange(len(v)), first] = False
    for k in range(len(centroids)):
        rows = np.flatnonzero(need[:, k])
        exact[rows, k] = np.square(v[rows] - centroids[k]).sum(1)
    best = exact.argmin(1)
    return best, exact[np.arange(len(v)), best], len(v) + int(need.sum())


def quantize(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """id, v (floor(scale * x) of each component), compressed; of vectors of the right length without null, infinite or undefined components."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    if not isinstance(rows.schema["vec"].dataType.elementType, T.FloatType | T.DoubleType):
        rows = rows.withColumn("vec", F.col("vec").cast("array<double>"))
    schema = T.StructType([rows.schema["id"], T.StructField("v", T.ArrayType(T.LongType())), T.StructField("compressed", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right = pc.fill_null(pc.equal(pc.list_value_length(batch.column("vec")), dimensions), False)
            held = batch.filter(right)
            x = pc.list_flatten(held.column("vec")).to_numpy(zero_copy_only=False).astype("f8").reshape(-1, dimensions)
            finite = np.isfinite(x).all(1)
            with np.errstate(over="ignore"):
                q = np.floor(x[finite] * scale)
            v = np.where(q >= 2.0**63, _MOST, np.where(q < -(2.0**63), _LEAST, np.clip(q, -(2.0**63), 2.0**63 - 1024).astype("i8")))
            yield pa.RecordBatch.from_arrays([held.column("id").filter(pa.array(finite)), _lists(v), _lists(compress(v))], names=schema.names)

    return rows.mapInArrow(run, schema)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def _compared(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH):
            batch = whole.slice(at, BATCH)
            v, compressed = (pc.list_flatten(batch.column(c)).to_numpy().reshape(batch.num_rows, -1) for c in ("v", "compressed"))
            yield batch, v, *nearest(v, compressed, centroids)[:2]


def _moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round."""
    k, n = centroids.shape
    schema = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.DecimalType(38, 0)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, "i8"), np.zeros((k, n), object)
        for _, v, best, _ in _compared(batches, centroids):
            narrow = max(int(v.max()), -int(v.min())) < _narrow(n)
            for c in np.unique(best):
                held = v[best == c]
                counts[c] += len(held)
                sums[c] += (held if narrow else held.astype(object)).sum(0)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype("i4")), pa.array(counts[met]), pa.array([[Decimal(int(x)) for x in sums[c]] for c in met], pa.list_(pa.decimal128(38, 0)))], names=schema.names)

    told = kept.select("v", "compressed").mapInArrow(run, schema).groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(n)])
    out = centroids.copy()
    for r in told.collect():
        out[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(n)]
    return out


def cluster(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, id_col: str = "vec_id", vec_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """One row per vector that is kept: id, cluster, distance, cluster_inertia, inertia, centroid (its components).

    Kept are vectors with exactly ``dimensions`` components, none null, infinite or NaN;
    each component counts as floor(scale * x). The first centroids are the vectors with the
    smallest sha256 of ``seed:id``; vectors without an id come last, and equal ids (or
    none) go by their components. With fewer vectors than centroids each vector is one;
    an empty table gives no rows. Repeated rows count each. Components beyond a long's
    range count as its end, and distances and sums beyond it are returned as its end.
    """
    spark = vectors.sparkSession
    kept = stage_table(quantize(vectors, id_col, vec_col, dimensions, scale), "vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = kept.orderBy(order.asc_nulls_last(), "v").limit(centroids).select("v").collect()
    places = np.array([r["v"] for r in first], "i8").reshape(-1, dimensions)
    if len(places):
        for _ in range(rounds):
            places = _moved(kept, places)
    schema = T.StructType([T.StructField(id_col, kept.schema["id"].dataType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, best, far in _compared(batches, places):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(best.astype("i4")), pa.array(far)], names=schema.names)

    placed = stage_table(kept.mapInArrow(run, schema), "clusters")
    sums = {r["cluster"]: int(r["d"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    table = [(k, min(d, _MOST), min(sum(sums.values()), _MOST), [int(x) for x in places[k]]) for k, d in sums.items()]
    totals = spark.createDataFrame(table, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    return placed.join(F.broadcast(totals), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def digest(centroid: str = "centroid") -> Column:
    """Lowercase hex sha256 of the components, joined by commas."""
    return F.sha2(F.array_join(F.transform(centroid, lambda x: x.cast("string")), ","), 256)
