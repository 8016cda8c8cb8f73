"""Connected components of a link table, by alternating large-star and small-star steps.

Each step is a map-side aggregated minimum and an equi-join, written to the shared
folder; nothing of the graph reaches the driver but two sums that tell when it rests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_table, stage_table

STEPS = 60


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row per node that has a link: node, root (the smallest node reachable).

    Self-links, repeated and reversed links are harmless; links with a null end are
    ignored. An empty table gives no rows.
    """
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    edges = stage_table(pairs.where("u > v").distinct(), "edges", "snappy")
    told = _signature(edges)
    for _ in range(STEPS):
        if not told[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = stage_table(large, "large", "snappy")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u > v")
        newer = stage_table(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges", "snappy")
        drop_table(large)
        drop_table(edges)
        edges, before, told = newer, told, _signature(newer)
        if before == told:
            break
    else:
        raise RuntimeError("components didn't settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
