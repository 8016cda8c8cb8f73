"""Exact deduplication: 128-bit content hash groups with a byte comparison inside them.

Plan: one narrow pass writes ``(id, hash, length)``; groups are aggregated once with
map-side partials, so a group holding a third of all rows is a few partial rows, and only
groups of two or more are joined back: a row without a partner keeps itself. Texts move
only for hashes that occur twice or more, pre-aggregated by their bytes, to prove that
one hash means one text. Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh, stage_table

#: Most repeated hashes (32 hex digits each, some 50 MB) and most ids of dropped rows that are broadcast; beyond it the joins shuffle.
BROADCAST_HASHES, BROADCAST_IDS = 400_000, 1_000_000


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def content_hash(norm: Column) -> Column:
    """First 128 bits of SHA-256, as hex."""
    return F.substring(F.sha2(norm, 256), 1, 32)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of=content_hash) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Equal means identical bytes after deleting ASCII white space. Of equal texts the
    one with the most code points stays, then the smallest id (a null id sorts first).
    Null and empty texts are one group. Rows that repeat the winner's id and text all
    report ``kept``; ``survivors`` returns such a row once. An empty table gives no rows.
    Other columns of ``docs``, whatever their names, are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    norm = normalised(F.col("text"))
    hashed = rows.select("id", norm.alias("norm"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("points"))
    digest = stage_table(hashed.select("id", "points", F.sha2("norm", 256).alias("sha"), hash_of(F.col("norm")).alias("h")), "digest")
    part = F.lit("")
    repeated = stage_table(_best(digest.withColumn("part", part)), "repeated")
    many = repeated.count()
    small = (lambda df: F.broadcast(df)) if many <= BROADCAST_HASHES else (lambda df: df)
    if many:
        texts = rows.select(norm.alias("norm")).withColumn("h", hash_of(F.col("norm"))).join(small(repeated.select("h")), "h", "left_semi")
        variants = texts.groupBy("h", "norm").agg(F.count("*").alias("n"))
        clashes = stage_table(variants.groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1").select("h"), "clashes")
        if not clashes.isEmpty():
            # one hash, several texts: these go by their full digest
            digest = digest.join(clashes.withColumn("clash", F.lit(True)), "h", "left")
            part = F.when(F.col("clash"), F.col("sha")).otherwise("")
            split = _best(digest.where("clash").withColumn("part", part))
            repeated = stage_table(repeated.join(clashes, "h", "left_anti").unionByName(split), "repeated")
    out = digest.withColumn("part", part).join(small(repeated), ["h", "part"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return out.select(F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"))


def _best(digest: DataFrame) -> DataFrame:
    """h, part, group_size, keep_id of the groups of two rows or more."""
    held = digest.groupBy("h", "part").agg(F.count("*").alias("group_size"), F.min(F.struct((-F.col("points")).alias("less"), "id")).alias("best"))
    return held.where("group_size > 1").select("h", "part", "group_size", F.col("best.id").alias("keep_id"))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; a repeated row stays once.

    The rows that go are dropped by id, so texts don't move. Only rows that share an id
    with one that stays are told apart by their texts; of those with one id and one
    normalised text the longest stays.
    """
    told = stage_table(groups(docs, id_col, text_col).select(F.col(id_col).alias("id"), "kept", "text_sha256"), "told")
    by_id = told.groupBy("id").agg(F.count("*").alias("n"), F.count_if("kept").alias("k"))
    key = fresh(docs, "of")
    gone = stage_table(by_id.where("k = 0").select(F.col("id").alias(key)), "gone", "snappy")
    mixed = stage_table(by_id.where("k > 0 and n > 1").select(F.col("id").alias(key)), "mixed", "snappy")
    # the only row without an id that is dropped shares its group with one that is kept
    same = lambda other: docs[id_col].eqNullSafe(other[key])
    small = (lambda df: F.broadcast(df)) if gone.count() <= BROADCAST_IDS else (lambda df: df)
    plain = docs.join(small(gone), same(gone), "left_anti")
    if mixed.isEmpty():
        return plain
    plain = plain.join(mixed, plain[id_col].eqNullSafe(mixed[key]), "left_anti")
    sha, rank = (fresh(docs, n) for n in ("sha", "rank"))
    rest = docs.join(mixed, same(mixed), "left_semi").withColumn(sha, F.sha2(normalised(F.col(text_col)), 256))
    kept = told.where("kept").select(F.col("id").alias(key), F.col("text_sha256").alias(rank)).distinct()
    rest = rest.join(kept, rest[id_col].eqNullSafe(kept[key]) & (rest[sha] == kept[rank]), "left_semi")
    line = Window.partitionBy(id_col, sha).orderBy(F.length(text_col).desc_nulls_last(), text_col)
    return plain.unionByName(rest.withColumn(rank, F.row_number().over(line)).where(F.col(rank) == 1).select(*docs.columns))
