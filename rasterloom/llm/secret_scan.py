"""Secret scan over an incremental blob ledger, in built-in functions only.

Every version of a text is addressed by its SHA-256. A ledger remembers which
(blob, rule version) pairs were scanned and what was found; a run scans only the
blobs that are new under its rules, each once however many paths hold it, and joins
the findings back to all paths. Start and end of the matches come from splitting a
text at them: the lengths of the pieces and matches before one add up to its place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import new_path, stage_table

#: Most unseen blobs whose ids are broadcast; beyond it the join shuffles.
BROADCAST_BLOBS = 20_000


@dataclass(frozen=True)
class Rule:
    """kind, pattern, the group whose length counts, least length, and a literal every match holds."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    holds: str = ""


# The rules, in their order of precedence.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, "AKIA"),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{32,}", 0, 32),
)
EXTRA = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{20,}", 0, 24, "gh"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, "eyJ"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, "PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1, "xox"),
)
RULES = BASE + EXTRA
VERSION = "1"

FINDING = "blob string, kind string, rank int, start bigint, end bigint"


def blob_of(text: Column) -> Column:
    """Content address of a text; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _hits(text: Column, rule: Rule) -> Column:
    got = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    return F.when(text.contains(rule.holds), got).otherwise(F.array().cast("array<string>")) if rule.holds else got


def find(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All findings in ``texts`` (blob, text): one row per match that is long enough; leftmost, not overlapping per kind."""
    text = F.col("text")
    tried = F.array(*[F.struct(F.lit(k).alias("rank"), _hits(text, r).alias("m")) for k, r in enumerate(rules)])
    hits = texts.withColumn("copy", F.monotonically_increasing_id()).select("blob", "copy", "text", F.explode(tried).alias("t")).where(F.size("t.m") > 0)
    pieces, passes, kind = F.lit(None).cast("array<string>"), F.lit(False), F.lit(None).cast("string")
    for k, r in reversed(list(enumerate(rules))):
        mine = F.col("t.rank") == k
        pieces = F.when(mine, F.split(text, r.pattern, -1)).otherwise(pieces)
        long = F.length(F.regexp_extract("match", r.pattern, r.group)) if r.group else F.length("match")
        passes = F.when(F.col("rank") == k, long >= r.least).otherwise(passes)
        kind = F.when(F.col("rank") == k, F.lit(r.kind)).otherwise(kind)
    each = hits.select("blob", "copy", F.col("t.rank").alias("rank"), F.posexplode(F.arrays_zip(pieces.alias("piece"), F.col("t.m").alias("match"))).alias("at", "x"))
    each = each.select("blob", "copy", "rank", "at", F.col("x.match").alias("match"), F.length("x.piece").alias("skip"))
    so_far = Window.partitionBy("blob", "copy", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("skip") + F.coalesce(F.length("match"), F.lit(0))).over(so_far)
    placed = each.withColumn("end", end).where(F.col("match").isNotNull() & passes)
    return placed.select("blob", kind.alias("kind"), "rank", (F.col("end") - F.length("match")).cast("long").alias("start"), F.col("end").cast("long").alias("end"))


class BlobLedger:
    """Scanned (blob, rule version) pairs and their findings, as two growing Parquet tables."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, table: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{table}")
        except Exception as e:  # an absent table is an empty one
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def scanned(self) -> DataFrame:
        return self._read("scanned", "blob string, version string").distinct()

    def findings(self, version: str) -> DataFrame:
        """Findings under one version; a run that died between its two writes leaves repeats, which are dropped."""
        kept = self._read("findings", FINDING + ", version string")
        return kept.where(F.col("version") == version).drop("version").distinct()

    def update(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES, version: str = VERSION) -> int:
        """Scan the blobs of ``versions`` (row id, blob, text) that ``version`` has not seen; how many there were."""
        seen = self.scanned().where(F.col("version") == version).select("blob")
        firsts = versions.groupBy("blob").agg(F.min("row").alias("row"))
        unseen = stage_table(firsts.join(seen, "blob", "left_anti"), "unseen")
        n = unseen.count()
        if n:
            bounded = F.broadcast(unseen) if n <= BROADCAST_BLOBS else unseen
            texts = versions.join(bounded, versions.row.eqNullSafe(unseen.row) & (versions.blob == unseen.blob), "left_semi").select("blob", "text")
            find(texts, rules).withColumn("version", F.lit(version)).write.mode("append").parquet(f"{self.path}/findings")
            unseen.select("blob", F.lit(version).alias("version")).write.mode("append").parquet(f"{self.path}/scanned")
        return n


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, version: str = VERSION, ledger: str | None = None) -> DataFrame:
    """One row per input row: id, blob, found (array of kind, rank, start, end, sorted by start, then rule).

    ``ledger`` is a folder that later runs pass again; without one a new ledger starts in
    the shared folder. Null texts count as empty and hold nothing. Rows that repeat a text
    share its findings; a repeated (id, text) is scanned once. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("row"), blob_of(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    book = BlobLedger(spark, ledger or new_path(spark, "ledger"))
    book.update(rows, rules, version)
    spans = F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "end")))
    told = book.findings(version).groupBy("blob").agg(spans.alias("found"))
    return rows.select("row", "blob").join(told, "blob", "left").select(F.col("row").alias(id_col), "blob", F.coalesce("found", F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")).alias("found"))
