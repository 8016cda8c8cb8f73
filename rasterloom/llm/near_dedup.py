"""Near-duplicate classes: SetSketch registers, banding, likelihood estimate, exact verification.

1. Every text becomes its set of word shingles (64-bit hashes) and ``REGISTERS``
   SetSketch registers: the least hash under each of as many mixes, turned into an
   exponential variate and floored on a geometric scale. Registers merge by maximum.
2. Texts with one set are one class and go on as its smallest id.
3. Bands of registers are hashed into buckets. A bucket's members are compared with one
   hub, the member that shares most buckets, so a group of n copies costs n comparisons.
   Components are formed, and buckets that still span several take another hub, until a
   round finds nothing.
4. What such buckets still hold apart is compared by a bounded join: shingles are ordered
   by how many of these texts have them, and a pair that is similar enough has its first
   common shingle near the front of both, with enough left behind it. Pairs of one
   component are not formed, and a pair must share a band.
5. Each pair of 3 and 4 goes through the joint likelihood of two sketches and the known set
   sizes; pairs far below the threshold are dropped, all others are verified on their full
   sets. A link is lost only if no band is shared: (1 - s^4)^32, about 5e-6 at similarity
   0.75.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import fresh, join_split, scratch, stage_table, trim

WORDS = 5
#: Similarity in hundredths.
THRESHOLD = 75
REGISTERS, ROWS = 128, 4
BASE, RATE, TOP = 1.001, 20.0, 65534
#: A pair is verified if its estimate is at least this; five standard errors below the threshold.
ESTIMATE = 0.55
#: Most ids that are broadcast to fetch texts or to drop rows (some 30 MB); beyond it the join shuffles.
BROADCAST_IDS = 1_000_000
#: Members of a bucket that a task gets at most; a larger one is dealt over several, each with its hub.
MEMBERS = 256
#: Most rounds of hubs; the bounded join takes what they leave.
ROUNDS = 6
_MEMO = 300_000
#: Shingles whose sets a verifying task keeps.
CACHED = 3_000_000


def _mixes() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1, 1 << 62, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)


def _blend(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Distinct shingle hashes of texts; words are runs without ASCII white space, A-Z lower-cased."""

    def __init__(self, words: int = WORDS):
        self.words, self.memo = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted 64-bit hashes; a text of fewer words is one shingle, one without words none."""
        tokens = (text or "").encode().lower().split()
        if not tokens:
            return np.zeros(0, np.uint64)
        memo = self.memo
        if len(memo) > _MEMO:
            memo.clear()
        try:
            h = np.array([memo[t] for t in tokens], np.uint64)
        except KeyError:
            for t in set(tokens).difference(memo):
                memo[t] = xxhash.xxh3_64_intdigest(t)
            h = np.array([memo[t] for t in tokens], np.uint64)
        k = min(self.words, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = _blend(out * np.uint64(0xD6E8FEB86659FD93) + h[i : len(h) - k + 1 + i])
        return np.unique(out)


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers (uint16) of each non-empty set."""
    flat, starts = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), REGISTERS), np.uint16)
    for r, (m, b) in enumerate(zip(*_mixes(), strict=True)):
        v = flat * m
        v += b
        v ^= v >> np.uint64(31)
        v *= np.uint64(0xBF58476D1CE4E5B9)
        low = (np.minimum.reduceat(v, starts).astype(np.float64) + 0.5) / 2.0**64
        exponential = -np.log1p(-np.minimum(low, 1 - 1e-16)) / RATE
        out[:, r] = np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)) + TOP // 4, 0, TOP + 1)
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of a union."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of sketched pairs with known set sizes, on a grid of hundredths."""
    above, below = (a > b).sum(1), (a < b).sum(1)
    same = REGISTERS - above - below
    u = na / (na + nb)
    v = 1 - u
    grid = np.linspace(0, 1, 101)[None, :]
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
    pa_, pb = p(u[:, None] - v[:, None] * grid), p(v[:, None] - u[:, None] * grid)
    ps = np.clip(1 - pa_ - pb, 1e-12, 1)
    score = above[:, None] * np.log(pa_) + below[:, None] * np.log(pb) + same[:, None] * np.log(ps)
    score[grid > np.minimum(u / v, v / u)[:, None] + 1e-9] = -np.inf
    return score.argmax(1) / 100


def signatures(rows: DataFrame, words: int) -> DataFrame:
    """Of rows (id, text): id, n (set size), whole (128-bit hash of the set), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                sets = [shingles(t) for t in batch.column("text").to_pylist()]
                full = [s for s in sets if len(s)]
                made = iter(sketch(full) if full else [])
                kept = [next(made).tobytes() if len(s) else None for s in sets]
                names = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()), pa.array(kept, pa.binary())], names=["id", "n", "whole", "sketch"])
        del shingles
        trim()

    return rows.select("id", "text").mapInArrow(run, "id bigint, n bigint, whole binary, sketch binary")


def _bands(sketch: Column) -> Column:
    """One key for each band of a sketch."""
    wide = 2 * ROWS
    return F.array(*[F.xxhash64(F.substring(sketch, 1 + wide * k, wide), F.lit(k)) for k in range(REGISTERS // ROWS)])


def _estimated(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Of a written table of distinct pairs (a, b), those that share a band and whose sketches don't rule them out."""
    of = lambda c: reps.select(F.col("id").alias(c), F.col("sketch").alias(f"s{c}"), F.col("n").alias(f"n{c}"))
    held = join_split(join_split(pairs, of("a"), "a", "b"), of("b"), "b", "a", pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("sa", "sb"))
                na, nb = (batch.column(c).to_numpy().astype(float) for c in ("na", "nb"))
                keep = (a == b).reshape(len(a), -1, ROWS).all(2).any(1)
                keep[keep] = estimate(a[keep], b[keep], na[keep], nb[keep]) >= ESTIMATE
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    return held.select("a", "b", "sa", "sb", "na", "nb").mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, threshold: int) -> DataFrame:
    """Of a written table of pairs (a, b), those whose full shingle sets are similar enough."""
    of = lambda c: texts.select(F.col("id").alias(c), F.col("text").alias(f"t{c}"))
    held = join_split(join_split(pairs, of("a"), "a", "b"), of("b"), "b", "a", pairs).select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, made, size = Shingler(words), {}, 0

        def of(text: pa.Scalar) -> np.ndarray:
            nonlocal size
            key = xxhash.xxh3_128_digest(text.as_buffer())
            if key not in made:
                if size > CACHED:
                    made.clear()
                    size = 0
                made[key] = shingles(text.as_py())
                size += len(made[key])
            return made[key]

        for batch in batches:
            keep, ta, tb = [], batch.column("ta"), batch.column("tb")
            for i in range(batch.num_rows):
                one, other = of(ta[i]), of(tb[i])
                both = _common(one, other)
                keep.append(100 * both >= threshold * (len(one) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        shingles, made = None, {}
        trim()

    return held.mapInArrow(run, "a bigint, b bigint")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable), kept.

    Two texts are linked when 100 * common shingles >= threshold * united shingles. A text
    of fewer than ``words`` words is one shingle; null, empty and blank texts have none and
    are linked with nothing. Ids are integers; rows that repeat an id are one document,
    which has the links of all its texts. A row without an id is in no component
    (component_id null) and kept. An empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    made = stage_table(signatures(rows, words), "signatures")
    # equal sets have equal sizes and sketches, so any of them will do
    sets = made.where("n > 0 and id is not null").groupBy("whole").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    reps = stage_table(sets, "reps")
    with scratch(docs.sparkSession) as keep:
        links = _links(reps, rows, words, threshold).unionByName(_other_texts(made))
        roots = keep(stage_table(components(links), "roots", "snappy"))
    rep = F.when(F.col("id").isNotNull(), F.coalesce("rep", "id"))
    out = made.select("id", "n", "whole").join(reps.select("whole", F.col("id").alias("rep")), "whole", "left").select("id", "n", rep.alias("rep"))
    out = out.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component_id", F.coalesce("root", "rep"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _other_texts(made: DataFrame) -> DataFrame:
    """Links between the sets of ids that have several: the smallest id of each set of theirs."""
    again = made.where("id is not null and n > 0").groupBy("id").agg(F.min("whole").alias("x"), F.max("whole").alias("y")).where("x != y").select("id")
    whole = made.join(again, "id", "left_semi").select("whole").distinct()
    return made.where("id is not null").join(whole, "whole", "left_semi").groupBy("whole").agg(F.min("id").alias("a"), F.collect_set("id").alias("b")).select("a", F.explode("b").alias("b"))


def _lane(size: str) -> Column:
    """Which of its bucket's lanes an id is in."""
    return F.pmod(F.xxhash64("id"), F.ceil(F.col(size) / MEMBERS)).cast("int").alias("lane")


def _lanes(buckets: DataFrame) -> DataFrame:
    """A row for each lane of each bucket (key, size)."""
    lanes = F.sequence(F.lit(0), F.ceil(F.col("size") / MEMBERS).cast("int") - 1)
    return buckets.withColumn("lane", F.explode(lanes)).drop("size")


def _links(reps: DataFrame, rows: DataFrame, words: int, threshold: int) -> DataFrame:
    """Links that join what belongs together: of each component found by hubs a star, and what crosses these."""
    spread = reps.select("id", F.explode(_bands(F.col("sketch"))).alias("key"))
    full = spread.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    inside = stage_table(spread.join(full, "key").select("key", _lane("size"), "id", "size"), "buckets")
    weight = inside.groupBy("id").agg(F.sum("size").alias("weight"))
    ids = inside.select("id").distinct()
    texts = stage_table(rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi"), "texts")
    live = inside.join(weight, "id").select("key", "lane", "id", "size", "weight", F.col("id").alias("root"))
    bucket = ["key", "lane"]
    links = roots = None
    for _ in range(ROUNDS):
        live = stage_table(live, "live", "snappy")
        best = F.max(F.struct("weight", (-F.col("id")).alias("less"), "id", "root"))
        hubs = _lanes(live.groupBy("key").agg(best.alias("hub"), F.first("size").alias("size")))
        met = live.join(hubs, bucket).where("root != hub.root").select(F.col("hub.id").alias("a"), F.col("id").alias("b")).distinct()
        near = stage_table(_estimated(stage_table(met, "met", "snappy"), reps), "candidates", "snappy")
        found = stage_table(_verified(near, texts, words, threshold), "links", "snappy")
        links = found if links is None else links.unionByName(found)
        last = found.isEmpty()
        if roots is None or not last:
            roots = stage_table(components(links), "roots", "snappy")
        rest = live.join(hubs.select(*bucket, F.col("hub.id").alias("hub")), bucket).where("id != hub").drop("root", "hub")
        rest = rest.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        apart = _lanes(rest.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.first("size").alias("size")).where("x != y"))
        live = rest.join(apart, bucket, "left_semi").select(*bucket, "id", "size", "weight", "root")
        if last:
            break
    met = stage_table(_crossing(stage_table(live.select("id", "root").distinct(), "apart", "snappy"), texts, words, threshold), "met", "snappy")
    crossing = _verified(stage_table(_estimated(met, reps), "candidates", "snappy"), texts, words, threshold)
    return crossing.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))


def _crossing(apart: DataFrame, texts: DataFrame, words: int, threshold: int) -> DataFrame:
    """Pairs (a, b) of different components among the texts of ``apart`` (id, root) that may be similar enough; loses none that are.

    The common shingles of a pair that is similar enough are at least
    threshold * (na + nb) / (100 + threshold). In an order of all shingles that both texts
    keep, none of them stands before the first, so both have as many from there on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for batch in batches:
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = shingles(text)
                if n := len(own):
                    name = xxhash.xxh3_64_intdigest(text) - (1 << 63)
                    yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.full(n, key)), pa.array(np.full(n, name)), pa.array(np.full(n, n))], names=["h", "id", "name", "n"])

    held = texts.join(apart, "id", "left_semi").select("id", "text").distinct().mapInArrow(run, "h bigint, id bigint, name bigint, n bigint")
    held = stage_table(held, "shingles")
    often = held.groupBy("h").agg(F.count("*").alias("f")).where("f > 1")
    own = Window.partitionBy("id", "name")
    # shingles of one text only come first, and need no row
    at = (F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("f", "h")) - 1).alias("at")
    placed = held.join(often, "h").select("h", "id", "n", at).where((F.col("n") - F.col("at")) * 100 >= threshold * F.col("n"))
    placed = stage_table(placed.join(apart, "id"), "prefixes", "snappy")
    # of the components that meet at a shingle the largest isn't compared with itself
    most = placed.groupBy("h", "root").agg(F.count("*").alias("size")).groupBy("h").agg(F.max_by("root", F.struct("size", "root")).alias("most"), F.count("*").alias("roots"))
    placed = placed.join(most.where("roots > 1"), "h").withColumn("major", F.col("root") == F.col("most"))
    short = placed.where((F.col("n") - F.col("at")) * (100 + threshold) >= 2 * threshold * F.col("n")).select("h", F.col("major").cast("int").alias("lane"), *[F.col(c).alias(f"{c}1") for c in ("id", "root", "n", "at")])
    long = placed.select("h", F.explode(F.when(F.col("major"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("lane"), *[F.col(c).alias(f"{c}2") for c in ("id", "root", "n", "at")])
    left = F.least(F.col("n1") - F.col("at1"), F.col("n2") - F.col("at2"))
    order = (F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("id1") < F.col("id2")))
    fits = (F.col("root1") != F.col("root2")) & order & (left * (100 + threshold) >= threshold * (F.col("n1") + F.col("n2")))
    both = short.alias("s").join(long.alias("l"), (F.col("s.h") == F.col("l.h")) & (F.col("s.lane") == F.col("l.lane")) & fits)
    return both.select(F.col("id1").alias("a"), F.col("id2").alias("b")).distinct()


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay: one for each component, the one with the smallest id; rows without an id are in none and all stay."""
    name = fresh(docs, "dropped")
    gone = classes(docs, id_col, text_col, words, threshold).where("not kept").select(F.col(id_col).alias(name)).distinct()
    gone = stage_table(gone, "dropped", "snappy")
    small = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if small else gone, docs[id_col].cast("long") == gone[name], "left_anti")
