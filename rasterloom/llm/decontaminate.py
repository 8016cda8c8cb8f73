"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Items and documents are normalised (A-Z lower-cased, other ASCII than letters and digits
as single spaces). An item of length L is found where some window of the document is
within ``EDITS * L`` edits of it. Long items are cut into pieces of ``PIECE`` bytes or a
little more (an item below twice that is one piece), one of which then has no more than
its share k of the edits; walks part for good after many edits, so this is what keeps the
recall at every length. A piece with k edits holds at least one of its k + 1 disjoint
segments unchanged, so windows are looked at only where a segment stands: the piece-sized
window that this occurrence implies, at the word start next to it. Each window is embedded
by CGK random walks (a shared random bit for each step and character says whether the walk
moves on), which turns few edits into few differing positions; ``ROUNDS`` samples of
``BITS`` positions are the LSH keys. Before a window is embedded, its 4-grams must allow
the edits (each edit changes four at most); a window that shares a key with its piece is
verified by the exact edit distance of the whole item (infix alignment, so a window that
is off by some characters still finds the passage whole).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import stage_table

EDITS = 0.1
SEGMENT = 8
#: So many keys, and so short, that 0.99 of the seeded windows at EDITS share one; tests hold it.
WALKS, ROUNDS, BITS = 2, 64, 2
#: Length of a walk, in lengths of the piece; a step moves on every other time.
STEPS = 1.8
PIECE = 128
#: Items shorter than this, normalised, are matched as whole words: a tenth of them is no edit.
WHOLE_WORDS = 10
#: Items held by a task at once: more are taken in blocks, each a pass over the documents.
BLOCK_BYTES = 8_000_000
BATCH_BYTES = 3_000_000
#: Most keys of contaminated rows that are broadcast to drop them (some 40 MB); beyond it the join shuffles.
BROADCAST_HITS = 1_000_000
_TABLE = bytes((c | 32 if 65 <= c <= 90 else c) if c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))


def normalise(text: str | None) -> bytes:
    return b" ".join((text or "").encode().translate(_TABLE).split())


def infix_distance(item: bytes, window: bytes) -> int:
    """Least edits between the item and any part of the window, by bit-parallel columns."""
    m = len(item)
    where: dict[int, int] = {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in window:
        eq = where.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        if score < best:
            best = score
    return best


def _grams(text: np.ndarray) -> np.ndarray:
    """16-bit hashes of the 4-grams of a text, one for each place."""
    t = text.astype(np.uint32)
    return (t[:-3] | t[1:-2] << 8 | t[2:-1] << 16 | t[3:] << 24) * np.uint32(0x9E3779B1) >> np.uint32(16) if len(t) > 3 else np.zeros(0, np.uint32)


class Finder:
    """Finds a block of items in texts."""

    def __init__(self, items: list[tuple[int, bytes]], edits: float = EDITS, seed: int = 11):
        self.items = sorted(((k, t) for k, t in items if t), key=lambda x: (len(x[1]), x[1]))
        limit = lambda n: int(edits * n)
        self.edits = [limit(len(t)) for _, t in self.items]
        # by length, so windows that are embedded together need much the same steps
        pieces = sorted((n, i, at) for i, (_, t) in enumerate(self.items) for at, n in _pieces(t))
        self.sizes, self.of, self.at = (np.array([p[c] for p in pieces], np.int64) for c in range(3))
        self.limits = np.array([limit(n) for n, _, _ in pieces], np.int64)
        body = [self.items[i][1][at : at + n] for n, i, at in pieces]
        keys, whose, offsets, lengths, widths = [], [], [], [], set()
        for j, t in enumerate(body):
            parts = int(self.limits[j]) + 1
            size = len(t) // parts
            # a segment shorter than SEGMENT is its own seed, so segments stay disjoint
            width = min(SEGMENT, size)
            widths.add(width)
            for p in range(parts):
                keys.append(int.from_bytes(t[p * size : p * size + width], "little"))
                whose.append(j)
                offsets.append(p * size)
                lengths.append(size)
        order = np.argsort(np.array(keys, np.uint64), kind="stable") if keys else np.zeros(0, int)
        self.keys, self.whose, self.offsets, self.lengths = (np.array(x, d)[order] for x, d in ((keys, np.uint64), (whose, np.int64), (offsets, np.int64), (lengths, np.int64)))
        self.widths = sorted(widths)
        self.bits = max(16, int(np.ceil(np.log2(max(len(keys), 1) * 64))))
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[self._slot(self.keys)] = True
        rng = np.random.default_rng(seed)
        steps = int(STEPS * max(self.sizes, default=0)) + 2
        self.moves = rng.integers(0, 2, (WALKS, steps, 256), dtype=np.uint8)
        # positions are drawn as shares of the piece's own walk, so short ones are sampled over their length
        self.draws = rng.random((WALKS, ROUNDS, BITS)) * STEPS
        # a walk goes no further than its steps
        self.gap = gap = b"\0" * (steps + SEGMENT)
        self.text = np.frombuffer(gap.join([*body, b""]), np.uint8)
        self.places = np.cumsum(self.sizes + len(gap)) - self.sizes - len(gap)
        self.grams = [_grams(np.frombuffer(t, np.uint8)) for t in body]
        self.marks = np.zeros(1 << 16, bool)
        self.signs = self._signatures(self.text, self.places, np.arange(len(body))) if body else None

    def _slot(self, x: np.ndarray) -> np.ndarray:
        return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _held(self, piece: int, there: np.ndarray) -> int:
        """How many of the piece's 4-grams are among those of a window; hashes that collide only add to it."""
        self.marks[there] = True
        out = int(self.marks[self.grams[piece]].sum())
        self.marks[there] = False
        return out

    def _signatures(self, text: np.ndarray, starts: np.ndarray, pieces: np.ndarray) -> np.ndarray:
        """LSH keys (window, walk * ROUNDS + round) of piece-sized windows."""
        out = np.zeros((len(starts), WALKS * ROUNDS), np.uint64)
        sizes = self.sizes[pieces]
        for walk in range(WALKS):
            steps = int(sizes.max() * STEPS) + 1
            at, seen = starts.astype(np.int64), np.zeros((steps, len(starts)), np.uint8)
            for s in range(steps):
                c = text[at]
                seen[s] = c
                at += self.moves[walk, s][c]
            for r in range(ROUNDS):
                key = np.full(len(starts), walk * ROUNDS + r + 1, np.uint64)
                for b in range(BITS):
                    key = key * np.uint64(256) + seen[(self.draws[walk, r, b] * sizes).astype(np.int64), np.arange(len(starts))]
                out[:, walk * ROUNDS + r] = key
        return out

    def find(self, texts: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(text, item id, place, edits) of what is within its edits; of several places of an item in a text the best, then first."""
        if not self.items:
            return []
        gap = self.gap
        joined = gap + gap.join(texts) + gap
        text = np.frombuffer(joined, np.uint8)
        begins = np.cumsum([len(gap)] + [len(t) + len(gap) for t in texts[:-1]])
        grams = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, 8)).view("<u8").ravel() if len(text) >= 8 else np.zeros(0, np.uint64)
        spots, entries = [], []
        for width in self.widths:
            # a key's unused bytes are 0, which no text has
            seeds = grams if width == SEGMENT else grams & np.uint64((1 << 8 * width) - 1)
            hits = np.flatnonzero(self.maybe[self._slot(seeds)])
            low, high = np.searchsorted(self.keys, seeds[hits], "left"), np.searchsorted(self.keys, seeds[hits], "right")
            times = high - low
            spots.append(np.repeat(hits, times))
            entries.append(np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
            fits = np.minimum(self.lengths[entries[-1]], SEGMENT) == width
            spots[-1], entries[-1] = spots[-1][fits], entries[-1][fits]
        spot, entry = np.concatenate(spots), np.concatenate(entries)
        if not len(entry):
            return []
        for more in range(SEGMENT, int(self.lengths[entry].max())):
            longer = self.lengths[entry] > more
            same = ~longer | (text[np.minimum(spot + more, len(text) - 1)] == self.text[np.minimum(self.places[self.whose[entry]] + self.offsets[entry] + more, len(self.text) - 1)])
            spot, entry = spot[same], entry[same]
            if not len(entry):
                return []
        piece, start = self.whose[entry], spot - self.offsets[entry]
        edges = np.flatnonzero((text[1:] != 32) & ((text[:-1] == 32) | (text[:-1] == 0)) & (text[1:] != 0)) + 1
        near = np.searchsorted(edges, start)
        after, before = edges[np.minimum(near, len(edges) - 1)], edges[np.maximum(near - 1, 0)]
        snapped = np.where(np.abs(after - start) <= np.abs(start - before), after, before)
        start = np.where(np.abs(snapped - start) <= self.limits[piece], snapped, start)
        piece, start = np.unique(np.stack([piece, np.maximum(start, 0)]), axis=1)
        of = np.searchsorted(begins, start + self.sizes[piece] // 2, "right") - 1
        piece, start, of = piece[of >= 0], start[of >= 0], of[of >= 0]
        limits, ends = self.limits[piece], begins + np.array([len(t) for t in texts])
        lows, highs = np.maximum(start - 2 * limits, begins[of]), np.minimum(start + self.sizes[piece] + 2 * limits, ends[of])
        # the 4-grams first: they lose nothing, and leave few windows to embed
        least, four = self.sizes[piece] - 3 - 4 * limits, _grams(text)
        able = [self._held(j, four[a : max(b - 3, a)]) >= n for j, a, b, n in zip(piece.tolist(), lows.tolist(), highs.tolist(), least.tolist(), strict=True)]
        piece, start, of = piece[able], start[able], of[able]
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for at in range(0, len(piece), 20_000):
            j, s, there = piece[at : at + 20_000], start[at : at + 20_000], of[at : at + 20_000]
            same = (self._signatures(text, s, j) == self.signs[j]).any(1)
            for k, p, d in sorted(set(zip(self.of[j[same]].tolist(), (s[same] - self.at[j[same]]).tolist(), there[same].tolist(), strict=True))):
                body, limit = self.items[k][1], self.edits[k]
                a = max(p - 2 * limit, int(begins[d]))
                b = min(p + len(body) + 2 * limit, int(begins[d]) + len(texts[d]))
                if (had := best.get((d, k))) and had[0] == 0:
                    continue
                window = joined[a:b]
                exact = window.find(body)
                if exact < 0 and not limit or len(body) < WHOLE_WORDS and not (joined[a - 1] in b" \0" and joined[b] in b" \0"):
                    continue
                edits, place = (0, a + exact - int(begins[d])) if exact >= 0 else (infix_distance(body, window), p - int(begins[d]))
                if edits <= limit and (not had or (edits, max(place, 0)) < had):
                    best[(d, k)] = (edits, max(place, 0))
        return [(d, self.items[k][0], place, edits) for (d, k), (edits, place) in best.items()]


def _pieces(item: bytes) -> list[tuple[int, int]]:
    """(place, length) of an item's pieces, which begin at word starts where words allow it."""
    cuts, least = [0], len(item) // max(1, len(item) // PIECE)
    while len(item) - cuts[-1] >= 2 * least > 0:
        at = cuts[-1] + least
        space = item.find(b" ", at - 1, at + least // 2)
        cuts.append(space + 1 if space >= 0 else at)
    return [(a, b - a) for a, b in zip(cuts, [*cuts[1:], len(item)], strict=True)]


def blocks(items: DataFrame, item_col: str, text_col: str) -> list[DataFrame]:
    """The items in blocks that a task can hold."""
    items = items.select(item_col, text_col).distinct()
    held = items.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    n = max(1, -(-held // BLOCK_BYTES))
    return [items.where(F.pmod(F.xxhash64(item_col, text_col), F.lit(n)) == k) for k in range(n)] if n > 1 else [items]


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", edits: float = EDITS) -> DataFrame:
    """One row per (document, item) found: id, item id, place (in the normalised text), edits.

    Null and empty texts match nothing, nor do items without a letter or digit. Items of
    fewer than ten normalised bytes, too short for a tenth of edits, match as whole words.
    Items repeated under one id count once, different ones each; an item without an id is
    found under a null one. Of several places
    of an item in a text the one with the fewest edits, then the first, is told. Repeated
    documents are each matched. Either table may be empty.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    spark, kind = docs.sparkSession, items.schema[item_col].dataType
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField(item_col, kind), T.StructField("place", T.LongType()), T.StructField("edits", T.LongType())])
    found = None
    for block in blocks(items.where(F.col(item_text).isNotNull()).select(item_col, item_text), item_col, item_text):
        held = spark.sparkContext.broadcast(sorted({(r[0], normalise(r[1])) for r in block.collect()}, key=lambda x: (x[0] is not None, x)))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            finder = Finder(held.value, edits)
            for whole in batches:
                ids, texts = whole.column("id").to_pylist(), whole.column("text").to_pylist()
                at = size = 0
                out = []
                for i, t in enumerate(texts):
                    size += len(t or "") + len(finder.gap)
                    if size >= BATCH_BYTES or i + 1 == len(texts):
                        out += [(ids[at + d], k, p, e) for d, k, p, e in finder.find([normalise(x) for x in texts[at : i + 1]])]
                        at, size = i + 1, 0
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((whole.schema.field("id").type, pa.int64() if isinstance(kind, T.LongType) else None, pa.int64(), pa.int64()))], names=schema.names)

        part = rows.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found


def _key(id_col: str, text_col: str) -> Column:
    """What findings are joined back by: 128 bits of id and text, so rows that share an id are told apart, and only rows that are alike aren't."""
    both = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(text_col, F.lit("")))
    return F.unhex(F.substring(F.sha2(both, 256), 1, 32))


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", edits: float = EDITS) -> DataFrame:
    """One row per input row: id, contaminated, items (sorted ids found; one without an id isn't named), least_edits (null without a find). Rows that share an id, or have none, are each answered by their own text."""
    keyed = docs.select(id_col, _key(id_col, text_col).alias("__key"), F.col(text_col).alias("text"))
    found = stage_table(matches(keyed, items, "__key", "text", item_col, item_text, edits), "matches", "snappy")
    told = found.groupBy("__key").agg(F.array_sort(F.collect_set(item_col)).alias("items"), F.min("edits").alias("least_edits"))
    out = keyed.select(id_col, "__key").join(told, "__key", "left")
    none = F.array().cast(told.schema["items"].dataType)
    return out.select(id_col, F.col("least_edits").isNotNull().alias("contaminated"), F.coalesce("items", none).alias("items"), "least_edits")


def survivors(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", edits: float = EDITS) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns; a row stays or goes by its own text, whatever else has its id."""
    keyed = docs.select(_key(id_col, text_col).alias("__key"), F.col(text_col).alias("text"))
    hit = stage_table(matches(keyed, items, "__key", "text", item_col, item_text, edits).select("__key").distinct(), "hit", "snappy")
    small = hit.count() <= BROADCAST_HITS
    return docs.join(F.broadcast(hit) if small else hit, _key(id_col, text_col) == hit["__key"], "left_anti")
