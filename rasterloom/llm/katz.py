"""Katz backoff language model over words: Good-Turing discounts, exactly normalised backoff.

Order two over one: P(w | v) = d(c) c(v, w) / (c(v) + 1) where (v, w) was seen, else
alpha(v) P(w), with P(w) itself discounted and backed off to unseen words. alpha(v) is
what the seen continuations leave over, divided by the unigram mass of the unseen ones;
the one pseudo-count keeps it positive where no count is low enough for a discount.
Every training word is a context, at any size of the input. A third order would double
what is shuffled and stored, beyond four times the input.

How it scales: frequent words get 18-bit numbers from a bounded broadcast table. Tasks
pack the word pairs of a block of documents into byte columns, at most one record for each
of P partitions (a hash of the pair, P grows with the tokens), so Spark moves a few large
records rather than a row for each token; a record holds its pairs and nothing of the
length of the block, and none is made without pairs. A pair that a block has ``OFTEN``
times or more is sent once, with its count, and the partition answers with its count in
the whole corpus, which the block applies to its documents: no pair is a hot key beyond an
entry for each block. Of the other pairs the partition answers with sums for the documents
that have them. Each partition stores its counts as its part of the model; the discounts
and the numbered contexts' alpha are bounded. Contexts without a number go by their 64-bit
hash: a pair of such a context and a numbered word is counted where the context's hash
belongs, a pair with another such word where that word's hash belongs (its count is known
there). Both send what the context's alpha needs, and the places that need alpha, to the
partition of the context's hash, which answers the blocks.

A stored model scores further documents: its partitions join their records as a block that
has counts and no documents, so both ways run the same evaluation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop_table, fresh, stage_table, trim

BITS = 18
#: Words that have a number, one number being kept for the start of a text and one for all other contexts.
NUMBERED = (1 << BITS) - 2
#: Highest count that is discounted.
LOW = 5
BLOCK_DOCS, BLOCK_BYTES = 2000, 2_000_000
#: From so many times in a block on, a pair is sent once.
OFTEN = 16
#: Marks a training document in a document's place in its block.
_TRAIN = 1 << 15
#: Tokens a partition of pairs gets on average.
PART_TOKENS = 2_000_000
SLICES = 16
NONE = np.uint32(0xFFFFFFFF)
_MEMO = 250_000
_RECORD = "kind int, part bigint, block bigint, data array<binary>"
_GOLD = np.uint64(0x9E3779B97F4A7C15)
END = xxhash.xxh3_64_intdigest(b"")


class Hasher:
    """Word hashes of texts: words are runs without ASCII white space, A-Z lower-cased; each text gets one end."""

    def __init__(self):
        self.memo: dict[bytes, int] = {}

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All hashes, and how many each text has."""
        memo, out, sizes = self.memo, [], []
        if len(memo) > _MEMO:
            memo.clear()
        for text in texts:
            words = (text or "").encode().lower().split()
            try:
                out += [memo[w] for w in words]
            except KeyError:
                for w in set(words).difference(memo):
                    memo[w] = xxhash.xxh3_64_intdigest(w)
                out += [memo[w] for w in words]
            out.append(END)
            sizes.append(len(words) + 1)
        return np.array(out, np.uint64), np.array(sizes, np.int64)


def discounts(of: np.ndarray) -> np.ndarray:
    """Katz's d(r) for r = 0 … LOW from the counts of counts ``of[r]``, r to LOW + 1; 1 where the counts can't carry one."""
    d = np.ones(LOW + 1)
    if of[1] > 0:
        common = (LOW + 1) * of[LOW + 1] / of[1]
        for r in range(1, LOW + 1):
            if of[r] > 0 and common < 1:
                value = ((r + 1) * of[r + 1] / of[r] / r - common) / (1 - common)
                if 0 < value <= 1:
                    d[r] = value
    return d


class Unigrams:
    """Numbers and counts of frequent words, totals, and the unigram's probabilities."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int, docs: int, of: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.counts, self.total, self.distinct, self.docs = hashes[order], counts[order], total, distinct, docs
        self.of, self.discount = of, discounts(of)
        kept = total - sum((1 - self.discount[r]) * r * of[r] for r in range(1, LOW + 1))
        # at least one pseudo-count is left to unseen words, taken from all
        self.scale = kept / (kept + 1) if kept > total - 1 else 1.0
        self.left = (1 - self.scale * kept / total) if total else 1.0
        self.unseen = self.left / max(of[1], 1)
        self.start = len(self.hashes)
        #: The context number that stands for all words without one.
        self.rare = self.start + 1

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The word's number, or NONE."""
        if not len(self.hashes):
            return np.full(len(h), NONE, np.uint32)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, NONE).astype(np.uint32)

    def p(self, c: np.ndarray) -> np.ndarray:
        """Probability of a word of training count ``c``; of count 0, of one unseen word."""
        c = np.asarray(c)
        return np.where(c > 0, self.scale * self.discount[np.minimum(c, LOW) * (c <= LOW)] * c / max(self.total, 1), self.unseen)


def _blocks(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[list]]:
    """Columns of blocks of documents; a block ends after BLOCK_DOCS rows or BLOCK_BYTES of text."""
    held, size = [[] for _ in columns], 0
    for whole in batches:
        for at in range(0, whole.num_rows, 200):
            batch = whole.slice(at, 200)
            for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                for column, value in zip(held, row, strict=True):
                    column.append(value)
                size += len(row[columns.index("text")] or "")
                if len(held[0]) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                    yield held
                    held, size = [[] for _ in columns], 0
    if held[0]:
        yield held


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kind, part, block, data = zip(*rows, strict=True) if rows else ([], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(part, pa.int64()), pa.array(block, pa.int64()), pa.array([[x.tobytes() for x in d] for d in data], pa.list_(pa.binary()))], names=["kind", "part", "block", "data"])


def count_words(texts: DataFrame) -> DataFrame:
    """h, c: the training count of each word's hash, pre-aggregated by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, hashes, counts = Hasher(), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []

        def settle() -> tuple[np.ndarray, np.ndarray]:
            new, n = np.unique(np.concatenate(waiting), return_counts=True)
            both, place = np.unique(np.concatenate((hashes, new)), return_inverse=True)
            return both, np.bincount(place, np.concatenate((counts, n))).astype(np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts)], names=["h", "c"])

        for (block,) in _blocks(batches, ["text"]):
            waiting.append(hasher(block)[0])
            if sum(map(len, waiting)) > 1_500_000:
                hashes, counts = settle()
                waiting = []
                if len(hashes) > 1_000_000:
                    yield out()
                    hashes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if waiting:
            hashes, counts = settle()
        yield out()
        del waiting, hashes, counts, hasher
        trim()

    return texts.select("text").mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


def unigrams(texts: DataFrame) -> Unigrams:
    """Counts of all words of ``texts``; the driver gets totals, counts of counts and the frequent words."""
    table = stage_table(count_words(texts), "unigrams")
    by_count = table.groupBy("c").agg(F.count("*").alias("n")).where("n > 0").orderBy(F.desc("c")).toPandas()
    total, distinct = int((by_count.c * by_count.n).sum()), int(by_count.n.sum())
    of = np.zeros(LOW + 2)
    for c, n in zip(by_count.c, by_count.n, strict=True):
        if c <= LOW + 1:
            of[c] = n
    # the whole counts, from above, whose words all have room
    fits = by_count.c[by_count.n.cumsum() <= NUMBERED]
    top = table.where(F.col("c") >= int(fits.min())).toPandas() if len(fits) else table.limit(0).toPandas()
    end = np.uint64(END).astype(np.int64)
    docs = table.where(F.col("h") == int(end)).agg(F.sum("c")).first()[0] or 0
    drop_table(table)
    return Unigrams(top.h.to_numpy(np.int64).view(np.uint64), top.c.to_numpy(np.int64), total, distinct, int(docs), of)


def _part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h * _GOLD) >> np.uint64(33)) % np.uint64(parts)


def _dealt(records: DataFrame, key: str, uni: Unigrams) -> DataFrame:
    """Dealt by a key over as many tasks as the tokens need, whatever the session's default is."""
    least = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return records.repartition(max(least, -(-uni.total // PART_TOKENS)), key).groupBy(key)


def _by_part(where: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by partition, and where each begins in it."""
    order = np.argsort(where, kind="stable")
    return order, np.searchsorted(where[order], np.arange(parts + 1))


def _spread(rows: DataFrame, uni: Unigrams, parts: int) -> DataFrame:
    """Records of each block: kind 0 what is known at once, kind 1 the pairs for one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hasher, task, made = Hasher(), TaskContext.get().partitionId(), 0
        for ids, texts, train in _blocks(batches, ["id", "text", "train"]):
            block, made = task << 24 | made, made + 1
            h, sizes = hasher(texts)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            w = uni.numbers(h)
            ctx = np.empty_like(w)
            ctx[1:] = w[:-1]
            ctx[ctx == NONE] = uni.rare
            ctx[np.cumsum(sizes) - sizes] = uni.start if uni.docs else NONE
            often = w != NONE
            c = np.where(often, uni.counts[np.minimum(w, max(len(uni.counts) - 1, 0))] if len(uni.counts) else 0, 0)
            base = np.bincount(doc[often], np.log10(c[often] + 0.5), len(sizes))
            known = np.bincount(doc[often], minlength=len(sizes))
            alone = often & (ctx == NONE)
            score = np.bincount(doc[alone], np.log10(uni.p(c[alone])), len(sizes))
            flag = np.array([bool(t) for t in train], np.uint8)
            key_ids = np.array([0 if i is None else i for i in ids], np.int64)
            before = np.roll(h, 1)
            rare, after = ~often, often & (ctx == uni.rare)
            pair = often & ~alone & ~after
            key, key_doc = ctx[pair].astype(np.uint64) << np.uint64(BITS) | w[pair], doc[pair]
            # what comes often in the block goes once
            names, place, times = np.unique(key, return_inverse=True, return_counts=True)
            many = times >= OFTEN
            hot, hot_n = names[many], np.bincount(place, flag[key_doc], len(names))[many].astype(np.uint32)
            order, hot_cut = _by_part(_part_of(hot, parts), parts)
            hot, hot_n, nth = hot[order], hot_n[order], np.zeros(len(names), np.int64)
            nth[np.flatnonzero(many)[order]] = np.arange(len(order))
            mine = many[place]
            held, held_n = np.unique(key_doc[mine] << 32 | nth[place[mine]], return_counts=True)
            out = [(0, int(_part_of(np.array([block], np.uint64), parts)[0]), block, (key_ids, np.array([i is None for i in ids], np.uint8), flag, sizes, base, known.astype(np.int64), score, hot, (held >> 32).astype(np.uint16), (held & 0xFFFFFFFF).astype(np.uint32), held_n.astype(np.uint32)))]
            key, key_doc = key[~mine], key_doc[~mine]
            marked = (doc | flag[doc].astype(np.int64) * _TRAIN).astype(np.uint16)
            key_doc = (key_doc | flag[key_doc].astype(np.int64) * _TRAIN).astype(np.uint16)
            rare_doc, rare_h, rare_ctx, rare_v = marked[rare], h[rare], ctx[rare], before[rare]
            after_doc, after_v, after_w = marked[after], before[after], w[after]
            (o1, c1), (o2, c2), (o3, c3) = (_by_part(_part_of(x, parts), parts) for x in (key, rare_h, after_v))
            for p in np.flatnonzero(np.diff(c1) + np.diff(c2) + np.diff(c3) + np.diff(hot_cut)).tolist():
                i, j, k, m = o1[c1[p] : c1[p + 1]], o2[c2[p] : c2[p + 1]], o3[c3[p] : c3[p + 1]], slice(hot_cut[p], hot_cut[p + 1])
                both = j[rare_ctx[j] == uni.rare]
                out.append((1, p, block, (key_doc[i], key[i].astype(np.uint32), (key[i] >> np.uint64(32)).astype(np.uint8), rare_doc[j], rare_h[j], rare_ctx[j], rare_v[both], after_doc[k], after_v[k], after_w[k], hot[m], hot_n[m])))
            yield _records(out)
        del hasher
        trim()

    return rows.mapInArrow(run, _RECORD)


_KINDS = ("u2", "u4", "u1", "u2", "u8", "u4", "u8", "u2", "u8", "u4", "u8", "u4")
#: Of a stored partition: pairs of numbers; number and word; two words; word and number; each with counts.
_STORED = ("u8", "u8", "u4", "u8", "u8", "u8", "u8", "u8", "u8", "u4", "u8")


def _count_pairs(records: DataFrame, uni: Unigrams, parts: int) -> DataFrame:
    """For each partition of pairs: kind 1 answers for each block, kind 2 sums by numbered context, kind 3 the pairs' counts, kind 4 what other contexts' partitions need; kind 0 goes through. Records of kind 3 are a stored model's."""

    def run(whole: pa.Table) -> pa.Table:
        trim()
        kinds = whole.column("kind")
        heads, table, stored = (whole.filter(pc.equal(kinds, k)).select(["kind", "part", "block", "data"]) for k in (0, 1, 3))
        if not table.num_rows and not stored.num_rows:
            return heads
        part = whole.column("part")[0].as_py()
        blocks = table.column("block").to_pylist()
        empty = [tuple(np.zeros(0, k) for k in _KINDS)]
        data = [[np.frombuffer(x, k) for x, k in zip(d, _KINDS, strict=True)] for d in table.column("data").to_pylist()] or empty
        kept = [[np.frombuffer(x, k) for x, k in zip(d, _STORED, strict=True)] for d in stored.column("data").to_pylist()] or [tuple(np.zeros(0, k) for k in _STORED)]
        of_model = [np.concatenate([d[k] for d in kept]) for k in range(len(_STORED))]
        of_model[0] = np.concatenate([np.cumsum(d[0], dtype=np.uint64) for d in kept])
        joined = lambda k: np.concatenate([d[k] for d in data])

        def places(k: int) -> tuple[np.ndarray, np.ndarray]:
            """The block and document of each entry as one number, and whether it is for training."""
            raw = joined(k).astype(np.int64)
            return np.repeat(np.arange(len(data)), [len(d[k]) for d in data]) * _TRAIN + raw % _TRAIN, raw >= _TRAIN

        spots, trains = zip(*(places(k) for k in (0, 3, 7)), strict=True)
        there, dense = np.unique(np.concatenate(spots), return_inverse=True)
        docs = len(there)
        cut = np.cumsum([len(x) for x in spots])
        key_doc, rare_doc, after_doc = np.split(dense, cut[:-1])
        hot, hot_n = joined(10), joined(11)
        # of the others, the count is divided out where it is known
        contexts = np.concatenate((uni.counts, [uni.docs, 0])).astype(float)
        score, base, known, lows = np.zeros(docs), np.zeros(docs), np.zeros(docs, np.int64), np.zeros((LOW, docs))
        sums = np.zeros((LOW + 2, uni.rare + 1))
        lost_doc, lost_ctx = [], []
        # of contexts without a number: seen pairs' context, count and word's probability; the places that need alpha
        told, asked = [], []
        none = lambda x: np.full(len(x), -1, np.int64)  # noqa: E731  entries that are counts, and of no document

        def pairs(ctx: np.ndarray, doc: np.ndarray, weight: np.ndarray, name: np.ndarray, wc: np.ndarray, v: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Distinct names that were seen, their counts, and each entry's; adds to the sums of documents and contexts. ``v``: hashes of contexts without a number."""
            nonlocal score
            distinct, one, place = np.unique(name, return_index=True, return_inverse=True)
            c = np.bincount(place, weight, len(distinct)).astype(np.int64)
            own = c[place]
            seen, unseen = (own > 0) & (doc >= 0), (own == 0) & (doc >= 0)
            score += np.bincount(doc[seen], np.log10(own[seen] / (contexts[ctx[seen]] + 1)), docs)
            for r in range(1, LOW + 1):
                lows[r - 1] += np.bincount(doc[seen & (own == r)], minlength=docs)
            score += np.bincount(doc[unseen], np.log10(uni.p(wc[unseen])), docs)
            first, held = one[c > 0], c[c > 0]
            for r in range(1, LOW + 2):
                sums[r - 1] += np.bincount(ctx[first[held == r]], minlength=uni.rare + 1)
            if v is None:
                lost_doc.append(doc[unseen])
                lost_ctx.append(ctx[unseen])
                sums[LOW + 1] += np.bincount(ctx[first], uni.p(wc[first]), uni.rare + 1)
            else:
                told.append((v[first], np.minimum(held, LOW + 1).astype(np.uint8), uni.p(wc[first])))
                asked.append((doc[unseen], v[unseen]))
            return distinct[c > 0], held, own

        numbered = lambda w: uni.counts[w.astype(np.int64)] if len(w) else np.zeros(0, np.int64)
        key = np.concatenate((joined(1).astype(np.uint64) | joined(2).astype(np.uint64) << np.uint64(32), hot, of_model[0]))
        ctx, w = (key >> np.uint64(BITS)).astype(np.int64), key & np.uint64((1 << BITS) - 1)
        names, counts, own = pairs(ctx, np.concatenate((key_doc, none(hot), none(of_model[0]))), np.concatenate((trains[0], hot_n, of_model[1])), key, numbered(w))
        hot_c = own[len(key_doc) : len(key_doc) + len(hot)]
        # words without a number, behind a number or another such word
        here = joined(5)
        h = np.concatenate((joined(4), of_model[3], of_model[6]))
        h_ctx = np.concatenate((here, of_model[2], np.full(len(of_model[6]), uni.rare))).astype(np.int64)
        h_v = np.concatenate((joined(6), of_model[5]))
        h_doc = np.concatenate((rare_doc, none(of_model[3]), none(of_model[6])))
        h_n = np.concatenate((trains[1], of_model[4], of_model[7])).astype(float)
        words, place = np.unique(h, return_inverse=True)
        c = np.bincount(place, h_n, len(words)).astype(np.int64)[place]
        real = h_doc >= 0
        base += np.bincount(h_doc[real], np.log10(c[real] + 0.5), docs)
        known += np.bincount(h_doc[real & (c > 0)], minlength=docs)
        alone = h_ctx == int(NONE)
        score += np.bincount(h_doc[alone], np.log10(uni.p(c[alone])), docs)
        both = h_ctx == uni.rare
        after = ~alone & ~both
        mixed = h_ctx[after].astype(np.uint64) << np.uint64(40) | place[after].astype(np.uint64)
        rare_names, rare_counts, _ = pairs(h_ctx[after], h_doc[after], h_n[after], mixed, c[after])
        after_v, after_w = np.concatenate((joined(8), of_model[8])), np.concatenate((joined(9), of_model[9]))
        others = np.unique(np.concatenate((h_v, after_v)))
        mixed = np.searchsorted(others, h_v).astype(np.uint64) << np.uint64(32) | place[both].astype(np.uint64)
        two_names, two_counts, _ = pairs(h_ctx[both], h_doc[both], h_n[both], mixed, c[both], h_v)
        mixed = np.searchsorted(others, after_v).astype(np.uint64) << np.uint64(32) | after_w.astype(np.uint64)
        next_doc, next_n = np.concatenate((after_doc, none(of_model[8]))), np.concatenate((trains[2], of_model[10]))
        after_names, after_counts, _ = pairs(np.full(len(after_v), uni.rare), next_doc, next_n, mixed, numbered(after_w), after_v)
        # every word but the last stands before another
        inner = real & (h != np.uint64(END))
        score -= np.bincount(h_doc[inner], np.log10(c[inner] + 1), docs)
        lost_doc, lost_ctx = np.concatenate(lost_doc), np.concatenate(lost_ctx)
        order = np.argsort(lost_doc, kind="stable")
        lost_doc, lost_ctx = lost_doc[order], lost_ctx[order]
        out, hot_at = [], np.cumsum([0] + [len(d[10]) for d in data])
        ends = np.searchsorted(there, np.arange(len(data) + 1) * _TRAIN)
        for k, b in enumerate(blocks):
            span = slice(ends[k], ends[k + 1])
            low, high = np.searchsorted(lost_doc, (ends[k], ends[k + 1]))
            lost = np.bincount(lost_doc[low:high] - ends[k], minlength=ends[k + 1] - ends[k]).astype(np.uint32)
            out.append((1, part, b, (hot_c[hot_at[k] : hot_at[k + 1]], (there[span] % _TRAIN).astype(np.uint16), score[span], base[span], known[span].astype(np.uint32), lows[:, span].astype(np.uint32), lost, lost_ctx[low:high].astype(np.uint32))))
        seen_v, seen_r, seen_p = (np.concatenate(x) for x in zip(*told, strict=True))
        ask_doc, ask_v = (np.concatenate(x) for x in zip(*asked, strict=True))
        ask_block, ask_doc = np.array(blocks, np.int64)[there[ask_doc] // _TRAIN] if len(ask_doc) else np.zeros(0, np.int64), (there[ask_doc] % _TRAIN).astype(np.uint32)
        (o1, c1), (o2, c2) = (_by_part(_part_of(x, parts), parts) for x in (seen_v, ask_v))
        for p in np.flatnonzero(np.diff(c1) + np.diff(c2)).tolist():
            i, j = o1[c1[p] : c1[p + 1]], o2[c2[p] : c2[p + 1]]
            out.append((4, p, part, (seen_v[i], seen_r[i], seen_p[i], ask_block[j], ask_doc[j], ask_v[j])))
        used = np.flatnonzero(sums.any(0))
        for s in range(SLICES):
            mine = used[used % SLICES == s]
            if len(mine):
                out.append((2, s, part, (mine.astype(np.uint32), sums[: LOW + 1, mine].astype(np.uint32), sums[LOW + 1, mine])))
        rare_ctx, rare_word = (rare_names >> np.uint64(40)).astype(np.uint32), words[(rare_names & np.uint64((1 << 40) - 1)).astype(np.int64)]
        two, two_w, next_, next_w = (x for names_of in (two_names, after_names) for x in (others[(names_of >> np.uint64(32)).astype(np.int64)], names_of & np.uint64(0xFFFFFFFF)))
        more = (two, words[two_w.astype(np.int64)], two_counts.astype(np.uint64), next_, next_w.astype(np.uint32), after_counts.astype(np.uint64))
        out.append((3, part, part, (np.diff(names, prepend=np.uint64(0)), counts.astype(np.uint64), rare_ctx, rare_word, rare_counts.astype(np.uint64), *more)))
        return pa.concat_tables([heads, pa.Table.from_batches([_records(out)])], promote_options="permissive")

    return _dealt(records, "part", uni).applyInArrow(run, _RECORD)


def _other_contexts(counted: DataFrame, uni: Unigrams) -> DataFrame:
    """Kind 5, for each block and partition of contexts without a number: the places that need alpha, the context's counts of counts and -log10 of what its seen words leave."""

    def run(table: pa.Table) -> pa.Table:
        trim()
        data = [[np.frombuffer(x, k) for x, k in zip(d, ("u8", "u1", "f8", "i8", "u4", "u8"), strict=True)] for d in table.column("data").to_pylist()]
        part = table.column("part")[0].as_py()
        v, r, p, block, doc, ask = (np.concatenate(x) for x in zip(*data, strict=True))
        del data
        names, which = np.unique(ask, return_inverse=True)
        at = np.minimum(np.searchsorted(names, v), max(len(names) - 1, 0))
        mine = names[at] == v if len(names) else np.zeros(len(v), bool)
        at, r, p = at[mine], r[mine], p[mine]
        low = np.stack([np.bincount(at[r == k], minlength=len(names)) for k in range(1, LOW + 1)]).astype(np.uint32)
        left = -np.log10(np.maximum(1 - np.bincount(at, p, len(names)), 1e-12))
        order = np.argsort(block, kind="stable")
        block, doc, which = block[order], doc[order], which[order]
        of, cut = np.unique(block, return_index=True)
        out = []
        for b, i, j in zip(of.tolist(), cut.tolist(), [*cut[1:].tolist(), len(block)], strict=True):
            out.append((5, part, b, (doc[i:j], low[:, which[i:j]], left[which[i:j]])))
        return pa.Table.from_batches([_records(out)])

    return _dealt(counted.where("kind = 4"), "part", uni).applyInArrow(run, _RECORD)


def _context_sums(counted: DataFrame) -> DataFrame:
    """ctx, low (LOW + 1 counts of counts), mass (unigram probability of the seen continuations)."""

    def run(table: pa.Table) -> pa.Table:
        trim()
        sums: dict[str, np.ndarray] = {}
        for ctx, low, mass in table.column("data").to_pylist():
            at = np.frombuffer(ctx, np.uint32)
            new = np.vstack([np.frombuffer(low, np.uint32).reshape(LOW + 1, -1), np.frombuffer(mass, np.float64)])
            if not sums:
                sums = {"at": at, "new": new}
            else:
                both, place = np.unique(np.concatenate((sums["at"], at)), return_inverse=True)
                joined = np.hstack((sums["new"], new))
                sums = {"at": both, "new": np.stack([np.bincount(place, row, len(both)) for row in joined])}
        return pa.table({"ctx": pa.array(sums["at"].astype(np.int64)), "low": pa.array(sums["new"][: LOW + 1].T.astype(np.int64).tolist(), pa.list_(pa.int64())), "mass": pa.array(sums["new"][LOW + 1])})

    return counted.where("kind = 2").groupBy("part").applyInArrow(run, "ctx bigint, low array<bigint>, mass double")


def backoff(sums, uni: Unigrams) -> tuple[np.ndarray, np.ndarray]:
    """alpha of each numbered context, and the discounts of all pairs, from the rows of ``_context_sums``."""
    contexts = np.concatenate((uni.counts, [uni.docs])).astype(float)
    low, mass = np.zeros((uni.rare + 1, LOW + 1)), np.zeros(uni.rare + 1)
    if len(sums):
        at = sums["ctx"].to_numpy()
        low[at], mass[at] = np.stack(sums["low"].to_numpy()), sums["mass"].to_numpy()
    d = discounts(np.concatenate(([0], low.sum(0))))
    low, mass = low[: uni.rare], mass[: uni.rare]
    spared = 1 + low[:, :LOW] @ ((1 - d[1:]) * np.arange(1, LOW + 1))
    return spared / (contexts + 1) / np.maximum(1 - mass, 1e-12), d


def _summed(answers: DataFrame, uni: Unigrams, alpha: np.ndarray, d: np.ndarray) -> DataFrame:
    """One row for each document, block by block."""
    spared = (1 - d[1:]) * np.arange(1, LOW + 1)
    log_alpha, log_d, log_total = np.log10(alpha), np.log10(d[1:]), np.log10(uni.total + 0.5 * (uni.distinct + 1))
    contexts = np.concatenate((uni.counts, [uni.docs])).astype(float)
    names = ["id", "train", "n_tokens", "n_known", "base_score", "score"]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        kinds, data = table.column("kind").to_pylist(), table.column("data").to_pylist()
        head = data[kinds.index(0)]
        ids, null, train, sizes, base, known, score, hot, hot_doc, hot_at, hot_n = (np.frombuffer(x, k) for x, k in zip(head, ("i8", "u1", "u1", "i8", "f8", "i8", "f8", "u8", "u2", "u4", "u4"), strict=True))
        base, known, score = base.copy(), known.copy(), score.copy()
        answers = [x for kind, x in zip(kinds, data, strict=True) if kind == 1]
        for x in answers:
            at = np.frombuffer(x[1], "u2")
            score[at] += np.frombuffer(x[2], "f8") + log_d @ np.frombuffer(x[5], "u4").reshape(LOW, -1)
            base[at] += np.frombuffer(x[3], "f8")
            known[at] += np.frombuffer(x[4], "u4")
            score += np.bincount(np.repeat(at, np.frombuffer(x[6], "u4")), log_alpha[np.frombuffer(x[7], "u4")], len(ids))
        if len(hot):
            # in the order of the partitions, as the block has them
            c = np.concatenate([np.frombuffer(x[0], "i8") for x in answers])
            ctx, w = (hot >> np.uint64(BITS)).astype(np.int64), (hot & np.uint64((1 << BITS) - 1)).astype(np.int64)
            seen = np.log10(np.maximum(c, 1) / (contexts[ctx] + 1)) + np.where((c > 0) & (c <= LOW), log_d[np.clip(c, 1, LOW) - 1], 0)
            value = np.where(c > 0, seen, log_alpha[ctx] + np.log10(uni.p(uni.counts[w])))
            score += np.bincount(hot_doc, value[hot_at] * hot_n, len(ids))
        for kind, x in zip(kinds, data, strict=True):
            if kind == 5:
                low = np.frombuffer(x[1], "u4").reshape(LOW, -1)
                score += np.bincount(np.frombuffer(x[0], "u4"), np.log10(1 + spared @ low) + np.frombuffer(x[2], "f8"), len(ids))
        base -= sizes * log_total
        return pa.table([pa.array(ids, pa.int64(), mask=null.astype(bool)), pa.array(train.astype(bool)), pa.array(sizes), pa.array(known), pa.array(base), pa.array(score)], names=names)

    return _dealt(answers, "block", uni).applyInArrow(run, "id bigint, train boolean, n_tokens bigint, n_known bigint, base_score double, score double")


def _rows(docs: DataFrame, usable: Column, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(usable, F.lit(False)).alias("train"))


def _evaluated(counted: DataFrame, sums, uni: Unigrams, id_col: str) -> DataFrame:
    """Scores from what the partitions answered."""
    alpha, d = backoff(sums, uni)
    out = _summed(counted.where("kind < 2").unionByName(_other_contexts(counted, uni)), uni, alpha, d)
    return out.withColumn("train_tokens", F.lit(uni.total).cast("long")).withColumnRenamed("id", id_col)


class Model:
    """A stored model: one Parquet folder of the partitions' pair counts and of the frequent words."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        head = spark.read.schema(_RECORD).parquet(f"{path}/words").first()["data"]
        hashes, counts, totals, of = (np.frombuffer(x, k) for x, k in zip(head, ("u8", "i8", "i8", "f8"), strict=True))
        self.unigrams, self.parts = Unigrams(hashes, counts, *totals[:3].tolist(), of), int(totals[3])

    @staticmethod
    def save(spark: SparkSession, path: str, counted: DataFrame, uni: Unigrams, parts: int) -> Model:
        head = [x.tobytes() for x in (uni.hashes, uni.counts, np.array([uni.total, uni.distinct, uni.docs, parts]), uni.of)]
        spark.createDataFrame([(9, 0, 0, head)], _RECORD).write.parquet(f"{path}/words")
        counted.where("kind = 3").write.parquet(f"{path}/pairs")
        return Model(spark, path)

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Score documents the model needn't have seen; columns as of ``score``, with train false."""
        rows = _rows(docs, F.lit(False), id_col, text_col)
        records = _spread(rows, self.unigrams, self.parts).unionByName(self.spark.read.schema(_RECORD).parquet(f"{self.path}/pairs"))
        counted = stage_table(_count_pairs(records, self.unigrams, self.parts), "counted", by="kind")
        return _evaluated(counted, _context_sums(counted).toPandas(), self.unigrams, id_col)


def _counted(rows: DataFrame) -> tuple[DataFrame, Unigrams, int]:
    uni = unigrams(rows.where("train"))
    parts = max(1, -(-uni.total // PART_TOKENS))
    return stage_table(_count_pairs(_spread(rows, uni, parts), uni, parts), "counted", by="kind"), uni, parts


def train(docs: DataFrame, usable: Column, path: str, text_col: str = "text") -> Model:
    """Count the ``usable`` rows and store the model in a new folder."""
    rows = _rows(docs.where(usable).withColumn(fresh(docs, "row"), F.lit(0)), F.lit(True), fresh(docs, "row"), text_col)
    return Model.save(docs.sparkSession, path, *_counted(rows))


def score(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit on the ``usable`` rows and score all: id, train, n_tokens, n_known, train_tokens, base_score, score.

    ``score`` is the model's log10 probability of the text's words and end; ``base_score``
    that of the additive unigram (0.5 a word, one unseen word). Null and empty texts are
    one end. Ids are integers, and may be null; a row whose ``usable`` is null is scored
    only. Repeated rows are each counted and scored. Without usable rows every word is
    unseen. An empty table gives no rows. As each partition of pairs counts and answers in
    one pass, this is ``train`` and ``Model.score`` at once.
    """
    counted, uni, _ = _counted(_rows(docs, usable, id_col, text_col))
    return _evaluated(counted, _context_sums(counted).toPandas(), uni, id_col)
