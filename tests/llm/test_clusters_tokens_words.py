"""Clustering, BPE and spelling variants against plain twins."""

import hashlib
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import bpe, centroids, queries, spelling
from rasterloom.llm.tokens import Encoder, default_path

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id bigint, embedding array<double>, v int, id int, compressed string, cluster int"


def lloyd(rows, k, rounds, seed, n, scale):
    """(id, cluster, distance) of each vector, and the centroids, in Python's integers."""
    kept = [(i, [math.floor(Fraction(x) * scale) for x in e]) for i, e in rows if e is not None and len(e) == n and all(x is not None and math.isfinite(x) for x in e)]
    order = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    places = [v for _, v in sorted(kept, key=order)[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min(range(len(places)), key=lambda j: (far(v, places[j]), j))
    for _ in range(rounds):
        groups: dict = {}
        for _, v in kept:
            groups.setdefault(nearest(v), []).append(v)
        places = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(places)]
    return [(i, nearest(v), far(v, places[nearest(v)])) for i, v in kept], places


def placed(spark, rows, n, k, rounds=3):
    df = spark.createDataFrame([(i, e, 1, 2, "x", 3) for i, e in rows], VECTORS)
    return centroids.cluster(df, k, rounds, dimensions=n).collect()


@pytest.mark.parametrize("spread", [0.5, 3e4, 2e7])
def test_clusters_equal_lloyd(spark, spread):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, spread) for _ in range(20)]) for i in range(120)] + [(i % 3, [0.0] * 20) for i in range(9)]
    rows += [(None, [rng.gauss(0, spread) for _ in range(20)]), (500, None), (501, []), (502, [1.0] * 19), (503, [1.0] * 21), (504, [None] + [1.0] * 19), (505, [math.nan] * 20), (506, [math.inf] + [0.0] * 19), (507, [-0.0] * 20)]
    want, places = lloyd(rows, 7, 3, 1, 20, 64)
    got = placed(spark, rows, 20, 7)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=str) == sorted(((i, c, min(d, 2**63 - 1)) for i, c, d in want), key=str)
    assert all(r.centroid == places[r.cluster] for r in got)
    total = Counter()
    for _, c, d in want:
        total[c] += d
    assert all((r.cluster_inertia, r.inertia) == (min(total[r.cluster], 2**63 - 1), min(sum(total.values()), 2**63 - 1)) for r in got)


def test_clusters_edges(spark):
    assert placed(spark, [], 4, 3) == []
    assert placed(spark, [(1, None), (2, [1.0])], 4, 3) == []
    few = placed(spark, [(1, [0.0, 1.0, 2.0, 3.0]), (2, [9.0, 9.0, 9.0, 9.0])], 4, 16)
    assert sorted(r.cluster for r in few) == [0, 1] and all(r.distance == 0 for r in few)
    same = placed(spark, [(i, [1.0, 1.0, 1.0, 1.0]) for i in range(5)], 4, 3)  # equal centroids: the smallest number takes all
    assert {(r.cluster, r.distance, r.inertia) for r in same} == {(0, 0, 0)}
    vast = placed(spark, [(1, [1e300] * 4), (2, [-1e300] * 4), (3, [0.0] * 4)], 4, 2)
    assert all(0 <= r.distance <= 2**63 - 1 for r in vast) and len(vast) == 3


def test_screening_loses_nothing_and_saves_distances():
    rng = np.random.default_rng(2)
    at = rng.integers(-900, 900, (16, 64))
    v = at[rng.integers(0, 16, 3000)] + rng.integers(-200, 200, (3000, 64))
    best, far, took = centroids.nearest(v, centroids.compress(v), at)
    every = np.square(v[:, None, :] - at).sum(2)
    assert (best == every.argmin(1)).all() and (far == every.min(1)).all()
    assert took < 0.2 * every.size


def coded(docs, **more):
    got = bpe.decode(bpe.encode(docs, **more)).collect()
    return sorted(((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded) for r in got), key=str)


def plain(full, rows):
    ids = [(d, full.encode(t or "", add_special_tokens=False).ids) for d, t in rows]
    return sorted(((d, len(x), tuple(x), full.decode(x, skip_special_tokens=False)) for d, x in ids), key=str)


def test_bpe_equals_the_whole_tokenizer(spark, table, corpus):
    full = Encoder.shared(default_path()).full
    rng = random.Random(4)
    odd = ["e", "́", "̧", " ", "'", "re", "ll", "T", "the ", "1", "!", "<|endoftext|>", "<|", "|>", "İ", "ᄀ", "ᅡ", "日本", "\x00", "\n", "a" * 40, "!?" * 20, " " * 200]
    docs = {d: t for d, t in corpus.items() if t is None or len(t) < 10_000}
    docs |= {1000 + i: "".join(rng.choice(odd) for _ in range(rng.randrange(300))) for i in range(40)} | {2000: "word " * 5_000, 2001: "x" * 30_000, 2002: "́" * 300, 2003: "<|endoftext|>" * 200}
    rows = [*docs.items(), (None, "no id"), (None, "no id"), (3, docs[3])]
    df = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], "doc_id bigint, text string, ids string, key int, at int")
    want = plain(full, rows)
    for leaf, window in ((16_384, 64), (50, 16), (7, 16)):
        assert coded(df, leaf=leaf, window=window) == want
    assert coded(df.where("false")) == []


def test_bpe_by_other_files(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    full = Encoder.shared(path).full
    df = spark.createDataFrame([(1, "Some  text, twiceé " * 40), (2, None)], "doc_id bigint, text string")
    got = bpe.decode(bpe.encode(df, path=path, leaf=20), path=path).collect()
    assert {r.doc_id: (r.ids, r.decoded) for r in got} == {1: (full.encode("Some  text, twiceé " * 40).ids, "Some  text, twiceé " * 40), 2: ([], "")}


def test_decoding_odd_ids(spark):
    full = Encoder.shared(default_path()).full
    df = spark.createDataFrame([(1, [320, -1, 99_999, None, 530]), (2, []), (3, None)], "k int, ids array<int>")
    got = {r.k: r.decoded for r in bpe.decode(df).collect()}
    assert got == {1: full.decode([320, 530], skip_special_tokens=False), 2: "", 3: None}


def test_halves():
    text = "ab́́cd" * 50
    parts = bpe.halves(text, 8)
    assert "".join(parts) == text and max(map(len, parts)) <= 8 and not any(p.startswith("́") for p in parts)
    assert bpe.halves("́" * 50, 8) == ["́" * 50]


def test_op12_query(spark):
    full = Encoder.shared(default_path()).full
    told = lambda s: hashlib.sha256(s.encode()).hexdigest()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {(d, n, told(" ".join(map(str, ids))), told(text)) for d, n, ids, text in plain(full, docs)}
    assert {tuple(r) for r in queries.op12_bpe(spark, SF).collect()} == want


def words_of(rows, slip):
    import re

    count = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            count[run if h % slip else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows, slip):
    words = words_of(rows, slip)
    near = {w: [x for x in words if is_near(w, x)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return out


@pytest.mark.parametrize(("shard", "owners"), [(8_192, 4_096), (16, 3)])
def test_variants_equal_all_pairs(spark, corpus, shard, owners):
    rng = random.Random(6)
    stems = ["".join(rng.choice("abcéÿ") for _ in range(rng.randrange(4, 8))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(stems) for _ in range(rng.randrange(60)))) for i in range(120)] + [*corpus.items()]
    rows += [(i, "hot" + "".join(rng.choice("xyz") for _ in range(4)) + " hot" + "".join(rng.choice("xyz") for _ in range(3))) for i in range(300)]
    rows += [(None, "Nulls Étude nulls NULLS ab×cd abcde"), (7, None), (8, ""), (3, rows[3][1]), (9, "chain chainn chainnn " * 3 + "chain " * 30 + "chainn " * 9)]
    df = spark.createDataFrame([(d, t, "w", 1, 2) for d, t in rows], "doc_id bigint, text string, word string, n int, id int")
    got = spelling.variants(df, slip=5, shard=shard, owners=owners)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain_variants(rows, 5)
    assert {tuple(r) for r in got.collect()} == want and any(w[1] and w[1] != w[2] for w in want)
    if owners == 3:  # a half with more owners than that lies in several shards
        dealt = spelling.dealt(spelling.vocabulary(df, slip=5), 40, owners).where("role = 0 AND NOT second AND word LIKE 'hot%'").groupBy(F.length("word")).agg(F.countDistinct("shard").alias("s")).collect()
        assert max(r.s for r in dealt) > 1


def test_variants_of_nothing(spark, table):
    assert spelling.variants(table({}, empty=True)).collect() == []
    assert spelling.variants(table({1: None, 2: "", 3: "1 2 3"})).collect() == []
    long = spelling.variants(table({1: ("a" * 5_000 + " ") * 3 + ("a" * 4_999 + " ") * 9})).collect()
    assert {(len(r.word), r.n_near, r.form is None) for r in long} >= {(4999, 1, True)} or len(long) <= 2
