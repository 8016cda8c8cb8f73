import math
import random
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
import regex
from brute import edit_distance_infix, near_classes
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterloom.llm import components, decontaminate, katz, language_id, license_scan, near_dedup, packing, queries, sampling, shared, toxicity
from rasterloom.llm.tokens import Encoder, default_path

SF = "/root/testdata/sf0.01"


# near duplicates


def test_near_classes(table, corpus):
    want = near_classes(corpus)
    docs = table(corpus)
    got = near_dedup.classes(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = near_dedup.survivors(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(d for d, w in want.items() if w[1] == d)


def test_near_edges(table):
    assert near_dedup.classes(table({}, empty=True)).collect() == []
    docs = table({7: "a b c d e f", 9: None})
    twice = docs.unionByName(docs)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.classes(twice).collect()) == [(7, 2, 7), (7, 2, 7), (9, 0, 9), (9, 0, 9)]


def test_rows_without_ids(table, spark):
    """They lose neither the row nor its findings."""
    docs = table({1: "a b c d e f", 2: ITEMS[1]}).unionByName(table({None: "a b c d e f"})).unionByName(table({None: ITEMS[1]}))
    key = lambda rows: sorted((r.doc_id is None, r.text) for r in rows)
    assert key(near_dedup.survivors(docs).collect()) == key(docs.collect())
    assert key(decontaminate.survivors(docs, _items(spark)).collect()) == [(False, "a b c d e f"), (True, "a b c d e f")]
    got = decontaminate.report(docs, _items(spark)).collect()
    assert sorted((r.doc_id is None, r["items"]) for r in got) == [(False, []), (False, [1]), (True, []), (True, [1])]
    told = license_scan.scan(table({None: "all rights reserved", 3: "none"})).collect()
    assert {r.doc_id: r.labels for r in told} == {None: "reserved", 3: ""}


def _family(rng, n):
    """Near copies of one text, not all near to each other, and texts that share most of another but are too far apart."""
    base, docs = [f"w{k}" for k in range(120)], {}
    for i in range(n):
        w = list(base)
        for _ in range(3 if i else 0):
            w[rng.randrange(len(w))] = f"e{i}{rng.random()}"
        docs[i * 3 % (n + 1)] = " ".join(w)
    passage = [f"p{k}" for k in range(80)]
    for i in range(n):
        own = [f"o{i}x{k}" for k in range(rng.randrange(8, 40))]
        docs[1000 + i] = " ".join(passage + own)
    for i in range(n // 3):  # chains: each like the next only
        docs[2000 + i] = " ".join([f"c{k}" for k in range(6 * i, 6 * i + 100)])
    return docs


@pytest.mark.parametrize("rounds,most", [(6, 1_000_000), (1, 0)])
def test_near_hot_group(table, monkeypatch, rounds, most):
    """Large groups, by hubs and by the bounded join behind them, with ids broadcast and shuffled."""
    monkeypatch.setattr(near_dedup, "ROUNDS", rounds)
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", most)
    docs = _family(random.Random(1), 150)
    want = near_classes(docs)
    got = near_dedup.classes(table(docs)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert {r.doc_id for r in near_dedup.survivors(table(docs)).collect()} == {d for _, d in want.values()}


@pytest.mark.parametrize("threshold", [60, 75, 90])
def test_near_bounded_join_loses_nothing(spark, threshold):
    """Every similar pair of different components comes out; of texts that share a passage and are too far apart, few others do."""
    docs = _family(random.Random(4), 60)
    sets = {d: set(near_dedup.Shingler()(t).tolist()) for d, t in docs.items()}
    texts = spark.createDataFrame(list(docs.items()), "id bigint, text string")
    roots = {d: d % 3 if d < 1000 else d for d in docs}
    apart = spark.createDataFrame(list(roots.items()), "id bigint, root bigint")
    got = [(min(r), max(r)) for r in near_dedup._crossing(apart, texts, 5, threshold).collect()]
    near = {(a, b) for a in docs for b in docs if a < b and roots[a] != roots[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}
    shared = lambda pairs: sum(1000 <= a < b < 2000 for a, b in pairs)
    assert len(got) == len(set(got)) and near <= set(got) and shared(got) <= shared(near) + 60


@pytest.mark.parametrize("split", [2, 16])
def test_near_split_keys(table, monkeypatch, split):
    """Buckets, hubs and centres of stars dealt over many tasks."""
    monkeypatch.setattr(near_dedup, "MEMBERS", split)
    monkeypatch.setattr(shared, "SPLIT", split)
    monkeypatch.setattr(near_dedup, "ROUNDS", 2)
    docs = _family(random.Random(3), 40)
    got = near_dedup.classes(table(docs)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near_classes(docs)


@pytest.mark.parametrize("most", [0, 1_000])
def test_join_split(spark, monkeypatch, most):
    """Equal to the plain join, whatever the sizes of the keys and of their list."""
    monkeypatch.setattr(shared, "SPLIT", 3)
    monkeypatch.setattr(shared, "MOST_SPLIT", most)
    rows = spark.createDataFrame([(k, i) for k in range(12) for i in range(k * k)], "k long, i long")
    side = spark.createDataFrame([(k, f"s{k}") for k in range(1, 20)], "k long, s string")
    got = shared.join_split(rows, side, "k", "i")
    assert got.columns == ["k", "i", "s"] and sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(side, "k").collect()))
    assert shared.join_split(rows.where("k < 2"), side, "k", "i").collect() == [(1, 0, "s1")]


def test_near_one_id_with_several_texts(table):
    """Such a document has the links of all its texts."""
    long = lambda c, n=60: " ".join(f"{c}{k}" for k in range(n))
    docs = table({5: long("a")}).unionByName(table({5: long("b"), 3: long("a", 58), 9: long("b", 58), 11: long("c")}))
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.classes(docs).collect())
    assert got == [(3, 54, 3, True), (5, 56, 3, False), (5, 56, 3, False), (9, 54, 3, False), (11, 56, 11, True)]


def test_near_clashing_columns(table):
    docs = table({1: "a b c d e f", 2: "A b c d e f"}).withColumnsRenamed({"h": "dropped", "part": "root"}).withColumn("dropped_", F.lit(1))
    kept = near_dedup.survivors(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1]


def test_sketches():
    rng = np.random.default_rng(0)
    whole = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2)
    a, b = np.sort(whole[:3000]), np.sort(whole[1000:])
    sa, sb, su = near_dedup.sketch([a, b, np.sort(whole)])
    assert (near_dedup.merge(sa, sb) == su).all()
    got = near_dedup.estimate(sa[None], sb[None], np.array([3000.0]), np.array([3000.0]))[0]
    assert abs(got - 0.5) < 0.15
    assert near_dedup.estimate(sa[None], sa[None], np.array([3000.0]), np.array([3000.0]))[0] == 1


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + k, 101 + k) for k in range(30)] + [(200, 200 + k) for k in range(50)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    df = spark.createDataFrame([*links, (None, 3)], "a bigint, b bigint")
    assert {r.node: r.root for r in components.components(df).collect()} == {x: find(x) for x in root}
    assert components.components(df.where("false")).collect() == []


# language


def test_language(spark, table):
    got = queries.op2_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(table):
    sample = pd.DataFrame({"text": ["the house and the garden", "das haus und der garten"] * 20, "lang": ["en", "de"] * 20})
    model = language_id.fit(sample)
    docs = {1: None, 2: "", 3: "123 !!", 4: "the garden", 5: "das haus " * 9000, 6: "é", 7: "the garden"}
    got = {r.doc_id: r for r in language_id.predict(table(docs), model).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and all(got[k].rejected and got[k].score == 0 for k in (1, 2, 3))
    assert (got[4].lang_pred, got[5].lang_pred) == ("en", "de") and got[6].lang_pred in ("en", "de") and got[4][1:] == got[7][1:]
    none = language_id.fit(sample.iloc[:0])
    assert {r.lang_pred for r in language_id.predict(table(docs), none).collect()} == {"und"}
    assert language_id.predict(table(docs, empty=True), model).collect() == []


def test_language_sample_holds_rare_languages(spark, monkeypatch):
    monkeypatch.setattr(language_id, "fit", lambda sample: sample)
    lang = F.when(F.col("id") % 2000 == 7, "rare").when(F.col("id") % 3 == 0, "de").otherwise("en")
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x" * 50).alias("text"), lang.alias("lang"))
    got = Counter(language_id.train(docs, F.lit(True), most_rows=500)["lang"])
    assert got["rare"] == 10 and all(170 <= got[k] <= 320 for k in ("de", "en"))
    assert 100 <= len(language_id.train(docs, F.lit(True), most_rows=500, most_bytes=7500)) <= 200


# toxicity


def _toxic_sample(n, seed):
    rng = random.Random(seed)
    plain = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(n):
        y = int(i % 8 == 0)
        w = [rng.choice(plain) for _ in range(60)]
        if y:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(["zorgal", "zorgen", "zorgit", "idiot", "Moron,"])
        rows.append((" ".join(w), y))
    return pd.DataFrame(rows, columns=["text", "label"])


def test_toxicity(table):
    model = toxicity.fit(_toxic_sample(800, 1))
    fresh = _toxic_sample(300, 2)
    docs = dict(enumerate(fresh["text"])) | {1000: None, 1001: "", 1002: "plain " * 20_000}
    got = {r.doc_id: r for r in toxicity.score(table(docs), model).collect()}
    assert not any(got[i].predicted and not y for i, y in enumerate(fresh["label"]))
    assert sum(got[i].predicted for i in range(len(fresh))) >= 0.9 * fresh["label"].sum()
    assert {got[k].predicted for k in (1000, 1001, 1002)} == {0} and all(0 <= r.score <= 1 for r in got.values())
    kept = toxicity.keep_clean(table(docs), model)
    assert kept.columns == table(docs).columns and {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if not r.predicted}
    assert toxicity.score(table(docs, empty=True), model).collect() == []
    bare = toxicity.fit(_toxic_sample(0, 1))
    assert bare.score("nice words") < 0.5 < bare.score("you idiot, a worthless idiot and scum")


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "fit", lambda sample: sample)
    docs = spark.range(8000).select(F.col("id").alias("doc_id"), F.lit("x" * 100).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))
    few = toxicity.train(docs, labels, F.col("doc_id") % 3 != 1, most_rows=1000)
    assert 850 <= len(few) <= 1150
    short = toxicity.train(docs, labels, F.col("doc_id") % 3 != 1, most_rows=1000, most_bytes=40_000)
    assert 300 <= len(short) <= 500
    half = toxicity.train(docs, labels.where("doc_id < 4000"), F.lit(True), most_rows=1000, free_rows=500)
    free = half[half["label"] < 0]
    assert 180 <= len(free) <= 340 and free["doc_id"].min() >= 4000 and 850 <= len(half) - len(free) <= 1150


@pytest.mark.parametrize("rows,size", [(1e-9, 10**9), (10**9, 3)])
def test_samples_are_never_empty(spark, rows, size):
    """A share below any grid still draws a row, for each group."""
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("x" * 100).alias("text"), (F.col("id") % 3).cast("string").alias("lang"))
    assert len(sampling.bounded(docs, "doc_id", "text", rows, size)) == 1
    assert sorted(sampling.bounded_by(docs, "lang", "doc_id", "text", rows, size)["lang"]) == ["0", "1", "2"]
    assert len(sampling.bounded(docs.where("false"), "doc_id", "text", rows, size)) == 0


def test_label_model_weighs_copies_of_a_voter():
    rng = np.random.default_rng(0)
    y = rng.random(3000) < 0.2
    one = np.where(y, rng.random(3000) < 0.6, rng.random(3000) < 0.05)
    votes = np.column_stack([one, one, one, np.where(y, rng.random(3000) < 0.7, rng.random(3000) < 0.02)]).astype(float)
    known = np.where(rng.random(3000) < 0.7, y.astype(int), -1)
    q, rates, gold = toxicity.label_model(votes, known)
    assert abs(rates[0, 2] - 1 / 3) < 0.05 and rates[3, 2] > 0.8 and abs(rates[3, 0] - 0.7) < 0.1 and gold[0] > 0.95 and gold[1] < 0.05
    assert ((q > 0.5) == y)[known >= 0].mean() > 0.97 and ((q > 0.5) == y)[known < 0].mean() > 0.9


def test_label_model_estimates_how_far_labels_are_right():
    """A tenth of the given labels is wrong: many good voters tell so."""
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    votes = np.column_stack([np.where(y, rng.random(4000) < 0.8, rng.random(4000) < 0.05) for _ in range(8)]).astype(float)
    q, _, gold = toxicity.label_model(votes, np.where(rng.random(4000) < 0.1, ~y, y).astype(int))
    assert abs(gold[0] - 0.9) < 0.04 and abs(gold[1] - 0.1) < 0.04 and ((q > 0.5) == y).mean() > 0.99


def test_toxicity_score_is_the_classifier(table):
    """The score by a plain sum over the voters that hit, found without the model's index."""
    model = toxicity.fit(_toxic_sample(600, 3))
    docs = dict(enumerate(_toxic_sample(80, 4)["text"])) | {200: None, 201: "", 202: "You are such an idiot!!! scum!! trash!!", 203: "word " * 5000}
    for r in toxicity.score(table(docs), model).collect():
        held = {w.lower() for w in regex.findall(rb"[A-Za-z\x80-\xff]+", (docs[r.doc_id] or "").encode())}
        hit = {k for mark, of in model.by_mark.items() for k in of if any(w == mark[:-1] if mark.endswith(b"$") else w.startswith(mark) for w in held)}
        hit |= {k for k, p in model.patterns if regex.search(p, docs[r.doc_id] or "")}
        z = model.bias + sum(model.weights[k] for k in hit)
        assert r.score == pytest.approx(1 / (1 + math.exp(-z))) and r.predicted == int(r.score >= 0.7) and set(r.voters) == {model.names[k] for k in hit}


def test_op6(spark):
    got = queries.op6_toxicity(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    rows = got.join(labels, "doc_id").collect()
    assert got.count() == 1000 and all(r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.predicted and not r.toxic for r in rows) <= 2 and sum(r.predicted and r.toxic for r in rows) >= 20


# decontamination


ITEMS = {1: "The quick brown fox jumps over the lazy dog near the river bank at noon.", 2: "Counting all sheep in seven green valleys takes, as they say, a very long time indeed; so bring tea.", 3: "short one", 4: None, 5: "", 6: "ab"}


def _items(spark):
    return spark.createDataFrame(list(ITEMS.items()), "item_id bigint, text string")


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=30), st.binary(max_size=60))
def test_infix_distance(item, text):
    item, text = (bytes(c & 3 for c in x) for x in (item, text))
    assert decontaminate.infix_distance(item, text) == edit_distance_infix(item, text)


def test_decontaminate(spark, table, corpus):
    pad = "lorem ipsum dolor sit amet " * 30
    docs = {1: pad + ITEMS[1] + pad, 2: ITEMS[2].upper(), 3: pad + ITEMS[2].replace("seven", "eleven").replace("say,", "said") + " x", 4: pad, 5: None, 6: "", 7: ITEMS[1][:40], 8: pad * 40 + ITEMS[1], 9: "a short one it is", 10: ITEMS[1] + " " + ITEMS[2], 11: "quick fox " * 50}
    got = {r.doc_id: (r.contaminated, r["items"], r.least_edits) for r in decontaminate.report(table(docs), _items(spark)).collect()}
    assert {d: v[1] for d, v in got.items()} == {1: [1], 2: [2], 3: [2], 4: [], 5: [], 6: [], 7: [], 8: [1], 9: [3], 10: [1, 2], 11: []}
    assert all(v[0] == bool(v[1]) and (v[2] is None) == (not v[1]) for v in got.values()) and got[3][2] > 0 and got[2][2] == 0
    more = docs | {1000 + d: t for d, t in corpus.items()}
    clean = decontaminate.survivors(table(more), _items(spark))
    assert clean.columns == table(docs).columns and {r.doc_id for r in clean.collect()} == more.keys() - {1, 2, 3, 8, 9, 10}
    assert decontaminate.report(table(docs, empty=True), _items(spark)).collect() == []
    assert not any(r.contaminated for r in decontaminate.report(table(docs), _items(spark).where("false")).collect())


def _edited(rng, text, edits):
    w = bytearray(text)
    for _ in range(edits):
        k = rng.randrange(len(w))
        op = rng.randrange(3)
        if op == 0:
            del w[k]
        elif op == 1:
            w[k] = ord(rng.choice("qrstuv"))
        else:
            w.insert(k, ord(rng.choice("qrstuv")))
    return bytes(w)


@pytest.mark.parametrize("kind", ["letters", "words"])
@pytest.mark.parametrize("sizes,copies", [((8, 9, 12, 18), 30), ((24, 40, 80), 12), ((150, 250, 400), 8), ((1000, 2000), 6)])
def test_recall_at_the_bound(kind, sizes, copies):
    """Of passages with edits of 7 and 10 %, 0.97 are found, at every length; nothing beyond the bound is."""
    rng = random.Random(6)
    vocabulary = [w for r in ITEMS.values() for w in (r or "").split()]
    text = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n)) if kind == "letters" else " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, decontaminate.normalise(text(n + 9))[:n].strip()) for i, n in enumerate(sizes * 6)]
    texts, want = [], []
    for _ in range(copies):
        for i, t in items:
            pad = bytes(rng.choice(b"uvwxyz ") for _ in range(200))
            texts.append(decontaminate.normalise((pad + b" " + _edited(rng, t, int(rng.choice([0.07, 0.1]) * len(t))) + b" " + pad).decode()))
            want.append(i)
    limit = {i: int(0.1 * len(t)) for i, t in items}
    near = {(d, i) for d, i in enumerate(want) if decontaminate.infix_distance(dict(items)[i], texts[d]) <= limit[i]}
    got = decontaminate.Finder(items).find(texts)
    found = {(d, k) for d, k, _, _ in got}
    if max(sizes) < 20:  # an edit is worth more than a tenth of many of these
        near |= found
        assert len(near) >= 0.25 * len(want) and all(t in texts[d] for d, k in found for t in [dict(items)[k]] if len(t) < 10)
        short = {(d, i) for d, i in near if len(dict(items)[i]) < 10}
        exact = {(d, i) for d, x in enumerate(texts) for i, t in items if len(t) < 10 and b" " + t + b" " in b" " + x + b" "}
        assert short == exact and len(found & near) >= 0.97 * len(near)
        return
    assert len(near) >= 0.85 * len(want) and len(found & near) >= 0.97 * len(near)
    assert all(decontaminate.infix_distance(dict(items)[k], texts[d]) <= e <= limit[k] for d, k, _, e in got)


def test_finder_against_brute_force():
    """All pairs of items and texts, near and far, by the plain infix distance."""
    rng = random.Random(8)
    items = [(i, " ".join(rng.choice(["red", "green", "blue", "stone", "river", "cloud", "lamp"]) for _ in range(rng.randrange(1, 14))).encode()) for i in range(20)] + [(90, b"ab"), (91, b"")]
    texts = [_edited(rng, dict(items)[rng.randrange(20)], rng.randrange(0, 4)) + b" tail" * rng.randrange(2) for _ in range(40)] + [b"ab", b"", b"ab c"]
    texts = [decontaminate.normalise(t.decode()) for t in texts]
    near = lambda t, x: edit_distance_infix(t, x) <= len(t) // 10 if len(t) >= 10 else b" " + t + b" " in b" " + x + b" "
    want = {(d, k) for d, x in enumerate(texts) for k, t in items if t and near(t, x)}
    got = {(d, k) for d, k, _, _ in decontaminate.Finder(items).find(texts)}
    assert got <= want and len(got) >= 0.98 * len(want) > 20 and {(40, 90), (42, 90)} <= got


def test_pieces():
    rng = random.Random(1)
    for n in (8, 127, 255, 300, 400, 5000):
        item = decontaminate.normalise("".join(rng.choice("abcdefg hi") for _ in range(n)))
        cut = decontaminate._pieces(item)
        assert b"".join(item[a : a + k] for a, k in cut) == item and (len(item) < 256) == (len(cut) == 1) and all(2 * k >= decontaminate.PIECE or len(cut) == 1 for _, k in cut)


def test_items_without_ids_and_repeated_rows(spark, table):
    items = spark.createDataFrame([(None, ITEMS[2]), (1, ITEMS[1]), (1, ITEMS[1]), (6, "ab")], "item_id bigint, text string")
    docs = table({1: ITEMS[1], 2: ITEMS[2], 3: "AB!", 4: "ab c", 5: ITEMS[1]})
    got = sorted((r.doc_id, r.contaminated, r["items"]) for r in decontaminate.report(docs.unionByName(docs.where("doc_id = 1")), items).collect())
    assert got == [(1, True, [1]), (1, True, [1]), (2, True, []), (3, True, [6]), (4, True, [6]), (5, True, [1])]


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_rows_that_share_an_id(spark, table, monkeypatch, most):
    """A row stays or goes by its own text, whether the keys of the hits are broadcast or shuffled."""
    monkeypatch.setattr(decontaminate, "BROADCAST_HITS", most)
    docs = table({1: ITEMS[1], 2: "clean too"}).unionByName(table({1: "a clean text of one id"})).unionByName(table({None: ITEMS[2]})).unionByName(table({None: "clean"}))
    kept = decontaminate.survivors(docs, _items(spark))
    assert ("BroadcastHashJoin" in kept._jdf.queryExecution().sparkPlan().toString()) or not most
    kept = kept.collect()
    assert sorted(r.text for r in kept) == ["a clean text of one id", "clean", "clean too"]
    told = decontaminate.report(docs, _items(spark)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.contaminated) for r in told) == [(False, 1, False), (False, 1, True), (False, 2, False), (True, 0, False), (True, 0, True)]


def test_blocks_split_items_without_ids(spark, monkeypatch):
    items = spark.createDataFrame([(None, f"{k} " + ITEMS[1]) for k in range(40)] + [(None, ITEMS[2])] * 99, "item_id bigint, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 500)
    held = [[r.text for r in b.collect()] for b in decontaminate.blocks(items, "item_id", "text")]
    assert sorted(t for b in held for t in b) == sorted({r.text for r in items.collect()}) and max(sum(map(len, b)) for b in held) < 1_500
    docs = spark.createDataFrame([(1, ITEMS[2]), (2, "7 " + ITEMS[1]), (3, "none")], "doc_id bigint, text string")
    assert {r.doc_id: r.contaminated for r in decontaminate.report(docs, items).collect()} == {1: True, 2: True, 3: False}


def test_short_items_and_phrases():
    """An item too short for edits stands between words; one of ten bytes or more has its tenth."""
    items = [(1, b"was ist"), (2, b"is"), (3, b"seventeen letters"), (4, b"x")]
    texts = [b"und was ist das", b"this", b"it has sevnteen letters here", b"was istdas", b"a x", b"is", b"ax"]
    assert sorted((d, k) for d, k, _, _ in decontaminate.Finder(items).find(texts)) == [(0, 1), (2, 3), (4, 4), (5, 2)]


def test_memory_of_long_items():
    """A full block with an item of 100 KB stays far below a gigabyte, and finds its items."""
    code = """
import random, resource, sys
sys.path.insert(0, %r)
from rasterloom.llm import decontaminate
rng = random.Random(3)
word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
text = lambda n: " ".join(word() for _ in range(n // 6))[:n].strip().encode()
items = [(i, text(2_000)) for i in range(3_950)] + [(9_999, text(100_000))]
f = decontaminate.Finder(items)
found = f.find([b"before " + items[5][1] + b" after", items[-1][1][:50_000] + b"zz" + items[-1][1][50_000:], text(3_000)] + [text(500) for _ in range(50)])
assert sorted((d, k) for d, k, _, _ in found) == [(0, 5), (1, 9_999)], found
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
""" % str(Path(__file__).resolve().parents[2])
    told = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True)
    assert told.returncode == 0, told.stderr
    assert int(told.stdout) < 1_000


@pytest.mark.parametrize("size", [30, 31])
def test_segments_shorter_than_a_seed(size):
    item = b"abcdefghijklmnopqrstuvwxyz01234"[:size]
    text = bytearray(b"before " + item + b" after")
    for at in (7, 14, 21):  # the first byte of all segments but one
        text[7 + at] = ord("9")
    assert [(k, e) for _, k, _, e in decontaminate.Finder([(1, item)]).find([bytes(text)])] == [(1, 3)]


def test_op5_finds_whole_items(spark):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op5_decontaminate(spark, SF).collect():
        assert {i for i, t in items.items() if t in docs[r.doc_id]} <= set(r["items"])


# tokens and packing


@pytest.fixture(scope="module")
def encoder():
    return Encoder(default_path())


def _ids(raw):
    return np.frombuffer(raw, "<u2").tolist()


def test_encoder_equals_tokenizer(encoder, corpus):
    odd = ["İstanbul ΑΣ, Σ'S it's <|endoftext|>x 'tis don't 12a3 a1, ...! ß ẞ ŒUVRE \xa0x 你好,世界 ﬁ \x1cfoo\x85bar é co-op, (hi) [x]. 😀ok K ſ!!", "", "\n\t a", "ab.,b x.y. .x"]
    texts = [t or "" for t in corpus.values()] + odd
    want = encoder.full.encode_batch(texts, add_special_tokens=False)
    assert [_ids(x) for x in encoder.encode(texts)] == [e.ids for e in want]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aAbZzéÉßİΣσς'’.,!?;:|)(<>\"- \t\n\xa0́ﬁ09<|")))
def test_encoder_on_any_text(encoder, text):
    assert _ids(encoder.encode([text])[0]) == encoder.full.encode(text, add_special_tokens=False).ids


def test_words_go_through_the_model_once_a_batch(encoder, monkeypatch):
    seen, words = Counter(), ["Garden", "fenêtre", "ÉCOLE", "straße"]
    bare = encoder.bare
    monkeypatch.setattr(encoder, "bare", SimpleNamespace(encode_batch_fast=lambda lines, **k: seen.update(p for x in lines for p in x.split(" ")) or bare.encode_batch_fast(lines, **k)))
    texts = [f" {w}{s} {w.lower() if w.isascii() else w}{s}\n{w}" for w in words for s in ("", ",", ".", "'", "?!", '."', "_", ")|")] * 3
    assert [_ids(x) for x in encoder.encode(texts)] == [e.ids for e in encoder.full.encode_batch(texts, add_special_tokens=False)]
    assert len(seen) >= len(words) and max(seen.values()) == 1


@pytest.mark.parametrize("texts", [[], [""], [None, " \n"], ["word"], ["..."], ["12"], ["a\x00", "\x00"], ["a<|", "<|endoftext|>", "b<|endoftext|>, <|ENDOFTEXT|>"], ["ÉCOLE's a' a'' a's' H̱ ẖ. ª º. µ, ×. a÷ c÷.", None, " x "]])
def test_encoder_on_odd_batches(encoder, texts):
    assert [_ids(x) for x in encoder.encode(texts)] == [encoder.full.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("length", [16, 4096])
def test_packing(table, corpus, encoder, length):
    docs = table(corpus).repartition(5)
    rows = packing.pack(docs, length, with_ids=True).collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length > 0
    for d, text in corpus.items():
        ids = encoder.full.encode(text or "", add_special_tokens=False).ids + [2]
        parts = sorted(by[d], key=lambda r: r.start)
        assert [i for r in parts for i in r.ids] == ids and {r.doc_tokens for r in parts} == {len(ids)}
        assert [r.start for r in parts] == list(np.cumsum([0] + [r.length for r in parts[:-1]]))
    held: dict = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    full = {}
    for s, v in held.items():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        full[s] = at
    assert sorted(full) == list(range(len(full))) and all(full[s] == length for s in sorted(full)[:-1]) and full[max(full)] <= length
    assert packing.pack(table(corpus, empty=True)).collect() == []


def test_other_tokenizer(table):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack(table({1: "Hello  world", 2: None}), path=path, end=50256, with_ids=True).collect()
    assert {r.doc_id: r.ids for r in rows} == {1: Encoder(path).full.encode("Hello  world").ids + [50256], 2: [50256]}


# language model


def _katz_twin(docs, train, most):
    """Scores by dictionaries: id -> (tokens, known, base, score)."""
    tok = {d: [w.decode() for w in (t or "").encode().lower().split()] + [""] for d, t in docs.items()}
    c = Counter(w for d in docs if train[d] for w in tok[d])
    total, of, starts = sum(c.values()), Counter(c.values()), sum(train.values())
    cut, n = None, 0
    for k in sorted(of, reverse=True):
        n += of[k]
        if n > most:
            break
        cut = k
    often = {w for w in c if cut is not None and c[w] >= cut}

    def discount(of):
        d, a = {}, 6 * of.get(6, 0) / of[1] if of.get(1) else 2
        for r in range(1, 6):
            d[r] = 1.0
            if of.get(1) and of.get(r) and a < 1 and 0 < (v := ((r + 1) * of.get(r + 1, 0) / of[r] / r - a) / (1 - a)) <= 1:
                d[r] = v
        return d

    d1 = discount(of)
    kept = sum(d1.get(k, 1) * k for k in c.values())
    scale = kept / (kept + 1) if kept > total - 1 else 1
    unseen = (1 - scale * kept / total if total else 1) / max(of.get(1, 0), 1)
    p1 = lambda w: scale * d1.get(c[w], 1) * c[w] / total if c[w] else unseen
    assert abs(sum(map(p1, c)) + unseen * max(of.get(1, 0), 1) - 1) < 1e-9
    start = object()
    pairs = {d: list(zip([start, *tok[d]], tok[d], strict=False)) for d in docs}
    has = lambda v: starts > 0 if v is start else v in often
    n2 = Counter(x for d in docs if train[d] for x in pairs[d] if has(x[0]))
    d2 = discount(Counter(n2.values()))
    size = lambda v: starts if v is start else c[v]
    after: dict = {}
    for (v, w), k in n2.items():
        after.setdefault(v, []).append((w, k))

    def p(v, w):
        if not has(v):
            return p1(w)
        if k := n2.get((v, w)):
            return d2.get(k, 1) * k / (size(v) + 1)
        seen = after.get(v, [])
        left = 1 - sum(d2.get(k, 1) * k for _, k in seen) / (size(v) + 1)
        return left / max(1 - sum(p1(w) for w, _ in seen), 1e-12) * p1(w)

    for v in list(after)[:5]:
        assert abs(sum(p(v, w) for w in c) + p(v, "never seen") * max(of.get(1, 0), 1) - 1) < 1e-9
    base = lambda w: math.log10((c[w] + 0.5) / (total + 0.5 * (len(c) + 1)))
    return {d: (len(tok[d]), sum(c[w] > 0 for w in tok[d]), sum(map(base, tok[d])), sum(math.log10(p(v, w)) for v, w in pairs[d])) for d in docs}, total


@pytest.mark.parametrize("often,part", [(2, 300), (16, 2_000_000)])
def test_katz(table, corpus, monkeypatch, tmp_path, often, part):
    """Against dictionaries, with pairs sent once and not; the stored model scores the same."""
    monkeypatch.setattr(katz, "OFTEN", often)
    monkeypatch.setattr(katz, "PART_TOKENS", part)
    docs = {d: t for d, t in corpus.items() if t is None or len(t) < 10_000}
    train = {d: zlib.crc32(str(d).encode()) % 5 != 1 for d in docs}
    want, total = _katz_twin(docs, train, math.inf)
    rows = table(docs).repartition(3)
    got = katz.score(rows, ~queries.held_out(5, 1)).collect()
    model = katz.train(rows, ~queries.held_out(5, 1), str(tmp_path / "model"))
    new = katz.Model(model.spark, model.path).score(rows).collect()
    assert len(got) == len(docs) == len(new)
    for r in got + new:
        n, known, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, abs=1e-6) and r.score == pytest.approx(score, abs=1e-6)
    assert all(r.train == train[r.doc_id] for r in got) and not any(r.train for r in new)


def test_katz_records_grow_with_the_pairs(spark, corpus):
    """Not with the product of blocks and partitions: no record without pairs, and nothing in one but its pairs."""
    rng = random.Random(3)
    text = lambda: " ".join(f"w{rng.randrange(50)}" for _ in range(40))
    rows = spark.createDataFrame([(i, text(), True) for i in range(60)], "id bigint, text string, train boolean").repartition(20)
    uni = katz.unigrams(rows)
    sizes = []
    for parts in (4, 4000):
        made = katz._spread(rows, uni, parts).where("kind = 1").collect()
        sizes.append(sum(len(x) for r in made for x in r.data))
        assert len(made) <= 60 * 41
    assert sizes[0] == sizes[1]


@pytest.mark.parametrize("numbered,part", [(40, 500), (0, 2000)])
def test_katz_contexts_without_numbers(table, corpus, monkeypatch, numbered, part):
    """How many words have numbers doesn't change the model."""
    monkeypatch.setattr(katz, "NUMBERED", numbered)
    monkeypatch.setattr(katz, "PART_TOKENS", part)
    docs = {d: t for d, t in corpus.items() if t is None or len(t) < 10_000}
    train = {d: zlib.crc32(str(d).encode()) % 5 != 1 for d in docs}
    want, _ = _katz_twin(docs, train, math.inf)
    for r in katz.score(table(docs).repartition(3), ~queries.held_out(5, 1)).collect():
        assert (r.n_tokens, r.n_known, r.base_score, r.score) == pytest.approx(want[r.doc_id], abs=1e-6)


def test_katz_many_words(table):
    """More words than have numbers: a pair of rare words counts like any other."""
    docs = {d: " ".join(f"w{k}" for k in range(1000 * d, 1000 * d + 1000)) for d in range(270)}
    docs |= {300: "w5 w6 w7 w100 w6", 301: "w269998 w269999 nowhere w3"}
    train = {d: d < 300 for d in docs}
    want, _ = _katz_twin(docs, train, math.inf)
    got = {r.doc_id: r.score for r in katz.score(table(docs), F.col("doc_id") < 300).collect()}
    assert got == {d: pytest.approx(w[3], abs=1e-5) for d, w in want.items()}


def test_katz_edges(table, corpus):
    assert katz.score(table(corpus, empty=True), F.lit(True)).collect() == []
    got = katz.score(table({1: "a b", 2: None}), F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    twice = table({1: "a b", 2: None})
    assert len(katz.score(twice.unionByName(twice), F.lit(True)).collect()) == 4


def test_katz_counts_beyond_32_bits(spark, tmp_path):
    """Stored counts above 2^32 are read and answered as they are, for pairs that come once in a block and often."""
    docs = spark.createDataFrame([(i, "alpha beta") for i in range(50)], "doc_id bigint, text string")
    katz.train(docs, F.lit(True), str(tmp_path / "plain"))
    more = 1 << 33

    def raised(data):
        for k in (1, 4, 7, 10):
            data[k] = (np.frombuffer(data[k], "u8") + np.uint64(more)).tobytes()
        return data

    pairs = [(r.kind, r.part, r.block, raised(list(map(bytes, r.data)))) for r in spark.read.parquet(str(tmp_path / "plain/pairs")).collect()]
    spark.createDataFrame(pairs, katz._RECORD).write.parquet(str(tmp_path / "raised/pairs"))
    spark.read.schema(katz._RECORD).parquet(str(tmp_path / "plain/words")).write.parquet(str(tmp_path / "raised/words"))
    few, many = docs.limit(1), docs.limit(40)
    score = lambda name, rows: {round(r.score, 9) for r in katz.Model(spark, str(tmp_path / name)).score(rows).collect()}
    (old,) = score("plain", few) | score("plain", many)
    (new,) = score("raised", few) | score("raised", many)
    assert new - old == pytest.approx(3 * math.log10((50 + more) / 50))


def test_words_without_letters():
    assert regex.search(r"\p{L}", "12 !") is None and language_id.plain("Ab-c1É") == b" ab c \xc3\x89 "
