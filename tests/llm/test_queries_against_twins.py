"""Queries that SQL can't express, as registered, against plain twins on the smallest tables."""

import math
import zlib

import numpy as np
import pytest
import regex
from test_models import _katz_twin

from rasterloom.llm import language_id, queries, toxicity
from rasterloom.llm.tokens import Encoder, default_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def remains(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def grams(text):
    """Hashes of the byte 2- to 4-grams of each word with its borders, one by one."""
    data = language_id.plain(text)
    out = []
    for n in (2, 3, 4):
        for i in range(len(data) - n + 1):
            part = data[i : i + n]
            if part.strip() if n == 2 else 32 not in part[1:-1]:
                h = part[0]
                h = h * 0x01000193 & 0xFFFFFFFF
                for c in part[1:]:
                    h = (h ^ c) * 0x01000193 & 0xFFFFFFFF
                h = h + (n * 0x9E3779B1 & 0xFFFFFFFF) & 0xFFFFFFFF
                out.append((h ^ h >> 15) * 0x85EBCA6B % (1 << 32) >> 16)
    return out


def test_op2(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs, ~queries.held_out(4, 2))
    for r in queries.op2_language_id(spark, SF).collect():
        text = documents[r.doc_id]
        assert r.held_out == (remains(r.doc_id, 4) == 2)
        if not text or not regex.search(r"\p{L}", text):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        at = grams(text)
        z = [model.temperature * (model.bias[k] + sum(float(model.table[g, k]) for g in at) / max(len(at), 1)) for k in range(len(model.languages))]
        p = [math.exp(x - max(z)) for x in z]
        best = max(range(len(p)), key=p.__getitem__)
        assert r.lang_pred == model.languages[best] and r.score == pytest.approx(p[best] / sum(p), abs=1e-3)


def test_op2_learns_from_its_rows_only(spark):
    """Other languages, texts and ids of held-out rows change nothing."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = docs.where(~queries.held_out(4, 2))
    a, b = language_id.train(docs, ~queries.held_out(4, 2)), language_id.train(known, ~queries.held_out(4, 2))
    assert a.languages == b.languages and (a.table == b.table).all() and a.limit == b.limit


def test_op6(spark, documents):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels, ~queries.held_out(3, 1))
    for r in queries.op6_toxicity(spark, SF).collect():
        held = {w.lower() for w in regex.findall(rb"[A-Za-z\x80-\xff]+", (documents[r.doc_id] or "").encode())}
        hit = {k for mark, of in model.by_mark.items() for k in of if any(w == mark[:-1] if mark.endswith(b"$") else w.startswith(mark) for w in held)}
        hit |= {k for k, p in model.patterns if regex.search(p, documents[r.doc_id] or "")}
        assert set(r.voters) == {model.names[k] for k in hit}
        z = model.bias + sum(float(model.weights[k]) for k in hit)
        assert r.score == pytest.approx(1 / (1 + math.exp(-z))) and r.predicted == int(r.score >= 0.7) and r.held_out == (remains(r.doc_id, 3) == 1)


def test_op7(spark, documents):
    encoder = Encoder(default_path())
    pieces = sorted(queries.op7_packing(spark, SF).collect(), key=lambda r: (r.doc_id, r.start))
    held: dict = {}
    for r in pieces:
        held.setdefault(r.doc_id, []).append(r)
    at: dict = {}
    assert held.keys() == documents.keys()
    for d, mine in held.items():
        ids = np.append(np.array(encoder.full.encode(documents[d] or "", add_special_tokens=False).ids, "<u4"), np.uint32(2))
        assert [r.start for r in mine] == np.cumsum([0] + [r.length for r in mine])[:-1].tolist() and sum(r.length for r in mine) == len(ids)
        for r in mine:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
            at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in at.values():
        places.sort()
        assert [o for o, _ in places] == np.cumsum([0] + [n for _, n in places])[:-1].tolist() and sum(n for _, n in places) <= 4096
    total = sum(r.length for r in pieces)
    assert len(at) == -(-total // 4096)


def test_op9(spark, documents):
    train = {d: remains(d, 5) != 1 for d in documents}
    want, total = _katz_twin(documents, train, math.inf)
    got = queries.op9_lm_scoring(spark, SF).collect()
    assert len(got) == len(documents)
    for r in got:
        n, known, base, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not train[r.doc_id], n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-6)
