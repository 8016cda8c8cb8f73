import zlib

import numpy as np
import pytest
from brute import exact, near_classes

import corpus_pipeline as cp
from rasterloom.llm import decontaminate, queries, toxicity
from rasterloom.llm.tokens import Encoder, default_path

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    """Each stage keeps what its plain twin keeps of its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    stages = dict(cp.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), ~queries.held_out(3, 1))
    clean = stages["toxicity"](spark, docs, SF)
    assert clean.columns == docs.columns
    assert texts(clean) == {d: t for d, t in texts(docs).items() if model.score(t) < 0.7}
    single = stages["exact_dedup"](spark, clean, SF)
    assert single.columns == docs.columns and set(texts(single)) == {k for k, _, _ in exact(texts(clean)).values()}
    apart = stages["near_dedup"](spark, single, SF)
    assert apart.columns == docs.columns and set(texts(apart)) == {r for _, r in near_classes(texts(single)).values()}
    fresh = stages["decontamination"](spark, apart, SF)
    items = [decontaminate.normalise(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert fresh.columns == docs.columns and set(texts(fresh)) == {d for d, t in texts(apart).items() if not any(i in decontaminate.normalise(t) for i in items)}
    packed = stages["packing"](spark, fresh, SF).collect()
    whole = Encoder(default_path()).full
    ids = {d: whole.encode(t or "", add_special_tokens=False).ids + [2] for d, t in texts(fresh).items()}
    assert {r.doc_id for r in packed} == set(ids) and sum(r.length for r in packed) == sum(map(len, ids.values()))
    for r in packed:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())


@pytest.fixture
def small(spark, tmp_path):
    """A folder of tables from rows of documents, with labels and benchmark items."""

    def make(rows):
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame([(r[0], 1, 0) for r in rows], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
        spark.createDataFrame([(1, "a passage of the benchmark that no training text may hold")] * bool(rows), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)

    return make


def test_run_on_empty_tables(spark, small):
    assert cp.run(spark, small([])).collect() == []


def test_run_with_nulls_and_repeated_rows(spark, small):
    """A row without an id or text is a document like others; repeated rows leave one."""
    rows = [(1, "one two three four five six", None, None, None), (1, "one two three four five six", None, None, None), (2, None, "en", "s", 0), (3, "", None, None, None), (None, "a text without an id", None, None, None), (4, "x A passage of the Benchmark, that no training text may hold!", None, None, 1)]
    got = cp.run(spark, small(rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, 1), (False, 2), (True, 0)]


def test_run(spark):
    rows = cp.run(spark, SF)
    assert set(rows.columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} and rows.count() > 100
    assert cp.ORACLE_SQL is None
