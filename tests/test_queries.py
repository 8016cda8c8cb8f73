import os
import subprocess
import sys
import zlib
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import checksums, parts
from rasterloom.plans import file_queries, table_queries
from rasterloom.plans import queries as raster

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


QUERIES = raster.QUERIES | table_queries.QUERIES | file_queries.QUERIES
ORACLE_SQL = raster.ORACLE_SQL | table_queries.ORACLE_SQL | file_queries.ORACLE_SQL


@pytest.mark.parametrize("name", list(QUERIES))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(map(tuple, df.select(*columns).collect()), key=str)
    told = duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})")
    assert got == sorted(told.fetchall(), key=str)


def test_checksums(spark):
    made = [b"", b"a", b"Wikipedia", bytes(range(256)) * 300, b"\xff" * 70_000]
    rows = spark.createDataFrame([(i, j, bytearray(a), bytearray(b)) for i, a in enumerate(made) for j, b in enumerate(made)], "i int, j int, a binary, b binary")
    one, two = checksums.adler32(F.col("a")), checksums.adler32(F.col("b"))
    size = F.octet_length("b").cast("long")
    crc = parts.crc32_combine(checksums.crc32(F.col("a")), checksums.crc32(F.col("b")), size)
    for r in rows.select("i", "j", one.alias("x"), checksums.adler32_native(F.col("a")).alias("n"), checksums.adler32_combine(one, two, size).alias("y"), checksums.crc32(F.col("a")).alias("c"), crc.alias("d")).collect():
        a, b = made[r.i], made[r.j]
        assert (r.x, r.n, r.y, r.c, r.d) == (zlib.adler32(a), zlib.adler32(a), zlib.adler32(a + b), zlib.crc32(a), zlib.crc32(a + b))
        assert checksums.crc32_combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    none = rows.limit(1).select(checksums.adler32(F.lit(None).cast("binary")).alias("x"), parts.crc32_combine(F.lit(1), F.lit(None).cast("long"), F.lit(2)).alias("y")).first()
    assert none.x is None and none.y is None


def test_twins_without_sql(spark):
    for row in raster.crc32(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").limit(50).collect():
        assert row.crc == zlib.crc32(row.text.encode())
    for name in ("encode_bilevel", "encode_bilevel_tpgd", "container_bytes", "container_fragment"):
        assert all(len(r.code) == 2 * r["size"] and ("ffac" in r.code) for r in raster.QUERIES[name](spark, SF).collect())


def test_entry_without_training_data():
    """The entry imports and lists the raster queries when the other subpackage and the pipeline are absent."""
    code = "import sys; sys.modules['rasterloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'threshold' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_entry(spark):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["ctx", "bit", "n"]
    assert set(e.oracle_sql()) <= set(e.queries())
