from datetime import datetime

import numpy as np
import pytest
from make import pbm, pgm, png
from pyspark.sql import functions as F
from t88 import decode_file

from rasterloom.functions import colour, metadata
from rasterloom.operators import kernels, pixels
from rasterloom.plans.pipeline import Options, binarize_images, convert, encode_images
from rasterloom.sources.images import read_files, read_images
from rasterloom.sources.sinks import write_pages, write_table
from rasterloom.streaming.ingest import ingest

RNG = np.random.default_rng(8)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("images")
    bits, gray = RNG.integers(0, 2, (13, 40)).astype(np.uint8), RNG.integers(0, 256, (12, 17)).astype(np.uint8)
    (d / "a.pbm").write_bytes(pbm(bits))
    (d / "b.pgm").write_bytes(pgm(gray))
    (d / "c.png").write_bytes(png(gray[..., None], 8, 0, (1, 2, 3, 4)))
    (d / "d.gif").write_bytes(b"GIF89a" + b"\0" * 20)
    (d / "e.txt").write_bytes(b"hi")
    (d / "f.pgm").write_bytes(pgm(gray)[:-5])
    return d, bits, gray


def _by_name(rows):
    return {r.img_id.rsplit("/", 1)[-1]: r for r in rows}


def test_convert(spark, folder):
    d, bits, gray = folder
    for options in (Options(), Options(typical=True, full=False), Options(scale=2), Options(scale=4, threshold=100)):
        got = _by_name(convert(spark, str(d), options, parts=3).collect())
        want = kernels.threshold(kernels.upscale(gray, options.scale), options.threshold)
        assert len(got) == 6
        assert (decode_file(got["a.pbm"].code) == bits).all()
        assert (decode_file(got["b.pgm"].code) == want).all()
        assert got["b.pgm"].code == got["c.png"].code
        assert [got[n].error.code for n in ("d.gif", "e.txt", "f.pgm")] == [3, 1, 3]
        assert got["a.pbm"].error is None


def test_steps_agree_with_convert(spark, folder):
    d, _, _ = folder
    steps = _by_name(encode_images(binarize_images(read_images(spark, str(d)), Options()), Options()).collect())
    whole = _by_name(convert(spark, str(d)).collect())
    assert {n: (r.code, r.error) for n, r in steps.items()} == {n: (r.code, r.error) for n, r in whole.items()}
    undone = _by_name(encode_images(read_images(spark, str(d), glob="*.pgm")).collect())
    assert undone["b.pgm"].error.code == 2


def test_scan_pushes_length(spark, folder):
    files = read_files(spark, str(folder[0]), most_bytes=50)
    assert {r.path.rsplit("/", 1)[-1] for r in files.select("path").collect()} == {"d.gif", "e.txt"}
    plan = files.select("path", "length")._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,50)" in plan and "content" not in plan.split("ReadSchema")[1]


def test_sinks(spark, folder, tmp_path):
    pages = convert(spark, str(folder[0]))
    write_pages(pages, str(tmp_path / "pages"), root=str(folder[0]))
    got = _by_name(pages.collect())
    assert {p.name: p.read_bytes() for p in (tmp_path / "pages").iterdir()} == {f"{n}.jb2": bytes(r.code) for n, r in got.items() if r.code is not None}
    write_table(pages, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 6


def test_pages_of_one_name(spark, tmp_path):
    """Pages that share a name keep their folders; one outside the root fails, as does a way out of the folder."""
    pages = spark.createDataFrame([("file:///a/1/page%20x.png", bytearray(b"1")), ("file:/a/2/page.png", bytearray(b"2")), ("s3://b/a/3/page.png", bytearray(b"3")), ("/a/e.png", None)], "img_id string, code binary")
    write_pages(pages, str(tmp_path / "below"), root="/a")
    files = lambda d: {str(p.relative_to(d)): p.read_bytes() for p in d.rglob("*") if p.is_file()}
    assert files(tmp_path / "below") == {"1/page x.png.jb2": b"1", "2/page.png.jb2": b"2", "3/page.png.jb2": b"3"}
    write_pages(pages, str(tmp_path / "whole"), suffix="")
    assert set(files(tmp_path / "whole")) == {"a/1/page x.png", "a/2/page.png", "a/3/page.png"}
    for bad, root in (("/b/x.png", "/a"), ("/a/../x.png", "/a")):
        with pytest.raises(Exception, match="doesn't lie below|names no file"):
            write_pages(spark.createDataFrame([(bad, bytearray(b"x"))], "img_id string, code binary"), str(tmp_path / "bad"), root=root)


def test_stream(spark, folder, tmp_path):
    d, bits, _ = folder
    (tmp_path / "in").mkdir()
    for n in ("a.pbm", "b.pgm"):
        (tmp_path / "in" / n).write_bytes((d / n).read_bytes())
    go = lambda: ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    go()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    (tmp_path / "in" / "c.png").write_bytes((d / "c.png").read_bytes())
    go()
    got = _by_name(spark.read.parquet(str(tmp_path / "out")).collect())
    assert len(got) == 3 and (decode_file(got["a.pbm"].code) == bits).all()


def _table(spark, arrays):
    rows = [(f"i{k}", y, x, int(v)) for k, a in enumerate(arrays) for (y, x), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, "img_id string, y int, x int, v bigint")


def _array(df, column, k, shape):
    out = np.full(shape, -1, np.int64)
    for r in df.where(F.col("img_id") == f"i{k}").select("y", "x", column).collect():
        out[r[0], r[1]] = r[2]
    return out


@pytest.mark.parametrize("shape", [(1, 1), (1, 6), (5, 1), (6, 35)])
def test_pixels_equal_kernels(spark, shape):
    grays = [RNG.integers(0, 256, shape).astype(np.uint8) for _ in range(2)]
    px = _table(spark, grays)
    bits = pixels.threshold(px, 128)
    for k, g in enumerate(grays):
        b = kernels.threshold(g, 128)
        assert (_array(bits, "bit", k, shape) == b).all()
        assert (_array(pixels.contexts(bits), "ctx", k, shape) == kernels.contexts(b)).all()
        for s in (2, 4):
            big = (shape[0] * s, shape[1] * s)
            assert (_array(pixels.upscale(px, s), "v", k, big) == kernels.upscale(g, s)).all()
        same = {r.y: r.same for r in pixels.typical(bits).where(F.col("img_id") == f"i{k}").collect()}
        assert [same[y] for y in range(shape[0])] == kernels.typical(b).tolist()
        words = {r.y: r.words for r in pixels.lines(bits).where(F.col("img_id") == f"i{k}").collect()}
        assert [words[y] for y in range(shape[0])] == kernels.words(b).tolist()
        for undo in (pixels.unfilter_sub(pixels.filter_sub(px)), pixels.unfilter_up(pixels.filter_up(px))):
            assert (_array(undo, "v", k, shape) == g).all()


def test_small_operators(spark):
    px = _table(spark, [np.arange(12).reshape(3, 4)])
    boxed = pixels.invert_box(pixels.threshold(px, 100), 2, -1, 9, 3)
    assert _array(boxed, "bit", 0, (3, 4)).tolist() == [[1, 1, 0, 0], [1, 1, 0, 0], [1, 1, 1, 1]]
    ls = spark.createDataFrame([("a", 0, [0xFFFFFFFF, 0xFFFFFFFF])], "img_id string, y int, words array<bigint>")
    for w, value, want in ((40, 0, 0xFF000000), (64, 0, 0xFFFFFFFF), (33, 0, 0x80000000)):
        assert pixels.set_pad_bits(ls, F.lit(w), F.lit(1), value).first().words == [0xFFFFFFFF, want]
    ls = spark.createDataFrame([("a", 0, [0, 0])], "img_id string, y int, words array<bigint>")
    assert pixels.set_pad_bits(ls, F.lit(40), F.lit(1), 1).first().words == [0, 0x00FFFFFF]
    a = spark.createDataFrame([("p", 1, 2, 8), ("q", 1, 2, 1)], "img_id string, w int, h int, d int")
    b = spark.createDataFrame([("p", 1, 2, 8), ("q", 1, 2, 8)], "img_id string, w int, h int, d int")
    assert {r.img_id: r.equal for r in pixels.same_size(a, b).collect()} == {"p": True, "q": False}


def test_palette_columns(spark):
    df = spark.createDataFrame([([(1, 1, 1), (2, 2, 2)],), ([(1, 2, 1)],)], "cmap array<struct<r:smallint,g:smallint,b:smallint>>")
    c = F.col("cmap")
    rows = df.select(colour.has_colour(c).alias("has"), colour.size(colour.add(c, 9, 8, 7, 1)).alias("n"), colour.entry(c, F.lit(5)).alias("none"), colour.channels(c)[1].alias("g")).collect()
    assert [(r.has, r.n, r.none, r.g) for r in rows] == [(False, 2, None, [1, 2]), (True, 2, None, [2])]
    big = spark.range(257).select(F.col("id").alias("idx"), F.lit(0).alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"))
    with pytest.raises(ValueError):
        colour.palette_join(_table(spark, [np.zeros((1, 1))]), big)


def test_metadata(spark):
    df = spark.createDataFrame([("/a/", "b", datetime(1997, 8, 29, 2, 14)), ("/a", None, None), (None, "b", None)], "d string, n string, t timestamp")
    rows = df.select(metadata.path_name(F.col("d"), F.col("n")).alias("p"), metadata.rfc1123(F.col("t")).alias("t")).collect()
    assert [r.p for r in rows] == ["/a/b", "/a", "b"] and rows[0].t == "29 Aug 1997 02:14:00 +0000"
