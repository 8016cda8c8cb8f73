"""Packed lines, ordered parts, mixed filters, passes and palettes of each image."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import checksums, colour, parts
from rasterloom.operators import coder, filters, interlace, kernels, lines
from rasterloom.plans import table_queries
from rasterloom.sources import png


def raster(rng, w, h):
    bits = rng.integers(0, 2, (h, w)).astype(np.uint8)
    bits[1:] = np.where(rng.random((h - 1, 1)) < 0.4, bits[:-1], bits[1:])
    return bits


def line_table(spark, images):
    rows = [(i, y, [255 * (1 - int(v)) for v in line]) for i, bits in images.items() for y, line in enumerate(bits)]
    random.Random(1).shuffle(rows)
    return lines.threshold(spark.createDataFrame(rows, "img_id int, y int, values array<int>"), 128)


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(3)
    return {w: raster(rng, w, 6) for w in (1, 2, 5, 31, 32, 33, 61, 64, 65, 100)}


def test_lines_equal_kernels(spark, images):
    ls = line_table(spark, images).persist()
    assert all(r.words == kernels.words(images[r.img_id])[r.y].tolist() and r.w == r.img_id for r in ls.collect())
    assert {(r.img_id, r.y, r.x): r.bit for r in lines.pixels(ls).collect()} == {(i, y, x): int(v) for i, b in images.items() for (y, x), v in np.ndenumerate(b)}
    assert {(r.img_id, r.y): r.same for r in lines.typical(ls).collect()} == {(i, y): int(v) for i, b in images.items() for y, v in enumerate(kernels.typical(b))}
    assert {(r.img_id, r.y): r.contexts for r in lines.with_contexts(ls).collect()} == {(i, y): line.tolist() for i, b in images.items() for y, line in enumerate(kernels.contexts(b))}
    for typical in (False, True):
        want: dict = {}
        for b in images.values():
            for s in zip(*(x.tolist() for x in coder.symbols(b, typical)), strict=True):
                want[s] = want.get(s, 0) + 1
        assert {(r.ctx, r.bit): r.n for r in lines.context_histogram(ls, typical).collect()} == want
    assert {(r.img_id, r.y): r.words for r in lines.invert(ls).collect()} == {(i, y): line.tolist() for i, b in images.items() for y, line in enumerate(kernels.words(1 - b))}


@pytest.mark.parametrize("box", [(0, 0, 4, 2), (25, 1, 40, 3), (-5, -2, 8, 4), (31, 0, 2, 9), (60, 2, 500, 500), (200, 0, 5, 5), (3, 3, 0, 4), (3, 3, 4, 0), (0, 0, 100, 6)])
def test_boxes(spark, images, box):
    ls = line_table(spark, images)
    x, y, w, h = box
    for op, to in (("clear", lambda b: 0 * b), ("set", lambda b: 0 * b + 1), ("invert", lambda b: 1 - b)):
        want = {}
        for i, bits in images.items():
            made = bits.copy()
            at = (slice(max(y, 0), max(y + h, 0)), slice(max(x, 0), max(x + w, 0)))
            made[at] = to(made[at])
            want |= {(i, k): line.tolist() for k, line in enumerate(kernels.words(made))}
        assert {(r.img_id, r.y): r.words for r in lines.box(ls, *box, op).collect()} == want
    by_line = lines.box(ls, F.col("y"), 0, F.lit(1), F.lit(99), "set")  # a box that differs by line: the diagonal
    assert all(r.words[0] >> (31 - r.y) & 1 for r in by_line.where("w > 6").collect())


def test_lines_of_nothing(spark):
    none = lines.threshold(spark.createDataFrame([(1, 0, [])], "img_id int, y int, values array<int>"), 9)
    assert none.collect()[0].words == [] and lines.contexts(none).collect() == [] and lines.invert(none).collect()[0].words == []
    assert lines.context_histogram(none.where("false"), True).collect() == []


def test_lines_take_one_exchange(spark, images):
    plan = lines.context_histogram(line_table(spark, images), True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Python" not in plan  # lines by image, counts by context


def test_carrying():
    for crc in (0, 1, 0xDEADBEEF, 0xFFFFFFFF):
        for back in (False, True):
            assert parts._back(parts._forth(crc)) == crc == parts._forth(parts._back(crc))
    assert zlib.crc32(b"ab") == checksums.crc32_combine(zlib.crc32(b"a"), zlib.crc32(b"b"), 1)


def test_parts_in_any_order(spark):
    rng = random.Random(4)
    files = {f: bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 50, 3_000, 70_000]))) for f in range(12)} | {99: b"\xff" * 200_000}
    rows = []
    for f, data in files.items():
        cuts = sorted({0, len(data), *(rng.randrange(len(data) + 1) for _ in range(rng.randrange(9)))})
        for seq, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            rows.append((f, seq, a, b - a, zlib.crc32(data[a:b]), zlib.adler32(data[a:b])))
        if rng.random() < 0.5:  # an empty part changes nothing
            rows.append((f, 99, len(data), 0, 0, 1))
        elif not data:
            rows.append((f, 0, 0, 0, 0, 1))
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "file int, seq int, at long, length long, crc long, adler long").repartition(5)
    want = {f: (len(d), True, zlib.crc32(d), zlib.adler32(d)) for f, d in files.items()}
    assert {r.file: (r.length, r.complete, r.crc, r.adler) for r in parts.combine(table, ["file"], "at").collect()} == want
    assert {r.file: (r.length, r.complete, r.crc, r.adler) for r in parts.combine(parts.with_offsets(table, ["file"]), ["file"]).collect()} == want
    plan = parts.combine(table, ["file"], "at")._jdf.queryExecution().executedPlan().toString()
    assert "partial_" in plan and "Python" not in plan
    # a missing, doubled, overlapping or unknown part
    few = [(1, 0, 5, 1, 1), (1, 9, 3, 1, 1), (2, 0, 5, 1, 1), (2, 0, 5, 1, 1), (3, 0, 5, 1, 1), (3, 3, 5, 1, 1), (4, 0, 5, 1, 1), (4, 5, 2, None, 1), (5, 2, 3, 1, 1), (6, 0, 4, 7, 9)]
    got = parts.combine(spark.createDataFrame(few, "file int, offset long, length long, crc long, adler long"), ["file"]).collect()
    assert {r.file: (r.complete, r.crc, r.adler) for r in got} == {f: (False, None, None) for f in (1, 2, 3, 4, 5)} | {6: (True, 7, 9)}
    assert parts.combine(table.where("false"), ["file"], "at").collect() == []


def test_far_parts(spark):
    """A part at the end of a terabyte: its CRC goes back and forth over all zero bits of the way."""
    far = spark.range(1).select(parts.carried(parts.carried(F.lit(0xDEADBEEF), F.lit((1 << 40) - 3), back=True), F.lit((1 << 40) - 3)).alias("c"), parts.carried(F.lit(12345), F.lit(0)).alias("same")).first()
    assert (far.c, far.same) == (0xDEADBEEF, 12345)


def long_texts(spark, tmp_path):
    """Documents of one, three and very many parts, an empty and a missing text, and one without an id, which SQL leaves out."""
    texts = {3: "é" * 350 + "z" * 1_000, 4: "", 5: "é\u20ac" * 200_000, 6: "x", 7: "a" * 700, 8: "b" * 701, 9: None, None: "n" * 900}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return {i: t.encode() for i, t in texts.items() if t is not None and i is not None}


def above_parts(df):
    """What the plan does with parts, once they are cut, and what it does before."""
    return df._jdf.queryExecution().optimizedPlan().toString().split("Generate explode(sequence(0")


def test_damaged_texts_are_read_once(spark, tmp_path):
    texts = long_texts(spark, tmp_path)
    df = table_queries.checksum_parts_damaged(spark, str(tmp_path))
    above, below = above_parts(df)  # one cut only: the parts that come twice aren't cut again
    # nothing works on whole texts or single bytes above the cut
    assert above.count("Window [") == 1 and "text" not in above and "regexp" not in above and "text" in below
    want = {}
    for i, data in texts.items():
        n = max(1, -(-len(data) // 700)) - (i % 3 == 1) + (i % 3 == 2)
        if n:
            whole = i % 3 == 0 or not data
            want[i] = (n, whole, not whole)
    assert {r.doc_id: (r.parts, r.complete, r.none) for r in df.collect()} == want


def test_whole_texts_by_parts(spark, tmp_path):
    texts = long_texts(spark, tmp_path)
    df = table_queries.checksum_parts(spark, str(tmp_path))
    above, below = above_parts(df)
    assert "text" not in above and "regexp" not in above and "text" in below
    # a sum that asks for its column twice gets it worked out, and no lambda runs for each bit of a register
    sums = [line for line in above.splitlines() if "bit_xor(" in line]
    assert sums and all("bit_xor(__carried" in line and "lambda" not in line.split("bit_xor(")[1].split(") AS")[0] for line in sums)
    back = next(line for line in above.splitlines() if "__carried#" in line and "bit_xor" not in line)
    assert back.count("aggregate(") == 1
    assert {r.doc_id: (r.length, r.complete, r.crc, r.adler) for r in df.collect()} == {i: (len(d), True, zlib.crc32(d), zlib.adler32(d)) for i, d in texts.items()}


@pytest.mark.parametrize("bpp", [1, 2, 3])
def test_unfilter(spark, bpp):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for i, (w, h) in enumerate([(1, 1), (3, 5), (64, 3), (65, 6), (200, 4)]):
        above = np.zeros(w * bpp, np.uint8)
        for y in range(h):
            kind, line = int(rng.integers(0, 7)), rng.integers(0, 256, w * bpp).astype(np.uint8)
            rows.append((i, y, kind, line.tolist()))
            above = line if kind in (0, 5, 6) else png.unfilter(kind, line, above, bpp)
            want |= {(i, y, k): above[k::bpp].tolist() for k in range(bpp)}
    random.Random(2).shuffle(rows)
    table = filters.channels(spark.createDataFrame(rows, "img_id int, y int, kind int, f array<int>"), bpp)
    assert {(r.img_id, r.y, r.channel): r.v for r in filters.unfilter(table, ("img_id", "channel")).collect()} == want


def test_unfilter_nothing(spark):
    empty = spark.createDataFrame([(1, 0, 4, []), (1, 1, 3, [])], "img_id int, y int, kind int, f array<int>")
    assert sorted((r.y, r.v) for r in filters.unfilter(empty).collect()) == [(0, []), (1, [])]
    assert filters.unfilter(empty.where("false")).collect() == []


def test_interlacing(spark):
    sizes = {(w, h): np.arange(w * h).reshape(h, w) for w in range(1, 10) for h in range(1, 10)}
    px = spark.createDataFrame([(100 * w + h, int(y), int(x), int(v)) for (w, h), a in sizes.items() for (y, x), v in np.ndenumerate(a)], "img_id int, y int, x int, v int")
    made = interlace.interlace(px).persist()
    want = {(100 * w + h, p, r): line.tolist() for (w, h), a in sizes.items() for p, (y0, dy, x0, dx) in enumerate(png.ADAM7, 1) for r, line in enumerate(a[y0::dy, x0::dx]) if line.size}
    assert {(r.img_id, r["pass"], r.row): r["values"] for r in made.collect()} == want
    assert sorted(map(tuple, interlace.deinterlace(made).collect())) == sorted(map(tuple, px.collect()))
    assert "Exchange hashpartitioning" not in interlace.deinterlace(spark.createDataFrame(made.collect()))._jdf.queryExecution().executedPlan().toString()
    images = spark.createDataFrame([(100 * w + h, w, h) for w, h in sizes], "img_id int, w int, h int")
    for bits in (1, 4, 8, 24):
        places: dict = {}
        for r in interlace.raw_lines(images, bits).collect():
            places.setdefault(r.img_id, []).append((r.offset, r["pass"], r.row, r.length))
        for (w, h), a in sizes.items():
            at, told = 0, []
            for p, (y0, dy, x0, dx) in enumerate(png.ADAM7, 1):
                ph, pw = a[y0::dy, x0::dx].shape
                for row in range(ph if pw else 0):
                    told.append((at, p, row, -(-pw * bits // 8)))
                    at += -(-pw * bits // 8) + 1
            assert sorted(places[100 * w + h]) == told and at == png.raw_size(w, h, bits, 1)
    assert interlace.shapes(images).where("img_id = 101 AND ph = 0").count() == 6


@pytest.mark.parametrize("salts", [1, 3])
def test_palettes_of_each_image(spark, salts):
    cmap = {1: [(1, 2, 3), (4, 5, 6)], 2: [(9, 9, 9)], 3: []}
    palettes = spark.createDataFrame([(i, [dict(zip("rgb", c, strict=True)) for c in m]) for i, m in cmap.items()], "img_id int, cmap array<struct<r:smallint,g:smallint,b:smallint>>")
    rows = [(i, y, [y, 1, -1, 300]) for i in (1, 2, 3, 4) for y in range(4)] + [(1, 9, []), (None, 0, [0])]
    got = colour.look_up(spark.createDataFrame(rows, "img_id int, y int, values array<int>"), palettes, salts=salts)
    assert got.columns == ["img_id", "y", "values", "colours", "missing"]
    told = {(r.img_id, r.y): ([tuple(c) for c in r.colours], r.missing) for r in got.collect()}
    find = lambda i, v: cmap[i][v] if 0 <= v < len(cmap.get(i, ())) else (0, 0, 0)
    assert told == {(i, y): ([find(i, v) for v in vs], sum(not 0 <= v < len(cmap.get(i, ())) for v in vs)) for i, y, vs in rows}


def test_many_palettes(spark):
    """More palettes than a broadcast would take."""
    n = 2_000
    palettes = spark.range(n).select(F.col("id").alias("img_id"), F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.struct((i % 256).cast("short").alias("r"), ((i + F.col("id")) % 256).cast("short").alias("g"), F.lit(0).cast("short").alias("b"))).alias("cmap"))
    each = spark.range(n).select(F.col("id").alias("img_id"), F.lit(0).alias("y"), F.array((F.col("id") % 256).cast("int")).alias("values"))
    wrong = colour.look_up(each, palettes).where("colours[0].r <> img_id % 256 OR colours[0].g <> 2 * img_id % 256 OR missing <> 0")
    assert wrong.count() == 0
