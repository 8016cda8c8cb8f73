"""Strip-wise conversion, damaged files, chunk tables, balanced reading, two-phase sinks, files in parts."""

import os
import random
import struct
import subprocess
import sys
import zlib
from datetime import datetime
from pathlib import Path

import numpy as np
import pytest
from make import chunk, pbm, pgm
from make import png as make_png
from pyspark.sql import functions as F

from rasterloom import schemas
from rasterloom.operators import strips
from rasterloom.operators.binarize import Options, binarize
from rasterloom.operators.container import encode_image
from rasterloom.plans import file_queries
from rasterloom.plans.pipeline import convert_files
from rasterloom.sources import balanced, chunks, images, pnm, sinks
from rasterloom.sources.pnm import ImageError
from rasterloom.streaming import parts

ROOT = Path(__file__).resolve().parents[1]


def whole(data, o):
    """The page of a file that is decoded whole."""
    r = binarize(images.decode(data, o.compat), o)
    return encode_image(r.pixels, o.xres or r.xres, o.yres or r.yres, o.typical, o.full), r.w, r.h, r.xres, r.yres, sorted(set(r.warnings))


def outcome(make):
    try:
        return make()
    except ImageError as e:
        return e.code, str(e)


def samples():
    rng = np.random.default_rng(7)
    phys = chunk(b"pHYs", struct.pack(">IIB", 11811, 11811, 1))
    for w, h in ((1, 1), (9, 7), (40, 30), (33, 65)):
        gray = rng.integers(0, 256, (h, w, 1))
        for depth, colour, planes in ((8, 0, 1), (16, 0, 1), (1, 0, 1), (2, 0, 1), (4, 0, 1), (8, 2, 3), (16, 2, 3), (8, 6, 4), (8, 4, 2)):
            made = rng.integers(0, 1 << depth, (h, w, planes))
            made[h // 2 :] = made[h // 2 : h // 2 + 1]  # lines alike
            for idats in (1, 3):
                yield make_png(made, depth, colour, filters=(0, 1, 2, 3, 4), extra=phys, idats=idats)
            yield make_png(made, depth, colour, filters=(4, 2), interlace=True)
        for depth in (1, 2, 8):
            index = rng.integers(0, min(1 << depth, 4), (h, w, 1))
            yield make_png(index, depth, 3, palette=bytes(rng.integers(0, 256, 3 * min(1 << depth, 3)).tolist()))
            yield make_png(index, depth, 3, palette=b"\x00\x00\x00\xff\xff\xff")
        yield from (make_png(gray, 8, 0, filters=(7, 4), tail=b"left over"), make_png(gray, 8, 0)[:-30], make_png(gray, 8, 0) + b"x")
        yield make_png(gray, 8, 0).replace(b"IEND", b"IENX")
        damaged = bytearray(make_png(gray, 8, 0, idats=2))
        damaged[60] ^= 1
        yield bytes(damaged)
        yield make_png(gray, 8, 0, extra=chunk(b"tEXt", b"k\0v", bad_crc=True))
        yield pgm(gray[..., 0].astype(np.uint8))
        yield pgm(gray[..., 0].astype(np.uint8))[:-1]
        yield pbm((gray[..., 0] > 99).astype(np.uint8))
        yield b"P6 %d %d 255\n" % (w, h) + rng.integers(0, 256, 3 * w * h).astype(np.uint8).tobytes()
        yield b"P2\n# c\n%d %d 255\n" % (w, h) + b" ".join(b"%d" % v for v in gray.ravel())
        yield b"P5 %d %d 65535\n" % (w, h) + rng.integers(0, 256, 2 * w * h).astype(np.uint8).tobytes()


@pytest.mark.parametrize("strip", [1, 50, 1 << 18])
def test_strips_equal_whole_images(monkeypatch, strip):
    monkeypatch.setattr(strips, "STRIP", strip)
    for data in samples():
        for o in (Options(), Options(threshold=100, scale=2, typical=True, full=False), Options(scale=4, xres=99), Options(compat=True, typical=True)):

            def lines(data=data, o=o):
                images.readable(data)
                p = strips.encode_file(data, o)
                return p.code, p.w, p.h, p.xres, p.yres, sorted(set(p.warnings))

            assert outcome(lines) == outcome(lambda data=data, o=o: whole(data, o))


def test_memory_is_flat_in_the_height():
    """Peak memory beside the file and its code: ten times the height takes hardly more. The whole raster of the taller one alone would be 40 MB, upscaled 160 MB."""
    code = """
import resource, struct, sys, zlib
sys.path.insert(0, %r)
from rasterloom.operators import strips
from rasterloom.operators.binarize import Options
h = int(sys.argv[1])
z = zlib.compressobj(1); line = b"\\0" + b"\\xff" * 4000
body = b"".join([z.compress(line * 100) for _ in range(h // 100)] + [z.flush()])
c = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
data = b"\\x89PNG\\r\\n\\x1a\\n" + c(b"IHDR", struct.pack(">IIBBBBB", 4000, h, 8, 0, 0, 0, 0)) + c(b"IDAT", body) + c(b"IEND", b"")
page = strips.encode_file(data, Options(typical=True))
assert page.h == h
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
""" % str(ROOT)
    low, high = (int(subprocess.run([sys.executable, "-c", code, str(h)], capture_output=True, text=True, check=True).stdout) for h in (1_000, 10_000))
    assert high - low < 12


BAD = {
    "above": b"P2\n1 1\n255\n70000\n", "digits": b"P2\n1 1\n255\n" + b"9" * 5_000 + b"\n", "header": b"P5\n" + b"1" * 5_000 + b" 1\n255\n", "colour": b"P3\n1 1\n255\n1 2 300\n", "gray": b"P2\n1 1\n255\n300\n", "stray": b"P1\n2 1 \n1x    \n", "word": b"P2\n2 1\n15\n1 two\n",
}


def test_bad_files_are_rows(spark):
    rows = [(k, bytearray(v)) for k, v in BAD.items()] + [("good", bytearray(b"P2\n2 1\n255\n7 255\n")), ("bits", bytearray(b"P1\n2 2\n01 1 0\n")), ("none", None)]
    files = spark.createDataFrame(rows, "path string, content binary")
    for made in (images.decode_images(files), convert_files(files)):
        told = {r.img_id: r.error.code if r.error else None for r in made.collect()}
        assert told == dict.fromkeys(BAD, schemas.READ) | {"good": None, "bits": None, "none": schemas.MISSING}
    kept = pnm.decode(b"P2\n2 1\n255\n300 x\n", compat=True)
    assert kept.pixels.tolist() == [[44, 0]] and kept.warnings
    assert pnm.decode(b"P1\n3 1\n1x0\n", compat=True).pixels.tolist() == [[1, 0, 0]]


def test_chunk_table(spark):
    gray = np.zeros((3, 3, 1), int)
    good, bad = make_png(gray, 8, 0, idats=2, extra=chunk(b"tEXt", b"k\0v", bad_crc=True)), make_png(gray, 8, 0)[:-7]
    files = spark.createDataFrame([("a", bytearray(good)), ("b", bytearray(bad)), ("c", bytearray(b"P5 1 1 255\n ")), ("d", None), ("e", bytearray(good[:8]))], "path string, content binary")
    rows = sorted(map(tuple, chunks.chunk_table(files).collect()))
    assert [r[2:4] + r[5:] for r in rows if r[0] == "a"] == [("IHDR", 8, True, True), ("tEXt", 33, False, False), ("IDAT", 48, True, True), *[("IDAT", r[3], True, True) for r in rows if r[0] == "a" and r[1] == 3], ("IEND", len(good) - 12, True, True)]
    assert [(r[2], r[6]) for r in rows if r[0] == "b"] == [("IHDR", True), ("IDAT", True), ("IEND", None)][: len([r for r in rows if r[0] == "b"])] and not [r for r in rows if r[0] in "cde"]
    chunks.register(spark)
    files.createOrReplaceTempView("chunk_files")
    assert sorted(map(tuple, spark.sql("SELECT f.path, c.* FROM chunk_files f, LATERAL png_chunks(f.content) c").collect())) == rows
    assert chunks.chunk_table(files.where("false")).collect() == []


def test_balanced_reading(spark, tmp_path):
    rng = random.Random(2)
    want = {}
    for i in range(60):
        data = bytes([i]) * int(2 ** rng.uniform(8, 19))
        (tmp_path / f"d{i % 3}").mkdir(exist_ok=True)
        (tmp_path / f"d{i % 3}" / f"f{i}.bin").write_bytes(data)
        want[f"f{i}.bin"] = data
    read = balanced.read_balanced(spark, str(tmp_path), tasks=8)
    assert {os.path.basename(r.path): bytes(r.content) for r in read.collect()} == want and read.rdd.getNumPartitions() == 8
    held = [r.n for r in read.groupBy(F.spark_partition_id()).agg(F.sum("length").alias("n")).collect()]
    assert max(held) <= 1.3 * sum(held) / 8
    assert read.columns == images.read_files(spark, str(tmp_path)).columns
    assert balanced.read_balanced(spark, str(tmp_path), 4, glob="*.none").collect() == []
    assert {r.length for r in balanced.read_balanced(spark, str(tmp_path), 4, most_bytes=999).collect()} == {len(d) for d in want.values() if len(d) <= 999}
    assert balanced.deal([], 3) == [] and balanced.deal([5], 3) == [[0]] and sorted(map(sum, balanced.deal([5, 4, 3, 3], 2, 0))) == [3, 3]


def files_below(path):
    return sorted(str(p.relative_to(path)) for p in Path(path).rglob("*") if p.is_file() and not p.name.endswith(".crc"))


def pages(spark, names, fail_at=None):
    def code(name):
        if name == fail_at:
            raise RuntimeError("planted")
        return name.encode()

    make = F.udf(code, "binary")
    return spark.createDataFrame([(n,) for n in names], "img_id string").repartition(4).select("img_id", make("img_id").alias("code"))


def test_failed_job_publishes_nothing(spark, tmp_path):
    names = [f"/in/{k}/p{k}.png" for k in range(20)]
    with pytest.raises(Exception, match="planted"):
        sinks.write_pages(pages(spark, names, names[7]), str(tmp_path), root="/in")
    assert files_below(tmp_path) == [] and not (tmp_path / sinks.STAGING).exists()
    sinks.write_pages(pages(spark, names), str(tmp_path), root="/in")
    assert files_below(tmp_path) == sorted(f"{k}/p{k}.png.jb2" for k in range(20)) and not (tmp_path / sinks.STAGING).exists()
    assert (tmp_path / "3/p3.png.jb2").read_bytes() == b"/in/3/p3.png"
    with pytest.raises(Exception, match="one name"):
        sinks.write_pages(pages(spark, ["/in/a", "/in/a"]), str(tmp_path / "two"), root="/in")
    assert files_below(tmp_path / "two") == []


def test_attempts_that_failed_leave_nothing(tmp_path):
    writer = sinks._Writer({"path": str(tmp_path)})
    rows = [{"img_id": "a/b", "code": b"1"}, {"img_id": "c", "code": None}, {"img_id": "d", "code": b"22"}]
    writer.write(rows[:1])  # an attempt that is lost
    done = writer.write(rows)
    assert files_below(tmp_path / "a") == []
    writer.commit([done, None])
    assert files_below(tmp_path) == ["a/b.jb2", "d.jb2"] and done.size == 3


def test_batch_that_is_replayed(tmp_path):
    writer = sinks._StreamWriter({"path": str(tmp_path)})
    first = writer.write([{"img_id": "a", "code": b"1"}])
    writer.commit([first], 0)
    again = writer.write([{"img_id": "a", "code": b"2"}, {"img_id": "b", "code": b"2"}])
    writer.commit([again], 0)
    assert files_below(tmp_path) == [f"{sinks.MARKS}/0/0", "a.jb2"] and (tmp_path / "a.jb2").read_bytes() == b"1"
    lost = writer.write([{"img_id": "z", "code": b"1"}])
    writer.abort([lost], 1)
    assert "z.jb2" not in files_below(tmp_path) and not (tmp_path / sinks.STAGING).exists()


def test_stream_of_pages(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = lambda: convert_files(images.stream_files(spark, str(tmp_path / "in")))
    run = lambda: sinks.stream_pages(stream(), str(tmp_path / "out"), str(tmp_path / "state"), root=str(tmp_path / "in")).awaitTermination()
    (tmp_path / "in/a.pgm").write_bytes(pgm(np.zeros((3, 3), np.uint8)))
    (tmp_path / "in/bad.pgm").write_bytes(b"P5 3 3 255\n " + b"x" * 3)
    run()
    (tmp_path / "in/b.pgm").write_bytes(pgm(np.zeros((4, 3), np.uint8)))
    run()
    assert [f for f in files_below(tmp_path / "out") if not f.startswith("_")] == ["a.pgm.jb2", "b.pgm.jb2"]
    assert (tmp_path / "out/a.pgm.jb2").read_bytes() == whole(pgm(np.zeros((3, 3), np.uint8)), Options())[0]


def part_rows():
    rng = random.Random(5)
    files = {f"f{k}": bytes(rng.randrange(256) for _ in range(rng.randrange(1, 200))) for k in range(15)}
    rows = []
    for path, data in files.items():
        n = rng.randrange(1, 6)
        rows += [(path, k, n, bytearray(data[len(data) * k // n : len(data) * (k + 1) // n])) for k in range(n)]
    rows += rng.sample(rows, 20)
    rows += [("broken", 0, 3, bytearray(b"x")), ("broken", 2, 3, bytearray(b"z")), (None, 0, 1, bytearray(b"")), ("odd", 5, 2, bytearray(b"q")), ("null", 0, 1, None)]
    rng.shuffle(rows)
    return files, [(*r, datetime(2024, 1, 1, 0, 0, i % 50)) for i, r in enumerate(rows)]


def test_parts_of_a_stream(spark, tmp_path):
    """Parts in shuffled micro-batches give each file once, as the batch twin does; a broken file is an error once the stream went on for the time-out."""
    files, rows = part_rows()
    at = tmp_path / "parts"
    put = lambda part: spark.createDataFrame(part, parts.PARTS).coalesce(1).write.mode("append").parquet(str(at))
    for k in range(0, len(rows), 20):
        put(rows[k : k + 20])
    stream = spark.readStream.schema(parts.PARTS).option("maxFilesPerTrigger", 1).parquet(str(at))
    query = parts.assemble(stream, "2 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))

    def run():
        going = query.trigger(availableNow=True).start()
        try:
            assert going.awaitTermination(120)
        finally:
            going.stop()
        return spark.read.schema(parts.FILE).parquet(str(tmp_path / "out")).collect()

    told = run()
    assert sorted((r.path, bytes(r.content)) for r in told) == sorted(files.items())
    batch = {r.path: (None if r.content is None else bytes(r.content), r.error and r.error.msg) for r in parts.join_parts(spark.createDataFrame(rows, parts.PARTS)).collect()}
    assert batch == {k: (v, None) for k, v in files.items()} | {"broken": (None, "2 of 3 parts came")}
    again = [(*r[:4], datetime(2024, 1, 1, 0, 1, 30)) for r in rows if r[0] == "f0"]
    put([*again, ("new", 0, 1, bytearray(b"n"), datetime(2024, 1, 1, 0, 3))])  # copies come late, and the broken file has had its time
    told = run()
    assert [(r.path, r.error.code, r.error.msg) for r in told if r.error] == [("broken", schemas.READ, "2 of 3 parts came")]
    assert sorted(r.path for r in told if r.content is not None) == sorted([*files, "new"])


def test_stream_of_many_files_keeps_few_states(spark, tmp_path):
    """Files share calls and states of a few buckets; each is still given out once, and times out by itself."""
    first = [(f"f{i}", k, 2, bytearray(b"%d:%d" % (i, k)), datetime(2024, 1, 1, 0, 0, i % 50)) for i in range(300) for k in range(2) if i % 10 or not k]
    late = [("f0", 1, 2, bytearray(b"0:1"), datetime(2024, 1, 1, 0, 1, 30)), ("f1", 0, 2, bytearray(b"again"), datetime(2024, 1, 1, 0, 1, 30))]
    later = [("new", 0, 1, bytearray(b"n"), datetime(2024, 1, 1, 0, 3))]
    at = tmp_path / "parts"
    at.mkdir()
    stream = spark.readStream.schema(parts.PARTS).parquet(str(at))
    query = parts.assemble(stream, "2 minutes", buckets=3).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
    for put in (first, late, later):
        spark.createDataFrame(put, parts.PARTS).coalesce(1).write.mode("append").parquet(str(at))
        going = query.trigger(availableNow=True).start()
        assert going.awaitTermination(120)
        assert all(s.numRowsTotal <= 3 for p in going.recentProgress for s in p.stateOperators)
    told = spark.read.schema(parts.FILE).parquet(str(tmp_path / "out")).collect()
    whole = {f"f{i}": b"%d:0%d:1" % (i, i) for i in range(300) if i % 10 or not i} | {"new": b"n"}
    assert sorted((r.path, bytes(r.content)) for r in told if r.error is None) == sorted(whole.items())
    assert sorted((r.path, r.content, r.error.msg) for r in told if r.error) == sorted((f"f{i}", None, "1 of 2 parts came") for i in range(10, 300, 10))


def test_parts_are_cut_from_files_made_once(spark):
    plan = file_queries._file_parts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_crc_of_chunks_is_right():
    assert zlib.crc32(b"IEND") == struct.unpack(">I", make_png(np.zeros((1, 1, 1), int), 8, 0)[-4:])[0]
