"""Queries over files made from the embeddings: damaged ones, their chunks, all kinds of samples, whole conversion, arrival in parts."""

from __future__ import annotations

import struct
import tempfile
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import chunks, png
from ..sources.images import decode_images
from ..streaming import parts as parted
from .pipeline import Options, convert_files
from .queries import _CODE_SQL, _SEGMENTS, CUT, PX, _chunk, _coder_sql, _files, _gray, _png, _read


def _damaged(i: int, gray: np.ndarray) -> bytes:
    """A PNM file of eight kinds; whether it can be read hangs on the first two numbers."""
    v, u = int(gray[0, 0]), int(gray[0, 1])
    return (
        b"P5 8 8 255\n" + gray.tobytes()[: 64 if v % 2 else 40],
        b"P2\n# one\n1 1 255\n%d\n" % (v + 120),
        b"P3\n# two\n2 1 255\n1 2 3 %d %d %d\n" % (u, v, u + v),
        b"P1\n# bits\n2 1\n1%d\n" % (v % 4),
        b"P5 %s 1 255\n%c" % (b"9" * 5_000 if v % 3 == 0 else b"0" * 5_000 + b"1", v),
        b"P5\n# one\n1 1 %d\n%c" % (255 if v % 2 else 254, v),
        b"P2\n# two\n2 1 15\n3 %s\n" % (b"x" if v % 3 == 0 else b"%d" % (v % 16)),
        b"P4\n# bits\n9 1\n" + bytes([v, u])[: 1 + v % 2],
    )[i % 8]


def pnm_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Good and bad files: the error's code, or the size and the sum of the samples. No file fails the job."""
    read = decode_images(_files(spark, sf, _damaged))
    digits = F.regexp_extract_all(F.hex("data"), F.lit(".."), F.lit(0))
    total = F.aggregate(digits, F.lit(0).cast("long"), lambda s, x: s + F.conv(x, 16, 10).cast("long"))
    return read.select(F.col("img_id").cast("long").alias("img_id"), F.col("error.code").alias("code"), "w", "h", "d", total.alias("total"))


_FIRST = ", ".join(f"floor((embedding[{i}]::DOUBLE + 1.0) * 127.5)::INT AS {c}" for i, c in enumerate("vut", 1))
_ERRORS_SQL = f"""
    WITH {PX}, t AS (SELECT img_id, sum(v)::BIGINT AS total FROM px GROUP BY img_id), f AS (SELECT vec_id AS img_id, vec_id % 8 AS k, {_FIRST} FROM embeddings),
    g AS (SELECT f.*, total, [v % 2 = 1, v + 120 <= 255, u + v <= 255, v % 4 < 2, v % 3 <> 0, v % 2 = 1, v % 3 <> 0, v % 2 = 1][k + 1] AS good FROM f JOIN t USING (img_id))
    SELECT img_id, CASE WHEN NOT good THEN 3 END AS code, CASE WHEN good THEN [8, 1, 2, 2, 1, 1, 2, 9][k + 1] END AS w, CASE WHEN good THEN [8, 1, 1, 1, 1, 1, 1, 1][k + 1] END AS h, CASE WHEN good THEN [8, 8, 32, 1, 8, 8, 4, 1][k + 1] END AS d,
        CASE WHEN good THEN [total, v + 120, 6 + 2 * (u + v), 128 + 64 * (v % 4), v, v, 3 + v % 16, v + (u & 128)][k + 1] END::BIGINT AS total FROM g"""


def png_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The chunk table of files with image data in one to four chunks; a chunk's CRC is spoilt where the number says so."""

    def make(i: int, gray: np.ndarray) -> bytes:
        raw = zlib.compress(b"".join(b"\0" + line.tobytes() for line in gray), 0)
        n = i % 4 + 1
        size = -(-len(raw) // n)
        body = [(b"IHDR", struct.pack(">IIBBBBB", 8, 8, 8, 0, 0, 0, 0)), (b"tEXt", b"k\0" + b"t" * int(gray[0, 0]))]
        body += [(b"IDAT", raw[at : at + size]) for at in range(0, len(raw), size)] + [(b"IEND", b"")]
        made = [_chunk(*c) for c in body]
        if int(gray[0, 1]) % 3 == 0:
            k = int(gray[0, 2]) % len(made)
            made[k] = made[k][:-1] + bytes([made[k][-1] ^ 255])
        return png.SIGNATURE + b"".join(made)

    table = chunks.chunk_table(_files(spark, sf, make))
    return table.select(F.col("path").cast("long").alias("img_id"), "seq", "name", F.col("offset").alias("start"), "length", "critical", "crc_right")


# stored data take eleven bytes more than the 72 of eight lines and their filters
_CHUNKS_SQL = f"""
    WITH f AS (SELECT vec_id AS img_id, (vec_id % 4 + 1)::INT AS n, {_FIRST} FROM embeddings),
    s AS (SELECT *, (83 + n - 1) // n AS size, unnest(range(n + 3))::INT AS seq FROM f),
    c AS (SELECT *, CASE WHEN seq = 0 THEN 'IHDR' WHEN seq = 1 THEN 'tEXt' WHEN seq = n + 2 THEN 'IEND' ELSE 'IDAT' END AS name,
        (CASE WHEN seq = 0 THEN 13 WHEN seq = 1 THEN 2 + v WHEN seq = n + 2 THEN 0 ELSE least(size, 83 - (seq - 2) * size) END)::BIGINT AS length FROM s)
    SELECT img_id, seq, name, (8 + coalesce(sum(length + 12) OVER (PARTITION BY img_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start, length,
        name <> 'tEXt' AS critical, NOT (u % 3 = 0 AND t % (n + 3) = seq) AS crc_right FROM c"""


def _kinds(i: int, gray: np.ndarray) -> bytes:
    """A PNG of one of eight kinds: 1, 2, 4 and 16 bits of gray, colour of 8 and 16 bits, the former with alpha, gray with alpha."""
    depth, colour = ((1, 0), (2, 0), (4, 0), (16, 0), (8, 2), (16, 2), (8, 6), (8, 4))[i % 8]
    v = gray.astype(np.int64)
    planes = {0: [v], 2: [v, 255 - v, v ^ 85], 6: [v, 255 - v, v ^ 85, v // 2], 4: [v, v // 2]}[colour]
    samples = np.stack(planes, 2).reshape(8, -1)
    if depth == 16:
        lines = (samples * 256 + 7).astype(">u2").view(np.uint8).reshape(8, -1)
    elif depth == 8:
        lines = samples.astype(np.uint8)
    else:
        lines = np.packbits((samples >> (8 - depth))[..., None] >> np.arange(depth - 1, -1, -1) & 1, axis=1).reshape(8, -1) if depth == 1 else _packed(samples >> (8 - depth), depth)
    raw = b"".join(b"\0" + line.tobytes() for line in lines)
    head = struct.pack(">IIBBBBB", 8, 8, depth, colour, 0, 0, 0)
    return png.SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw)) + _chunk(b"IEND", b"")


def _packed(samples: np.ndarray, depth: int) -> np.ndarray:
    bits = samples[..., None] >> np.arange(depth - 1, -1, -1) & 1
    return np.packbits(bits.reshape(len(samples), -1).astype(np.uint8), axis=1)


def png_read_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels of files of all kinds: of colour all three channels in one number; bilevel ones have 1 for black."""
    read = decode_images(_files(spark, sf, _kinds)).select(F.col("img_id").cast("long").alias("img_id"), "d", F.hex("data").alias("h"))
    size = F.when(F.col("d") == 32, 6).otherwise(2)
    at = F.sequence(F.lit(0), F.lit(63))
    bit = lambda i: F.call_function("shiftright", F.conv(F.substr("h", F.floor(i / 8).cast("int") * 2 + 1, F.lit(2)), 16, 10).cast("int"), 7 - i % 8).bitwiseAND(F.lit(1)).cast("long")
    whole = lambda i: F.conv(F.substr("h", i * size + 1, size), 16, 10).cast("long")
    values = F.when(F.col("d") == 1, F.transform(at, bit)).otherwise(F.transform(at, whole))
    return read.select("img_id", "d", F.posexplode(values).alias("i", "v")).select("img_id", F.expr("cast(i div 8 as int)").alias("y"), (F.col("i") % 8).alias("x"), "d", "v")


_KINDS_SQL = f"""WITH {PX} SELECT img_id, y, x, (CASE img_id % 8 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 8 WHEN 7 THEN 8 ELSE 32 END)::INT AS d,
    (CASE img_id % 8 WHEN 0 THEN (v < 128)::INT WHEN 1 THEN v // 64 WHEN 2 THEN v // 16 WHEN 3 THEN v WHEN 7 THEN v ELSE v * 65536 + (255 - v) * 256 + xor(v, 85) END)::BIGINT AS v FROM px"""


def convert_png(spark: SparkSession, sf: str) -> DataFrame:
    """Whole files from PNG to pages, lines at a time."""
    pages = convert_files(_files(spark, sf, lambda i, gray: _png(gray, turn=i, alpha=i % 2 == 1)), Options(threshold=CUT, xres=300, yres=300))
    return pages.select(F.col("img_id").cast("long").alias("img_id"), F.octet_length("code").cast("long").alias("size"), F.lower(F.hex("code")).alias("code"))


def _file_parts(spark: SparkSession, sf: str) -> DataFrame:
    """PNM files in parts of 13 bytes; every third part comes twice."""
    files = _files(spark, sf, lambda i, gray: b"P5 8 8 255\n" + gray.tobytes())
    n = F.ceil(F.octet_length("content") / 13).cast("int")
    each = files.select("path", "content", n.alias("parts"), F.explode(F.sequence(F.lit(0), n - 1)).alias("seq"))
    # copies by an explode: a union would make the files once more
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("seq") % 3 == 0, 2).otherwise(1))).alias("copy")
    return each.select("path", "seq", "parts", F.substring("content", F.col("seq") * 13 + 1, F.lit(13)).alias("content"), copies).drop("copy")


def parts_joined(spark: SparkSession, sf: str) -> DataFrame:
    """The pixels of files that came in parts."""
    return _read(parted.join_parts(_file_parts(spark, sf)).select("path", "content"))


def _folder(spark: SparkSession) -> str:
    """A new folder where the session keeps checkpoints, or a temporary one in a local session without."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
    return f"{(base or 'file://' + tempfile.gettempdir()).rstrip('/')}/rasterloom-stream-{uuid.uuid4().hex}"


def parts_streamed(spark: SparkSession, sf: str) -> DataFrame:
    """The same as a stream of several micro-batches, written and read again: each file comes out once."""
    at = _folder(spark)
    # parts of a file lie in different files of the stream's input
    arrived = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq"))
    _file_parts(spark, sf).withColumn("arrived", arrived).repartition(6, F.xxhash64("path", "seq")).write.parquet(f"{at}/parts")
    stream = spark.readStream.schema(parted.PARTS).option("maxFilesPerTrigger", 2).parquet(f"{at}/parts")
    done = parted.assemble(stream).writeStream.format("parquet").option("path", f"{at}/files").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    done.awaitTermination()
    return _read(spark.read.schema(parted.FILE).parquet(f"{at}/files").select("path", "content"))


QUERIES = {f.__name__: f for f in (pnm_errors, png_chunks, png_read_kinds, convert_png, parts_joined, parts_streamed)}

ORACLE_SQL = {
    "pnm_errors": _ERRORS_SQL,
    "png_chunks": _CHUNKS_SQL,
    "png_read_kinds": _KINDS_SQL,
    "convert_png": f"{_coder_sql(False)} {_CODE_SQL} (SELECT img_id, '974a42320d0a1a0a0100000001' || {_SEGMENTS} || '0000000231000100000000' || '0000000333000100000000' AS code FROM e)",
    "parts_joined": f"WITH {PX} SELECT * FROM px",
    "parts_streamed": f"WITH {PX} SELECT * FROM px",
}
