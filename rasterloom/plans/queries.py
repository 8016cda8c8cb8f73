"""Queries over the driver's tables, each with its SQL twin.

The tables hold no images, so the 64 numbers of an embedding are read as an 8 x 8 gray
image; other numeric columns stand for colours, samples and sizes.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checksums, colour, metadata
from ..functions import parts as parts_of
from ..operators import coder, container, kernels, pixels
from ..sources import png
from ..sources.images import decode_images
from ..sources.sniff import sniff
from .pipeline import Options, binarize_images

CUT = 128


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gray_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixel table of the embeddings."""
    each = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img_id"), F.posexplode("embedding").alias("pos", "e"))
    return each.select("img_id", F.expr("cast(pos div 8 as int)").alias("y"), (F.col("pos") % 8).alias("x"), F.floor((F.col("e").cast("double") + 1.0) * 127.5).alias("v"))


def bit_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.threshold(gray_pixels(spark, sf_dir), CUT)


PX = """px AS (SELECT vec_id AS img_id, (i // 8)::INT AS y, (i % 8)::INT AS x, floor((embedding[i + 1]::DOUBLE + 1.0) * 127.5)::BIGINT AS v
         FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings))"""
BITS = f"{PX}, b AS (SELECT img_id, y, x, (v < {CUT})::INT AS bit FROM px)"


def _scaled_sql(factor: int, cut: bool) -> str:
    s = factor
    value = f"((({s} - i) * ({s} - j) * v + ({s} - i) * j * r + i * ({s} - j) * b + i * j * c) // {s * s})::BIGINT"
    return f"""
    WITH {PX}, h AS (SELECT *, coalesce(lead(v) OVER (PARTITION BY img_id, y ORDER BY x), v) AS r FROM px),
    q AS (SELECT *, coalesce(lead(v) OVER (PARTITION BY img_id, x ORDER BY y), v) AS b, coalesce(lead(r) OVER (PARTITION BY img_id, x ORDER BY y), r) AS c FROM h),
    o AS (SELECT q.*, i.range AS i, j.range AS j FROM q, range({s}) i, range({s}) j)
    SELECT img_id, (y * {s} + i)::INT AS y, (x * {s} + j)::INT AS x, {f"({value} < {CUT})::INT AS bit" if cut else f"{value} AS v"} FROM o"""


_LINES_SQL = f"{BITS}, l AS (SELECT img_id, y, sum(bit * (1 << (7 - x)))::BIGINT AS byte FROM b GROUP BY ALL)"
_TYPICAL_SQL = f"""{_LINES_SQL}, s AS (SELECT img_id, y, coalesce((byte = lag(byte) OVER w)::INT, 0) AS same FROM l WINDOW w AS (PARTITION BY img_id ORDER BY y)),
    t AS (SELECT img_id, y, same, xor(same, coalesce(lag(same) OVER w, 0)) AS change FROM s WINDOW w AS (PARTITION BY img_id ORDER BY y))"""


def _context_sql() -> str:
    at = lambda dy, dx: f"coalesce(n{-dy}.bit{f'_{dx}' if dx else ''}, 0)".replace("_-", "_m")
    shifts = [k for k in range(-4, 5) if k]
    moved = ", ".join(f"{'lead' if k > 0 else 'lag'}(bit, {abs(k)}) OVER w AS bit_{k}".replace("_-", "_m") for k in shifts)
    terms = " + ".join(f"{at(dy, dx)} * {1 << 15 - i}" for i, (dy, dx) in enumerate(kernels.NEIGHBOURS))
    return f"""{BITS}, m AS (SELECT img_id, y, x, bit, {moved} FROM b WINDOW w AS (PARTITION BY img_id, y ORDER BY x)),
    k AS (SELECT n0.img_id, n0.y, n0.x, ({terms})::INT AS ctx, n0.bit FROM m n0
          LEFT JOIN m n1 ON n1.img_id = n0.img_id AND n1.x = n0.x AND n1.y = n0.y - 1 LEFT JOIN m n2 ON n2.img_id = n0.img_id AND n2.x = n0.x AND n2.y = n0.y - 2)"""


# a palette for the demonstration: index i is (i * 7, i * 5 + 3, i * 11) modulo 256
PALETTE_ROWS = 64


def _palette(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    return spark.range(PALETTE_ROWS).select(i.cast("int").alias("idx"), (i * 7 % 256).cast("int").alias("r"), ((i * 5 + 3) % 256).cast("int").alias("g"), (i * 11 % 256).cast("int").alias("b"))


_PALETTE_SQL = f"pal AS (SELECT range::INT AS idx, (range * 7 % 256)::INT AS r, ((range * 5 + 3) % 256)::INT AS g, (range * 11 % 256)::INT AS b FROM range({PALETTE_ROWS}))"


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels as palette indices; some are beyond the palette."""
    return gray_pixels(spark, sf_dir).withColumn("v", (F.col("v") % 80).cast("int"))


_INDEXED_SQL = f"{PX}, {_PALETTE_SQL}, ix AS (SELECT img_id, y, x, (v % 80)::INT AS v FROM px), lk AS (SELECT ix.*, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b FROM ix LEFT JOIN pal ON v = idx)"


def _colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours from the digits of line items."""
    k = F.col("l_orderkey")
    rgb = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (k % 256).alias("r"), (F.col("l_partkey") % 256).alias("g"), (F.col("l_suppkey") % 256).alias("b"))
    return rgb


_COLOURS_SQL = "rgb AS (SELECT l_orderkey, l_linenumber, l_orderkey % 256 AS r, l_partkey % 256 AS g, l_suppkey % 256 AS b FROM lineitem)"


def threshold(spark, sf):
    return bit_pixels(spark, sf)


def invert(spark, sf):
    return pixels.invert(bit_pixels(spark, sf))


def invert_box(spark, sf):
    return pixels.invert_box(bit_pixels(spark, sf), 2, 3, 4, 20)


def set_pixel(spark, sf):
    return pixels.set_pixel(gray_pixels(spark, sf), 3, 5, 300, 8)


def pack_rows(spark, sf):
    return pixels.pack_bytes(bit_pixels(spark, sf)).select("img_id", "y", "byte")


def pack_words(spark, sf):
    return pixels.pack_words(bit_pixels(spark, sf)).select("img_id", "y", "word")


def tpgd(spark, sf):
    return pixels.typical(bit_pixels(spark, sf))


def contexts(spark, sf):
    return pixels.contexts(bit_pixels(spark, sf))


def context_histogram(spark, sf):
    return pixels.context_histogram(bit_pixels(spark, sf))


def context_histogram_tpgd(spark, sf):
    return pixels.context_histogram(bit_pixels(spark, sf), with_typical=True)


def scale2x(spark, sf):
    return pixels.upscale(gray_pixels(spark, sf), 2)


def scale2x_threshold(spark, sf):
    return pixels.threshold(pixels.upscale(gray_pixels(spark, sf), 2), CUT)


def scale4x(spark, sf):
    return pixels.upscale(gray_pixels(spark, sf), 4)


def scale4x_threshold(spark, sf):
    return pixels.threshold(pixels.upscale(gray_pixels(spark, sf), 4), CUT)


def palette_lookup(spark, sf):
    return colour.palette_join(_indexed(spark, sf), _palette(spark))


def palette_gray(spark, sf):
    return palette_lookup(spark, sf).select("img_id", "y", "x", colour.weighted_gray(F.col("r"), F.col("g"), F.col("b")).alias("gray"))


def palette_has_color(spark, sf):
    entries = F.array_sort(F.collect_set(F.struct("r", "g", "b")))
    return palette_lookup(spark, sf).groupBy("img_id").agg(entries.alias("cmap")).select("img_id", colour.has_colour(F.col("cmap")).alias("has_colour"))


def rgb_compose(spark, sf):
    return _colours(spark, sf).select("l_orderkey", "l_linenumber", colour.compose(F.col("r"), F.col("g"), F.col("b")).alias("pixel"))


def green_channel(spark, sf):
    return rgb_compose(spark, sf).select("l_orderkey", "l_linenumber", colour.fast_gray(F.col("pixel")).alias("gray"))


def weighted_gray(spark, sf):
    return _colours(spark, sf).select("l_orderkey", "l_linenumber", colour.weighted_gray(F.col("r"), F.col("g"), F.col("b")).alias("gray"))


def strip16(spark, sf):
    return _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", colour.strip_16((F.col("l_partkey") * 31 % 65536).cast("int")).alias("sample"))


def strip_alpha(spark, sf):
    """Files of gray with an alpha that is theirs alone: reading leaves the gray."""
    return _read(_files(spark, sf, lambda i, gray: _png(gray, alpha=True)))


def png_filter_sub(spark, sf):
    return pixels.filter_sub(gray_pixels(spark, sf))


def png_filter_up(spark, sf):
    return pixels.filter_up(gray_pixels(spark, sf))


def png_filter_average(spark, sf):
    return pixels.filter_average(gray_pixels(spark, sf))


def png_filter_paeth(spark, sf):
    return pixels.filter_paeth(gray_pixels(spark, sf))


def png_unfilter_sub(spark, sf):
    return pixels.unfilter_sub(png_filter_sub(spark, sf).drop("v"))


def png_unfilter_up(spark, sf):
    return pixels.unfilter_up(png_filter_up(spark, sf).drop("v"))


def adam7_pass(spark, sf):
    return gray_pixels(spark, sf).select("img_id", "y", "x", pixels.adam7_pass(F.col("x"), F.col("y")).alias("pass"))


def ppm_to_ppi(spark, sf):
    return _table(spark, sf, "part").select("p_partkey", metadata.to_ppi(F.col("p_partkey") * 7 + F.col("p_size")).alias("ppi"))


def resolution_scale(spark, sf):
    x, y = metadata.scale_resolution(F.col("p_size"), F.col("p_size") % 5, 2.0, 4.0)
    return _table(spark, sf, "part").select("p_partkey", x.alias("xres"), y.alias("yres"))


def pad_mask(spark, sf):
    return _table(spark, sf, "part").select("p_partkey", pixels.pad_mask(F.col("p_size"), F.lit(1)).alias("mask"), metadata.words_per_line(F.col("p_size"), F.lit(8)).alias("wpl"))


def format_sniff(spark, sf):
    docs = _table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("document").alias("kind"), F.encode("text", "utf-8").alias("content"))
    made = docs.select("id", F.lit("made").alias("kind"), F.concat(F.element_at(F.array(*[F.unhex(F.lit(m)) for m in _MADE]), (F.col("id") % len(_MADE) + 1).cast("int")), F.col("content")).alias("content"))
    return docs.unionByName(made).select("id", "kind", sniff(F.col("content")).alias("format"))


_MADE = ("424D", "49492A00", "4D4D002A", "50340A", "FFD8FF", "89504E470D0A1A0A", "474946383961", "73706978", "00")


def adler32(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", checksums.adler32(F.encode("text", "utf-8")).alias("adler"))


def adler32_combine(spark, sf):
    data = F.encode("text", "utf-8")
    half = F.floor(F.octet_length(data) / 2).cast("int")
    parts = _table(spark, sf, "documents").select("doc_id", F.substring(data, F.lit(1), half).alias("one"), F.substring(data, half + 1, F.octet_length(data)).alias("two"))
    return parts.select("doc_id", checksums.adler32_combine(checksums.adler32(F.col("one")), checksums.adler32(F.col("two")), F.octet_length("two").cast("long")).alias("adler"))


def crc32(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", checksums.crc32(F.encode("text", "utf-8")).alias("crc"))


def crc32_combine(spark, sf):
    data = F.encode("text", "utf-8")
    half = F.floor(F.octet_length(data) / 3).cast("int")
    parts = _table(spark, sf, "documents").select("doc_id", F.substring(data, F.lit(1), half).alias("one"), F.substring(data, half + 1, F.octet_length(data)).alias("two"))
    return parts.select("doc_id", parts_of.crc32_combine(F.crc32("one"), F.crc32("two"), F.octet_length("two")).alias("crc"))


def _chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def _palette_png(i: int, gray: np.ndarray) -> bytes:
    """A bilevel PNG with a palette: black and white for even numbers, white and black for odd ones."""
    black = kernels.threshold(gray, CUT)
    index, palette = (1 - black, b"\0\0\0\xff\xff\xff") if i % 2 == 0 else (black, b"\xff\xff\xff\0\0\0")
    lines = b"".join(b"\0" + kernels.pack(line[None]) for line in index)
    head = struct.pack(">IIBBBBB", gray.shape[1], gray.shape[0], 1, 3, 0, 0, 0)
    return png.SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"PLTE", palette) + _chunk(b"IDAT", zlib.compress(lines)) + _chunk(b"IEND", b"")


def _png(gray: np.ndarray, turn: int = 0, interlace: bool = False, alpha: bool = False) -> bytes:
    """A PNG file of a gray image, its lines filtered by all five kinds in turn."""
    lines = bytearray()
    for y0, dy, x0, dx in png.ADAM7 if interlace else [(0, 1, 0, 1)]:
        part = gray[y0::dy, x0::dx].astype(np.int32)
        if alpha:
            part = np.stack([part, 255 - part], 2).reshape(len(part), -1)
        step = 2 if alpha else 1
        pad = np.pad(part, ((1, 0), (step, 0)))
        left, above, corner = pad[1:, :-step], pad[:-1, step:], pad[:-1, :-step]
        far = [np.abs(left + above - corner - x) for x in (left, above, corner)]
        paeth = np.choose(np.argmin(far, 0), [left, above, corner])
        guesses = (0 * part, left, above, (left + above) // 2, paeth)
        for y in range(len(part)):
            kind = (y + turn) % 5
            lines += bytes([kind]) + ((part - guesses[kind])[y] % 256).astype(np.uint8).tobytes()
    head = struct.pack(">IIBBBBB", gray.shape[1], gray.shape[0], 8, 4 if alpha else 0, 0, 0, int(interlace))
    return png.SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(bytes(lines))) + _chunk(b"IEND", b"")


def _gray(embedding: list[float]) -> np.ndarray:
    return np.floor((np.array(embedding, np.float64) + 1) * 127.5).astype(np.uint8).reshape(8, 8)


def _files(spark, sf, make) -> DataFrame:
    """A file (path, content) for each embedding."""

    def run(batches):
        for batch in batches:
            made = [make(i, _gray(e)) for i, e in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").cast(pa.string()), pa.array(made, pa.binary())], names=["path", "content"])

    return _table(spark, sf, "embeddings").select("vec_id", "embedding").mapInArrow(run, "path string, content binary")


def _read(files: DataFrame) -> DataFrame:
    """The pixel table of decoded gray files."""
    byte = lambda i: F.conv(F.hex(F.substring("data", i + 1, F.lit(1))), 16, 10).cast("long")
    each = decode_images(files).select(F.col("img_id").cast("long").alias("img_id"), "w", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("w") * F.col("h") - 1), byte)).alias("i", "v"))
    return each.select("img_id", F.expr("cast(i div w as int)").alias("y"), (F.col("i") % F.col("w")).alias("x"), "v")


def png_read(spark, sf):
    return _read(_files(spark, sf, lambda i, gray: _png(gray, turn=i)))


def png_read_adam7(spark, sf):
    return _read(_files(spark, sf, lambda i, gray: _png(gray, turn=i, interlace=True)))


def pnm_read(spark, sf):
    return _read(_files(spark, sf, lambda i, gray: b"P5\n# %d\n8 8\n255\n" % i + gray.tobytes()))


def pnm_read_ascii(spark, sf):
    return _read(_files(spark, sf, lambda i, gray: b"P2\n8 8\n255\n" + b"\n".join(b" ".join(b"%d" % v for v in line) for line in gray.tolist())))


def pnm_read_bits(spark, sf):
    """Bytes of the lines of bilevel files."""
    return _line_bytes(decode_images(_files(spark, sf, lambda i, gray: b"P4\n8 8\n" + kernels.pack(kernels.threshold(gray, CUT)))), "byte")


def _line_bytes(images: DataFrame, name: str) -> DataFrame:
    byte = lambda y: F.conv(F.hex(F.substring("data", y + 1, F.lit(1))), 16, 10).cast("long")
    return images.select(F.col("img_id").cast("long").alias("img_id"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), byte)).alias("y", name))


def palette_bits(spark, sf):
    """Black is 1 whatever the palette's order; the historical reading isn't, where black comes first."""
    files = _files(spark, sf, _palette_png)
    told = [_line_bytes(binarize_images(decode_images(files, compat), Options(compat=compat)), name) for compat, name in ((False, "byte"), (True, "compat"))]
    return told[0].join(told[1], ["img_id", "y"])


def _palette_of(gray: np.ndarray) -> bytes:
    """A PNG of one pixel whose palette, of one to four entries, is made of the image's first numbers."""
    v = gray.ravel()
    head = struct.pack(">IIBBBBB", 1, 1, 2, 3, 0, 0, 0)
    return png.SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"PLTE", v[: 3 * (int(v[12]) % 4 + 1)].tobytes()) + _chunk(b"IDAT", zlib.compress(b"\0\0")) + _chunk(b"IEND", b"")


def palette_entries(spark, sf):
    """Size, second entry, first channel and growth of the palettes that files carry."""
    cmap = F.col("cmap")
    grown = colour.add(colour.add(cmap, 1, 2, 3, 2), 4, 5, 6, 2)
    return decode_images(_files(spark, sf, lambda i, gray: _palette_of(gray))).select(
        F.col("img_id").cast("long").alias("img_id"), colour.size(cmap).alias("size"), colour.entry(cmap, F.lit(1))["g"].cast("int").alias("second"), colour.entry(cmap, F.lit(2)).isNull().alias("third_absent"),
        F.array_join(colour.channels(cmap)[0].cast("array<string>"), ",").alias("reds"), colour.size(colour.add(grown, 7, 8, 9, 2)).alias("grown"),
    )


def same_size(spark, sf):
    """A PNG and a PNM of each embedding, the latter a line short where the first number is odd."""
    one = decode_images(_files(spark, sf, lambda i, gray: _png(gray)))
    other = decode_images(_files(spark, sf, lambda i, gray: b"P5 8 %d 255\n" % (8 - gray[0, 0] % 2) + gray[: 8 - gray[0, 0] % 2].tobytes()))
    return pixels.same_size(one, other).select(F.col("img_id").cast("long").alias("img_id"), "equal")


def container_layout(spark, sf):
    """The segments of a file around bytes that stand for the code."""

    def run(batches):
        for batch in batches:
            out = [container.wrap(8, 8, 300, 300, kernels.pack(kernels.threshold(_gray(e), CUT)), False, True).hex() for e in batch.column("embedding").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out)], names=["img_id", "file"])

    return _table(spark, sf, "embeddings").select("vec_id", "embedding").mapInArrow(run, "img_id bigint, file string")


def set_pad_bits(spark, sf):
    ls = pixels.set_pad_bits(pixels.lines(bit_pixels(spark, sf)), F.lit(8), F.lit(1), 1)
    return ls.select("img_id", "y", F.element_at("words", 1).alias("word"))


def path_name(spark, sf):
    return _table(spark, sf, "part").select("p_partkey", metadata.path_name(F.concat("p_type", F.when(F.col("p_partkey") % 2 == 0, "/").otherwise("")), F.col("p_name")).alias("path"))


def rfc1123(spark, sf):
    return _table(spark, sf, "orders").select("o_orderkey", metadata.rfc1123(F.col("o_orderdate")).alias("date"))


def _pages(spark, sf, typical: bool, full: bool) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = []
            for e in batch.column("embedding").to_pylist():
                bits = kernels.threshold(_gray(e), CUT)
                out.append(container.encode_image(bits, 300, 300, typical, full) if full is not None else coder.encode_bilevel(bits, typical))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([len(x) for x in out], pa.int64()), pa.array([x.hex() for x in out])], names=["img_id", "size", "code"])

    return _table(spark, sf, "embeddings").select("vec_id", "embedding").mapInArrow(run, "img_id bigint, size bigint, code string")


def encode_bilevel(spark, sf):
    return _pages(spark, sf, False, None)


def encode_bilevel_tpgd(spark, sf):
    return _pages(spark, sf, True, None)


def container_bytes(spark, sf):
    return _pages(spark, sf, False, True)


def container_fragment(spark, sf):
    return _pages(spark, sf, False, False)


QUERIES = {
    f.__name__: f
    for f in (
        threshold, invert, invert_box, set_pixel, pack_rows, pack_words, tpgd, contexts, context_histogram, context_histogram_tpgd, scale2x, scale2x_threshold, scale4x, scale4x_threshold,
        palette_lookup, palette_gray, palette_has_color, rgb_compose, green_channel, weighted_gray, strip16, strip_alpha, png_filter_sub, png_filter_up, png_filter_average, png_filter_paeth,
        png_unfilter_sub, png_unfilter_up, adam7_pass, ppm_to_ppi, resolution_scale, pad_mask, format_sniff, adler32, adler32_combine, crc32, crc32_combine, png_read, png_read_adam7, pnm_read, pnm_read_ascii, pnm_read_bits, palette_bits, palette_entries, same_size, container_layout, set_pad_bits, path_name, rfc1123, encode_bilevel, encode_bilevel_tpgd, container_bytes, container_fragment,
    )
}

_SUB, _UP = "coalesce(lag(v) OVER (PARTITION BY img_id, y ORDER BY x), 0)", "coalesce(lag(v) OVER (PARTITION BY img_id, x ORDER BY y), 0)"
_ADLER_SQL = """
    WITH d AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS l FROM documents),
    e AS (SELECT doc_id, len(l) AS n, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS i FROM d),
    s AS (SELECT doc_id, sum(('0x' || x)::BIGINT) AS a, sum((n - i) * ('0x' || x)::BIGINT) AS b FROM e GROUP BY doc_id)
    SELECT d.doc_id, (((len(l) + coalesce(s.b, 0)) % 65521) * 65536 + (1 + coalesce(s.a, 0)) % 65521)::BIGINT AS adler FROM d LEFT JOIN s USING (doc_id)"""


def _coder_sql(typical: bool) -> str:
    """The arithmetic coder as a recursion, one row an image and step: move pending bits out, code a symbol, or end."""
    qe, likely, unlikely = (str([f(m, n, s, bit) if f else q for q, m, n, s in coder.STATES for bit in (0, 1)]) for f in (None, lambda m, n, s, bit: 2 * m + bit, lambda m, n, s, bit: 2 * n + (bit ^ s)))
    plain = "SELECT img_id, y, x, ctx, bit FROM k"
    symbols = f"{plain} SEMI JOIN (SELECT * FROM t WHERE same = 0) z USING (img_id, y) UNION ALL SELECT img_id, y, -1, {coder.TYPICAL}, change FROM t" if typical else plain
    lines = f", {_TYPICAL_SQL.removeprefix(BITS + ', ')}" if typical else ""
    return f"""WITH RECURSIVE {_context_sql()}{lines},
    us AS (SELECT *, dense_rank() OVER (PARTITION BY img_id ORDER BY ctx) AS r FROM ({symbols})),
    sq AS (SELECT img_id, list(r ORDER BY y, x) AS rs, list(bit ORDER BY y, x) AS bs, max(r) AS m, count(*) AS n FROM us GROUP BY img_id),
    g AS (SELECT img_id, 0::BIGINT AS i, 32768::BIGINT AS a, 0::BIGINT AS c, 12::BIGINT AS ct, 0::BIGINT AS pend, -1::BIGINT AS last, '' AS code, list_transform(range(m), lambda z: 0::BIGINT) AS st, 0 AS ph FROM sq
    UNION ALL SELECT img_id,
        CASE WHEN sym THEN i + 1 ELSE i END, CASE WHEN sym THEN a2 << p2 ELSE a END,
        CASE WHEN sym THEN c2 WHEN move AND ct1 = 0 THEN c3 & ((1::BIGINT << sh) - 1) WHEN move THEN c1 WHEN fin THEN cf ELSE c END,
        CASE WHEN move AND ct1 = 0 THEN 27 - sh WHEN move THEN ct1 ELSE ct END,
        CASE WHEN sym THEN p2 WHEN move THEN pend - k WHEN ph < 2 THEN ct ELSE 0 END,
        CASE WHEN move AND ct1 = 0 THEN (c3 >> sh) & 255 ELSE last END, CASE WHEN move AND ct1 = 0 AND last >= 0 THEN code || lpad(lower(hex(l1)), 2, '0') ELSE code END,
        CASE WHEN sym THEN list_transform(st, lambda v, j: CASE WHEN j = r THEN s2 ELSE v END) ELSE st END,
        CASE WHEN sym OR move THEN ph ELSE ph + 1 END
    FROM (SELECT *, CASE WHEN l1 = 255 THEN 20 ELSE 19 END AS sh, CASE WHEN a2 >= 32768 THEN 0 ELSE (15 - floor(log2(greatest(a2, 1))))::BIGINT END AS p2
    FROM (SELECT *, last + carry AS l1, CASE WHEN carry = 1 THEN c1 & 134217727 ELSE c1 END AS c3,
        CASE WHEN hit AND a1 >= 32768 THEN s0 WHEN hit THEN {likely}[s0 + 1] ELSE {unlikely}[s0 + 1] END AS s2,
        CASE WHEN hit AND a1 >= 32768 THEN a1 WHEN hit = (a1 < qe) THEN qe ELSE a1 END AS a2,
        CASE WHEN hit AND a1 >= 32768 OR hit <> (a1 < qe) THEN c ELSE c END + CASE WHEN hit AND a1 >= 32768 OR hit <> (a1 < qe) THEN qe ELSE 0 END AS c2
    FROM (SELECT *, a - qe AS a1, CASE WHEN last >= 0 AND last <> 255 AND (c1 >> 27) > 0 THEN 1 ELSE 0 END AS carry, CASE WHEN (c | 65535) >= c + a THEN (c | 65535) - 32768 ELSE c | 65535 END AS cf
    FROM (SELECT *, {qe}[s0 + 1] AS qe, b = s0 % 2 AS hit, CASE WHEN move THEN c << k ELSE c END AS c1, ct - k AS ct1
    FROM (SELECT g.*, pend > 0 AS move, least(pend, ct) AS k, pend = 0 AND i < n AS sym, pend = 0 AND i = n AND ph = 0 AS fin, coalesce(rs[i + 1], 1) AS r, coalesce(st[rs[i + 1]], 0) AS s0, coalesce(bs[i + 1], 0) AS b FROM g JOIN sq USING (img_id) WHERE ph < 3))))))
    , e AS (SELECT img_id, code || lpad(lower(hex(last)), 2, '0') || CASE WHEN last = 255 THEN 'ac' ELSE 'ffac' END AS code FROM g WHERE ph = 3)"""


_CODE_SQL = "SELECT img_id, (length(code) // 2)::BIGINT AS size, code FROM"
_SEGMENTS = "'00000000300001000000130000000800000008' || '0000012c0000012c010000' || '00000001260001' || lpad(lower(hex(26 + length(code) // 2)), 8, '0') || '000000080000000800000000000000000000' || '03fffdff02fefefe' || code"
# the table from its rule: eight steps of one bit for each byte
_CRC_SQL = """
    WITH t AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)),
    d AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT) AS l FROM documents)
    SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, l), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM d, t"""
# signature, flags, page count; page information; generic region; end of page, end of file
_LAYOUT_SQL = f"""WITH {_LINES_SQL}, c AS (SELECT img_id, string_agg(lpad(lower(hex(byte)), 2, '0'), '' ORDER BY y) AS code FROM l GROUP BY img_id)
    SELECT img_id, '974a42320d0a1a0a0100000001' || '0000000030000100000013' || '00000008000000080000012c0000012c010000' || '0000000126000100000022' || '000000080000000800000000000000000000' || '03fffdff02fefefe' || code
        || '0000000231000100000000' || '0000000333000100000000' AS file FROM c"""
_SNIFF_SQL = """
    CASE WHEN n < 12 THEN NULL WHEN h[1:4] = '424D' THEN 'bmp' WHEN h[1:4] IN ('4949', '4D4D') THEN 'tiff' WHEN h[1:4] IN ('5031', '5032', '5033', '5034', '5035', '5036') THEN 'pnm'
    WHEN h[1:4] = 'FFD8' THEN 'jpeg' WHEN h[1:16] = '89504E470D0A1A0A' THEN 'png' WHEN h[1:12] IN ('474946383761', '474946383961') THEN 'gif'
    WHEN h[1:24] = '0000000C6A5020200D0A870A' THEN 'jp2' WHEN h[1:8] = '52494646' AND h[17:24] = '57454250' THEN 'webp' WHEN h[1:8] = '73706978' THEN 'spix' END"""
_MADE_SQL = ", ".join(f"'{m}'" for m in _MADE)

ORACLE_SQL = {
    "threshold": f"WITH {BITS} SELECT * FROM b",
    "invert": f"WITH {BITS} SELECT img_id, y, x, 1 - bit AS bit FROM b",
    "invert_box": f"WITH {BITS} SELECT img_id, y, x, CASE WHEN x BETWEEN 2 AND 5 AND y BETWEEN 3 AND 22 THEN 1 - bit ELSE bit END AS bit FROM b",
    "set_pixel": f"WITH {PX} SELECT img_id, y, x, CASE WHEN x = 3 AND y = 5 THEN 44 ELSE v END AS v FROM px",
    "pack_rows": f"WITH {_LINES_SQL} SELECT * FROM l",
    "pack_words": f"WITH {BITS} SELECT img_id, y, sum(bit::BIGINT * (1::BIGINT << (31 - x)))::BIGINT AS word FROM b GROUP BY ALL",
    "tpgd": f"WITH {_TYPICAL_SQL} SELECT * FROM t",
    "contexts": f"WITH {_context_sql()} SELECT * FROM k",
    "context_histogram": f"WITH {_context_sql()} SELECT ctx, bit, count(*) AS n FROM k GROUP BY ALL",
    "context_histogram_tpgd": f"WITH {_context_sql()}, {_TYPICAL_SQL.removeprefix(BITS + ', ')}, u AS (SELECT ctx, bit FROM k SEMI JOIN (SELECT * FROM t WHERE same = 0) z USING (img_id, y) UNION ALL SELECT {coder.TYPICAL} AS ctx, change AS bit FROM t) SELECT ctx, bit, count(*) AS n FROM u GROUP BY ALL",
    "scale2x": _scaled_sql(2, False),
    "scale2x_threshold": _scaled_sql(2, True),
    "scale4x": _scaled_sql(4, False),
    "scale4x_threshold": _scaled_sql(4, True),
    "palette_lookup": f"WITH {_INDEXED_SQL} SELECT * FROM lk",
    "palette_gray": f"WITH {_INDEXED_SQL} SELECT img_id, y, x, ((r + 2 * g + b) // 4)::BIGINT AS gray FROM lk",
    "palette_has_color": f"WITH {_INDEXED_SQL} SELECT img_id, bool_or(r <> g OR r <> b) AS has_colour FROM lk GROUP BY img_id",
    "rgb_compose": f"WITH {_COLOURS_SQL} SELECT l_orderkey, l_linenumber, r * 16777216 + g * 65536 + b * 256 AS pixel FROM rgb",
    "green_channel": f"WITH {_COLOURS_SQL} SELECT l_orderkey, l_linenumber, g AS gray FROM rgb",
    "weighted_gray": f"WITH {_COLOURS_SQL} SELECT l_orderkey, l_linenumber, ((r + 2 * g + b) // 4)::BIGINT AS gray FROM rgb",
    "strip16": "SELECT l_orderkey, l_linenumber, ((l_partkey * 31 % 65536) // 256)::INT AS sample FROM lineitem",
    "strip_alpha": f"WITH {PX} SELECT * FROM px",
    "png_read": f"WITH {PX} SELECT * FROM px",
    "png_read_adam7": f"WITH {PX} SELECT * FROM px",
    "pnm_read": f"WITH {PX} SELECT * FROM px",
    "pnm_read_ascii": f"WITH {PX} SELECT * FROM px",
    "pnm_read_bits": f"WITH {_LINES_SQL} SELECT * FROM l",
    "palette_bits": f"WITH {_LINES_SQL} SELECT img_id, y, byte, CASE WHEN img_id % 2 = 0 THEN 255 - byte ELSE byte END AS compat FROM l",
    "palette_entries": f"""WITH {PX}, g AS (SELECT img_id, list(v ORDER BY y, x) AS v FROM px GROUP BY img_id), n AS (SELECT *, (v[13] % 4 + 1)::INT AS size FROM g)
        SELECT img_id, size, CASE WHEN size > 1 THEN v[5] END::INT AS second, size < 3 AS third_absent, array_to_string([v[1], v[4], v[7], v[10]][:size], ',') AS reds, least(4, size + 3)::INT AS grown FROM n""",
    "same_size": f"WITH {PX} SELECT img_id, v % 2 = 0 AS equal FROM px WHERE x = 0 AND y = 0",
    "container_layout": _LAYOUT_SQL,
    "encode_bilevel": f"{_coder_sql(False)} {_CODE_SQL} e",
    "encode_bilevel_tpgd": f"{_coder_sql(True)} {_CODE_SQL} e",
    "container_bytes": f"{_coder_sql(False)} {_CODE_SQL} (SELECT img_id, '974a42320d0a1a0a0100000001' || {_SEGMENTS} || '0000000231000100000000' || '0000000333000100000000' AS code FROM e)",
    "container_fragment": f"{_coder_sql(False)} {_CODE_SQL} (SELECT img_id, {_SEGMENTS} AS code FROM e)",
    "crc32": _CRC_SQL,
    "crc32_combine": _CRC_SQL,
    "set_pad_bits": f"WITH {_LINES_SQL} SELECT img_id, y, byte * 16777216 + 16777215 AS word FROM l",
    "path_name": "SELECT p_partkey, p_type || '/' || p_name AS path FROM part",
    "rfc1123": "SELECT o_orderkey, day(o_orderdate) || strftime(o_orderdate, ' %b %Y %H:%M:%S +0000') AS date FROM orders",
    "png_filter_sub": f"WITH {PX} SELECT img_id, y, x, v, ((v - {_SUB} + 256) % 256)::BIGINT AS f FROM px",
    "png_filter_up": f"WITH {PX} SELECT img_id, y, x, v, ((v - {_UP} + 256) % 256)::BIGINT AS f FROM px",
    "png_filter_average": f"WITH {PX} SELECT img_id, y, x, v, ((v - ({_SUB} + {_UP}) // 2 + 256) % 256)::BIGINT AS f FROM px",
    "png_filter_paeth": f"""WITH {PX}, s AS (SELECT *, {_SUB} AS a, {_UP} AS b FROM px), q AS (SELECT *, coalesce(lag(a) OVER (PARTITION BY img_id, x ORDER BY y), 0) AS c FROM s),
        p AS (SELECT *, abs(b - c) AS pa, abs(a - c) AS pb, abs(a + b - 2 * c) AS pc FROM q)
        SELECT img_id, y, x, v, ((v - CASE WHEN pa <= pb AND pa <= pc THEN a WHEN pb <= pc THEN b ELSE c END + 256) % 256)::BIGINT AS f FROM p""",
    "png_unfilter_sub": f"WITH {PX} SELECT img_id, y, x, ((v - {_SUB} + 256) % 256)::BIGINT AS f, v FROM px",
    "png_unfilter_up": f"WITH {PX} SELECT img_id, y, x, ((v - {_UP} + 256) % 256)::BIGINT AS f, v FROM px",
    "adam7_pass": f"""WITH {PX} SELECT img_id, y, x, CASE WHEN y % 2 = 1 THEN 7 WHEN x % 2 = 1 THEN 6 WHEN y % 4 = 2 THEN 5 WHEN x % 4 = 2 THEN 4 WHEN y % 8 = 4 THEN 3 WHEN x % 8 = 4 THEN 2 ELSE 1 END AS pass FROM px""",
    "ppm_to_ppi": "SELECT p_partkey, floor((p_partkey * 7 + p_size) / 39.37::DOUBLE + 0.5)::BIGINT AS ppi FROM part",
    "resolution_scale": "SELECT p_partkey, CASE WHEN p_size <> 0 AND p_size % 5 <> 0 THEN p_size * 2 ELSE p_size END::BIGINT AS xres, CASE WHEN p_size <> 0 AND p_size % 5 <> 0 THEN p_size % 5 * 4 ELSE p_size % 5 END::BIGINT AS yres FROM part",
    "pad_mask": "SELECT p_partkey, CASE WHEN p_size % 32 = 0 THEN 4294967295 ELSE 4294967295 - ((1::BIGINT << (32 - p_size % 32)) - 1) END::BIGINT AS mask, ((p_size * 8 + 31) // 32)::BIGINT AS wpl FROM part",
    "format_sniff": f"""WITH c AS (SELECT doc_id AS id, 'document' AS kind, hex(encode(text)) AS h FROM documents UNION ALL SELECT doc_id, 'made', [{_MADE_SQL}][doc_id % {len(_MADE)} + 1] || hex(encode(text)) FROM documents),
        s AS (SELECT *, length(h) // 2 AS n FROM c) SELECT id, kind, {_SNIFF_SQL} AS format FROM s""",
    "adler32": _ADLER_SQL,
    "adler32_combine": _ADLER_SQL,
}
