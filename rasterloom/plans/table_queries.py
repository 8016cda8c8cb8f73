"""Queries of the operators on packed lines, ordered parts, mixed filters, passes and palettes of each image, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checksums, colour, parts
from ..operators import filters, interlace, kernels, lines, pixels
from ..operators.coder import TYPICAL
from .queries import _ADLER_SQL, _CRC_SQL, CUT, PX, _table, gray_pixels

# A sheet for each embedding: 8 lines of 61 pixels that read the numbers in steps of 7; one to three lines in a row are alike.
WIDE, HIGH = 61, 8
_SHEET = "floor((embedding[(x * 7 + (y // (1 + vec_id % 3)) * 11) % 64 + 1]::DOUBLE + 1.0) * 127.5)::BIGINT"
SHEET = f"sh AS (SELECT vec_id AS img_id, y::INT AS y, x::INT AS x, ({_SHEET} < {CUT})::INT AS bit FROM embeddings, range({HIGH}) a(y), range({WIDE}) b(x))"
WORDS = f"{SHEET}, wd AS (SELECT img_id, y, (x // 32)::INT AS nth, sum(bit::BIGINT << (31 - x % 32))::BIGINT AS word FROM sh GROUP BY ALL)"


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed lines of the sheets."""
    line = F.col("y")
    at = lambda x: ((x * 7 + F.floor(line / (1 + F.col("vec_id") % 3)) * 11) % 64).cast("int")
    gray = F.transform(F.sequence(F.lit(0), F.lit(WIDE - 1)), lambda x: F.floor((F.get("embedding", at(x)).cast("double") + 1.0) * 127.5))
    each = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(HIGH - 1))).alias("y"))
    return lines.threshold(each.select(F.col("vec_id").alias("img_id"), "y", gray.alias("values")), CUT)


def _words(ls: DataFrame, name: str = "word") -> DataFrame:
    return ls.select("img_id", "y", F.posexplode("words").alias("nth", name))


def line_threshold(spark, sf):
    return _words(sheets(spark, sf))


BOX = (25, 2, 20, 4)


def line_boxes(spark, sf):
    """A box across a word's edge, cleared, set and inverted."""
    ls = sheets(spark, sf)
    made = ls.select("img_id", "y", F.col("words").alias("plain"), "w")
    for op in ("clear", "set", "invert"):
        made = lines.box(made.withColumn("words", F.col("plain")), *BOX, op).withColumnRenamed("words", op)
    each = F.posexplode(F.arrays_zip("clear", "set", "invert")).alias("nth", "s")
    return made.select("img_id", "y", each).select("img_id", "y", "nth", "s.*")


def line_typical(spark, sf):
    return lines.typical(sheets(spark, sf)).select("img_id", "y", "same", "change")


def line_contexts(spark, sf):
    return lines.contexts(sheets(spark, sf))


def line_context_histogram(spark, sf):
    return lines.context_histogram(sheets(spark, sf), with_typical=True)


def _parts(spark, sf) -> DataFrame:
    """Texts in parts of 700 bytes, each with its own checksums; they carry their number, and no order."""
    # as in the SQL, rows without an id fall out; bytes are taken from a text once, below the explode: above it, they would be for each part anew
    texts = _table(spark, sf, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.col("text").cast("binary").alias("data"))
    numbers = F.sequence(F.lit(0), F.floor(F.greatest(F.octet_length("data") - 1, F.lit(0)) / 700).cast("int"))
    each = texts.select("doc_id", "data", F.explode(numbers).alias("seq")).select("doc_id", "seq", F.substring("data", F.col("seq") * 700 + 1, F.lit(700)).alias("part"))
    return each.select("doc_id", "seq", F.octet_length("part").cast("long").alias("length"), F.crc32("part").alias("crc"), checksums.adler32(F.col("part")).alias("adler"))


def checksum_parts(spark, sf):
    """The checksums of whole texts from those of their parts."""
    return parts.combine(parts.with_offsets(_parts(spark, sf), ["doc_id"]), ["doc_id"]).select("doc_id", "length", "complete", "crc", "adler")


def checksum_parts_damaged(spark, sf):
    """A part is lost where the id leaves 1 modulo 3, and one comes twice where it leaves 2; texts of one part lose or double all they have."""
    each = parts.with_offsets(_parts(spark, sf), ["doc_id"])
    lost = each.where(~((F.col("doc_id") % 3 == 1) & (F.col("offset") == 0)))
    # copies by an explode: a union would cut, sum up and deal all texts once more
    copies = F.when((F.col("doc_id") % 3 == 2) & (F.col("offset") == 0), 2).otherwise(1)
    twice = lost.withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    return parts.combine(twice, ["doc_id"]).select("doc_id", "parts", "complete", F.col("crc").isNull().alias("none"))


def filtered_lines(spark, sf) -> DataFrame:
    """Lines filtered by all five kinds in turn: img_id, y, kind, f."""
    px = gray_pixels(spark, sf)
    kind = (F.col("y") + F.col("img_id")) % 5
    each = px.withColumn("f", F.col("v"))
    for i, made in enumerate((pixels.filter_sub, pixels.filter_up, pixels.filter_average, pixels.filter_paeth), 1):
        each = made(each.withColumnRenamed("f", "had")).withColumn("f", F.when(kind == i, F.col("f")).otherwise(F.col("had"))).drop("had")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("x", "f"))), lambda s: s["f"].cast("int"))
    return each.groupBy("img_id", "y", kind.cast("int").alias("kind")).agg(ordered.alias("f"))


def png_unfilter_mixed(spark, sf):
    """What the filters made, and the pixels again."""
    made = filtered_lines(spark, sf)
    back = filters.unfilter(made)
    both = made.join(back, ["img_id", "y"]).select("img_id", "y", "kind", F.posexplode(F.arrays_zip("f", "v")).alias("x", "s"))
    return both.select("img_id", "y", "x", "kind", "s.f", "s.v")


def png_unfilter_channels(spark, sf):
    """The same for lines whose bytes belong to two channels in turn: the number of a line's pixel is x div 2."""
    px = gray_pixels(spark, sf).withColumn("channel", F.col("x") % 2).withColumn("at", F.expr("x div 2"))
    flat = px.select(F.struct("img_id", "channel").alias("img_id"), "y", F.col("at").alias("x"), "v")
    made = pixels.filter_paeth(flat).select("img_id.img_id", "y", (F.col("x") * 2 + F.col("img_id.channel")).alias("x"), F.col("f"))
    byte_lines = made.groupBy("img_id", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "f"))), lambda s: s["f"].cast("int")).alias("f")).withColumn("kind", F.lit(4))
    back = filters.unfilter(filters.channels(byte_lines, 2), ("img_id", "channel"))
    return back.select("img_id", "y", "channel", F.posexplode("v").alias("at", "v")).select("img_id", "y", (F.col("at") * 2 + F.col("channel")).cast("int").alias("x"), "v")


def _sized(spark, sf) -> DataFrame:
    """Pixel tables of 1 to 9 columns and lines."""
    size = _table(spark, sf, "embeddings").select("vec_id", "embedding", (F.col("vec_id") % 9 + 1).cast("int").alias("w"), (F.expr("vec_id div 9") % 9 + 1).cast("int").alias("h"))
    each = size.select(F.col("vec_id").alias("img_id"), "embedding", "w", "h", F.explode(F.sequence(F.lit(0), F.col("w") * F.col("h") - 1)).alias("i"))
    value = F.floor((F.get("embedding", F.col("i") % 64).cast("double") + 1.0) * 127.5)
    return each.select("img_id", "w", "h", F.expr("cast(i div w as int)").alias("y"), (F.col("i") % F.col("w")).cast("int").alias("x"), value.alias("v"))


_SIZED = """sz AS (SELECT vec_id AS img_id, embedding, (vec_id % 9 + 1)::INT AS w, ((vec_id // 9) % 9 + 1)::INT AS h FROM embeddings),
    si AS (SELECT *, unnest(range(w * h)) AS i FROM sz), sp AS (SELECT img_id, w, h, (i // w)::INT AS y, (i % w)::INT AS x, floor((embedding[i % 64 + 1]::DOUBLE + 1.0) * 127.5)::BIGINT AS v FROM si)"""


def adam7_lines(spark, sf):
    ls = interlace.interlace(_sized(spark, sf))
    return ls.select("img_id", "pass", "row", F.array_join(F.col("values").cast("array<string>"), ",").alias("line"))


def adam7_deinterlace(spark, sf):
    return interlace.deinterlace(interlace.interlace(_sized(spark, sf)))


def adam7_shapes(spark, sf):
    return interlace.shapes(_sized(spark, sf).select("img_id", "w", "h").distinct())


def adam7_raw_lines(spark, sf):
    """Places of the lines at four bits a pixel."""
    return interlace.raw_lines(_sized(spark, sf).select("img_id", "w", "h").distinct(), 4).withColumnRenamed("offset", "start")


# the pass of a place, from the powers of two in it
_PASS = "CASE WHEN y % 2 = 1 THEN 7 WHEN x % 2 = 1 THEN 6 WHEN y % 4 = 2 THEN 5 WHEN x % 4 = 2 THEN 4 WHEN y % 8 = 4 THEN 3 WHEN x % 8 = 4 THEN 2 ELSE 1 END"


def palette_per_image(spark, sf):
    """Indices below 16 under palettes of 4 to 16 entries that differ by image; images whose number 17 divides have none."""
    vec = F.col("vec_id")
    entry = lambda i: F.struct(((i * 7 + vec) % 256).cast("short").alias("r"), ((i * 5 + vec * 3) % 256).cast("short").alias("g"), (i * 11 % 256).cast("short").alias("b"))
    palettes = _table(spark, sf, "embeddings").where("vec_id % 17 <> 0").select(vec.alias("img_id"), F.transform(F.sequence(F.lit(0), (vec % 13 + 3).cast("int")), entry).alias("cmap"))
    each = gray_pixels(spark, sf).groupBy("img_id", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda s: (s["v"] % 16).cast("int")).alias("values"))
    found = colour.look_up(each, palettes, salts=4).select("img_id", "y", "missing", F.posexplode("colours").alias("x", "c"))
    return found.select("img_id", "y", "x", *[F.col(f"c.{c}").cast("int").alias(c) for c in "rgb"], "missing")


QUERIES = {
    f.__name__: f
    for f in (line_threshold, line_boxes, line_typical, line_contexts, line_context_histogram, checksum_parts, checksum_parts_damaged, png_unfilter_mixed, png_unfilter_channels, adam7_lines, adam7_deinterlace, adam7_shapes, adam7_raw_lines, palette_per_image)
}

_FILTERED = f"""WITH {PX}, fa AS (SELECT *, coalesce(lag(v) OVER (PARTITION BY img_id, y ORDER BY x), 0) AS a, coalesce(lag(v) OVER (PARTITION BY img_id, x ORDER BY y), 0) AS b FROM px),
    fc AS (SELECT *, coalesce(lag(a) OVER (PARTITION BY img_id, x ORDER BY y), 0) AS c, ((y + img_id) % 5)::INT AS kind FROM fa),
    fg AS (SELECT *, CASE kind WHEN 0 THEN 0 WHEN 1 THEN a WHEN 2 THEN b WHEN 3 THEN (a + b) // 2 WHEN 4 THEN CASE WHEN abs(b - c) <= abs(a - c) AND abs(b - c) <= abs(a + b - 2 * c) THEN a WHEN abs(a - c) <= abs(a + b - 2 * c) THEN b ELSE c END END AS guess FROM fc)"""
_NEAR = ", ".join(f"{'lead' if k > 0 else 'lag'}(bit, {abs(k)}) OVER w AS {'p' if k > 0 else 'm'}{abs(k)}" for k in range(-4, 4) if k)


def _sheet_contexts() -> str:
    """The neighbourhood of each pixel of the sheets, gathered pixel by pixel."""
    at = lambda dy, dx: f"coalesce(n{-dy}.{'bit' if dx == 0 else ('p' if dx > 0 else 'm') + str(abs(dx))}, 0)"
    terms = " + ".join(f"{at(dy, dx)} * {1 << 15 - i}" for i, (dy, dx) in enumerate(kernels.NEIGHBOURS))
    return f"""{SHEET}, sm AS (SELECT img_id, y, x, bit, {_NEAR} FROM sh WINDOW w AS (PARTITION BY img_id, y ORDER BY x)),
    sc AS (SELECT n0.img_id, n0.y, n0.x, ({terms})::INT AS ctx, n0.bit FROM sm n0 LEFT JOIN sm n1 ON n1.img_id = n0.img_id AND n1.x = n0.x AND n1.y = n0.y - 1 LEFT JOIN sm n2 ON n2.img_id = n0.img_id AND n2.x = n0.x AND n2.y = n0.y - 2)"""


_ALIKE = """sl AS (SELECT img_id, y, string_agg(bit, '' ORDER BY x) AS line FROM sh GROUP BY ALL), ss AS (SELECT img_id, y, coalesce((line = lag(line) OVER w)::INT, 0) AS same FROM sl WINDOW w AS (PARTITION BY img_id ORDER BY y)),
    st AS (SELECT img_id, y, same, xor(same, coalesce(lag(same) OVER w, 0)) AS change FROM ss WINDOW w AS (PARTITION BY img_id ORDER BY y))"""
_IN_BOX = f"y BETWEEN {BOX[1]} AND {BOX[1] + BOX[3] - 1} AND x BETWEEN {BOX[0]} AND {BOX[0] + BOX[2] - 1}"
_BOXED = ", ".join(f"sum((CASE WHEN {_IN_BOX} THEN {to} ELSE bit END)::BIGINT << (31 - x % 32))::BIGINT AS {name}" for name, to in (("clear", "0"), ("set", "1"), ("invert", "1 - bit")))
_PASS_TABLE = "ad(pass, y0, dy, x0, dx) AS (VALUES (1, 0, 8, 0, 8), (2, 0, 8, 4, 8), (3, 4, 8, 0, 4), (4, 0, 4, 2, 4), (5, 2, 4, 0, 2), (6, 0, 2, 1, 2), (7, 1, 2, 0, 1))"
_SHAPES = f"""{_SIZED}, {_PASS_TABLE}, sq AS (SELECT img_id, pass, greatest(0, (w - x0 + dx - 1) // dx)::INT AS pw, greatest(0, (h - y0 + dy - 1) // dy)::INT AS ph FROM sz, ad),
    sn AS (SELECT img_id, pass, CASE WHEN ph > 0 THEN pw ELSE 0 END AS pw, CASE WHEN pw > 0 THEN ph ELSE 0 END AS ph FROM sq)"""

ORACLE_SQL = {
    "line_threshold": f"WITH {WORDS} SELECT * FROM wd",
    "line_boxes": f"WITH {SHEET} SELECT img_id, y, (x // 32)::INT AS nth, {_BOXED} FROM sh GROUP BY ALL",
    "line_typical": f"WITH {SHEET}, {_ALIKE} SELECT * FROM st",
    "line_contexts": f"WITH {_sheet_contexts()} SELECT * FROM sc",
    "line_context_histogram": f"WITH {_sheet_contexts()}, {_ALIKE} SELECT ctx, bit, count(*) AS n FROM (SELECT ctx, bit FROM sc SEMI JOIN (SELECT * FROM st WHERE same = 0) z USING (img_id, y) UNION ALL SELECT {TYPICAL}, change FROM st) GROUP BY ALL",
    "checksum_parts": f"SELECT doc_id, octet_length(encode(text))::BIGINT AS length, true AS complete, crc, adler FROM ({_CRC_SQL}) JOIN ({_ADLER_SQL}) USING (doc_id) JOIN documents USING (doc_id) WHERE text IS NOT NULL",
    "checksum_parts_damaged": """WITH d AS (SELECT doc_id, greatest(1, (octet_length(encode(text)) + 699) // 700) - (doc_id % 3 = 1)::INT + (doc_id % 3 = 2)::INT AS parts, doc_id % 3 = 0 OR octet_length(encode(text)) = 0 AS complete FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, parts::BIGINT AS parts, complete, NOT complete AS none FROM d WHERE parts > 0""",
    "png_unfilter_mixed": f"{_FILTERED} SELECT img_id, y, x, kind, ((v - guess + 256) % 256)::INT AS f, v::INT AS v FROM fg",
    "png_unfilter_channels": f"WITH {PX} SELECT img_id, y, x, v::INT AS v FROM px",
    "adam7_lines": f"WITH {_SIZED}, pp AS (SELECT img_id, y, x, v, {_PASS} AS pass FROM sp) SELECT img_id, pass::INT AS pass, (dense_rank() OVER (PARTITION BY img_id, pass ORDER BY y) - 1)::INT AS row, string_agg(v, ',' ORDER BY x) AS line FROM pp GROUP BY img_id, pass, y",
    "adam7_deinterlace": f"WITH {_SIZED} SELECT img_id, y, x, v FROM sp",
    "adam7_shapes": f"WITH {_SHAPES} SELECT * FROM sn",
    "adam7_raw_lines": f"""WITH {_SHAPES}, so AS (SELECT *, (pw * 4 + 7) // 8 AS size, coalesce(sum(ph * ((pw * 4 + 7) // 8 + 1)) OVER (PARTITION BY img_id ORDER BY pass ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM sn),
        sr AS (SELECT *, unnest(range(ph)) AS row FROM so) SELECT img_id, pass, row::INT AS row, (first + row * (size + 1))::BIGINT AS start, size::INT AS length FROM sr""",
    "palette_per_image": f"""WITH {PX}, pv AS (SELECT img_id, y, x, v % 16 AS i, CASE WHEN img_id % 17 = 0 THEN 0 ELSE img_id % 13 + 4 END AS size FROM px)
        SELECT img_id, y, x, (CASE WHEN i < size THEN (i * 7 + img_id) % 256 ELSE 0 END)::INT AS r, (CASE WHEN i < size THEN (i * 5 + img_id * 3) % 256 ELSE 0 END)::INT AS g, (CASE WHEN i < size THEN i * 11 % 256 ELSE 0 END)::INT AS b,
        (count(*) FILTER (i >= size) OVER (PARTITION BY img_id, y))::INT AS missing FROM pv""",
}
