"""Interlacing as joins with the table of passes: seven rows of first line, line step, first column, column step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.png import ADAM7
from .pixels import adam7_pass

_FIELDS = ("y0", "dy", "x0", "dx")


def passes(df: DataFrame) -> DataFrame:
    """The table of passes: pass (1 to 7), y0, dy, x0, dx."""
    return df.sparkSession.createDataFrame([(i, *p) for i, p in enumerate(ADAM7, 1)], "pass int, y0 int, dy int, x0 int, dx int")


def shapes(images: DataFrame) -> DataFrame:
    """Seven rows for each image (img_id, w, h): pass, pw, ph, its size; a pass that takes no pixel has none (0 by 0)."""
    table = F.array(*[F.struct(F.lit(i).alias("pass"), *[F.lit(v).alias(c) for c, v in zip(_FIELDS, p, strict=True)]) for i, p in enumerate(ADAM7, 1)])
    each = images.select("img_id", "w", "h", F.explode(table).alias("p")).select("img_id", "w", "h", "p.*")
    pw, ph = (F.greatest(F.ceil((F.col(n) - F.col(at)) / F.col(step)), F.lit(0)).cast("int") for n, at, step in (("w", "x0", "dx"), ("h", "y0", "dy")))
    empty = (pw == 0) | (ph == 0)
    return each.select("img_id", "pass", F.when(empty, 0).otherwise(pw).alias("pw"), F.when(empty, 0).otherwise(ph).alias("ph"))


def raw_lines(images: DataFrame, bits: int = 8) -> DataFrame:
    """Where each line of each pass lies in inflated image data: img_id, pass, row, offset (of its filter byte), length (without it)."""
    size = F.ceil(F.col("pw") * bits / 8).cast("int")
    passes_of = F.array_sort(F.collect_list(F.struct("pass", "ph", F.when(F.col("ph") > 0, size).otherwise(0).alias("size"))))
    one = shapes(images).groupBy("img_id").agg(passes_of.alias("p"))
    taken = lambda p: F.when(p["ph"] > 0, p["ph"].cast("long") * (p["size"] + 1)).otherwise(F.lit(0).cast("long"))
    before = lambda k: F.aggregate(F.slice("p", F.lit(1), k), F.lit(0).cast("long"), lambda s, p: s + taken(p))
    each = one.select("img_id", F.explode(F.transform("p", lambda p, k: F.struct(p.alias("p"), before(k).alias("first")))).alias("s")).where("s.p.ph > 0")
    rows = each.select("img_id", "s", F.explode(F.sequence(F.lit(0), F.col("s.p.ph") - 1)).alias("row"))
    return rows.select("img_id", F.col("s.p.pass").alias("pass"), "row", (F.col("s.first") + F.col("row") * (F.col("s.p.size") + 1)).alias("offset"), F.col("s.p.size").alias("length"))


def interlace(px: DataFrame, value: str = "v") -> DataFrame:
    """Pass lines of a pixel table: img_id, pass, row, values; passes without pixels have no line."""
    placed = px.withColumn("pass", adam7_pass(F.col("x"), F.col("y"))).join(F.broadcast(passes(px)), "pass")
    row, column = (F.floor((F.col(c) - F.col(f"{c}0")) / F.col(f"d{c}")).cast("int") for c in ("y", "x"))
    lines = placed.groupBy("img_id", "pass", row.alias("row")).agg(F.array_sort(F.collect_list(F.struct(column.alias("at"), F.col(value).alias("v")))).alias("s"))
    return lines.select("img_id", "pass", "row", F.col("s.v").alias("values"))


def deinterlace(lines: DataFrame, values: str = "values", value: str = "v") -> DataFrame:
    """The pixel table of pass lines (img_id, pass, row, ``values``): the pass says where its lines and columns lie. Nothing is shuffled, and lines may come in any order."""
    each = lines.join(F.broadcast(passes(lines)), "pass").select("img_id", "row", *_FIELDS, F.posexplode(values).alias("at", value))
    return each.select("img_id", (F.col("y0") + F.col("row") * F.col("dy")).alias("y"), (F.col("x0") + F.col("at") * F.col("dx")).alias("x"), value)
