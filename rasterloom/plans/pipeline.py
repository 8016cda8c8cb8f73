"""The whole way from image files to encoded pages, parallel over images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..operators import container, strips
from ..operators.binarize import Options, binarize
from ..sources.images import decode_images, from_row, map_rows, read_files, readable, to_row
from ..sources.pnm import ImageError

ENCODED = T.StructType(
    [
        T.StructField("img_id", T.StringType()),
        T.StructField("w", T.IntegerType()),
        T.StructField("h", T.IntegerType()),
        T.StructField("xres", T.IntegerType()),
        T.StructField("yres", T.IntegerType()),
        T.StructField("code", T.BinaryType()),
        T.StructField("warnings", T.ArrayType(T.StringType())),
        T.StructField("error", schemas.ERROR),
    ]
)


def _failed(img_id: str | None, e: ImageError) -> dict:
    return dict.fromkeys(ENCODED.names) | {"img_id": img_id, "error": {"code": e.code, "msg": str(e)}}


def _encoded(img_id: str | None, r, o: Options) -> dict:
    code = container.encode_image(r.pixels, o.xres or r.xres, o.yres or r.yres, o.typical, o.full)
    return {"img_id": img_id, "w": r.w, "h": r.h, "xres": r.xres, "yres": r.yres, "code": code, "warnings": r.warnings, "error": None}


def binarize_images(images: DataFrame, options: Options = Options()) -> DataFrame:
    """The image table with one bit a pixel; rows in error stay as they are."""
    options.check()

    def make(row: dict) -> dict:
        if row["error"] is not None:
            return row
        try:
            return to_row(row["img_id"], binarize(from_row(row), options))
        except ImageError as e:
            return to_row(row["img_id"], None, e)

    return map_rows(images, schemas.IMAGE.names, make, schemas.IMAGE)


def encode_images(images: DataFrame, options: Options = Options()) -> DataFrame:
    """Encoded pages of a bilevel image table; an image of more bits is an error."""
    options.check()

    def make(row: dict) -> dict:
        if row["error"] is not None:
            return dict.fromkeys(ENCODED.names) | {"img_id": row["img_id"], "error": row["error"]}
        if row["d"] != 1:
            return _failed(row["img_id"], ImageError("not a bilevel image", schemas.DEPTH))
        return _encoded(row["img_id"], from_row(row), options)

    return map_rows(images, schemas.IMAGE.names, make, ENCODED)


def spread(files: DataFrame, parts: int) -> DataFrame:
    """Deal files over ``parts`` tasks by a hash of the path, so neighbours in a folder, often alike in size, part; an image doesn't split."""
    return files.repartition(parts, F.xxhash64("path"))


def convert(spark: SparkSession, path: str | list[str], options: Options = Options(), glob: str | None = None, parts: int | None = None) -> DataFrame:
    """Read, decode, binarize and encode in one Python stage, a few lines at a time: no raster leaves the worker or is held whole there."""
    options.check()
    files = read_files(spark, path, glob)
    if parts:
        files = spread(files, parts)
    return convert_files(files, options)


def convert_files(files: DataFrame, options: Options = Options()) -> DataFrame:
    """The same for a batch or stream of files (path, content)."""

    def make(row: dict) -> dict:
        try:
            readable(row["content"])
            page = strips.encode_file(row["content"], options)
            return {"img_id": row["path"], **vars(page), "error": None}
        except ImageError as e:
            return _failed(row["path"], e)

    return map_rows(files, ["path", "content"], make, ENCODED)


__all__ = ["ENCODED", "Options", "binarize_images", "convert", "convert_files", "decode_images", "encode_images", "spread"]
