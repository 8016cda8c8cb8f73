"""Image files as DataFrames: batch or stream of binary files, decoded in parallel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import kernels
from . import png, pnm
from .pnm import ImageError, Raster
from .sniff import sniff, sniff_bytes

FILES = "path string, modificationTime timestamp, length bigint, content binary"
#: Bytes of decoded data after which a batch goes out.
BATCH_BYTES = 16_000_000


def read_files(spark: SparkSession, path: str | list[str], glob: str | None = None, most_bytes: int | None = None) -> DataFrame:
    """path, modificationTime, length, content, format; ``most_bytes`` is pushed into the scan."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    if most_bytes is not None:
        files = files.where(F.col("length") <= most_bytes)
    return files.withColumn("format", sniff(F.col("content"), F.col("length")))


def stream_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """The same as a stream of the files that arrive in a folder."""
    reader = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return files.withColumn("format", sniff(F.col("content"), F.col("length")))


def readable(data: bytes | None) -> str:
    """Whether a file is ``png`` or ``pnm`` by its first bytes; others can't be read."""
    if data is None:
        raise ImageError("no file", schemas.MISSING)
    kind = sniff_bytes(data)
    if kind not in ("png", "pnm"):
        raise ImageError(f"{kind} files can't be read" if kind else "unknown format", schemas.READ if kind else schemas.FORMAT)
    return kind


def decode(data: bytes | None, compat: bool = False) -> Raster:
    """Decode a PNG or PNM file."""
    return (png if readable(data) == "png" else pnm).decode(data, compat)


def to_row(img_id: str | None, r: Raster | None, error: ImageError | None = None) -> dict:
    """An image-table row."""
    if r is None:
        return dict.fromkeys(schemas.IMAGE.names) | {"img_id": img_id, "error": {"code": error.code, "msg": str(error)}}
    data = kernels.pack(r.pixels) if r.d == 1 else r.pixels.astype("<u2" if r.d == 16 else np.uint8).tobytes()
    cmap = None if r.cmap is None else [{"r": int(a), "g": int(b), "b": int(c)} for a, b, c in r.cmap]
    return {"img_id": img_id, "w": r.w, "h": r.h, "d": r.d, "xres": r.xres, "yres": r.yres, "informat": r.informat, "text": r.text, "cmap": cmap, "data": data, "warnings": r.warnings, "error": None}


def from_row(row: dict) -> Raster:
    """The raster of an image-table row."""
    w, h, d = row["w"], row["h"], row["d"]
    if d == 1:
        pixels = kernels.unpack(row["data"], w, h)
    else:
        pixels = np.frombuffer(row["data"], "<u2" if d == 16 else np.uint8).reshape((h, w, 3) if d == 32 else (h, w))
    cmap = None if row["cmap"] is None else np.array([[c["r"], c["g"], c["b"]] for c in row["cmap"]], np.uint8).reshape(-1, 3)
    return Raster(pixels, d, row["informat"], row["xres"], row["yres"], row["text"], cmap, list(row["warnings"] or ()))


def map_rows(df: DataFrame, columns: list[str], make, schema) -> DataFrame:
    """``make(row)`` of each row, in Arrow batches that go out after BATCH_BYTES of ``data``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        out, held = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = make(batch.slice(i, 1).to_pylist()[0])
                out.append(row)
                held += len(row.get("data") or row.get("code") or b"")
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out, held = [], 0

    return df.select(*columns).mapInArrow(run, schema)


def decode_images(files: DataFrame, compat: bool = False) -> DataFrame:
    """The image table of files (path, content); a file that can't be decoded gives a row with ``error``."""

    def make(row: dict) -> dict:
        try:
            return to_row(row["path"], decode(row["content"], compat))
        except ImageError as e:
            return to_row(row["path"], None, e)

    return map_rows(files, ["path", "content"], make, schemas.IMAGE)


def read_images(spark: SparkSession, path: str | list[str], glob: str | None = None, compat: bool = False, most_bytes: int | None = None) -> DataFrame:
    """Decode all files below ``path``."""
    return decode_images(read_files(spark, path, glob, most_bytes), compat)
