"""The chunk table of PNG files: what a file holds, and what of it is damaged, without decoding it."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from .png import CRITICAL, SIGNATURE

FIELDS = "seq int, name string, offset bigint, length bigint, critical boolean, crc_right boolean"


def walk(data: bytes | None) -> Iterator[tuple[int, str, int, int, bool, bool | None]]:
    """(seq, name, offset, length, critical, crc_right) of each chunk; bodies are looked at where they lie.

    A file without the signature has none. A chunk that the file's end cuts short is told
    with the length it claims and no CRC, and nothing follows it; bytes behind IEND count as
    chunks as long as they hold any.
    """
    if data is None or data[: len(SIGNATURE)] != SIGNATURE:
        return
    view, at, seq = memoryview(data), len(SIGNATURE), 0
    while at + 8 <= len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        end = at + 8 + size
        whole = end + 4 <= len(data)
        right = zlib.crc32(view[at + 4 : end]) == struct.unpack_from(">I", data, end)[0] if whole else None
        yield seq, name.decode("latin-1"), at, size, name in CRITICAL or not name[0] & 32, right
        if not whole:
            return
        at, seq = end + 4, seq + 1


def chunk_table(files: DataFrame, keep: tuple[str, ...] = ("path",), content: str = "content") -> DataFrame:
    """A row for each chunk of each file, beside the file's ``keep`` columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    rows = files.select(*keep, content)
    schema = StructType([rows.schema[c] for c in keep] + StructType.fromDDL(FIELDS).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            column, found, times = batch.column(content), [], []
            for i in range(batch.num_rows):
                told = list(walk(column[i].as_buffer().to_pybytes() if column[i].is_valid else None))
                found += told
                times.append(len(told))
            where = pa.array([i for i, n in enumerate(times) for _ in range(n)], pa.int64())
            parts = [pa.array(list(x), arrow.field(len(keep) + k).type) for k, x in enumerate(zip(*found, strict=True))] or [pa.array([], f.type) for f in list(arrow)[len(keep) :]]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(where) for c in keep] + parts, schema=arrow)

    return rows.mapInArrow(run, schema)


@udtf(returnType=FIELDS)
class PngChunks:
    """``SELECT f.path, c.* FROM files f, LATERAL png_chunks(f.content) c``."""

    def eval(self, content: bytes):
        yield from walk(None if content is None else bytes(content))


def register(spark: SparkSession) -> None:
    """Make ``png_chunks`` known to SQL."""
    spark.udtf.register("png_chunks", PngChunks)
