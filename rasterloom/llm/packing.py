"""Concatenate and cut: documents become token sequences of one fixed length.

Pass one tokenizes each text once and writes its ids with the place it has among its
partition's tokens. Prefix sums over the partitions' totals (one row for each task)
turn that into a global place; pass two cuts the stream at multiples of the length and
emits one boundary record for each piece. Nothing is sorted or shuffled, only the last
sequence can be short, and a text in one place is independent of all other texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import stage_table, trim
from .tokens import Encoder, default_path

LENGTH = 4096
END = 2
#: Texts encoded at once, and the bytes after which a batch is cut short: the more at once, the fewer words come again.
TEXT_ROWS, TEXT_BYTES = 16_384, 8_000_000
#: The same for rows of ids that are cut.
BATCH_ROWS, BATCH_BYTES = 256, 2_000_000
#: Most partitions (one offset each) that are broadcast; beyond it the join shuffles.
MOST_PARTS = 500_000


def _slices(batch: pa.RecordBatch, column: str, rows: int = BATCH_ROWS, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with bounded text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    at = held = 0
    for i, size in enumerate(sizes):
        held += size
        if i - at + 1 >= rows or held >= most:
            yield batch.slice(at, i + 1 - at)
            at, held = i + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


def tokenize(docs: DataFrame, id_col: str, text_col: str, path: str | None, end: int | None) -> DataFrame:
    """id, part (task), before (tokens of the task's earlier rows), n, ids (little-endian binary), width."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("part", T.LongType()), T.StructField("before", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("width", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.shared(path or default_path())
        tail = b"" if end is None else np.array([end], encoder.dtype).tobytes()
        width, part, before = np.dtype(encoder.dtype).itemsize, TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in _slices(whole, "text", TEXT_ROWS, TEXT_BYTES):
                ids = [x + tail for x in encoder.encode(batch.column("text").to_pylist())]
                n = np.array([len(x) // width for x in ids], "i8")
                at = before + np.cumsum(n) - n
                before += int(n.sum())
                size = len(ids)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.full(size, part, "i8")), pa.array(at), pa.array(n), pa.array(ids, pa.binary()), pa.array(np.full(size, width, "i4"))], names=schema.names)

    return rows.mapInArrow(run, schema)


def pack(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end: int | None = END, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset; ``with_ids`` adds the ids.

    ``path`` is a tokenizers file every executor can read. Each document is its ids, then
    ``end``. Null and empty texts are that one id (and no piece if ``end`` is None). A text
    longer than a sequence runs through as many as it needs. Repeated rows are packed each.
    An empty table gives no rows.
    """
    tokens = stage_table(tokenize(docs, id_col, text_col, path, end), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    first = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = stage_table(totals.select("part", first.alias("first")), "offsets", "snappy")
    small = offsets.count() <= MOST_PARTS
    placed = tokens.join(F.broadcast(offsets) if small else offsets, "part").select("id", (F.col("first") + F.col("before")).alias("place"), "n", "ids", "width")
    fields = [T.StructField(id_col, tokens.schema["id"].dataType)] + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    schema = T.StructType(fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Encoder.forget()
        trim()
        for batch in (b for whole in batches for b in _slices(whole, "ids")):
            columns = batch.to_pydict()
            out = [[] for _ in schema.names]
            for key, place, n, raw, width in zip(*(columns[c] for c in ("id", "place", "n", "ids", "width")), strict=True):
                ids, start = np.frombuffer(raw, f"<u{width}").astype("<u4"), 0
                while start < n:
                    sequence, offset = divmod(place + start, length)
                    stop = min(n, start + length - offset)
                    piece = ids[start:stop]
                    row = [key, start, stop - start, zlib.crc32(piece.tobytes()), n, sequence, offset]
                    for column, value in zip(out, row + [piece.astype("i4")] * with_ids, strict=True):
                        column.append(value)
                    start = stop
            types = [batch.schema.field("id").type] + [pa.int64()] * 6 + [pa.list_(pa.int32())] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=schema.names)

    return placed.mapInArrow(cut, schema)
