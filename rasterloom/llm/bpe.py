"""Encoding and decoding by a public BPE file; long texts by tree concatenation.

A text of up to LEAF code points is encoded at once. A longer one is halved until its
parts are that short, wherever the cuts fall; the parts are dealt over the tasks and
encoded there. They come together as a tree: two neighbours are joined by encoding a
window on either side of the join alone and both windows together. Where the first
window ends in the left node's own ids and starts as the double one does, and likewise
on the right, the double window replaces what lies between; else the windows grow, up
to the whole nodes.

Why that is exact: what both encodings share holds the end of a word, where splitting
starts afresh, or so many ids that it lies in a run of letters or signs whose extent
doesn't depend on where one looks from; and ids of a word are the right ones if each
neighbouring pair is, which the nodes and the window vouch for on their sides of what
they share. Cuts are made only before characters that never compose with what precedes.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .packing import TEXT_BYTES, TEXT_ROWS, _slices
from .shared import trim
from .tokens import Encoder, _offsets, default_path

#: Code points that are encoded at once.
LEAF = 16_384
#: Code points on either side of a join that are encoded first; more than any fixed string a splitting pattern looks for.
WINDOW = 64
#: So many shared ids without the end of a word lie in a run: fixed strings are shorter.
RUN = 16


def _fixed(char: str) -> bool:
    """Whether a character never composes with one before it; unassigned ones may."""
    return unicodedata.category(char) not in ("Mn", "Mc", "Me", "Cn") and not 0x1160 <= ord(char) <= 0x11FF


def halves(text: str, leaf: int = LEAF) -> list[str]:
    """Parts of a text in order: it is halved, and its halves again, until each has at most ``leaf`` code points; a text that can be cut nowhere stays whole."""
    if len(text) <= leaf:
        return [text]
    mid = len(text) // 2
    cut = next((at for far in range(mid) for at in (mid - far, mid + far) if at < len(text) and _fixed(text[at])), None)
    return [text] if cut is None else halves(text[:cut], leaf) + halves(text[cut:], leaf)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    unlike = np.flatnonzero(a[:n] != b[:n])
    return int(unlike[0]) if len(unlike) else n


class Tree:
    """Joins encoded parts of one text, neighbour to neighbour."""

    def __init__(self, encoder: Encoder, window: int = WINDOW):
        self.full, self.window = encoder.full, window
        self.stops = encoder.ends.copy()
        for token in encoder.full.get_added_tokens_decoder():
            self.stops[token] = True
        self.nodes: list[tuple[int, str, np.ndarray]] = []

    def add(self, text: str, ids: np.ndarray) -> None:
        """The next part; nodes of as many parts become one."""
        self.nodes.append((1, text, ids))
        while len(self.nodes) > 1 and self.nodes[-1][0] >= self.nodes[-2][0]:
            self._join()

    def finish(self) -> np.ndarray:
        """The ids of the whole text; the tree is empty again."""
        while len(self.nodes) > 1:
            self._join()
        return self.nodes.pop()[2] if self.nodes else np.array([], "i4")

    def _join(self) -> None:
        (n, left, a), (m, right, b) = self.nodes[-2:]
        self.nodes[-2:] = [(n + m, left + right, self.concatenate(left, a, right, b))]

    def _shares(self, ids: np.ndarray) -> bool:
        return len(ids) >= RUN or bool(self.stops[ids].any())

    def concatenate(self, left: str, a: np.ndarray, right: str, b: np.ndarray) -> np.ndarray:
        """The ids of ``left + right`` from those of both."""
        size = self.window
        while True:
            tail, head = left[-size:], right[:size]
            before, after, both = (np.array(e.ids, "i4") for e in self.full.encode_batch([tail, head, tail + head], add_special_tokens=False))
            start, stop = self._agreed(a, before, both), self._agreed(b[::-1], after[::-1], both[::-1])
            # a window that is the whole node needs no agreement
            start = (0, 0) if size >= len(left) else start
            stop = (0, 0) if size >= len(right) else stop
            if start and stop and start[1] + stop[1] <= len(both):
                return np.concatenate([a[: start[0]], both[start[1] : len(both) - stop[1]], b[len(b) - stop[0] :]])
            size *= 2

    def _agreed(self, node: np.ndarray, window: np.ndarray, both: np.ndarray) -> tuple[int, int] | None:
        """How many of the node's and of the double window's first ids stand for the same text, if what node, window and double window share suffices."""
        shared, last = len(window) - _common(node[::-1], window[::-1]), _common(window, both)
        return (len(node) - len(window) + last, last) if shared < last and self._shares(window[shared:last]) else None


class Decoder:
    """Texts of ids, as the file's own ``decode`` gives them with special tokens kept."""

    def __init__(self, encoder: Encoder):
        self.full = encoder.full
        size = self.full.get_vocab_size()
        self.size, self.table = size, None
        if self.full.decoder is None:  # tokens are joined by spaces
            self.table = pa.array([(self.full.id_to_token(i) or "").encode() + b" " for i in range(size)], pa.large_binary())

    def texts(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of the ids between neighbouring offsets; ids that the file doesn't have say nothing."""
        if self.table is None or len(ids) and not (ids.min() >= 0 and ids.max() < self.size):
            told = (ids[i:j] for i, j in zip(offsets, offsets[1:], strict=False))
            return [self.full.decode(x[(x >= 0) & (x < self.size)].tolist(), skip_special_tokens=False) for x in told]
        spelt = self.table.take(pa.array(ids))
        data, cut = spelt.buffers()[2], _offsets(spelt)[offsets].tolist()
        return [data[i : j - 1].to_pybytes().decode() if j > i else "" for i, j in zip(cut, cut[1:], strict=False)]


def _schema(id_col: str, kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(id_col, kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])


def _rows(keys: pa.Array, ids: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    n = np.array([len(x) for x in ids], "i8")
    flat = np.concatenate(ids).astype("i4") if ids else np.array([], "i4")
    return pa.RecordBatch.from_arrays([keys, pa.array(n), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(flat))], names=names)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, leaf: int = LEAF, window: int = WINDOW) -> DataFrame:
    """One row per row: id, n_tokens, ids, by the tokenizers file at ``path`` (every executor can read it) without its extra tokens.

    Null and empty texts have no ids. Repeated rows and rows without an id are encoded
    each; an empty table gives no rows. Trees need a file whose words have ends and whose
    white space goes; by any other file each text is encoded in one piece.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = _schema(id_col, rows.schema["id"].dataType)
    path = path or default_path()
    splits = Encoder.shared(path).pattern is not None
    kind = to_arrow_type(rows.schema["id"].dataType)
    is_long = F.coalesce(F.length("text") > leaf, F.lit(False)) if splits else F.lit(False)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.shared(path)
        for batch in (b for big in batches for b in _slices(big, "text", TEXT_ROWS, TEXT_BYTES)):
            yield _rows(batch.column("id"), [np.frombuffer(x, encoder.dtype) for x in encoder.encode(batch.column("text").to_pylist())], schema.names)

    short = rows.where(~is_long).mapInArrow(whole, schema)
    if not splits:
        return short
    part_schema = T.StructType([T.StructField("key", T.LongType()), rows.schema["id"], T.StructField("at", T.IntegerType()), T.StructField("text", T.StringType())])
    node_schema = T.StructType([*part_schema, T.StructField("ids", T.BinaryType())])

    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for big in batches for b in _slices(big, "text", 256, TEXT_BYTES)):
            parts = [halves(t, leaf) for t in batch.column("text").to_pylist()]
            where = pa.array(np.repeat(np.arange(len(parts)), [len(p) for p in parts]))
            order = pa.array([i for p in parts for i in range(len(p))], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("key").take(where), batch.column("id").take(where), order, pa.array([x for p in parts for x in p], pa.string())], names=part_schema.names)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.shared(path)
        for batch in (b for big in batches for b in _slices(big, "text", TEXT_ROWS, TEXT_BYTES)):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(encoder.encode(batch.column("text").to_pylist()), pa.binary())], names=node_schema.names)

    def concatenate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        encoder = Encoder.shared(path)
        tree = Tree(encoder, window)
        parts = (row for big in batches for b in _slices(big, "text") for row in zip(*(b.column(c).to_pylist() for c in ("key", "id", "text", "ids")), strict=True))
        for (_, doc), nodes in groupby(parts, itemgetter(0, 1)):
            for _, _, text, ids in nodes:
                tree.add(text, np.frombuffer(ids, encoder.dtype).astype("i4"))
            yield _rows(pa.array([doc], kind), [tree.finish()], schema.names)

    parts = rows.where(is_long).select(F.monotonically_increasing_id().alias("key"), "id", "text").mapInArrow(halve, part_schema)
    nodes = parts.repartition("key", "at").mapInArrow(leaves, node_schema)
    return short.unionByName(nodes.repartition("key").sortWithinPartitions("key", "at").mapInArrow(concatenate, schema))


def decode(tokens: DataFrame, ids_col: str = "ids", text_col: str = "decoded", path: str | None = None) -> DataFrame:
    """The rows with the text of their ids; null ids give null, and ids that the file doesn't have say nothing."""
    schema = T.StructType([*tokens.schema, T.StructField(text_col, T.StringType())])
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(Encoder.shared(path))
        for big in batches:
            for at in range(0, big.num_rows, 256):
                batch = big.slice(at, 256)
                ids = batch.column(ids_col)
                offsets = np.asarray(ids.offsets)
                flat = ids.values.slice(offsets[0], offsets[-1] - offsets[0]).fill_null(-1).to_numpy()
                texts = decoder.texts(flat, offsets - offsets[0])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string(), mask=np.asarray(ids.is_null()))], names=schema.names)

    return tokens.mapInArrow(run, schema)
