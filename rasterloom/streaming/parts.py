"""Files that arrive in parts: a stream that keeps files apart puts the parts in order and gives each file out once, when it is whole.

A part says which file it belongs to, its number (from 0) and how many parts there are.
The state of a file is the parts met so far; parts may come in any order, in any micro-batch
and more than once. Files are dealt over buckets by a hash of the path, and the stream is
keyed by these: a call of Python for each file and micro-batch took milliseconds, however
little the file had. Time is what the parts' own ``arrived`` column says: a file from which
nothing has come while the stream went on for the time-out is given out with an error. One
that was given out is remembered for as long, so late copies of its parts don't give it
out again; what is later still is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import schemas

PARTS = "path string, seq int, parts int, content binary, arrived timestamp"
FILE = T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.BinaryType()), T.StructField("error", schemas.ERROR)])
_STATE = "paths array<string>, counts array<int>, dones array<boolean>, lasts array<bigint>, seqs array<array<int>>, contents array<array<binary>>"
#: Keys of the stream's state: enough to deal over many tasks, few enough calls of Python in a micro-batch. What runs from a checkpoint must keep to its number.
BUCKETS = 4_096
#: Bytes of whole files that a bucket gives out in one piece.
ANSWER_BYTES = 16 << 20


@dataclass
class _File:
    """What is known of a file: its parts by number, how many there are, whether it was given out, the time of the last part."""

    count: int
    done: bool
    last: int
    held: dict[int, bytes]


def _answers(found: Iterator[tuple[str, bytes | None, str | None]]) -> Iterator[pd.DataFrame]:
    """Rows of path, content and error from path, content and message."""
    rows, size = [], 0
    for path, content, msg in found:
        rows.append((path, content, None if msg is None else {"code": schemas.READ, "msg": msg}))
        size += len(content or b"")
        if size >= ANSWER_BYTES:
            yield pd.DataFrame(rows, columns=FILE.names, dtype=object)
            rows, size = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=FILE.names, dtype=object)


def assemble(parts: DataFrame, timeout: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """A stream of whole files (path, content, error) from a stream of parts (path, seq, parts, content, arrived).

    A part without a path, number, count, content or time, or with a number outside its file's
    count, is ignored; parts that disagree about the count make the file an error at the
    time-out unless the first count is met. A bucket's state is written anew whenever one of
    its files gets a part; more ``buckets`` make it smaller.
    """

    def met(files: dict[str, _File], batches: Iterator[pd.DataFrame], now: int, came: set[str]) -> Iterator[tuple[str, bytes | None, str | None]]:
        for batch in batches:
            for path, seq, n, content, at in zip(*(batch[c].tolist() for c in ("path", "seq", "parts", "content", "ms")), strict=True):
                file = files.get(path)
                if file is None:
                    file = files[path] = _File(int(n), False, now, {})
                file.last = max(file.last if path in came else now, int(at))
                came.add(path)
                if not file.done and int(n) == file.count and int(seq) < file.count:
                    file.held.setdefault(int(seq), bytes(content))
        for path in came:
            file = files[path]
            if not file.done and len(file.held) == file.count:
                yield path, b"".join(file.held[k] for k in range(file.count)), None
                file.held, file.done = {}, True

    def ended(files: dict[str, _File], now: int, came: set[str]) -> Iterator[tuple[str, bytes | None, str | None]]:
        # the watermark is the time-out behind the latest part of all
        for path in [p for p, f in files.items() if p not in came and f.last + 1 < now]:
            file = files.pop(path)
            if not file.done:
                yield path, None, f"{len(file.held)} of {file.count} parts came"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        files: dict[str, _File] = {}
        if state.exists:
            for path, count, done, last, seqs, contents in zip(*state.get, strict=True):
                files[path] = _File(count, done, last, dict(zip(seqs, contents, strict=True)))
        now, came = state.getCurrentWatermarkMs(), set()
        if not state.hasTimedOut:
            yield from _answers(met(files, batches, now, came))
        yield from _answers(ended(files, now, came))
        if not files:
            state.remove()
            return
        told = files.values()
        state.update((list(files), [f.count for f in told], [f.done for f in told], [f.last for f in told], [list(f.held) for f in told], [list(f.held.values()) for f in told]))
        state.setTimeoutTimestamp(min(f.last for f in told) + 1)

    known = parts.where("path IS NOT NULL AND seq >= 0 AND seq < parts AND content IS NOT NULL AND arrived IS NOT NULL").withWatermark("arrived", timeout)
    dealt = known.withColumn("ms", F.unix_millis("arrived")).withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInPandasWithState(step, FILE, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def join_parts(parts: DataFrame) -> DataFrame:
    """The same for a table of parts: path, content, error; ``arrived`` plays no part."""
    known = parts.where("path IS NOT NULL AND seq >= 0 AND seq < parts AND content IS NOT NULL").dropDuplicates(["path", "seq", "parts"])
    files = known.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", "content"))).alias("held"), F.max("parts").alias("parts"), F.min("parts").alias("least"))
    whole = (F.size("held") == F.col("parts")) & (F.col("parts") == F.col("least"))
    content = F.aggregate("held", F.lit(b""), lambda so_far, x: F.concat(so_far, x["content"]))
    msg = F.concat(F.size("held").cast("string"), F.lit(" of "), F.col("parts").cast("string"), F.lit(" parts came"))
    error = F.when(~whole, F.struct(F.lit(schemas.READ).alias("code"), msg.alias("msg")))
    return files.select("path", F.when(whole, content).alias("content"), error.alias("error"))
