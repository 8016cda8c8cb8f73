"""Reading many files of unlike sizes in tasks of like sizes.

A file of an image can't be split, so a task's share is planned from the files' lengths
before any is read: the largest file first, each to the task that has least so far. Names
and lengths come from Spark's own listing, which the driver holds anyway.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .images import FILES
from .sniff import sniff

#: Bytes that opening a file counts for, so tasks don't fill up with very small ones.
OPEN = 64 * 1024


def deal(sizes: list[int], tasks: int, fixed: int = OPEN) -> list[list[int]]:
    """Which files each task takes: the largest first, to the task with least so far (ties: the first). Tasks without a file are left out."""
    free = [(0, k) for k in range(tasks)]
    out: list[list[int]] = [[] for _ in range(tasks)]
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        held, k = heapq.heappop(free)
        out[k].append(i)
        heapq.heappush(free, (held + sizes[i] + fixed, k))
    return [files for files in out if files]


@dataclass
class Share(InputPartition):
    """The files of one task."""

    paths: list[str]


class _Reader(DataSourceReader):
    def __init__(self, shares: list[list[str]]):
        self.shares = shares

    def partitions(self) -> list[Share]:
        return [Share(paths) for paths in self.shares] or [Share([])]

    def read(self, partition: Share):
        from pyarrow import fs

        for path in partition.paths:
            system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
            told = system.get_file_info(at)
            with system.open_input_stream(at) as stream:
                content = stream.read()
            changed = datetime.fromtimestamp((told.mtime_ns or 0) / 1e9, timezone.utc)
            yield path, changed, len(content), content


def read_balanced(spark: SparkSession, path: str | list[str], tasks: int | None = None, glob: str | None = None, most_bytes: int | None = None) -> DataFrame:
    """What ``read_files`` gives, by ``tasks`` tasks (as many as the session runs at once) of nearly equal bytes, the largest files first.

    A file larger than a task's share is a task of its own. ``most_bytes`` leaves larger
    files out before they are dealt. A folder without files gives no rows.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    listed = (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "length")
    if most_bytes is not None:
        listed = listed.where(F.col("length") <= most_bytes)
    found = listed.orderBy("path").collect()
    shares = [[found[i]["path"] for i in share] for share in deal([r["length"] for r in found], tasks or spark.sparkContext.defaultParallelism)]

    class BalancedFiles(DataSource):
        @classmethod
        def name(cls) -> str:
            return "balanced_files"

        def schema(self) -> str:
            return FILES

        def reader(self, schema) -> DataSourceReader:
            return _Reader(shares)

    spark.dataSource.register(BalancedFiles)
    return spark.read.format("balanced_files").load().withColumn("format", sniff(F.col("content"), F.col("length")))
