"""Writing encoded pages: Parquet, or one file for each page through a data source of our own.

Pages are published in two phases. A task writes into a folder of its own below a staging
folder; only when all tasks are done the driver moves what they report to its place, and
removes the staging folder with all that failed or repeated attempts left. A job that
fails publishes nothing. A stream does so for each batch, and keeps a mark for each batch
it has published, so one that is run again after a crash is published once.
"""

from __future__ import annotations

import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery

STAGING, MARKS = "_staging", "_batches"
#: Files moved at once.
MOVERS = 16


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: its folder, and the pages' names in it."""

    folder: str
    names: list[str] = field(default_factory=list)
    size: int = 0


class _Pages:
    """Names, staging and publishing, for batches and streams alike."""

    def __init__(self, options: dict):
        self.base, self.suffix, self.root = options["path"].rstrip("/"), options.get("suffix", ".jb2"), options.get("root", "")
        self.job = uuid.uuid4().hex

    def _at(self):
        """The file system and the folder in it."""
        from pyarrow import fs

        if "://" in self.base:
            return fs.FileSystem.from_uri(self.base)
        return fs.LocalFileSystem(), self.base.removeprefix("file:")

    def _name(self, img_id: str) -> str:
        """The path of a page below the root, or the whole path without scheme and host."""
        path = unquote(re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", img_id)).strip("/")
        root = unquote(re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", self.root)).strip("/")
        if root and not path.startswith(root + "/"):
            raise ValueError(f"{img_id} doesn't lie below {self.root}")
        parts = path[len(root) + 1 if root else 0 :].split("/")
        if not all(parts) or ".." in parts or parts[0] in (STAGING, MARKS):
            raise ValueError(f"{img_id} names no file")
        return "/".join(parts) + self.suffix

    def write(self, rows) -> Written:
        system, base = self._at()
        out, made = Written(f"{STAGING}/{self.job}/{uuid.uuid4().hex}"), set()
        for row in rows:
            if row["code"] is None:
                continue
            name = self._name(row["img_id"])
            path = f"{base}/{out.folder}/{name}"
            if (folder := path.rsplit("/", 1)[0]) not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            with system.open_output_stream(path) as stream:
                stream.write(bytes(row["code"]))
            out.names.append(name)
            out.size += len(row["code"])
        return out

    def _publish(self, messages) -> None:
        """Move the pages of all tasks to their places. Two pages of one name fail before anything moves."""
        system, base = self._at()
        moves = [(f"{base}/{m.folder}/{name}", f"{base}/{name}") for m in messages if m is not None for name in m.names]
        if len({to for _, to in moves}) < len(moves):
            raise ValueError("two pages have one name")
        for folder in {to.rsplit("/", 1)[0] for _, to in moves}:
            system.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(MOVERS) as pool:
            list(pool.map(lambda m: system.move(*m), moves))
        self._clear()

    def _clear(self) -> None:
        """Remove what this job staged, and the staging folder if no other job uses it."""
        from pyarrow import fs

        system, base = self._at()
        for folder in (f"{base}/{STAGING}/{self.job}", f"{base}/{STAGING}"):
            there = system.get_file_info(folder).type == fs.FileType.Directory
            if there and (folder.endswith(self.job) or not system.get_file_info(fs.FileSelector(folder))):
                system.delete_dir(folder)


class _Writer(_Pages, DataSourceWriter):
    def commit(self, messages) -> None:
        self._publish(messages)

    def abort(self, messages) -> None:
        self._clear()


class _StreamWriter(_Pages, DataSourceStreamWriter):
    """Marks lie below the sink's folder by the stream's ``stream`` option, so several streams can share it."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.stream = options.get("stream", "0")

    def commit(self, messages, batchId) -> None:  # noqa: N803
        from pyarrow import fs

        system, base = self._at()
        mark = f"{base}/{MARKS}/{self.stream}/{batchId}"
        if system.get_file_info(mark).type == fs.FileType.File:
            self._clear()
            return
        self._publish(messages)
        system.create_dir(mark.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(mark) as out:
            out.write(str(sum(len(m.names) for m in messages if m is not None)).encode())

    def abort(self, messages, batchId) -> None:  # noqa: N803
        self._clear()


class PageFiles(DataSource):
    """``df.write.format("page_files").mode("append").option("path", …)``, or ``writeStream``: img_id below ``root`` names the file; rows in error are left out."""

    @classmethod
    def name(cls) -> str:
        return "page_files"

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return _Writer(self.options)

    def streamWriter(self, schema, overwrite) -> DataSourceStreamWriter:  # noqa: N802
        return _StreamWriter(self.options)


def _qualified(spark: SparkSession, path: str) -> str:
    """A path without a scheme in the session's own file system."""
    if "://" in path:
        return path
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return whole.removeprefix("file:") if whole.startswith("file:") else whole


def write_pages(pages: DataFrame, path: str, suffix: str = ".jb2", root: str = "") -> None:
    """One file for each page, in folders as below ``root`` (without it, as in the whole of img_id), so no two pages share a name; all pages, or none if a task fails.

    The folder is one that all executors see, or in a store pyarrow knows; a path without a
    scheme lies in the session's own file system. A page outside ``root`` fails the write,
    as do two pages of one name. A page written before under the same name is replaced.
    """
    register(pages.sparkSession)
    pages.select("img_id", "code").write.format("page_files").mode("append").option("path", _qualified(pages.sparkSession, path)).option("suffix", suffix).option("root", root).save()


def stream_pages(pages: DataFrame, path: str, checkpoint: str, suffix: str = ".jb2", root: str = "", stream: str = "0", once: bool = True) -> StreamingQuery:
    """The same for a stream of pages, batch by batch; ``stream`` names it among those that write to the folder. ``once`` stops when what is there is done."""
    register(pages.sparkSession)
    writer = pages.select("img_id", "code").writeStream.format("page_files").option("checkpointLocation", checkpoint)
    for key, value in (("path", _qualified(pages.sparkSession, path)), ("suffix", suffix), ("root", root), ("stream", stream)):
        writer = writer.option(key, value)
    return (writer.trigger(availableNow=True) if once else writer).start()


def write_table(pages: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet with the pages as binary."""
    pages.write.mode(mode).parquet(path)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageFiles)
