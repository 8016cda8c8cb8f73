"""Tables that cut lineage, kept in the folder that driver and executors share.

Every table is written to a fresh folder below ``spark.checkpoint.dir`` and read
back, so a lost executor costs a re-read, never a recomputation of the stage.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = "spark.checkpoint.dir"
_made: dict[str, list[str]] = {}
#: The folder of each application that has none set; a session's checkpoint folder can't be set once it runs.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset in local mode (tests), a temporary folder."""
    path = spark.conf.get(_KEY, None)
    if not path:
        master, key = spark.sparkContext.master, spark.sparkContext.applicationId
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set {_KEY} to a folder that all executors see")
        path = _own[key] if key in _own else _own.setdefault(key, "file://" + tempfile.mkdtemp(prefix="rasterloom-"))
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder; nothing is written yet."""
    path = f"{shared_dir(spark)}/rasterloom-{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stage_table(df: DataFrame, name: str, codec: str = "zstd", by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, in a folder for each value of ``by``, and return a reader of the written table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", codec)
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of one key that a task gets at most; what has more is dealt over several.
SPLIT = 1_024
#: Most keys with more rows than that which are broadcast; beyond it they are joined by a shuffle.
MOST_SPLIT = 200_000


def join_split(rows: DataFrame, side: DataFrame, key: str, spread_by: str, counted: DataFrame | None = None) -> DataFrame:
    """``rows.join(side, key)`` where ``side`` has few rows for each key and any key may have very many ``rows``.

    Keys with more than ``SPLIT`` rows are dealt over several tasks by a hash of
    ``spread_by``, and each gets a copy of the side's row; others are joined as they are.
    ``counted`` is a written table to count keys in, where ``rows`` would be computed for it.
    """
    often = (rows if counted is None else counted).groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > SPLIT)
    n = often.count()
    if not n:
        return rows.join(side, key)
    often = stage_table(often.select(key, F.ceil(F.col("__n") / SPLIT).cast("int").alias("__parts")), "often", "snappy")
    often = F.broadcast(often) if n <= MOST_SPLIT else often
    parts = F.coalesce("__parts", F.lit(1))
    dealt = rows.join(often, key, "left").withColumn("__part", F.pmod(F.xxhash64(spread_by), parts).cast("int")).drop("__parts")
    copies = side.join(often, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return dealt.join(copies, [key, "__part"]).drop("__part")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem in taken:
        stem += "_"
    return stem


def trim() -> None:
    """Give memory that a Python worker has freed back to the system; workers live on from task to task."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove one folder through the file system that owns it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_table(df: DataFrame) -> None:
    """Delete a table made by ``stage_table``; its readers are invalid afterwards."""
    for folder in {re.sub(r"(/rasterloom-[^/]+)/.*", r"\1", f) for f in df.inputFiles() if "/rasterloom-" in f}:
        delete_path(df.sparkSession, folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables staged inside when it is left, but for those passed to the function it gives."""
    key = spark.sparkContext.applicationId
    before, kept = len(_made.get(key, ())), set()

    def keep(df: DataFrame) -> DataFrame:
        files = df.inputFiles()
        kept.update(p for p in _made[key][before:] if any(p.rsplit("/", 1)[1] in f for f in files))
        return df

    try:
        yield keep
    finally:
        made = _made.get(key, [])
        for path in [p for p in made[before:] if p not in kept]:
            delete_path(spark, path)
            made.remove(path)


def release(spark: SparkSession) -> int:
    """Delete every table this application staged; call it when results are saved."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        delete_path(spark, path)
    return len(paths)
