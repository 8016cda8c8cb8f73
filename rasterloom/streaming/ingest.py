"""Continuous conversion of a folder of images."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.pipeline import Options, convert_files
from ..sources.images import stream_files


def convert_stream(spark: SparkSession, path: str, options: Options = Options(), glob: str | None = None) -> DataFrame:
    """A stream of encoded pages; stateless, so it needs neither watermark nor state store."""
    return convert_files(stream_files(spark, path, glob), options.check())


def ingest(spark: SparkSession, path: str, out: str, checkpoint: str, options: Options = Options(), glob: str | None = None, once: bool = True) -> StreamingQuery:
    """Write pages to Parquet as files arrive, each once; ``once`` stops when what is there is done."""
    writer = convert_stream(spark, path, options, glob).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
