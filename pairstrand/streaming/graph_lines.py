"""Graph files that arrive one by one: the scans of ``sources.formats`` as append-only streams.

Each new file of a folder is read once; its lines become segments and links as they come, and a sink keeps them as Parquet
with a checkpoint in the shared folder, so a stream that is started again goes on where it ended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairstrand.sources import formats
from pairstrand.sources.shared import new_folder


def lines(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Lines of the folder's files, split into fields."""
    return formats.fields(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder))


def segments(split: DataFrame, depth: int = 1) -> DataFrame:
    return formats.scan_gfa_s(split, depth)


def links(split: DataFrame) -> DataFrame:
    return formats.scan_gfa_l(split)


def segment_totals(split: DataFrame) -> DataFrame:
    """Number and total length of the segments so far (complete or update mode)."""
    return segments(split).groupBy().agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("total_length"))


def append_to(stream: DataFrame, path: str, checkpoint: str | None = None) -> StreamingQuery:
    """Write what has arrived to Parquet and stop; call again, with the same checkpoint, for what is new."""
    where = checkpoint or new_folder(stream.sparkSession, "stream")
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", where).outputMode("append").trigger(availableNow=True).start()
