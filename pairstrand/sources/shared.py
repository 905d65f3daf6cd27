"""Tables in the folder that the driver and every executor share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where that is unset and all runs on one machine, as in tests, a temporary folder is made and put into the session.
    Executors elsewhere wouldn't see it, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str, block_mb: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it again.

    This cuts the lineage and survives the loss of executors. block_mb: size of the file's row groups, which a task holds in
    memory while it writes. Tables that are ``dealt`` stay so.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession, kind)
    if hasattr(df, "_keys"):
        name = path.rsplit("/", 1)[1].replace("-", "_")
        df.write.format("parquet").bucketBy(shuffle_partitions(spark), *df._keys).option("path", path).saveAsTable(name)
        out = spark.table(name)
        out._written_path, out._table = path, name
        return out
    writer = df.write.option("parquet.block.size", block_mb << 20) if block_mb else df.write
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def bucketed(df: DataFrame, kind: str, keys: list[str], distinct: bool = False) -> DataFrame:
    """Like ``written``, for a table that meets others again and again by the same keys: dealt into buckets by these, so that a join by
    just these keys shuffles the other side only. With ``distinct``, each row once."""
    rows = df.repartition(shuffle_partitions(df.sparkSession), *keys)
    return written(dealt(rows.distinct() if distinct else rows, keys), kind)


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mark rows whose tasks hold them by these keys: ``written`` puts them into buckets."""
    df._keys = keys
    return df


def forget(*tables: DataFrame) -> None:
    """Delete tables of ``written`` and ``bucketed`` that nothing will read again; other DataFrames are left alone."""
    for df in tables:
        path = getattr(df, "_written_path", None)
        if path:
            if hasattr(df, "_table"):
                df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._table}")
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
