"""What the corpus operators share: inputs, and ids and texts as they take them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairstrand.sources.shared import forget, new_folder, shared_dir, shuffle_partitions, written

__all__ = ["NO_ID", "forget", "keyed", "named", "new_folder", "shared_dir", "shuffle_partitions", "slices", "table", "written"]

#: Stands for a null id inside Python code, where a null would turn all ids of a batch into floats.
NO_ID = -(2**63)


#: Rows, and bytes, that Spark hands to Python at once: texts can be long, and a batch is held several times over.
BATCH_ROWS, BATCH_BYTES = 1000, 8_000_000


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers in this session; Spark reads these settings when a plan runs, so they stay set."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        found = spark.conf.get(f"spark.sql.execution.arrow.{name}").rstrip("bB")
        if not (found.isdigit() and 0 < int(found) <= most):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", most)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the input tables."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator needs, under names of its own: id (NO_ID for null) and body (null is empty)."""
    small_batches(docs.sparkSession)
    return docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("body"))


def named(df: DataFrame, id_col: str, column: str = "id") -> DataFrame:
    """Undo ``keyed``: the id's own name, and null where there was none."""
    return df.withColumn(column, F.nullif(F.col(column), F.lit(NO_ID))).withColumnRenamed(column, id_col)


def slices(batches: Iterator[pd.DataFrame], column: str, size: int) -> Iterator[pd.DataFrame]:
    """Batches cut into rows whose values in ``column`` have at most ``size`` bytes (or characters) together, or into single rows."""
    for rows in batches:
        first, held = 0, 0
        for k, n in enumerate(map(len, rows[column])):
            if held and held + n > size:
                yield rows[first:k]
                first, held = k, 0
            held += n
        if first < len(rows):
            yield rows[first:]
