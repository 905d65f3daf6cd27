"""Exact deduplication by content hash, with DataFrame functions only.

Texts are grouped by their 128-bit MD5 *and* their bytes, so texts whose hashes collide stay apart. The grouping
aggregates before its shuffle: of a text that a third of all rows share, each task sends one row. Rows then find their
group again by MD5 and SHA-256 together in a join of narrow columns, whose hot partitions adaptive execution splits.

Defined results: a null text counts as empty; a null id never wins over an id; rows with the same id and the same text
are the same document, so ``exact_groups`` marks them alike and ``drop_copies`` returns one of them; an empty table gives
an empty result; texts of any length are compared whole; other columns of the input, whatever their names, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _text(df: DataFrame, text_col: str) -> Column:
    return F.coalesce(df[text_col].cast("string"), F.lit(""))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    ``keep`` says whether the ``largest`` or the ``smallest`` id of a group stays.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    best = F.max if keep == "largest" else F.min
    rows = docs.select(docs[id_col].alias("id"), _text(docs, text_col).alias("body"))
    hashed = rows.select("id", F.unhex(F.md5("body")).alias("md5"), "body")
    groups = (
        hashed.groupBy("md5", "body")
        .agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("md5", F.unhex(F.sha2("body", 256)).alias("sha"), "keep_id", "group_size")
    )
    narrow = hashed.select("id", "md5", F.unhex(F.sha2("body", 256)).alias("sha"))
    return narrow.join(groups, ["md5", "sha"]).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row of each text, that with the largest id; all columns stay.

    One shuffle: the row that stays is carried through the aggregation.
    """
    rest = [c for c in docs.columns if c != text_col]
    rows = docs.select(
        F.unhex(F.md5(_text(docs, text_col))).alias("md5"),
        _text(docs, text_col).alias("body"),
        F.struct(docs[id_col].alias("i")).alias("order"),
        F.struct(docs[text_col].isNull().alias("missing"), *(docs[c].alias(f"c{i}") for i, c in enumerate(rest))).alias("row"),
    )
    best = rows.groupBy("md5", "body").agg(F.max_by("row", "order").alias("row"))
    back = {c: F.col(f"row.c{i}") for i, c in enumerate(rest)}
    back[text_col] = F.when(~F.col("row.missing"), F.col("body"))
    return best.select(*(back[c].alias(c) for c in docs.columns))
