"""The pipeline's stages: each keeps, changes or places documents by one operator.

Documents without id pass the stages as the operators' notes say; a stage never looks at other columns than id and text,
and returns every column it was given. Texts of any length are taken whole, equal rows are treated alike, and an empty table
gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairstrand.llm import exact_dedup, near_dedup, packing, quality, substring_dedup, tokens
from pairstrand.llm.common import NO_ID, table
from pairstrand.llm.settings import PASSAGE, VOCABULARY, quality_forest


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, quality_forest(docs, table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the one with the smallest id stays; documents without id all stay.

    Where an id has several texts, each is taken by itself: one that is no other's near copy stays. Rows equal to the one that
    stays (its id and text) stay too.
    """
    gone = near_dedup.near_texts(docs).where(~F.col("text_stays")).select("id", "md5").distinct()
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    md5 = F.unhex(F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary")))
    rows = docs.select(*(docs[c].alias(n) for c, n in names.items()), F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("id"), md5.alias("md5"))
    return rows.join(gone, ["id", "md5"], "left_anti").select(*(F.col(n).alias(c) for c, n in names.items()))


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose their repeated strings of ``PASSAGE`` bytes; what a cut leaves of a character goes too, and n_chars is
    counted anew.

    Documents of which nothing is left stay, with an empty text; texts that lose nothing, nulls too, stay as they are.
    """
    facts = substring_dedup.losses(docs, PASSAGE)
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    keyed = docs.select(*(docs[c].alias(n) for c, n in names.items()), substring_dedup.text_key(F.coalesce(docs["text"], F.lit(""))).alias("doc"))
    joined = keyed.join(facts.select("doc", "gone", "rest"), "doc", "left")
    changed = F.col("gone").isNotNull()
    back = {c: F.col(n) for c, n in names.items()}
    back["text"] = F.when(changed, F.col("rest")).otherwise(back["text"])
    if "n_chars" in back:
        back["n_chars"] = F.when(changed, F.length("rest").cast(docs.schema["n_chars"].dataType)).otherwise(back["n_chars"])
    return joined.select(*(v.alias(c) for c, v in back.items()))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' ids (with an end id each) in sequences."""
    return packing.pack(tokens.token_lengths(docs, VOCABULARY, extra=1))
