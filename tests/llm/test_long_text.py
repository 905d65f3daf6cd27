"""One text of 70 MB through the operators that take texts of any length."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairstrand.llm import fingerprints, substring_dedup, tokens, warc
from pairstrand.llm.settings import VOCABULARY
from pairstrand.sources.shared import written

SIZE = 70_000_000


def prose(n, seed):
    rng = np.random.default_rng(seed)
    stock = np.array([bytes(rng.integers(97, 123, rng.integers(3, 9)).astype(np.uint8)).decode() for _ in range(20_000)], object)
    return (" ".join(stock[rng.integers(0, len(stock), n // 5)]))[:n]


@pytest.fixture(scope="module")
def long(spark):
    text, passage = prose(SIZE, 1), prose(450, 2)
    text = text[:30_000_000] + "<" + passage + ">" + text[30_000_000:60_000_000] + "é漢" + text[60_000_000:]
    rows = [(1, text), (2, f"own [{passage}] end"), (3, None)]
    return text, passage, written(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "long-text")


def test_repeated_passage(long):
    text, passage, df = long
    got = {r["doc_id"]: r for r in substring_dedup.removals(df).drop("text").collect()}
    assert [(got[i]["n_removed"], got[i]["n_spans"]) for i in (1, 2, 3)] == [(450, 1), (450, 1), (0, 0)]
    assert got[1]["kept_sha256"] == hashlib.sha256(text.replace(passage, "", 1).encode()).hexdigest()


def test_round_trip(long):
    text, _, df = long
    got = {r["doc_id"]: r["decoded_sha256"] for r in tokens.round_trip(df, VOCABULARY).collect()}
    assert got[1] == hashlib.sha256(text.encode()).hexdigest()


def test_archives(long):
    text, _, df = long
    pages = df.select(F.col("doc_id").alias("page_id"), F.lit("http://x/").alias("url"), F.col("text").alias("html"))
    pages = pages.union(pages.select(F.col("page_id") + 10, "url", "html"))
    got = {r["page_id"]: r for r in warc.read_archives(warc.resolve_revisits(warc.write_responses(pages))).collect()}
    assert (got[11]["record_type"], got[11]["refers_to"], got[1]["payload_bytes"]) == ("revisit", 1, len(text.encode()))


def test_fingerprints(long):
    text, _, df = long
    got = {r["doc_id"]: r for r in fingerprints.successive(df).collect()}
    half = len(text) // 2
    assert got[1]["n_chars"] == len(text) and got[1]["shared_edited"] == len(text) - half and 0.4 < got[1]["near_edited"] < 0.6
