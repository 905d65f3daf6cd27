"""Token files, separator scans, WARC archives: round trips."""

import base64
import gzip
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from pairstrand.llm import tokens, warc
from pairstrand.llm.settings import END_ID, SEPARATOR_ID, VOCABULARY, VOCABULARY_SIZE


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def ids_of(library, text):
    return library.encode("" if text is None else text, add_special_tokens=False).ids


@pytest.mark.parametrize("by_library", [False, True])
def test_token_files(plain_docs, library, by_library):
    rows = sorted((r["doc_id"], r["text"]) for r in plain_docs.collect())
    files = tokens.write_token_files(plain_docs, VOCABULARY, END_ID, VOCABULARY_SIZE, library=by_library)
    want, start = {}, 0
    for i, t in rows:
        ids = [*ids_of(library, t), END_ID]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = tokens.read_token_files(files, VOCABULARY_SIZE).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in got} == want
    assert sum(r["n_ids"] for r in files.collect()) == start


def test_token_files_odd(docs, no_docs):
    got = tokens.read_token_files(tokens.write_token_files(docs, VOCABULARY, END_ID, VOCABULARY_SIZE), VOCABULARY_SIZE).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in docs.collect())
    ends = sorted((r["start"], r["start"] + r["n_tokens"]) for r in got)
    assert all(a[1] == b[0] for a, b in zip(ends[:-1], ends[1:], strict=True)) and ends[0][0] == 0
    assert tokens.read_token_files(tokens.write_token_files(no_docs, VOCABULARY, END_ID, VOCABULARY_SIZE), VOCABULARY_SIZE).count() == 0


def test_token_files_roll(docs, monkeypatch):
    want = Counter(map(tuple, tokens.read_token_files(tokens.write_token_files(docs, VOCABULARY, END_ID, VOCABULARY_SIZE), VOCABULARY_SIZE).collect()))
    monkeypatch.setattr(tokens, "TOKEN_FILE_IDS", 100)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = docs.sparkSession.conf.get(name)
    docs.sparkSession.conf.set(name, 2)
    files = tokens.write_token_files(docs, VOCABULARY, END_ID, VOCABULARY_SIZE)
    docs.sparkSession.conf.set(name, rows)
    assert files.where("piece > 0").count() > 0
    assert Counter(map(tuple, tokens.read_token_files(files, VOCABULARY_SIZE).collect())) == want


def test_wide_ids(plain_docs):
    files = tokens.write_token_files(plain_docs.limit(5), VOCABULARY, 70_000, 70_001)
    assert tokens.read_token_files(files, 70_001).count() == 5


def test_separator_scan(docs, no_docs, library, monkeypatch):
    monkeypatch.setattr(tokens, "SCAN_BLOCK", 7)
    files, names = tokens.write_flat_files(docs, VOCABULARY, SEPARATOR_ID, SEPARATOR_ID + 1)
    got = tokens.scan_separators(files, SEPARATOR_ID, SEPARATOR_ID + 1).join(names, "doc_no").collect()
    want = Counter((r["doc_id"], len(ids_of(library, r["text"])) + 1) for r in docs.collect())
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == want
    assert all(r["ended"] for r in got)
    assert sorted(r["doc_no"] for r in got) == list(range(docs.count()))
    empty, _ = tokens.write_flat_files(no_docs, VOCABULARY, SEPARATOR_ID, SEPARATOR_ID + 1)
    assert tokens.scan_separators(empty, SEPARATOR_ID, SEPARATOR_ID + 1).count() == 0


def test_separator_scan_stitches_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "SCAN_BLOCK", 4)
    rng = np.random.default_rng(7)
    ids = np.where(rng.random(500) < 0.08, 9, 1).astype("<u2")
    ids[120:300] = 1  # a document that fills whole files
    ids[-3:] = 1
    rows = []
    for k, lo in enumerate(range(0, 500, 37)):
        path = f"file://{tmp_path}/{k}.bin"
        tokens.put(path, ids[lo : lo + 37])
        rows.append((0, k, path, len(ids[lo : lo + 37])))
    files = spark.createDataFrame(rows, "stream long, piece long, path string, n_ids long")
    got = sorted((r["doc_no"], r["start"], r["n_tokens"], r["ended"]) for r in tokens.scan_separators(files, 9, 10).collect())
    ends = np.flatnonzero(ids == 9)
    starts = np.append(0, ends + 1)
    want = [(k, int(a), int(b - a + 1), True) for k, (a, b) in enumerate(zip(starts, ends, strict=False))]
    want.append((len(ends), int(starts[-1]), int(500 - starts[-1]), False))
    assert got == want


PAGES = "page_id long, url string, html string, id string, body string, path string, size long"


def pages(spark):
    rows = [
        (5, "http://a/ b", "<p>x</p>"), (3, "http://a/ü", "<p>x</p>"), (9, None, None), (4, "u\r\nInjected: 1", ""), (7, "http://c", "é" * 30_000), (None, "http://d", "<p>x</p>"), (None, "http://e", "only"), (3, "http://a/ü", "<p>x</p>"),
        (8, "http://f", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"),
    ]
    return spark.createDataFrame([(*r, "i", "b", "p", 1) for r in rows], PAGES)


@pytest.mark.parametrize("least", [0, 5])
def test_warc(spark, least):
    df = pages(spark).repartition(2)
    groups = defaultdict(list)
    for r in df.collect():
        groups[r["html"] or ""].append(r["page_id"])
    want = Counter()
    for r in df.collect():
        raw = (r["html"] or "").encode()
        first = min((i for i in groups[r["html"] or ""] if i is not None), default=None)
        revisit = len(raw) >= least and first is not None and r["page_id"] != first
        want[(r["page_id"], len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first if revisit else None)] += 1
    got = warc.read_archives(warc.resolve_revisits(warc.write_responses(df), least))
    assert Counter(tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == want


def test_warc_revisits_keep_long_urls(spark):
    url = "http://a/" + "x" * 200_000
    df = spark.createDataFrame([(1, "http://b", "<p>x</p>"), (2, url, "<p>x</p>")], "page_id long, url string, html string")
    files = warc.resolve_revisits(warc.write_responses(df.coalesce(1))).collect()
    found = {}
    for r in files:
        with gzip.open(r["path"].removeprefix("file://")) as stream:
            found |= {head["page-id"]: (head["warc-type"], head["warc-target-uri"]) for head, _ in warc.parse(stream)}
    assert found == {"1": ("response", "http://b"), "2": ("revisit", url)}


def test_warc_record_ids_are_all_different(spark):
    """Rows without id, and rows that share one: each record has its own id, and revisits name records that have the payload."""
    files = warc.resolve_revisits(warc.write_responses(pages(spark).repartition(2))).collect()
    records = []
    for r in files:
        with gzip.open(r["path"].removeprefix("file://")) as stream:
            records += list(warc.parse(stream))
    ids = [head["warc-record-id"] for head, _ in records]
    assert len(set(ids)) == len(ids) == 9
    payloads = {head["warc-record-id"]: head["warc-payload-digest"] for head, _ in records if head["warc-type"] == "response"}
    revisits = [head for head, _ in records if head["warc-type"] == "revisit"]
    assert revisits and all(payloads[x["warc-refers-to"]] == x["warc-payload-digest"] for x in revisits)


def test_warc_of_nothing(spark):
    none = spark.createDataFrame([], PAGES)
    assert warc.read_archives(warc.resolve_revisits(warc.write_responses(none))).count() == 0


def test_warc_files_rotate(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1)
    headers = warc.write_responses(pages(spark).coalesce(1))
    assert headers.select("path").distinct().count() == 9
    assert warc.read_archives(warc.resolve_revisits(headers)).count() == 9
