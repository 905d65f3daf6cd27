"""Removal of long strings that occur more than once, by suffix arrays of shards.

A window is a string of ``length`` bytes of one text. Every byte covered by a window that also begins anywhere else, in the
same text or another, is removed. Windows are judged on the input. Steps:

1. Equal texts of at least ``length`` bytes are all windows repeated, so they are removed whole; one of them stands for all
   in what follows.
2. Long anchors (``anchors``; grams of three fifths of ``length``) of all texts are counted: a window that is repeated has a
   repeated anchor. Only texts with such anchors go on, and of them only windows whose long anchor is repeated.
3. These windows are cut into segments: runs of windows with the same short anchor (grams of four 25ths of ``length``) and the
   bytes they cover. Equal windows have the same short anchor, so only segments of one anchor have to meet. Equal segments
   become one; what lies in several places is repeated as a whole.
4. Segments of an anchor go to one shard. Each shard builds its suffix array by Larsson-Sadakane refinement and common
   prefixes by Kasai's walk.
5. An anchor with more than ``SHARD_BYTES`` of different segments is split over several shards, up to ``SHARDS``, and these
   are merged two by two: the windows of one are searched, by binary search, in the suffix array of the other.
6. An anchor with still more is made longer: each of its windows has half of what it holds besides the anchor on one side of
   it, so the anchor grows by that half, and its segments are cut in two at most. Windows that differ near the anchor part
   ways; at last an anchor is a whole window, and its segments are all equal.
7. Texts' repeated windows are put together, and the covered bytes removed.

Defined results: texts are their UTF-8 bytes; a null text counts as empty; texts under ``length`` bytes lose nothing; ids
may be null or repeated, for rows are told apart by their texts (128 bits of SHA-256, as segments are by 128 bits of BLAKE2);
bytes that a cut leaves of a character are counted as kept, but aren't in ``text``. Texts may have any length that a value of
Spark's can have: they are worked on in stretches that overlap by ``length - 1`` bytes. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairstrand.llm.anchors import anchor_runs
from pairstrand.llm.common import NO_ID, forget, keyed, shuffle_partitions, slices, written
from pairstrand.llm.suffixes import repeated_starts, starts_in_both
from pairstrand.llm.textarrays import CHUNK_BYTES, chunks, mix

LENGTH = 400
#: Bytes of segments that are sorted together, and shards that an anchor is split over at most.
SHARD_BYTES, SHARDS = 250_000, 8
#: Bytes of one text that are worked on at once.
STRETCH = CHUNK_BYTES
#: Bytes of texts of a batch that Python works on at once, and MB of the row groups of tables with whole texts or segments.
SLICE, BLOCK_MB = 2_000_000, 16

RUNS = "hash binary, first array<int>, n array<int>"


def _grams(length: int) -> tuple[int, int]:
    """Lengths of the long and the short anchors."""
    return max(1, length * 3 // 5), max(1, length * 4 // 25)


def _stretches(texts: list[bytes], length: int, stretch: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Texts in chunks, long ones in stretches: for each its text's index and its place in the text, and its bytes.

    A stretch reaches ``length - 1`` bytes into the next one, so each window lies in one and begins in no other.
    """
    cut = [(i, lo, t[lo : lo + stretch + length - 1]) for i, t in enumerate(texts) for lo in range(0, max(1, len(t) - length + 1), stretch)]
    for a, b in chunks([x[2] for x in cut]):
        yield np.array([x[0] for x in cut[a:b]], np.int64), np.array([x[1] for x in cut[a:b]], np.int64), [x[2] for x in cut[a:b]]


def _joined(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and starts of texts, and the places where windows begin."""
    size = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(size) - size
    begins = np.zeros(int(size.sum()) + 1, np.int64)
    long = size >= length
    begins[start[long]] += 1
    begins[start[long] + size[long] - length + 1] -= 1
    return np.frombuffer(b"".join(texts), np.uint8), start, np.cumsum(begins)[:-1] > 0


def _coarse_keys(batches: Iterator[pd.DataFrame], length: int, stretch: int) -> Iterator[pd.DataFrame]:
    """Per text and long anchor: doc, key, occurrence (another number for a second one in the same text).

    Stretches of a text count as different texts here: an anchor at their border may seem to be repeated, which only lets
    more windows go on.
    """
    gram, _ = _grams(length)
    for rows in slices(batches, "body", SLICE):
        texts, docs = [bytes(b) for b in rows["body"]], rows["doc"].to_numpy()
        tag = np.array([int.from_bytes(d[:8], "little") for d in docs], np.uint64)
        for owner, offset, pieces in _stretches(texts, length, stretch):
            data, start, wanted = _joined(pieces, length)
            first, _, key, _ = anchor_runs(data, wanted, length, gram)
            piece = np.searchsorted(start, first, side="right") - 1
            order = np.lexsort((key, piece))
            key, piece = key[order], piece[order]
            new = np.append(True, (np.diff(piece) != 0) | (key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
            second = np.append(False, new[:-1]) & ~new  # the first repetition within a stretch
            keep = new | second
            own = tag[owner] ^ np.where(offset > 0, mix(offset.astype(np.uint64) << np.uint64(1)), np.uint64(0))
            yield pd.DataFrame({"doc": docs[owner[piece[keep]]], "key": key[keep].view(np.int64), "occurrence": (own[piece[keep]] ^ second[keep].astype(np.uint64)).view(np.int64)})


def _segments(batches: Iterator[pd.DataFrame], length: int, stretch: int) -> Iterator[pd.DataFrame]:
    """Per text: doc, body, and its different segments: first windows of all their places, numbers of windows, short anchors,
    their places in the segments, and hashes."""
    coarse, fine = _grams(length)
    for rows in slices(batches, "body", SLICE):
        texts = [bytes(b) for b in rows["body"]]
        keys = [np.asarray(k, np.int64).view(np.uint64) for k in rows["keys"]]
        # text that repeats itself has the same segment again and again: one entry with all its places
        found: list[dict[bytes, tuple[int, int, int, list[int]]]] = [{} for _ in texts]
        for owner, offset, pieces in _stretches(texts, length, stretch):
            data, start, wanted = _joined(pieces, length)
            first, n, key, _ = anchor_runs(data, wanted, length, coarse)
            piece = np.searchsorted(start, first, side="right") - 1
            repeated = np.zeros(len(first), bool)
            bounds = np.searchsorted(piece, np.arange(len(pieces) + 1))
            for i, text in enumerate(owner.tolist()):
                lo, hi = bounds[i], bounds[i + 1]
                repeated[lo:hi] = np.isin(key[lo:hi], keys[text])
            marks = np.zeros(len(data) + 1, np.int64)
            np.add.at(marks, first[repeated], 1)
            np.add.at(marks, first[repeated] + n[repeated], -1)
            first, n, key, place = anchor_runs(data, np.cumsum(marks)[:-1] > 0, length, fine)
            piece = np.searchsorted(start, first, side="right") - 1
            raw, at = data.tobytes(), place - first
            begins = first - start[piece] + offset[piece]
            for text, p, f, k, a, key_ in zip(owner[piece].tolist(), begins.tolist(), first.tolist(), n.tolist(), at.tolist(), key.view(np.int64).tolist(), strict=True):
                h = hashlib.blake2b(raw[f : f + k + length - 1], digest_size=16).digest()
                found[text].setdefault(h, (k, key_, a, []))[3].append(p)
        yield pd.DataFrame(
            {
                "doc": rows["doc"].array,
                "body": texts,
                "begins": [[x[3] for x in f.values()] for f in found],
                "n": [[x[0] for x in f.values()] for f in found],
                "key": [[x[1] for x in f.values()] for f in found],
                "at": [[x[2] for x in f.values()] for f in found],
                "hash": [list(f) for f in found],
            }
        )


def _cut(batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """Per different segment of a batch: hash, key, at, bytes, number of places."""
    for rows in slices(batches, "body", SLICE):
        found: dict[bytes, list] = {}
        for r in rows.itertuples():
            body = bytes(r.body)
            for begins, n, key, at, h in zip(r.begins, r.n, r.key, r.at, r.hash, strict=True):
                one = found.get(h)
                if one is None:
                    p = int(begins[0])
                    found[h] = [key, at, body[p : p + n + length - 1], len(begins)]
                else:
                    one[3] += len(begins)
        yield pd.DataFrame({"hash": list(found), **{name: [x[k] for x in found.values()] for k, name in enumerate(("key", "at", "segment", "places"))}})


def _runs(mask: np.ndarray) -> tuple[list[int], list[int]]:
    """First places and lengths of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist()


def _as_runs(hashes: list[bytes], masks: list[np.ndarray]) -> pd.DataFrame:
    runs = [_runs(m) for m in masks]
    return pd.DataFrame({"hash": hashes, "first": [r[0] for r in runs], "n": [r[1] for r in runs]})


def _shards(batches: Iterator[pd.DataFrame], length: int, shard_bytes: int) -> Iterator[pd.DataFrame]:
    """Repeated windows of segments that come sorted by anchor; several anchors make a shard."""
    hashes: list[bytes] = []
    segments: list[bytes] = []
    size, last = 0, None
    for rows in batches:
        for key, h, segment in zip(rows["key"], rows["hash"], rows["segment"], strict=True):
            if key != last and size >= shard_bytes:  # closed at its last anchor's end
                yield _as_runs(hashes, repeated_starts(segments, length))
                hashes, segments, size = [], [], 0
            hashes.append(bytes(h))
            segments.append(bytes(segment))
            size, last = size + len(segment), key
    if hashes:
        yield _as_runs(hashes, repeated_starts(segments, length))


def _merged(batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """Repeated windows of two shards of one anchor, or of one by itself. Rows come sorted by anchor, one and other."""

    def solve(group: tuple, held: list[tuple]) -> pd.DataFrame:
        one = [x for x in held if x[0] == group[1]]
        if group[1] == group[2]:
            return _as_runs([x[1] for x in one], repeated_starts([x[2] for x in one], length))
        other = [x for x in held if x[0] == group[2]]
        masks = starts_in_both([x[2] for x in one], [x[2] for x in other], length)
        return _as_runs([x[1] for x in one + other], [*masks[0], *masks[1]])

    held: list[tuple] = []
    last = None
    for rows in batches:
        for r in rows.itertuples():
            group = (r.key, r.one, r.other)
            if group != last and held:
                yield solve(last, held)
                held = []
            held.append((r.part, bytes(r.hash), bytes(r.segment)))
            last = group
    if held:
        yield solve(last, held)


def _lengthened(batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """Segments of a longer anchor: parent (hash), offset (its first window's number there), hash, key, at, gram, segment, places."""
    for rows in batches:
        out = []
        for r in rows.itertuples():
            segment, rest = bytes(r.segment), length - r.gram
            ahead, after = (rest + 1) // 2, rest // 2 + 1  # a window has so much before the anchor, or so much behind it
            windows, turn = len(segment) - length + 1, r.at - ahead + 1
            for lo, hi, at, gram in ((0, min(windows, turn), r.at - ahead, r.gram + ahead), (max(0, turn), windows, r.at, r.gram + after)):
                if lo < hi:
                    own, side = segment[lo : hi + length - 1], b"a" if lo == 0 and at != r.at else b"b"
                    key = hashlib.blake2b(own[at - lo : at - lo + gram], digest_size=8, person=side).digest()
                    out.append((bytes(r.hash), lo, hashlib.blake2b(own, digest_size=16).digest(), int.from_bytes(key, "little", signed=True), at - lo, gram, own, r.places))
        yield pd.DataFrame(out, columns=["parent", "offset", "hash", "key", "at", "gram", "segment", "places"])


def repeated_runs(segments: DataFrame, length: int) -> DataFrame:
    """Runs of repeated windows of different segments: hash, first, n (arrays); a segment may have several rows.

    segments: hash, key, at and gram (place and length of the anchor), segment (bytes), places (in how many places of the
    texts it lies).
    """
    parts, shard_bytes = shuffle_partitions(segments.sparkSession), SHARD_BYTES
    # what lies in several places is repeated whole, whatever other segments hold
    whole = segments.where("places > 1").select("hash", F.array(F.lit(0)).alias("first"), F.array(F.octet_length("segment") - (length - 1)).alias("n"))
    by_key = segments.groupBy("key").agg(F.count(F.lit(1)).alias("different"), F.sum(F.octet_length("segment")).alias("bytes"), F.min("places").alias("least")).where("different > 1 and least = 1")
    # narrow rows first: whole segments are joined by their own hashes, so that those of a common anchor don't meet in one task
    flagged = segments.select("hash", "key").join(written(by_key.select("key", "bytes"), "sub-keys"), "key").select("hash", "bytes")
    several = written(segments.join(flagged.hint("merge"), "hash"), "sub-several", BLOCK_MB)
    n_shards = F.ceil(F.col("bytes") / SHARD_BYTES).cast("int")
    usual = several.where(n_shards <= 1).select("key", "hash", "segment").repartition(parts, "key").sortWithinPartitions("key")
    found = [usual.mapInPandas(lambda b: _shards(b, length, shard_bytes), RUNS)]

    split = several.where((n_shards > 1) & (n_shards <= SHARDS)).withColumn("shards", n_shards).withColumn("part", F.pmod(F.xxhash64("hash"), "shards").cast("int"))
    met = split.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    met = met.select("key", F.least("part", "with").alias("one"), F.greatest("part", "with").alias("other"), "part", "hash", "segment")
    together = ["key", "one", "other"]
    found.append(met.repartition(parts, *together).sortWithinPartitions(*together).mapInPandas(lambda b: _merged(b, length), RUNS))

    hot = several.where(n_shards > SHARDS)
    if not hot.isEmpty():
        more = written(hot.mapInPandas(lambda b: _lengthened(b, length), "parent binary, offset int, hash binary, key long, at int, gram int, segment binary, places long"), "sub-longer")
        firsts = [F.first(c).alias(c) for c in ("key", "at", "gram", "segment")]
        inner = repeated_runs(written(more.groupBy("hash").agg(*firsts, F.sum("places").alias("places")), "sub-segments"), length)
        back = more.select("parent", "offset", "hash").join(inner, "hash")
        found.append(back.select(F.col("parent").alias("hash"), F.transform("first", lambda x: x + F.col("offset")).alias("first"), "n"))
    rows = written(functools.reduce(DataFrame.union, found).where(F.size("first") > 0), "sub-found")
    forget(several)
    return rows.join(whole.select("hash"), "hash", "left_anti").union(whole)


def _removed(batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """Per text: doc, number of removed bytes and spans, SHA-256 of the rest, the rest."""
    for rows in slices(batches, "body", SLICE):
        out = []
        for r in rows.itertuples():
            body = bytes(r.body)
            places = [(np.asarray(x["begins"], np.int64)[:, None] + np.asarray(x["first"], np.int64)).ravel() for x in r.hits]
            sizes = [np.tile(np.asarray(x["n"], np.int64) + length - 1, len(x["begins"])) for x in r.hits]
            start, size = np.concatenate(places), np.concatenate(sizes)
            order = np.argsort(start, kind="stable")
            start, end = start[order], np.maximum.accumulate((start + size)[order])
            new = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
            start, end = start[new], end[np.append(new[1:], len(end)) - 1]
            rest = b"".join(body[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(body)], strict=True))
            out.append((r.doc, len(body) - len(rest), len(start), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore")))
        yield pd.DataFrame(out, columns=["doc", "n_removed", "n_spans", "kept_sha256", "rest"])


def text_key(body: Column) -> Column:
    """What tells texts apart: 128 bits of their SHA-256."""
    return F.unhex(F.substring(F.sha2(body.cast("binary"), 256), 1, 32))


def losses(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What texts lose, one row per different text that loses something: doc (``text_key``), gone (all of it, for it has
    copies), and else n_removed, n_spans, kept_sha256 and rest (as text)."""
    raw, stretch = keyed(docs, id_col, text_col), STRETCH
    long = raw.where(F.octet_length("body") >= length).select(text_key(F.col("body")).alias("doc"), F.col("body").cast("binary").alias("body"))
    grams = written(long.mapInPandas(lambda b: _coarse_keys(b, length, stretch), "doc binary, key long, occurrence long"), "sub-grams")
    repeated = grams.groupBy("key").agg(F.min("occurrence").alias("lo"), F.max("occurrence").alias("hi")).where("lo < hi").select("key")
    of_doc = grams.select("key", "doc").join(written(repeated, "sub-repeated"), "key").groupBy("doc").agg(F.collect_set("key").alias("keys"))
    texts = long.groupBy("doc").agg(F.first("body").alias("body"))
    some = texts.join(of_doc, "doc")
    cut_schema = "doc binary, body binary, begins array<array<int>>, n array<int>, key array<long>, at array<int>, hash array<binary>"
    held = written(some.mapInPandas(lambda b: _segments(b, length, stretch), cut_schema), "sub-held", BLOCK_MB)
    forget(grams)
    pieces = held.mapInPandas(lambda b: _cut(b, length), "hash binary, key long, at int, segment binary, places long")
    firsts = [F.first(c).alias(c) for c in ("key", "at", "segment")]
    segments = written(pieces.groupBy("hash").agg(*firsts, F.sum("places").alias("places")).withColumn("gram", F.lit(_grams(length)[1])), "sub-segments", BLOCK_MB)
    runs = repeated_runs(segments, length)
    where = held.select("doc", F.explode(F.arrays_zip("begins", "hash")).alias("s")).select("doc", F.col("s.begins").alias("begins"), F.col("s.hash").alias("hash"))
    per_doc = where.join(runs, "hash").groupBy("doc").agg(F.collect_list(F.struct("begins", "first", "n")).alias("hits"))
    lost = held.select("doc", "body").join(per_doc, "doc").mapInPandas(lambda b: _removed(b, length), "doc binary, n_removed long, n_spans long, kept_sha256 string, rest string")
    copies = long.groupBy("doc").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("doc", F.lit(True).alias("copied"))
    # of copies nothing is left, whatever else their one representative keeps
    facts = copies.join(lost, "doc", "full")
    gone = F.coalesce("copied", F.lit(False))
    return written(facts.select("doc", gone.alias("gone"), "n_removed", "n_spans", "kept_sha256", F.when(gone, "").otherwise(F.col("rest")).alias("rest")), "sub-facts", BLOCK_MB)


def removals(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What each row loses: id, n_bytes, n_removed, n_spans, kept_sha256, text (what is left of it)."""
    facts = losses(docs, length, id_col, text_col)
    rows = keyed(docs, id_col, text_col).withColumn("doc", text_key(F.col("body"))).join(facts, "doc", "left")
    n_bytes, gone, changed = F.octet_length("body").cast("long"), F.coalesce("gone", F.lit(False)), F.col("gone").isNotNull()
    kept = F.when(gone, "").when(changed, F.col("rest")).otherwise(F.col("body"))
    return rows.select(
        F.nullif("id", F.lit(NO_ID)).alias(id_col),
        n_bytes.alias("n_bytes"),
        F.when(gone, n_bytes).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", F.sha2(F.col("body").cast("binary"), 256))).alias("kept_sha256"),
        kept.alias("text"),
    )
