"""Encoding columns of texts, flat token files, and scans for their document boundaries.

A token file is a row of unsigned little-endian integers without header (``uint16`` where the vocabulary has at most
65,536 ids, else ``uint32``). ``write_token_files`` writes such files for each range of document ids, with two files of
signed 64-bit integers beside each: the documents' offsets (where each begins, counted in ids from the file's start, and the
end) and the document ids. A file is closed after the document that fills it (``TOKEN_FILE_IDS``). The base of each file, the
number of ids in all files before it, comes from prefix sums: within a range of ids, and over the ranges. Files are read memory-mapped where the folder is local, else block by block.

A file is written under the name of the attempt and then renamed; a task that is run again writes the same bytes, so
lost executors do no harm.

Defined results, where a function doesn't say otherwise: a null text counts as empty, a null id stays null, equal rows are
each worked on, other columns play no part, texts are taken whole, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairstrand.llm.bpe import codec
from pairstrand.llm.common import NO_ID, keyed, named, new_folder, shuffle_partitions, written

#: Ids in a block of the separator scan.
SCAN_BLOCK = 1 << 20
#: Ids that one flat file of the separator scan holds at most.
FILE_IDS = 1 << 22
#: Ids after which a token file is closed.
TOKEN_FILE_IDS = 1 << 24


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text: id, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as empty; a null id stays null; one row out for each row in.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = codec(vocabulary)
        for rows in batches:
            at = 0
            for n_texts, ids, counts in bpe.encode_batch(rows["body"].tolist()):
                ends = np.cumsum(counts) * 4
                raw = ids.astype("<u4").tobytes()
                yield pd.DataFrame(
                    {
                        "id": rows["id"].iloc[at : at + n_texts].array,
                        "n_tokens": counts,
                        "ids_sha256": [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)],
                        "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in bpe.decode_batch(ids, counts)],
                    }
                )
                at += n_texts

    return named(keyed(docs, id_col, text_col).mapInPandas(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"), id_col)


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids of every whole text: id, ids (array of int)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = codec(vocabulary)
        for rows in batches:
            at = 0
            for n_texts, ids, counts in bpe.encode_batch(rows["body"].tolist()):
                yield pd.DataFrame({"id": rows["id"].iloc[at : at + n_texts].array, "ids": np.split(ids.astype(np.int32), np.cumsum(counts)[:-1])})
                at += n_texts

    return named(keyed(docs, id_col, text_col).mapInPandas(run, "id long, ids array<int>"), id_col)


def decode(tokens: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The texts of arrays of ids: id, text. A null array gives an empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = codec(vocabulary)
        for rows in batches:
            lists = [np.zeros(0, np.int64) if x is None else np.asarray(x, np.int64) for x in rows["ids"]]
            flat = np.concatenate([np.zeros(0, np.int64), *lists])
            yield pd.DataFrame({"id": rows["id"], "text": bpe.decode_batch(flat, np.array([len(x) for x in lists], np.int64))})

    rows = tokens.select(F.coalesce(tokens[id_col].cast("long"), F.lit(NO_ID)).alias("id"), tokens[ids_col].alias("ids"))
    return named(rows.mapInPandas(run, "id long, text string"), id_col)


def token_lengths(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", extra: int = 0) -> DataFrame:
    """The number of ids of every whole text plus ``extra``: id, n_tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = codec(vocabulary)
        for rows in batches:
            counts = np.concatenate([c for _, _, c in bpe.encode_batch(rows["body"].tolist())] or [np.zeros(0, np.int64)])
            yield pd.DataFrame({"id": rows["id"], "n_tokens": counts + extra})

    return named(keyed(docs, id_col, text_col).mapInPandas(run, "id long, n_tokens long"), id_col)


# -- files -----------------------------------------------------------------------------------------------------------


def put(path: str, *parts: bytes | np.ndarray) -> None:
    """Write a file by way of a name of this attempt's own."""
    store, at = pafs.FileSystem.from_uri(path)
    own = f"{at}.{uuid.uuid4().hex}"
    store.create_dir(at.rpartition("/")[0], recursive=True)
    with store.open_output_stream(own) as out:
        for x in parts:
            out.write(np.ascontiguousarray(x) if isinstance(x, np.ndarray) else x)
    store.move(own, at)


def ids_of(path: str, dtype: str) -> np.ndarray:
    """The integers of a file: a memory map where the folder is local."""
    store, at = pafs.FileSystem.from_uri(path)
    if isinstance(store, pafs.LocalFileSystem):
        with store.open_input_file(at) as f:
            return np.memmap(at, dtype=dtype, mode="r") if f.size() else np.zeros(0, dtype)
    with store.open_input_file(at) as f:
        return np.frombuffer(f.readall(), dtype)


def id_type(size: int) -> str:
    """Type of the ids of a vocabulary of ``size`` ids."""
    return "<u2" if size <= 1 << 16 else "<u4"


def before(df: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """``df`` with the column ``before``: the sum of ``value`` over all rows that come before by group and order.

    Only the groups' totals, of which there is one a task, are added up in one place.
    """
    so_far = lambda w: F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    totals = df.groupBy(group).agg(F.sum(value).alias(value)).select(group, so_far(Window.orderBy(group)).alias("groups_before"))
    within = df.withColumn("own_before", so_far(Window.partitionBy(group).orderBy(*order)))
    return within.join(totals, group).withColumn("before", F.col("groups_before") + F.col("own_before")).drop("groups_before", "own_before")


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, vocabulary_size: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", library: bool = False) -> DataFrame:
    """Write the ids of every whole text, each text followed by ``end_id``, in ascending order of document id.

    Returns one row per file: range (long), piece (of the range), path, n_docs, n_ids, base. Rows without a document id come first; rows with
    equal ids follow one another in the order of their texts. An empty table gives no file. With ``library`` the words
    that a task has not met before are encoded by the tokenizers library instead of by ``bpe``.
    """
    spark = docs.sparkSession
    folder, dtype = folder or new_folder(spark, "tokens"), id_type(vocabulary_size)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, ids_parts, counts_parts, doc_parts = codec(vocabulary, library), [], [], []
        number, piece, held = None, 0, 0

        def flush() -> pd.DataFrame:
            nonlocal ids_parts, counts_parts, doc_parts, piece, held
            counts = np.concatenate(counts_parts)
            path = f"{folder}/part-{number:06d}-{piece:06d}"
            put(f"{path}.bin", *ids_parts)
            put(f"{path}.idx", np.append(0, np.cumsum(counts)).astype("<i8"))
            put(f"{path}.doc", np.concatenate(doc_parts).astype("<i8"))
            out = pd.DataFrame({"range": [number], "piece": [piece], "path": [path], "n_docs": [len(counts)], "n_ids": [held]})
            ids_parts, counts_parts, doc_parts, piece, held = [], [], [], piece + 1, 0
            return out

        for rows in batches:
            at = 0
            for n_texts, ids, counts in bpe.encode_batch(rows["body"].tolist()):
                number = int(rows["part"].iloc[0]) if number is None else number
                doc_parts.append(rows["id"].to_numpy(np.int64)[at : at + n_texts])
                ids_parts.append(np.insert(ids, np.cumsum(counts), end_id).astype(dtype))
                counts_parts.append(counts + 1)
                at, held = at + n_texts, held + len(ids_parts[-1])
                if held >= TOKEN_FILE_IDS:
                    yield flush()
        if held:
            yield flush()

    parts = shuffle_partitions(spark)
    ordered = keyed(docs, id_col, text_col).repartitionByRange(parts, "id").sortWithinPartitions("id", "body")
    files = written(ordered.withColumn("part", F.spark_partition_id()).mapInPandas(run, "range long, piece long, path string, n_docs long, n_ids long"), "token-files")
    return before(files, "range", ["piece"], "n_ids").withColumnRenamed("before", "base")


def read_token_files(files: DataFrame, vocabulary_size: int, id_col: str = "doc_id") -> DataFrame:
    """Per document of the files: id, start (ids in all files before it), n_tokens, ids_crc32."""
    dtype = id_type(vocabulary_size)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for path, base in zip(rows["path"], rows["base"], strict=True):
                ids, offsets, docs = ids_of(f"{path}.bin", dtype), ids_of(f"{path}.idx", "<i8"), ids_of(f"{path}.doc", "<i8")
                for lo in range(0, len(docs), 20_000):
                    ends = offsets[lo : lo + 20_001]
                    sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                    yield pd.DataFrame({"id": docs[lo : lo + 20_000], "start": ends[:-1] + base, "n_tokens": np.diff(ends), "ids_crc32": sums})

    apart = files.select("path", "base").repartition(shuffle_partitions(files.sparkSession))
    return named(apart.mapInPandas(run, "id long, start long, n_tokens long, ids_crc32 long"), id_col)


# -- files without an index ------------------------------------------------------------------------------------------


def write_flat_files(docs: DataFrame, vocabulary: str, end_id: int, vocabulary_size: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Write texts' ids, each text followed by ``end_id``, as flat files that know nothing of documents.

    The order is that of the input's partitions. A file ends after ``FILE_IDS`` ids, in the middle of a document if it so
    falls. Returns one row per file (stream, piece, path, n_ids), and one row per document (doc_no, id): its number in the
    order of all streams, which only serves to name the documents that a scan finds.
    """
    spark = docs.sparkSession
    folder, dtype = folder or new_folder(spark, "flat"), id_type(vocabulary_size)
    schema = "stream long, piece long, path string, n_ids long, n_docs long, first_no long, doc_ids array<long>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, kept, n_kept, piece, stream, seen = codec(vocabulary), [], 0, 0, None, 0

        def flush(last: bool) -> Iterator[pd.DataFrame]:
            nonlocal kept, n_kept, piece
            while n_kept >= FILE_IDS or (last and n_kept):
                flat = np.concatenate(kept)
                path = f"{folder}/stream-{stream:06d}-{piece:06d}.bin"
                put(path, flat[:FILE_IDS])
                yield pd.DataFrame({"stream": [stream], "piece": [piece], "path": [path], "n_ids": [min(len(flat), FILE_IDS)], "n_docs": [0], "first_no": [0], "doc_ids": [None]})
                kept, n_kept, piece = [flat[FILE_IDS:].copy()], max(0, len(flat) - FILE_IDS), piece + 1

        for rows in batches:
            if not len(rows):
                continue
            stream = int(rows["part"].iloc[0]) if stream is None else stream
            names = rows["id"].tolist()
            yield pd.DataFrame({"stream": [stream], "piece": [0], "path": [None], "n_ids": [0], "n_docs": [len(names)], "first_no": [seen], "doc_ids": [names]})
            seen += len(names)
            for _, ids, counts in bpe.encode_batch(rows["body"].tolist()):
                kept.append(np.insert(ids, np.cumsum(counts), end_id).astype(dtype))
                n_kept += len(kept[-1])
                yield from flush(False)
        if stream is not None:
            yield from flush(True)

    rows = keyed(docs, id_col, text_col).withColumn("part", F.spark_partition_id())
    out = written(rows.mapInPandas(run, schema), "flat-files")
    streams = Window.orderBy("stream")  # one row per stream
    bases = (
        out.groupBy("stream")
        .agg(F.sum("n_docs").alias("n_docs"))
        .select("stream", F.coalesce(F.sum("n_docs").over(streams.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("stream_no"))
    )
    names = out.where(F.col("path").isNull()).join(bases, "stream").select((F.col("stream_no") + F.col("first_no")).alias("first_no"), F.posexplode("doc_ids").alias("k", "id"))
    return out.where(F.col("path").isNotNull()).select("stream", "piece", "path", "n_ids"), named(names.select((F.col("first_no") + F.col("k")).alias("doc_no"), "id"), id_col)


def scan_separators(files: DataFrame, end_id: int, vocabulary_size: int) -> DataFrame:
    """Find the documents of flat files by their end ids: doc_no (from 0), start (in all ids), n_tokens (with the end id), ended.

    ``files`` has stream, piece, path and n_ids. Each block of a file is searched at once; a block gives the places of its
    end ids, counted from the file's start. The document that begins before a block (or file) ends at its first end id, so
    boundaries are stitched by the last end id of all that stands before: a running maximum over blocks within a file and,
    over files, a prefix scan of one row per file. Ids after the last end id of all files are a document without an end:
    it is returned with ``ended`` false. Files of no ids, or without any end id, are passed over by the scan.
    """
    dtype = id_type(vocabulary_size)
    placed = written(before(files, "stream", ["piece"], "n_ids").withColumnRenamed("before", "base"), "flat-bases")

    def ends_of(path: str) -> Iterator[np.ndarray]:
        ids = ids_of(path, dtype)
        for lo in range(0, len(ids), SCAN_BLOCK):
            yield np.flatnonzero(ids[lo : lo + SCAN_BLOCK] == end_id) + lo

    def last_end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples():
                last, n_ends = None, 0
                for e in ends_of(r.path):
                    last, n_ends = (r.base + int(e[-1]) if len(e) else last), n_ends + len(e)
                yield pd.DataFrame({"stream": [r.stream], "piece": [r.piece], "path": [r.path], "base": [r.base], "n_ids": [r.n_ids], "n_ends": [n_ends], "last": pd.array([last], "Int64")})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples():
                before, number = int(r.before), int(r.first_no)  # place of the last end id before this file, or -1
                for e in ends_of(r.path):
                    if len(e):
                        places = e + r.base
                        starts = np.append(before, places[:-1]) + 1
                        before = int(places[-1])
                        yield pd.DataFrame({"doc_no": np.arange(number, number + len(e)), "start": starts, "n_tokens": places - starts + 1, "ended": True})
                        number += len(e)
                if r.is_last and r.base + r.n_ids > before + 1:
                    yield pd.DataFrame({"doc_no": [number], "start": [before + 1], "n_tokens": [int(r.base + r.n_ids - before - 1)], "ended": [False]})

    parts = shuffle_partitions(files.sparkSession)
    apart = placed.select("stream", "piece", "path", "base", "n_ids").repartition(parts)
    lasts = written(apart.mapInPandas(last_end, "stream long, piece long, path string, base long, n_ids long, n_ends long, last long"), "flat-lasts")
    # within a stream, and over the streams, of which there is one a task
    numbered = before(lasts, "stream", ["piece"], "n_ends").withColumnRenamed("before", "first_no")
    until = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    along, streams = Window.partitionBy("stream").orderBy("piece"), Window.orderBy("stream")
    per_stream = lasts.groupBy("stream").agg(F.max("last").alias("end"), F.max("piece").alias("last_piece"))
    per_stream = per_stream.select("stream", "last_piece", F.max("end").over(until(streams)).alias("ahead"), F.lead("stream").over(streams).isNull().alias("last_stream"))
    stitched = numbered.withColumn("own", F.max("last").over(until(along))).join(per_stream, "stream").select(
        "path",
        "base",
        "n_ids",
        F.coalesce("own", "ahead", F.lit(-1).cast("long")).alias("before"),
        "first_no",
        (F.col("last_stream") & (F.col("piece") == F.col("last_piece"))).alias("is_last"),
    )
    return stitched.repartition(parts).mapInPandas(cut, "doc_no long, start long, n_tokens long, ended boolean")
