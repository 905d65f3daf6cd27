"""WARC archives of pages, and revisit records for payloads that an archive has already.

``write_responses`` writes one response record per page. ``resolve_revisits`` shuffles only the records' headers by payload
digest, finds of each digest the smallest page id, joins that back to the headers, and rewrites each archive from its file:
the original keeps its payload, every other record becomes a revisit without payload, and all get fresh headers.
``read_archives`` reads records of either kind. Each record is a gzip member of its own.

Payloads are the pages' texts in UTF-8. Digests are SHA-1 in bare upper-case base32, lengths and digests those of the full
payload, of revisits too (its HTTP header is kept, with the full length).

Defined results: a null text is an empty payload; a null URL is ``about:blank``; line ends, blanks and signs beyond ASCII in
URLs are percent-encoded; rows with the same page id and payload are all originals; a page without id is an original only
if no page with id has its payload; an empty table gives no archive. Files are written under an attempt's own name and then
renamed, and a task that runs again writes the same bytes. A record's id comes from its place in the archives (file and
offset), so records of rows without id, or of repeated ids, have ids of their own, and a revisit names the record that has
the payload. Payloads and URLs may have any length that a value of Spark's can have.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairstrand.llm.common import NO_ID, named, new_folder, shuffle_partitions, written
from pairstrand.llm.tokens import put

#: A file is closed when it has so many bytes.
FILE_BYTES = 32 << 20
DATE = "2000-01-01T00:00:00Z"
HEADERS = "path string, offset long, size long, id long, payload_bytes long, payload_digest string"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122: names that are URLs


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(path: str, offset: int) -> str:
    """Id of the record of a page, from the place at which its response was first written."""
    return f"<{uuid.uuid5(SPACE, f'{path.rpartition('/')[2]}/{offset}').urn}>"


def http_header(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()


def record(kind: str, own: str, page_id: int, url: str, payload: bytes, n: int, payload_digest: str, refers_to: tuple[str, int] | None = None) -> bytes:
    """One compressed record, of the id ``own``. n and payload_digest are those of the full payload; refers_to has the original's
    record id and page id."""
    block = http_header(n) + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}"]
    head += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    if page_id != NO_ID:
        head.append(f"Page-Id: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers_to[0]}", f"Refers-To-Page-Id: {refers_to[1]}"]
    raw = "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"
    return gzip.compress(raw, compresslevel=1, mtime=0)


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an uncompressed stream."""
    while line := stream.readline():
        if line == b"\r\n":
            continue
        headers: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, stream.read(int(headers["content-length"]))


def head_of(raw: bytes, piece: int = 1 << 16) -> bytes:
    """The header of a compressed record, unpacked only so far as it reaches."""
    stream, found = zlib.decompressobj(31), bytearray()
    while (end := found.find(b"\r\n\r\n")) < 0:
        more = stream.decompress(raw, piece)
        if not more:
            raise ValueError("a record without the end of its header")
        found += more
        raw = stream.unconsumed_tail
    return bytes(found[:end])


def write_responses(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a response record per page; returns each record's header: path, offset, size, id, payload_bytes, payload_digest."""
    folder = folder or new_folder(pages.sparkSession, "warc")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, k, size, records, heads = None, 0, 0, [], []

        def path() -> str:
            return f"{folder}/part-{part:06d}-{k:06d}.warc.gz"

        def flush() -> pd.DataFrame:
            nonlocal k, size, records, heads
            put(path(), *records)
            out = pd.DataFrame(heads, columns=["offset", "size", "id", "payload_bytes", "payload_digest"]).assign(path=path())
            k, size, records, heads = k + 1, 0, [], []
            return out

        for rows in batches:
            for r in rows.itertuples():
                part = r.part if part is None else part
                payload = r.body.encode()
                found = digest(payload)
                records.append(record("response", record_id(path(), size), r.id, urllib.parse.quote(r.url, safe=":/?#[]@!$&'()*+,;=%") or "about:blank", payload, len(payload), found))
                heads.append((size, len(records[-1]), r.id, len(payload), found))
                size += len(records[-1])
                if size >= FILE_BYTES:
                    yield flush()
        if records:
            yield flush()

    url = F.coalesce(pages[url_col].cast("string"), F.lit("about:blank")).alias("url")
    rows = pages.select(F.coalesce(pages[id_col].cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("body"), url)
    return written(rows.withColumn("part", F.spark_partition_id()).mapInPandas(run, HEADERS), "warc-headers")


def resolve_revisits(headers: DataFrame, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write deduplicated archives; returns their files: path, n_records.

    ``headers`` has the columns that ``write_responses`` returns. Payloads of fewer than ``min_bytes`` bytes stay responses.
    """
    spark = headers.sparkSession
    folder = folder or new_folder(spark, "warc-dedup")
    first = F.min(F.struct((F.col("id") == NO_ID).alias("none"), "id", "path", "offset")).alias("first")
    originals = headers.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes").agg(first).select("payload_digest", "payload_bytes", "first")
    decided = headers.join(originals, ["payload_digest", "payload_bytes"], "left")
    kept = F.col("first").isNull() | (F.col("first.id") == F.col("id"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, source, records = None, None, []

        def flush() -> pd.DataFrame:
            nonlocal records
            put(path := f"{folder}/{at.rpartition('/')[2]}", *records)
            out = pd.DataFrame({"path": [path], "n_records": [len(records)]})
            records = []
            return out

        for rows in batches:
            for r in rows.itertuples():
                if r.path != at:
                    if records:
                        yield flush()
                    if source is not None:
                        source.close()
                    at = r.path
                    store, name = pafs.FileSystem.from_uri(at)
                    source = store.open_input_file(name)
                raw = source.read_at(r.size, r.offset)
                # of a revisit only the header is needed
                head, _, block = zlib.decompress(raw, 31).partition(b"\r\n\r\n") if r.kept else (head_of(raw), b"", b"")
                url = next(x for x in head.decode().split("\r\n") if x.startswith("WARC-Target-URI: ")).partition(": ")[2]
                own = record_id(r.path, r.offset)
                if r.kept:
                    payload = block[len(http_header(r.payload_bytes)) : -4]
                    records.append(record("response", own, r.id, url, payload, r.payload_bytes, r.payload_digest))
                else:
                    records.append(record("revisit", own, r.id, url, b"", r.payload_bytes, r.payload_digest, (record_id(r.first_path, r.first_offset), r.first_id)))
        if records:
            yield flush()

    rows = decided.select("path", "offset", "size", "id", "payload_bytes", "payload_digest", kept.alias("kept"), F.coalesce("first.path", F.lit("")).alias("first_path"), F.coalesce("first.offset", F.lit(0)).alias("first_offset"), F.coalesce("first.id", F.lit(0)).alias("first_id"))
    by_file = rows.repartition(shuffle_partitions(spark), "path").sortWithinPartitions("path", "offset")
    return written(by_file.mapInPandas(run, "path string, n_records long"), "warc-files")


def read_archives(files: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Per record of the archives: id, payload_bytes, payload_digest, record_type, refers_to."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for path in rows["path"]:
                store, name = pafs.FileSystem.from_uri(path)
                out = []
                with store.open_input_stream(name, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for head, block in parse(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        n = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        found = head["warc-payload-digest"].partition(":")[2]
                        if head["warc-type"] == "response" and (len(payload), digest(payload)) != (n, found):
                            raise ValueError(f"{path}: the payload of {head['warc-record-id']} is damaged")
                        out.append((int(head.get("page-id", NO_ID)), n, found, head["warc-type"], int(head.get("refers-to-page-id", NO_ID))))
                yield pd.DataFrame(out, columns=["id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    apart = files.select("path").repartition(shuffle_partitions(files.sparkSession))
    out = apart.mapInPandas(run, "id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return named(out, id_col).withColumn("refers_to", F.nullif("refers_to", F.lit(NO_ID)))
