"""Document fingerprints by prefix polynomial hashes.

A text of code points c[0], c[1], ... has the prefix hashes H[j] = sum of (c[k] + 1) * B^(j - 1 - k), k < j, modulo the prime
2^31 - 1, for two bases B side by side. The hash of any span follows from two of them: H[j] - H[i] * B^(j - i). So two spans
are compared at one go whatever their lengths, and the longest common extension of two places is found by binary search.
Arrays are made for ``BLOCK`` code points at a time; of longer texts the hashes at blocks' starts are kept, so that a text of
any length needs no more memory than its own characters and one block.

A fingerprint is a string (base64) of: the number of code points, the whole text's hash, ``REGISTERS`` registers made from the
smallest hashes of the text's spans of ``SPAN`` code points (which register, a span hash's first bits say), and the prefix hashes at the ``grid``'s places
(1 to 8, then four a doubling). Two fingerprints are alike by the larger of two figures: the share of registers that agree,
which estimates the share of spans in common; and the longest common prefix, found by binary search on the grid, over
the longer length. Equal fingerprints are alike by 1, others by less.

Successive documents: rows in descending order of id, rows that share an id by a text's MD5; the next document of the last is
the first. Texts don't meet by a join: ids and digests are sorted by range alone, the ranges' first keys become the driver's
list of cuts (some a partition), each text goes once to its range's task, and each range is also given the one text that
follows it. Rows that repeat a key over and over are a range of their own, which is dealt to many tasks.

Defined results: a null text counts as empty; rows without id come last; rows with an equal id and text are one document,
returned as often as it occurs, and its next document is the next other one (itself, if there is no other); texts of any
length are taken whole; other columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from pairstrand.llm.common import NO_ID, keyed, named, shuffle_partitions, written
from pairstrand.llm.textarrays import mix

PRIME = (1 << 31) - 1
BASES = tuple(int(x) for x in np.random.default_rng(21).integers(1 << 20, PRIME, 2))
BLOCK = 1 << 18
SPAN, REGISTERS = 12, 64

_P, _31 = np.uint64(PRIME), np.uint64(31)


def fold(x: np.ndarray) -> np.ndarray:
    """``x`` modulo PRIME, in place, for integers under 2^63."""
    for _ in range(2):
        high = x >> _31
        x &= _P
        x += high
    x -= _P * (x >= _P)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n - 1)."""
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = fold(out[:more] * np.uint64(pow(base, done, PRIME)))
        done += more
    return out


_TABLES: list[tuple[np.ndarray, np.ndarray]] = []


def _tables(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of each base and of its inverse, at least n of each; kept in the process."""
    if not _TABLES or len(_TABLES[0][0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        _TABLES[:] = [(_powers(b, size), _powers(pow(b, -1, PRIME), size)) for b in BASES]
    return _TABLES


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def prefix_arrays(codes: np.ndarray, start: tuple[int, int] = (0, 0)) -> np.ndarray:
    """H[0] ... H[n] for each base (2, n + 1), carried on from ``start``."""
    n = len(codes)
    out = np.empty((2, n + 1), np.uint64)
    for row, (power, inverse), first in zip(out, _tables(n + 1), start, strict=True):
        sums = fold((codes + np.uint64(1)) * inverse[:n])
        np.cumsum(sums, out=sums)  # under 2^31 * BLOCK
        row[0] = first
        row[1:] = fold(fold(sums) * power[:n])
        if first:
            row[1:] = fold(row[1:] + fold(np.uint64(first) * power[1 : n + 1]))
    return out


class PrefixHashes:
    """A text's prefix hashes: the whole arrays of a short text, those at blocks' starts and one block of a long one."""

    def __init__(self, text: str) -> None:
        self.text, self.n = text, len(text)
        self.marks = [(0, 0)]
        for _, own in self.blocks():
            self.marks.append((int(own[0, -1]), int(own[1, -1])))

    def blocks(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each block's first place and arrays, in order."""
        for a in range(0, max(self.n, 1), BLOCK):
            self._at, self._own = a, prefix_arrays(code_points(self.text[a : a + BLOCK]), self.marks[a // BLOCK])
            yield a, self._own

    def prefix(self, j: int) -> tuple[int, int]:
        """H[j] for both bases."""
        k, within = divmod(j, BLOCK)
        if not within:
            return self.marks[k]
        if self._at != k * BLOCK:
            self._at, self._own = k * BLOCK, prefix_arrays(code_points(self.text[k * BLOCK : (k + 1) * BLOCK]), self.marks[k])
        return int(self._own[0, within]), int(self._own[1, within])

    def span(self, i: int, j: int) -> tuple[int, int]:
        """Hash of the code points i to j - 1."""
        return tuple((b - a * pow(base, j - i, PRIME)) % PRIME for base, a, b in zip(BASES, self.prefix(i), self.prefix(j), strict=True))

    def equal(self, i: int, other: PrefixHashes, j: int, length: int) -> bool:
        """Whether ``length`` code points from i on equal the other's from j on."""
        return max(i + length - self.n, j + length - other.n) <= 0 and self.span(i, i + length) == other.span(j, j + length)

    def common(self, i: int, other: PrefixHashes, j: int) -> int:
        """Length of the longest common extension of place i here and place j there."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(i, other, j, middle):
                low = middle
            else:
                high = middle - 1
        return low


def grid(n: int) -> np.ndarray:
    """Places of a text of n code points whose prefix hashes a fingerprint holds."""
    steps = np.floor(8 * 2.0 ** (np.arange(4 * 60) / 4)).astype(np.int64)
    places = np.concatenate([np.arange(1, 8), steps])
    return places[: np.searchsorted(places, n, side="right")]


_SHIFT = np.uint64(64 - (REGISTERS.bit_length() - 1))


def fingerprint(hashes: PrefixHashes) -> str:
    """A text's fingerprint."""
    n, span = hashes.n, min(SPAN, max(hashes.n, 1))
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    scale = [np.uint64(pow(b, span, PRIME)) for b in BASES]
    kept = np.zeros((2, 0), np.uint64)  # the end of the block before, for spans across
    places = grid(n)
    prefixes = np.zeros(len(places), "<u4")
    for a, own in hashes.blocks():
        end = a + own.shape[1] - 1
        here = slice(*np.searchsorted(places, [a, end], side="right"))
        prefixes[here] = own[0, places[here] - a]
        h = np.concatenate([kept, own], axis=1)
        if h.shape[1] > span:
            first, second = (fold(row[span:] + (_P - fold(row[:-span] * s))) for row, s in zip(h, scale, strict=True))
            found = mix((first << _31) ^ second)
            np.minimum.at(least, (found >> _SHIFT).astype(np.int64), found << np.uint64(64 - int(_SHIFT)))
        if end < n:
            kept = h[:, max(0, h.shape[1] - span) : -1]
    registers = np.where(least == np.iinfo(np.uint64).max, 0, mix(least) % np.uint64(65535) + np.uint64(1)).astype("<u2")
    whole = np.array(hashes.prefix(n), "<u4")
    return base64.b64encode(np.array([n], "<i8").tobytes() + whole.tobytes() + registers.tobytes() + prefixes.tobytes()).decode()


def alike(one: str, other: str) -> float:
    """Likeness of two fingerprints, 0 to 1."""
    if one == other:
        return 1.0
    (n, own, places), (m, theirs, others) = map(_fields, (one, other))
    filled = (own > 0) | (theirs > 0)
    spans = ((own == theirs) & filled).sum() / max(1, filled.sum())
    low, high = 0, min(len(places), len(others))
    while low < high:
        middle = (low + high + 1) // 2
        if places[middle - 1] == others[middle - 1]:
            low = middle
        else:
            high = middle - 1
    longest = max(n, m)
    prefix = grid(longest)[low - 1] / longest if low else 0.0
    return float(min(max(spans, prefix), 1 - 1 / (longest + 1)))


def _fields(mark: str) -> tuple[int, np.ndarray, np.ndarray]:
    """A fingerprint's length, registers and prefix hashes."""
    data = base64.b64decode(mark)
    ends = 16 + 2 * REGISTERS
    return int(np.frombuffer(data[:8], "<i8")[0]), np.frombuffer(data[16:ends], "<u2"), np.frombuffer(data[ends:], "<u4")


@F.pandas_udf(DoubleType())
def likeness(one: pd.Series, other: pd.Series) -> pd.Series:
    """Likeness of two columns of fingerprints; null where one is null."""
    return pd.Series([None if a is None or b is None else alike(a, b) for a, b in zip(one, other, strict=True)], dtype=float)


@F.pandas_udf(LongType())
def common_extension(text: pd.Series, place: pd.Series, other: pd.Series, other_place: pd.Series) -> pd.Series:
    """Length of the longest common extension of a place (from 0) of a text and one of another; a null text counts as empty."""
    out = []
    for a, i, b, j in zip(text, place, other, other_place, strict=True):
        x, y = PrefixHashes(a or ""), PrefixHashes(b or "")
        out.append(x.common(min(int(i), x.n), y, min(int(j), y.n)))
    return pd.Series(out, dtype="int64")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars, fingerprint."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            bodies = rows["body"].tolist()
            yield pd.DataFrame({"id": rows["id"], "n_chars": [len(t) for t in bodies], "fingerprint": [fingerprint(PrefixHashes(t)) for t in bodies]})

    return named(keyed(docs, id_col, text_col).mapInPandas(run, "id long, n_chars long, fingerprint string"), id_col)


def _cuts(keys: DataFrame, parts: int) -> list[tuple[int, str, int]]:
    """Keys (id, md5) that begin a range, in order, and the number of tasks each range is dealt to: some a partition.

    keys: range, id, md5, copies.
    """
    own = F.struct((-F.col("id").cast("decimal(20,0)")).alias("o"), "md5", "id")
    stats = keys.groupBy("range").agg(F.min(own).alias("first"), F.sum("copies").alias("n")).collect()  # one row a partition
    share = max(1, sum(r["n"] for r in stats) // parts)
    # no more than one in a partition's share, so at most `parts` of them
    hot = keys.where(F.col("copies") > share).select("id", "md5", "copies").collect()
    firsts = {(-r["first"]["id"], r["first"]["md5"]): 1 for r in stats}
    for r in hot:
        after = keys.where((F.col("id") < r["id"]) | ((F.col("id") == r["id"]) & (F.col("md5") > r["md5"]))).agg(F.min(own).alias("next")).first()["next"]
        if after:
            firsts.setdefault((-after["id"], after["md5"]), 1)
    for r in hot:
        firsts[(-r["id"], r["md5"])] = min(parts, -(-r["copies"] // share))
    return [(-i, m, n) for (i, m), n in sorted(firsts.items())]


def successive(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, shared_edited,
    shared_next.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document. shared_edited and shared_next are the lengths of the prefixes that the text has in common with both.
    """
    spark, parts = docs.sparkSession, shuffle_partitions(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    counted = rows.select("id", F.md5(F.col("body").cast("binary")).alias("md5")).groupBy("id", "md5").agg(F.count(F.lit(1)).alias("copies"))
    keys = written(counted.repartitionByRange(parts, F.desc("id"), "md5").withColumn("range", F.spark_partition_id()), "fingerprint-keys")
    cuts = _cuts(keys, parts)
    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, shared_edited long, shared_next long"
    if not cuts:
        return named(spark.createDataFrame([], schema), id_col)
    starts, tasks = [(-i, m) for i, m, _ in cuts], [n for _, _, n in cuts]

    @F.pandas_udf("long")
    def run_of(ids: pd.Series, md5: pd.Series, salt: pd.Series) -> pd.Series:
        found = [bisect.bisect_right(starts, (-i, m)) - 1 for i, m in zip(ids.tolist(), md5.tolist(), strict=True)]
        return pd.Series([k * parts + s % tasks[k] for k, s in zip(found, salt.tolist(), strict=True)], dtype="int64")

    # the texts that begin ranges, each once, for the runs of the range before
    heads = spark.createDataFrame([(i, m, ((k - 1) % len(cuts)) * parts + s) for k, (i, m, _) in enumerate(cuts) for s in range(tasks[k - 1])], "id long, md5 string, run long")
    wanted = heads.select("id").distinct()
    near = rows.join(F.broadcast(wanted), "id", "left_semi").withColumn("md5", F.md5(F.col("body").cast("binary")))
    head_texts = near.join(F.broadcast(heads.select("id", "md5").distinct()), ["id", "md5"], "left_semi").groupBy("id", "md5").agg(F.first("body").alias("body"))
    guests = written(head_texts.join(F.broadcast(heads), ["id", "md5"]).select("run", F.lit(1).alias("guest"), "id", "md5", "body"), "fingerprint-heads")
    own = rows.withColumn("md5", F.md5(F.col("body").cast("binary"))).select(run_of("id", "md5", F.spark_partition_id()).alias("run"), F.lit(0).alias("guest"), "id", "md5", "body")
    task = F.pmod(F.floor(F.col("run") / parts) + F.pmod("run", F.lit(parts)), F.lit(parts)).cast("int")
    dealt = own.unionByName(guests).repartitionById(parts, task).sortWithinPartitions("run", "guest", F.desc("id"), "md5")

    def finished(n_rows: int, i: int, hashes: PrefixHashes, mark: str, after: PrefixHashes, mark_after: str) -> pd.DataFrame:
        tail = hashes.n // 2
        edited = hashes.text[: hashes.n - tail] + after.text[:tail]
        theirs = PrefixHashes(edited)
        mark_edited = fingerprint(theirs)
        out = (i, hashes.n, hashlib.sha256(edited.encode()).hexdigest(), mark, mark_edited, alike(mark, mark_edited), alike(mark, mark_after), hashes.common(0, theirs, 0), hashes.common(0, after, 0))
        return [out] * n_rows

    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pending = None  # run, id, md5, prefix hashes, fingerprint; its rows are counted
        n_rows = 0
        for rows in batches:
            out = []
            for number, guest, i, md5, body in zip(rows["run"].tolist(), rows["guest"].tolist(), rows["id"].tolist(), rows["md5"].tolist(), rows["body"].tolist(), strict=True):
                if pending and not guest and pending[:3] == (number, i, md5):
                    n_rows += 1
                    continue
                if pending and guest and pending[1:3] == (i, md5):
                    hashes, mark = pending[3:]  # the only document follows itself
                else:
                    hashes = PrefixHashes(body)
                    mark = fingerprint(hashes)
                if pending and pending[0] == number:
                    out += finished(n_rows, pending[1], *pending[3:], hashes, mark)
                pending, n_rows = (None, 0) if guest else ((number, i, md5, hashes, mark), 1)
                if len(out) >= 1000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    return named(dealt.mapInPandas(run, schema), id_col)
