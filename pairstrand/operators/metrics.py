"""Walks, the contigs they spell, and measures of their quality.

walks: hap, walk_id, pos, node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NullType

from pairstrand.functions.strings import IUPAC, IUPAC_COMPLEMENT, path_suffix
from pairstrand.sources.shared import shuffle_partitions

WALK = ["hap", "walk_id"]


def walk_edges(walks: DataFrame) -> DataFrame:
    """hap, walk_id, pos, src, dst: neighbours in walks."""
    along = Window.partitionBy(*WALK).orderBy("pos")
    return walks.select(*WALK, "pos", F.col("node").alias("src"), F.lead("node").over(along).alias("dst")).where(F.col("dst").isNotNull())


def cumulative_offsets(walks: DataFrame, edges: DataFrame) -> DataFrame:
    """hap, walk_id, pos, node, offset: bases before each node (sums of prefix lengths; unknown edges count nothing)."""
    along = Window.partitionBy(*WALK).orderBy("pos")
    steps = walks.withColumn("before", F.lag("node").over(along)).join(edges.select(F.col("src").alias("before"), F.col("dst").alias("node"), "prefix_length"), ["before", "node"], "left")
    run = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return steps.select(*WALK, "pos", "node", F.sum(F.coalesce("prefix_length", F.lit(0))).over(run).alias("offset"))


def edge_correctness(walks: DataFrame, classified: DataFrame) -> DataFrame:
    """hap, correct, wrong, wrong by class, rate (wrong of both). classified: src, dst, class.

    An edge of a walk that isn't classified raises an error.
    """
    rows = walk_edges(walks).join(classified, ["src", "dst"], "left")
    cls = F.coalesce("class", F.raise_error(F.lit("a walk has an edge that the graph lacks")).cast("string"))
    rows = rows.withColumn("class", cls)
    count = lambda *names: F.count_if(F.col("class").isin(*names))
    out = rows.groupBy("hap").agg(
        count("correct").alias("correct"), F.count_if(F.col("class") != "correct").alias("wrong"), count("cross_strand").alias("wrong_strand"), count("cross_chr").alias("wrong_chr"),
        count("forward_skip", "backward_skip").alias("wrong_skip"), count("unknown").alias("wrong_unknown"),
    )
    return out.withColumn("rate", F.round(F.col("wrong") / (F.col("wrong") + F.col("correct")), 6))


def phasing_errors(walks: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """hap, pairs, switch, hamming: rates over all pairs of neighbours.

    A pair whose labels are both other than 0 switches if its first label differs from that of the qualifying pair before
    it; a pair with a -1 counts for hamming.
    """
    of = lambda end, name: labels.select(F.col("node").alias(end), F.col(column).alias(name))
    pairs = walk_edges(walks).join(of("src", "c"), "src").join(of("dst", "n"), "dst")
    whole = pairs.groupBy("hap").agg(F.count(F.lit(1)).alias("pairs"), F.count_if((F.col("c") == -1) | (F.col("n") == -1)).alias("ham"))
    qualified = pairs.where("c <> 0 and n <> 0").withColumn("last", F.lag("c").over(Window.partitionBy(*WALK).orderBy("pos")))
    switches = qualified.groupBy("hap").agg(F.count_if(F.col("c") != F.col("last")).alias("sw"))
    return whole.join(switches, "hap", "left").select("hap", "pairs", F.round(F.coalesce("sw", F.lit(0)) / F.col("pairs"), 6).alias("switch"), F.round(F.col("ham") / F.col("pairs"), 6).alias("hamming"))


def kmer_error(walks: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """hap, kmer_error: wrong k-mers of the bases that nodes add, among all their parental k-mers.

    nodes: node, read_length, kmer_count_p, kmer_count_m. Wrong are the other parent's.
    """
    rows = walk_edges(walks).join(edges.select("src", "dst", "overlap_length"), ["src", "dst"]).join(nodes.select(F.col("node").alias("dst"), "read_length", "kmer_count_p", "kmer_count_m"), "dst")
    share = (F.col("read_length") - F.col("overlap_length")) / F.col("read_length")
    wrong = F.when(F.col("hap") == "p", F.col("kmer_count_m")).otherwise(F.col("kmer_count_p"))
    every = F.col("kmer_count_m") + F.col("kmer_count_p")
    return rows.groupBy("hap").agg(F.round(F.sum(share * wrong) / F.sum(share * every), 6).alias("kmer_error"))


def contig_lengths(walks: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """hap, walk_id, length: lengths of nodes less overlaps."""
    own = walks.join(nodes.select("node", "read_length"), "node").groupBy(*WALK).agg(F.sum("read_length").alias("total"))
    over = walk_edges(walks).join(edges.select("src", "dst", "overlap_length"), ["src", "dst"]).groupBy(*WALK).agg(F.sum("overlap_length").alias("overlaps"))
    return own.join(over, WALK, "left").select(*WALK, (F.col("total") - F.coalesce("overlaps", F.lit(0))).alias("length"))


def _running(lengths: DataFrame) -> DataFrame:
    """Sums of lengths from the longest down, per hap. Equal lengths are summed first, so rows are at most the different
    lengths of a haplotype."""
    counts = lengths.groupBy("hap", "length").agg(F.count(F.lit(1)).alias("c"))
    down = Window.partitionBy("hap").orderBy(F.desc("length"))
    run = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumns({"sum": F.sum(F.col("c") * F.col("length")).over(run), "count": F.sum("c").over(run)})


def n50(lengths: DataFrame, genome: int | None = None, share: float = 0.5, name: str = "n50") -> DataFrame:
    """hap and the length at which contigs, longest first, hold a share of all (or of the genome); 0 if they never do."""
    run = _running(lengths)
    goal = F.max("sum").over(Window.partitionBy("hap")) if genome is None else F.lit(genome)
    return run.withColumn("goal", goal * share).groupBy("hap").agg(F.coalesce(F.max(F.when(F.col("sum") >= F.col("goal"), F.col("length"))), F.lit(0)).alias(name))


def lg90(lengths: DataFrame, reference: int, share: float = 0.9) -> DataFrame:
    """hap, lg90: how many contigs, longest first, hold 90 % of a reference; 0 if all don't."""
    run = _running(lengths).withColumn("before", F.col("sum") - F.col("c") * F.col("length")).withColumn("goal", F.lit(reference * share))
    needed = (F.col("count") - F.col("c")) + F.ceil((F.col("goal") - F.col("before")) / F.col("length"))
    return run.groupBy("hap").agg(F.coalesce(F.min(F.when((F.col("sum") >= F.col("goal")) & (F.col("before") < F.col("goal")), needed)), F.lit(0)).cast("long").alias("lg90"))


def walk_steps(walks: DataFrame, edges: DataFrame) -> DataFrame:
    """hap, walk_id, pos, node, skip: how many of a node's first bases its walk has already (0 where no edge joins it to the node before)."""
    along = Window.partitionBy(*WALK).orderBy("pos")
    steps = walks.withColumn("before", F.lag("node").over(along)).join(edges.select(F.col("src").alias("before"), F.col("dst").alias("node"), "overlap_length"), ["before", "node"], "left")
    return steps.select(*WALK, "pos", "node", F.coalesce("overlap_length", F.lit(0)).cast("int").alias("skip"))


def spelled(parts: DataFrame) -> DataFrame:
    """hap, walk_id, length, seq: a walk's parts (pos, part) one after another."""
    seq = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "part"))), lambda p: p["part"]), "")
    return parts.groupBy(*WALK).agg(seq.alias("seq")).select(*WALK, F.length("seq").cast("long").alias("length"), "seq")


def walk_to_seq(walks: DataFrame, sequences: DataFrame, edges: DataFrame) -> DataFrame:
    """hap, walk_id, length, seq: the first node whole, of each next one what its overlap doesn't cover.

    Nodes that no edge joins to the node before are added whole. Sequences join at the very end.
    """
    steps = walk_steps(walks, edges).join(sequences.select("node", "seq"), "node")
    return spelled(steps.select(*WALK, "pos", path_suffix(F.col("seq"), F.col("skip")).alias("part")))


def wrong_runs(walks: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """hap, walk_id, first, n: maximal runs of nodes labelled -1."""
    along = Window.partitionBy(*WALK).orderBy("pos")
    rows = walks.join(labels.select("node", F.col(column).alias("y")), "node").withColumn("k", F.row_number().over(along)).where("y = -1")
    rows = rows.withColumn("island", F.col("k") - F.row_number().over(along))
    return rows.groupBy(*WALK, "island").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).drop("island")


def crop_by_hap(walks: DataFrame, labels: DataFrame, column: str, max_wrong: int) -> DataFrame:
    """Walks split at runs of over ``max_wrong`` nodes labelled -1, which are left out: hap, walk_id, part, pos, node."""
    along = Window.partitionBy(*WALK).orderBy("pos")
    rows = walks.join(labels.select("node", F.col(column).alias("y")), "node").withColumn("k", F.row_number().over(along))
    bad = rows.where("y = -1").withColumn("island", F.col("k") - F.row_number().over(along))
    long = bad.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*WALK, "island"))).where(F.col("n") > max_wrong).select(*WALK, "pos", F.lit(1).alias("cut"))
    marked = rows.select(*WALK, "pos", "node").join(long, [*WALK, "pos"], "left").withColumn("cut", F.coalesce("cut", F.lit(0)))
    opens = (F.col("cut") == 0) & (F.coalesce(F.lag("cut").over(along), F.lit(1)) == 1)
    parts = marked.withColumn("part", F.sum(opens.cast("int")).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return parts.where("cut = 0").select(*WALK, "part", "pos", "node")


def trim_ends(walks: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """Walks without the nodes labelled -1 at either end."""
    span = walks.join(labels.where(F.col(column) != -1).select("node"), "node", "left_semi").groupBy(*WALK).agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    return walks.join(span, WALK).where("pos between lo and hi").select(walks.columns)


#: Places of a sequence that are looked at together.
PLACES = 131_072


def _canonical(words: np.ndarray) -> np.ndarray:
    """Rows of letters (bytes), each replaced by its reverse complement where that sorts first."""
    turned = _COMPLEMENT[words[:, ::-1]]
    at = (words != turned).argmax(1)[:, None]
    less = np.take_along_axis(turned, at, 1) < np.take_along_axis(words, at, 1)
    return np.where(less, turned, words)


_COMPLEMENT = np.arange(256, dtype=np.uint8)
for _x, _y in zip(IUPAC + IUPAC.lower(), IUPAC_COMPLEMENT + IUPAC_COMPLEMENT.lower(), strict=True):
    _COMPLEMENT[ord(_x)] = ord(_y)


def _words(rows: np.ndarray) -> pa.Array:
    """Rows of letters as strings."""
    n, k = rows.shape
    return pa.StringArray.from_buffers(n, pa.py_buffer((np.arange(n + 1) * k).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows)))


def _places(sequences: DataFrame, k: int, key: str, seq_col: str) -> DataFrame:
    """key, kmer, c: k-mers or their reverse complements, whichever sort first, and how often they are in a stretch of a sequence. A
    sequence's stretches give rows of their own. Sequences are letters of one byte each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in enumerate(b.column("seq")):
                letters = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else np.zeros(0, np.uint8)
                for a in range(0, len(letters) - k + 1, PLACES):
                    stretch = np.lib.stride_tricks.sliding_window_view(letters[a : a + PLACES + k - 1], k)
                    found, c = np.unique(np.ascontiguousarray(_canonical(stretch)).view(f"S{k}").ravel(), return_counts=True)
                    kmers = _words(found.view(np.uint8).reshape(len(found), k))
                    yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(np.full(len(found), i))), kmers, pa.array(c)], names=[key, "kmer", "c"])

    rows = sequences.select(F.col(key).alias("key"), F.col(seq_col).alias("seq")).where(F.length("seq") >= k)
    rows = rows.repartition(shuffle_partitions(rows.sparkSession))  # a file's row group would be one task, and its k-mers are many times its size
    return rows.mapInArrow(run, f"`{key}` {sequences.schema[key].dataType.simpleString()}, kmer string, c long")


def kmers(sequences: DataFrame, k: int, parent_col: str = "parent", seq_col: str = "seq") -> DataFrame:
    """parent, kmer: each parent's different k-mers, on either strand."""
    return _places(sequences, k, parent_col, seq_col).select(F.col(parent_col).alias("parent"), "kmer").distinct()


def kmer_hits(reads: DataFrame, kmers: DataFrame, k: int, id_col: str = "read_id", seq_col: str = "seq") -> DataFrame:
    """read_id, parent, hits: places in reads whose k-mer is in a parent's set (kmers: kmer, parent), on either strand."""
    known = kmers.where(F.length("kmer") == k).select(F.lit(None).alias("read_id"), "parent", F.col("kmer").alias("seq"))
    return shared_kmers(reads.select(F.col(id_col).alias("read_id"), F.lit(None).alias("parent"), F.col(seq_col).alias("seq")).union(known), k)


#: Letters that a task holds before it deals them out; k-mers that are looked at together; bins of a shuffle partition.
LETTERS, TOGETHER, BINS = 4_000_000, 1_000_000, 8
#: Letters that name a k-mer's bin.
SEED = 9


def shared_kmers(sequences: DataFrame, k: int) -> DataFrame:
    """read_id, parent, hits: places in reads whose k-mer is in a parent's set, on either strand.

    sequences: read_id (null: not a read), parent (null: in no parent's set), seq (letters of one byte each). A row may be both.

    K-mers that lie one after another mostly have the same least stretch of ``SEED`` letters (by a hash that both strands share),
    which names their bin; they go there as one piece of sequence, and many pieces as one compressed row. So a place costs two or
    three bytes of shuffle, not a row of its own. A bin counts each read's places by parent; the sums go on.
    """
    types = {f.name: f.dataType for f in sequences.schema}
    n = shuffle_partitions(sequences.sparkSession)
    rows = sequences.select(*(F.col(c).cast("string").alias(c) for c in ("read_id", "parent", "seq"))).where(F.length("seq") >= k).repartition(n)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for i in range(len(b)):
                held.append(b.slice(i, 1))
                size += len(b.column(2)[i].as_buffer())
                if size >= LETTERS:
                    yield from dealt(held)
                    held, size = [], 0
        if held:
            yield from dealt(held)

    def dealt(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        letters, sizes = _letters(table.column(2))
        for bins, *piece in _pieces(letters, sizes, k, BINS * n):
            ids = [table.column(c).combine_chunks() for c in (0, 1)]
            yield from _rows_of_bins(bins, *piece, *ids)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, size, last, sums, many = [], 0, None, [], 0
        for b in batches:
            for bin_, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if bin_ != last and size >= TOGETHER:
                    sums.append(_hits(group, k))
                    group, size, many = [], 0, many + len(sums[-1])
                    if many >= TOGETHER:
                        sums = [_summed(sums)]
                        if len(sums[0]) >= TOGETHER // 2:
                            yield from sums.pop().to_batches(max_chunksize=10_000)
                        many = sum(map(len, sums))
                last = bin_
                group.append(_unblob(blob.as_buffer()))
                size += int(group[-1][1].sum())
        if group:
            sums.append(_hits(group, k))
        if sums:
            yield from _summed(sums).to_batches(max_chunksize=10_000)

    found = rows.mapInArrow(deal, "bin int, pieces binary").repartition(n, "bin").sortWithinPartitions("bin").mapInArrow(count, "read_id string, parent string, hits long")
    return found.groupBy("read_id", "parent").agg(F.sum("hits").alias("hits")).select(*(F.col(c).cast(types[c] if types[c] != NullType() else "string").alias(c) for c in ("read_id", "parent")), "hits")


#: Numbers of letters, the same for both cases; T and U have the same complement.
_CODE = np.full(256, 31, np.uint64)
for _i, _x in enumerate(IUPAC):
    _CODE[[ord(_x), ord(_x.lower())]] = IUPAC.index("T") if _x == "U" else _i


def _letters(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All rows' letters, one after another, and how many each has."""
    parts = [np.frombuffer(x.as_buffer(), np.uint8) for x in column]
    return np.concatenate(parts), np.array([len(x) for x in parts])


def _mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers."""
    for turn in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(turn)
    return x ^ (x >> np.uint64(32))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after another."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _pieces(letters: np.ndarray, sizes: np.ndarray, k: int, bins: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Pieces of sequences whose k-mers are of one bin, in the order of bins: bin, k-mers in it, sequence, and all their letters. A
    long sequence is looked at in stretches."""
    ends, most = np.cumsum(sizes), max(LETTERS, k)
    for first in range(0, len(letters) - k + 1, most):
        here = letters[first : first + most + k - 1]
        m = min(k, SEED)
        code, turned = _CODE[here], _CODE[_COMPLEMENT[here]]
        ahead = back = np.zeros(len(here) - m + 1, np.uint64)
        for j in range(m):
            ahead = (ahead << np.uint64(5)) | code[j : len(here) - m + 1 + j]
            back = (back << np.uint64(5)) | turned[m - 1 - j : len(here) - j]
        least, width = _mixed(np.minimum(ahead, back)), 1
        while width < k - m + 1:  # minima of twice as many, and of what is left
            step = min(width, k - m + 1 - width)
            least, width = np.minimum(least[:-step], least[step:]), width + step
        at = np.arange(first, first + len(least))
        of = np.searchsorted(ends, at, side="right")
        inside = at + k <= ends[of]
        at, of, least = at[inside], of[inside], least[inside]
        if not len(at):
            continue
        new = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (of[1:] != of[:-1])]))
        count, bin_ = np.diff(np.append(new, len(at))), (least[new] % np.uint64(bins)).astype(np.int64)
        order = np.argsort(bin_, kind="stable")
        count, start = count[order], at[new][order]
        yield bin_[order], count, of[new][order], letters[_ranges(start, count + k - 1)], np.cumsum(count + k - 1)


def _rows_of_bins(bins: np.ndarray, count: np.ndarray, of: np.ndarray, letters: np.ndarray, ends: np.ndarray, ids: pa.Array, parents: pa.Array) -> Iterator[pa.RecordBatch]:
    """One row a bin."""
    cuts = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1], [True]]))
    blobs = []
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        own, local = np.unique(of[a:z], return_inverse=True)
        blobs.append(_blob(letters[ends[a - 1] if a else 0 : ends[z - 1]], count[a:z], np.diff(local, prepend=0), ids.take(pa.array(own)), parents.take(pa.array(own))))
    for a in range(0, len(blobs), 64):
        yield pa.RecordBatch.from_arrays([pa.array(bins[cuts[a : min(a + 64, len(blobs))]], pa.int32()), pa.array(blobs[a : a + 64], pa.binary())], names=["bin", "pieces"])


def _blob(letters: np.ndarray, count: np.ndarray, step: np.ndarray, *texts: pa.Array) -> bytes:
    """Arrays as compressed bytes: their numbers' low bytes first, then the higher ones, which are mostly zero."""
    parts = [letters.tobytes(), *(np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes() for x in (count, step))]
    for t in texts:
        sizes = np.where(t.is_valid().to_numpy(zero_copy_only=False), pc.binary_length(t).fill_null(0).to_numpy(zero_copy_only=False), -1)
        parts += [np.ascontiguousarray(sizes.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), "".join(x for x in t.to_pylist() if x).encode()]
    head = np.array([len(p) for p in parts], "<i8").tobytes()
    raw = head + b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unblob(blob: pa.Buffer) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """letters, count, step, ids, parents."""
    data = memoryview(blob)
    raw = memoryview(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True))
    sizes = np.frombuffer(raw[:56], "<i8")
    ends = 56 + np.cumsum(sizes)
    parts = [raw[e - n : e] for e, n in zip(ends, sizes, strict=True)]
    numbers = lambda x: np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<i4").ravel().astype(np.int64)

    def texts(sizes: np.ndarray, data: memoryview) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))]).astype(np.int32)
        valid = pa.py_buffer(np.packbits(sizes >= 0, bitorder="little"))
        return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(bytes(data)), valid)

    return np.frombuffer(parts[0], np.uint8), numbers(parts[1]), numbers(parts[2]), texts(numbers(parts[3]), parts[4]), texts(numbers(parts[5]), parts[6])


def _hits(group: list[tuple], k: int) -> pa.Table:
    """read_id, parent, hits of the pieces of some bins, which hold all pieces that their k-mers are in."""
    letters, count = (np.concatenate([g[j] for g in group]) for j in (0, 1))
    firsts = np.cumsum([0] + [len(g[3]) for g in group])
    of = np.concatenate([f + np.cumsum(g[2]) for f, g in zip(firsts, group, strict=False)])
    ids, names = (pa.concat_arrays([g[j] for g in group]) for j in (3, 4))
    named = names.dictionary_encode()
    parent = named.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    none, found = ~ids.is_valid().to_numpy(zero_copy_only=False), []
    sizes = count + k - 1
    starts, passes = np.cumsum(sizes) - sizes, max(1, int(count.sum()) // (4 * TOGETHER))
    # a bin of very many k-mers is looked at several times, each time at those with some of the hashes
    cuts = np.searchsorted(np.cumsum(count), np.arange(1, passes) * 4 * TOGETHER)
    chunks = [(a, z) for a, z in zip([0, *cuts], [*cuts, len(count)], strict=True) if a < z]
    for turn in range(passes):
        words, seqs = [], []
        for a, z in chunks:
            w = _kmer_words(letters[starts[a] : starts[z - 1] + sizes[z - 1]], starts[a:z] - starts[a], count[a:z], k)
            mine = slice(None) if passes == 1 else _hash(w) % np.uint64(passes) == turn
            words.append(w[:, mine])
            seqs.append(np.repeat(of[a:z], count[a:z])[mine])
        w, seq = np.concatenate(words, axis=1), np.concatenate(seqs)
        if not len(seq):
            continue
        order, new = _alike(w)
        seq, first = seq[order], np.flatnonzero(new)
        runs, of_parent = np.diff(np.append(first, len(seq))), parent[seq]
        for p, name in enumerate(named.dictionary):
            hits = np.bincount(seq[np.repeat(np.logical_or.reduceat(of_parent == p, first), runs)], minlength=len(ids))
            hits[none] = 0
            i = np.flatnonzero(hits)
            found.append(pa.table({"read_id": ids.take(pa.array(i)), "parent": pa.repeat(name, len(i)), "hits": hits[i]}))
    return _summed(found) if found else pa.table({"read_id": ids[:0], "parent": names[:0], "hits": np.zeros(0, np.int64)})


def _kmer_words(letters: np.ndarray, starts: np.ndarray, count: np.ndarray, k: int) -> np.ndarray:
    """Each k-mer of the pieces, or its reverse complement where that sorts first, as numbers of up to eight letters, which together
    hold them all."""
    both = np.concatenate([letters, _COMPLEMENT[letters[::-1]], np.zeros(8, np.uint8)])
    b = min(k, 8)
    eight = np.ndarray(len(both) - 8, "<u8", both, strides=(1,)).copy().byteswap() >> np.uint64(64 - 8 * b)
    steps = [*range(0, k - b, b), k - b]
    ahead = _ranges(starts, count)
    back = 2 * len(letters) - k - ahead
    one, two = eight[ahead], eight[back]
    less, tie = two < one, np.flatnonzero(one == two)
    for s in steps[1:]:
        one, two = eight[ahead[tie] + s], eight[back[tie] + s]
        less[tie[two < one]] = True
        tie = tie[one == two]
    at = np.where(less, back, ahead)
    return np.stack([eight[at + s] for s in steps])


def _hash(words: np.ndarray) -> np.ndarray:
    out = np.zeros(words.shape[1], np.uint64)
    for w in words:
        out = _mixed(out + w)
    return out


def _alike(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal columns lie together, and where each group of them begins: by hash, unless two share one."""
    hashes = _hash(words)
    order = np.argsort(hashes)
    found, hashes = words[:, order], hashes[order]
    differ = (found[:, 1:] != found[:, :-1]).any(0)
    if (differ & (hashes[1:] == hashes[:-1])).any():
        order = np.lexsort(words)
        found = words[:, order]
        differ = (found[:, 1:] != found[:, :-1]).any(0)
    return order, np.concatenate([[True], differ])


def _summed(tables: list[pa.Table]) -> pa.Table:
    """read_id, parent, hits: one row a read and parent."""
    out = pa.concat_tables(tables).group_by(["read_id", "parent"]).aggregate([("hits", "sum")])
    return pa.table({"read_id": out.column("read_id"), "parent": out.column("parent"), "hits": out.column("hits_sum")})


def evaluate(walks: DataFrame, nodes: DataFrame, edges: DataFrame, classified: DataFrame, column: str) -> DataFrame:
    """One row a haplotype: what ``edge_correctness``, ``phasing_errors``, ``kmer_error`` and ``n50`` say of its walks."""
    parts = [edge_correctness(walks, classified), phasing_errors(walks, nodes, column), kmer_error(walks, nodes, edges), n50(contig_lengths(walks, nodes, edges))]
    out = parts[0]
    for x in parts[1:]:
        out = out.join(x, "hap", "left")
    return out


def parent_average(metrics: DataFrame) -> DataFrame:
    """metric, value: means over haplotypes. metrics: hap, metric, value."""
    return metrics.groupBy("metric").agg(F.avg("value").alias("value"))


def wrong_kmer_fraction(nodes: DataFrame, hap: str) -> DataFrame:
    """fraction: all nodes' k-mers of the other parent over all their bases."""
    other = {"p": "kmer_count_m", "m": "kmer_count_p"}[hap]
    return nodes.agg(F.round(F.sum(other) / F.sum("read_length"), 6).alias("fraction"))
