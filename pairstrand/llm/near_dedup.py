"""Near-duplicate groups by HyperMinHash.

A document is the set of its 5-word shingles (64-bit hashes). A sketch has ``REGISTERS`` registers, each the number of
leading zeros (6 bits) of a smallest hash and the ``MANTISSA`` bits after them. A wide sketch has ``SEEDS`` hash functions
with ``BUCKETS`` buckets each, chosen by a hash's first bits. Small sets would leave most buckets empty, so sets of at most
``SMALL`` shingles have a tight sketch, one hash function and one bucket per register; sets whose sizes lie so near to
``SMALL`` that a similar set could be on its other side have both. Steps:

1. Sets that are equal become one node, a number with the smallest (id, MD5 of the text) that has the set.
2. Banding: empty registers take over their next neighbour, then ``BAND`` registers of as many hash functions form a band
   key. Sets of Jaccard similarity 0.75 share no band with a probability of (1 - 0.75^5)^64, about 3e-8.
3. Pairs, at most a few a node. A band's centre is its node of the smallest hash. First each node is held against one
   centre, the first of all its bands' centres, which connects groups of copies by one pair a node. Bands whose nodes are
   still unconnected give all pairs between unconnected nodes if these are few for its number of nodes (``FEW`` a node),
   else one pair a node, with a centre again; and after these, once more.
   Bands that even then have many unconnected pairs (a large group of copies that are mostly just too different) are joined
   to families by their common nodes. A family is dealt out in blocks by size of set and hash, and each two blocks whose
   sizes allow a link meet in one task, which compares their sketches, counts the intersections of those that may be linked
   and returns only links that connect: no pair is left out, and none is a row.
4. Pairs whose estimated similarity (corrected for chance collisions of registers) is lower than the threshold by over
   ``SIGMAS`` standard errors are dropped; the others are confirmed on their full sets.
5. Components of the confirmed links; where an id has several texts, the components of these are one document's, and so are one.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a text of one to four words is one shingle; a null
text, an empty one and one without words has no shingle and no link. Rows that share an id are one document with several
texts: they have one component, the smallest id that links of any of its texts reach. Among texts alone (``text_stays``) each
group of near copies keeps the smallest (id, MD5), so that a text which is no other's near copy stays. A row without id is linked with nothing: its component is null and it is kept. Texts of any length are taken whole; rows that are repeated are each returned; other
columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairstrand.llm.common import NO_ID, keyed, written
from pairstrand.llm.textarrays import Words, chunks, lower_ascii, mix, words
from pairstrand.operators.components import wcc

SHINGLE = 5
#: A link: 100 * intersection >= 75 * union.
PERCENT = 75
SEEDS, BUCKETS, MANTISSA = 5, 64, 10
BAND, REGISTERS = SEEDS, SEEDS * BUCKETS
SMALL = 64
SIGMAS = 5.5
#: Pairs a node up to which a band gives all its pairs.
FEW = 2
#: Nodes, and bytes of texts, of a family's block.
BLOCK, BLOCK_BYTES = 512, 16_000_000
#: Keys that a family's class is dealt to.
SALTS = 64
#: Shingles that are counted at once.
COLUMNS = 4096
#: Chance that registers of different hashes agree: same number of zeros (1/3) and same mantissa.
CHANCE = 2.0**-MANTISSA / 3

_MULT = np.random.default_rng(5).integers(1, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_SEED = np.random.default_rng(6).integers(1, 2**63, REGISTERS, dtype=np.uint64)
_BAND_SALT = mix(np.arange(1, 2 * BUCKETS + 1, dtype=np.uint64)).reshape(2, BUCKETS)
_BAND_MULT = np.random.default_rng(8).integers(1, 2**63, BAND, dtype=np.uint64) | np.uint64(1)


def shingles(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending within it: hashes and number per text."""
    n = len(w.hash)
    at = np.flatnonzero(w.doc[SHINGLE - 1 :] == w.doc[: n - SHINGLE + 1]) if n >= SHINGLE else np.zeros(0, np.int64)
    sums = np.zeros(len(at), np.uint64)
    for j in range(SHINGLE):
        sums += w.hash[at + j] * _MULT[j]
    short = np.flatnonzero((w.count > 0) & (w.count < SHINGLE))
    short_sums = w.count[short].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(SHINGLE - 1):
        has = w.count[short] > j
        short_sums[has] += w.hash[w.first[short[has]] + j] * _MULT[j]
    found, doc = mix(np.concatenate([sums, short_sums])), np.concatenate([w.doc[at], short])
    order = np.lexsort((found, doc))
    found, doc = found[order], doc[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
    return found[new], np.bincount(doc[new], minlength=len(w.count)).astype(np.int64)


def _pack(least: np.ndarray) -> np.ndarray:
    """Registers of smallest hashes; 0 where there was none."""
    empty = least == np.iinfo(np.uint64).max
    _, exponent = np.frexp((least >> np.uint64(11)).astype(np.float64))
    zeros = np.clip(53 - exponent, 0, 62).astype(np.uint64)
    mantissa = (least << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    return np.where(empty, 0, ((zeros + np.uint64(1)) << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)


def wide_sketches(found: np.ndarray, count: np.ndarray) -> np.ndarray:
    """One row of registers per set: (seed, bucket)."""
    n = len(count)
    doc = np.repeat(np.arange(n), count)
    shift = np.uint64(BUCKETS.bit_length() - 1)
    least = np.full((SEEDS, n * BUCKETS), np.iinfo(np.uint64).max, np.uint64)
    for s in range(SEEDS):
        g = mix(found + _SEED[s])
        np.minimum.at(least[s], doc * BUCKETS + (g >> (np.uint64(64) - shift)).astype(np.int64), g << shift)
    return _pack(least).reshape(SEEDS, n, BUCKETS).transpose(1, 0, 2).reshape(n, REGISTERS)


def tight_sketches(found: np.ndarray, count: np.ndarray) -> np.ndarray:
    """One row of registers per set (none empty): a hash function each."""
    if not len(count):
        return np.zeros((0, REGISTERS), np.uint16)
    starts = np.cumsum(count) - count
    return np.column_stack([_pack(np.minimum.reduceat(mix(found + seed), starts)) for seed in _SEED])


def band_keys(sketches: np.ndarray, tight: bool) -> np.ndarray:
    """Keys of the bands of each sketch: a register of each of BAND hash functions."""
    if tight:
        dense = sketches.reshape(len(sketches), BAND, BUCKETS)
    else:
        regs = sketches.reshape(-1, BUCKETS)
        twice = np.concatenate([regs, regs], axis=1)
        place = np.where(twice > 0, np.arange(2 * BUCKETS), 4 * BUCKETS)
        nearest = np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1][:, :BUCKETS]
        dense = np.take_along_axis(twice, np.minimum(nearest, 2 * BUCKETS - 1), axis=1).reshape(len(sketches), BAND, BUCKETS)
    keys = np.zeros((len(sketches), BUCKETS), np.uint64)
    for s in range(BAND):
        keys = mix(keys + (dense[:, s].astype(np.uint64) + np.uint64(1)) * _BAND_MULT[s])
    return mix(keys + _BAND_SALT[int(tight)])


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity of sketches, row by row, and the number of registers that it rests on."""
    filled = ((a > 0) | (b > 0)).sum(1)
    same = ((a == b) & (a > 0)).sum(1)
    share = same / np.maximum(filled, 1)
    return (share - CHANCE) / (1 - CHANCE), filled


def _floor(filled: np.ndarray) -> np.ndarray:
    """The least estimate, from so many registers, that doesn't rule out a link."""
    bound = PERCENT / 100
    return bound - SIGMAS * np.sqrt(bound * (1 - bound) / np.maximum(filled, 1))


def _sets(bodies: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    texts = [lower_ascii(t) for t in bodies]
    for a, b in chunks(texts):
        yield shingles(words(texts[a:b]))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, md5 (of the text), n_shingles, bytes (of the text), set_hash (128 bits, null without shingles), wide and
    tight (sketches, null if not needed)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            raw = [t.encode() for t in rows["body"]]
            at, size, md5 = 0, np.array([len(t) for t in raw], np.int64), [hashlib.md5(t).digest() for t in raw]
            del raw
            for found, count in _sets(rows["body"].tolist()):
                n = len(count)
                sketches = {}
                for name, make, needed in (("wide", wide_sketches, 100 * count >= PERCENT * SMALL), ("tight", tight_sketches, (count > 0) & (PERCENT * count <= 100 * SMALL))):
                    column = np.full(n, None, object)
                    column[needed] = [x.tobytes() for x in make(found[np.repeat(needed, count)], count[needed])]
                    sketches[name] = column
                sums = np.zeros((n, 2), np.uint64)
                full = np.flatnonzero(count)
                if len(full):
                    starts = (np.cumsum(count) - count)[full]
                    sums[full, 0] = np.add.reduceat(mix(found ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
                    sums[full, 1] = np.add.reduceat(mix(found + np.uint64(0x1234567812345678)), starts) ^ count[full].astype(np.uint64)
                yield pd.DataFrame(
                    {
                        "id": rows["id"].to_numpy()[at : at + n],
                        "md5": md5[at : at + n],
                        "n_shingles": count,
                        "bytes": size[at : at + n],
                        "set_hash": [x.tobytes() if c else None for x, c in zip(sums, count, strict=True)],
                        **sketches,
                    }
                )
                at += n

    return keyed(docs, id_col, text_col).mapInPandas(run, "id long, md5 binary, n_shingles long, bytes long, set_hash binary, wide binary, tight binary")


def _rows(sketches: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint16).reshape(len(sketches), REGISTERS)


def _bands(nodes: DataFrame) -> DataFrame:
    """Per node and band: key, node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for name in ("wide", "tight"):
                own = rows[rows[name].notna()]
                if len(own):
                    keys = band_keys(_rows(own[name]), name == "tight")
                    yield pd.DataFrame({"key": keys.view(np.int64).ravel(), "node": np.repeat(own["node"].to_numpy(), BUCKETS)})

    return nodes.select("node", "wide", "tight").mapInPandas(run, "key long, node long")


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose estimated similarity isn't clearly under the threshold."""

    @F.pandas_udf("boolean")
    def near(wide_a: pd.Series, wide_b: pd.Series, tight_a: pd.Series, tight_b: pd.Series) -> pd.Series:
        keep = np.zeros(len(wide_a), bool)
        wide = (wide_a.notna() & wide_b.notna()).to_numpy()
        tight = ~wide & (tight_a.notna() & tight_b.notna()).to_numpy()  # with neither, their sizes are too far apart
        for which, a, b in ((wide, wide_a, wide_b), (tight, tight_a, tight_b)):
            share, filled = estimate(_rows(a[which]), _rows(b[which]))
            keep[which] = share >= _floor(filled)
        return pd.Series(keep)

    sketch = lambda x: nodes.select(F.col("node").alias(x), F.col("wide").alias(f"wide_{x}"), F.col("tight").alias(f"tight_{x}"))
    with_both = pairs.join(sketch("b"), "b").join(sketch("a"), "a")
    return with_both.where(near("wide_a", "wide_b", "tight_a", "tight_b")).select("a", "b").distinct()


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that are links on their full sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            index: dict[str, int] = {}
            ia, ib = ([index.setdefault(t, len(index)) for t in rows[c].tolist()] for c in ("body_a", "body_b"))
            sets = [s for found, count in _sets(list(index)) for s in np.split(found, np.cumsum(count)[:-1])]
            keep = np.zeros(len(rows), bool)
            for k, (i, j) in enumerate(zip(ia, ib, strict=True)):
                x, y = sets[i], sets[j]
                if 100 * min(len(x), len(y)) >= PERCENT * max(len(x), len(y)) > 0:
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[k] = 100 * both >= PERCENT * (len(x) + len(y) - both)
            yield rows.loc[keep, ["a", "b"]]

    with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("body").alias("body_b")), "b")
    with_both = with_b.join(texts.select(F.col("node").alias("a"), F.col("body").alias("body_a")), "a")
    return with_both.select("a", "b", "body_a", "body_b").mapInPandas(run, "a long, b long").distinct()


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets with one another."""
    of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, index, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True, return_counts=True)
    common = np.flatnonzero(times > 1)
    column = np.full(len(times), -1)
    column[common] = np.arange(len(common))
    column = column[index]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, len(common), COLUMNS):
        own = np.flatnonzero((column >= lo) & (column < lo + COLUMNS))
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[of[own], column[own] - lo] = 1
        out += has @ has.T
    return out.astype(np.int64)


def _likely_within(rows: pd.DataFrame) -> np.ndarray:
    """Which rows may be linked with one another, by their sketches."""
    out = np.zeros((len(rows), len(rows)), bool)
    known = np.zeros((len(rows), len(rows)), bool)  # pairs that have a kind of sketch in common
    for name in ("wide", "tight"):
        own = np.flatnonzero(rows[name].notna())
        sketches = _rows(rows[name].iloc[own])
        for k, i in enumerate(own.tolist()):
            share, filled = estimate(sketches[k : k + 1], sketches[k:])
            later = own[k:]
            new = ~known[i, later]
            out[i, later[new & (share >= _floor(filled))]] = True
            known[i, later] = True
    return out | out.T


def _block_links(rows: pd.DataFrame) -> pd.DataFrame:
    """Links that connect the nodes of two blocks (or of one) as all links between different labels would."""
    rows = rows.sort_values(["node", "body"], ignore_index=True)
    label, mine = rows["label"].to_numpy(), rows["mine"].to_numpy()
    meet = label[:, None] != label[None, :]
    if rows["b1"].iloc[0] != rows["b2"].iloc[0]:
        meet &= mine[:, None] != mine[None, :]
    meet &= _likely_within(rows)
    pick = np.flatnonzero(meet.any(1))
    if not len(pick):
        return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
    rows, label, meet = rows.iloc[pick], label[pick], meet[np.ix_(pick, pick)]
    sets = [s for found, count in _sets(rows["body"].tolist()) for s in np.split(found, np.cumsum(count)[:-1])]
    size = np.array([len(x) for x in sets])
    both = _intersections(sets)
    link = meet & (100 * both >= PERCENT * (size[:, None] + size[None, :] - both))
    root = {x: x for x in label.tolist()}

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    node, out = rows["node"].to_numpy(), []
    for i, j in zip(*np.nonzero(np.triu(link)), strict=True):
        p, q = top(label[i]), top(label[j])
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((node[i], node[j]))
    return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)


def _family_links(open_: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links of the bands' nodes, family by family. open_: key, node, label."""
    # bands by their smallest nodes, and nodes by the smallest of these: bands that share a node are one edge of a small graph
    first = open_.groupBy("key").agg(F.min("node").alias("first"))
    of_node = written(open_.join(first.hint("merge"), "key").select("node", "first").distinct(), "near-firsts")
    least = of_node.groupBy("node").agg(F.min("first").alias("least"))
    joined = wcc(of_node.join(least, "node").select("first", "least").distinct(), "first", "least")
    families = least.join(joined.select(F.col("node").alias("least"), F.col("component").alias("family")), "least").select("node", "family")
    # sets of which one has over 4/3 as many shingles can't be linked, so only neighbouring classes of sizes meet
    size_class = F.floor(F.log(100 / PERCENT, F.col("n_shingles").cast("double"))).cast("int")
    sized = nodes.select("node", "bytes", "wide", "tight", size_class.alias("class"))
    members = written(families.join(open_.select("node", "label").distinct(), "node").join(sized, "node"), "near-members")
    n_blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("bytes") / BLOCK_BYTES)).cast("int")
    blocks = written(members.groupBy("family", "class").agg(n_blocks.alias("blocks")), "near-blocks")
    beside = blocks.select("family", (F.col("class") + 1).alias("class"), F.col("blocks").alias("below")).join(blocks.select("family", (F.col("class") - 1).alias("class"), F.col("blocks").alias("above")), ["family", "class"], "full")
    # a class of a family may hold a large share of all nodes: its one row is copied to SALTS keys, among which its nodes are dealt
    rooms = blocks.join(beside, ["family", "class"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = members.drop("bytes").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(rooms, ["family", "class", "salt"]).withColumn("own", own)
    name = lambda c, n: F.concat_ws(":", c, n)
    along = lambda c, n: F.coalesce(F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda k: name(c, k)), F.array().cast("array<string>"))
    others = F.concat(along(F.col("class") - 1, "below"), along(F.col("class"), "blocks"), along(F.col("class") + 1, "above"))
    met = dealt.withColumn("mine", name(F.col("class"), F.col("own"))).withColumn("other", F.explode(others))
    met = met.select("family", F.least("mine", "other").alias("b1"), F.greatest("mine", "other").alias("b2"), "mine", "node", "label", "wide", "tight")
    return met.join(texts, "node").groupBy("family", "b1", "b2").applyInPandas(_block_links, "a long, b long").distinct()


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (src, dst) enough to connect all nodes that chains of links connect. docs: id, body; nodes: node, id, md5 (whose
    text has the set), sketches."""
    bands = _bands(nodes)
    order = F.struct(F.xxhash64("node").alias("order"), F.col("node").alias("node"))
    by_key = bands.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.min(order).alias("c")).where("lo < hi")
    centres = written(by_key.select("key", F.col("c.node").alias("centre")), "near-keys")
    # merge: these sides grow with the input, so none is broadcast however few there are; skewed joins can be split
    rest = written(bands.join(centres.hint("merge"), "key"), "near-bands")
    wanted = nodes.select("node", "id", "md5").join(rest.select("node").distinct().hint("merge"), "node", "left_semi")
    with_md5 = docs.withColumn("md5", F.unhex(F.md5(F.col("body").cast("binary"))))
    texts = written(with_md5.join(wanted.hint("merge"), ["id", "md5"]).select("node", "body").distinct(), "near-texts")
    pair = [F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")]
    # one pair a node: with the first of all its bands' centres
    first = rest.groupBy("node").agg(F.min(F.struct(F.xxhash64("centre").alias("order"), "centre")).alias("c")).select("node", F.col("c.centre").alias("centre"))
    found = [written(_confirmed(_likely(first.where("node <> centre").select(*pair).distinct(), nodes), texts), "near-links")]
    rest = rest.select("key", "node")
    for last in (False, True):
        labels = wcc(functools.reduce(DataFrame.union, found), "a", "b")
        active = written(rest.join(labels.hint("merge"), "node", "left").select("key", "node", F.coalesce("component", "node").alias("label")), "near-active")
        by_label = active.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
        sizes = by_label.groupBy("key").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("inner"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
        few = (F.col("n") * F.col("n") - F.col("inner")) <= 2 * FEW * F.col("n")
        open_ = written(active.join(written(sizes.select("key", few.alias("few")), "near-sizes").hint("merge"), "key"), "near-open")
        one, other = open_.where("few"), open_.where("few").select("key", F.col("node").alias("b"), F.col("label").alias("label_b"))
        pairs = one.join(other.hint("merge"), "key").where("label <> label_b and node < b").select(F.col("node").alias("a"), "b")
        many = open_.where("not few")
        if not last:
            held = many.groupBy("key").agg(F.min(F.struct(F.xxhash64("label").alias("order"), "label", "node")).alias("c"))
            to_centre = many.join(held.select("key", F.col("c.label").alias("other"), F.col("c.node").alias("centre")).hint("merge"), "key").where("label <> other")
            pairs = pairs.union(to_centre.select(*pair))
        pairs = written(_likely(pairs.distinct(), nodes), "near-pairs")
        found.append(written(_confirmed(pairs, texts), "near-links"))
        if last:
            found.append(written(_family_links(many, nodes, texts), "near-links"))
        rest = open_.select("key", "node")
    return functools.reduce(DataFrame.union, found).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def near_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id (NO_ID for null), md5, n_shingles, component_id, text_stays."""
    signed = written(signatures(docs, id_col, text_col), "near-signed")
    with_id = signed.where((F.col("n_shingles") > 0) & (F.col("id") != NO_ID))
    same = [F.first(c).alias(c) for c in ("wide", "tight", "n_shingles", "bytes")]
    sets = with_id.groupBy("set_hash").agg(F.min(F.struct("id", "md5")).alias("least"), *same)
    # numbers that are fixed as the table is written
    nodes = written(sets.select(F.monotonically_increasing_id().alias("node"), "set_hash", "least.id", "least.md5", *(n for n in ("wide", "tight", "n_shingles", "bytes"))), "near-nodes")
    joined = wcc(links(keyed(docs, id_col, text_col), nodes))
    names = nodes.select("set_hash", "node", "id", "md5")
    of_set = written(names.join(joined.hint("merge"), "node", "left").select("set_hash", "id", "md5", F.coalesce("component", "node").alias("texts")), "near-components")
    groups = of_set.groupBy("texts").agg(F.min(F.struct("id", "md5")).alias("least"))
    groups = groups.select("texts", "least", F.col("texts").alias("whole"))
    # ids with several texts join the components of these
    several = written(signed.where(F.col("id") != NO_ID).groupBy("id").agg(F.min("md5").alias("lo"), F.max("md5").alias("hi")).where("lo < hi").select("id"), "near-several")
    repeated = not several.isEmpty()
    if repeated:
        of_id = with_id.select("id", "set_hash").distinct().join(several, "id").join(of_set.select("set_hash", "texts").hint("merge"), "set_hash")
        of_id = written(of_id.select("id", "texts").distinct(), "near-ids")
        across = of_id.join(of_id.groupBy("id").agg(F.min("texts").alias("first")), "id").where("first <> texts")
        documents = wcc(across, "first", "texts").select(F.col("node").alias("texts"), "component")
        groups = groups.join(documents.hint("merge"), "texts", "left").select("texts", "least", F.coalesce("component", "texts").alias("whole"))
    groups = written(groups, "near-groups")
    component = groups.groupBy("whole").agg(F.min("least.id").alias("component_id"))
    groups = written(groups.join(component.hint("merge"), "whole"), "near-facts")
    facts = of_set.select("set_hash", "texts").join(groups.hint("merge"), "texts").select("set_hash", "least", "component_id")
    out = signed.select("id", "md5", "n_shingles", "set_hash").join(facts.hint("merge"), "set_hash", "left")
    linked = F.col("component_id").isNotNull() & (F.col("id") != NO_ID)
    stays = ~linked | (F.struct("id", "md5") == F.col("least"))
    component_id = F.when(F.col("id") != NO_ID, F.coalesce(F.col("component_id") if not repeated else F.coalesce("of_document", "component_id"), "id"))
    if repeated:
        of_document = of_id.join(groups.hint("merge"), "texts").groupBy("id").agg(F.min("component_id").alias("of_document"))
        out = out.join(of_document.hint("merge"), "id", "left")
    return out.select("id", "md5", "n_shingles", component_id.alias("component_id"), stays.alias("text_stays"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable by links), kept (id is component_id), text_stays (the row's
    text is the one that its near copies leave, or has none)."""
    own = F.nullif("id", F.lit(NO_ID))
    kept = F.coalesce(own == F.col("component_id"), F.lit(True))
    return near_texts(docs, id_col, text_col).select(own.alias(id_col), "n_shingles", "component_id", kept.alias("kept"), "text_stays")
