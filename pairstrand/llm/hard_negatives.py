"""Hard negatives by norm-bucketed search.

For every anchor the nearest rows of its own label are its positives, and each positive opens a window: negatives are rows of other
labels whose score (inner product with the anchor) lies between two shares of the positive's, the highest ones first. Both
searches work alike:

* Candidates are sorted by norm, largest first, and cut into buckets of at most ``BUCKET`` rows, each packed into one row with
  its largest norm.
* By Cauchy-Schwarz no row of a bucket scores over |anchor| * (largest norm). A bucket where that is less than a window's need,
  the larger of its lower limit and its running kth score, is pruned: before the shuffle for a whole block of anchors, inside
  a task for each anchor. A task takes its buckets by falling norm, so it stops at the first that no anchor needs.
* There are two rounds. The first takes the buckets of the largest norms, about a sixteenth; the kth scores that it finds go with
  the anchors into the second, whose tasks then return only rows that better them. So what is returned per window doesn't
  grow with the number of buckets.

Vectors are integers floor(scale * x), scores exact. Anchors are dealt to blocks of about ``BLOCK`` by classes of norms, and
a block meets the buckets of a shard (``SHARD`` buckets) in one task; neither a label nor a norm held by many rows makes a task larger.
Blocks' smallest needs are the only figures that go through the driver.

Defined results: rows without id, label or vector, and those with a null, NaN or infinite component take no part, nor do vectors
of another dimension than the most common one (of equally common ones, the largest); of rows that share an id the one of
the smallest label, then vector, takes part, so repeated rows count once; integers are kept within what lets 100 times a score
fit into 64 bits (some 37 million for 64 components); ties go to the smaller id; an anchor without positives or a window without
negatives gives no row; other columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairstrand.llm.common import shuffle_partitions, small_batches, written

BUCKET, SHARD, BLOCK = 1024, 8, 1024
#: One of so many ranges of norms is searched in the first round.
FIRST = 16
#: Bounds are taken larger by this share, so that rounding never prunes a bucket that is needed.
SLACK = 1e-9
_PACKED = "number long, bucket long, top double, ids binary, labels binary, v binary"
_HITS = "anchor long, slot int, id long, score long"


def _usable(vectors: DataFrame, label: Column, scale: int, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """id, label, v (integers), norm2 of the rows that take part; and the dimension."""
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), label.cast("long").alias("label"), vectors[vector_col].cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    most = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    d = most[0]["d"] if most else 0
    bound = math.isqrt((2**63 - 1) // (100 * max(d, 1)))
    low, high = F.lit(-bound).cast("long"), F.lit(bound).cast("long")
    whole = F.transform("v", lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x * scale, F.lit(float(bound))), F.lit(float(-bound)))), high), low))
    one = rows.where(F.size("v") == d).groupBy("id").agg(F.min(F.struct("label", whole.alias("v"))).alias("r")).select("id", "r.label", "r.v")
    return one.withColumn("norm2", F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)), d


def _buckets(rows: DataFrame, parts: int) -> DataFrame:
    """Rows by falling norm, packed into buckets: number (of the range of norms), bucket, top (largest norm), ids, labels, v."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, k = [], 0

        def packed(own: pd.DataFrame) -> pd.DataFrame:
            at = int(own["part"].iloc[0])
            v = np.array(own["v"].tolist(), "<i8")
            return pd.DataFrame({"number": [at], "bucket": [(at << 32) + k], "top": [math.sqrt(own["norm2"].max())], "ids": [own["id"].to_numpy("<i8").tobytes()], "labels": [own["label"].to_numpy("<i8").tobytes()], "v": [v.tobytes()]})

        for rows_ in batches:
            held.append(rows_)
            while sum(map(len, held)) >= BUCKET:
                own = pd.concat(held, ignore_index=True)
                yield packed(own[:BUCKET])
                held, k = [own[BUCKET:]], k + 1
        held = [x for x in held if len(x)]
        if held:
            yield packed(pd.concat(held, ignore_index=True))

    ordered = rows.repartitionByRange(parts, F.desc("norm2"), "id").sortWithinPartitions(F.desc("norm2"), "id")
    return ordered.withColumn("part", F.spark_partition_id()).mapInPandas(run, _PACKED)


def exact_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows of integers."""
    if x.shape[1] * float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) < 2**53:
        return (x.astype(float) @ y.T.astype(float)).astype(np.int64)
    return x @ y.T


def _merged(top: tuple[np.ndarray, ...], more: tuple[np.ndarray, ...], k: int, kth: np.ndarray) -> tuple[np.ndarray, ...]:
    """The k best (window, score, id) of each window; kth is brought up to date in place."""
    w, s, i = (np.concatenate(c) for c in zip(top, more, strict=True))
    order = np.lexsort((i, -s, w))
    w, s, i = w[order], s[order], i[order]
    place = np.arange(len(w)) - np.searchsorted(w, w)
    last = place == k - 1
    kth[w[last]] = np.maximum(kth[w[last]], s[last])
    keep = place < k
    return w[keep], s[keep], i[keep]


def search_buckets(buckets: pd.DataFrame, anchors: pd.DataFrame, k: int, same: bool, low: int, high: int) -> pd.DataFrame:
    """The k best candidates of each window of each anchor, in buckets by falling norm.

    anchors: id, label, v, norm2 and windows (dicts of slot, score of the positive or None, kth score or None). same: candidates have the anchor's
    label and any score; else another label and a score of ``low`` to ``high`` hundredths of the positive's.
    """
    nothing = pd.DataFrame({"anchor": [], "slot": [], "id": [], "score": []}, dtype=np.int64)
    if not len(buckets) or not len(anchors):
        return nothing
    x, ids, labels = np.array(anchors["v"].tolist(), np.int64).reshape(len(anchors), -1), anchors["id"].to_numpy(np.int64), anchors["label"].to_numpy(np.int64)
    norms = np.sqrt(anchors["norm2"].to_numpy(float))
    flat = [(a, w["slot"], w["score"], w["kth"]) for a, windows in enumerate(anchors["windows"]) for w in windows]
    if not flat:
        return nothing
    of, slot = np.array([f[0] for f in flat]), np.array([f[1] for f in flat])
    least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    floor = np.array([least if same else -((-low * f[2]) // 100) for f in flat], np.int64)
    roof = np.array([most if same else (high * f[2]) // 100 for f in flat], np.int64)
    kth = np.array([least if f[3] is None else f[3] for f in flat], np.int64)
    top = (np.zeros(0, np.int64),) * 3
    for _, bucket in buckets.sort_values(["top", "bucket"], ascending=[False, True]).iterrows():
        need = np.maximum(floor, kth)
        reach = norms * bucket["top"] * (1 + SLACK)
        active = np.flatnonzero(reach[of] >= need)
        if not len(active):
            break  # every later bucket has smaller norms
        own = np.unique(of[active])
        row = np.zeros(len(anchors), np.int64)
        row[own] = np.arange(len(own))
        c_ids, c_labels = np.frombuffer(bucket["ids"], "<i8"), np.frombuffer(bucket["labels"], "<i8")
        scores = exact_products(x[own], np.frombuffer(bucket["v"], "<i8").reshape(len(c_ids), -1))
        alike = labels[own][:, None] == c_labels[None, :]
        fit = alike & (ids[own][:, None] != c_ids[None, :]) if same else ~alike
        found = []
        for j in np.unique(slot[active]):
            w = active[slot[active] == j]
            s = scores[row[of[w]]]
            a, b = np.nonzero(fit[row[of[w]]] & (s >= need[w][:, None]) & (s <= roof[w][:, None]))
            found.append((w[a], s[a, b], c_ids[b]))
        top = _merged(top, tuple(np.concatenate(c) for c in zip(*found, strict=True)), k, kth)
    return pd.DataFrame({"anchor": ids[of[top[0]]], "slot": slot[top[0]], "id": top[2], "score": top[1]})


def _best(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def _searched(buckets: DataFrame, anchors: DataFrame, windows: DataFrame, k: int, same: bool, low: int, high: int) -> DataFrame:
    """anchor, slot, id, score, rank: the k best of each window. windows: anchor, slot, score."""
    facts = buckets.agg(F.count(F.lit(1)).alias("n"), F.max("number").alias("last")).first()
    n_shards, first = -(-facts["n"] // SHARD), max(1, ((facts["last"] or 0) + 1) // FIRST)

    def one_round(some: DataFrame, known: DataFrame, kind: str) -> DataFrame:
        asked = known.groupBy("anchor").agg(F.collect_list(F.struct("slot", "score", "kth")).alias("windows"), F.min(F.greatest(F.col("least").cast("double"), F.col("kth").cast("double"))).alias("need"))
        asked = written(anchors.join(asked.withColumnRenamed("anchor", "id"), "id"), "mining-anchors")
        # the smallest norm that a block of anchors still needs; a block's number and this are all that the driver sees
        needs = asked.groupBy("block").agg(F.min(F.when(F.col("norm2") > 0, F.col("need") / F.sqrt("norm2")).otherwise(F.when(F.col("need") > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf"))))).alias("r")).collect()
        if not needs:
            return asked.sparkSession.createDataFrame([], _HITS)
        needed = F.array(*(F.struct(F.lit(r["block"]).alias("block"), F.lit(r["r"]).cast("double").alias("r")) for r in needs))
        shard = F.pmod(F.xxhash64("bucket"), F.lit(n_shards)).cast("int").alias("shard")
        meets = F.explode(F.transform(F.filter(needed, lambda b: b["r"].isNull() | (b["r"] <= F.col("top") * (1 + SLACK))), lambda b: b["block"])).alias("block")
        left = some.select("bucket", "top", "ids", "labels", "v", shard, meets)
        right = asked.select("block", "id", "label", "v", "norm2", "windows", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"))
        joined = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard"))
        return written(joined.applyInPandas(lambda b, a: search_buckets(b, a, k, same, low, high), _HITS), kind)

    # a window's lower limit, rounded down; it only prunes whole buckets here
    open_ = windows.withColumn("least", F.lit(None).cast("long") if same else F.floor(F.col("score") * low / 100) - 1)
    begun = one_round(buckets.where(F.col("number") < first), open_.withColumn("kth", F.lit(None).cast("long")), "mining-first")
    kth = _best(begun, k).where(F.col("rank") == k).select("anchor", "slot", F.col("score").alias("kth"))
    rest = one_round(buckets.where(F.col("number") >= first), open_.join(kth, ["anchor", "slot"], "left"), "mining-rest")
    return _best(begun.unionByName(rest), k)


def mine(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    is_anchor (on the column ``id``) says which rows are anchors; label (on the columns of ``vectors``) is each row's label.
    """
    spark, parts = vectors.sparkSession, shuffle_partitions(vectors.sparkSession)
    small_batches(spark)
    rows, _ = _usable(vectors, label, scale, id_col, vector_col)
    rows = written(rows, "mining-rows")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    # classes of norms, a quarter of a doubling each, and blocks within them
    norm_class = F.when(F.col("norm2") > 0, F.floor(2 * F.log2(F.col("norm2").cast("double")))).otherwise(F.lit(-1)).cast("int")
    asked = rows.where(is_anchor).withColumn("class", norm_class)
    counts = {r["class"]: -(-r["n"] // BLOCK) for r in asked.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 128 classes
    if not counts:
        return spark.createDataFrame([], schema)
    base, first_block = {}, 0
    for c, n in sorted(counts.items()):
        base[c], first_block = (first_block, n), first_block + n
    pick = lambda j: F.create_map(*(F.lit(x) for c, b in base.items() for x in (c, b[j])))[F.col("class")]
    block = pick(0) + F.pmod(F.xxhash64("id"), pick(1)).cast("int")
    anchors = written(asked.select("id", "label", "v", "norm2", block.alias("block")), "mining-asked")
    buckets = written(_buckets(rows, parts), "mining-buckets")
    one = anchors.select(F.col("id").alias("anchor"), F.lit(1).alias("slot"), F.lit(None).cast("long").alias("score"))
    near = written(_searched(buckets, anchors, one, positives, True, low, high), "mining-positives")
    windows = near.select("anchor", F.col("rank").alias("slot"), "score")
    far = _searched(buckets, anchors, windows, negatives, False, low, high)
    pairs = near.select("anchor", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = far.withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score").join(pairs, ["anchor", "slot"])
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
