"""Nearest neighbours by inner product with learned partitions.

On a bounded sample (``SAMPLE`` vectors, those whose ids have the smallest hashes) the neighbour graph is built and cut into
balanced parts: recursive halving along principal directions, then rounds in which vectors move to the part that holds most
of their neighbours, as far as the part has room. A small network (one hidden layer) learns from a vector the parts of its
neighbours. Every vector is indexed in its most probable part; a query is routed to its ``probes`` most probable parts, and
all vectors there are reranked with exact inner products in double precision. ``probes`` is the least number that finds
``RECALL`` of the true neighbours of sample vectors that the network hasn't seen; with no usable structure it grows to all
parts, which is exact search.

Hot groups: of equal vectors only the ``k + 1`` smallest ids can be among a query's ``k`` nearest, so a limit within each
task drops the others before the shuffle without changing any answer. Parts are split into blocks of candidates and of
queries, so no task has to hold more than a block of each.

Defined results: vectors that are null, empty, all zero, or hold null, NaN or infinite components take no part, nor do
those without id or of another dimension than the most common one (of equally common ones, the largest); equal rows (id and
vector) count once; ties go to the smaller id; with fewer than ``k`` candidates all are returned; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairstrand.llm.common import written

SAMPLE, HELD_OUT, NEIGHBOURS = 8192, 1024, 20
#: Share of the held-out sample's true neighbours that routing has to reach.
RECALL = 0.97
#: At least so many sample vectors a part.
LEAST_PART = 64
HIDDEN, EPOCHS, BATCH = 128, 24, 256
CANDIDATE_BLOCK, QUERY_BLOCK = 4096, 2048
SLACK = 0.1


@dataclass
class Router:
    """Parts' scores of a vector: a network of one hidden layer."""

    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1
    recall: float = 1.0

    @property
    def parts(self) -> int:
        return self.w2.shape[1]

    def scores(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum(((x - self.mean) / self.scale) @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def ranked(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n most probable parts of each vector, best first."""
        return np.argsort(-self.scores(x), axis=1, kind="stable")[:, :n]


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of each vector's k largest inner products with other vectors."""
    out = []
    for a in range(0, len(x), 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out.append(np.argpartition(-s, k - 1, axis=1)[:, :k].copy())  # not a view, which would keep the whole block
    return np.concatenate(out)


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """Part of each vector; parts is a power of two, and no part exceeds its share by over SLACK."""
    part = np.zeros(len(x), np.int64)
    for level in range(parts.bit_length() - 1):
        nxt = np.zeros_like(part)
        for p in range(1 << level):
            own = np.flatnonzero(part == p)
            if not len(own):
                continue
            c = x[own] - x[own].mean(0)
            direction = np.linalg.eigh(c.T @ c)[1][:, -1]
            order = own[np.argsort(c @ direction, kind="stable")]
            nxt[order[len(order) // 2 :]] = 1
        part = 2 * part + nxt
    room = int(np.ceil(len(x) / parts * (1 + SLACK)))
    # neighbours both ways: those that a vector names, and those that name it
    ends = np.concatenate([graph.ravel(), np.repeat(np.arange(len(x)), graph.shape[1])])
    rows = np.concatenate([np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()])
    for _ in range(12):
        votes = np.bincount(rows * parts + part[ends], minlength=len(x) * parts).reshape(len(x), parts)
        best = votes.argmax(1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), part]
        size = np.bincount(part, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < room:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


def train(x: np.ndarray, target: np.ndarray) -> Router:
    """Fit the network to distributions over parts (cross-entropy, Adam)."""
    rng = np.random.default_rng(3)
    d, parts = x.shape[1], target.shape[1]
    r = Router(x.mean(0), float(x.std()) or 1.0, rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts))
    weights = [r.w1, r.b1, r.w2, r.b2]
    m, v, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    z = (x - r.mean) / r.scale
    for epoch in range(EPOCHS):
        rate = 3e-3 * (1 - epoch / EPOCHS)
        order = rng.permutation(len(x))
        for a in range(0, len(x), BATCH):
            i = order[a : a + BATCH]
            pre = z[i] @ r.w1 + r.b1
            hidden = np.maximum(pre, 0)
            s = hidden @ r.w2 + r.b2
            p = np.exp(s - s.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            ds = (p - target[i]) / len(i)
            dh = (ds @ r.w2.T) * (pre > 0)
            step += 1
            for w, g, mm, vv in zip(weights, (z[i].T @ dh, dh.sum(0), hidden.T @ ds, ds.sum(0)), m, v, strict=True):
                mm += 0.1 * (g - mm)
                vv += 0.001 * (g * g - vv)
                w -= rate * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
    return r


def fit(x: np.ndarray, n_rows: int) -> Router:
    """Learn parts for ``n_rows`` vectors from the sample ``x``."""
    wanted = max(1, int(np.sqrt(max(1, n_rows)) / 4))
    parts = 1 << max(0, min(wanted.bit_length() - 1, max(1, len(x) // LEAST_PART).bit_length() - 1))
    d = x.shape[1] if x.ndim == 2 else 0
    if parts < 2 or len(x) <= 2 * NEIGHBOURS:
        return Router(np.zeros(d), 1.0, np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    graph = neighbour_graph(x, NEIGHBOURS)
    part = balanced_parts(x, graph, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), NEIGHBOURS), part[graph].ravel()), 1 / (NEIGHBOURS + 1))
    target[np.arange(len(x)), part] += 1 / (NEIGHBOURS + 1)
    held = np.random.default_rng(4).permutation(len(x))[: min(HELD_OUT, len(x) // 4)]
    seen = np.setdiff1d(np.arange(len(x)), held)
    r = train(x[seen], target[seen])
    home = r.ranked(x, 1)[:, 0]
    place = np.empty((len(held), parts), np.int64)
    np.put_along_axis(place, r.ranked(x[held], parts), np.arange(parts)[None, :], axis=1)
    needed = np.take_along_axis(place, home[graph[held]], axis=1)  # probes that reach each true neighbour, less 1
    reached = np.cumsum(np.bincount(needed.ravel(), minlength=parts)) / needed.size
    r.probes = int(np.argmax(reached >= RECALL)) + 1
    r.recall = float(reached[r.probes - 1])
    return r


def usable(embedding: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(embedding, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return embedding.isNotNull() & finite & F.exists(embedding, lambda c: c != 0)


def _best(scores: np.ndarray, ids: np.ndarray, x: np.ndarray, q: np.ndarray, q_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact scores of a query's k best candidates."""
    if len(scores) > k + 1:
        least = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
        pick = np.flatnonzero(scores >= least - 1e-9 * max(1.0, abs(least)))
    else:
        pick = np.arange(len(scores))
    pick = pick[ids[pick] != q_id]
    exact = (x[pick] * q).sum(1)
    order = np.lexsort((ids[pick], -exact))[:k]
    return ids[pick][order], exact[order]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", router: Router | None = None) -> DataFrame:
    """Each query's k nearest of ``vectors`` (its own row aside): query_id, rank, vec_id, score."""
    spark = vectors.sparkSession

    def rows_of(df: DataFrame) -> DataFrame:
        v = df.select(df[id_col].cast("long").alias("id"), df[vector_col].cast("array<double>").alias("v"))
        return v.where(F.col("id").isNotNull() & usable(F.col("v")))

    out_schema = "query_id long, rank int, vec_id long, score double"
    all_rows = rows_of(vectors)
    dimensions = all_rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not dimensions:
        return spark.createDataFrame([], out_schema)
    d, n = dimensions[0]["d"], dimensions[0]["n"]
    all_rows, asked = all_rows.where(F.size("v") == d), rows_of(queries).where(F.size("v") == d)
    if router is None:
        sample = all_rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas()
        router = fit(np.array(sample["v"].tolist(), float).reshape(-1, d), n)
    shared = spark.sparkContext.broadcast(router)  # some 100 kB: the network's weights

    def routed(n_parts: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                if len(rows):
                    parts = shared.value.ranked(np.array(rows["v"].tolist(), float), n_parts)
                    yield pd.DataFrame({"id": rows["id"].repeat(n_parts), "v": rows["v"].repeat(n_parts), "part": parts.ravel()})

        return run

    schema = "id long, v array<double>, part int"
    same = Window.partitionBy("v").orderBy("id")
    candidates = all_rows.distinct().withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1).drop("place")
    candidates = written(candidates.mapInPandas(routed(1), schema), "ann-index")
    asked = written(asked.distinct().mapInPandas(routed(router.probes), schema), "ann-queries")

    def blocks(df: DataFrame, size: int) -> dict[int, int]:
        return {r["part"]: -(-r["n"] // size) for r in df.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per part

    n_c, n_q = blocks(candidates, CANDIDATE_BLOCK), blocks(asked, QUERY_BLOCK)

    def number(of: dict[int, int]) -> Column:
        return F.coalesce(F.create_map(*(F.lit(x) for p in of.items() for x in p))[F.col("part")], F.lit(1)) if of else F.lit(1)

    def dealt(df: DataFrame, own: str, own_n: dict[int, int], other: str, other_n: dict[int, int]) -> DataFrame:
        one = F.pmod(F.xxhash64("id"), number(own_n)).cast("int").alias(own)
        return df.select("id", "v", "part", one, F.explode(F.sequence(F.lit(0), number(other_n) - 1)).alias(other))

    def search(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(c) or not len(q):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        x, ids = np.array(c["v"].tolist()), c["id"].to_numpy()
        found = []
        for a in range(0, len(q), 256):
            y, q_ids = np.array(q["v"].iloc[a : a + 256].tolist()), q["id"].iloc[a : a + 256].to_numpy()
            for scores, one, q_id in zip(y @ x.T, y, q_ids, strict=True):
                best, exact = _best(scores, ids, x, one, q_id, k)
                found.append(pd.DataFrame({"query_id": q_id, "vec_id": best, "score": exact}))
        return pd.concat(found)

    keys = ["part", "c_block", "q_block"]
    left = dealt(candidates, "c_block", n_c, "q_block", n_q).groupBy(*keys)
    right = dealt(asked, "q_block", n_q, "c_block", n_c).groupBy(*keys)
    hits = left.cogroup(right).applyInPandas(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
