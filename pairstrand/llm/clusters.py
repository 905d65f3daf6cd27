"""Centroid clustering by exponion search.

Vectors of integers are assigned to the nearest of k centroids, round after round, with exact integer distances. Each vector
keeps its centroid, an upper bound of its distance to it and a lower bound of its distance to any other; when centroids
move, the bounds give way by as much. A vector whose upper bound lies under its lower one stays without a look at any
centroid. Of the others the upper bound is made exact, and if that doesn't do, only centroids inside a ball around the
current centroid are scanned: the ball's radius is twice the vector's distance plus the distance from the centroid to its
next one, and the centroids inside are a prefix of that centroid's list of the others, sorted by distance. The second nearest
is always inside too, so both bounds are exact afterwards. The ball includes its border, so that centroids at the same distance
are seen and the smaller number wins.

On Spark a round is one pass of numpy over the table of vectors with their bounds, which is written to the shared folder (the
vectors as small integers), and one pass that adds up each task's vectors by centroid: a task gives one row a centroid, so a
cluster of any size meets in no one task. Only centroids, k rows of sums, go through the driver.

Defined results: vectors that are null, of another number of components than ``dimension``, or hold a null, NaN or infinite
component take no part; integers beyond ``LIMIT`` either way count as ``LIMIT``; a vector without id takes part but never
starts as a centroid; repeated rows each count; starts with equal hashes (repeated ids) go by their components; with fewer vectors than k, all start; sums that
don't fit into 64 bits are null; other columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairstrand.llm.common import small_batches, written

#: Integers are kept within +-LIMIT, so that a squared distance of 64 components fits into 64 bits.
LIMIT = 1 << 26
#: Floating-point bounds give way by this share, so that rounding never hides a centroid.
SLACK = 1e-9


def _finite(embedding: Column) -> Column:
    return F.forall(embedding, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))


def whole_vectors(vectors: DataFrame, scale: int, dimension: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The usable vectors as integers floor(scale * x): id, v."""
    v = vectors[vector_col].cast("array<double>")
    good = vectors.select(vectors[id_col].cast("long").alias("id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") == dimension) & _finite(F.col("v")))
    bound = F.lit(float(LIMIT))
    return good.select("id", F.transform("v", lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x * scale, bound), -bound)), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int")).alias("v"))


def starts(vectors: DataFrame, k: int, seed: str = "1") -> np.ndarray:
    """The k vectors with the smallest SHA-256 of ``seed:id``, in the order of these."""
    hashed = vectors.where(F.col("id").isNotNull()).withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256))
    return np.array([r["v"] for r in hashed.orderBy("hash", "v").limit(k).collect()], np.int64)


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, exact: (rows, centroids)."""
    if 4 * x.shape[1] * float(max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0))) ** 2 < 2**53:
        y, c = x.astype(float), centroids.astype(float)
        return ((y * y).sum(1)[:, None] - 2 * (y @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], axis=1) if len(centroids) else np.zeros((len(x), 0), np.int64)


class Exponion:
    """One round's centroids, with each centroid's list of the others by distance, and how far each has moved."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None) -> None:
        self.c, self.k = centroids, len(centroids)
        apart = np.sqrt(squared(centroids, centroids).astype(float))
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.order = np.array([np.r_[a, row[row != a]] for a, row in enumerate(self.order)])  # itself first, equal centroids next
        self.sorted = np.take_along_axis(apart, self.order, axis=1)
        moved = np.zeros(self.k) if before is None else np.sqrt(((centroids - before) ** 2).sum(1).astype(float))
        self.moved = moved
        self.others = np.array([np.delete(moved, a).max(initial=0) for a in range(self.k)])

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Full search: centroid, squared distance, lower bound."""
        return self._best(squared(x, self.c), np.arange(self.k))

    @staticmethod
    def _best(d: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        by_name = np.argsort(names, kind="stable")
        d, names = d[:, by_name], names[by_name]
        at = d.argmin(1)  # the first of equal ones, so the smallest number
        rows = np.arange(len(d))
        best = d[rows, at].copy()
        lower = np.full(len(d), np.inf)
        if d.shape[1] > 1:
            lower = np.sqrt(np.partition(d, 1, axis=1)[:, 1].astype(float))
        return names[at], best, lower

    def again(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """New centroid, upper and lower bound of each vector, and the number of distances that were computed."""
        own, upper, lower = own.copy(), upper + self.moved[own], lower - self.others[own]
        looked = 0
        open_ = np.flatnonzero(~(upper * (1 + SLACK) < lower * (1 - SLACK)))
        if len(open_):
            exact = ((x[open_] - self.c[own[open_]]) ** 2).sum(1)
            looked += len(open_)
            upper[open_] = np.sqrt(exact.astype(float))
            open_ = open_[~(upper[open_] * (1 + SLACK) < lower[open_] * (1 - SLACK))]
        near = self.sorted[:, 1] if self.k > 1 else np.zeros(1)
        for a in np.unique(own[open_]).tolist():
            rows = open_[own[open_] == a]
            inside = np.searchsorted(self.sorted[a], (2 * upper[rows] + near[a]) * (1 + SLACK), side="right")
            size = np.minimum(self.k, 1 << np.ceil(np.log2(np.maximum(inside, 2))).astype(np.int64))  # lists' lengths, doubling
            for n in np.unique(size).tolist():
                some, names = rows[size == n], self.order[a, :n]
                found, best, low = self._best(squared(x[some], self.c[names]), names)
                looked += len(some) * len(names)
                own[some], upper[some], lower[some] = found, np.sqrt(best.astype(float)), low
        return own, upper, lower, looked


_STATE = "id long, v binary, cluster int, upper double, lower double"


def _matrix(packed: pd.Series, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), "<i4").reshape(len(packed), d).astype(np.int64)


def _first_state(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search = Exponion(centroids)
        for rows in batches:
            if len(rows):
                x = np.array(rows["v"].tolist(), np.int64)
                own, best, lower = search.first(x)
                yield pd.DataFrame({"id": rows["id"].astype("Int64"), "v": [r.tobytes() for r in x.astype("<i4")], "cluster": own, "upper": np.sqrt(best.astype(float)), "lower": lower})

    return vectors.mapInPandas(run, _STATE)


def _next_state(state: DataFrame, centroids: np.ndarray, before: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search = Exponion(centroids, before)
        for rows in batches:
            if len(rows):
                x = _matrix(rows["v"], centroids.shape[1])
                own, upper, lower, _ = search.again(x, rows["cluster"].to_numpy(np.int64), rows["upper"].to_numpy(), rows["lower"].to_numpy())
                yield pd.DataFrame({"id": rows["id"].astype("Int64"), "v": rows["v"], "cluster": own, "upper": upper, "lower": lower})

    return state.mapInPandas(run, _STATE)


def means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid's floor of the mean of its vectors; where it has none, as it was."""
    d = centroids.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for rows in batches:
            own = rows["cluster"].to_numpy(np.int64)
            np.add.at(sums, own, _matrix(rows["v"], d))
            counts += np.bincount(own, minlength=len(counts))
        full = np.flatnonzero(counts)
        yield pd.DataFrame({"cluster": full, "n": counts[full], "sums": list(sums[full])})

    parts = state.select("cluster", "v").mapInPandas(run, "cluster int, n long, sums array<long>")
    added = parts.select("cluster", "n", F.posexplode("sums").alias("place", "s")).groupBy("cluster", "place").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in added.collect():  # k rows a component
        out[r["cluster"], r["place"]] = int(r["s"]) // r["n"]
    return out


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dimension: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """Per usable vector: id, cluster, distance (squared); and the final centroids."""
    small_batches(vectors.sparkSession)
    own = whole_vectors(vectors, scale, dimension, id_col, vector_col)
    centroids = starts(own, k)
    if not len(centroids):
        return own.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), centroids
    state = written(_first_state(own, centroids), "cluster-state")
    for _ in range(rounds):
        before, centroids = centroids, means(state, centroids)
        state = written(_next_state(state, centroids, before), "cluster-state")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            own = rows["cluster"].to_numpy(np.int64)
            x = _matrix(rows["v"], centroids.shape[1])
            yield pd.DataFrame({"id": rows["id"].astype("Int64"), "cluster": own, "distance": ((x - centroids[own]) ** 2).sum(1)})

    return state.select("id", "v", "cluster").mapInPandas(run, "id long, cluster int, distance long").withColumnRenamed("id", id_col), centroids


def clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dimension: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per usable vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256 (of the components joined by commas)."""
    spark = vectors.sparkSession
    assigned, centroids = cluster(vectors, k, rounds, scale, dimension, id_col, vector_col)
    assigned = written(assigned, "cluster-rows")
    facts = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    sums = assigned.groupBy("cluster").agg(exact("distance").alias("s"))
    totals = sums.groupBy().agg(F.sum("s").alias("t"))
    own = sums.crossJoin(totals).join(spark.createDataFrame(facts, "cluster int, centroid_sha256 string"), "cluster")  # one row, and k rows
    own = own.select("cluster", F.expr("try_cast(s AS bigint)").alias("cluster_inertia"), F.expr("try_cast(t AS bigint)").alias("inertia"), "centroid_sha256")
    return assigned.join(F.broadcast(own), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
