"""Features, a gated graph convolution, edge heads, losses and confusion counts.

Vectors are arrays of doubles. A layer is a projection, two joins and sums per node; products with weights, gates and sums are
numpy's, on Arrow batches of rows, so that matrices of any size travel once to a worker, and neither they nor the vectors' width are
part of the plan. Tables of vectors compress well and are far larger in memory than on disk, so none is ever broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairstrand.functions.strings import complement, sigmoid
from pairstrand.operators.graph import degrees, mirror
from pairstrand.operators.vectors import Held, added, lists, moments, packed, rows_of, unpacked
from pairstrand.sources.shared import dealt, forget, shuffle_partitions, written

Matrix = list[list[float]]


def features(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node, x (in-degree, out-degree, support, length / 1e5); src, dst, e (overlap / 1e4)."""
    deg = degrees(nodes, edges)
    x = F.array(F.col("in_deg").cast("double"), F.col("out_deg").cast("double"), F.coalesce("support", F.lit(0.0)), F.col("read_length") / 1e5)
    return nodes.join(deg, "node").select("node", x.alias("x")), edges.select("src", "dst", F.array(F.col("overlap_length") / 1e4).alias("e"))


def beam_edge_score(length: Column, overlap: Column, wrong_kmers: Column, score: Column, alpha: float = 1e-5, beta: float = 3.0, gamma: float = 25.0) -> Column:
    """What an edge adds to a walk: new bases, less wrong k-mers in them, less its badness squared. No haplotype, no penalty
    by k-mers: pass null."""
    new = length - overlap
    penalty = F.coalesce(beta * wrong_kmers * new / length, F.lit(0.0))
    return alpha * new - penalty - (gamma * score) * (gamma * score)


def graphic_edge_score(length: Column, overlap: Column, graphic: Column, score: Column, alpha: float = 1e-5, beta: float = 10.0, gamma: float = 20.0, threshold: float = 0.0) -> Column:
    """The same with external node scores: a penalty where they are under a threshold."""
    penalty = F.when(graphic < -threshold, -graphic * beta).otherwise(0.0)
    return alpha * (length - overlap) - penalty - (gamma * score) * (gamma * score)


def mirror_average(edges: DataFrame, column: str | list[str] = "score", compat: bool = False) -> DataFrame:
    """Edges with the mean of their own and their mirrors' scores (their own if the mirror is missing), in one or several columns.

    With ``compat`` both get (a + 3 b) / 4, b being the score of the later of the two by (src, dst).
    """
    columns = [column] if isinstance(column, str) else column
    other = mirror(edges.select("src", "dst", *(F.col(c).alias(f"other_{c}") for c in columns)))
    both = edges.join(other.hint("merge"), ["src", "dst"], "left")

    def value(c: str) -> Column:
        own, twin = F.col(c), F.col(f"other_{c}")
        if compat:
            here = F.struct("src", "dst")
            there = F.struct(complement(F.col("dst")).alias("src"), complement(F.col("src")).alias("dst"))
            mean = F.when(here == there, own).when(here < there, (own + 3 * twin) / 4).otherwise((twin + 3 * own) / 4)
        else:
            mean = (own + twin) / 2
        return F.coalesce(mean, own)

    return both.withColumns({c: value(c) for c in columns}).drop(*(f"other_{c}" for c in columns))


def linear(x: Column, w: Matrix, b: list[float] | None = None) -> Column:
    """Affine map of an array column."""
    weights, bias = np.asarray(w, float), np.zeros(len(w)) if b is None else np.asarray(b, float)

    @F.arrow_udf("array<double>")
    def product(rows: pa.Array) -> pa.Array:
        return lists(rows_of(rows).reshape(len(rows), weights.shape[1]) @ weights.T + bias)

    return product(x)


def standardise(rows: DataFrame, column: str, size: int, eps: float = 1e-8) -> DataFrame:
    """Each element less its mean over all rows, divided by the root of its (population) variance plus eps."""
    n, mean, variance = moments(rows, column)
    if not n:
        return rows
    scale = np.sqrt(variance + eps)

    @F.arrow_udf("array<double>")
    def scaled(x: pa.Array) -> pa.Array:
        return lists((rows_of(x).reshape(len(x), len(mean)) - mean) / scale)

    return rows.withColumn(column, scaled(column))


def normalise(rows: DataFrame, column: str, size: int, norm: str | None) -> DataFrame:
    """``pair``: each element over all rows, eps 1e-8; ``batch``: the same with eps 1e-5; ``layer``: each row over its elements,
    eps 1e-5; None: as it is."""
    if norm in ("pair", "batch"):
        return standardise(rows, column, size, 1e-8 if norm == "pair" else 1e-5)
    if norm == "layer":
        total = lambda x: F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)
        mean = total(F.col(column)) / size
        spread = total(F.transform(column, lambda v: (v - mean) * (v - mean))) / size
        return rows.withColumn(column, F.transform(column, lambda v: (v - mean) / F.sqrt(spread + 1e-5)))
    if norm is not None:
        raise ValueError(f"{norm}: norms are pair, batch and layer")
    return rows


def gated_conv(h: DataFrame, e: DataFrame, w: dict[str, Matrix], size: int, eps: float = 1e-6, norm: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One layer of a symmetric gated graph convolution.

    h: node, h; e: src, dst, e. Gates are sigmoids of B1 h_src + B2 h_dst + B3 e; a node takes A1 h, the gated mean of A2 h
    over its in-edges and that of A3 h over its out-edges. Both passes share the gate. Residuals are added after the relu.
    """
    return gated_network(h, e, [w], size, norm, eps)


def gated_network(h: DataFrame, e: DataFrame, layers: list[dict[str, Matrix]], size: int, norm: str | None = None, eps: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """Several layers (``gated_conv``), one on the other; nodes and edges are written between them.

    Nodes are dealt into buckets by blocks of ids, and an edge lies in both of its ends' buckets (once, if they are the same). So a
    bucket has all that its nodes sum up once their neighbours' vectors have come: a layer shuffles a node's vector once for each
    bucket that it has a neighbour in, and nothing else. Each bucket's tables are a few compressed rows, which one task takes in; a
    node's edges lie in one bucket, however many they are. A norm needs sums over all rows before a layer ends, so layers with one
    go by joins (``_layer``).
    """
    if not layers:
        return h, e
    if norm is not None:
        ready = _ready(h, layers[0])
        for w, after in zip(layers, [*layers[1:], None], strict=True):
            ready, e = _layer(ready, e, w, after, size, eps, norm)
        return ready.select("node", unpacked("h").alias("h")), e.select("src", "dst", unpacked("e").alias("e"))
    spark, block = h.sparkSession, BLOCK
    names, schema = _bucket_names(spark), "bucket long, ids binary, e binary, h binary"
    bucket = lambda node: _bucket(node, names, block)

    def dealt_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _together(batches):
            node, rows = x.column("node").to_numpy(), rows_of(x.column("h").combine_chunks())
            yield from _by_bucket(bucket(node), names, lambda at: _node_row(node[at], rows[at]))  # noqa: B023

    def dealt_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _together(batches):
            src, dst, rows = x.column("src").to_numpy(), x.column("dst").to_numpy(), rows_of(x.column("e").combine_chunks())
            one, two = bucket(src), bucket(dst)
            twice = np.flatnonzero(one != two)
            of = np.concatenate([np.arange(len(src)), twice])
            yield from _by_bucket(np.concatenate([one, two[twice]]), names, lambda at: _edge_row(src[of[at]], dst[of[at]], rows[of[at]]))  # noqa: B023

    of_nodes = h.select(F.col("node").cast("long").alias("node"), "h").mapInArrow(dealt_nodes, schema)
    of_edges = e.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "e").mapInArrow(dealt_edges, schema)
    state = written(dealt(of_nodes.union(of_edges).repartition(len(names), "bucket"), ["bucket"]), "conv-buckets")

    def sent(key: tuple, mine: pa.Table) -> pa.Table:
        node, rows, src, dst, _ = _bucket_of(mine)
        one, two = np.searchsorted(names, bucket(src)), np.searchsorted(names, bucket(dst))
        own, ends, to = int(np.searchsorted(names, key[0].as_py())), np.concatenate([src, dst]), np.concatenate([two, one])
        far = np.concatenate([one == own, two == own]) & (to != own)
        at, there = _places_in(node, ends[far])
        codes = np.unique(to[far][there] * np.int64(len(node)) + at[there])
        to, at = np.divmod(codes, max(1, len(node)))
        return pa.Table.from_batches(_by_bucket(names[to], names, lambda x: _node_row(node[at[x]], rows[at[x]])), _ROWS)

    def layer(w: dict[str, Matrix], give: str):
        def run(key: tuple, mine: pa.Table, others: pa.Table) -> pa.Table:
            node, rows, src, dst, own = _bucket_of(mine)
            new, own, keep = _bucket_layer(w, eps, node, rows, *_bucket_of(others)[:2], src, dst, own)
            src, dst = src[keep], dst[keep]
            if give == "h":
                return pa.table({"node": node, "h": lists(new)})
            if give == "e":
                here = bucket(src) == key[0].as_py()
                return pa.table({"src": src[here], "dst": dst[here], "e": lists(own[here])})
            parts = [_node_row(node, new), *(_edge_row(src[a : a + TOGETHER], dst[a : a + TOGETHER], own[a : a + TOGETHER]) for a in range(0, len(src), TOGETHER))]
            return pa.Table.from_pylist([{"bucket": key[0].as_py(), **x} for x in parts], _ROWS)

        return run

    def meet(state: DataFrame, w: dict[str, Matrix], give: str, schema: str) -> DataFrame:
        messages = state.groupBy("bucket").applyInArrow(sent, _ROWS_SCHEMA).repartition(len(names), "bucket")
        return state.groupBy("bucket").cogroup(messages.groupBy("bucket")).applyInArrow(layer(w, give), schema)

    for w in layers[:-1]:
        before, state = state, written(dealt(meet(state, w, "both", schema), ["bucket"]), "conv-buckets")
        forget(before)
    return meet(state, layers[-1], "h", "node long, h array<double>"), meet(state, layers[-1], "e", "src long, dst long, e array<double>")


#: Nodes whose ids differ in these last bits only share a bucket; rows that a task packs together; edges that are looked at together.
BLOCK, TOGETHER, EDGES = 11, 500_000, 100_000
_ROWS_SCHEMA = "bucket long, ids binary, e binary, h binary"
_ROWS = pa.schema({"bucket": pa.int64(), "ids": pa.binary(), "e": pa.binary(), "h": pa.binary()})


def _bucket_names(spark: SparkSession) -> np.ndarray:
    """Names of as many buckets as there are shuffle partitions, each in a partition of its own."""
    n = shuffle_partitions(spark)
    of = spark.range(40 * n + 100).groupBy(F.expr(f"pmod(hash(id), {n})")).agg(F.min("id").alias("id"))
    return np.sort(np.array([r["id"] for r in of.collect()]))


def _bucket(node: np.ndarray, names: np.ndarray, block: int) -> np.ndarray:
    x = (node >> block).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return names[((x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)) % np.uint64(len(names))]


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together, up to ``TOGETHER`` rows."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += len(b)
        if size >= TOGETHER:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held)


def _by_bucket(bucket: np.ndarray, names: np.ndarray, row: Callable[[np.ndarray], dict]) -> Iterator[pa.RecordBatch]:
    """One row for each bucket, made of the places that go to it."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0, [True]])) if len(order) else np.zeros(1, int)
    made = [{"bucket": int(bucket[order[a]]), **row(order[a:z])} for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
    for a in range(0, len(made), 64):
        yield pa.RecordBatch.from_pylist(made[a : a + 64], _ROWS)


def _shrunk(rows: np.ndarray) -> bytes:
    """Rows of 64-bit numbers compressed, first bytes of all, then second ones, and so on."""
    raw = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1).T.tobytes()
    return np.array([*rows.shape, len(raw)], "<i8").tobytes() + pa.compress(raw, "zstd", asbytes=True)


def _grown(data: pa.Scalar, kind: type) -> np.ndarray:
    data = memoryview(data.as_buffer())
    n, d, size = np.frombuffer(data[:24], "<i8").tolist()
    raw = np.frombuffer(pa.decompress(data[24:], size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(8 * d, n).T).view(kind).reshape(n, d)


def _node_row(node: np.ndarray, rows: np.ndarray) -> dict:
    order = np.argsort(node)
    return {"ids": _shrunk(np.diff(node[order], prepend=0)[:, None]), "h": _shrunk(rows[order])}


def _edge_row(src: np.ndarray, dst: np.ndarray, rows: np.ndarray) -> dict:
    order = np.lexsort([dst, src])
    src, step = src[order], dst[order] - src[order]
    return {"ids": _shrunk(np.stack([np.diff(src, prepend=0), (step << 1) ^ (step >> 63)], axis=1)), "e": _shrunk(rows[order])}


def _bucket_of(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """Nodes in order, their vectors, and edges' ends and vectors."""
    node, h, ends, e = [np.zeros(0, np.int64)], [], [np.zeros((0, 2), np.int64)], []
    for ids, of_edges, of_nodes in zip(rows.column("ids"), rows.column("e"), rows.column("h"), strict=True):
        ids = _grown(ids, np.int64)
        if of_nodes.is_valid:
            node.append(np.cumsum(ids[:, 0]))
            h.append(_grown(of_nodes, float))
        else:
            src, step = np.cumsum(ids[:, 0]), ids[:, 1]
            ends.append(np.stack([src, src + ((step >> 1) ^ -(step & 1))], axis=1))
            e.append(_grown(of_edges, float))
    node, ends = np.concatenate(node), np.concatenate(ends)
    order = np.argsort(node, kind="stable")
    return node[order], np.concatenate(h)[order] if h else np.zeros((0, 0)), ends[:, 0], ends[:, 1], np.concatenate(e) if e else np.zeros((0, 0))


def _places_in(node: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ids are among ordered ones, and whether they are."""
    at = np.minimum(np.searchsorted(node, wanted), max(0, len(node) - 1))
    return at, node[at] == wanted if len(node) else np.zeros(len(wanted), bool)


def _bucket_layer(w: dict[str, Matrix], eps: float, node: np.ndarray, h: np.ndarray, far: np.ndarray, far_h: np.ndarray, src: np.ndarray, dst: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """New vectors of the bucket's nodes, and of those of its edges whose ends both exist, and which these are. Sums are right for
    the bucket's own nodes, which have all their edges here."""
    m = {k: np.asarray(v, float) for k, v in w.items()}
    d = len(m["B3"])
    names = np.concatenate([node, far])
    order = np.argsort(names, kind="stable")
    names, rows = names[order], np.concatenate([x for x in (h, far_h) if len(x)])[order] if len(names) else np.zeros((0, d))
    (one, first), (two, second) = _places_in(names, src), _places_in(names, dst)
    keep = first & second
    one, two, e = one[keep], two[keep], e[keep] if len(e) else np.zeros((0, d))
    ahead, behind = rows @ np.concatenate([m["A2"], m["B1"]]).T, rows @ np.concatenate([m["A3"], m["B2"]]).T
    new, sums = np.empty((len(e), d)), np.zeros((2, len(names), 2 * d))
    for a in range(0, len(e), EDGES):
        at = slice(a, a + EDGES)
        of_src, of_dst = ahead[one[at]], behind[two[at]]
        raw = of_src[:, d:] + of_dst[:, d:] + e[at] @ m["B3"].T
        g = 1 / (1 + np.exp(-raw))
        new[at] = np.maximum(raw, 0) + e[at]
        for side, (to, of) in enumerate(((two[at], of_src), (one[at], of_dst))):
            places, parts = added(to, [np.concatenate([g * of[:, :d], g], axis=1)])
            sums[side, places] += parts[0]
    mine = _places_in(names, node)[0]
    if not len(node):
        return np.zeros((0, d)), new, keep
    out = h @ m["A1"].T
    for part in sums[:, mine]:
        out += part[:, :d] / (part[:, d:] + eps)
    return np.maximum(out, 0) + h, new, keep


def _shares(rows: np.ndarray, w: dict[str, Matrix] | None) -> dict[str, pa.Array]:
    """Nodes' vectors and what they add to edges that leave them and that reach them: for the gated sum, and for the gate."""
    of = lambda *names: packed(rows @ np.concatenate([np.asarray(w[m], float) for m in names]).T)
    return {"h": packed(rows)} | ({} if w is None else {"ahead": of("A2", "B1"), "behind": of("A3", "B2")})


def _ready_schema(w: dict[str, Matrix] | None) -> str:
    return "node long, h binary" + ("" if w is None else ", ahead binary, behind binary")


def _ready(h: DataFrame, w: dict[str, Matrix] | None) -> DataFrame:
    """Nodes as ``_layer`` takes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if len(x):
                out = _shares(rows_of(x.column("h")), w)
                yield pa.RecordBatch.from_arrays([x.column("node"), *out.values()], names=["node", *out])

    return written(h.select(F.col("node").cast("long").alias("node"), "h").mapInArrow(run, _ready_schema(w)), "conv-nodes")


def _layer(ready: DataFrame, e: DataFrame, w: dict[str, Matrix], after: dict[str, Matrix] | None, size: int, eps: float, norm: str) -> tuple[DataFrame, DataFrame]:
    """One layer with a norm on nodes that are ready for it: nodes ready for the layer after it (or the last), and edges, vectors packed."""
    b3, a1 = np.asarray(w["B3"], float), np.asarray(w["A1"], float)
    d = len(b3)
    ends = e.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "e")
    joined = ends.join(ready.select(F.col("node").alias("src"), "ahead").hint("merge"), "src").join(ready.select(F.col("node").alias("dst"), "behind").hint("merge"), "dst")
    # rows of edges (src, dst, e, and the raw vector n), and of partial sums (node, side, part)
    made = pa.schema({"src": pa.int64(), "dst": pa.int64(), "e": pa.binary(), "n": pa.binary(), "node": pa.int64(), "side": pa.int32(), "part": pa.binary()})

    def rows(size: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(size, f.type) for f in made], schema=made)

    def sums(side: int, keys: np.ndarray, parts: list[np.ndarray]) -> pa.RecordBatch:
        return rows(len(keys), node=pa.array(keys), side=pa.array(np.full(len(keys), side, np.int32)), part=packed(parts[0]))

    def gates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(), Held()
        for x in batches:
            if len(x):
                src, dst, own = (rows_of(x.column(c)) for c in ("ahead", "behind", "e"))
                raw = src[:, d:] + dst[:, d:] + own @ b3.T
                g = 1 / (1 + np.exp(-raw))
                yield rows(len(x), src=x.column("src"), dst=x.column("dst"), e=packed(own), n=packed(raw))
                for side, (key, of) in enumerate((("dst", src), ("src", dst))):
                    for s in held[side].add(x.column(key).to_numpy(), [np.concatenate([g * of[:, :d], g], axis=1)]):
                        yield sums(side, *s)
        for side in (0, 1):
            for s in held[side].rest():
                yield sums(side, *s)

    # the new edges and the sums both hang on the gates, which are therefore written once
    gate = written(joined.select("src", "dst", "e", "ahead", "behind").mapInArrow(gates, "src long, dst long, e binary, n binary, node long, side int, part binary"), "conv-gates")

    def new(nodes: np.ndarray, own: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        out = own @ a1.T
        for keys, part in found:
            out[np.searchsorted(nodes, keys)] += part[:, :d] / (part[:, d:] + eps) if len(keys) else 0
        return pa.RecordBatch.from_arrays([pa.array(nodes), packed(out), packed(own)], names=["node", "n", "h"])

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sorted by node, so a node's rows lie together; those of the last one wait for the next batch
        kept: list[tuple[np.ndarray, np.ndarray]] | None = None
        for x in batches:
            if not len(x):
                continue
            keys, sides = x.column("node").to_numpy(), x.column("side").to_numpy()
            found = []
            for side in range(3):
                at = sides == side
                part = rows_of(x.column("part").filter(pa.array(at)))
                mine = [(keys[at], part)] if len(part) else []
                if kept and len(kept[side][0]):
                    mine.insert(0, kept[side])
                own, sums = added(np.concatenate([m[0] for m in mine]), [np.concatenate([m[1] for m in mine])]) if mine else (keys[:0], [part])
                found.append((own, sums[0]))
            kept = [(k[k == keys[-1]], p[k == keys[-1]]) for k, p in found]
            found = [(k[k != keys[-1]], p[k != keys[-1]]) for k, p in found]
            if len(found[2][0]):
                yield new(*found[2], found[:2])
        if kept and len(kept[2][0]):
            yield new(*kept[2], kept[:2])

    met = gate.where("node is not null").select("node", "side", "part").union(ready.select("node", F.lit(2), "h"))
    out = met.repartition("node").sortWithinPartitions("node").mapInArrow(nodes, "node long, n binary, h binary")
    of_edges = gate.where("node is null")

    @F.arrow_udf("binary")
    def residual(n: pa.Array, before: pa.Array) -> pa.Array:
        return packed(np.maximum(rows_of(n), 0) + rows_of(before)) if len(n) else before

    def normed(table: DataFrame, column: str) -> DataFrame:
        spread = normalise(table.withColumn("n", unpacked("n")), "n", size, norm)
        return spread.withColumn(column, residual("n", column)).drop("n")

    return _ready(normed(written(out, "conv-layer"), "h"), after), written(normed(of_edges.select("src", "dst", "e", "n"), "e"), "conv-layer")


def edge_heads(h: DataFrame, e: DataFrame, heads: list[dict]) -> DataFrame:
    """src, dst, logits (one a head) of two-layer networks on source, destination and edge vectors, all heads in one pass.

    First layers are linear, so each node's share of them is made before the joins.
    """
    w1, b1 = (np.concatenate([np.asarray(x[k], float) for x in heads]) for k in ("w1", "b1"))
    w2, b2 = [np.asarray(x["w2"], float) for x in heads], [float(x["b2"]) for x in heads]
    cuts = np.cumsum([len(w) for w in w2])[:-1]

    def share(end: str) -> DataFrame:
        @F.arrow_udf("array<double>")
        def product(rows: pa.Array) -> pa.Array:
            x = rows_of(rows)
            d = x.shape[1]
            return lists((x @ (w1[:, :d] if end == "src" else w1[:, d : 2 * d]).T).reshape(len(rows), len(w1)))

        return h.select(F.col("node").alias(end), product("h").alias(f"h_{end}")).hint("merge")

    @F.arrow_udf("array<double>")
    def logits(src: pa.Array, dst: pa.Array, own: pa.Array) -> pa.Array:
        if not len(own):
            return lists(np.zeros((0, len(w2))))
        x = rows_of(own)
        hidden = np.maximum(rows_of(src) + rows_of(dst) + x @ w1[:, w1.shape[1] - x.shape[1] :].T + b1, 0)
        return lists(np.stack([z @ w + b for z, w, b in zip(np.split(hidden, cuts, axis=1), w2, b2, strict=True)], axis=1))

    return e.join(share("src"), "src").join(share("dst"), "dst").select("src", "dst", logits("h_src", "h_dst", "e").alias("logits"))


def edge_head(h: DataFrame, e: DataFrame, w1: Matrix, b1: list[float], w2: list[float], b2: float) -> DataFrame:
    """src, dst, logit of a two-layer network on source, destination and edge vectors."""
    return edge_heads(h, e, [{"w1": w1, "b1": b1, "w2": w2, "b2": b2}]).select("src", "dst", F.col("logits")[0].alias("logit"))


def score_graph(h: DataFrame, e: DataFrame, head: dict, cut_head: dict, compat: bool = False) -> DataFrame:
    """src, dst, score and to_cut: both heads' probabilities, averaged with the mirrors'."""
    both = edge_heads(h, e, [head, cut_head]).select("src", "dst", *(sigmoid(F.col("logits")[k]).alias(c) for k, c in enumerate(("score", "to_cut"))))
    return mirror_average(written(both, "score-edges"), ["score", "to_cut"], compat)


def weighted_bce(logit: Column, target: Column, pos_weight: float) -> Column:
    p = sigmoid(logit)
    return -(pos_weight * target * F.log(p) + (1 - target) * F.log(1 - p))


def symmetry_loss(rows: DataFrame, pos_weight: float, alpha: float = 0.1) -> DataFrame:
    """loss: weighted cross-entropy of both directions' logits, plus alpha times their mean distance."""
    y = F.col("target")
    return rows.agg((F.avg(weighted_bce(F.col("logit"), y, pos_weight)) + F.avg(weighted_bce(F.col("logit_rev"), y, pos_weight)) + alpha * F.avg(F.abs(F.col("logit") - F.col("logit_rev")))).alias("loss"))


def confusion(rows: DataFrame, target: str, predicted: str) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, fpr, fnr; rates with nothing below the line are 0."""
    t, p = F.col(target) == 1, F.col(predicted) == 1
    counts = rows.agg(*(F.coalesce(F.count_if(c), F.lit(0)).alias(n) for n, c in (("tp", t & p), ("fp", ~t & p), ("fn", t & ~p), ("tn", ~t & ~p))))
    ratio = lambda a, b: F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 6)
    c = F.col
    return counts.select(
        "tp", "fp", "fn", "tn",
        ratio(c("tp"), c("tp") + c("fp")).alias("precision"), ratio(c("tp"), c("tp") + c("fn")).alias("recall"), ratio(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")).alias("f1"),
        ratio(c("fp"), c("fp") + c("tn")).alias("fpr"), ratio(c("fn"), c("fn") + c("tp")).alias("fnr"),
    )


def dataset_stats(nodes: DataFrame, labelled: DataFrame, target: str) -> DataFrame:
    """n_nodes, n_edges, positives, negatives, mean_degree, pos_weight (negatives per positive, 1 without any), bias."""
    pos = F.sum(F.col(target))
    e = labelled.agg(F.count(F.lit(1)).alias("n_edges"), F.coalesce(pos, F.lit(0)).cast("long").alias("positives"))
    n = nodes.agg(F.count(F.lit(1)).alias("n_nodes"))
    both = n.crossJoin(e).withColumn("negatives", F.col("n_edges") - F.col("positives"))
    p = F.col("positives") / F.col("n_edges")
    weight = F.when(F.col("positives") > 0, F.col("negatives") / F.col("positives")).otherwise(1.0)
    return both.select("n_nodes", "n_edges", "positives", "negatives", F.round(F.col("n_edges") / F.col("n_nodes"), 6).alias("mean_degree"), F.round(weight, 6).alias("pos_weight"), F.round(-F.log((1 - p) / p), 6).alias("bias"))


def train_logistic(labelled: DataFrame, feature_columns: list[str], target: str, weight: str | None = None, max_iter: int = 50):
    """A first trainer on the same features: Spark's logistic regression, weighted. Returns the fitted model."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=feature_columns, outputCol="features").transform(labelled)
    more = {"weightCol": weight} if weight else {}
    return LogisticRegression(featuresCol="features", labelCol=target, maxIter=max_iter, **more).fit(rows)
