"""The pipeline against its stages chained in plain Python, and the growing of trees against plain splits."""

from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from pairstrand.llm import packing, quality
from pairstrand.llm.settings import PASSAGE, VOCABULARY, quality_forest

from test_ann_packing import check
from test_queries_llm import best_fit
from test_texts import body, brute_components, shingle_set

SMALL = "/root/testdata/sf0.001"


def plain_grow(x, y, edges):
    """Trees by trying every split: the same loss, gains and leaves, row by row."""
    base = np.log(y.sum() / (len(y) - y.sum()))
    raw, trees = np.full(len(y), base), []
    for _ in range(quality.TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        worth = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + quality.PENALTY)  # noqa: E731, B023
        tree, todo = {}, [(0, np.arange(len(y)), 0)]
        while todo:
            node, rows, depth = todo.pop()
            best = (1e-6, None)
            for f in range(x.shape[1]) if depth < quality.DEPTH else ():
                for at in edges[f]:
                    left, right = rows[x[rows, f] <= at], rows[x[rows, f] > at]
                    if min(h[left].sum(), h[right].sum()) >= quality.LEAST_HESSIAN:
                        gain = worth(left) + worth(right) - worth(rows)
                        if gain > best[0] + 1e-12:
                            best = (gain, (f, at, left, right))
            if best[1] is None:
                value = -quality.RATE * g[rows].sum() / (h[rows].sum() + quality.PENALTY)
                tree[node] = value
                raw[rows] += value
            else:
                f, at, left, right = best[1]
                tree[node] = (f, at)
                todo += [(2 * node + 1, left, depth + 1), (2 * node + 2, right, depth + 1)]
        trees.append(tree)
    return base, trees


def test_trees_grow_as_by_plain_splits(monkeypatch):
    for name, value in (("TREES", 4), ("DEPTH", 3), ("BINS", 8)):
        monkeypatch.setattr(quality, name, value)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(160, 4))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(160) < 0.1)).astype(float)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, quality.BINS + 1)[1:-1])) for f in range(4)]
    base, trees = plain_grow(x, y, edges)
    forest = quality.grow(x, y)
    assert forest.base == pytest.approx(base)
    inner = 0
    for t, tree in enumerate(trees):
        for node, content in tree.items():
            if isinstance(content, tuple):
                inner += 1
                assert (forest.feature[t, node], forest.threshold[t, node]) == (content[0], pytest.approx(content[1]))
                assert (forest.left[t, node], forest.right[t, node]) == (2 * node + 1, 2 * node + 2)
            else:
                assert forest.value[t, node] == pytest.approx(content) and forest.left[t, node] == node
    assert inner > 12


def brute_rests(texts, length):
    """What is left of every text without the strings of ``length`` bytes that begin in two places."""
    raw = [t.encode() for t in texts]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b, text in zip(raw, texts, strict=True):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore") if gone.any() else text)
    return out


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables here")
def test_run_against_its_stages_in_plain_python(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{name}.parquet") for name in ("documents", "labels"))
    forest = quality_forest(docs, labels)
    texts = {r["doc_id"]: body(r["text"]) for r in docs.collect()}
    kept = {}
    for i, t in texts.items():  # trees walked node by node
        x = np.concatenate(list(quality._features([t])))[0]
        total = forest.base
        for tree in range(len(forest.feature)):
            node = 0
            while forest.left[tree, node] != node:
                node = forest.left[tree, node] if x[forest.feature[tree, node]] <= forest.threshold[tree, node] else forest.right[tree, node]
            total += forest.value[tree, node]
        if 1 / (1 + np.exp(-total)) >= quality.THRESHOLD:
            kept[i] = t
    last = {}
    for i, t in kept.items():
        last[t] = max(i, last.get(t, i))
    kept = {i: t for t, i in last.items()}
    components = brute_components({i: [shingle_set(t)] for i, t in kept.items()})
    kept = {i: t for i, t in kept.items() if components[i] == i}
    order = sorted(kept)
    rests = dict(zip(order, brute_rests([kept[i] for i in order], PASSAGE), strict=True))
    library = Tokenizer.from_file(VOCABULARY)
    library.no_truncation()
    library.no_padding()
    lengths = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in rests.items()}
    rows = corpus_pipeline.run(spark, SMALL).collect()
    check(rows, lengths, packing.CAPACITIES)
    most = max(packing.CAPACITIES)
    pieces = [min(most, n - s) for n in lengths.values() for s in range(0, n, most)]
    cost = sum({r["bin_id"]: r["capacity"] + packing.BIN_COST for r in rows}.values())
    assert cost <= 1.01 * best_fit(pieces, packing.CAPACITIES)
    assert len(texts) > len(kept) > 50 and any(rests[i] != kept[i] for i in order)
