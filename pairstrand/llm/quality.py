"""A quality classifier: histogram gradient-boosted trees over statistics of a document's text.

The trees are grown in numpy on a bounded sample of labelled rows (``TRAIN_ROWS``, the rows whose ids have the smallest
hashes), flattened into arrays, and applied to all documents by array traversal inside the tasks. Statistics are of the whole
text and use nothing but the text.

Defined results: a null text counts as empty and gets a score like any other; labels without id or value are left out,
repeated labels each count; without labels of both kinds the score is (ones + 1) / (labels + 1), so 1.0 without any. Equal texts
have equal scores, rows that are repeated are each scored, texts of any length are taken whole, other columns play no part, and
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairstrand.llm.common import keyed, named
from pairstrand.llm.textarrays import Words, chunks, words

#: Labelled rows that the trees are grown on, at most.
TRAIN_ROWS = 20_000
BINS, TREES, DEPTH, RATE, LEAST_HESSIAN, PENALTY = 64, 80, 4, 0.2, 5.0, 1.0
#: Score from which a document counts as good.
THRESHOLD = 0.7

#: Signs counted together as shares of a text's bytes.
SIGNS = {"stops": ".", "commas": ",;:", "shouts": "!?", "pipes": "|", "marks": "#$%&*+=<>@^~_{}[]\\/`", "quotes": "'\"()-"}
FEATURES = [
    "log_bytes", "log_words", "bytes_per_word", "longest_word", "upper", "lower", "digits", "beyond_ascii", "blanks", "line_ends",
    *SIGNS, "repeated_neighbour", "repeated_second_neighbour", "distinct_words", "capital_words", "upper_words", "signs_at_end", "words_without_letters", "long_words", "lines", "distinct_lines",
]


def _ranges() -> dict[str, np.ndarray]:
    out = {k: np.zeros(256, bool) for k in ("upper", "lower", "digits", "beyond_ascii", "blanks", "line_ends", *SIGNS)}
    for name, a, b in (("upper", 65, 91), ("lower", 97, 123), ("digits", 48, 58), ("beyond_ascii", 128, 256), ("blanks", 32, 33), ("line_ends", 10, 11)):
        out[name][a:b] = True
    for name, signs in SIGNS.items():
        out[name][[ord(c) for c in signs]] = True
    return out


_CLASS = _ranges()


def statistics(w: Words) -> np.ndarray:
    """One row of FEATURES per text."""
    n_texts = len(w.text_len)
    per_text = lambda doc, values=None: np.bincount(doc, weights=values, minlength=n_texts)
    share = lambda part, whole: part / np.maximum(whole, 1)
    histogram = np.bincount(np.repeat(np.arange(n_texts), w.text_len + 1) * 256 + w.data, minlength=n_texts * 256).reshape(n_texts, 256)
    histogram[:, 32] -= 1  # the blank between texts
    out = {"log_bytes": np.log1p(w.text_len), "log_words": np.log1p(w.count), "bytes_per_word": share(w.text_len, w.count)}
    longest = np.zeros(n_texts)
    np.maximum.at(longest, w.doc, w.length)
    out["longest_word"] = np.log1p(longest)
    for name, members in _CLASS.items():
        out[name] = share(histogram[:, members].sum(1), w.text_len)
    for name, k in (("repeated_neighbour", 1), ("repeated_second_neighbour", 2)):
        same = (w.hash[k:] == w.hash[:-k]) & (w.doc[k:] == w.doc[:-k])
        out[name] = share(per_text(w.doc[k:], same), w.count)
    order = np.lexsort((w.hash, w.doc))
    new = np.append(True, (np.diff(w.doc[order]) != 0) | (w.hash[order][1:] != w.hash[order][:-1])) if len(order) else np.zeros(0, bool)
    out["distinct_words"] = share(per_text(w.doc[order], new), w.count)
    head, tail = w.data[w.start], w.data[w.start + w.length - 1]
    out["capital_words"] = share(per_text(w.doc, _CLASS["upper"][head]), w.count)
    second = w.data[np.minimum(w.start + 1, len(w.data) - 1)]
    out["upper_words"] = share(per_text(w.doc, _CLASS["upper"][head] & _CLASS["upper"][second]), w.count)
    out["signs_at_end"] = share(per_text(w.doc, _CLASS["marks"][tail] | _CLASS["shouts"][tail] | _CLASS["pipes"][tail]), w.count)
    letter = (_CLASS["upper"] | _CLASS["lower"] | _CLASS["beyond_ascii"])[w.data]
    letters = np.append(0, np.cumsum(letter))
    out["words_without_letters"] = share(per_text(w.doc, letters[w.start + w.length] == letters[w.start]), w.count)
    out["long_words"] = share(per_text(w.doc, w.length > 20), w.count)
    # lines by a hash of their words; empty lines aside
    ends = np.append(0, np.cumsum(w.data == 10))
    line = ends[w.start]
    first = np.flatnonzero(np.append(True, (np.diff(line) != 0) | (np.diff(w.doc) != 0))) if len(line) else np.zeros(0, np.int64)
    if len(first):
        weight = (np.arange(len(line)) - np.repeat(first, np.diff(np.append(first, len(line))))).astype(np.uint64)
        line_hash = np.add.reduceat(w.hash * (weight * np.uint64(2) + np.uint64(1)), first)
        line_doc = w.doc[first]
        order = np.lexsort((line_hash, line_doc))
        new = np.append(True, (np.diff(line_doc[order]) != 0) | (line_hash[order][1:] != line_hash[order][:-1]))
        n_lines = per_text(line_doc)
        out["lines"], out["distinct_lines"] = share(n_lines, w.count), share(per_text(line_doc[order], new), n_lines)
    else:
        out["lines"] = out["distinct_lines"] = np.zeros(n_texts)
    return np.column_stack([out[f] for f in FEATURES])


@dataclass
class Forest:
    """Trees as arrays of nodes, shape (trees, nodes). A leaf points to itself; value holds leaves' contributions."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                go_left = x[rows, self.feature[t, node]] <= self.threshold[t, node]
                node = np.where(go_left, self.left[t, node], self.right[t, node])
            out += self.value[t, node]
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray) -> Forest:
    """Fit the trees: logistic loss, second-order gains over histograms of binned features."""
    n, ones = len(y), float(y.sum())
    n_nodes = 2 ** (DEPTH + 1) - 1
    shape = (TREES, n_nodes)
    none = Forest(0.0, *(np.zeros((0, n_nodes), t) for t in (np.int64, float, np.int64, np.int64, float)))
    if ones in (0, n):
        p = (ones + 1) / (n + 1)
        none.base = 40.0 if p == 1 else float(np.log(p / (1 - p)))
        return none
    n_features = x.shape[1]
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(n_features)]
    binned = np.column_stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(n_features)])  # bin b: edges[b-1] < v <= edges[b]
    flat = binned + np.arange(n_features) * BINS
    base = float(np.log(ones / (n - ones)))
    out = Forest(base, np.zeros(shape, np.int64), np.full(shape, np.inf), np.tile(np.arange(n_nodes), (TREES, 1)), np.tile(np.arange(n_nodes), (TREES, 1)), np.zeros(shape))
    raw = np.full(n, base)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for depth in range(DEPTH):
            first, width = 2**depth - 1, 2**depth
            at = node - first
            inside = np.flatnonzero(at >= 0)
            if not len(inside):
                break
            key = (at[inside, None] * (n_features * BINS) + flat[inside]).ravel()
            sums = [np.bincount(key, weights=np.repeat(v[inside], n_features), minlength=width * n_features * BINS).reshape(width, n_features, BINS) for v in (g, h)]
            gl, hl = (np.cumsum(s, axis=2) for s in sums)
            gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
            gain = gl**2 / (hl + PENALTY) + (gt - gl) ** 2 / (ht - hl + PENALTY) - gt**2 / (ht + PENALTY)
            gain[(hl < LEAST_HESSIAN) | (ht - hl < LEAST_HESSIAN)] = 0
            for f in range(n_features):
                gain[:, f, len(edges[f]) :] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                if gain.reshape(width, -1)[k, best[k]] > 1e-6:
                    f, b = divmod(int(best[k]), BINS)
                    i = first + k
                    out.feature[t, i], out.threshold[t, i], out.left[t, i], out.right[t, i] = f, edges[f][b], 2 * i + 1, 2 * i + 2
            go_left = x[np.arange(n), out.feature[t, node]] <= out.threshold[t, node]
            node = np.where(go_left, out.left[t, node], out.right[t, node])
        gs, hs = (np.bincount(node, weights=v, minlength=n_nodes) for v in (g, h))
        out.value[t] = -RATE * gs / (hs + PENALTY)
        raw += out.value[t, node]
    return out


def _features(bodies: list[str]) -> Iterator[np.ndarray]:
    texts = [t.encode() for t in bodies]
    for a, b in chunks(texts):
        yield statistics(words(texts[a:b]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> Forest:
    """Grow the trees on at most ``train_rows`` of the labelled documents.

    The sample's ids and labels (two numbers a row) are few enough to broadcast; only statistics come to the driver.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            x = np.concatenate([np.zeros((0, len(FEATURES))), *_features(rows["body"].tolist())])
            yield pd.DataFrame({"y": rows["y"], "x": list(x)})

    known = labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("int").alias("y")).dropna()
    sample = known.orderBy(F.xxhash64("id"), "id", "y").limit(train_rows)
    rows = keyed(docs, id_col, text_col).join(F.broadcast(sample), "id").select("body", "y")
    found = rows.mapInPandas(run, "y int, x array<double>").toPandas()
    x = np.array(found["x"].tolist(), float).reshape(len(found), len(FEATURES))
    order = np.lexsort((*x.T, found["y"]))  # the same trees whatever order the rows come in
    return grow(x[order], found["y"].to_numpy(float)[order])


def score(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text: id, score."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            scores = [forest.score(x) for x in _features(rows["body"].tolist())]
            yield pd.DataFrame({"id": rows["id"], "score": np.concatenate([np.zeros(0), *scores])})

    return named(keyed(docs, id_col, text_col).mapInPandas(run, "id long, score double"), id_col)


def keep_good(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose texts score ``threshold`` or more, with all their columns."""

    @F.pandas_udf("double")
    def score_of(bodies: pd.Series) -> pd.Series:
        return pd.Series(np.concatenate([np.zeros(0), *(forest.score(x) for x in _features(bodies.tolist()))]))

    return docs.where(score_of(F.coalesce(docs[text_col].cast("string"), F.lit(""))) >= threshold)


def fold(id_column: Column) -> Column:
    """The remainder, by 4, of the CRC-32 of an id as text."""
    return F.crc32(id_column.cast("string").cast("binary")) % 4
