"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

Statistics are made once per text, in Arrow batches. Training, in numpy on the driver, takes a bounded sample of
labelled documents: each statistic is cut into bins by its quantiles, a tree's level is found from histograms of
gradients and Hessians over (node, bin), and the trees are flattened into arrays (statistic, threshold, left child,
value), which a vectorised traversal follows for all documents and trees, level by level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import bounded_sample, held_out, keep

#: Labelled documents trained on (a bound that does not grow with the data): those whose hashed doc_id is smallest.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, L2, LEAST = 60, 4, 32, 0.2, 1.0, 20
THRESHOLD = 0.3

#: Classes of bytes whose share of the text is a statistic.
_CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "blank": [9, 10, 11, 12, 13, 32],
    "symbol": b"#*$%&|<>",
    "bang": b"!?",
    "stop": b".,;:",
    "bar": b"|",
    "high": range(128, 256),
    "quote": b"'\"()[]{}=+-_/\\@~^`",
}
STATISTICS = ("log_bytes", "log_words", "word_length", "longest_word", "distinct_words", "doubled_words", "capital_words", "lines", "line_words", "distinct_lines", "entropy", *(f"share_{c}" for c in _CLASSES))
_MASKS = np.zeros((256, len(_CLASSES)))
for _k, _members in enumerate(_CLASSES.values()):
    _MASKS[list(_members), _k] = 1


def statistics(text: str) -> list[float]:
    """The statistics of one text, in the order of ``STATISTICS``."""
    data = text.encode("utf-8", "replace")
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, w = max(1, len(data)), max(1, len(words))
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    some = counts[counts > 0] / n
    return [
        np.log1p(len(data)),
        np.log1p(len(words)),
        sum(map(len, words)) / w,
        max(map(len, words), default=0),
        len(set(words)) / w,
        sum(map(str.__eq__, words, words[1:])) / w,
        sum(map(str.isupper, words)) / w,
        np.log1p(len(lines)),
        len(words) / max(1, len(lines)),
        len(set(lines)) / max(1, len(lines)),
        float(-(some * np.log2(some)).sum()),
        *(counts @ _MASKS / n),
    ]


@dataclass
class Trees:
    """Flattened trees: per tree and node the statistic (-1 in a leaf), the threshold (left if the value is at most
    that), the left child (the right one follows it) and the value. ``start`` is the log odds without any tree."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, t, l, v in zip(self.feature, self.threshold, self.left, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while (inner := f[node] >= 0).any():
                on, at = rows[inner], node[inner]
                node[on] = l[at] + (x[on, f[at]] > t[at])
            total += v[node]
        return 1 / (1 + np.exp(-total))


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, node: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each node the best (statistic, bin, gain) from histograms; gain 0 where no split helps."""
    best = np.zeros(nodes)
    feature, cut = np.full(nodes, -1), np.zeros(nodes, dtype=np.int64)
    for j in range(x.shape[1]):
        cell = node * BINS + x[:, j]
        gs, hs, ns = (np.bincount(cell, w, nodes * BINS).reshape(nodes, BINS).cumsum(axis=1) for w in (g, h, None))
        gl, hl, nl, gt, ht, nt = gs[:, :-1], hs[:, :-1], ns[:, :-1], gs[:, -1:], hs[:, -1:], ns[:, -1:]
        gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
        gain[(nl < LEAST) | (nt - nl < LEAST)] = 0
        at = gain.argmax(axis=1)
        top = gain[np.arange(nodes), at]
        better = top > best + 1e-9
        best[better], feature[better], cut[better] = top[better], j, at[better]
    return feature, cut, best


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees | None:
    """Boosted on the logistic loss; None without rows. With one label only, no tree is grown."""
    if not len(y):
        return None
    share = np.clip(y.mean(), 0.001, 0.999)
    start = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    score, size = np.full(len(y), start), 2 ** (depth + 1) - 1
    grown = []
    for _ in range(trees if 0 < y.mean() < 1 else 0):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        f, t, l, v = np.full(size, -1), np.zeros(size), np.zeros(size, dtype=np.int64), np.zeros(size)
        place, used, level = np.zeros(len(y), dtype=np.int64), 1, np.array([0])
        for d in range(depth + 1):
            local = np.searchsorted(level, place)
            on = np.flatnonzero((local < len(level)) & (level[np.minimum(local, len(level) - 1)] == place))
            gs, hs = (np.bincount(local[on], w[on], len(level)) for w in (g, h))
            v[level] = -RATE * gs / (hs + L2)
            if d == depth:
                break
            feature, cut, gain = _split(binned[on], g[on], h[on], local[on], len(level))
            grows = level[gain > 0]
            if not len(grows):
                break
            f[grows] = feature[gain > 0]
            t[grows] = [edges[a][b] if b < len(edges[a]) else np.inf for a, b in zip(feature[gain > 0], cut[gain > 0], strict=True)]
            l[grows] = used + 2 * np.arange(len(grows))
            used += 2 * len(grows)
            bin_of = np.zeros(size, dtype=np.int64)
            bin_of[grows] = cut[gain > 0]
            move = on[f[place[on]] >= 0]
            at = place[move]
            place[move] = l[at] + (binned[move, f[at]] > bin_of[at])
            level = np.sort(np.concatenate([l[grows], l[grows] + 1]))
        score = score + v[place]
        grown.append((f, t, l, v))
    shape = (len(grown), size)
    parts = [np.array([tree[k] for tree in grown]).reshape(shape) for k in range(4)]
    return Trees(start, parts[0].astype(np.int64), parts[1].astype(float), parts[2].astype(np.int64), parts[3].astype(float))


def measure(documents: DataFrame) -> DataFrame:
    """doc_id and the statistics (array of floats) of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.asarray(statistics(t or ""), dtype=np.float32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float32()))], names=["doc_id", "x"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, x array<float>")


def train_on(measured: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees | None:
    """Trains on at most ``sample`` labelled documents that are not held out; of several labels the largest counts."""
    marks = labels.where(~held_out("doc_id") & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("y"))
    rows = bounded_sample(keep(measured.join(marks, "doc_id")), "doc_id", sample, "x").select("x", "y").collect()
    return train(np.array([r["x"] for r in rows], dtype=float), np.array([r["y"] for r in rows], dtype=float)) if rows else None


def score(measured: DataFrame, trees: Trees | None) -> DataFrame:
    """``measured`` with the score in a column of its own; 0.5 if there was nothing to learn from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(float) if n else np.empty((0, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees.scores(x) if trees else np.full(n, 0.5), pa.float64())], names=["doc_id", "score"])

    return measured.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def classify(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``documents`` (doc_id, text), learnt from ``labels`` (doc_id,
    quality).

    Only statistics of the text go into a score. Null and empty texts are scored as empty ones; repeated rows are
    repeated; documents without a label are scored like any other; other columns are ignored; no rows give none.
    """
    measured = keep(measure(documents))
    scored = score(measured, train_on(measured, labels, sample))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
