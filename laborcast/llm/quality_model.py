"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are put into at most BINS quantile bins. A tree grows level by level: gradient and hessian sums per node,
feature and bin are one ``bincount``, their running sums give every split's gain. Trees are complete and flattened into
arrays, so a block of documents goes down all trees at once with array lookups.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import extended, slices, with_columns, without
from .textstats import line_counts, repeated_words

#: The model is fitted on at most this many labelled documents, those whose keys have the smallest hashes.
TRAIN_ROWS = 40_000
BINS, TREES, DEPTH, RATE, L2, LEAST = 64, 120, 4, 0.15, 2.0, 8.0
_SYMBOLS = b"#*$%&|<>"
#: 0 for what separates words, 2 for capitals (A-Z), 3 for digits, 1 for any other byte.
_KIND = np.array([0 if b == 32 or 9 <= b <= 13 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 1 for b in range(256)], dtype=np.uint8)
FEATURES = [
    "log_bytes", "log_words", "word_bytes", "longest_word", "distinct_words", "top_word", "repeated", "upper", "lower", "digits", "spaces",
    *[f"symbol_{chr(c)}" for c in _SYMBOLS], "exclaim", "stops", "commas", "other_punctuation", "controls", "high_bytes", "byte_entropy",
    "lines", "repeated_lines", "line_words", "capital_words", "digit_words", "one_byte_words", "top_byte",
]


def split(text: str) -> tuple[bytes, list[bytes], Counter]:
    """The bytes of a text, its words, and how often each is there."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    return data, words, Counter(words)


def statistics(text: str, parts: tuple[bytes, list[bytes], Counter] | None = None) -> list[float]:
    """The statistics of one text, named by FEATURES; an empty text has zeros. ``parts`` is its :func:`split`, if that is known."""
    data, words, counts = parts or split(text)
    if not words:
        return [0.0] * len(FEATURES)
    codes = np.frombuffer(data, dtype=np.uint8)
    h = np.bincount(codes, minlength=256)
    n, k = len(data), len(words)
    lines, repeats = line_counts(text)
    p = h[h > 0] / n
    punctuation = h[33:48].sum() + h[58:65].sum() + h[91:97].sum() + h[123:127].sum()
    symbols = [h[c] for c in _SYMBOLS]
    kinds = np.append(np.uint8(0), np.append(_KIND[codes], np.uint8(0)))
    first = kinds[1:-1][kinds[:-2] == 0]  # what stands at the start of each word, and zeros between words
    single = int(((kinds[1:-1] > 0) & (kinds[:-2] == 0) & (kinds[2:] == 0)).sum())
    return [
        np.log1p(n), np.log1p(k), (n - h[32] - h[9:14].sum()) / k, np.log1p(max(map(len, counts))), len(counts) / k, max(counts.values()) / k,
        repeated_words(words) / k, h[65:91].sum() / n, h[97:123].sum() / n, h[48:58].sum() / n, h[32] / n,
        *[s / k for s in symbols], h[33] / k, h[46] / k, h[44] / k, (punctuation - sum(symbols) - h[33] - h[46] - h[44]) / k, h[:32].sum() / n,
        h[128:].sum() / n, float(-(p * np.log2(p)).sum()), np.log1p(lines), repeats / max(1, lines), np.log1p(k / max(1, lines)),
        (first == 2).sum() / k, (first == 3).sum() / k, single / k, h.max() / n,
    ]


@dataclass
class Forest:
    """Complete trees as arrays: node i of a tree has the children 2i+1 and 2i+2."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes; above it goes right
    leaf: np.ndarray  # trees x leaves
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row."""
        out = np.full(len(x), self.base)
        trees = np.arange(len(self.leaf))
        depth = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        for start in range(0, len(x), 2048):
            block = x[start:start + 2048]
            rows = np.arange(len(block))[:, None]
            node = np.zeros((len(block), len(trees)), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (block[rows, self.feature[trees, node]] > self.threshold[trees, node])
            out[start:start + 2048] += self.leaf[trees, node - (self.leaf.shape[1] - 1)].sum(axis=1) if len(trees) else 0
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Boosted trees for logistic loss. Without both labels the forest is a constant: the smoothed share of label 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    inner, leaves = (1 << depth) - 1, 1 << depth
    empty = Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    if len(y) == 0 or y.min() == y.max():
        return empty
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(width)]
    bins = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], axis=1)  # bin b: edge b-1 < value <= edge b
    cells = bins + np.arange(width) * BINS
    margin, found = np.full(n, base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            index = ((node - first)[:, None] * (width * BINS) + cells).ravel()
            size = count * width * BINS
            sums = [np.bincount(index, np.repeat(v, width), size).reshape(count, width, BINS) for v in (g, h)]
            gl, hl = (np.cumsum(s, axis=2) for s in sums)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gr, hr = gt - gl, ht - hl
            gain = gl**2 / (hl + L2) + gr**2 / (hr + L2) - gt**2 / (ht + L2)
            gain[(hl < LEAST / 4) | (hr < LEAST / 4)] = 0
            best = gain.reshape(count, -1).argmax(axis=1)
            for i, b in enumerate(best):
                f, cut_at = divmod(int(b), BINS)
                if gain[i, f, cut_at] > 1e-9 and cut_at < len(edges[f]):
                    feature[first + i], threshold[first + i] = f, edges[f][cut_at]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        at = node - inner
        leaf = RATE * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + L2)
        margin += leaf[at]
        found.append((feature, threshold, leaf))
    return Forest(*(np.stack(a) for a in zip(*found)), base)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS) -> Forest:
    """Fit on documents that ``labels`` marks 0 or 1, at most ``rows`` of them, chosen by a hash of the key.

    The choice is the same in every run and at every size. Labels without a key or without a mark count for nothing; a
    key labelled twice counts twice. The keys chosen are few by this bound, so they go to the documents, not the
    documents to them.
    """
    marked = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label"))
    chosen = marked.orderBy(F.xxhash64("_key"), "_key", "_label").limit(rows)
    joined = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_key").select("_label", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "_text"):
            values = pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column(0), values], names=["label", "values"])

    got = joined.mapInArrow(run, "label int, values array<double>").toArrow()  # at most `rows` rows of numbers
    y = got.column("label").to_numpy().astype(float)
    x = np.array(got.column("values").to_pylist(), dtype=float).reshape(len(y), len(FEATURES))
    order = np.lexsort((*x.T[::-1], y))  # the same order whatever the partitions
    return fit(x[order], y[order])


def score(docs: DataFrame, forest: Forest, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 as ``name``, replacing a column of that name.

    Only the text counts. A null or empty text is scored by its statistics, all zero. Every row is kept, repeated ones
    too; texts are read whole; no rows give no rows.
    """
    source = without(docs, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, text):
            yield with_columns(part, **{name: pa.array(forest.score(np.array([statistics(t) for t in texts]).reshape(len(texts), len(FEATURES))))})

    return source.mapInArrow(run, extended(source, T.StructField(name, T.DoubleType(), False)))
