"""Quality classifier: a generalised additive model with pairwise interactions.

Features are counts and ratios of the whole text. Each is cut into bins at quantiles; boosting goes
round the features in turn and fits a shallow tree to one of them at a time, so that the sum of
its trees is one lookup table for each feature. Then the pairs of features that explain most of what is
left get tables of their own in the same way. A score is the sum of table entries.

Training uses at most ``MAX_TRAIN_ROWS`` labelled documents, those with the smallest hashes of
their ids; only their features reach the driver. Scoring reads every whole text.

Defined results: a null text is empty and gets a score like any other; labels without a quality and
ids that are null are not used; without labels of both kinds the score is the smoothed
share of good labels (0.5 for none). An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuesift.llm.common import small_batches, text_of

#: Bound of the training sample, and the share of ids that is never trained on.
MAX_TRAIN_ROWS = 20_000
FOLDS, HELD_OUT_FOLD = 5, 0
THRESHOLD = 0.3

BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, LEAVES, RATE = 120, 3, 0.15
_L2, _MIN_ROWS = 1.0, 3

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "longest_word", "upper", "symbols", "marks", "bangs", "pipes", "digits",
    "non_ascii", "different_words", "top_word", "different_lines", "line_words", "repeated_triples", "commas", "stops",
)


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    out[list(chars)] = 1
    return out


_CLASSES = np.stack([
    _mask(bytes(range(65, 91))),                              # upper
    _mask(bytes(range(65, 91)) + bytes(range(97, 123))),      # letters
    _mask(b"#$%&*+/<=>@\\^_`{|}~"),                           # symbols
    _mask(b"\"'()-:;[]?"),                                    # marks
    _mask(b"!"), _mask(b"|"), _mask(b"0123456789"), _mask(bytes(range(128, 256))), _mask(b","), _mask(b"."),
])


def features(text: str) -> list[float]:
    """The values of ``FEATURES`` for one whole text."""
    data = text.encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    counts = _CLASSES @ np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    upper, letters, symbols, marks, bangs, pipes, digits, beyond, commas, stops = counts.tolist()
    words = data.split()
    n_words = max(1, len(words))
    seen = Counter(words)
    lines = [line for line in data.split(b"\n") if line.strip()]
    triples = set(zip(words, words[1:], words[2:], strict=False))
    return [
        math.log1p(len(data)), math.log1p(len(words)), (len(data) - len(words)) / n_words,
        math.log1p(max(map(len, seen), default=0)), upper / max(1, letters), symbols / n, marks / n_words,
        bangs / n_words, pipes / n_words, digits / n, beyond / n, len(seen) / n_words,
        max(seen.values(), default=0) / n_words, len(set(lines)) / max(1, len(lines)),
        math.log1p(len(words) / max(1, len(lines))), 1 - len(triples) / max(1, len(words) - 2),
        commas / n_words, stops / n_words,
    ]


def held_out(doc_id: Column) -> Column:
    """True for the ids whose label is never trained on; a null id is not held out."""
    fold = F.crc32(doc_id.cast("string")) % FOLDS
    return F.coalesce(fold == HELD_OUT_FOLD, F.lit(False))


@dataclass
class Model:
    """Intercept, cut points and table of each feature, and tables of pairs on coarser cuts."""

    intercept: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of a good label for each row of features."""
        total = np.full(len(rows), self.intercept)
        for at, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cuts, rows[:, at], side="right")]
        for a, b, table in self.pairs:
            total += table[
                np.searchsorted(self.coarse[a], rows[:, a], side="right"),
                np.searchsorted(self.coarse[b], rows[:, b], side="right"),
            ]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Cut points half way between quantiles of the different values."""
    levels = np.unique(np.quantile(values, np.linspace(0, 1, bins + 1), method="nearest"))
    return (levels[1:] + levels[:-1]) / 2


def _gain(grad, weight):
    return grad * grad / (weight + _L2)


def _steps(grad: np.ndarray, weight: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Values of a tree with at most ``LEAVES`` leaves over the bins of one feature."""
    sums = [np.concatenate([[0.0], np.cumsum(x)]) for x in (grad, weight, rows)]
    edges = [0, len(grad)]
    for _ in range(LEAVES - 1):
        best, cut = 1e-9, None
        for low, high in pairwise(edges):
            if high - low < 2:
                continue
            at = np.arange(low + 1, high)
            (g1, h1, n1), (g, h, n) = (
                [s[at] - s[low] for s in sums], [s[high] - s[low] for s in sums]
            )
            gain = _gain(g1, h1) + _gain(g - g1, h - h1) - _gain(g, h)
            gain[(n1 < _MIN_ROWS) | (n - n1 < _MIN_ROWS)] = -1
            k = int(gain.argmax())
            if gain[k] > best:
                best, cut = gain[k], int(at[k])
        if cut is None:
            break
        edges = sorted([*edges, cut])
    out = np.zeros(len(grad))
    for low, high in pairwise(edges):
        out[low:high] = (sums[0][high] - sums[0][low]) / (sums[1][high] - sums[1][low] + _L2)
    return out


def _quadrants(grad: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree with one cut on each axis of a pair of features."""
    g, h = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (grad, weight))
    best, found = 0.0, None
    for i in range(1, grad.shape[0]):
        for j in range(1, grad.shape[1]):
            corners = [
                (s[i, j], s[i, -1] - s[i, j], s[-1, j] - s[i, j], s[-1, -1] - s[i, -1] - s[-1, j] + s[i, j])
                for s in (g, h)
            ]
            gain = sum(_gain(a, b) for a, b in zip(*corners, strict=True)) - _gain(g[-1, -1], h[-1, -1])
            if gain > best:
                best, found = gain, (i, j, [a / (b + _L2) for a, b in zip(*corners, strict=True)])
    values = np.zeros(grad.shape)
    if found:
        i, j, (values[:i, :j], values[:i, j:], values[i:, :j], values[i:, j:]) = found
    return best, values


def fit(rows: np.ndarray, labels: np.ndarray) -> Model:
    """Cyclic boosting of the tables of single features, then of pairs."""
    n, good = len(labels), int(labels.sum()) if len(labels) else 0
    share = (good + 1) / (n + 2)
    model = Model(math.log(share / (1 - share)))
    if good in (0, n):
        return model
    model.cuts = [_cuts(rows[:, at], BINS) for at in range(rows.shape[1])]
    model.coarse = [_cuts(rows[:, at], PAIR_BINS) for at in range(rows.shape[1])]
    model.tables = [np.zeros(len(cuts) + 1) for cuts in model.cuts]
    bins = [np.searchsorted(cuts, rows[:, at], side="right") for at, cuts in enumerate(model.cuts)]
    total = np.full(n, model.intercept)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return labels - p, p * (1 - p)

    for _ in range(ROUNDS):
        for table, at in zip(model.tables, bins, strict=True):
            grad, weight = slope()
            size = len(table)
            step = RATE * _steps(
                np.bincount(at, grad, size), np.bincount(at, weight, size), np.bincount(at, minlength=size)
            )
            table += step
            total += step[at]

    coarse = [np.searchsorted(cuts, rows[:, at], side="right") for at, cuts in enumerate(model.coarse)]

    def grids(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        shape = len(model.coarse[a]) + 1, len(model.coarse[b]) + 1
        cell, (grad, weight) = coarse[a] * shape[1] + coarse[b], slope()
        return tuple(np.bincount(cell, x, shape[0] * shape[1]).reshape(shape) for x in (grad, weight))

    gains = {pair: _quadrants(*grids(*pair))[0] for pair in combinations(range(rows.shape[1]), 2)}
    chosen = [pair for pair in sorted(gains, key=lambda pair: -gains[pair])[:PAIRS] if gains[pair] > 0]
    model.pairs = [(a, b, np.zeros((len(model.coarse[a]) + 1, len(model.coarse[b]) + 1))) for a, b in chosen]
    for _ in range(ROUNDS // 4):
        for a, b, table in model.pairs:
            step = RATE * _quadrants(*grids(a, b))[1]
            table += step
            total += step[coarse[a], coarse[b]]
    return model


def training_rows(
    docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, text_col: str = "text", id_col: str = "doc_id"
) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``max_rows`` labels outside the held-out fold."""
    usable = labels.filter(
        labels["doc_id"].isNotNull() & labels["quality"].isNotNull() & ~held_out(labels["doc_id"])
    ).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    picked = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select(docs[id_col].alias("doc_id"), text_of(docs, text_col).alias("text"))
    one = rows.join(F.broadcast(picked), "doc_id")  # at most max_rows rows of two numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id, text, quality = batch.columns
            values = [features(t) for t in text.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [doc_id, quality, pa.array(values, pa.list_(pa.float64()))], names=["doc_id", "quality", "values"]
            )

    small_batches(docs.sparkSession)
    typed = one.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("quality").cast("int").alias("quality"))
    measured = typed.mapInArrow(run, "doc_id long, quality int, values array<double>")
    # Repeated ids must not outgrow the bound either.
    kept = measured.orderBy(F.xxhash64("doc_id"), "doc_id", "values").limit(max_rows).toArrow()
    values = np.array(kept["values"].to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    return values, np.array(kept["quality"].to_pylist(), dtype=float)


def train(docs: DataFrame, labels: DataFrame, **options) -> Model:
    return fit(*training_rows(docs, labels, **options))


def scores(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id", carry: bool = False) -> DataFrame:
    """``id, score`` of each row; with ``carry`` the whole row comes along as ``row``."""
    small_batches(docs.sparkSession)
    rows = docs.select(
        docs[id_col].alias("id"), text_of(docs, text_col).alias("text"),
        *([F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []),
    )

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        values = np.array([features(text) for text in texts.to_pylist()], dtype=float).reshape(-1, len(FEATURES))
        return pa.array(model.score(values), pa.float64())

    return rows.withColumn("score", score(F.col("text"))).drop("text")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, with their own columns."""
    return scores(docs, model, text_col, id_col, carry=True).filter(F.col("score") >= threshold).select("row.*")
