"""Quality of a text by pairwise ranking: better and worse documents, logistic loss on feature differences.

The model is fitted on all labelled documents and all pairs of a better and a worse one. A pair's loss depends on the difference of
two scores alone, so the sum over all pairs needs the scores' counts on a grid, not the pairs: in each round one pass over the
documents counts scores, another adds up the gradient. Features are measured once and written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from stratalens.llm.labels import agreed_labels
from stratalens.llm.ngram_join import bounded
from stratalens.llm.text import only, words
from stratalens.operators.ordering import quantiles
from stratalens.session import materialize, scratch_path

#: Preference pairs a pass of ``bradley_terry`` in memory; ``train`` takes all pairs.
PAIRS = 20000
#: Standardised features are cut at this.
BOUND = 6.0
#: Cells of the grid of scores, and lengths of steps along a direction that one pass tries.
CELLS = 2048
STEPS = (1 / 64, 1 / 16, 1 / 4, 1 / 2, 1.0, 2.0, 4.0, 8.0)
#: Rows whose features a task holds as doubles at once.
BLOCK = 1000

#: Bytes by kind: the pairs of neighbouring kinds are features.
_KINDS = (
    *[bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(48, 58)), b" ", b"\n\r", b"\t\x0b\x0c"],
    *[b".", b",", b";:", b"!", b"?", b"'\"`", b"-_", b"()[]{}", b"|", b"*", b"$", b"%", b"&", b"#", b"@", b"/\\", b"=+", b"<>", b"~^"],
    bytes(range(128, 192)),
    bytes(range(192, 256)),
)
_KIND_OF = np.zeros(256, np.int64)
for _k, _chars in enumerate(_KINDS):
    _KIND_OF[list(_chars)] = _k + 1
N_KINDS = len(_KINDS) + 1
_MIX = np.uint64(0x9E3779B97F4A7C15)


def features(text: str | None) -> np.ndarray:
    """Shares of neighbouring character kinds, then measures of length and repetition."""
    data = (text or "").encode("utf-8", "surrogatepass")
    kinds = _KIND_OF[np.frombuffer(data, np.uint8)]
    pairs = np.zeros(N_KINDS * N_KINDS)
    if len(kinds) > 1:
        pairs = np.bincount(kinds[:-1] * N_KINDS + kinds[1:], minlength=N_KINDS * N_KINDS) / (len(kinds) - 1)
    tokens = words(text or "")
    n = len(tokens)
    lines = data.count(b"\n") + 1
    if n:
        ids = np.fromiter(map(hash, tokens), np.int64, n).view(np.uint64)
        _, counts = np.unique(ids, return_counts=True)
        distinct, top = len(counts) / n, counts.max() / n
        same = float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0
        triples = ids[:-2] * _MIX + (ids[1:-1] ^ (ids[1:-1] >> np.uint64(29))) * _MIX * _MIX + ids[2:] if n > 2 else ids[:1]
        again = 1.0 - len(np.unique(triples)) / len(triples)
        mean = sum(map(len, tokens)) / n
    else:
        distinct, top, same, again, mean = 0.0, 0.0, 0.0, 0.0, 0.0
    measures = [np.log1p(n), np.log1p(mean), distinct, top, same, again, np.log1p(n / lines), float(n == 0)]
    return np.concatenate([np.sqrt(pairs), measures]).astype(np.float32)


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return ((x - mean) / scale).clip(-BOUND, BOUND)


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def score(self, text: str | None) -> float:
        if not len(self.weights):
            return 1.0
        z = standard(features(text), self.mean, self.scale) @ self.weights
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * (z - self.threshold), -30, 30))))


def bradley_terry(good: np.ndarray, bad: np.ndarray, pairs: int = PAIRS, epochs: int = 30, rate: float = 0.05, l2: float = 1e-3) -> np.ndarray:
    """Weights under which the better document of a pair wins with probability sigmoid of its score minus
    the other's, for features in memory. Pairs are drawn anew in every pass; Adam steps on batches of them."""
    draw = np.random.default_rng(11)
    w = np.zeros(good.shape[1])
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    for _ in range(epochs):
        left, right = draw.integers(len(good), size=pairs), draw.integers(len(bad), size=pairs)
        for start in range(0, pairs, 500):
            d = good[left[start : start + 500]] - bad[right[start : start + 500]]
            p = 1.0 / (1.0 + np.exp(np.clip(d @ w, -30, 30)))
            g = -(d * p[:, None]).mean(axis=0) + l2 * w
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def quantile_threshold(scores: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Where the scores are cut, and how steeply: the quantile at the share of bad documents, halfway
    between its two neighbours; the slope sets the mean distance of the documents to 4."""
    order = np.sort(scores)
    at = int(round((labels == 0).mean() * len(order)))
    at = min(max(at, 1), len(order) - 1)
    threshold = float(order[at - 1] + order[at]) / 2
    return threshold, 4.0 / max(1e-6, float(np.abs(scores - threshold).mean()))


def cell_width(weights: np.ndarray) -> float:
    """The width at which the grid holds every score under ``weights``."""
    return float(BOUND * np.abs(weights).sum() / (CELLS / 2 - 2)) or 1.0


def taps(scores: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """The four cells around each score and its shares in them (cubic interpolation), both to count and to look up."""
    at = scores / width + CELLS / 2
    first = at.astype(np.int64) - 1
    f = at - first - 1
    shares = [-f * (f - 1) * (f - 2) / 6, (f + 1) * (f - 1) * (f - 2) / 2, -(f + 1) * f * (f - 2) / 2, (f + 1) * f * (f - 1) / 6]
    return first[:, None] + np.arange(4), np.stack(shares, axis=-1)


def against(counts: np.ndarray, width: float, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """For each cell, the sum over all counted scores of ``f`` of the difference from the cell's score to theirs."""
    kernel = f(width * np.arange(CELLS, -CELLS - 1, -1))
    size = 4 * CELLS
    return np.fft.irfft(np.fft.rfft(counts, size) * np.fft.rfft(kernel, size), size)[CELLS : 2 * CELLS + 1]


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, x)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0.0, -x))


def total(table: DataFrame, shape: tuple[int, ...], add: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> np.ndarray:
    """The sum over all rows of ``table`` of arrays of ``shape``: ``add`` puts a block of labels and features to the array of its
    task, Spark adds up the entries of the tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(shape)
        for labels, x in blocks(batches):
            add(sums, labels, x)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums.ravel()[at])], ["at", "value"])

    found = table.mapInArrow(count, "at bigint, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(int(np.prod(shape)))  # as many entries as the array has, whatever the table
    out[found.column("at").to_numpy()] = found.column("value").to_numpy()
    return out.reshape(shape)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Labels and features of ``BLOCK`` rows at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            x = np.frombuffer(b"".join(part.column("features").to_pylist()), np.float32).reshape(part.num_rows, -1)
            yield part.column("label").to_numpy(), x.astype(np.float64)


class AllPairs(NamedTuple):
    """Mean logistic loss over all pairs of a document of label 1 and one of label 0 in ``table`` (``label, features``)."""

    table: DataFrame
    mean: np.ndarray
    scale: np.ndarray
    pairs: float
    l2: float = 1e-3

    def along(self, weights: np.ndarray, direction: np.ndarray, steps: tuple[float, ...]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Loss, weights and counts of scores (by label and cell) of each step from ``weights``, in one pass."""
        tried = [weights + step * direction for step in steps]
        widths, mean, scale = [cell_width(w) for w in tried], self.mean, self.scale

        def add(sums: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
            for sum_, scores, width in zip(sums, (standard(x, mean, scale) @ np.stack(tried, axis=1)).T, widths):
                cells, shares = taps(scores, width)
                place = cells + labels[:, None] * (CELLS + 1)
                sum_ += np.bincount(place.ravel(), shares.ravel(), 2 * (CELLS + 1)).reshape(2, -1)

        counts = total(self.table, (len(steps), 2, CELLS + 1), add)
        return [(self.loss(w, c, width), w, c) for w, c, width in zip(tried, counts, widths)]

    def loss(self, weights: np.ndarray, counts: np.ndarray, width: float) -> float:
        return float(counts[1] @ against(counts[0], width, _softplus) / self.pairs + self.l2 / 2 * weights @ weights)

    def gradient(self, weights: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Each document moves the score by the sum over all of the other class of the chance that a pair is lost."""
        width, mean, scale = cell_width(weights), self.mean, self.scale
        pull = np.stack([against(counts[1], width, lambda x: _sigmoid(-x)), -against(counts[0], width, _sigmoid)])

        def add(sums: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
            x = standard(x, mean, scale)
            cells, shares = taps(x @ weights, width)
            sums += (pull[labels[:, None], cells] * shares).sum(axis=1) @ x

        return total(self.table, weights.shape, add) / self.pairs + self.l2 * weights


def minimise(goal: AllPairs, size: int, rounds: int = 200, memory: int = 10, tolerance: float = 1e-4) -> np.ndarray:
    """Weights of least loss by the limited-memory BFGS method, from zero, until a round lowers the loss by less than a part of
    ``tolerance``. The loss is convex, so of the steps tried the one of least loss is taken."""
    best, w, counts = goal.along(np.zeros(size), np.zeros(size), (0.0,))[0]
    gradient = goal.gradient(w, counts)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, parts = -gradient, []
        for s, y in reversed(moves):
            parts.append(s @ d / (s @ y))
            d = d - parts[-1] * y
        d = d * (moves[-1][0] @ moves[-1][1] / (moves[-1][1] @ moves[-1][1])) if moves else d / max(1.0, np.abs(d).sum())
        for (s, y), part in zip(moves, reversed(parts)):
            d = d + (part - y @ d / (s @ y)) * s
        found, tried, counts = min(goal.along(w, d, STEPS), key=lambda option: option[0])
        if found >= best * (1 - tolerance):
            break
        after = goal.gradient(tried, counts)
        moves = [*moves, (tried - w, after - gradient)][-memory:]
        best, w, gradient = found, tried, after
    return w


def measured(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """``label, features`` of every row of ``docs`` (``doc_id, text``) with a label in ``labelled``, written once and read again."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(text.as_py()).tobytes() for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(rows, pa.binary())], ["label", "features"])

    spark, schema = docs.sparkSession, "label int, features binary"
    path = scratch_path(spark, "quality")
    docs.join(bounded(materialize(labelled)), "doc_id").select("label", "text").mapInArrow(measure, schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def train(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id_col: str = "doc_id",
    label_col: str = "quality",
) -> Model:
    """Learn from all labelled documents for which ``learn`` (on ``doc_id``) holds.

    Mean and spread of the features, the weights (over all pairs of a good and a bad document) and the cut, which is the exact
    quantile of all their scores at the share of bad ones, come from every one of them.
    """
    table = measured(only(docs, doc_id=id_col, text=text_col).where(learn), agreed_labels(labels, learn, label_id_col, label_col))
    size = len(features(""))

    def add_moments(sums: np.ndarray, label: np.ndarray, x: np.ndarray) -> None:
        sums[0] += x.sum(axis=0)
        sums[1] += (x * x).sum(axis=0)
        sums[2, :2] += np.bincount(label, minlength=2)

    sums = total(table, (3, size), add_moments)
    bad, good = int(sums[2, 0]), int(sums[2, 1])
    if not bad or not good:
        return Model(np.zeros(0), np.zeros(0), np.zeros(0), 0.0, 1.0)
    n = bad + good
    mean = sums[0] / n
    scale = np.maximum(np.sqrt(np.maximum(sums[1] / n - mean * mean, 0.0)), 1e-3)
    weights = minimise(AllPairs(table, mean, scale, float(bad) * good), size)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(standard(x, mean, scale) @ weights)], ["score"])

    scores = table.mapInArrow(place, "score double")
    # Halfway between the last bad and the first good place, as in ``quantile_threshold``.
    threshold = quantiles(scores, [], "score", {"cut": (min(max(bad, 1), n - 1) - 0.5) / (n - 1)}).first()["cut"]
    distance = scores.agg(F.avg(F.abs(F.col("score") - threshold))).first()[0]
    return Model(mean, scale, weights, float(threshold), 4.0 / max(1e-6, float(distance)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every row of ``docs``, from its text alone; 0.5 is the quantile threshold.

    Edge cases: null and empty texts are scored by their (empty) features; without labels of both classes every
    score is 1; texts are read whole; every row is judged by its own text; an empty table
    gives an empty result; other columns are ignored.
    """
    return only(docs, doc_id=id_col, text=text_col).select("doc_id", scorer(docs.sparkSession, model)("text").alias("score"))


def scorer(spark: SparkSession, model: Model) -> Callable[[str], Column]:
    """The score of a text column as a column."""
    shared = spark.sparkContext.broadcast(model)  # a fixed number of features

    @F.pandas_udf("double")
    def score_texts(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(text) for text in texts], dtype="float64")

    return score_texts
