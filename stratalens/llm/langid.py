"""Language of a text: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from stratalens.llm.text import only

#: Hash buckets of character n-grams, and the orders of the n-grams.
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Documents a language gives to the training sample at most (in expectation).
SAMPLE_PER_LANG = 600
UNDETERMINED = "und"
#: Scale of the relative term frequencies, so that one pass moves the weights.
SCALE = 30.0

_MULTIPLIERS = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))
_SHIFT = np.uint32(32 - BUCKETS.bit_length() + 1)


@functools.cache
def _letters() -> np.ndarray:
    """1 for code points that are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def ngram_buckets(text: str | None) -> np.ndarray | None:
    """Buckets of all n-grams of the text, one entry an occurrence; None without letters.

    The text is lower-cased; every run of other characters than letters is one blank.
    """
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, 32).astype(np.uint32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = np.concatenate(([np.uint32(32)], codes[keep], [np.uint32(32)])).astype(np.uint32)
    out, mixed = [], np.zeros(len(codes), np.uint32)
    for order in range(1, max(ORDERS) + 1):
        if len(codes) < order:
            break
        mixed = mixed[: len(codes) - order + 1] * np.uint32(31) + (codes[order - 1 :] + np.uint32(order)) * _MULTIPLIERS[order - 1]
        if order in ORDERS:
            out.append((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x9E3779B1) >> _SHIFT)
    return np.concatenate(out)


class Model(NamedTuple):
    langs: list[str]
    weights: np.ndarray  # bucket x lang, with the idf of the bucket and SCALE multiplied in
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        buckets = ngram_buckets(text)
        if buckets is None or not self.langs:
            return UNDETERMINED, 0.0
        z = (self.weights.take(buckets, axis=0).mean(axis=0, dtype=np.float64) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def _document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all learning texts each bucket occurs; counted in the tasks, then added up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, docs = np.zeros(BUCKETS, np.int64), 0
        seen = np.zeros(BUCKETS, bool)
        for batch in batches:
            for text in batch.column("text"):
                buckets = ngram_buckets(text.as_py())
                if buckets is not None:
                    docs += 1
                    seen[buckets] = True
                    found += seen
                    seen[:] = False
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), pa.array(np.append(found[at], docs))], ["bucket", "n"]
        )

    counts = texts.select("text").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    table = counts.toPandas()  # at most one row a bucket
    df = np.zeros(BUCKETS, np.int64)
    inner = table["bucket"] >= 0
    df[table["bucket"][inner]] = table["n"][inner]
    return df, int(table["n"][~inner].sum())


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def ftrl(
    rows: list[tuple[np.ndarray, np.ndarray, int]],
    classes: int,
    epochs: int = 3,
    alpha: float = 0.3,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.05,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights by follow-the-regularised-leader with an elastic net: per coordinate, the weight is zero
    until the summed gradient exceeds ``l1``, and shrunk by ``l2`` and the coordinate's own rate after."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))
    order = np.random.default_rng(7)

    def weights(at):
        zs, rate = z[at], (beta + np.sqrt(n[at])) / alpha + l2
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / rate)

    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, values, label = rows[i]
            at, values = np.append(at, BUCKETS), np.append(values, 1.0)
            w = weights(at)
            error = _softmax(values @ w)
            error[label] -= 1.0
            g = values[:, None] * error
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(slice(None))
    return w[:BUCKETS], w[BUCKETS]


def temperature_of(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        p = _softmax(logits / np.exp(log_t))
        return -float(np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean())

    low, high, ratio = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(
    docs: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_per_lang: int = SAMPLE_PER_LANG,
) -> Model:
    """Learn from the rows of ``docs`` for which ``learn`` (on ``doc_id``) holds and the language is known.

    Document frequencies cover all these rows. The weights are fitted on a sample of about
    ``sample_per_lang`` documents of each language, drawn by a hash of the id; every fifth of them is
    kept back to set the temperature.
    """
    base = only(docs, doc_id=id_col, text=text_col, lang=lang_col)
    known = base.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0)
    df, total = _document_frequencies(known)
    idf = np.log((1.0 + total) / (1.0 + df)) + 1.0
    langs = sorted(sizes)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    # One rate a language; there are as many as languages, whatever the corpus.
    rates = docs.sparkSession.createDataFrame(
        [(lang, min(1.0, sample_per_lang / n)) for lang, n in sizes.items()], "lang string, rate double"
    )

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, counts = [], []
            for text in batch.column("text"):
                buckets = ngram_buckets(text.as_py())
                found, n = np.unique(buckets, return_counts=True) if buckets is not None else (np.zeros(0), np.zeros(0))
                at.append(found.astype(np.int32))
                counts.append((n / max(1, n.sum())).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), pa.array(at, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.float32()))],
                ["doc_id", "lang", "at", "tf"],
            )

    sample = known.join(F.broadcast(rates), "lang").where(draw < F.col("rate")).select("doc_id", "lang", "text")
    kind = base.schema["doc_id"].dataType.simpleString()
    table = (
        sample.mapInArrow(features, f"doc_id {kind}, lang string, at array<int>, tf array<float>").orderBy("doc_id").toArrow()
    )
    place = {lang: i for i, lang in enumerate(langs)}
    at_column, tf_column = table.column("at").combine_chunks(), table.column("tf").combine_chunks()
    rows = []
    for i, lang in enumerate(table.column("lang").to_pylist()):
        at = at_column[i].values.to_numpy(zero_copy_only=False)
        if len(at):
            rows.append((at, tf_column[i].values.to_numpy(zero_copy_only=False) * idf[at] * SCALE, place[lang]))
    fit, kept = [r for i, r in enumerate(rows) if i % 5], rows[::5]
    weights, bias = ftrl(fit or rows, len(langs))
    logits = np.array([values @ weights[at] + bias for at, values, _ in kept]).reshape(-1, len(langs))
    temperature = temperature_of(logits, np.array([label for *_, label in kept], dtype=int))
    return Model(langs, (weights * idf[:, None] * SCALE).astype(np.float32), bias, temperature)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for every row of ``docs``, from its text alone.

    Edge cases: a null text, or one without letters, is ``und`` with score 0, as is every text when
    nothing could be learned; texts are read whole; every row is judged by its own text; an empty
    table gives an empty result; other columns are ignored.
    """
    base = only(docs, doc_id=id_col, text=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of buckets a language

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = [known.predict(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([lang for lang, _ in found], pa.string()),
                    pa.array([score for _, score in found], pa.float64()),
                ],
                ["doc_id", "lang_pred", "score"],
            )

    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(scan, f"doc_id {kind}, lang_pred string, score double")

