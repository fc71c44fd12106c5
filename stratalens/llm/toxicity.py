"""Toxic documents by a subsequence string kernel: a support vector machine on Nyström landmarks."""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from stratalens.llm.labels import labelled_sample
from stratalens.llm.text import only

#: Length of the common subsequences, how far one may stretch, and the weight of each character of its span.
LENGTH, REACH, DECAY = 4, 6, 0.7
#: What a class of training words costs when it is misjudged altogether.
COST = 20000.0
#: Labelled documents in the training sample at most (in expectation); landmarks; words a worker remembers.
SAMPLE = 5000
LANDMARKS = 500
#: Likelihood ratio (natural log) from which a subsequence tells the classes apart: by chance, less than
#: one in a million does.
SURE = 14.0
CACHE_WORDS = 300_000
#: Words of more than LONG letters are read in parts of WIDE letters, each starting STRIDE after the one before.
LONG, WIDE, STRIDE = 24, 12, 2
#: A word stands for toxic documents only if it is at least this many times more frequent among them than among clean ones.
ODDS = 5.0

_ALPHABET = 32
_CODE_OF = np.zeros(0x250, np.int64)
_CODE_OF[ord("^")], _CODE_OF[ord("$")] = 1, 28
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz"):
    _CODE_OF[ord(_c)] = _i + 2
#: Letters beyond ASCII by their base letter, the rest of the Latin block in two codes.
for _letters, _base in (("àáâãäå", "a"), ("ç", "c"), ("èéêë", "e"), ("ìíîï", "i"), ("ñ", "n"), ("òóôõö", "o"), ("ùúûü", "u"), ("ýÿ", "y")):
    for _c in _letters:
        _CODE_OF[ord(_c)] = _CODE_OF[ord(_base)]
for _c in range(0xC0, 0x250):
    if not _CODE_OF[_c]:
        _CODE_OF[_c] = 29 + _c % 2

#: Digits and signs that stand for letters inside words.
_LEET = str.maketrans("013457@$!", "oieastasi")
_NOT_LETTER = re.compile(r"[\W\d_]+")
_HAS_SIGN = re.compile(r"[\W\d_]")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
#: At least three lone characters in a row, with blanks between them.
_SPACED = re.compile(r"(?<!\S)\w(?:\s\w){2,}(?!\S)")


def plain_word(word: str) -> str:
    """The letters of a word: edges without signs, inner digits and signs read as letters or left out."""
    if not _HAS_SIGN.search(word):
        return word
    word = _EDGE.sub("", word)
    if _HAS_SIGN.search(word) and any(c.isalpha() for c in word):
        word = word.translate(_LEET)
    return _NOT_LETTER.sub("", word)


def windows(word: str) -> list[str]:
    """A word, or the overlapping parts of a long one: any ``WIDE - STRIDE + 1`` letters in a row lie in one part."""
    if len(word) <= LONG:
        return [word]
    return [word[k : k + WIDE] for k in range(0, len(word) - WIDE + STRIDE, STRIDE)]


def units(text: str | None) -> list[str]:
    """What the kernel reads: the words, and rows of lone characters put together."""
    text = (text or "").lower()
    found = text.split()
    if _SPACED.search(text):
        found += ["".join(m.group().split()) for m in _SPACED.finditer(text)]
    return found


def _offsets() -> list[tuple[tuple[int, ...], float]]:
    """Places of a subsequence's characters after its first one, with the weight of its span."""
    from itertools import combinations

    return [((0, *rest), DECAY ** (rest[-1] + 1)) for rest in combinations(range(1, REACH), LENGTH - 1)]


OFFSETS = _offsets()
#: A word has this many signs besides its letters.
SIGNS = 2


def _norms(longest: int) -> np.ndarray:
    """Length in the kernel's space by number of characters, no subsequence repeating."""
    out = np.zeros(longest + 1)
    for n in range(longest + 1):
        out[n] = sum(w * w * max(0, n - o[-1]) for o, w in OFFSETS)
    return np.sqrt(np.maximum(out, 1e-9))


def _encoded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character codes of all words one after another, each between a start and an end sign and followed by
    zeros, and the number of characters of each."""
    text = "".join([f"^{w}$" + "\0" * REACH for w in words])
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where(points < len(_CODE_OF), _CODE_OF[np.minimum(points, len(_CODE_OF) - 1)], 31)
    codes[points == 0] = 0
    return codes, np.fromiter(map(len, words), np.int64, len(words)) + SIGNS


def subsequences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each shape of subsequence: number of the word, code of the subsequence, weight."""
    codes, sizes = _encoded(words)
    owner = np.repeat(np.arange(len(words)), sizes + REACH)
    for places, weight in OFFSETS:
        n = len(codes) - places[-1]
        code = codes[:n].copy()
        inside = code > 0
        for p in places[1:]:
            part = codes[p : p + n]
            code = code * _ALPHABET + part
            inside &= part > 0
        at = np.flatnonzero(inside)
        at = at[owner[at] == owner[at + places[-1]]]
        yield owner[at], code[at], weight


class Kernel(NamedTuple):
    """Words as sparse rows of the kernel's feature space, scaled to unit length by their number of letters."""

    owner: np.ndarray
    code: np.ndarray
    value: np.ndarray
    count: int

    @classmethod
    def of(cls, words: list[str]) -> Kernel:
        parts = [(o, c, np.full(len(o), w)) for o, c, w in subsequences(words)]
        owner, code, value = (np.concatenate(x) for x in zip(*parts))
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + SIGNS
        norms = _norms(int(sizes.max(initial=1)))
        return cls(owner, code, value / norms[sizes[owner]], len(words))

    def against(self, other: Kernel) -> np.ndarray:
        """Kernel of every word here with every word there."""
        codes, place = np.unique(other.code, return_inverse=True)
        table = np.zeros((len(codes), other.count), np.float32)
        np.add.at(table, (place, other.owner), other.value)
        at = np.searchsorted(codes, self.code).clip(max=len(codes) - 1)
        hit = np.flatnonzero(codes[at] == self.code) if len(codes) else np.zeros(0, np.int64)
        out = np.zeros((self.count, other.count), np.float32)
        order = hit[np.argsort(self.owner[hit], kind="stable")]
        for start in range(0, len(order), 20000):
            part = order[start : start + 20000]
            rows, first = np.unique(self.owner[part], return_index=True)
            out[rows] += np.add.reduceat(table[at[part]] * self.value[part, None], first, axis=0)
        return out


class Model(NamedTuple):
    table: np.ndarray  # weight of every subsequence: the landmarks' part in the decision, added up
    bias: float
    pair: float  # bonus of two words, each below one strong word
    slope: float
    shift: float

    def decisions(self, words: list[str]) -> np.ndarray:
        """Distance of every word from the margin's middle."""
        out = np.zeros(len(words))
        for owner, code, weight in subsequences(words):
            out += np.bincount(owner, self.table[code] * weight, minlength=len(words))
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + SIGNS
        return out / _norms(int(sizes.max(initial=1)))[sizes] + self.bias


class Scorer:
    """Scores texts, remembering the words seen: the two worst units of a text make its score."""

    def __init__(self, model: Model) -> None:
        self.model, self.cache = model, {}

    def decide(self, texts: list[str | None]) -> np.ndarray:
        """The two highest decisions among each text's units."""
        found = [units(t) for t in texts]
        new = list(set().union(*found).difference(self.cache))
        for start in range(0, len(new), 20000):
            part = new[start : start + 20000]
            plain = [plain_word(w) for w in part]
            values = self.model.decisions(plain)
            # Long chains of characters are read in windows.
            for i, word in enumerate(plain):
                if len(word) > LONG:
                    values[i] = self.model.decisions(windows(word)).max()
            self.cache.update(zip(part, values.tolist()))
        get, low = self.cache.__getitem__, self.model.bias
        out = [heapq.nlargest(2, map(get, f)) for f in found]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        return np.array([[*top, low, low][:2] for top in out]).reshape(-1, 2)

    def score(self, texts: list[str | None]) -> list[float]:
        top = self.decide(texts)
        z = np.maximum(top[:, 0], top.mean(axis=1) + self.model.pair) * self.model.slope + self.model.shift
        return (1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))).tolist()


#: Unbroken pieces of words that witnesses are chosen by, and buckets to count them in.
PIECES, PIECE_BUCKETS = (5, 6, 7, 8), 1 << 21


def _pieces(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the word and bucket of each of its unbroken pieces, signs at its ends included."""
    codes, sizes = _encoded(words)
    owner = np.repeat(np.arange(len(words)), sizes + REACH)
    owners, buckets = [], []
    for length in PIECES:
        n = len(codes) - length + 1
        mixed, inside = np.full(n, length, np.uint64), np.ones(n, bool)
        for k in range(length):
            mixed = mixed * np.uint64(0x100000001B3) + codes[k : k + n].astype(np.uint64)
            inside &= codes[k : k + n] > 0
        mixed ^= mixed >> np.uint64(29)
        at = np.flatnonzero(inside)
        owners.append(owner[at])
        buckets.append((mixed[at] % np.uint64(PIECE_BUCKETS)).astype(np.int64))
    return np.concatenate(owners), np.concatenate(buckets)


def _witnesses(toxic: list[set[str]], clean_counts: Counter, clean: list[set[str]], each: int = 3) -> Counter:
    """Words that stand for the label of their document: those with a piece that tells toxic documents
    from clean ones, by the likelihood ratio of its counts in both.

    Labels may be wrong and clean documents may quote an insult: a word is ruled out by its odds in the two classes (one clean
    document added to each count), not by being met in a clean document.
    """
    toxic_counts = Counter(w for d in toxic for w in d)
    quoted = {w for w, n in clean_counts.items() if toxic_counts[w] * len(clean) < ODDS * (n + 1) * len(toxic)}

    def presence(docs: list[set[str]]) -> np.ndarray:
        found = np.zeros(PIECE_BUCKETS, np.float32)
        for words in filter(None, docs):
            found[np.unique(_pieces(sorted(words))[1])] += 1
        return found

    bad, good = presence(toxic), presence(clean)
    share = len(toxic) / (len(toxic) + len(clean))
    total = np.maximum(bad + good, 1)
    ratio = bad * np.log(np.maximum(bad, 1) / (total * share)) + good * np.log(np.maximum(good, 1) / (total * (1 - share)))
    ratio[(bad / len(toxic) < 5 * good / len(clean)) | (ratio < SURE)] = 0
    chosen: Counter = Counter()
    for words in toxic:
        known = sorted(words - quoted)
        if not known:
            continue
        best = np.zeros(len(known))
        owner, bucket = _pieces(known)
        np.maximum.at(best, owner, ratio[bucket])
        top = np.argsort(-best, kind="stable")[:each]
        chosen.update(known[i] for i in top if best[i] > 0 and best[i] >= best[top[0]] / 2)
    return chosen


def _varied(words: list[str], draw: np.random.Generator) -> list[str]:
    """The words with one letter put in, doubled or left out, as people write around filters."""
    out = []
    for word in words:
        at = int(draw.integers(1, len(word))) if len(word) > 1 else 1
        kind = int(draw.integers(3))
        letter = chr(97 + int(draw.integers(26))) if kind == 0 else word[at - 1]
        out.append(word[:at] + letter + word[at:] if kind < 2 or len(word) < 6 else word[:at] + word[at + 1 :])
    return out


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 30) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by Newton steps on the rows inside the margin."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    ridge = np.ones(len(w))
    ridge[-1] = 1e-3
    inside = np.ones(len(x1), bool)
    for _ in range(steps):
        part = x1[inside]
        weighted = part * cost[inside, None]
        w = np.linalg.solve(np.diag(ridge) + weighted.T @ part, weighted.T @ y[inside])
        now = y * (x1 @ w) < 1
        if (now == inside).all():
            break
        inside = now
    return w[:-1], float(w[-1])


def fit(texts: list[str], labels: list[int], prior: float = 0.5, landmarks: int = LANDMARKS) -> Model:
    """Learn from documents and their labels.

    A document is toxic because of one of its words, so witnesses are chosen first; then the machine
    separates witnesses from words of clean documents, and the clean words that it misjudges join
    the training words, twice. The decision is a sum of kernels with the landmarks, hence linear in the
    subsequences: their weights are added up once into a table. ``prior`` is the share of toxic ones.
    """
    docs = [{w for u in units(t) for w in windows(plain_word(u)) if w} for t in texts]
    toxic, clean = ([d for d, y in zip(docs, labels) if y == k] for k in (1, 0))
    clean_counts = Counter(w for d in clean for w in d)
    empty = Model(np.zeros(_ALPHABET**LENGTH, np.float32), -1.0, 0.0, 1.0, -4.0)
    if not toxic or not clean_counts:
        return empty
    chosen = _witnesses(toxic, clean_counts, clean)
    if not chosen:
        return empty
    draw = np.random.default_rng(3)
    positives = [w for w, _ in chosen.most_common(1500)]
    varied = [w for k in range(8) for w in _varied(positives[:150], draw) if w not in clean_counts]
    all_clean = sorted(w for w in clean_counts if w not in chosen)
    if not all_clean:
        return empty
    negatives = [all_clean[i] for i in draw.permutation(len(all_clean))[:3000]]
    model = empty
    for _ in range(3):
        marks = positives[: landmarks // 2] + negatives[-(landmarks - landmarks // 2) :]
        k_marks = Kernel.of(marks)
        values, vectors = np.linalg.eigh(k_marks.against(k_marks).astype(np.float64))
        kept = values > 1e-4 * values.max()
        root = vectors[:, kept] / np.sqrt(values[kept])
        words = positives + varied + negatives
        x = Kernel.of(words).against(k_marks) @ root
        y = np.repeat([1.0, -1.0], [len(positives) + len(varied), len(negatives)])
        often = np.sqrt([chosen[w] for w in positives])
        share = np.concatenate(
            [often / often.sum(), np.full(len(varied), 1 / max(1, len(varied))), np.full(len(negatives), 2 / len(negatives))]
        )
        w, bias = _svm(x, y, share * COST)
        part = root @ w
        table = np.zeros(_ALPHABET**LENGTH)
        np.add.at(table, k_marks.code, part[k_marks.owner] * k_marks.value)
        model = Model(table.astype(np.float32), bias, 0.0, 1.0, 0.0)
        judged = model.decisions(all_clean)
        known = set(negatives)
        negatives += [h for i in np.argsort(-judged, kind="stable")[:600] if (h := all_clean[i]) not in known]
    return _calibrated(model, Scorer(model).decide(texts), np.array(labels), prior)


def _calibrated(model: Model, top: np.ndarray, y: np.ndarray, prior: float) -> Model:
    """Logistic scores with the classes in their true shares: one strong word makes a text toxic, or
    two that are weaker by ``pair``, the bonus under which the classes are told apart best."""
    weight = np.where(y == 1, prior / max(1, (y == 1).sum()), (1 - prior) / max(1, (y == 0).sum())) * len(y)
    best = None
    for pair in np.arange(0.0, 2.01, 0.25):
        x = np.maximum(top[:, 0], top.mean(axis=1) + pair).clip(-4, 4)
        x1, w, ridge = np.stack([x, np.ones(len(x))], axis=1), np.zeros(2), np.array([0.5, 0.005])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
            h = (x1 * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x1 + np.diag(ridge)
            step = np.linalg.solve(h, x1.T @ (weight * (p - y)) + ridge * w)
            w = w - step
            if np.abs(step).max() < 1e-6:
                break
        p = np.clip(1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30))), 1e-9, 1 - 1e-9)
        loss = -float((weight * np.where(y == 1, np.log(p), np.log(1 - p))).sum()) + float((ridge * w * w).sum()) / 2
        if best is None or loss < best[0] - 1e-9:
            best = (loss, float(pair), float(w[0]), float(w[1]))
    return Model(model.table, model.bias, *best[1:])


def train(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id_col: str = "doc_id",
    label_col: str = "toxic",
    sample: int = SAMPLE,
) -> Model:
    """Learn from about ``sample`` labelled documents for which ``learn`` (on ``doc_id``) holds; both
    classes are drawn by a hash of the id, each up to half of the sample."""
    chosen, sizes = labelled_sample(labels, learn, label_id_col, label_col, sample)
    prior = sizes.get(1, 0) / max(1, sum(sizes.values()))
    base = only(docs, doc_id=id_col, text=text_col).join(F.broadcast(chosen), "doc_id")
    rows = base.where("text IS NOT NULL").select("doc_id", "label", "text").orderBy("doc_id").toArrow()
    return fit(rows.column("text").to_pylist(), rows.column("label").to_pylist(), prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every row of ``docs``, from its text alone.

    Edge cases: null and empty texts score low (no word decides); without labels of both classes so does
    every text; texts are read whole; every row is judged by its own text; an empty table
    gives an empty result; other columns are ignored.
    """
    base = only(docs, doc_id=id_col, text=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            scores: list[float] = []
            for start in range(0, batch.num_rows, 200):
                scores += scorer.score(batch.column("text").slice(start, 200).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(scan, f"doc_id {kind}, score double")
