"""Passages of test items in documents, found by streaming words through a generalised suffix automaton."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from stratalens.llm.text import only

#: Characters of test items that one automaton may hold; larger benchmarks are split into several.
AUTOMATON_CHARS = 20_000_000

#: A word is a run of ASCII letters and digits and of all characters beyond ASCII.
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
_PLAIN = bytes(
    b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)


def plain_words(text: str | None) -> list[bytes]:
    """A-Z lower-cased words as UTF-8."""
    return (text or "").encode().translate(_PLAIN).split()


class SuffixAutomaton:
    """All word sequences of a set of items, and which items hold those of ``window`` words.

    ``follow`` walks a text word by word and keeps the longest sequence ending there that some item
    contains. Items shorter than ``window`` words count where they occur whole.
    """

    def __init__(self, items: Iterable[tuple[str, str | None]], window: int) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        shorts: dict[int, set[str]] = {}
        paths = []
        for name, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in plain_words(text)]
            if words:
                last = 0
                for word in words:
                    last = self._extend(last, word)
                paths.append((name, words))
        held = [set() for _ in self.next]
        for name, words in paths:
            state = 0
            for at, word in enumerate(words):
                state = self.next[state][word]
                if at + 1 >= window:
                    held[state].add(name)
            if len(words) < window:
                shorts.setdefault(state, set()).add(name)
        # From long to short, the items of a state also hold its suffixes.
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            up = self.link[state]
            if self.length[up] >= window:
                held[up] |= held[state]
        # The state of the last ``window`` words, and the short items that end wherever a state is reached.
        self.window_state = [0] * len(self.next)
        self.items = held
        self.own_short = shorts
        self.shorter: list[tuple[int, ...]] = [()] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            up = self.link[state]
            self.window_state[state] = self.window_state[up] or (state if self.length[state] >= window else 0)
            self.shorter[state] = self.shorter[up] + ((up,) if up in shorts else ())

    def _extend(self, last: int, word: int) -> int:
        """Add ``word`` after the sequence of state ``last`` and return the state of the longer one."""
        nexts, link, length = self.next, self.link, self.length
        there = nexts[last].get(word)
        if there is not None and length[there] == length[last] + 1:
            return there
        if there is not None:
            return self._clone(last, word, there)
        new = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        state = last
        while state >= 0 and word not in nexts[state]:
            nexts[state][word] = new
            state = link[state]
        if state >= 0:
            there = nexts[state][word]
            link[new] = there if length[there] == length[state] + 1 else self._clone(state, word, there)
        return new

    def _clone(self, state: int, word: int, there: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        copy = len(nexts)
        nexts.append(dict(nexts[there]))
        link.append(link[there])
        length.append(length[state] + 1)
        link[there] = copy
        while state >= 0 and nexts[state].get(word) == there:
            nexts[state][word] = copy
            state = link[state]
        return copy

    def follow(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Spans of words (first, past) that lie in occurrences, and the items that occur."""
        nexts, link, length, window = self.next, self.link, self.length, self.window
        own, shorter, window_state = self.own_short, self.shorter, self.window_state
        spans: list[list[int]] = []
        reached: set[int] = set()
        state = run = 0
        for at, word in enumerate(map(self.vocabulary.get, words)):
            if word is None:
                state = run = 0
                continue
            there = nexts[state].get(word)
            while there is None and state:
                state = link[state]
                run = length[state]
                there = nexts[state].get(word)
            if there is None:
                run = 0
                continue
            state = there
            run += 1
            first = at + 1
            if run >= window:
                first = at + 1 - run
                reached.add(window_state[state])
            if own:
                ends = shorter[state]
                if state in own and run == length[state]:
                    ends += (state,)
                if ends:
                    reached.update(ends)
                    first = min(first, at + 1 - length[ends[-1]])
            if first <= at:
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append([first, at + 1])
        found: set[str] = set()
        for state in reached:
            found |= own.get(state, set()) if length[state] < window else self.items[state]
        return spans, found


def _blocks(items: DataFrame, limit: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of about ``limit`` characters; one block at a time is on the driver."""
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = -(-size // limit) or 1
    for block in range(count):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == block) if count > 1 else items
        yield [(r["item"], r["text"]) for r in part.collect()]


_SPANS = "array<struct<first: bigint, past: bigint>>"
_ARROW_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))


def _as_structs(spans: list[list[int]]) -> list[dict[str, int]]:
    return [{"first": a, "past": b} for a, b in spans]


def _scan(base: DataFrame, items: list[tuple[str, str]], window: int, judge: Judge | None) -> DataFrame:
    """``base`` (text last) with ``n_words, spans, items`` of one block of test items; with ``judge``, judged in the
    same pass and without the text."""
    shared = base.sparkSession.sparkContext.broadcast(items)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = SuffixAutomaton(shared.value, window)
        for batch in batches:
            counts, spans, found = [], [], []
            for text in batch.column("text"):
                words = plain_words(text.as_py())
                hit, names = automaton.follow(words)
                counts.append(len(words))
                spans.append(hit)
                found.append(sorted(names))
            counts, named = pa.array(counts, pa.int64()), pa.array(found, pa.list_(pa.string()))
            if judge is not None:
                yield judge.batch(batch, counts, spans, named)
                continue
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, counts, pa.array(map(_as_structs, spans), _ARROW_SPANS), named],
                [*batch.schema.names, "n_words", "spans", "items"],
            )

    if judge is not None:
        return base.mapInArrow(scan, judge.schema(base))
    fields = StructType.fromDDL(f"n_words bigint, spans {_SPANS}, items array<string>").fields
    return base.mapInArrow(scan, StructType(base.schema.fields + fields))


class Judge(NamedTuple):
    """What happens to documents with spans: those of more than ``max_words`` words are cut out, and documents
    covered by more than ``max_coverage`` are dropped."""

    max_words: int
    max_coverage: float

    def batch(self, batch: pa.RecordBatch, counts: pa.Array, spans: list[list[list[int]]], items: pa.Array) -> pa.RecordBatch:
        hits, texts, drops = [], [], []
        for text, n, found in zip(batch.column("text"), counts, spans):
            hit = sum(past - first for first, past in found)
            cut = [s for s in found if s[1] - s[0] > self.max_words]
            hits.append(hit)
            texts.append(without_spans(text.as_py(), cut) if cut else text.as_py())
            drops.append(hit > self.max_coverage * n.as_py())
        kept = [name for name in batch.schema.names if name in ("row", "doc_id")]
        columns = [counts, pa.array(hits, pa.int64()), pa.array(map(_as_structs, spans), _ARROW_SPANS), items]
        columns += [pa.array(texts, pa.string()), pa.array(drops, pa.bool_())]
        names = ["n_words", "n_hit", "spans", "items", "clean_text", "dropped"]
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *columns], [*kept, *names])

    @staticmethod
    def schema(base: DataFrame) -> StructType:
        fields = StructType.fromDDL(
            f"n_words bigint, n_hit bigint, spans {_SPANS}, items array<string>, clean_text string, dropped boolean"
        ).fields
        return StructType([f for f in base.schema.fields if f.name in ("row", "doc_id")] + fields)


def _joined(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for first, past in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], past)
        else:
            out.append([first, past])
    return out


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and what stands between them."""
    places = [m.span() for m in _WORD.finditer(text)]
    kept, at = [], 0
    for first, past in spans:
        kept.append(text[at : places[first][0]])
        at = places[past - 1][1]
    return "".join([*kept, text[at:]])


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    max_words: int = 0,
    max_coverage: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    automaton_chars: int = AUTOMATON_CHARS,
    carry: bool = False,
) -> DataFrame:
    """Every row of ``docs`` with what it shares with ``benchmark`` and its text without that.

    ``doc_id, n_words, n_hit, spans, items, clean_text, dropped``, and with ``carry`` the whole row of ``docs`` as the struct
    ``row``. A span is a run of words covered
    by occurrences of ``window`` consecutive words of an item, or of whole shorter items. Spans of more
    than ``max_words`` words are cut out of ``clean_text``; where spans cover more than
    ``max_coverage`` of the words, the document is ``dropped``.

    The items are test sets, not a corpus. An automaton holds at most ``automaton_chars`` characters
    of them; a larger benchmark is split, and each part is one pass over the documents whose spans are
    then joined. Documents never meet each other.

    Edge cases: a null text has no words, and its clean text is null; null or wordless items match
    nothing; a null item id counts as the empty id; repeated items count once; rows that repeat an
    id are judged each by their own text; empty tables give empty or clean results; other columns
    are ignored.
    """
    named = {"doc_id": F.col(f"`{id_col}`"), "text": F.col(f"`{text_col}`")}
    others = {"row": F.struct(*[F.col(f"`{c}`") for c in docs.columns])} if carry else {}
    base = docs.select(*[c.alias(name) for name, c in {**others, **named}.items()])
    items = only(benchmark, item=item_col, text=item_text_col)
    items = items.select(F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item"), "text").where("text IS NOT NULL")
    judge = Judge(max_words, max_coverage)
    blocks = _blocks(items, automaton_chars)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _scan(base, first, window, judge)
    found = _scan(base, first, window, None)
    while second is not None:
        found, second = found.unionByName(_scan(base, second, window, None)), next(blocks, None)
    found = found.select("doc_id", F.xxhash64("text").alias("version"), "n_words", "spans", "items")
    found = found.groupBy("doc_id", "version").agg(
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.max("n_words").alias("n_words"),
    )
    texts = base.withColumn("version", F.xxhash64("text"))
    same = texts["doc_id"].eqNullSafe(found["doc_id"]) & (texts["version"] == found["version"])
    found = texts.join(found, same).select(*[texts[c] for c in base.columns], "n_words", "spans", "items")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [_joined([(s["first"], s["past"]) for s in found]) for found in batch.column("spans").to_pylist()]
            yield judge.batch(batch, batch.column("n_words"), spans, batch.column("items"))

    return found.mapInArrow(clean, judge.schema(base))
