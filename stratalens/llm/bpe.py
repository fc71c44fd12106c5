"""Byte-pair encoding with word ends, and decoding, by merging short words in a contiguous rank array."""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stratalens.llm.text import only

#: Words of more symbols than this are merged with a heap; scanning is quadratic in the length.
SHORT = 96
#: Blank-separated chunks and words (each) that a worker remembers, at most twice as many, and the longest one worth remembering.
CACHE_PIECES = 200_000
CACHE_CHARS = 64
#: Characters (or ids) handled before a batch is handed on.
GROUP_CHARS = 1_000_000

#: What the tokenizer's ``\\s`` matches; Python counts the four separators \x1C to \x1F as blanks, too.
_NO_BLANKS = re.compile(r"[\x1c-\x1f]")
_BLANKS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")

#: Chunks that normalising leaves alone but for A-Z.
_SHOWN = re.compile(r"[!-~]+")

#: No adjacent pair at this place can merge.
_NEVER = 1 << 62


class MergeTable:
    """Merges of a vocabulary as numbers: rank of a pair of ids, and the id that it becomes."""

    def __init__(self, vocab: dict[str, int], merges: list) -> None:
        self.width = max(vocab.values(), default=0) + 1
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, merge in enumerate(merges):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks[vocab[left] * self.width + vocab[right]] = rank
            self.made.append(vocab[left + right])

    def merge(self, symbols: list[int]) -> list[int]:
        """``symbols`` with the pair of least rank, the leftmost of equals, merged until none is left."""
        return self._scan(symbols) if len(symbols) <= SHORT else self._heap(symbols)

    def _scan(self, ids: list[int]) -> list[int]:
        """One array of parts and one of the ranks between neighbours; a merge deletes one boundary and
        refreshes the two ranks beside it."""
        width, rank_of, made = self.width, self.ranks.get, self.made
        ids = list(ids)
        ranks = [rank_of(a * width + b, _NEVER) for a, b in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == _NEVER:
                break
            at = ranks.index(least)
            ids[at] = made[least]
            del ids[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = rank_of(ids[at] * width + ids[at + 1], _NEVER)
            if at:
                ranks[at - 1] = rank_of(ids[at - 1] * width + ids[at], _NEVER)
        return ids

    def _heap(self, ids: list[int]) -> list[int]:
        """The same result in n log n: boundaries are links, and outdated heap entries are passed over."""
        width, rank_of, made = self.width, self.ranks.get, self.made
        ids, n = list(ids), len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i) for i in range(n - 1) if (rank := rank_of(ids[i] * width + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or rank_of(ids[i] * width + ids[j]) != rank:
                continue
            ids[i], ids[j] = made[rank], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (rank := rank_of(ids[a] * width + ids[b])) is not None:
                    heapq.heappush(heap, (rank, a))
        return [i for i in ids if i >= 0]


class _Remembered(dict):
    """Ids by piece of text as bytes. Missing ones are encoded and short ones remembered: when it is full, only those used
    since it was full before are kept."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode, self.former = encode, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.former.get(piece)
        if ids is None:
            ids = self.encode(piece)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.former = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class WordBpe:
    """A byte-level BPE whose words end in a suffix and never reach across blanks.

    The tokenizer's file states how a text is normalised and split into words, and the ``tokenizers`` library
    does both for chunks beyond ASCII; the merging is done here.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        steps = [s["type"] for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        plain = model.get("type") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix")
        plain = plain and not any(model.get(k) for k in ("unk_token", "byte_fallback", "ignore_merges"))
        if not plain or steps != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in splits] != ["Split", "ByteLevel"]:
            raise ValueError(f"{path} is not a lower-casing byte-level BPE with word ends")
        if spec.get("decoder") or any(t["normalized"] for t in spec.get("added_tokens", [])):
            raise ValueError(f"{path} has a decoder or normalised special tokens")
        self.library = Tokenizer.from_file(path)
        self.words = re.compile(splits[0]["pattern"]["Regex"].replace(r"[\p{L}]", "[a-z]").replace(r"[\p{N}]", "[0-9]").replace(r"\p{L}\p{N}", "a-z0-9"))
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.table = MergeTable(vocab, model["merges"])
        self.inner = {c: i for c, i in vocab.items() if len(c) == 1}
        self.last = {c: vocab[c + end] for c in self.inner if c + end in vocab}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.cut = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        known = {**vocab, **self.special}
        self.pieces: list[str | None] = [None] * (max(known.values()) + 1)
        for piece, i in known.items():
            self.pieces[i] = piece
        self.chunks, self.merged = _Remembered(self._chunk), _Remembered(self._word)

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a text without blanks and special tokens."""
        if _SHOWN.fullmatch(chunk):
            words = self.words.findall(chunk.lower())
        else:
            steps = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))
            words = [word for word, _ in steps]
        return b"".join(map(self.merged.__getitem__, words))

    def _word(self, word: str) -> bytes:
        """Ids of one word, whose characters stand for its bytes."""
        symbols = [self.inner[c] for c in word[:-1] if c in self.inner]
        if word and word[-1] in self.last:
            symbols.append(self.last[word[-1]])
        return np.array(self.table.merge(symbols), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Token ids of a whole text as little-endian unsigned 32-bit numbers."""
        if not self.cut.search(text):
            return self._section(text)
        done, at = [], 0
        for found in self.cut.finditer(text):
            done += [self._section(text[at : found.start()]), np.array([self.special[found[0]]], "<u4").tobytes()]
            at = found.end()
        return b"".join([*done, self._section(text[at:])])

    def _section(self, text: str) -> bytes:
        chunks = filter(None, _BLANKS.split(text)) if _NO_BLANKS.search(text) else text.split()
        return b"".join(map(self.chunks.__getitem__, chunks))

    def decode(self, ids: bytes) -> str:
        """The pieces of the ids, parted by spaces; ids that the vocabulary lacks leave nothing."""
        numbers = np.frombuffer(ids, "<u4")
        if len(numbers) and int(numbers.max()) >= len(self.pieces):
            numbers = numbers[numbers < len(self.pieces)]
        pieces = map(self.pieces.__getitem__, numbers.tolist())
        try:
            return " ".join(pieces)
        except TypeError:  # a gap in the vocabulary
            return " ".join(p for i in numbers.tolist() if (p := self.pieces[i]) is not None)


@functools.lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def _grouped(column: pa.Array, size) -> Iterator[tuple[int, list]]:
    """First row and values of groups of rows of about GROUP_CHARS; a single value may be larger."""
    first, group, amount = 0, [], 0
    for i, value in enumerate(column):
        group.append(value.as_py())
        amount += size(group[-1])
        if amount >= GROUP_CHARS:
            yield first, group
            first, group, amount = i + 1, [], 0
    if group:
        yield first, group


def encode_texts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids`` of every row: the token ids of the whole text as little-endian unsigned 32-bit numbers.

    ``tokenizer`` is the file of a lower-casing byte-level BPE with word ends. The ids are those of the
    ``tokenizers`` library without added special tokens; special tokens that stand in the text are found
    as that library finds them. A text is cut at blanks, which no word crosses; each worker remembers the ids of
    short chunks, and merges a new word in an array of adjacent ranks. There is no shuffle.

    Edge cases: null and empty texts have no ids (not null); repeated rows are encoded each; a null id is carried
    along; a word of any length is merged in n log n; an empty table gives an empty result; other columns are ignored.
    """
    base = only(docs, doc_id=id_col, text=text_col)
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_bpe(tokenizer).encode
        for batch in batches:
            for first, texts in _grouped(batch.column("text"), lambda t: len(t or "")):
                ids = [encode(t) if t else b"" for t in texts]
                counts = pa.array([len(i) // 4 for i in ids], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(ids)), counts, pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"]
                )

    return base.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids binary")


def decode_ids(rows: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of every row of :func:`encode_texts`: pieces parted by spaces, word ends and special tokens shown,
    as the ``tokenizers`` library decodes for a vocabulary without a decoder.

    Edge cases: no ids decode to an empty text, null ids to null with no tokens; unknown ids leave nothing.
    """
    base = only(rows, doc_id=id_col, ids=ids_col)
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = word_bpe(tokenizer).decode
        for batch in batches:
            for first, ids in _grouped(batch.column("ids"), lambda i: len(i or b"") // 4):
                texts = [None if i is None else decode(i) for i in ids]
                counts = pa.array([len(i or b"") // 4 for i in ids], pa.int64())
                kept = [batch.column(c).slice(first, len(ids)) for c in ("doc_id", "ids")]
                yield pa.RecordBatch.from_arrays(
                    [kept[0], counts, kept[1], pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"]
                )

    return base.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids binary, decoded string")
