"""Packing of tokenised documents into fixed windows by minimum bin slack."""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from stratalens.llm.ngram_join import bounded
from stratalens.llm.text import only
from stratalens.session import materialize

#: Characters encoded at a time, and words remembered by a worker between such groups.
GROUP_CHARS = 1_000_000
CACHE_WORDS = 100_000
#: Pieces whose ids are handed on at a time.
PIECES = 2000

_BLANK_BEFORE_BLANK = re.compile(r" (?!\S)")


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    A byte-level BPE never joins a token across the space before a word, so each space-led word has
    the same ids wherever it stands. Words are encoded once and remembered; the new ones of a group
    of texts are encoded in one call on the same vocabulary. Texts with a blank after a space or
    with a special token, and vocabularies of any other kind, take the tokenizer's own way.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.cache: dict[str, bytes] = {}
        self.fast = None
        ranks = self._ranks(spec)
        if ranks:
            pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
            self.fast = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.leads = np.zeros(max(ranks.values()) + 1, dtype=bool)
            self.leads[[i for token, i in ranks.items() if token.startswith(b" ")]] = True

    @functools.cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _ranks(self, spec: dict) -> dict[bytes, int] | None:
        """Bytes to id, if this is a plain byte-level BPE whose ids follow the order of its merges."""
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space")
        if not plain or spec.get("normalizer") or not before.get("use_regex", True):
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown}
        byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.special}
        merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        if any(vocab.get(m.replace(" ", "")) != 256 + i for i, m in enumerate(merges)) or len(vocab) != 256 + len(merges):
            return None
        return {bytes(byte_of[c] for c in token): i for token, i in vocab.items()}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.fast is None:
            return [self._whole(t) for t in texts]
        odd = [bool(_BLANK_BEFORE_BLANK.search(t)) or any(s in t for s in self.special) for t in texts]
        parts = [[] if o else t.split(" ") for t, o in zip(texts, odd)]
        new = list(set().union(*(p[1:] for p in parts)).difference(self.cache))
        if new:
            ids = self.fast.encode_to_numpy(" " + " ".join(new), disallowed_special=()).astype("<u4")
            at = [*(4 * np.flatnonzero(self.leads[ids])).tolist(), 4 * len(ids)]
            if len(at) != len(new) + 1:
                raise ValueError("words and their tokens do not line up")
            data = ids.tobytes()
            self.cache.update((w, data[a:b]) for w, a, b in zip(new, at, at[1:]))
        get = self.cache.__getitem__
        done = [
            self._whole(t) if o else self._first(p[0]) + b"".join(map(get, p[1:]))
            for t, o, p in zip(texts, odd, parts)
        ]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        return done

    def _first(self, word: str) -> bytes:
        return self.fast.encode_to_numpy(word, disallowed_special=()).astype("<u4").tobytes() if word else b""


@functools.lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    return Encoder(path)


def binary_parts(length: int) -> list[int]:
    """``length`` as descending powers of two."""
    return [1 << k for k in reversed(range(length.bit_length())) if length >> k & 1]


def token_ids(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: its token ids, and how many rows of its task before it have a tail of the same length.

    ``full`` are the leading pieces of ``capacity`` tokens and ``rest`` is the tail, as little-endian
    unsigned 32-bit bytes. Rows are sorted within their tasks, so ``inside`` does not hang on their order.
    """
    base = only(docs, doc_id=id_col, text=text_col).sortWithinPartitions("doc_id", "text")
    kind = base.schema["doc_id"].dataType.simpleString()
    step = 4 * capacity

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        seen: dict[int, int] = {}
        for batch in batches:
            first, group, chars = 0, [], 0
            values = batch.column("text")
            for i in range(batch.num_rows):
                group.append(values[i].as_py() or "")
                chars += len(group[-1])
                if chars < GROUP_CHARS and i + 1 < batch.num_rows:
                    continue
                tokens, full, rest, inside = [], [], [], []
                for ids in encoder.encode(group):
                    data = ids + end
                    cut = len(data) // step * step
                    tail = (len(data) - cut) // 4
                    tokens.append(len(data) // 4)
                    full.append([data[k : k + step] for k in range(0, cut, step)])
                    rest.append(data[cut:])
                    inside.append(seen.get(tail, 0))
                    seen[tail] = inside[-1] + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, len(group)),
                        pa.array(tokens, pa.int64()),
                        pa.array(full, pa.list_(pa.binary())),
                        pa.array(rest, pa.binary()),
                        pa.array(inside, pa.int64()),
                    ],
                    ["doc_id", "doc_tokens", "full", "rest", "inside"],
                )
                first, group, chars = i + 1, [], 0
        encoder.cache.clear()  # the worker may serve other operators next

    return base.mapInArrow(encode, f"doc_id {kind}, doc_tokens bigint, full array<binary>, rest binary, inside bigint")


def with_ids(pieces: DataFrame) -> DataFrame:
    """``data`` of every piece as ``ids``, and their check sum."""
    kind = pieces.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PIECES):
                some = batch.slice(at, PIECES)
                data = some.column("data").to_pylist()
                ids = pa.array(np.frombuffer(b"".join(data), "<u4").astype(np.int32))
                ends = np.cumsum([0, *(len(d) // 4 for d in data)]).astype(np.int32)
                made = {"ids_crc32": pa.array([zlib.crc32(d) for d in data], pa.int64()), "ids": pa.ListArray.from_arrays(ends, ids)}
                yield pa.RecordBatch.from_arrays([made[n] if n in made else some.column(n) for n in names], names)

    return pieces.mapInArrow(
        read,
        f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
        "offset bigint, ids array<int>",
    )


def fill_window(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, with at most ``counts`` of each, whose sum comes closest to ``room``.

    Reachable sums are bits of one integer; the sets after each length are kept, so the counts of
    the best sum can be traced back.
    """
    mask = (2 << room) - 1
    reach, layers = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        layers.append((length, reach))
        moved = reach
        for _ in range(min(counts[length], room // length)):
            moved = moved << length & mask
            if not moved:
                break
            reach |= moved
        if reach >> room & 1:
            break
    best, used = reach.bit_length() - 1, {}
    for length, before in reversed(layers):
        while not before >> best & 1:
            best -= length
            used[length] = used.get(length, 0) + 1
    return used


def plan_windows(counts: dict[int, int], capacity: int, max_slack: int = 0) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """Windows as (lengths with their counts, how many windows like it), and the lengths left over.

    The longest remaining length opens a window, the best multiset fills it, and the window is
    repeated as often as the counts allow. A length whose best window misses the capacity by more
    than ``max_slack`` is left over.
    """
    left = {length: n for length, n in counts.items() if n}
    windows, over = [], {}
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        if not rest[longest]:
            del rest[longest]
        used = fill_window(rest, capacity - longest)
        used[longest] = used.get(longest, 0) + 1
        if capacity - sum(k * n for k, n in used.items()) > max_slack:
            over[longest] = left.pop(longest)
            continue
        times = min(left[k] // n for k, n in used.items())
        windows.append((used, times))
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return windows, over


def _slots(windows, over, window: int) -> tuple[list[tuple[int, ...]], int]:
    """Where the tails of each length go, as rows over ranks ``[first, past)`` of that length:
    (length, first, past, part, size, start, each, sequence, offset, line)."""
    rows, taken, sequence = [], {}, 0
    for used, times in windows:
        offset = 0
        for length, each in sorted(used.items(), reverse=True):
            first = taken.get(length, 0)
            taken[length] = first + each * times
            rows.append((length, first, first + each * times, -1, length, 0, each, sequence, offset, -1))
            offset += length * each
        sequence += times
    line, place = 0, {}
    for size in (1 << k for k in reversed(range(window.bit_length()))):
        for length, n in sorted(over.items()):
            if length & size:
                place[length, size] = line
                line += n * size
    for length, n in sorted(over.items()):
        start, first = 0, taken.get(length, 0)
        for part, size in enumerate(binary_parts(length)):
            rows.append((length, first, first + n, part, size, start, 1, sequence, 0, place[length, size]))
            start += size
    return rows, line


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 1024,
    end_id: int = 0,
    max_slack: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of tokenised documents and their places in sequences of at most ``capacity`` tokens.

    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``, one row a piece: the
    ``ids`` of a sequence's pieces, put together by ``offset``, are its training row, and ``ids_crc32`` is
    the check sum of those ids as 32-bit numbers. A document's ids end with ``end_id``. Leading pieces of ``capacity`` tokens are sequences of their
    own. The tails are counted by length, at most ``capacity - 1`` numbers whatever the size of
    the corpus, and windows are planned on these counts by minimum bin slack. Lengths that fit no window
    are cut into powers of two, which fill windows exactly; what remains at the very end is dealt to
    sequences whose lengths are powers of two, so nothing is padded (with ``max_slack`` above 0,
    windows may stay short by that much instead of cutting).

    The documents get their places by rank within their length: ranks are counted within the
    tasks that tokenise and shifted by the counts of the tasks before, so no length is gathered in one
    task, however many copies share it. Texts are tokenised once; the ids are written once and cut
    where they lie, without a shuffle as long as the counts by length and task can be broadcast.

    Edge cases: null and empty texts are the end id alone; every row is packed, repeated ones too;
    a null id is carried along; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = materialize(token_ids(docs, tokenizer, capacity, end_id, id_col, text_col))
    rows = rows.withColumn("task", F.spark_partition_id()).withColumn("tail", (F.col("doc_tokens") % capacity).cast("int"))
    tails = rows.where("tail > 0").drop("full")
    per_task = materialize(tails.groupBy("tail", "task").agg(F.count(F.lit(1)).alias("n")))
    counts = {r["tail"]: r["n"] for r in per_task.groupBy("tail").agg(F.sum("n").alias("n")).collect()}
    windows, over = plan_windows(counts, capacity, max_slack)
    window = 1 << (capacity.bit_length() - 1)
    slots, line = _slots(windows, over, window)
    sequences = sum(times for _, times in windows)
    whole = line // window
    # What does not fill the last window: sequences of descending powers of two.
    ends = np.cumsum(binary_parts(line % window)).tolist()

    before = Window.partitionBy("tail").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shifted = per_task.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = tails.join(bounded(materialize(shifted)), ["tail", "task"]).withColumn("rank", F.col("before") + F.col("inside"))
    # At most one row a length and window shape, both bounded by the capacity.
    plan = spark.createDataFrame(
        slots,
        "tail int, first bigint, past bigint, part int, size bigint, at bigint, each bigint, sequence bigint, "
        "shift bigint, line bigint",
    )
    placed = ranked.join(F.broadcast(plan), "tail").where("rank >= first AND rank < past")
    turn = F.col("rank") - F.col("first")
    uncut = F.col("part") < 0
    on_line = F.col("line") + turn * F.col("size")
    last = on_line - F.lit(whole * window)
    last_sequence, last_start = F.lit(0), F.lit(0)
    for i, end in enumerate(ends[:-1]):
        last_sequence = F.when(last >= end, i + 1).otherwise(last_sequence)
        last_start = F.when(last >= end, end).otherwise(last_start)
    number = F.floor(on_line / window)
    tail_pieces = placed.select(
        "doc_id",
        (F.col("doc_tokens") - F.col("tail") + F.col("at")).alias("start"),
        F.col("size").alias("length"),
        F.substring("rest", F.col("at").cast("int") * 4 + 1, F.col("size").cast("int") * 4).alias("data"),
        "doc_tokens",
        F.when(uncut, F.col("sequence") + F.floor(turn / F.col("each")))
        .when(number < whole, F.col("sequence") + number)
        .otherwise(F.col("sequence") + whole + last_sequence)
        .cast("long")
        .alias("sequence_id"),
        F.when(uncut, F.col("shift") + turn % F.col("each") * F.col("size"))
        .when(number < whole, on_line % window)
        .otherwise(last - last_start)
        .cast("long")
        .alias("offset"),
    )
    full = rows.where(F.size("full") > 0).select("doc_id", "doc_tokens", F.posexplode("full").alias("k", "data"))
    full_pieces = full.select(
        "doc_id",
        (F.col("k").cast("long") * capacity).alias("start"),
        F.lit(capacity).cast("long").alias("length"),
        "data",
        "doc_tokens",
        (F.lit(sequences + whole + len(ends)) + F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return with_ids(tail_pieces.unionByName(full_pieces))
