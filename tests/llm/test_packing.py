import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalens.llm.packing import binary_parts, encoder_of, fill_window, pack, plan_windows

tokenizers = pytest.importorskip("tokenizers")
places = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def path():
    return str(places.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def tokenizer(path):
    return tokenizers.Tokenizer.from_file(path)


TEXTS = [
    "Hello there, friend.",
    "",
    " leading and trailing ",
    "double  blanks \n and\n\nlines\t tabs",
    "naïve café ñandú £5 ½ ²³ 漢字 🙂 don't we'll",
    "x" * 3000,
    "a <|endoftext|> b",
    " wide blank \x1c sep",
    "word " * 5000,
]


def test_ids_are_those_of_the_tokenizer(path, tokenizer):
    encoder = encoder_of(path)
    assert encoder.fast is not None
    got = [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(TEXTS)]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in TEXTS]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t.,'sA1é"), st.characters(codec="utf-8")), max_size=60))
def test_ids_of_any_text(text):
    path = str(places.path("byte_bpe_50k.json"))
    encoder = encoder_of(path)
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def check_packed(rows, texts, tokenizer, capacity):
    """Every id in exactly one piece, sequences without gaps; returns the padding."""
    sequences = defaultdict(list)
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for members in sequences.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_every_token_has_one_place(docs_of, path, tokenizer):
    texts = [(i, (TEXTS * 4)[i]) for i in range(30)] + [(100, None)] + [(200 + i, "the same copy") for i in range(500)]
    rows = pack(docs_of(texts).repartition(5), path, capacity=64).collect()
    assert check_packed(rows, texts, tokenizer, 64) == 0


def test_sequences_can_be_built(docs_of, path, tokenizer):
    """The pieces carry the ids: documents and sequences come out of the rows alone."""
    texts = [(i, (TEXTS * 3)[i]) for i in range(27)] + [(100, None)]
    rows = pack(docs_of(texts).repartition(3), path, capacity=64).collect()
    built, sequences = defaultdict(list), defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        built[r.doc_id] += r.ids
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert len(sequences[r.sequence_id]) == r.offset and len(r.ids) == r.length
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        sequences[r.sequence_id] += r.ids
    assert dict(built) == {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for d, t in texts}
    assert max(map(len, sequences.values())) == 64 and sum(map(len, sequences.values())) == sum(map(len, built.values()))


def test_capacity_that_is_no_power_of_two(docs_of, path, tokenizer):
    texts = [(i, "one two three " * (i % 17)) for i in range(60)]
    rows = pack(docs_of(texts), path, capacity=100).collect()
    assert check_packed(rows, texts, tokenizer, 100) == 0


def test_empty_table_repeated_rows_and_null_ids(docs_of, path):
    assert pack(docs_of([]), path).count() == 0
    rows = pack(docs_of([(1, "a b"), (1, "a b"), (None, "c")]), path).collect()
    assert Counter(r.doc_id for r in rows)[1] >= 2 and any(r.doc_id is None for r in rows)
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=5), st.integers(0, 20))
def test_window_is_filled_as_well_as_can_be(counts, room):
    from itertools import product

    sums = {sum(k * n for k, n in zip(counts, ns)) for ns in product(*(range(c + 1) for c in counts.values()))}
    used = fill_window(counts, room)
    assert all(n <= counts[k] for k, n in used.items())
    assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= room)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 15), st.integers(1, 40), max_size=8))
def test_plan_uses_every_length_once(counts):
    windows, over = plan_windows(counts, 16)
    total = Counter(over)
    for used, times in windows:
        assert sum(k * n for k, n in used.items()) == 16
        total.update({k: n * times for k, n in used.items()})
    assert dict(total) == counts


def test_binary_parts():
    assert [binary_parts(n) for n in (0, 1, 6, 1023)] == [[], [1], [4, 2], [512, 256, 128, 64, 32, 16, 8, 4, 2, 1]]
