import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalens.llm import bpe
from stratalens.llm.bpe import MergeTable, decode_ids, encode_texts, word_bpe
from stratalens.llm.queries import QUERIES, table, tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def truth(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_random_texts_match_the_library(library):
    made = word_bpe(PATH)
    pieces = ["don't", "WORLD'S", "<|endoftext|>", "<|startoftext|>x", "<|ENDOFTEXT|>", "\x1c", "a\x1fb", "\x85", "᠎", "ΑΣ", "é",
              "İ", "日本語", "½", "١٢", "̈", "😀!?", "...", "x1y22", "\x00", "\x7f", "é", "_", "'", "'re'", "ǅ", " ", "​"]

    @settings(max_examples=400, deadline=None, database=None)
    @given(st.lists(st.one_of(st.sampled_from(pieces), st.text(st.characters(codec="utf-8"), max_size=8), st.text("abe sthi'", max_size=30)), max_size=12))
    def check(parts):
        text = " ".join(parts[::2]) + "".join(parts[1::2])
        ids, shown = truth(library, text)
        data = made.encode(text)
        assert np.frombuffer(data, "<u4").tolist() == ids
        assert made.decode(data) == shown

    check()


def test_array_and_heap_merge_alike():
    rng = random.Random(3)
    letters = "abcd"
    vocab = {c: i for i, c in enumerate(letters)}
    merges = []
    while len(merges) < 60:
        a, b = rng.choice(list(vocab)), rng.choice(list(vocab))
        if a + b not in vocab:
            vocab[a + b] = len(vocab)
            merges.append((a, b))
    merging = MergeTable(vocab, merges)

    def brute(symbols):
        names, words = {i: c for c, i in vocab.items()}, list(symbols)
        order = {m: k for k, m in enumerate(merges)}
        while True:
            pairs = [(order.get((names[a], names[b]), 999), i) for i, (a, b) in enumerate(zip(words, words[1:]))]
            if not pairs or min(pairs)[0] == 999:
                return words
            at = min(pairs)[1]
            words[at : at + 2] = [vocab[names[words[at]] + names[words[at + 1]]]]

    for length in [0, 1, 2, 3, 5, 9, 30, 90]:
        for _ in range(30):
            word = [rng.randrange(4) for _ in range(length)]
            assert merging._scan(word) == merging._heap(word) == brute(word)


def test_very_long_word_and_cache_limits(library, monkeypatch):
    rng = random.Random(1)
    word = "".join(rng.choice("etaoinshr") for _ in range(60_000))
    assert np.frombuffer(word_bpe(PATH).encode(word), "<u4").tolist() == truth(library, word)[0]
    monkeypatch.setattr(bpe, "CACHE_PIECES", 3)
    small = bpe.WordBpe(PATH)
    text = "one two three four five six one two"
    assert np.frombuffer(small.encode(text), "<u4").tolist() == truth(library, text)[0]
    assert len(small.chunks) <= 3


def test_odd_rows(spark, docs_of, library):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "same text"), (4, "same text"), (None, "no id"), (5, "x" * 300_000), (6, "a <|endoftext|> b")]
    got = decode_ids(encode_texts(docs_of(rows), PATH), PATH).collect()
    assert len(got) == len(rows)
    want = sorted(((i, *truth(library, t)) for i, t in rows), key=str)
    assert sorted(((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist(), r["decoded"]) for r in got), key=str) == want
    assert all(r["n_tokens"] == len(r["ids"]) // 4 for r in got)
    assert encode_texts(docs_of([]), PATH).count() == 0


def test_ids_that_are_unknown_or_null(spark):
    rows = spark.createDataFrame([(1, np.array([320, 60_000_000], "<u4").tobytes()), (2, None)], "doc_id int, ids binary")
    got = {r["doc_id"]: r["decoded"] for r in decode_ids(rows, PATH).collect()}
    assert got == {1: word_bpe(PATH).pieces[320], 2: None}


def test_query_matches_the_library_on_whole_texts(spark, small, library):
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in QUERIES["op11_bpe"](spark, small).collect()}
    want = {}
    for row in table(spark, small, "documents").select("doc_id", "text").collect():
        ids, shown = truth(library, row["text"])
        want[row["doc_id"]] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest())
    assert got == want


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe.WordBpe(tokenizer_path("byte_bpe_50k.json"))
