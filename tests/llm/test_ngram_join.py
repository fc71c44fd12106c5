import random

import numpy as np
import pyarrow as pa
import pytest
from corpus_checks import by_id

from stratalens.llm import ngram_join
from stratalens.llm.components import components, with_least
from stratalens.llm.ngram_join import Bands, near_duplicates, shingle_set, spanning
from stratalens.session import small_batches


def brute(rows, size, percent):
    sets = []
    for _, text in rows:
        words = [w.decode() for w in (text or "").encode().lower().split()]
        runs = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)}
        sets.append(runs if words else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return {doc: (len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(rows)}


def copies(draw, count, words, edits):
    base = [f"w{draw.randint(0, 400)}" for _ in range(words)]
    for _ in range(count):
        text = list(base)
        for _ in range(draw.randint(0, edits)):
            place = draw.randrange(len(text))
            kind = draw.randrange(3)
            if kind == 0:
                text[place] = f"v{draw.randint(0, 10**6)}"
            elif kind == 1 and len(text) > 1:
                del text[place]
            else:
                text.insert(place, "new")
        yield " ".join(text)


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(1)
    texts = [None, "", "  \n", "One", "one", "ONE two", "one  two", "a b c", "É b c", "é b c"]
    for words, edits in ((4, 1), (12, 1), (40, 2), (40, 6), (150, 6), (400, 12)):
        for _ in range(3):
            texts += copies(draw, 8, words, edits)
    texts += copies(draw, 60, 120, 3)
    draw.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("size, percent, spanning", [(3, 90, True), (5, 80, True), (5, 80, False)])
def test_components_against_brute_force(docs_of, corpus, size, percent, spanning):
    found = near_duplicates(docs_of(corpus), size=size, percent=percent, block=7, spanning=spanning)
    assert by_id(found, "n_shingles", "component_id") == brute(corpus, size, percent)


def test_the_shuffled_way_agrees(docs_of, corpus, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    found = near_duplicates(docs_of(corpus), size=3, percent=90)
    assert by_id(found, "n_shingles", "component_id") == brute(corpus, 3, 90)


def test_repeated_rows_null_ids_and_empty_table(docs_of):
    text = "a b c d e f g h"
    rows = near_duplicates(docs_of([(5, text), (5, text), (3, text.upper()), (None, text), (None, "other words entirely"), (9, None)]))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows.collect()), key=str)
    assert got == sorted([(5, 4, 3), (5, 4, 3), (3, 4, 3), (None, 4, 3), (None, 1, None), (9, 0, 9)], key=str)
    two = near_duplicates(docs_of([(1, text), (1, "x y z u v w"), (2, text)]))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in two.collect()) == [(1, 2, 1), (1, 4, 1), (2, 4, 1)]
    assert near_duplicates(docs_of([])).count() == 0


def test_every_close_pair_shares_a_key():
    """Also where parts are empty on both sides."""
    draw = np.random.default_rng(2)
    for percent in (80, 90):
        bands = Bands(percent)
        for _ in range(1500):
            size = int(draw.integers(2, 60))
            a = np.unique(draw.integers(0, 2**63, size).astype(np.uint64) * np.uint64(2))
            if draw.random() < 0.3:  # crowded into one range, so that most parts are empty
                a = np.unique(a >> np.uint64(int(draw.integers(1, 8))))
            drop = int(draw.integers(0, max(1, len(a) // 4)))
            b = np.unique(np.concatenate([a[drop:], draw.integers(0, 2**63, int(draw.integers(0, 4))).astype(np.uint64)]))
            shared = len(np.intersect1d(a, b))
            if not len(b) or 100 * shared < percent * (len(a) + len(b) - shared) or np.array_equal(a, b):
                continue
            keys = [set(bands.keys(s, ngram_join._mix(s)).tolist()) for s in (a, b)]
            assert keys[0] & keys[1]


def test_signatures_keep_links_and_rule_out_most_other_pairs():
    """With one bit a hash, at any length and folded, too: no linked pair goes, and one of similarity 0.65 for 0.8 rarely stays."""
    draw = np.random.default_rng(12)
    stayed = 0
    for total in (40, 200, 1100, 5000, 30_000):
        for _ in range(20):
            for share in (65, 80):
                every = draw.integers(0, 2**63, total).astype(np.uint64)
                both = -(-total * share // 100)
                own = both + draw.integers(0, total - both + 1)
                sets = every[:own], np.concatenate((every[:both], every[own:]))
                bits = [ngram_join.bitmap(s) for s in sets]
                shorter = min(map(len, bits))
                a, b = (ngram_join.folded(x, shorter) for x in bits)
                near = ngram_join.near_enough(np.array([total + both]), np.array([np.bitwise_count(a ^ b).sum(dtype=np.int64)]), 80)
                if share == 80:
                    assert near[0]
                elif total < 10_000:
                    stayed += int(near[0])
    assert stayed <= 4  # of 80


def test_shingles():
    assert len(shingle_set("A b\tc a B c", 3)) == 3
    assert len(shingle_set("a b", 3)) == 1 and shingle_set("a b", 3)[0] != shingle_set("a b a", 3)[0]
    assert np.array_equal(shingle_set("A b", 3), shingle_set("a  B\n", 3))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    found = components(spark.createDataFrame(links, "a bigint, b bigint"))
    got = {r.node: r.label for r in found.collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200}
    assert got == want
    assert found.count() == len(want)


def test_least_of_large_groups(spark):
    rows = spark.createDataFrame([(i, "g" if i % 3 else None) for i in range(1, 500)], "v int, g string")
    found = with_least(rows, "g", "v", "least", salts=5).collect()
    assert len(found) == 499 and {(r.g, r.least) for r in found} == {("g", 1), (None, None)}


def test_spanning_pairs_join_all_that_any_pairs_join():
    draw = np.random.default_rng(6)
    for _ in range(30):
        left, right = draw.integers(0, 12, 40), draw.integers(0, 12, 40)
        order = draw.permutation(40)
        kept = spanning(left, right, order)
        assert len(kept) < 12
        parts = lambda places: _parts([(left[k], right[k]) for k in places])
        assert parts(kept) == parts(range(40))


def _parts(pairs):
    group = {x: x for p in pairs for x in p}
    for _ in group:
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    return {x: g for x, g in group.items() if any(x in p for p in pairs)}


def test_tiles_of_a_group_name_few_pairs(docs_of, spark, monkeypatch):
    """Near copies of which few link: pairs named by the tiles grow with the members, not with their square."""
    counts = []
    original = ngram_join._tile_pairs

    def counted(rows, percent, forest):
        pairs = original(rows, percent, forest)
        counts.append(pairs.select("a", "b").distinct().count())
        return pairs

    monkeypatch.setattr(ngram_join, "_tile_pairs", counted)
    sizes = (100, 200, 400)
    for members in sizes:
        rows = list(enumerate(copies(random.Random(9), members, 150, 6)))
        found = near_duplicates(docs_of(rows), size=3, percent=90, bits_per_hash=8)
        assert by_id(found, "n_shingles", "component_id") == brute(rows, 3, 90)
    named = [a + b for a, b in zip(counts[::2], counts[1::2])]
    assert all(pairs < members for pairs, members in zip(named, sizes))


def test_nodes_that_share_a_tag(docs_of, corpus, monkeypatch):
    """With tags of four values keys can hardly tell nodes apart, and no link is lost."""
    monkeypatch.setattr(ngram_join, "TAG_BITS", 2)
    some = corpus[::2]
    found = near_duplicates(docs_of(some), size=5, percent=80, block=7, spanning=False)
    assert by_id(found, "n_shingles", "component_id") == brute(some, 5, 80)


def test_keys_are_not_written_and_those_of_two_sets_not_tiled(docs_of, monkeypatch):
    """Two texts that share keys but don't link: no table holds their keys, and tiles have no row of them."""
    base = [f"w{i}" for i in range(120)]
    rows, tiled, written = list(enumerate([" ".join(base), " ".join([*base[:80], *(f"n{i}" for i in range(40))])])), [], []
    tiles, materialize = ngram_join._tiles, ngram_join.materialize

    def counted(*args):
        spread = tiles(*args)
        tiled.append(spread.count())
        return spread

    def noted(frame):
        written.append(frame.dtypes)
        return materialize(frame)

    monkeypatch.setattr(ngram_join, "_tiles", counted)
    monkeypatch.setattr(ngram_join, "materialize", noted)
    found = near_duplicates(docs_of(rows), size=5, percent=80, spanning=False)
    assert by_id(found, "n_shingles", "component_id") == brute(rows, 5, 80)
    assert tiled == [0]
    assert not any(kind.startswith("array") for columns in written for _, kind in columns)


def test_rows_reach_the_workers_in_small_batches(docs_of, spark, monkeypatch):
    """All that is written runs with batches of 4 MB, whatever their number of rows; the session's own limit holds afterwards."""
    limit, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    materialize, before = ngram_join.materialize, spark.conf.get(limit)

    def noted(frame):
        seen.append(spark.conf.get(limit))
        return materialize(frame)

    monkeypatch.setattr(ngram_join, "materialize", noted)
    rows = list(enumerate(["a b c d", "a b c d", "e f g"]))
    found = near_duplicates(docs_of(rows), size=3, percent=90)
    assert by_id(found, "n_shingles", "component_id") == brute(rows, 3, 90)
    assert seen and set(seen) == {"4m"} and spark.conf.get(limit) == before

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    with small_batches(spark, "200000b"):
        long = spark.range(0, 2000, 1, 1).selectExpr("repeat('x', 2000) AS text").mapInArrow(sizes, "n bigint").collect()
    assert sum(r.n for r in long) == 2000 and max(r.n for r in long) <= 110
