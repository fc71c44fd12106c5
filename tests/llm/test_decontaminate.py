import random
import re

from corpus_checks import by_id

from stratalens.llm.decontaminate import SuffixAutomaton, find_contamination, plain_words, without_spans

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def brute(text, items, window):
    found = WORD.findall(ascii_lower(text or ""))
    hit, names = set(), set()
    for name, item in items:
        words = WORD.findall(ascii_lower(item or ""))
        size = min(window, len(words))
        for k in range(len(words) - size + 1 if words else 0):
            for at in range(len(found) - size + 1):
                if found[at : at + size] == words[k : k + size]:
                    hit.update(range(at, at + size))
                    names.add(name)
    return len(found), len(hit), sorted(names)


def test_words():
    assert plain_words("It's 5É×A_b|c\n") == [w.encode() for w in ["it", "s", "5É×a", "b", "c"]]
    assert plain_words(None) == []


def test_random_texts_against_brute_force():
    draw = random.Random(4)
    for _ in range(300):
        letters = "abc"[: draw.randint(1, 3)]
        text = lambda n: " ".join(draw.choice(letters) for _ in range(draw.randint(0, n)))
        items = [(str(i), text(9)) for i in range(draw.randint(0, 5))]
        window = draw.randint(1, 5)
        doc = text(25)
        automaton = SuffixAutomaton(items, window)
        words = plain_words(doc)
        spans, names = automaton.follow(words)
        assert (len(words), sum(b - a for a, b in spans), sorted(names)) == brute(doc, items, window)
        assert all(x[1] < y[0] or x[1] == y[0] for x, y in zip(spans, spans[1:]))


ITEM = "one two three four five six seven eight nine ten eleven"


def rows(spark, docs_of, docs, items, **options):
    bench = spark.createDataFrame(items, "item_id string, text string").selectExpr("*", "1 AS spans", "2 AS item")
    return find_contamination(docs_of(docs), bench, **options)


def test_edge_cases_and_cleaning(spark, docs_of):
    docs = [(1, f"Before, {ITEM.upper()}! after it all."), (2, None), (3, ""), (4, "nothing here"), (5, ITEM), (5, "other")]
    items = [("b", ITEM), ("a", "x " + ITEM), ("c", None), ("d", "..."), (None, "nothing here"), ("b", ITEM)]
    found = rows(spark, docs_of, docs, items).collect()
    got = {(r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.clean_text, r.dropped) for r in found}
    assert got == {
        (1, 15, 11, ("a", "b"), "Before, ! after it all.", True),
        (2, 0, 0, (), None, False),
        (3, 0, 0, (), "", False),
        (4, 2, 2, ("",), "", True),
        (5, 11, 11, ("a", "b"), "", True),
        (5, 1, 0, (), "other", False),
    }


def test_limits(spark, docs_of):
    docs = [(1, "p q r " * 20 + ITEM)]
    strict = rows(spark, docs_of, docs, [("b", ITEM)], max_words=10, max_coverage=0.5).first()
    assert strict.clean_text == "p q r " * 20 and not strict.dropped
    loose = rows(spark, docs_of, docs, [("b", ITEM)], max_words=11, max_coverage=0.1).first()
    assert loose.clean_text == docs[0][1] and loose.dropped


def test_several_automata_agree_with_one(spark, docs_of, small):
    docs, bench = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    columns = ("n_words", "n_hit", "items", "clean_text", "dropped")
    one = by_id(find_contamination(docs, bench), *columns)
    several = by_id(find_contamination(docs, bench, automaton_chars=2000), *columns)
    assert one == several and sum(v[1] > 0 for v in one.values()) > 0


def test_query_against_brute_force(spark, small):
    import hashlib

    from stratalens.llm.queries import QUERIES

    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    found = by_id(QUERIES["op8_decontamination"](spark, small), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    chosen = [k for k in texts if len(texts[k]) < 1500]
    for doc in chosen:
        n, hit, names = brute(texts[doc], items, 10)
        assert found[doc] == (n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0)
    assert len(found) == len(texts)


def test_empty_tables_and_carried_rows(spark, docs_of):
    assert rows(spark, docs_of, [], [("b", ITEM)]).count() == 0
    clean = rows(spark, docs_of, [(1, ITEM)], [], carry=True).first()
    assert clean.clean_text == ITEM and clean["row"]["row"] == "w"


def test_without_spans():
    assert without_spans("a, b; c d", [(1, 3)]) == "a,  d"
