import hashlib

from stratalens.llm.exact_dedup import exact_duplicates


def result(frame):
    return sorted(
        ((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in frame.collect()),
        key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[3]),
    )


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_groups_by_ascii_case_only(docs_of):
    rows = [(1, "Hello"), (2, "hELLO"), (3, "hello "), (4, None), (5, ""), (6, "ÉA"), (7, "éa"), (8, "Éa"), (9, "İI"), (10, "ẞ")]
    assert result(exact_duplicates(docs_of(rows), salts=3)) == [
        (1, 2, 2, False, sha("hello")),
        (2, 2, 2, True, sha("hello")),
        (3, 3, 1, True, sha("hello ")),
        (4, 5, 2, False, sha("")),
        (5, 5, 2, True, sha("")),
        (6, 8, 2, False, sha("Éa")),
        (7, 7, 1, True, sha("éa")),
        (8, 8, 2, True, sha("Éa")),
        (9, 9, 1, True, sha("İi")),
        (10, 10, 1, True, sha("ẞ")),
    ]


def test_repeated_rows_and_null_ids(docs_of):
    found = result(exact_duplicates(docs_of([(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b")])))
    assert [r[:4] for r in found] == [
        (1, 1, 3, False),
        (1, 1, 3, True),
        (None, 1, 3, False),
        (None, None, 2, False),
        (None, None, 2, True),
    ]


def test_large_group_of_a_long_text(docs_of):
    text = "word " * 20_000
    found = result(exact_duplicates(docs_of([(i, text) for i in range(300)] + [(1000, "x")]), salts=4))
    assert {r[1:3] for r in found} == {(299, 300), (1000, 1)}
    assert sum(r[3] for r in found) == 2


def test_empty_table_and_string_ids(docs_of):
    assert exact_duplicates(docs_of([])).count() == 0
    found = exact_duplicates(docs_of([("b", "t"), ("a", "t")], "string")).collect()
    assert {(r.doc_id, r.keep_id) for r in found} == {("a", "b"), ("b", "b")}


def test_different_texts_of_one_digest(docs_of, monkeypatch):
    """With a digest that cannot tell texts apart, the comparison of whole texts must."""
    from pyspark.sql import functions as F

    from stratalens.llm import exact_dedup

    monkeypatch.setattr(exact_dedup.F, "sha2", lambda column, bits: F.lit("00"))
    found = result(exact_duplicates(docs_of([(1, "a"), (2, "A"), (3, "b"), (4, "c"), (5, "C")])))
    assert [r[:4] for r in found] == [(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True), (4, 5, 2, False), (5, 5, 2, True)]


def test_no_python_in_the_plan(docs_of):
    plan = exact_duplicates(docs_of([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
