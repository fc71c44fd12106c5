from collections import defaultdict

from corpus_checks import by_id
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from stratalens.llm.line_dedup import dedup_lines

BLANKS = " \t\n\x0b\x0c\r"


def ascii_lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def brute(rows, min_docs, min_chars):
    key = lambda line: ascii_lower(line.strip(BLANKS))
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(doc)
    out = {}
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [
            x for x in lines if not (len(key(x)) >= min_chars and len(holders[key(x)]) >= min_docs and doc != max(holders[key(x)]))
        ]
        out[doc] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def test_edge_cases(docs_of):
    line = "This line is long enough."
    rows = [
        (1, f"a\n  {line}\t\nb\n{line}"),
        (2, line.upper()),
        (3, f"{line}\n\n"),
        (4, None),
        (5, ""),
        (6, "short\nshort"),
        (7, "short"),
        (8, "short"),
    ]
    assert by_id(dedup_lines(docs_of(rows), salts=3), "kept_text", "n_lines", "n_dropped") == brute(rows, 3, 20)


def test_repeated_rows_count_once_and_null_ids_keep_all(docs_of):
    line = "x" * 20
    found = dedup_lines(docs_of([(1, line), (1, line), (2, line), (None, line)]))
    assert {(r.doc_id, r.kept_text, r.n_dropped) for r in found.collect()} == {(1, line, 0), (2, line, 0), (None, line, 0)}
    assert found.count() == 4
    other = dedup_lines(docs_of([(1, f"{line}\nq"), (1, f"r\n{line}\ns"), (2, line), (3, line)]))
    assert {(r.doc_id, r.kept_text) for r in other.collect()} == {(1, "q"), (1, "r\ns"), (2, ""), (3, line)}


def test_empty_table_and_carried_rows(docs_of):
    assert dedup_lines(docs_of([])).count() == 0
    row = dedup_lines(docs_of([(1, "t")]), carry=True).first()
    assert row["row"]["row"] == "w" and row["row"]["doc_id"] == 1 and row["kept_text"] == "t"


def test_long_text_with_many_dropped_lines(docs_of):
    """Work must not grow with lines times dropped lines."""
    text = "\n".join(f"shared line number {i:08d}" if i % 2 else f"{i}" for i in range(60_000))
    found = by_id(dedup_lines(docs_of([(i, text) for i in range(3)])), "n_lines", "n_dropped")
    assert found == {0: (60_000, 30_000), 1: (60_000, 30_000), 2: (60_000, 0)}


def test_no_python_in_the_plan(docs_of):
    plan = dedup_lines(docs_of([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


lines = st.lists(st.sampled_from(["aa", " AA", "bb\r", "bb", "c", "", "É", "é"]), max_size=5).map("\n".join)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), lines), min_size=1, max_size=8))
def test_against_brute_force(docs_of, texts):
    rows = list(enumerate(texts))
    found = by_id(dedup_lines(docs_of(rows), min_docs=2, min_chars=1, salts=2), "kept_text", "n_lines", "n_dropped")
    assert found == brute(rows, 2, 1)
