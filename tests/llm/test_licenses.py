from corpus_checks import by_id

from stratalens.llm.licenses import TEMPLATES, WHOLE_TEXTS, Templates, bigrams, dice, scan_licenses

MIT = next(text for name, text in TEMPLATES if name == "MIT" and len(text) > 500)


def names(text):
    return [(m.license, m.first_line, m.last_line) for m in Templates(TEMPLATES, 0.8).scan(text)]


def test_every_template_finds_itself():
    known = Templates(TEMPLATES, 0.8)
    for name, text in TEMPLATES:
        assert known.best(bigrams(text)) == (name, 1.0)
        found = known.scan(f"Some prose before it.\n{text}\nAnd some after it.")
        assert [m.license for m in found] == [name]


def test_pruning_loses_nothing():
    """The best template with size bounds is the best of all comparisons."""
    known = Templates(TEMPLATES, 0.8)
    words = MIT.split()
    units = [bigrams(" ".join(words[:k])) for k in range(0, len(words), 7)]
    units += [bigrams(t.replace("License", "Licence")) for _, t in TEMPLATES] + [bigrams(t + " extra words at end") for _, t in TEMPLATES]
    for unit in units:
        scores = [dice(unit, s) for s in known.sets]
        top = max(scores)
        want = (known.names[scores.index(top)], top) if top >= 0.8 else None
        got = known.best(unit)
        assert (got and (got[0], round(got[1], 9))) == (want and (want[0], round(want[1], 9)))


def test_lines_runs_and_holders():
    assert names("prose\nLicensed under CC BY-NC 4.0.\nmore") == [("CC-BY-NC-4.0", 1, 1)]
    assert names("LICENSED UNDER CC-BY-NC 4.0!") == [("CC-BY-NC-4.0", 0, 0)]
    text = "prose here\nCopyright (c) 2020 Somebody\n" + MIT + "\nmore prose of another kind"
    assert names(text) == [("MIT", 2, 4)]
    assert names("no notice\nof any kind") == []


def test_notices_inside_lines():
    assert names("Copyright 2024 Acme. All rights reserved.") == [("proprietary", 0, 0)]
    assert names("Copyright (c) 2020 X, licensed under the MIT License.") == [("MIT", 0, 0)]
    assert names("Some long prose about a thing. Released under the MIT License. And more prose, on and on.") == [("MIT", 0, 0)]
    one_line = " ".join(MIT.split())
    assert names("Copyright (c) 2020 Somebody " + one_line) == [("MIT", 0, 0)]
    assert names(f"First line.\nWords before it. {one_line} Then other words follow.\nLast line.") == [("MIT", 1, 1)]
    two = "Text is licensed under CC BY 4.0. The code, though, is licensed under the Apache License, Version 2.0. Enjoy."
    assert [m for m, *_ in names(two)] == ["CC-BY-4.0", "Apache-2.0"]
    assert names("All rights reserved. " * 3) == [("proprietary", 0, 0)] * 3


def test_windows_are_the_best_of_all():
    """The best window found is the best of all pairs of first and last word, repeated bigrams included."""
    import random

    draw = random.Random(5)
    known = Templates([("t", "a b c a d b c"), ("u", "b a b d")], 0.6)
    for _ in range(200):
        text = [draw.choice("abcd") for _ in range(draw.randrange(2, 14))]
        pairs = list(zip(text, text[1:]))
        for i, mine in enumerate(known.sets):
            every = [dice(frozenset(pairs[p:q]), mine) for p in range(len(pairs)) for q in range(p + 1, len(pairs) + 1)]
            got = known.windows(i, pairs)
            want = max(every)
            assert (round(max(w[0] for w in got), 9) if got else None) == (round(want, 9) if want >= 0.6 else None)
            spans = sorted((w[1], w[2]) for w in got)
            assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_whole_texts_inside_prose():
    """Each licence text, wrapped and on one line, is that licence and no other."""
    known, texts = Templates(TEMPLATES, 0.8), dict(TEMPLATES[-len(WHOLE_TEXTS) :])
    assert list(texts) == list(WHOLE_TEXTS)
    for name, text in texts.items():
        for body in (text, " ".join(text.split())):
            found = known.scan(f"Prose stands before it. Copyright (c) 2020 Somebody\n{body} More prose of another kind.")
            assert [(m.license, round(m.dice, 2)) for m in found] == [(name, 1.0)]
    bsd = texts["BSD-3-Clause"].replace("the copyright holder nor", "Acme Inc. nor")
    assert [m.license for m in known.scan(bsd)] == ["BSD-3-Clause"]


def test_rows(docs_of):
    found = scan_licenses(docs_of([(1, None), (2, ""), (3, "word"), (4, "All rights reserved."), (4, "x"), (None, "Released under the MIT License")]))
    got = sorted(((r.doc_id, [m.license for m in r.matches]) for r in found.collect()), key=str)
    assert got == sorted([(1, []), (2, []), (3, []), (4, ["proprietary"]), (4, []), (None, ["MIT"])], key=str)
    assert scan_licenses(docs_of([])).count() == 0


def test_query_finds_every_planted_line(spark, small):
    from stratalens.llm.queries import QUERIES

    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT", "All rights reserved.": "proprietary"}
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    found = by_id(QUERIES["op1_license_scan"](spark, "/root/testdata/sf0.01"), "licenses", "n_matches")
    assert found.keys() == texts.keys()
    for line, name in lines.items():
        with_line = {d for d, t in texts.items() if line in t.split("\n")}
        assert with_line and {d for d, v in found.items() if name in v[0].split(",")} == with_line
