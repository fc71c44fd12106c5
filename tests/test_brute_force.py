"""Scores of random surveys against a plain calculation."""

import math
import random
from collections import Counter

import pytest

from stratalens import Dimension
from stratalens.operators import scores
from stratalens.operators.strata import cell_counts, key_columns, line_up, population_shares

DIMS = [
    Dimension("A × B", ("a", "b")),
    Dimension("B × C", ("b", "c")),
    Dimension("A", ("a",)),
    Dimension("C", ("c",)),
]


def plain_scores(survey, people, columns, order):
    take = lambda row: tuple(row[order.index(c)] for c in columns)
    counted = Counter(take(r) for r in survey if None not in take(r))
    known = Counter(take(r) for r in people if None not in take(r))
    q = {k: v / len(people) for k, v in known.items()}
    total = len(survey)
    s = {k: v / total for k, v in counted.items()}
    strata = set(q) | set(s)
    match = 1 - 0.5 * sum(abs(s.get(k, 0) - q.get(k, 0)) for k in strata)
    relevant = [k for k, v in q.items() if v > 1 / total]
    coverage = sum(k in s for k in relevant) / len(relevant) if relevant else 1.0
    roots = sum(math.sqrt(v) for v in q.values())
    strategic = 1 - 0.5 * sum(abs(s.get(k, 0) - math.sqrt(q.get(k, 0)) / roots) for k in strata)
    weight = {k: q.get(k, 0) * (math.sqrt(s[k] * (1 - s[k]) / counted[k]) if k in s else 1.0) for k in strata}
    heavy = sum(weight.values())
    weighted = 1 - sum(weight[k] * abs(s.get(k, 0) - q.get(k, 0)) for k in strata) / heavy if heavy > 0 else 0.0
    return match, coverage, strategic, weighted


@pytest.mark.parametrize("seed", range(3))
def test_scorecard(spark, seed):
    rng = random.Random(seed)

    def rows(count, hot):
        def one():
            a = "hot" if rng.random() < hot else rng.choice(["a1", "a2", "a3", None])
            return (f"w{rng.randint(1, 3)}", a, rng.choice(["b1", "b2", None, "b3"]), rng.choice(["c1", "c2", "c3"]) if rng.random() < 0.9 else None)

        return [one() for _ in range(count)]

    survey, people = rows(400, 0.5), rows(900, 0.2) + [("w", "only here", "b9", "c9")] * 3
    order = key_columns(DIMS)
    schema = "wave string, a string, b string, c string"
    bench = population_shares(spark.createDataFrame(people, schema), DIMS)
    cells = cell_counts(spark.createDataFrame(survey, schema), order, ["wave"])
    got = {(r["wave"], r["dimension"]): r for r in scores.scorecard(cells, bench, DIMS, ["wave"]).collect()}
    assert len(got) == 3 * len(DIMS)
    for wave in ("w1", "w2", "w3"):
        answers = [r[1:] for r in survey if r[0] == wave]
        for dim in DIMS:
            expected = plain_scores(answers, [r[1:] for r in people], dim.columns, ["a", "b", "c"])
            row = got[wave, dim.name]
            found = (row["match_score"], row["coverage_score"], row["strategic_score"], row["weighted_score"])
            assert found == pytest.approx(expected), (wave, dim.name)
    assert line_up(cells, bench, DIMS, ["wave"]).where("n < 0").count() == 0
