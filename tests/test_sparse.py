"""Groups scored from their sampled strata against every stratum lined up with every group."""

import random

import pytest
from plan_rows import metric_of
from pyspark.sql import functions as F

from stratalens.operators.scores import all_scores, scorecard, with_weights
from stratalens.operators.sparse import count_above, group_scores
from stratalens.operators.strata import Dimension, cell_counts, line_up

AB = Dimension("A × B", ("a", "b"))
A = Dimension("A", ("a",))
COLUMNS = ["sample_size", "strata", "sampled_strata", "match_score", "coverage_score", "strategic_score", "weighted_score"]


def plain(frame, by=("wave",)):
    return {tuple(r[c] for c in (*by, "dimension")): [r[c] for c in COLUMNS] for r in frame.collect()}


def same(got, want):
    assert set(got) == set(want) and want
    for key in want:
        assert got[key] == pytest.approx(want[key], abs=1e-9), key


@pytest.fixture
def tables(spark):
    """Waves of very different sizes, one of them nameless; missing keys, strata only the survey has, shares of every size."""
    rng = random.Random(11)
    letters = "abcdefgh"
    strata = [(x, y, rng.random() ** 6) for x in letters for y in "123456"]
    total = sum(q for *_, q in strata)
    bench = [("A × B", x, y, q / total) for x, y, q in strata]
    bench += [("A", x, None, sum(q for a, _, q in strata if a == x) / total) for x in letters]
    bench += [("A × B", "a", "1", 0.01), ("A × B", "b", "9", None), ("A", "zero", None, 0.0)]
    people = []
    for wave, size in [(1, 3), (2, 40), (3, 900), (None, 25), (5, 1)]:
        people += [(wave, rng.choice([*letters, "z", None]), rng.choice([*"123456", None])) for _ in range(size)]
    people += [(6, None, None)] * 4
    return (
        spark.createDataFrame(people, "wave int, a string, b string"),
        spark.createDataFrame(bench, "dimension string, a string, b string, population_share double"),
    )


def dense(cells, bench, variance=None, se=1.0, by=("wave",), threshold=None):
    aligned = line_up(cells, bench, [AB, A], list(by), targets=True, threshold=threshold)
    return all_scores(with_weights(aligned, [AB, A], variance, se), list(by))


def test_equal_to_all_strata_lined_up(tables):
    people, bench = tables
    cells = cell_counts(people, ["a", "b"], ["wave"])
    same(plain(scorecard(cells, bench, [AB, A], ["wave"])), plain(dense(cells, bench)))
    same(plain(group_scores(cells, bench, [AB, A], ["wave"], unsampled_se=0.5, threshold=0.02)), plain(dense(cells, bench, se=0.5, threshold=0.02)))


def test_variances_for_all_groups_and_by_group(spark, tables):
    people, bench = tables
    cells = cell_counts(people, ["a", "b"], ["wave"])
    common = spark.createDataFrame([("A", "a", 0.3), ("A × B", "b × 2", 0.25), ("A", "unheard of", 0.9)], "dimension string, stratum string, variance double")
    same(plain(scorecard(cells, bench, [AB, A], ["wave"], common)), plain(dense(cells, bench, common)))
    own = [(1, "A", "a", 0.3), (1, "A", "b", 0.2), (3, "A", "a", 0.1), (None, "A", "c", 0.25), (2, "A × B", "c × 3", 0.2), (77, "A", "a", 0.5)]
    own = spark.createDataFrame(own, "wave int, dimension string, stratum string, variance double")
    same(plain(scorecard(cells, bench, [AB, A], ["wave"], own)), plain(dense(cells, bench, own)))


def test_benchmark_of_its_own_for_each_group(tables):
    people, bench = tables
    cells = cell_counts(people, ["a", "b"], ["wave"])
    waves = people.select("wave").distinct()
    own = bench.crossJoin(waves).where("wave IS NULL OR wave <> 2").withColumn(
        "population_share", F.when(F.col("wave") == 3, F.col("population_share") ** 2).otherwise(F.col("population_share"))
    )
    same(plain(scorecard(cells, own, [AB, A], ["wave"])), plain(dense(cells, own)))


def test_all_of_a_benchmark_sampled_leaves_no_rounding(spark):
    bench = spark.createDataFrame([("A", c, None, 0.1) for c in "abcdefghij"], "dimension string, a string, b string, population_share double")
    people = spark.createDataFrame([(1, c, None) for c in "abcdefghij"] + [(2, "a", None)], "wave int, a string, b string")
    got = plain(scorecard(cell_counts(people, ["a"], ["wave"]), bench.drop("b"), [A], ["wave"]))
    assert got[1, "A"] == pytest.approx([10, 10, 10, 1.0, 1.0, 1.0, 1.0])
    assert got[2, "A"][3] == pytest.approx(0.1)


def test_no_rows(spark, tables):
    people, bench = tables
    cells = cell_counts(people.where("wave = 99"), ["a", "b"], ["wave"])
    assert scorecard(cells, bench, [AB, A], ["wave"]).count() == 0
    some = cell_counts(people, ["a", "b"], ["wave"])
    same(plain(scorecard(some, bench.where("false"), [AB, A], ["wave"])), plain(dense(some, bench.where("false"))))


def test_count_above(spark):
    rng = random.Random(2)
    values = [(g, rng.choice([1e-9, 0.5, 0.001, rng.random(), 0.5 + rng.random() * 1e-5])) for g in "ab" for _ in range(300)] + [("a", 0.0), ("c", 0.1)]
    bars = [(g, b) for g in "abd" for b in (0.5, 0.001, 1.0, 1e-12, 0.5000005)]
    got = count_above(spark.createDataFrame(values, "g string, v double"), spark.createDataFrame(bars * 2, "g string, bar double"), ["g"], "v", "bar")
    assert {(r["g"], r["bar"]): r["above"] for r in got.collect()} == {(g, b): sum(h == g and v > b for h, v in values) for g, b in bars}


def test_joins_give_sampled_strata_not_strata_times_groups(spark):
    """400 groups of two respondents against 500 strata: every join stays near the 800 sampled strata."""
    bench = spark.range(500).selectExpr("'A' AS dimension", "cast(id AS string) AS a", "1.0D / 500 AS population_share")
    people = spark.range(800).selectExpr("id % 400 AS wave", "cast((id * 7) % 500 AS string) AS a")
    card = scorecard(cell_counts(people, ["a"], ["wave"]), bench, [A], ["wave"])
    assert len(card.collect()) == 400
    joined = metric_of(card, "Join")
    assert joined and max(joined) <= 800
    lined = line_up(cell_counts(people, ["a"], ["wave"]), bench, [A], ["wave"])
    lined.collect()
    assert max(metric_of(lined, "Join")) > 100_000
