"""Hand-derived scores on tiny surveys."""

import math

import pytest
from pyspark.sql import functions as F

from stratalens import Dimension
from stratalens.operators import scores
from stratalens.operators.strata import as_long, cell_counts, line_up, population_shares, roll_up, roll_up_shares, stratum_counts

PLACE = ["country", "gender"]
DIM = Dimension("Country × Gender", ("country", "gender"))


def score(survey, benchmark, columns, **options):
    dim = Dimension(" × ".join(columns), tuple(columns))
    aligned = line_up(cell_counts(survey, columns), as_long(benchmark, dim), [dim], **options)
    return scores.match_and_coverage(aligned).first()


def test_partial_match(survey_of, benchmark_of):
    survey = survey_of(PLACE, (2, "USA", "Male"), (1, "USA", "Female"), (1, "Canada", "Male"))
    bench = benchmark_of(PLACE, *[(c, g, 0.25) for c in ("USA", "Canada") for g in ("Male", "Female")])
    assert score(survey, bench, PLACE)["match_score"] == pytest.approx(0.75)


def test_perfect_match(survey_of, benchmark_of):
    survey = survey_of(["country"], (3, "A"), (1, "B"))
    bench = benchmark_of(["country"], ("A", 0.75), ("B", 0.25))
    row = score(survey, bench, ["country"])
    assert row["match_score"] == pytest.approx(1.0) and row["coverage_score"] == 1.0


def test_disjoint_with_repeated_benchmark_key(survey_of, benchmark_of):
    survey = survey_of(PLACE, (2, "USA", "Male"))
    bench = benchmark_of(PLACE, ("Canada", "Female", 0.5), ("Canada", "Female", 0.5))
    assert score(survey, bench, PLACE)["match_score"] == pytest.approx(0.0)


def test_repeated_benchmark_key_repeats_the_sample_share(survey_of, benchmark_of):
    survey = survey_of(["country"], (1, "A"), (1, "B"))
    bench = benchmark_of(["country"], ("A", 0.25), ("A", 0.25), ("B", 0.5))
    # A joins twice with share 0.5 each: gaps 0.25 + 0.25 + 0.
    assert score(survey, bench, ["country"])["match_score"] == pytest.approx(0.75)


def test_empty_survey_scores_zero(survey_of, benchmark_of):
    survey = survey_of(["country"])
    bench = benchmark_of(["country"], ("A", 0.5), ("B", 0.5))
    row = score(survey, bench, ["country"])
    assert (row["match_score"], row["coverage_score"], row["sample_size"]) == (0.0, 0.0, 0)
    dim = Dimension("country", ("country",))
    card = scores.scorecard(cell_counts(survey, ["country"]), as_long(bench, dim), [dim]).first()
    assert (card["strategic_score"], card["weighted_score"]) == (0.0, 0.0)


@pytest.mark.parametrize(
    "groups, bench, threshold, expected",
    [
        ([(50, "USA"), (50, "Canada")], [("USA", 0.4), ("Canada", 0.4), ("Mexico", 0.2)], None, 2 / 3),
        ([(10, "USA")], [("USA", 0.01), ("Canada", 0.005)], None, 1.0),
        ([(60, "A"), (40, "B")], [("A", 0.6), ("B", 0.3), ("C", 0.09), ("D", 0.01)], None, 2 / 3),
        ([(5, "Alpha"), (3, "Beta")], [("Alpha", 0.5), ("Beta", 0.3), ("Gamma", 0.2)], 0.1, 2 / 3),
        ([(5, "Alpha")], [("Alpha", 0.5), ("Beta", 0.3), ("Gamma", 0.2)], 0.4, 1.0),
    ],
)
def test_coverage(survey_of, benchmark_of, groups, bench, threshold, expected):
    row = score(survey_of(["country"], *groups), benchmark_of(["country"], *bench), ["country"], threshold=threshold)
    assert row["coverage_score"] == pytest.approx(expected)


def test_missing_keys_stay_in_the_denominator(survey_of, benchmark_of):
    survey = survey_of(["country"], (2, "A"), (1, "B"), (1, None))
    bench = benchmark_of(["country"], ("A", 0.5), ("B", 0.5))
    row = score(survey, bench, ["country"])
    # Shares are 2/4 and 1/4, a quarter is lost: 1 - 0.5 * (0 + 0.25).
    assert row["match_score"] == pytest.approx(0.875) and row["sample_size"] == 4


def test_nulls_leave_only_the_dimensions_they_belong_to(survey_of):
    survey = survey_of(PLACE, (2, "A", "m"), (1, "A", None), (1, None, "f"))
    dims = [DIM, Dimension("Country", ("country",)), Dimension("Gender", ("gender",))]
    rows = roll_up(cell_counts(survey, PLACE), dims).collect()
    got = {(r["dimension"], r["country"], r["gender"]): r["n"] for r in rows}
    assert got == {
        ("Country × Gender", "A", "m"): 2,
        ("Country", "A", None): 3,
        ("Gender", None, "m"): 2,
        ("Gender", None, "f"): 1,
    }


def test_groups_without_a_name_are_groups(spark, benchmark_of):
    survey = spark.createDataFrame([("w1", "A"), ("w1", "B"), (None, "A")], "wave string, country string")
    dim = Dimension("Country", ("country",))
    bench = as_long(benchmark_of(["country"], ("A", 0.5), ("B", 0.5)), dim)
    aligned = line_up(cell_counts(survey, ["country"], ["wave"]), bench, [dim], ["wave"])
    got = {r["wave"]: r["match_score"] for r in scores.match_and_coverage(aligned, ["wave"]).collect()}
    assert got == {"w1": pytest.approx(1.0), None: pytest.approx(0.5)}


SHARES = {"a": 0.40, "b": 0.20, "c": 0.10, "d": 0.05, "e": 0.01, "f": 0.001, "g": 0.239}


PLANS = {
    "proportional": (400, 200, 100, 50, 10, 1, 239),
    "strategic": (290, 190, 140, 100, 45, 15, 220),
    "equal": (143, 143, 143, 143, 143, 142, 143),
}


@pytest.mark.parametrize(
    "plan, match, strategic", [("proportional", 1.0, 0.861243), ("strategic", 0.861, 0.989178), ("equal", 0.590, 0.728757)]
)
def test_three_sampling_plans(spark, benchmark_of, plan, match, strategic):
    dim = Dimension("Stratum", ("key",))
    cells = spark.createDataFrame(list(zip(SHARES, PLANS[plan])), "key string, n long")
    card = scores.scorecard(cells, as_long(benchmark_of(["key"], *SHARES.items()), dim), [dim]).first()
    assert card["match_score"] == pytest.approx(match, abs=1e-3)
    assert card["strategic_score"] == pytest.approx(strategic, abs=1e-6)


def test_weighted_detail(spark, survey_of, benchmark_of):
    shares = {"USA": 0.30, "China": 0.40, "Denmark": 0.02, "Luxembourg": 0.01, "Malta": 0.01, "Other": 0.26}
    counts = {"USA": 50, "China": 100, "Denmark": 2, "Luxembourg": 1}
    known = {"USA": 0.2, "China": 0.1, "Malta": 0.05}
    dim = Dimension("Country", ("country",))
    survey = survey_of(["country"], *[(n, c) for c, n in counts.items()])
    variance = spark.createDataFrame([("Country", c, v) for c, v in known.items()], "dimension string, stratum string, variance double")
    aligned = line_up(cell_counts(survey, ["country"]), as_long(benchmark_of(["country"], *shares.items()), dim), [dim])
    weighted = scores.with_weights(aligned, [dim], variance)
    total = sum(counts.values())
    expected, error, weight_sum = {}, 0.0, 0.0
    for c, q in shares.items():
        n = counts.get(c, 0)
        s = n / total
        weight = q * (math.sqrt(s * (1 - s) / n) if n else 1.0) * (1 - known.get(c, 0.0))
        expected[c] = weight
        error += weight * abs(s - q)
        weight_sum += weight
    detail = {r["stratum"]: r for r in scores.weighted_detail(weighted, [dim]).collect()}
    for c, weight in expected.items():
        assert detail[c]["weight"] == pytest.approx(weight)
        assert detail[c]["normalized_weight"] == pytest.approx(weight / weight_sum)
    assert sum(r["normalized_weight"] for r in detail.values()) == pytest.approx(1.0)
    got = weighted.groupBy("dimension").agg(scores.weighted_of().alias("w")).first()["w"]
    assert got == pytest.approx(1 - error / weight_sum)


def test_no_weight_at_all_scores_zero(survey_of, benchmark_of):
    survey = survey_of(["country"], (4, "A"))
    dim = Dimension("Country", ("country",))
    aligned = line_up(cell_counts(survey, ["country"]), as_long(benchmark_of(["country"], ("A", 1.0)), dim), [dim])
    # The only stratum has share 1, hence no standard error and no weight.
    assert scores.with_weights(aligned, [dim]).agg(scores.weighted_of().alias("w")).first()["w"] == 0.0


def test_roll_up_single_key(benchmark_of):
    bench = benchmark_of(PLACE, ("USA", "Male", 0.1), ("CAN", "Male", 0.15), ("USA", "Female", 0.2), ("CAN", "Female", 0.25))
    rolled = roll_up_shares(bench, [Dimension("Gender", ("gender",))])
    got = {r["gender"]: r["population_share"] for r in rolled.collect()}
    assert got == {"Male": pytest.approx(0.25), "Female": pytest.approx(0.45)}


def test_roll_up_needs_its_columns(benchmark_of):
    with pytest.raises(ValueError, match="missing columns"):
        roll_up_shares(benchmark_of(["country"], ("A", 1.0)), [Dimension("Religion", ("religion",))])


def test_coarsening_never_lowers_the_match(spark, survey_of):
    survey = survey_of(PLACE, (5, "A", "m"), (1, "A", "f"), (2, "B", "m"), (7, "C", "f"))
    people = survey_of(PLACE, (3, "A", "m"), (3, "A", "f"), (3, "B", "f"), (4, "C", "m"), (4, "D", "f"))
    dims = [DIM, Dimension("Country", ("country",)), Dimension("Gender", ("gender",))]
    card = scores.match_and_coverage(line_up(cell_counts(survey, PLACE), population_shares(people, dims), dims)).collect()
    got = {r["dimension"]: r["match_score"] for r in card}
    assert got["Country"] >= got["Country × Gender"] and got["Gender"] >= got["Country × Gender"]
    assert all(0.0 <= v <= 1.0 for v in got.values())


def test_efficiency_and_bands(spark):
    rows = spark.createDataFrame([(0.8, 0.9), (0.5, 0.0), (0.9, 0.9), (0.95, 0.9)], "score double, top double")
    got = [r[0] for r in rows.select(scores.efficiency(F.col("score"), F.col("top"))).collect()]
    assert got == [pytest.approx(0.8889, abs=1e-4), 0.0, pytest.approx(1.0), 1.0]
    bands = [tuple(r) for r in rows.select(scores.rating(F.col("score")), scores.report_rating(F.col("score"))).collect()]
    assert bands == [("Excellent", "Good"), ("Moderate", "Poor"), ("Excellent", "Excellent"), ("Excellent", "Excellent")]


def test_overall_row_ignores_missing_scores(spark):
    card = spark.createDataFrame([("a", 0.5, None), ("b", 0.7, 0.2)], "dimension string, match_score double, coverage_score double")
    overall = scores.with_overall(card, ["match_score", "coverage_score"]).where("dimension = 'Overall (Average)'").first()
    assert overall["match_score"] == pytest.approx(0.6) and overall["coverage_score"] == pytest.approx(0.2)


def test_stratum_counts_need_all_keys(survey_of):
    counts = stratum_counts(survey_of(PLACE, (2, "A", "m"), (1, "A", None)), PLACE)
    assert [(r["country"], r["gender"], r["n"]) for r in counts.collect()] == [("A", "m", 2)]


def test_nearest_maxima_prefers_the_smaller_size_on_ties(spark):
    sizes = spark.createDataFrame([("s", 300), ("t", 9000)], "survey string, sample_size long")
    maxima = spark.createDataFrame([("d", 100, 0.5, 0.6), ("d", 500, 0.7, 0.8)], "dimension string, size int, max_match double, max_coverage double")
    got = {r["survey"]: r["size_used"] for r in scores.nearest_maxima(sizes, maxima).collect()}
    assert got == {"s": 100, "t": 500}


def test_everyday_entry_point(survey_of, benchmark_of):
    survey = survey_of(["country"], (1, "A"), (1, "B"))
    row = scores.match_score(survey, benchmark_of(["country"], ("A", 0.5), ("B", 0.5)), ["country"]).first()
    assert row["match_score"] == pytest.approx(1.0)
