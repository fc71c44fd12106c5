"""Gaps, contributors, impact and the running totals behind them."""

import random

import pytest
from pyspark.sql import functions as F

from stratalens import Dimension
from stratalens.operators import ordering, scores, segments
from stratalens.operators.strata import as_long, cell_counts, line_up

DIM = Dimension("Country × Gender", ("country", "gender"))
KEYS = ["country", "gender"]


@pytest.fixture
def aligned(survey_of, benchmark_of):
    survey = survey_of(KEYS, (1, "USA", "M"), (1, "USA", "F"), (2, "India", "M"), (1, "Brazil", "F"))
    bench = benchmark_of(
        KEYS, ("USA", "M", 0.15), ("USA", "F", 0.15), ("India", "M", 0.25), ("India", "F", 0.25), ("Brazil", "M", 0.1), ("Brazil", "F", 0.1)
    )
    return line_up(cell_counts(survey, KEYS), as_long(bench, DIM), [DIM], keyed=True)


def test_deviations_sum_to_zero(aligned):
    gaps = segments.deviations(aligned).collect()
    assert sum(r["deviation"] for r in gaps) == pytest.approx(0.0)
    assert all(r["tvd_share"] == pytest.approx(abs(r["deviation"]) / 2) for r in gaps)


def test_keyed_and_row_denominators(survey_of, benchmark_of):
    survey = survey_of(["country"], (1, "A"), (1, "B"), (2, None))
    dim = Dimension("Country", ("country",))
    aligned = line_up(cell_counts(survey, ["country"]), as_long(benchmark_of(["country"], ("A", 0.5), ("B", 0.5)), dim), [dim], keyed=True)
    keyed = {r["country"]: r["sample_share"] for r in segments.deviations(aligned).collect()}
    rows = {r["country"]: r["sample_share"] for r in segments.deviations(aligned, "rows").collect()}
    assert keyed == {"A": 0.5, "B": 0.5} and rows == {"A": 0.25, "B": 0.25}
    with pytest.raises(ValueError):
        segments.deviations(aligned, "other")


def test_survey_only_stratum_has_no_relative_deviation(survey_of, benchmark_of):
    dim = Dimension("Country", ("country",))
    survey = survey_of(["country"], (1, "A"), (1, "Z"))
    aligned = line_up(cell_counts(survey, ["country"]), as_long(benchmark_of(["country"], ("A", 1.0)), dim), [dim], keyed=True)
    got = {r["country"]: r["relative_deviation"] for r in segments.deviations(aligned).collect()}
    assert got["Z"] is None and got["A"] == pytest.approx(-0.5)


def _gaps(spark):
    dim = Dimension("Country", ("country",))
    values = [("A", 0.1), ("B", -0.05), ("C", 0.03), ("D", -0.08)]
    frame = spark.createDataFrame(values, "country string, deviation double")
    frame = frame.withColumns(
        {
            "dimension": F.lit("Country"),
            "population_share": F.lit(0.25),
            "sample_share": F.lit(0.25) + F.col("deviation"),
            "abs_deviation": F.abs("deviation"),
            "relative_deviation": F.col("deviation") / 0.25,
            "tvd_share": F.abs("deviation") / 2,
        }
    )
    return frame, dim


def test_top_contributors(spark):
    gaps, dim = _gaps(spark)
    over = segments.top_contributors(gaps, [dim], 1, "over").first()
    under = segments.top_contributors(gaps, [dim], 1, "under").first()
    assert (over["segment"], under["segment"]) == ("A", "D")
    both = segments.top_contributors(gaps, [dim], 3).orderBy("rank").collect()
    assert [r["segment"] for r in both] == ["A", "D", "B"]
    assert [round(r["cumulative_tvd"], 6) for r in both] == [0.05, 0.09, 0.115]
    with pytest.raises(ValueError):
        segments.top_contributors(gaps, [dim], 1, "sideways")


def test_small_benchmark_strata_are_no_contributors(spark):
    gaps, dim = _gaps(spark)
    tiny = gaps.withColumn("population_share", F.when(F.col("country") == "A", 0.00009).otherwise(0.25))
    assert segments.top_contributors(tiny, [dim], 1).first()["segment"] == "D"


def test_impact_never_exceeds_one(aligned):
    top = segments.top_contributors(segments.deviations(aligned), [DIM], 10)
    card = scores.match_and_coverage(aligned)
    summary = segments.fix_summary(top, card).first()
    assert summary["potential_score"] == pytest.approx(1.0)
    assert summary["improvement"] == pytest.approx(1.0 - summary["current_score"])
    steps = [r["cumulative_score"] for r in segments.fix_impact(top, card).orderBy("rank").collect()]
    assert steps == sorted(steps) and max(steps) <= 1.0


def test_segments_to_target_is_the_first_row_reaching_it(spark):
    gaps, dim = _gaps(spark)
    cumulative = segments.cumulative_gaps(gaps, [dim])
    got = {r["target"]: r["segments_needed"] for r in segments.segments_to_target(cumulative, [0.05, 0.1, 0.5]).collect()}
    assert got == {0.05: 1, 0.1: 3, 0.5: None}


def test_categories(survey_of, benchmark_of):
    dim = Dimension("C", ("c",))
    survey = survey_of(["c"], (40, "a"), (30, "b"), (20, "d"), (10, "e"))
    bench = benchmark_of(["c"], ("a", 0.2), ("b", 0.25), ("d", 0.21), ("e", 0.29), ("f", 0.05))
    aligned = line_up(cell_counts(survey, ["c"]), as_long(bench, dim), [dim])
    got = {r["stratum"]: r["category"] for r in segments.category_table(aligned, [dim]).collect()}
    assert got == {
        "c:a": "Highly Over-represented", "c:b": "Over-represented", "c:d": "Under-represented",
        "c:e": "Highly Under-represented", "c:f": "Missing",
    }


def test_border_belongs_to_under_in_labels_but_not_in_counts(spark):
    gaps = spark.createDataFrame([(-0.001,), (0.001,), (0.0011,)], "deviation double")
    got = [r[0] for r in gaps.select(segments.representation(F.col("deviation"))).collect()]
    assert got == ["under", "balanced", "over"]
    stats = segments.segment_statistics(
        gaps.withColumns({"dimension": F.lit("d"), "sample_share": F.lit(0.1), "abs_deviation": F.abs("deviation")})
    ).first()
    assert (stats["under"], stats["balanced"], stats["over"]) == (0, 2, 1)


@pytest.mark.parametrize("hot", [0.0, 0.4, 1.0])
def test_running_totals_against_a_plain_loop(spark, hot):
    """Many ties and one hot group: ranks and sums must be those of a sorted loop."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        group = "hot" if rng.random() < hot else f"g{i % 3}"
        value = 0.25 if rng.random() < 0.5 else rng.choice([0.1, 0.5, rng.random()])
        rows.append((group, f"k{i:05d}", value))
    frame = spark.createDataFrame(rows, "grp string, key string, value double").repartition(6)
    got = ordering.running_totals(frame, [F.desc("value"), F.col("key")], "value", ["grp"])
    expected = {}
    for group in {r[0] for r in rows}:
        total = 0.0
        for rank, (_, key, value) in enumerate(sorted((r for r in rows if r[0] == group), key=lambda r: (-r[2], r[1])), 1):
            total += value
            expected[key] = (rank, total)
    seen = {r["key"]: (r["rank"], r["running"]) for r in got.collect()}
    assert seen.keys() == expected.keys()
    for key, (rank, total) in expected.items():
        assert seen[key][0] == rank and seen[key][1] == pytest.approx(total)


def test_running_totals_without_groups(spark):
    frame = spark.createDataFrame([(i, float(i)) for i in range(500)], "key long, value double").repartition(5)
    got = {r["key"]: (r["rank"], r["running"]) for r in ordering.running_totals(frame, [F.col("key")], "value").collect()}
    assert got[499] == (500, pytest.approx(sum(range(500)))) and got[0] == (1, 0.0)


def test_running_totals_of_nothing(spark):
    frame = spark.createDataFrame([], "grp string, key long, value double")
    assert ordering.running_totals(frame, [F.col("key")], "value", ["grp"]).collect() == []


def test_first_rows_with_and_without_groups(spark):
    frame = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), ("b", 5)], "g string, v int")
    assert [(r["v"], r["rank"]) for r in ordering.first_rows(frame, [F.col("v")], 3).orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 3)]
    grouped = ordering.first_rows(frame, [F.desc("v")], 1, ["g"]).collect()
    assert sorted((r["g"], r["v"]) for r in grouped) == [("a", 3), ("b", 5)]
