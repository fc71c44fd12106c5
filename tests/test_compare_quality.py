import pytest
from pyspark.sql import functions as F

from stratalens import Dimension
from stratalens.operators import compare, quality

WAVES = [("a", 1, 0.5), ("a", 2, 0.6), ("a", 3, 0.55), ("b", 1, 0.0), ("b", 2, 0.3)]


@pytest.fixture
def wave_scores(spark):
    return spark.createDataFrame(WAVES, "dimension string, wave int, match_score double")


def test_wave_changes(wave_scores):
    got = {(r["dimension"], r["wave"]): (r["change"], r["change_pct"]) for r in compare.wave_changes(wave_scores).collect()}
    assert got["a", 1] == (None, None)
    assert got["a", 2] == (pytest.approx(0.1), pytest.approx(20.0))
    assert got["b", 2] == (pytest.approx(0.3), None)  # no percentage of zero


def test_overall_trend(wave_scores):
    got = {r["dimension"]: (r["trend"], r["direction"]) for r in compare.overall_trend(wave_scores).collect()}
    assert got == {"a": (pytest.approx(0.05), "Positive"), "b": (pytest.approx(0.3), "Positive")}


def test_leave_one_out_and_extremes(spark):
    card = spark.createDataFrame(
        [("x", "d1", 0.9), ("y", "d1", 0.5), ("z", "d1", 0.7), ("x", "d2", 0.2), ("y", "d2", 0.6), ("z", "d2", 0.4)],
        "survey string, dimension string, match_score double",
    )
    strengths = compare.leave_one_out(card)
    got = {(r["survey"], r["dimension"]): r["strength"] for r in strengths.collect()}
    assert got["x", "d1"] == pytest.approx(0.3) and got["x", "d2"] == pytest.approx(-0.3)
    ends = {r["survey"]: (r["strongest"], r["weakest"]) for r in compare.strongest_and_weakest(strengths).collect()}
    assert ends["x"] == ("d1", "d2") and ends["y"] == ("d2", "d1")


def test_single_survey_has_no_others(spark):
    card = spark.createDataFrame([("x", "d", 0.9)], "survey string, dimension string, match_score double")
    assert compare.leave_one_out(card).first()["strength"] is None


def test_alignment_and_report(spark):
    survey = spark.createDataFrame([("a", "u"), ("b", "u"), ("c", None)], "country string, place string")
    bench = spark.createDataFrame([("a", "u"), ("d", "v")], "country string, place string")
    got = {r["column"]: r for r in compare.alignment(survey, bench, ["country", "place", "age"]).collect()}
    assert (got["country"]["matched"], got["country"]["unmatched"], got["country"]["coverage"]) == (1, 2, pytest.approx(1 / 3))
    assert (got["place"]["survey_categories"], got["place"]["coverage"]) == (1, 1.0)
    assert (got["age"]["missing_in"], got["age"]["coverage"]) == ("survey, benchmark", 0.0)
    lost = [r["category"] for r in compare.unmatched_categories(survey, bench, ["country", "place"], 1).collect()]
    assert lost == ["b"]
    dims = [Dimension("Country", ("country",)), Dimension("Both", ("country", "place")), Dimension("Place", ("place",)), Dimension("Age", ("age",))]
    report = {r["dimension"]: r for r in compare.alignment_report(survey, bench, dims).collect()}
    assert report["Place"]["recommendation"].startswith("Excellent") and report["Country"]["recommendation"].startswith("Poor")
    assert report["Both"]["recommendation"].startswith("Moderate") and report["Both"]["issues"] == 1
    assert report["Age"]["status"] == "skipped" and report["Age"]["overall_alignment"] is None


def test_overlaps(spark):
    left = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "c string")
    right = spark.createDataFrame([("b",), ("z",)], "c string")
    assert {r["c"]: r["where"] for r in compare.overlap(left, right, "c").collect()} == {"a": "only left", "b": "both", "z": "only right"}
    row = compare.strata_overlap(left, right, ["c"]).first()
    assert (row["survey_strata"], row["common_strata"], row["overlap"]) == (2, 1, 0.5)


def test_coverage_gap(spark):
    bench = spark.createDataFrame([("a", 0.5), ("b", 0.2), ("b", 0.1), ("c", 0.2)], "country string, population_share double")
    known = spark.createDataFrame([("a",), ("a",)], "country string")
    assert [(r["country"], round(r["population_share"], 9)) for r in compare.uncovered(bench, known, "country").collect()] == [("b", 0.3), ("c", 0.2)]
    got = {r["state"]: (r["categories"], round(r["population_share"], 9)) for r in compare.coverage_summary(bench, known, "country").collect()}
    assert got == {"mapped": (1, 0.5), "unmapped": (2, 0.5)}


def issues(frame):
    return {(r["source"], r["check"], r["column"]): (r["value"], r["severity"]) for r in frame.collect()}


def test_core_survey_check(spark):
    survey = spark.createDataFrame([("a", None), ("b", None), ("c", "m")], "country string, gender string")
    got = issues(quality.check_survey(survey))
    assert set(got) == {("survey", "missing_values", "gender"), ("survey", "missing_column", "age_group")}
    assert issues(quality.check_survey(survey.limit(0), ["country"])) == {("survey", "empty", None): (0.0, "error")}
    assert issues(quality.check_survey(survey, ["country"])) == {}


def test_deep_survey_check(spark):
    rows = [("a", "17", None, "1")] * 3 + [("b?", "130", None, "2"), ("c", "x", None, None), ("d", "-1", None, "3")]
    survey = spark.createDataFrame(rows, "country string, age string, empty string, some string")
    got = issues(quality.check_survey_deep(survey, ["gender"]))
    assert got["survey", "unusual_characters", "country"] == (1.0, "error")
    assert got["survey", "implausible_age", "age"] == (2.0, "error")
    assert got["survey", "all_null", "empty"][1] == "error"
    assert got["survey", "duplicate_rows", None] == (pytest.approx(100 * 2 / 6), "error")
    assert ("survey", "missing_values", "some") not in got  # 17 % is below the warning
    assert ("survey", "missing_column", "gender") in got


def test_missing_values_between_the_limits_are_a_warning(spark):
    survey = spark.range(10).select(F.when(F.col("id") > 2, F.col("id").cast("string")).alias("v"), F.col("id").alias("k"))
    assert issues(quality.check_survey_deep(survey)) == {("survey", "missing_values", "v"): (30.0, "warning")}


def test_benchmark_check(spark):
    rows = [("good", "a", 0.5), ("good", "b", 0.5), ("off", "a", 0.2), ("off", "b", -0.1), ("off", "c", None), ("one", "a", 1.0), ("twice", "a", 0.5), ("twice", "a", 0.5)]
    bench = spark.createDataFrame(rows, "dimension string, k string, population_share double")
    got = issues(quality.check_benchmark(bench, [Dimension("any", ("k",))]))
    assert {k[:2] for k in got} == {
        ("off", "share_sum"), ("off", "negative_share"), ("off", "null_share"), ("one", "large_share"), ("one", "few_strata"), ("twice", "repeated_key"),
    }
    assert got["twice", "repeated_key", None] == (1.0, "warning")
    assert ("benchmark", "missing_column", "population_share") in issues(quality.check_benchmark(bench.drop("population_share"), []))


@pytest.mark.parametrize("known, found", [(0, "no_overlap"), (1, "low_overlap"), (3, None)])
def test_pair_check(spark, known, found):
    survey = spark.range(20).select(F.concat(F.lit("c"), F.col("id")).alias("country"))
    rows = [(f"c{i}" if i < known else f"x{i}", 0.1) for i in range(10)]
    bench = spark.createDataFrame(rows, "country string, population_share double")
    got = issues(quality.check_pair(survey, bench, Dimension("Country", ("country",))))
    assert {k[1] for k in got if k[0] == "pair"} == ({found} if found else set())
    lost = issues(quality.check_pair(survey, bench.withColumnRenamed("country", "land"), Dimension("Country", ("country",))))
    assert ("benchmark", "missing_column", "country") in lost


def test_mapping_requirement_and_completeness(spark):
    dims = [Dimension("A", ("a",)), Dimension("R", ("r",), ("country_to_region",))]
    survey = spark.createDataFrame([("A",), ("B",), (None,)], "country string")
    regions = spark.createDataFrame([("A", "X"), ("B", "Y")], "country string, region string")
    assert issues(quality.check_requirements(survey, dims, {})) == {("R", "missing_requirement", "country_to_region"): (None, "error")}
    assert issues(quality.check_requirements(survey, dims, {"country_to_region": regions})) == {}
    part = {"country_to_region": regions.where("country = 'A'")}
    assert issues(quality.check_requirements(survey, dims, part)) == {("R", "unmapped_keys", "country_to_region"): (1.0, "error")}
    bench = spark.createDataFrame([("A",)], "dimension string")
    row = quality.check_completed(bench, dims).first()
    assert (row["completed"], row["coverage"], row["sufficient"]) == (1, 0.5, False)


def test_summary_counts_by_severity(spark):
    rows = [("s", "x", "c", 1.0, "error"), ("s", "y", "c", 1.0, "warning"), ("b", "y", "c", 1.0, "warning")]
    frame = spark.createDataFrame(rows, quality.ISSUE_SCHEMA)
    got = {r["source"]: (r["errors"], r["warnings"], r["valid"]) for r in quality.validation_summary([frame, quality.no_issues(spark)]).collect()}
    assert got == {"s": (1, 1, False), "b": (0, 1, True)}


def test_profile(spark):
    frame = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "c string")
    row = quality.profile(quality.value_counts(frame, ["c"])).first()
    assert (row["rows"], row["distinct_values"], row["missing_share"], row["top_value"]) == (4, 2, 0.25, "a")


def test_rows_that_differ_in_the_place_of_a_null_are_no_duplicates(spark):
    rows = spark.createDataFrame([(None, "a"), ("a", None)] * 1 + [("b", "c")] * 8, "x string, y string")
    found = {r["check"]: r["value"] for r in quality.check_survey_deep(rows).collect()}
    assert found["duplicate_rows"] == pytest.approx(70.0)
