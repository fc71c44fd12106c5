import statistics

import pytest
from plan_rows import metric_of
from pyspark.sql import functions as F

from stratalens.operators import variance


def long(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"stratum string, question string, answer {kind}")


def test_scaled_variance_is_that_of_scaled_answers(spark):
    answers = [1.0, 2.0, 5.0, 4.0]
    got = variance.within_stratum_variance(long(spark, [("s", "q", a) for a in answers]), ["stratum"]).first()["variance"]
    scaled = [(a - 1) / 4 for a in answers]
    assert got == pytest.approx(statistics.variance(scaled))


def test_answers_up_to_one_are_not_scaled(spark):
    got = variance.within_stratum_variance(long(spark, [("s", "q", a) for a in (0.0, 0.5, 0.5)]), ["stratum"]).first()["variance"]
    assert got == pytest.approx(statistics.variance([0.0, 0.5, 0.5]))


def test_defaults_and_constant_questions(spark):
    rows = [("one", "q", 1.0), ("flat", "q", 3.0), ("flat", "q", 3.0), ("mixed", "q", 3.0), ("mixed", "q", 3.0), ("mixed", "p", 0.0), ("mixed", "p", 1.0)]
    got = {r["stratum"]: r["variance"] for r in variance.within_stratum_variance(long(spark, rows), ["stratum"]).collect()}
    assert got == {"one": 0.25, "flat": 0.25, "mixed": pytest.approx(0.5)}


def test_numeric_form_scales_only_outside_the_unit_range(spark):
    rows = [("s", "unit", 0.0), ("s", "unit", 1.0), ("s", "wide", 10.0), ("s", "wide", 30.0), ("s", "flat", 7.0), ("s", "flat", 7.0), ("s", "few", 1.0)]
    got = {r["question"]: r["variance"] for r in variance.numeric_stratum_variance(long(spark, rows), ["stratum"]).collect()}
    assert got == {"unit": pytest.approx(0.5), "wide": pytest.approx(0.5)}


def scored(spark, answers):
    counts = variance.answer_counts(long(spark, [("s", "q", a) for a in answers], "string"), ["stratum"])
    return {r["answer"]: r["score"] for r in variance.unit_scores(counts, ["stratum"]).collect()}


def test_known_answers_follow_the_scale(spark):
    assert scored(spark, ["Agree", "Disagree", "Neutral", "what"]) == {"Agree": 1.0, "Disagree": 0.0, "Neutral": 0.5, "what": None}


def test_mostly_unknown_answers_become_ranks(spark):
    assert scored(spark, ["red", "blue", "green", None]) == {"blue": 0.0, "green": 0.5, "red": 1.0, None: None}


def test_single_unknown_answer_is_the_middle(spark):
    assert scored(spark, ["red", "red"]) == {"red": 0.5}


def test_many_unknown_answers_stay_unknown(spark):
    got = scored(spark, [f"a{i:02d}" for i in range(11)])
    assert set(got.values()) == {None}


def test_exactly_half_unknown_keeps_the_scale(spark):
    assert scored(spark, ["Agree", "other"]) == {"Agree": 1.0, "other": None}


def test_variance_from_counts_is_that_of_the_answers(spark):
    answers = ["Agree"] * 5 + ["Neutral"] * 3 + ["Disagree"] * 2
    counts = variance.answer_counts(long(spark, [("s", "q", a) for a in answers], "string"), ["stratum"])
    got = variance.stratum_variance(variance.unit_scores(counts, ["stratum"]), ["stratum"]).first()
    assert got["answers"] == 10
    assert got["variance"] == pytest.approx(statistics.variance([1.0] * 5 + [0.5] * 3 + [0.0] * 2))


def test_summary_uses_population_deviation(spark):
    rows = spark.createDataFrame([("s", 0.1), ("s", 0.3), ("s", 0.8)], "stratum string, variance double")
    row = variance.variance_summary(rows, ["stratum"]).first()
    assert row["std_variance"] == pytest.approx(statistics.pstdev([0.1, 0.3, 0.8])) and row["median_variance"] == 0.3
    assert row["consensus_score"] == pytest.approx(0.6)


def test_consensus_bands_are_strict(spark):
    rows = spark.createDataFrame([(0.2,), (0.1,), (0.4,), (0.5,)], "mean_variance double")
    got = {r["band"]: r["strata"] for r in variance.consensus_bands(rows).collect()}
    assert got == {"High": 1, "Medium": 1, "Low": 2}


def test_agreement_table(spark):
    wide = spark.createDataFrame(
        [("q1", "Ask Opinion", "80%", "10%"), ("q2", "Ask Opinion", "60% ", None), ("q3", "Poll", "0%", "90%")],
        "question string, question_type string, `O1: Male` string, `O2: Female` string",
    )
    rates = variance.agreement_rates(wide)
    assert {(r["question"], r["stratum"]): r["rate"] for r in rates.collect()}[("q2", "Male")] == pytest.approx(0.6)
    strata = spark.createDataFrame([("Male",), ("Female",), ("Other",)], "stratum string")
    got = {r["stratum"]: r["variance"] for r in variance.agreement_variance(rates, strata).collect()}
    assert got == {"Male": pytest.approx(statistics.variance([0.8, 0.6])), "Female": 0.25, "Other": 0.25}


def test_poll_columns(spark):
    frame = spark.range(300).select(
        F.col("id").alias("Participant Id"),
        (F.col("id") % 5).alias("five"),
        (F.col("id") % 20).alias("twenty"),
        (F.col("id") % 21).alias("many"),
        F.lit("x").alias("one"),
        F.col("id").alias("text (English)"),
        F.when(F.col("id") < 2, F.col("id")).alias("two and nulls"),
    )
    got = {r["column"]: r["answers"] for r in variance.poll_columns(frame).collect()}
    assert got == {"five": 5, "twenty": 20, "two and nulls": 2}


def test_indicator_columns():
    assert variance.indicator_columns(["ai_use", "age", "trust_ai", "job_loss"]) == ["ai_use", "trust_ai", "job_loss"]


def test_answers_are_counted_before_they_meet_their_categories(spark):
    """The join gets one row a stratum and question, however many answers there are; a question may be in two categories."""
    answers = spark.range(3000).selectExpr("CAST(id % 2 AS STRING) AS stratum", "CAST(id % 3 AS STRING) AS question", "CAST(id % 5 AS DOUBLE) AS answer")
    codes = spark.createDataFrame([("0", "a"), ("1", "a"), ("1", "b"), ("9", "b")], "question string, category string")
    found = variance.variance_by_category(answers, codes, ["stratum"])
    got = {(r["category"], r["stratum"]): r["variance"] for r in found.collect()}
    one = {(s, q): statistics.variance([(i % 5) / 4 for i in range(3000) if i % 2 == s and i % 3 == q]) for s in (0, 1) for q in (0, 1)}
    want = {("a", str(s)): (one[s, 0] + one[s, 1]) / 2 for s in (0, 1)} | {("b", str(s)): one[s, 1] for s in (0, 1)}
    assert got == {key: pytest.approx(value) for key, value in want.items()}
    joined = metric_of(found, "Join")
    assert joined and max(joined) <= 6
