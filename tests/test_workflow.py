import pytest
from pyspark.sql import functions as F

from stratalens.functions import fixed
from stratalens.operators import harmonize
from stratalens.plans import workflow


@pytest.fixture
def hierarchy(spark):
    return workflow.Hierarchy(
        spark.createDataFrame([("A", "North"), ("B", "North"), ("C", "South")], "country string, region string"),
        spark.createDataFrame([("North", "Top"), ("South", "Low")], "region string, continent string"),
    )


@pytest.fixture
def benchmark(spark, hierarchy):
    area, kind = "Region, subregion, country or area *", "Type"
    schema = f"`{kind}` string, `{area}` string, `15-19` string, `25-29` string, `65-69` string"
    male = spark.createDataFrame([("Country", "A", "1 000", "500", "500"), ("Country", "B", "700", "300", "0"), ("Country", "D", "10", "10", "10")], schema)
    female = spark.createDataFrame([("Country", "A", "900", "600", "500"), ("Country", "B", "500", "500", "0"), ("Country", "D", "10", "10", "10")], schema)
    names = [c for columns in fixed.RELIGION_COLUMNS.values() for c in columns]
    religion = spark.createDataFrame(
        [("A", "4,000", "AAA", "50", "50", *["0"] * (len(names) - 2)), ("B", "2,000", "BBB", "<0.1", "99", *["0"] * (len(names) - 2))],
        "COUNTRY string, `2010 COUNTRY POPULATION` string, ISO3_Code string, " + ", ".join(f"`{n}` string" for n in names),
    )
    setting = spark.createDataFrame(
        [("A", "AAA", "3", "1"), ("B", "BBB", "1", "1")],
        "`Region, subregion, country or area` string, ISO3_Code string, `Urban (thousands)` string, `Rural (thousands)` string",
    )
    return workflow.build_benchmarks(male, female, religion, setting, hierarchy)


RAW = [
    ("A", "Male", "18-25", "Christianity", "Urban"), ("A", "Female", "26-35", "Islam", "Suburban"), ("B", "Male", "18-25", "Islam", "Rural"),
    ("A", "Female", "65+", "Christianity", "Urban"), ("C", "Male", "18-25", "Islam", "Urban"), (None, "Male", "18-25", "Islam", "Urban"),
]
COLUMNS = "country string, gender string, age_group string, religion string, environment string"


def test_all_dimensions_have_a_benchmark(benchmark):
    sums = {r["dimension"]: r["s"] for r in benchmark.groupBy("dimension").agg({"population_share": "sum"}).withColumnRenamed("sum(population_share)", "s").collect()}
    assert set(sums) == {d.name for d in fixed.STANDARD_DIMENSIONS}
    assert sums["Religion"] == pytest.approx(1.0) and sums["Country × Gender × Age"] == pytest.approx(1.0)
    # Country D has no region and is missing from the regional dimensions.
    assert 0.9 < sums["Region"] < 1.0


def test_scorecard_of_all_dimensions(spark, benchmark, hierarchy):
    survey = workflow.prepare_survey(spark.createDataFrame(RAW, COLUMNS), harmonize.standard_mappings(spark), "participants", hierarchy)
    assert survey.count() == 5  # one respondent has no country
    maxima = spark.createDataFrame([("Country", 5, 0.9, 1.0), ("Country", 500, 0.99, 1.0)], "dimension string, size long, max_match double, max_coverage double")
    card = {r["dimension"]: r for r in workflow.full_scorecard(survey, benchmark, maxima=maxima).collect()}
    assert len(card) == 14 and card["Overall (Average)"]["sample_size"] == 5
    assert card["Country"]["max_match"] == 0.9 and card["Gender"]["max_match"] == 0.99  # stored, and stand-in
    assert card["Country × Religion"]["max_match"] is None
    assert all(0.0 <= r["match_score"] <= 1.0 for r in card.values())
    assert card["Gender"]["dimension_columns"] == ["gender"]
    assert card["Environment"]["match_score"] == pytest.approx(1 - abs(4 / 5 - 4 / 6))


def test_scorecard_per_survey_and_missing_columns(spark, benchmark):
    frame = spark.createDataFrame([("w1", "A", "Male"), ("w2", "B", "Female")], "wave string, country string, gender string")
    maxima = spark.createDataFrame([("Country", 5, 0.9, 1.0)], "dimension string, size long, max_match double, max_coverage double")
    card = workflow.full_scorecard(frame, benchmark, by=["wave"], maxima=maxima).collect()
    assert {r["dimension"] for r in card if r["wave"] == "w1"} == {"Country", "Gender", "Overall (Average)"}
    assert sum(r["error"] is not None for r in card) == 11


def test_auto_simplification_of_several_surveys(spark, benchmark):
    """Every survey is simplified by its own size, as if it were scored alone."""
    frame = spark.createDataFrame([("w1", "A"), ("w2", "A"), ("w2", "B")], "wave string, country string")
    together = workflow.full_scorecard(frame, benchmark, by=["wave"], simplify="auto").where("dimension = 'Country'").collect()
    for row in together:
        alone = workflow.full_scorecard(frame.where(F.col("wave") == row["wave"]), benchmark, simplify="auto").where("dimension = 'Country'").first()
        assert row["match_score"] == pytest.approx(alone["match_score"]) and row["strata"] == alone["strata"]
    assert len(together) == 2


def test_strict_mapping_drops_unlisted_countries(spark, hierarchy):
    raw = spark.createDataFrame([("Turkey", "Male", "18-25"), ("Atlantis", "Male", "18-25")], "country string, gender string, age_group string")
    strict = workflow.prepare_survey(raw, harmonize.standard_mappings(spark), "participants", strict=True)
    assert [r["country"] for r in strict.collect()] == ["Türkiye"]


def test_analysis_tables_agree(spark, benchmark, hierarchy):
    survey = workflow.prepare_survey(spark.createDataFrame(RAW, COLUMNS), harmonize.standard_mappings(spark), "participants", hierarchy)
    dims = [d for d in fixed.STANDARD_DIMENSIONS if d.name in ("Gender", "Country")]
    tables = workflow.analyse(survey, benchmark.where("dimension IN ('Gender', 'Country')"), dims)
    score = {r["dimension"]: r["match_score"] for r in tables.scores.collect()}
    tvd = {r["dimension"]: r["t"] for r in tables.deviations.groupBy("dimension").agg({"tvd_share": "sum"}).withColumnRenamed("sum(tvd_share)", "t").collect()}
    for name in score:
        assert score[name] == pytest.approx(1 - tvd[name])
    assert tables.impact.count() == 2 and tables.contributors.count() > 0
    assert tables.alignment.where("dimension = 'Gender'").first()["overall_alignment"] == 1.0
    assert "large_share" in {r["check"] for r in tables.issues.collect()}


def test_coarser_dimensions(spark, hierarchy):
    fine = spark.createDataFrame([("A", 0.5), ("B", 0.3), ("Z", 0.2)], "country string, population_share double")
    region = [d for d in fixed.STANDARD_DIMENSIONS if d.name == "Region"]
    assert [(r["region"], round(r["population_share"], 9)) for r in workflow.coarser(fine, region, hierarchy).collect()] == [("North", 0.8)]


def test_listed_countries_are_kept_and_the_rest_folded(spark, benchmark):
    frame = spark.createDataFrame([("A", "Male"), ("B", "Female")], "country string, gender string")
    listed = spark.createDataFrame([("A",)], "country string")
    card = {r["dimension"]: r for r in workflow.full_scorecard(frame, benchmark, simplify="listed", listed=listed).collect()}
    share = benchmark.where("dimension = 'Country' AND country = 'A'").first()["population_share"]
    # B matches nothing any more: half of the sample and the folded share are both lost.
    assert card["Country"]["match_score"] == pytest.approx(1 - 0.5 * (abs(0.5 - share) + 0.5 + (1 - share)))
    assert card["Gender"]["match_score"] == pytest.approx(workflow.full_scorecard(frame, benchmark).where("dimension = 'Gender'").first()["match_score"])
    with pytest.raises(ValueError):
        workflow.full_scorecard(frame, benchmark, simplify="listed")
    with pytest.raises(ValueError):
        workflow.full_scorecard(frame.select(F.lit(1).alias("x")), benchmark)
