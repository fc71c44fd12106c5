import pytest
from pyspark.sql import functions as F

from stratalens.functions import expressions as ex
from stratalens.functions import fixed
from stratalens.operators import benchmarks, harmonize
from stratalens.operators.strata import cell_counts, roll_up


def counts(frame, column):
    return {r[column]: r["count"] for r in frame.groupBy(column).count().collect()}


def test_strict_and_lenient_mapping(spark):
    survey = spark.createDataFrame([("USA", "M"), ("CAN", "F"), ("Mars", "F"), (None, "M")], "country string, gender string")
    mapping = harmonize.mapping_table(
        spark, {"s": {"country": {"United States": ["USA"], "Canada": ["CAN"]}, "gender": {"Male": ["M"], "Female": ["F"]}}}
    )
    strict = harmonize.map_strict(survey, mapping, "s", ["country", "gender", "religion"])
    assert sorted((r["country"], r["gender"]) for r in strict.collect()) == [("Canada", "Female"), ("United States", "Male")]
    lenient = harmonize.map_lenient(survey, mapping, "s", ["country", "gender"])
    assert counts(lenient, "country") == {"United States": 1, "Canada": 1, "Mars": 1, None: 1}
    assert lenient.columns == survey.columns


def test_benchmark_mapping_overrides_and_suburbs_are_urban(spark):
    survey = spark.createDataFrame([("a", "Suburban"), ("b", "Rural")], "religion string, environment string")
    mapping = harmonize.mapping_table(spark, {"s": {"religion": {"one": ["a", "b"]}}, "benchmark": {"religion": {"two": ["b"]}}})
    got = harmonize.map_lenient(survey, mapping, "s", ["religion", "environment"])
    assert sorted(tuple(r) for r in got.collect()) == [("one", "Urban"), ("two", "Rural")]


def test_inherited_countries(spark):
    mappings = harmonize.standard_mappings(spark)
    taken = mappings.where("source = 'participants' AND attribute = 'country' AND raw_value = 'Turkey'").first()
    assert taken["standard_value"] == "Türkiye"
    one = harmonize.one_value_each(mappings, ["participants", "benchmark"])
    assert one.groupBy("attribute", "raw_value").count().where("count > 1").count() == 0


def test_mapping_joins_either_way(spark):
    """Whether the optimizer broadcasts the mapping or not, the result is the same and no job runs before."""
    survey = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "country string")
    mapping = spark.createDataFrame([("country", "a", "A"), ("country", "b", "B")], "attribute string, raw_value string, standard_value string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for threshold in (old, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            strict = harmonize.map_columns(survey, mapping, ["country"], strict=True)
            assert {r[0] for r in strict.collect()} == {"A", "B"}
            assert {r[0] for r in harmonize.map_columns(survey, mapping, ["country"], strict=False).collect()} == {"A", "B", "c", None}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_hierarchy(spark):
    survey = spark.createDataFrame([("United States",), ("Canada",), ("Germany",), ("Atlantis",)], "country string")
    regions = spark.createDataFrame(
        [("United States", "North America"), ("Canada", "North America"), ("Germany", "Europe")], "country string, region string"
    )
    continents = spark.createDataFrame([("North America", "Americas")], "region string, continent string")
    got = {r["country"]: (r["region"], r["continent"]) for r in harmonize.add_hierarchy(survey, regions, continents).collect()}
    assert got == {
        "United States": ("North America", "Americas"), "Canada": ("North America", "Americas"), "Germany": ("Europe", None), "Atlantis": (None, None),
    }
    assert counts(harmonize.unmapped_values(survey, regions, "country").drop("n"), "country") == {"Atlantis": 1}


def test_expressions(spark):
    frame = spark.createDataFrame(
        [("4 219 817", "<0.1", "<10,000", ' "Urban" ', -1), ("31,410", "99.7", "31,410,000", "nan", 17), ("..", "x", "?", "", 66)],
        "num string, pct string, people string, txt string, age int",
    )
    got = frame.select(
        ex.plain_number(F.col("num")), ex.percent_text(F.col("pct")), ex.bounded_count(F.col("people")),
        ex.clean_text(F.trim("txt")), ex.age_band(F.col("age")),
    ).collect()
    assert [tuple(r) for r in got] == [
        (4219817.0, 0.05, 10000, "Urban", None), (31410.0, 99.7, 31410000, None, "Under 18"), (None, 0.0, None, None, "66+"),
    ]


@pytest.mark.parametrize("age, band", [(0, "Under 18"), (18, "18-25"), (25, "18-25"), (26, "26-35"), (45, "36-45"), (56, "56-65"), (65, "56-65"), (None, None)])
def test_age_bands(spark, age, band):
    assert spark.createDataFrame([(age,)], "age int").select(ex.age_band(F.col("age"))).first()[0] == band


@pytest.mark.parametrize("code, place", [(1, "Rural"), (3, "Rural"), (4, "Urban"), (8, "Urban"), (9, None), (None, None)])
def test_town_setting(spark, code, place):
    assert spark.createDataFrame([(code,)], "c int").select(ex.town_setting(F.col("c"))).first()[0] == place


def test_recode_drops_incomplete(spark):
    raw = spark.createDataFrame(
        [("USA", "Man", "Over 65", "City", "Atheist"), ("Chile", "Woman", "18-25", "?", "?"), ("Chile", "Robot", "18-25", "City", "Hindu"), (None, "Man", "18-25", "City", "Hindu")],
        "country string, gender string, age_group string, environment string, religion string",
    )
    got = sorted(tuple(r) for r in harmonize.recode_demographics(raw).collect())
    assert got[0] == ("Chile", "Female", "18-25", None, None) and got[1][0:3] == ("United States", "Male", "65+") and len(got) == 2


def test_age_gender_benchmark(spark):
    columns = "Type string, Area string, `15-19` string, `20-24` string, `0-4` string, `100+` string"
    male = spark.createDataFrame([("Country", "A", "1 000", "2,000", "999", "x"), ("Country", "B", "5", "5", "5", "5"), ("Region", "W", "9", "9", "9", "9")], columns)
    female = spark.createDataFrame([("Country/Area", "A", "0", "0", "1", "7 000")], columns)
    got = {(r["country"], r["gender"], r["age_group"]): r["population_share"] for r in benchmarks.age_gender_benchmark(male, female, "Area", "Type").collect()}
    assert got == {("A", "Male", "18-25"): pytest.approx(0.3), ("A", "Female", "65+"): pytest.approx(0.7)}


def test_religion_benchmark(spark):
    names = [c for columns in fixed.RELIGION_COLUMNS.values() for c in columns]
    schema = "COUNTRY string, POP string, ISO3_Code string, " + ", ".join(f"`{n}` string" for n in names)
    blank = ["0"] * len(names)
    def row(country, pop, iso, **values):
        cells = dict(zip(names, blank)) | values
        return (country, pop, iso, *cells.values())
    raw = spark.createDataFrame(
        [
            row("A", "1,000", "AAA", **{"PERCENT CHRISTIAN": "50.0", "PERCENT FOLK RELIGION": "<0.1", "PERCENT OTHER RELIGION": "10"}),
            row("Europe", "9", "EEE", **{"PERCENT MUSLIM": "100"}),
            row("B", "<10,000", "BBB", **{"PERCENT MUSLIM": "10"}),
            row("C", "bad", "CCC", **{"PERCENT MUSLIM": "10"}),
            row("D", "1,000", " ", **{"PERCENT MUSLIM": "10"}),
        ],
        schema,
    )
    got = {(r["country"], r["religion"]): r["population_share"] for r in benchmarks.religion_benchmark(raw, "COUNTRY", "POP", "ISO3_Code").collect()}
    total = 500 + 100.5 + 1000
    assert got == {
        ("A", "Christianity"): pytest.approx(500 / total), ("A", "Other religious group"): pytest.approx(100.5 / total), ("B", "Islam"): pytest.approx(1000 / total),
    }


def test_setting_benchmark(spark):
    raw = spark.createDataFrame(
        [("A", "AAA", "1 000", "3,000"), ("Upper-middle-income countries", "UMC", "9", "9"), ("B", "BBB", "...", "5"), ("Asia", "ASI", "1", "1"), ("C", "CCC", "0", "4 000")],
        "Area string, ISO3_Code string, `Urban (thousands)` string, `Rural (thousands)` string",
    )
    got = {(r["country"], r["environment"]): r["population_share"] for r in benchmarks.setting_benchmark(raw, "Area", "ISO3_Code").collect()}
    assert got == {("A", "Urban"): pytest.approx(1 / 8), ("A", "Rural"): pytest.approx(3 / 8), ("C", "Rural"): pytest.approx(0.5)}


def test_standard_dimensions_roll_up_together(spark):
    columns = ["country", "gender", "age_group", "religion", "environment", "region", "continent"]
    survey = spark.createDataFrame([("A", "m", "18-25", "x", "Urban", "R", "K"), ("A", "f", "65+", None, "Rural", "R", "K")], ", ".join(f"{c} string" for c in columns))
    rows = roll_up(cell_counts(survey, columns), fixed.STANDARD_DIMENSIONS).groupBy("dimension").agg(F.sum("n").alias("n")).collect()
    got = {r["dimension"]: r["n"] for r in rows}
    assert len(got) == 13 and got["Religion"] == 1 and got["Country × Gender × Age"] == 2


def test_coded_survey(spark):
    raw = spark.createDataFrame([(1, 10, "1", "30", "5", "1"), (2, 10, "9", "30", "5", "1"), (3, 11, "2", "-2", "77", "2")], "id int, country_code int, sex string, age string, religion string, place string")
    codes = spark.createDataFrame([(10, "Peru"), (11, "Chad")], "code int, label string")
    got = {r["participant_id"]: r for r in harmonize.coded_survey(raw, codes, 7).collect()}
    assert set(got) == {"1", "3"}
    assert (got["1"]["country"], got["1"]["gender"], got["1"]["age_group"], got["1"]["religion"], got["1"]["environment"], got["1"]["year"]) == ("Peru", "Male", "26-35", "Muslim", "Urban", 2022)
    assert got["3"]["age_group"] is None and got["3"]["religion"] is None


def test_slug(spark):
    assert spark.createDataFrame([("Region × Gender × Age Group",)], "d string").select(benchmarks.slug(F.col("d"))).first()[0] == "region_gender_age_group"
