import pytest
from pyspark.sql import functions as F

from stratalens.operators import harmonize
from stratalens.sources import readers, writers


def test_missing_path_is_named(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="no such data"):
        readers.load_table(spark, str(tmp_path / "absent.csv"))


@pytest.mark.parametrize("kind", ["csv", "json", "parquet", "orc"])
def test_round_trip(spark, tmp_path, kind):
    frame = spark.createDataFrame([("a", 0.5), ("b", None)], "k string, v double")
    path = str(tmp_path / "out")
    writers.export(frame, path, kind, {"survey": "s", "rows": 2})
    back = readers.load_table(spark, path, "k string, v double", kind)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, frame.collect()), key=str)
    meta = spark.read.json(path + "_metadata").first()
    assert (meta["survey"], meta["rows"]) == ("s", "2")


def test_csv_export_flattens_arrays(spark, tmp_path):
    frame = spark.createDataFrame([("d", ["x", "y"])], "dimension string, columns array<string>")
    writers.export(frame, str(tmp_path / "out"), "csv")
    assert readers.load_table(spark, str(tmp_path / "out"), kind="csv").first()["columns"] == "x, y"
    with pytest.raises(ValueError):
        writers.export(frame, str(tmp_path / "out"), "xlsx")


def test_benchmarks_by_dimension(spark, tmp_path):
    long = spark.createDataFrame([("Gender", "m", None, 1.0), ("Country", None, "A", 1.0)], "dimension string, gender string, country string, population_share double")
    path = str(tmp_path / "bench")
    writers.write_by(long, path)
    some = readers.load_benchmarks(spark, path, ["Gender"])
    assert [r["gender"] for r in some.collect()] == ["m"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "= Gender)]" in plan
    assert readers.load_benchmarks(spark, path).count() == 2


def test_benchmark_files(spark, tmp_path):
    (tmp_path / "g.csv").write_text("gender,population_proportion\nMale,0.5\nFemale,0.5\n")
    (tmp_path / "c.csv").write_text("country,population_proportion\nA,1.0\n")
    long = readers.load_benchmark_files(spark, {"Gender": str(tmp_path / "g.csv"), "Country": str(tmp_path / "c.csv")})
    assert {(r["dimension"], r["gender"], r["country"], r["population_share"]) for r in long.collect()} == {
        ("Gender", "Male", None, 0.5), ("Gender", "Female", None, 0.5), ("Country", None, "A", 1.0),
    }
    with pytest.raises(ValueError):
        readers.load_benchmark_files(spark, {})


EXPORT = """a,b,Participant Id,c,d,How old are you?,What is your gender?,What best describes where you live?,e,What religious group or faith do you most identify with?,What country or region do you most identify with?
x,y,Participant Id,z,w,How old are you?,q,q,q,q,q
x,y,p1,z,w," 18-25 ",Female,Suburban,v,Sikhism,"Korea, Republic of"
x,y,p2,z,w,26-35,male,Rural,v,,Chile
x,y,p3,z,w,,Male,Rural,v,Islam,Chile
"""


def test_participants_by_position(spark, tmp_path):
    path = tmp_path / "wave_3.csv"
    path.write_text(EXPORT)
    regions = spark.createDataFrame([("Republic of Korea", "Eastern Asia")], "country string, region string")
    continents = spark.createDataFrame([("Eastern Asia", "Asia")], "region string, continent string")
    got = {r["participant_id"]: r for r in readers.load_participants(spark, str(path), harmonize.standard_mappings(spark), regions, continents).collect()}
    assert set(got) == {"p1", "p2"}
    one = got["p1"]
    assert (one["age_group"], one["environment"], one["religion"], one["country"], one["continent"]) == (
        "18-25", "Urban", "Other religious group", "Republic of Korea", "Asia",
    )
    assert (got["p2"]["gender"], got["p2"]["religion"], got["p2"]["region"]) == ("Male", None, None)


def test_short_export_is_refused(spark):
    with pytest.raises(ValueError, match="missing"):
        readers.by_position(spark.createDataFrame([("a", "b")], "_c0 string, _c1 string"))


def test_question_texts(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text("What is your gender?,Muted,Participant Id\nMale,no,7\n")
    got = readers.by_question_text(readers.load_table(spark, str(path)))
    assert sorted(got.columns) == ["gender", "participant_id"] and got.first()["gender"] == "Male"


def test_words(spark):
    rows = [(" p1 a b c d 18-25 Male  Urban e Islam Chile",), ("too short",), (None,), ("Participant Id a b c d e f g h i j",)]
    lines = spark.createDataFrame(rows, "value string")
    got = readers.by_words(lines).collect()
    assert [tuple(r) for r in got] == [("p1", "18-25", "Male", "Urban", "Islam", "Chile")]


def test_title_line(spark):
    lines = spark.createDataFrame([(",,,",), ('"",""',), ("a,b",)], "value string")
    assert [r["value"] for r in readers.skip_title_line(lines).collect()] == ["a,b"]


def test_below_marker_over_several_splits(spark, tmp_path):
    body = "".join(f"{i},{i % 3},x\n" for i in range(4000))
    for name, notes in (("a", 3), ("b", 9)):
        text = "".join(f"note {k}, with comma, 12\n" for k in range(notes)) + "D_ID,Q1,Q2\n" + body
        (tmp_path / f"{name}.csv").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        frame = readers.load_below_marker(spark, str(tmp_path), "D_ID", "id INT, q1 INT, q2 INT")
        assert frame.agg(F.count("id"), F.sum("id"), F.count("q2")).first()[:] == (8000, 2 * sum(range(4000)), 0)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_waves_from_paths(spark, tmp_path):
    for wave in (6, 7):
        folder = tmp_path / f"wave_{wave}"
        folder.mkdir()
        (folder / "data.csv").write_text("gender,religion\n1,5\n")
    got = readers.load_coded_surveys(spark, str(tmp_path / "*"), harmonize.standard_mappings(spark)).collect()
    assert sorted((r["wave"], r["gender"], r["religion"]) for r in got) == [(6, "Male", "Islam"), (7, "Male", "Islam")]
    named = readers.load_waves(spark, str(tmp_path / "*" / "*.csv"))
    assert {r["survey"] for r in named.collect()} == {"wave_6", "wave_7"}


def test_multi_line_headers(spark, tmp_path):
    (tmp_path / "u.csv").write_text('Index,"Country\ncode",Urban\n1,"4",4 219 817\n')
    tables = readers.load_population_tables(spark, {"urban": str(tmp_path / "u.csv")})
    assert tables["urban"].columns[1] == "Country\ncode" and tables["urban"].first()["Urban"] == "4 219 817"


@pytest.mark.parametrize("kind", ["parquet", "json"])
def test_variance_lookup(spark, tmp_path, kind):
    rows = [("s1", "Gender", "Male", 0.1), ("s1", "Country", "A", 0.2), ("s2", "Gender", "Male", 0.3)]
    frame = spark.createDataFrame(rows, "survey string, dimension string, stratum string, variance double")
    writers.write_variances(frame, str(tmp_path / "v"), kind)
    back = readers.load_variances(spark, str(tmp_path / "v"), kind)
    assert sorted((r["survey"], r["dimension"], r["stratum"], r["variance"]) for r in back.collect()) == sorted(rows)
    with pytest.raises(ValueError):
        writers.write_variances(frame, str(tmp_path / "w"), "yaml")


def test_nested_variance_lookup(spark, tmp_path):
    path = tmp_path / "lookup.json"
    path.write_text('{"Gender": {"Male": 0.1,\n "Female": 0.2}, "Country": {"A": 0.3}}')
    got = {(r["survey"], r["dimension"], r["stratum"]): r["variance"] for r in readers.load_nested_variances(spark, str(path), "s1").collect()}
    assert got == {("s1", "Gender", "Male"): 0.1, ("s1", "Gender", "Female"): 0.2, ("s1", "Country", "A"): 0.3}
