"""Quoted records over several lines and blocks, against Python's csv module."""

import csv
import io
import random

import pytest
from pyspark.errors import PySparkException

from stratalens.sources import readers
from stratalens.sources.records import fields_of, quoted_records


@pytest.fixture
def small_blocks(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]
    for name, value in zip(names, ("64", "0")):
        spark.conf.set(name, value)
    yield
    for name, value in zip(names, old):
        spark.conf.set(name, value)


def written(path, rows):
    text = io.StringIO()
    csv.writer(text, lineterminator="\n", quoting=csv.QUOTE_MINIMAL).writerows(rows)
    path.write_text(text.getvalue())


def random_rows(seed, count):
    rng = random.Random(seed)
    parts = ["a", "long text " * 4, ",", '"', "\n", "\n\n", '""', " ", "ü"]
    field = lambda: "x" + "".join(rng.choice(parts) for _ in range(rng.randrange(5))) + "y"
    return [[str(i), field(), field()] for i in range(count)]


@pytest.mark.parametrize("seed", range(3))
def test_records_over_many_blocks(spark, tmp_path, small_blocks, seed):
    want = {}
    for name in ("one", "two"):
        rows = random_rows(seed * 10 + len(name), 60)
        written(tmp_path / f"{name}{seed}.csv", rows)
        want[f"{name}{seed}"] = rows
    records = quoted_records(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20  # a record lies in several blocks
    got = {}
    for r in records.select("file", "place", fields_of("value").alias("f")).orderBy("file", "place").collect():
        got.setdefault(r["file"].rsplit("/", 1)[1][:-4], []).append(list(r["f"]))
    assert got == want


def test_fields(spark):
    cases = ['a,b', '"a,b",c', '"say ""yes""",x', '"",', '""""', '"a""",b', ' a , " b " ', '', ',', '"x\ny",z']
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, v string")
    got = [list(r["f"]) for r in frame.orderBy("i").select(fields_of("v").alias("f")).collect()]
    want = [["a", "b"], ["a,b", "c"], ['say "yes"', "x"], ["", ""], ['"'], ['a"', "b"], ["a", " b "], [""], ["", ""], ["x\ny", "z"]]
    assert got == want
    other = spark.createDataFrame([('a;"b;c"',)], "v string").select(fields_of("v", ";").alias("f")).first()["f"]
    assert other == ["a", "b;c"]


def test_a_missing_quote_is_an_error_not_one_row(spark, tmp_path):
    (tmp_path / "bad.csv").write_text('a,"never closed\n' + "b,c\n" * 300)
    with pytest.raises(PySparkException, match="quote is missing"):
        quoted_records(spark, str(tmp_path / "bad.csv"), most_lines=100).collect()
    assert quoted_records(spark, str(tmp_path / "bad.csv"), most_lines=1000).count() == 1


def test_empty_file(spark, tmp_path):
    (tmp_path / "none.csv").write_text("")
    assert quoted_records(spark, str(tmp_path)).count() == 0


def test_question_texts_with_a_header_for_each_file(spark, tmp_path):
    questions = {"What is your\ngender?": "gender", "Where?": "place"}
    (tmp_path / "a.csv").write_text(',,\n"What is your\ngender?",Where?,x\nMale,"a\nb",1\n')
    (tmp_path / "b.csv").write_text('x,Where?,"What is your\ngender?"\n2,"c, ""d""",Female\nx,Where?,"What is your\ngender?"\n')
    (tmp_path / "c.csv").write_text("Other,e,3\n")
    got = sorted(tuple(r) for r in readers.load_question_texts(spark, str(tmp_path), questions).collect())
    assert got == [("Female", 'c, "d"'), ("Male", "a\nb"), ("Other", "e")]


def test_participants_with_line_breaks(spark, tmp_path):
    fields = ["x", "y\nz", "p1", 'a "q"', "w", "18-25", "Female", "Rural", "v", "Islam", "Chile"]
    written(tmp_path / "p.csv", [["h"] * 11, fields])
    got = readers.load_participants(spark, str(tmp_path / "p.csv")).collect()
    assert [(r["participant_id"], r["country"]) for r in got if r["participant_id"] == "p1"] == [("p1", "Chile")]


def test_population_table_over_many_blocks(spark, tmp_path, small_blocks):
    rows = [["Index", "Country\ncode", "Urban"], *[[str(i), f"c{i}\nname", f"{i} 000"] for i in range(80)]]
    written(tmp_path / "u.csv", rows)
    table = readers.load_population_tables(spark, {"urban": str(tmp_path / "u.csv")})["urban"]
    assert table.columns == ["Index", "Country\ncode", "Urban"]
    assert sorted(map(tuple, table.collect()), key=lambda r: int(r[0])) == [tuple(r) for r in rows[1:]]
