"""Groups without a name, lookups of several surveys, and files without a marker line."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stratalens.operators import scores, segments
from stratalens.operators.allocation import with_variance
from stratalens.operators.strata import Dimension, cell_counts, join_groups, line_up
from stratalens.operators.variance import for_dimensions
from stratalens.plans import workflow
from stratalens.sources import readers

DIM = Dimension("Country", ("country",))


@pytest.fixture
def bench(spark):
    return spark.createDataFrame([("Country", "A", 0.5), ("Country", "B", 0.5)], "dimension string, country string, population_share double")


@pytest.fixture
def survey(spark):
    """Wave 1 has both countries, the nameless wave only one."""
    return spark.createDataFrame([(1, "A"), (1, "B"), (None, "A"), (None, "A")], "wave int, country string")


@pytest.fixture
def aligned(survey, bench):
    return line_up(cell_counts(survey, ["country"], ["wave"]), bench, [DIM], ["wave"], keyed=True)


def test_join_groups(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "g string, v int")
    right = spark.createDataFrame([(None, 3), ("a", 4), ("b", 5)], "g string, w int")
    assert sorted(map(tuple, join_groups(left, right, ["g"]).collect()), key=str) == [("a", 2, 4), (None, 1, 3)]
    assert join_groups(left, left.withColumnRenamed("v", "w"), ["g"]).count() == 2


def test_nameless_group_keeps_its_rows(aligned):
    gaps = segments.deviations(aligned)
    by = ["wave"]
    assert segments.cumulative_gaps(gaps, [DIM], by).count() == 4
    weighted = scores.with_weights(aligned, [DIM])
    assert scores.weighted_detail(weighted, [DIM], by).count() == 4
    top = segments.top_contributors(gaps, [DIM], 10, by=by)
    card = scores.match_and_coverage(aligned, by)
    assert segments.fix_impact(top, card, by).count() == 4
    rows = {r["wave"]: r for r in segments.fix_summary(top, card, by).collect()}
    assert rows[None]["current_score"] == pytest.approx(0.5) and rows[None]["potential_score"] == pytest.approx(1.0)
    assert segments.dimension_totals(segments.category_table(aligned, [DIM], by), by=by).count() == 2
    detail = scores.weighted_detail(weighted, [DIM], by)
    assert segments.weight_shift(detail, detail, [DIM], by).count() == 4


def test_nameless_group_in_the_whole_scorecard(spark, survey, bench):
    maxima = spark.createDataFrame([("Country", 2, 1.0, 1.0)], "dimension string, size int, max_match double, max_coverage double")
    card = workflow.full_scorecard(survey, bench, [DIM], ["wave"], maxima=maxima)
    rows = {(r["wave"], r["dimension"]): r for r in card.collect()}
    assert set(rows) == {(w, d) for w in (1, None) for d in ("Country", "Overall (Average)")}
    assert rows[None, "Country"]["match_pct_of_max"] == pytest.approx(50)
    assert rows[None, "Overall (Average)"]["match_score"] == pytest.approx(0.5)
    assert rows[None, "Overall (Average)"]["sample_size"] == 2


def test_each_survey_uses_its_own_variances(spark, survey, bench):
    named = survey.na.fill({"wave": 2})
    aligned = line_up(cell_counts(named, ["country"], ["wave"]), bench, [DIM], ["wave"])
    lookup = spark.createDataFrame(
        [(1, "Country", "A", 0.1), (2, "Country", "A", 0.4)], "wave int, dimension string, stratum string, variance double"
    )
    rows = scores.with_weights(aligned, [DIM], lookup).collect()
    assert {(r["wave"], r["country"]): r["reliability"] for r in rows} == {(1, "A"): 0.9, (1, "B"): 1.0, (2, "A"): 0.6, (2, "B"): 1.0}
    assert len(rows) == 4


def test_two_variances_for_one_stratum_are_an_error(spark, survey, bench):
    lookup = spark.createDataFrame(
        [("s1", "Country", "A", 0.1), ("s2", "Country", "A", 0.4)], "survey string, dimension string, stratum string, variance double"
    )
    aligned = line_up(cell_counts(survey, ["country"]), bench, [DIM])
    with pytest.raises(PySparkException, match="more than one variance"):
        scores.with_weights(aligned, [DIM], lookup).collect()
    one = lookup.where("survey = 's2'")
    assert {r["country"]: r["reliability"] for r in scores.with_weights(aligned, [DIM], one).collect()}["A"] == pytest.approx(0.6)
    strata = bench.withColumn("stratum", F.col("country"))
    with pytest.raises(PySparkException, match="more than one variance"):
        with_variance(strata, lookup).collect()


def test_spellings_are_chosen_within_each_survey(spark):
    rows = [("s1", "Country", "A", 0.1), ("s2", "Country", "A", 0.2)]
    lookup = spark.createDataFrame(rows, "survey string, dimension string, stratum string, variance double")
    assert sorted(map(tuple, for_dimensions(lookup, [DIM]).collect())) == rows


def test_overall_row_is_made_in_the_same_aggregate(spark):
    card = spark.createDataFrame([("A", 0.2, 5), ("B", None, 7)], "dimension string, match_score double, sample_size int")
    rows = {r["dimension"]: r for r in scores.with_overall(card, ["match_score"], largest=["sample_size"]).collect()}
    assert rows["A"]["match_score"] == 0.2 and rows["B"]["match_score"] is None
    assert rows["Overall (Average)"]["match_score"] == 0.2 and rows["Overall (Average)"]["sample_size"] == 7


def written(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)


def test_columns_below_the_marker_by_name(spark, tmp_path):
    written(tmp_path / "d", "a.csv", 'note\nD_ID,Q1,"Q,2"\n1,2,3\n4,"5",x\n')
    written(tmp_path / "d", "b.csv", 'Q,2\n\n"Q,2",D_ID\n7,8\n')
    names = {"id": "D_ID", "q1": "Q1", "q2": "Q,2"}
    frame = readers.load_below_marker(spark, str(tmp_path / "d"), "D_ID", "id INT, q1 INT, q2 INT", names=names)
    assert sorted(map(tuple, frame.collect())) == [(1, 2, 3), (4, 5, None), (8, None, 7)]


def test_file_without_the_marker(spark, tmp_path):
    written(tmp_path / "d", "a.csv", "note\nD_ID,Q1\n1,2\n")
    written(tmp_path / "d", "b.csv", "note\nX,Q1\n3,4\n")
    read = lambda **o: readers.load_below_marker(spark, str(tmp_path / "d"), "D_ID", "id INT, q1 INT", **o)
    with pytest.raises(PySparkException, match="no line with"):
        read().collect()
    assert sorted(map(tuple, read(fallback=1).collect())) == [(1, 2), (3, 4)]


def test_participants_with_wave_and_layout(spark, tmp_path):
    folder = tmp_path / "wave 3"
    written(folder, "p.txt", ",,\nParticipant id\n")
    line = " ".join(f"w{i}" for i in range(40))
    written(folder, "p.txt", ",,,\n" + line + "\n")
    frame = readers.load_participants(spark, str(folder), layout="words", wave=r"(?i)wave(?:[_ ]|%20)?(\d+)")
    assert [r["wave"] for r in frame.collect()] == [3]
    with pytest.raises(ValueError):
        readers.load_participants(spark, str(folder), layout="sideways")


def test_question_texts_below_a_title_line(spark, tmp_path):
    head = '"How old are you?","What is your gender?",Other\n'
    written(tmp_path / "q", "a.csv", ",,\n" + head + '"18-25, about","Male",x\n')
    written(tmp_path / "q", "b.csv", head + "65+,Female,y\n")
    rows = readers.load_question_texts(spark, str(tmp_path / "q")).collect()
    assert sorted((r["age_group"], r["gender"]) for r in rows) == [("18-25, about", "Male"), ("65+", "Female")]
    written(tmp_path / "e", "a.csv", ",,\n")
    assert readers.load_question_texts(spark, str(tmp_path / "e")).count() == 0
