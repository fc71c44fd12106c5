"""Counting and numbering in pieces: runs of a stream, window intervals, nearest keys, row classes, keyed lookups."""

import math
import random
from datetime import datetime, timedelta

import pytest
from plan_rows import metric_of
from pyspark.sql import functions as F

from stratalens.operators import quality, scores, variance
from stratalens.operators.ordering import nearest
from stratalens.operators.strata import Dimension, cell_counts, line_up
from stratalens.streaming import live

DIM = Dimension("Country", ("country",))
AB = Dimension("A × B", ("a", "b"))


def test_runs_are_the_binary_digits():
    assert [live.runs_until(k) for k in (0, 1, 2, 6, 7)] == [
        [(0, 0)],
        [(0, 1)],
        [(0, 1), (2, 2)],
        [(0, 3), (4, 5), (6, 6)],
        [(0, 7)],
    ]


def batches_of(spark, count, rows=6):
    return [spark.createDataFrame([(f"c{(7 * k + i) % 11}",) for i in range(rows)], "country string") for k in range(count)]


def test_every_batch_can_be_read_and_little_is_written_again(spark, tmp_path):
    state, rows = str(tmp_path / "state"), 6
    sink = live.keep_counts([DIM], state)
    batches, want = batches_of(spark, 8, rows), {}
    for k, batch in enumerate(batches):
        sink(batch, k)
        for row in batch.collect():
            want[row["country"]] = want.get(row["country"], 0) + 1
        assert {r["country"]: r["n"] for r in live.counts_so_far(spark, state, k).collect()} == want
        assert {r["country"]: r["n"] for r in live.counts_so_far(spark, state).collect()} == want
    written = spark.read.parquet(state).groupBy("run").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).collect()
    # Batches 0, 2, 4 and 6 wrote their own counts alone, and a count is in no more runs than the batches doubled, and its own.
    assert {r["run"]: r["rows"] for r in written if r["run"] in ("2-2", "4-4", "6-6")} == {"2-2": rows, "4-4": rows, "6-6": rows}
    assert sum(r["n"] for r in written) <= 8 * rows * (int(math.log2(8)) + 1)


def test_a_batch_run_again_or_after_a_lost_write(spark, tmp_path):
    state = str(tmp_path / "state")
    batches = batches_of(spark, 4)
    calls = []
    sink = live.keep_counts([DIM], state, lambda session, k: calls.append(k))
    for k in (0, 1, 1, 2, 3, 3):
        sink(batches[k], k)
    total = live.counts_so_far(spark, state).agg(F.sum("n")).first()[0]
    assert total == sum(b.count() for b in batches) and calls == [0, 1, 1, 2, 3, 3]
    # The write of batch 3 is lost half way: without its run the state is that of batch 2, and the batch can be run again.
    spark.createDataFrame([], "country string, n long").write.mode("overwrite").parquet(f"{state}/run=0-3")
    assert live.counts_so_far(spark, state, 2).agg(F.sum("n")).first()[0] == 18
    sink(batches[3], 3)
    assert live.counts_so_far(spark, state, 3).agg(F.sum("n")).first()[0] == 24


def test_cumulative_windows_of_ten_thousand_days(spark):
    start = datetime(1990, 1, 1)
    rows = [((start + timedelta(days=d)).strftime("%Y-%m-%d"), "A", 1) for d in range(0, 10_000, 2)]
    rows += [((start + timedelta(days=d)).strftime("%Y-%m-%d"), "B", 2) for d in range(1, 10_000, 2)]
    cells = spark.createDataFrame(rows, "window string, country string, n long").repartition(6)
    running = live.to_date(cells, ["country"])
    got = {(r["window"], r["country"]): r["n"] for r in running.collect()}
    assert len(got) == 19_999  # the second stratum starts on the second day
    day = lambda d: (start + timedelta(days=d)).strftime("%Y-%m-%d")
    assert got[day(0), "A"] == 1 and (day(0), "B") not in got
    assert got[day(9_999), "A"] == 5_000 and got[day(9_999), "B"] == 10_000 and got[day(5_000), "B"] == 5_000
    plan = running._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "map_from_arrays" not in plan
    numbers = {r["window"]: r["at"] for r in live.numbered_windows(cells).collect()}
    assert [numbers[day(d)] for d in (0, 1, 31, 9_999)] == [1, 2, 32, 10_000]


def test_cumulative_windows_of_nothing(spark):
    assert live.to_date(spark.createDataFrame([], "window string, country string, n long"), ["country"]).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_nearest_key(spark, seed):
    rng = random.Random(seed)
    asked = [rng.choice([0, 1, 7, rng.randrange(50), rng.randrange(100_000)]) for _ in range(200)]
    known = [rng.choice([0, 10, rng.randrange(60), rng.randrange(120_000)]) for _ in range((30, 1, 200)[seed])]
    frame = lambda values: spark.createDataFrame([(v,) for v in [*values, None]], "size long")
    got = {r["size"]: r["nearest"] for r in nearest(frame(asked), frame(known), "size").collect()}
    assert got == {a: min(known, key=lambda k: (abs(k - a), k)) for a in asked}
    plan = nearest(frame(asked), frame(known), "size")._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "collect_list" not in plan


def test_nearest_key_without_any(spark):
    empty = spark.createDataFrame([], "size long")
    some = spark.createDataFrame([(3,)], "size long")
    assert [tuple(r) for r in nearest(some, empty, "size").collect()] == [(3, None)]
    assert nearest(empty, some, "size").count() == 0


def scans_of(frame):
    """File scans of the executed plan; one that is reused counts once."""
    frame.collect()
    return len(metric_of(frame, "FileSourceScan"))


def test_validation_scans_the_survey_once(spark, tmp_path):
    path = str(tmp_path / "survey")
    rows = [("a", "x", 30), ("a", "x", 30), ("b", None, 150), (None, "y", 20), ("a", "x!", None)]
    spark.createDataFrame(rows, "a string, b string, age int").write.parquet(path)
    survey = spark.read.parquet(path)
    bench = spark.createDataFrame([("a", "x", 0.5), ("q", "r", 0.5)], "a string, b string, population_share double")
    deep = quality.check_survey_deep(survey)
    assert scans_of(deep) == 1
    found = {(r["check"], r["column"]): r["value"] for r in deep.collect()}
    assert found["duplicate_rows", None] == pytest.approx(20.0)
    assert found["unusual_characters", "b"] == 1 and found["implausible_age", "age"] == 1
    pair = quality.check_pair(survey, bench, AB)
    assert scans_of(pair) == 1
    assert {tuple(r) for r in deep.collect()} <= {tuple(r) for r in pair.collect()}
    # One of the survey's two whole strata, so no finding about the overlap; with other keys there is.
    assert not [r for r in pair.collect() if r["source"] == "pair"]
    apart = quality.check_pair(survey, bench.withColumn("a", F.lit("other")), AB).where("source = 'pair'").collect()
    assert [(r["check"], r["value"]) for r in apart] == [("no_overlap", 0.0)]
    nothing = quality.check_pair(survey.where("age > 999"), bench, AB).collect()
    assert {r["check"] for r in nothing if r["source"] != "A × B"} == {"empty", "no_overlap"}


def test_flags_of_many_columns(spark):
    """More findings than fit one number of bits."""
    columns = [f"c{i}" for i in range(70)]
    row = [("!" if i % 7 == 0 else None if i % 5 == 0 else "fine") for i in range(70)]
    frame = spark.createDataFrame([tuple(row)] * 3, ", ".join(f"{c} string" for c in columns))
    found = {(r["check"], r["column"]) for r in quality.check_survey_deep(frame).collect()}
    assert {c for k, c in found if k == "unusual_characters"} == {f"c{i}" for i in range(0, 70, 7)}
    assert {c for k, c in found if k == "all_null"} == {f"c{i}" for i in range(0, 70, 5) if i % 7}


def test_strata_whose_names_run_together_have_their_own_variances(spark):
    keys = [("p × q", "r"), ("p", "q × r")]
    bench = spark.createDataFrame([("A × B", a, b, 0.5) for a, b in keys], "dimension string, a string, b string, population_share double")
    people = spark.createDataFrame([(1, *keys[0])] * 3 + [(1, *keys[1]), (2, *keys[1])], "wave int, a string, b string")
    lookup = variance.keyed_lookup([(AB, spark.createDataFrame([(*keys[0], 0.1), (*keys[1], 0.6)], "a string, b string, variance double"))])
    rows = scores.with_weights(line_up(cell_counts(people, ["a", "b"]), bench, [AB]), [AB], lookup).collect()
    assert {(r["a"], r["b"]): r["reliability"] for r in rows} == {keys[0]: pytest.approx(0.9), keys[1]: pytest.approx(0.4)}
    cells = cell_counts(people, ["a", "b"], ["wave"])
    sparse = {r["wave"]: r["weighted_score"] for r in scores.scorecard(cells, bench, [AB], ["wave"], lookup).collect()}
    aligned = scores.with_weights(line_up(cells, bench, [AB], ["wave"], targets=True), [AB], lookup)
    dense = {r["wave"]: r["weighted_score"] for r in scores.all_scores(aligned, ["wave"]).collect()}
    assert sparse == {w: pytest.approx(v) for w, v in dense.items()}
    renamed = variance.for_dimensions(lookup.withColumn("dimension", F.lit("A x B")), [AB])
    assert sorted(map(tuple, renamed.select("dimension", "a", "b", "variance").collect())) == sorted(("A × B", *k, v) for k, v in zip(keys, (0.1, 0.6)))
    with pytest.raises(ValueError):
        scores.with_weights(bench, [AB], lookup.select("dimension", "variance"))


def test_poll_columns_send_few_values(spark):
    frame = spark.range(50_000).select(
        (F.col("id") % 3).alias("three"), (F.col("id") % 20).alias("twenty"), (F.col("id") % 21).alias("too many"),
        F.concat(F.lit("text "), F.col("id")).alias("free"), F.lit("x").alias("one"), F.lit(None).cast("string").alias("none"),
    )
    found = variance.poll_columns(frame)
    assert {r["column"]: r["answers"] for r in found.collect()} == {"three": 3, "twenty": 20}
    moved = metric_of(found, "ShuffleExchange", "shuffleRecordsWritten")
    tasks, columns = 8, 6
    assert moved and max(moved) <= tasks * columns * variance.SLOTS < 50_000 * columns
