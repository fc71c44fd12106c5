from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stratalens import Dimension
from stratalens.operators.scores import match_and_coverage
from stratalens.operators.strata import as_long, cell_counts, line_up
from stratalens.streaming import live

DIM = Dimension("Country", ("country",))
SCHEMA = "ts timestamp, country string"
START = datetime(2024, 1, 1)


def at(hours, country):
    return (START + timedelta(hours=hours), country)


class Arrivals:
    """Respondents arriving in files, one micro-batch each."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.count = spark, str(folder / "in"), 0

    def add(self, *rows):
        self.count += 1
        frame = self.spark.createDataFrame(list(rows), SCHEMA).coalesce(1)
        frame.write.mode("append").parquet(self.folder)

    def stream(self):
        return self.spark.readStream.schema(SCHEMA).parquet(self.folder)


@pytest.fixture
def arrivals(spark, tmp_path):
    return Arrivals(spark, tmp_path)


def test_late_rows_are_left_out_and_open_windows_wait(spark, tmp_path, arrivals):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        counts = live.windowed_counts(arrivals.stream(), "ts", ["country"], "1 day", "1 hour")
        live.run_windowed_counts(counts, out, checkpoint).awaitTermination()
        return spark.read.schema(counts.schema).parquet(out)

    arrivals.add(at(1, "A"), at(2, "A"), at(3, "B"))
    assert run().count() == 0  # the first day is still open
    arrivals.add(at(30, "A"))  # closes the first day
    run()
    arrivals.add(at(4, "B"), at(60, "A"))  # the first row is too late
    got = {(r["window_start"].day, r["country"]): r["n"] for r in run().collect()}
    assert got == {(1, "A"): 2, (1, "B"): 1, (2, "A"): 1}


def test_snapshots_follow_the_stream(spark, tmp_path, arrivals, benchmark_of):
    bench = as_long(benchmark_of(["country"], ("A", 0.5), ("B", 0.5)), DIM)
    state, scores, checkpoint = (str(tmp_path / name) for name in ("state", "scores", "cp"))

    def run():
        live.follow_scores(arrivals.stream(), bench, [DIM], state, scores, checkpoint).awaitTermination()
        return {r["batch"]: (r["sample_size"], r["match_score"]) for r in spark.read.parquet(scores).collect()}

    arrivals.add(at(0, "A"), at(1, "A"))
    assert run() == {0: (2, pytest.approx(0.5))}
    arrivals.add(at(2, "B"), at(3, "B"))
    assert run() == {0: (2, pytest.approx(0.5)), 1: (4, pytest.approx(1.0))}
    arrivals.add(at(4, "A"))
    assert run()[2] == (5, pytest.approx(0.9))
    arrivals.add(at(5, "B"), at(6, "B"))
    assert run()[3][0] == 7
    # Each batch holds the running counts: reading one folder is enough, and none grows with the stream.
    assert live.counts_so_far(spark, state, 1).agg(F.sum("n")).first()[0] == 4
    assert live.counts_so_far(spark, state).agg(F.sum("n")).first()[0] == 7
    live.compact_counts(spark, state, str(tmp_path / "compact"), [DIM])
    assert live.snapshot(spark, str(tmp_path / "compact"), bench, [DIM]).first()["sample_size"] == 7


def test_repeated_batch_counts_once(spark, tmp_path):
    batch = spark.createDataFrame([at(0, "A"), at(1, "B")], SCHEMA)
    sink = live.keep_counts([DIM], str(tmp_path / "state"))
    for _ in range(2):
        sink(batch, 0)
    assert spark.read.parquet(str(tmp_path / "state")).agg(F.sum("n")).first()[0] == 2


def test_cumulative_windows(spark, benchmark_of):
    rows = [at(1, "A"), at(2, "A"), at(50, "B"), at(51, "B"), at(80, "A")]
    table = spark.createDataFrame(rows, SCHEMA)
    cells = live.windowed_cells(table, "ts", ["country"])
    bench = as_long(benchmark_of(["country"], ("A", 0.5), ("B", 0.5)), DIM)
    daily = {r["window"]: r["match_score"] for r in live.windowed_scores(cells, bench, [DIM]).collect()}
    assert daily == {"2024-01-01": pytest.approx(0.5), "2024-01-03": pytest.approx(0.5), "2024-01-04": pytest.approx(0.5)}
    so_far = {r["window"]: (r["sample_size"], r["match_score"]) for r in live.windowed_scores(live.to_date(cells, ["country"]), bench, [DIM]).collect()}
    assert so_far == {"2024-01-01": (2, pytest.approx(0.5)), "2024-01-03": (4, pytest.approx(1.0)), "2024-01-04": (5, pytest.approx(0.9))}
    whole = match_and_coverage(line_up(cell_counts(table, ["country"]), bench, [DIM])).first()
    assert so_far["2024-01-04"][1] == pytest.approx(whole["match_score"])
