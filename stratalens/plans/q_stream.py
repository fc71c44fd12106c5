"""The event table as an arriving survey: streams, and the same per window on the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.operators.strata import Dimension, population_shares
from stratalens.plans import sqltext as q
from stratalens.plans.registry import query
from stratalens.session import scratch_path
from stratalens.streaming import live

TYPE = Dimension("Type", ("event_type",))
TYPE_LEVEL = Dimension("Type × Level", ("event_type", "level"))
DIMS = (TYPE_LEVEL, TYPE)
SQL_DIMS = [("Type × Level", ("event_type", "level")), ("Type", ("event_type",))]
KEYS = ("event_type", "level")

# Arriving respondents are measured against all events.
EVENTS = """answers AS (SELECT ts, strftime(ts, '%Y-%m-%d') AS "window", event_type, CASE WHEN value > 10 THEN 'high' ELSE 'low' END AS level FROM events)"""


def answers(frame):
    return frame.select("ts", "event_type", F.when(F.col("value") > 10, "high").otherwise("low").alias("level"))


def arriving(t):
    """The event file as a stream."""
    batch = t.read("events")
    stream = t.spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    return answers(stream)


def event_benchmark(t):
    return population_shares(answers(t.read("events")), DIMS)


BY_WINDOW = q.lined_up(SQL_DIMS, KEYS, survey="answers", base="answers", by=('"window"',))


@query(
    "windowed_match",
    f"""WITH {EVENTS}, {BY_WINDOW}
SELECT "window", dimension, max(size) AS sample_size, {q.r(q.MATCH, "match_score")}, {q.r(q.COVERAGE, "coverage_score")} FROM aligned GROUP BY "window", dimension""",
)
def windowed_match(t):
    """Each day's events against all events."""
    cells = live.windowed_cells(answers(t.read("events")), "ts", ["event_type", "level"])
    return live.windowed_scores(cells, population_shares(cells, DIMS, F.col("n")), DIMS)


@query(
    "cumulative_match",
    f"""WITH raw AS (SELECT strftime(ts, '%Y-%m-%d') AS d, event_type, CASE WHEN value > 10 THEN 'high' ELSE 'low' END AS level FROM events),
days AS (SELECT DISTINCT d AS "window" FROM raw), base AS (SELECT event_type, level FROM raw),
answers AS (SELECT "window", event_type, level FROM days JOIN raw ON raw.d <= days."window"),
{q.lined_up(SQL_DIMS, KEYS, survey="answers", base="base", by=('"window"',))}
SELECT "window", dimension, max(size) AS sample_size, {q.r(q.MATCH, "match_score")}, {q.r(q.COVERAGE, "coverage_score")} FROM aligned GROUP BY "window", dimension""",
)
def cumulative_match(t):
    """Everything up to each day against all events."""
    cells = live.windowed_cells(answers(t.read("events")), "ts", ["event_type", "level"])
    bench = population_shares(cells.where("n > 0"), DIMS, F.col("n"))
    return live.windowed_scores(live.to_date(cells, ["event_type", "level"]), bench, DIMS)


@query(
    "stream_counts",
    """WITH w AS (SELECT date_trunc('day', ts) AS s, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT strftime(s, '%Y-%m-%d') AS window_start, event_type, n FROM w
WHERE s + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
)
def stream_counts(t):
    """A stream with watermark: days are written once they are closed, the last one stays open."""
    out = scratch_path(t.spark, "counts")
    counts = live.windowed_counts(arriving(t), "ts", ["event_type"])
    live.run_windowed_counts(counts, out, scratch_path(t.spark, "counts-checkpoint")).awaitTermination()
    written = t.spark.read.schema(counts.schema).parquet(out)
    return written.select(F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "event_type", "n")


@query(
    "stream_snapshot",
    f"""WITH {EVENTS}, {q.lined_up(SQL_DIMS, KEYS, survey="answers", base="answers")}
SELECT dimension, max(size) AS sample_size, {q.r(q.MATCH, "match_score")}, {q.r(q.COVERAGE, "coverage_score")} FROM aligned GROUP BY dimension""",
)
def stream_snapshot(t):
    """Scores written after every micro-batch; the last snapshot covers the whole stream."""
    state, out = scratch_path(t.spark, "state"), scratch_path(t.spark, "snapshots")
    checkpoint = scratch_path(t.spark, "snapshot-checkpoint")
    live.follow_scores(arriving(t), event_benchmark(t), DIMS, state, out, checkpoint).awaitTermination()
    snapshots = t.spark.read.parquet(out)
    last = snapshots.agg(F.max("batch").alias("batch"))
    return snapshots.where(F.col("batch") == last.scalar()).drop("batch")
