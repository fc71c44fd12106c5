"""Following scores while respondents are still arriving."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratalens.operators.scores import match_and_coverage
from stratalens.operators.sparse import group_scores
from stratalens.operators.strata import Dimension, cell_counts, join_groups, key_columns, line_up
from stratalens.session import materialize


def windowed_counts(stream: DataFrame, ts: str, keys: Sequence[str], width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Respondents per stratum and event-time window; rows later than ``delay`` are left out.

    Works on a stream (append mode: a window is emitted once it can no longer change) and, without
    the watermark's effect, on a table.
    """
    return (
        stream.withColumn(ts, F.col(ts).cast("timestamp"))
        .withWatermark(ts, delay)
        .groupBy(F.window(ts, width).alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")
    )


def run_windowed_counts(counts: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    writer = counts.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def runs_until(batch: int) -> list[tuple[int, int]]:
    """First and last batch of the runs that hold batches 0 to ``batch``: the powers of two that make up their number."""
    runs, first = [], 0
    for size in (1 << k for k in reversed(range((batch + 1).bit_length()))):
        if (batch + 1) & size:
            runs.append((first, first + size - 1))
            first += size
    return runs


def _run_path(state: str, run: tuple[int, int]) -> str:
    return f"{state}/run={run[0]}-{run[1]}"


def _stored_runs(spark: SparkSession, state: str) -> list[tuple[int, int]]:
    """The fewest stored runs that cover all batches so far."""
    names = spark.read.parquet(state).select(F.col("run").cast("string")).distinct().collect()  # one row a run
    stored = [tuple(map(int, row["run"].split("-"))) for row in names]
    chosen, first = [], 0
    while following := [run for run in stored if run[0] == first]:
        chosen.append(max(following, key=lambda run: run[1]))
        first = chosen[-1][1] + 1
    return chosen


def counts_so_far(spark: SparkSession, state: str, batch: int | None = None) -> DataFrame:
    """Cell counts after ``batch``, by default after the last one. At most one run for each binary digit of the
    number of batches is read."""
    runs = _stored_runs(spark, state) if batch is None else runs_until(batch)
    rows = spark.read.parquet(*[_run_path(state, run) for run in runs])
    return rows.groupBy(*[c for c in rows.columns if c != "n"]).agg(F.sum("n").alias("n"))


def snapshot(
    spark: SparkSession, state: str, benchmark: DataFrame, dims: Sequence[Dimension], batch: int | None = None
) -> DataFrame:
    """Scores over everything counted so far (or up to ``batch``)."""
    return match_and_coverage(line_up(counts_so_far(spark, state, batch).select(*key_columns(dims), "n"), benchmark, dims))


def keep_counts(dims: Sequence[Dimension], state: str, after: Callable[[SparkSession, int], None] | None = None):
    """A micro-batch sink that keeps cell counts as runs of batches which are merged when they double.

    Batch k writes its own counts only, unless the runs before it are as long as it would become: those are merged into it. So a count
    is written again no more often than the number of batches doubles, and what a batch writes follows the batch, not all that was
    counted. Runs are named by their batches and the runs they were made of stay: a batch that is run again overwrites
    its own run from the same sources, nothing is counted twice, and the counts after any earlier batch can still be read.
    ``after`` is called when the counts are stored, for example to write a snapshot.
    """
    keys = key_columns(dims)

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        counts = cell_counts(batch, keys)
        own = runs_until(batch_id)[-1]
        parts = [run for run in (runs_until(batch_id - 1) if batch_id else []) if run[0] >= own[0]]
        if parts:
            before = spark.read.parquet(*[_run_path(state, run) for run in parts]).select(*keys, "n")
            counts = counts.unionByName(before).groupBy(*keys).agg(F.sum("n").alias("n"))
        counts.write.mode("overwrite").parquet(_run_path(state, own))
        if after is not None:
            after(spark, batch_id)

    return sink


def follow_scores(
    stream: DataFrame,
    benchmark: DataFrame,
    dims: Sequence[Dimension],
    state: str,
    scores: str,
    checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Write a score snapshot after every micro-batch, from counts accumulated in ``state``.

    The benchmark is computed once and written to the shared folder.
    """
    benchmark = materialize(benchmark)

    def publish(spark: SparkSession, batch_id: int) -> None:
        snapshot(spark, state, benchmark, dims, batch_id).write.mode("overwrite").parquet(f"{scores}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(keep_counts(dims, state, publish)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def compact_counts(spark: SparkSession, state: str, out: str, dims: Sequence[Dimension]) -> None:
    """All counts of a stream that has ended (or pauses) as a single run in another folder."""
    last = _stored_runs(spark, state)[-1][1]
    counts_so_far(spark, state).select(*key_columns(dims), "n").write.mode("overwrite").parquet(_run_path(out, (0, last)))


def windowed_cells(table: DataFrame, ts: str, keys: Sequence[str], unit: str = "day") -> DataFrame:
    """Cell counts per calendar window; the window is a text such as ``2024-01-31``."""
    day = F.date_format(F.date_trunc(unit, ts), "yyyy-MM-dd").alias("window")
    return table.select(day, *keys).groupBy("window", *keys).agg(F.count(F.lit(1)).alias("n"))


#: Leading characters of a window's name that slice the calendar: months, for days.
SLICE_CHARS = 7


def numbered_windows(cells: DataFrame) -> DataFrame:
    """``window, at``: the windows in the order of their names, numbered from 1, one row each.

    They are ranked within slices of the calendar and moved up by the windows of the slices before. Rows without a
    window have no number. The filter is always true and keeps this and other uses of ``cells`` on one exchange.
    """
    windows = cells.where("n > 0").select("window").distinct().withColumn("_slice", F.substring("window", 1, SLICE_CHARS))
    sizes = windows.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))  # one row a slice
    starts = sizes.select("_slice", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_slice").orderBy("window"))
    place = F.when(F.col("window").isNotNull(), inside + F.col("_before")).cast("int")
    return join_groups(windows, starts, ["_slice"]).select("window", place.alias("at"))


def to_date(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cumulative cell counts at the end of every window.

    A stratum's running count holds from its window until its next one. Both are numbers, so what is shuffled for a row is the two
    ends of its interval, whatever the length of the calendar; the interval is spelled out last, and its numbers
    get their windows' names back.
    """
    numbers = numbered_windows(cells)
    order = Window.partitionBy(*keys).orderBy("at")
    running = join_groups(cells, numbers, ["window"]).where("at IS NOT NULL").select(
        "at",
        *keys,
        F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("n"),
        F.lead("at").over(order).alias("_next"),
    )
    last = numbers.agg(F.max("at")).scalar()
    held = running.select(F.explode(F.sequence("at", F.coalesce(F.col("_next") - 1, last))).alias("at"), *keys, "n")
    return held.join(numbers, "at").select("window", *keys, "n")


def windowed_scores(cells: DataFrame, benchmark: DataFrame, dims: Sequence[Dimension]) -> DataFrame:
    """Match and coverage per window, for plain or cumulative cells."""
    card = group_scores(cells, benchmark, dims, ["window"], weighted=False)
    return card.select("window", "dimension", "sample_size", "match_score", "coverage_score")
