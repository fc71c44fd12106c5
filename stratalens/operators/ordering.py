"""Ranks and running sums over whole tables without a single-task window.

A window without partitions sends everything to one task. Here rows are range-partitioned by the
sort order into slices, slice totals (one row per slice and group) give each slice its start,
and the window runs inside the slices. The sliced rows are written to the shared checkpoint
folder first, so slice borders stay what they were even if executors are lost.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.operators.strata import join_groups
from stratalens.session import materialize


#: Slices of a group whose first rows are too many for Spark's own limit.
SLICES = 256


def running_totals(
    frame: DataFrame,
    order: Sequence[Column],
    value: str | None = None,
    by: Sequence[str] = (),
    rank: str = "rank",
    total: str = "running",
) -> DataFrame:
    """Add ``rank`` (from 1) and, with ``value``, the running sum ``total`` in ``order`` within ``by``.

    ``order`` must be a total order (end it with the key columns), otherwise ties are arbitrary.
    """
    sliced = materialize(
        frame.repartitionByRange(*[F.col(c).asc() for c in by], *order).withColumn("_slice", F.spark_partition_id())
    )
    measured = F.col(value) if value else F.lit(0.0)
    slices = sliced.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_rows"), F.sum(measured).alias("_mass"))
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.select(
        *by,
        "_slice",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
        F.coalesce(F.sum("_mass").over(earlier), F.lit(0.0)).alias("_mass_before"),
    )
    inside = Window.partitionBy(*by, "_slice").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = join_groups(sliced, starts, [*by, "_slice"]).withColumn(rank, (F.row_number().over(inside) + F.col("_rows_before")).cast("long"))
    if value:
        counted = counted.withColumn(total, F.sum(measured).over(upto) + F.col("_mass_before"))
    return counted.drop("_slice", "_rows_before", "_mass_before")


def first_rows(frame: DataFrame, order: Sequence[Column], count: int, by: Sequence[str] = (), rank: str = "rank") -> DataFrame:
    """The first ``count`` rows per group with their rank.

    Without groups this is a sorted limit, which keeps ``count`` rows per task before anything
    moves; with groups Spark limits every group per task before its shuffle. It does so up to a
    count set in the session; beyond it, the first rows are picked within slices of each group first, so
    that no task sorts a whole group.
    """
    if not by:
        frame = frame.orderBy(*order).limit(count)
    elif count > int(frame.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        slices = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in frame.columns]), F.lit(SLICES))
        local = F.row_number().over(Window.partitionBy(*by, "_slice").orderBy(*order))
        frame = frame.withColumn("_slice", slices).withColumn("_local", local).where(F.col("_local") <= count)
        frame = frame.drop("_slice", "_local")
    window = Window.partitionBy(*by).orderBy(*order)
    return frame.withColumn(rank, F.row_number().over(window).cast("long")).where(F.col(rank) <= count)


def quantiles(frame: DataFrame, by: Sequence[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """``by`` and the exact, linearly interpolated quantiles ``wanted`` (name: part of 1) of each group; nulls do not count.

    Equal values are counted first, in the tasks that read them. Running counts over the slices of all values give each
    value the places it takes, so at most two rows a quantile are picked and no task meets all values of a group.
    """
    counted = frame.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_totals(counted, [F.col("_value")], "_n", by, rank="_rank", total="_upto")
    sizes = placed.groupBy(*by).agg(F.sum("_n").alias("_size"))
    placed = join_groups(placed, sizes, by) if by else placed.withColumn("_size", placed.agg(F.sum("_n")).scalar())
    here = lambda at: (F.col("_upto") > at) & (F.col("_upto") - F.col("_n") <= at)
    at = {name: F.lit(float(part)) * (F.col("_size") - 1) for name, part in wanted.items()}
    picked = placed.where(reduce(lambda a, b: a | b, [here(f(a)) for a in at.values() for f in (F.floor, F.ceil)]))
    ends = [F.max(F.when(here(f(a)), F.col("_value"))).alias(f"_{end}_{name}") for name, a in at.items() for end, f in (("low", F.floor), ("high", F.ceil))]
    found = picked.groupBy(*by, "_size").agg(*ends)
    between = {n: F.col(f"_low_{n}") + (F.col(f"_high_{n}") - F.col(f"_low_{n}")) * (a - F.floor(a)) for n, a in at.items()}
    return found.select(*by, *[column.alias(name) for name, column in between.items()])


def nearest(asked: DataFrame, known: DataFrame, key: str, name: str = "nearest", fine: int = 16) -> DataFrame:
    """Every different ``key`` of ``asked`` with the closest one of ``known``, the smaller of two equally close. Keys are whole
    numbers from 0 up; null has none.

    Both sides' keys meet in buckets of their order. Within a bucket, windows carry the last smaller and the next larger known key; the
    first and last known key of each bucket are handed over to the buckets around it (a bounded number: ``fine`` for each doubling).
    """
    bucket = F.floor(F.log2(F.col(key).cast("double") + 1) * fine).cast("int").alias("_bucket")
    mark = lambda frame, flag: frame.where(F.col(key).isNotNull()).select(key, bucket, F.lit(flag).alias("_known"))
    points = mark(asked, False).unionByName(mark(known, True)).groupBy("_bucket", key).agg(
        F.bool_or("_known").alias("_known"), F.bool_or(~F.col("_known")).alias("_asked")
    )
    borders = points.groupBy("_bucket").agg(F.min(F.when(F.col("_known"), F.col(key))).alias("_first"), F.max(F.when(F.col("_known"), F.col(key))).alias("_last"))
    order = Window.orderBy("_bucket")  # one row a bucket
    borders = borders.select(
        "_bucket",
        F.max("_last").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.min("_first").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    inside = Window.partitionBy("_bucket").orderBy(key)
    here = F.when(F.col("_known"), F.col(key))
    carried = points.select(
        "_bucket",
        key,
        "_asked",
        F.max(here).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_smaller"),
        F.min(here).over(inside.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("_larger"),
    )
    met = carried.where("_asked").join(borders, "_bucket")
    below, above = F.coalesce("_smaller", "_before"), F.coalesce("_larger", "_after")
    close = F.when(above.isNull() | (F.col(key) - below <= above - F.col(key)), below).otherwise(above)
    return met.select(key, close.alias(name))
