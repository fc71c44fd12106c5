"""Distributing a future sample over the strata.

All functions work on several dimensions and several sample sizes at once; a size is a column,
added with ``with_sizes``, so nothing is joined without a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.functions.expressions import ratio
from stratalens.operators.strata import Dimension, dimension_label, few, look_up_variance

# Fixed value: variance of a yes/no answer at its largest, used where none is known.
DEFAULT_VARIANCE = 0.25
GROUP = ["dimension", "size"]


def with_sizes(benchmark: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """One copy of every stratum per planned sample size."""
    return benchmark.withColumn("size", F.explode(F.array(*[F.lit(int(s)).cast("long") for s in sizes])))


def with_variance(strata: DataFrame, variance: DataFrame | None, default: float = DEFAULT_VARIANCE) -> DataFrame:
    """Variance per stratum from a lookup (``look_up_variance``), else the default."""
    if variance is None:
        return strata.withColumn("variance", F.lit(default))
    looked_up = look_up_variance(strata, variance, "_known")
    return looked_up.withColumn("variance", F.coalesce("_known", F.lit(default))).drop("_known")


def neyman(
    benchmark: DataFrame, dims: Sequence[Dimension], sizes: Sequence[int], variance: DataFrame | None = None
) -> DataFrame:
    """Optimal allocation: share x standard deviation, rounded half to even; the rounding
    difference goes to the largest stratum (first by name among equals)."""
    strata = with_variance(benchmark.withColumn("stratum", dimension_label(dims)), variance)
    weighed = with_sizes(strata, sizes).withColumn("_w", F.col("population_share") * F.sqrt("variance"))
    pairs = len(dims) * len(sizes)
    sums = few(weighed.groupBy(*GROUP).agg(F.sum("_w").alias("_sum")), pairs)
    ideal = F.round(F.col("size") * ratio("_w", "_sum"), 9)
    rounded = weighed.join(sums, GROUP).withColumn("n", F.coalesce(F.bround(ideal), F.lit(0)).cast("long"))
    largest = rounded.groupBy(*GROUP).agg(
        F.sum("n").alias("_given"),
        F.min_by("stratum", F.struct((-F.col("n")).alias("n"), F.col("stratum"))).alias("_largest"),
    )
    residue = F.when(F.col("stratum") == F.col("_largest"), F.col("size") - F.col("_given")).otherwise(F.lit(0))
    return rounded.join(few(largest, pairs), GROUP).select(
        *GROUP, "stratum", "population_share", "variance", (F.col("n") + residue).cast("long").alias("optimal_n")
    )


def proportional_beside_strategic(targets: DataFrame, dims: Sequence[Dimension], sizes: Sequence[int]) -> DataFrame:
    """Rounded proportional and square-root allocations, their difference and the boost."""
    sized = with_sizes(targets.withColumn("stratum", dimension_label(dims)), sizes)
    plain = F.bround(F.round(F.col("size") * F.col("population_share"), 9)).cast("long")
    strategic = F.bround(F.round(F.col("size") * F.col("target_share"), 9)).cast("long")
    return sized.select(
        *GROUP,
        "stratum",
        (F.col("population_share") * 100).alias("population_pct"),
        plain.alias("proportional_n"),
        strategic.alias("strategic_n"),
        (strategic - plain).alias("difference"),
        ratio("target_share", "population_share").alias("boost"),
    )


def proportional_beside_optimal(optimal: DataFrame) -> DataFrame:
    """Truncated proportional counts next to the optimal ones, with difference and change."""
    plain = (F.col("size") * F.col("population_share")).cast("long")
    change = F.when(plain > 0, ratio(F.col("optimal_n") - plain, plain) * 100).otherwise(F.lit(0.0))
    return optimal.select(
        *GROUP,
        "stratum",
        "population_share",
        "variance",
        plain.alias("proportional_n"),
        "optimal_n",
        (F.col("optimal_n") - plain).alias("difference"),
        change.alias("pct_change"),
    )


def efficiency_gain(compared: DataFrame) -> DataFrame:
    """Reduction of the summed sampling variance by the optimal allocation."""

    def spread(count: str):
        return F.sum(
            F.when(F.col(count) > 0, ratio(F.pow("population_share", F.lit(2.0)) * F.col("variance"), F.col(count)))
        )

    return compared.groupBy(*GROUP).agg(
        spread("proportional_n").alias("variance_proportional"), spread("optimal_n").alias("variance_optimal")
    ).withColumn(
        "efficiency_gain", ratio(F.col("variance_proportional") - F.col("variance_optimal"), F.col("variance_proportional"))
    )


def beside_actual(compared: DataFrame, aligned: DataFrame, dims: Sequence[Dimension]) -> DataFrame:
    """Planned allocations next to what the survey really has per stratum."""
    actual = aligned.select("dimension", dimension_label(dims).alias("stratum"), F.col("n").alias("actual_n"))
    return compared.join(actual, ["dimension", "stratum"], "left").select(
        *GROUP, "stratum", "proportional_n", "optimal_n", F.coalesce("actual_n", F.lit(0)).cast("long").alias("actual_n")
    )
