"""Scores of many groups against a benchmark they share, without producing every stratum for every group.

A group of respondents meets few of the benchmark's strata. Only those are joined; all the others have no respondent, and
what they add to a score depends on the benchmark alone. With s and q the sample and population shares,

    sum |s - q| = sum over sampled strata of (|s - q| - q), plus the sum of all q

and likewise for square-root targets and for weights. The rows produced are the sampled strata and one row per
group and dimension, whatever the number of strata times groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.functions.expressions import ratio, standard_error
from stratalens.operators.strata import (
    Dimension,
    dimension_label,
    few,
    join_groups,
    key_columns,
    look_up_variance,
    roll_up,
    same_keys,
    sample_sizes,
)

#: Buckets per halving of a share in the index of shares.
FINE = 1024
#: What is left of a sum after taking off its parts counts as rounding below this part of it.
ROUNDING = 1e-12


def _rest(whole: Column, part: Column, open_strata: Column) -> Column:
    """``whole - part``: nothing without strata left over, or where only rounding is left."""
    rest = F.coalesce(whole, F.lit(0.0)) - F.coalesce(part, F.lit(0.0))
    return F.when((open_strata > 0) & (rest > F.coalesce(whole, F.lit(0.0)) * ROUNDING), rest).otherwise(F.lit(0.0))


def count_above(values: DataFrame, bars: DataFrame, by: Sequence[str], value: str, bar: str, name: str = "above") -> DataFrame:
    """``by``, ``bar`` and how many ``value`` of the same group lie above it, for every different bar; both are above zero.

    An index of shares: values and bars meet in buckets of a thousandth of a halving, where a bar counts the values before it. Running
    counts over the buckets (a bounded number for each group) add what lies in higher ones.
    """
    place = [*by, "_bucket"]
    points = values.select(*by, F.col(value).alias("_at"), F.lit(1).alias("_n"))
    points = points.unionByName(bars.select(*by, F.col(bar).alias("_at"), F.lit(0).alias("_n"))).where("_at > 0")
    points = points.withColumn("_bucket", F.floor(F.log2("_at") * FINE).cast("int")).repartition(*place)
    # One row for equal values, and one for equal bars; a bar stands before the values it equals.
    points = points.groupBy(*place, "_at", (F.col("_n") == 0).alias("_asked")).agg(F.sum("_n").alias("_n"))
    ladder = points.groupBy(*place).agg(F.sum("_n").alias("_n"))
    higher = Window.partitionBy(*by).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    ladder = ladder.select(*place, F.coalesce(F.sum("_n").over(higher), F.lit(0)).alias("_above"))
    inside = Window.partitionBy(*place).orderBy(F.desc("_at"), F.desc("_asked")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    asked = points.withColumn("_n", F.sum("_n").over(inside)).where("_asked")
    found = join_groups(asked, ladder, place)
    return found.select(*by, F.col("_at").alias(bar), (F.col("_n") + F.col("_above")).cast("long").alias(name))


def group_scores(
    cells: DataFrame,
    benchmark: DataFrame,
    dims: Sequence[Dimension],
    by: Sequence[str],
    variance: DataFrame | None = None,
    unsampled_se: float = 1.0,
    threshold: float | None = None,
    weighted: bool = True,
) -> DataFrame:
    """Scores per group and dimension, as :func:`stratalens.operators.scores.scorecard` defines them.

    Columns: ``by, dimension, sample_size, strata, sampled_strata, match_score, coverage_score`` and, with ``weighted``,
    ``strategic_score, weighted_score``. A benchmark with group columns of its own is that of those groups; a variance lookup may
    name groups, too. Groups without respondents have no row, a group without a name is a group.
    """
    keys, group = key_columns(dims), [*by, "dimension"]
    own = [*(c for c in by if c in benchmark.columns), "dimension"]
    expected = benchmark.select(*own, *keys, F.coalesce("population_share", F.lit(0.0)).alias("q"))
    totals = [F.count(F.lit(1)).alias("_strata"), F.sum("q").alias("_q")]
    per_group = None
    if weighted:
        roots = expected.groupBy(*own).agg(F.sum(F.sqrt("q")).alias("_roots"))
        expected = join_groups(expected, few(roots, len(dims), own[:-1]), own, "left")
        expected = expected.withColumn("t", F.coalesce(ratio(F.sqrt("q"), F.col("_roots")), F.lit(0.0))).drop("_roots")
        expected = expected.withColumn("_reliability", F.lit(1.0))
        if variance is not None:
            named = expected.withColumn("stratum", dimension_label(dims))
            groups = [c for c in variance.columns if c in by and c not in own]
            if groups:
                per_group = _weights_by_group(named, variance, own, groups, unsampled_se)
            else:
                found = look_up_variance(named, variance, "_variance")
                expected = found.withColumn("_reliability", F.lit(1.0) - F.coalesce("_variance", F.lit(0.0))).drop("_variance", "stratum")
        alone = F.col("q") * unsampled_se * F.col("_reliability")
        totals += [F.sum("t").alias("_t"), F.sum(alone).alias("_w"), F.sum(alone * F.col("q")).alias("_wq")]
    whole = expected.groupBy(*own).agg(*totals)

    sizes = sample_sizes(cells, dims, by).where("sample_size > 0")
    counts = join_groups(roll_up(cells, dims, "n", by), sizes, group)
    counts = counts.withColumn("s", ratio("n", "sample_size"))
    met = counts.alias("c").join(expected.alias("e"), same_keys("c", "e", [*own, *keys]), "left")
    more = [F.coalesce("e.t", F.lit(0.0)).alias("t"), F.coalesce("e._reliability", F.lit(1.0)).alias("_reliability")] if weighted else []
    met = met.select("c.*", F.coalesce("e.q", F.lit(0.0)).alias("q"), F.col("e.q").isNotNull().alias("_known"), *more)
    if per_group is not None:
        met = look_up_variance(met.withColumn("stratum", dimension_label(dims)), variance, "_variance")
        met = met.withColumn("_reliability", F.lit(1.0) - F.coalesce("_variance", F.lit(0.0)))
    bar = F.lit(float(threshold)) if threshold is not None else ratio(F.lit(1.0), F.col("sample_size"))
    gap, there = F.abs(F.col("s") - F.col("q")), F.col("n") > 0
    sums = [
        F.count(F.lit(1)).alias("_rows"),
        F.count_if("_known").alias("_met"),
        F.count_if(there).alias("_sampled"),
        F.sum(gap).alias("_gap"),
        F.sum("q").alias("_gap_q"),
        F.count_if(there & (F.col("q") > bar)).alias("_covered"),
    ]
    if weighted:
        weight = F.col("q") * standard_error(F.col("s"), F.col("n"), unsampled_se) * F.col("_reliability")
        alone = F.col("q") * unsampled_se * F.col("_reliability")
        sums += [
            F.sum(F.abs(F.col("s") - F.col("t"))).alias("_gap_t"),
            F.sum("t").alias("_met_t"),
            F.sum(weight).alias("_weight"),
            F.sum(weight * gap).alias("_error"),
            F.sum(alone).alias("_met_w"),
            F.sum(alone * F.col("q")).alias("_met_wq"),
        ]
    seen = met.groupBy(*group).agg(*sums)

    card = join_groups(join_groups(sizes, seen, group, "left"), whole, own, "left")
    card = card.where(F.col("_rows").isNotNull() | F.col("_strata").isNotNull())
    if threshold is not None:
        above = expected.groupBy(*own).agg(F.count_if(F.col("q") > threshold).alias("_relevant"))
        card = join_groups(card, above, own, "left")
    else:
        card = card.withColumn("_bar", bar)
        asked = sizes.select(*own, ratio(F.lit(1.0), F.col("sample_size")).alias("_bar"))
        card = join_groups(card, count_above(expected, asked, own, "q", "_bar", "_relevant"), [*own, "_bar"], "left")
    if per_group is not None:
        card = join_groups(card, per_group, [*group_columns(per_group, by), "dimension"], "left")
        card = card.withColumn("_w", F.col("_w") + F.coalesce("_more_w", F.lit(0.0)))
        card = card.withColumn("_wq", F.col("_wq") + F.coalesce("_more_wq", F.lit(0.0)))

    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    left = number("_strata") - number("_met")
    scores = [
        "sample_size",
        (left + number("_rows")).cast("long").alias("strata"),
        number("_sampled").cast("long").alias("sampled_strata"),
        (F.lit(1.0) - F.lit(0.5) * (number("_gap") + _rest(F.col("_q"), F.col("_gap_q"), left))).alias("match_score"),
        F.when(number("_relevant") == 0, F.lit(1.0)).otherwise(ratio(number("_covered"), F.col("_relevant"))).alias("coverage_score"),
    ]
    if weighted:
        mass = number("_weight") + _rest(F.col("_w"), F.col("_met_w"), left)
        error = ratio(number("_error") + _rest(F.col("_wq"), F.col("_met_wq"), left), mass)
        scores += [
            (F.lit(1.0) - F.lit(0.5) * (number("_gap_t") + _rest(F.col("_t"), F.col("_met_t"), left))).alias("strategic_score"),
            F.when(mass > 0, F.lit(1.0) - error).otherwise(F.lit(0.0)).alias("weighted_score"),
        ]
    return card.select(*group, *scores)


def group_columns(frame: DataFrame, by: Sequence[str]) -> list[str]:
    return [c for c in by if c in frame.columns]


def _weights_by_group(named: DataFrame, variance: DataFrame, own: Sequence[str], groups: Sequence[str], unsampled_se: float) -> DataFrame:
    """What the variances of a group's lookup take off the weights of strata that nobody was sampled in.

    Joined per entry of the lookup: strata without an entry have reliability 1 in every group and are not touched.
    """
    shared = [c for c in variance.columns if c in named.columns and c != "variance"]
    listed = variance.select(*shared, *groups).distinct()
    entries = listed.alias("v").join(named.alias("e"), same_keys("v", "e", shared))
    others = [c for c in named.columns if c not in shared]
    entries = entries.select(*[F.col(f"v.{c}") for c in (*shared, *groups)], *[F.col(f"e.{c}") for c in others])
    entries = look_up_variance(entries, variance, "_variance")
    less = -F.col("q") * unsampled_se * F.coalesce("_variance", F.lit(0.0))
    return entries.groupBy(*own, *groups).agg(F.sum(less).alias("_more_w"), F.sum(less * F.col("q")).alias("_more_wq"))
