"""Which strata cause the gap, how large the gain of fixing them is, and lists built on that."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.functions.expressions import ratio, tagged_label
from stratalens.operators.ordering import first_rows, running_totals
from stratalens.operators.strata import Dimension, dimension_label, join_groups

# Deviations within this distance of zero count as balanced.
BALANCED = 0.001
# Fixed value: benchmark shares below this are left out of contributor lists.
MIN_BENCHMARK_SHARE = 0.0001


def deviations(aligned: DataFrame, denominator: str = "keyed") -> DataFrame:
    """Signed, absolute and relative gap per stratum.

    ``denominator="keyed"`` divides by respondents that have every key of the dimension (needs
    ``line_up(..., keyed=True)``); ``"rows"`` keeps the shares over all respondents. The relative gap is null where the
    benchmark share is zero.
    """
    if denominator == "keyed":
        frame = aligned.withColumn("sample_share", F.col("keyed_share")).drop("keyed_share")
    elif denominator == "rows":
        frame = aligned
    else:
        raise ValueError("denominator is 'keyed' or 'rows'")
    gap = F.col("sample_share") - F.col("population_share")
    return (
        frame.withColumn("deviation", gap)
        .withColumn("abs_deviation", F.abs(gap))
        .withColumn("relative_deviation", ratio(gap, F.col("population_share")))
        .withColumn("tvd_share", F.abs(gap) / 2)
    )


def representation(deviation: Column) -> Column:
    """Three-way label; the lower border itself is *under*, the upper border *balanced*."""
    return F.when(deviation <= -BALANCED, "under").when(deviation <= BALANCED, "balanced").otherwise("over")


def category_table(aligned: DataFrame, dims: Sequence[Dimension], by: Sequence[str] = ()) -> DataFrame:
    """Points, ratios and five-way category for every benchmark stratum."""
    gap = F.col("sample_share") - F.col("population_share")
    pct = F.when(
        F.col("population_share") > 0, (ratio("sample_share", "population_share") - 1) * 100
    ).when(F.col("n") == 0, F.lit(0.0))
    # A benchmark share of zero that was sampled is infinitely over-represented: null here.
    over = pct.isNull()
    category = (
        F.when(F.col("n") == 0, "Missing")
        .when(over | (pct > 50), "Highly Over-represented")
        .when(pct > 0, "Over-represented")
        .when(pct > -50, "Under-represented")
        .otherwise("Highly Under-represented")
    )
    names = None
    for d in dims:
        here = F.col("dimension") == d.name
        names = F.when(here, tagged_label(d.columns)) if names is None else names.when(here, tagged_label(d.columns))
    return aligned.where("in_benchmark").select(
        *by,
        "dimension",
        names.alias("stratum"),
        F.col("n").alias("sample_count"),
        "population_share",
        "sample_share",
        gap.alias("signed_deviation"),
        F.abs(gap).alias("absolute_deviation"),
        (F.abs(gap) / 2 * 100).alias("contribution_points"),
        (gap * 100).alias("deviation_points"),
        ratio("sample_share", "population_share").alias("representation_ratio"),
        pct.alias("over_under_pct"),
        category.alias("category"),
    )


def top_contributors(
    gaps: DataFrame,
    dims: Sequence[Dimension],
    count: int = 10,
    side: str = "both",
    min_benchmark: float = MIN_BENCHMARK_SHARE,
    by: Sequence[str] = (),
) -> DataFrame:
    """Strata with the largest absolute gap per dimension, with running total variation."""
    frame = gaps.where(F.col("population_share") >= min_benchmark)
    if side == "over":
        frame = frame.where("deviation > 0")
    elif side == "under":
        frame = frame.where("deviation < 0")
    elif side != "both":
        raise ValueError("side is 'over', 'under' or 'both'")
    frame = frame.withColumn("segment", dimension_label(dims)).withColumn("representation", representation(F.col("deviation")))
    group = [*by, "dimension"]
    top = first_rows(frame, [F.desc(F.round("abs_deviation", 12)), F.col("segment")], count, group)
    upto = Window.partitionBy(*group).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return top.withColumn("cumulative_tvd", F.sum("tvd_share").over(upto)).select(
        *group, "rank", "segment", "sample_share", "population_share", "deviation", "abs_deviation",
        "relative_deviation", "tvd_share", "representation", "cumulative_tvd",
    )


def dimension_totals(categories: DataFrame, top: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Segments, represented, missing and contribution per dimension, and that of its top segments."""
    group = [*by, "dimension"]
    order = [F.desc(F.round("contribution_points", 9)), F.col("stratum")]
    best = first_rows(categories, order, top, group).groupBy(*group).agg(F.sum("contribution_points").alias("top_contribution"))
    totals = (
        categories.groupBy(*group)
        .agg(
            F.count(F.lit(1)).alias("segments"),
            F.count_if(F.col("sample_count") > 0).alias("represented"),
            F.count_if(F.col("sample_count") == 0).alias("missing"),
            F.sum("contribution_points").alias("total_contribution"),
        )
    )
    return join_groups(totals, best, group)


def fix_impact(top: DataFrame, scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Score after fixing the listed segments one after the other; never above 1."""
    group = [*by, "dimension"]
    return join_groups(top, scores.select(*group, "match_score"), group).select(
        *group,
        "rank",
        "segment",
        F.col("tvd_share").alias("individual_impact"),
        F.least(F.lit(1.0), F.col("match_score") + F.col("cumulative_tvd")).alias("cumulative_score"),
    )


def fix_summary(top: DataFrame, scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Current and potential score per dimension; the percentage is null when the score is 0."""
    group = [*by, "dimension"]
    gain = top.groupBy(*group).agg(F.sum("tvd_share").alias("gain"))
    potential = F.least(F.lit(1.0), F.col("match_score") + F.coalesce("gain", F.lit(0.0)))
    return join_groups(scores, gain, group, "left").select(
        *group,
        F.col("match_score").alias("current_score"),
        potential.alias("potential_score"),
        (potential - F.col("match_score")).alias("improvement"),
        (ratio(potential - F.col("match_score"), F.col("match_score")) * 100).alias("improvement_pct"),
    )


def cumulative_gaps(gaps: DataFrame, dims: Sequence[Dimension], by: Sequence[str] = ()) -> DataFrame:
    """All strata by falling gap with their running total variation."""
    named = gaps.withColumn("segment", dimension_label(dims))
    order = [F.desc(F.round("abs_deviation", 12)), F.col("segment")]
    return running_totals(named, order, "tvd_share", [*by, "dimension"], total="cumulative_tvd")


def segments_to_target(cumulative: DataFrame, targets: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Rank of the first segment at which each target is reached; null when it never is."""
    group = [*by, "dimension"]
    wanted = F.explode(F.array(*[F.lit(float(t)) for t in targets])).alias("target")
    reached = F.round("cumulative_tvd", 9) >= F.col("target")
    return cumulative.select(*group, "rank", "cumulative_tvd", wanted).groupBy(*group, "target").agg(
        F.min(F.when(reached, F.col("rank"))).alias("segments_needed")
    )


def parent_roll_up(gaps: DataFrame, parent: str, count: int, by: Sequence[str] = ()) -> DataFrame:
    """Gaps summed up to one key column, largest first, with over/under status."""
    summed = gaps.groupBy(*by, parent).agg(
        F.sum("sample_share").alias("sample_share"), F.sum("population_share").alias("population_share")
    )
    gap = F.round(F.col("sample_share") - F.col("population_share"), 12)
    summed = summed.withColumn("deviation", gap).withColumn("status", F.when(gap > 0, "Over").otherwise("Under"))
    return first_rows(summed, [F.desc(F.abs("deviation")), F.col(parent)], count, by)


def distribution(cells_long: DataFrame, column: str, count: int) -> DataFrame:
    """The most frequent sample categories with their benchmark share beside them."""
    known = cells_long.where("n > 0")
    return first_rows(known, [F.desc("n"), F.col(column)], count).select(
        "rank", column, "n", "sample_share", F.when(F.col("in_benchmark"), F.col("population_share")).alias("population_share")
    )


def recruitment_list(categories: DataFrame, count: int, by: Sequence[str] = ()) -> DataFrame:
    """Most under-represented strata over all dimensions with the points they lack."""
    lacking = categories.where("signed_deviation < 0").withColumn("points_needed", -F.col("deviation_points"))
    order = [F.desc(F.round("points_needed", 9)), F.col("dimension"), F.col("stratum")]
    return first_rows(lacking, order, count, by).select(*by, "rank", "dimension", "stratum", "category", "points_needed")


def over_and_under(gaps: DataFrame, dims: Sequence[Dimension], count: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """The most over- and the most under-represented strata per dimension."""
    named = gaps.withColumn("segment", dimension_label(dims)).withColumn(
        "side", F.when(F.col("deviation") > 0, "over").when(F.col("deviation") < 0, "under")
    )
    order = [F.desc(F.round("abs_deviation", 12)), F.col("segment")]
    picked = first_rows(named.where("side IS NOT NULL"), order, count, [*by, "dimension", "side"])
    return picked.select(*by, "dimension", "side", "rank", "segment", "deviation")


def segment_statistics(gaps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of over-, under- and well-represented strata and the size of the gaps."""
    return gaps.groupBy(*by, "dimension").agg(
        F.count(F.lit(1)).alias("segments"),
        F.count_if(F.col("sample_share") > 0).alias("represented"),
        F.avg("abs_deviation").alias("mean_abs_deviation"),
        F.max("abs_deviation").alias("max_abs_deviation"),
        F.count_if(F.col("deviation") > BALANCED).alias("over"),
        F.count_if(F.col("deviation") < -BALANCED).alias("under"),
        F.count_if(F.abs("deviation") <= BALANCED).alias("balanced"),
    )


def weight_shift(plain: DataFrame, informed: DataFrame, dims: Sequence[Dimension], by: Sequence[str] = ()) -> DataFrame:
    """Normalised weights without and with variance, and each stratum's part of the weighted error."""
    on = [*by, "dimension", "stratum"]
    errors = informed.groupBy(*by, "dimension").agg(F.sum("weighted_contribution").alias("_error"))
    with_variance = informed.select(*on, F.col("normalized_weight").alias("weight_informed"), "weighted_contribution")
    both = join_groups(plain.select(*on, F.col("normalized_weight").alias("weight_plain")), with_variance, on)
    return join_groups(both, errors, [*by, "dimension"]).select(
        *on,
        "weight_plain",
        "weight_informed",
        (F.col("weight_informed") - F.col("weight_plain")).alias("weight_change"),
        (F.coalesce(ratio("weighted_contribution", "_error"), F.lit(0.0)) * 100).alias("error_share_pct"),
    )


def boosted(targets: DataFrame, dims: Sequence[Dimension], count: int) -> DataFrame:
    """Strata that square-root targets raise the most over their population share."""
    named = targets.withColumn("stratum", dimension_label(dims)).withColumn(
        "boost", ratio("target_share", "population_share")
    )
    order = [F.desc(F.round("boost", 9)), F.col("stratum")]
    return first_rows(named, order, count, ["dimension"]).select(
        "dimension", "rank", "stratum", "population_share", "target_share", "boost"
    )


def dimension_extremes(scores: DataFrame, count: int = 3, score: str = "match_score", by: Sequence[str] = ()) -> DataFrame:
    """Best and worst dimensions, with flags for those below 0.8 and 0.5."""
    # Below 0.8 a dimension needs attention, below 0.5 it is critical.
    value = F.round(score, 9)
    best = first_rows(scores, [F.desc(value), F.col("dimension")], count, by).withColumn("end", F.lit("top"))
    worst = first_rows(scores, [F.asc(value), F.col("dimension")], count, by).withColumn("end", F.lit("bottom"))
    return best.unionByName(worst).select(
        *by, "end", "rank", "dimension", score, (F.col(score) < 0.8).alias("needs_attention"), (F.col(score) < 0.5).alias("critical")
    )


def score_gap(scores: DataFrame, score: str = "match_score", by: Sequence[str] = ()) -> DataFrame:
    """Best and worst dimension by name, and the distance between them."""
    value = F.round(score, 9)
    return scores.groupBy(*by).agg(
        F.min_by("dimension", F.struct(-value, F.col("dimension"))).alias("best"),
        F.min_by("dimension", F.struct(value, F.col("dimension"))).alias("worst"),
        (F.max(score) - F.min(score)).alias("gap"),
    )


def detail_order(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Detail tables sorted by falling population share, keys breaking ties."""
    return table.orderBy(F.desc("population_share"), *columns)
