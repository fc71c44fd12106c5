"""What score a sample of a given size can reach, and how much it varies from sample to sample.

The best attainable score is exact (largest-remainder rounding), not simulated. Where replicates
are wanted they are rows of one table, drawn from key hashes instead of a random generator, so
every retry of a task and every engine draws the same numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.functions.expressions import ratio, standard_error
from stratalens.operators.allocation import with_sizes
from stratalens.operators.ordering import quantiles, running_totals
from stratalens.operators.reshape import auto_simplify, keep_listed_countries
from stratalens.operators.scores import coverage_of, match_of, scorecard
from stratalens.operators.strata import Dimension, cell_counts, dimension_label, few, join_groups, key_columns
from stratalens.session import materialize

SIZE = ["dimension", "size"]


def _numbers(count: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))


def normalised(benchmark: DataFrame) -> DataFrame:
    """Shares divided by their sum per dimension, where that sum is not 1."""
    # Fixed value: sums within a millionth of 1 are taken as 1.
    sums = benchmark.groupBy("dimension").agg(F.sum("population_share").alias("_sum"))
    joined = benchmark.join(F.broadcast(sums), "dimension")  # one row per dimension
    off = F.abs(F.col("_sum") - 1.0) > 1e-6
    scaled = F.when(off, ratio("population_share", "_sum")).otherwise(F.col("population_share"))
    return joined.withColumn("population_share", scaled).drop("_sum")


def best_allocation(benchmark: DataFrame, dims: Sequence[Dimension], sizes: Sequence[int]) -> DataFrame:
    """Whole counts closest to the shares: rounded down, then one more for the largest remainders."""
    strata = with_sizes(normalised(benchmark).withColumn("stratum", dimension_label(dims)), sizes)
    ideal = F.round(F.col("size") * F.col("population_share"), 9)
    floored = strata.select(
        *SIZE, "stratum", "population_share", F.floor(ideal).alias("_floor"), F.round(ideal - F.floor(ideal), 9).alias("_rest")
    )
    ranked = running_totals(floored, [F.desc("_rest"), F.col("stratum")], by=SIZE)
    given = few(ranked.groupBy(*SIZE).agg(F.sum("_floor").alias("_given")), len(dims) * len(sizes))
    extra = F.when(F.col("rank") <= F.col("size") - F.col("_given"), 1).otherwise(0)
    return ranked.join(given, SIZE).select(*SIZE, "stratum", "population_share", (F.col("_floor") + extra).cast("long").alias("n"))


def _relevance(frame: DataFrame) -> DataFrame:
    return frame.withColumn("sample_share", ratio("n", "size")).withColumn(
        "relevant", F.col("population_share") > ratio(F.lit(1.0), F.col("size"))
    )


def max_scores(allocation: DataFrame) -> DataFrame:
    """Best attainable match per dimension and size, with the coverage of that allocation."""
    return _relevance(allocation).groupBy(*SIZE).agg(
        F.count(F.lit(1)).alias("strata"),
        F.count_if("relevant").alias("relevant_strata"),
        match_of().alias("max_match"),
        coverage_of().alias("max_coverage"),
    )


def size_curve(benchmark: DataFrame, dims: Sequence[Dimension], sizes: Sequence[int]) -> DataFrame:
    return max_scores(best_allocation(benchmark, dims, sizes))


def first_size_reaching(curve: DataFrame, target: float) -> DataFrame:
    """Smallest size whose best score reaches ``target``, and the size before the first gain below 0.01."""
    # Fixed value: a gain below 0.01 counts as diminishing.
    order = Window.partitionBy("dimension").orderBy("size")
    gains = curve.withColumn("_gain", F.round(F.col("max_match") - F.lag("max_match").over(order), 9)).withColumn(
        "_before", F.lag("size").over(order)
    )
    return gains.groupBy("dimension").agg(
        F.min(F.when(F.round("max_match", 9) >= target, F.col("size"))).alias("size_reaching_target"),
        F.min(F.when(F.col("_gain") < 0.01, F.col("_before"))).alias("diminishing_after"),
        F.max("max_match").alias("best_match"),
    )


def replicate_statistics(scores: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Mean, population deviation, range and linearly interpolated quartiles over replicates."""
    moments = scores.groupBy(*group).agg(
        F.count(F.lit(1)).alias("replicates"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    middle = quantiles(scores, group, value, {"median": 0.5, "q25": 0.25, "q75": 0.75})
    return join_groups(moments, middle, group, "left")


def _drawn(survey: DataFrame, respondent: str, columns: Sequence[str], replicates: int) -> DataFrame:
    """Every respondent once per replicate with a random text to order by, and the bucket of that text: 16 for
    each doubling of its first 48 bits, so that few draws lie beyond any wanted number in its bucket."""
    keyed = survey.select(respondent, *columns).withColumn("replicate", F.explode(_numbers(replicates)))
    keyed = keyed.withColumn("_draw", F.md5(F.concat_ws("|", F.col(respondent).cast("string"), F.col("replicate").cast("string"))))
    lead = F.conv(F.substring("_draw", 1, 12), 16, 10).cast("double")
    return keyed.withColumn("_bucket", F.floor(F.log2(lead + 1) * 16).cast("int"))


def subsamples(survey: DataFrame, respondent: str, columns: Sequence[str], sizes: Sequence[int], replicates: int) -> DataFrame:
    """Random sub-samples without replacement: per replicate the respondents with the smallest draw.

    The k-th smallest draw is found by counting. Draws are counted by bucket in the tasks (some hundred numbers a
    replicate), running counts name the bucket that holds the k-th draw and how many of it are wanted, and only draws up to that bucket are
    kept: little more than ``size`` a replicate, however many respondents there are. Ranks are given within buckets,
    which hold a small part of a replicate each. A survey smaller than a size is taken whole.
    """
    drawn = _drawn(survey, respondent, columns, replicates)
    counts = drawn.groupBy("replicate", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("replicate").orderBy("_bucket"))  # at most 769 buckets
    wanted = F.explode(F.array(*[F.lit(int(s)).cast("long") for s in sizes]))
    reached = counts.withColumn("_upto", upto).withColumn("size", wanted)
    # The bucket that reaches the size; without one, all of them.
    edge = F.coalesce(F.min(F.when(F.col("_upto") >= F.col("size"), F.col("_bucket"))), F.max("_bucket"))
    before = F.coalesce(F.max(F.when(F.col("_upto") < F.col("size"), F.col("_upto"))), F.lit(0))
    edges = reached.groupBy("replicate", "size").agg(edge.alias("edge"), (F.col("size") - before).alias("wanted"))
    edges = edges.groupBy("replicate").agg(F.collect_list(F.struct("size", "edge", "wanted")).alias("_edges"))  # one entry a size
    near = drawn.join(few(edges, replicates), "replicate").where(F.col("_bucket") <= F.array_max(F.transform("_edges", lambda e: e["edge"])))
    place = F.row_number().over(Window.partitionBy("replicate", "_bucket").orderBy("_draw", respondent))
    sized = near.withColumn("_place", place).withColumn("_edge", F.explode("_edges"))
    inside = F.col("_bucket") < F.col("_edge.edge")
    last = (F.col("_bucket") == F.col("_edge.edge")) & (F.col("_place") <= F.col("_edge.wanted"))
    return sized.where(inside | last).select(F.col("_edge.size").alias("size"), "replicate", respondent, *columns)


def subsample_scores(
    survey: DataFrame,
    respondent: str,
    benchmark: DataFrame,
    dims: Sequence[Dimension],
    sizes: Sequence[int],
    replicates: int,
    mode: str = "none",
    listed: DataFrame | None = None,
) -> DataFrame:
    """Scorecards of replicated sub-samples of several sizes, and of the whole survey once (size 0).

    With ``mode="auto"`` the benchmark is simplified for each sub-sample size first; with ``mode="listed"`` the
    country dimension keeps the countries of ``listed`` and folds the others. All sizes and
    replicates are groups of one job.
    """
    columns = key_columns(dims)
    group = ["size", "replicate"]
    zero = F.lit(0).cast("long")
    whole = cell_counts(survey, columns).withColumn("size", zero).withColumn("replicate", zero)
    drawn = subsamples(survey, respondent, columns, sizes, replicates)
    cells = materialize(cell_counts(drawn, columns, group).unionByName(whole))
    if mode == "auto":
        totals = cells.groupBy(*group).agg(F.sum("n").alias("sample_size")).groupBy("size").agg(F.max("sample_size").alias("sample_size"))
        bars = totals.select("size", F.explode(F.array(*[F.lit(d.name) for d in dims])).alias("dimension"), "sample_size")
        benchmark = auto_simplify(benchmark, dims, bars, ["size"])
    elif mode == "listed":
        if listed is None:
            raise ValueError("name the countries to keep")
        benchmark = keep_listed_countries(benchmark, dims, listed)
    elif mode != "none":
        raise ValueError("mode is 'none', 'auto' or 'listed'")
    return scorecard(cells, benchmark, dims, group)


def expected_coverage(benchmark: DataFrame, sizes: Sequence[int], counts: Sequence[int] = (1, 2)) -> DataFrame:
    """Expected part of the strata with at least 1 (or 2) respondents in a random sample, exactly."""
    if not set(counts) <= {1, 2}:
        raise ValueError("at least 1 or 2 respondents")
    sized = with_sizes(benchmark, sizes).withColumn("at_least", F.explode(F.array(*[F.lit(c).cast("long") for c in counts])))
    q, n = F.col("population_share"), F.col("size").cast("double")
    none = F.pow(F.lit(1.0) - q, n)
    single = n * q * F.pow(F.lit(1.0) - q, n - 1)
    hit = F.when(F.col("at_least") == 1, F.lit(1.0) - none).otherwise(F.lit(1.0) - none - single)
    return sized.groupBy(*SIZE, "at_least").agg(
        F.count(F.lit(1)).alias("strata"), F.sum(hit).alias("expected_strata"), F.avg(hit).alias("expected_coverage")
    )


def sensitivity(aligned: DataFrame, dim: Dimension, stratum: str, counts: Sequence[int]) -> DataFrame:
    """Match and weighted score when one stratum had 0, 1, 2, … respondents instead of its own."""
    named = aligned.where("in_benchmark").withColumn("stratum", dimension_label([dim]))
    varied = named.withColumn("override", F.explode(F.array(*[F.lit(int(c)).cast("long") for c in counts])))
    here = F.col("stratum") == stratum
    own = varied.groupBy("override").agg(F.sum(F.when(here, F.col("n")).otherwise(0)).alias("_own"))
    varied = varied.join(own, "override").withColumn("n", F.when(here, F.col("override")).otherwise(F.col("n")))
    varied = varied.withColumn("sample_size", F.col("sample_size") - F.col("_own") + F.col("override"))
    varied = varied.withColumn("sample_share", ratio("n", "sample_size"))
    weight = F.col("population_share") * standard_error(F.col("sample_share"), F.col("n"), 1.0)
    gap = F.abs(F.col("sample_share") - F.col("population_share"))
    return varied.groupBy("override").agg(
        match_of().alias("match_score"), (F.lit(1.0) - ratio(F.sum(weight * gap), F.sum(weight))).alias("weighted_score")
    )
