"""The four representativeness scores and what is derived from them.

match = 1 - half the summed gap between sample and population shares; coverage = part of the
relevant strata with at least one respondent; strategic = match against square-root targets;
weighted = gap averaged with weights population share x standard error x reliability.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.functions.expressions import banded, ratio, standard_error
from stratalens.operators.ordering import nearest
from stratalens.operators.sparse import group_scores
from stratalens.operators.strata import Dimension, as_long, cell_counts, dimension_label, few, join_groups, line_up, look_up_variance

# Rating cut-offs and their names.
QUALITY_CUTS = [(0.8, "Excellent"), (0.6, "Good"), (0.4, "Moderate")]
REPORT_CUTS = [(0.9, "Excellent"), (0.8, "Good"), (0.7, "Fair")]
COVERAGE_CUTS = [(0.9, "High"), (0.7, "Medium")]

# Stand-ins where no stored maximum exists (dimension, match, coverage).
DEFAULT_MAXIMA = [
    ("Country", 0.995, 0.99),
    ("Region × Gender × Age", 0.98, 0.99),
    ("Region × Religion", 0.98, 0.99),
    ("Region × Environment", 0.98, 0.99),
    ("Region", 0.98, 0.99),
    ("Continent", 0.995, 1.0),
    ("Gender", 0.99, 1.0),
    ("Age Group", 0.99, 1.0),
    ("Religion", 0.99, 1.0),
    ("Environment", 0.99, 1.0),
]


def _or_empty(score: Column) -> Column:
    return F.when(F.max("sample_size") > 0, score).otherwise(F.lit(0.0))


def match_of(sample: str = "sample_share", population: str = "population_share") -> Column:
    return F.lit(1.0) - F.lit(0.5) * F.sum(F.abs(F.col(sample) - F.col(population)))


def coverage_of() -> Column:
    relevant = F.count_if(F.col("relevant"))
    return F.when(relevant == 0, F.lit(1.0)).otherwise(
        ratio(F.count_if(F.col("relevant") & (F.col("n") > 0)), relevant)
    )


def weighted_of(weight: str = "weight", without_weight: float = 0.0) -> Column:
    error = ratio(F.sum(F.col(weight) * F.abs(F.col("sample_share") - F.col("population_share"))), F.sum(weight))
    return F.when(F.sum(weight) > 0, F.lit(1.0) - error).otherwise(F.lit(float(without_weight)))


def with_weights(
    aligned: DataFrame,
    dims: Sequence[Dimension],
    variance: DataFrame | None = None,
    unsampled_se: float = 1.0,
    default_variance: float | None = None,
) -> DataFrame:
    """Add ``standard_error``, ``reliability`` and ``weight``.

    ``variance`` has ``dimension, variance`` and the strata's key columns (or their readable name as ``stratum``), and
    may name the survey by the group columns of ``aligned``; strata it does not list get reliability 1, or 1 - ``default_variance`` when that
    is given.
    """
    frame = aligned
    missing = F.lit(1.0 if default_variance is None else 1.0 - default_variance)
    if variance is None:
        frame = frame.withColumn("reliability", missing)
    else:
        frame = frame.withColumn("stratum", dimension_label(dims))
        frame = look_up_variance(frame, variance, "_variance")
        frame = frame.withColumn("reliability", F.coalesce(F.lit(1.0) - F.col("_variance"), missing))
        frame = frame.drop("_variance", "stratum")
    frame = frame.withColumn("standard_error", standard_error(F.col("sample_share"), F.col("n"), unsampled_se))
    return frame.withColumn("weight", F.col("population_share") * F.col("standard_error") * F.col("reliability"))


def match_and_coverage(aligned: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Match and coverage per group and dimension; an empty survey scores 0."""
    return aligned.groupBy(*by, "dimension").agg(
        F.max("sample_size").alias("sample_size"),
        _or_empty(match_of()).alias("match_score"),
        _or_empty(coverage_of()).alias("coverage_score"),
    )


def all_scores(aligned: DataFrame, by: Sequence[str] = (), without_weight: float = 0.0) -> DataFrame:
    """All four scores out of one aggregate; needs ``target_share`` and ``weight``."""
    return aligned.groupBy(*by, "dimension").agg(
        F.max("sample_size").alias("sample_size"),
        F.count(F.lit(1)).alias("strata"),
        F.count_if(F.col("n") > 0).alias("sampled_strata"),
        _or_empty(match_of()).alias("match_score"),
        _or_empty(coverage_of()).alias("coverage_score"),
        _or_empty(match_of(population="target_share")).alias("strategic_score"),
        _or_empty(weighted_of(without_weight=without_weight)).alias("weighted_score"),
    )


def scorecard(
    cells: DataFrame,
    benchmark: DataFrame,
    dims: Sequence[Dimension],
    by: Sequence[str] = (),
    variance: DataFrame | None = None,
    unsampled_se: float = 1.0,
) -> DataFrame:
    """Every score for every dimension and group. Groups are scored from the strata they sampled (see ``sparse``);
    without groups, one join lines up all strata."""
    if by:
        return group_scores(cells, benchmark, dims, by, variance, unsampled_se)
    aligned = line_up(cells, benchmark, dims, by, targets=True)
    return all_scores(with_weights(aligned, dims, variance, unsampled_se), by)


def describe(scores: DataFrame, dims: Sequence[Dimension]) -> DataFrame:
    """Attach each dimension's column list and description."""
    name, text = F.lit(None).cast("array<string>"), F.lit(None).cast("string")
    for d in reversed(dims):
        here = F.col("dimension") == d.name
        name = F.when(here, F.array(*[F.lit(c) for c in d.columns])).otherwise(name)
        text = F.when(here, F.lit(d.description)).otherwise(text)
    return scores.withColumn("dimension_columns", name).withColumn("description", text)


def with_overall(
    scores: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] = (),
    label: str = "Overall (Average)",
    largest: Sequence[str] | None = None,
) -> DataFrame:
    """Append the row of averages; missing scores do not count.

    Every row stands for its own dimension and for the average, so the scores are computed once. With ``largest``,
    the other columns stay, and the average row gets the maximum of those named and null for the rest.
    """
    others = [c for c in scores.columns if c not in (*by, "dimension", *columns)] if largest is not None else []
    doubled = scores.select(
        *by, F.explode(F.array(F.col("dimension"), F.lit(label))).alias("_row"), "dimension", *columns, *others
    )
    own = F.col("_row") == F.col("dimension")
    kept = [F.max(F.col(c) if c in largest else F.when(own, F.col(c))).alias(c) for c in others]
    found = doubled.groupBy(*by, F.col("_row").alias("_row")).agg(*[F.avg(c).alias(c) for c in columns], *kept)
    return found.withColumnRenamed("_row", "dimension").select(*by, "dimension", *columns, *others)


def unavailable(dims: Sequence[Dimension], survey_columns: Sequence[str], scores: DataFrame) -> DataFrame:
    """Scores of all configured dimensions: those whose columns are absent keep nulls and an error text."""
    frame = scores.withColumn("error", F.lit(None).cast("string"))
    spark = scores.sparkSession
    lost = [
        (d.name, f"Missing columns: {[c for c in d.columns if c not in survey_columns]}")
        for d in dims
        if any(c not in survey_columns for c in d.columns)
    ]
    if not lost:
        return frame
    rows = spark.createDataFrame(lost, "dimension string, error string")
    return frame.unionByName(rows, allowMissingColumns=True)


def target_shares(benchmark: DataFrame) -> DataFrame:
    """Square-root targets: sqrt(q) over the dimension's sum of sqrt(q)."""
    roots = benchmark.groupBy("dimension").agg(F.sum(F.sqrt("population_share")).alias("root_sum"))
    return (
        benchmark.join(F.broadcast(roots), "dimension")  # one row per dimension
        .withColumn("target_share", ratio(F.sqrt("population_share"), F.col("root_sum")))
        .drop("root_sum")
    )


def strategic_detail(aligned: DataFrame, dims: Sequence[Dimension], by: Sequence[str] = ()) -> DataFrame:
    """One row per stratum behind the strategic score."""
    gap = F.abs(F.col("sample_share") - F.col("target_share"))
    return aligned.select(
        *by,
        "dimension",
        dimension_label(dims).alias("stratum"),
        "population_share",
        "target_share",
        "sample_share",
        F.col("n").alias("sample_count"),
        (F.col("target_share") - F.col("population_share")).alias("target_vs_population"),
        gap.alias("deviation_from_target"),
        F.abs(F.col("sample_share") - F.col("population_share")).alias("deviation_from_population"),
        (gap * 0.5).alias("strategic_contribution"),
    )


def weighted_detail(weighted: DataFrame, dims: Sequence[Dimension], by: Sequence[str] = ()) -> DataFrame:
    """One row per stratum behind the weighted score, with normalised weights."""
    group = [*by, "dimension"]
    totals = few(weighted.groupBy(*group).agg(F.sum("weight").alias("weight_sum")), len(dims), by)
    gap = F.abs(F.col("sample_share") - F.col("population_share"))
    return join_groups(weighted, totals, group).select(
        *group,
        dimension_label(dims).alias("stratum"),
        "population_share",
        "sample_share",
        F.col("n").alias("sample_count"),
        "standard_error",
        "reliability",
        "weight",
        gap.alias("deviation"),
        (F.col("weight") * gap).alias("weighted_contribution"),
        F.coalesce(ratio("weight", "weight_sum"), F.lit(0.0)).alias("normalized_weight"),
    )


def match_beside_weighted(weighted: DataFrame, by: Sequence[str] = (), without_weight: float = 0.0) -> DataFrame:
    """Match and weighted score over the benchmark's own strata, side by side."""
    return weighted.groupBy(*by, "dimension").agg(
        _or_empty(match_of()).alias("match_score"),
        _or_empty(weighted_of(without_weight=without_weight)).alias("weighted_score"),
    )


def agreement_scores(
    aligned: DataFrame, dims: Sequence[Dimension], variance: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Both scores with reliability from agreement variance; unknown strata count as 0.25."""
    weighted = with_weights(aligned, dims, variance, unsampled_se=0.5, default_variance=0.25)
    scores = weighted.where("in_benchmark").groupBy(*by, "dimension").agg(
        _or_empty(match_of()).alias("match_score"),
        _or_empty(weighted_of()).alias("weighted_score"),
        F.count(F.lit(1)).alias("strata"),
    )
    sampled = aligned.groupBy(*by, "dimension").agg(F.count_if(F.col("n") > 0).alias("sampled_strata"))
    spread = variance.groupBy("dimension").agg(F.avg("variance").alias("mean_agreement_variance"))
    return (
        join_groups(scores, sampled, [*by, "dimension"])
        .join(spread, "dimension", "left")
        .withColumn("difference", F.col("weighted_score") - F.col("match_score"))
    )


def mean_improvement(scores: DataFrame) -> DataFrame:
    """Average gain of the weighted over the match score per dimension, over all surveys."""
    return scores.groupBy("dimension").agg(F.avg("difference").alias("improvement"))


def efficiency(score: Column, maximum: Column) -> Column:
    """Part of the attainable score that was reached, at most 1; 0 when nothing is attainable."""
    return F.when(maximum > 0, F.least(F.lit(1.0), ratio(score, maximum))).otherwise(F.lit(0.0))


def with_percent_of_max(scores: DataFrame, maxima: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Join ``max_match, max_coverage`` by dimension and express the scores in percent of them."""
    return join_groups(scores, maxima, [*by, "dimension"], "left").withColumns(
        {
            "match_pct_of_max": ratio("match_score", "max_match") * 100,
            "coverage_pct_of_max": ratio("coverage_score", "max_coverage") * 100,
        }
    )


def nearest_maxima(sizes: DataFrame, maxima: DataFrame) -> DataFrame:
    """For each survey the stored maxima of the sample size closest to its own.

    ``sizes`` has ``survey, sample_size``; ``maxima`` has ``dimension, size, max_match,
    max_coverage``. Ties go to the smaller size.
    """
    close = nearest(sizes, maxima.select(F.col("size").alias("sample_size")), "sample_size", "size")
    return sizes.join(close, "sample_size").join(maxima, "size").select(
        "survey", "sample_size", "dimension", F.col("size").alias("size_used"), "max_match", "max_coverage"
    )


def attainable(sizes: DataFrame, maxima: DataFrame) -> DataFrame:
    """Nearest stored maxima, and the fixed stand-ins for dimensions without any."""
    found = nearest_maxima(sizes, maxima)
    row = lambda d, m, c: F.struct(F.lit(d).alias("dimension"), F.lit(m).alias("max_match"), F.lit(c).alias("max_coverage"))
    stand_ins = sizes.select("survey", "sample_size", F.explode(F.array(*[row(*r) for r in DEFAULT_MAXIMA])).alias("d"))
    stand_ins = stand_ins.select("survey", "sample_size", "d.dimension", F.col("sample_size").alias("size_used"), "d.max_match", "d.max_coverage")
    lacking = stand_ins.join(found.select("survey", "dimension"), ["survey", "dimension"], "left_anti")
    return found.select("survey", "dimension", "size_used", "max_match", "max_coverage").unionByName(
        lacking.select("survey", "dimension", F.col("size_used").cast("long").alias("size_used"), "max_match", "max_coverage")
    )


def rating(score: Column) -> Column:
    return banded(score, QUALITY_CUTS, "Poor")


def report_rating(score: Column) -> Column:
    return banded(score, REPORT_CUTS, "Poor")


def coverage_rating(score: Column) -> Column:
    return banded(score, COVERAGE_CUTS, "Low")


def per_hundred(score: Column, size: Column) -> Column:
    """Score bought per hundred respondents."""
    return ratio(score, size) * 100


def match_score(survey: DataFrame, benchmark: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Match, coverage and sample size for one list of columns (the everyday entry point)."""
    dim = Dimension(" × ".join(columns), tuple(columns))
    return match_and_coverage(line_up(cell_counts(survey, columns), as_long(benchmark, dim), [dim]))
