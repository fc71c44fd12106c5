"""Comparing surveys, waves and category sets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalens.functions.expressions import banded, ratio
from stratalens.operators.ordering import first_rows
from stratalens.operators.strata import Dimension, join_groups

# Alignment cut-offs with the advice given for each.
ALIGNMENT_ADVICE = [
    (0.95, "Excellent alignment. Ready for analysis."),
    (0.80, "Good alignment. Consider mapping unmapped categories or excluding them."),
    (0.60, "Moderate alignment. Review unmapped categories and update segment mappings."),
]
POOR_ALIGNMENT = "Poor alignment. Significant mapping work needed before analysis."


def wave_changes(scores: DataFrame, wave: str = "wave", score: str = "match_score") -> DataFrame:
    """Score per dimension and wave with the change to the wave before."""
    order = Window.partitionBy("dimension").orderBy(wave)
    before = F.lag(score).over(order)
    return scores.select(
        "dimension", wave, score, (F.col(score) - before).alias("change"), (ratio(F.col(score) - before, before) * 100).alias("change_pct")
    )


def overall_trend(scores: DataFrame, wave: str = "wave", score: str = "match_score") -> DataFrame:
    """First and last wave per dimension, difference, percent and direction."""
    ends = scores.groupBy("dimension").agg(
        F.count(F.lit(1)).alias("waves"), F.min_by(score, wave).alias("first_score"), F.max_by(score, wave).alias("last_score")
    )
    gain = F.col("last_score") - F.col("first_score")
    return ends.withColumns(
        {
            "trend": gain,
            "trend_pct": ratio(gain, F.col("first_score")) * 100,
            "direction": F.when(F.round(gain, 12) > 0, "Positive").otherwise("Negative"),
        }
    )


def leave_one_out(scores: DataFrame, survey: str = "survey", score: str = "match_score") -> DataFrame:
    """Each survey's score against the mean of the other surveys, per dimension."""
    sums = scores.groupBy("dimension").agg(F.sum(score).alias("_sum"), F.count(score).alias("_count"))
    others = ratio(F.col("_sum") - F.col(score), F.col("_count") - 1)
    return scores.join(sums, "dimension").select(
        survey, "dimension", score, others.alias("others_mean"), (F.col(score) - others).alias("strength")
    )


def strongest_and_weakest(strengths: DataFrame, survey: str = "survey") -> DataFrame:
    value = F.round("strength", 9)
    return strengths.groupBy(survey).agg(
        F.min_by("dimension", F.struct((-value).alias("v"), F.col("dimension"))).alias("strongest"),
        F.max("strength").alias("strongest_by"),
        F.min_by("dimension", F.struct(value.alias("v"), F.col("dimension"))).alias("weakest"),
        F.min("strength").alias("weakest_by"),
    )


def consistency(scores: DataFrame, score: str = "match_score") -> DataFrame:
    """1 minus the relative spread over surveys, per dimension."""
    return scores.groupBy("dimension").agg(
        F.count(F.lit(1)).alias("surveys"), (F.lit(1.0) - ratio(F.stddev_pop(score), F.avg(score))).alias("consistency")
    )


def comparison_table(
    scores: DataFrame,
    dims: Sequence[Dimension],
    survey: str = "survey",
    score: str = "match_score",
    coverage: str = "coverage_score",
    countries: DataFrame | None = None,
) -> DataFrame:
    """One row per survey: participants, averages, gap to a perfect score, score and coverage of every
    dimension, and the number of ``countries`` when a table ``survey, country`` of answers or cells is given."""
    per_dim = [
        F.max(F.when(F.col("dimension") == d.name, F.col(c))).alias(f"{c}: {d.name}") for c in (score, coverage) for d in dims
    ]
    table = scores.groupBy(survey).agg(
        F.max("sample_size").alias("participants"),
        F.avg(score).alias("average_score"),
        F.avg(coverage).alias("average_coverage"),
        (F.lit(1.0) - F.avg(score)).alias("gap_to_perfect"),
        (ratio(F.avg(score), F.max("sample_size")) * 100).alias("score_per_hundred"),
        *per_dim,
    )
    if countries is None:
        return table
    counted = countries.groupBy(survey).agg(F.countDistinct("country").alias("countries"))
    return join_groups(table, counted, [survey], "left")


def comparison_summary(scores: DataFrame, survey: str = "survey", score: str = "match_score") -> DataFrame:
    """Surveys, participants, mean score, best survey and weakest dimension over everything."""
    per_survey = scores.groupBy(survey).agg(F.avg(score).alias("_avg"), F.max("sample_size").alias("_n"))
    by_survey = per_survey.agg(
        F.count(F.lit(1)).alias("surveys"),
        F.sum("_n").alias("participants"),
        F.avg("_avg").alias("mean_score"),
        F.min_by(survey, F.struct((-F.round("_avg", 9)).alias("v"), F.col(survey))).alias("best_survey"),
        F.max("_avg").alias("best_score"),
    )
    per_dim = scores.groupBy("dimension").agg(F.avg(score).alias("_avg"))
    weakest = per_dim.agg(F.min_by("dimension", F.struct(F.round("_avg", 9).alias("v"), F.col("dimension"))).alias("d"))
    return by_survey.withColumn("weakest_dimension", weakest.scalar())


def by_method(scores: DataFrame, methods: Sequence[str], method: str = "method", score: str = "match_score") -> DataFrame:
    """Mean score per dimension with one column per methodology."""
    return scores.groupBy("dimension").pivot(method, list(methods)).agg(F.avg(score))


def by_family(scores: DataFrame, families: DataFrame, score: str = "match_score") -> DataFrame:
    """Average score per family of dimensions (``dimension, family``)."""
    return scores.join(families, "dimension").groupBy("family").agg(
        F.countDistinct("dimension").alias("dimensions"), F.avg(score).alias("average_score")
    )


def stack(tables: Sequence[DataFrame]) -> DataFrame:
    """Scorecards or segment tables under each other; absent columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def _categories(frame: DataFrame, columns: Sequence[str], side: str) -> DataFrame:
    """Distinct ``column, category`` pairs with how often each occurs; combined in every task first."""
    counted = frame.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    text = counted.select("n", *[F.col(c).cast("string").alias(c) for c in columns])
    long = text.unpivot(["n"], list(columns), "column", "category").where("category IS NOT NULL")
    return long.groupBy("column", "category").agg(F.sum("n").alias(side))


def category_pairs(survey: DataFrame, benchmark: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every category of every column with its number of rows on both sides."""
    mine, theirs = _categories(survey, columns, "survey_rows"), _categories(benchmark, columns, "benchmark_rows")
    return mine.join(theirs, ["column", "category"], "full_outer")


def alignment(survey: DataFrame, benchmark: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Categories of the survey that the benchmark knows, per column.

    A column absent on a side is reported in ``missing_in`` with zeros.
    """
    shared = [c for c in columns if c in survey.columns and c in benchmark.columns]
    absent = [
        (c, ", ".join(side for side, frame in (("survey", survey), ("benchmark", benchmark)) if c not in frame.columns))
        for c in columns
        if c not in shared
    ]
    out = None
    if shared:
        pairs = category_pairs(survey, benchmark, shared)
        mine, theirs = F.col("survey_rows").isNotNull(), F.col("benchmark_rows").isNotNull()
        out = pairs.groupBy("column").agg(
            F.count_if(mine).alias("survey_categories"),
            F.count_if(theirs).alias("benchmark_categories"),
            F.count_if(mine & theirs).alias("matched"),
            F.count_if(mine & ~theirs).alias("unmatched"),
        ).withColumn("coverage", F.coalesce(ratio("matched", "survey_categories"), F.lit(0.0)))
        out = out.withColumn("missing_in", F.lit(None).cast("string"))
    if absent:
        rows = survey.sparkSession.createDataFrame(absent, "column string, missing_in string")
        for name in ("survey_categories", "benchmark_categories", "matched", "unmatched"):
            rows = rows.withColumn(name, F.lit(0).cast("long"))
        rows = rows.withColumn("coverage", F.lit(0.0))
        out = rows if out is None else out.unionByName(rows)
    return out


def unmatched_categories(survey: DataFrame, benchmark: DataFrame, columns: Sequence[str], first: int = 5) -> DataFrame:
    """The first few categories per column, in alphabetic order, that the benchmark does not know."""
    lost = category_pairs(survey, benchmark, columns).where("survey_rows IS NOT NULL AND benchmark_rows IS NULL")
    return first_rows(lost, [F.col("category")], first, ["column"]).select("column", "rank", "category", "survey_rows")


def alignment_report(survey: DataFrame, benchmark: DataFrame, dims: Sequence[Dimension]) -> DataFrame:
    """Mean coverage, number of incomplete columns and advice per dimension.

    Dimensions with columns the survey lacks are reported as skipped.
    """
    spark = survey.sparkSession
    able = [d for d in dims if all(c in survey.columns for c in d.columns)]
    skipped = [(d.name, "skipped", f"Missing columns in survey data: {list(d.columns)}") for d in dims if d not in able]
    out = None
    if able:
        columns = list(dict.fromkeys(c for d in able for c in d.columns))
        stats = alignment(survey, benchmark, columns)
        wanted = F.explode(F.array(*[F.struct(F.lit(d.name).alias("dimension"), F.lit(c).alias("column")) for d in able for c in d.columns]))
        members = spark.range(1).select(wanted.alias("m")).select("m.dimension", "m.column")
        joined = members.join(stats, "column")
        out = joined.groupBy("dimension").agg(
            F.avg("coverage").alias("overall_alignment"), F.count_if(F.col("coverage") < 1.0).alias("issues")
        )
        advice = banded(F.round("overall_alignment", 12), ALIGNMENT_ADVICE, POOR_ALIGNMENT)
        out = out.withColumn("status", F.lit("complete")).withColumn("recommendation", advice)
    if skipped:
        rows = spark.createDataFrame(skipped, "dimension string, status string, recommendation string")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def overlap(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Every value of ``column`` on either side with where it occurs: only left, only right, both."""
    a = left.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_left", F.lit(True))
    b = right.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_right", F.lit(True))
    where = F.when(F.col("_right").isNull(), "only left").when(F.col("_left").isNull(), "only right").otherwise("both")
    return a.join(b, column, "full_outer").select(column, where.alias("where"))


def strata_overlap(survey: DataFrame, benchmark: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of strata in the survey, in the benchmark, in both, and the survey's part found."""
    mine = survey.select(*columns).na.drop().distinct()
    theirs = benchmark.select(*columns).na.drop().distinct()
    marked = mine.withColumn("_m", F.lit(1)).join(theirs.withColumn("_t", F.lit(1)), list(columns), "full_outer")
    counted = marked.agg(
        F.count("_m").alias("survey_strata"),
        F.count("_t").alias("benchmark_strata"),
        F.count_if(F.col("_m").isNotNull() & F.col("_t").isNotNull()).alias("common_strata"),
    )
    return counted.withColumn("overlap", F.coalesce(ratio("common_strata", "survey_strata"), F.lit(0.0)))


def uncovered(benchmark: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Values of ``column`` that ``known`` lacks, with the population share that goes missing."""
    lost = benchmark.join(known.select(column).distinct(), column, "left_anti")
    return lost.groupBy(column).agg(F.sum("population_share").alias("population_share")).orderBy(
        F.desc(F.round("population_share", 12)), column
    )


def coverage_summary(benchmark: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Mapped and unmapped values and the population share of both."""
    marked = benchmark.join(known.select(column).distinct().withColumn("_known", F.lit(True)), column, "left")
    state = F.when(F.col("_known").isNotNull(), "mapped").otherwise("unmapped")
    per_value = marked.groupBy(state.alias("state"), column).agg(F.sum("population_share").alias("_share"))
    return per_value.groupBy("state").agg(F.count(F.lit(1)).alias("categories"), F.sum("_share").alias("population_share"))
