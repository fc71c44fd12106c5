"""How much respondents of one stratum disagree, from poll answers or agreement rates.

Answers are turned to long form and counted per (stratum, question, answer) first. Scaling and
variance then work on these counts: a hot stratum is combined in the tasks that read it, and what
is shuffled grows with the number of different answers, not with the respondents.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalens.functions.expressions import LABEL_SEPARATOR, banded, ratio
from stratalens.operators.ordering import quantiles
from stratalens.operators.strata import Dimension, dimension_name, few, join_groups, key_columns

# Fixed value: used where a stratum has too few answers.
DEFAULT_VARIANCE = 0.25

# Answers on a scale from 1 to 5 (yes/no kinds from 0 to 1).
FIVE_POINT_SCALE = {
    "Strongly Distrust": 1, "Somewhat Distrust": 2, "Neither Trust Nor Distrust": 3, "Somewhat Trust": 4, "Strongly Trust": 5,
    "Profoundly Worse": 1, "Noticeably Worse": 2, "No Major Change": 3, "Noticeably Better": 4, "Profoundly Better": 5,
    "Risks far outweigh benefits": 1, "Risks slightly outweigh benefits": 2, "Risks and benefits are equal": 3,
    "Benefits slightly outweigh risks": 4, "Benefits far outweigh risks": 5,
    "never": 1, "annually": 2, "monthly": 3, "weekly": 4, "daily": 5,
    "Yes": 1, "No": 0, "Don't Know": 0.5, "Unsure": 0.5, "Agree": 1, "Disagree": 0,
    "More concerned than excited": 1, "Equally concerned and excited": 2, "More excited than concerned": 3,
}

# Answers on a scale from 0 to 1.
UNIT_SCALE = {
    "Strongly Disagree": 0, "Neutral": 0.5, "Strongly Agree": 1, "Disagree": 0, "Agree": 1,
    "Strongly Distrust": 0, "Somewhat Distrust": 0.25, "Neither Trust Nor Distrust": 0.5, "Somewhat Trust": 0.75, "Strongly Trust": 1,
    "Profoundly Worse": 0, "Noticeably Worse": 0.25, "No Major Change": 0.5, "Noticeably Better": 0.75, "Profoundly Better": 1,
    "Risks far outweigh benefits": 0, "Risks slightly outweigh benefits": 0.25, "Risks and benefits are equal": 0.5,
    "Benefits slightly outweigh risks": 0.75, "Benefits far outweigh risks": 1,
    "never": 0, "annually": 0.25, "monthly": 0.5, "weekly": 0.75, "daily": 1,
    "Never": 0, "Rarely": 0.25, "Sometimes": 0.5, "Often": 0.75, "Always": 1,
    "No": 0, "Yes": 1, "Don't Know": 0.5, "Unsure": 0.5,
    "More concerned than excited": 0, "Equally concerned and excited": 0.5, "More excited than concerned": 1,
}

# Participant columns that are never poll questions, and name parts that exclude one.
DEMOGRAPHIC_COLUMNS = (
    "Participant Id", "Sample Provider Id", "How old are you?", "What is your gender?",
    "What best describes where you live?", "What religious group or faith do you most identify with?",
    "What country or region do you most identify with?", "Please select your preferred language:",
    "Muted", "Categories", "Sentiment",
)
EXCLUDED_NAME_PARTS = ("(English)", "(Original)", "(%agree)")
# Name prefixes of indicator questions.
INDICATOR_PREFIXES = ("ai_", "trust_", "impact_", "job_", "automation_")
OPINION_TYPE = "Ask Opinion"

#: Classes of hashes by which columns with many different values are told from closed questions.
SLOTS = 256


def scaled(answer, scale: dict[str, float]):
    """Number for an answer text; null when the scale does not list it."""
    pairs = [part for text, number in scale.items() for part in (F.lit(text), F.lit(float(number)))]
    return F.try_element_at(F.create_map(*pairs), answer)


def indicator_columns(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c.startswith(INDICATOR_PREFIXES)]


def poll_columns(
    frame: DataFrame,
    excluded: Sequence[str] = DEMOGRAPHIC_COLUMNS,
    excluded_parts: Sequence[str] = EXCLUDED_NAME_PARTS,
    least: int = 2,
    most: int = 20,
) -> DataFrame:
    """Columns that look like closed questions: between ``least`` and ``most`` different answers.

    Exact, and a column of free text never sends its texts. Values are told apart by 64 bits of hash. Each task first says which of
    ``SLOTS`` classes of hashes a column meets; more classes than ``most`` mean more answers, and those columns are out. In the columns
    left, few values fall into few classes: each task sends every different one once, and they are counted.
    """
    names = [c for c in frame.columns if c and c not in excluded and not any(p in c for p in excluded_parts)]
    if not names:
        return frame.sparkSession.createDataFrame([], "column string, answers long")
    hashed = frame.select(*[F.when(F.col(f"`{c}`").isNotNull(), F.xxhash64(F.col(f"`{c}`").cast("string"))).alias(c) for c in names])
    long = hashed.unpivot([], [F.col(f"`{c}`") for c in names], "column", "value").where("value IS NOT NULL")
    met = long.groupBy("column", F.pmod("value", F.lit(SLOTS)).alias("_slot")).agg(F.lit(1).alias("_"))
    closed = met.groupBy("column").agg(F.count(F.lit(1)).alias("_slots")).where(F.col("_slots") <= most).select("column")
    left = long.join(few(closed, len(names)), "column", "left_semi")
    seen = left.groupBy("column", "value").agg(F.lit(1).alias("_"))
    return seen.groupBy("column").agg(F.count(F.lit(1)).alias("answers")).where(F.col("answers").between(least, most))


def long_answers(survey: DataFrame, by: Sequence[str], questions: Sequence[str], kind: str) -> DataFrame:
    """Wide question columns as ``question, answer`` rows; missing answers stay as nulls."""
    cast = survey.select(*by, *[F.col(f"`{q}`").cast(kind).alias(q) for q in questions])
    return cast.unpivot(list(by), [F.col(f"`{q}`") for q in questions], "question", "answer")


def question_variances(numeric: DataFrame, by: Sequence[str]) -> DataFrame:
    """Respondents (``_rows``) and the answers' sample variance (``_var``) per stratum and question, answers above 1 scaled to 0..1 first."""
    spread = F.col("_max") - F.col("_min")
    return numeric.groupBy(*by, "question").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.var_samp("answer").alias("_var"),
        F.min("answer").alias("_min"),
        F.max("answer").alias("_max"),
    ).withColumn("_var", F.when(F.col("_max") > 1, F.try_divide(F.col("_var"), spread * spread)).otherwise(F.col("_var")))


def mean_variance(questions: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean of ``question_variances`` over the questions of each group, or the default."""
    return questions.groupBy(*by).agg(
        F.when(F.max("_rows") < 2, F.lit(DEFAULT_VARIANCE)).otherwise(F.coalesce(F.avg("_var"), F.lit(DEFAULT_VARIANCE))).alias("variance")
    )


def within_stratum_variance(numeric: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean over the questions of the answers' sample variance, answers above 1 scaled to 0..1 first.

    ``numeric`` has ``by``, ``question`` and a numeric ``answer``. Scaling is algebra: the
    variance divided by the squared range. A constant answer has no scale and is left out;
    strata with fewer than two respondents, or without any usable question, get the default.
    """
    return mean_variance(question_variances(numeric, by), by)


def variance_by_category(numeric: DataFrame, codes: DataFrame, by: Sequence[str]) -> DataFrame:
    """The same, separately for every question category; ``codes`` has ``question, category``.

    Questions meet their categories as one row a stratum: answers are never shuffled by the few questions.
    """
    return mean_variance(question_variances(numeric, by).join(codes, "question"), ["category", *by])


def answer_counts(answers: DataFrame, by: Sequence[str]) -> DataFrame:
    """Respondents per stratum, question and answer."""
    return answers.groupBy(*by, "question", "answer").agg(F.count(F.lit(1)).alias("n"))


def unit_scores(counts: DataFrame, by: Sequence[str], scale: dict[str, float] = UNIT_SCALE) -> DataFrame:
    """Text answers of closed questions (see ``poll_columns``) on 0..1 within each (stratum, question).

    When more than half of the respondents gave answers the scale does not know and there are 2
    to 10 different ones, they are spread evenly in alphabetic order; a single one counts as 0.5.
    """
    group = Window.partitionBy(*by, "question")
    known = scaled(F.col("answer"), scale)
    totals = counts.withColumn("_known", known).withColumns(
        {
            "_all": F.sum("n").over(group),
            "_lost": F.sum(F.when(F.col("_known").isNull(), F.col("n")).otherwise(0)).over(group),
            "_kinds": F.count("answer").over(group),
            "_place": F.dense_rank().over(group.orderBy(F.asc_nulls_last("answer"))),
        }
    )
    unclear = F.col("_lost") > F.col("_all") * 0.5
    spread = F.when(F.col("answer").isNotNull(), ratio(F.col("_place") - 1, F.col("_kinds") - 1))
    score = (
        F.when(unclear & F.col("_kinds").between(2, 10), spread)
        .when(unclear & (F.col("_kinds") == 1), F.lit(0.5))
        .otherwise(F.col("_known"))
    )
    return totals.select(*by, "question", "answer", "n", score.alias("score"))


def numeric_stratum_variance(numeric: DataFrame, by: Sequence[str]) -> DataFrame:
    """The same result for numeric answers, in one aggregate: values outside 0..1 are min-max
    scaled within (stratum, question), which divides the variance by the squared range."""
    span = F.col("_max") - F.col("_min")
    sums = numeric.groupBy(*by, "question").agg(
        F.count("answer").alias("answers"),
        F.var_samp("answer").alias("_var"),
        F.min("answer").alias("_min"),
        F.max("answer").alias("_max"),
    )
    inside = (F.col("_min") >= 0) & (F.col("_max") <= 1)
    variance = F.when(inside, F.col("_var")).otherwise(F.try_divide(F.col("_var"), span * span))
    found = sums.withColumn("variance", variance).where("answers >= 2 AND variance IS NOT NULL")
    return found.select(*by, "question", "answers", "variance")


def stratum_variance(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sample variance per stratum and question out of scored answer counts; two answers at least."""
    used = F.col("score").isNotNull()
    n = F.col("n").cast("double")
    sums = scores.groupBy(*by, "question").agg(
        F.sum(F.when(used, F.col("n"))).alias("answers"),
        F.sum(F.when(used, n * F.col("score"))).alias("_first"),
        F.sum(F.when(used, n * F.col("score") * F.col("score"))).alias("_second"),
    )
    k = F.col("answers").cast("double")
    variance = ratio(F.col("_second") - F.col("_first") * F.col("_first") / k, k - 1)
    return sums.where("answers >= 2").select(*by, "question", "answers", F.greatest(variance, F.lit(0.0)).alias("variance"))


def variance_summary(variances: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean, median, spread and consensus (1 - mean variance) per stratum over its questions."""
    moments = variances.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_questions"),
        F.avg("variance").alias("mean_variance"),
        F.stddev_pop("variance").alias("std_variance"),
        F.min("variance").alias("min_variance"),
        F.max("variance").alias("max_variance"),
        (F.lit(1.0) - F.avg("variance")).alias("consensus_score"),
    )
    return join_groups(moments, quantiles(variances, by, "variance", {"median_variance": 0.5}), by, "left")


def consensus_comparison(summaries: DataFrame, group: Sequence[str]) -> DataFrame:
    """Consensus per survey and dimension: strata, mean, range and sample deviation."""
    return summaries.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_strata"),
        F.avg("consensus_score").alias("avg_consensus"),
        F.min("consensus_score").alias("min_consensus"),
        F.max("consensus_score").alias("max_consensus"),
        F.stddev_samp("consensus_score").alias("std_consensus"),
    )


def consensus_bands(summaries: DataFrame, variance: str = "mean_variance") -> DataFrame:
    """How many strata agree strongly, somewhat or little, and their mean variance."""
    # Consensus above these is High, Medium, otherwise Low.
    band = banded(F.lit(1.0) - F.col(variance), [(0.8, "High"), (0.6, "Medium")], "Low", strict=True)
    return summaries.groupBy(band.alias("band")).agg(
        F.count(F.lit(1)).alias("strata"), F.avg(variance).alias("mean_variance")
    )


def agreement_rates(aggregate: DataFrame, question: str = "question", kind: str = "question_type") -> DataFrame:
    """Agreement table with one ``code: stratum`` column per stratum holding ``85%`` texts, as long rows."""
    wide = [c for c in aggregate.columns if ": " in c]
    opinions = aggregate.where(F.col(kind) == OPINION_TYPE)
    long = opinions.select(question, *[F.col(f"`{c}`").cast("string").alias(c) for c in wide]).unpivot(
        [question], [F.col(f"`{c}`") for c in wide], "column", "text"
    )
    rate = F.rtrim(F.rtrim("text"), F.lit("%")).try_cast("double") / 100
    return long.select(question, F.regexp_extract("column", ": (.*)$", 1).alias("stratum"), rate.alias("rate"))


def agreement_variance(rates: DataFrame, strata: DataFrame) -> DataFrame:
    """Variance of agreement rates per surveyed stratum; one rate or none gives the default."""
    spread = rates.groupBy("stratum").agg(F.var_samp("rate").alias("variance"))
    return strata.select("stratum").distinct().join(spread, "stratum", "left").select(
        "stratum", F.coalesce("variance", F.lit(DEFAULT_VARIANCE)).alias("variance")
    )


def for_dimensions(variance: DataFrame, dims: Sequence[Dimension]) -> DataFrame:
    """Variances under the names of ``dims``, whatever spelling the lookup uses.

    A dimension is looked up as ``A x B``, then under its own name, then, with a single column,
    under that column's name in title case; the first spelling found is used alone, in each survey
    where the lookup names surveys.
    """
    spellings = []
    for d in dims:
        names = [d.name.replace(LABEL_SEPARATOR, " x "), d.name]
        if len(d.columns) == 1:
            names.append(d.columns[0].title())
        spellings += [(name, d.name, rank) for rank, name in enumerate(dict.fromkeys(names))]
    table = F.explode(F.array(*[F.struct(F.lit(s).alias("spelling"), F.lit(d).alias("name"), F.lit(r).alias("rank")) for s, d, r in spellings]))
    aliases = F.broadcast(variance.sparkSession.range(1).select(table.alias("a")).select("a.*"))  # three rows per dimension at most
    strata = [c for c in variance.columns if c == "stratum" or c in key_columns(dims)]
    surveys = [c for c in variance.columns if c not in ("dimension", "variance", *strata)]
    named = variance.join(aliases, F.col("dimension") == F.col("spelling"))
    used = named.groupBy(*surveys, "name").agg(F.min("rank").alias("rank"))
    if not surveys:
        used = F.broadcast(used)  # one row per dimension
    chosen = join_groups(named, used, [*surveys, "name", "rank"])
    return chosen.select(*surveys, F.col("name").alias("dimension"), *strata, "variance")


def keyed_lookup(parts: Sequence[tuple[Dimension, DataFrame]]) -> DataFrame:
    """One lookup out of each dimension's own table of key columns and ``variance``; keys outside a dimension are null."""
    keys = key_columns([dim for dim, _ in parts])
    rows = [
        frame.select(
            dimension_name(dim.name),
            *[F.col(k).cast("string").alias(k) if k in dim.columns else F.lit(None).cast("string").alias(k) for k in keys],
            F.col("variance").cast("double").alias("variance"),
        )
        for dim, frame in parts
    ]
    return reduce(DataFrame.unionByName, rows)
