"""Within-stratum variance from answers of several kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.operators import allocation, variance
from stratalens.operators.strata import Dimension, dimension_name
from stratalens.plans import sqltext as q
from stratalens.plans.registry import query
from stratalens.plans.testbed import LANG, LANG_SOURCE

LINES = """long AS (
  SELECT l_returnflag || ' × ' || l_linestatus AS stratum, question, answer FROM (
    SELECT l_returnflag, l_linestatus, l_discount AS discount, l_tax AS tax, l_quantity AS quantity FROM lineitem)
  UNPIVOT INCLUDE NULLS (answer FOR question IN (discount, tax, quantity)))"""
LINE_ONE = """one AS (SELECT stratum, question, count(*) AS rows_, var_samp(answer) AS v, min(answer) AS lo, max(answer) AS hi
  FROM long GROUP BY stratum, question),
scaled AS (SELECT *, CASE WHEN hi > 1 THEN v / nullif((hi - lo) * (hi - lo), 0) ELSE v END AS sv FROM one)"""


def line_answers(t):
    lines = t.read("lineitem").select(
        F.concat_ws(" × ", "l_returnflag", "l_linestatus").alias("stratum"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("l_quantity").alias("quantity"),
    )
    return variance.long_answers(lines, ["stratum"], ["discount", "tax", "quantity"], "double")


@query(
    "within_variance",
    f"""WITH {LINES}, {LINE_ONE}
SELECT stratum, {q.r("CASE WHEN max(rows_) < 2 THEN 0.25 ELSE coalesce(avg(sv), 0.25) END", "variance")} FROM scaled GROUP BY stratum""",
)
def within_variance(t):
    return variance.within_stratum_variance(line_answers(t), ["stratum"])


@query(
    "variance_by_category",
    f"""WITH {LINES}, {LINE_ONE}, codes AS (SELECT * FROM (VALUES ('discount', 'price'), ('tax', 'price'), ('quantity', 'volume')) v(question, category))
SELECT category, stratum, {q.r("CASE WHEN max(rows_) < 2 THEN 0.25 ELSE coalesce(avg(sv), 0.25) END", "variance")}
FROM scaled JOIN codes USING (question) GROUP BY category, stratum""",
)
def variance_by_category(t):
    codes = t.spark.createDataFrame(
        [("discount", "price"), ("tax", "price"), ("quantity", "volume")], "question string, category string"
    )
    return variance.variance_by_category(line_answers(t), codes, ["stratum"])


@query(
    "stratum_question_variance",
    f"""WITH {LINES}, {LINE_ONE}
SELECT stratum, question, rows_ AS answers, {q.r("CASE WHEN lo >= 0 AND hi <= 1 THEN v ELSE v / nullif((hi - lo) * (hi - lo), 0) END", "variance")}
FROM one WHERE rows_ >= 2""",
)
def stratum_question_variance(t):
    return variance.numeric_stratum_variance(line_answers(t), ["stratum"])


# Answer texts standing for the event types and order priorities of the given tables.
REPLIES = """replies AS (
  SELECT user_id, CAST(date_part('day', ts) AS BIGINT) % 7 AS grp,
    CASE event_type WHEN 'click' THEN 'Agree' WHEN 'view' THEN 'Neutral' WHEN 'error' THEN 'Strongly Disagree'
      WHEN 'signup' THEN 'Strongly Agree' WHEN 'purchase' THEN 'no idea' END AS opinion,
    CASE WHEN value > 20 THEN 'weekly' WHEN value > 5 THEN 'monthly' WHEN value > 2 THEN NULL ELSE 'never' END AS habit,
    'tier ' || CAST(user_id % 4 AS VARCHAR) AS tier,
    'same' AS constant
  FROM events),
long AS (SELECT grp, question, answer FROM (SELECT grp, opinion, habit, tier, constant FROM replies)
  UNPIVOT INCLUDE NULLS (answer FOR question IN (opinion, habit, tier, constant)))"""
SCALE = "CASE answer WHEN 'Agree' THEN 1.0 WHEN 'Neutral' THEN 0.5 WHEN 'Strongly Disagree' THEN 0.0 WHEN 'Strongly Agree' THEN 1.0 WHEN 'weekly' THEN 0.75 WHEN 'monthly' THEN 0.5 WHEN 'never' THEN 0.0 END"
SCORED = f"""counts AS (SELECT grp, question, answer, count(*) AS n, CAST({SCALE} AS DOUBLE) AS known FROM long GROUP BY ALL),
framed AS (SELECT *, sum(n) OVER g AS total, sum(CASE WHEN known IS NULL THEN n ELSE 0 END) OVER g AS lost,
    count(answer) OVER g AS kinds, dense_rank() OVER (PARTITION BY grp, question ORDER BY answer NULLS LAST) AS place
  FROM counts WINDOW g AS (PARTITION BY grp, question)),
scored AS (SELECT grp, question, answer, n, CASE WHEN lost > total * 0.5 AND kinds BETWEEN 2 AND 10
    THEN CASE WHEN answer IS NOT NULL THEN (place - 1)::DOUBLE / (kinds - 1) END
    WHEN lost > total * 0.5 AND kinds = 1 THEN 0.5 ELSE known END AS score FROM framed),
spread AS (SELECT grp, question, sum(n) FILTER (score IS NOT NULL) AS answers,
    (sum(n * score * score) - sum(n * score) * sum(n * score) / sum(n) FILTER (score IS NOT NULL)) / (sum(n) FILTER (score IS NOT NULL) - 1) AS v
  FROM scored GROUP BY grp, question HAVING sum(n) FILTER (score IS NOT NULL) >= 2)"""


def reply_counts(t):
    e = F.col("event_type")
    opinion = (
        F.when(e == "click", "Agree").when(e == "view", "Neutral").when(e == "error", "Strongly Disagree")
        .when(e == "signup", "Strongly Agree").when(e == "purchase", "no idea")
    )
    value = F.col("value")
    habit = F.when(value > 20, "weekly").when(value > 5, "monthly").when(value > 2, F.lit(None)).otherwise("never")
    replies = t.read("events").select(
        (F.dayofmonth("ts").cast("long") % 7).alias("grp"),
        opinion.alias("opinion"),
        habit.alias("habit"),
        F.concat(F.lit("tier "), (F.col("user_id") % 4).cast("string")).alias("tier"),
        F.lit("same").alias("constant"),
    )
    answers = variance.long_answers(replies, ["grp"], ["opinion", "habit", "tier", "constant"], "string")
    return variance.answer_counts(answers, ["grp"])


@query(
    "likert_scale",
    f"""WITH {REPLIES}, {SCORED} SELECT grp, question, answer, n, {q.r("known", "score")} FROM framed""",
)
def likert_scale(t):
    return reply_counts(t).withColumn("score", variance.scaled(F.col("answer"), variance.UNIT_SCALE))


@query(
    "ordinal_fallback",
    f"""WITH {REPLIES}, {SCORED} SELECT grp, question, answer, n, {q.r("score", "score")} FROM scored""",
)
def ordinal_fallback(t):
    """Unlisted answers become evenly spread ranks when most of a question is unlisted."""
    return variance.unit_scores(reply_counts(t), ["grp"])


@query(
    "poll_variance",
    f"""WITH {REPLIES}, {SCORED} SELECT grp, question, CAST(answers AS BIGINT) AS answers, {q.r("greatest(v, 0)", "variance")} FROM spread""",
)
def poll_variance(t):
    return variance.stratum_variance(variance.unit_scores(reply_counts(t), ["grp"]), ["grp"])


SUMMARY = """summary AS (SELECT grp, count(*) AS n_questions, avg(v) AS mean_v, median(v) AS med, stddev_pop(v) AS sd, min(v) AS lo, max(v) AS hi
  FROM (SELECT grp, greatest(v, 0) AS v FROM spread) GROUP BY grp)"""


def poll_summary(t):
    return variance.variance_summary(
        variance.stratum_variance(variance.unit_scores(reply_counts(t), ["grp"]), ["grp"]), ["grp"]
    )


@query(
    "variance_summary",
    f"""WITH {REPLIES}, {SCORED}, {SUMMARY}
SELECT grp, n_questions, {q.r("mean_v", "mean_variance")}, {q.r("med", "median_variance")}, {q.r("sd", "std_variance")},
  {q.r("lo", "min_variance")}, {q.r("hi", "max_variance")}, {q.r("1 - mean_v", "consensus_score")} FROM summary""",
)
def variance_summary(t):
    return poll_summary(t)


LINE_SUMMARY = """line_summary AS (SELECT survey, dimension, stratum, 1 - avg(v) AS c FROM (
    SELECT survey, dimension, stratum, question, CASE WHEN min(answer) >= 0 AND max(answer) <= 1 THEN var_samp(answer)
      ELSE var_samp(answer) / nullif((max(answer) - min(answer)) * (max(answer) - min(answer)), 0) END AS v
    FROM long GROUP BY ALL HAVING count(answer) >= 2) WHERE v IS NOT NULL GROUP BY ALL)"""
SURVEY_LINES = """tagged AS (SELECT CAST(year(l_shipdate) AS BIGINT) AS survey, dimension, stratum, l_discount AS discount, l_tax AS tax, l_quantity AS quantity
  FROM (SELECT *, 'Flag' AS dimension, l_returnflag AS stratum FROM lineitem UNION ALL SELECT *, 'Status', l_linestatus FROM lineitem)),
long AS (SELECT survey, dimension, stratum, question, answer FROM tagged UNPIVOT INCLUDE NULLS (answer FOR question IN (discount, tax, quantity)))"""


def survey_summaries(t):
    pair = F.explode(
        F.array(
            F.struct(F.lit("Flag").alias("dimension"), F.col("l_returnflag").alias("stratum")),
            F.struct(F.lit("Status").alias("dimension"), F.col("l_linestatus").alias("stratum")),
        )
    ).alias("pair")
    lines = t.read("lineitem").select(
        F.year("l_shipdate").cast("long").alias("survey"),
        pair,
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("l_quantity").alias("quantity"),
    ).select("survey", "pair.dimension", "pair.stratum", "discount", "tax", "quantity")
    group = ["survey", "dimension", "stratum"]
    answers = variance.long_answers(lines, group, ["discount", "tax", "quantity"], "double")
    return variance.variance_summary(variance.numeric_stratum_variance(answers, group), group)


@query(
    "variance_cross_survey",
    f"""WITH {SURVEY_LINES}, {LINE_SUMMARY}
SELECT survey, dimension, count(*) AS n_strata, {q.r("avg(c)", "avg_consensus")}, {q.r("min(c)", "min_consensus")},
  {q.r("max(c)", "max_consensus")}, {q.r("stddev_samp(c)", "std_consensus")} FROM line_summary GROUP BY survey, dimension""",
)
def variance_cross_survey(t):
    return variance.consensus_comparison(survey_summaries(t), ["survey", "dimension"])


@query(
    "consensus_bands",
    f"""WITH {REPLIES}, {SCORED}, {SUMMARY}
SELECT CASE WHEN 1 - mean_v > 0.8 THEN 'High' WHEN 1 - mean_v > 0.6 THEN 'Medium' ELSE 'Low' END AS band, count(*) AS strata,
  {q.r("avg(mean_v)", "mean_variance")} FROM summary GROUP BY band""",
)
def consensus_bands(t):
    return variance.consensus_bands(poll_summary(t))


@query(
    "agreement_variance",
    f"""WITH {q.ORDERS}, rates AS (SELECT segment || status AS question, priority AS stratum,
    round(100 * avg(CASE WHEN price > 250000 THEN 1.0 ELSE 0.0 END), 0) / 100 AS rate
  FROM survey WHERE region <> 'ASIA' AND priority <> '5-LOW' GROUP BY segment, status, priority),
spread AS (SELECT stratum, var_samp(rate) AS v FROM rates GROUP BY stratum)
SELECT p.stratum, {q.r("coalesce(v, 0.25)", "variance")} FROM (SELECT DISTINCT o_orderpriority AS stratum FROM orders) p
LEFT JOIN spread ON spread.stratum = p.stratum""",
)
def agreement_variance(t):
    """Agreement table as delivered: one ``O<i>: <stratum>`` column per stratum, ``85%`` texts."""
    groups = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]
    kind = F.when(F.col("region") == "ASIA", "Poll Single Select").otherwise(variance.OPINION_TYPE)
    survey = t.survey.withColumn("question_type", kind)
    rate = F.round(F.avg(F.when(F.col("price") > 250000, 1.0).otherwise(0.0)) * 100, 0).cast("int")
    wide = (
        survey.groupBy("question_type", F.concat("segment", "status").alias("question"))
        .pivot("priority", groups)
        .agg(F.concat(rate.cast("string"), F.lit("%")))
    )
    for i, name in enumerate(groups):
        wide = wide.withColumnRenamed(name, f"O{i + 1}: {name}")
    strata = t.survey.select(F.col("priority").alias("stratum"))
    return variance.agreement_variance(variance.agreement_rates(wide), strata)


@query(
    "neyman_from_variance",
    f"""WITH {q.LABELLED}, long AS (SELECT lang AS stratum, question, CAST(answer AS DOUBLE) AS answer FROM (SELECT lang, quality, toxic FROM labelled)
    UNPIVOT INCLUDE NULLS (answer FOR question IN (quality, toxic))), {LINE_ONE},
spread AS (SELECT stratum, CASE WHEN max(rows_) < 2 THEN 0.25 ELSE coalesce(avg(sv), 0.25) END AS variance FROM scaled GROUP BY stratum),
{q.shares("bench", "documents", [q.DOCUMENT[1]], ("lang",))},
w AS (SELECT dimension, lang AS stratum, q, coalesce(variance, 0.25) AS var, q * sqrt(coalesce(variance, 0.25)) AS w
  FROM bench LEFT JOIN spread ON stratum = lang),
g AS (SELECT *, CAST(round_even(CAST(round(500 * (w / sum(w) OVER ()), 9) AS DOUBLE), 0) AS BIGINT) AS n0 FROM w),
h AS (SELECT *, row_number() OVER (ORDER BY n0 DESC, stratum) AS k, sum(n0) OVER () AS given FROM g)
SELECT dimension, CAST(500 AS BIGINT) AS size, stratum, {q.r("q", "population_share")}, {q.r("var", "variance")},
  CAST(n0 + CASE WHEN k = 1 THEN 500 - given ELSE 0 END AS BIGINT) AS optimal_n FROM h""",
)
def neyman_from_variance(t):
    """Allocation by the variance measured in the labels of each language."""
    labels = t.labelled.select(F.col("lang").alias("stratum"), "quality", "toxic")
    measured = variance.within_stratum_variance(
        variance.long_answers(labels, ["stratum"], ["quality", "toxic"], "double"), ["stratum"]
    )
    measured = measured.select(dimension_name("Language"), "stratum", "variance")
    return allocation.neyman(t.document_shares(LANG), [LANG], [500], measured)


@query(
    "poll_columns",
    """SELECT 'lang' AS "column", count(DISTINCT lang) AS answers FROM documents HAVING count(DISTINCT lang) BETWEEN 2 AND 20
UNION ALL SELECT 'source', count(DISTINCT source) FROM documents HAVING count(DISTINCT source) BETWEEN 2 AND 20
UNION ALL SELECT 'n_chars', count(DISTINCT n_chars) FROM documents HAVING count(DISTINCT n_chars) BETWEEN 2 AND 20
UNION ALL SELECT 'text', count(DISTINCT text) FROM documents HAVING count(DISTINCT text) BETWEEN 2 AND 20""",
)
def poll_columns(t):
    return variance.poll_columns(t.read("documents"), excluded=["doc_id"])


TRUST = """replies AS (SELECT CAST(date_part('day', ts) AS BIGINT) % 7 AS grp,
    CASE event_type WHEN 'click' THEN 'Strongly Trust' WHEN 'view' THEN 'Somewhat Trust' WHEN 'error' THEN 'Strongly Distrust'
      WHEN 'signup' THEN 'Neither Trust Nor Distrust' ELSE 'skipped' END AS trust_ai,
    CASE WHEN value > 20 THEN 'Yes' WHEN value > 5 THEN 'No' ELSE 'Unsure' END AS ai_use FROM events),
long AS (SELECT grp AS stratum, question, CAST(CASE answer WHEN 'Strongly Trust' THEN 5 WHEN 'Somewhat Trust' THEN 4 WHEN 'Neither Trust Nor Distrust' THEN 3
    WHEN 'Strongly Distrust' THEN 1 WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 WHEN 'Unsure' THEN 0.5 END AS DOUBLE) AS answer
  FROM replies UNPIVOT (answer FOR question IN (trust_ai, ai_use)))"""


@query(
    "within_variance_text",
    f"""WITH {TRUST}, {LINE_ONE}
SELECT stratum AS grp, {q.r("CASE WHEN max(rows_) < 2 THEN 0.25 ELSE coalesce(avg(sv), 0.25) END", "variance")} FROM scaled GROUP BY stratum""",
)
def within_variance_text(t):
    """Text answers on the five-point scale; only indicator questions count."""
    e, value = F.col("event_type"), F.col("value")
    trust = (
        F.when(e == "click", "Strongly Trust").when(e == "view", "Somewhat Trust").when(e == "error", "Strongly Distrust")
        .when(e == "signup", "Neither Trust Nor Distrust").otherwise("skipped")
    )
    use = F.when(value > 20, "Yes").when(value > 5, "No").otherwise("Unsure")
    replies = t.read("events").select((F.dayofmonth("ts").cast("long") % 7).alias("grp"), trust.alias("trust_ai"), use.alias("ai_use"), "user_id")
    answers = variance.long_answers(replies, ["grp"], variance.indicator_columns(replies.columns), "string")
    numeric = answers.withColumn("answer", variance.scaled(F.col("answer"), variance.FIVE_POINT_SCALE))
    return variance.within_stratum_variance(numeric, ["grp"])


@query(
    "variance_spellings",
    f"""WITH {q.LABELLED}
SELECT 'Language × Source' AS dimension, lang || ' × ' || source AS stratum, {q.r("var_samp(quality)", "variance")} FROM labelled GROUP BY lang, source
UNION ALL SELECT 'Tongue', lang, {q.r("var_samp(quality)", "v")} FROM labelled GROUP BY lang""",
)
def variance_spellings(t):
    """A lookup that writes its dimensions differently from the scorecard."""
    fine = t.labelled.groupBy("lang", "source").agg(F.var_samp("quality").alias("variance"))
    coarse = t.labelled.groupBy("lang").agg(F.var_samp("quality").alias("variance"))
    lookup = fine.select(F.lit("Language x Source").alias("dimension"), F.concat_ws(" × ", "lang", "source").alias("stratum"), "variance").unionByName(
        coarse.select(F.lit("Lang").alias("dimension"), F.col("lang").alias("stratum"), "variance")
    )
    return variance.for_dimensions(lookup, [LANG_SOURCE, Dimension("Tongue", ("lang",))])
