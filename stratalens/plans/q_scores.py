"""Scores over the orders survey, the supplier survey and the labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.functions.expressions import ratio
from stratalens.operators import scores
from stratalens.operators.strata import (
    benchmark_left,
    cell_counts,
    dimension_label,
    dimension_name,
    line_up,
    stratum_counts,
)
from stratalens.plans import sqltext as q
from stratalens.plans.registry import query
from stratalens.plans.testbed import COUNTRY, COUNTRY_SEGMENT, DOCUMENT, REGION, SEGMENT, STANDARD
from stratalens.session import materialize

ONE = [q.STANDARD[0]]
ONE_KEYS = ("country", "segment")


@query(
    "match_country_segment",
    f"""WITH {q.ORDERS}, {q.lined_up(ONE, ONE_KEYS)}
SELECT dimension, max(size) AS sample_size, {q.r(q.MATCH, "match_score")}, {q.r(q.COVERAGE, "coverage_score")}
FROM aligned GROUP BY dimension""",
)
def match_country_segment(t):
    return scores.match_and_coverage(t.aligned([COUNTRY_SEGMENT]))


NULLED = "holed AS (SELECT nullif(segment, 'MACHINERY') AS segment, country FROM survey)"


@query(
    "match_null_keys",
    f"""WITH {q.ORDERS}, {NULLED}, {q.lined_up(ONE, ONE_KEYS, survey="holed")}
SELECT dimension, max(size) AS sample_size, {q.r(q.MATCH, "match_score")}, {q.r(q.COVERAGE, "coverage_score")},
       {q.r("sum(s)", "share_sum")}
FROM aligned GROUP BY dimension""",
)
def match_null_keys(t):
    """Respondents with a missing key still count in the denominator."""
    holed = t.survey.withColumn("segment", F.nullif("segment", F.lit("MACHINERY")))
    aligned = line_up(
        cell_counts(holed, COUNTRY_SEGMENT.columns), t.benchmark_for(COUNTRY_SEGMENT), [COUNTRY_SEGMENT]
    )
    sums = aligned.groupBy("dimension").agg(F.sum("sample_share").alias("share_sum"))
    return scores.match_and_coverage(aligned).join(sums, "dimension")


@query(
    "coverage_default",
    f"""WITH {q.LABELLED}, {q.lined_up(q.DOCUMENT, q.DOCUMENT_KEYS, survey="labelled", base="documents")}
SELECT dimension, max(size) AS sample_size, {q.r(q.MATCH, "match_score")}, {q.r(q.COVERAGE, "coverage_score")}
FROM aligned GROUP BY dimension""",
)
def coverage_default(t):
    return scores.match_and_coverage(t.document_aligned(DOCUMENT))


@query(
    "coverage_custom",
    f"""WITH {q.LABELLED}, {q.lined_up(q.DOCUMENT, q.DOCUMENT_KEYS, survey="labelled", base="documents", threshold="0.02")}
SELECT dimension, {q.r(q.COVERAGE, "coverage_score")}, count(*) FILTER (relevant) AS relevant_strata
FROM aligned GROUP BY dimension""",
)
def coverage_custom(t):
    aligned = t.document_aligned(DOCUMENT, threshold=0.02)
    return aligned.groupBy("dimension").agg(
        scores.coverage_of().alias("coverage_score"), F.count_if("relevant").alias("relevant_strata")
    )


@query(
    "stratum_counts",
    f"""WITH {q.ORDERS} SELECT region, segment, priority, count(*) AS n FROM survey GROUP BY ALL""",
)
def stratum_count_query(t):
    return stratum_counts(t.survey, ["region", "segment", "priority"])


@query(
    "sample_shares",
    f"""WITH {q.ORDERS}, {q.counted("counts", "survey", q.STANDARD, q.STANDARD_KEYS)}
SELECT dimension, {q.label(q.STANDARD, q.STANDARD_KEYS)} AS stratum, n, {q.r("n::DOUBLE / (SELECT count(*) FROM survey)", "sample_share")}
FROM counts""",
)
def sample_shares(t):
    aligned = t.aligned(STANDARD)
    return aligned.where("n > 0").select("dimension", dimension_label(STANDARD).alias("stratum"), "n", "sample_share")


@query(
    "strategic_targets",
    f"""WITH {q.PEOPLE}, {q.shares("bench", "people", q.STANDARD, q.STANDARD_KEYS)}
SELECT dimension, {q.label(q.STANDARD, q.STANDARD_KEYS)} AS stratum, {q.r("q", "population_share")},
       {q.r("sqrt(q) / sum(sqrt(q)) OVER (PARTITION BY dimension)", "target_share")}
FROM bench""",
)
def strategic_targets(t):
    targets = scores.target_shares(t.benchmark)
    return targets.select("dimension", dimension_label(STANDARD).alias("stratum"), "population_share", "target_share")


@query(
    "strategic_score",
    f"""WITH {q.ORDERS}, {q.lined_up(q.STANDARD, q.STANDARD_KEYS)}
SELECT dimension, {q.r(q.STRATEGIC, "strategic_score")},
       {q.r("1 - 0.5 * sum(abs(s - t)) FILTER (in_bench)", "benchmark_only_score")}
FROM aligned GROUP BY dimension""",
)
def strategic_score(t):
    """Both forms: over the union of strata, and over the benchmark's strata alone."""
    gap = F.abs(F.col("sample_share") - F.col("target_share"))
    return (
        t.aligned(STANDARD, targets=True)
        .groupBy("dimension")
        .agg(
            scores.match_of(population="target_share").alias("strategic_score"),
            (F.lit(1.0) - F.lit(0.5) * F.sum(F.when(F.col("in_benchmark"), gap))).alias("benchmark_only_score"),
        )
    )


@query(
    "strategic_detail",
    f"""WITH {q.LABELLED}, {q.lined_up(q.DOCUMENT, q.DOCUMENT_KEYS, survey="labelled", base="documents")}
SELECT dimension, {q.label(q.DOCUMENT, q.DOCUMENT_KEYS)} AS stratum, {q.r("q", "population_share")}, {q.r("t", "target_share")},
       {q.r("s", "sample_share")}, n AS sample_count, {q.r("t - q", "target_vs_population")},
       {q.r("abs(s - t)", "deviation_from_target")}, {q.r("abs(s - q)", "deviation_from_population")},
       {q.r("0.5 * abs(s - t)", "strategic_contribution")}
FROM aligned""",
)
def strategic_detail(t):
    return scores.strategic_detail(t.document_aligned(DOCUMENT, targets=True), DOCUMENT)


@query(
    "weighted_basic",
    f"""WITH {q.ORDERS}, {q.lined_up(q.STANDARD, q.STANDARD_KEYS)}, weighted AS (SELECT *, q * {q.SE} AS w FROM aligned)
SELECT dimension, {q.r(q.WEIGHTED, "weighted_score")} FROM weighted GROUP BY dimension""",
)
def weighted_basic(t):
    weighted = scores.with_weights(t.aligned(STANDARD), STANDARD)
    return weighted.groupBy("dimension").agg(scores.weighted_of().alias("weighted_score"))


VARIANCE_SQL = """variance AS (
  SELECT 'Language' AS dimension, lang AS stratum, var_samp(quality) AS variance FROM labelled GROUP BY lang
  UNION ALL SELECT 'Source', source, var_samp(quality) FROM labelled WHERE source < 'src3' GROUP BY source)"""


def label_variance(t):
    by_lang = t.labelled.groupBy("lang").agg(F.var_samp("quality").alias("variance"))
    by_source = t.labelled.where("source < 'src3'").groupBy("source").agg(F.var_samp("quality").alias("variance"))
    return by_lang.select(dimension_name("Language"), F.col("lang").alias("stratum"), "variance").unionByName(
        by_source.select(dimension_name("Source"), F.col("source").alias("stratum"), "variance")
    )


WEIGHTED_DOC = f"""{q.LABELLED}, {q.lined_up(q.DOCUMENT, q.DOCUMENT_KEYS, survey="labelled", base="documents")}, {VARIANCE_SQL},
named AS (SELECT *, {q.label(q.DOCUMENT, q.DOCUMENT_KEYS)} AS stratum FROM aligned),
weighted AS (
  SELECT named.*, {q.SE} AS se, 1 - coalesce(variance, 0) AS rel, q * {q.SE} * (1 - coalesce(variance, 0)) AS w
  FROM named LEFT JOIN variance USING (dimension, stratum))"""


@query(
    "weighted_reliability",
    f"""WITH {WEIGHTED_DOC}
SELECT dimension, {q.r(q.MATCH, "match_score")}, {q.r(q.WEIGHTED, "weighted_score")} FROM weighted GROUP BY dimension""",
)
def weighted_reliability(t):
    """Only some strata have a known variance; the rest count as fully reliable."""
    weighted = scores.with_weights(t.document_aligned(DOCUMENT), DOCUMENT, label_variance(t))
    return scores.match_beside_weighted(weighted)


@query(
    "weighted_detail",
    f"""WITH {WEIGHTED_DOC}
SELECT dimension, stratum, {q.r("q", "population_share")}, {q.r("s", "sample_share")}, n AS sample_count,
       {q.r("se", "standard_error")}, {q.r("rel", "reliability")}, {q.r("w", "weight")}, {q.r("abs(s - q)", "deviation")},
       {q.r("w * abs(s - q)", "weighted_contribution")},
       {q.r("w / sum(w) OVER (PARTITION BY dimension)", "normalized_weight")}
FROM weighted""",
)
def weighted_detail(t):
    weighted = scores.with_weights(t.document_aligned(DOCUMENT), DOCUMENT, label_variance(t))
    return scores.weighted_detail(materialize(weighted), DOCUMENT)


@query(
    "weighted_half_error",
    f"""WITH {q.LABELLED}, {q.lined_up(q.DOCUMENT, q.DOCUMENT_KEYS, survey="labelled", base="documents", threshold="0.02")},
weighted AS (SELECT *, q * CASE WHEN n > 0 THEN sqrt(s * (1 - s) / n) ELSE 0.5 END AS w FROM aligned WHERE in_bench)
SELECT dimension, {q.r(q.MATCH, "match_score")}, {q.r(q.WEIGHTED, "weighted_score")} FROM weighted GROUP BY dimension""",
)
def weighted_half_error(t):
    """The script form: benchmark strata only, unsampled strata with standard error one half."""
    aligned = benchmark_left(t.document_aligned(DOCUMENT, threshold=0.02))
    return scores.match_beside_weighted(scores.with_weights(aligned, DOCUMENT, unsampled_se=0.5))


@query(
    "match_vs_weighted",
    f"""WITH {q.PEOPLE}, vendors AS (
  SELECT n_name AS country, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
{q.lined_up([q.STANDARD[2]], ("country",), survey="vendors")}, weighted AS (SELECT *, q * {q.SE} AS w FROM aligned WHERE in_bench)
SELECT dimension, country AS stratum, {q.r("q", "population_share")}, {q.r("s", "sample_share")}, n AS sample_count,
       {q.r(q.SE, "standard_error")}, {q.r("abs(s - q)", "absolute_deviation")}, {q.r("0.5 * abs(s - q)", "match_contribution")},
       {q.r("w", "weight")}, {q.r("1 - 0.5 * sum(abs(s - q)) OVER ()", "match_score")},
       {q.r("1 - sum(w * abs(s - q)) OVER () / sum(w) OVER ()", "weighted_score")}
FROM weighted""",
)
def match_vs_weighted(t):
    """Supplier countries against customer countries, stratum by stratum, with both scores."""
    cells = cell_counts(t.supplier_survey, ["country"])
    aligned = benchmark_left(line_up(cells, t.benchmark_for(COUNTRY), [COUNTRY]))
    weighted = materialize(scores.with_weights(aligned, [COUNTRY]))
    gap = F.abs(F.col("sample_share") - F.col("population_share"))
    both = scores.match_beside_weighted(weighted)
    return weighted.join(both, "dimension").select(
        "dimension",
        F.col("country").alias("stratum"),
        "population_share",
        "sample_share",
        F.col("n").alias("sample_count"),
        "standard_error",
        gap.alias("absolute_deviation"),
        (gap * 0.5).alias("match_contribution"),
        "weight",
        "match_score",
        "weighted_score",
    )


@query(
    "scorecard_all",
    f"""WITH {q.ORDERS}, {q.lined_up(q.STANDARD, q.STANDARD_KEYS)}
SELECT dimension, max(size) AS sample_size, {q.r(q.MATCH, "match_score")}, {q.r(q.COVERAGE, "coverage_score")}
FROM aligned GROUP BY dimension""",
)
def scorecard_all(t):
    return scores.match_and_coverage(t.aligned(STANDARD))


FULL = f"""{q.ORDERS}, {q.lined_up(q.STANDARD, q.STANDARD_KEYS, by=("priority",))},
weighted AS (SELECT *, q * {q.SE} AS w FROM aligned),
card AS (SELECT priority, dimension, max(size) AS sample_size, count(*) AS strata, count(*) FILTER (n > 0) AS sampled_strata,
    {q.MATCH} AS match_score, {q.COVERAGE} AS coverage_score, {q.STRATEGIC} AS strategic_score, {q.WEIGHTED} AS weighted_score
  FROM weighted GROUP BY priority, dimension)"""


def full_card(t):
    cells = t.order_cells(["country", "segment", "region"], ["priority"])
    return scores.scorecard(cells, t.benchmark, STANDARD, ["priority"])


@query(
    "scorecard_full",
    f"""WITH {FULL}
SELECT priority, dimension, sample_size, strata, sampled_strata, {q.r("match_score", "match_score")},
       {q.r("coverage_score", "coverage_score")}, {q.r("strategic_score", "strategic_score")}, {q.r("weighted_score", "weighted_score")}
FROM card""",
)
def scorecard_full(t):
    """Every score, every dimension, every survey (one per order priority) from one scan."""
    return full_card(t)


@query(
    "scorecard_full_overall",
    f"""WITH {FULL}
SELECT priority, dimension, {q.r("match_score", "match_score")}, {q.r("coverage_score", "coverage_score")},
       {q.r("strategic_score", "strategic_score")}, {q.r("weighted_score", "weighted_score")} FROM card
UNION ALL
SELECT priority, 'Overall (Average)', {q.r("avg(match_score)", "m")}, {q.r("avg(coverage_score)", "c")},
       {q.r("avg(strategic_score)", "s")}, {q.r("avg(weighted_score)", "w")} FROM card GROUP BY priority""",
)
def scorecard_full_overall(t):
    columns = ["match_score", "coverage_score", "strategic_score", "weighted_score"]
    return scores.with_overall(full_card(t), columns, ["priority"])


@query(
    "rating_bands",
    f"""WITH {FULL}
SELECT priority, dimension, CASE WHEN match_score >= 0.8 THEN 'Excellent' WHEN match_score >= 0.6 THEN 'Good'
         WHEN match_score >= 0.4 THEN 'Moderate' ELSE 'Poor' END AS rating,
       CASE WHEN match_score >= 0.9 THEN 'Excellent' WHEN match_score >= 0.8 THEN 'Good' WHEN match_score >= 0.7 THEN 'Fair'
         ELSE 'Poor' END AS report_rating,
       CASE WHEN coverage_score >= 0.9 THEN 'High' WHEN coverage_score >= 0.7 THEN 'Medium' ELSE 'Low' END AS coverage_rating,
       {q.r("match_score / sample_size * 100", "score_per_hundred")}
FROM card""",
)
def rating_bands(t):
    return full_card(t).select(
        "priority",
        "dimension",
        scores.rating(F.col("match_score")).alias("rating"),
        scores.report_rating(F.col("match_score")).alias("report_rating"),
        scores.coverage_rating(F.col("coverage_score")).alias("coverage_rating"),
        scores.per_hundred(F.col("match_score"), F.col("sample_size")).alias("score_per_hundred"),
    )


AGREEMENT = f"""{q.ORDERS}, {q.lined_up(q.STANDARD, q.STANDARD_KEYS, by=("priority",))},
rates AS (SELECT segment, status, avg(CASE WHEN price > 250000 THEN 1.0 ELSE 0.0 END) AS rate FROM survey GROUP BY segment, status),
variance AS (SELECT 'Segment' AS dimension, segment AS stratum, var_samp(rate) AS variance FROM rates GROUP BY segment),
named AS (SELECT *, {q.label(q.STANDARD, q.STANDARD_KEYS)} AS stratum FROM aligned),
weighted AS (SELECT named.*, q * CASE WHEN n > 0 THEN sqrt(s * (1 - s) / n) ELSE 0.5 END * (1 - coalesce(variance, 0.25)) AS w
  FROM named LEFT JOIN variance USING (dimension, stratum)),
both_scores AS (SELECT priority, dimension, 1 - 0.5 * sum(abs(s - q)) FILTER (in_bench) AS m,
    CASE WHEN sum(w) FILTER (in_bench) > 0 THEN 1 - sum(w * abs(s - q)) FILTER (in_bench) / sum(w) FILTER (in_bench) ELSE 0 END AS v,
    count(*) FILTER (in_bench) AS strata, count(*) FILTER (n > 0) AS sampled_strata FROM weighted GROUP BY priority, dimension),
spread AS (SELECT dimension, avg(variance) AS mv FROM variance GROUP BY dimension)"""


def _agreement(t):
    rates = t.survey.groupBy("segment", "status").agg(
        F.avg(F.when(F.col("price") > 250000, 1.0).otherwise(0.0)).alias("rate")
    )
    variance = rates.groupBy("segment").agg(F.var_samp("rate").alias("variance"))
    variance = materialize(variance.select(dimension_name("Segment"), F.col("segment").alias("stratum"), "variance"))
    return scores.agreement_scores(materialize(t.aligned(STANDARD, ["priority"])), STANDARD, variance, ["priority"])


@query(
    "agreement_scores",
    f"""WITH {AGREEMENT}
SELECT priority, dimension, {q.r("m", "match_score")}, {q.r("v", "weighted_score")}, strata, sampled_strata,
       {q.r("mv", "mean_agreement_variance")}, {q.r("v - m", "difference")}
FROM both_scores LEFT JOIN spread USING (dimension)""",
)
def agreement_scores(t):
    return _agreement(t)


@query(
    "agreement_improvement",
    f"""WITH {AGREEMENT} SELECT dimension, {q.r("avg(v - m)", "improvement")} FROM both_scores GROUP BY dimension""",
)
def agreement_improvement(t):
    return scores.mean_improvement(_agreement(t))


@query(
    "nearest_max",
    f"""WITH {q.PEOPLE}, {q.shares("bench", "people", q.STANDARD[2:], q.STANDARD_KEYS)},
maxima AS (SELECT dimension, v.size, 1 - 0.5 * sum(abs(floor(q * v.size) / v.size - q)) AS max_match,
    count(*) FILTER (floor(q * v.size) > 0)::DOUBLE / count(*) AS max_coverage
  FROM bench, (VALUES (20), (100), (1000), (5000)) v(size) GROUP BY dimension, v.size),
surveys AS (SELECT o_orderpriority AS survey, count(*) AS sample_size FROM orders GROUP BY 1
  UNION ALL SELECT o_orderstatus, count(*) FROM orders GROUP BY 1
  UNION ALL SELECT 'supplier', count(*) FROM supplier),
ranked AS (SELECT survey, sample_size, size, row_number() OVER (PARTITION BY survey ORDER BY abs(size - sample_size), size) AS k
  FROM surveys, (SELECT DISTINCT size FROM maxima))
SELECT survey, sample_size, dimension, ranked.size AS size_used, {q.r("max_match", "max_match")}, {q.r("max_coverage", "max_coverage")}
FROM ranked JOIN maxima ON ranked.size = maxima.size WHERE k = 1""",
)
def nearest_max(t):
    """Maxima stored for a few sample sizes, looked up for surveys of any size."""
    bench = t.benchmark_for(COUNTRY, REGION, SEGMENT)
    sized = bench.withColumn("size", F.explode(F.array(*[F.lit(s) for s in (20, 100, 1000, 5000)])))
    whole = F.floor(F.col("population_share") * F.col("size"))
    maxima = sized.groupBy("dimension", "size").agg(
        (F.lit(1.0) - F.lit(0.5) * F.sum(F.abs(ratio(whole, F.col("size")) - F.col("population_share")))).alias("max_match"),
        ratio(F.count_if(whole > 0), F.count(F.lit(1))).alias("max_coverage"),
    )
    orders = t.read("orders")
    sizes = (
        orders.groupBy(F.col("o_orderpriority").alias("survey")).agg(F.count(F.lit(1)).alias("sample_size"))
        .unionByName(orders.groupBy(F.col("o_orderstatus").alias("survey")).agg(F.count(F.lit(1)).alias("sample_size")))
        .unionByName(t.read("supplier").groupBy(F.lit("supplier").alias("survey")).agg(F.count(F.lit(1)).alias("sample_size")))
    )
    return scores.nearest_maxima(sizes, maxima)


STORED_SIZES = (100, 1000, 5000)


@query(
    "scorecard_percent_of_max",
    f"""WITH {FULL}, stored AS (SELECT dimension, v.size, 1 - 0.5 * sum(abs(floor(q * v.size) / v.size - q)) AS max_match,
    count(*) FILTER (floor(q * v.size) > 0)::DOUBLE / count(*) AS max_coverage
  FROM bench, (VALUES (100), (1000), (5000)) v(size) WHERE dimension IN ('Segment', 'Country × Segment') GROUP BY dimension, v.size),
nearest AS (SELECT priority, size, row_number() OVER (PARTITION BY priority ORDER BY abs(size - sample_size), size) AS k
  FROM (SELECT DISTINCT priority, sample_size FROM card), (SELECT DISTINCT size FROM stored)),
reach AS (SELECT priority, dimension, max_match, max_coverage FROM nearest JOIN stored USING (size) WHERE k = 1
  UNION ALL SELECT DISTINCT priority, d.dimension, d.m, d.c FROM card, (VALUES ('Country', 0.995::DOUBLE, 0.99::DOUBLE), ('Region', 0.98, 0.99)) d(dimension, m, c))
SELECT card.priority, card.dimension, {q.r("match_score", "match_score")}, {q.r("max_match", "max_match")}, {q.r("match_score / max_match * 100", "match_pct_of_max")},
  {q.r("coverage_score / max_coverage * 100", "coverage_pct_of_max")}
FROM card LEFT JOIN reach ON reach.priority = card.priority AND reach.dimension = card.dimension""",
)
def scorecard_percent_of_max(t):
    """Scores in percent of stored maxima, of fixed stand-ins, or of nothing where neither exists."""
    bench = t.benchmark_for(SEGMENT, COUNTRY_SEGMENT)
    sized = bench.withColumn("size", F.explode(F.array(*[F.lit(s) for s in STORED_SIZES])))
    whole = F.floor(F.col("population_share") * F.col("size"))
    maxima = materialize(
        sized.groupBy("dimension", "size").agg(
            (F.lit(1.0) - F.lit(0.5) * F.sum(F.abs(ratio(whole, F.col("size")) - F.col("population_share")))).alias("max_match"),
            ratio(F.count_if(whole > 0), F.count(F.lit(1))).alias("max_coverage"),
        )
    )
    card = materialize(full_card(t)).withColumnRenamed("priority", "survey")
    sizes = card.groupBy("survey").agg(F.max("sample_size").alias("sample_size"))
    reach = scores.attainable(sizes, maxima).drop("size_used")
    return scores.with_percent_of_max(card, reach, ["survey"]).select(
        F.col("survey").alias("priority"), "dimension", "match_score", "max_match", "match_pct_of_max", "coverage_pct_of_max"
    )


@query(
    "scorecard_missing_columns",
    f"""WITH {q.ORDERS}, {q.lined_up([q.STANDARD[4]], ("segment",))}
SELECT dimension, max(size) AS sample_size, {q.r(q.MATCH, "match_score")}, {q.r(q.COVERAGE, "coverage_score")},
  CAST(NULL AS VARCHAR) AS error FROM aligned GROUP BY dimension
UNION ALL SELECT 'Country', NULL, NULL, NULL, 'Missing columns: [''country'']'
UNION ALL SELECT 'Region', NULL, NULL, NULL, 'Missing columns: [''region'']'""",
)
def scorecard_missing_columns(t):
    """Dimensions the survey cannot answer stay in the scorecard with an error text."""
    thin = t.survey.select("respondent", "segment")
    wanted = (COUNTRY, REGION, SEGMENT)
    able = [d for d in wanted if all(c in thin.columns for c in d.columns)]
    card = scores.match_and_coverage(line_up(cell_counts(thin, ["segment"]), t.benchmark_for(*able), able))
    return scores.unavailable(wanted, thin.columns, card)
