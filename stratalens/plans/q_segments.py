"""Segment analysis over the orders survey and the labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.operators import scores, segments
from stratalens.operators.strata import cell_counts, line_up
from stratalens.plans import sqltext as q
from stratalens.plans.q_scores import FULL, WEIGHTED_DOC, full_card, label_variance
from stratalens.plans.registry import query
from stratalens.plans.testbed import COUNTRY, COUNTRY_SEGMENT, DOCUMENT
from stratalens.session import materialize

DOC = f"""{q.LABELLED}, {q.lined_up(q.DOCUMENT, q.DOCUMENT_KEYS, survey="labelled", base="documents")}"""
GAPS = """gaps AS (
  SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY dimension) - q AS dev, n::DOUBLE / sum(n) OVER (PARTITION BY dimension) AS sk
  FROM aligned)"""
DOC_LABEL = q.label(q.DOCUMENT, q.DOCUMENT_KEYS)


def doc_gaps(t):
    return segments.deviations(t.document_aligned(DOCUMENT, keyed=True))


@query(
    "deviations",
    f"""WITH {DOC}, {GAPS}
SELECT dimension, lang, source, n, {q.r("sk", "sample_share")}, {q.r("q", "population_share")}, {q.r("dev", "deviation")},
  {q.r("abs(dev)", "abs_deviation")}, {q.r("dev / nullif(q, 0)", "relative_deviation")}, {q.r("abs(dev) / 2", "tvd_share")},
  CASE WHEN dev <= -0.001 THEN 'under' WHEN dev <= 0.001 THEN 'balanced' ELSE 'over' END AS representation
FROM gaps""",
)
def deviations(t):
    gaps = doc_gaps(t).withColumn("representation", segments.representation(F.col("deviation")))
    return gaps.select(
        "dimension", "lang", "source", "n", "sample_share", "population_share", "deviation", "abs_deviation",
        "relative_deviation", "tvd_share", "representation",
    )


@query(
    "deviations_null_keys",
    f"""WITH {q.ORDERS}, holed AS (SELECT nullif(segment, 'MACHINERY') AS segment, country FROM survey),
{q.lined_up([q.STANDARD[0]], ("country", "segment"), survey="holed")}, {GAPS}
SELECT dimension, country, segment, n, {q.r("sk", "sample_share")}, {q.r("s", "row_share")}, {q.r("dev", "deviation")} FROM gaps""",
)
def deviations_null_keys(t):
    """With missing keys the two denominators differ: keyed respondents against all respondents."""
    holed = t.survey.withColumn("segment", F.nullif("segment", F.lit("MACHINERY")))
    cells = cell_counts(holed, COUNTRY_SEGMENT.columns)
    aligned = line_up(cells, t.benchmark_for(COUNTRY_SEGMENT), [COUNTRY_SEGMENT], keyed=True)
    aligned = aligned.withColumn("row_share", F.col("sample_share"))
    return segments.deviations(aligned).select(
        "dimension", "country", "segment", "n", "sample_share", "row_share", "deviation"
    )


CATEGORIES = f"""{DOC}, cats AS (
  SELECT dimension, CASE dimension WHEN 'Language × Source' THEN 'lang:' || lang || ' × source:' || source
      WHEN 'Language' THEN 'lang:' || lang ELSE 'source:' || source END AS stratum,
    n, q, s, (s / q - 1) * 100 AS pct, 100 * abs(s - q) / 2 AS points FROM aligned WHERE in_bench),
labelled_cats AS (SELECT *, CASE WHEN n = 0 THEN 'Missing' WHEN pct > 50 THEN 'Highly Over-represented'
  WHEN pct > 0 THEN 'Over-represented' WHEN pct > -50 THEN 'Under-represented' ELSE 'Highly Under-represented' END AS category FROM cats)"""


def doc_categories(t):
    return segments.category_table(t.document_aligned(DOCUMENT), DOCUMENT)


@query(
    "deviation_categories",
    f"""WITH {CATEGORIES}
SELECT dimension, stratum, n AS sample_count, {q.r("q", "population_share")}, {q.r("s", "sample_share")},
  {q.r("s - q", "signed_deviation")}, {q.r("abs(s - q)", "absolute_deviation")}, {q.r("points", "contribution_points")},
  {q.r("(s - q) * 100", "deviation_points")}, {q.r("s / q", "representation_ratio")}, {q.r("pct", "over_under_pct")}, category
FROM labelled_cats""",
)
def deviation_categories(t):
    return doc_categories(t)


def _top_sql(count: int, where: str) -> str:
    return f"""named AS (SELECT *, {DOC_LABEL} AS segment FROM gaps WHERE q >= 0.0001 AND {where}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY round(abs(dev), 12) DESC, segment) AS rank FROM named),
top AS (SELECT *, sum(abs(dev) / 2) OVER (PARTITION BY dimension ORDER BY rank) AS cum FROM ranked WHERE rank <= {count})"""


TOP_COLUMNS = f"""dimension, rank, segment, {q.r("sk", "sample_share")}, {q.r("q", "population_share")}, {q.r("dev", "deviation")},
  {q.r("abs(dev)", "abs_deviation")}, {q.r("dev / q", "relative_deviation")}, {q.r("abs(dev) / 2", "tvd_share")},
  CASE WHEN dev <= -0.001 THEN 'under' WHEN dev <= 0.001 THEN 'balanced' ELSE 'over' END AS representation, {q.r("cum", "cumulative_tvd")}"""


@query("top_contributors", f"""WITH {DOC}, {GAPS}, {_top_sql(10, "true")} SELECT {TOP_COLUMNS} FROM top""")
def top_contributors(t):
    return segments.top_contributors(doc_gaps(t), DOCUMENT, 10)


@query("top_over_contributors", f"""WITH {DOC}, {GAPS}, {_top_sql(5, "dev > 0")} SELECT {TOP_COLUMNS} FROM top""")
def top_over_contributors(t):
    return segments.top_contributors(doc_gaps(t), DOCUMENT, 5, "over")


@query("top_under_contributors", f"""WITH {DOC}, {GAPS}, {_top_sql(5, "dev < 0")} SELECT {TOP_COLUMNS} FROM top""")
def top_under_contributors(t):
    return segments.top_contributors(doc_gaps(t), DOCUMENT, 5, "under")


@query(
    "top_per_dimension",
    f"""WITH {CATEGORIES},
ranked AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY round(points, 9) DESC, stratum) AS k FROM labelled_cats)
SELECT dimension, count(*) AS segments, count(*) FILTER (n > 0) AS represented, count(*) FILTER (n = 0) AS missing,
  {q.r("sum(points)", "total_contribution")}, {q.r("sum(points) FILTER (k <= 10)", "top_contribution")}
FROM ranked GROUP BY dimension""",
)
def top_per_dimension(t):
    return segments.dimension_totals(doc_categories(t), 10)


@query(
    "top_overall",
    f"""WITH {CATEGORIES}
SELECT row_number() OVER (ORDER BY round(points, 9) DESC, dimension, stratum) AS rank, dimension, stratum, category,
  {q.r("points", "contribution_points")} FROM labelled_cats ORDER BY rank LIMIT 20""",
)
def top_overall(t):
    order = [F.desc(F.round("contribution_points", 9)), F.col("dimension"), F.col("stratum")]
    top = segments.first_rows(doc_categories(t), order, 20)
    return top.select("rank", "dimension", "stratum", "category", "contribution_points")


IMPACT = f"""{DOC}, {GAPS}, {_top_sql(10, "true")},
card AS (SELECT dimension, {q.MATCH} AS m FROM aligned GROUP BY dimension)"""


@query(
    "fix_impact",
    f"""WITH {IMPACT} SELECT dimension, rank, segment, {q.r("abs(dev) / 2", "individual_impact")},
  {q.r("least(1.0, m + cum)", "cumulative_score")} FROM top JOIN card USING (dimension)""",
)
def fix_impact(t):
    aligned = materialize(t.document_aligned(DOCUMENT, keyed=True))
    top = segments.top_contributors(segments.deviations(aligned), DOCUMENT, 10)
    return segments.fix_impact(top, scores.match_and_coverage(aligned))


@query(
    "fix_summary",
    f"""WITH {IMPACT}, gain AS (SELECT dimension, sum(abs(dev) / 2) AS g FROM top GROUP BY dimension),
both_scores AS (SELECT dimension, m, least(1.0, m + coalesce(g, 0)) AS p FROM card LEFT JOIN gain USING (dimension))
SELECT dimension, {q.r("m", "current_score")}, {q.r("p", "potential_score")}, {q.r("p - m", "improvement")},
  {q.r("(p - m) / nullif(m, 0) * 100", "improvement_pct")} FROM both_scores""",
)
def fix_summary(t):
    aligned = materialize(t.document_aligned(DOCUMENT, keyed=True))
    top = segments.top_contributors(segments.deviations(aligned), DOCUMENT, 10)
    return segments.fix_summary(top, scores.match_and_coverage(aligned))


CUMULATIVE = f"""{DOC}, {GAPS}, named AS (SELECT *, {DOC_LABEL} AS segment FROM gaps),
ranked AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY round(abs(dev), 12) DESC, segment) AS rank FROM named),
cumulative AS (SELECT *, sum(abs(dev) / 2) OVER (PARTITION BY dimension ORDER BY rank) AS cum FROM ranked)"""


@query(
    "cumulative_gaps",
    f"""WITH {CUMULATIVE} SELECT dimension, rank, segment, {q.r("abs(dev) / 2", "tvd_share")}, {q.r("cum", "cumulative_tvd")}
FROM cumulative""",
)
def cumulative_gaps(t):
    return segments.cumulative_gaps(doc_gaps(t), DOCUMENT).select(
        "dimension", "rank", "segment", "tvd_share", "cumulative_tvd"
    )


@query(
    "segments_to_target",
    f"""WITH {CUMULATIVE}, targets AS (SELECT * FROM (VALUES (0.05::DOUBLE), (0.10), (0.15)) v(target))
SELECT dimension, target, min(rank) FILTER (round(cum, 9) >= target) AS segments_needed
FROM cumulative, targets GROUP BY dimension, target""",
)
def segments_to_target(t):
    return segments.segments_to_target(segments.cumulative_gaps(doc_gaps(t), DOCUMENT), [0.05, 0.10, 0.15])


@query(
    "country_rollup_dev",
    f"""WITH {q.ORDERS}, {q.lined_up([q.STANDARD[0]], ("country", "segment"), by=("priority",))},
summed AS (SELECT priority, country, sum(s) AS s, sum(q) AS q, round(sum(s) - sum(q), 12) AS dev FROM aligned GROUP BY priority, country),
ranked AS (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY abs(dev) DESC, country) AS rank FROM summed)
SELECT priority, rank, country, {q.r("s", "sample_share")}, {q.r("q", "population_share")}, {q.r("dev", "deviation")},
  CASE WHEN dev > 0 THEN 'Over' ELSE 'Under' END AS status FROM ranked WHERE rank <= 10""",
)
def country_rollup_dev(t):
    aligned = t.aligned([COUNTRY_SEGMENT], ["priority"])
    return segments.parent_roll_up(aligned, "country", 10, ["priority"])


@query(
    "distribution_overlay",
    f"""WITH {q.PEOPLE}, vendors AS (SELECT n_name AS country FROM supplier JOIN nation ON s_nationkey = n_nationkey),
{q.lined_up([q.STANDARD[2]], ("country",), survey="vendors")}
SELECT row_number() OVER (ORDER BY n DESC, country) AS rank, country, n, {q.r("s", "sample_share")},
  {q.r("CASE WHEN in_bench THEN q END", "population_share")} FROM aligned WHERE n > 0 ORDER BY rank LIMIT 10""",
)
def distribution_overlay(t):
    cells = cell_counts(t.supplier_survey, ["country"])
    return segments.distribution(line_up(cells, t.benchmark_for(COUNTRY), [COUNTRY]), "country", 10)


@query(
    "recruitment_list",
    f"""WITH {CATEGORIES}
SELECT row_number() OVER (ORDER BY round((q - s) * 100, 9) DESC, dimension, stratum) AS rank, dimension, stratum, category,
  {q.r("(q - s) * 100", "points_needed")} FROM labelled_cats WHERE s < q ORDER BY rank LIMIT 15""",
)
def recruitment_list(t):
    return segments.recruitment_list(doc_categories(t), 15)


@query(
    "over_and_under",
    f"""WITH {DOC}, {GAPS}, named AS (SELECT *, {DOC_LABEL} AS segment, CASE WHEN dev > 0 THEN 'over' ELSE 'under' END AS side
  FROM gaps WHERE dev <> 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY dimension, side ORDER BY round(abs(dev), 12) DESC, segment) AS rank FROM named)
SELECT dimension, side, rank, segment, {q.r("dev", "deviation")} FROM ranked WHERE rank <= 5""",
)
def over_and_under(t):
    return segments.over_and_under(doc_gaps(t), DOCUMENT, 5)


@query(
    "segment_statistics",
    f"""WITH {DOC}, {GAPS}
SELECT dimension, count(*) AS segments, count(*) FILTER (sk > 0) AS represented, {q.r("avg(abs(dev))", "mean_abs_deviation")},
  {q.r("max(abs(dev))", "max_abs_deviation")}, count(*) FILTER (dev > 0.001) AS over, count(*) FILTER (dev < -0.001) AS under,
  count(*) FILTER (abs(dev) <= 0.001) AS balanced FROM gaps GROUP BY dimension""",
)
def segment_statistics(t):
    return segments.segment_statistics(doc_gaps(t))


@query(
    "weight_shift",
    f"""WITH {WEIGHTED_DOC}, both_weights AS (
  SELECT dimension, stratum, q * se / sum(q * se) OVER (PARTITION BY dimension) AS w0, w / sum(w) OVER (PARTITION BY dimension) AS w1,
    w * abs(s - q) / sum(w * abs(s - q)) OVER (PARTITION BY dimension) * 100 AS pct FROM weighted)
SELECT dimension, stratum, {q.r("w0", "weight_plain")}, {q.r("w1", "weight_informed")}, {q.r("w1 - w0", "weight_change")},
  {q.r("pct", "error_share_pct")} FROM both_weights""",
)
def weight_shift(t):
    aligned = materialize(t.document_aligned(DOCUMENT))
    plain = scores.weighted_detail(scores.with_weights(aligned, DOCUMENT), DOCUMENT)
    informed = scores.weighted_detail(scores.with_weights(aligned, DOCUMENT, label_variance(t)), DOCUMENT)
    return segments.weight_shift(plain, informed, DOCUMENT)


@query(
    "boost_factors",
    f"""WITH {q.shares("bench", "documents", q.DOCUMENT, q.DOCUMENT_KEYS)},
targets AS (SELECT *, sqrt(q) / sum(sqrt(q)) OVER (PARTITION BY dimension) AS t FROM bench),
named AS (SELECT *, {DOC_LABEL} AS stratum FROM targets),
ranked AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY round(t / q, 9) DESC, stratum) AS rank FROM named)
SELECT dimension, rank, stratum, {q.r("q", "population_share")}, {q.r("t", "target_share")}, {q.r("t / q", "boost")}
FROM ranked WHERE rank <= 10""",
)
def boost_factors(t):
    return segments.boosted(scores.target_shares(t.document_shares(*DOCUMENT)), DOCUMENT, 10)


@query(
    "dimension_extremes",
    f"""WITH {FULL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY round(match_score, 9) DESC, dimension) AS hi,
  row_number() OVER (PARTITION BY priority ORDER BY round(match_score, 9), dimension) AS lo FROM card)
SELECT priority, 'top' AS "end", hi AS rank, dimension, {q.r("match_score", "match_score")}, match_score < 0.8 AS needs_attention,
  match_score < 0.5 AS critical FROM ranked WHERE hi <= 3
UNION ALL SELECT priority, 'bottom', lo, dimension, {q.r("match_score", "match_score")}, match_score < 0.8, match_score < 0.5
FROM ranked WHERE lo <= 3""",
)
def dimension_extremes(t):
    return segments.dimension_extremes(full_card(t), 3, by=["priority"])


@query(
    "score_gap",
    f"""WITH {FULL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY round(match_score, 9) DESC, dimension) AS hi,
  row_number() OVER (PARTITION BY priority ORDER BY round(match_score, 9), dimension) AS lo FROM card)
SELECT priority, max(dimension) FILTER (hi = 1) AS best, max(dimension) FILTER (lo = 1) AS worst,
  {q.r("max(match_score) - min(match_score)", "gap")} FROM ranked GROUP BY priority""",
)
def score_gap(t):
    return segments.score_gap(full_card(t), by=["priority"])


@query(
    "detail_sorted",
    f"""WITH {DOC} SELECT dimension, {DOC_LABEL} AS stratum, {q.r("q", "population_share")}, {q.r("s", "sample_share")} FROM aligned
ORDER BY q DESC, dimension, stratum""",
)
def detail_sorted(t):
    detail = scores.strategic_detail(t.document_aligned(DOCUMENT, targets=True), DOCUMENT)
    return segments.detail_order(detail.select("dimension", "stratum", "population_share", "sample_share"), ["dimension", "stratum"])
