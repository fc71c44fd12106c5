"""Scores and lists by group where a group has no name, and lookups that hold several surveys."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.operators import scores, segments
from stratalens.operators.strata import cell_counts, line_up
from stratalens.plans import sqltext as q
from stratalens.plans.registry import query
from stratalens.plans.testbed import REGION, SEGMENT

DIMS = (REGION, SEGMENT)
NAMED = [("Region", ("region",)), ("Segment", ("segment",))]
KEYS = ("region", "segment")
LABEL = q.label(NAMED, KEYS)


def _lined_up(survey: str) -> str:
    same = q.lined_up(NAMED, KEYS, survey=survey, by=("status",))
    return same.replace("sizes.status = counts.status", "sizes.status IS NOT DISTINCT FROM counts.status")


# Orders without a status are a group of their own.
HOLED = f"""{q.ORDERS}, holed AS (SELECT nullif(status, 'P') AS status, region, segment FROM survey), {_lined_up("holed")}"""
GAPS = f"""gaps AS (SELECT *, {LABEL} AS segment_name, n::DOUBLE / sum(n) OVER (PARTITION BY status, dimension) - q AS dev FROM aligned),
ranked AS (SELECT *, row_number() OVER (PARTITION BY status, dimension ORDER BY round(abs(dev), 12) DESC, segment_name) AS rank FROM gaps)"""


def aligned_by_status(t, holed: bool = True, **options):
    status = F.nullif("status", F.lit("P")) if holed else F.col("status")
    cells = cell_counts(t.survey.withColumn("status", status), KEYS, ["status"])
    return line_up(cells, t.benchmark_for(*DIMS), DIMS, ["status"], **options)


@query(
    "cumulative_gaps_null_group",
    f"""WITH {HOLED}, {GAPS} SELECT status, dimension, segment_name AS segment, rank,
  {q.r("sum(abs(dev) / 2) OVER (PARTITION BY status, dimension ORDER BY rank)", "cumulative_tvd")} FROM ranked""",
)
def cumulative_gaps_null_group(t):
    """Running total variation of every group, the one without a name included."""
    gaps = segments.deviations(aligned_by_status(t, keyed=True))
    running = segments.cumulative_gaps(gaps, DIMS, ["status"])
    return running.select("status", "dimension", F.col("segment"), "rank", "cumulative_tvd")


@query(
    "fix_summary_null_group",
    f"""WITH {HOLED}, {GAPS},
card AS (SELECT status, dimension, 1 - 0.5 * sum(abs(s - q)) AS m, sum(CASE WHEN rank <= 2 THEN abs(dev) / 2 END) AS g FROM ranked GROUP BY ALL),
both_scores AS (SELECT *, least(1.0, m + coalesce(g, 0)) AS p FROM card)
SELECT status, dimension, {q.r("m", "current_score")}, {q.r("p", "potential_score")}, {q.r("p - m", "improvement")},
  {q.r("(p - m) / nullif(m, 0) * 100", "improvement_pct")} FROM both_scores""",
)
def fix_summary_null_group(t):
    """What fixing the two largest gaps would give every group."""
    aligned = aligned_by_status(t, keyed=True)
    top = segments.top_contributors(segments.deviations(aligned), DIMS, 2, by=["status"])
    return segments.fix_summary(top, scores.match_and_coverage(aligned, ["status"]), ["status"])


@query(
    "weighted_detail_null_group",
    f"""WITH {HOLED}, weighted AS (SELECT *, {LABEL} AS stratum, q * {q.SE} AS w FROM aligned)
SELECT status, dimension, stratum, n AS sample_count, {q.r("w", "weight")},
  {q.r("w / sum(w) OVER (PARTITION BY status, dimension)", "normalized_weight")} FROM weighted""",
)
def weighted_detail_null_group(t):
    """Weights normalised within every group."""
    detail = scores.weighted_detail(scores.with_weights(aligned_by_status(t), DIMS), DIMS, ["status"])
    return detail.select("status", "dimension", "stratum", "sample_count", "weight", "normalized_weight")


@query(
    "scorecard_variance_by_survey",
    f"""WITH {q.ORDERS}, {_lined_up("survey")},
urgent AS (SELECT status, segment AS stratum, avg(CASE WHEN priority = '1-URGENT' THEN 1.0 ELSE 0.0 END) AS p FROM survey GROUP BY ALL),
weighted AS (SELECT a.*, q * {q.SE} * coalesce(1 - p * (1 - p), 1) AS w FROM aligned a
  LEFT JOIN urgent u ON a.status = u.status AND a.dimension = 'Segment' AND a.segment = u.stratum)
SELECT status, dimension, count(*) AS strata, {q.r(q.MATCH, "match_score")}, {q.r(q.WEIGHTED, "weighted_score")}
FROM weighted GROUP BY status, dimension""",
)
def scorecard_variance_by_survey(t):
    """One lookup holds the variances of several surveys; each survey is weighted by its own."""
    urgent = F.avg(F.when(F.col("priority") == "1-URGENT", 1.0).otherwise(0.0))
    rates = t.survey.groupBy("status", F.col("segment").alias("stratum")).agg(urgent.alias("p"))
    lookup = rates.select("status", F.lit("Segment").alias("dimension"), "stratum", (F.col("p") * (1 - F.col("p"))).alias("variance"))
    cells = cell_counts(t.survey, KEYS, ["status"])
    card = scores.scorecard(cells, t.benchmark_for(*DIMS), DIMS, ["status"], lookup)
    return card.select("status", "dimension", "strata", "match_score", "weighted_score")
