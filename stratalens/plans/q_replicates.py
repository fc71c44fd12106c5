"""Attainable scores, replicated samples and sub-samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.operators import replicates, scores
from stratalens.operators.strata import cell_counts, line_up
from stratalens.plans import sqltext as q
from stratalens.plans.registry import query
from stratalens.plans.testbed import COUNTRY, COUNTRY_SEGMENT, REGION, SEGMENT, STANDARD

STD = f"{q.PEOPLE}, {q.shares('bench', 'people', q.STANDARD, q.STANDARD_KEYS)}"
STD_LABEL = q.label(q.STANDARD, q.STANDARD_KEYS)
SIZES = (50, 100, 250, 1000)


def _best(sizes) -> str:
    values = ", ".join(f"({s})" for s in sizes)
    return f"""ideal AS (SELECT dimension, {STD_LABEL} AS stratum, CASE WHEN abs(sum(q) OVER (PARTITION BY dimension, size) - 1) > 1e-6 THEN q / sum(q) OVER (PARTITION BY dimension, size) ELSE q END AS q, CAST(size AS BIGINT) AS size
  FROM bench, (VALUES {values}) z(size)),
floored AS (SELECT *, CAST(floor(round(size * q, 9)) AS BIGINT) AS f, round(round(size * q, 9) - floor(round(size * q, 9)), 9) AS rest FROM ideal),
ranked AS (SELECT *, row_number() OVER (PARTITION BY dimension, size ORDER BY rest DESC, stratum) AS k,
  sum(f) OVER (PARTITION BY dimension, size) AS given FROM floored),
best AS (SELECT dimension, size, stratum, q, CAST(f + CASE WHEN k <= size - given THEN 1 ELSE 0 END AS BIGINT) AS n FROM ranked),
curve AS (SELECT dimension, size, count(*) AS strata, count(*) FILTER (q > 1.0::DOUBLE / size) AS relevant_strata,
  1 - 0.5 * sum(abs(n::DOUBLE / size - q)) AS m,
  CASE WHEN count(*) FILTER (q > 1.0::DOUBLE / size) = 0 THEN 1.0 ELSE count(*) FILTER (q > 1.0::DOUBLE / size AND n > 0)::DOUBLE / count(*) FILTER (q > 1.0::DOUBLE / size) END AS c
  FROM best GROUP BY dimension, size)"""


@query(
    "max_match_exact",
    f"""WITH {STD}, {_best((333,))} SELECT dimension, size, stratum, {q.r("q", "population_share")}, n FROM best""",
)
def max_match_exact(t):
    """The whole counts that come closest to the population for one sample size."""
    return replicates.best_allocation(t.benchmark, STANDARD, [333])


@query(
    "size_curve",
    f"""WITH {STD}, {_best(SIZES)} SELECT dimension, size, strata, relevant_strata, {q.r("m", "max_match")}, {q.r("c", "max_coverage")} FROM curve""",
)
def size_curve(t):
    return replicates.size_curve(t.benchmark, STANDARD, SIZES)


@query(
    "size_for_target",
    f"""WITH {STD}, {_best(SIZES)}, gains AS (SELECT *, round(m - lag(m) OVER w, 9) AS gain, lag(size) OVER w AS before FROM curve
  WINDOW w AS (PARTITION BY dimension ORDER BY size))
SELECT dimension, min(size) FILTER (round(m, 9) >= 0.9) AS size_reaching_target, min(before) FILTER (gain < 0.01) AS diminishing_after,
  {q.r("max(m)", "best_match")} FROM gains GROUP BY dimension""",
)
def size_for_target(t):
    return replicates.first_size_reaching(replicates.size_curve(t.benchmark, STANDARD, SIZES), 0.9)


@query(
    "efficiency",
    f"""WITH {q.ORDERS}, {q.lined_up(q.STANDARD, q.STANDARD_KEYS)},
card AS (SELECT dimension, {q.MATCH} AS match_score, {q.COVERAGE} AS coverage_score FROM aligned GROUP BY dimension),
{_best((1000,))}
SELECT dimension, {q.r("match_score", "match_score")}, {q.r("m", "max_match")}, {q.r("c", "max_coverage")},
  {q.r("CASE WHEN m > 0 THEN least(1.0, match_score / m) ELSE 0 END", "efficiency")},
  {q.r("match_score / m * 100", "match_pct_of_max")}, {q.r("coverage_score / c * 100", "coverage_pct_of_max")}
FROM card JOIN curve USING (dimension)""",
)
def efficiency(t):
    card = scores.match_and_coverage(t.aligned(STANDARD))
    maxima = replicates.size_curve(t.benchmark, STANDARD, [1000]).select("dimension", "max_match", "max_coverage")
    full = scores.with_percent_of_max(card, maxima)
    return full.select(
        "dimension", "match_score", "max_match", "max_coverage",
        scores.efficiency(F.col("match_score"), F.col("max_match")).alias("efficiency"), "match_pct_of_max", "coverage_pct_of_max",
    )


SUB_DIMS = [q.STANDARD[2], q.STANDARD[3], q.STANDARD[4]]
SUB = f"""drawn AS (SELECT respondent, country, region, segment, replicate, md5(concat_ws('|', respondent, replicate)) AS o FROM survey, range(5) z(replicate)),
placed AS (SELECT *, row_number() OVER (PARTITION BY replicate ORDER BY o, respondent) AS place FROM drawn),
sub AS (SELECT size, replicate, country, region, segment FROM placed, (VALUES (50), (200)) z(size) WHERE place <= size
  UNION ALL SELECT 0, 0, country, region, segment FROM survey)"""
SUB_KEYS = ("country", "region", "segment")


SUB_CARD = f"""{SUB}, {q.lined_up(SUB_DIMS, SUB_KEYS, survey="sub", by=("size", "replicate"), total="total")},
card AS (SELECT size, replicate, dimension, {q.MATCH} AS m, {q.COVERAGE} AS c FROM aligned GROUP BY ALL)"""


def _cards(t):
    """Scores of five random sub-samples of 50 and 200 respondents, and of the whole survey (size 0)."""
    dims = (COUNTRY, REGION, SEGMENT)
    return replicates.subsample_scores(t.survey, "respondent", t.benchmark_for(*dims), dims, [50, 200], 5)


@query(
    "replicate_scores",
    f"""WITH {q.ORDERS}, {SUB_CARD}
SELECT dimension, CAST(size AS BIGINT) AS size, replicate, {q.r("m", "match_score")}, {q.r("c", "coverage_score")} FROM card WHERE size > 0""",
)
def replicate_scores(t):
    """Match and coverage of every real sub-sample."""
    return _cards(t).where("size > 0").select("dimension", "size", "replicate", "match_score", "coverage_score")


@query(
    "replicate_statistics",
    f"""WITH {q.ORDERS}, {SUB_CARD}
SELECT dimension, CAST(size AS BIGINT) AS size, count(*) AS replicates, {q.r("avg(c)", "mean")}, {q.r("stddev_pop(c)", "std")}, {q.r("min(c)", "min")}, {q.r("max(c)", "max")},
  {q.r("median(c)", "median")}, {q.r("quantile_cont(c, 0.25)", "q25")}, {q.r("quantile_cont(c, 0.75)", "q75")} FROM card WHERE size > 0 GROUP BY dimension, size""",
)
def replicate_statistics(t):
    """Spread of the coverage over real sub-samples."""
    return replicates.replicate_statistics(_cards(t).where("size > 0"), ["dimension", "size"], "coverage_score")


@query(
    "subsample_stability",
    f"""WITH {q.ORDERS}, {SUB}, {q.lined_up(SUB_DIMS, SUB_KEYS, survey="sub", by=("size", "replicate"), total="total")},
weighted AS (SELECT *, q * {q.SE} AS w FROM aligned),
card AS (SELECT size, replicate, dimension, {q.MATCH} AS m, {q.COVERAGE} AS c, {q.STRATEGIC} AS st, {q.WEIGHTED} AS v FROM weighted GROUP BY ALL)
SELECT CAST(size AS BIGINT) AS size, dimension, count(*) AS replicates, {q.r("avg(m)", "match_mean")}, {q.r("stddev_pop(m)", "match_std")},
  {q.r("avg(c)", "coverage_mean")}, {q.r("avg(st)", "strategic_mean")}, {q.r("avg(v)", "weighted_mean")} FROM card GROUP BY size, dimension""",
)
def subsample_stability(t):
    """Five random sub-samples of 50 and 200 respondents next to the whole survey (size 0)."""
    return _cards(t).groupBy("size", "dimension").agg(
        F.count(F.lit(1)).alias("replicates"),
        F.avg("match_score").alias("match_mean"),
        F.stddev_pop("match_score").alias("match_std"),
        F.avg("coverage_score").alias("coverage_mean"),
        F.avg("strategic_score").alias("strategic_mean"),
        F.avg("weighted_score").alias("weighted_mean"),
    )


AUTO_DIM = [q.STANDARD[0]]


@query(
    "subsample_stability_auto",
    f"""WITH {q.ORDERS}, {SUB}, {q.shares("bench", "people", AUTO_DIM, ("country", "segment"))},
totals AS (SELECT size, replicate, count(*) AS total FROM sub GROUP BY ALL),
bars AS (SELECT size, greatest(1.0::DOUBLE / max(total), 0.001) AS bar FROM totals GROUP BY size),
marked AS (SELECT bench.*, size, q >= bar OR (SELECT count(*) FROM bench) <= 50 AS keep FROM bench, bars),
folded AS (SELECT size, country, segment, q FROM marked WHERE keep
  UNION ALL SELECT * FROM (SELECT size, 'Other Countries', 'Other Countries', sum(q) AS q FROM marked WHERE NOT keep GROUP BY size) WHERE q > 0),
e AS (SELECT totals.*, country, segment, q FROM folded JOIN totals USING (size)),
c AS (SELECT size, replicate, country, segment, count(*)::DOUBLE / max(total) AS s FROM sub JOIN totals USING (size, replicate) GROUP BY ALL),
card AS (SELECT coalesce(e.size, c.size) AS size, coalesce(e.replicate, c.replicate) AS replicate, 1 - 0.5 * sum(abs(coalesce(s, 0) - coalesce(q, 0))) AS m
  FROM e FULL OUTER JOIN c ON e.size = c.size AND e.replicate = c.replicate AND e.country = c.country AND e.segment = c.segment GROUP BY ALL)
SELECT CAST(size AS BIGINT) AS size, count(*) AS replicates, {q.r("avg(m)", "match_mean")}, {q.r("stddev_pop(m)", "match_std")} FROM card GROUP BY size""",
)
def subsample_stability_auto(t):
    """The same, each size against a benchmark simplified for it."""
    dims = (COUNTRY_SEGMENT,)
    cards = replicates.subsample_scores(t.survey, "respondent", t.benchmark_for(*dims), dims, [50, 200], 5, "auto")
    return cards.groupBy("size").agg(
        F.count(F.lit(1)).alias("replicates"), F.avg("match_score").alias("match_mean"), F.stddev_pop("match_score").alias("match_std")
    )


LISTED = "country IN ('NATION_1', 'NATION_5', 'NATION_9')"


@query(
    "subsample_stability_listed",
    f"""WITH {q.ORDERS}, {SUB}, {q.shares("bench", "people", [q.STANDARD[2]], ("country",))},
folded AS (SELECT country, q FROM bench WHERE {LISTED} UNION ALL SELECT 'Other Countries', 1 - sum(q) FROM bench WHERE {LISTED}),
totals AS (SELECT size, replicate, count(*) AS total FROM sub GROUP BY ALL),
e AS (SELECT totals.*, country, q FROM folded, totals),
c AS (SELECT size, replicate, country, count(*)::DOUBLE / max(total) AS s FROM sub JOIN totals USING (size, replicate) GROUP BY ALL),
card AS (SELECT coalesce(e.size, c.size) AS size, coalesce(e.replicate, c.replicate) AS replicate, 1 - 0.5 * sum(abs(coalesce(s, 0) - coalesce(q, 0))) AS m
  FROM e FULL OUTER JOIN c ON e.size = c.size AND e.replicate = c.replicate AND e.country = c.country GROUP BY ALL)
SELECT CAST(size AS BIGINT) AS size, count(*) AS replicates, {q.r("avg(m)", "match_mean")}, {q.r("stddev_pop(m)", "match_std")} FROM card GROUP BY size""",
)
def subsample_stability_listed(t):
    """The same against a benchmark that keeps three countries."""
    kept = t.population.where(LISTED).select("country").distinct()
    cards = replicates.subsample_scores(t.survey, "respondent", t.benchmark_for(COUNTRY), (COUNTRY,), [50, 200], 5, "listed", kept)
    return cards.groupBy("size").agg(
        F.count(F.lit(1)).alias("replicates"), F.avg("match_score").alias("match_mean"), F.stddev_pop("match_score").alias("match_std")
    )


@query(
    "subsample_statistics",
    f"""WITH {q.ORDERS}, {SUB}, {q.lined_up(SUB_DIMS, SUB_KEYS, survey="sub", by=("size", "replicate"), total="total")},
card AS (SELECT size, replicate, dimension, {q.MATCH} AS m FROM aligned GROUP BY ALL)
SELECT CAST(size AS BIGINT) AS size, dimension, count(*) AS replicates, {q.r("avg(m)", "mean")}, {q.r("stddev_pop(m)", "std")}, {q.r("min(m)", "min")},
  {q.r("max(m)", "max")}, {q.r("median(m)", "median")}, {q.r("quantile_cont(m, 0.25)", "q25")}, {q.r("quantile_cont(m, 0.75)", "q75")}
FROM card GROUP BY size, dimension""",
)
def subsample_statistics(t):
    """Spread of the match score over real sub-samples."""
    return replicates.replicate_statistics(_cards(t), ["size", "dimension"], "match_score")


@query(
    "expected_coverage",
    f"""WITH {STD}, hits AS (SELECT dimension, CAST(size AS BIGINT) AS size, CAST(k AS BIGINT) AS at_least,
    CASE WHEN k = 1 THEN 1 - pow(1 - q, size) ELSE 1 - pow(1 - q, size) - size * q * pow(1 - q, size - 1) END AS hit
  FROM bench, (VALUES (50), (200), (1000)) z(size), (VALUES (1), (2)) y(k))
SELECT dimension, size, at_least, count(*) AS strata, {q.r("sum(hit)", "expected_strata")}, {q.r("avg(hit)", "expected_coverage")}
FROM hits GROUP BY dimension, size, at_least""",
)
def expected_coverage(t):
    return replicates.expected_coverage(t.benchmark, [50, 200, 1000])


@query(
    "sensitivity",
    f"""WITH {q.PEOPLE}, vendors AS (SELECT n_name AS country FROM supplier JOIN nation ON s_nationkey = n_nationkey),
{q.lined_up([q.STANDARD[2]], ("country",), survey="vendors")},
varied AS (SELECT country, q, k AS override, CASE WHEN country = 'NATION_3' THEN k ELSE n END AS n2,
    size - (SELECT n FROM aligned WHERE country = 'NATION_3') + k AS total FROM aligned, range(10) z(k) WHERE in_bench),
shared AS (SELECT override, q, n2, n2::DOUBLE / total AS s FROM varied),
weighted AS (SELECT *, q * CASE WHEN n2 > 0 THEN sqrt(s * (1 - s) / n2) ELSE 1.0 END AS w FROM shared)
SELECT override, {q.r("1 - 0.5 * sum(abs(s - q))", "match_score")}, {q.r("1 - sum(w * abs(s - q)) / sum(w)", "weighted_score")} FROM weighted GROUP BY override""",
)
def sensitivity(t):
    aligned = line_up(cell_counts(t.supplier_survey, ["country"]), t.benchmark_for(COUNTRY), [COUNTRY])
    return replicates.sensitivity(aligned, COUNTRY, "NATION_3", range(10))
