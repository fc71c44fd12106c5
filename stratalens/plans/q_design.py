"""Benchmark reshaping and sample allocation."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.operators import allocation, reshape, scores
from stratalens.operators.strata import cell_counts, dimension_name, line_up, sample_sizes
from stratalens.plans import sqltext as q
from stratalens.plans.registry import query
from stratalens.plans.testbed import COUNTRY, STANDARD

STD = f"{q.PEOPLE}, {q.shares('bench', 'people', q.STANDARD, q.STANDARD_KEYS)}"
STD_LABEL = q.label(q.STANDARD, q.STANDARD_KEYS)
RANKED = f"""named AS (SELECT *, {STD_LABEL} AS lbl FROM bench),
ranked AS (SELECT *, row_number() OVER w AS k, sum(q) OVER w AS cum FROM named
  WINDOW w AS (PARTITION BY dimension ORDER BY round(q, 15) DESC, lbl ROWS UNBOUNDED PRECEDING))"""


def folded(source: str, keep: str, labels: dict[str, str], dims=q.STANDARD, keys=q.STANDARD_KEYS) -> str:
    """Kept rows plus one summed row per dimension."""
    filled = ", ".join(
        "CASE " + " ".join(f"WHEN dimension = '{d}' THEN '{labels[d]}'" for d, cols in dims if k in cols) + f" END AS {k}"
        for k in keys
    )
    cols = ", ".join(keys)
    return f"""folded AS (
  SELECT dimension, {cols}, q FROM {source} WHERE {keep}
  UNION ALL SELECT * FROM (SELECT dimension, {filled}, sum(q) AS q FROM {source} WHERE NOT ({keep}) GROUP BY dimension) WHERE q > 0)"""


PLAIN = {d: "Others" for d, _ in q.STANDARD}
SHOW = f"SELECT dimension, country, segment, region, {q.r('q', 'population_share')} FROM folded"


@query("simplify_topn", f"WITH {STD}, {RANKED}, {folded('ranked', 'k <= 4', PLAIN)} {SHOW}")
def simplify_topn(t):
    return reshape.simplify(t.benchmark, STANDARD, top=4)


@query("simplify_threshold", f"WITH {STD}, {folded('bench', 'q >= 0.04', PLAIN)} {SHOW}")
def simplify_threshold(t):
    return reshape.simplify(t.benchmark, STANDARD, threshold=0.04)


@query("simplify_coverage", f"WITH {STD}, {RANKED}, {folded('ranked', '(k = 1 OR round(cum - q, 12) < 0.8)', PLAIN)} {SHOW}")
def simplify_coverage(t):
    return reshape.simplify(t.benchmark, STANDARD, coverage=0.8)


VENDORS = """vendors AS (SELECT n_name AS country, r_name AS region, CASE WHEN s_acctbal > 5000 THEN 'BUILDING' ELSE 'MACHINERY' END AS segment
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
AUTO_LABELS = {
    "Country × Segment": "Other Countries",
    "Region × Segment": "Other Regions",
    "Country": "Other Countries",
    "Region": "Other Regions",
    "Segment": "Others",
}


def vendors(t):
    """Suppliers as a survey, with a segment made from their balance."""
    supplier = t.read("supplier").withColumn("segment", F.when(F.col("s_acctbal") > 5000, "BUILDING").otherwise("MACHINERY"))
    return supplier.join(t.places, supplier.s_nationkey == F.col("n_nationkey")).select("country", "region", "segment")


@query(
    "simplify_auto",
    f"""WITH {STD}, {VENDORS}, sized AS (SELECT *, count(*) OVER (PARTITION BY dimension) AS strata FROM bench),
barred AS (SELECT *, strata > CASE WHEN dimension = 'Segment' THEN 100 ELSE 50 END AS crowded,
  greatest(1.0::DOUBLE / (SELECT count(*) FROM vendors), 0.001) AS bar FROM sized),
{folded("barred", "(NOT crowded OR q >= bar)", AUTO_LABELS)} {SHOW}""",
)
def simplify_auto(t):
    cells = cell_counts(vendors(t), ["country", "segment", "region"])
    return reshape.auto_simplify(t.benchmark, STANDARD, sample_sizes(cells, STANDARD))


@query(
    "simplify_adaptive",
    f"""WITH {q.PEOPLE}, {VENDORS}, {q.lined_up(q.STANDARD, q.STANDARD_KEYS, survey="vendors")},
named AS (SELECT *, n > 0 AS hit, {STD_LABEL} AS lbl FROM aligned WHERE in_bench),
ranked AS (SELECT *, row_number() OVER w AS k, sum(q) OVER w AS cum FROM named
  WINDOW w AS (PARTITION BY dimension ORDER BY hit DESC, round(q, 15) DESC, lbl ROWS UNBOUNDED PRECEDING)),
{folded("ranked", "(hit OR round(cum, 12) <= 0.7 OR (k > 1 AND round(cum - q, 12) < 0.7))", PLAIN)} {SHOW}""",
)
def simplify_adaptive(t):
    cells = cell_counts(vendors(t), ["country", "segment", "region"])
    return reshape.adaptive_simplify(line_up(cells, t.benchmark, STANDARD), STANDARD, 0.7)


@query(
    "simplify_list",
    f"""WITH {q.PEOPLE}, {q.shares("bench", "people", [q.STANDARD[2]], ("country",))},
kept AS (SELECT dimension, country, q FROM bench WHERE country IN (SELECT n_name FROM nation WHERE n_regionkey IN (1, 3)))
SELECT dimension, country, {q.r("q", "population_share")} FROM kept
UNION ALL SELECT dimension, 'Others', {q.r("1 - sum(q)", "q")} FROM kept GROUP BY dimension HAVING round(1 - sum(q), 12) > 0""",
)
def simplify_list(t):
    """The kept list comes from a table: here the countries of two regions."""
    listed = t.read("nation").where("n_regionkey IN (1, 3)").select(F.col("n_name").alias("country"))
    return reshape.keep_listed(t.benchmark_for(COUNTRY), COUNTRY, listed)


@query(
    "simplify_impact",
    f"""WITH {STD}, {folded("bench", "q >= 0.04", PLAIN)},
before AS (SELECT dimension, count(*) AS o FROM bench GROUP BY dimension),
after AS (SELECT dimension, count(*) AS s, coalesce(sum(q) FILTER (lower(CASE WHEN dimension LIKE 'Country%' THEN country
    WHEN dimension LIKE 'Region%' THEN region ELSE segment END) LIKE '%other%'), 0) AS x FROM folded GROUP BY dimension)
SELECT dimension, o AS original_strata, s AS simplified_strata, {q.r("(o - s)::DOUBLE / o", "reduction_ratio")},
  {q.r("x", "others_share")}, CAST(o - s + CASE WHEN x > 0 THEN 1 ELSE 0 END AS BIGINT) AS others_strata, {q.r("1 - x", "kept_coverage")}
FROM before JOIN after USING (dimension)""",
)
def simplify_impact(t):
    return reshape.simplification_impact(t.benchmark, reshape.simplify(t.benchmark, STANDARD, threshold=0.04), STANDARD)


def _scores_on_folded(relabel: bool) -> str:
    survey = "survey"
    extra = ""
    if relabel:
        survey = "renamed"
        extra = """renamed AS (SELECT CASE WHEN country IN (SELECT country FROM folded WHERE country <> 'Other Countries') THEN country
    ELSE 'Other Countries' END AS country FROM survey),"""
    return f"""WITH {q.ORDERS}, {q.shares("bench", "people", [q.STANDARD[2]], ("country",))},
{folded("bench", "q >= 0.04", {"Country": "Other Countries"}, [q.STANDARD[2]], ("country",))}, {extra}
c AS (SELECT country, count(*)::DOUBLE / (SELECT count(*) FROM survey) AS s FROM {survey} GROUP BY country)
SELECT 'Country' AS dimension, {q.r("1 - 0.5 * sum(abs(coalesce(s, 0) - coalesce(q, 0)))", "match_score")}, count(*) AS strata
FROM folded FULL OUTER JOIN c ON folded.country = c.country"""


def _folded_score(t, relabel: bool):
    folded_bench = reshape.simplify(t.benchmark_for(COUNTRY), [COUNTRY], threshold=0.04, label="Other Countries")
    survey = t.survey
    if relabel:
        survey = reshape.relabel_survey(survey, folded_bench, COUNTRY, "Other Countries")
    aligned = line_up(cell_counts(survey, ["country"]), folded_bench, [COUNTRY])
    return aligned.groupBy("dimension").agg(scores.match_of().alias("match_score"), F.count(F.lit(1)).alias("strata"))


@query("simplified_score", _scores_on_folded(False))
def simplified_score(t):
    """Only the benchmark is folded: respondents of folded strata match nothing."""
    return _folded_score(t, False)


@query("simplified_score_relabelled", _scores_on_folded(True))
def simplified_score_relabelled(t):
    """The same benchmark with the survey folded alike."""
    return _folded_score(t, True)


VARIANCE = f"""spread AS (SELECT segment AS stratum, 'Segment' AS dimension, var_samp(CASE WHEN c_acctbal > 8000 THEN 1.0 ELSE 0.0 END) AS variance
  FROM people GROUP BY segment)"""


def _neyman(sizes: str, name: str = "planned") -> str:
    """Neyman allocation over ``bench`` for an inline list of sizes, with variance from ``spread``."""
    return f"""v AS (SELECT bench.*, {STD_LABEL} AS stratum FROM bench),
w AS (SELECT v.dimension, v.stratum, q, size, coalesce(variance, 0.25) AS var, q * sqrt(coalesce(variance, 0.25)) AS w
  FROM v LEFT JOIN spread ON spread.dimension = v.dimension AND spread.stratum = v.stratum, (VALUES {sizes}) z(size)),
g AS (SELECT *, CAST(round_even(CAST(round(size * (w / sum(w) OVER (PARTITION BY dimension, size)), 9) AS DOUBLE), 0) AS BIGINT) AS n0 FROM w),
h AS (SELECT *, row_number() OVER (PARTITION BY dimension, size ORDER BY n0 DESC, stratum) AS k,
  sum(n0) OVER (PARTITION BY dimension, size) AS given FROM g),
{name} AS (SELECT dimension, CAST(size AS BIGINT) AS size, stratum, q, var,
  CAST(n0 + CASE WHEN k = 1 THEN size - given ELSE 0 END AS BIGINT) AS opt, CAST(trunc(size * q) AS BIGINT) AS prop FROM h)"""


def segment_variance(t):
    yes = F.when(F.col("c_acctbal") > 8000, 1.0).otherwise(0.0)
    spread = t.population.groupBy("segment").agg(F.var_samp(yes).alias("variance"))
    return spread.select(dimension_name("Segment"), F.col("segment").alias("stratum"), "variance")


SIZES = (1000, 2500, 5000, 10000)
SIZE_VALUES = ", ".join(f"({s})" for s in SIZES)


@query(
    "neyman",
    f"""WITH {STD}, {VARIANCE}, {_neyman("(1003)")}
SELECT dimension, size, stratum, {q.r("q", "population_share")}, {q.r("var", "variance")}, opt AS optimal_n FROM planned""",
)
def neyman(t):
    return allocation.neyman(t.benchmark, STANDARD, [1003], segment_variance(t))


@query(
    "neyman_default",
    f"""WITH {STD}, spread AS (SELECT 'none' AS dimension, 'none' AS stratum, 0.25::DOUBLE AS variance), {_neyman("(777)")}
SELECT dimension, size, stratum, {q.r("q", "population_share")}, {q.r("var", "variance")}, opt AS optimal_n FROM planned""",
)
def neyman_default(t):
    """Without known variances every stratum counts with the largest one."""
    return allocation.neyman(t.benchmark, STANDARD, [777])


@query(
    "allocation_compare",
    f"""WITH {STD}, targets AS (SELECT *, sqrt(q) / sum(sqrt(q)) OVER (PARTITION BY dimension) AS t, {STD_LABEL} AS stratum FROM bench)
SELECT dimension, CAST(1000 AS BIGINT) AS size, stratum, {q.r("q * 100", "population_pct")},
  CAST(round_even(CAST(round(1000 * q, 9) AS DOUBLE), 0) AS BIGINT) AS proportional_n,
  CAST(round_even(CAST(round(1000 * t, 9) AS DOUBLE), 0) AS BIGINT) AS strategic_n,
  CAST(round_even(CAST(round(1000 * t, 9) AS DOUBLE), 0) - round_even(CAST(round(1000 * q, 9) AS DOUBLE), 0) AS BIGINT) AS difference,
  {q.r("t / q", "boost")} FROM targets""",
)
def allocation_compare(t):
    return allocation.proportional_beside_strategic(scores.target_shares(t.benchmark), STANDARD, [1000])


@query(
    "allocation_sizes",
    f"""WITH {STD}, {VARIANCE}, {_neyman(SIZE_VALUES)}
SELECT dimension, size, stratum, {q.r("q", "population_share")}, {q.r("var", "variance")}, prop AS proportional_n, opt AS optimal_n,
  opt - prop AS difference, {q.r("CASE WHEN prop > 0 THEN (opt - prop)::DOUBLE / prop * 100 ELSE 0 END", "pct_change")} FROM planned""",
)
def allocation_sizes(t):
    return allocation.proportional_beside_optimal(allocation.neyman(t.benchmark, STANDARD, SIZES, segment_variance(t)))


@query(
    "efficiency_gain",
    f"""WITH {STD}, {VARIANCE}, {_neyman(SIZE_VALUES)},
spreads AS (SELECT dimension, size, sum(q * q * var / prop) FILTER (prop > 0) AS vp, sum(q * q * var / opt) FILTER (opt > 0) AS vo
  FROM planned GROUP BY dimension, size)
SELECT dimension, size, {q.r("vp", "variance_proportional")}, {q.r("vo", "variance_optimal")}, {q.r("(vp - vo) / vp", "efficiency_gain")} FROM spreads""",
)
def efficiency_gain(t):
    planned = allocation.neyman(t.benchmark, STANDARD, SIZES, segment_variance(t))
    return allocation.efficiency_gain(allocation.proportional_beside_optimal(planned))


@query(
    "allocation_actual",
    f"""WITH {q.ORDERS}, {q.shares("bench", "people", q.STANDARD, q.STANDARD_KEYS)}, {VARIANCE}, {_neyman("(15000)")},
{q.counted("counts", "survey", q.STANDARD, q.STANDARD_KEYS)}, have AS (SELECT dimension, {STD_LABEL} AS stratum, n FROM counts)
SELECT dimension, size, stratum, prop AS proportional_n, opt AS optimal_n, coalesce(n, 0) AS actual_n
FROM planned LEFT JOIN have USING (dimension, stratum)""",
)
def allocation_actual(t):
    planned = allocation.proportional_beside_optimal(allocation.neyman(t.benchmark, STANDARD, [15000], segment_variance(t)))
    return allocation.beside_actual(planned, t.aligned(STANDARD), STANDARD)
