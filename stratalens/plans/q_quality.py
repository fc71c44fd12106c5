"""Data-quality jobs and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.operators import quality
from stratalens.operators.harmonize import add_hierarchy, mapping_table
from stratalens.operators.strata import Dimension
from stratalens.plans import sqltext as q
from stratalens.plans.q_harmonize import MAPPINGS
from stratalens.plans.registry import query
from stratalens.plans.testbed import LANG_SOURCE, STANDARD

ISSUE = 'SELECT {source} AS source, \'{check}\' AS "check", {column} AS "column", {value} AS value, \'{severity}\' AS severity'


def issue(source: str, check: str, column: str, value: str, severity: str = "error") -> str:
    return ISSUE.format(source=source, check=check, column=column, value=f"round(CAST({value} AS DOUBLE), 6)", severity=severity)


HOLED = """holed AS (SELECT nullif(lang, 'en') AS lang, CASE WHEN source IN ('src1', 'src2', 'src3', 'src4', 'src5') THEN NULL ELSE source || '!' END AS source,
  CAST(n_chars % 150 AS VARCHAR) AS age_text, CAST(NULL AS VARCHAR) AS nothing FROM documents)"""


def holed(t):
    """Documents with missing languages, odd characters, implausible ages and an empty column."""
    first = ["src1", "src2", "src3", "src4", "src5"]
    return t.read("documents").select(
        F.nullif("lang", F.lit("en")).alias("lang"),
        F.when(~F.col("source").isin(first), F.concat("source", F.lit("!"))).alias("source"),
        (F.col("n_chars") % 150).cast("string").alias("age_text"),
        F.lit(None).cast("string").alias("nothing"),
    )


@query(
    "validate_survey",
    f"""WITH {HOLED}, s AS (SELECT 100.0 * count(*) FILTER (lang IS NULL) / count(*) AS l, 100.0 * count(*) FILTER (source IS NULL) / count(*) AS o FROM holed)
{issue("'survey'", "missing_values", "'lang'", "l")} FROM s WHERE l > 50
UNION ALL {issue("'survey'", "missing_values", "'source'", "o")} FROM s WHERE o > 50
UNION ALL {issue("'survey'", "missing_column", "'country'", "NULL")}""",
)
def validate_survey(t):
    return quality.check_survey(holed(t), ["lang", "source", "country"])


DEEP = f"""s AS (SELECT count(*) AS n, 100.0 * count(*) FILTER (lang IS NULL) / count(*) AS l, 100.0 * count(*) FILTER (source IS NULL) / count(*) AS o,
    count(*) FILTER (source LIKE '%!') AS odd, count(*) FILTER (CAST(age_text AS INTEGER) > 120) AS old FROM holed),
d AS (SELECT 100.0 * (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM holed))) / count(*) AS dup FROM holed),
found AS (
  {issue("'survey'", "missing_values", "'lang'", "l")} FROM s WHERE l > 50
  UNION ALL {issue("'survey'", "missing_values", "'source'", "o", "warning")} FROM s WHERE o > 20 AND o <= 50
  UNION ALL {issue("'survey'", "unusual_characters", "'source'", "odd")} FROM s WHERE odd > 0
  UNION ALL {issue("'survey'", "implausible_age", "'age_text'", "old")} FROM s WHERE old > 0
  UNION ALL {issue("'survey'", "all_null", "'nothing'", "n")} FROM s
  UNION ALL {issue("'survey'", "missing_values", "'nothing'", "100")} FROM s
  UNION ALL {issue("'survey'", "duplicate_rows", "NULL", "dup")} FROM d WHERE dup > 10)"""


@query("validate_survey_deep", f"WITH {HOLED}, {DEEP} SELECT * FROM found UNION ALL {issue(chr(39) + 'survey' + chr(39), 'missing_column', chr(39) + 'country' + chr(39), 'NULL')}")
def validate_survey_deep(t):
    return quality.check_survey_deep(holed(t), ["lang", "country"])


ODD_BENCH = """odd AS (
  SELECT 'Priority' AS dimension, o_orderpriority AS k, count(*)::DOUBLE / (SELECT count(*) FROM orders) AS q FROM orders GROUP BY 2
  UNION ALL SELECT 'Status', o_orderstatus, count(*)::DOUBLE / (SELECT count(*) FROM orders) * 1.3 FROM orders GROUP BY 2
  UNION ALL SELECT 'Label', CAST(quality AS VARCHAR), count(*)::DOUBLE / (SELECT count(*) FROM labels) FROM labels GROUP BY 2
  UNION ALL SELECT 'Balance', c_mktsegment, CASE WHEN c_mktsegment < 'C' THEN -1.0 WHEN c_mktsegment > 'H' THEN NULL ELSE 0.9 END FROM customer GROUP BY 2
  UNION ALL SELECT 'Region', 'all', 1.0
  UNION ALL SELECT 'Customer', CAST(c_custkey AS VARCHAR), 1.0 / (SELECT count(*) FROM customer) FROM customer
  UNION ALL SELECT 'Customer', '0', 0.0)"""


def odd_benchmark(t):
    orders, labels, customer = t.read("orders"), t.read("labels"), t.read("customer")

    def shares(frame, name, column, factor=1.0):
        total = frame.agg(F.count(F.lit(1)).alias("n"))
        counted = frame.groupBy(F.col(column).cast("string").alias("k")).agg(F.count(F.lit(1)).alias("n"))
        return counted.select(F.lit(name).alias("dimension"), "k", (F.col("n") / total.scalar() * factor).alias("population_share"))

    segments = customer.select(F.col("c_mktsegment").alias("k")).distinct()
    bad = F.when(F.col("k") < "C", -1.0).when(F.col("k") > "H", F.lit(None)).otherwise(0.9)
    one = customer.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("Region").alias("dimension"), F.lit("all").alias("k"), F.lit(1.0).alias("population_share")
    )
    extra = one.select(F.lit("Customer").alias("dimension"), F.lit("0").alias("k"), F.lit(0.0).alias("population_share"))
    return (
        shares(orders, "Priority", "o_orderpriority")
        .unionByName(shares(orders, "Status", "o_orderstatus", 1.3))
        .unionByName(shares(labels, "Label", "quality"))
        .unionByName(segments.select(F.lit("Balance").alias("dimension"), "k", bad.alias("population_share")))
        .unionByName(one)
        .unionByName(shares(customer, "Customer", "c_custkey"))
        .unionByName(extra)
    )


BENCH_ISSUES = f"""stats AS (SELECT dimension, count(*) AS strata, coalesce(sum(q), 0) AS total, count(*) FILTER (q < 0) AS neg, count(*) FILTER (q IS NULL) AS nul,
    count(*) FILTER (q > 0.5) AS big, count(*) - count(DISTINCT k) AS rep FROM odd GROUP BY dimension),
bench_issues AS (
  {issue("dimension", "share_sum", "'population_share'", "total")} FROM stats WHERE abs(total - 1) > 0.01
  UNION ALL {issue("dimension", "negative_share", "'population_share'", "neg")} FROM stats WHERE neg > 0
  UNION ALL {issue("dimension", "null_share", "'population_share'", "nul")} FROM stats WHERE nul > 0
  UNION ALL {issue("dimension", "large_share", "'population_share'", "big")} FROM stats WHERE big > 0
  UNION ALL {issue("dimension", "few_strata", "NULL", "strata")} FROM stats WHERE strata < 2
  UNION ALL {issue("dimension", "many_strata", "NULL", "strata")} FROM stats WHERE strata > 10000
  UNION ALL {issue("dimension", "repeated_key", "NULL", "rep", "warning")} FROM stats WHERE rep > 0)"""
KEYED = Dimension("Any", ("k",))


@query("validate_benchmark", f"WITH {ODD_BENCH}, {BENCH_ISSUES} SELECT * FROM bench_issues")
def validate_benchmark(t):
    return quality.check_benchmark(odd_benchmark(t), [KEYED])


@query(
    "validate_pair",
    f"""WITH {HOLED}, {DEEP}, b AS (SELECT lang, 'other' || source AS source, count(*)::DOUBLE / (SELECT count(*) FROM documents) AS q FROM documents GROUP BY ALL)
SELECT * FROM found UNION ALL {issue("'pair'", "no_overlap", "NULL", "0")}""",
)
def validate_pair(t):
    """Survey and benchmark that share no stratum."""
    documents = t.read("documents")
    total = documents.agg(F.count(F.lit(1)).alias("n"))
    bench = documents.groupBy("lang", F.concat(F.lit("other"), "source").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    bench = bench.select("lang", "source", (F.col("n") / total.scalar()).alias("population_share"))
    return quality.check_pair(holed(t), bench, LANG_SOURCE)


@query(
    "validate_mapping",
    """WITH regions AS (SELECT r_name AS region, n_name AS country FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'),
sizes AS (SELECT r_name AS region, count(country) AS n FROM region LEFT JOIN regions ON regions.region = r_name GROUP BY r_name)
SELECT 'regions' AS source, 'empty_region' AS "check", region AS "column", 0.0::DOUBLE AS value, 'error' AS severity FROM sizes WHERE n = 0
UNION ALL SELECT 'continents', 'region_without_continent', r_name, 0.0, 'error' FROM region WHERE r_name NOT IN ('AFRICA', 'ASIA', 'EUROPE', 'AMERICA')
UNION ALL SELECT 'orders', 'mapped_twice', 'status: O', 2.0, 'error'""",
)
def validate_mapping(t):
    table = mapping_table(t.spark, {**MAPPINGS, "orders": {**MAPPINGS["orders"], "status": {"Done": ["F", "O"], "Open": ["O", "P"]}}})
    regions = t.places.where("region <> 'ASIA'").select("region", "country")
    continents = t.spark.createDataFrame(
        [("AFRICA", "South"), ("ASIA", "East"), ("EUROPE", "North"), ("AMERICA", "West")], "region string, continent string"
    )
    return quality.check_mappings(table, regions, continents, t.read("region").select(F.col("r_name").alias("region")))


@query(
    "dimension_requirements",
    f"""WITH {q.PEOPLE}, known AS (SELECT DISTINCT n_name AS country FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'),
lost AS (SELECT count(DISTINCT country) AS n FROM people WHERE country NOT IN (SELECT country FROM known))
{issue("'Segment'", "missing_requirement", "'segment_to_group'", "NULL")}
UNION ALL SELECT source, "check", "column", value, severity FROM ({issue("'Region'", "unmapped_keys", "'country_to_region'", "(SELECT n FROM lost)")}) WHERE value > 0
UNION ALL SELECT source, "check", "column", value, severity FROM ({issue("'Region × Segment'", "unmapped_keys", "'country_to_region'", "(SELECT n FROM lost)")}) WHERE value > 0""",
)
def dimension_requirements(t):
    """Dimensions whose hierarchy table is missing or does not know all keys of the population."""
    grouped = Dimension("Segment", ("segment",), ("segment_to_group",))
    regions = t.places.where("region <> 'ASIA'").select("country", "region")
    dims = [d for d in STANDARD if d.name != "Segment"] + [grouped]
    return quality.check_requirements(t.population, dims, {"country_to_region": regions})


@query(
    "validation_summary",
    f"""WITH {HOLED}, {DEEP}, {ODD_BENCH}, {BENCH_ISSUES}, every AS (SELECT * FROM found UNION ALL SELECT * FROM bench_issues)
SELECT source, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings,
  count(*) FILTER (severity = 'error') = 0 AS valid FROM every GROUP BY source""",
)
def validation_summary(t):
    found = [quality.check_survey_deep(holed(t)), quality.check_benchmark(odd_benchmark(t), [KEYED])]
    return quality.validation_summary(found)


@query(
    "completed_benchmarks",
    f"""WITH {q.PEOPLE}, {q.shares("bench", "people", q.STANDARD, q.STANDARD_KEYS)}
SELECT CAST(5 AS BIGINT) AS configured, count(DISTINCT dimension) AS completed, {q.r("count(DISTINCT dimension) / 5.0", "coverage")},
  count(DISTINCT dimension) / 5.0 >= 0.8 AS sufficient FROM bench WHERE dimension <> 'Segment'""",
)
def completed_benchmarks(t):
    return quality.check_completed(t.benchmark_for(*[d for d in STANDARD if d.name != "Segment"]), STANDARD)


@query(
    "geographic_coverage",
    f"""WITH {q.PEOPLE} SELECT count(*) AS respondents, {q.r("avg(CASE WHEN country <> 'NATION_7' THEN 100.0 ELSE 0.0 END)", "region_pct")},
  {q.r("avg(CASE WHEN country <> 'NATION_7' AND region <> 'AFRICA' THEN 100.0 ELSE 0.0 END)", "continent_pct")} FROM people""",
)
def geographic_coverage(t):
    regions = t.places.where("country <> 'NATION_7'").select("country", "region")
    continents = t.places.where("region <> 'AFRICA'").select("region", F.lit("known").alias("continent")).distinct()
    return quality.geographic_coverage(add_hierarchy(t.population.select("country"), regions, continents))


PROFILE = f"""{q.ORDERS}, holes AS (SELECT nullif(segment, 'MACHINERY') AS segment, status, region FROM survey),
counts AS (SELECT 'segment' AS col, segment AS cat, count(*) AS n FROM holes GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM holes GROUP BY 2
  UNION ALL SELECT 'region', region, count(*) FROM holes GROUP BY 2)"""


def profile_counts(t):
    holes = t.survey.withColumn("segment", F.nullif("segment", F.lit("MACHINERY")))
    return quality.value_counts(holes, ["segment", "status", "region"])


@query(
    "profile_columns",
    f"""WITH {PROFILE} SELECT col AS "column", CAST(sum(n) AS BIGINT) AS rows, count(cat) AS distinct_values,
  {q.r("coalesce(sum(n) FILTER (cat IS NULL), 0) / sum(n)", "missing_share")}, {q.r("1 - coalesce(sum(n) FILTER (cat IS NULL), 0) / sum(n)", "completeness")},
  (array_agg(cat ORDER BY n DESC, cat) FILTER (cat IS NOT NULL))[1] AS top_value FROM counts GROUP BY col""",
)
def profile_columns(t):
    return quality.profile(profile_counts(t))


@query("value_distribution", f"""WITH {PROFILE} SELECT col AS "column", cat AS category, n FROM counts""")
def value_distribution(t):
    return profile_counts(t)


@query(
    "top_values",
    f"""WITH {PROFILE}, ranked AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, cat) AS k FROM counts WHERE cat IS NOT NULL)
SELECT col AS "column", cat AS category, n, k AS rank FROM ranked WHERE k <= 3""",
)
def top_values(t):
    return quality.top_values(profile_counts(t), 3)


@query(
    "benchmark_profile",
    f"""WITH {q.PEOPLE}, {q.shares("bench", "people", q.STANDARD, q.STANDARD_KEYS)}
SELECT dimension, count(*) AS strata, {q.r("sum(q)", "share_sum")}, count(DISTINCT country) AS country_values, count(DISTINCT segment) AS segment_values,
  count(DISTINCT region) AS region_values FROM bench GROUP BY dimension""",
)
def benchmark_profile(t):
    return quality.benchmark_profile(t.benchmark, STANDARD)


@query(
    "dimension_statistics",
    f"""WITH {q.LABELLED}, holes AS (SELECT nullif(lang, 'de') AS lang, source FROM labelled)
SELECT 'Language × Source' AS dimension, 'lang' AS "column", count(*) AS participants, count(DISTINCT lang) AS categories, {q.r("count(lang)::DOUBLE / count(*)", "coverage")} FROM holes
UNION ALL SELECT 'Language × Source', 'source', count(*), count(DISTINCT source), {q.r("count(source)::DOUBLE / count(*)", "c")} FROM holes""",
)
def dimension_statistics(t):
    return quality.dimension_statistics(t.labelled.withColumn("lang", F.nullif("lang", F.lit("de"))), LANG_SOURCE)
