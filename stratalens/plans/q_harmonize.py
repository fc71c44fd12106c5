"""Harmonising labels, cleaning published numbers and building benchmarks from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.functions import expressions as ex
from stratalens.functions import fixed
from stratalens.operators import benchmarks, harmonize
from stratalens.operators.scores import match_and_coverage
from stratalens.operators.strata import Dimension, cell_counts, line_up, population_shares, route_benchmarks
from stratalens.plans import sqltext as q
from stratalens.plans.registry import query
from stratalens.plans.testbed import COUNTRY, COUNTRY_SEGMENT, REGION, REGION_SEGMENT
from stratalens.sources import readers

MAPPINGS = {
    "orders": {
        "priority": {"High": ["1-URGENT", "2-HIGH"], "Normal": ["3-MEDIUM"], "Low": ["5-LOW"]},
        "status": {"Done": ["F"], "Open": ["O", "P"]},
    },
    "benchmark": {"priority": {"Medium": ["3-MEDIUM"]}},
}
MAP_SQL = """prio AS (SELECT * FROM (VALUES ('1-URGENT', 'High'), ('2-HIGH', 'High'), ('3-MEDIUM', 'Normal'), ('5-LOW', 'Low')) v(raw, std)),
stat AS (SELECT * FROM (VALUES ('F', 'Done'), ('O', 'Open'), ('P', 'Open')) v(raw, std))"""


def mappings(t):
    table = harmonize.mapping_table(t.spark, MAPPINGS)
    inherits = ex.inline_table(t.spark, [("web", "status", "orders")], ["source", "attribute", "parent"])
    return harmonize.resolve_mappings(table, inherits)


def answers(t):
    return t.read("orders").select("o_orderkey", F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))


@query(
    "map_strict",
    f"""WITH {MAP_SQL} SELECT prio.std AS priority, stat.std AS status, count(*) AS n FROM orders
JOIN prio ON prio.raw = o_orderpriority JOIN stat ON stat.raw = o_orderstatus GROUP BY 1, 2""",
)
def map_strict(t):
    """Orders with an unlisted priority are dropped."""
    mapped = harmonize.map_strict(answers(t), mappings(t), "orders", ["priority", "status"])
    return mapped.groupBy("priority", "status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "map_lenient",
    f"""WITH {MAP_SQL} SELECT CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'Medium' ELSE coalesce(prio.std, o_orderpriority) END AS priority,
  coalesce(stat.std, o_orderstatus) AS status, count(*) AS n FROM orders
LEFT JOIN prio ON prio.raw = o_orderpriority LEFT JOIN stat ON stat.raw = o_orderstatus GROUP BY 1, 2""",
)
def map_lenient(t):
    """Unlisted values stay, and the benchmark's own mapping has the last word."""
    mapped = harmonize.map_lenient(answers(t), mappings(t), "orders", ["priority", "status"])
    return mapped.groupBy("priority", "status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "map_inherited",
    f"""WITH {MAP_SQL} SELECT o_orderpriority AS priority, stat.std AS status, count(*) AS n FROM orders
JOIN stat ON stat.raw = o_orderstatus GROUP BY 1, 2""",
)
def map_inherited(t):
    """A source that takes its status mapping over from another one."""
    mapped = harmonize.map_strict(answers(t), mappings(t), "web", ["status"])
    return mapped.groupBy("priority", "status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "hierarchy",
    """WITH places AS (SELECT n_name AS country, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 7),
continents AS (SELECT * FROM (VALUES ('AFRICA', 'South'), ('ASIA', 'East'), ('EUROPE', 'North'), ('AMERICA', 'West')) v(region, continent))
SELECT n_name AS country, p.region, continent, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN places p ON p.country = n_name LEFT JOIN continents c ON c.region = p.region GROUP BY 1, 2, 3""",
)
def hierarchy(t):
    """Region and continent by lookup; a country and a region are missing from the tables."""
    customers = t.read("customer").join(t.read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    regions = t.places.where("n_nationkey <> 7").select("country", "region")
    continents = t.spark.createDataFrame(
        [("AFRICA", "South"), ("ASIA", "East"), ("EUROPE", "North"), ("AMERICA", "West")], "region string, continent string"
    )
    placed = harmonize.add_hierarchy(customers.select(F.col("n_name").alias("country")), regions, continents)
    return placed.groupBy("country", "region", "continent").agg(F.count(F.lit(1)).alias("n"))


@query(
    "age_bucket",
    """SELECT CASE WHEN a < 0 THEN NULL WHEN a < 18 THEN 'Under 18' WHEN a < 26 THEN '18-25' WHEN a < 36 THEN '26-35' WHEN a < 46 THEN '36-45'
  WHEN a < 56 THEN '46-55' WHEN a < 66 THEN '56-65' ELSE '66+' END AS age_group, count(*) AS n
FROM (SELECT l_quantity * 2 - 10 AS a FROM lineitem) GROUP BY 1""",
)
def age_bucket(t):
    ages = t.read("lineitem").select((F.col("l_quantity") * 2 - 10).alias("age"))
    return ages.groupBy(ex.age_band(F.col("age")).alias("age_group")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "town_size",
    """SELECT CASE WHEN p_size <= 3 THEN 'Rural' WHEN p_size <= 8 THEN 'Urban' END AS environment, count(*) AS n FROM part GROUP BY 1""",
)
def town_size(t):
    return t.read("part").groupBy(ex.town_setting(F.col("p_size")).alias("environment")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "code_labels",
    """SELECT n_name AS country, CASE c_code WHEN 1 THEN 'Male' WHEN 2 THEN 'Female' END AS gender, count(*) AS n
FROM (SELECT c_nationkey, CAST(abs(c_acctbal) / 2500 AS INTEGER) AS c_code FROM customer)
LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey < 20 GROUP BY 1, 2""",
)
def code_labels(t):
    """Country labels from a code table, sex labels from the fixed codes (halves go to the even code); unknown codes give null."""
    coded = t.read("customer").select("c_nationkey", F.bround(F.abs("c_acctbal") / 2500).cast("int").alias("c_code"))
    codes = t.read("nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("label"))
    labelled = harmonize.label_codes(coded, "c_nationkey", codes, "country")
    labelled = harmonize.label_codes(labelled, "c_code", fixed.SEX_CODES, "gender")
    return labelled.groupBy("country", "gender").agg(F.count(F.lit(1)).alias("n"))


DIRTY = """dirty AS (SELECT r_name AS grp, CASE WHEN c_acctbal < 0 THEN '<0.1' WHEN c_acctbal < 1000 THEN 'n/a'
    ELSE '"' || ' ' || CAST(CAST(floor(c_acctbal) AS BIGINT) // 1000 AS VARCHAR) || ',' || lpad(CAST(CAST(floor(c_acctbal) AS BIGINT) % 1000 AS VARCHAR), 3, '0') END AS txt
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@query(
    "clean_numeric",
    f"""WITH {DIRTY}, cleaned AS (SELECT grp, CASE WHEN txt LIKE '"%' THEN CAST(replace(replace(replace(txt, '"', ''), ' ', ''), ',', '') AS DOUBLE) END AS v,
  CASE WHEN txt LIKE '<%' THEN 0.05 ELSE 0.0 END AS pct FROM dirty)
SELECT grp, count(*) AS n, count(v) AS readable, {q.r("sum(v)", "total")}, {q.r("sum(pct)", "percent_sum")} FROM cleaned GROUP BY grp""",
)
def clean_numeric(t):
    """Quoted numbers with blanks and commas, ``<0.1`` and plain junk."""
    whole = F.floor("c_acctbal").cast("long")
    text = (
        F.when(F.col("c_acctbal") < 0, "<0.1")
        .when(F.col("c_acctbal") < 1000, "n/a")
        .otherwise(F.concat(F.lit('" '), (whole / 1000).cast("long").cast("string"), F.lit(","), F.lpad((whole % 1000).cast("string"), 3, "0")))
    )
    dirty = t.population.select(F.col("region").alias("grp"), text.alias("txt"))
    value = ex.plain_number(ex.clean_text(F.col("txt")))
    percent = F.when(F.contains("txt", F.lit("<")), ex.percent_text(F.col("txt"))).otherwise(0.0)
    return dirty.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"), F.count(value).alias("readable"), F.sum(value).alias("total"), F.sum(percent).alias("percent_sum")
    )


@query(
    "exclude_aggregates",
    """WITH places AS (SELECT n_name AS name, 'Country' AS kind, 'N' || n_nationkey AS iso, n_nationkey AS k FROM nation
  UNION ALL SELECT r_name, 'Region', 'R' || r_regionkey, r_regionkey FROM region
  UNION ALL SELECT r_name || ' developed', 'Country', 'D', r_regionkey FROM region
  UNION ALL SELECT n_name || ' (old)', 'Country/Area', ' ', n_nationkey FROM nation)
SELECT name, iso FROM places WHERE kind IN ('Country', 'Country/Area') AND trim(iso) <> '' AND name NOT LIKE '%developed%'
  AND name NOT IN (SELECT n_name FROM nation WHERE n_regionkey = 4)""",
)
def exclude_aggregates(t):
    nation, region = t.read("nation"), t.read("region")
    rows = (
        nation.select(F.col("n_name").alias("name"), F.lit("Country").alias("kind"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("iso"))
        .unionByName(region.select(F.col("r_name").alias("name"), F.lit("Region").alias("kind"), F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("iso")))
        .unionByName(region.select(F.concat("r_name", F.lit(" developed")).alias("name"), F.lit("Country").alias("kind"), F.lit("D").alias("iso")))
        .unionByName(nation.select(F.concat("n_name", F.lit(" (old)")).alias("name"), F.lit("Country/Area").alias("kind"), F.lit(" ").alias("iso")))
    )
    listed = nation.where("n_regionkey = 4").select(F.col("n_name").alias("name"))
    kept = benchmarks.real_countries(rows, "name", "iso", "kind", aggregates=listed, words=fixed.AGGREGATE_WORDS)
    return kept.select("name", "iso")


@query(
    "positional_split",
    """WITH raw AS (SELECT c_custkey, c_acctbal, c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT 'P' || c_custkey AS participant_id, CASE WHEN c_acctbal < 5000 THEN '18-25' ELSE '26-35' END AS age_group, 'Male' AS gender,
  'Urban' AS environment, c_mktsegment AS religion, n_name AS country FROM raw WHERE c_acctbal >= 0""",
)
def positional_split(t):
    """Unquoted lines; those of customers in debt are too short to hold all fields."""
    age = F.when(F.col("c_acctbal") < 5000, "18-25").otherwise("26-35")
    whole = F.concat_ws(
        "  ", F.concat(F.lit("P"), F.col("c_custkey").cast("string")), F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d"),
        age, F.lit("Male"), F.lit("Urban"), F.lit("e"), "segment", "country",
    )
    lines = t.population.select(F.when(F.col("c_acctbal") >= 0, whole).otherwise(F.lit("broken line")).alias("value"))
    return readers.by_words(lines)


@query(
    "positional_columns",
    """SELECT 'C' || c_custkey AS participant_id, CASE WHEN c_acctbal < 1000 THEN NULL ELSE '36-45' END AS age_group, 'Female' AS gender,
  'Rural' AS environment, c_mktsegment AS religion, n_name AS country FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def positional_columns(t):
    """Columns by place, with quotes and blanks around them and empty or ``nan`` texts."""
    people = t.population
    blank = F.when(F.col("c_acctbal") < 0, "nan").when(F.col("c_acctbal") < 1000, "").otherwise('" 36-45 "')
    fields = [
        F.lit("x"), F.lit("y"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")), F.lit("z"), F.lit("w"), blank,
        F.lit('"Female"'), F.lit(" Rural"), F.lit("v"), F.col("segment"), F.concat(F.lit('"'), F.col("country"), F.lit('"')),
    ]
    raw = people.select(*[f.alias(f"_c{i}") for i, f in enumerate(fields)])
    header = t.spark.range(1).select(*[F.lit("Participant Id").alias(f"_c{i}") for i in range(len(fields))])
    return readers.by_position(raw.unionByName(header))


@query(
    "question_texts",
    """SELECT n_name AS country, c_mktsegment AS religion, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""",
)
def question_texts(t):
    raw = t.population.select(
        F.col("country").alias("What country or region do you most identify with?"),
        F.col("segment").alias("What religious group or faith do you most identify with?"),
        F.col("c_acctbal").alias("Muted"),
    )
    return readers.by_question_text(raw).groupBy("country", "religion").agg(F.count(F.lit(1)).alias("n"))


@query(
    "recode_demographics",
    """WITH raw AS (SELECT n_name AS country, c_mktsegment AS s, c_acctbal AS a FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT CASE WHEN a < 100 THEN 'United States' WHEN a < 500 THEN 'United Kingdom' ELSE country END AS country,
  CASE WHEN s IN ('BUILDING', 'HOUSEHOLD') THEN 'Male' ELSE 'Female' END AS gender, CASE WHEN a > 5000 THEN '65+' ELSE '18-25' END AS age_group,
  CASE s WHEN 'BUILDING' THEN 'Urban' WHEN 'HOUSEHOLD' THEN 'Rural' END AS environment,
  CASE s WHEN 'BUILDING' THEN 'I do not identify with any religious group or faith' WHEN 'FURNITURE' THEN 'Buddhism' END AS religion, count(*) AS n
FROM raw WHERE s <> 'MACHINERY' GROUP BY ALL""",
)
def recode_demographics(t):
    s, a = F.col("segment"), F.col("c_acctbal")
    raw = t.population.select(
        F.when(a < 100, "USA").when(a < 500, "Britain").otherwise(F.col("country")).alias("country"),
        F.when(s == "BUILDING", "Man").when(s == "HOUSEHOLD", "Male").when(s == "MACHINERY", "Other").otherwise("Woman").alias("gender"),
        F.when(a > 5000, "Over 65").otherwise("18-25").alias("age_group"),
        F.when(s == "BUILDING", "Suburban").when(s == "HOUSEHOLD", "Village").otherwise("Moon").alias("environment"),
        F.when(s == "BUILDING", "Atheist").when(s == "FURNITURE", "Buddhist").otherwise("?").alias("religion"),
    )
    return harmonize.recode_demographics(raw).groupBy("country", "gender", "age_group", "environment", "religion").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "keep_known_categories",
    f"""WITH {q.ORDERS} SELECT country, count(*) AS n FROM survey
WHERE country IN (SELECT n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey) GROUP BY country""",
)
def keep_known_categories(t):
    kept = harmonize.keep_known(t.survey, t.supplier_survey, "country")
    return kept.groupBy("country").agg(F.count(F.lit(1)).alias("n"))


@query(
    "region_subset_score",
    f"""WITH {q.ORDERS}, asia AS (SELECT * FROM survey WHERE region = 'ASIA'), {q.lined_up([q.STANDARD[2]], ("country",), survey="asia")}
SELECT dimension, max(size) AS sample_size, {q.r(q.MATCH, "match_score")}, {q.r(q.COVERAGE, "coverage_score")} FROM aligned GROUP BY dimension""",
)
def region_subset_score(t):
    """Scoring one region against the whole population, as asked for by an analyst."""
    asia = t.survey.where("region = 'ASIA'")
    return match_and_coverage(line_up(cell_counts(asia, ["country"]), t.benchmark_for(COUNTRY), [COUNTRY]))


@query(
    "rollup_region",
    f"""WITH {q.PEOPLE}, fine AS (SELECT country, segment, count(*)::DOUBLE / (SELECT count(*) FROM people) AS q FROM people GROUP BY country, segment),
placed AS (SELECT fine.*, r_name AS region FROM fine LEFT JOIN nation ON n_name = country AND n_nationkey <> 7 LEFT JOIN region ON n_regionkey = r_regionkey)
SELECT 'Region × Segment' AS dimension, region, segment, {q.r("sum(q)", "population_share")} FROM placed WHERE region IS NOT NULL GROUP BY region, segment
UNION ALL SELECT 'Region', region, NULL, {q.r("sum(q)", "q")} FROM placed WHERE region IS NOT NULL GROUP BY region""",
)
def rollup_region(t):
    """A country benchmark rolled up; the unmapped country leaves, so shares sum to less than 1."""
    fine = t.benchmark_for(COUNTRY_SEGMENT).drop("dimension")
    placed = harmonize.add_hierarchy(fine, t.places.where("n_nationkey <> 7").select("country", "region"))
    return benchmarks.regional_benchmark(placed, [REGION_SEGMENT, REGION])


@query(
    "benchmark_grouping_sets",
    f"""WITH {q.PEOPLE}, {q.shares("bench", "people", q.STANDARD, q.STANDARD_KEYS)}
SELECT dimension, country, segment, region, {q.r("q", "population_share")} FROM bench""",
)
def benchmark_grouping_sets(t):
    return t.benchmark


@query(
    "benchmark_routing",
    f"""WITH {q.PEOPLE}, a AS (SELECT country, segment, count(*)::DOUBLE / (SELECT count(*) FROM people) AS q FROM people GROUP BY ALL),
b AS (SELECT n_name AS country, count(*)::DOUBLE / (SELECT count(*) FROM supplier) AS q FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)
SELECT 'Segment' AS dimension, segment, NULL AS country, {q.r("sum(q)", "population_share")} FROM a GROUP BY segment
UNION ALL SELECT 'Country', NULL, country, {q.r("sum(q)", "q")} FROM b GROUP BY country""",
)
def benchmark_routing(t):
    """Each dimension is served by its own base table."""
    by_customer = t.benchmark_for(COUNTRY_SEGMENT).drop("dimension")
    by_supplier = population_shares(t.supplier_survey, [COUNTRY]).drop("dimension")
    segment = Dimension("Segment", ("segment",), base="customers")
    country = Dimension("Country", ("country",), base="suppliers")
    return route_benchmarks({"customers": by_customer, "suppliers": by_supplier}, [segment, country])


@query(
    "benchmark_suite",
    f"""WITH {q.PEOPLE}, {q.shares("bench", "people", q.STANDARD, q.STANDARD_KEYS)}
SELECT dimension, count(*) AS strata, {q.r("sum(q)", "share_sum")}, count(DISTINCT country) AS countries FROM bench
WHERE dimension IN ('Country', 'Segment') GROUP BY dimension""",
)
def benchmark_suite(t):
    """Benchmarks written by dimension and read back in part: only the wanted folders are read."""
    from stratalens.session import scratch_path
    from stratalens.sources.writers import write_by

    path = scratch_path(t.spark, "benchmarks")
    write_by(t.benchmark, path)
    suite = readers.load_benchmarks(t.spark, path, ["Country", "Segment"])
    return suite.groupBy("dimension").agg(
        F.count(F.lit(1)).alias("strata"), F.sum("population_share").alias("share_sum"), F.countDistinct("country").alias("countries")
    )


@query(
    "normalise_population",
    f"""WITH p AS (SELECT n_name AS country, sum(c_acctbal) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name)
SELECT country, {q.r("v / sum(v) OVER ()", "population_share")} FROM p""",
)
def normalise_population(t):
    wealth = t.population.groupBy("country").agg(F.sum("c_acctbal").alias("population"))
    return benchmarks.to_shares(wealth)


AGES = ["15-19", "20-24", "25-29", "35-39", "65-69", "100+"]


def _wide_population(t, poor: bool):
    """A published-looking age table: one row per country and one text column per age."""
    who = t.population.where(F.col("c_acctbal") < 4500 if poor else F.col("c_acctbal") >= 4500)
    column = F.element_at(F.array(*[F.lit(a) for a in AGES]), (F.floor(F.abs("c_acctbal") / 100) % 6 + 1).cast("int"))
    who = who.select(F.col("country").alias("Area"), F.lit("Country").alias("Type"), column.alias("age"))
    counted = who.groupBy("Area", "Type").pivot("age", AGES).agg(F.count(F.lit(1)) * 1500)
    text = [F.regexp_replace(F.format_number(f"`{a}`", 0), ",", " ").alias(a) for a in AGES]
    region = counted.select(F.lit("World").alias("Area"), F.lit("Region").alias("Type"), *[F.lit("9 999 999").alias(a) for a in AGES])
    return counted.select("Area", "Type", *text).unionByName(region)


@query(
    "unpivot_benchmark",
    f"""WITH {q.PEOPLE}, tagged AS (SELECT country, CASE WHEN c_acctbal < 4500 THEN 'Male' ELSE 'Female' END AS gender,
    CASE CAST(floor(abs(c_acctbal) / 100) AS BIGINT) % 6 WHEN 0 THEN '18-25' WHEN 1 THEN '18-25' WHEN 2 THEN '26-35' WHEN 3 THEN '36-45' ELSE '65+' END AS age_group
  FROM people), paired AS (SELECT * FROM tagged WHERE country IN (SELECT country FROM tagged WHERE gender = 'Male') AND country IN (SELECT country FROM tagged WHERE gender = 'Female'))
SELECT country, gender, age_group, {q.r("count(*)::DOUBLE / (SELECT count(*) FROM paired)", "population_share")} FROM paired GROUP BY ALL""",
)
def unpivot_benchmark(t):
    """Wide age tables of men and women, numbers as text, to shares by country, gender and age."""
    return benchmarks.age_gender_benchmark(_wide_population(t, True), _wide_population(t, False), "Area", "Type")


@query(
    "religion_shares",
    f"""WITH {q.PEOPLE}, n AS (SELECT country, segment, count(*) AS n, sum(count(*)) OVER (PARTITION BY country) AS total FROM people GROUP BY country, segment),
pct AS (SELECT country, segment, total * 1000 AS people, CASE WHEN n * 5 < total THEN 0.05 ELSE floor(1000.0 * n / total) / 10 END AS p FROM n),
grouped AS (SELECT country, CASE segment WHEN 'BUILDING' THEN 'Christianity' WHEN 'FURNITURE' THEN 'Islam' WHEN 'HOUSEHOLD' THEN 'Hinduism'
    ELSE 'Other religious group' END AS religion, max(people) AS people, sum(p) AS p FROM pct GROUP BY 1, 2),
pop AS (SELECT country, religion, people * (p / 100) AS v FROM grouped WHERE p > 0)
SELECT country, religion, {q.r("v / sum(v) OVER ()", "population_share")} FROM pop""",
)
def religion_shares(t):
    """Percentages as text with ``<0.1`` for small ones, population text with commas."""
    segments = {"BUILDING": "PERCENT CHRISTIAN", "FURNITURE": "PERCENT MUSLIM", "HOUSEHOLD": "PERCENT HINDU",
                "MACHINERY": "PERCENT FOLK RELIGION", "AUTOMOBILE": "PERCENT OTHER RELIGION"}
    counted = t.population.groupBy("country").pivot("segment", list(segments)).agg(F.count(F.lit(1)))
    total = sum((F.coalesce(s, F.lit(0)) for s in segments), F.lit(0))
    wide = counted.withColumn("total", total)
    percent = [
        F.when(F.col(s) * 5 < F.col("total"), "<0.1").otherwise((F.floor(F.lit(1000.0) * F.col(s) / F.col("total")) / 10).cast("string")).alias(name)
        for s, name in segments.items()
    ]
    zero = [F.lit("0").alias(c) for c in ("PERCENT BUDDHIST", "PERCENT JEWISH", "PERCENT UNAFFIL.")]
    raw = wide.select(
        F.col("country").alias("COUNTRY"), F.format_number(F.col("total") * 1000, 0).alias("PEOPLE"), F.lit("ISO").alias("ISO3_Code"), *percent, *zero
    )
    return benchmarks.religion_benchmark(raw, "COUNTRY", "PEOPLE", "ISO3_Code")


@query(
    "setting_shares",
    f"""WITH {q.PEOPLE}, n AS (SELECT country, CASE WHEN c_acctbal < 3000 THEN 'Rural' ELSE 'Urban' END AS environment, count(*) AS n FROM people GROUP BY ALL),
both_known AS (SELECT country FROM n GROUP BY country HAVING count(*) = 2)
SELECT country, environment, {q.r("n::DOUBLE / sum(n) OVER ()", "population_share")} FROM n WHERE country IN (SELECT country FROM both_known)""",
)
def setting_shares(t):
    """Urban and rural thousands with blanks as thousands marks."""
    poor = F.col("c_acctbal") < 3000
    counted = t.population.groupBy("country").agg(
        (F.count_if(~poor) * 1000).alias("u"), (F.count_if(poor) * 1000).alias("r")
    )
    text = lambda c: F.when(F.col(c) > 0, F.regexp_replace(F.format_number(c, 0), ",", " ")).otherwise("...")
    raw = counted.select(
        F.col("country").alias("Area"), F.lit("XYZ").alias("ISO3_Code"), text("u").alias("Urban (thousands)"), text("r").alias("Rural (thousands)")
    )
    return benchmarks.setting_benchmark(raw, "Area", "ISO3_Code")


@query(
    "coded_survey",
    """WITH raw AS (SELECT o_orderkey, c_nationkey, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS code, CAST(floor(o_totalprice / 5000) AS BIGINT) - 2 AS age
  FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT n_name AS country, CASE code WHEN 1 THEN 'Male' ELSE 'Female' END AS gender,
  CASE WHEN age < 0 THEN NULL WHEN age < 18 THEN 'Under 18' WHEN age < 26 THEN '18-25' WHEN age < 36 THEN '26-35' WHEN age < 46 THEN '36-45'
    WHEN age < 56 THEN '46-55' WHEN age < 66 THEN '56-65' ELSE '66+' END AS age_group,
  CASE code WHEN 1 THEN 'Roman Catholic' ELSE 'Protestant' END AS religion, 'Rural' AS environment, 2014 AS year, count(*) AS n
FROM raw JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey < 20 AND code IN (1, 2) GROUP BY ALL""",
)
def coded_survey(t):
    """Numeric answers to labels; unknown sex or country codes drop the respondent."""
    orders = t.read("orders").join(t.read("customer"), F.col("o_custkey") == F.col("c_custkey"))
    code = F.substring("o_orderpriority", 1, 1)
    raw = orders.select(
        F.col("o_orderkey").alias("id"), F.col("c_nationkey").alias("country_code"), code.alias("sex"),
        (F.floor(F.col("o_totalprice") / 5000) - 2).alias("age"), code.alias("religion"), code.alias("town_size"),
    )
    countries = t.read("nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("label"))
    labelled = harmonize.coded_survey(raw, countries, 6)
    return labelled.groupBy("country", "gender", "age_group", "religion", "environment", "year").agg(F.count(F.lit(1)).alias("n"))


@query(
    "drop_incomplete",
    """WITH holed AS (SELECT nullif(lang, 'es') AS lang, nullif(source, 'src1') AS source FROM documents)
SELECT lang, source, count(*) AS n FROM holed WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY ALL""",
)
def drop_incomplete(t):
    holed = t.read("documents").select(F.nullif("lang", F.lit("es")).alias("lang"), F.nullif("source", F.lit("src1")).alias("source"))
    return harmonize.drop_incomplete(holed).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query(
    "dimension_slugs",
    f"""WITH {q.PEOPLE}, {q.shares("bench", "people", q.STANDARD, q.STANDARD_KEYS)}
SELECT DISTINCT dimension, replace(replace(lower(dimension), ' × ', '_'), ' ', '_') AS slug FROM bench""",
)
def dimension_slugs(t):
    names = t.benchmark.select("dimension").distinct()
    return names.withColumn("slug", benchmarks.slug(F.col("dimension")))
