"""Whole flows over the thirteen standard dimensions: published tables, benchmark, survey, scorecard, analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.functions import fixed
from stratalens.operators import harmonize, scores
from stratalens.operators.strata import key_columns
from stratalens.plans import sqltext as q
from stratalens.plans import workflow
from stratalens.plans.registry import query
from stratalens.session import scratch_path
from stratalens.sources import readers

DIMS = fixed.STANDARD_DIMENSIONS
NAMED = [(d.name, d.columns) for d in DIMS]
KEYS = tuple(key_columns(DIMS))
FAITHS = {"AUTOMOBILE": "Christianity", "BUILDING": "Islam", "FURNITURE": "Hinduism", "HOUSEHOLD": "Buddhism", "MACHINERY": "Judaism"}
AGES = tuple(fixed.AGE_COLUMNS)
AREA, SETTING_AREA = "Region, subregion, country or area *", "Region, subregion, country or area"

_FAITH = "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FAITHS.items()) + " END"
_AGE = "CASE c_custkey % 6 " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(AGES)) + " END"
TRAITS = f"""people AS (
  SELECT c_custkey, n_nationkey, n_name AS country, CASE WHEN r_name <> 'AFRICA' THEN r_name END AS region,
    CASE WHEN r_name = 'AMERICA' THEN 'New World' WHEN r_name <> 'AFRICA' THEN 'Old World' END AS continent,
    CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender, {_AGE} AS age_group, {_FAITH} AS religion,
    CASE WHEN c_acctbal >= 3000 THEN 'Urban' ELSE 'Rural' END AS environment, c_acctbal
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _bench_sql() -> str:
    parts = []
    for d in DIMS:
        shown = ", ".join(k if k in d.columns else f"CAST(NULL AS VARCHAR) AS {k}" for k in KEYS)
        whole = " AND ".join(f"{c} IS NOT NULL" for c in d.columns)
        parts.append(f"SELECT '{d.name}' AS dimension, {shown}, sum(q) AS q FROM base_{d.base} WHERE {whole} GROUP BY {', '.join(d.columns)}")
    return "bench AS (" + "\n  UNION ALL ".join(parts) + ")"


BENCH = f"""{TRAITS},
paired AS (SELECT * FROM people WHERE country IN (SELECT country FROM people GROUP BY country HAVING count(DISTINCT gender) = 2)),
base_age_gender AS (SELECT country, region, continent, gender, age_group, count(*)::DOUBLE / (SELECT count(*) FROM paired) AS q FROM paired GROUP BY country, region, continent, gender, age_group),
faiths AS (SELECT country, region, continent, religion, count(*) AS n FROM people GROUP BY country, region, continent, religion),
totals AS (SELECT country, count(*) AS total FROM people GROUP BY country),
followers AS (SELECT faiths.*, total * (round(100.0::DOUBLE * n / total, 1) / 100) AS pop FROM faiths JOIN totals USING (country)),
base_religion AS (SELECT country, region, continent, religion, pop / (SELECT sum(pop) FROM followers) AS q FROM followers WHERE pop > 0),
base_environment AS (SELECT country, region, continent, environment, count(*)::DOUBLE / (SELECT count(*) FROM people) AS q FROM people GROUP BY country, region, continent, environment),
{_bench_sql()}"""


def _aligned_sql(dims, where: str) -> str:
    """The alignment of the prepared survey with the benchmark above."""
    text = q.lined_up(dims, KEYS, survey="answers")
    own = f"bench_n AS (SELECT 1),\nasked AS (SELECT * FROM bench WHERE dimension IN ({', '.join(repr(n) for n, _ in dims)}))"
    text = text.replace(q.shares("bench", "people", dims, KEYS), own).replace("FROM bench, sizes", "FROM asked, sizes").replace("bench.*", "asked.*")
    return f"answers AS (SELECT people.* FROM orders JOIN people ON o_custkey = c_custkey WHERE n_nationkey <> 7{where}),\n{text}"


def traits(t) -> DataFrame:
    age = F.element_at(F.array(*[F.lit(a) for a in AGES]), (F.col("c_custkey") % 6 + 1).cast("int"))
    faith = F.create_map(*[F.lit(x) for pair in FAITHS.items() for x in pair])
    return t.population.select(
        "c_custkey", "country", "c_acctbal",
        F.when(F.col("c_custkey") % 2 == 0, "Female").otherwise("Male").alias("gender"),
        age.alias("age_group"),
        F.element_at(faith, F.col("segment")).alias("religion"),
        F.when(F.col("c_acctbal") >= 3000, "Urban").otherwise("Rural").alias("environment"),
    )


def published(t) -> dict[str, DataFrame]:
    """The population as the four tables are published: text with blanks and commas in numbers, rounded
    percentages, rows for the whole world; written as csv and read again."""
    people = traits(t)
    spaced = lambda n: F.replace(F.format_number(n, 0), F.lit(","), F.lit(" "))
    tables = {}
    for name in ("Male", "Female"):
        counts = people.where(F.col("gender") == name).groupBy("country").agg(
            *[F.count_if(F.col("age_group") == g).alias(columns[0]) for g, columns in fixed.AGE_COLUMNS.items()]
        )
        world = counts.agg(*[F.sum(c[0]).alias(c[0]) for c in fixed.AGE_COLUMNS.values()]).withColumn("country", F.lit("WORLD"))
        both = counts.withColumn("Type", F.lit("Country/Area")).unionByName(world.withColumn("Type", F.lit("World")))
        tables[name] = both.select("Type", F.col("country").alias(AREA), *[spaced(c[0]).alias(c[0]) for c in fixed.AGE_COLUMNS.values()])
    percent = lambda g: F.round(F.count_if(F.col("religion") == g) * F.lit(100.0) / F.count(F.lit(1)), 1).cast("string")
    named = {g: columns[0] for g, columns in fixed.RELIGION_COLUMNS.items()}
    tables["religion"] = people.groupBy(F.col("country").alias("COUNTRY")).agg(
        F.format_number(F.count(F.lit(1)), 0).alias("2010 COUNTRY POPULATION"),
        *[percent(g).alias(c) for g, c in named.items()],
        *[F.first(F.lit("0.0")).alias(c) for columns in fixed.RELIGION_COLUMNS.values() for c in columns[1:]],
        F.first(F.lit("ISO")).alias("ISO3_Code"),
    )
    tables["setting"] = people.groupBy(F.col("country").alias(SETTING_AREA)).agg(
        *[spaced(F.count_if(F.col("environment") == g)).alias(c) for g, c in fixed.SETTING_COLUMNS.items()], F.first(F.lit("ISO")).alias("ISO3_Code")
    )
    paths = {}
    for name, table in tables.items():
        paths[name] = scratch_path(t.spark, f"published-{name}")
        table.write.option("header", True).csv(paths[name])
    return readers.load_population_tables(t.spark, paths)


def hierarchy(t) -> workflow.Hierarchy:
    """One region has no place in the tables, so its countries leave the regional dimensions."""
    regions = t.places.where("region <> 'AFRICA'").select("country", "region")
    continent = F.when(F.col("region") == "AMERICA", "New World").otherwise("Old World")
    return workflow.Hierarchy(regions, regions.select("region").distinct().withColumn("continent", continent))


def benchmark(t) -> DataFrame:
    tables = published(t)
    return workflow.build_benchmarks(tables["Male"], tables["Female"], tables["religion"], tables["setting"], hierarchy(t))


def survey(t, *columns: str) -> DataFrame:
    """Answers in other spellings; those the strict mapping does not list leave."""
    orders = t.read("orders").select("o_custkey").join(traits(t), F.col("o_custkey") == F.col("c_custkey"))
    raw = orders.select(
        F.lower("gender").alias("gender"),
        "age_group",
        "religion",
        F.when(F.col("c_acctbal") < 0, "Suburban").otherwise(F.col("environment")).alias("environment"),
        F.lower("country").alias("country"),
    ).select(*columns)
    nations = t.read("nation").where("n_nationkey <> 7")
    countries = nations.select(
        F.lit("participants").alias("source"), F.lit("country").alias("attribute"), F.lower("n_name").alias("raw_value"), F.col("n_name").alias("standard_value")
    )
    mappings = harmonize.standard_mappings(t.spark).unionByName(countries)
    return workflow.prepare_survey(raw, mappings, "participants", hierarchy(t), strict=True)


@query("flow_benchmarks", f"""WITH {BENCH} SELECT dimension, {", ".join(KEYS)}, {q.r("q", "population_share")} FROM bench""")
def flow_benchmarks(t):
    """Thirteen benchmarks out of four published tables."""
    return benchmark(t).select("dimension", *KEYS, "population_share")


PLACELESS = [(name, columns) for name, columns in NAMED if "environment" not in columns]
_BEST = "CASE dimension WHEN 'Country' THEN 0.9 " + " ".join(f"WHEN '{d}' THEN {m}" for d, m, _ in scores.DEFAULT_MAXIMA if d != "Country") + " END"
_ERRORS = "\n".join(
    f"UNION ALL SELECT '{name}', NULL, NULL, NULL, NULL, NULL, NULL, 'Missing columns: [''environment'']'" for name, columns in NAMED if "environment" in columns
)


@query(
    "flow_scorecard",
    f"""WITH {BENCH}, {_aligned_sql(PLACELESS, "")},
weighted AS (SELECT *, q * {q.SE} AS w FROM aligned),
card AS (SELECT dimension, max(size) AS sample_size, {q.MATCH} AS m, {q.COVERAGE} AS c, {q.STRATEGIC} AS st, {q.WEIGHTED} AS v FROM weighted GROUP BY dimension),
rated AS (SELECT *, 100 * m / {_BEST} AS pct FROM card),
every AS (SELECT * FROM rated UNION ALL SELECT 'Overall (Average)', max(sample_size), avg(m), avg(c), avg(st), avg(v), avg(pct) FROM rated)
SELECT dimension, sample_size, {q.r("m", "match_score")}, {q.r("c", "coverage_score")}, {q.r("st", "strategic_score")},
  {q.r("v", "weighted_score")}, {q.r("pct", "match_pct_of_max")}, CAST(NULL AS VARCHAR) AS error FROM every
{_ERRORS}""",
)
def flow_scorecard(t):
    """Strict mapping, all four scores, percent of the best attainable score, the row of averages, and an error
    for each dimension whose column the survey lacks."""
    stored = t.spark.createDataFrame([("Country", 1000, 0.9, 1.0)], "dimension string, size long, max_match double, max_coverage double")
    answers = survey(t, "gender", "age_group", "religion", "country")
    card = workflow.full_scorecard(answers, benchmark(t), maxima=stored)
    return card.select("dimension", "sample_size", *workflow.SCORES, "match_pct_of_max", "error")


@query(
    "flow_analysis",
    f"""WITH {BENCH}, {_aligned_sql(NAMED, " AND c_acctbal >= 0")},
gaps AS (SELECT *, {q.label(NAMED, KEYS)} AS segment, n::DOUBLE / sum(n) OVER (PARTITION BY dimension) - q AS dev FROM aligned),
top AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY round(abs(dev), 12) DESC, segment) AS rank FROM gaps WHERE q >= 0.0001),
gain AS (SELECT dimension, sum(abs(dev) / 2) AS g FROM top WHERE rank <= 10 GROUP BY dimension),
card AS (SELECT dimension, {q.MATCH} AS m FROM aligned GROUP BY dimension),
both_scores AS (SELECT dimension, m, least(1.0, m + coalesce(g, 0)) AS p FROM card LEFT JOIN gain USING (dimension))
SELECT dimension, {q.r("m", "current_score")}, {q.r("p", "potential_score")}, {q.r("p - m", "improvement")},
  {q.r("(p - m) / nullif(m, 0) * 100", "improvement_pct")} FROM both_scores""",
)
def flow_analysis(t):
    """What fixing the ten largest gaps would give in every standard dimension."""
    answers = survey(t, "gender", "age_group", "religion", "environment", "country")
    return workflow.analyse(answers, benchmark(t), DIMS).impact
