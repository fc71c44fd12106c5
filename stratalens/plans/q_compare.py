"""Waves, surveys and category sets side by side."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.operators import compare, scores
from stratalens.operators.sparse import group_scores
from stratalens.operators.strata import Dimension, key_columns
from stratalens.plans import sqltext as q
from stratalens.plans.q_scores import FULL, full_card
from stratalens.plans.registry import query
from stratalens.plans.testbed import COUNTRY_SEGMENT, DOCUMENT, LANG_SOURCE, STANDARD

WAVES = f"""{q.ORDERS}, {q.lined_up(q.STANDARD, q.STANDARD_KEYS, by=("wave",))},
card AS (SELECT wave, dimension, max(size) AS size, {q.MATCH} AS m, {q.COVERAGE} AS c FROM aligned GROUP BY wave, dimension)"""


def wave_card(t):
    cells = t.order_cells(key_columns(STANDARD), ["wave"])
    card = group_scores(cells, t.benchmark, STANDARD, ["wave"], weighted=False)
    return card.select("wave", "dimension", "sample_size", "match_score", "coverage_score")


def survey_card(t):
    return full_card(t).withColumnRenamed("priority", "survey")


@query(
    "wave_trend",
    f"""WITH {WAVES} SELECT dimension, wave, {q.r("m", "match_score")}, {q.r("m - lag(m) OVER w", "change")},
  {q.r("(m - lag(m) OVER w) / lag(m) OVER w * 100", "change_pct")} FROM card WINDOW w AS (PARTITION BY dimension ORDER BY wave)""",
)
def wave_trend(t):
    """Score per year of ordering with the change to the year before."""
    return compare.wave_changes(wave_card(t))


@query(
    "overall_trend",
    f"""WITH {WAVES}, ends AS (SELECT dimension, count(*) AS waves, arg_min(m, wave) AS f, arg_max(m, wave) AS l FROM card GROUP BY dimension)
SELECT dimension, waves, {q.r("f", "first_score")}, {q.r("l", "last_score")}, {q.r("l - f", "trend")}, {q.r("(l - f) / f * 100", "trend_pct")},
  CASE WHEN round(l - f, 12) > 0 THEN 'Positive' ELSE 'Negative' END AS direction FROM ends""",
)
def overall_trend(t):
    return compare.overall_trend(wave_card(t))


LOO = f"""{FULL}, sums AS (SELECT dimension, sum(match_score) AS s, count(*) AS c FROM card GROUP BY dimension),
loo AS (SELECT priority AS survey, dimension, match_score, (s - match_score) / (c - 1) AS others FROM card JOIN sums USING (dimension))"""


@query(
    "leave_one_out",
    f"""WITH {LOO} SELECT survey, dimension, {q.r("match_score", "match_score")}, {q.r("others", "others_mean")},
  {q.r("match_score - others", "strength")} FROM loo""",
)
def leave_one_out(t):
    return compare.leave_one_out(survey_card(t))


@query(
    "strongest_and_weakest",
    f"""WITH {LOO}, ranked AS (SELECT *, row_number() OVER (PARTITION BY survey ORDER BY round(match_score - others, 9) DESC, dimension) AS hi,
  row_number() OVER (PARTITION BY survey ORDER BY round(match_score - others, 9), dimension) AS lo FROM loo)
SELECT survey, max(dimension) FILTER (hi = 1) AS strongest, {q.r("max(match_score - others)", "strongest_by")},
  max(dimension) FILTER (lo = 1) AS weakest, {q.r("min(match_score - others)", "weakest_by")} FROM ranked GROUP BY survey""",
)
def strongest_and_weakest(t):
    return compare.strongest_and_weakest(compare.leave_one_out(survey_card(t)))


@query(
    "consistency",
    f"""WITH {WAVES} SELECT dimension, count(*) AS surveys, {q.r("1 - stddev_pop(m) / avg(m)", "consistency")} FROM card GROUP BY dimension""",
)
def consistency(t):
    return compare.consistency(wave_card(t))


PIVOT = ", ".join(
    q.r(f"max({c}) FILTER (dimension = '{d}')", f'"{c}: {d}"') for c in ("match_score", "coverage_score") for d, _ in q.STANDARD
)


@query(
    "compare_pivot",
    f"""WITH {FULL} SELECT priority AS survey, max(sample_size) AS participants, {q.r("avg(match_score)", "average_score")},
  {q.r("avg(coverage_score)", "average_coverage")}, {q.r("1 - avg(match_score)", "gap_to_perfect")},
  {q.r("avg(match_score) / max(sample_size) * 100", "score_per_hundred")}, {PIVOT},
  (SELECT count(DISTINCT country) FROM survey WHERE survey.priority = card.priority) AS countries FROM card GROUP BY priority""",
)
def compare_pivot(t):
    """Surveys side by side, with the countries that answered and score and coverage of every dimension."""
    countries = t.order_cells(["country"], ["priority"]).withColumnRenamed("priority", "survey")
    return compare.comparison_table(survey_card(t), STANDARD, countries=countries)


@query(
    "comparison_summary",
    f"""WITH {FULL}, per AS (SELECT priority, avg(match_score) AS a, max(sample_size) AS n FROM card GROUP BY priority),
dims AS (SELECT dimension, avg(match_score) AS a FROM card GROUP BY dimension)
SELECT count(*) AS surveys, CAST(sum(n) AS BIGINT) AS participants, {q.r("avg(a)", "mean_score")},
  (SELECT priority FROM per ORDER BY round(a, 9) DESC, priority LIMIT 1) AS best_survey, {q.r("max(a)", "best_score")},
  (SELECT dimension FROM dims ORDER BY round(a, 9), dimension LIMIT 1) AS weakest_dimension FROM per""",
)
def comparison_summary(t):
    return compare.comparison_summary(survey_card(t))


@query(
    "methodology_pivot",
    f"""WITH {FULL}, tagged AS (SELECT *, CASE WHEN priority < '3' THEN 'panel' ELSE 'door' END AS method FROM card)
SELECT dimension, {q.r("avg(match_score) FILTER (method = 'panel')", "panel")}, {q.r("avg(match_score) FILTER (method = 'door')", "door")}
FROM tagged GROUP BY dimension""",
)
def methodology_pivot(t):
    tagged = survey_card(t).withColumn("method", F.when(F.col("survey") < "3", "panel").otherwise("door"))
    return compare.by_method(tagged, ["panel", "door"])


@query(
    "family_averages",
    f"""WITH {FULL}, f AS (SELECT * FROM (VALUES ('Country', 'geographic'), ('Region', 'geographic'), ('Segment', 'demographic'),
  ('Country × Segment', 'fine'), ('Region × Segment', 'fine')) v(dimension, family))
SELECT family, count(DISTINCT dimension) AS dimensions, {q.r("avg(match_score)", "average_score")} FROM card JOIN f USING (dimension) GROUP BY family""",
)
def family_averages(t):
    pairs = [("Country", "geographic"), ("Region", "geographic"), ("Segment", "demographic"), ("Country × Segment", "fine"), ("Region × Segment", "fine")]
    return compare.by_family(survey_card(t), t.spark.createDataFrame(pairs, "dimension string, family string"))


@query(
    "stacked_scorecards",
    f"""WITH {q.ORDERS}, {q.LABELLED}, {q.lined_up([q.STANDARD[4]], ("segment",))}, {q.counted("dc", "labelled", [q.DOCUMENT[1]], ("lang",))},
{q.shares("db", "documents", [q.DOCUMENT[1]], ("lang",))}
SELECT 'orders' AS survey, dimension, max(size) AS sample_size, {q.r(q.MATCH, "match_score")} FROM aligned GROUP BY dimension
UNION ALL SELECT 'documents', 'Language', (SELECT count(*) FROM labelled), {q.r("1 - 0.5 * sum(abs(coalesce(dc.n, 0)::DOUBLE / (SELECT count(*) FROM labelled) - coalesce(q, 0)))", "m")}
FROM db FULL OUTER JOIN dc ON db.lang = dc.lang""",
)
def stacked_scorecards(t):
    """Scorecards of unrelated surveys in one table."""
    segment, lang = STANDARD[4], DOCUMENT[1]
    orders = scores.match_and_coverage(t.aligned([segment])).withColumn("survey", F.lit("orders"))
    documents = scores.match_and_coverage(t.document_aligned([lang])).withColumn("survey", F.lit("documents"))
    return compare.stack([orders, documents]).select("survey", "dimension", "sample_size", "match_score")


ALIGN = """mine AS (SELECT 'lang' AS col, lang AS cat FROM labelled UNION SELECT 'source', source FROM labelled UNION SELECT 'label', 'q' || quality FROM labelled),
theirs AS (SELECT 'lang' AS col, lang AS cat FROM documents WHERE lang <> 'es' UNION SELECT 'source', source FROM documents WHERE lang = 'es'
  UNION SELECT 'label', 'q' || (n_chars % 1) FROM documents),
paired AS (SELECT coalesce(mine.col, theirs.col) AS col, coalesce(mine.cat, theirs.cat) AS cat, mine.cat IS NOT NULL AS m, theirs.cat IS NOT NULL AS t
  FROM mine FULL OUTER JOIN theirs ON mine.col = theirs.col AND mine.cat = theirs.cat),
stats AS (SELECT col, count(*) FILTER (m) AS sc, count(*) FILTER (t) AS bc, count(*) FILTER (m AND t) AS matched, count(*) FILTER (m AND NOT t) AS unmatched
  FROM paired GROUP BY col)"""


def alignment_sides(t):
    """The survey's categories against a benchmark that misses some of each column."""
    survey = t.labelled.select("lang", "source", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("label"))
    documents = t.read("documents")
    benchmark = documents.select(
        F.when(F.col("lang") != "es", F.col("lang")).alias("lang"),
        F.when(F.col("lang") == "es", F.col("source")).alias("source"),
        F.concat(F.lit("q"), (F.col("n_chars") % 1).cast("string")).alias("label"),
    )
    return survey, benchmark


@query(
    "alignment",
    f"""WITH {q.LABELLED}, {ALIGN} SELECT col AS "column", sc AS survey_categories, bc AS benchmark_categories, matched, unmatched,
  {q.r("matched::DOUBLE / sc", "coverage")}, CAST(NULL AS VARCHAR) AS missing_in FROM stats
UNION ALL SELECT 'topic', 0, 0, 0, 0, 0.0, 'survey, benchmark'""",
)
def alignment(t):
    survey, benchmark = alignment_sides(t)
    return compare.alignment(survey, benchmark, ["lang", "source", "label", "topic"])


@query(
    "unmatched_categories",
    f"""WITH {q.LABELLED}, {ALIGN}, freq AS (SELECT 'lang' AS col, lang AS cat, count(*) AS n FROM labelled GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM labelled GROUP BY 2
  UNION ALL SELECT 'label', 'q' || quality, count(*) FROM labelled GROUP BY 2),
lost AS (SELECT col, cat, n, row_number() OVER (PARTITION BY col ORDER BY cat) AS k FROM paired JOIN freq USING (col, cat) WHERE m AND NOT t)
SELECT col AS "column", k AS rank, cat AS category, n AS survey_rows FROM lost WHERE k <= 5""",
)
def unmatched_categories(t):
    survey, benchmark = alignment_sides(t)
    return compare.unmatched_categories(survey, benchmark, ["lang", "source", "label"])


@query(
    "alignment_report",
    f"""WITH {q.LABELLED}, {ALIGN}, dims AS (SELECT * FROM (VALUES ('Language', 'lang'), ('Language × Source', 'lang'), ('Language × Source', 'source'), ('Label', 'label')) v(dimension, col)),
rep AS (SELECT dimension, avg(matched::DOUBLE / sc) AS a, count(*) FILTER (matched < sc) AS issues FROM dims JOIN stats USING (col) GROUP BY dimension)
SELECT dimension, {q.r("a", "overall_alignment")}, issues, 'complete' AS status, CASE WHEN round(a, 12) >= 0.95 THEN 'Excellent alignment. Ready for analysis.'
  WHEN round(a, 12) >= 0.8 THEN 'Good alignment. Consider mapping unmapped categories or excluding them.'
  WHEN round(a, 12) >= 0.6 THEN 'Moderate alignment. Review unmapped categories and update segment mappings.'
  ELSE 'Poor alignment. Significant mapping work needed before analysis.' END AS recommendation FROM rep
UNION ALL SELECT 'Topic', NULL, NULL, 'skipped', 'Missing columns in survey data: [''topic'']'""",
)
def alignment_report(t):
    survey, benchmark = alignment_sides(t)
    dims = [Dimension("Language", ("lang",)), LANG_SOURCE, Dimension("Label", ("label",)), Dimension("Topic", ("topic",))]
    return compare.alignment_report(survey, benchmark, dims)


@query(
    "overlap_sets",
    """WITH a AS (SELECT DISTINCT n_name AS v FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'),
b AS (SELECT DISTINCT n_name AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT coalesce(a.v, b.v) AS value, CASE WHEN b.v IS NULL THEN 'only left' WHEN a.v IS NULL THEN 'only right' ELSE 'both' END AS "where"
FROM a FULL OUTER JOIN b ON a.v = b.v""",
)
def overlap_sets(t):
    """Countries of the customers of one segment against countries of the suppliers."""
    builders = t.population.where("segment = 'BUILDING'").select(F.col("country").alias("value"))
    return compare.overlap(builders, t.supplier_survey.select(F.col("country").alias("value")), "value")


@query(
    "strata_overlap",
    f"""WITH {q.LABELLED}, a AS (SELECT DISTINCT lang, source FROM labelled), b AS (SELECT DISTINCT lang, source FROM documents),
j AS (SELECT a.lang AS al, b.lang AS bl FROM a FULL OUTER JOIN b ON a.lang = b.lang AND a.source = b.source)
SELECT count(al) AS survey_strata, count(bl) AS benchmark_strata, count(*) FILTER (al IS NOT NULL AND bl IS NOT NULL) AS common_strata,
  {q.r("count(*) FILTER (al IS NOT NULL AND bl IS NOT NULL)::DOUBLE / count(al)", "overlap")} FROM j""",
)
def strata_overlap(t):
    return compare.strata_overlap(t.labelled, t.read("documents"), ["lang", "source"])


GAP = f"""{q.PEOPLE}, fine AS (SELECT country, segment, count(*)::DOUBLE / (SELECT count(*) FROM people) AS q FROM people GROUP BY ALL),
known AS (SELECT DISTINCT n_name AS country FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE r_name <> 'AMERICA')"""


def _known(t):
    return t.supplier_survey.where("region <> 'AMERICA'").select("country")


@query(
    "unmapped_gap",
    f"""WITH {GAP} SELECT country, {q.r("sum(q)", "population_share")} FROM fine WHERE country NOT IN (SELECT country FROM known) GROUP BY country""",
)
def unmapped_gap(t):
    """Countries the supplier list does not cover, with the population share they hold."""
    return compare.uncovered(t.benchmark_for(COUNTRY_SEGMENT), _known(t), "country")


@query(
    "mapping_coverage",
    f"""WITH {GAP}, per AS (SELECT CASE WHEN country IN (SELECT country FROM known) THEN 'mapped' ELSE 'unmapped' END AS state, country, sum(q) AS q FROM fine GROUP BY ALL)
SELECT state, count(*) AS categories, {q.r("sum(q)", "population_share")} FROM per GROUP BY state""",
)
def mapping_coverage(t):
    return compare.coverage_summary(t.benchmark_for(COUNTRY_SEGMENT), _known(t), "country")
