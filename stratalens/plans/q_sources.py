"""Readers and writers: the given tables are written in each format first, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.operators import harmonize, scores
from stratalens.plans import sqltext as q
from stratalens.plans.registry import query
from stratalens.plans.testbed import STANDARD
from stratalens.session import scratch_path
from stratalens.sources import readers, writers


def total():
    return F.count(F.lit(1)).alias("n")


@query(
    "source_exports",
    f"""WITH {q.ORDERS}, {q.lined_up(q.STANDARD, q.STANDARD_KEYS)},
card AS (SELECT dimension, max(size) AS sample_size, round({q.MATCH}, 6) + 0.0 AS match_score FROM aligned GROUP BY dimension)
SELECT 'csv' AS kind, * FROM card UNION ALL SELECT 'json', * FROM card UNION ALL SELECT 'parquet', * FROM card""",
)
def source_exports(t):
    """A scorecard written as csv, json and parquet, read back with its schema."""
    card = scores.match_and_coverage(t.aligned(STANDARD)).select("dimension", "sample_size", F.round("match_score", 6).alias("match_score"))
    out = None
    for kind in ("csv", "json", "parquet"):
        path = scratch_path(t.spark, f"scorecard-{kind}")
        writers.export(card, path, kind, {"survey": "orders"})
        back = readers.load_table(t.spark, path, card.schema, kind).select(F.lit(kind).alias("kind"), *card.columns)
        out = back if out is None else out.unionByName(back)
    return out


def written_export(t, header: bool) -> str:
    """Customers as a participant export by position, quoted, with the question line."""
    people = t.population
    age = F.when(F.col("c_acctbal") < 0, "").when(F.col("c_acctbal") < 5000, " 18-25 ").otherwise("65+")
    place = F.when(F.col("c_acctbal") < 3000, "Suburban").otherwise("Rural")
    fields = [F.lit("x"), F.lit("y"), F.col("c_custkey").cast("string"), F.lit("z"), F.lit("w"), age, F.lit("female"), place, F.lit("v"), F.lit("Sikhism"), F.col("country")]
    titles = ["a", "b", "Participant Id", "c", "d", "How old are you?", "What is your gender?", "What best describes where you live?", "e",
              "What religious group or faith do you most identify with?", "What country or region do you most identify with?"]
    rows = people.select(*[f.alias(name) for f, name in zip(fields, titles)])
    path = scratch_path(t.spark, "export")
    rows.write.option("header", True).csv(path)
    return path


EXPORTED = """exported AS (SELECT n_name AS country, CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal < 5000 THEN '18-25' ELSE '65+' END AS age_group,
    CASE WHEN c_acctbal < 3000 THEN 'Urban' ELSE 'Rural' END AS environment FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query(
    "source_participants",
    f"""WITH {EXPORTED} SELECT e.country, r_name AS region, age_group, 'Female' AS gender, environment, 'Other religious group' AS religion, count(*) AS n
FROM exported e JOIN nation ON n_name = e.country JOIN region ON n_regionkey = r_regionkey WHERE age_group IS NOT NULL GROUP BY ALL""",
)
def source_participants(t):
    """Export by column position: cleaned, mapped, with region, incomplete respondents dropped."""
    loaded = readers.load_participants(
        t.spark, written_export(t, True), harmonize.standard_mappings(t.spark), t.places.select("country", "region")
    )
    return loaded.groupBy("country", "region", "age_group", "gender", "environment", "religion").agg(total())


@query(
    "source_question_texts",
    f"""WITH {EXPORTED} SELECT country, trim(age_group) AS age_group, count(*) AS n FROM exported GROUP BY ALL""",
)
def source_question_texts(t):
    """The same export by question text."""
    named = readers.by_question_text(readers.load_table(t.spark, written_export(t, True), kind="csv"))
    return named.groupBy("country", F.nullif(F.trim("age_group"), F.lit("")).alias("age_group")).agg(total())


@query(
    "source_titled_texts",
    f"""WITH {EXPORTED} SELECT country, trim(age_group) AS age_group, count(*) AS n FROM exported GROUP BY ALL""",
)
def source_titled_texts(t):
    """The export with a line of empty names above the question texts."""
    lines = t.spark.read.text(written_export(t, True)).select("value", F.lit(1).alias("place"))
    titles = t.read("region").select(F.lit(",,,,,,,,,,").alias("value"), F.lit(0).alias("place")).distinct()
    heads = lines.where(F.contains("value", F.lit("How old are you?"))).limit(1).withColumn("place", F.lit(0))
    body = lines.where(~F.contains("value", F.lit("How old are you?")))
    path = scratch_path(t.spark, "titled")
    for part in (titles.unionByName(heads).coalesce(1).orderBy("place", F.length("value")), body):
        part.select("value").write.mode("append").text(path)
    named = readers.load_question_texts(t.spark, path)
    return named.groupBy("country", F.nullif(F.trim("age_group"), F.lit("")).alias("age_group")).agg(total())


NOTES = {"What is your\nnote?": "note", "What country or region do you most identify with?": "country"}


@query(
    "source_broken_lines",
    f"""WITH {q.PEOPLE} SELECT country, 'said "' || segment || '",' || chr(10) || chr(10) || 'then nothing' AS note, count(*) AS n FROM people GROUP BY ALL""",
)
def source_broken_lines(t):
    """An export whose fields hold line breaks, commas and quotes, below a question text with a line break."""
    note = F.concat(F.lit('said "'), "segment", F.lit('",\n\nthen nothing'))
    named = dict(zip(NOTES.values(), NOTES))
    rows = t.population.select("c_custkey", note.alias(named["note"]), F.col("country").alias(named["country"]))
    path = scratch_path(t.spark, "broken-lines")
    rows.write.option("header", True).option("escape", '"').csv(path)
    return readers.load_question_texts(t.spark, path, NOTES).groupBy("country", "note").agg(total())


@query(
    "source_participant_waves",
    """SELECT CASE WHEN c_acctbal < 0 THEN 1 ELSE 2 END AS wave, n_name AS country, count(*) AS n
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""",
)
def source_participant_waves(t):
    """Word exports of two waves; the wave comes from each file's path."""
    words = [F.col("c_custkey").cast("string"), F.lit("a b c d 18-25 Male Urban e Islam"), F.col("country")]
    people = t.population.select("c_acctbal", F.concat_ws(" ", *words).alias("value"))
    path = scratch_path(t.spark, "participants")
    for wave, part in ((1, people.where("c_acctbal < 0")), (2, people.where("c_acctbal >= 0"))):
        part.select("value").write.text(f"{path}/wave_{wave}")
    loaded = readers.load_participants(t.spark, f"{path}/*", layout="words", wave=r"wave_(\d+)")
    return loaded.groupBy("wave", "country").agg(total())


@query(
    "source_words",
    """SELECT 'c' || c_nationkey AS country, c_mktsegment AS religion, count(*) AS n FROM customer GROUP BY ALL""",
)
def source_words(t):
    """Unquoted single-column export read as text."""
    line = F.concat_ws(
        " ", F.col("c_custkey").cast("string"), F.lit("a b c d 18-25 Male Urban e"), "c_mktsegment", F.concat(F.lit("c"), F.col("c_nationkey").cast("string"))
    )
    path = scratch_path(t.spark, "words")
    t.read("customer").select(line.alias("value")).write.text(path)
    return readers.by_words(readers.skip_title_line(t.spark.read.text(path))).groupBy("country", "religion").agg(total())


@query(
    "source_below_marker",
    """SELECT c_nationkey AS q266, count(*) AS n, count(CASE WHEN c_acctbal >= 0 THEN 1 END) AS readable FROM customer GROUP BY c_nationkey""",
)
def source_below_marker(t):
    """Coded files with notes above the header line; unreadable codes become null."""
    files = 4
    rows = t.read("customer").select(
        F.pmod(F.xxhash64("c_custkey"), F.lit(files)).cast("int").alias("part"),
        F.col("c_custkey").alias("place"),
        F.concat_ws(",", F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string"), F.when(F.col("c_acctbal") >= 0, "1").otherwise("n/a")).alias("value"),
    )
    head = F.explode(F.array(*[F.struct(F.lit(place).cast("long").alias("place"), F.lit(text).alias("value")) for place, text in
                               ((-3, "Some survey, wave 7"), (-2, "1,2,3"), (-1, "D_INTERVIEW,Q266,Q260"))]))
    notes = t.spark.range(files).select(F.col("id").cast("int").alias("part"), head.alias("h")).select("part", "h.place", "h.value")
    path = scratch_path(t.spark, "coded")
    whole = rows.unionByName(notes).repartition("part").sortWithinPartitions("part", "place")
    whole.select("part", "value").write.partitionBy("part").text(path)
    coded = readers.load_below_marker(t.spark, f"{path}/part=*", "D_INTERVIEW", "id BIGINT, q266 INT, q260 INT")
    return coded.groupBy("q266").agg(total(), F.count("q260").alias("readable"))


@query(
    "source_marker_missing",
    """SELECT c_nationkey AS q266, count(*) AS n, count(CASE WHEN c_custkey % 3 <> 0 THEN 1 END) AS named,
  count(CASE WHEN c_acctbal >= 0 THEN 1 END) AS readable FROM customer GROUP BY c_nationkey""",
)
def source_marker_missing(t):
    """One file lacks the marker and takes the line that is agreed on as its header, one has its columns in another
    order; columns are found by their names in each file's own header."""
    place = F.col("c_custkey")
    part = F.pmod(place, F.lit(3)).cast("int")
    answer = F.when(F.col("c_acctbal") >= 0, "1").otherwise("n/a")
    cells = [place.cast("string"), F.col("c_nationkey").cast("string"), answer]
    line = F.when(part == 1, F.concat_ws(",", *reversed(cells))).otherwise(F.concat_ws(",", *cells))
    rows = t.read("customer").select(part.alias("part"), place.alias("place"), line.alias("value"))
    heads = [(0, "ID,Q266,Q260"), (1, 'Q260,"Q266",D_INTERVIEW'), (2, "D_INTERVIEW,Q266,Q260")]
    above = [F.struct(F.lit(k).alias("part"), F.lit(at).cast("long").alias("place"), F.lit(text).alias("value"))
             for k, head in heads for at, text in ((-3, "Some survey"), (-2, "notes, below"), (-1, head))]
    notes = t.spark.range(1).select(F.explode(F.array(*above)).alias("h")).select("h.*")
    path = scratch_path(t.spark, "unmarked")
    whole = rows.unionByName(notes).repartition("part").sortWithinPartitions("part", "place")
    whole.select("part", "value").write.partitionBy("part").text(path)
    coded = readers.load_below_marker(
        t.spark, f"{path}/part=*", "D_INTERVIEW", "id BIGINT, q266 INT, q260 INT",
        names={"id": "D_INTERVIEW", "q266": "Q266", "q260": "Q260"}, fallback=2,
    )
    return coded.groupBy("q266").agg(total(), F.count("id").alias("named"), F.count("q260").alias("readable"))


WAVES = """waves AS (SELECT CASE WHEN o_orderpriority < '3' THEN 6 ELSE 7 END AS wave, o_orderstatus FROM orders)"""


def written_waves(t) -> str:
    path = scratch_path(t.spark, "waves")
    gender = F.when(F.col("o_orderstatus") == "F", "1").when(F.col("o_orderstatus") == "O", "2").otherwise("9")
    orders = t.read("orders").withColumn("early", F.col("o_orderpriority") < "3")
    for wave, early in ((6, True), (7, False)):
        part = orders.where(F.col("early") == early).select(gender.alias("gender"), F.lit("5").alias("religion"))
        part.write.option("header", True).csv(f"{path}/wave_{wave}")
    return path


@query(
    "source_coded_waves",
    f"""WITH {WAVES} SELECT CAST(wave AS INTEGER) AS wave, CASE o_orderstatus WHEN 'F' THEN 'Male' WHEN 'O' THEN 'Female' ELSE '9' END AS gender,
  'Islam' AS religion, count(*) AS n FROM waves GROUP BY ALL""",
)
def source_coded_waves(t):
    """Coded waves as one table; the wave comes from the path, labels from the mapping."""
    coded = readers.load_coded_surveys(t.spark, f"{written_waves(t)}/*", harmonize.standard_mappings(t.spark))
    return coded.groupBy("wave", "gender", "religion").agg(total())


@query("source_waves", f"""WITH {WAVES} SELECT 'wave_' || wave AS survey, count(*) AS n FROM waves GROUP BY ALL""")
def source_waves(t):
    """All files of a glob as one table with a survey column."""
    return readers.load_waves(t.spark, f"{written_waves(t)}/*/*.csv").groupBy("survey").agg(total())


@query(
    "source_variances",
    f"""WITH {q.LABELLED}, v AS (SELECT 'docs' AS survey, 'Language' AS dimension, lang AS stratum, round(var_samp(quality), 6) + 0.0 AS variance FROM labelled GROUP BY lang
  UNION ALL SELECT 'docs', 'Source', source, round(var_samp(quality), 6) + 0.0 FROM labelled GROUP BY source)
SELECT 'json' AS kind, * FROM v UNION ALL SELECT 'parquet', * FROM v""",
)
def source_variances(t):
    """Variance lookup as json records and as parquet."""
    def spread(column, name):
        found = t.labelled.groupBy(F.col(column).alias("stratum")).agg(F.round(F.var_samp("quality"), 6).alias("variance"))
        return found.select(F.lit("docs").alias("survey"), F.lit(name).alias("dimension"), "stratum", "variance")

    variances = spread("lang", "Language").unionByName(spread("source", "Source"))
    out = None
    for kind in ("json", "parquet"):
        path = scratch_path(t.spark, "variances")
        writers.write_variances(variances, path, kind)
        back = readers.load_variances(t.spark, path, kind).select(F.lit(kind).alias("kind"), "survey", "dimension", "stratum", "variance")
        out = back if out is None else out.unionByName(back)
    return out


@query(
    "source_nested_variances",
    f"""WITH {q.LABELLED} SELECT 'docs' AS survey, 'Language' AS dimension, lang AS stratum, round(var_samp(quality), 6) + 0.0 AS variance FROM labelled GROUP BY lang
  UNION ALL SELECT 'docs', 'Source', source, round(var_samp(quality), 6) + 0.0 FROM labelled GROUP BY source""",
)
def source_nested_variances(t):
    """Variance lookup of one survey from one nested json object."""
    parts = []
    for column, name in (("lang", "Language"), ("source", "Source")):
        spread = t.labelled.groupBy(F.col(column).alias("stratum")).agg(F.round(F.var_samp("quality"), 6).alias("variance"))
        parts.append(spread.agg(F.map_from_entries(F.collect_list(F.struct("stratum", "variance"))).alias("strata")).withColumn("dimension", F.lit(name)))
    whole = parts[0].unionByName(parts[1]).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("dimension", "strata")))).alias("value"))
    path = scratch_path(t.spark, "nested")
    whole.write.text(path)
    return readers.load_nested_variances(t.spark, f"{path}/part-*", "docs")
