"""Bringing messy category labels to standard ones through mapping tables.

A mapping table has ``source, attribute, raw_value, standard_value``. Whether a table is broadcast is left to the
optimizer, which knows its size at run time and splits skewed keys of larger joins; no job runs while a frame is built.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.functions import fixed
from stratalens.functions.expressions import age_band, inline_table, town_setting

def mapping_table(spark: SparkSession, mappings: Mapping[str, Mapping[str, Mapping[str, Sequence[str]]]]) -> DataFrame:
    """Nested ``source -> attribute -> standard -> raw values`` as a table."""
    rows = [
        (source, attribute, raw, standard)
        for source, attributes in mappings.items()
        for attribute, standards in attributes.items()
        for standard, raws in standards.items()
        for raw in raws
    ]
    return inline_table(spark, rows, ["source", "attribute", "raw_value", "standard_value"])


def standard_mappings(spark: SparkSession) -> DataFrame:
    """The built-in mapping table with inheritance resolved."""
    inherits = inline_table(spark, fixed.SEGMENT_INHERITS, ["source", "attribute", "parent"])
    return resolve_mappings(mapping_table(spark, fixed.SEGMENT_MAPPINGS), inherits)


def resolve_mappings(mappings: DataFrame, inherits: DataFrame) -> DataFrame:
    """Add to every source what it inherits: ``inherits`` has ``source, attribute, parent``."""
    parents = mappings.select(F.col("source").alias("parent"), "attribute", "raw_value", "standard_value")
    taken = inherits.join(parents, ["parent", "attribute"]).select("source", "attribute", "raw_value", "standard_value")
    return mappings.select("source", "attribute", "raw_value", "standard_value").unionByName(taken)


def one_value_each(mappings: DataFrame, ranked_sources: Sequence[str]) -> DataFrame:
    """One standard value per raw value; sources later in the list override earlier ones."""
    rank = F.lit(None).cast("int")
    for i, source in enumerate(ranked_sources):
        rank = F.when(F.col("source") == source, F.lit(i)).otherwise(rank)
    ranked = mappings.where(F.col("source").isin(list(ranked_sources))).withColumn("_rank", rank)
    return ranked.groupBy("attribute", "raw_value").agg(
        F.max_by("standard_value", F.struct("_rank", "standard_value")).alias("standard_value")
    )


def map_columns(survey: DataFrame, mapping: DataFrame, columns: Sequence[str], strict: bool) -> DataFrame:
    """Replace raw by standard values in ``columns``.

    Strict: respondents with a value the mapping does not list are dropped. Lenient: the value
    stays. ``mapping`` has one row per ``attribute, raw_value`` (see ``one_value_each``).
    """
    frame = survey
    present = [c for c in columns if c in survey.columns]
    for column in present:
        table = mapping.where(F.col("attribute") == column).select(F.col("raw_value").alias("_raw"), F.col("standard_value").alias("_std"))
        frame = frame.join(table, frame[column] == F.col("_raw"), "inner" if strict else "left")
        value = F.col("_std") if strict else F.coalesce("_std", column)
        frame = frame.withColumn(column, value).drop("_raw", "_std")
    return frame


def map_strict(survey: DataFrame, mappings: DataFrame, source: str, columns: Sequence[str]) -> DataFrame:
    return map_columns(survey, one_value_each(mappings, [source]), columns, strict=True)


def map_lenient(survey: DataFrame, mappings: DataFrame, source: str, columns: Sequence[str]) -> DataFrame:
    """Survey mapping first, overridden by the benchmark mapping; suburban places count as urban."""
    frame = map_columns(survey, one_value_each(mappings, [source, "benchmark"]), columns, strict=False)
    if "environment" in frame.columns:
        frame = suburban_as_urban(frame)
    return frame


def suburban_as_urban(frame: DataFrame, column: str = "environment") -> DataFrame:
    return frame.withColumn(column, F.when(F.col(column) == "Suburban", "Urban").otherwise(F.col(column)))


def add_hierarchy(frame: DataFrame, regions: DataFrame, continents: DataFrame | None = None) -> DataFrame:
    """Add ``region`` (from ``country, region``) and ``continent`` (from ``region, continent``); unmapped gives null."""
    out = frame.drop("region", "continent").join(regions.select("country", "region"), "country", "left")
    if continents is not None:
        out = out.join(continents.select("region", "continent"), "region", "left")
    return out


def unmapped_values(frame: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """Distinct values of ``column`` the table does not know, with their frequency."""
    counts = frame.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(table.select(column).distinct(), column, "left_anti")


def _looked_up(column: str, values: Mapping) -> F.Column:
    pairs = [part for raw, standard in values.items() for part in (F.lit(raw), F.lit(standard))]
    return F.try_element_at(F.create_map(*pairs), F.col(column))


def recode_demographics(survey: DataFrame) -> DataFrame:
    """Fixed spellings per demographic column; respondents without country, gender or age leave."""
    frame = survey
    for column, values in fixed.SYNONYMS.items():
        if column in frame.columns:
            frame = frame.withColumn(column, _looked_up(column, values))
    if "country" in frame.columns:
        frame = frame.withColumn("country", F.coalesce(_looked_up("country", fixed.COUNTRY_SPELLINGS), F.col("country")))
    return drop_incomplete(frame, fixed.CORE_COLUMNS)


def drop_incomplete(frame: DataFrame, columns: Sequence[str] | None = None, how: str = "any") -> DataFrame:
    """Drop rows with any (or only) missing values in ``columns``."""
    return frame.na.drop(how=how, subset=list(columns) if columns else None)


def keep_known(survey: DataFrame, benchmark: DataFrame, column: str) -> DataFrame:
    """Respondents whose category the benchmark knows."""
    return survey.join(benchmark.select(column).distinct(), column, "left_semi")


def label_codes(frame: DataFrame, column: str, codes: DataFrame | Mapping[int, str], name: str) -> DataFrame:
    """Label for a numeric code, from a small dict or from a ``code, label`` table; unknown gives null."""
    if isinstance(codes, DataFrame):
        table = codes.select(F.col("code").alias("_code"), F.col("label").alias(name))
        return frame.join(table, F.col(column) == F.col("_code"), "left").drop("_code")
    return frame.withColumn(name, _looked_up(column, {int(k): v for k, v in codes.items()}))


def coded_survey(raw: DataFrame, countries: DataFrame, wave: int) -> DataFrame:
    """Numeric answers of a coded survey as labels: ``id, country_code, sex, age, religion, place``
    (or ``town_size`` instead of ``place``). Respondents without id, country or gender leave."""
    numeric = raw
    for column in ("sex", "age", "religion", "place", "town_size"):
        if column in raw.columns:
            numeric = numeric.withColumn(column, F.col(column).cast("string").try_cast("int"))
    frame = label_codes(numeric, "country_code", countries, "country")
    frame = label_codes(frame, "sex", fixed.SEX_CODES, "gender").withColumn("age_group", age_band(F.col("age")))
    frame = label_codes(frame.withColumnRenamed("religion", "_religion"), "_religion", fixed.RELIGION_CODES, "religion")
    if "place" in raw.columns:
        frame = label_codes(frame, "place", fixed.PLACE_CODES, "environment")
    else:
        frame = frame.withColumn("environment", town_setting(F.col("town_size")))
    frame = frame.select(
        F.col("id").cast("string").alias("participant_id"),
        "country", "gender", "age", "age_group", "religion", "environment",
        F.lit(wave).alias("wave"), F.lit(fixed.WAVE_YEARS.get(wave)).cast("int").alias("year"),
    )
    return drop_incomplete(frame, ["participant_id", "country", "gender"])
