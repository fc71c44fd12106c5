"""Readers for survey exports, population tables and stored benchmarks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalens.functions import fixed
from stratalens.functions.expressions import clean_text
from stratalens.operators.harmonize import add_hierarchy, drop_incomplete, map_lenient
from stratalens.operators.ordering import first_rows
from stratalens.operators.strata import join_groups
from stratalens.session import materialize
from stratalens.sources.records import fields_of, quoted_records


def load_table(spark: SparkSession, path: str, schema: str | T.StructType | None = None, kind: str | None = None, **options) -> DataFrame:
    """Read a csv, json, orc or parquet path; the format comes from ``kind`` or the file ending."""
    kind = kind or (path.rstrip("/").rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else "parquet")
    reader = spark.read.format(kind)
    if kind == "csv":
        reader = reader.option("header", options.pop("header", True))
    if schema is not None:
        reader = reader.schema(schema)
    try:
        return reader.options(**options).load(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"no such data: {path}") from error
        raise


def load_benchmarks(spark: SparkSession, root: str, dimensions: Sequence[str] | None = None) -> DataFrame:
    """The long benchmark table, written by ``write_by``; a subset reads only its partitions."""
    frame = load_table(spark, root, kind="parquet")
    if dimensions is not None:
        frame = frame.where(F.col("dimension").isin(list(dimensions)))
    return frame


def load_benchmark_files(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """One csv file per dimension (keys and ``population_proportion``) as one long table."""
    parts = []
    for dimension, path in paths.items():
        frame = load_table(spark, path, kind="csv")
        keys = [c for c in frame.columns if c != "population_proportion"]
        parts.append(
            frame.select(
                F.explode(F.array(F.lit(dimension))).alias("dimension"),
                *keys,
                F.col("population_proportion").cast("double").alias("population_share"),
            )
        )
    if not parts:
        raise ValueError("no benchmark files given")
    long = parts[0]
    for part in parts[1:]:
        long = long.unionByName(part, allowMissingColumns=True)
    return long


def by_position(raw: DataFrame, positions: Mapping[str, int] = fixed.EXPORT_POSITIONS) -> DataFrame:
    """Demographic columns of a headerless export by position, cleaned; the line holding the
    question texts (and the header itself) is recognised by its own words and left out."""
    columns = raw.columns
    absent = [name for name, i in positions.items() if i >= len(columns)]
    if absent:
        raise ValueError(f"export has only {len(columns)} columns, missing {absent}")
    wave = ["wave"] if "wave" in columns else []
    picked = raw.select(*[clean_text(F.col(f"`{columns[i]}`")).alias(name) for name, i in positions.items()], *wave)
    titles = [text for text in fixed.QUESTION_COLUMNS]
    return picked.where("participant_id IS NOT NULL").where(~F.col("participant_id").isin(titles))


def load_participants(
    spark: SparkSession,
    path: str,
    mappings: DataFrame | None = None,
    regions: DataFrame | None = None,
    continents: DataFrame | None = None,
    layout: str = "positions",
    wave: str | None = None,
) -> DataFrame:
    """Participant export: cleaned, mapped leniently, with hierarchy, core columns present.

    ``layout="positions"`` takes columns of a quoted csv by place, ``"words"`` an unquoted single-column
    export. With ``wave``, a pattern for the file path such as ``(?i)wave[_ ]?(\\d+)``, the
    survey's number is added as ``wave``.
    """
    if layout == "words":
        raw = spark.read.text(path)
        raw = raw if wave is None else with_wave(raw, wave)
    elif layout == "positions":
        raw = load_quoted(spark, path, wave=wave)
    if layout == "words":
        frame = by_words(skip_title_line(raw))
    elif layout == "positions":
        frame = by_position(raw)
    else:
        raise ValueError("layout is 'positions' or 'words'")
    if mappings is not None:
        frame = map_lenient(frame, mappings, "participants", ["age_group", "gender", "religion", "environment", "country"])
    if regions is not None:
        frame = add_hierarchy(frame, regions, continents)
    return drop_incomplete(frame, fixed.CORE_COLUMNS)


def load_quoted(spark: SparkSession, path: str, header: bool = False, wave: str | None = None) -> DataFrame:
    """Quoted csv files of one layout as text columns; fields may hold line breaks, and a file is read by many tasks.

    Columns are named as Spark names those of a csv file: by the first record with ``header`` (which may run over several lines, and is
    left out of each file), else by place. Short records end in nulls; empty fields are null.
    """
    names = load_table(spark, path, kind="csv", header=header, multiLine=header, escape='"').columns
    records = quoted_records(spark, path)
    if header:
        heads = records.groupBy("file").agg(F.min("place").alias("head"))  # one row a file
        records = join_groups(records, heads, ["file"]).where(F.col("place") > F.col("head"))
    more = [] if wave is None else [wave_of(F.col("file"), wave).alias("wave")]
    cells = records.where(F.trim("value") != "").select("file", fields_of("value").alias("cells"))
    return cells.select(*[F.nullif(F.get("cells", F.lit(i)), F.lit("")).alias(name) for i, name in enumerate(names)], *more)


def by_question_text(raw: DataFrame, questions: Mapping[str, str] = fixed.QUESTION_COLUMNS) -> DataFrame:
    """Columns named by their question text under their standard names; all others are left out."""
    found = [(text, name) for text, name in questions.items() if text in raw.columns]
    return raw.select(*[F.col(f"`{text}`").alias(name) for text, name in found])


def skip_title_line(lines: DataFrame, value: str = "value") -> DataFrame:
    """Text lines without a leading line of empty column names."""
    return lines.where(~F.rlike(F.trim(value), F.lit(r'^[,"\s]*$')))


def load_question_texts(spark: SparkSession, path: str, questions: Mapping[str, str] = fixed.QUESTION_COLUMNS) -> DataFrame:
    """Export with question texts as its header, with or without a line of empty names above it.

    Each file's header is its first record with one of the question texts, and its columns are found by it; a file without one has the
    header of the first file that has. Copies of a header are left out. A text that the header lacks gives null; fields may hold
    line breaks.
    """
    records = quoted_records(spark, path).where(~F.rlike(F.trim("value"), F.lit(r'^[,"\s]*$')))
    known = reduce(lambda a, b: a | b, [F.contains("value", F.lit(text)) for text in questions])
    heads = records.groupBy("file").agg(F.min(F.when(known, F.struct("place", "value"))).alias("head"))  # one row a file
    common = heads.where("head IS NOT NULL").agg(F.min_by("head.value", "file")).scalar()
    heads = heads.select("file", F.col("head.place").alias("_place"), F.coalesce("head.value", common).alias("_head"))
    found = join_groups(records, heads, ["file"]).where("(_place IS NULL OR place > _place) AND value <> _head")
    found = found.select(fields_of("_head").alias("names"), fields_of("value").alias("cells"))
    at = {name: F.array_position("names", text) for text, name in questions.items()}
    cell = {n: F.when(p > 0, F.nullif(F.get("cells", (p - 1).cast("int")), F.lit(""))) for n, p in at.items()}
    return found.select(*[value.alias(name) for name, value in cell.items()])


def by_words(
    lines: DataFrame, positions: Mapping[str, int] = fixed.WORD_POSITIONS, needed: int = fixed.WORDS_NEEDED, value: str = "value"
) -> DataFrame:
    """Unquoted single-column export: lines split on blanks, short lines left out, fields by place."""
    wave = ["wave"] if "wave" in lines.columns else []
    parts = lines.select(F.split(F.trim(value), r"\s+").alias("parts"), *wave).where(F.size("parts") >= needed)
    picked = parts.select(*[F.get("parts", F.lit(i)).alias(name) for name, i in positions.items()], *wave)
    return picked.where(F.col("participant_id") != "Participant")


def load_below_marker(
    spark: SparkSession,
    path: str,
    marker: str,
    schema: str,
    delimiter: str = ",",
    names: Mapping[str, str] | None = None,
    fallback: int | None = None,
) -> DataFrame:
    """Csv whose real header line, recognised by ``marker``, stands below free-form notes.

    ``schema`` names the columns in the order of the file, or, with ``names`` (column -> its name in the
    header), in any order: each file's own header is searched, and a name it lacks gives null. Numbers that cannot be
    read become null. In a file without the marker, line ``fallback`` (from 0, every line counted) is
    the header; without ``fallback`` such a file is an error when its rows are read, never left out.

    Lines are numbered once, by block and order within the block, and written to the shared folder, so that the
    header and the lines below it see the same numbers; large files may be split over tasks.
    """
    lines = materialize(
        spark.read.text(path).select(
            F.col("_metadata.file_path").alias("file"),
            F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("place"),
            "value",
        )
    )
    head = F.struct("place", "value")
    heads = lines.groupBy("file").agg(F.min(F.when(F.contains("value", F.lit(marker)), head)).alias("head"))
    if fallback is not None:
        numbered = first_rows(lines, [F.col("place")], fallback + 1, ["file"])
        stated = numbered.where(F.col("rank") == fallback + 1).select("file", head.alias("stated"))
        heads = join_groups(heads, stated, ["file"], "left").select("file", F.coalesce("head", "stated").alias("head"))
    absent = F.raise_error(F.concat(F.lit(f"no line with {marker!r} in "), F.col("file"))).cast("boolean")
    inside = F.when(F.col("head").isNull(), absent).otherwise(F.col("place") > F.col("head.place"))
    below = join_groups(lines, heads, ["file"]).where(inside)
    if names is None:
        row = F.from_csv("value", F.lit(schema), {"sep": delimiter, "mode": "PERMISSIVE"})
        return below.select(row.alias("row")).select("row.*").na.drop(how="all")
    fields = T.StructType.fromDDL(schema).fields
    found = below.select(fields_of("head.value", delimiter).alias("names"), fields_of("value", delimiter).alias("cells"))
    at = {f.name: F.array_position("names", names.get(f.name, f.name)) for f in fields}
    value = {n: F.when(p > 0, F.nullif(F.get("cells", (p - 1).cast("int")), F.lit(""))) for n, p in at.items()}
    return found.select(*[value[f.name].try_cast(f.dataType).alias(f.name) for f in fields]).na.drop(how="all")


def wave_of(path: Column, pattern: str) -> Column:
    return F.regexp_extract(path, pattern, 1).try_cast("int")


def with_wave(frame: DataFrame, pattern: str = r"(?i)wave[_ ]?(\d+)") -> DataFrame:
    """Wave number out of the file path of every row."""
    return frame.withColumn("wave", wave_of(F.col("_metadata.file_path"), pattern))


def load_coded_surveys(spark: SparkSession, path: str, mappings: DataFrame | None = None) -> DataFrame:
    """All processed coded surveys below ``path`` as one table with their wave."""
    frame = with_wave(load_table(spark, path, kind="csv"))
    if mappings is not None:
        frame = map_lenient(frame, mappings, "coded", ["age_group", "gender", "religion"])
    return frame


def load_waves(spark: SparkSession, pattern: str, survey: str = r"([^/]+)/[^/]+$", kind: str = "csv") -> DataFrame:
    """All waves matching a glob as one table; ``survey`` is cut out of each file's path."""
    frame = load_table(spark, pattern, kind=kind)
    return frame.withColumn("survey", F.regexp_extract(F.col("_metadata.file_path"), survey, 1))


def load_population_tables(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, DataFrame]:
    """Published population tables as text; headers and fields may run over several lines."""
    return {name: load_quoted(spark, path, header=True) for name, path in paths.items()}


def load_variances(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Variance lookup as written by ``write_variances``."""
    return load_table(spark, path, "survey string, dimension string, stratum string, variance double", kind)


def load_nested_variances(spark: SparkSession, path: str, survey: str) -> DataFrame:
    """Variance lookup of one survey from nested json ``{dimension: {stratum: variance}}``."""
    nested = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, map<string, double>>").alias("m"))
    outer = nested.select(F.explode("m").alias("dimension", "strata"))
    return outer.select(F.lit(survey).alias("survey"), "dimension", F.explode("strata").alias("stratum", "variance"))
