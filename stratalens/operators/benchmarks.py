"""Population tables as published (wide, numbers as text) to benchmarks of stratum shares."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.functions import fixed
from stratalens.functions.expressions import bounded_count, percent_text, plain_number, ratio
from stratalens.operators.strata import Dimension, roll_up_shares


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def real_countries(
    raw: DataFrame,
    country: str,
    iso: str | None = None,
    kind: str | None = None,
    kinds: Sequence[str] = fixed.COUNTRY_TYPES,
    aggregates: DataFrame | Sequence[str] = (),
    words: Sequence[str] = (),
) -> DataFrame:
    """Rows that are countries: right kind, an ISO code, no aggregate name, no aggregate word."""
    frame = raw
    if kind is not None:
        frame = frame.where(_quoted(kind).isin(list(kinds)))
    if iso is not None:
        code = F.trim(_quoted(iso))
        frame = frame.where(code.isNotNull() & (code != "") & (code != "nan"))
    if isinstance(aggregates, DataFrame):
        frame = frame.join(aggregates.select(F.col("name").alias("_agg")), _quoted(country) == F.col("_agg"), "left_anti")
    elif aggregates:
        frame = frame.where(~_quoted(country).isin(list(aggregates)))
    for word in words:
        frame = frame.where(~F.contains(F.lower(_quoted(country)), F.lit(word)))
    return frame


def to_shares(population: DataFrame, value: str = "population") -> DataFrame:
    """Replace population numbers by shares of their sum."""
    total = population.agg(F.sum(value).alias("total"))
    return population.withColumn("population_share", ratio(F.col(value), total.scalar())).drop(value)


def age_population(
    raw: DataFrame, country: str, label: str, groups: Mapping[str, Sequence[str]] = fixed.AGE_COLUMNS
) -> DataFrame:
    """One row per country and age group out of wide age columns; ``label`` names the gender."""
    found = _age_groups(_age_rows(raw, country, label, groups), groups)
    return found.where("population > 0")


def _age_rows(raw: DataFrame, country: str, label: str, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Country and gender with the age columns of the table as text."""
    wanted = [c for columns in groups.values() for c in columns if c in raw.columns]
    text = [_quoted(c).cast("string").alias(c) for c in wanted]
    return raw.select(_quoted(country).alias("country"), F.lit(label).alias("gender"), *text)


def _age_groups(rows: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Population per country, gender and age group; unreadable numbers count as none.

    The table is unpivoted once, whatever genders it holds."""
    wanted = {column: group for group, columns in groups.items() for column in columns if column in rows.columns}
    long = rows.unpivot(["country", "gender"], [_quoted(c) for c in wanted], "column", "text")
    pairs = [part for column, group in wanted.items() for part in (F.lit(column), F.lit(group))]
    whole = F.regexp_replace("text", "[ ,]", "").try_cast("long")
    return (
        long.groupBy("country", "gender", F.try_element_at(F.create_map(*pairs), F.col("column")).alias("age_group"))
        .agg(F.coalesce(F.sum(whole), F.lit(0)).alias("population"))
        .select("country", "gender", "age_group", "population")
    )


def both_sexes(male: DataFrame, female: DataFrame, country: str) -> DataFrame:
    """Age rows of both tables for the countries that both have. Each table is read once; the rows that are
    compared are one per country, gender and age group."""
    both = [_age_rows(table, country, label, fixed.AGE_COLUMNS) for table, label in ((male, "Male"), (female, "Female"))]
    found = _age_groups(both[0].unionByName(both[1], allowMissingColumns=True), fixed.AGE_COLUMNS)
    in_country = Window.partitionBy("country")
    sexes = F.max(F.col("gender") == "Male").over(in_country) & F.max(F.col("gender") == "Female").over(in_country)
    return found.where("country IS NOT NULL").withColumn("_both", sexes).where("_both AND population > 0").drop("_both")


def age_gender_benchmark(male: DataFrame, female: DataFrame, country: str, kind: str) -> DataFrame:
    men, women = real_countries(male, country, kind=kind), real_countries(female, country, kind=kind)
    return to_shares(both_sexes(men, women, country))


def religion_benchmark(
    raw: DataFrame,
    country: str,
    population: str,
    iso: str,
    groups: Mapping[str, Sequence[str]] = fixed.RELIGION_COLUMNS,
) -> DataFrame:
    """Country population times religion percentages; ``<0.1`` counts as 0.05 percent."""
    frame = real_countries(raw, country, iso=iso, aggregates=fixed.RELIGION_AGGREGATES)
    people = bounded_count(_quoted(population))
    named = [
        sum((percent_text(_quoted(c)) for c in columns), F.lit(0.0)).alias(group) for group, columns in groups.items()
    ]
    wide = frame.select(_quoted(country).alias("country"), people.alias("_people"), *named).where("_people IS NOT NULL")
    long = wide.unpivot(["country", "_people"], [_quoted(g) for g in groups], "religion", "percent")
    counted = long.where("percent > 0").withColumn("population", F.col("_people") * (F.col("percent") / 100))
    return to_shares(counted.select("country", "religion", "population"))


def setting_benchmark(
    raw: DataFrame, country: str, iso: str, columns: Mapping[str, str] = fixed.SETTING_COLUMNS
) -> DataFrame:
    """Urban and rural thousands per country; both numbers must be readable."""
    frame = real_countries(raw, country, iso=iso, aggregates=fixed.SETTING_AGGREGATES, words=fixed.AGGREGATE_WORDS)
    named = [(plain_number(_quoted(column)) * 1000).alias(name) for name, column in columns.items()]
    wide = frame.select(_quoted(country).alias("country"), *named).na.drop(subset=list(columns))
    long = wide.unpivot(["country"], [_quoted(n) for n in columns], "environment", "population")
    return to_shares(long.where("population > 0"))


def regional_benchmark(base: DataFrame, dims: Sequence[Dimension]) -> DataFrame:
    """Roll a country benchmark with ``region``/``continent`` columns up; unmapped countries leave,
    so the shares may add up to less than 1."""
    return roll_up_shares(base, dims)


def slug(name: Column) -> Column:
    """File name part for a dimension name."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), " × ", "_"), " ", "_")
