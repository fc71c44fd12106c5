"""Column expressions shared by the operators. Everything stays inside generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABEL_SEPARATOR = " × "


def ratio(top: Column | str, bottom: Column | str) -> Column:
    """Division that gives null instead of failing on zero."""
    top = F.col(top) if isinstance(top, str) else top
    bottom = F.col(bottom) if isinstance(bottom, str) else bottom
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def stratum_label(columns: Sequence[str], separator: str = LABEL_SEPARATOR) -> Column:
    """One readable name per stratum; null parts are left out."""
    return F.concat_ws(separator, *[F.col(c).cast("string") for c in columns])


def tagged_label(columns: Sequence[str], separator: str = LABEL_SEPARATOR) -> Column:
    """``column:value`` pairs joined into one name."""
    return F.concat_ws(separator, *[F.concat(F.lit(f"{c}:"), F.col(c).cast("string")) for c in columns])


def standard_error(share: Column, count: Column, unsampled: float) -> Column:
    """Standard error of a share; ``unsampled`` stands in where nobody was sampled."""
    return F.when(count > 0, F.sqrt(share * (F.lit(1.0) - share) / count)).otherwise(F.lit(float(unsampled)))


def banded(value: Column, cuts: Sequence[tuple[float, str]], lowest: str, strict: bool = False) -> Column:
    """Name the first cut that ``value`` reaches (or exceeds, when ``strict``)."""
    chain = None
    for cut, name in cuts:
        test = value > cut if strict else value >= cut
        chain = F.when(test, name) if chain is None else chain.when(test, name)
    return chain.otherwise(F.lit(lowest))


def plain_number(text: Column) -> Column:
    """Number out of text with blanks and thousands commas; null when it is none."""
    return F.regexp_replace(text, "[ ,]", "").try_cast("double")


def bounded_count(text: Column) -> Column:
    """Population text such as ``31,410,000`` or ``<10,000``; the bound itself is used."""
    return F.regexp_replace(text, "[<, ]", "").try_cast("long")


def percent_text(text: Column, below: float = 0.05) -> Column:
    """Percent text; anything written as *less than* counts as ``below``, bad text as zero."""
    return F.when(F.contains(text, F.lit("<")), F.lit(below)).otherwise(
        F.coalesce(F.trim(text).try_cast("double"), F.lit(0.0))
    )


def age_band(age: Column) -> Column:
    """Seven age groups; negative or missing ages have none."""
    # First age of the next band, name of this band.
    bands = [(18, "Under 18"), (26, "18-25"), (36, "26-35"), (46, "36-45"), (56, "46-55"), (66, "56-65")]
    chain = F.when(age.isNull() | (age < 0), F.lit(None).cast("string"))
    for upper, name in bands:
        chain = chain.when(age < upper, name)
    return chain.otherwise("66+")


def town_setting(size_code: Column) -> Column:
    """Rural up to town size 3, urban up to 8, otherwise unknown."""
    return F.when(size_code <= 3, "Rural").when(size_code <= 8, "Urban")


def clean_text(text: Column) -> Column:
    """Strip quotes, then blanks; empty text and ``nan`` become null."""
    stripped = F.trim(F.regexp_replace(text, '^"+|"+$', ""))
    return F.when((stripped == "") | (stripped == "nan"), None).otherwise(stripped)


def inline_table(spark: SparkSession, rows: Sequence[tuple], columns: Sequence[str]) -> DataFrame:
    """A small parameter table inside the plan; its size is known to the optimizer."""
    structs = [F.struct(*[F.lit(v).alias(c) for v, c in zip(row, columns)]) for row in rows]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs)))


def rounded(frame: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, leaving the others alone."""
    return frame.select(
        *[
            F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
            for f in frame.schema.fields
        ]
    )
