"""Making fine benchmarks coarser: small strata are summed into one *Others* row per dimension.

Only the benchmark is reshaped. Respondents of a summed stratum therefore count as strata the
benchmark does not know, unless ``relabel_survey`` is applied to the survey as well.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.operators.ordering import first_rows, running_totals
from stratalens.operators.strata import Dimension, dimension_label, key_columns, same_keys

# More strata than this in a dimension with that column call for simplification.
CROWDED = {"country": 50, "region": 50, "language": 20, "occupation": 20}
# Any dimension with more strata than this, and the smallest threshold used.
CROWDED_ANYWHERE = 100
SMALLEST_THRESHOLD = 0.001
# Name of the summed row, by the first of these columns in the dimension.
OTHERS_BY_COLUMN = {"country": "Other Countries", "region": "Other Regions", "religion": "Other Religions"}
OTHERS = "Others"


def others_labels(dims: Sequence[Dimension]) -> dict[str, str]:
    """Name of the summed row per dimension."""
    return {d.name: next((name for c, name in OTHERS_BY_COLUMN.items() if c in d.columns), OTHERS) for d in dims}


def _by_share() -> list[Column]:
    return [F.desc(F.round("population_share", 15)), F.col("_label")]


def fold(
    marked: DataFrame, dims: Sequence[Dimension], label: str | Mapping[str, str] = OTHERS, by: Sequence[str] = ()
) -> DataFrame:
    """Keep rows with ``keep`` true, sum the others into one row (per group), added only when it is above zero."""
    keys = key_columns(dims)
    kept = marked.where("keep").select(*by, "dimension", *keys, "population_share")
    rest = marked.where("NOT keep").groupBy(*by, "dimension").agg(F.sum("population_share").alias("population_share"))
    filled = []
    for key in keys:
        value = F.lit(None).cast("string")
        for d in dims:
            if key in d.columns:
                name = label if isinstance(label, str) else label[d.name]
                value = F.when(F.col("dimension") == d.name, name).otherwise(value)
        filled.append(value.alias(key))
    return kept.unionByName(rest.where("population_share > 0").select(*by, "dimension", *filled, "population_share"))


def mark(
    benchmark: DataFrame,
    dims: Sequence[Dimension],
    threshold: float | None = None,
    top: int | None = None,
    coverage: float = 0.8,
) -> DataFrame:
    """Add ``keep``: the ``top`` rows, else shares of at least ``threshold``, else the shortest
    run of largest shares whose sum reaches ``coverage``."""
    named = benchmark.withColumn("_label", dimension_label(dims))
    if top is not None:
        # The last row kept, one per dimension, is enough to tell kept rows from the rest.
        last = first_rows(named, _by_share(), top, ["dimension"], "_rank")
        place = F.struct((-F.round("population_share", 15)).alias("s"), F.col("_label").alias("l"))
        border = last.groupBy("dimension").agg(F.max(place).alias("_border"))
        return named.join(F.broadcast(border), "dimension").withColumn("keep", place <= F.col("_border")).drop("_border", "_label")
    if threshold is not None:
        return named.withColumn("keep", F.col("population_share") >= threshold).drop("_label")
    summed = running_totals(named, _by_share(), "population_share", ["dimension"])
    before = F.round(F.col("running") - F.col("population_share"), 12)
    return summed.withColumn("keep", (F.col("rank") == 1) | (before < coverage)).drop("rank", "running", "_label")


def simplify(
    benchmark: DataFrame,
    dims: Sequence[Dimension],
    threshold: float | None = None,
    top: int | None = None,
    coverage: float = 0.8,
    label: str | Mapping[str, str] = OTHERS,
) -> DataFrame:
    """Simplified benchmark; a given ``top`` wins over ``threshold``, which wins over ``coverage``."""
    return fold(mark(benchmark, dims, threshold, top, coverage), dims, label)


def simplify_countries(benchmark: DataFrame, dim: Dimension, top: int = 30) -> DataFrame:
    return simplify(benchmark, [dim], top=top, label="Other Countries")


def simplify_religions(benchmark: DataFrame, dim: Dimension, threshold: float = 0.01) -> DataFrame:
    return simplify(benchmark, [dim], threshold=threshold, label="Other Religions")


def simplify_occupations(benchmark: DataFrame, dim: Dimension, coverage: float = 0.9) -> DataFrame:
    return simplify(benchmark, [dim], coverage=coverage, label="Other Occupations")


def auto_simplify(benchmark: DataFrame, dims: Sequence[Dimension], sizes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Fold strata that expect less than one respondent, in crowded dimensions only.

    ``sizes`` has ``dimension, sample_size`` and the group columns ``by``; every group gets a
    benchmark of its own. The threshold is max(1 / sample size, 0.001).
    """
    strata = benchmark.groupBy("dimension").agg(F.count(F.lit(1)).alias("_strata"))
    limit = F.lit(CROWDED_ANYWHERE)
    for d in dims:
        limits = [CROWDED[c] for c in d.columns if c in CROWDED]
        if limits:
            limit = F.when(F.col("dimension") == d.name, F.lit(min([*limits, CROWDED_ANYWHERE]))).otherwise(limit)
    bars = strata.join(sizes.select(*by, "dimension", "sample_size"), "dimension").select(
        *by,
        "dimension",
        (F.col("_strata") > limit).alias("_crowded"),
        F.greatest(F.try_divide(F.lit(1.0), F.col("sample_size")), F.lit(SMALLEST_THRESHOLD)).alias("_bar"),
    )
    marked = benchmark.join(bars if by else F.broadcast(bars), "dimension")  # one row per dimension and group
    marked = marked.withColumn("keep", ~F.col("_crowded") | (F.col("population_share") >= F.col("_bar")))
    return fold(marked, dims, others_labels(dims), by)


def adaptive_simplify(aligned: DataFrame, dims: Sequence[Dimension], target: float = 0.95) -> DataFrame:
    """Keep every sampled stratum, then unsampled ones until their sum reaches ``target``."""
    known = aligned.where("in_benchmark").withColumn("_label", dimension_label(dims))
    known = known.withColumn("_sampled", F.col("n") > 0)
    summed = running_totals(known, [F.desc("_sampled"), *_by_share()], "population_share", ["dimension"])
    here = F.round("running", 12)
    before = F.round(F.col("running") - F.col("population_share"), 12)
    keep = F.col("_sampled") | (here <= target) | ((F.col("rank") > 1) & (before < target))
    return fold(summed.withColumn("keep", keep), dims, OTHERS)


def keep_listed(benchmark: DataFrame, dim: Dimension, listed: DataFrame, label: str = "Others") -> DataFrame:
    """Keep the strata named in ``listed`` (same key columns); the row for the rest is 1 - their sum."""
    kept = benchmark.join(listed.select(*dim.columns).distinct(), list(dim.columns), "left_semi")
    kept = kept.where(F.col("dimension") == dim.name).select("dimension", *dim.columns, "population_share")
    rest = kept.groupBy("dimension").agg((F.lit(1.0) - F.sum("population_share")).alias("population_share"))
    rest = rest.where(F.round("population_share", 12) > 0)
    return kept.unionByName(rest.select("dimension", *[F.lit(label).alias(c) for c in dim.columns], "population_share"))


def keep_listed_countries(benchmark: DataFrame, dims: Sequence[Dimension], listed: DataFrame) -> DataFrame:
    """The benchmark with only the listed countries in its country dimension and one row for the others."""
    for d in (d for d in dims if d.columns == ("country",)):
        kept = keep_listed(benchmark, d, listed, OTHERS_BY_COLUMN["country"])
        benchmark = benchmark.where(F.col("dimension") != d.name).unionByName(kept, allowMissingColumns=True)
    return benchmark


def relabel_survey(survey: DataFrame, simplified: DataFrame, dim: Dimension, label: str) -> DataFrame:
    """Give respondents (or cells) outside the kept strata the name of the summed row."""
    kept = simplified.where(F.col("dimension") == dim.name).select(*dim.columns).distinct()
    kept = kept.where(reduce(lambda a, b: a | b, [F.col(c) != label for c in dim.columns]))
    kept = kept.withColumn("_kept", F.lit(True))
    whole = reduce(lambda a, b: a & b, [F.col(f"s.{c}").isNotNull() for c in dim.columns])
    joined = survey.alias("s").join(kept.alias("k"), same_keys("s", "k", dim.columns), "left")
    shown = [
        F.when(whole & F.col("k._kept").isNull(), label).otherwise(F.col(f"s.{c}")).alias(c) if c in dim.columns else F.col(f"s.{c}")
        for c in survey.columns
    ]
    return joined.select(*shown)


def simplification_impact(original: DataFrame, simplified: DataFrame, dims: Sequence[Dimension]) -> DataFrame:
    """Strata before and after, reduction, share of the summed rows and what is still covered."""
    first = F.lit(None).cast("string")
    for d in dims:
        first = F.when(F.col("dimension") == d.name, F.col(d.columns[0])).otherwise(first)
    after = simplified.groupBy("dimension").agg(
        F.count(F.lit(1)).alias("simplified_strata"),
        F.coalesce(
            F.sum(F.when(F.contains(F.lower(first), F.lit("other")), F.col("population_share"))), F.lit(0.0)
        ).alias("others_share"),
    )
    before = original.groupBy("dimension").agg(F.count(F.lit(1)).alias("original_strata"))
    gone = F.col("original_strata") - F.col("simplified_strata")
    return before.join(after, "dimension").select(
        "dimension",
        "original_strata",
        "simplified_strata",
        F.try_divide(gone.cast("double"), F.col("original_strata").cast("double")).alias("reduction_ratio"),
        "others_share",
        (gone + F.when(F.col("others_share") > 0, 1).otherwise(0)).cast("long").alias("others_strata"),
        (F.lit(1.0) - F.col("others_share")).alias("kept_coverage"),
    )
