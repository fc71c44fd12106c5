"""Data-quality jobs. Every check yields rows ``source, check, column, value, severity``; no rows
means nothing was found."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalens.functions.expressions import ratio
from stratalens.functions.fixed import CORE_COLUMNS
from stratalens.operators.ordering import first_rows
from stratalens.operators.strata import Dimension, key_columns

# Characters expected in category texts, plausible ages, and percentages at which
# missing values or duplicates are reported.
USUAL_TEXT = r"^[a-zA-Z0-9\s\-_.,()]+$"
AGE_RANGE = (0, 120)
MISSING_ERROR, MISSING_WARNING, DUPLICATE_ERROR = 50.0, 20.0, 10.0
# Tolerance of a share sum, largest unsuspicious share, plausible numbers of strata.
SUM_TOLERANCE, LARGE_SHARE, FEWEST_STRATA, MOST_STRATA = 0.01, 0.5, 2, 10_000
# Least overlap in percent, largest region, least part of the dimensions covered.
LEAST_OVERLAP, LARGEST_REGION, LEAST_COVERED = 10.0, 100, 0.8

ISSUE_SCHEMA = "source string, check string, column string, value double, severity string"


def _issue(found: Column, check: str, column: str | None, value: Column, severity: str = "error", source: str | None = None) -> Column:
    row = F.struct(
        F.lit(source).cast("string").alias("source"),
        F.lit(check).alias("check"),
        F.lit(column).cast("string").alias("column"),
        value.cast("double").alias("value"),
        F.lit(severity).alias("severity"),
    )
    return F.when(found, row)


def _issues(stats: DataFrame, source: Column | str, candidates: Sequence[Column]) -> DataFrame:
    """Candidate findings of an aggregated row as issue rows; a finding may name a source of its own."""
    name = F.lit(source) if isinstance(source, str) else source
    kept = F.array_compact(F.array(*candidates))
    found = stats.select(name.alias("source"), F.explode(kept).alias("i"))
    return found.select(F.coalesce("i.source", "source").alias("source"), "i.check", "i.column", "i.value", "i.severity")


def no_issues(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ISSUE_SCHEMA)


def _absent(spark: SparkSession, source: str, columns: Sequence[str]) -> DataFrame:
    rows = [(source, "missing_column", c, None, "error") for c in columns]
    return spark.createDataFrame(rows, ISSUE_SCHEMA) if rows else no_issues(spark)


def check_survey(survey: DataFrame, required: Sequence[str] = CORE_COLUMNS, source: str = "survey") -> DataFrame:
    """Required columns present, at least one respondent, not more than half of a column missing."""
    present = [c for c in required if c in survey.columns]
    stats = survey.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in present])
    candidates = [_issue(F.col("rows") == 0, "empty", None, F.col("rows"))]
    for c in present:
        pct = ratio(F.col(c) * 100, F.col("rows"))
        candidates.append(_issue(pct > MISSING_ERROR, "missing_values", c, pct))
    found = _issues(stats, source, candidates)
    return found.unionByName(_absent(survey.sparkSession, source, [c for c in required if c not in survey.columns]))


def row_classes(survey: DataFrame, keys: Sequence[str] = ()) -> tuple[DataFrame, list[tuple[str, int, str]]]:
    """Classes of equal rows with their number of ``_copies``, the ``keys`` of their stratum and what is wrong with each of their rows.

    Rows are told apart by 128 bits of hash, combined in the task that reads them; whole rows are never shuffled. Hashes
    skip nulls, so the places of the nulls are hashed too. What is wrong with a row follows from its values, so it is the same
    for a class and travels as bits, 60 in a number; the list says which (finding, column) each bit stands for.
    """
    flags, bits = [], []
    for i, field in enumerate(survey.schema.fields):
        col = F.col(f"`{field.name}`")
        flags.append((("null", i, field.name), col.isNull()))
        if isinstance(field.dataType, T.StringType):
            flags.append((("odd", i, field.name), ~F.rlike(col, F.lit(USUAL_TEXT))))
        if "age" in field.name.lower():
            age = col.cast("string").try_cast("double")
            flags.append((("age", i, field.name), (age < AGE_RANGE[0]) | (age > AGE_RANGE[1])))
    for at in range(0, len(flags), 60):
        ones = [F.when(test, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k, (_, test) in enumerate(flags[at : at + 60])]
        bits.append(reduce(lambda a, b: a.bitwiseOR(b), ones))
    every = [F.array(*[F.col(f"`{c}`").isNull() for c in survey.columns]), *[F.col(f"`{c}`") for c in survey.columns]]
    named = [F.col(f"`{c}`").alias(f"_key_{k}") for k, c in enumerate(keys)]
    classes = survey.groupBy(F.xxhash64(*every).alias("_a"), F.xxhash64(F.lit(1), *every).alias("_b"), *named).agg(
        F.count(F.lit(1)).alias("_copies"), *[F.max(b).alias(f"_bits_{k}") for k, b in enumerate(bits)]
    )
    return classes, [name for name, _ in flags]


def _class_sums(flags: Sequence[tuple[str, int, str]]) -> list[Column]:
    """Rows, rows that repeat an earlier one, and rows with each finding, summed over classes."""
    copies = F.col("_copies")
    sums = [F.sum(copies).alias("rows"), F.sum(copies - 1).alias("extra")]
    for k, (kind, i, _) in enumerate(flags):
        here = F.col(f"_bits_{k // 60}").bitwiseAND(F.lit(1 << k % 60).cast("long")) != 0
        sums.append(F.sum(F.when(here, copies).otherwise(0)).alias(f"{kind}_{i}"))
    return sums


def _survey_candidates(flags: Sequence[tuple[str, int, str]]) -> list[Column]:
    rows = F.coalesce("rows", F.lit(0))
    candidates = [_issue(rows == 0, "empty", None, rows)]
    for kind, i, c in flags:
        n = F.col(f"{kind}_{i}")
        if kind == "null":
            pct = ratio(n * 100, rows)
            candidates.append(_issue((rows > 0) & (n == rows), "all_null", c, n))
            candidates.append(_issue(pct > MISSING_ERROR, "missing_values", c, pct))
            candidates.append(_issue((pct > MISSING_WARNING) & (pct <= MISSING_ERROR), "missing_values", c, pct, "warning"))
        else:
            candidates.append(_issue(n > 0, "unusual_characters" if kind == "odd" else "implausible_age", c, n))
    doubled = ratio(F.col("extra") * 100, rows)
    return [*candidates, _issue(doubled > DUPLICATE_ERROR, "duplicate_rows", None, doubled)]


def check_survey_deep(survey: DataFrame, required: Sequence[str] = (), source: str = "survey") -> DataFrame:
    """All-null columns, unusual characters, implausible ages, missing values and duplicate rows, in one scan."""
    classes, flags = row_classes(survey)
    found = _issues(classes.agg(*_class_sums(flags)), source, _survey_candidates(flags))
    return found.unionByName(_absent(survey.sparkSession, source, [c for c in required if c not in survey.columns]))


def check_benchmark(benchmark: DataFrame, dims: Sequence[Dimension], share: str = "population_share") -> DataFrame:
    """Share sum, negative, missing and very large shares, number of strata, repeated keys."""
    if share not in benchmark.columns:
        return _absent(benchmark.sparkSession, "benchmark", [share])
    q = F.col(share)
    per_key = benchmark.groupBy("dimension", *key_columns(dims)).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.sum(q).alias("_sum"),
        F.count_if(q < 0).alias("_negative"),
        F.count_if(q.isNull()).alias("_null"),
        F.count_if(q > LARGE_SHARE).alias("_large"),
    )
    stats = per_key.groupBy("dimension").agg(
        F.sum("_rows").alias("strata"),
        F.coalesce(F.sum("_sum"), F.lit(0.0)).alias("total"),
        F.sum("_negative").alias("negative"),
        F.sum("_null").alias("null"),
        F.sum("_large").alias("large"),
        F.count_if(F.col("_rows") > 1).alias("repeated"),
    )
    return _issues(
        stats,
        F.col("dimension"),
        [
            _issue(F.abs(F.col("total") - 1.0) > SUM_TOLERANCE, "share_sum", share, F.col("total")),
            _issue(F.col("negative") > 0, "negative_share", share, F.col("negative")),
            _issue(F.col("null") > 0, "null_share", share, F.col("null")),
            _issue(F.col("large") > 0, "large_share", share, F.col("large")),
            _issue(F.col("strata") < FEWEST_STRATA, "few_strata", None, F.col("strata")),
            _issue(F.col("strata") > MOST_STRATA, "many_strata", None, F.col("strata")),
            _issue(F.col("repeated") > 0, "repeated_key", None, F.col("repeated"), "warning"),
        ],
    )


def check_pair(survey: DataFrame, benchmark: DataFrame, dim: Dimension) -> DataFrame:
    """Survey and benchmark checks together, key columns on both sides and enough common strata.

    The survey is scanned once: its classes of equal rows are summed by stratum, the strata meet those of the benchmark,
    and one row of sums holds the survey's findings and the overlap.
    """
    spark = survey.sparkSession
    lost = [(side, c) for side, frame in (("survey", survey), ("benchmark", benchmark)) for c in dim.columns if c not in frame.columns]
    if lost:
        found = check_survey_deep(survey)
    else:
        keys = [f"_key_{k}" for k in range(len(dim.columns))]
        classes, flags = row_classes(survey, dim.columns)
        strata = classes.groupBy(*keys).agg(*_class_sums(flags))
        theirs = benchmark.select(*[F.col(c).alias(k) for c, k in zip(dim.columns, keys)]).na.drop().distinct()
        met = strata.withColumn("_mine", F.lit(1)).join(theirs.withColumn("_theirs", F.lit(1)), keys, "full_outer")
        whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.col("_mine").isNotNull())
        sums = [c for c in strata.columns if c not in keys]
        stats = met.agg(
            *[F.sum(c).alias(c) for c in sums],
            F.count_if(whole).alias("survey_strata"),
            F.count_if(whole & F.col("_theirs").isNotNull()).alias("common_strata"),
        )
        pct = F.coalesce(ratio("common_strata", "survey_strata"), F.lit(0.0)) * 100
        few = _issue((F.col("common_strata") > 0) & (pct < LEAST_OVERLAP), "low_overlap", None, pct, source="pair")
        none = _issue(F.col("common_strata") == 0, "no_overlap", None, pct, source="pair")
        found = _issues(stats, "survey", [*_survey_candidates(flags), none, few])
    if not any(side == "benchmark" for side, _ in lost):
        found = found.unionByName(check_benchmark(benchmark.withColumn("dimension", F.lit(dim.name)), [dim]))
    for side in ("survey", "benchmark"):
        found = found.unionByName(_absent(spark, side, [c for s, c in lost if s == side]))
    return found


def check_mappings(mappings: DataFrame, regions: DataFrame, continents: DataFrame, region_names: DataFrame) -> DataFrame:
    """Raw values mapped twice, empty or oversized regions, regions without a continent."""
    twice = mappings.groupBy("source", "attribute", "raw_value").agg(F.countDistinct("standard_value").alias("n")).where("n > 1")
    sizes = region_names.select("region").distinct().join(
        regions.where("country IS NOT NULL").groupBy("region").agg(F.count(F.lit(1)).alias("n")), "region", "left"
    )
    homeless = region_names.select("region").distinct().join(
        continents.where("continent IS NOT NULL").select("region").distinct(), "region", "left_anti"
    )

    def rows(frame: DataFrame, source: Column, check: str, column: Column, value: Column) -> DataFrame:
        return frame.select(
            source.alias("source"), F.lit(check).alias("check"), column.alias("column"), value.cast("double").alias("value"), F.lit("error").alias("severity")
        )

    return reduce(
        DataFrame.unionByName,
        [
            rows(twice, F.col("source"), "mapped_twice", F.concat_ws(": ", "attribute", "raw_value"), F.col("n")),
            rows(sizes.where("n IS NULL"), F.lit("regions"), "empty_region", F.col("region"), F.lit(0)),
            rows(sizes.where(F.col("n") > LARGEST_REGION), F.lit("regions"), "large_region", F.col("region"), F.col("n")),
            rows(homeless, F.lit("continents"), "region_without_continent", F.col("region"), F.lit(0)),
        ],
    )


def check_requirements(survey: DataFrame, dims: Sequence[Dimension], hierarchies: Mapping[str, DataFrame]) -> DataFrame:
    """Dimensions that need a hierarchy table which is not there, or which lacks keys that the survey has.

    The first column of a hierarchy table is its key; ``value`` is the number of keys it lacks.
    """
    spark = survey.sparkSession
    absent = [(d.name, "missing_requirement", r, None, "error") for d in dims for r in d.requires if r not in hierarchies]
    found = spark.createDataFrame(absent, ISSUE_SCHEMA) if absent else no_issues(spark)
    for name, table in hierarchies.items():
        users = [d.name for d in dims if name in d.requires]
        key = table.columns[0]
        if users and key in survey.columns:
            keys = survey.select(key).where(F.col(key).isNotNull()).distinct()
            lost = keys.join(table.select(key).distinct(), key, "left_anti").agg(F.count(F.lit(1)).alias("n"))
            lost = lost.select("n", F.explode(F.array(*[F.lit(u) for u in users])).alias("user"))
            found = found.unionByName(_issues(lost, F.col("user"), [_issue(F.col("n") > 0, "unmapped_keys", name, F.col("n"))]))
    return found


def check_completed(benchmark: DataFrame, dims: Sequence[Dimension]) -> DataFrame:
    """Configured dimensions that have a benchmark, and whether at least 80 % do."""
    wanted = benchmark.sparkSession.range(1).select(F.explode(F.array(*[F.lit(d.name) for d in dims])).alias("dimension"))
    have = benchmark.select("dimension").distinct().withColumn("_have", F.lit(1))
    part = ratio(F.count("_have"), F.count(F.lit(1)))
    return wanted.join(have, "dimension", "left").agg(
        F.count(F.lit(1)).alias("configured"), F.count("_have").alias("completed"), part.alias("coverage"), (part >= LEAST_COVERED).alias("sufficient")
    )


def validation_summary(issues: Sequence[DataFrame]) -> DataFrame:
    """Errors and warnings per source; a source without errors is valid."""
    every = reduce(DataFrame.unionByName, issues)
    return every.groupBy("source").agg(
        F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings")
    ).withColumn("valid", F.col("errors") == 0)


def geographic_coverage(survey: DataFrame, columns: Sequence[str] = ("region", "continent")) -> DataFrame:
    """Percent of respondents with a region and a continent."""
    return survey.agg(
        F.count(F.lit(1)).alias("respondents"),
        *[(F.avg(F.col(c).isNotNull().cast("double")) * 100).alias(f"{c}_pct") for c in columns],
    )


def value_counts(frame: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Frequency of every value of every column (missing values too), combined in each task first."""
    text = frame.select(*by, *[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
    long = text.unpivot(list(by), [F.col(f"`{c}`") for c in columns], "column", "category")
    return long.groupBy(*by, "column", "category").agg(F.count(F.lit(1)).alias("n"))


def profile(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct values, missing share, completeness and most frequent value per column."""
    missing = F.sum(F.when(F.col("category").isNull(), F.col("n")).otherwise(0))
    best = F.min_by("category", F.when(F.col("category").isNotNull(), F.struct((-F.col("n")).alias("n"), F.col("category"))))
    return counts.groupBy(*by, "column").agg(
        F.sum("n").alias("rows"),
        F.count("category").alias("distinct_values"),
        ratio(missing, F.sum("n")).alias("missing_share"),
        (F.lit(1.0) - ratio(missing, F.sum("n"))).alias("completeness"),
        best.alias("top_value"),
    )


def top_values(counts: DataFrame, count: int, by: Sequence[str] = ()) -> DataFrame:
    known = counts.where("category IS NOT NULL")
    return first_rows(known, [F.desc("n"), F.col("category")], count, [*by, "column"])


def benchmark_profile(benchmark: DataFrame, dims: Sequence[Dimension]) -> DataFrame:
    """Strata, share sum and different values per key column, for every dimension."""
    return benchmark.groupBy("dimension").agg(
        F.count(F.lit(1)).alias("strata"),
        F.sum("population_share").alias("share_sum"),
        *[F.countDistinct(c).alias(f"{c}_values") for c in key_columns(dims)],
    )


def dimension_statistics(survey: DataFrame, dim: Dimension) -> DataFrame:
    """Respondents and, per key column, categories and the part of respondents that have one."""
    counts = value_counts(survey, dim.columns)
    return profile(counts).select(
        F.lit(dim.name).alias("dimension"), "column", F.col("rows").alias("participants"), F.col("distinct_values").alias("categories"),
        F.col("completeness").alias("coverage"),
    )
