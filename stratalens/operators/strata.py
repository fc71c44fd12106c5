"""Counting people per stratum and lining the counts up with population shares.

All dimensions travel together in one *long* table: a ``dimension`` column names the row's
dimension, the key columns outside that dimension are null. Respondents are aggregated once to
cells (all key columns together); every dimension is then a grouping set over the cells.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.functions.expressions import ratio, stratum_label


MOST_BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class Dimension:
    """A named list of key columns; ``requires`` names the hierarchy tables it depends on."""

    name: str
    columns: tuple[str, ...]
    requires: tuple[str, ...] = ()
    description: str = ""
    base: str | None = field(default=None)

    def __post_init__(self) -> None:
        object.__setattr__(self, "columns", tuple(self.columns))


def key_columns(dims: Sequence[Dimension]) -> list[str]:
    """Every key column used by ``dims``, in order of first use."""
    return list(dict.fromkeys(c for d in dims for c in d.columns))


def dimension_label(dims: Sequence[Dimension]) -> Column:
    """Stratum name in the column order of the row's own dimension."""
    chain = None
    for d in dims:
        test = F.col("dimension") == d.name
        chain = F.when(test, stratum_label(d.columns)) if chain is None else chain.when(test, stratum_label(d.columns))
    return chain


def same_keys(left: str, right: str, columns: Sequence[str]) -> Column:
    """Null-safe equality of two aliased frames on ``columns``; still a hash/sort join key for Spark."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


def join_groups(left: DataFrame, right: DataFrame, columns: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right``, joined on ``columns``; nulls match nulls, since a
    group without a name is a group."""
    joined = left.alias("_l").join(right.alias("_r"), same_keys("_l", "_r", columns), how)
    others = [c for c in right.columns if c not in columns]
    return joined.select(*[F.col(f"_l.`{c}`") for c in left.columns], *[F.col(f"_r.`{c}`") for c in others])


def look_up_variance(strata: DataFrame, variance: DataFrame, name: str) -> DataFrame:
    """Add the variance of each stratum as ``name``; null where the lookup has none.

    The lookup has ``dimension, variance`` and names strata by their key columns (all that ``strata`` has of them, null outside the
    dimension), which tells any two strata apart. A lookup that only knows readable names has ``stratum`` instead; two strata
    whose values run together to one name share its variance then. Columns that name the survey
    are join keys where ``strata`` has them too. Two variances for one stratum are
    an error when the rows are read, not two strata.
    """
    keys = [c for c in variance.columns if c != "variance" and c in strata.columns]
    if "dimension" not in keys or len(keys) < 2:
        raise ValueError(f"a variance lookup needs dimension and the strata's keys or names, found {variance.columns}")
    where = F.concat_ws(" / ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    twice = F.raise_error(F.concat(F.lit("more than one variance for "), where)).cast("double")
    known = variance.groupBy(*keys).agg(F.count(F.lit(1)).alias("_times"), F.max("variance").alias("_one"))
    known = known.select(*keys, F.when(F.col("_times") > 1, twice).otherwise(F.col("_one")).alias(name))
    return join_groups(strata, known, keys, "left")


def few(frame: DataFrame, rows: int, by: Sequence[str] = ()) -> DataFrame:
    """Broadcast a table whose number of rows is known from parameters (dimensions, sizes,
    replicates). With groups of unknown number, or too many rows, the optimizer decides."""
    return F.broadcast(frame) if not by and rows <= MOST_BROADCAST_ROWS else frame


def cell_counts(survey: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Respondents per cell. Rows with missing keys keep their own cell, so totals stay whole."""
    return survey.groupBy(*by, *columns).agg(F.count(F.lit(1)).alias("n"))


def stratum_counts(survey: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Respondents per stratum; a stratum needs all of its keys."""
    return cell_counts(survey.na.drop(subset=list(columns)), columns)


def lattice(dims: Sequence[Dimension]) -> dict[str, list[Dimension]]:
    """Which dimensions are summed up from which: the name of each dimension that no other contains, and those read off it (itself
    first). A contained dimension goes to the container with the fewest columns."""
    sets = {d.name: frozenset(d.columns) for d in dims}
    roots = [d for d in dims if not any(sets[d.name] < other for other in sets.values())]
    plan = {d.name: [d] for d in roots}
    for d in dims:
        if d.name not in plan:
            holders = [r for r in roots if sets[d.name] < sets[r.name]]
            plan[min(holders, key=lambda r: len(r.columns)).name].append(d)
    return plan


def roll_up(cells: DataFrame, dims: Sequence[Dimension], value: str = "n", by: Sequence[str] = ()) -> DataFrame:
    """Sum ``value`` for every dimension: grouping sets over the cells for the dimensions that no other contains, and
    the others from the sums of those (see :func:`lattice`), so a cell is expanded for the former only.

    A missing column is an error here, before any job starts. A null in one of a dimension's own
    keys leaves that dimension only: sums keep their nulls until all dimensions are read off; the bit of ``grouping_id`` tells
    a null from a column that is not part of the dimension.
    """
    keys = key_columns(dims)
    missing = [c for c in [*by, *keys] if c not in cells.columns]
    if missing:
        raise ValueError(f"cannot roll up, missing columns: {missing}")
    if len({frozenset(d.columns) for d in dims}) != len(dims):
        raise ValueError("two dimensions share the same columns")
    plan = lattice(dims)
    roots = [d for d in dims if d.name in plan]
    every = [*by, *keys]
    sets = [[*by, *d.columns] for d in roots]
    grouped = cells.groupingSets(sets, *every).agg(F.sum(value).alias(value), F.grouping_id().alias("_set"))
    top = len(every) - 1
    codes = [sum(1 << (top - i) for i, c in enumerate(every) if c not in members) for members in sets]
    named = lambda values: reduce(lambda chain, nv: chain.when(F.col("_set") == F.lit(nv[0]), nv[1]), list(zip(codes, values))[1:], F.when(F.col("_set") == F.lit(codes[0]), values[0]))
    if len(roots) == len(dims):
        long = grouped.select(*by, named([F.lit(d.name) for d in roots]).alias("dimension"), *keys, F.col(value))
    else:
        read_off = named([F.array(*[F.lit(d.name) for d in plan[r.name]]) for r in roots])
        spread = grouped.select(*by, F.explode(read_off).alias("dimension"), *keys, F.col(value))
        member = {c: F.col("dimension").isin([d.name for d in dims if c in d.columns]) for c in keys}
        spread = spread.select(*by, "dimension", *[F.when(member[c], F.col(c)).alias(c) for c in keys], F.col(value))
        long = spread.groupBy(*by, "dimension", *keys).agg(F.sum(value).alias(value))
    whole = [reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in d.columns], F.col("dimension") == d.name) for d in dims]
    return long.where(reduce(lambda a, b: a | b, whole)).select(*by, "dimension", *keys, F.col(value))


def sample_sizes(cells: DataFrame, dims: Sequence[Dimension], by: Sequence[str] = ()) -> DataFrame:
    """All respondents, missing keys included, once per group and dimension."""
    totals = cells.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("sample_size"))
    return totals.select(*by, F.explode(F.array(*[F.lit(d.name) for d in dims])).alias("dimension"), "sample_size")


def population_shares(people: DataFrame, dims: Sequence[Dimension], weight: Column | None = None) -> DataFrame:
    """Long benchmark from population rows (or weighted rows): share of the whole population."""
    keys = key_columns(dims)
    cells = people.groupBy(*keys).agg(F.sum(F.lit(1.0) if weight is None else weight.cast("double")).alias("mass"))
    total = cells.agg(F.sum("mass").alias("mass"))
    long = roll_up(cells, dims, "mass")
    return long.withColumn("population_share", ratio(F.col("mass"), total.scalar())).drop("mass")


def roll_up_shares(benchmark: DataFrame, dims: Sequence[Dimension], share: str = "population_share") -> DataFrame:
    """Coarser dimensions from a finer benchmark: shares are summed, unmapped keys drop out."""
    return roll_up(benchmark, dims, share)


def dimension_name(name: str) -> Column:
    """A dimension's name as a generated column.

    A plain literal would be folded out of later joins on ``dimension`` and leave them without a key.
    """
    return F.explode(F.array(F.lit(name))).alias("dimension")


def as_long(benchmark: DataFrame, dim: Dimension) -> DataFrame:
    """Bring a one-dimension benchmark into the long form."""
    return benchmark.select(dimension_name(dim.name), *dim.columns, "population_share")


def route_benchmarks(bases: dict[str, DataFrame], dims: Sequence[Dimension]) -> DataFrame:
    """Long benchmark for dimensions that come from different base tables (``Dimension.base``)."""
    keys = key_columns(dims)
    parts = []
    for base, frame in bases.items():
        served = [d for d in dims if d.base == base]
        if served:
            part = roll_up_shares(frame, served)
            for c in keys:
                if c not in part.columns:
                    part = part.withColumn(c, F.lit(None).cast("string"))
            parts.append(part.select("dimension", *keys, "population_share"))
    lost = [d.name for d in dims if d.base not in bases]
    if lost:
        raise ValueError(f"no base benchmark for {lost}")
    return reduce(DataFrame.unionByName, parts)


def line_up(
    cells: DataFrame,
    benchmark: DataFrame,
    dims: Sequence[Dimension],
    by: Sequence[str] = (),
    threshold: float | None = None,
    targets: bool = False,
    keyed: bool = False,
) -> DataFrame:
    """Full outer join of sample and population per stratum, for all dimensions and groups at once.

    Both sides are aggregated first, so what is joined are strata, never respondents; all branches
    start from the same exchange of cells, so respondents are read once. Columns: ``n``,
    ``sample_share`` (count / all respondents), ``population_share``, ``relevant`` (population
    share above ``threshold``, by default above 1 / sample size), ``in_benchmark``,
    ``sample_size``; with ``targets`` the square-root ``target_share``; with ``keyed`` the
    ``keyed_share`` (count / respondents that have every key of the dimension). A benchmark that has
    group columns of its own is the benchmark of those groups.
    """
    keys = key_columns(dims)
    group = [*by, "dimension"]
    own = [*(c for c in by if c in benchmark.columns), "dimension"]
    counts = roll_up(cells, dims, "n", by)
    expected = benchmark.select(*own, *keys, "population_share")
    if by:
        # Every group is measured against its whole benchmark. The filter is always true; it keeps
        # the size needed on this side, so that both sides share one exchange of cells. The join
        # is null-safe: a group without a name is a group.
        sizes = sample_sizes(cells, dims, by).where("sample_size > 0")
        expected = join_groups(expected, sizes, own).select(*group, *keys, "population_share", "sample_size")
        counts = counts.alias("k").join(sizes.alias("z"), same_keys("k", "z", group)).select("k.*", "z.sample_size")
    else:
        size = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("sample_size")).scalar()
        expected, counts = expected.withColumn("sample_size", size), counts.withColumn("sample_size", size)
    counts = counts.withColumn("sample_share", ratio("n", "sample_size"))
    if keyed:
        whole = few(roll_up(cells, dims, "n", by).groupBy(*group).agg(F.sum("n").alias("keyed_size")), len(dims), by)
        counts = counts.alias("k").join(whole.alias("z"), same_keys("k", "z", group))
        counts = counts.select("k.*", ratio("n", "keyed_size").alias("keyed_share"))

    bar = F.lit(float(threshold)) if threshold is not None else ratio(F.lit(1.0), F.col("sample_size"))
    expected = expected.withColumn("relevant", F.coalesce(F.col("population_share") > bar, F.lit(False)))
    if targets:
        roots = benchmark.groupBy(*own).agg(F.sum(F.sqrt("population_share")).alias("root_sum"))
        expected = join_groups(expected, few(roots, len(dims), own[:-1]), own, "left")
        expected = expected.withColumn("target_share", ratio(F.sqrt("population_share"), F.col("root_sum")))

    on = [*group, *keys]
    joined = expected.alias("e").join(counts.alias("c"), same_keys("e", "c", on), "full_outer")
    out = [F.coalesce(f"e.{c}", f"c.{c}").alias(c) for c in on]
    out += [
        F.coalesce("c.n", F.lit(0)).cast("long").alias("n"),
        F.coalesce("c.sample_share", F.lit(0.0)).alias("sample_share"),
        F.coalesce("e.population_share", F.lit(0.0)).alias("population_share"),
        F.coalesce("e.relevant", F.lit(False)).alias("relevant"),
        F.col("e.population_share").isNotNull().alias("in_benchmark"),
        F.coalesce("e.sample_size", "c.sample_size").alias("sample_size"),
    ]
    if targets:
        out.append(F.coalesce("e.target_share", F.lit(0.0)).alias("target_share"))
    if keyed:
        out.append(F.coalesce("c.keyed_share", F.lit(0.0)).alias("keyed_share"))
    return joined.select(*out)


def benchmark_left(aligned: DataFrame) -> DataFrame:
    """Only strata the benchmark knows; strata seen in the survey alone are left out."""
    return aligned.where("in_benchmark")
