"""Whole flows: from raw survey rows and published population tables to scorecards."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.functions.fixed import CORE_COLUMNS, STANDARD_DIMENSIONS
from stratalens.operators import benchmarks, compare, harmonize, quality, reshape, scores, segments
from stratalens.operators.strata import Dimension, cell_counts, key_columns, line_up, roll_up_shares, route_benchmarks, sample_sizes
from stratalens.session import materialize

SCORES = ("match_score", "coverage_score", "strategic_score", "weighted_score")


@dataclass
class Hierarchy:
    """``country, region`` and ``region, continent``."""

    regions: DataFrame
    continents: DataFrame | None = None

    def tables(self) -> list[str]:
        return ["country_to_region"] + (["country_to_continent"] if self.continents is not None else [])

    def add_to(self, frame: DataFrame) -> DataFrame:
        return harmonize.add_hierarchy(frame, self.regions, self.continents)


def build_benchmarks(
    male: DataFrame,
    female: DataFrame,
    religion: DataFrame,
    setting: DataFrame,
    hierarchy: Hierarchy,
    dims: Sequence[Dimension] = STANDARD_DIMENSIONS,
    area: str = "Region, subregion, country or area *",
    kind: str = "Type",
    religion_country: str = "COUNTRY",
    religion_people: str = "2010 COUNTRY POPULATION",
    setting_country: str = "Region, subregion, country or area",
    iso: str = "ISO3_Code",
) -> DataFrame:
    """Long benchmark of all dimensions out of the four published tables.

    Every dimension is rolled up from the base table it belongs to; countries without a region
    leave the regional dimensions only.
    """
    bases = {
        "age_gender": benchmarks.age_gender_benchmark(male, female, area, kind),
        "religion": benchmarks.religion_benchmark(religion, religion_country, religion_people, iso),
        "environment": benchmarks.setting_benchmark(setting, setting_country, iso),
    }
    return route_benchmarks({name: hierarchy.add_to(base) for name, base in bases.items()}, dims)


def prepare_survey(
    raw: DataFrame,
    mappings: DataFrame,
    source: str,
    hierarchy: Hierarchy | None = None,
    strict: bool = False,
    columns: Sequence[str] = ("age_group", "gender", "religion", "environment", "country"),
    core: Sequence[str] = CORE_COLUMNS,
) -> DataFrame:
    """Standard labels, hierarchy, and only respondents whose core columns are known."""
    mapper = harmonize.map_strict if strict else harmonize.map_lenient
    frame = mapper(raw, mappings, source, columns)
    if hierarchy is not None:
        frame = hierarchy.add_to(frame)
    return harmonize.drop_incomplete(frame, [c for c in core if c in frame.columns])


def full_scorecard(
    survey: DataFrame,
    benchmark: DataFrame,
    dims: Sequence[Dimension] = STANDARD_DIMENSIONS,
    by: Sequence[str] = (),
    variance: DataFrame | None = None,
    maxima: DataFrame | None = None,
    simplify: str = "none",
    listed: DataFrame | None = None,
    overall: bool = True,
) -> DataFrame:
    """All four scores per dimension (and per survey, with ``by``), in percent of the attainable
    score when ``maxima`` is given, with the row of averages.

    ``simplify="auto"`` folds small strata of crowded benchmarks first, for each survey by its own sample
    size. ``simplify="listed"`` keeps the countries of ``listed`` in
    the country dimension and folds the others. Dimensions whose columns the survey lacks get an error text.
    """
    able = [d for d in dims if all(c in survey.columns for c in d.columns)]
    if not able:
        raise ValueError(f"the survey has the columns of none of {[d.name for d in dims]}")
    cells = materialize(cell_counts(survey, key_columns(able), by))
    shares = benchmark.where(F.col("dimension").isin([d.name for d in able]))
    if simplify == "auto":
        shares = reshape.auto_simplify(shares, able, sample_sizes(cells, able, by), by)
    elif simplify == "listed":
        if listed is None:
            raise ValueError("name the countries to keep")
        shares = reshape.keep_listed_countries(shares, able, listed)
    elif simplify != "none":
        raise ValueError("simplify is 'none', 'auto' or 'listed'")
    card = scores.scorecard(cells, shares, able, by, variance)
    if maxima is not None:
        sizes = sample_sizes(cells, able[:1], by).select(*by, "sample_size")
        # As json, a missing group name differs from every name.
        named = F.to_json(F.struct(*by)) if by else F.lit("survey")
        reach = scores.attainable(sizes.select(named.alias("survey"), "sample_size"), maxima).drop("size_used")
        card = card.withColumn("survey", named)
        card = scores.with_percent_of_max(card, reach, ["survey"]).drop("survey")
    if overall:
        extra = ["max_match", "max_coverage", "match_pct_of_max", "coverage_pct_of_max"] if maxima is not None else []
        card = scores.with_overall(card, [*SCORES, *extra], by, largest=["sample_size"])
    return scores.unavailable(dims, survey.columns, scores.describe(card, dims))


@dataclass
class Analysis:
    """The tables an analyst looks at, all from one materialized alignment."""

    scores: DataFrame
    deviations: DataFrame
    contributors: DataFrame
    impact: DataFrame
    alignment: DataFrame
    issues: DataFrame


def analyse(survey: DataFrame, benchmark: DataFrame, dims: Sequence[Dimension], top: int = 10) -> Analysis:
    """Scores, gaps, contributors, impact, category alignment and data issues of one survey."""
    aligned = materialize(line_up(cell_counts(survey, key_columns(dims)), benchmark, dims, targets=True, keyed=True))
    card = scores.all_scores(scores.with_weights(aligned, dims))
    gaps = segments.deviations(aligned)
    leading = segments.top_contributors(gaps, dims, top)
    found = quality.check_survey(survey, key_columns(dims)).unionByName(quality.check_benchmark(benchmark, dims))
    return Analysis(card, gaps, leading, segments.fix_summary(leading, card), compare.alignment_report(survey, benchmark, dims), found)


def coarser(benchmark: DataFrame, dims: Sequence[Dimension], hierarchy: Hierarchy) -> DataFrame:
    """Regional dimensions out of a country benchmark."""
    return roll_up_shares(hierarchy.add_to(benchmark), dims)
