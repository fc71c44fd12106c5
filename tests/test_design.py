"""Reshaping, allocation, attainable scores and replicates."""

import itertools
import math
import random

import pytest
from plan_rows import metric_of
from pyspark.sql import functions as F

from stratalens import Dimension
from stratalens.operators import allocation, ordering, replicates, reshape, scores
from stratalens.operators.strata import as_long, cell_counts, line_up

DIM = Dimension("Country", ("country",))


@pytest.fixture
def long_benchmark(benchmark_of):
    def build(*rows, dim=DIM):
        return as_long(benchmark_of(list(dim.columns), *rows), dim)

    return build


FIVE = (("A", 0.4), ("B", 0.3), ("C", 0.15), ("D", 0.1), ("E", 0.05))


def shares(frame):
    return {r["country"]: round(r["population_share"], 9) for r in frame.collect()}


def test_simplify_by_top_threshold_and_coverage(long_benchmark):
    bench = long_benchmark(*FIVE)
    assert shares(reshape.simplify(bench, [DIM], top=2)) == {"A": 0.4, "B": 0.3, "Others": 0.3}
    assert shares(reshape.simplify(bench, [DIM], threshold=0.1)) == {"A": 0.4, "B": 0.3, "C": 0.15, "D": 0.1, "Others": 0.05}
    # 0.4, 0.7, 0.85: the third row is the first to reach 0.8 and is kept.
    assert shares(reshape.simplify(bench, [DIM], coverage=0.8)) == {"A": 0.4, "B": 0.3, "C": 0.15, "Others": 0.15}


def test_simplify_priority_and_nothing_to_fold(long_benchmark):
    bench = long_benchmark(*FIVE)
    assert shares(reshape.simplify(bench, [DIM], threshold=0.2, top=4, coverage=0.1))["D"] == 0.1
    assert "Others" not in shares(reshape.simplify(bench, [DIM], top=9))
    assert shares(reshape.simplify(bench, [DIM], coverage=0.1)) == {"A": 0.4, "Others": 0.6}


def test_presets_name_their_rest(long_benchmark):
    bench = long_benchmark(*FIVE)
    assert "Other Countries" in shares(reshape.simplify_countries(bench, DIM, 1))
    assert "Other Religions" in shares(reshape.simplify_religions(bench, DIM, 0.2))
    assert "Other Occupations" in shares(reshape.simplify_occupations(bench, DIM))


def test_rest_is_named_in_every_key_column(benchmark_of):
    dim = Dimension("Country × Gender", ("country", "gender"))
    bench = as_long(benchmark_of(["country", "gender"], ("A", "m", 0.7), ("A", "f", 0.2), ("B", "f", 0.1)), dim)
    rest = reshape.simplify(bench, [dim], top=1).where("country = 'Others'").first()
    assert rest["gender"] == "Others" and rest["population_share"] == pytest.approx(0.3)


def test_auto_threshold_only_in_crowded_dimensions(spark, long_benchmark):
    sizes = spark.createDataFrame([("Country", 50)], "dimension string, sample_size long")
    few = long_benchmark(*[(f"c{i}", 1 / 50) for i in range(50)])
    assert reshape.auto_simplify(few, [DIM], sizes).count() == 50
    many = long_benchmark(("big", 0.5), *[(f"c{i}", 0.5 / 60) for i in range(60)])
    assert shares(reshape.auto_simplify(many, [DIM], sizes)) == {"big": 0.5, "Other Countries": 0.5}


def test_auto_threshold_has_a_floor(spark, long_benchmark):
    sizes = spark.createDataFrame([("Country", 10_000_000)], "dimension string, sample_size long")
    many = long_benchmark(("big", 0.94), *[(f"c{i}", 0.001) for i in range(59)], ("tiny", 0.0009), ("dust", 0.0001))
    assert shares(reshape.auto_simplify(many, [DIM], sizes))["Other Countries"] == pytest.approx(0.001)


def test_adaptive_keeps_sampled_strata_and_one_more(survey_of, long_benchmark):
    bench = long_benchmark(*FIVE)
    cells = cell_counts(survey_of(["country"], (1, "D")), ["country"])
    aligned = line_up(cells, bench, [DIM])
    # Sampled D (0.1), then A 0.5, B 0.8, C 0.95, E 1.0.
    assert shares(reshape.adaptive_simplify(aligned, [DIM], 0.8)) == {"D": 0.1, "A": 0.4, "B": 0.3, "Others": 0.2}
    assert shares(reshape.adaptive_simplify(aligned, [DIM], 0.7)) == {"D": 0.1, "A": 0.4, "B": 0.3, "Others": 0.2}
    assert shares(reshape.adaptive_simplify(aligned, [DIM], 1.0)) == {"D": 0.1, "A": 0.4, "B": 0.3, "C": 0.15, "E": 0.05}


def test_listed_strata_leave_the_remainder(spark, long_benchmark):
    listed = spark.createDataFrame([("A",), ("C",), ("Z",)], "country string")
    assert shares(reshape.keep_listed(long_benchmark(*FIVE), DIM, listed)) == {"A": 0.4, "C": 0.15, "Others": 0.45}


def test_relabelled_survey_matches_the_summed_row(survey_of, long_benchmark):
    folded = reshape.simplify(long_benchmark(*FIVE), [DIM], top=1)
    survey = survey_of(["country"], (4, "A"), (3, "B"), (3, "E"), (1, None))
    renamed = reshape.relabel_survey(survey, folded, DIM, "Others")
    got = {r["country"]: r["count"] for r in renamed.groupBy("country").count().collect()}
    assert got == {"A": 4, "Others": 6, None: 1}


def test_impact_of_simplification(long_benchmark):
    bench = long_benchmark(*FIVE)
    row = reshape.simplification_impact(bench, reshape.simplify(bench, [DIM], top=2), [DIM]).first()
    assert (row["original_strata"], row["simplified_strata"], row["others_strata"]) == (5, 3, 3)
    assert row["reduction_ratio"] == pytest.approx(0.4) and row["kept_coverage"] == pytest.approx(0.7)


@pytest.mark.parametrize("size", [1, 7, 100, 1003])
def test_neyman_adds_up(spark, long_benchmark, size):
    variance = spark.createDataFrame([("Country", "A", 0.01), ("Country", "E", 0.2)], "dimension string, stratum string, variance double")
    got = {r["stratum"]: r["optimal_n"] for r in allocation.neyman(long_benchmark(*FIVE), [DIM], [size], variance).collect()}
    assert sum(got.values()) == size
    known = {"A": 0.01, "E": 0.2}
    weights = {c: q * math.sqrt(known.get(c, 0.25)) for c, q in FIVE}
    plain = {c: round(size * w / sum(weights.values())) for c, w in weights.items()}
    off = {c for c in plain if plain[c] != got[c]}
    assert off <= {min(plain, key=lambda c: (-plain[c], c))}


def test_half_even_rounding(long_benchmark):
    targets = scores.target_shares(long_benchmark(("A", 0.5), ("B", 0.5)))
    rows = allocation.proportional_beside_strategic(targets, [DIM], [5]).collect()
    assert {r["proportional_n"] for r in rows} == {2}


def test_efficiency_gain_is_positive_for_unequal_variances(spark, long_benchmark):
    variance = spark.createDataFrame([("Country", "A", 0.01), ("Country", "B", 0.25)], "dimension string, stratum string, variance double")
    planned = allocation.neyman(long_benchmark(*FIVE), [DIM], [1000], variance)
    assert allocation.efficiency_gain(allocation.proportional_beside_optimal(planned)).first()["efficiency_gain"] > 0


def best_by_force(q, size):
    best = -1.0
    for counts in itertools.product(range(size + 1), repeat=len(q) - 1):
        last = size - sum(counts)
        if last >= 0:
            best = max(best, 1 - 0.5 * sum(abs(n / size - s) for n, s in zip((*counts, last), q)))
    return best


@pytest.mark.parametrize("seed", range(4))
def test_best_allocation_against_all_allocations(long_benchmark, seed):
    rng = random.Random(seed)
    raw = [rng.random() for _ in range(4)]
    q = [v / sum(raw) for v in raw]
    size = rng.randint(3, 12)
    bench = long_benchmark(*[(f"c{i}", v) for i, v in enumerate(q)])
    counts = replicates.best_allocation(bench, [DIM], [size])
    assert counts.agg(F.sum("n")).first()[0] == size
    assert replicates.max_scores(counts).first()["max_match"] == pytest.approx(best_by_force(q, size))


def test_subsample_scores_stay_below_the_maximum(spark, long_benchmark):
    """Scores of real sub-samples, none better than the best allocation of its size."""
    bench = long_benchmark(*[(f"c{i}", 0.02 if i < 40 else 0.05) for i in range(44)])
    survey = spark.range(2000).select(F.col("id").alias("respondent"), F.concat(F.lit("c"), F.col("id") % 44).alias("country"))
    drawn = replicates.subsample_scores(survey, "respondent", bench, [DIM], [15, 60], 12).where("size > 0").collect()
    top = {r["size"]: r["max_match"] for r in replicates.size_curve(bench, [DIM], [15, 60]).collect()}
    assert len(drawn) == 24 and all(r["sample_size"] == r["size"] and r["match_score"] <= top[r["size"]] + 1e-9 for r in drawn)


def test_statistics_interpolate(spark):
    frame = spark.createDataFrame([("d", float(v)) for v in (1, 2, 3, 10)], "dimension string, v double")
    row = replicates.replicate_statistics(frame, ["dimension"], "v").first()
    assert (row["q25"], row["median"], row["q75"], row["mean"]) == (1.75, 2.5, 4.75, 4.0)


def test_subsamples_are_whole_and_without_replacement(spark):
    survey = spark.range(5000).select(F.col("id").alias("respondent"), F.concat(F.lit("c"), F.col("id") % 7).alias("country"))
    drawn = replicates.subsamples(survey, "respondent", ["country"], [50, 200], 3)
    sizes = {(r["size"], r["replicate"]): (r["n"], r["d"]) for r in drawn.groupBy("size", "replicate").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("respondent").alias("d")).collect()}
    assert sizes == {(s, k): (s, s) for s in (50, 200) for k in range(3)}
    # The smaller sample of a replicate is part of its larger one, and replicates differ.
    first = {r["respondent"] for r in drawn.where("size = 200 AND replicate = 0").collect()}
    assert {r["respondent"] for r in drawn.where("size = 50 AND replicate = 0").collect()} <= first
    assert {r["respondent"] for r in drawn.where("size = 200 AND replicate = 1").collect()} != first


def test_subsamples_pick_the_smallest_hashes(spark):
    import hashlib

    survey = spark.range(900).select(F.col("id").alias("respondent"), F.lit("x").alias("country"))
    ranked = sorted(range(900), key=lambda i: (hashlib.md5(f"{i}|0".encode()).hexdigest(), i))
    drawn = replicates.subsamples(survey, "respondent", ["country"], [1, 30, 899, 900, 5000], 1).collect()
    for size in (1, 30, 899, 900, 5000):
        assert {r["respondent"] for r in drawn if r["size"] == size} == set(ranked[:size])
    assert len(drawn) == 1 + 30 + 899 + 900 + 900


def test_subsamples_shuffle_little_more_than_they_keep(spark):
    """Two replicates of 2000 out of 60,000 respondents: what moves is near 4000 rows, not 120,000."""
    survey = spark.range(60_000).select(F.col("id").alias("respondent"), (F.col("id") % 9).alias("country"))
    drawn = replicates.subsamples(survey, "respondent", ["country"], [2000], 2)
    assert sorted((r["size"], r["replicate"]) for r in drawn.collect()) == [(2000, 0)] * 2000 + [(2000, 1)] * 2000
    moved = metric_of(drawn, "ShuffleExchange", "shuffleRecordsWritten")
    buckets = 2 * 769 * 8  # counts by bucket of each of eight tasks at most
    assert 4000 <= sum(moved) <= 4000 * 1.1 + buckets


def test_repeated_respondents_are_drawn_like_others(spark):
    survey = spark.createDataFrame([(1, "x")] * 40 + [(i, "y") for i in range(2, 30)], "respondent int, country string")
    drawn = replicates.subsamples(survey, "respondent", ["country"], [10], 3)
    assert drawn.groupBy("replicate").count().orderBy("replicate").collect() == [(0, 10), (1, 10), (2, 10)]
    assert replicates.subsamples(survey.where("false"), "respondent", ["country"], [10], 3).count() == 0


def test_quantiles_against_plain_interpolation(spark):
    import numpy as np

    rng = random.Random(8)
    rows = [(g, rng.choice([rng.random(), 0.5, -3.0])) for g, n in (("a", 400), ("b", 7), (None, 12), ("one", 1)) for _ in range(n)]
    rows += [("a", None), ("nothing", None)]
    frame = spark.createDataFrame(rows, "g string, v double")
    wanted = {"least": 0.0, "q10": 0.1, "middle": 0.5, "most": 1.0}
    got = {r["g"]: [r[n] for n in wanted] for r in ordering.quantiles(frame, ["g"], "v", wanted).collect()}
    known = {g: [v for h, v in rows if h == g and v is not None] for g in ("a", "b", None, "one")}
    assert set(got) == set(known)
    assert all(got[g] == pytest.approx([float(np.quantile(known[g], p)) for p in wanted.values()]) for g in known)
    whole = ordering.quantiles(frame, [], "v", {"middle": 0.5}).collect()
    assert [r["middle"] for r in whole] == [pytest.approx(float(np.median([v for _, v in rows if v is not None])))]


def test_samples_beyond_the_group_limit(spark):
    """Counts above Spark's own limit are cut in slices, not in one sort of the whole group."""
    from stratalens.operators.ordering import first_rows

    frame = spark.range(6000).select(F.col("id"), (F.col("id") % 2).alias("g"))
    top = first_rows(frame, [F.col("id")], 2000, ["g"])
    assert "_slice" in top._jdf.queryExecution().executedPlan().toString()
    assert top.groupBy("g").agg(F.max("id").alias("m"), F.count(F.lit(1)).alias("n")).orderBy("g").collect() == [(0, 3998, 2000), (1, 3999, 2000)]


def test_auto_simplify_by_group(spark):
    """Every group folds by its own sample size."""
    from stratalens.operators.reshape import auto_simplify

    rows = [("D", f"c{i}", 0.01 if i else 0.4) for i in range(61)]
    bench = spark.createDataFrame(rows, "dimension string, country string, population_share double")
    sizes = spark.createDataFrame([(1, "D", 50), (2, "D", 1000)], "wave int, dimension string, sample_size long")
    dims = [Dimension("D", ("country",))]
    got = {r["wave"]: r["n"] for r in auto_simplify(bench, dims, sizes, ["wave"]).groupBy("wave").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {1: 2, 2: 61}


def test_expected_coverage(long_benchmark):
    rows = replicates.expected_coverage(long_benchmark(("A", 0.5), ("B", 0.5)), [2]).collect()
    got = {r["at_least"]: r["expected_strata"] for r in rows}
    assert got == {1: pytest.approx(1.5), 2: pytest.approx(0.5)}
    with pytest.raises(ValueError):
        replicates.expected_coverage(long_benchmark(*FIVE), [2], [3])


def test_sensitivity_changes_the_total_too(survey_of, long_benchmark):
    bench = long_benchmark(("A", 0.5), ("B", 0.5))
    aligned = line_up(cell_counts(survey_of(["country"], (4, "A"), (1, "B")), ["country"]), bench, [DIM])
    got = {r["override"]: r["match_score"] for r in replicates.sensitivity(aligned, DIM, "B", [0, 4]).collect()}
    assert got == {0: pytest.approx(0.5), 4: pytest.approx(1.0)}


def test_size_for_target(spark):
    curve = spark.createDataFrame(
        [("d", 10, 0.5), ("d", 20, 0.8), ("d", 40, 0.805)], "dimension string, size long, max_match double"
    )
    row = replicates.first_size_reaching(curve, 0.7).first()
    assert (row["size_reaching_target"], row["diminishing_after"]) == (20, 20)


def test_shares_are_scaled_only_when_they_do_not_add_up(long_benchmark):
    exact = {r["country"]: r["population_share"] for r in replicates.normalised(long_benchmark(*FIVE)).collect()}
    assert exact == dict(FIVE)
    half = {r["country"]: r["population_share"] for r in replicates.normalised(long_benchmark(("A", 0.2), ("B", 0.3))).collect()}
    assert half == {"A": pytest.approx(0.4), "B": pytest.approx(0.6)}
