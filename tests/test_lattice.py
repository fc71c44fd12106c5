"""Dimensions summed up from the dimensions that contain them."""

import itertools
import random

import pytest
from plan_rows import metric_of

from stratalens.functions.fixed import STANDARD_DIMENSIONS
from stratalens.operators.strata import Dimension, lattice, roll_up

DIMS = [Dimension(" × ".join(c), c) for n in (3, 2, 1) for c in itertools.combinations("abc", n)]


def brute(rows, dims, by):
    found = {}
    for wave, a, b, c, n in rows:
        values = {"a": a, "b": b, "c": c}
        for d in dims:
            if all(values[k] is not None for k in d.columns):
                key = (wave if by else None, d.name, *(values[k] if k in d.columns else None for k in "abc"))
                found[key] = found.get(key, 0) + n
    return found


@pytest.mark.parametrize("by", [[], ["wave"]])
@pytest.mark.parametrize("dims", [DIMS, DIMS[1:], DIMS[4:], [DIMS[0], DIMS[4]], [DIMS[1], DIMS[6]]])
def test_against_plain_sums(spark, dims, by):
    rng = random.Random(3)
    rows = [(rng.choice([1, 2, None]), *(rng.choice(["x", "y", None]) for _ in "abc"), rng.randrange(5)) for _ in range(120)]
    cells = spark.createDataFrame(rows, "wave int, a string, b string, c string, n long")
    got = {}
    for r in roll_up(cells, dims, "n", by).collect():
        key = (r["wave"] if by else None, r["dimension"], *((r[k] if k in r.asDict() else None) for k in "abc"))
        assert key not in got
        got[key] = r["n"]
    want = brute(rows, dims, by)
    used = {c for d in dims for c in d.columns}
    assert got == {(w, d, *(v if k in used else None for k, v in zip("abc", values))): n for (w, d, *values), n in want.items()}


def test_containers():
    plan = lattice(STANDARD_DIMENSIONS)
    assert sorted(d.name for part in plan.values() for d in part) == sorted(d.name for d in STANDARD_DIMENSIONS)
    assert len(plan) < len(STANDARD_DIMENSIONS) and all(part[0].name == name for name, part in plan.items())
    assert all(set(d.columns) <= set(part[0].columns) for part in plan.values() for d in part)


def test_cells_are_expanded_for_the_containers_only(spark):
    cells = spark.range(4000).selectExpr("cast(id AS string) AS a", "cast(id % 7 AS string) AS b", "cast(id % 5 AS string) AS c", "1L AS n")
    rolled = roll_up(cells, DIMS)
    rolled.collect()
    # One container instead of seven dimensions: 4000 rows enter the first sums, not 28,000.
    assert len(lattice(DIMS)) == 1 and sum(metric_of(rolled, "Expand")) <= 4000
