import math

import numpy as np
import pytest

from stratalens.llm import whitening
from stratalens.llm.eigen import count_below, leading_pairs
from stratalens.llm.queries import QUERIES, table


def vectors_of(spark, rows):
    frame = spark.createDataFrame(list(rows), "vec_id bigint, embedding array<float>")
    return frame.selectExpr("'x' AS vector", "vec_id", "embedding", "1 AS n", "2 AS component", "'y' AS line", "3 AS whitened")


def usable(rows):
    return [(i, [float(np.float32(c)) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]


def brute(rows, components=32):
    """The contract by the plainest way: Python integers, numpy's own eigenpairs."""
    kept = usable(rows)
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept]
    n, dim = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(dim)]
    y = np.array([[(n * r[j] - sums[j]) / n for j in range(dim)] for r in x])
    covariance = y.T @ y / n
    values, found = np.linalg.eigh(covariance)
    values, found = values[::-1][:components], found[:, ::-1][:, :components]
    deviations = [sum((n * r[j] - sums[j]) ** 2 for j in range(dim)) for r in x]
    return [i for i, _ in kept], deviations, y @ found / np.sqrt(values), values / np.trace(covariance)


@pytest.mark.parametrize("kind", ["random", "equal", "one_column", "graded", "clustered", "blocks"])
def test_eigenpairs(kind):
    rng = np.random.default_rng(4)
    turn = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    matrix = {
        "random": lambda: (lambda b: b @ b.T)(rng.standard_normal((40, 90))),
        "equal": lambda: np.eye(40) * 3,
        "one_column": lambda: np.ones((40, 40)),
        "graded": lambda: np.diag(10.0 ** -np.arange(40)),
        "clustered": lambda: turn @ np.diag([5.0] * 12 + [5 - 1e-12] * 8 + [1.0] * 20) @ turn.T,
        "blocks": lambda: np.kron(np.eye(2), (lambda b: b @ b.T)(rng.standard_normal((20, 30)))),
    }[kind]()
    matrix = (matrix + matrix.T) / 2
    values, vectors = leading_pairs(matrix, 32)
    norm = np.abs(np.linalg.eigvalsh(matrix)).max()
    assert np.abs(values - np.linalg.eigvalsh(matrix)[::-1][:32]).max() < 1e-13 * norm
    assert np.abs(matrix @ vectors - vectors * values).max() < 1e-12 * norm
    assert np.abs(vectors.T @ vectors - np.eye(32)).max() < 1e-13


def test_sturm_counts_and_small_matrices():
    diagonal, off = np.array([2.0, 2.0, 2.0]), np.array([1.0, 0.0])
    assert count_below(diagonal, off, np.array([0.0, 1.5, 2.5, 4.0])).tolist() == [0, 1, 2, 3]
    assert leading_pairs(np.array([[7.0]]), 32)[0].tolist() == [7.0]
    assert leading_pairs(np.zeros((3, 3)), 2)[0].tolist() == [0.0, 0.0]
    assert leading_pairs(np.zeros((0, 0)), 2)[1].shape == (0, 0)


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    plain = rng.standard_normal((400, 40)) @ rng.standard_normal((40, 40)) / 9
    rows = [(i, v.tolist()) for i, v in enumerate(plain)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)]  # a vector that a third of the rows repeat
    rows += [(2000, None), (2001, [None] * 40), (2002, [math.nan] * 40), (2003, [math.inf] + [0.0] * 39), (2004, [1.0] * 39 + [None]), (2005, [])]
    frame = vectors_of(spark, rows).repartition(7)
    model = whitening.fit(frame)
    got = {r["vec_id"]: r for r in whitening.whiten(frame, model).collect()}
    ids, deviations, white, shares = brute(rows)
    assert sorted(got) == sorted(ids)
    assert {i: got[i]["deviation"] for i in ids} == dict(zip(ids, deviations))
    mine = np.array([got[i]["whitened"] for i in ids])
    signs = np.sign((mine * white).sum(axis=0))
    assert np.abs(mine * signs - white).max() < 1e-9
    assert np.abs(model.values / model.trace - shares).max() < 1e-12
    assert whitening.identity_error(frame, model) < 1e-10


def test_odd_tables(spark):
    nothing = vectors_of(spark, [])
    model = whitening.fit(nothing)
    assert model.n == 0 and whitening.identity_error(nothing, model) is None and whitening.whiten(nothing, model).count() == 0
    # One vector, or equal ones: no spread, so no component can be divided by.
    same = vectors_of(spark, [(None, [1.0, 2.0]), (3, [1.0, 2.0]), (3, [1.0, 2.0])])
    model = whitening.fit(same)
    rows = whitening.whiten(same, model).collect()
    assert [(r["deviation"], r["whitened"]) for r in rows] == [(0, [None, None])] * 3
    assert whitening.identity_error(same, model) is None
    # The most frequent length counts; the longer one of equals.
    mixed = vectors_of(spark, [(1, [1.0]), (2, [0.0, 1.0]), (3, [1.0, 3.0]), (4, [5.0, 2.0]), (5, [2.0])])
    assert sorted(r["vec_id"] for r in whitening.whiten(mixed, whitening.fit(mixed)).collect()) == [2, 3, 4]
    # One constant dimension: its direction has no variance, the other one is whole.
    flat = vectors_of(spark, [(1, [1.0, 5.0]), (2, [3.0, 5.0])])
    white = {r["vec_id"]: r["whitened"] for r in whitening.whiten(flat, whitening.fit(flat)).collect()}
    assert {abs(v[0]) for v in white.values()} == {1.0} and {v[1] for v in white.values()} == {None}


def test_huge_entries_stay_defined(spark):
    rows = vectors_of(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.5, 2.0])])
    got = {r["vec_id"]: r for r in whitening.whiten(rows, whitening.fit(rows)).collect()}
    assert got[1]["deviation"] is None and got[2]["deviation"] is None and sorted(got) == [1, 2, 3]


def test_query_on_small_tables(spark, small):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, small, "embeddings").select("vec_id", "embedding").collect()]
    ids, deviations, white, shares = brute(rows)
    got = QUERIES["op12_whitening"](spark, small).toPandas()
    assert len(got) == len(ids) * 32 and got["identity_error"].max() < 1e-9 and set(got["n"]) == {len(ids)}
    mine = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    signs = np.sign((mine * white).sum(axis=0))
    assert np.abs(mine * signs - white).max() < 1e-8
    assert got[got["component"] == 1].set_index("vec_id")["deviation"].loc[ids].tolist() == deviations
    assert np.allclose(got.drop_duplicates("component").sort_values("component")["explained"], shares, rtol=1e-10)
