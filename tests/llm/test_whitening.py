"""Whitening and spectrum slicing against numpy."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from larder.llm import whitening as W


@pytest.mark.parametrize("d", [1, 2, 7, 40])
def test_counts_and_eigenpairs(d):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(d, d))
    a = a @ a.T - np.eye(d)
    values, vectors = np.linalg.eigh(a)
    for s in np.concatenate([rng.uniform(values[0] - 1, values[-1] + 1, 20), values - 1e-6, values + 1e-6]):
        assert W.count_above(a, s) == (values > s).sum()
    got, basis = W.Spectrum(a).leading(16)
    k = min(16, d)
    assert len(got) == k
    np.testing.assert_allclose(got, values[::-1][:k], rtol=0, atol=1e-12 * abs(values).max())
    np.testing.assert_allclose(np.abs((basis * vectors.T[::-1][:k]).sum(axis=1)), 1, atol=1e-9)


@pytest.mark.parametrize("matrix", [np.zeros((4, 4)), np.eye(5), np.diag([3.0, 3, 2, 2, 2, 0]), np.ones((6, 6)),
                                    np.diag([1e12, 1, 1e-12]), np.diag([2, 1, 1 + 1e-15]), np.array([[0.0, 1], [1, 0]])])
def test_repeated_and_missing_eigenvalues(matrix):
    got, basis = W.Spectrum(matrix).leading(16)
    scale = max(1.0, np.abs(matrix).max())
    np.testing.assert_allclose(got, np.linalg.eigvalsh(matrix)[::-1], atol=1e-13 * scale * len(matrix))
    np.testing.assert_allclose(basis @ basis.T, np.eye(len(matrix)), atol=1e-12)
    np.testing.assert_allclose(matrix @ basis.T, basis.T * got, atol=1e-12 * scale)


def plain(rows, k=16):
    """(n, deviations, whitened up to sign, eigenvalues, trace) in numpy and Python integers."""
    x = {i: [math.floor(64 * float(c)) + 1000000 for c in v] for i, v in rows}
    fit = sorted(set(map(tuple, x.values())))
    n, d = len(fit), len(fit[0])
    sums = [sum(f[j] for f in fit) for j in range(d)]
    centred = np.array([[(n * f[j] - sums[j]) / n for j in range(d)] for f in fit])
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    deviation = {i: sum((n * a - s) ** 2 for a, s in zip(f, sums)) for i, f in x.items()}
    white = {i: np.array([(n * a - s) / n for a, s in zip(f, sums)]) @ u / np.sqrt(e) for i, f in x.items()}
    return n, deviation, white, e, np.trace(v)


def vectors_of(n, d, seed):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(d, d)) / 3
    return [(i, [float(np.float32(c)) for c in rng.normal(size=d) @ mix]) for i in range(n)]


def test_rows_against_numpy(spark):
    rows = vectors_of(300, 9, 1)
    rows += [(1000 + i, rows[0][1]) for i in range(150)]                # a third are copies
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    model = W.fit_whitening(frame, components=6)
    n, deviation, white, values, trace = plain(rows, 6)
    assert model.n == n == 300
    np.testing.assert_allclose(model.values, values, rtol=1e-11)
    np.testing.assert_allclose(model.explained, values / trace, rtol=1e-11)
    assert model.identity_error < 1e-10
    got = {r["vec_id"]: r for r in W.whiten(frame, model).collect()}
    assert {i: int(r["deviation"]) for i, r in got.items()} == deviation
    ours = np.array([got[i]["whitened"] for i, _ in rows])
    theirs = np.array([white[i] for i, _ in rows])
    sign = np.sign((ours * theirs).sum(axis=0))
    np.testing.assert_allclose(ours, theirs * sign, atol=1e-8)


def test_unusable_vectors_other_lengths_null_ids_and_clashing_columns(spark):
    rows = [(i, v, 0, 0) for i, v in vectors_of(40, 3, 2)]
    rows += [(100, None, 0, 0), (101, [1.0, None, 2.0], 0, 0), (102, [1.0, float("nan"), 0.0], 0, 0),
             (103, [float("inf"), 0.0, 0.0], 0, 0), (104, [], 0, 0), (105, [1.0, 2.0], 0, 0), (None, rows[0][1], 0, 0),
             (0, rows[0][1], 0, 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x int, deviation int")
    model = W.fit_whitening(frame)
    out = W.whiten(frame, model).collect()
    assert model.n == 40 and model.dim == 3
    assert Counter(r["vec_id"] for r in out) == Counter([*range(40), None, 0])


def test_empty_table_single_vector_and_missing_variance(spark):
    schema = "vec_id long, embedding array<float>"
    empty = spark.createDataFrame([], schema)
    assert W.fit_whitening(empty) is None
    assert W.whiten(empty, None).collect() == []
    one = spark.createDataFrame([(7, [0.5, 0.25])], schema)
    model = W.fit_whitening(one)
    row = W.whiten(one, model).first()
    assert row["deviation"] == 0 and row["whitened"] == [None, None] and model.explained == [None, None]
    flat = spark.createDataFrame([(i, [i / 64, 1.0, 0.0]) for i in range(10)], schema)
    model = W.fit_whitening(flat)
    row = W.whiten(flat, model).first()
    assert [x is None for x in row["whitened"]] == [False, True, True] and model.identity_error < 1e-12


def test_very_large_entries_stay_exact(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1, 1]) * rng.uniform(1e9, 1e12) for _ in range(3)]) for i in range(30)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = W.fit_whitening(frame)
    n, deviation, _, values, _ = plain(rows)
    assert {r["vec_id"]: int(r["deviation"]) for r in W.whiten(frame, model).collect()} == deviation
    np.testing.assert_allclose(model.values, values, rtol=1e-9)
    huge = spark.createDataFrame([(0, [1e300, 0.0]), (1, [-1e300, 1.0]), (2, [0.0, 2.0])], "vec_id long, embedding array<double>")
    assert W.whiten(huge, W.fit_whitening(huge)).count() == 3


def test_query_over_a_folder(spark, tmp_path):
    from larder.llm.queries import QUERIES
    rows = [*vectors_of(60, 20, 5), (60, None)]
    spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int") \
        .write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["op12_whitening"](spark, str(tmp_path))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    found = got.collect()
    n, deviation, white, values, trace = plain(rows[:-1])
    assert Counter(r["vec_id"] for r in found) == {i: 16 for i in range(60)}
    assert all(r["n"] == n and r["deviation"] == deviation[r["vec_id"]] and r["identity_error"] < 1e-8 for r in found)
    for c in range(16):
        mine = {r["vec_id"]: r for r in found if r["component"] == c + 1}
        a, b = np.array([mine[i]["whitened"] for i in range(60)]), np.array([white[i][c] for i in range(60)])
        np.testing.assert_allclose(a, b * np.sign(a @ b), atol=1e-7)
        assert abs(mine[0]["explained"] / (values[c] / trace) - 1) < 1e-9


def test_query_over_an_empty_folder(spark, tmp_path):
    from larder.llm.queries import QUERIES
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert QUERIES["op12_whitening"](spark, str(tmp_path)).collect() == []
