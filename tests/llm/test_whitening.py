import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.llm import queries
from evalloom.llm import whitening as W

KIND = "vec_id long, embedding array<float>"


def brute(vectors):
    """n, sums, variances and components of floor(64 c) + 1000000, from the covariance itself."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], dtype=np.int64)
    n = len(x)
    centred = x - x.sum(axis=0) / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    return x, n, e[::-1], u[:, ::-1].T, centred


def cloud(n, dim, seed):
    r = np.random.default_rng(seed)
    return (r.standard_normal((n, dim)) * np.linspace(0.2, 3.0, dim) + r.uniform(-5, 5, dim)).astype(np.float32).tolist()


@pytest.mark.parametrize(("n", "dim", "parts"), [(400, 6, 1), (700, 40, 7), (500, 5, 40)])
def test_whole_tree_against_the_covariance(spark, n, dim, parts):
    vectors = cloud(n, dim, n)
    df = spark.createDataFrame(list(enumerate(vectors)), KIND).repartition(parts)
    model = W.fit(df, fan=3)
    x, count, e, u, centred = brute(vectors)
    assert (model.n, model.sums) == (count, [int(s) - W.SHIFT * n for s in x.sum(axis=0)])
    assert np.allclose(model.variances, e, rtol=1e-10)
    k = min(32, dim)
    assert np.allclose(np.abs((model.vectors * u).sum(axis=1)), 1, atol=1e-8)
    got = {r.vec_id: r for r in W.transform(df, model).collect()}
    for i in range(n):
        assert got[i].deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[i], x.sum(axis=0), strict=True))
        want = centred[i] @ u[:k].T / np.sqrt(e[:k])
        assert np.allclose(np.abs(got[i].whitened), np.abs(want), atol=1e-7)
    assert W.identity_error(W.transform(df, model), n, k).first()[0] < 1e-9


def test_merging_loses_nothing():
    r = np.random.default_rng(5)
    x = r.integers(-300, 300, (90, 12))
    whole = W.State.of(x)
    parts = [W.State.of(x[a:b]) for a, b in ((0, 1), (1, 4), (4, 60), (60, 90))]
    merged = parts[0].merged(parts[1]).merged(parts[2].merged(parts[3]))
    assert (merged.n, merged.sums) == (whole.n, whole.sums)
    a, b = merged.scaled.T @ merged.scaled, whole.scaled.T @ whole.scaled
    assert np.abs(a - b).max() < 1e-13 * np.abs(b).max()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = cloud(60, 4, 9)
    rows = list(enumerate(good)) + [(7, good[7]), (None, good[0]), (100, None), (101, [1.0, nan, 0.0, 0.0]), (102, [1.0, inf, 0.0, 0.0]), (103, [1.0, None, 0.0, 0.0]), (104, [1.0, 2.0]), (105, []), (106, [1e30, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, KIND).withColumns({"whitened": F.lit("clash"), "n": F.lit(3), "part": F.lit("x")}).repartition(5)
    model = W.fit(df)
    x, n, e, *_ = brute([*good, good[7], good[0]])
    assert model.n == n and np.allclose(model.variances, e)
    out = W.transform(df, model)
    assert out.columns == ["vec_id", "embedding", "n", "part", "deviation", "whitened"]
    assert sorted(str(r.vec_id) for r in out.collect()) == sorted([*map(str, range(60)), "7", "None"])


def test_no_variance_and_no_rows(spark):
    flat = spark.createDataFrame([(i, [float(i), 2.0, 2.0]) for i in range(9)], KIND)
    model = W.fit(flat)
    values = [r.whitened for r in W.transform(flat, model).collect()]
    assert all(v[0] is not None and v[1:] == [None, None] for v in values)
    assert W.identity_error(W.transform(flat, model), 9, 3).first()[0] < 1e-12
    one = spark.createDataFrame([(1, [1.0, 2.0])], KIND)
    row = W.transform(one, W.fit(one)).first()
    assert (row.deviation, row.whitened) == (0, [None, None])
    none = spark.createDataFrame([], KIND)
    assert W.fit(none) is None and W.transform(none, None).count() == 0


def test_a_deviation_beyond_a_long_is_null(spark):
    df = spark.createDataFrame([(0, [2.0**39, 0.0]), (1, [0.0, 0.0]), (2, [0.0, 1.0])], KIND)
    assert [r.deviation for r in W.transform(df, W.fit(df)).orderBy("vec_id").collect()] == [None] * 3


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = queries.QUERIES["op13_whitening"](spark, d).collect()
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()}
    x, n, e, u, centred = brute(list(vectors.values()))
    assert len(rows) == 32 * n and {r.n for r in rows} == {n} and max(r.identity_error for r in rows) < 1e-9
    first = {r.component: r.explained for r in rows}
    assert np.allclose([first[i + 1] for i in range(32)], e[:32] / e.sum(), rtol=1e-9)
    values = {(r.vec_id, r.component): r.whitened for r in rows}
    for k, (i, c) in enumerate(zip(vectors, centred, strict=True)):
        want = c @ u[:32].T / np.sqrt(e[:32])
        assert np.allclose([abs(values[i, j + 1]) for j in range(32)], np.abs(want), atol=1e-6), k


def test_random_entries_are_floored(spark):
    r = random.Random(3)
    values = [[r.choice([-0.001, 0.0, 1 / 64, -1 / 64, r.uniform(-2, 2)]) for _ in range(3)] for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(values)), "vec_id long, embedding array<double>")
    want = [sum(math.floor(64 * v[i]) for v in values) for i in range(3)]
    assert W.fit(df).sums == want
