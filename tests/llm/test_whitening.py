import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import whitening as wh


def frame(spark, vectors, start=0):
    return spark.createDataFrame([(start + k, v, 1, "x") for k, v in enumerate(vectors)], "vec_id long, embedding array<float>, n int, component string")


def integers(vectors):
    return [[int(np.floor(64 * float(np.float32(c)))) + 1000000 for c in v] for v in vectors]


def run(df):
    model = wh.fit(df)
    error = wh.identity_error(df, model)
    return model, error, wh.whiten(df, model, error).collect()


@pytest.mark.parametrize("n", [1, 2, 3, 8, 40])
def test_eigen_solve(n):
    rng = np.random.default_rng(n)
    for a in (rng.normal(size=(n, n)), np.diag(np.arange(n) % 3.0), np.zeros((n, n)), np.ones((n, n))):
        a = (a + a.T) / 2
        values, vectors = wh.symmetric_qr(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * max(1, n))
        assert np.allclose(vectors.T @ vectors, np.eye(n), atol=1e-13 * max(1, n)) and np.allclose(vectors @ np.diag(values) @ vectors.T, a, atol=1e-12 * max(1, n))


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(5)
    good = (rng.normal(size=(500, 40)) @ rng.normal(size=(40, 40)) / 6).astype(np.float32).tolist() + [[0.25] * 40] * 60
    bad = [None, [None] + [1.0] * 39, [float("nan")] * 40, [float("inf")] + [0.0] * 39, [1e30] * 40]
    df = frame(spark, good + bad).repartition(7)
    model, error, rows = run(df)
    x = np.array(integers(good), object)
    n, sums = len(x), x.sum(0)
    y = (x - 0).astype(float) - (sums / n).astype(float)
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    want = {(k, c + 1): (y[k] @ vectors[:, c]) / np.sqrt(values[c]) for k in range(n) for c in range(32)}
    assert len(rows) == n * 32 and model.n == n and list(model.sums) == sums.tolist()
    deviation = {k: sum((n * int(v) - int(s)) ** 2 for v, s in zip(x[k], sums)) for k in range(n)}
    signs = {}
    for r in rows:
        w = want[r.vec_id, r.component]
        sign = signs.setdefault(r.component, 1 if abs(r.whitened - w) < abs(r.whitened + w) else -1) if abs(w) > 0.1 else signs.get(r.component)
        assert sign is None or abs(r.whitened - sign * w) < 1e-8
        assert r.n == n and r.deviation == deviation[r.vec_id] and abs(r.explained - values[r.component - 1] / values.sum()) < 1e-10 and r.identity_error == error < 1e-9


def test_edges(spark):
    assert run(frame(spark, []))[2] == [] and run(frame(spark, [None, [None, 1.0]]))[2] == []
    model, error, rows = run(frame(spark, [[1.0, 2.0]]))
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in rows] == [(1, 1, 0, None, None, 0.0), (2, 1, 0, None, None, 0.0)]
    # a constant dimension, a vector that ends early, a repeated row, one without an id
    vectors = [[1.0, 5.0, 2.0], [2.0, 5.0], [1.0, 5.0, 2.0], [0.5, 5.0, -1.0]]
    df = frame(spark, vectors).withColumn("vec_id", F.when(F.col("vec_id") < 3, F.col("vec_id"))).repartition(3)
    model, error, rows = run(df)
    x = np.array(integers([v + [0.0] * (3 - len(v)) for v in vectors]), float)
    assert len(rows) == 12 and list(model.sums) == x.sum(0).tolist() and error < 1e-9
    assert np.allclose(model.values, np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1], atol=1e-6)
    assert all((r.whitened is None) == (r.component == 3) for r in rows)
    assert {r.deviation for r in rows if r.vec_id == 1} == {int((((4 * x[1]) - x.sum(0)) ** 2).sum())}
    # large entries: sums beyond a long, deviations beyond a long
    model, _, rows = run(frame(spark, [[1e16, 1.0]] * 40 + [[-1e16, 1.0]]))
    assert model.sums[0] == 40 * integers([[1e16]])[0][0] + integers([[-1e16]])[0][0] and all(r.deviation is None for r in rows)


def test_merge_in_any_split(spark):
    rng = np.random.default_rng(9)
    good = (rng.normal(size=(300, 6)) + 1000).astype(np.float32).tolist()
    a, b = wh.fit(frame(spark, good).repartition(1)), wh.fit(frame(spark, good).repartition(40))
    assert a.sums == b.sums and np.allclose(a.values, b.values, rtol=1e-10)
    own = wh.Moments()
    for low in range(0, 300, 7):
        own.add(np.array(integers(good))[low : low + 7])
    x = np.array(integers(good), float)
    assert np.allclose(own.co / 300, np.cov(x.T, bias=True), rtol=1e-9, atol=1e-6)
