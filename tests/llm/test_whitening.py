"""op12: FEAST against a full decomposition, whitened rows against numpy, odd rows."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colscope.llm import feast, whitening

ROWS = "vec_id long, embedding array<float>, label int, n double, component string, v int"


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 24), st.integers(0, 3))
def test_counts_are_those_of_the_spectrum(seed, d, kind):
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    e = [rng.standard_normal(d), rng.integers(-2, 3, d).astype(float), 10.0 ** rng.uniform(-6, 3, d), np.zeros(d)][kind]
    a = (q * e) @ q.T
    a = (a + a.T) / 2
    for s in (-1.5, 0.37, e.mean() + 0.011):
        if np.abs(e - s).min() > 1e-9:
            assert feast.count_above(a, s) == (e > s).sum()


@pytest.mark.parametrize("kind", ["flat", "falling", "clustered", "deficient", "diagonal"])
def test_pairs_are_those_of_a_full_decomposition(kind):
    rng = np.random.default_rng(3)
    d = 64
    e = {"flat": 1 + 0.01 * rng.random(d), "falling": 10.0 ** -np.linspace(0, 6, d), "diagonal": np.arange(d, 0, -1.0),
         "clustered": np.repeat([5.0, 3.0, 1.0, 0.5], 16), "deficient": np.r_[rng.random(9) + 1, np.zeros(d - 9)]}[kind]
    q = np.eye(d) if kind == "diagonal" else np.linalg.qr(rng.standard_normal((d, d)))[0]
    a = (q * e) @ q.T * 1e4
    a = (a + a.T) / 2
    got, v = feast.leading(a, 32)
    want = np.sort(np.linalg.eigvalsh(a))[::-1][:len(got)]
    assert len(got) == min(32, (e > 0).sum())
    assert np.abs(got - want).max() < 1e-12 * want[0]
    assert np.abs(v.T @ v - np.eye(len(got))).max() < 1e-12
    assert np.abs(a @ v - v * got).max() < 1e-12 * want[0]


def test_a_block_that_is_too_small_is_enlarged():
    a = np.diag(np.r_[np.full(20, 2.0), np.full(5, 1.0)])
    e, v = feast.interval(a, 1.5, 2.5, 20)
    assert len(e) == 20 and np.allclose(e, 2)
    with pytest.raises(ArithmeticError):
        feast.interval(a, 1.5, 2.5, 19, rounds=3)


def brute(vectors, count):
    x = np.floor(64 * vectors).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    c = x - s / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1][:count], q[:, ::-1][:, :count]
    return n, ((n * x - s) ** 2).sum(1), c @ q / np.sqrt(e), e / np.trace(c.T @ c / n)


def test_whitened_rows_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 40)).astype(np.float32) * np.linspace(3, 0.2, 40).astype(np.float32)
    x[7] = x[8]
    rows = [(i % 290, [float(c) for c in x[i]], 1, 0.5, "c", 2) for i in range(len(x))]
    rows += [(900, None, 1, 0.5, "c", 2), (901, [float("nan")] * 40, 1, 0.5, "c", 2), (902, [1.0] * 39 + [None], 1, 0.5, "c", 2),
             (903, [float("inf")] + [0.0] * 39, 1, 0.5, "c", 2), (904, [1.0] * 7, 1, 0.5, "c", 2), (905, [], 1, 0.5, "c", 2)]
    rows[5] = (None, *rows[5][1:])
    df = spark.createDataFrame(rows, ROWS).repartition(4)
    got = whitening.whiten(df, components=32)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    n, deviation, white, explained = brute(x.astype(float), 32)
    table = {}
    for r in got.collect():
        assert r["n"] == n and r["identity_error"] < 1e-10
        assert abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9
        table.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r["whitened"])
    sign = None
    for i in range(len(x)):
        mine = table[rows[i][0], int(deviation[i])]
        line = np.array([mine[c][0] for c in range(1, 33)])
        if sign is None:
            sign = np.sign(line * white[i])
        assert np.abs(line - sign * white[i]).max() < 1e-8
    assert sum(len(v) for m in table.values() for v in m.values()) == 32 * len(x)


def test_tables_without_a_component(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None), (2, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).collect() == []
    got = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 4.0]), (3, [1.0, 4.0])], schema)).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 3 and all(r["explained"] == 1 for r in got)


def test_sums_that_do_not_fit_a_long(spark):
    """Far entries: exact deviation where it fits, else null; the components are still right."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((50, 3)) * 1e9
    got = whitening.whiten(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>"))
    n, _, white, _ = brute(x, 3)
    rows = sorted(got.collect())
    assert all(r["deviation"] is None for r in rows) and rows[0]["identity_error"] < 1e-6
    line = np.array([r["whitened"] for r in rows]).reshape(50, 3)
    sign = np.sign((line * white).sum(0))
    assert np.abs(line - sign * white).max() < 1e-5


def test_covariance_passes_agree(spark, monkeypatch):
    """Blocks exact as doubles, exact as longs, and rounded doubles give one covariance."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((200, 6)) * 100
    vectors = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").repartition(3)
    n, sums, spread = whitening.moments(vectors, 6)
    a = whitening.covariance(vectors, 6, n, sums, spread)
    c = np.floor(64 * x) + 1_000_000
    c -= c.mean(0)
    assert np.abs(a - c.T @ c / 200).max() < 1e-9 * np.abs(a).max()
    assert np.abs(a - whitening.covariance(vectors, 6, n, sums, 1 << 24)).max() == 0
    assert np.abs(a - whitening.covariance(vectors, 6, n, sums, 1 << 31)).max() < 1e-9 * np.abs(a).max()
