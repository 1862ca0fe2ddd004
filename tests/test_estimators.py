"""Fits of summaries against NumPy fits of all values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellsight.operators import thresholds


def table(spark, groups):
    rows = [(name, float(v), "x") for name, values in groups.items() for v in values]
    return spark.createDataFrame(rows, "dataset_name string, score double, n string").repartition(4)


def mixture(x, tolerance=1e-3):
    """Plain expectation-maximisation over all values with the same start and stop."""
    cut = (x.min() + x.max()) / 2
    for _ in range(100):
        moved = (x[x >= cut].mean() + x[x < cut].mean()) / 2
        if abs(moved - cut) <= 1e-9 * (x.max() - x.min()):
            break
        cut = moved
    r, previous = (x >= cut).astype(float), None
    parts = lambda r: [(q.mean(), np.average(x, weights=q), np.average((x - np.average(x, weights=q)) ** 2, weights=q) + 1e-6) for q in (1 - r, r)]
    p = parts(r)
    for _ in range(100):
        logs = [math.log(w) - 0.5 * math.log(2 * math.pi * v) - (x - m) ** 2 / (2 * v) for w, m, v in p]
        both = np.logaddexp(*logs)
        p = parts(np.exp(logs[1] - both))
        if previous is not None and abs(both.mean() - previous) < tolerance:
            break
        previous = both.mean()
    return [v for part in sorted(p, key=lambda q: q[1]) for v in part]


def test_mixture_equals_plain_fit_in_every_group(spark):
    rng = np.random.default_rng(4)
    groups = {
        "apart": np.concatenate([rng.normal(0, 1, 3000), rng.normal(8, 0.5, 400)]),
        "near": np.concatenate([rng.normal(0, 1, 3000), rng.normal(2, 1, 3000)]),
        "shifted": 1e6 + np.concatenate([rng.normal(0, 0.1, 2000), rng.normal(1, 0.1, 300)]),
        "outlier": np.concatenate([rng.normal(0, 1, 2000), [1e5]]),
        None: rng.normal(0, 1, 500),
    }
    found = {r["dataset_name"]: [r[c] for c in ("w0", "m0", "v0", "w1", "m1", "v1")] for r in thresholds.fit_mixture(table(spark, groups), tolerance=1e-6).collect()}
    assert set(found) == set(groups)
    for name, x in groups.items():
        assert np.allclose(found[name], mixture(x, 1e-6), rtol=2e-3, atol=2e-3), name
    # Far from zero, the variance keeps its digits.
    assert abs(found["shifted"][2] - 0.01) < 1e-3


def test_mixture_of_thousands_of_groups_and_of_constant_scores(spark):
    rows = spark.range(0, 12_000).selectExpr("concat('g', id % 3000) AS dataset_name", "CAST(id DIV 3000 AS DOUBLE) AS score")
    assert thresholds.fit_mixture(rows).count() == 3_000
    flat = thresholds.fit_mixture(table(spark, {"a": [2.0] * 5, "b": [1.0, 2.0]})).collect()
    assert all(math.isfinite(r[c]) for r in flat for c in ("w0", "m0", "v0", "w1", "m1", "v1"))


def pareto(y):
    """Likelihood of all excesses searched on a fine grid and by bisection of the derivative's sign."""

    def loss(t):
        shape = np.log1p(t * y).mean()
        return math.log(shape / t) + shape + 1 if shape > -1 else math.inf

    grid = [t for t in (np.exp(np.linspace(math.log(1e-4), math.log(1e4), 20_001)) - 1) / y.max() if abs(t) * y.max() > 1e-6]
    t = min(grid, key=loss)
    step = abs(t) * 1e-3
    while step > abs(t) * 1e-13:
        t = min((t - step, t, t + step), key=loss)
        if loss(t) <= min(loss(t - step), loss(t + step)):
            step /= 2
    shape = np.log1p(t * y).mean()
    return shape, shape / t


@pytest.mark.parametrize("shape", [-0.3, -0.05, 0.2, 0.7])
def test_tail_by_likelihood_equals_numpy(spark, shape):
    u = np.random.default_rng(6).random(40_000)
    x = 5 + 2 / shape * ((1 - u) ** -shape - 1)
    found = thresholds.evt_likelihood_thresholds(table(spark, {"d": x})).first()
    start = np.quantile(x, 0.95)
    y = x[x > start] - start
    a, scale = pareto(y)
    assert math.isclose(found["threshold"], start + scale / a * (0.1**-a - 1), rel_tol=1e-6)


def test_tail_without_enough_excesses(spark):
    groups = {"few": np.arange(100.0), "flat": [1.0] * 1000, "steps": [0.0] * 950 + [3.0] * 50}
    found = {r["dataset_name"]: r["threshold"] for r in thresholds.evt_likelihood_thresholds(table(spark, groups)).collect()}
    assert found == {k: np.quantile(v, 0.99) for k, v in groups.items()}
    alone = thresholds.evt_likelihood_thresholds(table(spark, {"few": np.arange(100.0)}).select("score"), []).first()
    assert alone["threshold"] == np.quantile(np.arange(100.0), 0.99)


def test_offsets_of_several_scores_are_selected_together(spark, monkeypatch):
    """Before, the sweep read all scores once per number of trees."""
    from cellsight.operators import scoring

    rows = spark.range(4_000).selectExpr("CAST(pmod(hash(id), 997) AS DOUBLE) AS `a`", "CAST(id * id % 1013 AS DOUBLE) AS b")
    expected = {c: scoring.fit_offsets(rows, [0.05, 0.1], c) for c in "ab"}
    passes, original = [], scoring.quantile_values
    monkeypatch.setattr(scoring, "quantile_values", lambda *a: passes.append(1) or original(*a))
    assert scoring.fit_offsets_of(rows, ["a", "b"], [0.05, 0.1]) == expected and len(passes) == 1
