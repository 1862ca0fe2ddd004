"""Neighbour-based information against a plain count of all pairs."""

import numpy as np
import pytest

from cellsight.operators import profile


def psi(m):
    return -0.5772156649015329 + sum(1 / i for i in range(1, int(m)))


def brute(x, y, k=3):
    keep = np.isin(y, [c for c in set(y) if (y == c).sum() > 1])
    x, y = x[keep], y[keep]
    total = 0.0
    for v, c in zip(x, y):
        own = np.sort(np.abs(x[y == c] - v))
        size = len(own)
        radius = own[min(k, size - 1)] * (1 - 1e-9)
        total += psi(min(k, size - 1)) - psi(size) - psi((np.abs(x - v) <= radius).sum())
    return max(0.0, psi(len(x)) + total / len(x))


@pytest.mark.parametrize("k", [1, 3])
def test_equals_all_pairs(spark, k):
    rng = np.random.default_rng(2)
    y = np.array([0] * 320 + [1] * 70 + [2] * 3 + [3])
    smooth = np.round(rng.normal(size=len(y)) + y, 5)
    steps = rng.integers(0, 12, len(y)) + 2.0 * (y == 1)
    hot = np.where(rng.random(len(y)) < 0.4, 7.0, smooth)
    rows = [(float(a), float(b), float(c), None if i % 50 == 0 else 1.0, int(label), "x") for i, (a, b, c, label) in enumerate(zip(smooth, steps, hot, y))]
    df = spark.createDataFrame([*rows, (None, None, None, None, 0, "x"), (1.0, 1.0, 1.0, 1.0, None, "x")], "smooth double, steps double, hot double, flat double, label int, place string")
    found = {r["feature"]: r["mutual_information"] for r in profile.neighbour_information(df.repartition(6), ["smooth", "steps", "hot", "flat"], k=k).collect()}
    for name, x in (("smooth", smooth), ("steps", steps), ("hot", hot)):
        assert abs(found[name] - brute(x, y, k)) < 1e-9, name
    assert found["flat"] < 0.02


def test_rows_that_say_everything_and_nothing(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 5_000)
    x, noise = y * 10 + rng.random(5_000), rng.random(5_000)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(x, noise, y)], "x double, noise double, label int")
    found = {r["feature"]: r["mutual_information"] for r in profile.neighbour_information(df, ["x", "noise"]).collect()}
    share = y.mean()
    assert abs(found["x"] + share * np.log(share) + (1 - share) * np.log(1 - share)) < 0.01 and found["noise"] < 0.03


def test_empty_table(spark):
    assert profile.neighbour_information(spark.createDataFrame([], "x double, label int"), ["x"]).count() == 0
