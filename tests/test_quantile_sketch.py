"""The mergeable sketch, snapping per batch and by join, and moments, against NumPy."""

import math

import numpy as np
import pytest

from cellsight.operators import profile, quantiles


def test_rank_error_of_merged_sketches(monkeypatch):
    monkeypatch.setattr(quantiles, "BUFFER", 1_000)
    rng = np.random.default_rng(1)
    whole = rng.lognormal(size=200_000)
    parts = []
    for piece in np.array_split(whole, 40):
        sketch = quantiles.Sketch()
        for batch in np.array_split(piece, 3):
            sketch.see(batch)
        parts.append(sketch)
    merged = quantiles.Sketch()
    for part in parts:
        for level, held in part.levels.items():
            for v in held:
                merged.add(v, level)
    merged.count, merged.low, merged.high = len(whole), whole.min(), whole.max()
    weight = sum(2**level * len(v) for level, held in merged.levels.items() for v in held)
    assert weight == len(whole) and merged.numbers() < 12 * 1_000
    monkeypatch.setattr(quantiles, "PAD", 0.005)
    ordered = np.sort(whole)
    for p in (0.0, 0.01, 0.5, 0.99, 1.0):
        (low,), (high,) = merged.ends([p], 0)
        assert low <= np.quantile(ordered, p) <= high
        assert (ordered <= high).mean() - (ordered < low).mean() < 0.03


@pytest.mark.parametrize("sent", [20_000, 0])
def test_every_group_is_bracketed(spark, monkeypatch, sent):
    """No small-group rule, so that brackets are used in all groups, by batch and by join."""
    monkeypatch.setattr(quantiles, "SMALL_GROUP", 0)
    monkeypatch.setattr(quantiles, "SENT_BRACKETS", sent)
    rng = np.random.default_rng(2)
    n = 30_000
    group = rng.integers(0, 4, n)
    value = np.where(rng.random(n) < 0.34, 3.0, np.round(rng.normal(size=n), 3) + group)
    rows = [(f"g{g}", int(g), None if i % 11 == 0 else float(v), i) for i, (g, v) in enumerate(zip(group, value))]
    df = spark.createDataFrame([*rows, (None, 1, 5.0, 0)], "name string, g int, v double, i long").repartition(7)
    keep = np.arange(n) % 11 != 0
    for by in ([], ["g"], ["name", "g"]):
        rows = df.where("name IS NOT NULL") if by != ["name", "g"] else df
        found = quantiles.exact_quantiles(rows, {"v": [0.0, 0.05, 0.5, 0.95, 1.0], "i": [0.3]}, by).collect()
        assert len(found) == (24 if by else 6)
        for r in found:
            mine = group == r["g"] if by else np.full(n, True)
            x = value[mine & keep] if r["feature"] == "v" else np.arange(n)[mine]
            assert r["value"] == pytest.approx(np.quantile(x, r["prob"]), rel=1e-12)


def test_moments_of_parts_and_far_from_zero(spark):
    rng = np.random.default_rng(3)
    a, b = rng.gamma(2.0, size=20_000), 1e7 + rng.normal(size=20_000)
    rows = [(float(x), None if i % 5 == 0 else float(y), None, 4.0) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b double, none double, flat double").repartition(6)
    found = {r["feature"]: r for r in profile.kpi_profile(df, ["a", "b", "none", "flat"]).collect()}
    b = b[np.arange(len(b)) % 5 != 0]
    for name, x in (("a", a), ("b", b)):
        d = x - x.mean()
        expected = (x.mean(), x.std(ddof=1), (d**3).mean() / (d**2).mean() ** 1.5, (d**4).mean() / (d**2).mean() ** 2 - 3)
        for column, value in zip(("mean", "std", "skewness", "kurtosis"), expected):
            assert math.isclose(found[name][column], value, rel_tol=1e-6, abs_tol=1e-6), (name, column)
        assert found[name]["min"] == x.min() and found[name]["max"] == x.max()
    assert found["none"]["mean"] is None and found["flat"]["std"] == 0 and found["flat"]["skewness"] is None


def test_a_single_grouped_column_is_not_snapped_in_python(spark, monkeypatch):
    rows = spark.range(30_000).selectExpr("id % 3 AS g", "CAST(pmod(hash(id), 10007) AS DOUBLE) AS v")
    expected = quantiles.exact_quantiles(rows.selectExpr("*", "v AS w"), {"v": [0.25, 0.5, 0.99], "w": [0.5]}, ["g"]).where("feature = 'v'").collect()
    monkeypatch.setattr(quantiles, "_snap_batches", lambda *_: (_ for _ in ()).throw(AssertionError("sent to Python")))
    assert sorted(quantiles.exact_quantiles(rows, {"v": [0.25, 0.5, 0.99]}, ["g"]).collect()) == sorted(expected)
