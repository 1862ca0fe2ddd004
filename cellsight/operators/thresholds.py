"""Adaptive thresholds on score tables, per data set."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cellsight.operators.joins import null_safe_join
from cellsight.operators.quantiles import exact_quantiles, wide_quantiles
from cellsight.session import materialise

MAD_SCALE = 1.4826
TAIL = 0.95
TAIL_QUANTILE = 0.90
MINIMUM_TAIL_ROWS = 20
POSTERIOR_CUTS = [0.50, 0.80, 0.90, 0.95]
# Bins of a summary per unit of asinh of the scaled value; the summary of a group grows with the logarithm of its range.
FINENESS = 512


def _common_quantiles(scored: DataFrame, by: list[str]) -> DataFrame:
    """All quantiles that the methods share, selected at once: columns p25 to p99."""
    probs = (25, 50, 75, 90, 95, 98, 99)
    return materialise(wide_quantiles(scored, {f"p{p}": ("score", p / 100) for p in probs}, by), "quantiles")


def percentile_thresholds(scored: DataFrame, percentiles: list[int], by: list[str] = ("dataset_name",)) -> DataFrame:
    found = exact_quantiles(scored, {"score": [p / 100 for p in percentiles]}, by)
    name = F.concat(F.lit("percentile_"), F.round(F.col("prob") * 100).cast("int").cast("string"))
    return found.select(*by, name.alias("method"), F.col("value").alias("threshold"))


def iqr_thresholds(scored: DataFrame, factors: list[float], by: list[str] = ("dataset_name",), known: DataFrame | None = None) -> DataFrame:
    quartiles = known.selectExpr(*by, "p25 AS q1", "p75 AS q3") if known else wide_quantiles(scored, {"q1": ("score", 0.25), "q3": ("score", 0.75)}, by)
    return _per_factor(quartiles, "iqr", factors, "q3 + {k}D * (q3 - q1)", by)


def mad_thresholds(scored: DataFrame, factors: list[float], by: list[str] = ("dataset_name",), known: DataFrame | None = None) -> DataFrame:
    """Median plus multiples of the scaled median distance from the median."""
    middle = known.selectExpr(*by, "p50 AS middle") if known else materialise(wide_quantiles(scored, {"middle": ("score", 0.5)}, by), "medians")
    rows = scored.select(*by, "score")
    away = null_safe_join(rows, middle, list(by)) if by else rows.withColumn("middle", F.lit(middle.first()["middle"]))
    distance = wide_quantiles(away.select(*by, F.abs(F.col("score") - F.col("middle")).alias("away")), {"mad": ("away", 0.5)}, by)
    both = null_safe_join(middle, distance, list(by)) if by else distance.withColumn("middle", F.lit(middle.first()["middle"]))
    return _per_factor(both, "mad", factors, f"middle + {{k}}D * {MAD_SCALE}D * mad", by)


def gaussian_thresholds(scored: DataFrame, factors: list[float], by: list[str] = ("dataset_name",)) -> DataFrame:
    moments = scored.groupBy(*by).agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd"))
    return _per_factor(moments, "gaussian", factors, "mean + {k}D * sd", by)


def _per_factor(stats: DataFrame, name: str, factors: list[float], sql: str, by: list[str]) -> DataFrame:
    cells = ", ".join(f"struct('{name}_{k:g}' AS method, {sql.format(k=float(k))} AS threshold)" for k in factors)
    return stats.selectExpr(*by, f"inline(array({cells}))")


def _tails(scored: DataFrame, by: list[str], known: DataFrame | None) -> DataFrame:
    if known:
        return known.selectExpr(*by, "p95 AS start", "p99")
    return materialise(wide_quantiles(scored, {"start": ("score", TAIL), "p99": ("score", 0.99)}, by), "tails")


def evt_thresholds(scored: DataFrame, by: list[str] = ("dataset_name",), known: DataFrame | None = None) -> DataFrame:
    """Tail threshold: a Pareto fit by moments to the excesses over the 95th percentile.

    The threshold is the tail start plus the 90 % quantile of the fit; with at most 20 excesses or
    equal excesses it is the 99th percentile.
    """
    cuts = _tails(scored, by, known)
    rows = scored.select(*by, "score")
    joined = null_safe_join(rows, cuts, list(by)) if by else rows.withColumns(
        {c: F.lit(v) for c, v in cuts.first().asDict().items()}
    )
    excess = F.when(F.col("score") > F.col("start"), F.col("score") - F.col("start"))
    stats = joined.groupBy(*by, "start", "p99").agg(
        F.count(excess).alias("n"), F.avg(excess).alias("m"), F.var_samp(excess).alias("v")
    )
    shape = "(0.5D * (1D - m * m / v))"
    scale = "(0.5D * m * (1D + m * m / v))"
    quantile = (
        f"IF(abs({shape}) < 1e-9D, -{scale} * ln({1 - TAIL_QUANTILE!r}D), "
        f"{scale} / {shape} * (pow({1 - TAIL_QUANTILE!r}D, -{shape}) - 1D))"
    )
    return stats.selectExpr(
        *by, "'evt' AS method", f"IF(n > {MINIMUM_TAIL_ROWS} AND v > 0, start + {quantile}, p99) AS threshold"
    )


def _summaries(rows: DataFrame, by: list[str], value: str, scale: str) -> DataFrame:
    """Mergeable summary of a column per group: rows (by..., n, m, s) with the count, mean and squared deviations of each bin.

    Bins are equal steps of asinh(scale), so they are narrow where the values are and few however far they reach.
    """
    binned = rows.withColumn("_bin", F.expr(f"CAST(floor(asinh({scale}) * {FINENESS}D) AS BIGINT)"))
    return binned.groupBy(*by, "_bin").agg(
        F.count(value).cast("double").alias("n"), F.avg(value).alias("m"), F.expr(f"count({value}) * var_pop({value})").alias("s")
    )


def _fitted(summary: DataFrame, by: list[str], extra: list[str], fit: Callable[[pd.DataFrame], tuple], names: list[str]) -> DataFrame:
    """One row (by..., extra..., names...) per group, from a function of the group's summary."""
    kept = [*by, *extra]
    types = {f.name: f.dataType.simpleString() for f in summary.schema.fields}
    schema = ", ".join([f"`{c}` {types[c]}" for c in kept] + [f"{n} double" for n in names])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = group.iloc[:1][kept].reset_index(drop=True)
        values = fit(group.sort_values("m"))
        return out.assign(**{n: [float(v)] for n, v in zip(names, values)})

    grouped = summary.groupBy(*by) if by else summary.withColumn("_all", F.lit(0)).groupBy("_all")
    return grouped.applyInPandas(run, schema)


def pareto_likelihood(n: np.ndarray, m: np.ndarray, s: np.ndarray) -> tuple[float, float]:
    """Shape and scale of the Pareto tail that maximises the likelihood of excesses given as bins of count, mean and deviations.

    With t = shape / scale the best shape is the mean of ln(1 + t y), so one number is searched; the means inside a bin are
    expanded to second order.  Shapes of -1 and below, where the likelihood has no maximum, are left out.
    """
    total, top = n.sum(), m.max()
    centre = float((n * m).sum() / total)

    def shape(t: float) -> float:
        base = 1 + t * m
        return float((n * np.log(base) - s * t * t / (2 * base * base)).sum() / total)

    def loss(u: float) -> float:
        t = (math.exp(u) - 1) / top
        if abs(t) * top < 1e-9:
            return math.log(centre) + 1
        found = shape(t)
        return math.inf if found <= -1 or found / t <= 0 else math.log(found / t) + found + 1

    grid = np.linspace(math.log(1e-4), math.log(1e4), 600)
    losses = [loss(u) for u in grid]
    at = int(np.argmin(losses))
    low, high = grid[max(0, at - 1)], grid[min(len(grid) - 1, at + 1)]
    ratio = (math.sqrt(5) - 1) / 2
    a, b = high - ratio * (high - low), low + ratio * (high - low)
    fa, fb = loss(a), loss(b)
    for _ in range(80):
        if fa <= fb:
            high, b, fb = b, a, fa
            a = high - ratio * (high - low)
            fa = loss(a)
        else:
            low, a, fa = a, b, fb
            b = low + ratio * (high - low)
            fb = loss(b)
    t = (math.exp((low + high) / 2) - 1) / top
    if abs(t) * top < 1e-9:
        return 0.0, centre
    found = shape(t)
    return found, found / t


def evt_likelihood_thresholds(scored: DataFrame, by: list[str] = ("dataset_name",), known: DataFrame | None = None) -> DataFrame:
    """Tail threshold by a Pareto tail of maximum likelihood over the excesses above the 95th percentile.

    The excesses of a group are counted into a mergeable summary and fitted in its task, one job for all groups.  With at
    most 20 excesses or equal excesses the threshold is the 99th percentile.
    """
    by = list(by)
    cuts = _tails(scored, by, known)
    rows = scored.select(*by, "score")
    joined = null_safe_join(rows, cuts, by) if by else rows.withColumns({c: F.lit(v) for c, v in cuts.first().asDict().items()})
    beyond = joined.withColumn("excess", F.col("score") - F.col("start")).where("excess > 0")
    unit = beyond.groupBy(*by).agg(F.avg("excess").alias("unit"))
    beyond = null_safe_join(beyond, materialise(unit, "units"), by) if by else beyond.withColumn("unit", F.lit(unit.first()["unit"]))
    summary = _summaries(beyond, by, "excess", "16D * excess / unit")

    def fit(group: pd.DataFrame) -> tuple:
        n, m, s = (group[c].to_numpy() for c in "nms")
        if n.sum() <= MINIMUM_TAIL_ROWS or (len(n) == 1 and s[0] <= 0):
            return math.nan, math.nan
        return pareto_likelihood(n, m, np.maximum(s, 0.0))

    found = materialise(_fitted(summary, by, [], fit, ["shape", "scale"]), "pareto")
    ends = null_safe_join(cuts, found, by, "left") if by else cuts.crossJoin(F.broadcast(found.limit(1))) if found.take(1) else cuts.withColumns({"shape": F.lit(math.nan), "scale": F.lit(math.nan)})
    quantile = (
        f"IF(abs(shape) < 1e-9D, -scale * ln({1 - TAIL_QUANTILE!r}D), scale / shape * (pow({1 - TAIL_QUANTILE!r}D, -shape) - 1D))"
    )
    return ends.selectExpr(*by, "'evt' AS method", f"IF(shape IS NULL OR isnan(shape), p99, start + {quantile}) AS threshold")


def adaptive_thresholds(scored: DataFrame, by: list[str] = ("dataset_name",), likelihood: bool = False) -> DataFrame:
    """All closed-form methods as (by..., method, threshold); `likelihood` fits the tail by likelihood instead of by moments.

    The quantiles that the methods need are selected together; only the distances from the median need a second selection.
    """
    by = list(by)
    known = _common_quantiles(scored, by)
    cells = ", ".join(f"struct('percentile_{p}' AS method, p{p} AS threshold)" for p in (90, 95, 98, 99))
    tail = evt_likelihood_thresholds if likelihood else evt_thresholds
    return (
        known.selectExpr(*by, f"inline(array({cells}))")
        .unionByName(iqr_thresholds(scored, [1.5, 3.0], by, known))
        .unionByName(mad_thresholds(scored, [3.5, 5.0], by, known))
        .unionByName(gaussian_thresholds(scored, [2.5, 3.0], by))
        .unionByName(tail(scored, by, known))
    )


def apply_threshold(scored: DataFrame, thresholds: DataFrame, method: str, by: list[str] = ("dataset_name",), output: str = "predicted") -> DataFrame:
    """Flag rows at or above the threshold of one method."""
    cut = materialise(thresholds.where(F.col("method") == method).select(*by, F.col("threshold").alias("_cut")), "cut")
    joined = null_safe_join(scored, cut, list(by)) if by else scored.withColumn("_cut", F.lit(cut.first()["_cut"]))
    return joined.withColumn(output, (F.col("score") >= F.col("_cut")).cast("int")).drop("_cut")


# Two-component mixture -------------------------------------------------------------------------

_PARAMETERS = ["w0", "m0", "v0", "w1", "m1", "v1"]
_VARIANCE_FLOOR = 1e-6


def _log_density(k: int, x: str = "score") -> str:
    return f"(ln(w{k}) - 0.5D * ln({2 * math.pi!r}D * v{k}) - ({x} - m{k}) * ({x} - m{k}) / (2D * v{k}))"


def posterior_sql(x: str = "score") -> str:
    """SQL for the probability of component 1, the one with the larger mean."""
    return f"(1D / (1D + exp({_log_density(0, x)} - {_log_density(1, x)})))"


def mixture_of_bins(n: np.ndarray, m: np.ndarray, s: np.ndarray, tolerance: float, iterations: int) -> tuple:
    """Weights, means and variances of two normal components fitted to bins of count, mean and squared deviations.

    The start splits at the two-means cut; responsibilities are taken at the bin means, moments hold all of a bin's
    deviations and are centred at the component's mean, so narrow scores far from zero lose nothing.
    """
    total = n.sum()
    cut = (m.min() + m.max()) / 2
    for _ in range(100):
        upper = m >= cut
        if upper.all() or not upper.any():
            break
        moved = (np.average(m[upper], weights=n[upper]) + np.average(m[~upper], weights=n[~upper])) / 2
        if abs(moved - cut) <= 1e-9 * (m.max() - m.min()):
            break
        cut = moved

    def moments(share: np.ndarray) -> tuple[float, float, float]:
        weight = max(float((n * share).sum()), 1e-10)
        mean = float((n * share * m).sum()) / weight
        spread = float((share * (s + n * np.square(m - mean))).sum()) / weight
        return weight / total, mean, spread + _VARIANCE_FLOOR

    upper = (m >= cut).astype(float)
    first, second, previous = moments(1 - upper), moments(upper), None
    for _ in range(iterations):
        logs = [math.log(w) - 0.5 * math.log(2 * math.pi * v) - np.square(m - mean) / (2 * v) for w, mean, v in (first, second)]
        both = np.logaddexp(*logs)
        share = np.exp(logs[1] - both)
        likelihood = float((n * both).sum()) / total
        first, second = moments(1 - share), moments(share)
        if previous is not None and abs(likelihood - previous) < tolerance:
            break
        previous = likelihood
    return (*first, *second) if first[1] <= second[1] else (*second, *first)


def fit_mixture(
    scored: DataFrame, by: list[str] = ("dataset_name",), tolerance: float = 1e-3, iterations: int = 100
) -> DataFrame:
    """Two normal components per group, fitted by expectation-maximisation; component 1 has the larger mean.

    A group's scores are counted into a mergeable summary, whose size does not follow the number of rows, and
    all iterations run in the task that holds it: one job for any number of groups.
    """
    by = list(by)
    rows = scored.where("score IS NOT NULL").select(*by, "score")
    spread = rows.groupBy(*by).agg(F.avg("score").alias("_mean"), F.stddev_pop("score").alias("_sd"))
    if by:
        placed = null_safe_join(rows, materialise(spread, "spreads"), by)
    else:
        placed = rows.withColumns({c: F.lit(v).cast("double") for c, v in spread.first().asDict().items()})
    summary = _summaries(placed, by, "score", "IF(_sd > 0, 8D * (score - _mean) / _sd, 0D)")

    def fit(group: pd.DataFrame) -> tuple:
        n, m, s = (group[c].to_numpy() for c in "nms")
        return mixture_of_bins(n, m, np.maximum(s, 0.0), tolerance, iterations)

    return materialise(_fitted(summary, by, [], fit, _PARAMETERS), "mixture")


def mixture_posterior(scored: DataFrame, mixture: DataFrame, by: list[str] = ("dataset_name",), output: str = "anomaly_probability") -> DataFrame:
    """Probability that a score belongs to the component with the larger mean."""
    if not by:
        fitted = mixture.first().asDict()
        joined = scored.withColumns({c: F.lit(fitted[c]) for c in _PARAMETERS})
    else:
        joined = null_safe_join(scored, mixture, list(by))
    return joined.withColumn(output, F.expr(posterior_sql())).drop(*_PARAMETERS)


def mixture_flags(scored: DataFrame, by: list[str] = ("dataset_name",), cut: float = 0.90, output: str = "predicted") -> DataFrame:
    """Flag rows whose posterior reaches the cut."""
    found = mixture_posterior(scored, fit_mixture(scored, by), by)
    return found.withColumn(output, (F.col("anomaly_probability") >= cut).cast("int"))
