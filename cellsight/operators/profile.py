"""Column profiles, correlation, feature selection and discriminative power."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from cellsight.operators.quantiles import exact_quantiles, quantile_values
from cellsight.operators.ranking import running_totals
from cellsight.session import materialise
from cellsight.sources.schema import KPI_KEYWORDS, double, literal, numeric_columns, quoted

PROFILE_QUANTILES = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p95": 0.95, "p99": 0.99}
CORRELATION_LIMIT = 0.95
VARIANCE_LIMIT = 0.0
OVERLAP_BINS = 50
INFORMATION_BINS = 20


def _inline(df: DataFrame, columns: list[str], fields: dict[str, str]) -> DataFrame:
    """Turn one wide row into one row per column; a field is the ending of a column of the wide row."""
    structs = ", ".join(
        "struct(" + ", ".join([f"{literal(c)} AS feature"] + [f"{quoted(c + end)} AS {n}" for n, end in fields.items()]) + ")"
        for c in columns
    )
    return df.selectExpr(f"inline(array({structs}))")


def unpivot(df: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """Rows (keep..., feature, value), missing values left out."""
    cells = ", ".join(f"struct({literal(c)} AS feature, {double(c)} AS value)" for c in columns)
    return df.selectExpr(*keep, f"inline(array({cells}))").where("value IS NOT NULL")


def central_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (feature, n, mean, m2, m3, m4, min, max): sums of powers of the deviations from the mean, up to the fourth.

    A task returns one state per column, built batch by batch around the batch's own mean; states of any parts merge by
    shifting them to the common mean, so nothing cancels.
    """
    names = [f"c{i}" for i in range(len(columns))]
    numbers = df.selectExpr(*[f"{double(c)} AS {n}" for n, c in zip(names, columns)])

    def shifted(n, mean, m2, m3, m4, centre):
        d = mean - centre
        return m2 + n * d**2, m3 + 3 * d * m2 + n * d**3, m4 + 4 * d * m3 + 6 * d**2 * m2 + n * d**4

    def state(batches):
        total = None
        for batch in batches:
            x = batch.to_numpy(dtype=float)
            n = (~np.isnan(x)).sum(axis=0)
            with np.errstate(invalid="ignore", divide="ignore"):
                mean = np.where(n > 0, np.nansum(x, axis=0) / np.maximum(n, 1), 0.0)
                d = np.nan_to_num(x - mean)
            low, high = np.where(np.isnan(x), np.inf, x).min(axis=0, initial=np.inf), np.where(np.isnan(x), -np.inf, x).max(axis=0, initial=-np.inf)
            part = [n.astype(float), mean, (d**2).sum(axis=0), (d**3).sum(axis=0), (d**4).sum(axis=0), low, high]
            if total is None:
                total = part
                continue
            count = total[0] + part[0]
            centre = np.where(count > 0, (total[0] * total[1] + part[0] * part[1]) / np.maximum(count, 1), 0.0)
            sums = [a + b for a, b in zip(shifted(*total[:5], centre), shifted(*part[:5], centre))]
            total = [count, centre, *sums, np.minimum(total[5], low), np.maximum(total[6], high)]
        if total is not None:
            yield pd.DataFrame({"place": np.arange(len(columns)), **dict(zip(("n", "mean", "m2", "m3", "m4", "low", "high"), total))})

    parts = materialise(numbers.mapInPandas(state, "place int, n double, mean double, m2 double, m3 double, m4 double, low double, high double"), "moments")
    parts = parts.where("n > 0")
    centres = parts.groupBy("place").agg(F.expr("sum(n * mean) / sum(n)").alias("centre"))
    d = "(mean - centre)"
    merged = parts.join(centres, "place").groupBy("place", "centre").agg(
        F.sum("n").alias("n"),
        F.expr(f"sum(m2 + n * {d} * {d})").alias("m2"),
        F.expr(f"sum(m3 + 3D * {d} * m2 + n * pow({d}, 3))").alias("m3"),
        F.expr(f"sum(m4 + 4D * {d} * m3 + 6D * {d} * {d} * m2 + n * pow({d}, 4))").alias("m4"),
        F.min("low").alias("min"),
        F.max("high").alias("max"),
    )
    feature = "array(" + ", ".join(map(literal, columns)) + ")[place] AS feature"
    return merged.selectExpr(feature, "n", "centre AS mean", "m2", "m3", "m4", "min", "max")


def kpi_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, deviation, range, quantiles, skewness and excess kurtosis per column."""
    numbers = df.selectExpr(*[f"{double(c)} AS {quoted(c)}" for c in columns])
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    long = names.join(central_moments(numbers, columns), "feature", "left").selectExpr(
        "feature", "mean", "sqrt(IF(n > 1, m2 / (n - 1), NULL)) AS std", "min", "max",
        "IF(m2 > 0, sqrt(n) * m3 / pow(m2, 1.5D), NULL) AS skewness", "IF(m2 > 0, n * m4 / (m2 * m2) - 3D, NULL) AS kurtosis",
    )
    quantiles = exact_quantiles(numbers, {c: list(PROFILE_QUANTILES.values()) for c in columns})
    named = quantiles.groupBy("feature").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for n, p in PROFILE_QUANTILES.items()]
    )
    return long.join(named, "feature", "left").select(
        "feature", "mean", "std", "min", *PROFILE_QUANTILES, "max", "skewness", "kurtosis"
    )


def pair_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (feature_a, feature_b, position_a, position_b, corr, cov) for all pairs with a <= b.

    One matrix product per Arrow batch gives the sums of all pairs at once; each task returns one row
    per pair.  Columns are centred on their means first, so that the sums keep their precision.
    Rows with a missing value in either column do not count for the pair.
    """
    numbers = df.selectExpr(*[f"{double(c)} AS c{i}" for i, c in enumerate(columns)])
    means = numbers.selectExpr(*[f"avg({c}) AS {c}" for c in numbers.columns]).first()
    centre = np.array([m if m is not None else 0.0 for m in means])
    i, j = np.triu_indices(len(columns))

    def products(batches):
        total = None
        for batch in batches:
            x = batch.to_numpy(dtype=float) - centre
            seen = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            part = np.stack([seen.T @ seen, x.T @ seen, seen.T @ x, x.T @ x, (x * x).T @ seen, seen.T @ (x * x)])
            total = part if total is None else total + part
        if total is not None:
            cells = total[:, i, j]
            yield pd.DataFrame(
                {"i": i, "j": j, "n": cells[0], "sa": cells[1], "sb": cells[2], "sab": cells[3], "saa": cells[4], "sbb": cells[5]}
            )

    sums = (
        numbers.mapInPandas(products, "i int, j int, n double, sa double, sb double, sab double, saa double, sbb double")
        .groupBy("i", "j")
        .agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "sab", "saa", "sbb")])
    )
    names = "array(" + ", ".join(map(literal, columns)) + ")"
    cov = "sab - try_divide(sa * sb, n)"
    spread = "sqrt(greatest(saa - try_divide(sa * sa, n), 0D) * greatest(sbb - try_divide(sb * sb, n), 0D))"
    return sums.selectExpr(
        f"{names}[i] AS feature_a",
        f"{names}[j] AS feature_b",
        "i AS position_a",
        "j AS position_b",
        f"try_divide({cov}, {spread}) AS corr",
        f"try_divide({cov}, n - 1) AS cov",
    )


def corr_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every ordered pair."""
    return _mirror(pair_moments(df, columns), "corr")


def cov_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sample covariance of every ordered pair."""
    return _mirror(pair_moments(df, columns), "cov")


def _mirror(pairs: DataFrame, value: str) -> DataFrame:
    forward = pairs.select("feature_a", "feature_b", value)
    back = pairs.where("position_a <> position_b").select(
        F.col("feature_b").alias("feature_a"), F.col("feature_a").alias("feature_b"), value
    )
    return forward.unionByName(back)


def top_correlations(df: DataFrame, columns: list[str], k: int = 15) -> DataFrame:
    """The k strongest absolute correlations between different columns."""
    return (
        pair_moments(df, columns)
        .where("position_a < position_b AND corr IS NOT NULL")
        .select("feature_a", "feature_b", F.abs("corr").alias("strength"))
        .orderBy(F.desc("strength"), "feature_a", "feature_b")
        .limit(k)
    )


def is_kpi(name: str) -> bool:
    return any(word in name.lower() for word in KPI_KEYWORDS)


def kpi_columns(features: DataFrame, name: str = "feature") -> DataFrame:
    """Rows of a feature table whose name contains a KPI word."""
    return features.where(F.lower(name).rlike("|".join(map(re.escape, KPI_KEYWORDS))))


def variances(df: DataFrame, columns: list[str]) -> DataFrame:
    """Population variance per column; null for a column without values."""
    wide = df.selectExpr(*[f"var_pop({double(c)}) AS {quoted(c)}" for c in columns])
    return _inline(wide, columns, {"variance": ""})


def variance_filter(df: DataFrame, columns: list[str], limit: float = VARIANCE_LIMIT) -> DataFrame:
    """Columns whose population variance exceeds the limit."""
    return variances(df, columns).where(F.col("variance") > limit)


def corr_prune(df: DataFrame, columns: list[str], protected: list[str], limit: float = CORRELATION_LIMIT) -> DataFrame:
    """Names of unprotected columns that correlate above the limit with an earlier column."""
    return (
        pair_moments(df, columns)
        .where((F.col("position_a") < F.col("position_b")) & (F.abs("corr") > limit))
        .where(~F.col("feature_b").isin(protected) if protected else F.lit(True))
        .select(F.col("feature_b").alias("feature"))
        .distinct()
    )


def select_features(
    df: DataFrame, variance_limit: float = VARIANCE_LIMIT, correlation_limit: float = CORRELATION_LIMIT
) -> tuple[list[str], DataFrame]:
    """Chosen column names and the report; the names collected here are bounded by the schema."""
    numeric = numeric_columns(df)
    kept = {row["feature"] for row in variance_filter(df, numeric, variance_limit).collect()}
    varied = [c for c in numeric if c in kept]
    kpis = [c for c in varied if is_kpi(c)]
    dropped = (
        {row["feature"] for row in corr_prune(df, varied, kpis, correlation_limit).collect()} if len(varied) > 1 else set()
    )
    selected = [c for c in varied if c not in dropped]
    low = [c for c in numeric if c not in kept]
    return selected, feature_report(df, selected, low, sorted(dropped), kpis)


def feature_report(
    df: DataFrame, selected: list[str], low_variance: list[str], correlated: list[str], kpis: list[str]
) -> DataFrame:
    """Type, missing count, sample variance, KPI mark and decision of every column."""
    numeric = set(numeric_columns(df))
    decisions = {c: "removed_low_variance" for c in low_variance}
    decisions |= {c: "removed_high_correlation" for c in correlated}
    decisions |= {c: "selected" for c in selected}
    aggregates = []
    for c in df.columns:
        value = double(c) if c in numeric else quoted(c)
        aggregates.append(f"count_if({value} IS NULL) AS {quoted(c + '__missing')}")
        aggregates.append(f"{f'var_samp({value})' if c in numeric else 'CAST(NULL AS DOUBLE)'} AS {quoted(c + '__variance')}")
    types = dict(df.dtypes)
    cells = ", ".join(
        f"struct({literal(c)} AS feature, '{types[c]}' AS dtype, {quoted(c + '__missing')} AS missing_count, {quoted(c + '__variance')} AS variance, "
        f"{str(c in set(kpis)).lower()} AS is_kpi, '{decisions.get(c, 'not_numeric_or_excluded')}' AS decision)"
        for c in df.columns
    )
    return df.selectExpr(*aggregates).selectExpr(f"inline(array({cells}))")


def score_histogram(scored: DataFrame, score: str = "score", label: str | None = "label", bins: int = 45) -> DataFrame:
    """Counts per equal-width bin over the range of the scores, per class if a label is given.

    The last bin includes its upper end; empty bins are kept with zero.
    """
    spark = scored.sparkSession
    ends = scored.agg(F.min(score).alias("low"), F.max(score).alias("high")).first()
    low, high = _widen(ends["low"], ends["high"])
    width = (high - low) / bins
    value = F.col(score)
    bin_no = F.least(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    keys = ["bin"] + ([label] if label else [])
    counts = scored.where(value.isNotNull()).select(bin_no.alias("bin"), *keys[1:]).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n")
    )
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    if label:
        grid = grid.select("bin", F.explode(F.array(F.lit(0), F.lit(1))).alias(label))
    full = grid.join(counts, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n"))
    result = full.select(
        *keys, (F.lit(low) + F.col("bin") * width).alias("lower"), (F.lit(low) + (F.col("bin") + 1) * width).alias("upper"), "n"
    )
    if label:
        totals = scored.where(value.isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_total"))
        result = result.join(totals, label, "left").select(
            *result.columns, F.coalesce(F.col("n") / (F.col("_total") * width), F.lit(0.0)).alias("density")
        )
    return result


def _widen(low: float, high: float) -> tuple[float, float]:
    """A range without extent becomes one of width 1 around its value."""
    return (low - 0.5, high + 0.5) if low == high else (low, high)


def _class_bins(df: DataFrame, columns: list[str], label: str, place) -> DataFrame:
    """Counts (feature, bin, label, n) of binned columns.

    `place(column, values)` gives bin numbers, negative outside all bins.  Each task counts its
    batches first, so it returns at most columns x bins x 2 rows.
    """
    numbers = df.where(F.col(label).isNotNull()).selectExpr(
        f"CAST({label} AS INT) AS _class", *[f"{double(c)} AS c{i}" for i, c in enumerate(columns)]
    )

    def count(batches):
        totals: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            classes = batch["_class"].to_numpy()
            for i, c in enumerate(columns):
                v = batch[f"c{i}"].to_numpy(dtype=float)
                bins = np.full(len(v), -1)
                known = ~np.isnan(v)
                bins[known] = place(c, v[known])
                for k in np.unique(classes):
                    found = np.bincount(bins[(classes == k) & (bins >= 0)])
                    before = totals.get((c, k))
                    if before is not None:
                        size = max(len(before), len(found))
                        found = np.pad(found, (0, size - len(found))) + np.pad(before, (0, size - len(before)))
                    totals[c, k] = found
        for (c, k), found in totals.items():
            used = np.flatnonzero(found)
            yield pd.DataFrame({"feature": c, "bin": used.astype("int32"), label: np.int32(k), "n": found[used]})

    return (
        numbers.mapInPandas(count, f"feature string, bin int, {label} int, n long")
        .groupBy("feature", "bin", label)
        .agg(F.sum("n").alias("n"))
    )


def histogram_overlap(df: DataFrame, columns: list[str], label: str = "label", bins: int = OVERLAP_BINS) -> DataFrame:
    """Shared area of the normal and anomalous densities over bins of the normal range.

    The anomalous density is normalised within that range; without anomalies in range it is null.
    """
    row = df.where(F.col(label) == 0).selectExpr(
        *[f"{f}({double(c)}) AS {quoted(f'{c}__{f}')}" for c in columns for f in ("min", "max")]
    ).first()
    ranges = {c: _widen(row[f"{c}__min"], row[f"{c}__max"]) for c in columns if row[f"{c}__min"] is not None}

    def place(c: str, v: np.ndarray) -> np.ndarray:
        low, high = ranges[c]
        at = np.minimum(np.floor((v - low) / ((high - low) / bins)), bins - 1)
        return np.where((v >= low) & (v <= high), at, -1).astype(int)

    binned = materialise(_class_bins(df, list(ranges), label, place), "bins")
    counts = binned.groupBy("feature", "bin").agg(
        F.sum(F.when(F.col(label) == 0, F.col("n")).otherwise(0)).alias("normal"),
        F.sum(F.when(F.col(label) == 1, F.col("n")).otherwise(0)).alias("anomalous"),
    )
    totals = counts.groupBy("feature").agg(F.sum("normal").alias("_normal"), F.sum("anomalous").alias("_anomalous"))
    # Density times width is the share of the class in the bin.
    shares = counts.join(totals, "feature").selectExpr(
        "feature", "least(try_divide(normal, _normal), try_divide(anomalous, _anomalous)) AS shared", "_anomalous"
    )
    return shares.groupBy("feature").agg(
        F.expr("IF(max(_anomalous) = 0, NULL, sum(shared))").alias("distribution_overlap")
    )


def class_separation(df: DataFrame, columns: list[str], label: str = "label") -> DataFrame:
    """Distance of the class means in units of the pooled population deviation."""
    moments = unpivot(df, columns, [label]).groupBy("feature").agg(
        *[
            F.expr(f"{f}(value) FILTER (WHERE {label} = {k})").alias(f"{f}{k}")
            for f in ("avg", "var_pop")
            for k in (0, 1)
        ]
    )
    distance = "abs(avg1 - avg0) / (sqrt((var_pop1 + var_pop0) / 2D) + 1e-9D)"
    return moments.select("feature", F.expr(distance).alias("anomaly_separation_power"))


def mutual_information(df: DataFrame, columns: list[str], label: str = "label", bins: int = INFORMATION_BINS) -> DataFrame:
    """Information between each feature, cut at its quantiles, and the label, over all rows."""
    steps = [k / bins for k in range(1, bins)]
    found = exact_quantiles(df, {c: steps for c in columns})
    edges: dict[str, set[float]] = {c: set() for c in columns}
    for row in found.collect():  # columns x (bins - 1) rows
        edges[row["feature"]].add(row["value"])
    cuts = {c: np.array(sorted(e)) for c, e in edges.items()}
    counts = materialise(_class_bins(df, columns, label, lambda c, v: np.searchsorted(cuts[c], v, side="left")), "bins")
    by_bin = counts.groupBy("feature", "bin").agg(F.sum("n").alias("n_bin"))
    by_label = counts.groupBy("feature", label).agg(F.sum("n").alias("n_label"))
    total = counts.groupBy("feature").agg(F.sum("n").alias("n_all"))
    joined = counts.join(by_bin, ["feature", "bin"]).join(by_label, ["feature", label]).join(total, "feature")
    term = "n / n_all * ln(CAST(n AS DOUBLE) * n_all / (CAST(n_bin AS DOUBLE) * n_label))"
    return joined.groupBy("feature").agg(F.expr(f"sum({term})").alias("mutual_information"))


def _digamma(x: str) -> str:
    """SQL for the digamma function of a whole number of 1 or more: the recurrence up to x + 8, then its asymptotic series."""
    y = f"({x} + 8D)"
    steps = " - ".join(f"1D / ({x} + {i}D)" for i in range(8))
    return f"(ln{y} - 0.5D / {y} - 1D / (12D * {y} * {y}) + 1D / (120D * pow({y}, 4)) - 1D / (252D * pow({y}, 6)) + 1D / (240D * pow({y}, 8)) - {steps})"


def neighbour_information(df: DataFrame, columns: list[str], label: str = "label", k: int = 3) -> DataFrame:
    """Information between each feature and the label from nearest neighbours in one dimension, over all rows.

    For each value the distance to the k-th neighbour of its class is compared with the number of all values that lie nearer;
    nothing is cut into bins.  Equal values are at distance zero; classes of one row are left out, and small classes use as
    many neighbours as they have.  Values are first counted, then numbered within their class by distributed running totals,
    so a value's neighbours are found by their numbers wherever they lie, and the counts inside a radius are
    differences of running totals at its two ends.
    """
    counted = unpivot(df, columns, [label]).where(F.col("value").isNotNull() & F.col(label).isNotNull())
    counted = counted.select("feature", F.col(label).alias("class"), (F.col("value") + 0.0).alias("value"))
    counted = materialise(counted.groupBy("feature", "class", "value").agg(F.count(F.lit(1)).alias("n")), "values")
    numbered = running_totals(counted.withColumn("one", F.lit(1).cast("long")), ["feature", "class"], ["value"], ["n", "one"])
    numbered = numbered.where("total_n > 1").withColumn("k", F.least(F.lit(k), F.col("total_n") - 1).cast("int"))
    numbered = materialise(numbered.select("feature", "class", "value", "n", "k", F.col("total_n").alias("size"), F.col("before_one").alias("place")), "numbered")

    # Every value sends itself to the k values on both sides of it; 2k + 1 values meet at each.
    sent = numbered.select("feature", "class", F.explode(F.sequence(F.col("place") - k, F.col("place") + k)).alias("place"), F.struct("value", "n").alias("near"))
    near = sent.groupBy("feature", "class", "place").agg(F.sort_array(F.collect_list("near")).alias("near"))
    at = numbered.join(near, ["feature", "class", "place"])
    listed = at.withColumn("e", F.expr(f"flatten(transform(near, x -> array_repeat(x.value, CAST(least(x.n, {k + 1}) AS INT))))")).withColumn("p", F.expr("array_position(e, value)"))
    # The least, over the runs of k + 1 neighbours that hold the value, of the run's further end.
    runs = "transform(sequence(0, k), j -> IF(p - j >= 1 AND p + k - j <= size(e), greatest(value - try_element_at(e, CAST(p - j AS INT)), try_element_at(e, CAST(p + k - j AS INT)) - value), NULL))"
    radius = materialise(listed.selectExpr("feature", "class", "value", "n", "k", "size", f"array_min({runs}) * (1D - 1e-9D) AS radius"), "radii")

    points = radius.groupBy("feature", "value").agg(F.sum("n").alias("n")).selectExpr("feature", "value AS at", "0 AS side", "CAST(NULL AS DOUBLE) AS value", f"CAST(NULL AS {radius.schema['class'].dataType.simpleString()}) AS class", "n")
    ends = [radius.selectExpr("feature", f"value {sign} radius AS at", f"{side} AS side", "value", "class", "0L AS n") for sign, side in (("-", -1), ("+", 1))]
    totals = running_totals(points.unionByName(ends[0]).unionByName(ends[1]), ["feature"], ["at", "side", "value", "class"], ["n"])
    inside = totals.where("side <> 0").groupBy("feature", "class", "value").agg(F.sum(F.col("side") * F.col("before_n")).cast("double").alias("m"))
    terms = radius.join(inside, ["feature", "class", "value"])
    everything = "CAST(sum(n) AS DOUBLE)"
    found = terms.groupBy("feature").agg(
        F.expr(f"{everything} AS total"),
        F.expr(f"sum(n * ({_digamma('k')} - {_digamma('size')} - {_digamma('m')})) / {everything} AS part"),
    )
    return found.selectExpr("feature", f"greatest(0D, {_digamma('total')} + part) AS mutual_information")


def feature_power(df: DataFrame, columns: list[str], label: str = "label") -> DataFrame:
    """Variance, information, separation, overlap and their combined score per feature."""
    return (
        variances(df, columns)
        .join(mutual_information(df, columns, label), "feature", "left")
        .join(class_separation(df, columns, label), "feature", "left")
        .join(histogram_overlap(df, columns, label), "feature", "left")
        .withColumn(
            "discriminative_score",
            F.expr("mutual_information + anomaly_separation_power + (1D - distribution_overlap)"),
        )
    )


def select_by_power(power: DataFrame, base: list[str], limit: int = 72) -> DataFrame:
    """Base features and those above the median score of the base, strongest first, at most `limit`."""
    in_base = F.col("feature").isin(base)
    middle = quantile_values(power.where(in_base), {"m": ("discriminative_score", 0.5)})["m"]
    return (
        power.where(in_base | (F.col("discriminative_score") > F.lit(middle)))
        .orderBy(F.desc_nulls_last("discriminative_score"), "feature")
        .limit(limit)
    )


# Business meaning and usefulness by word in the feature name, first match wins.
MEANINGS = {
    "latency": "Service delay and responsiveness",
    "packet_loss": "Packet delivery reliability",
    "throughput": "Traffic carrying performance",
    "prb": "Radio resource utilization",
    "active_users": "Cell user load",
    "rsrp": "Radio signal strength",
    "rsrq": "Radio signal quality",
    "spectral": "Radio efficiency",
    "handover": "Mobility stability",
    "congestion": "Load and capacity pressure",
    "service_degradation": "Combined latency/loss/throughput degradation",
    "radio_quality": "Combined signal health",
    "urllc": "URLLC slice SLA pressure",
    "embb": "eMBB capacity pressure",
}
OTHER_MEANING = "General telecom operating context"
USES = [
    (["latency", "packet_loss"], "Captures service degradation and transport instability."),
    (["throughput", "spectral"], "Highlights capacity loss and radio efficiency collapse."),
    (["rsrp", "rsrq"], "Detects coverage and signal-quality degradation."),
    (["active_users", "prb", "congestion"], "Identifies load pressure, resource saturation, and congestion."),
    (["slice"], "Separates slice-specific behavior and SLA risk."),
]
OTHER_USE = "Provides contextual separation for anomalous telecom states."


def feature_taxonomy(features: DataFrame, name: str = "feature") -> DataFrame:
    """Type, business meaning and usefulness text of each feature name."""
    column, lowered = F.col(name), F.lower(F.col(name))
    kind = (
        F.when(column.rlike("^(cell_type_|slice_type_)"), "encoded_categorical")
        .when(column.rlike("_z$|ratio|index|_x_|_per_"), "engineered_numeric")
        .otherwise("numeric")
    )
    meaning, use = None, None
    for word, text in MEANINGS.items():
        meaning = F.when(lowered.contains(word), text) if meaning is None else meaning.when(lowered.contains(word), text)
    for words, text in USES:
        test = lowered.rlike("|".join(words))
        use = F.when(test, text) if use is None else use.when(test, text)
    return features.withColumns(
        {
            "feature_type": kind,
            "business_interpretation": meaning.otherwise(OTHER_MEANING),
            "usefulness_reason": use.otherwise(OTHER_USE),
        }
    )


def power_report(features: DataFrame, power: DataFrame) -> DataFrame:
    """Attach power and rank to production features; unknown ones get 0 and the rank after the last."""
    # Both tables have one row per feature.
    ranked = power.select(
        "feature",
        F.row_number().over(Window.orderBy(F.desc_nulls_last("discriminative_score"), "feature")).cast("long").alias("_rank"),
        "discriminative_score",
    )
    count = features.count()
    return features.join(ranked, "feature", "left").select(
        *features.columns,
        F.coalesce("_rank", F.lit(count + 1)).alias("importance_rank"),
        F.coalesce("discriminative_score", F.lit(0.0)).alias("discriminative_power"),
    )
