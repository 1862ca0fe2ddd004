"""From raw detector scores to risk labels, fused scores, drivers and the production output."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cellsight.operators.quantiles import exact_quantiles, quantile_values
from cellsight.operators.ranking import percentile_rank
from cellsight.sources.schema import literal, quoted, require_columns

# Risk limits, fusion weights, offsets of the score columns and driver weights.
RISK_STATUS = [(0.30, "Healthy"), (0.60, "Moderate Risk")]
TOP_RISK = "High Risk"
HIGH_RISK_SCORE = 0.75
CONTAMINATIONS = [0.01, 0.03, 0.05, 0.10, 0.15]
FUSION_WEIGHTS = [0.15, 0.20, 0.25, 0.22, 0.18]
DRIVER_WEIGHTS = (0.65, 0.35)
DRIVER_FEATURES = [
    "latency_ms",
    "packet_loss_pct",
    "throughput_mbps",
    "handover_count",
    "rsrp_dbm",
    "rsrq_db",
    "prb_utilization_pct",
    "active_users",
    "throughput_per_user",
    "spectral_efficiency",
    "service_degradation_index",
    "congestion_pressure_index",
    "radio_quality_index",
]
# Candidate family -> condition on scaled KPIs; the first that holds is taken.
FAMILIES = [
    ("Congestion", "{prb_utilization_pct} > {active_users} AND {latency_ms} > 0"),
    ("Coverage", "{rsrp_dbm} < -0.75 OR {rsrq_db} < -0.75"),
    ("Capacity", "{active_users} > 1 AND {throughput_per_user} < -0.5"),
    ("Signal Quality", "{rsrq_db} < -0.75 OR {spectral_efficiency} < -0.75"),
    ("Transport", "{latency_ms} > 1 AND {packet_loss_pct} > 1"),
    ("User Surge", "{active_users} > 1"),
]
UNKNOWN_FAMILY = "Unknown"


def fit_score_range(scored: DataFrame, score: str = "score") -> tuple[float, float]:
    row = scored.agg(F.min(score).alias("low"), F.max(score).alias("high")).first()
    return row["low"], row["high"]


def risk_normalize(scored: DataFrame, score: str = "score", output: str = "risk", floor: float = 0.0) -> DataFrame:
    """Scores scaled to 0..1 by their range; `floor` is added to the range, equal scores give 0."""
    low, high = fit_score_range(scored, score)
    if low is None:
        raise ValueError("cannot normalise an empty score table")
    if floor == 0.0 and abs(high - low) <= 1e-8 + 1e-5 * abs(low):
        return scored.withColumn(output, F.lit(0.0))
    return scored.withColumn(output, (F.col(score) - F.lit(low)) / F.lit(high - low + floor))


def risk_status(score: str = "anomaly_score") -> str:
    steps = " ".join(f"WHEN {score} <= {limit}D THEN '{name}'" for limit, name in RISK_STATUS)
    return f"CASE {steps} ELSE '{TOP_RISK}' END"


def score_table(scored: DataFrame, key: str = "record_id", risk: str = "risk", predicted: str | None = None) -> DataFrame:
    """Key, rounded score, status and, if given, the anomaly flag."""
    table = scored.select(F.col(key).alias("record_id"), F.bround(risk, 4).alias("anomaly_score"), *([predicted] if predicted else []))
    table = table.withColumn("status", F.expr(risk_status()))
    columns = ["record_id", "anomaly_score", "status"]
    if predicted:
        table = table.withColumn("is_anomaly", F.col(predicted).cast("int"))
        columns.append("is_anomaly")
    return table.select(*columns)


def json_records(table: DataFrame) -> DataFrame:
    """One JSON text per row with the three result columns."""
    columns = ["record_id", "anomaly_score", "status"]
    require_columns(table, columns, "score table")
    return table.select(F.to_json(F.struct(*columns)).alias("record"))


def score_summary(table: DataFrame) -> DataFrame:
    """Totals, score range, counts per status and the anomaly rate, as one row."""
    statuses = [name for _, name in RISK_STATUS] + [TOP_RISK]
    aggregates = [
        F.count(F.lit(1)).alias("total_records"),
        F.avg("anomaly_score").alias("mean_anomaly_score"),
        F.max("anomaly_score").alias("max_anomaly_score"),
        F.min("anomaly_score").alias("min_anomaly_score"),
        *[F.count_if(F.col("status") == s).alias(s) for s in statuses],
    ]
    if "is_anomaly" in table.columns:
        aggregates += [
            F.sum(F.col("is_anomaly").cast("long")).alias("predicted_anomalies"),
            F.avg(F.col("is_anomaly").cast("double")).alias("predicted_anomaly_rate"),
        ]
    row = table.agg(*aggregates)
    entries = F.map_from_arrays(F.array(*map(F.lit, statuses)), F.array(*[F.col(s) for s in statuses]))
    present = F.map_filter(entries, lambda _, n: n > 0)
    return row.withColumn("status_counts", present).drop(*statuses)


def anomaly_summary(output: DataFrame) -> DataFrame:
    """One-row summary of the production output with the risk distribution as a map."""
    levels = ["Healthy", "Moderate Risk", "High Risk"]
    row = output.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.sum(F.col("is_anomaly").cast("long")).alias("total_anomalies"),
        F.bround(F.avg(F.col("is_anomaly").cast("double")) * 100, 4).alias("anomaly_percentage"),
        F.bround(F.avg("ensemble_score"), 6).alias("average_score"),
        F.bround(F.max("ensemble_score"), 6).alias("maximum_score"),
        F.bround(F.min("ensemble_score"), 6).alias("minimum_score"),
        *[F.count_if(F.col("risk_level") == s).alias(s) for s in levels],
    )
    entries = F.map_from_arrays(F.array(*map(F.lit, levels)), F.array(*[F.col(s) for s in levels]))
    return row.withColumn("risk_level_distribution", F.map_filter(entries, lambda _, n: n > 0)).drop(*levels)


def risk_level(normalized: str = "normalized_score", flag: str = "is_anomaly") -> str:
    return (
        f"CASE WHEN {flag} = 1 AND {normalized} >= {HIGH_RISK_SCORE}D THEN 'High Risk' "
        f"WHEN {flag} = 1 THEN 'Moderate Risk' ELSE 'Healthy' END"
    )


def family_candidate(df: DataFrame, flag: str = "is_anomaly") -> str:
    """SQL for the candidate family of flagged rows; a missing column counts as 0."""
    value = {
        c: f"CAST({c} AS DOUBLE)" if c in df.columns else "0D"
        for c in (
            "prb_utilization_pct", "active_users", "latency_ms", "rsrp_dbm", "rsrq_db",
            "throughput_per_user", "spectral_efficiency", "packet_loss_pct",
        )
    }
    steps = " ".join(f"WHEN {test.format(**value)} THEN '{name}'" for name, test in FAMILIES)
    return f"IF({flag} = 1, CASE {steps} ELSE '{UNKNOWN_FAMILY}' END, '{UNKNOWN_FAMILY}')"


def fit_deviation(df: DataFrame, features: list[str] = DRIVER_FEATURES) -> dict[str, dict[str, float]]:
    """Mean, sample deviation, median and interquartile range; a zero spread becomes 1e-6."""
    present = [c for c in features if c in df.columns]
    quartiles = quantile_values(df, {f"{c}|{p}": (c, p) for c in present for p in (0.25, 0.5, 0.75)})
    row = df.selectExpr(*[f"{f}({quoted(c)}) AS {quoted(f'{c}__{f}')}" for c in present for f in ("avg", "stddev_samp")]).first()
    return {
        c: {
            "mean": row[f"{c}__avg"],
            "sd": row[f"{c}__stddev_samp"] or 1e-6,
            "median": quartiles[f"{c}|0.5"],
            "iqr": (quartiles[f"{c}|0.75"] - quartiles[f"{c}|0.25"]) or 1e-6,
        }
        for c in present
        if row[f"{c}__avg"] is not None
    }


def top_drivers(df: DataFrame, reference: dict[str, dict[str, float]], flag: str = "is_anomaly") -> DataFrame:
    """The three features that deviate most in flagged rows, with their deviation; padding otherwise.

    The features of a row are ordered inside the row, so nothing is exploded or shuffled.
    """
    cells = []
    for position, (c, s) in enumerate(reference.items()):
        z = f"abs(({quoted(c)} - {s['mean']!r}D) / {s['sd']!r}D)"
        robust = f"abs(({quoted(c)} - {s['median']!r}D) / {s['iqr']!r}D)"
        deviation = f"{DRIVER_WEIGHTS[0]}D * {z} + {DRIVER_WEIGHTS[1]}D * {robust}"
        cells.append(f"struct(-({deviation}) AS less, {position} AS position, {literal(c)} AS name)")
    ranked = f"IF({flag} = 1, slice(array_sort(array({', '.join(cells)})), 1, 3), NULL)"
    staged = df.withColumn("_drivers", F.expr(ranked))
    columns = {}
    for i, name in enumerate(["primary_driver", "secondary_driver", "tertiary_driver"]):
        columns[name] = F.expr(f"coalesce(get(_drivers, {i}).name, '')")
        columns[f"driver_{i + 1}_deviation"] = F.expr(f"bround(coalesce(-get(_drivers, {i}).less, 0D), 6)")
    return staged.withColumns(columns).drop("_drivers")


def ensemble_scores(scored: DataFrame, offsets: dict[str, float], score: str = "score") -> DataFrame:
    """One column per contamination: the same forest score moved by that contamination's offset."""
    return scored.withColumns({name: F.col(score) + F.lit(offset) for name, offset in offsets.items()})


def fit_offsets(scored: DataFrame, contaminations: list[float] = CONTAMINATIONS, score: str = "score") -> dict[str, float]:
    """Offset per contamination: that quantile of the negated training scores."""
    return fit_offsets_of(scored, [score], contaminations)[score]


def fit_offsets_of(scored: DataFrame, scores: list[str], contaminations: list[float] = CONTAMINATIONS) -> dict[str, dict[str, float]]:
    """The offsets of several score columns, selected together."""
    negated = scored.select(*[(-F.col(quoted(c))).alias(f"negated_{i}") for i, c in enumerate(scores)])
    named = {f"{i}|score_{round(c * 100)}": (f"negated_{i}", c) for i in range(len(scores)) for c in contaminations}
    found = quantile_values(negated, named)
    return {name: {f"score_{round(c * 100)}": found[f"{i}|score_{round(c * 100)}"] for c in contaminations} for i, name in enumerate(scores)}


def score_fusion(scored: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """Weighted mean, mean and maximum of the percentile ranks of the score columns, within `by`.

    A column that is named more than once is ranked once.
    """
    ranked = scored
    for c in dict.fromkeys(columns):
        ranked = percentile_rank(ranked, c, f"_rank_{c}", by)
    ranks = [F.col(f"_rank_{c}") for c in columns]
    weighted = sum((r * F.lit(w) for r, w in zip(ranks[1:], FUSION_WEIGHTS[1:])), ranks[0] * F.lit(FUSION_WEIGHTS[0]))
    return ranked.select(
        *scored.columns,
        weighted.alias("weighted_average"),
        (sum(ranks[1:], ranks[0]) / len(columns)).alias("rank_aggregation"),
        F.greatest(*ranks).alias("percentile_max"),
    )


def mean_fusion(scored: DataFrame, columns: list[str], output: str = "raw_score") -> DataFrame:
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    return scored.withColumn(output, total / len(columns))


def production_output(
    scored: DataFrame,
    reference: dict[str, dict[str, float]],
    method: str = "gmm_posterior_0_90",
    key: str = "record_id",
    probability: str | None = None,
) -> DataFrame:
    """The 14-column scored output of a table with features, `ensemble_score` and `is_anomaly`."""
    low, high = fit_score_range(scored, "ensemble_score")
    normalized = (F.col("ensemble_score") - F.lit(low)) / F.lit(high - low + 1e-9)
    ranked = percentile_rank(scored, "ensemble_score", "_percentile").withColumn("normalized_score", normalized)
    explained = top_drivers(ranked, reference)
    extra = [F.col(probability)] if probability else []
    return explained.select(
        F.col(key).alias("record_id"),
        F.bround("ensemble_score", 6).alias("ensemble_score"),
        F.bround("normalized_score", 6).alias("normalized_score"),
        F.bround("_percentile", 6).alias("anomaly_percentile"),
        F.lit(method).alias("threshold_method"),
        F.expr(risk_level()).alias("risk_level"),
        F.col("is_anomaly").cast("int").alias("is_anomaly"),
        "primary_driver",
        "secondary_driver",
        "tertiary_driver",
        "driver_1_deviation",
        "driver_2_deviation",
        "driver_3_deviation",
        F.expr(family_candidate(explained)).alias("anomaly_family_candidate"),
        *extra,
    )


def calibrate(scores: DataFrame, flags: DataFrame, key: str = "record_id", score: str = "score") -> float:
    """Live threshold: the lowest score among rows saved as anomalies, else the 90th percentile.

    Scores and flags are matched by key; keys on one side only mean the tables differ.
    """
    left = scores.select(key, score).alias("s")
    right = flags.select(key, F.col("is_anomaly").cast("int").alias("flag")).alias("f")
    joined = left.join(right, F.col(f"s.{key}") == F.col(f"f.{key}"), "full_outer")
    row = joined.agg(
        F.count_if(F.col(f"s.{key}").isNull() | F.col(f"f.{key}").isNull()).alias("unmatched"),
        F.min(F.when(F.col("f.flag") == 1, F.col(f"s.{score}"))).alias("lowest"),
    ).first()
    if row["unmatched"]:
        raise ValueError(f"{row['unmatched']} rows have only a score or only a flag; cannot calibrate")
    if row["lowest"] is not None:
        return row["lowest"]
    return exact_quantiles(scores, {score: [0.9]}).first()["value"]


def live_decision(scored: DataFrame, threshold: float, score: str = "raw_score", override_compliant: bool = False) -> DataFrame:
    """Anomaly flag and status per record; optionally a compliant record is always Normal."""
    flag = F.col(score) >= F.lit(threshold)
    if override_compliant:
        flag = flag & ~F.coalesce(F.col("sla_compliant").try_cast("double").cast("int") == 1, F.lit(False))
    return scored.withColumn("is_anomaly", flag).withColumn(
        "anomaly_status", F.when(F.col("is_anomaly"), "Anomaly").otherwise("Normal")
    )


