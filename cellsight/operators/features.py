"""Feature engineering: time, ratios, encodings, scaled copies, interactions, indices and z-scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cellsight.operators.joins import null_safe_join
from cellsight.operators.quantiles import quantile_values
from cellsight.session import materialise
from cellsight.sources.schema import CELL_TYPES, KPI_FIELDS, RATIO_FIELDS, SLICE_TYPES, double, quoted

# Evening hours counted as peak, and the small constant that keeps ratios finite.
PEAK_HOURS = (18, 22)
EPSILON = 0.001

# New feature -> (left, right, operation).
PAIRS = {
    "latency_x_packet_loss": ("latency_ms", "packet_loss_pct", "mul"),
    "latency_per_throughput": ("latency_ms", "throughput_mbps", "ratio"),
    "throughput_per_prb": ("throughput_mbps", "prb_utilization_pct", "ratio"),
    "active_users_x_utilization": ("active_users", "prb_utilization_pct", "mul"),
    "rsrp_x_rsrq": ("rsrp_dbm", "rsrq_db", "mul"),
    "spectral_efficiency_x_utilization": ("spectral_efficiency", "prb_utilization_pct", "mul"),
    "throughput_per_user_x_latency": ("throughput_per_user", "latency_ms", "mul"),
    "packet_loss_per_signal_quality": ("packet_loss_pct", "rsrq_db", "ratio"),
    "handover_per_signal_strength": ("handover_count", "rsrp_dbm", "ratio"),
    "latency_x_utilization": ("latency_ms", "prb_utilization_pct", "mul"),
    "loss_x_handover": ("packet_loss_pct", "handover_count", "mul"),
    "users_per_throughput": ("active_users", "throughput_mbps", "ratio"),
    "utilization_per_spectral_efficiency": ("prb_utilization_pct", "spectral_efficiency", "ratio"),
}

# New feature -> (needed columns, SQL).
INDICES = {
    "service_degradation_index": (
        ["latency_ms", "packet_loss_pct", "throughput_mbps"],
        "latency_ms + packet_loss_pct - throughput_mbps",
    ),
    "congestion_pressure_index": (
        ["active_users", "prb_utilization_pct", "throughput_per_user"],
        "active_users + prb_utilization_pct - throughput_per_user",
    ),
    "radio_quality_index": (
        ["rsrp_dbm", "rsrq_db", "spectral_efficiency"],
        "rsrp_dbm + rsrq_db + spectral_efficiency",
    ),
    "peak_load_pressure": (
        ["is_peak_hour", "active_users", "prb_utilization_pct"],
        "is_peak_hour * (active_users + prb_utilization_pct)",
    ),
    "urllc_risk_pressure": (
        ["slice_type_URLLC", "latency_ms", "packet_loss_pct"],
        "slice_type_URLLC * (latency_ms + packet_loss_pct)",
    ),
    "embb_capacity_pressure": (
        ["slice_type_eMBB", "throughput_mbps", "prb_utilization_pct"],
        f"slice_type_eMBB * (prb_utilization_pct / (abs(throughput_mbps) + {EPSILON}D))",
    ),
}

CONTEXT_FEATURES = [
    "latency_ms",
    "packet_loss_pct",
    "throughput_mbps",
    "prb_utilization_pct",
    "active_users",
    "throughput_per_user",
    "spectral_efficiency",
    "rsrp_dbm",
    "rsrq_db",
]


def add_sql(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.withColumns({name: F.expr(sql) for name, sql in columns.items()}) if columns else df


def time_features(df: DataFrame, timestamp: str = "timestamp") -> DataFrame:
    """Hour, weekday from Monday = 0, and the peak-hour flag; an unreadable time counts as 0."""
    ts = f"TRY_CAST({timestamp} AS TIMESTAMP_NTZ)"
    return add_sql(
        df,
        {
            "hour_of_day": f"coalesce(hour({ts}), 0)",
            "day_of_week": f"coalesce(weekday({ts}), 0)",
            "is_peak_hour": f"CAST(coalesce(hour({ts}), 0) BETWEEN {PEAK_HOURS[0]} AND {PEAK_HOURS[1]} AS INT)",
        },
    )


def ratio_features(df: DataFrame) -> DataFrame:
    """Throughput per user and per resource block, null on division by zero, unless already present."""
    wanted = {
        "throughput_per_user": "try_divide(throughput_mbps, active_users)",
        "spectral_efficiency": "try_divide(throughput_mbps, prb_utilization_pct)",
    }
    return add_sql(df, {name: sql for name, sql in wanted.items() if name not in df.columns})


def clean_infinite(df: DataFrame, columns: list[str], fill: float | None = 0.0) -> DataFrame:
    """Infinite and NaN values become null, then `fill`."""
    finite = "IF(isnan({0}) OR abs({0}) = double('Infinity'), NULL, CAST({0} AS DOUBLE))"
    cleaned = {c: finite.format(quoted(c)) for c in columns}
    if fill is not None:
        cleaned = {c: f"coalesce({sql}, {float(fill)}D)" for c, sql in cleaned.items()}
    return add_sql(df, cleaned)


def one_hot_static(df: DataFrame) -> DataFrame:
    """The six fixed indicator columns; null gives zeros."""
    wanted = {f"cell_type_{v}": f"coalesce(CAST(cell_type = '{v}' AS INT), 0)" for v in CELL_TYPES}
    wanted |= {f"slice_type_{v}": f"coalesce(CAST(slice_type = '{v}' AS INT), 0)" for v in SLICE_TYPES}
    return add_sql(df, {name: sql for name, sql in wanted.items() if name not in df.columns})


def distinct_mapping(reference: DataFrame, category: str, code: str) -> DataFrame:
    """One code per category."""
    present = reference.where(F.col(category).isNotNull() & F.col(code).isNotNull())
    return present.groupBy(category).agg(F.min(code).alias(code))


def label_encode(df: DataFrame, reference: DataFrame, category: str, code: str) -> DataFrame:
    """Attach the code a category has in the reference; others get the median code."""
    mapping = materialise(distinct_mapping(reference, category, code), "codes")
    fallback = quantile_values(reference, {"median": (code, 0.5)})["median"]
    joined = null_safe_join(df, mapping, [category], "left")
    return joined.withColumn(code, F.coalesce(F.col(code).cast("double"), F.lit(fallback).cast("double")))


def fit_ranges(reference: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Minimum and maximum per column; constant and empty columns are left out."""
    row = reference.selectExpr(
        *[f"{f}({double(c)}) AS {quoted(f'{c}_{f}')}" for c in columns for f in ("min", "max")]
    ).first()
    ranges = {c: (row[f"{c}_min"], row[f"{c}_max"]) for c in columns}
    return {c: r for c, r in ranges.items() if r[0] is not None and r[0] != r[1]}


def minmax_features(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """`<column>_norm`, scaled by the reference range, not clipped."""
    return df.withColumns(
        {
            f"{c}_norm": (F.col(c).try_cast("double") - F.lit(low)) / F.lit(high - low)
            for c, (low, high) in ranges.items()
            if c in df.columns
        }
    )


def pair_features(df: DataFrame) -> DataFrame:
    """Products and safe ratios of column pairs that are present."""
    sql = {
        name: f"CAST({left} * {right} AS DOUBLE)" if op == "mul" else f"{left} / (abs({right}) + {EPSILON}D)"
        for name, (left, right, op) in PAIRS.items()
        if left in df.columns and right in df.columns
    }
    return add_sql(df, sql)


def composite_indices(df: DataFrame) -> DataFrame:
    return add_sql(
        df, {name: sql for name, (needed, sql) in INDICES.items() if all(c in df.columns for c in needed)}
    )


def fit_context(reference: DataFrame, columns: list[str] | None = None) -> dict[str, dict[str, float]]:
    """Median, interquartile range, mean and sample deviation per context feature."""
    present = [c for c in (columns or CONTEXT_FEATURES) if c in reference.columns]
    quartiles = quantile_values(reference, {f"{c}|{p}": (c, p) for c in present for p in (0.25, 0.5, 0.75)})
    row = reference.selectExpr(
        *[f"{f}({double(c)}) AS {quoted(f'{c}_{f}')}" for c in present for f in ("avg", "stddev_samp")]
    ).first()
    stats = {}
    for c in present:
        if row[f"{c}_avg"] is not None:
            stats[c] = {
                "median": quartiles[f"{c}|0.5"],
                "iqr": quartiles[f"{c}|0.75"] - quartiles[f"{c}|0.25"],
                "mean": row[f"{c}_avg"],
                "sd": row[f"{c}_stddev_samp"] if row[f"{c}_stddev_samp"] is not None else float("nan"),
            }
    return stats


def context_z(df: DataFrame, stats: dict[str, dict[str, float]]) -> DataFrame:
    """Robust and plain z-scores against fitted statistics."""
    columns = {}
    for c, s in stats.items():
        if c in df.columns:
            value = F.col(c).try_cast("double")
            columns[f"{c}_robust_context_z"] = (value - F.lit(s["median"])) / F.lit(s["iqr"] + EPSILON)
            columns[f"{c}_batch_z"] = (value - F.lit(s["mean"])) / F.lit(s["sd"] + EPSILON)
    return df.withColumns(columns)


def basic_features(df: DataFrame) -> DataFrame:
    """Time, ratio and indicator columns of raw KPI rows."""
    return one_hot_static(ratio_features(time_features(df)))


def engineered_names(columns: list[str]) -> list[str]:
    """Names that `engineer` adds to a table with these columns."""
    present = set(columns)
    pairs = [name for name, (left, right, _) in PAIRS.items() if {left, right} <= present]
    indices = [name for name, (needed, _) in INDICES.items() if set(needed) <= present]
    z = [f"{c}_{kind}" for c in CONTEXT_FEATURES if c in present for kind in ("robust_context_z", "batch_z")]
    return pairs + indices + z


def engineer(df: DataFrame, base: list[str], stats: dict[str, dict[str, float]]) -> DataFrame:
    """Add all engineered features and fill missing values of features with 0."""
    added = context_z(composite_indices(pair_features(df)), stats)
    return clean_infinite(added, [*base, *engineered_names(base)])


def base_features() -> list[str]:
    """Raw, ratio, scaled, time and indicator features of a KPI row."""
    return [
        *KPI_FIELDS,
        *RATIO_FIELDS,
        *[f"{c}_norm" for c in [*KPI_FIELDS, *RATIO_FIELDS]],
        "hour_of_day",
        "day_of_week",
        "is_peak_hour",
        *[f"cell_type_{v}" for v in CELL_TYPES],
        *[f"slice_type_{v}" for v in SLICE_TYPES],
    ]
