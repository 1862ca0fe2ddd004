"""Column groups and schemas of the KPI tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

KPI_FIELDS = [
    "throughput_mbps",
    "latency_ms",
    "packet_loss_pct",
    "handover_count",
    "rsrp_dbm",
    "rsrq_db",
    "prb_utilization_pct",
    "active_users",
]
RATIO_FIELDS = ["throughput_per_user", "spectral_efficiency"]
ID_COLUMNS = ["record_id", "cell_id"]
TIME_COLUMNS = ["timestamp"]
CATEGORICAL_COLUMNS = ["cell_type", "slice_type"]
CELL_TYPES = ["macro", "micro", "pico"]
SLICE_TYPES = ["HC", "URLLC", "eMBB"]
ONE_HOT_FIELDS = [f"cell_type_{v}" for v in CELL_TYPES] + [f"slice_type_{v}" for v in SLICE_TYPES]

# Words that mark a column as a KPI.
KPI_KEYWORDS = [
    "throughput",
    "latency",
    "packet_loss",
    "handover",
    "rsrp",
    "rsrq",
    "prb",
    "active_users",
    "sla",
    "spectral_efficiency",
]

KPI_SCHEMA = T.StructType(
    [
        T.StructField("record_id", T.LongType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("cell_id", T.StringType()),
        T.StructField("cell_type", T.StringType()),
        T.StructField("slice_type", T.StringType()),
        T.StructField("throughput_mbps", T.DoubleType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("packet_loss_pct", T.DoubleType()),
        T.StructField("handover_count", T.LongType()),
        T.StructField("rsrp_dbm", T.DoubleType()),
        T.StructField("rsrq_db", T.DoubleType()),
        T.StructField("prb_utilization_pct", T.DoubleType()),
        T.StructField("active_users", T.LongType()),
        T.StructField("sla_compliant", T.IntegerType()),
    ]
)

LIVE_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in KPI_FIELDS]
    + [
        T.StructField(name, T.StringType())
        for name in ("timestamp", "cell_id", "cell_type", "slice_type", "network_slice", "sla_compliant")
    ]
)

SCORED_SCHEMA = T.StructType(
    [
        T.StructField("record_id", T.LongType()),
        T.StructField("dataset_name", T.StringType()),
        T.StructField("anomaly_family", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("label", T.IntegerType()),
    ]
)


def numeric_columns(df: DataFrame) -> list[str]:
    """Number columns in table order; booleans and decimals of flags do not count as numbers."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    """Text and boolean columns in table order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def first_present(df: DataFrame, names: list[str]) -> str | None:
    """The first of `names` that is a column of `df`."""
    return next((name for name in names if name in df.columns), None)


def quoted(name: str) -> str:
    """A column name for SQL text and for `F.col`, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    """A text for SQL, with quotes and backslashes escaped."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def double(name: str) -> str:
    """SQL for a column as double with NaN turned into null."""
    return f"nanvl(CAST({quoted(name)} AS DOUBLE), NULL)"


def number(name: str) -> Column:
    """A column as double with NaN turned into null, so that missing never compares as true."""
    value = F.col(quoted(name)).cast("double")
    return F.when(~F.isnan(value), value)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into null in every floating column, for tables whose writer marks missing as NaN."""
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floating})


def require_columns(df: DataFrame, names: list[str], what: str = "table") -> None:
    """Raise when columns are absent; presence is a matter of the schema, never of a row."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns: {', '.join(missing)}")
