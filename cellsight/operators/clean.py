"""Cleaning, imputation, outlier flags, scaling and one-hot encoding.

Every operator that needs statistics of the data is split into a fit, which returns a small set of
numbers bounded by the number of columns, and a transform, which turns them into literals.  The same
fitted numbers therefore serve training, batch scoring and the stream.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from cellsight.operators.quantiles import quantile_values
from cellsight.sources.schema import ID_COLUMNS, TIME_COLUMNS, categorical_columns, literal, numeric_columns, quoted

# A column with more categories than this is not a categorical feature.
MAX_CATEGORIES = 1_000


def trim_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def coerce_number(name: str) -> str:
    """SQL for text as a number, null when it is not one."""
    return f"nanvl(TRY_CAST({quoted(name)} AS DOUBLE), NULL)"


def coerce_timestamp(name: str) -> str:
    """SQL for text as a timestamp without zone, null when it is not one."""
    return f"TRY_CAST({quoted(name)} AS TIMESTAMP_NTZ)"


def dedupe_rows(df: DataFrame) -> DataFrame:
    """Drop exact duplicates; copies are combined before the shuffle, so many copies of one row are cheap."""
    return df.dropDuplicates()


def clean(df: DataFrame) -> DataFrame:
    """Trimmed column names, no duplicate rows, readable timestamps."""
    cleaned = dedupe_rows(trim_columns(df))
    present = [c for c in TIME_COLUMNS if c in cleaned.columns]
    return cleaned.withColumns({c: F.expr(coerce_timestamp(c)) for c in present})


def drop_id_time(df: DataFrame, also: list[str] = ()) -> DataFrame:
    return df.drop(*ID_COLUMNS, *TIME_COLUMNS, *also)


def fit_medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    return quantile_values(df, {c: (c, 0.5) for c in columns})


def fit_modes(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Most frequent value per column, the smallest on ties, 'unknown' for a column without values.

    Values are counted across the cluster first; no task holds the distinct values of a column.
    """
    if not columns:
        return {}
    cells = ", ".join(f"struct({literal(c)} AS feature, CAST({quoted(c)} AS STRING) AS value)" for c in columns)
    counts = (
        df.selectExpr(f"inline(array({cells}))")
        .where("value IS NOT NULL")
        .groupBy("feature", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = counts.groupBy("feature").agg(F.expr("min(struct(-n AS less, value)).value").alias("value"))
    found = {row["feature"]: row["value"] for row in best.collect()}
    return {c: found.get(c, "unknown") for c in columns}


def impute(df: DataFrame, fills: dict[str, float | str | None]) -> DataFrame:
    types = dict(df.dtypes)
    filled = {}
    for c, value in fills.items():
        if value is None:
            continue
        if types[c] in ("double", "float"):
            filled[c] = F.coalesce(F.expr(f"nanvl({quoted(c)}, NULL)"), F.lit(value).cast(types[c]))
        elif types[c] in ("string", "boolean"):
            filled[c] = F.coalesce(F.col(quoted(c)), F.lit(value).cast(types[c]))
        else:
            # Medians of whole numbers may be fractional.
            filled[c] = F.coalesce(F.col(quoted(c)).cast("double"), F.lit(value).cast("double"))
    return df.withColumns(filled) if filled else df


def fit_fills(df: DataFrame) -> dict[str, float | str | None]:
    numeric, categorical = numeric_columns(df), categorical_columns(df)
    return {**(fit_medians(df, numeric) if numeric else {}), **fit_modes(df, categorical)}


def fit_fences(df: DataFrame, columns: list[str], multiplier: float = 1.5) -> dict[str, tuple[float, float]]:
    """Outlier fences per column; columns without spread are left out."""
    named = {f"{c}|{q}": (c, q) for c in columns for q in (0.25, 0.75)}
    found = quantile_values(df, named)
    fences = {}
    for c in columns:
        q1, q3 = found[f"{c}|0.25"], found[f"{c}|0.75"]
        if q1 is not None and q3 != q1:
            fences[c] = (q1 - multiplier * (q3 - q1), q3 + multiplier * (q3 - q1))
    return fences


def flag_outliers(df: DataFrame, fences: dict[str, tuple[float, float]], output: str = "eda_outlier_flag") -> DataFrame:
    tests = [f"coalesce({quoted(c)} < {low!r}D OR {quoted(c)} > {high!r}D, false)" for c, (low, high) in fences.items()]
    return df.withColumn(output, F.expr(f"CAST({' OR '.join(tests) or 'false'} AS INT)"))


def fit_scaler(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation per column; a constant column is divided by 1."""
    row = df.selectExpr(
        *[f"{f}({quoted(c)}) AS {quoted(f'{c}_{s}')}" for c in columns for s, f in (
            ("mean", "avg"), ("sd", "stddev_pop"), ("low", "min"), ("high", "max"))]
    ).first()
    scaler = {}
    for c in columns:
        if row[f"{c}_mean"] is None:
            continue
        constant = row[f"{c}_low"] == row[f"{c}_high"]
        scaler[c] = (float(row[f"{c}_mean"]), 1.0 if constant else float(row[f"{c}_sd"]))
    return scaler


def scale(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(quoted(c)) - F.lit(mean)) / F.lit(sd) for c, (mean, sd) in scaler.items()})


def fit_categories(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """Sorted categories per column, refused beyond a fixed number."""
    found = {}
    for c in columns:
        rows = df.select(F.col(quoted(c)).cast("string").alias("value")).where("value IS NOT NULL").distinct()
        values = [row["value"] for row in rows.take(MAX_CATEGORIES + 1)]
        if len(values) > MAX_CATEGORIES:
            raise ValueError(f"{c} has more than {MAX_CATEGORIES} categories")
        found[c] = sorted(values)
    return found


def one_hot(df: DataFrame, categories: dict[str, list[str]], keep: bool = False) -> DataFrame:
    """0/1 columns `<column>_<category>`; a category not seen in the fit gives all zeros."""
    dummies = {
        f"{c}_{value}": F.coalesce((F.col(quoted(c)).cast("string") == F.lit(value)).cast("int"), F.lit(0))
        for c, values in categories.items()
        for value in values
    }
    encoded = df.withColumns(dummies)
    return encoded if keep else encoded.drop(*categories)


@dataclass
class Preparation:
    """Fitted cleaning statistics: fill values, scaling and categories."""

    fills: dict = field(default_factory=dict)
    scaler: dict = field(default_factory=dict)
    categories: dict = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        """Impute, scale the numbers and one-hot the categories; other columns pass through."""
        return one_hot(scale(impute(df, self.fills), self.scaler), self.categories)

    def feature_names(self) -> list[str]:
        return [*self.scaler, *[f"{c}_{v}" for c, values in self.categories.items() for v in values]]

    def write(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(k, json.dumps(v)) for k, v in asdict(self).items()], "part string, content string").write.parquet(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> "Preparation":
        parts = {row["part"]: json.loads(row["content"]) for row in spark.read.parquet(path).collect()}
        return cls(parts["fills"], {c: tuple(v) for c, v in parts["scaler"].items()}, parts["categories"])


def fit_preparation(df: DataFrame, skip: list[str] = ()) -> Preparation:
    """Fit fills, then scaling on the filled numbers, then categories, without ID and time columns."""
    features = drop_id_time(df, list(skip))
    fills = fit_fills(features)
    filled = impute(features, fills)
    return Preparation(
        fills,
        fit_scaler(filled, numeric_columns(features)),
        fit_categories(filled, categorical_columns(features)),
    )
