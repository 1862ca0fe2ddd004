"""Sinks: parquet by default, CSV and JSON lines for exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame


def sink_parquet(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def sink_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and no index column; quotes and line breaks in texts survive a round trip."""
    df.write.mode("overwrite").csv(path, header=True, escape='"', quoteAll=False)


def sink_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
