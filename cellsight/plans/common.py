"""Shared helpers of the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cellsight.operators import rca
from cellsight.session import materialise
from cellsight.sources.fixtures import kpi_view, scored_view, table

Spark = SparkSession


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """All double columns rounded, since sums of doubles depend on the order of the rows."""
    return df.select(*[F.round(F.col(f"`{n}`"), places).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


def time_text(name: str = "timestamp") -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def joined(name: str, separator: str = ", ") -> Column:
    return F.array_join(name, separator).alias(name)


def explained(spark: Spark, sf_dir: str) -> DataFrame:
    """KPI rows with all root-cause columns under per-slice thresholds."""
    return rca.explain_rows(rca.attach_thresholds(kpi_view(spark, sf_dir), "slice_type"))


def labelled_kpi(spark: Spark, sf_dir: str) -> DataFrame:
    """KPI rows with the label of the scored view."""
    return kpi_view(spark, sf_dir).withColumn(
        "label", F.expr("CAST(throughput_mbps < 50 OR packet_loss_pct > 4 AS INT)")
    )


__all__ = ["Spark", "rounded", "time_text", "joined", "explained", "labelled_kpi", "materialise", "kpi_view", "scored_view", "table"]
