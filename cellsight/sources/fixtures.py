"""The KPI and labelled-score views over the order tables, used as input by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cellsight.session import keep_methods_compiled


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def kpi_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per cell and time, derived from the line items; most of what is computed from it is wide."""
    keep_methods_compiled(spark)
    return table(spark, sf_dir, "lineitem").selectExpr(
        "((l_orderkey * 100000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber AS record_id",
        "l_shipdate + INTERVAL '1' HOUR * CAST(l_orderkey % 24 AS INT) AS timestamp",
        "concat('CELL_', CAST(l_suppkey AS STRING)) AS cell_id",
        "CASE l_returnflag WHEN 'A' THEN 'macro' WHEN 'N' THEN 'micro' ELSE 'pico' END AS cell_type",
        "CASE l_orderkey % 3 WHEN 0 THEN 'HC' WHEN 1 THEN 'URLLC' ELSE 'eMBB' END AS slice_type",
        "l_extendedprice / 500D AS throughput_mbps",
        "CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE l_quantity * 2D END AS latency_ms",
        "l_discount * 50D AS packet_loss_pct",
        "CAST(l_linenumber AS BIGINT) AS handover_count",
        "CAST(-70 - (l_partkey % 50) AS DOUBLE) AS rsrp_dbm",
        "CASE WHEN l_partkey % 89 = 0 THEN NULL ELSE -5D - l_tax * 200D END AS rsrq_db",
        "CAST((l_suppkey * 7 + l_linenumber * 13) % 100 AS DOUBLE) AS prb_utilization_pct",
        "CAST(l_orderkey % 400 AS BIGINT) AS active_users",
        "CASE WHEN l_orderkey % 53 = 0 THEN NULL WHEN l_orderkey % 4 = 0 THEN 1 ELSE 0 END AS sla_compliant",
    )


def scored_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with labels: three data sets (slices) and three families (cell types)."""
    return kpi_view(spark, sf_dir).select(
        "record_id",
        F.col("slice_type").alias("dataset_name"),
        F.col("cell_type").alias("anomaly_family"),
        (
            F.coalesce("latency_ms", F.lit(0.0)) / F.lit(100.0)
            + F.col("packet_loss_pct") / F.lit(5.0)
            + F.col("prb_utilization_pct") / F.lit(100.0)
        ).alias("score"),
        F.when((F.col("throughput_mbps") < 50) | (F.col("packet_loss_pct") > 4), 1).otherwise(0).alias("label"),
    )
