"""Order-dependent totals without a single-task window.

A total order over a large table is built in four steps: the table is first reduced to one
row per distinct value (so a value shared by a third of all rows is one row), range-partitioned
and written; each range then contributes one subtotal row; the subtotals are accumulated; and
every range continues from its own offset.  No task ever sees more than one range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cellsight.operators.joins import attach_by_value, null_safe_join
from cellsight.session import materialise

_RANGE = "_range"


def running_totals(counts: DataFrame, by: list[str], order: list[str], sums: list[str]) -> DataFrame:
    """Add `before_<s>` (sum over earlier rows) and `total_<s>` (sum over the group) for each s.

    `counts` holds at most one row per (by, order).
    """
    placed = materialise(
        counts.repartitionByRange(*by, *order).withColumn(_RANGE, F.spark_partition_id()), "ranges"
    )
    keys = [*by, _RANGE]
    subtotals = placed.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in sums])
    earlier = Window.partitionBy(*by).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    # One row per range and group: the number of shuffle partitions bounds this table.
    offsets = subtotals.select(
        *keys,
        *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"offset_{s}") for s in sums],
        *[F.sum(s).over(whole).alias(f"total_{s}") for s in sums],
    )
    joined = null_safe_join(placed, offsets, keys)
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.select(
        *counts.columns,
        *[
            (F.col(f"offset_{s}") + F.coalesce(F.sum(s).over(within), F.lit(0))).alias(f"before_{s}")
            for s in sums
        ],
        *[f"total_{s}" for s in sums],
    )


def value_ranks(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """One row per distinct value: `n` ties, `before_n` smaller rows and `total_n` rows in the group."""
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return running_totals(counts, by, [value], ["n"])


def percentile_rank(df: DataFrame, value: str, output: str, by: list[str] = ()) -> DataFrame:
    """Average-tie rank divided by the row count, within `by`; a missing value has a missing rank and is not counted."""
    ranks = materialise(value_ranks(df.select(*by, value), value, by), "ranks")
    share = (F.col("before_n") + (F.col("n") + 1) / F.lit(2.0)) / F.col("total_n")
    present = attach_by_value(df.where(F.col(value).isNotNull()), ranks.withColumn(output, share), [*by, value], [output])
    missing = df.where(F.col(value).isNull()).withColumn(output, F.lit(None).cast("double"))
    return present.unionByName(missing)


def stable_row_ids(df: DataFrame, key: str, output: str = "row_id") -> DataFrame:
    """1-based position of each row in the order of a key.

    Rows with equal keys follow the order of their other columns, rows without a key come last; every row
    gets an id of its own.
    """
    ties = [f.name for f in df.schema if f.name != key and f.dataType.typeName() not in ("map", "variant")]
    order = df.withColumns({"_no_key": F.col(f"`{key}`").isNull(), "_one": F.lit(1).cast("long")})
    placed = running_totals(order, [], ["_no_key", key, *ties], ["_one"])
    return placed.select(*df.columns, (F.col("before__one") + 1).alias(output))
