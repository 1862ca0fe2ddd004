"""One-hot encoding of any number of categories as sparse vectors with a stored dictionary.

The dictionary is a table with one row per category; nothing of it passes the driver.  A row gets the sorted
positions of its categories, so its width is the number of encoded columns, not the number of categories.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cellsight.operators.joins import null_safe_join
from cellsight.operators.ranking import running_totals
from cellsight.session import materialise
from cellsight.sources.schema import literal, quoted

DICTIONARY = "feature string, value string, position long, n long"


def fit_dictionary(df: DataFrame, columns: list[str]) -> DataFrame:
    """`feature, value, position, n`: every category, its place from 0 on by feature and value, and its rows.

    Missing values are no category; an empty table gives an empty dictionary.  Values are counted before the
    shuffle, so a value that most rows share costs no more than others.
    """
    if not columns:
        return df.sparkSession.createDataFrame([], DICTIONARY)
    cells = ", ".join(f"struct({literal(c)} AS feature, CAST({quoted(c)} AS STRING) AS value)" for c in columns)
    counts = df.selectExpr(f"inline(array({cells}))").where("value IS NOT NULL").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    placed = running_totals(counts.withColumn("_one", F.lit(1).cast("long")), [], ["feature", "value"], ["_one"])
    return materialise(placed.select("feature", "value", F.col("before__one").alias("position"), "n"), "dictionary")


def write_dictionary(dictionary: DataFrame, path: str) -> None:
    dictionary.write.partitionBy("feature").parquet(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A stored dictionary; a filter on `feature` reads the folder of that column only."""
    return spark.read.schema(DICTIONARY).parquet(path)


def one_hot_sparse(df: DataFrame, dictionary: DataFrame, columns: list[str], output: str = "positions", keep: bool = False) -> DataFrame:
    """The sorted positions of the ones of each row; missing values and categories unseen in the fit give none.

    One join per column; Spark broadcasts the categories of a column when their real size allows, and the skew
    rule of the adaptive planner splits the rows of a frequent value otherwise.  Rows are kept, repeated ones included.
    """
    encoded, found = df, []
    for i, column in enumerate(columns):
        place, value = f"_place_{i}", f"_value_{i}"
        one = dictionary.where(F.col("feature") == F.lit(column)).select(F.col("value").alias(value), F.col("position").alias(place))
        encoded = encoded.join(one, F.col(quoted(column)).cast("string") == F.col(value), "left").drop(value)
        found.append(F.col(place))
    places = F.array_sort(F.array_compact(F.array(*found))) if found else F.array().cast("array<long>")
    encoded = encoded.withColumn(output, places).drop(*[f"_place_{i}" for i in range(len(columns))])
    return encoded if keep else encoded.drop(*columns)


def column_shares(encoded: DataFrame, dictionary: DataFrame, by: list[str], positions: str = "positions") -> DataFrame:
    """Per group and category: `feature, value, ones` and `share`, the mean of the one-hot column within the group.

    Categories without a row in a group are left out: their share is 0.
    """
    rows = encoded.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    ones = encoded.select(*by, F.explode(positions).alias("position")).groupBy(*by, "position").agg(F.count(F.lit(1)).alias("ones"))
    shares = null_safe_join(ones, rows, by).withColumn("share", F.col("ones") / F.col("_rows")).drop("_rows")
    return shares.join(dictionary.select("position", "feature", "value"), "position").drop("position")
