"""Isolation forest: distributed sampling, one task per tree, and vectorised scoring.

Every tree grows on a small sample whose size does not depend on the table, so the table is read
once with a hash filter and only the pooled rows travel.  Rows are picked and trees are grown from
hashes of the row key and seeded generators, so partitioning cannot change the model.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cellsight.functions.sampling import uniform
from cellsight.sources.schema import double, quoted, require_columns

EULER = 0.5772156649
# Rows per tree that a task can hold; callers may pass another bound.
MAX_SAMPLE = 1_000_000
NODE_SCHEMA = "tree int, node int, feature int, split double, left int, right int, size long, depth int"
# Share of rows pooled beyond the exact need, so that every tree finds its full sample.
POOL_MARGIN = 1.3


def average_path(n):
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    many = 2.0 * (np.log(np.maximum(n - 1.0, 1.0)) + EULER) - 2.0 * (n - 1.0) / np.maximum(n, 1.0)
    return np.where(n > 2, many, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """A fitted forest; the node table has at most trees x 2 x sample size rows."""

    nodes: pd.DataFrame
    features: list[str]
    trees: int
    sample_size: int
    seed: int

    def meta(self) -> dict:
        return {"features": self.features, "trees": self.trees, "sample_size": self.sample_size, "seed": self.seed}

    def write(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.nodes, NODE_SCHEMA).write.parquet(f"{path}/nodes")
        spark.createDataFrame([(json.dumps(self.meta()),)], "meta string").write.parquet(f"{path}/meta")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> "Forest":
        nodes = spark.read.parquet(f"{path}/nodes")
        require_columns(nodes, [c.split()[0] for c in NODE_SCHEMA.split(", ")], "forest nodes")
        meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
        missing = {"features", "trees", "sample_size", "seed"} - set(meta)
        if missing:
            raise ValueError(f"forest meta lacks {sorted(missing)}")
        frame = nodes.orderBy("tree", "node").toPandas()
        return cls(frame, meta["features"], meta["trees"], meta["sample_size"], meta["seed"])

    def first_trees(self, count: int) -> "Forest":
        """The forest of the first `count` trees, equal to one fitted with that number of trees."""
        return Forest(self.nodes[self.nodes["tree"] < count], self.features, count, self.sample_size, self.seed)


def resolve_sample_size(max_samples: str | float | int, rows: int, most: int = MAX_SAMPLE) -> int:
    """'auto' is 256; a fraction is taken of the rows and refused where it would not fit a task of `most` rows."""
    if max_samples == "auto":
        return min(256, rows)
    size = int(max_samples * rows) if isinstance(max_samples, float) else int(max_samples)
    if size > most:
        raise ValueError(f"max_samples gives {size} rows per tree; the limit is {most}")
    return max(2, min(size, rows))


def tree_samples(df: DataFrame, features: list[str], key: str, trees: int, sample_size: int, seed: int, rows: int) -> DataFrame:
    """Rows (tree, draw, key, features...): for each tree the `sample_size` rows with the smallest draws.

    With many rows each row is offered to at most one tree; with few rows it is offered to several
    trees as numbered copies.
    """
    need = POOL_MARGIN * trees * sample_size + 64 * trees
    copies = min(trees, max(1, math.ceil(need / rows)))
    rate = min(1.0, need / (rows * copies))
    values = [F.coalesce(F.expr(double(c)), F.lit(0.0)).alias(c) for c in features]
    offered = df.select(F.col(quoted(key)).cast("string").alias("_key"), *values)
    if copies > 1:
        offered = offered.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    else:
        offered = offered.withColumn("_copy", F.lit(0))
    token = "concat(_key, '|', _copy)"
    # Neighbouring copies of a row go to different trees.
    first_tree = f"CAST(floor({uniform('_key', f'{seed}|tree')} * {trees}) AS INT)"
    pooled = (
        offered.withColumn("draw", F.expr(uniform(token, seed)))
        .where(F.col("draw") < rate)
        .withColumn("tree", F.expr(f"pmod({first_tree} + _copy, {trees})"))
    )
    order = Window.partitionBy("tree").orderBy("draw", "_key")
    return (
        pooled.withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= sample_size)
        .select("tree", "draw", "_key", *map(quoted, features))
    )


def _grow(x: np.ndarray, limit: int, rng: np.random.Generator) -> list[tuple]:
    """Nodes (node, feature, split, left, right, size, depth) of one random tree; leaves have feature -1."""
    nodes: list[list] = []
    waiting = [(np.arange(len(x)), 0, -1, 0)]
    while waiting:
        rows, depth, parent, side = waiting.pop()
        node = len(nodes)
        if parent >= 0:
            nodes[parent][3 + side] = node
        nodes.append([node, -1, 0.0, -1, -1, len(rows), depth])
        if depth >= limit or len(rows) <= 1:
            continue
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        usable = np.flatnonzero(high > low)
        if not len(usable):
            continue
        feature = int(rng.choice(usable))
        split = float(rng.uniform(low[feature], high[feature]))
        goes_left = x[rows, feature] <= split
        if goes_left.all():
            split = float(low[feature])
            goes_left = x[rows, feature] <= split
        nodes[node][1], nodes[node][2] = feature, split
        waiting.append((rows[~goes_left], depth + 1, node, 1))
        waiting.append((rows[goes_left], depth + 1, node, 0))
    return [tuple(n) for n in nodes]


def fit_forest(
    df: DataFrame,
    features: list[str],
    key: str = "record_id",
    trees: int = 200,
    max_samples: str | float | int = "auto",
    seed: int = 42,
    max_rows_per_tree: int = MAX_SAMPLE,
) -> Forest:
    """Train on a table; only the finished node table returns to the driver.

    A tree grows in one task, so `max_rows_per_tree` bounds the rows that `max_samples` may ask for.
    """
    require_columns(df, [key, *features], "training table")
    rows = df.select(key).count()
    if rows == 0:
        raise ValueError("cannot train on an empty table")
    sample_size = resolve_sample_size(max_samples, rows, max_rows_per_tree)
    limit = max(1, math.ceil(math.log2(max(2, sample_size))))

    def grow(batch: pd.DataFrame) -> pd.DataFrame:
        ordered = batch.sort_values(["draw", "_key"], kind="stable")
        tree = int(ordered["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        nodes = _grow(ordered[places].to_numpy(dtype=float), limit, rng)
        frame = pd.DataFrame(nodes, columns=["node", "feature", "split", "left", "right", "size", "depth"])
        frame.insert(0, "tree", tree)
        return frame

    places = [f"x{i}" for i in range(len(features))]
    samples = tree_samples(df, features, key, trees, sample_size, seed, rows).toDF("tree", "draw", "_key", *places)
    nodes = samples.groupBy("tree").applyInPandas(grow, NODE_SCHEMA).toPandas()
    nodes = nodes.sort_values(["tree", "node"]).reset_index(drop=True)
    return Forest(nodes, list(features), trees, sample_size, seed)


def _pack(forest: Forest) -> dict[str, np.ndarray]:
    """Node arrays of shape (trees, nodes).

    The two children of a node lie side by side, so a step is `child + (value > split)`; a leaf is its own
    child and splits at infinity, so a fixed number of steps ends in one.
    """
    groups = [g for _, g in forest.nodes.groupby("tree", sort=True)]
    width = max(len(g) for g in groups)
    packed = {
        "feature": np.zeros((len(groups), width), np.intp),
        "split": np.full((len(groups), width), np.inf),
        "child": np.tile(np.arange(width, dtype=np.intp), (len(groups), 1)),
        "length": np.zeros((len(groups), width)),
        "steps": np.zeros(len(groups), np.intp),
    }
    for t, g in enumerate(groups):
        g = g.set_index("node")
        inner = g[g["feature"] >= 0]
        place = np.zeros(len(g), np.intp)
        place[inner["left"]] = 1 + 2 * np.arange(len(inner))
        place[inner["right"]] = 2 + 2 * np.arange(len(inner))
        at = place[inner.index]
        packed["feature"][t, at], packed["split"][t, at], packed["child"][t, at] = inner["feature"], inner["split"], place[inner["left"]]
        packed["length"][t, place[g.index]] = g["depth"].to_numpy() + average_path(g["size"].to_numpy())
        packed["steps"][t] = g["depth"].max()
    packed["norm"] = np.array(max(float(average_path(forest.sample_size)), 1e-12))
    return packed


def score_matrix(packed: dict[str, np.ndarray], x: np.ndarray, counts: list[int] | None = None) -> np.ndarray:
    """Anomaly score 2^(-mean path / norm) per row, one column per number of leading trees in `counts`."""
    total = np.zeros(len(x))
    trees = packed["feature"].shape[0]
    wanted = counts or [trees]
    scores = np.empty((len(x), len(wanted)))
    rows = np.arange(len(x))
    flat = np.asfortranarray(x, dtype=float).ravel(order="F")
    for t in range(trees):
        start, split, child = packed["feature"][t] * len(x), packed["split"][t], packed["child"][t]
        at = np.zeros(len(x), np.intp)
        for _ in range(int(packed["steps"][t])):
            at = child.take(at) + (flat.take(start.take(at) + rows) > split.take(at))
        total += packed["length"][t].take(at)
        for i, count in enumerate(wanted):
            if count == t + 1:
                scores[:, i] = np.power(2.0, -total / count / float(packed["norm"]))
    return scores


def _shared(forest: Forest, spark: SparkSession):
    """The packed forest, sent to the executors once per application."""
    app = spark.sparkContext.applicationId
    if forest.__dict__.get("_sent", (None, None))[0] != app:
        forest._sent = (app, spark.sparkContext.broadcast(_pack(forest)))
    return forest._sent[1]


def score_column(forest: Forest, spark: SparkSession) -> Column:
    """Score expression over the feature columns; missing values count as 0."""
    shared = _shared(forest, spark)

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        x = np.nan_to_num(np.column_stack([c.to_numpy(dtype=float) for c in columns]), nan=0.0)
        return pd.Series(score_matrix(shared.value, x)[:, 0])

    return score(*[F.col(quoted(c)).cast("double") for c in forest.features])


def score_forest(df: DataFrame, forest: Forest, output: str = "score") -> DataFrame:
    require_columns(df, forest.features, "scored table")
    return df.withColumn(output, score_column(forest, df.sparkSession))


def score_prefixes(df: DataFrame, forest: Forest, counts: list[int], output: str = "scores") -> DataFrame:
    """Scores of the forests made of the first trees, for several tree counts in one pass, as an array."""
    shared = _shared(forest, df.sparkSession)

    @F.pandas_udf("array<double>")
    def scores(*columns: pd.Series) -> pd.Series:
        x = np.nan_to_num(np.column_stack([c.to_numpy(dtype=float) for c in columns]), nan=0.0)
        return pd.Series(list(score_matrix(shared.value, x, counts)))

    return df.withColumn(output, scores(*[F.col(quoted(c)).cast("double") for c in forest.features]))


def predict(scored: DataFrame, offset: float, score: str = "score", output: str = "predicted") -> DataFrame:
    """1 where the decision value (-score - offset) is negative."""
    return scored.withColumn(output, (F.col(score) > F.lit(-offset)).cast("int"))
