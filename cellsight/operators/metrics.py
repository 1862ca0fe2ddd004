"""Detector evaluation over labelled score tables, grouped by data set.

All ranking metrics come from one table of distinct scores with class counts and running totals,
which is built without a global window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cellsight.operators.joins import null_safe_join
from cellsight.operators.quantiles import exact_quantiles
from cellsight.operators.ranking import running_totals
from cellsight.session import materialise

METRICS = ["accuracy", "precision", "recall", "f1"]
SWEEP_PERCENTILES = [90, 92, 94, 95, 96, 97, 98, 99]
MINIMUM_RECALL = 0.75


def score_steps(scored: DataFrame, by: list[str] = ("dataset_name",), score: str = "score", label: str = "label") -> DataFrame:
    """One row per distinct score: rows `n`, positives `pos`, their totals and the counts below."""
    by = list(by)
    counts = (
        scored.where(F.col(score).isNotNull())
        .groupBy(*by, F.col(score).alias("score"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    )
    return running_totals(counts, by, ["score"], ["n", "pos"])


def roc_auc(steps: DataFrame, by: list[str] = ("dataset_name",)) -> DataFrame:
    """Probability that a positive scores above a negative, ties counted half; null without both classes."""
    negative = "(CAST(n AS DOUBLE) - pos)"
    below = "(CAST(before_n AS DOUBLE) - before_pos)"
    wins = F.expr(f"sum(pos * ({below} + {negative} / 2D))")
    pairs = F.expr("max(CAST(total_pos AS DOUBLE) * (total_n - total_pos))")
    return steps.groupBy(*by).agg(F.try_divide(wins, pairs).alias("roc_auc"))


def pr_auc(steps: DataFrame, by: list[str] = ("dataset_name",)) -> DataFrame:
    """Average precision: precision at each distinct score weighted by the recall it adds."""
    precision = "try_divide(CAST(total_pos - before_pos AS DOUBLE), total_n - before_n)"
    return steps.groupBy(*by).agg(
        F.expr(f"sum(try_divide(CAST(pos AS DOUBLE), total_pos) * {precision})").alias("pr_auc")
    )


def curve_points(steps: DataFrame) -> DataFrame:
    """ROC and precision-recall coordinates and F1 when flagging everything from each score upwards."""
    tp, flagged = "CAST(total_pos - before_pos AS DOUBLE)", "(total_n - before_n)"
    return steps.withColumns(
        {
            "fpr": F.expr(f"try_divide({flagged} - {tp}, total_n - total_pos)"),
            "tpr": F.expr(f"try_divide({tp}, total_pos)"),
            "precision": F.expr(f"try_divide({tp}, {flagged})"),
            "f1": F.expr(f"coalesce(try_divide(2D * {tp}, {flagged} + total_pos), 0D)"),
        }
    ).drop("n", "pos", "before_n", "before_pos", "total_n", "total_pos")


def best_f1_threshold(steps: DataFrame, by: list[str] = ("dataset_name",)) -> DataFrame:
    """The score that maximises F1 as a threshold, the lowest one on ties."""
    best = F.min(F.struct((-F.col("f1")).alias("less"), F.col("score"))).alias("best")
    return curve_points(steps).groupBy(*by).agg(best).select(
        *by, F.col("best.score").alias("threshold"), (-F.col("best.less")).alias("f1")
    )


def f1_curve(scored: DataFrame, by: list[str] = ("dataset_name",), points: int = 120) -> DataFrame:
    """F1 at evenly spaced score quantiles between 1 % and 99 %.

    Scores are first counted between neighbouring cuts, which leaves points + 1 rows per group.
    """
    by = list(by)
    probs = [0.01 + (0.99 - 0.01) * i / (points - 1) for i in range(points)]
    grid = materialise(exact_quantiles(scored, {"score": probs}, by).select(*by, "prob", "value"), "grid")
    cuts = grid.groupBy(*by).agg(F.array_sort(F.collect_list("value")).alias("cuts"))
    rows = scored.where(F.col("score").isNotNull()).select(*by, "score", "label")
    placed = null_safe_join(rows, materialise(cuts, "cuts"), by) if by else rows.withColumn(
        "cuts", F.lit(cuts.first()["cuts"])
    )
    counts = placed.groupBy(*by, F.expr("size(filter(cuts, c -> c <= score))").alias("passed")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("long")).alias("pos")
    )
    position = F.row_number().over(Window.partitionBy(*by).orderBy("prob"))
    numbered = grid.withColumn("position", position)
    pairs = null_safe_join(numbered.withColumn("_one", F.lit(1)), counts.withColumn("_one", F.lit(1)), [*by, "_one"])
    flagged = F.col("passed") >= F.col("position")
    return (
        pairs.groupBy(*by, "prob", "value")
        .agg(
            F.sum(F.when(flagged, F.col("n")).otherwise(0)).alias("flagged"),
            F.sum(F.when(flagged, F.col("pos")).otherwise(0)).alias("tp"),
            F.sum("pos").alias("positives"),
        )
        .select(
            *by,
            F.round("prob", 6).alias("prob"),
            F.col("value").alias("threshold"),
            F.expr("coalesce(try_divide(2D * tp, flagged + positives), 0D)").alias("f1"),
        )
    )


def confusion(scored: DataFrame, thresholds: DataFrame, by: list[str] = ("dataset_name",)) -> DataFrame:
    """Confusion counts per group and method when `score >= threshold` is flagged.

    `thresholds` has (by..., method, threshold).  All methods are counted in one pass over the
    scores: the thresholds of a group ride along as one array, and each method is one conditional
    count, so rows are neither multiplied nor shuffled.
    """
    by = list(by)
    small = materialise(thresholds.select(*by, "method", "threshold"), "cuts")
    methods = sorted(row["method"] for row in small.select("method").distinct().collect())
    columns = {m: f"t{i}" for i, m in enumerate(methods)}
    cuts = small.groupBy(*by).agg(
        *[F.max(F.when(F.col("method") == m, F.col("threshold"))).alias(c) for m, c in columns.items()]
    )
    flagged = {m: f"score >= {c}" for m, c in columns.items()}
    counts = [F.count(F.lit(1)).alias("rows"), F.sum(F.col("label").cast("long")).alias("positives")]
    for m, c in columns.items():
        counts.append(F.count_if(F.expr(f"{flagged[m]} AND label = 1")).alias(f"tp_{c}"))
        counts.append(F.count_if(F.expr(f"{flagged[m]} AND label = 0")).alias(f"fp_{c}"))
    rows = scored.select(*by, "score", "label")
    if by:
        joined = null_safe_join(rows, materialise(cuts, "cuts_wide"), by)
    else:
        joined = rows.withColumns({c: F.lit(value) for c, value in cuts.first().asDict().items()})
    wide = joined.groupBy(*by, *columns.values()).agg(*counts)
    cells = ", ".join(
        f"struct('{m}' AS method, {c} AS threshold, rows - positives - fp_{c} AS tn, fp_{c} AS fp, "
        f"positives - tp_{c} AS fn, tp_{c} AS tp)"
        for m, c in columns.items()
    )
    return wide.selectExpr(*by, f"inline(array({cells}))").where("threshold IS NOT NULL")


def class_metrics(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 from confusion counts, 0 where undefined."""
    return counts.withColumns(
        {
            "accuracy": F.expr("coalesce(try_divide(CAST(tp + tn AS DOUBLE), tp + tn + fp + fn), 0D)"),
            "precision": F.expr("coalesce(try_divide(CAST(tp AS DOUBLE), tp + fp), 0D)"),
            "recall": F.expr("coalesce(try_divide(CAST(tp AS DOUBLE), tp + fn), 0D)"),
            "f1": F.expr("coalesce(try_divide(2D * tp, 2D * tp + fp + fn), 0D)"),
        }
    )


def evaluate(scored: DataFrame, thresholds: DataFrame, by: list[str] = ("dataset_name",), pr: bool = True) -> DataFrame:
    """Metrics of every threshold method, with the ranking metrics of the group."""
    metrics = class_metrics(confusion(scored, thresholds, by))
    steps = materialise(score_steps(scored, by), "steps")
    metrics = null_safe_join(metrics, roc_auc(steps, by), list(by), "left")
    return null_safe_join(metrics, pr_auc(steps, by), list(by), "left") if pr else metrics


def threshold_sweep(scored: DataFrame, percentiles: list[int] = SWEEP_PERCENTILES, by: list[str] = ("dataset_name",)) -> DataFrame:
    """Metrics of percentile thresholds on every data set."""
    cuts = exact_quantiles(scored, {"score": [p / 100 for p in percentiles]}, by).select(
        *by, F.round(F.col("prob") * 100).cast("int").cast("string").alias("method"), F.col("value").alias("threshold")
    )
    rows = evaluate(scored, cuts, by, pr=False)
    return rows.select(
        *by,
        F.col("method").cast("int").alias("threshold_percentile"),
        F.col("threshold").alias("threshold_value"),
        *METRICS,
        "roc_auc",
        "tn",
        "fp",
        "fn",
        "tp",
        ((F.col("tp") + F.col("fp")) * 100.0 / (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))).alias("anomaly_percentage"),
        F.expr("CAST(tp + fn AS DOUBLE) / (tp + fp + tn + fn)").alias("ground_truth_anomaly_rate"),
        (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("records"),
    )


def with_average_rows(sweep: DataFrame) -> DataFrame:
    """The sweep plus one AVERAGE row per percentile: the mean over the data sets."""
    averaged = ["precision", "recall", "f1", "roc_auc", "anomaly_percentage", "accuracy", "tn", "fp", "fn", "tp"]
    detail = sweep.withColumns({c: F.col(c).cast("double") for c in averaged})
    mean = detail.groupBy("threshold_percentile").agg(*[F.avg(c).alias(c) for c in averaged])
    return detail.unionByName(mean.withColumn("dataset_name", F.lit("AVERAGE")), allowMissingColumns=True)


def constrained_best(rows: DataFrame, minimum_recall: float = MINIMUM_RECALL) -> DataFrame:
    """Best precision among rows with enough recall; if there are none, best recall overall."""
    eligible = F.col("recall") >= minimum_recall
    first = ["precision", "f1", "recall", "roc_auc"]
    second = ["recall", "f1", "precision", "roc_auc"]
    keys = [F.when(eligible, F.col(a)).otherwise(F.col(b)).desc() for a, b in zip(first, second)]
    return rows.orderBy(eligible.desc(), *keys, F.col("threshold_percentile")).limit(1)


def method_comparison(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.avg(c).alias(c) for c in columns])


def rank_score(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank_score", F.expr("roc_auc * 1000 + recall * 100 + precision * 10 + f1"))


def rank_score_best(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rank_score(rows).orderBy(F.desc("rank_score"), *keys).limit(1)


def family_recall(
    scored: DataFrame, predicted: str = "predicted", by: list[str] = ("dataset_name",), family: str = "anomaly_family"
) -> DataFrame:
    """Per family of labelled anomalies: rows, recall, mean score and misses."""
    return (
        scored.where("label = 1")
        .groupBy(*by, family)
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.avg(F.col(predicted).cast("double")).alias("recall"),
            F.avg("score").alias("mean_score"),
            F.count_if(F.col(predicted) == 0).alias("missed"),
        )
    )


def worst_families(families: DataFrame, k: int = 12) -> DataFrame:
    keys = [c for c in ("dataset_name", "anomaly_family") if c in families.columns]
    return families.orderBy("recall", F.desc("missed"), *keys).limit(k)


def heaviest(rows: DataFrame, column: str, keys: list[str], k: int = 5) -> DataFrame:
    return rows.orderBy(F.desc(column), *keys).limit(k)


def metric_gains(optimised: DataFrame, baseline: DataFrame) -> DataFrame:
    """Difference per metric of two (metric, value) tables."""
    return optimised.alias("o").join(baseline.alias("b"), "metric").select(
        "metric",
        F.col("b.value").alias("baseline"),
        F.col("o.value").alias("optimised"),
        (F.col("o.value") - F.col("b.value")).alias("gain"),
    )


def prevalence(scored: DataFrame, by: str = "dataset_name", flag: str = "label") -> DataFrame:
    """Share of flagged rows per data set, and for all rows under a null name."""
    return scored.rollup(by).agg(F.avg(F.col(flag).cast("double")).alias("prevalence"), F.count(F.lit(1)).alias("n"))
