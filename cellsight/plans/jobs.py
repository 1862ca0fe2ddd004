"""Composed jobs: the operators wired from input tables to result tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from cellsight.operators import clean, forest as iforest, forest_growth, metrics, perturb, profile, rca, recommend, retrieval, scoring, thresholds
from cellsight.operators.feature_model import fit_feature_model, fit_production_transform
from cellsight.operators.features import ratio_features
from cellsight.session import materialise
from cellsight.sources.schema import KPI_FIELDS, quoted
from cellsight.streaming import live

DEFAULT_CONTAMINATION = 0.05
# Metrics of the earlier model with which the optimised one is compared.
BASELINE_METRICS = {
    "accuracy": 0.8037,
    "precision": 0.3441,
    "recall": 0.6078,
    "f1": 0.3314,
    "roc_auc": 0.8369,
    "pr_auc": 0.4587,
}
SWEEP_TREES = [100, 200, 300, 500]
SWEEP_SAMPLES = ["auto", 0.5, 0.75, 1.0]
SWEEP_CONTAMINATIONS = [0.01, 0.03, 0.05, 0.08, 0.10, 0.15]


def _forest_scores(
    scored: DataFrame, train: DataFrame, features: list[str], key: str, trees: int, max_samples: str | float, counts: list[int] | None = None, output: str = "score"
) -> DataFrame:
    """Scores of a forest fitted to `train`; a share of its rows grows over the cluster, a fixed number of rows per tree in tasks."""
    if isinstance(max_samples, float):
        return forest_growth.score_grown(scored, train, features, key, trees, max_samples, counts=counts, output=output)
    forest = iforest.fit_forest(train, features, key, trees=trees, max_samples=max_samples)
    return iforest.score_prefixes(scored, forest, counts, output) if counts else iforest.score_forest(scored, forest, output)


def _score_with_forest(prepared: DataFrame, features: list[str], key: str, trees: int, contamination: float, seed: int = 42):
    forest = iforest.fit_forest(prepared, features, key, trees=trees, seed=seed)
    scored = materialise(iforest.score_forest(prepared.select(*map(quoted, [key, *features])), forest).select(key, "score"), "scores")
    offset = scoring.fit_offsets(scored, [contamination])[f"score_{round(contamination * 100)}"]
    return forest, iforest.predict(scored, offset), offset


def detect_job(raw: DataFrame, key: str = "record_id", trees: int = 200, contamination: float = DEFAULT_CONTAMINATION) -> dict[str, DataFrame]:
    """Clean, impute, scale, encode, select features, train, score and label."""
    cleaned = materialise(clean.clean(raw), "cleaned")
    preparation = clean.fit_preparation(cleaned)
    prepared = materialise(preparation.apply(cleaned).select(*map(quoted, [key, *preparation.feature_names()])), "prepared")
    selected, report = profile.select_features(prepared.drop(key))
    _, predicted, _ = _score_with_forest(prepared, selected, key, trees, contamination)
    table = scoring.score_table(scoring.risk_normalize(predicted), key, predicted="predicted")
    return {"scores": table, "feature_report": report, "summary": scoring.score_summary(table)}


def train_test_job(raw: DataFrame, key: str = "record_id", sample: int = 2_000, trees: int = 200) -> dict[str, DataFrame]:
    """Sample, split, fit on the training part only, score the test part."""
    split = materialise(perturb.train_test_split(perturb.sample_n(raw, sample, key), key=key, seed="42|split"), "split")
    parts = {name: clean.clean(split.where(F.col("split") == name).drop("split")) for name in ("train", "test")}
    preparation = clean.fit_preparation(parts["train"])
    fences = clean.fit_fences(parts["train"], KPI_FIELDS)
    flagged = clean.flag_outliers(parts["train"], fences)
    train, test = (materialise(preparation.apply(parts[n]), n) for n in ("train", "test"))
    selected, report = profile.select_features(train.select(*map(quoted, preparation.feature_names())))
    forest = iforest.fit_forest(train, selected, key, trees=trees)
    trained = iforest.score_forest(train, forest).select(key, "score")
    offset = scoring.fit_offsets(trained, [DEFAULT_CONTAMINATION])["score_5"]
    scored = materialise(iforest.score_forest(test, forest).select(key, "score"), "test_scores")
    table = scoring.score_table(scoring.risk_normalize(iforest.predict(scored, offset)), key, predicted="predicted")
    return {
        "scores": table,
        "feature_report": report,
        "outliers": rca.value_counts(flagged, "eda_outlier_flag"),
        "summary": scoring.score_summary(table),
    }


def rca_job(kpi: DataFrame, key: str = "record_id") -> dict[str, DataFrame]:
    """Root causes of a KPI table with counts by cause and severity and the coverage."""
    rows = materialise(rca.analyse(kpi, key), "rca")
    return {
        "results": rows,
        "causes": rca.value_counts(rows, "root_cause"),
        "severities": rca.value_counts(rows, "severity"),
        "coverage": rca.coverage(rows),
    }


def profile_job(kpi: DataFrame, columns: list[str] = KPI_FIELDS) -> dict[str, DataFrame]:
    pairs = materialise(profile.pair_moments(kpi, columns), "pairs")
    return {
        "profile": profile.kpi_profile(kpi, columns),
        "pairs": pairs,
        "strongest": profile.top_correlations(kpi, columns),
    }


# What the evaluation needs of a labelled set.
_SCORED = ["dataset_name", "anomaly_rate", "anomaly_family", "operating_regime", "ground_truth_label AS label", "copy_key"]


def _scored_sets(sets: DataFrame, forest: iforest.Forest) -> DataFrame:
    return materialise(iforest.score_forest(sets, forest).selectExpr(*_SCORED, "score"), "scored_sets")


def _labelled_sets(base: DataFrame, rates: list[float], regimes: list[str], key: str) -> DataFrame:
    """Stress sets, and regime sets when any are named."""
    sets = perturb.stress_sets(base, list(rates), key)
    return sets.unionByName(perturb.cross_sets(base, regimes, key)) if regimes else sets


def robustness_job(kpi: DataFrame, key: str = "record_id", rates: list[float] = perturb.STRESS_RATES, trees: int = 200) -> dict[str, DataFrame]:
    """Stress sets at several anomaly rates against all threshold methods."""
    base = ratio_features(kpi)
    features = [*KPI_FIELDS, "throughput_per_user", "spectral_efficiency"]
    # The forest is trained on the unchanged rows; its own decision is one more threshold.
    forest = iforest.fit_forest(base, features, key, trees=trees)
    trained = iforest.score_forest(base, forest).select("score")
    offset = scoring.fit_offsets(trained, [DEFAULT_CONTAMINATION])[f"score_{round(DEFAULT_CONTAMINATION * 100)}"]
    scored = _scored_sets(perturb.stress_sets(base, rates, key), forest)
    mixture = thresholds.fit_mixture(scored)
    with_posterior = materialise(thresholds.mixture_posterior(scored, mixture), "posterior")
    cuts = materialise(thresholds.adaptive_thresholds(scored, likelihood=True), "cuts")
    # A row is an anomaly above the offset, not at it.
    own = cuts.select("dataset_name").distinct().withColumns(
        {"method": F.lit("model_predict"), "threshold": F.lit(math.nextafter(-offset, math.inf))}
    )
    cuts = cuts.unionByName(own)
    by_score = metrics.evaluate(scored, cuts)
    by_mixture = _mixture_metrics(with_posterior)
    ranking = by_score.select("dataset_name", "roc_auc", "pr_auc").distinct()
    evaluation = materialise(by_score.unionByName(by_mixture.join(ranking, "dataset_name")), "evaluation")
    flagged = with_posterior.withColumn("predicted", (F.col("anomaly_probability") >= 0.90).cast("int"))
    families = materialise(metrics.family_recall(flagged), "families")
    gmm = evaluation.where("method = 'gmm_posterior_0.90'")
    return {
        "evaluation": evaluation,
        "families": families,
        "methods": metrics.method_comparison(evaluation, ["method"], [*metrics.METRICS, "roc_auc", "pr_auc", "fp", "fn", "tp"]),
        "worst_families": metrics.worst_families(families),
        "most_false_alarms": metrics.heaviest(gmm, "fp", ["dataset_name"]),
        "most_misses": metrics.heaviest(gmm, "fn", ["dataset_name"]),
    }


def _mixture_metrics(with_posterior: DataFrame) -> DataFrame:
    """Metrics of the posterior cut-offs, in one pass."""
    cuts = thresholds.POSTERIOR_CUTS
    grid = with_posterior.select("dataset_name").distinct().select(
        "dataset_name",
        F.inline(F.array(*[F.struct(F.lit(f"gmm_posterior_{c:.2f}").alias("method"), F.lit(c).alias("threshold")) for c in cuts])),
    )
    posterior = with_posterior.select("dataset_name", F.col("anomaly_probability").alias("score"), "label")
    return metrics.class_metrics(metrics.confusion(posterior, grid))


def model_select_job(
    kpi: DataFrame,
    key: str = "record_id",
    rates: list[float] = (0.01, 0.05, 0.20),
    regimes: list[str] = tuple(perturb.CROSS_REGIMES),
    trees: int = 350,
    max_samples: str | float = "auto",
) -> dict[str, DataFrame]:
    """Rank features by power, train on the chosen ones, fuse, compare threshold methods.

    A share as `max_samples` trains every tree on that share of the rows.
    """
    model = fit_feature_model(kpi)
    base = ratio_features(kpi)
    sets = _labelled_sets(base, rates, regimes, key)
    prepared = materialise(model.apply(sets), "labelled_features")
    power = materialise(profile.feature_power(prepared, model.names(), "ground_truth_label"), "power")
    chosen = [row["feature"] for row in profile.select_by_power(power, model.base).collect()]
    clean_rows = model.apply(kpi)
    scored = _forest_scores(prepared, clean_rows, chosen, key, trees, max_samples)
    scored = materialise(scored.selectExpr(*_SCORED, "score"), "scored_sets")
    # The scores of all contaminations differ by constants, so one ranking serves every column.
    fused = scoring.score_fusion(scored, ["score"] * 5, by=["dataset_name"])
    names = {"raw_score": "score", **{f: f for f in ("weighted_average", "rank_aggregation", "percentile_max")}}
    cells = ", ".join(f"struct('{name}' AS fusion_method, {column} AS score)" for name, column in names.items())
    long = materialise(fused.selectExpr("dataset_name", "label", f"inline(array({cells}))"), "fused")
    by = ["dataset_name", "fusion_method"]
    evaluation = materialise(metrics.evaluate(long, thresholds.adaptive_thresholds(long, by, likelihood=True), by), "evaluation")
    grouped = metrics.method_comparison(evaluation, ["fusion_method", "method"], [*metrics.METRICS, "roc_auc", "pr_auc"])
    best = metrics.rank_score_best(grouped, ["fusion_method", "method"])
    spark = kpi.sparkSession
    baseline = spark.createDataFrame(list(BASELINE_METRICS.items()), "metric string, value double")
    cells = ", ".join(f"struct('{m}' AS metric, {m} AS value)" for m in BASELINE_METRICS)
    gains = metrics.metric_gains(best.selectExpr(f"inline(array({cells}))"), baseline)
    return {"power": power, "evaluation": evaluation, "methods": grouped, "best": best, "gains": gains}


def param_sweep_job(
    kpi: DataFrame,
    key: str = "record_id",
    tree_counts: list[int] = SWEEP_TREES,
    sample_sizes: list[str | int | float] = SWEEP_SAMPLES,
    contaminations: list[float] = SWEEP_CONTAMINATIONS,
    rates: list[float] = SWEEP_CONTAMINATIONS,
) -> DataFrame:
    """Every combination of trees, sample size and contamination with its best F1 threshold.

    A sample size is 'auto', a number, or a share of all rows.  One forest is trained per sample size; smaller tree counts are its leading trees, and the
    contamination only moves all scores by a constant.
    """
    base = ratio_features(kpi)
    features = [*KPI_FIELDS, "throughput_per_user", "spectral_efficiency"]
    sets = perturb.sweep_sets(base, rates, key).select(F.col("ground_truth_label").alias("label"), *features)
    # The unchanged rows, without a label, give the offsets.
    rows = materialise(sets.unionByName(base.select(F.lit(None).cast("int").alias("label"), *features)), "sweep_rows")
    counts = sorted(tree_counts)
    scored, shifts = None, []
    for size in sample_sizes:
        found = materialise(_forest_scores(rows, base, features, key, counts[-1], size, counts, "scores").select("label", "scores"), "sweep_part")
        name = F.concat(F.lit(f"{size}|"), F.element_at(F.array(*map(F.lit, counts)), F.col("position") + 1))
        part = found.where("label IS NOT NULL").select("label", F.posexplode("scores").alias("position", "score"))
        part = part.select(name.alias("dataset_name"), "score", "label")
        names = [f"score_of_{count}" for count in counts]
        trained = found.where("label IS NULL").select(*[F.col("scores")[i].alias(name) for i, name in enumerate(names)])
        offsets = scoring.fit_offsets_of(trained, names, contaminations)
        shifts += [(f"{size}|{count}", c, offsets[name][f"score_{round(c * 100)}"]) for count, name in zip(counts, names) for c in contaminations]
        scored = part if scored is None else scored.unionByName(part)
    scored = materialise(scored, "sweep_scores")
    steps = materialise(metrics.score_steps(scored), "sweep_steps")
    best = materialise(metrics.best_f1_threshold(steps).withColumn("method", F.lit("best_f1")), "best")
    rows = metrics.class_metrics(metrics.confusion(scored, best)).join(metrics.roc_auc(steps), "dataset_name")
    offsets = kpi.sparkSession.createDataFrame(shifts, "dataset_name string, contamination double, offset double")
    return (
        rows.join(F.broadcast(offsets), "dataset_name")
        .withColumn("threshold", F.col("threshold") + F.col("offset"))
        .withColumns(
            {
                "max_samples": F.split_part("dataset_name", F.lit("|"), F.lit(1)),
                "n_estimators": F.split_part("dataset_name", F.lit("|"), F.lit(2)).cast("int"),
                "predicted_anomalies": F.col("tp") + F.col("fp"),
            }
        )
        .drop("dataset_name", "method", "offset")
    )


def best_parameters(sweep: DataFrame) -> DataFrame:
    keys = ["roc_auc", "recall", "precision", "f1", "accuracy"]
    return sweep.orderBy(*[F.desc(k) for k in keys], "n_estimators", "max_samples", "contamination").limit(1)


def threshold_job(
    kpi: DataFrame,
    key: str = "record_id",
    rates: list[float] = (0.01, 0.05, 0.20),
    regimes: list[str] = tuple(perturb.CROSS_REGIMES),
    trees: int = 200,
) -> dict[str, DataFrame]:
    """Sweep percentile thresholds over labelled sets, pick one and rescore the table with it."""
    base = ratio_features(kpi)
    features = [*KPI_FIELDS, "throughput_per_user", "spectral_efficiency"]
    sets = _labelled_sets(base, rates, regimes, key)
    scored = _scored_sets(sets, iforest.fit_forest(base, features, key, trees=trees))
    sweep = materialise(metrics.with_average_rows(metrics.threshold_sweep(scored)), "sweep")
    best = materialise(metrics.constrained_best(sweep.where("dataset_name = 'AVERAGE'")), "best")
    percentile = best.first()["threshold_percentile"]
    return {"sweep": sweep, "best": best, "scores": production_job(kpi, key, trees, percentile, "auto")["scores"]}


def production_job(
    kpi: DataFrame, key: str = "record_id", trees: int = 350, percentile: int | None = None, max_samples: str | float = 0.75
) -> dict[str, DataFrame]:
    """Transform, score, decide by mixture posterior or percentile, explain by drivers, summarise."""
    cleaned = materialise(clean.clean(kpi), "cleaned")
    transform = fit_production_transform(cleaned)
    prepared = materialise(transform.apply(cleaned).select(*map(quoted, [key, *transform.names()])), "production_features")
    scored = materialise(_forest_scores(prepared, prepared, transform.names(), key, trees, max_samples), "production_scores")
    fused = scored.withColumn("ensemble_score", F.col("score"))
    if percentile is None:
        mixture = thresholds.fit_mixture(fused.select("score"), [])
        decided = thresholds.mixture_posterior(fused, mixture, []).withColumn(
            "is_anomaly", (F.col("anomaly_probability") >= 0.90).cast("int")
        )
        method = "gmm_posterior_0_90"
    else:
        cut = thresholds.percentile_thresholds(fused.select("score"), [percentile], []).first()["threshold"]
        decided = fused.withColumn("is_anomaly", (F.col("score") >= F.lit(cut)).cast("int"))
        method = f"percentile_{percentile}"
    decided = materialise(decided, "decided")
    output = scoring.production_output(decided, scoring.fit_deviation(decided), method, key)
    output = materialise(output, "production_output")
    report = profile.feature_report(prepared.drop(key), transform.names(), [], [], [c for c in transform.names() if profile.is_kpi(c)])
    return {"scores": output, "summary": scoring.anomaly_summary(output), "feature_report": report}


def live_job(kpi: DataFrame, source: str, sink: str, checkpoint: str, now: str | None = None) -> DataFrame:
    """Fit the live model on reference rows and stream the JSON lines of a folder through it; returns the stored results."""
    spark = kpi.sparkSession
    live.run_stream(spark, source, sink, checkpoint, live.fit_live_model(kpi), now).awaitTermination()
    return spark.read.parquet(f"{sink}/results")


def index_job(documents: DataFrame, path: str) -> DataFrame:
    """Pages to chunks to unit vectors, stored as a table; returns the stored index."""
    chunks = retrieval.chunk_recursive(documents).withColumn("chunk_id", F.concat_ws("#", "document_id", "page_number", "chunk_no"))
    embedder = retrieval.fit_embedder(chunks, "chunk_text")
    indexed = retrieval.embed_text(chunks, embedder).withColumnRenamed("chunk_text", "text")
    retrieval.write_index(indexed, path)
    return retrieval.read_index(documents.sparkSession, path)


def incident_job(incidents: DataFrame, documents: DataFrame, k: int = retrieval.DEFAULT_K) -> DataFrame:
    """Incidents with actions and supporting chunks.

    The searched text holds cause, severity, slice, affected KPIs and explanation of an incident; equal
    texts are searched once and the found context is joined back to every incident.
    """
    chunks = retrieval.chunk_fixed(documents).withColumnRenamed("chunk_text", "text")
    chunks = materialise(chunks.withColumn("chunk_id", F.concat_ws("#", "document_id", "page_number", "chunk_no")), "chunks")
    embedder = retrieval.fit_embedder(chunks, "text")
    index = materialise(retrieval.embed_text(chunks, embedder), "index")

    def keyed_text(df: DataFrame) -> DataFrame:
        return retrieval.query_text(df, output="text").withColumn("query_id", F.md5("text"))

    texts = keyed_text(incidents).select("query_id", "text").dropDuplicates(["query_id"])
    vectors = materialise(retrieval.embed_text(texts, embedder).select("query_id", "embedding"), "queries")
    found = retrieval.retrieve_shape(retrieval.retrieve(vectors, index, k))
    context = retrieval.context_text(found, ["query_id"])
    keyed = keyed_text(recommend.recommend(incidents)).drop("text")
    return retrieval.with_context(keyed, context, ["query_id"])
