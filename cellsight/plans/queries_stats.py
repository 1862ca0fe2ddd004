"""Registered queries: statistics, evaluation, thresholds, ranks, sampling and perturbation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cellsight.operators import clean, features as feat, metrics, perturb, profile, ranking, rca, scoring, thresholds
from cellsight.plans.common import Spark, kpi_view, labelled_kpi, materialise, rounded, scored_view
from cellsight.sources.schema import KPI_FIELDS, RATIO_FIELDS

METRIC_COLUMNS = [*metrics.METRICS, "roc_auc", "pr_auc"]


# Cleaning statistics


def median_impute(spark: Spark, sf_dir: str) -> DataFrame:
    rows = kpi_view(spark, sf_dir)
    filled = clean.impute(rows, clean.fit_medians(rows, ["latency_ms", "rsrq_db", "sla_compliant"]))
    return filled.select("record_id", "latency_ms", "rsrq_db", "sla_compliant")


def mode_impute(spark: Spark, sf_dir: str) -> DataFrame:
    rows = kpi_view(spark, sf_dir).selectExpr(
        "record_id",
        "IF(handover_count = 1, NULL, cell_type) AS cell_type",
        "IF(handover_count = 2, NULL, cell_id) AS cell_id",
        "CAST(NULL AS STRING) AS site",
    )
    return clean.impute(rows, clean.fit_modes(rows, ["cell_type", "cell_id", "site"]))


def dedupe_rows(spark: Spark, sf_dir: str) -> DataFrame:
    rows = kpi_view(spark, sf_dir)
    copies = rows.unionByName(rows.where("cell_type = 'macro'")).drop("timestamp")
    return clean.dedupe_rows(copies)


def outlier_flag(spark: Spark, sf_dir: str) -> DataFrame:
    rows = feat.ratio_features(kpi_view(spark, sf_dir)).withColumn("constant_col", F.lit(0.0))
    rows = rows.withColumn("empty_col", F.lit(None).cast("double"))
    fences = clean.fit_fences(rows, [*KPI_FIELDS, *RATIO_FIELDS, "constant_col", "empty_col"])
    return clean.flag_outliers(rows, fences).select("record_id", "eda_outlier_flag")


def standard_scale(spark: Spark, sf_dir: str) -> DataFrame:
    rows = kpi_view(spark, sf_dir).withColumn("constant_col", F.lit(7.0))
    columns = [*KPI_FIELDS, "constant_col"]
    return rounded(clean.scale(rows, clean.fit_scaler(rows, columns)).select("record_id", *columns))


# Profiles and selection


def _with_flat_columns(spark: Spark, sf_dir: str) -> DataFrame:
    """KPI rows with a constant column and two columns that follow others exactly."""
    return kpi_view(spark, sf_dir).selectExpr(
        "*", "0D AS constant_col", "throughput_mbps * 2 + 1 AS doubled", "-latency_ms AS latency_negated"
    )


SELECTION = [*KPI_FIELDS, "constant_col", "doubled", "latency_negated"]


def variance_filter(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(profile.variance_filter(_with_flat_columns(spark, sf_dir), SELECTION))


def corr_matrix(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(profile.corr_matrix(kpi_view(spark, sf_dir), KPI_FIELDS))


def cov_matrix(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(profile.cov_matrix(kpi_view(spark, sf_dir), KPI_FIELDS))


def corr_prune(spark: Spark, sf_dir: str) -> DataFrame:
    columns = [c for c in SELECTION if c != "constant_col"]
    return profile.corr_prune(_with_flat_columns(spark, sf_dir), columns, ["latency_negated"])


def top_correlations(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(profile.top_correlations(kpi_view(spark, sf_dir), KPI_FIELDS))


def feature_report(spark: Spark, sf_dir: str) -> DataFrame:
    rows = clean.drop_id_time(kpi_view(spark, sf_dir))
    kpis = [c for c in rows.columns if profile.is_kpi(c)]
    return rounded(profile.feature_report(rows, KPI_FIELDS, [], [], kpis))


def select_features(spark: Spark, sf_dir: str) -> DataFrame:
    rows = clean.drop_id_time(_with_flat_columns(spark, sf_dir))
    return rounded(profile.select_features(rows)[1])


def kpi_profile(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(profile.kpi_profile(kpi_view(spark, sf_dir), KPI_FIELDS))


def value_counts(spark: Spark, sf_dir: str) -> DataFrame:
    return rca.value_counts(rca.classify(rca.attach_thresholds(kpi_view(spark, sf_dir), "slice_type")), "root_cause")


def rca_coverage(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(rca.coverage(rca.classify(rca.attach_thresholds(kpi_view(spark, sf_dir), "slice_type"))))


def score_summary(spark: Spark, sf_dir: str) -> DataFrame:
    scored = scoring.risk_normalize(scored_view(spark, sf_dir))
    row = scoring.score_summary(scoring.score_table(scored, predicted="label"))
    return rounded(row.withColumn("status_counts", _map_text("status_counts")))


def _map_text(name: str):
    entries = F.array_sort(F.map_entries(name))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "; ")


def anomaly_summary(spark: Spark, sf_dir: str) -> DataFrame:
    scored = scoring.risk_normalize(scored_view(spark, sf_dir), floor=1e-9, output="normalized_score")
    output = scored.select(
        F.col("score").alias("ensemble_score"),
        F.col("label").alias("is_anomaly"),
        F.expr(scoring.risk_level(flag="label")).alias("risk_level"),
    )
    return scoring.anomaly_summary(output).withColumn("risk_level_distribution", _map_text("risk_level_distribution"))


def score_histogram(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(profile.score_histogram(scored_view(spark, sf_dir)))


def histogram_overlap(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(profile.histogram_overlap(labelled_kpi(spark, sf_dir), KPI_FIELDS))


def class_separation(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(profile.class_separation(labelled_kpi(spark, sf_dir), KPI_FIELDS))


def mutual_information(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(profile.mutual_information(labelled_kpi(spark, sf_dir), KPI_FIELDS))


def neighbour_information(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(profile.neighbour_information(labelled_kpi(spark, sf_dir), KPI_FIELDS))


def feature_power(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(profile.feature_power(labelled_kpi(spark, sf_dir), KPI_FIELDS))


def select_by_power(spark: Spark, sf_dir: str) -> DataFrame:
    """Two base features and the others above their median score."""
    power = materialise(profile.feature_power(labelled_kpi(spark, sf_dir), KPI_FIELDS), "power")
    return rounded(profile.select_by_power(power, ["throughput_mbps", "rsrq_db"]).select("feature", "discriminative_score"))


def importance_rank(spark: Spark, sf_dir: str) -> DataFrame:
    rows = labelled_kpi(spark, sf_dir)
    power = materialise(profile.feature_power(rows, KPI_FIELDS), "power")
    ranked = profile.power_report(power.select("feature"), power)
    top = ranked.orderBy("importance_rank").limit(25)
    return rounded(profile.feature_taxonomy(top).drop("feature_type"))


# Evaluation


def _cuts(spark: Spark, sf_dir: str) -> DataFrame:
    return thresholds.percentile_thresholds(scored_view(spark, sf_dir), [90, 95, 99])


def confusion(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(metrics.confusion(scored_view(spark, sf_dir), _cuts(spark, sf_dir)))


def class_metrics(spark: Spark, sf_dir: str) -> DataFrame:
    counts = metrics.confusion(scored_view(spark, sf_dir), _cuts(spark, sf_dir))
    return rounded(metrics.class_metrics(counts).select("dataset_name", "method", *metrics.METRICS))


def roc_auc(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(metrics.roc_auc(metrics.score_steps(scored_view(spark, sf_dir))))


def pr_auc(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(metrics.pr_auc(metrics.score_steps(scored_view(spark, sf_dir))))


def curve_points(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(metrics.curve_points(metrics.score_steps(scored_view(spark, sf_dir))))


def f1_curve(spark: Spark, sf_dir: str) -> DataFrame:
    # Equal scores must be equal to the last bit for cuts that fall on them.
    return rounded(metrics.f1_curve(scored_view(spark, sf_dir).withColumn("score", F.round("score", 6))))


def best_f1_threshold(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(metrics.best_f1_threshold(metrics.score_steps(scored_view(spark, sf_dir))))


def threshold_sweep(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(metrics.threshold_sweep(scored_view(spark, sf_dir)))


def sweep_average_row(spark: Spark, sf_dir: str) -> DataFrame:
    rows = metrics.with_average_rows(metrics.threshold_sweep(scored_view(spark, sf_dir)))
    return rounded(rows.drop("ground_truth_anomaly_rate", "threshold_value", "records"))


def constrained_best(spark: Spark, sf_dir: str) -> DataFrame:
    rows = materialise(metrics.with_average_rows(metrics.threshold_sweep(scored_view(spark, sf_dir))), "sweep")
    best = metrics.constrained_best(rows.where("dataset_name = 'AVERAGE'"))
    return rounded(best.select("threshold_percentile", "precision", "recall", "f1", "roc_auc"))


def _evaluation(spark: Spark, sf_dir: str) -> DataFrame:
    return metrics.evaluate(scored_view(spark, sf_dir), _cuts(spark, sf_dir))


def method_comparison(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(metrics.method_comparison(_evaluation(spark, sf_dir), ["method"], [*METRIC_COLUMNS, "fp", "fn", "tp"]))


def rank_score_best(spark: Spark, sf_dir: str) -> DataFrame:
    grouped = metrics.method_comparison(_evaluation(spark, sf_dir), ["method"], METRIC_COLUMNS)
    return rounded(metrics.rank_score_best(grouped, ["method"]).select("method", "rank_score"))


def argmax_row(spark: Spark, sf_dir: str) -> DataFrame:
    """The best method per data set by its rank score."""
    scores = metrics.rank_score(_evaluation(spark, sf_dir))
    best = scores.groupBy("dataset_name").agg(F.expr("max(struct(rank_score, method))").alias("best"))
    return rounded(best.select("dataset_name", "best.method", "best.rank_score"))


def _families(spark: Spark, sf_dir: str) -> DataFrame:
    scored = scored_view(spark, sf_dir)
    return metrics.family_recall(thresholds.apply_threshold(scored, _cuts(spark, sf_dir), "percentile_90"))


def family_recall(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(_families(spark, sf_dir))


def failure_ranking(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(metrics.worst_families(_families(spark, sf_dir)).select("dataset_name", "anomaly_family", "recall", "missed"))


def heaviest_errors(spark: Spark, sf_dir: str) -> DataFrame:
    """The five rows of the evaluation with the most false alarms, and the five with the most misses."""
    rows = materialise(_evaluation(spark, sf_dir), "evaluation")
    lists = [metrics.heaviest(rows, c, ["dataset_name", "method"]).select(F.lit(c).alias("kind"), "dataset_name", "method", F.col(c).alias("errors")) for c in ("fp", "fn")]
    return lists[0].unionByName(lists[1])


def metric_gains(spark: Spark, sf_dir: str) -> DataFrame:
    """Metrics at the 90th percentile against those at the 99th, averaged over the sets."""
    rows = materialise(metrics.method_comparison(_evaluation(spark, sf_dir), ["method"], METRIC_COLUMNS), "methods")
    long = "inline(array(" + ", ".join(f"struct('{c}' AS metric, {c} AS value)" for c in METRIC_COLUMNS) + "))"
    new, old = (rows.where(f"method = 'percentile_{p}'").selectExpr(long) for p in (90, 99))
    return rounded(metrics.metric_gains(new, old))


def prevalence(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(metrics.prevalence(scored_view(spark, sf_dir)))


# Thresholds


def thr_percentile(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(thresholds.percentile_thresholds(scored_view(spark, sf_dir), [90, 95, 98, 99]))


def thr_iqr(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(thresholds.iqr_thresholds(scored_view(spark, sf_dir), [1.5, 3.0]))


def thr_mad(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(thresholds.mad_thresholds(scored_view(spark, sf_dir), [3.5, 5.0]))


def thr_gaussian(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(thresholds.gaussian_thresholds(scored_view(spark, sf_dir), [2.5, 3.0]))


def thr_gmm(spark: Spark, sf_dir: str) -> DataFrame:
    flagged = thresholds.mixture_flags(scored_view(spark, sf_dir))
    return rounded(flagged.select("record_id", "dataset_name", "anomaly_probability", "predicted"))


def thr_evt(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(thresholds.evt_thresholds(scored_view(spark, sf_dir)))


def thr_gmm_parameters(spark: Spark, sf_dir: str) -> DataFrame:
    """Weights, means and variances of the two components per data set."""
    return rounded(thresholds.fit_mixture(scored_view(spark, sf_dir)))


def thr_evt_likelihood(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(thresholds.evt_likelihood_thresholds(scored_view(spark, sf_dir)))


def apply_threshold(spark: Spark, sf_dir: str) -> DataFrame:
    flagged = thresholds.apply_threshold(scored_view(spark, sf_dir), _cuts(spark, sf_dir), "percentile_95")
    return flagged.select("record_id", "predicted")


def threshold_matrix(spark: Spark, sf_dir: str) -> DataFrame:
    scored = scored_view(spark, sf_dir)
    return rounded(metrics.evaluate(scored, thresholds.adaptive_thresholds(scored)))


# Ranks, sorts and limits


def percentile_rank(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(ranking.percentile_rank(scored_view(spark, sf_dir), "score", "rank").select("record_id", "rank"))


def dataset_partition_rank(spark: Spark, sf_dir: str) -> DataFrame:
    ranked = ranking.percentile_rank(scored_view(spark, sf_dir), "score", "rank", ["dataset_name"])
    return rounded(ranked.select("record_id", "dataset_name", "rank"))


def stable_row_ids(spark: Spark, sf_dir: str) -> DataFrame:
    return ranking.stable_row_ids(kpi_view(spark, sf_dir).select("record_id", "cell_id"), "record_id")


def sort_multi(spark: Spark, sf_dir: str) -> DataFrame:
    """Worst records first by several keys, with the position kept as a column."""
    scored = scored_view(spark, sf_dir)
    sweep = materialise(metrics.threshold_sweep(scored), "sweep")
    ordered = sweep.orderBy(F.desc("roc_auc"), F.desc("recall"), F.desc("precision"), F.desc("f1"), "threshold_percentile")
    return rounded(ordered.select("dataset_name", "threshold_percentile", "roc_auc", "recall", "precision", "f1"))


def head_k(spark: Spark, sf_dir: str) -> DataFrame:
    """The first ten issues in key order."""
    rows = rca.classify(rca.attach_thresholds(kpi_view(spark, sf_dir), "slice_type")).where(F.col("root_cause") != rca.NORMAL)
    return rows.select("record_id", "cell_id", "root_cause").orderBy("record_id").limit(10)


def top_drivers(spark: Spark, sf_dir: str) -> DataFrame:
    rows = feat.clean_infinite(feat.ratio_features(labelled_kpi(spark, sf_dir)), [*KPI_FIELDS, *RATIO_FIELDS])
    found = scoring.top_drivers(rows, scoring.fit_deviation(rows), "label")
    names = ["primary_driver", "secondary_driver", "tertiary_driver"]
    return found.select("record_id", *names, *[f"driver_{i}_deviation" for i in (1, 2, 3)])


# Sampling and perturbation


def sample_n(spark: Spark, sf_dir: str) -> DataFrame:
    return perturb.sample_n(kpi_view(spark, sf_dir).select("record_id", "cell_id", "throughput_mbps"), 2_000)


def train_test_split(spark: Spark, sf_dir: str) -> DataFrame:
    return perturb.train_test_split(kpi_view(spark, sf_dir).select("record_id"))


def winsorize(spark: Spark, sf_dir: str) -> DataFrame:
    rows = kpi_view(spark, sf_dir)
    columns = ["throughput_mbps", "latency_ms", "rsrq_db", "active_users"]
    return rounded(perturb.winsorize(rows, perturb.fit_bounds(rows, columns, 0.05, 0.95, 0.1)).select("record_id", *columns))


def bootstrap_rows(spark: Spark, sf_dir: str) -> DataFrame:
    rows = kpi_view(spark, sf_dir).select("record_id", "throughput_mbps")
    return perturb.bootstrap_rows(rows, rows.count())


def target_prevalence(spark: Spark, sf_dir: str) -> DataFrame:
    rows = scored_view(spark, sf_dir).select("record_id", "score", "label")
    return perturb.target_prevalence(rows, 0.1, rows.count())


def split_strata(spark: Spark, sf_dir: str) -> DataFrame:
    return perturb.split_strata(kpi_view(spark, sf_dir).select("record_id"), 7)


def regime_shift(spark: Spark, sf_dir: str) -> DataFrame:
    regimes = {"macro": perturb.CROSS_REGIMES["weak_coverage_cells"], "micro": perturb.NETWORK_REGIMES["Congested network"]}
    rows = feat.ratio_features(kpi_view(spark, sf_dir))
    columns = [*KPI_FIELDS, *RATIO_FIELDS]
    shifted = perturb.regime_shift(rows, regimes, perturb.fit_deviations(rows, columns), "cell_type")
    return rounded(shifted.select("record_id", "rsrp_dbm", "rsrq_db", "packet_loss_pct", "active_users", "latency_ms"), 5)


def inject_fault(spark: Spark, sf_dir: str) -> DataFrame:
    rows = feat.ratio_features(kpi_view(spark, sf_dir))
    levels = perturb.fit_fault_levels(rows, perturb.fault_columns())
    faulty = perturb.inject_fault(perturb.assign_faults(rows, 0.3), levels)
    return rounded(
        faulty.select(
            "record_id", "ground_truth_label", "anomaly_family", "difficulty", "latency_ms", "packet_loss_pct",
            "throughput_mbps", "prb_utilization_pct", "active_users", "rsrp_dbm", "rsrq_db",
        ),
        5,
    )


# Score columns


def iforest_offset(spark: Spark, sf_dir: str) -> DataFrame:
    offsets = scoring.fit_offsets(scored_view(spark, sf_dir))
    rows = scored_view(spark, sf_dir).agg(F.count(F.lit(1)).alias("rows"))
    return rounded(rows.withColumns({name: F.lit(value) for name, value in offsets.items()}))


def risk_normalize(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(scoring.risk_normalize(scored_view(spark, sf_dir)).select("record_id", "risk"))


def score_table(spark: Spark, sf_dir: str) -> DataFrame:
    return scoring.score_table(scoring.risk_normalize(scored_view(spark, sf_dir)), predicted="label")


def score_fusion(spark: Spark, sf_dir: str) -> DataFrame:
    rows = scored_view(spark, sf_dir).join(kpi_view(spark, sf_dir).select("record_id", "rsrp_dbm", "throughput_mbps"), "record_id")
    fused = scoring.score_fusion(rows, ["score", "rsrp_dbm", "throughput_mbps"], ["dataset_name"])
    return rounded(fused.select("record_id", "weighted_average", "rank_aggregation", "percentile_max"))


def mean_fusion(spark: Spark, sf_dir: str) -> DataFrame:
    scored = scored_view(spark, sf_dir)
    offsets = scoring.fit_offsets(scored)
    return rounded(scoring.mean_fusion(scoring.ensemble_scores(scored, offsets), list(offsets)).select("record_id", "raw_score"))


def ensemble_scores(spark: Spark, sf_dir: str) -> DataFrame:
    scored = scored_view(spark, sf_dir)
    offsets = scoring.fit_offsets(scored)
    return rounded(scoring.ensemble_scores(scored, offsets).select("record_id", *offsets))


def live_decision(spark: Spark, sf_dir: str) -> DataFrame:
    rows = scored_view(spark, sf_dir).join(kpi_view(spark, sf_dir).select("record_id", "sla_compliant"), "record_id")
    decided = scoring.live_decision(rows, 1.5, "score", override_compliant=True)
    return decided.select("record_id", "is_anomaly", "anomaly_status")


def production_output(spark: Spark, sf_dir: str) -> DataFrame:
    rows = feat.ratio_features(kpi_view(spark, sf_dir)).join(scored_view(spark, sf_dir).select("record_id", "score", "label"), "record_id")
    rows = feat.clean_infinite(rows, [*KPI_FIELDS, *RATIO_FIELDS]).withColumnsRenamed({"score": "ensemble_score", "label": "is_anomaly"})
    # Read six times below: joined once, with the columns that are used.
    rows = materialise(rows.select("record_id", *KPI_FIELDS, *RATIO_FIELDS, "ensemble_score", "is_anomaly"), "scored_rows")
    return scoring.production_output(rows, scoring.fit_deviation(rows), "given")


QUERIES = {
    f.__name__: f
    for f in (
        median_impute, mode_impute, dedupe_rows, outlier_flag, standard_scale, variance_filter, corr_matrix, cov_matrix,
        corr_prune, top_correlations, feature_report, select_features, kpi_profile, value_counts, rca_coverage,
        score_summary, anomaly_summary, score_histogram, histogram_overlap, class_separation, mutual_information,
        neighbour_information, feature_power, select_by_power, importance_rank, confusion, class_metrics, roc_auc, pr_auc, curve_points, f1_curve,
        best_f1_threshold, threshold_sweep, sweep_average_row, constrained_best, method_comparison, rank_score_best,
        argmax_row, family_recall, failure_ranking, heaviest_errors, metric_gains, prevalence, thr_percentile, thr_iqr, thr_mad,
        thr_gaussian, thr_gmm, thr_gmm_parameters, thr_evt, thr_evt_likelihood, apply_threshold, threshold_matrix, percentile_rank, dataset_partition_rank,
        stable_row_ids, sort_multi, head_k, top_drivers, sample_n, train_test_split, winsorize, bootstrap_rows,
        target_prevalence, split_strata, regime_shift, inject_fault, iforest_offset, risk_normalize, score_table,
        score_fusion, mean_fusion, ensemble_scores, live_decision, production_output,
    )
}
