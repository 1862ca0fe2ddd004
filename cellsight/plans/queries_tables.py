"""Registered queries: sources, sinks, projections and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cellsight.functions.text import parse_breakdown, split_list
from cellsight.operators import clean, encoding, features as feat, profile, rca, recommend, retrieval, scoring
from cellsight.operators.forest import Forest, fit_forest
from cellsight.plans.common import Spark, explained, joined, kpi_view, labelled_kpi, rounded, scored_view, table, time_text
from cellsight.session import scratch_path
from cellsight.sources import readers, sinks
from cellsight.sources.schema import KPI_FIELDS, RATIO_FIELDS, categorical_columns, numeric_columns
from cellsight.streaming import live

# Names under which the three families are stored as labelled sets.
SET_NAMES = {"macro": "stress_test_dataset_rate_0p05", "micro": "stress_test_dataset_rate_0p1", "pico": "cross_dataset_pico"}
NOW = "2024-01-01 00:00:00"


def _set_name() -> str:
    return "CASE anomaly_family " + " ".join(f"WHEN '{f}' THEN '{n}'" for f, n in SET_NAMES.items()) + " END"


# Sources and sinks


def scan_kpi_csv(spark: Spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "kpi_csv")
    sinks.sink_csv(kpi_view(spark, sf_dir), path)
    return readers.scan_kpi_csv(spark, path).withColumn("timestamp", time_text())


def scan_dataset_glob(spark: Spark, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "labelled_sets")
    for family, name in SET_NAMES.items():
        sinks.sink_csv(scored_view(spark, sf_dir).where(F.col("anomaly_family") == family).drop("dataset_name"), f"{root}/{name}")
    schema = "record_id long, anomaly_family string, score double, label int"
    sets = readers.scan_dataset_glob(spark, [f"{root}/stress_test_dataset_rate_*", f"{root}/cross_dataset_*"], schema)
    return rounded(
        sets.groupBy("dataset_name").agg(
            F.count(F.lit(1)).alias("rows"), F.avg("score").alias("mean_score"), F.sum("label").alias("positives")
        )
    )


def rate_from_path(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(readers.rate_from_path(scored_view(spark, sf_dir).withColumn("dataset_name", F.expr(_set_name()))))


def _json_lines(spark: Spark, sf_dir: str) -> DataFrame:
    """One line per KPI row; some lines are lists, broken texts or plain numbers."""
    record = "to_json(struct(" + ", ".join([*KPI_FIELDS, "cell_id", "cell_type", "slice_type", "sla_compliant"]) + "))"
    return kpi_view(spark, sf_dir).selectExpr(
        f"CASE handover_count WHEN 7 THEN concat('[', {record}, ']') "
        f"WHEN 6 THEN substring({record}, 1, length({record}) - 1) WHEN 5 THEN CAST(active_users AS STRING) "
        f"ELSE {record} END AS value"
    )


def _stored_lines(spark: Spark, sf_dir: str) -> str:
    path = scratch_path(spark, "json_lines")
    _json_lines(spark, sf_dir).write.text(path)
    return path


def scan_json_records(spark: Spark, sf_dir: str) -> DataFrame:
    parsed = readers.scan_json_records(spark, _stored_lines(spark, sf_dir))
    return rounded(
        parsed.groupBy(
            F.coalesce("error", F.lit("ok")).alias("outcome"),
            F.when(F.col("error").isNull() | (F.col("error") == "missing_fields"), F.array_join("missing", ",")).alias("missing"),
        ).agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.when(F.col("error").isNull(), F.expr(clean.coerce_number("throughput_mbps")))).alias("throughput"),
        )
    )


def require_fields(spark: Spark, sf_dir: str) -> DataFrame:
    return readers.missing_fields(kpi_view(spark, sf_dir)).select("record_id", joined("missing_fields"))


def read_feature_report(spark: Spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "feature_report")
    _, report = profile.select_features(clean.drop_id_time(kpi_view(spark, sf_dir)))
    sinks.sink_csv(report, path)
    stored = spark.read.csv(path, header=True)
    names = readers.read_feature_report(stored)
    return stored.where(F.col("feature").isin(names)).select("feature", "dtype")


def sink_csv(spark: Spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "results_csv")
    rows = explained(spark, sf_dir).select("record_id", "root_cause", joined("signals", " | "), "explanation", "confidence_score")
    sinks.sink_csv(rows, path)
    schema = "record_id long, root_cause string, signals string, explanation string, confidence_score double"
    return spark.read.schema(schema).csv(path, header=True, escape='"').fillna("", subset=["signals"])


def json_records(spark: Spark, sf_dir: str) -> DataFrame:
    return scoring.json_records(scoring.score_table(scoring.risk_normalize(scored_view(spark, sf_dir))))


def model_table_io(spark: Spark, sf_dir: str) -> DataFrame:
    """Nodes per tree of a stored and reloaded forest, with the differences to the original."""
    path = scratch_path(spark, "forest")
    forest = fit_forest(kpi_view(spark, sf_dir), KPI_FIELDS)
    forest.write(spark, path)
    loaded = Forest.read(spark, path)
    original = spark.createDataFrame(forest.nodes)
    stored = spark.createDataFrame(loaded.nodes)
    changed = original.exceptAll(stored.select(*original.columns)).groupBy("tree").agg(F.count(F.lit(1)).alias("changed"))
    counts = stored.groupBy("tree").agg(F.count(F.lit(1)).alias("nodes"))
    return counts.join(changed, "tree", "left").fillna(0, subset=["changed"])


def doc_listing(spark: Spark, sf_dir: str) -> DataFrame:
    return readers.doc_listing(spark, sf_dir, "parquet").select("source_filename", "document_id")


def _pages(spark: Spark, sf_dir: str) -> DataFrame:
    """Documents as pages with a path and a zero-based page number."""
    return table(spark, sf_dir, "documents").selectExpr(
        "concat('kb/', lang, '/', source, '.v', CAST(doc_id AS STRING), '.pdf') AS path",
        "CAST(n_chars AS INT) AS page",
        "text",
    )


def page_metadata(spark: Spark, sf_dir: str) -> DataFrame:
    found = retrieval.page_metadata(_pages(spark, sf_dir), "path", "page", "text")
    return found.select("source", "source_filename", "page_number", "document_id", F.length("text").alias("length"))


# Projections


def trim_columns(spark: Spark, sf_dir: str) -> DataFrame:
    kpi = kpi_view(spark, sf_dir).select("record_id", "cell_id", "throughput_mbps")
    return clean.trim_columns(kpi.toDF(" record_id", "cell_id  ", "  throughput_mbps "))


def coerce_types(spark: Spark, sf_dir: str) -> DataFrame:
    texts = kpi_view(spark, sf_dir).selectExpr(
        "record_id",
        "IF(cell_type = 'pico', cell_id, CAST(throughput_mbps AS STRING)) AS number_text",
        "IF(cell_type = 'macro', 'not a time', CAST(timestamp AS STRING)) AS time_text",
    )
    return texts.selectExpr(
        "record_id",
        f"{clean.coerce_number('number_text')} AS number",
        f"date_format({clean.coerce_timestamp('time_text')}, 'yyyy-MM-dd HH:mm:ss') AS time",
    )


def time_features(spark: Spark, sf_dir: str) -> DataFrame:
    return feat.time_features(kpi_view(spark, sf_dir)).select("record_id", "hour_of_day", "day_of_week", "is_peak_hour")


def ratio_features(spark: Spark, sf_dir: str) -> DataFrame:
    return feat.ratio_features(kpi_view(spark, sf_dir)).select("record_id", *RATIO_FIELDS)


def clean_infinite(spark: Spark, sf_dir: str) -> DataFrame:
    raw = kpi_view(spark, sf_dir).selectExpr(
        "record_id",
        "IF(active_users = 0, double('Infinity'), throughput_mbps / active_users) AS per_user",
        "IF(prb_utilization_pct = 0, double('NaN'), throughput_mbps / prb_utilization_pct) AS per_block",
    )
    return feat.clean_infinite(raw, ["per_user", "per_block"])


def one_hot_static(spark: Spark, sf_dir: str) -> DataFrame:
    encoded = feat.one_hot_static(kpi_view(spark, sf_dir))
    return encoded.select("record_id", *[c for c in encoded.columns if c.startswith(("cell_type_", "slice_type_"))])


def one_hot_dynamic(spark: Spark, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    known = clean.fit_categories(events.where(F.col("event_type") != "error"), ["event_type"])
    return clean.one_hot(events, known)


ENCODED = ["l_partkey", "l_suppkey", "l_linestatus"]


def _sparse_lines(spark: Spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines encoded by the stored categories of the lines that were not returned."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", *ENCODED)
    path = scratch_path(spark, "dictionary")
    encoding.write_dictionary(encoding.fit_dictionary(lines.where("l_returnflag <> 'R'"), ENCODED), path)
    dictionary = encoding.read_dictionary(spark, path)
    return encoding.one_hot_sparse(lines, dictionary, ENCODED), dictionary


def one_hot_sparse(spark: Spark, sf_dir: str) -> DataFrame:
    encoded, _ = _sparse_lines(spark, sf_dir)
    return encoded.selectExpr("l_orderkey", "l_linenumber", "array_join(positions, ',') AS positions")


def one_hot_shares(spark: Spark, sf_dir: str) -> DataFrame:
    """The means of all one-hot columns by return flag."""
    shares = encoding.column_shares(*_sparse_lines(spark, sf_dir), ["l_returnflag"])
    return rounded(shares.select("l_returnflag", "feature", "value", "ones", "share"), 9)


def _coded_reference(spark: Spark, sf_dir: str) -> DataFrame:
    """Rows of two cell types with a numeric code; the third type is not in the reference."""
    return kpi_view(spark, sf_dir).where("cell_type <> 'pico'").selectExpr(
        "cell_type", "IF(cell_type = 'macro', 3D, 8D) AS cell_type_enc"
    )


def label_encode(spark: Spark, sf_dir: str) -> DataFrame:
    rows = kpi_view(spark, sf_dir).select("record_id", "cell_type")
    return feat.label_encode(rows, _coded_reference(spark, sf_dir), "cell_type", "cell_type_enc")


def distinct_mapping(spark: Spark, sf_dir: str) -> DataFrame:
    return feat.distinct_mapping(_coded_reference(spark, sf_dir), "cell_type", "cell_type_enc")


def minmax_vs_reference(spark: Spark, sf_dir: str) -> DataFrame:
    kpi = feat.ratio_features(kpi_view(spark, sf_dir))
    columns = [*KPI_FIELDS, *RATIO_FIELDS]
    ranges = feat.fit_ranges(kpi.where("cell_type = 'macro'"), columns)
    return rounded(feat.minmax_features(kpi, ranges).select("record_id", *[f"{c}_norm" for c in columns]))


def _basic(spark: Spark, sf_dir: str) -> DataFrame:
    return feat.basic_features(kpi_view(spark, sf_dir))


def pair_features(spark: Spark, sf_dir: str) -> DataFrame:
    return feat.pair_features(_basic(spark, sf_dir)).select("record_id", *feat.PAIRS)


def composite_indices(spark: Spark, sf_dir: str) -> DataFrame:
    return feat.composite_indices(_basic(spark, sf_dir)).select("record_id", *feat.INDICES)


def context_z(spark: Spark, sf_dir: str) -> DataFrame:
    rows = _basic(spark, sf_dir)
    scored = feat.context_z(rows, feat.fit_context(rows))
    names = [f"{c}_{k}" for c in feat.CONTEXT_FEATURES for k in ("robust_context_z", "batch_z")]
    return rounded(scored.select("record_id", *names))


def reference_stats_join(spark: Spark, sf_dir: str) -> DataFrame:
    rows = _basic(spark, sf_dir)
    stats = feat.fit_context(rows.where("cell_type = 'macro'"))
    scored = feat.context_z(rows, stats)
    return rounded(scored.select("record_id", *[c for c in scored.columns if c.endswith("_z")]))


def drop_id_time(spark: Spark, sf_dir: str) -> DataFrame:
    return clean.drop_id_time(kpi_view(spark, sf_dir))


def split_types(spark: Spark, sf_dir: str) -> DataFrame:
    """Kind and number of values of each column of the event and KPI tables."""
    parts = []
    for name, df in (("kpi", kpi_view(spark, sf_dir)), ("events", table(spark, sf_dir, "events"))):
        numeric, categorical = numeric_columns(df), categorical_columns(df)
        kinds = {c: "numeric" if c in numeric else "categorical" if c in categorical else "other" for c in df.columns}
        cells = ", ".join(f"struct('{c}' AS feature, '{k}' AS kind, n_{c} AS present)" for c, k in kinds.items())
        counts = df.agg(*[F.count(c).alias(f"n_{c}") for c in df.columns])
        parts.append(counts.selectExpr(f"'{name}' AS source", f"inline(array({cells}))"))
    return parts[0].unionByName(parts[1])


def _feature_counts(spark: Spark, sf_dir: str) -> DataFrame:
    """Every raw and engineered feature name with its number of values."""
    rows = feat.composite_indices(feat.pair_features(_basic(spark, sf_dir)))
    names = [c for c in rows.columns if c not in ("record_id", "timestamp", "cell_id")]
    counts = rows.agg(*[F.count(c).alias(c) for c in names])
    return counts.selectExpr("inline(array(" + ", ".join(f"struct('{c}' AS feature, {c} AS present)" for c in names) + "))")


def kpi_columns(spark: Spark, sf_dir: str) -> DataFrame:
    return profile.kpi_columns(_feature_counts(spark, sf_dir))


def feature_taxonomy(spark: Spark, sf_dir: str) -> DataFrame:
    return profile.feature_taxonomy(_feature_counts(spark, sf_dir))


def risk_status(spark: Spark, sf_dir: str) -> DataFrame:
    return scoring.score_table(scoring.risk_normalize(scored_view(spark, sf_dir)))


def risk_level(spark: Spark, sf_dir: str) -> DataFrame:
    rows = scoring.risk_normalize(scored_view(spark, sf_dir), floor=1e-9, output="normalized_score")
    return rows.select("record_id", F.expr(scoring.risk_level(flag="label")).alias("risk_level"))


def _scaled(spark: Spark, sf_dir: str) -> DataFrame:
    """Ratios added, then every KPI and ratio standard-scaled."""
    rows = feat.ratio_features(labelled_kpi(spark, sf_dir))
    return clean.scale(rows, clean.fit_scaler(rows, [*KPI_FIELDS, *RATIO_FIELDS]))


def family_candidate(spark: Spark, sf_dir: str) -> DataFrame:
    rows = _scaled(spark, sf_dir)
    return rows.select("record_id", F.expr(scoring.family_candidate(rows, "label")).alias("family"))


def _live_texts(spark: Spark, sf_dir: str) -> DataFrame:
    """KPI rows as text records; some identities are empty and some flags absent."""
    return kpi_view(spark, sf_dir).selectExpr(
        "record_id",
        *[f"CAST({c} AS STRING) AS {c}" for c in KPI_FIELDS],
        "IF(cell_type = 'macro', '', date_format(timestamp, 'yyyy-MM-dd HH:mm:ss')) AS timestamp",
        "IF(handover_count = 1, '', cell_id) AS cell_id",
        "IF(handover_count = 2, NULL, cell_type) AS cell_type",
        "IF(handover_count = 3, '', slice_type) AS slice_type",
        "IF(handover_count = 4, 'core', NULL) AS network_slice",
        "CAST(sla_compliant AS STRING) AS sla_compliant",
        "handover_count <> 5 AS has_sla",
    )


def sla_infer(spark: Spark, sf_dir: str) -> DataFrame:
    return kpi_view(spark, sf_dir).select("record_id", F.expr(live.infer_sla()).alias("sla"))


def enrich_defaults(spark: Spark, sf_dir: str) -> DataFrame:
    enriched = live.enrich_defaults(_live_texts(spark, sf_dir), NOW)
    return enriched.select("record_id", "timestamp", "cell_id", "cell_type", "slice_type", "network_slice", "sla_compliant")


def live_incident_id(spark: Spark, sf_dir: str) -> DataFrame:
    return kpi_view(spark, sf_dir).select("record_id", F.expr(live.incident_id("CAST(record_id AS STRING)")).alias("incident_id"))


# Root causes


def rca_sla_gate(spark: Spark, sf_dir: str) -> DataFrame:
    rows = rca.score_rows(rca.attach_thresholds(kpi_view(spark, sf_dir), "slice_type"))
    return rows.select("record_id", F.expr(rca.is_issue(rows, "affected")).alias("is_issue"))


def rca_rule_scores(spark: Spark, sf_dir: str) -> DataFrame:
    rows = rca.score_rows(rca.attach_thresholds(kpi_view(spark, sf_dir), "slice_type"))
    return rows.select("record_id", *rca.SCORE_COLUMNS.values())


def rca_signals(spark: Spark, sf_dir: str) -> DataFrame:
    return explained(spark, sf_dir).select("record_id", joined("signals", " | "))


def rca_affected_kpis(spark: Spark, sf_dir: str) -> DataFrame:
    return explained(spark, sf_dir).select("record_id", joined("affected"))


def rca_classify(spark: Spark, sf_dir: str) -> DataFrame:
    rows = rca.classify(rca.attach_thresholds(kpi_view(spark, sf_dir), "slice_type"))
    return rows.select("record_id", "root_cause", "top_score")


def rca_confidence(spark: Spark, sf_dir: str) -> DataFrame:
    return explained(spark, sf_dir).select("record_id", "confidence_score")


def rca_severity_actions(spark: Spark, sf_dir: str) -> DataFrame:
    return explained(spark, sf_dir).select("record_id", "severity", joined("actions", " | "))


def rca_explanation(spark: Spark, sf_dir: str) -> DataFrame:
    return explained(spark, sf_dir).select("record_id", "explanation")


def score_breakdown_text(spark: Spark, sf_dir: str) -> DataFrame:
    return explained(spark, sf_dir).select("record_id", "score_breakdown")


def score_breakdown_parse(spark: Spark, sf_dir: str) -> DataFrame:
    parsed = explained(spark, sf_dir).select("record_id", parse_breakdown(F.col("score_breakdown")).alias("scores"))
    return parsed.select("record_id", *[F.col("scores")[cause].alias(name) for cause, name in rca.SCORE_COLUMNS.items()])


def split_lists(spark: Spark, sf_dir: str) -> DataFrame:
    rows = explained(spark, sf_dir).select(
        "record_id",
        split_list(F.array_join("signals", " | "), "|").alias("signals"),
        split_list(F.array_join("affected", ", "), ",").alias("affected"),
    )
    return rows.select(
        "record_id",
        F.size("signals").alias("n_signals"),
        F.get("signals", 0).alias("first_signal"),
        F.size("affected").alias("n_affected"),
        F.get("affected", F.size("affected") - 1).alias("last_affected"),
    )


def incident_id(spark: Spark, sf_dir: str) -> DataFrame:
    rows = rca.analyse(kpi_view(spark, sf_dir))
    return rows.select("incident_id", time_text(), F.col("`cell_id/site_id`"), "network_slice", "sla_compliant", "root_cause")


def adapt_incident(spark: Spark, sf_dir: str) -> DataFrame:
    return rca.adapt_incidents(rca.analyse(kpi_view(spark, sf_dir))).withColumn("timestamp", time_text())


def incident_listing(spark: Spark, sf_dir: str) -> DataFrame:
    return rca.listing(rca.analyse(kpi_view(spark, sf_dir)))


def retrieval_query_text(spark: Spark, sf_dir: str) -> DataFrame:
    rows = explained(spark, sf_dir).where(F.col("root_cause") != rca.NORMAL)
    rows = rows.withColumn("affected_kpis", F.array_join("affected", ", ")).withColumn("network_slice", F.col("slice_type"))
    return retrieval.query_text(rows).select("record_id", "query")


def slice_thresholds(spark: Spark, sf_dir: str) -> DataFrame:
    kpi = kpi_view(spark, sf_dir)
    every = rca.compute_thresholds(kpi).withColumn("slice_type", F.lit("__all__"))
    return rounded(rca.compute_thresholds(kpi, "slice_type").unionByName(every))


def slice_threshold_join(spark: Spark, sf_dir: str) -> DataFrame:
    kpi = kpi_view(spark, sf_dir).withColumn("slice_type", F.expr("IF(sla_compliant IS NULL, NULL, slice_type)"))
    return rounded(rca.attach_thresholds(kpi, "slice_type").select("record_id", *rca.THRESHOLDS))


# Joins


def calibration_join(spark: Spark, sf_dir: str) -> DataFrame:
    scores = scored_view(spark, sf_dir).select("record_id", "score")
    flags = labelled_kpi(spark, sf_dir).select("record_id", F.expr("CAST(latency_ms >= 96 AND packet_loss_pct >= 4 AS INT)").alias("is_anomaly"))
    flags = flags.withColumn("is_anomaly", F.coalesce("is_anomaly", F.lit(0)))
    threshold = scoring.calibrate(scores, flags)
    return rounded(scores.agg(F.count(F.lit(1)).alias("rows")).withColumn("threshold", F.lit(threshold)))


def feature_power_join(spark: Spark, sf_dir: str) -> DataFrame:
    """Power of the KPIs attached to the list of all KPIs."""
    rows = labelled_kpi(spark, sf_dir)
    power = profile.feature_power(rows, KPI_FIELDS)
    names = profile.variances(rows, KPI_FIELDS).select("feature")
    return rounded(profile.power_report(names, power))


def recommendation_join(spark: Spark, sf_dir: str) -> DataFrame:
    rows = explained(spark, sf_dir).select("record_id", "cell_id", "root_cause")
    found = recommend.recommend(rows)
    return found.select("record_id", "cell_id", F.col("normalized_root_cause").alias("root_cause"), joined("recommendations", " | "))


def semi_join_features(spark: Spark, sf_dir: str) -> DataFrame:
    names = profile.variances(kpi_view(spark, sf_dir), KPI_FIELDS).select("feature")
    return _feature_counts(spark, sf_dir).join(names, "feature", "left_semi")


def new_features_anti(spark: Spark, sf_dir: str) -> DataFrame:
    names = profile.variances(kpi_view(spark, sf_dir), KPI_FIELDS).select("feature")
    return _feature_counts(spark, sf_dir).join(names, "feature", "left_anti")


def union_frames(spark: Spark, sf_dir: str) -> DataFrame:
    scored = scored_view(spark, sf_dir)
    normal = scored.where("label = 0").drop("anomaly_family").withColumn("source", F.lit("normal"))
    faulty = scored.where("label = 1").withColumn("source", F.lit("faulty")).select("source", "label", "score", "dataset_name", "record_id")
    return rounded(normal.unionByName(faulty))


QUERIES = {
    f.__name__: f
    for f in (
        scan_kpi_csv, scan_dataset_glob, rate_from_path, scan_json_records, require_fields, read_feature_report, sink_csv,
        json_records, model_table_io, doc_listing, page_metadata, trim_columns, coerce_types, time_features, ratio_features,
        clean_infinite, one_hot_static, one_hot_dynamic, one_hot_sparse, one_hot_shares, label_encode, distinct_mapping, minmax_vs_reference, pair_features,
        composite_indices, context_z, reference_stats_join, drop_id_time, split_types, kpi_columns, feature_taxonomy,
        risk_status, risk_level, family_candidate, sla_infer, enrich_defaults, live_incident_id, rca_sla_gate,
        rca_rule_scores, rca_signals, rca_affected_kpis, rca_classify, rca_confidence, rca_severity_actions,
        rca_explanation, score_breakdown_text, score_breakdown_parse, split_lists, incident_id, adapt_incident,
        incident_listing, retrieval_query_text, slice_thresholds, slice_threshold_join, calibration_join,
        feature_power_join, recommendation_join, semi_join_features, new_features_anti, union_frames,
    )
}
