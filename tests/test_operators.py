"""Operators against hand-worked rows and small NumPy references."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellsight.functions.text import parse_breakdown, split_list, with_number_texts
from cellsight.operators import clean, features, forest, joins, metrics, perturb, profile, quantiles, ranking, rca, retrieval, scoring, thresholds
from cellsight.sources import readers
from cellsight.sources.fixtures import kpi_view, scored_view
from cellsight.sources.schema import KPI_FIELDS
from cellsight.streaming import live

LIMITS = {
    "very_low_throughput": 20.0, "low_throughput": 50.0, "high_latency": 60.0, "very_high_latency": 90.0, "high_packet_loss": 2.0,
    "very_high_packet_loss": 4.0, "high_prb": 85.0, "very_high_prb": 90.0, "high_users": 200.0, "low_users": 50.0,
    "high_handover": 8.0, "very_high_handover": 12.0, "weak_rsrp": -110.0, "poor_rsrq": -15.0, "very_poor_rsrq": -18.0,
}
SCHEMA = (
    "throughput_mbps double, latency_ms double, packet_loss_pct double, handover_count long, rsrp_dbm double, rsrq_db double, "
    "prb_utilization_pct double, active_users long, sla_compliant int"
)


def explain(spark, *rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return rca.explain_rows(rca.with_global_thresholds(df, LIMITS)).collect()


def test_golden_rows(spark):
    a, b = explain(spark, (22.0, 118.0, 3.8, 9, -86.0, -10.0, 97.0, 315, 0), (35.0, 95.0, 4.8, 14, -116.0, -18.5, 91.0, 240, 0))
    names = list(rca.SCORE_COLUMNS.values())
    assert [a[n] for n in names] == [9, 2, 6, 3, 4, 7]
    assert [b[n] for n in names] == [9, 2, 7, 8, 7, 8]
    assert (a.root_cause, a.severity, a.confidence_score) == ("RAN Congestion", "High", 0.90)
    assert a.signals == [
        "very high PRB utilization (97.0)", "high active users (315)", "low throughput (22.0)", "high latency (118.0)", "high packet loss (3.8)",
    ]
    assert a.affected == ["throughput_mbps", "latency_ms", "packet_loss_pct", "prb_utilization_pct", "active_users", "handover_count"]
    assert b.affected == a.affected[:5] + ["rsrp_dbm", "rsrq_db", "handover_count"]


def test_gate_and_ties(spark):
    none = (None,) * 8
    compliant, unknown, empty, tie, weak, nan = explain(
        spark,
        (22.0, 118.0, 3.8, 9, -86.0, -10.0, 97.0, 315, 1),
        (100.0, 10.0, 0.0, 1, -80.0, -5.0, 60.0, 100, None),
        (*none, 0),
        (10.0, 10.0, 0.0, 1, -80.0, -5.0, 91.0, 300, 0),
        (100.0, 10.0, 0.0, 1, -80.0, -5.0, 60.0, 100, 0),
        (float("nan"), 10.0, 0.0, 1, -80.0, -5.0, 60.0, 100, 0),
    )
    assert (compliant.root_cause, compliant.confidence_score, compliant.affected) == ("Normal", 0.95, [])
    assert unknown.root_cause == "Normal"
    assert (empty.root_cause, empty.confidence_score) == (rca.GENERIC, 0.50)
    assert tie.congestion_score == 7 and tie.outage_score == 3 and tie.root_cause == rca.CONGESTION
    assert weak.root_cause == rca.GENERIC and weak.score_breakdown.startswith("RAN Congestion=0; Suspected")
    assert nan.affected == []


def test_outage_wins_ties(spark):
    row = explain(spark, (15.0, 70.0, 0.0, 1, -80.0, -5.0, 40.0, 300, 0))[0]
    assert row.outage_score == 6 and row.congestion_score == 5 and row.root_cause == rca.OUTAGE
    row = explain(spark, (15.0, 10.0, 0.0, 1, -80.0, -5.0, 40.0, 30, 0))[0]
    assert row.outage_score == 7 and row.confidence_score == 0.90


def test_number_texts(spark):
    values = [1e7, 0.0001, 1.5e-5, 123456789.25, -2.5e8, 1e16, 1.234e20, -0.0005, 0.001, 3.5, 0.0]
    df = with_number_texts(spark.createDataFrame([(v,) for v in values], "x double"), {"t": ("x", False)})
    assert {r.x: r.t for r in df.collect()} == {v: repr(v) for v in values}


def test_text_lists(spark):
    row = spark.sql("SELECT 'a=1; b / c=x; q; a=3; e=f=4' AS t, ' x | |y ' AS p, CAST(NULL AS STRING) AS n").select(
        parse_breakdown(F.col("t")).alias("m"), split_list(F.col("p"), "|").alias("p"), split_list(F.col("n"), ",").alias("n")
    ).first()
    assert row.m == {"b / c": 0, "a": 3, "e=f": 4} and row.p == ["x", "y"] and row.n == []


@pytest.mark.parametrize("parts", [1, 7])
def test_distributed_quantiles_match_numpy(spark, sf_dir, parts):
    rows = kpi_view(spark, sf_dir).repartition(parts)
    wanted = {"throughput_mbps": [0.0, 0.05, 0.2, 0.5, 1.0], "latency_ms": [0.8, 0.95], "handover_count": [0.85]}
    data = rows.select("slice_type", *wanted).toPandas()
    for by in ([], ["slice_type"]):
        found = quantiles.exact_quantiles(rows, wanted, by).collect()
        for r in found:
            part = data if not by else data[data["slice_type"] == r.slice_type]
            assert r.value == pytest.approx(np.percentile(part[r.feature].dropna().astype(float), r.prob * 100), rel=1e-12)
        assert len(found) == 8 * (3 if by else 1)


def test_quantiles_survive_a_missed_bracket(spark, sf_dir):
    rows = kpi_view(spark, sf_dir).select("throughput_mbps")
    values = rows.toPandas()["throughput_mbps"]
    found = quantiles._narrowed(rows, {"throughput_mbps": [0.5]}, [], None).first()
    assert found.value == pytest.approx(np.percentile(values, 50)) and not found.outside


def test_percentile_rank_with_a_hot_value(spark):
    rows = spark.range(60_000).selectExpr("id", "IF(id % 3 = 0, 5D, CAST(id AS DOUBLE)) AS score")
    data = rows.toPandas()
    ranked = ranking.percentile_rank(rows, "score", "rank").toPandas().set_index("id")["rank"].sort_index()
    expected = data["score"].rank(pct=True)
    assert np.allclose(ranked.to_numpy(), expected.to_numpy())
    assert 0 < ranked.min() and ranked.max() <= 1


def test_rank_plan_has_no_single_task_window(spark, sf_dir):
    plan = ranking.value_ranks(scored_view(spark, sf_dir), "score", ["dataset_name"])
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "spark_partition_id" not in text and "Window" in text and "_range" in text


def test_auc_of_negated_scores(spark, sf_dir):
    scored = scored_view(spark, sf_dir)
    up = {r.dataset_name: r.roc_auc for r in metrics.roc_auc(metrics.score_steps(scored)).collect()}
    down = metrics.roc_auc(metrics.score_steps(scored.withColumn("score", -F.col("score")))).collect()
    assert all(abs(1 - up[r.dataset_name] - r.roc_auc) < 1e-12 for r in down)


def test_mixture_recovers_two_groups(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(0, 1, 9_000), rng.normal(6, 0.5, 1_000)])
    scored = spark.createDataFrame([(float(v),) for v in values], "score double")
    fit = thresholds.fit_mixture(scored, [], tolerance=1e-6).first()
    assert fit.w1 == pytest.approx(0.1, abs=0.01) and fit.m1 == pytest.approx(6, abs=0.1) and fit.m0 == pytest.approx(0, abs=0.1)


def test_pair_moments_match_numpy(spark, sf_dir):
    rows = kpi_view(spark, sf_dir)
    data = rows.select(*KPI_FIELDS).toPandas().astype(float)
    corr, cov = data.corr(), data.cov()
    for r in profile.pair_moments(rows, KPI_FIELDS).collect():
        assert r["corr"] == pytest.approx(corr.loc[r.feature_a, r.feature_b], abs=1e-9)
        assert r["cov"] == pytest.approx(cov.loc[r.feature_a, r.feature_b], rel=1e-9, abs=1e-7)


def test_forest_is_reproducible_and_ranks_outliers(spark, sf_dir):
    rows = kpi_view(spark, sf_dir)
    first = forest.fit_forest(rows.repartition(3), KPI_FIELDS, trees=20)
    second = forest.fit_forest(rows.repartition(11), KPI_FIELDS, trees=20)
    assert first.nodes.equals(second.nodes)
    scored = forest.score_forest(rows, first).select("score", *KPI_FIELDS).toPandas()
    direct = forest.score_matrix(forest._pack(first), scored[KPI_FIELDS].fillna(0.0).to_numpy(float))[:, 0]
    assert np.allclose(scored["score"], direct)
    outlier = spark.createDataFrame([(0.0, 1e4, 1e3, 1000, -500.0, -300.0, 1e3, 10_000)], ", ".join(f"{c} double" if c not in ("handover_count", "active_users") else f"{c} long" for c in KPI_FIELDS))
    assert forest.score_forest(outlier, first).first().score > np.percentile(scored["score"], 99)


def test_path_length():
    assert forest.average_path(1) == 0 and forest.average_path(2) == 1
    assert forest.average_path(256) == pytest.approx(2 * (math.log(255) + 0.5772156649) - 2 * 255 / 256)
    assert forest.resolve_sample_size(0.75, 1_000_000) == 750_000 and forest.resolve_sample_size(1.0, 40_000) == 40_000
    with pytest.raises(ValueError):
        forest.resolve_sample_size(0.75, 1_000_000, most=4_096)


def test_outliers_scaling_and_categories(spark):
    df = spark.createDataFrame([(i, float(i), 5.0, None, "ab"[i % 2]) for i in range(10)], "id long, x double, c double, e double, k string")
    fences = clean.fit_fences(df, ["x", "c", "e"])
    assert set(fences) == {"x"}
    scaled = clean.scale(df, clean.fit_scaler(df, ["x", "c"])).agg(F.avg("x"), F.stddev_pop("x"), F.max("c")).first()
    assert scaled[0] == pytest.approx(0) and scaled[1] == pytest.approx(1) and scaled[2] == 0
    encoded = clean.one_hot(spark.createDataFrame([("z",)], "k string"), clean.fit_categories(df, ["k"])).first()
    assert (encoded.k_a, encoded.k_b) == (0, 0)


def test_chunks_restore_the_text(spark):
    text = " ".join(f"word{i}" for i in range(400))
    chunks = retrieval.chunk_fixed(spark.createDataFrame([(1, text)], "id int, text string")).orderBy("chunk_no").collect()
    assert "".join(c.chunk_text[:400] for c in chunks[:-1]) + chunks[-1].chunk_text == text
    assert [len(c.chunk_text) for c in retrieval.chunk_fixed(spark.createDataFrame([(1, "x" * 1200)], "id int, text string")).collect()] == [500, 500, 400]


def test_recursive_chunks():
    text = "one two three four five six seven eight nine ten"
    chunks = retrieval.split_recursively(text, 20, 8, retrieval.SEPARATORS)
    assert all(len(c) <= 20 for c in chunks) and chunks[0] == "one two three four" and chunks[1].startswith("four")
    assert retrieval.split_recursively("a" * 25, 10, 2, retrieval.SEPARATORS) == ["a" * 10, "a" * 10, "a" * 9]


def test_topk_of_large_query_sets_equals_brute_force(spark, sf_dir, monkeypatch):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    queries, items = rows.selectExpr("vec_id AS query_id", "embedding"), rows.selectExpr("vec_id AS item_id", "embedding")
    near = {(r.query_id, r["rank"]): r.item_id for r in retrieval.similarity_topk(queries, items, 3).collect()}
    monkeypatch.setattr(retrieval, "BROADCAST_NUMBERS", 6_400)
    large = {(r.query_id, r["rank"]): r.item_id for r in retrieval.similarity_topk(queries, items, 3).collect()}
    data = rows.orderBy("vec_id").toPandas()
    x = np.vstack(data["embedding"]).astype(float)
    best = np.argsort(-np.round(x @ x.T, 6), axis=1, kind="stable")[:, :3]
    assert near == large == {(q, k + 1): int(best[q, k]) for q in range(len(x)) for k in range(3)}


def test_joins_keep_null_keys(spark):
    left = spark.createDataFrame([(1, None), (2, "a")], "i int, k string")
    right = spark.createDataFrame([(None, 7), ("a", 8)], "k string, v int")
    assert {(r.i, r.v) for r in joins.null_safe_join(left, right, ["k"]).collect()} == {(1, 7), (2, 8)}


def test_json_records(spark):
    good = {c: 1.5 for c in KPI_FIELDS}
    lines = [json.dumps(good), "[1]", "5", '{"a":', json.dumps({"latency_ms": 1}), json.dumps({**good, "latency_ms": None})]
    parsed = readers.parse_records(spark.createDataFrame([(line,) for line in lines], "value string")).collect()
    assert [r.error for r in parsed] == [None, "not_an_object", "not_an_object", "bad_json", "missing_fields", None]
    assert "latency_ms" not in parsed[4].missing and len(parsed[4].missing) == 7


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    reference = kpi_view(spark, sf_dir)
    model = live.fit_live_model(reference, trees=10)
    model.write(spark, str(tmp_path / "model"))
    model = live.LiveModel.read(spark, str(tmp_path / "model"))
    source = str(tmp_path / "in")
    reference.where("handover_count < 3").select(F.to_json(F.struct(*KPI_FIELDS, "cell_id")).alias("value")).write.text(source)
    now = "2024-01-01 00:00:00"
    live.run_stream(spark, source, str(tmp_path / "out"), str(tmp_path / "cp"), model, now).awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out" / "results")).drop("batch").select(F.to_json(F.struct("*")).alias("r"))
    batch = live.process(spark.read.text(source), model, now).select(F.to_json(F.struct("*")).alias("r"))
    assert sorted(r.r for r in streamed.collect()) == sorted(r.r for r in batch.collect())


def test_empty_and_bad_input(spark):
    with pytest.raises(ValueError):
        scoring.risk_normalize(spark.createDataFrame([], "score double"))
    with pytest.raises(ValueError):
        forest.fit_forest(spark.createDataFrame([], "record_id long, x double"), ["x"])
    with pytest.raises(ValueError):
        retrieval.similarity_topk(spark.createDataFrame([], "query_id int, embedding array<double>"), spark.createDataFrame([], "item_id int, embedding array<double>"))
    constant = scoring.risk_normalize(spark.createDataFrame([(2.0,), (2.0,)], "score double"))
    assert [r.risk for r in constant.collect()] == [0.0, 0.0]


def test_feature_plan_stays_in_the_jvm(spark, sf_dir):
    rows = rca.explain_rows(rca.attach_thresholds(kpi_view(spark, sf_dir), "slice_type"))
    text = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "BroadcastHashJoin" in text
    assert features.engineered_names(features.base_features())


def test_ranks_keep_rows_without_a_score(spark):
    rows = spark.createDataFrame([(1, 2.0), (2, None), (3, 2.0), (4, 5.0)], "record_id long, score double")
    ranked = {r["record_id"]: r["rank"] for r in ranking.percentile_rank(rows, "score", "rank").collect()}
    assert ranked == {1: 0.5, 2: None, 3: 0.5, 4: 1.0}


def test_row_ids_are_unique_for_repeated_and_missing_keys(spark):
    rows = spark.createDataFrame([(5, "b"), (5, "a"), (None, "x"), (1, "z"), (5, "a")], "record_id long, cell_id string")
    found = sorted((r["row_id"], r["record_id"], r["cell_id"]) for r in ranking.stable_row_ids(rows, "record_id").collect())
    assert found == [(1, 1, "z"), (2, 5, "a"), (3, 5, "a"), (4, 5, "b"), (5, None, "x")]


def test_draws_and_strata_with_repeated_keys(spark):
    rows = spark.createDataFrame([(i % 40, i) for i in range(100)], "record_id long, v long")
    assert perturb.bootstrap_rows(rows, 100).count() == 100
    sizes = [r["count"] for r in perturb.split_strata(rows, 7).groupBy("stratum").count().collect()]
    assert sum(sizes) == 100 and max(sizes) - min(sizes) <= 1


def test_sampled_rows_split_into_both_parts(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "record_id")
    split = perturb.train_test_split(perturb.sample_n(rows, 2_000), seed="42|split")
    counts = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert counts["train"] + counts["test"] == 2_000 and 0.15 < counts["test"] / 2_000 < 0.25


def test_column_names_of_any_characters(spark):
    names = ["a b", "c-d.e", "it's", "q`r"]
    df = spark.createDataFrame([(float(i), i * 2.0, float(i % 3), None if i == 4 else 1.0 * i * i) for i in range(9)], "w double, x double, y double, z double").toDF(*names)
    assert quantiles.quantile_values(df, {c: (c, 0.5) for c in names}) == {"a b": 4.0, "c-d.e": 8.0, "it's": 1.0, "q`r": 17.0}
    grouped = df.withColumn("g", F.lit(1))
    assert {r.feature: r.value for r in quantiles.exact_quantiles(grouped, {c: [0.5] for c in names}, ["g"]).collect()}["q`r"] == 17.0
    assert {r.feature for r in profile.variances(df, names).collect()} == set(names)
    assert profile.corr_matrix(df, names).where("feature_a = 'a b' AND feature_b = 'c-d.e'").first()["corr"] == pytest.approx(1.0)
    report = profile.feature_report(df, names, [], [], [])
    assert {r.feature: r.missing_count for r in report.collect()} == {"a b": 0, "c-d.e": 0, "it's": 0, "q`r": 1}
    prepared = clean.impute(df, clean.fit_medians(df, names))
    assert clean.scale(prepared, clean.fit_scaler(prepared, names)).columns == names


def test_stress_sets_mix_regimes_and_mark_faults(spark, sf_dir):
    base = features.ratio_features(kpi_view(spark, sf_dir))
    sets = perturb.stress_sets(base, [0.05, 0.4]).groupBy("dataset_name", "operating_regime", "ground_truth_label").count().collect()
    total = base.count()
    for name, rate in (("stress_test_dataset_rate_0p05", 0.05), ("stress_test_dataset_rate_0p4", 0.4)):
        found = {(r.operating_regime, r.ground_truth_label): r["count"] for r in sets if r.dataset_name == name}
        assert sum(found.values()) == total
        assert set(found) == {(perturb.INJECTED_REGIME, 1), *((regime, 0) for regime in perturb.REGIME_SHARES)}
        assert found[perturb.INJECTED_REGIME, 1] / total == pytest.approx(rate, abs=0.01)
        for regime, share in perturb.REGIME_SHARES.items():
            assert found[regime, 0] / total == pytest.approx(share * (1 - rate), abs=0.01)
    swept = perturb.sweep_sets(base, [0.15]).groupBy("anomaly_family").count().collect()
    assert {r.anomaly_family for r in swept} == {"Normal", *perturb.SWEEP_PATTERNS}


def test_production_rows_are_joined_once(spark, sf_dir, monkeypatch):
    """The rows handed to the output are stored, so none of its passes repeats their join."""
    from cellsight.plans import queries_stats

    plans = []
    made = scoring.production_output

    def watched(rows, *rest):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return made(rows, *rest)

    monkeypatch.setattr(scoring, "production_output", watched)
    assert queries_stats.production_output(spark, sf_dir).count() > 0
    assert len(plans) == 1 and "Join" not in plans[0]


def test_faults_are_drawn_once_per_choice(spark):
    """Chance, family, difficulty and quarter: one hash each, not one per name."""
    marked = perturb.assign_faults(spark.range(100).withColumnRenamed("id", "record_id"), 0.3)
    assert marked._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 4
    assert marked.where("ground_truth_label = 1 AND (anomaly_family IS NULL OR difficulty IS NULL)").count() == 0


def test_wide_projections_stay_compiled(spark, sf_dir):
    """A session of its own settings gets the limit of generated methods with the first KPI rows."""
    name = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.set(name, "65535")
    kpi_view(spark, sf_dir)
    assert spark.conf.get(name) == "8000"


def test_rows_are_dealt_before_they_are_multiplied(spark, sf_dir):
    """The sets of a table that one task reads are made by all tasks."""
    base = features.ratio_features(kpi_view(spark, sf_dir))
    plan = perturb.stress_sets(base, [0.05, 0.2])._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("Generate") < plan.index("RepartitionByExpression [record_id")


def test_filtered_lines_are_parsed_once(spark):
    lines = spark.createDataFrame([("{}",)], "value string").repartition(1)
    for part in (readers.accepted(readers.parse_records(lines)), readers.quarantine(readers.parse_records(lines))):
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        assert plan.lower().count("parsejson") + plan.lower().count("parse_json") == 1


def test_rows_outside_the_condition_stay_unexplained(spark, sf_dir):
    rows = rca.attach_thresholds(kpi_view(spark, sf_dir), "slice_type").withColumn("asked", F.col("record_id") % 3 == 0)
    every = rca.explain_rows(rows)
    some = rca.explain_rows(rows, only="asked")
    assert some.where("asked").exceptAll(every.where("asked")).isEmpty() and every.where("asked").exceptAll(some.where("asked")).isEmpty()
    for c in ("root_cause", "severity", "score_breakdown", "explanation", "affected", "actions"):
        assert some.where(f"NOT asked AND {c} IS NOT NULL").isEmpty(), c
