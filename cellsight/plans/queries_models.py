"""Registered queries: forest, retrieval, streaming and composed jobs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from cellsight.operators import cells, forest as iforest, forest_growth, perturb, rca, recommend, retrieval, scoring
from cellsight.operators.features import ratio_features
from cellsight.plans import jobs
from cellsight.plans.common import Spark, explained, kpi_view, labelled_kpi, materialise, rounded, scored_view, table, time_text
from cellsight.plans.queries_tables import NOW, _pages, _stored_lines
from cellsight.session import scratch_path
from cellsight.sources import readers, sinks
from cellsight.sources.schema import KPI_FIELDS
from cellsight.streaming import live

# Forest


def iforest_fit(spark: Spark, sf_dir: str) -> DataFrame:
    forest = iforest.fit_forest(kpi_view(spark, sf_dir), KPI_FIELDS)
    return spark.createDataFrame(forest.nodes, iforest.NODE_SCHEMA)


def _scored_by_forest(spark: Spark, sf_dir: str) -> DataFrame:
    rows = kpi_view(spark, sf_dir)
    return iforest.score_forest(rows, iforest.fit_forest(rows, KPI_FIELDS)).select("record_id", "score")


def iforest_score(spark: Spark, sf_dir: str) -> DataFrame:
    return _scored_by_forest(spark, sf_dir)


def iforest_predict(spark: Spark, sf_dir: str) -> DataFrame:
    scored = materialise(_scored_by_forest(spark, sf_dir), "scores")
    return iforest.predict(scored, scoring.fit_offsets(scored, [0.05])["score_5"])


def iforest_share(spark: Spark, sf_dir: str) -> DataFrame:
    """Scores of 350 trees, each grown on three quarters of all rows."""
    rows = kpi_view(spark, sf_dir)
    return rounded(forest_growth.score_grown(rows, rows, KPI_FIELDS, trees=350, max_samples=0.75).select("record_id", "score"))


def iforest_share_nodes(spark: Spark, sf_dir: str) -> DataFrame:
    """Size and shape of each of those trees; the nodes of a tree add up to its sample."""
    nodes = forest_growth.grown_nodes(kpi_view(spark, sf_dir), KPI_FIELDS, trees=350, max_samples=0.75)
    leaf = F.col("feature") < 0
    return nodes.groupBy("tree").agg(
        F.max(F.when(F.col("node") == 1, F.col("size"))).alias("sample_rows"), F.count(F.lit(1)).alias("nodes"),
        F.sum(leaf.cast("long")).alias("leaves"), F.sum(F.when(leaf, F.col("size"))).alias("rows_in_leaves"), F.max("depth").alias("levels"),
    )


def param_sweep(spark: Spark, sf_dir: str) -> DataFrame:
    return jobs.param_sweep_job(kpi_view(spark, sf_dir))


# Text and vectors


def chunk_fixed(spark: Spark, sf_dir: str) -> DataFrame:
    return retrieval.chunk_fixed(table(spark, sf_dir, "documents").select("doc_id", "text"))


def chunk_recursive(spark: Spark, sf_dir: str) -> DataFrame:
    return retrieval.chunk_recursive(table(spark, sf_dir, "documents").select("doc_id", "text"))


def embed_text(spark: Spark, sf_dir: str) -> DataFrame:
    """Length of each document vector and its number of non-zero places."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    embedded = retrieval.embed_text(documents, retrieval.fit_embedder(documents, "text"))
    return rounded(
        embedded.selectExpr(
            "doc_id", "sqrt(aggregate(embedding, 0D, (a, x) -> a + x * x)) AS norm", "size(filter(embedding, x -> x <> 0)) AS places"
        )
    )


def normalize_vectors(spark: Spark, sf_dir: str) -> DataFrame:
    doubled = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "transform(embedding, x -> x * 2) AS embedding")
    unit = retrieval.normalize_vectors(doubled)
    return rounded(unit.selectExpr("vec_id", "posexplode(embedding) AS (place, value)"))


def _queries(spark: Spark, sf_dir: str) -> DataFrame:
    """One query vector per label: the mean of its vectors."""
    places = table(spark, sf_dir, "embeddings").selectExpr("label", "posexplode(embedding) AS (place, value)")
    means = places.groupBy("label", "place").agg(F.round(F.avg(F.col("value").cast("double")), 6).alias("mean"))
    # A vector has as many places as the table's vectors have.
    vectors = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("place", "mean"))).alias("cells"))
    return vectors.select(F.col("label").alias("query_id"), F.col("cells.mean").alias("embedding"))


def similarity_join_topk(spark: Spark, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS item_id", "embedding")
    return rounded(retrieval.similarity_topk(_queries(spark, sf_dir), items, 3))


def _index(spark: Spark, sf_dir: str) -> DataFrame:
    """Vectors with the text and metadata of the document of the same number."""
    documents = retrieval.page_metadata(
        table(spark, sf_dir, "documents").selectExpr(
            "doc_id", "concat('kb/', lang, '/', source, '.v', CAST(doc_id AS STRING), '.pdf') AS path", "CAST(n_chars AS INT) AS page", "text"
        ),
        "path", "page", "text",
    )
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    rows = documents.join(vectors, F.col("doc_id") == F.col("vec_id")).withColumn("chunk_id", F.col("doc_id"))
    return rows.select("chunk_id", "embedding", "source", "source_filename", "document_id", "page", "text")


def retrieve_topk(spark: Spark, sf_dir: str) -> DataFrame:
    found = retrieval.retrieve(_queries(spark, sf_dir), _index(spark, sf_dir), 5)
    return rounded(found.select("query_id", F.col("item_id").alias("chunk_id"), "score", F.length("text").alias("length")))


def retrieval_rank(spark: Spark, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS item_id", "embedding")
    return retrieval.similarity_topk(_queries(spark, sf_dir), items, 10).select("query_id", "rank", "item_id")


def retrieve_shape(spark: Spark, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir).withColumn("source_filename", F.expr("IF(page < 1000, '', source_filename)"))
    return rounded(retrieval.retrieve_shape(retrieval.retrieve(_queries(spark, sf_dir), index)))


def index_table(spark: Spark, sf_dir: str) -> DataFrame:
    """Rows per document in a stored and reloaded index."""
    path = scratch_path(spark, "index")
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    chunks = retrieval.chunk_fixed(documents).withColumn("chunk_id", F.concat_ws("#", "doc_id", "chunk_no"))
    retrieval.write_index(retrieval.embed_text(chunks, retrieval.fit_embedder(chunks, "chunk_text")), path)
    return retrieval.read_index(spark, path).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.max(F.size("embedding")).alias("places"))


def _vector_index(spark: Spark, sf_dir: str) -> tuple[DataFrame, cells.CellIndex]:
    """All vectors, and an index of them in coarse cells."""
    path = scratch_path(spark, "cells")
    items = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS item_id", "embedding")
    cells.write_cells(items, path, cells.fit_cells(items))
    return items, cells.CellIndex.read(spark, path)


def index_cells(spark: Spark, sf_dir: str) -> DataFrame:
    """Cell of every stored vector and its distance to the centroid."""
    _, index = _vector_index(spark, sf_dir)
    return rounded(index.items.select("item_id", F.col("cell").cast("int").alias("cell"), "away"))


def retrieve_cells(spark: Spark, sf_dir: str) -> DataFrame:
    """The three nearest vectors of every vector, through the cells of a stored index."""
    items, index = _vector_index(spark, sf_dir)
    return cells.search(items.withColumnRenamed("item_id", "query_id"), index, 3)


def incident_context_text(spark: Spark, sf_dir: str) -> DataFrame:
    """Action text and context of each incident, as digests; the context is found by the handover count."""
    found = retrieval.retrieve_shape(retrieval.retrieve(_queries(spark, sf_dir), _index(spark, sf_dir)))
    contexts = retrieval.context_text(found, ["query_id"])
    contexts = contexts.withColumn("supporting_documentation", F.md5("supporting_documentation"))
    rows = explained(spark, sf_dir).where(F.col("root_cause") != rca.NORMAL)
    incidents = recommend.recommend(rows).select("record_id", "recommendations", F.col("handover_count").cast("int").alias("query_id"))
    texts = retrieval.with_context(incidents, contexts, ["query_id"])
    return texts.select("record_id", F.md5("action_text").alias("actions"), F.col("supporting_documentation").alias("context"))


def _incidents(spark: Spark, sf_dir: str) -> DataFrame:
    rows = explained(spark, sf_dir).where(F.col("root_cause") != rca.NORMAL)
    return rows.select(
        "record_id", "cell_id", "root_cause", "severity", F.col("slice_type").alias("network_slice"),
        F.array_join("affected", ", ").alias("affected_kpis"), "explanation",
    )


def _page_rows(spark: Spark, sf_dir: str) -> DataFrame:
    return retrieval.page_metadata(_pages(spark, sf_dir), "path", "page", "text").select("document_id", "page_number", "page", "source", "source_filename", "text")


def incident_retrieval(spark: Spark, sf_dir: str) -> DataFrame:
    """Number of incidents per searched text, with the size of the context found for it."""
    found = jobs.incident_job(_incidents(spark, sf_dir), _page_rows(spark, sf_dir))
    return found.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("incidents"),
        F.min("root_cause").alias("root_cause"),
        F.max(F.length("supporting_documentation")).alias("context_length"),
    )


# Streaming


def stream_kpi_source(spark: Spark, sf_dir: str) -> DataFrame:
    """Outcome counts of lines that arrive as a stream."""
    sink, checkpoint = scratch_path(spark, "parsed"), scratch_path(spark, "checkpoint")
    lines = live.stream_lines(spark, _stored_lines(spark, sf_dir))
    query = (
        readers.parse_records(lines).writeStream.format("parquet").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(sink)
    )
    query.awaitTermination()
    return spark.read.parquet(sink).groupBy(F.coalesce("error", F.lit("ok")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def _run_live(spark: Spark, sf_dir: str, model: live.LiveModel, override_compliant: bool = True) -> str:
    sink = scratch_path(spark, "live")
    live.run_stream(
        spark, _stored_lines(spark, sf_dir), sink, scratch_path(spark, "checkpoint"), model, NOW, override_compliant
    ).awaitTermination()
    return sink


def stream_score(spark: Spark, sf_dir: str) -> DataFrame:
    model = live.fit_live_model(kpi_view(spark, sf_dir))
    rows = spark.read.parquet(f"{_run_live(spark, sf_dir, model)}/results")
    return rounded(
        rows.groupBy("anomaly_detection.anomaly_status").agg(
            F.count(F.lit(1)).alias("n"), F.avg("anomaly_detection.anomaly_score").alias("mean_score")
        )
    )


def stream_rca(spark: Spark, sf_dir: str) -> DataFrame:
    """Every accepted record of a stream run explained, by a model whose threshold all scores exceed."""
    model = replace(live.fit_live_model(kpi_view(spark, sf_dir)), threshold=-1e9)
    rows = spark.read.parquet(f"{_run_live(spark, sf_dir, model, override_compliant=False)}/results")
    return rows.select(
        "cell_id", "input_kpis.throughput_mbps", "rca.root_cause", "rca.severity",
        F.array_join("rca.affected_kpis", ", ").alias("affected"), F.array_join("rca.matched_signals", " | ").alias("signals"),
        F.expr("array_join(transform(map_entries(rca.score_breakdown), e -> concat(e.key, '=', e.value)), '; ')").alias("score_breakdown"),
    )


def stream_sink(spark: Spark, sf_dir: str) -> DataFrame:
    """Stored result and rejected rows of a stream run."""
    model = live.fit_live_model(kpi_view(spark, sf_dir))
    sink = _run_live(spark, sf_dir, model)
    results = spark.read.parquet(f"{sink}/results").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit("results"))
    rejected = spark.read.parquet(f"{sink}/rejected").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit("rejected"))
    return results.unionByName(rejected)


# Jobs


def detect_job(spark: Spark, sf_dir: str) -> DataFrame:
    return jobs.detect_job(kpi_view(spark, sf_dir))["scores"]


def train_test_job(spark: Spark, sf_dir: str) -> DataFrame:
    return jobs.train_test_job(kpi_view(spark, sf_dir))["scores"]


def rca_job(spark: Spark, sf_dir: str) -> DataFrame:
    return jobs.rca_job(kpi_view(spark, sf_dir))["results"].withColumn("timestamp", time_text())


def profile_job(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(jobs.profile_job(kpi_view(spark, sf_dir))["pairs"].select("feature_a", "feature_b", "corr", "cov"))


def robustness_job(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(jobs.robustness_job(kpi_view(spark, sf_dir))["methods"])


def model_select_job(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(jobs.model_select_job(kpi_view(spark, sf_dir))["methods"])


def param_sweep_job(spark: Spark, sf_dir: str) -> DataFrame:
    return jobs.best_parameters(param_sweep(spark, sf_dir))


def threshold_job(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(jobs.threshold_job(kpi_view(spark, sf_dir))["sweep"])


def production_job(spark: Spark, sf_dir: str) -> DataFrame:
    return jobs.production_job(kpi_view(spark, sf_dir))["scores"]


def live_job(spark: Spark, sf_dir: str) -> DataFrame:
    """Records per status and cause of a stream run."""
    rows = jobs.live_job(kpi_view(spark, sf_dir), _stored_lines(spark, sf_dir), scratch_path(spark, "live"), scratch_path(spark, "checkpoint"), NOW)
    return rows.groupBy("anomaly_detection.anomaly_status", "rca.root_cause").agg(F.count(F.lit(1)).alias("n"))


def incident_job(spark: Spark, sf_dir: str) -> DataFrame:
    found = jobs.incident_job(_incidents(spark, sf_dir), _page_rows(spark, sf_dir))
    return found.select("record_id", "cell_id", "normalized_root_cause", "action_text", "supporting_documentation")


def index_job(spark: Spark, sf_dir: str) -> DataFrame:
    index = jobs.index_job(_page_rows(spark, sf_dir), scratch_path(spark, "index"))
    return index.select("chunk_id", "document_id", "page_number", F.length("text").alias("length"))


QUERIES = {
    f.__name__: f
    for f in (
        iforest_fit, iforest_score, iforest_predict, iforest_share, iforest_share_nodes, param_sweep, chunk_fixed, chunk_recursive, embed_text,
        normalize_vectors, similarity_join_topk, retrieve_topk, retrieval_rank, retrieve_shape, index_table, index_cells, retrieve_cells,
        incident_context_text, incident_retrieval, stream_kpi_source, stream_score, stream_rca, stream_sink, detect_job,
        train_test_job, rca_job, profile_job, robustness_job, model_select_job, param_sweep_job, threshold_job,
        production_job, live_job, incident_job, index_job,
    )
}
