"""Session settings and the shared scratch area for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}
# Bytes of a generated method beyond which the JVM no longer compiles it and runs it many times slower.
COMPILED_METHOD = "8000"


def get_session(app_name: str = "cellsight", **conf: str) -> SparkSession:
    """Build or fetch a session; cluster deployments pass their own sizing through spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.codegen.hugeMethodLimit": COMPILED_METHOD,
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def keep_methods_compiled(spark: SparkSession) -> None:
    """Wide projections run operator by operator, in pieces that the JVM compiles, instead of in one method that it interprets."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", COMPILED_METHOD)


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one named in spark.checkpoint.dir.

    Only a local master may fall back to a temporary folder, because on a cluster the
    folder has to be visible to every executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="cellsight-")
    return _LOCAL_SCRATCH[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the scratch root that no other call has used."""
    return f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str = "table") -> DataFrame:
    """Write `df` once and read it back.

    Cuts the lineage, keeps the result when executors are lost, and gives the optimizer the
    real size, so a later join is broadcast only when the table is below the session's limit.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
