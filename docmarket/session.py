"""Session settings the jobs are written for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Everything that decides a result is set here; cluster sizing is left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hot keys in shuffled joins are split at run time.
    "spark.sql.adaptive.skewJoin.enabled": "true",
}
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def build_session(app: str = "docmarket", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; ``master`` only for local runs and tests."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share, named by the cluster in ``spark.checkpoint.dir``.

    Only a local session, as in tests, gets one of its own where the setting is missing.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    known = context._jsc.sc().getCheckpointDir()
    return known.get() if known.isDefined() else tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, in the shared folder, of a table that many later steps read. It outlives executors."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def small_methods(spark: SparkSession) -> None:
    """For wide projections: code that HotSpot would not compile, as a method of it has more than 8,000 bytes, is split.

    Spark's own limit is the largest method there may be; its documentation names 8,000 for HotSpot. A limit that was set stays.
    """
    if spark.conf.get(METHOD_LIMIT, "65535") == "65535":
        spark.conf.set(METHOD_LIMIT, "8000")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
