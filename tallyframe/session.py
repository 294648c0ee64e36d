"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Session-local note of the folder a local session fell back to.
_LOCAL_DIR = "tallyframe.local.dir"


def build_session(
    app_name: str = "tallyframe",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session with adaptive execution, skew-join splitting and UTC timestamps."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master is not None:
        builder = builder.master(master)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a temporary folder; on a cluster a missing
    setting is an error, because files on one machine would be lost with it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    local_mode = spark.sparkContext.master.startswith("local")
    if configured:
        if configured.startswith("file:") and not local_mode:
            raise RuntimeError(f"spark.checkpoint.dir is a folder of one machine: {configured}")
        return configured
    if not local_mode:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    local = spark.conf.get(_LOCAL_DIR, None)
    if local is None:
        local = tempfile.mkdtemp(prefix="tallyframe-")
        spark.conf.set(_LOCAL_DIR, local)
    return local


def work_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def saved_table(df: DataFrame, label: str) -> DataFrame:
    """Write a derived table to the shared folder and read it back.

    Its lineage is cut and its size on disk becomes known, so that Catalyst broadcasts it only
    below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles the join otherwise.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# An input of one default split at most is dealt out; anything larger has splits of its own.
SPREAD_BYTES = 128 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal a tiny scan over the cores, for costly expressions.

    Only an input whose planned size is below ``SPREAD_BYTES`` is dealt out, so that no more than
    that is ever shuffled here. The result is the same either way.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(size)) > SPREAD_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys)
