"""Session settings and the shared folder for checkpoints and written tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
SHUFFLE_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_session(
    app_name: str = "shuffleworks", master: str | None = None, input_bytes: int | None = None, cores: int | None = None, **conf: str
) -> SparkSession:
    """A session with the settings the jobs are tuned for, sized for ``input_bytes`` on ``cores`` if both are given.

    Partition counts are left to adaptive execution: it starts from
    ``spark.sql.shuffle.partitions`` and merges or splits from measured sizes.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if input_bytes and cores:
        settings.update(sizing(input_bytes, cores))
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def sizing(input_bytes: int, cores: int) -> dict[str, str]:
    """Partition settings for an input of this size on this many cores.

    Splits of 128 to 512 MB, as many as keep every core busy without millions of
    tasks; shuffle partitions of about 200 MB, a size a core can sort in memory,
    at least two per core. Adaptive execution merges small ones.
    """
    mega = 1024 * 1024
    split = min(max(input_bytes // 400_000, 128 * mega), 512 * mega)
    partitions = max(input_bytes // (200 * mega), 2 * cores)
    return {
        "spark.sql.files.maxPartitionBytes": str(split),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(200 * mega),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(400 * mega),
    }


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the session names it.

    Without ``spark.checkpoint.dir`` it is a folder of the warehouse. If that is a
    plain local path, other machines cannot read it, so it serves local masters only.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    is_local = warehouse.startswith("file:") or "://" not in warehouse
    if is_local and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share; {warehouse} is one on each machine")
    return warehouse + "/_scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/shuffleworks/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which outlives executors."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


@contextmanager
def arrow_batches(spark: SparkSession, size: str) -> Iterator[None]:
    """Jobs that run in here send Arrow batches of about ``size`` bytes to Python, a row at least.

    A worker holds a batch until it has the next one. The setting is read when a job runs and is the session's, so what
    has to keep to it must be run in here (``durable``); jobs of other threads only get smaller batches meanwhile.
    """
    before = spark.conf.get(BATCH_CONF)
    spark.conf.set(BATCH_CONF, size)
    try:
        yield
    finally:
        spark.conf.set(BATCH_CONF, before)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that run in here remove their shuffle files when they end; a frame that is run again shuffles again."""
    before = spark.conf.get(SHUFFLE_CONF, None)
    spark.conf.set(SHUFFLE_CONF, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CONF)
        else:
            spark.conf.set(SHUFFLE_CONF, before)
