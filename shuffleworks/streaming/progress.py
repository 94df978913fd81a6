"""Latest progress per run and node, kept up to date by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from shuffleworks.operators.runs import merge_updates

_BATCH, _BASE = "batch_id", "base"


def _path(spark: SparkSession, table: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _committed(spark: SparkSession, table: str, kind: str) -> list[int]:
    """Numbers of the finished folders ``kind=<number>`` of a table, sorted."""
    path, files = _path(spark, table)
    if not files.exists(path):
        return []
    success = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")
    found = [s.getPath() for s in files.listStatus(path)]
    named = [p for p in found if p.getName().startswith(f"{kind}=") and files.exists(success(p))]
    return sorted(int(p.getName().split("=", 1)[1]) for p in named)


def read_updates(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stream of update rows from the Parquet files at ``path``, as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def latest_progress(updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The same merge as in batch, as a streaming aggregate for ``update`` mode.

    The state holds one row per key and has no end by nature.
    """
    return merge_updates(updates, keys, order)


def write_progress(
    updates: DataFrame, keys: list[str], order: list[str], table: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Keep the merged updates of every micro-batch as one folder of a Parquet table.

    There is no state to keep: a batch is reduced to one row per key and written
    under its number, so a repeated batch replaces its own folder. Readers merge
    the folders, see ``read_progress``. The table is there, and empty, before the
    first batch.
    """
    spark = updates.sparkSession
    if not _committed(spark, table, _BASE):
        spark.createDataFrame([], updates.schema).write.mode("overwrite").parquet(f"{table}/{_BASE}=-1")

    def store(batch: DataFrame, batch_id: int) -> None:
        merge_updates(batch, keys, order).write.mode("overwrite").parquet(f"{table}/{_BATCH}={batch_id}")

    writer = updates.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def _parts(spark: SparkSession, table: str) -> tuple[list[str], int]:
    """The folders that make up the table now, and the last batch among them.

    The newest finished base stands for all batches up to its number. A folder
    without its success mark is not read, so a reader never meets half of one.
    """
    bases, batches = _committed(spark, table, _BASE), _committed(spark, table, _BATCH)
    if not bases and not batches:
        raise FileNotFoundError(f"no progress table at {table}: start the stream first")
    base = bases[-1] if bases else -1
    later = [b for b in batches if b > base]
    folders = [f"{table}/{_BASE}={base}"] if bases else []
    return folders + [f"{table}/{_BATCH}={b}" for b in later], max([base, *later])


def read_progress(spark: SparkSession, table: str, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row per key over all batches written so far; no rows before the first."""
    return merge_updates(spark.read.parquet(*_parts(spark, table)[0]), keys, order)


def compact_progress(spark: SparkSession, table: str, keys: list[str], order: list[str]) -> None:
    """Merge the table into one folder, which later reads take for all batches in it.

    The stream goes on writing batches beside it. Folders that the base before it
    already stood for are removed; those of this base stay until the next
    compaction, for readers that have begun.
    """
    folders, last = _parts(spark, table)
    bases = _committed(spark, table, _BASE)
    if bases and last == bases[-1]:
        return
    read_progress(spark, table, keys, order).write.mode("overwrite").parquet(f"{table}/{_BASE}={last}")
    before = bases[-1] if bases else -1
    done = [f"{_BASE}={b}" for b in bases if b < before] + [f"{_BATCH}={b}" for b in _committed(spark, table, _BATCH) if b <= before]
    for name in done:
        path, files = _path(spark, f"{table}/{name}")
        files.delete(path, True)
