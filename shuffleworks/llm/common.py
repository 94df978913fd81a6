"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shuffleworks.session import scratch_path, shuffles_removed

#: What the contracts call white space: ``[\x20\x09-\x0D]``.
SPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later plans start from files that every executor can reach, so a lost
    executor costs no earlier step. Spark also knows the size of the table, and
    broadcasts it in a join only below its own threshold. ``options`` are those of the writer.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables between steps like those of ``cut``, which go as soon as no later step reads them.

    A step's shuffle files go when its table is written, not when the driver collects its garbage.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def cut(self, name: str, *parts: DataFrame | Iterable[DataFrame]) -> DataFrame:
        """The rows of all parts, written one after the other; a part is made when its turn comes."""
        path = self.paths[name] = scratch_path(self.spark, name)
        schema = None
        with shuffles_removed(self.spark):
            for part in (x for p in parts for x in ([p] if isinstance(p, DataFrame) else p)):
                part.write.mode("append").parquet(path)
                schema = part.schema
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables. No frame that is still to be run may read them."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_text(column: str = "text") -> Column:
    """The text, with null as the empty one."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` named in ``kept``, one for each of its rows, with the columns of ``docs``.

    ``kept`` has doc_id, text_key (``xxhash64`` of the text), n_chars and
    ``repeated``: whether another row has the same three. Only such rows need a
    second shuffle, which leaves one of them.
    """
    key, size, again = (fresh(docs, n) for n in ("_text_key", "_n_chars", "_repeated"))
    kept_id, kept_key, kept_size = (fresh(docs, n) for n in ("_kept_id", "_kept_key", "_kept_size"))
    marked = docs.withColumns({key: F.xxhash64(whole_text()), size: F.length(whole_text()).cast("long")})
    names = kept.select(
        F.col("doc_id").alias(kept_id), F.col("text_key").alias(kept_key), F.col("n_chars").alias(kept_size), F.col("repeated").alias(again)
    ).distinct()
    found = marked.join(
        names,
        marked["doc_id"].eqNullSafe(names[kept_id]) & (marked[key] == names[kept_key]) & (marked[size] == names[kept_size]),
    )
    result = found.where(~F.col(again)).select(*docs.columns)
    if kept.where("repeated").isEmpty():
        return result
    return result.unionByName(found.where(again).dropDuplicates(["doc_id", key, size]).select(*docs.columns))
