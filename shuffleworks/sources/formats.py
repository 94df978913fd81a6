"""Input and output formats of a job, by name or by function."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shuffleworks.constants import DEFAULT_INPUT_FORMAT, DEFAULT_INPUT_PATHS, DEFAULT_OUTPUT_FORMAT, DEFAULT_OUTPUT_PATHS
from shuffleworks.sources import containers


def _as_list(paths: str | list[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def read_lines(spark: SparkSession, paths: str | list[str], with_file: bool = False, offsets: bool = False) -> DataFrame:
    """One row ``value`` per line; on request ``file``, which it came from, and ``offset``, the byte where it begins there.

    Offsets need a second scan, for the bytes of each split. A compressed file counts as its plain text, a file's
    byte order mark as nothing.
    """
    if offsets:
        return _with_offsets(spark, _as_list(paths)).select("offset", "value", *["file"] * with_file)
    lines = spark.read.text(_as_list(paths))
    if with_file:
        lines = lines.select("value", F.col("_metadata.file_path").alias("file"))
    return lines


def _with_offsets(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Bytes before the split, summed over its file, and bytes before the line within the split."""
    # Only line feeds end a line here, so that what is left of it has all other bytes.
    lines = spark.read.option("lineSep", "\n").text(paths)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    splits = lines.groupBy("file", "block").agg(F.sum(F.octet_length("value") + 1).alias("bytes"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = splits.select("file", "block", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("before"))
    named = lines.select("file", "block", F.xxhash64("file", "block").alias("split"), F.col("value").cast("binary").alias("value"))
    within = named.mapInArrow(_within_split, "file string, block long, within long, value binary")
    placed = within.join(F.broadcast(before), ["file", "block"])  # one row per split
    return placed.select((F.col("before") + F.col("within")).alias("offset"), F.col("value").cast("string").alias("value"), "file")


def _within_split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where each line begins in its split, whose lines come one after the other; carriage returns end lines as well."""
    at, done = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        split, values = batch.column("split").to_numpy(), batch.column("value")
        sizes = pc.binary_length(values).to_numpy().astype(np.int64) + 1
        starts = np.cumsum(sizes) - sizes
        head = np.append(True, split[1:] != split[:-1])
        starts -= starts[head][np.cumsum(head) - 1]
        if split[0] == at:
            starts[np.cumsum(head) == 1] += done
        at, done = split[-1], int(starts[-1] + sizes[-1])
        columns = [batch.column("file"), batch.column("block"), pa.array(starts, pa.int64()), values]
        if pc.any(pc.match_substring(values, "\r")).as_py():
            columns = _cut_at_returns(columns)
        yield pa.RecordBatch.from_arrays(columns, names=["file", "block", "within", "value"])


def _cut_at_returns(columns: list[pa.Array]) -> list[pa.Array]:
    rows, within, pieces = [], [], []
    for row, (start, value) in enumerate(zip(columns[2].to_pylist(), columns[3].to_pylist())):
        own = value.split(b"\r")
        if len(own) > 1 and not own[-1]:
            own.pop()  # a return before the line feed, or at the end of the file
        for piece in own:
            rows.append(row)
            within.append(start)
            pieces.append(piece)
            start += len(piece) + 1
    return [columns[0].take(pa.array(rows)), columns[1].take(pa.array(rows)), pa.array(within, pa.int64()), pa.array(pieces, pa.binary())]


def read_parquet(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.parquet(*_as_list(paths))


def write_parquet(
    df: DataFrame, path: str, codec: str | None = None, partition_by: list[str] | None = None, mode: str = "errorifexists"
) -> None:
    writer = df.write.mode(mode)
    if codec:
        writer = writer.option("compression", codec)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_avro(spark: SparkSession, paths: str | list[str], split: int = containers.SPLIT) -> DataFrame:
    """Avro container files, split at their sync markers; the first file's schema counts for all."""
    return containers.read_containers(spark, "avro", _as_list(paths), split)


def write_avro(df: DataFrame, path: str, mode: str = "errorifexists", codec: str = "deflate") -> None:
    containers.write_containers(df, "avro", path, mode, codec=codec)


def read_sequence(
    spark: SparkSession, paths: str | list[str], schema: str | T.StructType = "key string, value string", split: int = containers.SPLIT
) -> DataFrame:
    """SequenceFile of key/value records, split at its sync markers and cast to ``schema``.

    Files of compressed blocks, or of classes that are not Hadoop's own, go through Spark's RDD reader instead, a
    record at a time.
    """
    try:
        found = containers.read_containers(spark, "sequence", _as_list(paths), split)
    except PySparkException as error:
        if "NotImplementedError" not in str(error):
            raise
        return spark.createDataFrame(spark.sparkContext.sequenceFile(",".join(_as_list(paths))), schema)
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return found.select(*[F.col(c).cast(f.dataType).alias(f.name) for c, f in zip(found.columns, wanted.fields)])


def write_sequence(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a two-column frame as a SequenceFile of key/value records. Neither column has nulls."""
    containers.write_containers(df, "sequence", path, mode)


def write_text(df: DataFrame, path: str, sep: str = "\t", mode: str = "errorifexists") -> None:
    """One line per row, ``key<sep>value``. A null key or value leaves out the separator too."""
    line = F.concat_ws(sep, *[F.col(f"`{c}`").cast("string") for c in df.columns])
    df.select(line.alias("value")).write.mode(mode).text(path)


READERS: dict[str, Callable[..., DataFrame]] = {
    "TextInputFormat": read_lines,
    "ParquetInputFormat": read_parquet,
    "AvroKeyInputFormat": read_avro,
    "SequenceFileInputFormat": read_sequence,
    "text": read_lines,
    "parquet": read_parquet,
    "avro": read_avro,
    "sequence": read_sequence,
}
WRITERS: dict[str, Callable[..., None]] = {
    "TextOutputFormat": write_text,
    "ParquetOutputFormat": write_parquet,
    "AvroKeyOutputFormat": write_avro,
    "SequenceFileOutputFormat": write_sequence,
    "text": write_text,
    "parquet": write_parquet,
    "avro": write_avro,
    "sequence": write_sequence,
}


def _named(table: Mapping[str, Callable], name: str) -> Callable:
    if name not in table:
        raise ValueError(f"unknown format {name!r}; known: {', '.join(table)}")
    return table[name]


def read_input(
    spark: SparkSession, input_format: str = DEFAULT_INPUT_FORMAT, input_paths: list[str] | None = None, **options
) -> DataFrame:
    """Read a job's input by format name; several paths give their union."""
    return _named(READERS, input_format)(spark, input_paths or DEFAULT_INPUT_PATHS, **options)


def write_output(
    df: DataFrame, output_format: str = DEFAULT_OUTPUT_FORMAT, output_path: str | None = None, **options
) -> None:
    """Write a job's output by format name."""
    _named(WRITERS, output_format)(df, output_path or DEFAULT_OUTPUT_PATHS[0], **options)


def read_tagged(inputs: Mapping[str, DataFrame], tag_col: str = "tag") -> DataFrame:
    """Union of several inputs, each row tagged with its source.

    Columns are matched by name and missing ones are null. The inputs stay
    separate scans, so each keeps its own pushed filters and columns.
    """
    tagged = [df.withColumn(tag_col, F.lit(tag)) for tag, df in inputs.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
