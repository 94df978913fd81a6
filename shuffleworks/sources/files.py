"""Scans over trees of source files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shuffleworks.constants import BUILD_FILE_NAMES, SCHEMA_SUFFIX, SKIP_DIRS, SOURCE_SUFFIX
from shuffleworks.functions.text import decode_utf8
from shuffleworks.sources import tree

def _listed(spark: SparkSession, root: str, wanted: Column, skip: list[str] | None = None) -> DataFrame:
    """Files below ``root`` whose name is wanted; (path below root, full path, size, bytes). Only these are read."""
    named = tree.list_files(spark, root, skip).where(wanted)
    read = tree.with_content(named, root)
    return read.select("path", F.concat(F.lit(tree.address(root) + "/"), F.col("path")).alias("abs_path"), "size_bytes", "content")


def scan_files(spark: SparkSession, root: str, skip_build_dirs: bool = True) -> DataFrame:
    """Source and build files: ``path, abs_path, size_bytes, content, kind``.

    ``content`` is raw bytes; see ``corpus.split_good_bad`` for the text. A file
    below a build or tool folder is left out, whatever the depth of the folder.
    """
    name = F.col("name")
    files = _listed(spark, root, name.endswith(SOURCE_SUFFIX) | name.isin(BUILD_FILE_NAMES), SKIP_DIRS if skip_build_dirs else None)
    if skip_build_dirs:  # also a file may have the name of such a folder
        files = files.where(~F.exists(F.split("path", "/"), lambda part: part.isin(SKIP_DIRS)))
    kind = F.when(F.col("path").endswith(SOURCE_SUFFIX), "source").otherwise("build")
    return files.withColumn("kind", kind)


def scan_schemas(spark: SparkSession, root: str) -> DataFrame:
    """Avro schema files anywhere below ``root``: ``path, abs_path, size_bytes, content`` (text)."""
    files = _listed(spark, root, F.col("name").endswith(SCHEMA_SUFFIX))
    return files.withColumn("content", decode_utf8(F.col("content")))


def scan_summary(files: DataFrame) -> DataFrame:
    """One row ``total_count, source_count, build_count``."""
    counts = files.agg(
        F.count_if(F.col("kind") == "source").alias("source_count"),
        F.count_if(F.col("kind") == "build").alias("build_count"),
    )
    return counts.select(
        (F.col("source_count") + F.col("build_count")).alias("total_count"), "source_count", "build_count"
    )
