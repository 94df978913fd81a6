"""Trees of files listed and read by tasks.

A round lists all folders of one depth, each in a task, so the driver sees no names and a
tree takes as many rounds as it is deep. A single folder is listed by one task, in batches.
Contents are read by tasks too, a file at a time. Names that start with ``_`` or ``.`` are
names like any other. Files are reached through pyarrow's file systems.
"""

from __future__ import annotations

import os
import posixpath
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shuffleworks.session import durable

SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?")
BATCH_BYTES = 32 << 20
BATCH_ROWS = 10_000


def address(root: str) -> str:
    """The folder with a scheme and without dots, as pyarrow and Spark both take it."""
    scheme = SCHEME.match(root)
    folder = posixpath.normpath(root[scheme.end() :] if scheme else os.path.abspath(root))
    head = scheme.group() if scheme else "file://"
    return (head if head.endswith("//") or "://" in head else head + "//") + folder


def store_of(uri: str):
    """The file system of an address, and the path on it. Characters of a path stand for themselves."""
    from pyarrow import fs

    scheme = SCHEME.match(uri)
    if not scheme or scheme.group().startswith("file:"):
        return fs.LocalFileSystem(), uri[scheme.end() :] if scheme else uri
    return fs.FileSystem.from_uri(scheme.group() + quote(uri[scheme.end() :]))


def _folder(root: str, below: str):
    store, base = store_of(root)
    return store, base.rstrip("/") + ("/" + below if below else "")


def _list(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for below in batch.column(0).to_pylist():
                store, folder = _folder(root, below)
                found = store.get_file_info(fs.FileSelector(folder))
                for i in range(0, len(found), BATCH_ROWS):
                    part = found[i : i + BATCH_ROWS]
                    paths = [f"{below}/{f.base_name}" if below else f.base_name for f in part]
                    columns = [paths, [f.base_name for f in part], [not f.is_file for f in part], [f.size if f.is_file else None for f in part]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.bool_(), pa.int64()))], names=["path", "name", "is_folder", "size_bytes"])

    return run


def list_files(spark: SparkSession, root: str, skip: list[str] | None = None) -> DataFrame:
    """``path`` (below the root), ``name, size_bytes`` of all files; folders named in ``skip`` are not gone into. A missing root is an error."""
    from pyarrow import fs

    root = address(root)
    store, base = _folder(root, "")
    if store.get_file_info(base).type != fs.FileType.Directory:
        raise AnalysisException(f"[PATH_NOT_FOUND] there is no folder {root}")
    folders = spark.createDataFrame([("",)], "path string")
    found = None
    while True:
        listed = durable(folders.repartition("path").mapInArrow(_list(root), "path string, name string, is_folder boolean, size_bytes bigint"))
        files = listed.where("not is_folder").select("path", "name", "size_bytes")
        found = files if found is None else found.unionByName(files)
        folders = listed.where("is_folder").where(~F.col("name").isin(skip or [])).select("path")
        if folders.isEmpty():
            return found


def _read(root: str, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = size = 0
            held: list[bytes] = []
            for i, path in enumerate(batch.column(at).to_pylist()):
                store, name = _folder(root, path)
                with store.open_input_stream(name) as file:
                    held.append(file.read())
                size += len(held[-1])
                if size >= BATCH_BYTES or i == batch.num_rows - 1:
                    rows = batch.slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(held, pa.binary())], names=[*batch.schema.names, "content"])
                    start, size, held = i + 1, 0, []

    return run


def with_content(files: DataFrame, root: str) -> DataFrame:
    """``files`` with the bytes of each, read by the tasks that the paths are dealt to."""
    schema = T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType())])
    return files.repartition("path").mapInArrow(_read(address(root), files.columns.index("path")), schema)
