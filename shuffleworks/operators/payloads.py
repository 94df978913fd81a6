"""Payloads that arrive as text: JSON to be salvaged, file maps, code replies, overlays."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shuffleworks.constants import (
    BUILD_FILE_WARNING,
    CODE_BLOCK,
    CODE_ROOT,
    DEFAULT_JOB_NAME,
    FORBIDDEN_PATH_PARTS,
    KEPT_SUFFIX,
    MISSING_FILES_ERROR,
    OTHER_FILE_WARNING,
    STUB_CONTENT,
    STUB_PATH,
)
from shuffleworks.functions.jsontext import salvage_one
from shuffleworks.functions.text import contains_any, strip_blanks
from shuffleworks.operators.ordering import null_free_keys


def salvage_json(df: DataFrame, raw_col: str, keep: list[str] | None = None) -> DataFrame:
    """The JSON inside a text: ``payload, strategy, error`` next to the kept columns.

    Strategies, in order: 1 the text as it is; 2 the first fenced block; 3 from
    the first ``{`` to the last ``}``; 4 the same after dropping control
    characters and doubling stray backslashes. If all fail the row stays, with
    the error. ``keep`` defaults to every column but the raw text.
    """
    kept = [c for c in df.columns if c != raw_col] if keep is None else keep
    fields = [df.schema[c] for c in kept]
    schema = T.StructType(
        [
            *fields,
            T.StructField("payload", T.StringType()),
            T.StructField("strategy", T.IntegerType()),
            T.StructField("error", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [salvage_one(raw) for raw in batch.column(raw_col).to_pylist()]
            columns = [batch.column(name) for name in kept]
            for place, kind in enumerate((pa.string(), pa.int32(), pa.string())):
                columns.append(pa.array([row[place] for row in found], kind))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    # Arrow, not pandas: the kept columns pass through untouched, whatever their type.
    return df.select(*kept, raw_col).mapInArrow(run, schema)


def _warning(path: Column) -> Column:
    return F.when(contains_any(path, FORBIDDEN_PATH_PARTS), F.concat(F.lit(BUILD_FILE_WARNING), path)).when(
        ~path.endswith(KEPT_SUFFIX), F.concat(F.lit(OTHER_FILE_WARNING), path)
    )


def _checked_payloads(df: DataFrame, payload: str) -> DataFrame:
    """Other columns plus ``error``, ``_files`` (path, content, warning, is_text) and ``_given`` warnings.

    One parse gives the files as (path, variant); one pass over them gives type,
    text and warning.
    """
    others = [c for c in df.columns if c != payload]
    document = F.col(payload)
    has_files = F.coalesce(F.array_contains(F.json_object_keys(document), "files"), F.lit(False))
    parsed = F.from_json(document, "files map<string,variant>, warnings array<string>")

    def checked(entry: Column) -> Column:
        return F.struct(
            entry["key"].alias("path"),
            F.try_variant_get(entry["value"], "$", "string").alias("content"),
            _warning(entry["key"]).alias("warning"),
            (F.schema_of_variant(entry["value"]) == "STRING").alias("is_text"),
        )

    files = F.transform(F.map_entries(F.col("_d.files")), checked)
    no_strings = F.array().cast("array<string>")
    bad = F.try_element_at(F.filter("_files", lambda f: ~f["is_text"]), F.lit(1))["path"]
    error = F.when(F.col("_files").isNull() & ~F.col("_has_files"), MISSING_FILES_ERROR).when(
        bad.isNotNull(), F.concat(F.lit("File content for '"), bad, F.lit("' is not a string"))
    )
    return (
        df.select(*others, has_files.alias("_has_files"), parsed.alias("_d"))
        .select(*others, "_has_files", files.alias("_files"), F.coalesce("_d.warnings", no_strings).alias("_given"))
        .select(*others, error.alias("error"), "_files", "_given")
    )


def filter_generated_files(df: DataFrame, payload: str = "payload") -> DataFrame:
    """The files of each payload that are kept: other columns plus ``path, content``.

    Build files and files of another kind are left out. One value that is not a
    string rejects the whole payload; see ``payload_summary`` for the reasons.
    """
    others = [c for c in df.columns if c != payload]
    accepted = F.when(F.col("error").isNull(), F.col("_files"))
    one = _checked_payloads(df, payload).select(*others, F.explode(accepted).alias("_f"))
    return one.where(F.col("_f.warning").isNull()).select(*others, "_f.path", "_f.content")


def payload_warnings(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Warnings per payload in order, the ones it came with first: ``pos, warning``."""
    others = [c for c in df.columns if c != payload]
    dropped = F.filter(F.transform("_files", lambda f: f["warning"]), lambda w: w.isNotNull())
    # Rejected payloads give no list. A filter on the error would be pushed down
    # and parse every payload twice.
    accepted = F.when(F.col("error").isNull(), F.concat("_given", dropped))
    return _checked_payloads(df, payload).select(*others, F.posexplode(accepted).alias("pos", "warning"))


def payload_summary(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Per payload ``file_count, warning_count, rejected, error``; counted inside the row, no shuffle."""
    others = [c for c in df.columns if c != payload]
    kept = F.filter("_files", lambda f: f["warning"].isNull())
    dropped = F.filter("_files", lambda f: f["warning"].isNotNull())
    rejected = F.col("error").isNotNull()
    return _checked_payloads(df, payload).select(
        *others,
        F.when(rejected, 0).otherwise(F.size(kept)).alias("file_count"),
        F.when(rejected, 0).otherwise(F.size("_given") + F.size(dropped)).alias("warning_count"),
        rejected.alias("rejected"),
        "error",
    )


def extract_code_blocks(df: DataFrame, raw: str = "raw", job_name: str = "job_name") -> DataFrame:
    """Code blocks of a reply that was not JSON: other columns plus ``path, content``.

    Fenced blocks that start with ``package``. A block with ``def main`` is the
    driver; else the second block, or one with ``def run``, is the job; else it
    is the service. Of two blocks for one path the last stays. A reply without
    blocks gives one stub file.
    """
    others = [c for c in df.columns if c != raw]
    name = F.coalesce(F.col(job_name), F.lit(DEFAULT_JOB_NAME))

    def path_of(code: Column, at: Column) -> Column:
        where = (
            F.when(code.contains("def main"), F.concat(F.lit("driver/"), name, F.lit("App.scala")))
            .when((at == 1) | code.contains("def run"), F.concat(F.lit("jobs/"), name, F.lit("Job.scala")))
            .otherwise(F.concat(F.lit("service/"), name, F.lit("Service.scala")))
        )
        return F.concat(F.lit(CODE_ROOT), where)

    blocks = F.regexp_extract_all(F.col(raw), F.lit(CODE_BLOCK), F.lit(1))
    files = F.transform(
        blocks, lambda code, at: F.struct(path_of(code, at).alias("path"), strip_blanks(code).alias("content"))
    )
    stub = F.array(F.struct(F.lit(STUB_PATH).alias("path"), F.lit(STUB_CONTENT).alias("content")))
    listed = df.select(*others, files.alias("_files"))
    last_only = F.filter(
        "_files",
        lambda f, at: ~F.exists(
            F.slice("_files", at + 2, F.size("_files")), lambda later: later["path"] == f["path"]
        ),
    )
    result = F.when(F.size("_files") > 0, last_only).otherwise(stub)
    return listed.select(*others, F.explode(result).alias("_f")).select(*others, "_f.path", "_f.content")


def parts_as(parts: list[Column], names: list[str]) -> list[Column]:
    return [p.alias(n) for p, n in zip(parts, names)]


def overlay(base: DataFrame, patch: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``patch`` replace rows of ``base`` with the same key; new keys are added.

    A patched row replaces all base rows of its key, nulls included; base rows
    whose key is not patched all stay, repeats too. A key that the patch has twice
    is an error when the rows are read, since neither row comes first.
    """
    keys = [f"_k{i}" for i in range(2 * len(key))]
    parts = null_free_keys(patch, key)
    patched = patch.select(*parts_as(parts, keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_times"))
    unpatched = base.select("*", *parts_as(null_free_keys(base, key), keys)).join(patched, keys, "left_anti")
    once = patch.select(*base.columns, *parts_as(parts, keys)).join(patched, keys)
    repeated = F.raise_error(F.concat(F.lit("the patch has a key twice: "), F.to_json(F.struct(*key))))
    checked = once.where(F.when(F.col("_times") == 1, F.lit(True)).otherwise(repeated.cast("boolean")))
    return unpatched.select(*base.columns).unionByName(checked.select(*base.columns))


def overlay_map(base: Column, patch: Column) -> Column:
    """The same for two map columns: entries of ``patch`` replace or join those of ``base``."""
    patch = F.coalesce(patch, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(base, lambda key, _: ~F.map_contains_key(patch, key)), patch)
