"""Classes in source files: what is declared, and which role each class has.

All of it works on one file per row, so nothing here shuffles but the counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shuffleworks.constants import (
    CLASS_PATTERN,
    COMBINER_NAME_PATTERN,
    DRIVER_IMPORTS,
    DRIVER_NAME_PATTERN,
    IMPORT_PATTERN,
    MAIN_METHOD,
    PACKAGE_PATTERN,
    ROLES,
)
from shuffleworks.functions.text import (
    code_only,
    decode_utf8,
    null_if_empty,
    split_top_level,
    squeeze_blanks,
)

UNCLASSIFIED = "unclassified"


def split_good_bad(files: DataFrame, path: str = "path", content: str = "content") -> tuple[DataFrame, DataFrame]:
    """(files with text, files that cannot be read as ``file, error``).

    Bytes that are not UTF-8 are replaced and the file is kept, with
    ``was_repaired`` set. Only a file without content goes to the side output.
    """
    text = decode_utf8(F.col(content))
    good = (
        files.where(F.col(content).isNotNull())
        .withColumn("was_repaired", ~F.is_valid_utf8(F.col(content).cast("string")))
        .withColumn(content, text)
    )
    bad = files.where(F.col(content).isNull()).select(F.col(path).alias("file"), F.lit("no content").alias("error"))
    return good, bad


def extract_package(content: Column) -> Column:
    return null_if_empty(F.regexp_extract(content, PACKAGE_PATTERN, 1))


def extract_imports(content: Column) -> Column:
    """Imported names in file order, ``a.b.*`` included, static imports not."""
    return F.regexp_extract_all(content, F.lit(IMPORT_PATTERN), F.lit(1))


def _matches(column: Column, pattern: str) -> Column:
    return F.coalesce(column.rlike(pattern), F.lit(False))


def classify_role(class_name: Column, extends: Column, implements: Column, imports: Column, content: Column) -> Column:
    """Role of a class; the first rule that holds decides.

    The imports and the text are those of the whole file, so a helper class in a
    driver's file is a driver too.
    """
    parent = F.coalesce(extends, F.lit(""))
    heritage = F.concat_ws(" ", parent, implements)
    has = heritage.contains
    return (
        F.when(_matches(class_name, COMBINER_NAME_PATTERN) & parent.contains("Reducer"), "combiner")
        .when(has("Mapper<"), "mapper")
        .when(has("Combiner<"), "combiner")
        .when(has("Reducer<"), "reducer")
        .when(has("Partitioner<") | has("HashPartitioner"), "partitioner")
        .when(has("WritableComparable"), "composite_key")
        .when(F.arrays_overlap(imports, F.array(*[F.lit(i) for i in DRIVER_IMPORTS])), "driver")
        .when(content.contains(MAIN_METHOD) & content.contains("Job"), "driver")
        .when(_matches(class_name, DRIVER_NAME_PATTERN), "driver")
        .otherwise(UNCLASSIFIED)
    )


def _parsed_header(header: Column) -> Column:
    """Name, parent and interfaces from the text of one class header."""
    name, parent, interfaces = [F.regexp_extract(header, CLASS_PATTERN, group) for group in (1, 2, 3)]
    listed = F.array_remove(split_top_level(squeeze_blanks(interfaces)), "")
    return F.struct(
        name.alias("class_name"),
        null_if_empty(squeeze_blanks(parent)).alias("extends"),
        listed.alias("implements"),
    )


def _with_role(parsed: Column) -> Column:
    """The role of a parsed class; reads ``imports`` and ``_marks`` of its file."""
    role = classify_role(
        parsed["class_name"], parsed["extends"], parsed["implements"], F.col("imports"), F.col("_marks")
    )
    return F.struct(
        parsed["class_name"].alias("class_name"),
        role.alias("role"),
        parsed["extends"].alias("extends"),
        parsed["implements"].alias("implements"),
    )


def extract_classes(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """One row per class declaration, nested ones included.

    ``class_name, file_path, class_pos, package, role, imports, extends, implements``.
    Comments and literals are taken out before looking for classes; package,
    imports and the role rules read the raw text. The headers are found in one pass and taken
    apart on the short header text. All of a class is made before the rows are
    exploded: a later filter on the role then reads a column, where after the
    explode it would be pushed down as the whole expression and run twice.
    """
    text = F.col(content)
    per_file = files.select(
        F.col(path).alias("file_path"),
        extract_package(text).alias("package"),
        extract_imports(text).alias("imports"),
        # The two facts of the text that the role rules need.
        F.concat_ws(
            " ", F.when(text.contains(MAIN_METHOD), MAIN_METHOD), F.when(text.contains("Job"), "Job")
        ).alias("_marks"),
        text.alias("_text"),
    )
    headers = F.regexp_extract_all(code_only(F.col("_text")), F.lit(CLASS_PATTERN), F.lit(0))
    found = F.transform(F.transform(headers, _parsed_header), _with_role)
    classes = per_file.select("file_path", "package", "imports", F.posexplode(found).alias("class_pos", "_c"))
    return classes.select(
        "_c.class_name", "file_path", "class_pos", "package", "_c.role", "imports", "_c.extends", "_c.implements"
    )


def role_counts(classes: DataFrame) -> DataFrame:
    """``role, n`` for every role, zero when absent; an unknown role counts as unclassified."""
    known = F.when(F.col("role").isin(ROLES), F.col("role")).otherwise(UNCLASSIFIED)
    counts = classes.select(known.alias("_role")).agg(
        *[F.count_if(F.col("_role") == role).alias(role) for role in ROLES]
    )
    return counts.unpivot([], list(ROLES), "role", "n")


def role_summary(classes: DataFrame) -> DataFrame:
    """``role, n`` for the roles that occur, by name; no role counts as unclassified."""
    role = F.coalesce("role", F.lit(UNCLASSIFIED))
    return classes.groupBy(role.alias("role")).agg(F.count(F.lit(1)).alias("n")).orderBy("role")


