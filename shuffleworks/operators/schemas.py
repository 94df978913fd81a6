"""Schemas from source text: key classes, type parameters and Avro records.

Fields are rows ``source_class, file_path, pos, name, java_type, spark_type, format``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shuffleworks.constants import (
    DEFAULT_TYPE,
    FALLBACK_KEY_FIELD,
    FIELD_PATTERN,
    GENERIC_FIELD_NAMES,
    GENERICS_PATTERN,
    UNKNOWN_JAVA_TYPE,
    WRITE_ACCESS_PATTERN,
)
from shuffleworks.functions.jsontext import is_strict_json
from shuffleworks.functions.text import split_top_level
from shuffleworks.functions.types import spark_type_name, to_spark_type
from shuffleworks.operators.corpus import classify_role

GENERIC_ROLES = ["mapper", "reducer", "combiner"]
FIELD_LIST = "array<struct<name:string,java_type:string>>"


def map_types(df: DataFrame, col: str, table: str = "java", out: str = "spark_type") -> DataFrame:
    return df.withColumn(out, spark_type_name(F.col(col), table))


def _field(name: Column, java_type: Column) -> Column:
    return F.struct(name.alias("name"), java_type.alias("java_type"))


def declared_fields(content: Column) -> Column:
    """Field declarations anywhere in the text, in order, repeats kept.

    Also finds constants and local variables; primitives are not looked for.
    """
    found = F.regexp_extract_all(content, F.lit(FIELD_PATTERN), F.lit(0))
    return F.transform(
        found,
        lambda text: _field(F.regexp_extract(text, FIELD_PATTERN, 2), F.regexp_extract(text, FIELD_PATTERN, 1)),
    )


def written_fields(content: Column) -> Column:
    """Names in ``this.x.write`` and ``this.x.readFields``, in order of first use, type unknown."""
    names = F.array_distinct(F.regexp_extract_all(content, F.lit(WRITE_ACCESS_PATTERN), F.lit(1)))
    return F.transform(names, lambda name: _field(name, F.lit(UNKNOWN_JAVA_TYPE)))


def fallback_fields() -> Column:
    """The one field of a key class whose file is gone."""
    return F.array(_field(F.lit(FALLBACK_KEY_FIELD), F.lit(UNKNOWN_JAVA_TYPE)))


def _explode_fields(df: DataFrame, fields: Column, fmt: str, table: str = "java") -> DataFrame:
    one = df.select("source_class", "file_path", F.posexplode(fields).alias("pos", "_field"))
    return one.select(
        "source_class",
        "file_path",
        "pos",
        F.col("_field.name").alias("name"),
        F.col("_field.java_type").alias("java_type"),
        spark_type_name(F.col("_field.java_type"), table).alias("spark_type"),
        F.lit(fmt).alias("format"),
    )


def _key_classes_with_fields(classes: DataFrame, files: DataFrame, path: str, content: str) -> DataFrame:
    """Composite-key classes with the field list of their file (empty if none was found).

    The text is reduced to field lists before the join, so file contents are
    never shuffled.
    """
    keys = classes.where(F.col("role") == "composite_key").select(
        F.col("class_name").alias("source_class"), "file_path"
    )
    # The first list that is not empty.
    lists = F.array(declared_fields(F.col(content)), written_fields(F.col(content)))
    per_file = files.select(
        F.col(path).alias("_path"),
        F.try_element_at(F.filter(lists, lambda fields: F.size(fields) > 0), F.lit(1)).alias("_found"),
    )
    # One row per path, so that copies of a file cannot multiply classes. The join
    # uses the partitioning of this aggregate.
    per_path = per_file.groupBy("_path").agg(F.max("_found").alias("_found"))
    joined = keys.join(per_path, keys.file_path == per_path._path, "left")
    no_path = F.coalesce(F.col("file_path"), F.lit("")) == ""
    fields = (
        F.when(no_path, F.array().cast(FIELD_LIST))
        .when(F.col("_path").isNull(), fallback_fields())
        .otherwise(F.coalesce("_found", F.array().cast(FIELD_LIST)))
    )
    return joined.select("source_class", "file_path", fields.alias("_fields"))


def composite_key_fields(
    classes: DataFrame, files: DataFrame, path: str = "path", content: str = "content"
) -> DataFrame:
    """Fields of composite-key classes.

    Declared fields of the class' whole file, else fields seen in its write
    methods, else one ``key`` field when the file is missing.
    """
    return _explode_fields(_key_classes_with_fields(classes, files, path, content), F.col("_fields"), "writable")


def own_key_fields(scanned: DataFrame) -> DataFrame:
    """Fields of composite-key classes from each class's own body: not those of other classes of the file, of nested
    ones, of methods, or static ones. Any type counts. ``scanned`` is that of ``javasource.scan``."""
    fields = scanned.select("file_path", "fields", F.explode("types").alias("t"), "imports", "marks")
    role = classify_role(F.col("t.class_name"), F.col("t.extends"), F.col("t.implements"), F.col("imports"), F.col("marks"))
    own = F.filter("fields", lambda f: (f["owner"] == F.col("t.qualified")) & ~f["is_static"])
    keys = fields.where((role == "composite_key") & (F.col("t.kind") == "class"))
    listed = F.transform(own, lambda f: _field(f["name"], f["java_type"]))
    return _explode_fields(keys.select(F.col("t.class_name").alias("source_class"), "file_path", listed.alias("_fields")), F.col("_fields"), "writable")


def unresolved_keys(
    classes: DataFrame, files: DataFrame, path: str = "path", content: str = "content"
) -> DataFrame:
    """Composite-key classes without any field: ``source_class, file_path``."""
    found = _key_classes_with_fields(classes, files, path, content)
    return found.where(F.size("_fields") == 0).select("source_class", "file_path")


def generic_fields(classes: DataFrame) -> DataFrame:
    """Input and output types of mappers, reducers and combiners, from their type parameters.

    The first four parameters count; a class with fewer has no schema.
    """
    parameters = split_top_level(F.regexp_extract("extends", GENERICS_PATTERN, 1))
    typed = classes.where(F.col("role").isin(GENERIC_ROLES)).select(
        F.col("class_name").alias("source_class"), "file_path", parameters.alias("_types")
    )
    named = F.array(
        *[_field(F.lit(name), F.col("_types")[i]) for i, name in enumerate(GENERIC_FIELD_NAMES)]
    )
    return _explode_fields(typed.where(F.size("_types") >= len(GENERIC_FIELD_NAMES)), named, "writable")


def _avro_type(raw: Column) -> Column:
    """Avro type name of a field's raw ``type`` text (a name, a union or an object)."""
    branches = F.from_json(raw, "array<string>")
    chosen = F.coalesce(
        F.try_element_at(F.filter(branches, lambda b: b != "null"), F.lit(1)), F.lit("string")
    )
    one = F.when(raw.startswith("["), chosen).otherwise(F.coalesce(raw, F.lit("string")))
    inner = F.coalesce(F.get_json_object(one, "$.type"), F.lit("string"))
    return F.when(one.startswith("{"), inner).otherwise(one)


def avro_fields(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Fields of Avro record schemas, one file per row. A file that is not JSON, or has no fields, gives no row.

    A union stands for its first branch that is not null, an object for its
    ``type``. Names and logical types inside are not followed.
    """
    valid = files.where(is_strict_json(F.col(content)))
    record = F.from_json(F.col(content), "name string, fields array<struct<name:string,type:string>>")
    parsed = valid.select(F.col(path).alias("file_path"), record.alias("_r")).select(
        F.col("_r.name").alias("source_class"), "file_path", F.col("_r.fields").alias("_raw")
    )
    fields = F.transform(
        "_raw", lambda f: _field(F.coalesce(f["name"], F.lit("field")), _avro_type(f["type"]))
    )
    return _explode_fields(parsed, fields, "avro", table="avro")


def resolve_schemas(
    classes: DataFrame,
    files: DataFrame,
    schema_files: DataFrame | None = None,
    path: str = "path",
    content: str = "content",
) -> tuple[DataFrame, DataFrame]:
    """(all fields, composite keys that could not be resolved)."""
    parts = composite_key_fields(classes, files, path, content).unionByName(generic_fields(classes))
    if schema_files is not None:
        parts = parts.unionByName(avro_fields(schema_files, path, content))
    return parts, unresolved_keys(classes, files, path, content)


def to_struct_type(fields: DataFrame, source_class: str, file_path: str | None = None) -> T.StructType:
    """The schema of one class as a Spark type.

    Collects the fields of one class in one file. Without ``file_path`` that is
    the first file with a class of that name, so copies do not add up.
    """
    of_class = fields.where(F.col("source_class") == source_class)
    if "file_path" in fields.columns:
        path = file_path if file_path is not None else of_class.agg(F.min("file_path")).first()[0]
        of_class = of_class.where(F.col("file_path").eqNullSafe(F.lit(path)))
    rows = of_class.orderBy("pos").select("name", "spark_type").collect()
    if not rows:
        raise ValueError(f"no schema for class {source_class!r}")
    return T.StructType([T.StructField(r["name"], to_spark_type(r["spark_type"] or DEFAULT_TYPE)) for r in rows])


def apply_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast the columns of a text frame to the schema, by name; a bad value becomes null."""

    def typed(field: T.StructField) -> Column:
        if isinstance(field.dataType, T.NullType):
            value = F.lit(None)
        else:
            value = F.col(f"`{field.name}`").try_cast(field.dataType)
        return value.alias(field.name)

    return df.select(*[typed(f) for f in schema.fields])
