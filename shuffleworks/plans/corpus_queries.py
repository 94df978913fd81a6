"""Registered queries: classes, schemas, dependencies, job tables, payloads.

Source texts come from ``testkit``, one per row of a given table. The SQL states
what each row must give from its key alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shuffleworks import testkit
from shuffleworks.functions.text import split_top_level
from shuffleworks.operators import corpus, deps, javasource, jobtable, payloads, schemas
from shuffleworks.plans.registry import Registry
from shuffleworks.session import arrow_batches, durable, scratch_path
from shuffleworks.sources import files
from shuffleworks.sources.tree import address
from shuffleworks.testkit import table

REGISTRY = Registry()


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.extract_classes(testkit.code_files(spark, sf_dir))


def _flat(array: str, sep: str = ";") -> Column:
    return F.array_join(F.col(array), sep).alias(array)


# What each file of the generated corpus declares, from its number alone.
_FILES = (
    "(SELECT p_partkey AS k, p_partkey % 10 AS m, p_partkey % 3 AS v, p_partkey // 10 AS b, "
    "'src/p' || (p_partkey // 10) || '/F' || p_partkey || '.java' AS path FROM part)"
)
_CLASS_NAME = (
    "'C' || k || CASE m WHEN 0 THEN 'Mapper' WHEN 1 THEN 'Combiner' WHEN 2 THEN 'Sum' WHEN 3 THEN 'Part' "
    "WHEN 4 THEN 'Key' WHEN 5 THEN 'Job' WHEN 6 THEN 'Start' WHEN 7 THEN 'Runner' WHEN 8 THEN 'Util' ELSE 'Mapper' END"
)
_ROLE = (
    "CASE m WHEN 0 THEN 'mapper' WHEN 1 THEN 'combiner' WHEN 2 THEN 'reducer' WHEN 3 THEN 'partitioner' "
    "WHEN 4 THEN 'composite_key' WHEN 8 THEN 'unclassified' ELSE 'driver' END"
)
_IMPORTS = (
    "CASE m WHEN 0 THEN ['org.apache.hadoop.io.Text'] "
    "WHEN 1 THEN ['org.apache.hadoop.io.Text', 'org.apache.hadoop.io.IntWritable'] "
    "WHEN 5 THEN ['org.apache.hadoop.mapreduce.Job'] WHEN 8 THEN ['com.company.v' || v || '.X', 'java.util.*'] "
    "WHEN 9 THEN ['pig.C' || k] ELSE CAST([] AS VARCHAR[]) END"
)
_CORPUS = f"(SELECT *, {_CLASS_NAME} AS class_name, {_ROLE} AS role, {_IMPORTS} AS imports FROM {_FILES})"


# --- trees of files ---------------------------------------------------------

_TREE = (
    "(SELECT CASE lang WHEN 'en' THEN 'en/' || src || '/D' || doc_id || '.java' WHEN 'de' THEN 'de/_gen/' || src || '/.D' || doc_id || '.java' "
    "ELSE lang || '/.m' || doc_id || '/pom.xml' END AS path, text, CASE WHEN lang IN ('en', 'de') THEN 'source' ELSE 'build' END AS kind "
    "FROM (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, 'xx') AS lang, coalesce(source, 'none') AS src FROM documents) WHERE lang <> 'fr')"
)


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = address(scratch_path(spark, "tree"))
    testkit.written_tree(spark, sf_dir, root)
    return files.scan_files(spark, root)


@REGISTRY.query(f"SELECT path, octet_length(encode(text)) AS size_bytes, md5(text) AS digest, kind FROM {_TREE}")
def scanned_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).select("path", "size_bytes", F.md5("content").alias("digest"), "kind")


@REGISTRY.query(f"SELECT count(*) AS total_count, count_if(kind = 'source') AS source_count, count_if(kind = 'build') AS build_count FROM {_TREE}")
def tree_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.scan_summary(_tree(spark, sf_dir))


# --- classes ----------------------------------------------------------------


@REGISTRY.query(
    "SELECT class_name, path AS file_path, CASE WHEN m <> 8 THEN 'org.gen.p' || b END AS package, role, "
    "array_to_string(imports, ';') AS imports, "
    "CASE m WHEN 0 THEN CASE v WHEN 2 THEN 'org.apache.hadoop.mapreduce.' ELSE '' END || 'Mapper<LongWritable, Text, Text, IntWritable>' "
    "WHEN 1 THEN 'Reducer<Text, IntWritable, Text, IntWritable>' WHEN 2 THEN 'Reducer<Text, IntWritable, Text, LongWritable>' "
    "WHEN 3 THEN 'Partitioner<Text, IntWritable>' WHEN 9 THEN 'Mapper' END AS extends, "
    "CASE m WHEN 4 THEN 'WritableComparable<' || class_name || '>' WHEN 8 THEN 'Closeable;Function<Map<K, V>, X>' ELSE '' END AS implements "
    f"FROM {_CORPUS}"
)
def class_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classes(spark, sf_dir).select(
        "class_name", "file_path", "package", "role", _flat("imports"), "extends", _flat("implements")
    )


@REGISTRY.query(f"SELECT role, count(*) AS n FROM {_CORPUS} GROUP BY role")
def role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.role_counts(_classes(spark, sf_dir))


@REGISTRY.query(f"SELECT role, count(*) AS n FROM {_CORPUS} GROUP BY role")
def role_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.role_summary(_classes(spark, sf_dir))


@REGISTRY.query(
    "SELECT doc_id, md5(CASE WHEN source = 'src0' THEN chr(65533) || text || chr(65533) || '!' ELSE text END) AS digest, "
    "source = 'src0' AS was_repaired FROM documents WHERE lang <> 'de'"
)
def decoded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw bytes: some with broken bytes, and German ones that could not be read at all."""
    text = F.encode("text", "UTF-8")
    broken = F.concat(F.unhex(F.lit("FF")), text, F.unhex(F.lit("C3")), F.encode(F.lit("!"), "UTF-8"))
    raw = F.when(F.col("source") == "src0", broken).otherwise(text)
    files = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("doc_id").alias("path"), F.when(F.col("lang") != "de", raw).alias("content")
    )
    good, _ = corpus.split_good_bad(files)
    return good.select("doc_id", F.md5("content").alias("digest"), "was_repaired")


@REGISTRY.query("SELECT doc_id AS file, 'no content' AS error FROM documents WHERE lang = 'de'")
def unreadable_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("path"), F.when(F.col("lang") != "de", F.encode("text", "UTF-8")).alias("content")
    )
    return corpus.split_good_bad(files)[1]


# --- schemas ----------------------------------------------------------------

_KEY_FIELDS = (
    "SELECT class_name AS source_class, path AS file_path, CAST(f.pos AS INTEGER) AS pos, f.name AS name, "
    "f.java_type AS java_type, f.spark_type AS spark_type, 'writable' AS format FROM (SELECT *, unnest(CASE b % 4 "
    "WHEN 0 THEN [{'pos': 0, 'name': 'f' || k || 'a', 'java_type': 'Text', 'spark_type': 'StringType'}, "
    "{'pos': 1, 'name': 'f' || k || 'b', 'java_type': 'LongWritable', 'spark_type': 'LongType'}] "
    "WHEN 1 THEN [{'pos': 0, 'name': 'g' || k, 'java_type': 'Unknown', 'spark_type': 'StringType'}, "
    "{'pos': 1, 'name': 'h', 'java_type': 'Unknown', 'spark_type': 'StringType'}] "
    "WHEN 2 THEN [{'pos': 0, 'name': 'key', 'java_type': 'Unknown', 'spark_type': 'StringType'}] ELSE [] END) AS f "
    f"FROM {_CORPUS} WHERE m = 4)"
)
_GENERIC_FIELDS = (
    "SELECT class_name AS source_class, path AS file_path, CAST(pos AS INTEGER) AS pos, "
    "['input_key', 'input_value', 'output_key', 'output_value'][pos + 1] AS name, t AS java_type, "
    "CASE t WHEN 'Text' THEN 'StringType' WHEN 'IntWritable' THEN 'IntegerType' ELSE 'LongType' END AS spark_type, "
    "'writable' AS format FROM (SELECT *, CASE m WHEN 0 THEN ['LongWritable', 'Text', 'Text', 'IntWritable'] "
    "WHEN 1 THEN ['Text', 'IntWritable', 'Text', 'IntWritable'] ELSE ['Text', 'IntWritable', 'Text', 'LongWritable'] END[pos + 1] AS t "
    f"FROM {_CORPUS}, range(4) r(pos) WHERE m < 3)"
)
_AVRO_FIELDS = (
    "SELECT 'R' || k AS source_class, 'schemas/r' || k || '.avsc' AS file_path, CAST(pos AS INTEGER) AS pos, "
    "CASE WHEN k % 5 = 3 AND pos = 1 THEN 'field' WHEN pos = 0 THEN 'a' ELSE 'b' END AS name, "
    "[['long', 'string'], ['double', 'string'], ['int', 'bytes'], ['array', 'boolean']][k % 5 + 1][pos + 1] AS java_type, "
    "[['LongType', 'StringType'], ['DoubleType', 'StringType'], ['IntegerType', 'BinaryType'], ['StringType', 'BooleanType']]"
    "[k % 5 + 1][pos + 1] AS spark_type, 'avro' AS format "
    "FROM (SELECT p_partkey AS k FROM part WHERE p_partkey % 5 < 4), range(2) r(pos)"
)


def _kept_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testkit.code_files(spark, sf_dir).where(~F.col("is_deleted"))


@REGISTRY.query(_KEY_FIELDS)
def key_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas.composite_key_fields(_classes(spark, sf_dir), _kept_files(spark, sf_dir))


@REGISTRY.query(f"SELECT class_name AS source_class, path AS file_path FROM {_CORPUS} WHERE m = 4 AND b % 4 = 3")
def unresolved_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas.resolve_schemas(_classes(spark, sf_dir), _kept_files(spark, sf_dir))[1]


@REGISTRY.query(_GENERIC_FIELDS)
def generic_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas.generic_fields(_classes(spark, sf_dir))


@REGISTRY.query(_AVRO_FIELDS)
def avro_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas.avro_fields(testkit.avro_files(spark, sf_dir))


@REGISTRY.query(f"{_KEY_FIELDS} UNION ALL {_GENERIC_FIELDS} UNION ALL {_AVRO_FIELDS}")
def resolved_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = durable(_classes(spark, sf_dir))  # two kinds of schema read them
    return schemas.resolve_schemas(classes, _kept_files(spark, sf_dir), testkit.avro_files(spark, sf_dir))[0]


@REGISTRY.query(
    "SELECT p_partkey, java_type, CASE java_type WHEN 'VIntWritable' THEN 'IntegerType' WHEN 'byte[]' THEN 'BinaryType' "
    "WHEN 'BigDecimal' THEN 'DecimalType(38,10)' WHEN 'Date' THEN 'DateType' ELSE 'StringType' END AS java_spark, "
    "CASE java_type WHEN 'int' THEN 'IntegerType' WHEN 'null' THEN 'NullType' ELSE 'StringType' END AS avro_spark "
    "FROM (SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'VIntWritable' WHEN 'STANDARD' THEN 'byte[]' "
    "WHEN 'PROMO' THEN 'BigDecimal' WHEN 'SMALL' THEN 'Date' ELSE 'null' END AS java_type FROM part)"
)
def mapped_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_type")
    named = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(kind == "ECONOMY", "VIntWritable")
        .when(kind == "STANDARD", "byte[]")
        .when(kind == "PROMO", "BigDecimal")
        .when(kind == "SMALL", "Date")
        .otherwise("null")
        .alias("java_type"),
    )
    both = schemas.map_types(schemas.map_types(named, "java_type", "java", "java_spark"), "java_type", "avro", "avro_spark")
    return both


@REGISTRY.query(
    "SELECT p_partkey, CAST(pos AS INTEGER) AS pos, CASE pos WHEN 0 THEN p_name WHEN 1 THEN 'Map<K, List<V' || p_size || ', W>>' ELSE p_brand END AS part "
    "FROM part, range(3) r(pos)"
)
def split_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(
        F.lit(" "), "p_name", F.lit(" , Map<K, List<V"), F.col("p_size").cast("string"), F.lit(", W>>,"), "p_brand", F.lit(" ,")
    )
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(split_top_level(text)).alias("pos", "part"))


_LINE_FIELDS = [
    ("Line", 0, "l_orderkey", "LongType"),
    ("Line", 1, "l_linenumber", "IntegerType"),
    ("Line", 2, "l_quantity", "DoubleType"),
    ("Line", 3, "l_extendedprice", "DecimalType(38,10)"),
    ("Line", 4, "l_returnflag", "StringType"),
    ("Line", 5, "l_shipdate", "DateType"),
]


@REGISTRY.query(
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'F' THEN l_quantity END AS l_quantity, "
    "l_extendedprice, l_returnflag, "
    "strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate FROM lineitem"
)
def typed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as text, given back their types; the quantity of open lines is not a number."""
    names = [name for _, _, name, _ in _LINE_FIELDS]
    lines = table(spark, sf_dir, "lineitem")
    as_text = lines.withColumn(
        "l_quantity", F.when(F.col("l_linestatus") == "F", F.col("l_quantity").cast("string")).otherwise("n/a")
    ).select(*[F.col(n).cast("string").alias(n) for n in names])
    fields = spark.createDataFrame(_LINE_FIELDS, "source_class string, pos int, name string, spark_type string")
    typed = schemas.apply_schema(as_text, schemas.to_struct_type(fields, "Line"))
    return typed.withColumn("l_extendedprice", F.col("l_extendedprice").cast("double")).withColumn(
        "l_shipdate", F.col("l_shipdate").cast("string")
    )


# --- dependencies -----------------------------------------------------------


@REGISTRY.query(
    f"SELECT path AS file_path, class_name, CAST(i AS INTEGER) AS import_pos, imports[i + 1] AS import "
    f"FROM {_CORPUS}, range(2) r(i) WHERE i < len(imports)"
)
def class_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.explode_imports(_classes(spark, sf_dir)).drop("class_pos")


_PREFIX_ROWS = "(VALUES (0, 'com.company.v1'), (1, 'com.company'), (2, 'pig.'), (3, 'org.apache.hadoop.io.I'), (4, 'org.apache.hadoop')) p(prefix_pos, prefix)"
_IMPORT_ROWS = f"(SELECT *, unnest(imports) AS import FROM {_CORPUS})"


@REGISTRY.query(
    f"SELECT path AS file_path, import, CAST(prefix_pos AS INTEGER) AS prefix_pos, prefix FROM {_IMPORT_ROWS}, {_PREFIX_ROWS} "
    "WHERE starts_with(import, prefix)"
)
def import_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    imports = deps.explode_imports(_classes(spark, sf_dir))
    return deps.match_prefix(imports, "import", testkit.PREFIXES).select("file_path", "import", "prefix_pos", "prefix")


def _site_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every site of the pages, with and without scheme end, as a prefix table."""
    url = F.col("url")
    site = F.regexp_extract(url, "^https?://[^/]+", 0)
    scheme = F.regexp_extract(url, "^https?:", 0)
    prefixes = table(spark, sf_dir, "pages").select(F.explode(F.array(site, scheme)).alias("prefix")).distinct()
    return prefixes.withColumn("prefix_pos", F.length("prefix"))


@REGISTRY.query(
    "SELECT page_id, prefix FROM pages, (SELECT DISTINCT unnest([regexp_extract(url, '^https?://[^/]+'), "
    "regexp_extract(url, '^https?:')]) AS prefix FROM pages) WHERE starts_with(url, prefix)"
)
def page_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return deps.match_prefix(pages, "url", _site_prefixes(spark, sf_dir)).select("page_id", "prefix")


@REGISTRY.query(
    "SELECT p_partkey, word FROM part, (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part) "
    "WHERE contains(p_name, word)"
)
def part_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    words = parts.select(F.explode(F.split("p_name", " ")).alias("prefix")).distinct()
    found = deps.match_contains(parts, "p_name", words.withColumn("prefix_pos", F.lit(0)))
    return found.select("p_partkey", F.col("prefix").alias("word"))


@REGISTRY.query(
    "SELECT doc_id, prefix AS passage FROM documents, (SELECT DISTINCT left(text, 40) AS prefix FROM benchmark WHERE length(text) >= 40) WHERE contains(text, prefix)"
)
def benchmark_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long texts against a table of passages."""
    passages = table(spark, sf_dir, "benchmark").where(F.length("text") >= 40).select(F.left("text", F.lit(40)).alias("prefix")).distinct()
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = deps.match_contains(docs, "text", passages.withColumn("prefix_pos", F.lit(0)))
    return found.select("doc_id", F.col("prefix").alias("passage"))


_BUILD_PATH = (
    "'m' || p_partkey || '/' || CASE p_partkey % 4 WHEN 0 THEN 'pom.xml' WHEN 1 THEN 'pom.xml' "
    "WHEN 2 THEN 'build.gradle.kts' ELSE 'build.gradle' END"
)
_DEPENDENCIES = (
    f"(SELECT path, CAST(i AS INTEGER) AS dep_pos, found[i + 1] AS dep FROM (SELECT {_BUILD_PATH} AS path, CASE p_partkey % 4 "
    "WHEN 0 THEN ['org.gen:app' || p_partkey, 'com.company:lib' || p_partkey] WHEN 1 THEN ['com.company:own' || p_partkey] "
    "WHEN 2 THEN ['com.company:lib' || p_partkey] ELSE CAST([] AS VARCHAR[]) END AS found FROM part), range(2) r(i) WHERE i < len(found))"
)


@REGISTRY.query(f"SELECT * FROM {_DEPENDENCIES}")
def build_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.build_dependencies(testkit.build_files(spark, sf_dir))


@REGISTRY.query(f"SELECT path, dep, 'lib' AS prefix FROM {_DEPENDENCIES} WHERE contains(dep, 'lib') UNION ALL "
           f"SELECT path, dep, 'company:' FROM {_DEPENDENCIES} WHERE contains(dep, 'company:')")
def dependency_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deps.build_dependencies(testkit.build_files(spark, sf_dir))
    return deps.match_contains(found, "dep", ["lib", "company:", " "]).select("path", "dep", "prefix")


_RISKS = (
    "(SELECT arg_min(prefix, prefix_pos) AS matched_prefix, import AS artifact, path AS location, false AS is_transitive, "
    "CASE WHEN contains(import, 'hadoop.io.') THEN 'Use Spark Dataset/DataFrame with built-in encoders' "
    "WHEN contains(import, 'hadoop.mapreduce.') THEN 'Migrate to Spark transformations (map, filter, reduce)' "
    "WHEN contains(import, 'pig.') THEN 'Rewrite in Spark SQL or Dataset API' "
    "ELSE 'Review for Spark-native equivalent or rewrite as custom UDF' END AS suggestion "
    f"FROM {_IMPORT_ROWS}, {_PREFIX_ROWS} WHERE starts_with(import, prefix) GROUP BY import, path UNION ALL "
    "SELECT 'com.company', dep, path, false, 'Review dependency tree and consider Spark-native alternatives' "
    f"FROM {_DEPENDENCIES} WHERE contains(dep, 'com.company'))"
)


def _risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.scan_risks(_classes(spark, sf_dir), testkit.build_files(spark, sf_dir), testkit.PREFIXES)


@REGISTRY.query(f"SELECT * FROM {_RISKS}")
def risk_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _risks(spark, sf_dir)


@REGISTRY.query(f"SELECT count(*) AS total_count, CAST(0 AS BIGINT) AS transitive_count, count(*) > 0 AS blocked FROM {_RISKS}")
def risk_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.risk_verdict(_risks(spark, sf_dir), action="block")


# --- job tables -------------------------------------------------------------

_DOCUMENTS = "(SELECT c_custkey AS k, c_custkey % 4 AS m FROM customer)"


@REGISTRY.query(
    "SELECT k AS id, CAST(pos AS INTEGER) AS job_pos, CASE WHEN pos = 0 THEN 'j' || k ELSE 'second' END AS job_name, "
    "CASE WHEN m = 0 THEN 'D' || k END AS driver, CASE WHEN m = 0 THEN 'M' END AS mapper, CAST(NULL AS VARCHAR) AS reducer, "
    "CASE WHEN m = 0 THEN 'K' END AS combiner, CASE WHEN m = 0 THEN 'P' END AS partitioner, "
    "CASE WHEN m = 0 THEN 'X;Y' ELSE '' END AS composite_keys, "
    "CASE m WHEN 0 THEN '/in/1;/in/2' WHEN 1 THEN '/data/input' END AS input_paths, "
    "CASE m WHEN 0 THEN '/o' ELSE '/data/output' END AS output_paths, "
    "CASE m WHEN 0 THEN 'ParquetInputFormat' WHEN 1 THEN 'TextInputFormat' END AS input_format, "
    "CASE m WHEN 0 THEN 'ParquetOutputFormat' ELSE 'TextOutputFormat' END AS output_format, "
    "CASE WHEN m = 0 THEN 'j' || (k - 1) END AS chained_after "
    f"FROM {_DOCUMENTS}, range(2) r(pos) WHERE m < 3 AND (pos = 0 OR m = 1)"
)
def normalised_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs, _ = jobtable.normalise_jobs(testkit.jobs_json(spark, sf_dir))
    return jobs.select(
        "id", "job_pos", "job_name", "driver", "mapper", "reducer", "combiner", "partitioner",
        _flat("composite_keys"), _flat("input_paths"), _flat("output_paths"), "input_format", "output_format", "chained_after",
    )


@REGISTRY.query(f"SELECT k AS id, 'Missing ''jobs'' key in job graph response' AS error FROM {_DOCUMENTS} WHERE m = 3")
def job_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobtable.normalise_jobs(testkit.jobs_json(spark, sf_dir))[1]


@REGISTRY.query(
    "SELECT k AS id, CAST(CASE m WHEN 1 THEN 2 ELSE 1 END AS INTEGER) AS n_jobs, "
    "CAST(CASE m WHEN 0 THEN 7 WHEN 1 THEN 2 END AS INTEGER) AS chain_count, "
    f"CASE m WHEN 0 THEN 'high' WHEN 1 THEN 'medium' END AS complexity FROM {_DOCUMENTS} WHERE m < 3"
)
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobtable.graph_summary(testkit.jobs_json(spark, sf_dir))


@REGISTRY.query(
    "SELECT class_name AS job_name, 'org.gen.p' || b AS package, class_name AS driver, path AS file_path, "
    "'C' || (k - 5) || 'Mapper' AS mapper, 'C' || (k - 4) || 'Combiner' AS combiner, 'C' || (k - 3) || 'Sum' AS reducer, "
    "'Absent' AS partitioner, 'src/p' || b || '/F' || (k - 5) || '.java' AS mapper_path, "
    "'src/p' || b || '/F' || (k - 4) || '.java' AS combiner_path, 'src/p' || b || '/F' || (k - 3) || '.java' AS reducer_path, "
    f"CAST(NULL AS VARCHAR) AS partitioner_path FROM {_CORPUS} WHERE m = 5"
)
def assembled_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = testkit.code_files(spark, sf_dir)
    classes = durable(corpus.extract_classes(files))  # read as drivers and as the classes they name
    return jobtable.assemble_jobs(files, classes).drop("job_var", "method", "title", "input_paths", "output_paths", "input_format", "output_format", "chained_after")


_DRIVERS = (
    "(SELECT doc_id AS k, coalesce(lang, 'xx') AS lang, coalesce(source, 'none') AS src, "
    "'src/' || coalesce(lang, 'xx') || '/D' || doc_id || '.java' AS path FROM documents)"
)
_NONE = "CAST(NULL AS VARCHAR)"


def _paths(column: str) -> Column:
    return F.array_join(column, ";", "?").alias(column)


@REGISTRY.query(
    f"WITH d AS {_DRIVERS}, w AS (SELECT src, arg_min('Runner' || k, path) AS job FROM d WHERE lang = 'fr' GROUP BY src) "
    "SELECT 'WordCount' || k AS job_name, 'org.gen.' || lang AS package, 'WordCount' || k AS driver, 'main' AS method, 'job' AS job_var, 'count ' || src AS title, path AS file_path, "
    f"'Map' AS mapper, 'Reduce' AS combiner, 'Reduce' AS reducer, {_NONE} AS partitioner, path AS mapper_path, path AS combiner_path, path AS reducer_path, {_NONE} AS partitioner_path, "
    "'/in/' || src || '/' || k || ';?' AS input_paths, '/data/out/' || src || '/' || k AS output_paths, 'TextInputFormat' AS input_format, 'TextOutputFormat' AS output_format, "
    f"{_NONE} AS chained_after FROM d WHERE lang = 'en' "
    f"UNION ALL SELECT 'Steps' || k || '.' || m || '.job', 'org.gen.de', 'Steps' || k, m, 'job', CASE m WHEN 'first' THEN 'first' END, path, CASE m WHEN 'first' THEN 'Ma' ELSE 'Mb' END, {_NONE}, "
    f"CASE m WHEN 'second' THEN 'Rb' END, {_NONE}, path, {_NONE}, CASE m WHEN 'second' THEN path END, {_NONE}, CASE m WHEN 'first' THEN '' ELSE '/mid/' || k || ';/other' END, "
    "CASE m WHEN 'first' THEN '/mid/' || k || '/' ELSE '?' END, CASE m WHEN 'first' THEN 'TextInputFormat' ELSE 'SequenceFileInputFormat' END, 'TextOutputFormat', "
    "CASE m WHEN 'second' THEN 'Steps' || k || '.first.job' END FROM d, (SELECT unnest(['first', 'second']) AS m) WHERE lang = 'de' "
    f"UNION ALL SELECT 'Runner' || k, 'org.gen.fr', 'Runner' || k, {_NONE}, 'job', {_NONE}, path, 'Map', {_NONE}, 'Absent', {_NONE}, {_NONE}, {_NONE}, {_NONE}, {_NONE}, '', '/fr/' || src, "
    f"'TextInputFormat', {_NONE}, {_NONE} FROM d WHERE lang = 'fr' "
    f"UNION ALL SELECT 'Es' || k, 'org.gen.' || lang, 'Es' || k, 'run', 'conf', '/data/out/' || d.src, path, 'Copy', {_NONE}, {_NONE}, {_NONE}, 'src/Paths_' || d.src || '.java', {_NONE}, {_NONE}, {_NONE}, "
    "'/fr/' || d.src, '', 'TextInputFormat', 'TextOutputFormat', w.job FROM d LEFT JOIN w ON w.src = d.src WHERE lang NOT IN ('en', 'de', 'fr')"
)
def assembled_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = testkit.driver_files(spark, sf_dir)
    scanned = javasource.scan_once(files)
    jobs = jobtable.assemble_jobs(files, javasource.scan_classes(scanned), scanned=scanned)
    return jobs.withColumns({c: _paths(c) for c in ("input_paths", "output_paths")})


@REGISTRY.query(
    f"WITH d AS {_DRIVERS}, c AS (SELECT path AS file_path, unnest(CASE lang "
    "WHEN 'en' THEN [('WordCount' || k, '', 'driver', 'main', 2), ('WordCount' || k || '.Map', 'WordCount' || k, 'mapper', 'map', 0), ('WordCount' || k || '.Reduce', 'WordCount' || k, 'reducer', '', 0)] "
    "WHEN 'de' THEN [('Steps' || k, '', 'unclassified', 'first;second', 2), ('Steps' || k || '.Ma', 'Steps' || k, 'mapper', '', 0), ('Steps' || k || '.Mb', 'Steps' || k, 'mapper', '', 0), "
    "('Steps' || k || '.Mb.Inner', 'Steps' || k || '.Mb', 'unclassified', '', 0), ('Steps' || k || '.Rb', 'Steps' || k, 'reducer', '', 0), ('Steps' || k || '.Pair', 'Steps' || k, 'composite_key', 'write', 2)] "
    "WHEN 'fr' THEN [('Runner' || k, '', 'driver', 'init;wire', 2)] ELSE [('Es' || k, '', 'unclassified', 'run', 1)] END) AS c FROM d "
    "UNION ALL SELECT 'src/Paths_' || src || '.java', unnest([('Paths_' || src, '', 'unclassified', '', 4), ('Paths_' || src || '.Copy', 'Paths_' || src, 'mapper', '', 0)]) FROM (SELECT DISTINCT src FROM d)) "
    "SELECT file_path, c[1] AS qualified, c[2] AS outer_class, c[3] AS role, c[4] AS methods, CAST(c[5] AS BIGINT) AS n_fields FROM c"
)
def nested_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = javasource.scan_once(testkit.driver_files(spark, sf_dir))
    classes = javasource.scan_classes(scanned)
    methods = javasource.scan_methods(scanned).groupBy("file_path", F.col("class").alias("qualified")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "method"))), lambda m: m["method"]), ";").alias("methods")
    )
    fields = javasource.scan_fields(scanned).groupBy("file_path", F.col("class").alias("qualified")).agg(F.count(F.lit(1)).alias("n_fields"))
    both = classes.join(methods, ["file_path", "qualified"], "left").join(fields, ["file_path", "qualified"], "left")
    return both.select(
        "file_path", "qualified", F.coalesce("outer", F.lit("")).alias("outer_class"), "role", F.coalesce("methods", F.lit("")).alias("methods"), F.coalesce("n_fields", F.lit(0)).alias("n_fields")
    )


@REGISTRY.query(
    f"WITH d AS {_DRIVERS} SELECT 'Pair' AS source_class, path AS file_path, CAST(pos AS INTEGER) AS pos, CASE pos WHEN 0 THEN 'a' || k ELSE 'b' END AS name, "
    "CASE pos WHEN 0 THEN 'Text' ELSE 'long' END AS java_type, CASE pos WHEN 0 THEN 'StringType' ELSE 'LongType' END AS spark_type, 'writable' AS format "
    "FROM d, (SELECT unnest([0, 1]) AS pos) WHERE lang = 'de'"
)
def own_key_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = testkit.driver_files(spark, sf_dir)
    with arrow_batches(spark, javasource.BATCH_BYTES):
        return durable(schemas.own_key_fields(javasource.scan(files)))


_CHAIN = (
    "WITH RECURSIVE jobs AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 20 <> 1 THEN c_custkey - 1 END AS p FROM customer), "
    "walk(k, root, depth) AS (SELECT k, k, 0 FROM jobs WHERE p IS NULL UNION ALL "
    "SELECT j.k, w.root, w.depth + 1 FROM jobs j JOIN walk w ON j.p = w.k) "
)


@REGISTRY.query(_CHAIN + "SELECT 'job' || k AS job, 'job' || root AS root, CAST(depth AS BIGINT) AS depth FROM walk")
def chain_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobtable.resolve_chains(testkit.chain_jobs(spark, sf_dir))[0]


@REGISTRY.query(_CHAIN + "SELECT 'job' || k AS job, 'broken' AS reason FROM jobs WHERE k NOT IN (SELECT k FROM walk)")
def broken_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobtable.resolve_chains(testkit.chain_jobs(spark, sf_dir))[1]


# --- payloads ---------------------------------------------------------------


@REGISTRY.query(
    "SELECT event_id AS id, CASE event_id % 6 WHEN 4 THEN replace(props, '}', ', \"p\": \"C:\\\\dir\\\\u0041\"}') "
    "WHEN 5 THEN NULL ELSE props END AS payload, "
    "CAST(CASE event_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 4 END AS INTEGER) AS strategy, "
    "event_id % 6 = 5 AS failed FROM events"
)
def salvaged_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = payloads.salvage_json(testkit.responses(spark, sf_dir), "raw")
    return found.select("id", "payload", F.col("strategy").cast("int").alias("strategy"), F.col("error").isNotNull().alias("failed"))


_ORDERS = "(SELECT o_orderkey AS k, o_orderkey % 5 AS m, o_orderstatus = 'F' AS given FROM orders)"


@REGISTRY.query(
    "SELECT k AS id, f.path AS path, f.content AS content FROM (SELECT k, unnest(CASE m "
    "WHEN 0 THEN [{'path': 'a' || k || '.scala', 'content': 'object A'}, {'path': 'b.scala', 'content': 'object B'}] "
    "WHEN 1 THEN [{'path': 'a' || k || '.scala', 'content': 'object A'}] "
    "WHEN 2 THEN [{'path': 'x.scala', 'content': 'object ' || k}] ELSE [] END) AS f "
    f"FROM {_ORDERS})"
)
def kept_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.filter_generated_files(testkit.payloads(spark, sf_dir))


@REGISTRY.query(
    "SELECT id, CAST(i AS INTEGER) AS pos, w[i + 1] AS warning FROM (SELECT k AS id, list_concat("
    "CASE WHEN given THEN ['given'] ELSE CAST([] AS VARCHAR[]) END, CASE m WHEN 1 THEN ['Filtered out build file: pom.xml'] "
    "WHEN 2 THEN ['Filtered out non-Scala file: README.md'] "
    "WHEN 3 THEN ['Filtered out build file: project/Build.scala', 'Filtered out non-Scala file: notes.txt'] "
    f"ELSE CAST([] AS VARCHAR[]) END) AS w FROM {_ORDERS} WHERE m < 4), range(3) r(i) WHERE i < len(w)"
)
def payload_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.payload_warnings(testkit.payloads(spark, sf_dir))


@REGISTRY.query(
    "SELECT k AS id, CAST([2, 1, 1, 0, 0][m + 1] AS INTEGER) AS file_count, "
    "CAST(CASE WHEN m = 4 THEN 0 ELSE [0, 1, 1, 2][m + 1] + CASE WHEN given THEN 1 ELSE 0 END END AS INTEGER) AS warning_count, "
    f"m = 4 AS rejected, CASE WHEN m = 4 THEN 'File content for ''n.scala'' is not a string' END AS error FROM {_ORDERS}"
)
def payload_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.payload_summary(testkit.payloads(spark, sf_dir))


_STUB_SQL = (
    "'package com.example.spark' || chr(10) || chr(10) || 'object App {' || chr(10) || "
    "'  def main(args: Array[String]): Unit = {' || chr(10) || "
    "'    println(\"LLM response was malformed - manual code review required\")' || chr(10) || '  }' || chr(10) || '}' || chr(10)"
)


@REGISTRY.query(
    "SELECT k AS id, job_name, 'src/main/scala/com/example/spark/' || f.path AS path, f.content AS content FROM ("
    "SELECT k, job_name, unnest(CASE m WHEN 0 THEN [{'path': 'App.scala', 'content': " + _STUB_SQL + "}] "
    "WHEN 1 THEN [{'path': 'driver/' || n || 'App.scala', 'content': 'package a.b' || chr(10) || 'object M' || k || ' { def main(x: Int) = 1 }'}] "
    "WHEN 2 THEN [{'path': 'driver/' || n || 'App.scala', 'content': 'package a.b' || chr(10) || 'object M' || k || ' { def main(x: Int) = 1 }'}, "
    "{'path': 'jobs/' || n || 'Job.scala', 'content': 'package a.c' || chr(10) || 'object R' || k || ' { def run() = 2 }'}] "
    "ELSE [{'path': 'service/' || n || 'Service.scala', 'content': 'package s' || chr(10) || 'object S3'}, "
    "{'path': 'jobs/' || n || 'Job.scala', 'content': 'package s' || chr(10) || 'object T' || k}] END) AS f FROM "
    "(SELECT o_orderkey AS k, o_orderkey % 4 AS m, CASE WHEN o_orderstatus <> 'P' THEN 'Job' || o_orderkey END AS job_name, "
    "coalesce(job_name, 'SparkJob') AS n FROM orders))"
)
def code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.extract_code_blocks(testkit.code_replies(spark, sf_dir))


@REGISTRY.query(
    "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'owes' ELSE c_name END AS c_name, "
    "CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL "
    "SELECT c_custkey + 1000000000, 'new', c_mktsegment FROM customer WHERE c_acctbal > 9000"
)
def overlaid_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    changed = customers.where("c_acctbal < 0").select(
        "c_custkey", F.lit("owes").alias("c_name"), F.lit(None).cast("string").alias("c_mktsegment")
    )
    added = customers.where("c_acctbal > 9000").select(
        (F.col("c_custkey") + 1000000000).alias("c_custkey"), F.lit("new").alias("c_name"), "c_mktsegment"
    )
    return payloads.overlay(customers.drop("c_acctbal"), changed.unionByName(added), ["c_custkey"])
