"""Fixed values.

Everything in this module is a value that the results depend on: lookup
tables, word lists, patterns and message texts. They are stated plainly and
in one place; the logic that uses them lives in the other modules.
"""

# --- file scan --------------------------------------------------------------
SKIP_DIRS = ["target", "build", ".gradle", ".mvn", "out", "__pycache__", ".git"]
BUILD_FILE_NAMES = ["pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle"]
SOURCE_SUFFIX = ".java"
SCHEMA_SUFFIX = ".avsc"

# --- input and output defaults ---------------------------------------------
DEFAULT_INPUT_FORMAT = "TextInputFormat"
DEFAULT_OUTPUT_FORMAT = "TextOutputFormat"
DEFAULT_INPUT_PATHS = ["/data/input"]
DEFAULT_OUTPUT_PATHS = ["/data/output"]
DEFAULT_COMPLEXITY = "medium"

# --- class roles ------------------------------------------------------------
ROLES = ["driver", "mapper", "reducer", "combiner", "partitioner", "composite_key", "unclassified"]
DRIVER_IMPORTS = [
    "org.apache.hadoop.mapreduce.Job",
    "org.apache.hadoop.mapred.JobConf",
    "org.apache.hadoop.mapreduce.lib.input.FileInputFormat",
]
DRIVER_NAME_PATTERN = r"(?i)driver|main|runner|app|launcher|entry"
COMBINER_NAME_PATTERN = r"(?i)combiner"

# --- source text ------------------------------------------------------------
# (?d) lets only a line feed end a line, (?U) reads \w and \s as Unicode classes.
PACKAGE_PATTERN = r"(?mdU)^package\s+([\w.]+)\s*;"
IMPORT_PATTERN = r"(?mdU)^import\s+([\w.*]+)\s*;"
CLASS_PATTERN = (
    r"(?U)\bclass\s+(\w+)(?:\s*<[^{;]*?>)?"
    r"(?:\s+extends\s+([\w<>,.?\[\]&\s]+?))?"
    r"(?:\s+implements\s+([\w<>,.?\[\]&\s]+?))?\s*\{"
)
WRITE_ACCESS_PATTERN = r"(?U)this\.(\w+)\.(?:write|readFields)"
GENERICS_PATTERN = r"<(.+)>"
MAVEN_PATTERN = r"(?s)<groupId>([^<]+)</groupId>\s*<artifactId>([^<]+)</artifactId>"
GRADLE_PATTERN = r"""["']([a-zA-Z0-9._-]+:[a-zA-Z0-9._-]+)(?::[0-9.]+)?["']"""
MAIN_METHOD = "public static void main"

# Calls that set up a job, by what they set.
JOB_CALLS = {
    "setMapperClass": "mapper",
    "setCombinerClass": "combiner",
    "setReducerClass": "reducer",
    "setPartitionerClass": "partitioner",
    "setInputFormatClass": "input_format",
    "setOutputFormatClass": "output_format",
    "setInputFormat": "input_format",
    "setOutputFormat": "output_format",
    "addInputPath": "input_path",
    "addInputPaths": "input_path",
    "setInputPaths": "input_path",
    "setOutputPath": "output_path",
    "setJobName": "title",
    "getInstance": "title",
    "Job": "title",
}

# --- type tables ------------------------------------------------------------
JAVA_TYPES = {
    "Text": "StringType",
    "IntWritable": "IntegerType",
    "LongWritable": "LongType",
    "FloatWritable": "FloatType",
    "DoubleWritable": "DoubleType",
    "BooleanWritable": "BooleanType",
    "BytesWritable": "BinaryType",
    "NullWritable": "NullType",
    "VIntWritable": "IntegerType",
    "VLongWritable": "LongType",
    "String": "StringType",
    "Integer": "IntegerType",
    "int": "IntegerType",
    "Long": "LongType",
    "long": "LongType",
    "Float": "FloatType",
    "float": "FloatType",
    "Double": "DoubleType",
    "double": "DoubleType",
    "Boolean": "BooleanType",
    "boolean": "BooleanType",
    "byte[]": "BinaryType",
    "Date": "DateType",
    "Timestamp": "TimestampType",
    "BigDecimal": "DecimalType(38,10)",
}
AVRO_TYPES = {
    "string": "StringType",
    "int": "IntegerType",
    "long": "LongType",
    "float": "FloatType",
    "double": "DoubleType",
    "boolean": "BooleanType",
    "bytes": "BinaryType",
    "null": "NullType",
}
DEFAULT_TYPE = "StringType"
UNKNOWN_JAVA_TYPE = "Unknown"
FALLBACK_KEY_FIELD = "key"
GENERIC_FIELD_NAMES = ["input_key", "input_value", "output_key", "output_value"]

# Java types that are recognised in a field declaration.
FIELD_TYPES = [
    "Text", "IntWritable", "LongWritable", "FloatWritable", "DoubleWritable",
    "BooleanWritable", "BytesWritable", "VIntWritable", "VLongWritable",
    "String", "Integer", "Long", "Float", "Double", "Boolean",
    "BigDecimal", "Date", "Timestamp",
]

FIELD_PATTERN = (
    r"(?U)(?:private|protected|public)?\s+(" + "|".join(FIELD_TYPES) + r")\s+(\w+)(?:\s*=\s*[^;]+)?\s*;"
)

# --- dependency risk --------------------------------------------------------
SUGGESTIONS = {
    "hadoop.io.": "Use Spark Dataset/DataFrame with built-in encoders",
    "hadoop.mapreduce.": "Migrate to Spark transformations (map, filter, reduce)",
    "hadoop.fs.": "Use spark.read/write with built-in file formats",
    "cascading.": "Rewrite in Spark Dataset API",
    "pig.": "Rewrite in Spark SQL or Dataset API",
    "hive.": "Use Spark SQL with Hive metastore support",
}
DEFAULT_SUGGESTION = "Review for Spark-native equivalent or rewrite as custom UDF"
BUILD_SUGGESTION = "Review dependency tree and consider Spark-native alternatives"

# --- payloads ---------------------------------------------------------------
FORBIDDEN_PATH_PARTS = [
    "pom.xml", "build.gradle", "build.sbt", "build.properties",
    "settings.gradle", "gradle.properties", "project/",
]
KEPT_SUFFIX = ".scala"
BUILD_FILE_WARNING = "Filtered out build file: "
OTHER_FILE_WARNING = "Filtered out non-Scala file: "
MISSING_JOBS_ERROR = "Missing 'jobs' key in job graph response"
MISSING_FILES_ERROR = "Missing 'files' key in codegen response"
DEFAULT_JOB_NAME = "SparkJob"
CODE_ROOT = "src/main/scala/com/example/spark/"
STUB_PATH = "src/main/scala/com/example/spark/App.scala"
STUB_CONTENT = (
    "package com.example.spark\n"
    "\n"
    "object App {\n"
    "  def main(args: Array[String]): Unit = {\n"
    '    println("LLM response was malformed - manual code review required")\n'
    "  }\n"
    "}\n"
)

FENCED_JSON = r"```(?:json)?\s*(\{.*?\})\s*```"
CONTROL_CHARACTERS = r"[\x00-\x1f\x7f-\x9f]"
STRAY_BACKSLASH = r'\\(?!["\\/bfnrt])'
CODE_BLOCK = r"(?s)```(?:scala)?\s*(package\s+[\w.]+.*?)```"

# --- runs and logs ----------------------------------------------------------
RUN_NODES = [
    "config_validate", "source_resolve", "driver_analysis", "schema_extract",
    "jobgraph_infer", "diagram_render", "spark_codegen", "risk_scan",
    "project_scaffold", "compile_check", "critique_and_patch", "test_check",
    "human_review", "package_export",
]
PENDING = "pending"
LOG_TAIL_CHARS = 2000
MAX_ERROR_LINES = 20
MAX_PATCH_RETRIES = 3
ERROR_LINE = r"(?i)\[ERROR\]|error:|cannot find symbol|not found:|value .* is not a member"
REVIEW_TEXT = "Human review required"
NO_CONFIG_ERROR = "No pipeline config provided."
NO_REPO_URL_ERROR = "Git mode selected but repo_url is empty."
NO_BRANCH_ERROR = "Git mode selected but branch is empty."
NO_LOCAL_PATH_ERROR = "Local mode selected but local_path is empty."
