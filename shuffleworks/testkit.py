"""Test inputs derived from the given tables.

Each function builds one input table with as many rows as the table it comes
from. What a row must give follows from its key and its other columns, never
from the code under test, so a check needs none of the patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shuffleworks.sources.tree import store_of



def spread_small(scan: DataFrame) -> DataFrame:
    """Spread a scan over the cores when it has few splits; a large scan is left alone.

    For work that is heavy per row. ``scan`` is a plain scan with the needed
    columns selected, so that looking at its splits starts no job. Rows are dealt
    out by their number in the scan, which is even and needs no sort.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() * 2 > cores:
        return scan
    return scan.repartition(cores, F.monotonically_increasing_id())


def table(spark: SparkSession, sf_dir: str, name: str, *spread: str) -> DataFrame:
    """A given table; with columns named, those columns, spread over the cores if the file is small."""
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread_small(scan.select(*spread)) if spread else scan


def _text(*parts: Column | str) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _case(selector: Column, branches: dict[int, Column]) -> Column:
    result = None
    for value, column in branches.items():
        result = F.when(selector == value, column) if result is None else result.when(selector == value, column)
    return result


# --- source files -----------------------------------------------------------


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source file per part: ``k, path, content, is_deleted``.

    The last digit of k picks the kind of class; ten neighbours share a package.
    Every file but the last two kinds carries a class in a comment that must not
    be found. Key classes come with declared fields, with fields only in a write
    method, in a file that is gone (``is_deleted``), or with no fields at all.
    """
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part", "p_partkey", "p_name").select(k.alias("k"), F.col("p_name").alias("note"))
    k, m, v = F.col("k"), F.col("k") % 10, F.col("k") % 3
    block = F.floor(k / 10)
    hadoop = "import org.apache.hadoop.io.{0};\n"
    package = F.when(m == 8, "").otherwise(_text("package org.gen.p", block, ";\n\n"))
    ghost = _text("/* was:\n class Ghost { } ", F.col("note"), " */\n// class Ghost {\n")
    mapper_base = _case(
        v,
        {
            0: F.lit("extends Mapper<LongWritable, Text, Text, IntWritable>"),
            1: F.lit("extends\n        Mapper<LongWritable, Text,\n            Text, IntWritable>\n"),
            2: F.lit("extends org.apache.hadoop.mapreduce.Mapper<LongWritable, Text, Text, IntWritable>"),
        },
    )
    key_body = _case(
        block % 4,
        {
            0: _text(
                "    private Text f", k, "a;\n    private LongWritable f", k, "b = new LongWritable();\n"
            ),
            1: _text("    void write(DataOutput out) { this.g", k, ".write(out); this.g", k, ".write(out); this.h.write(out); }\n"),
            2: _text("    private Text lost;\n"),
            3: _text("    int plain;\n"),
        },
    )
    body = _case(
        m,
        {
            0: _text(hadoop.format("Text"), "public class C", k, "Mapper ", mapper_base, " {\n}\n"),
            1: _text(
                hadoop.format("Text"), hadoop.format("IntWritable"),
                "public class C", k, "Combiner extends Reducer<Text, IntWritable, Text, IntWritable> {\n}\n",
            ),
            2: _text("class C", k, "Sum extends Reducer<Text, IntWritable, Text, LongWritable> {\n}\n"),
            3: _text("public final class C", k, "Part extends Partitioner<Text, IntWritable> {\n}\n"),
            4: _text("public class C", k, "Key implements WritableComparable<C", k, "Key> {\n", key_body, "}\n"),
            5: _text(
                "import org.apache.hadoop.mapreduce.Job;\nimport static java.util.Map.entry;\n",
                "public class C", k, "Job {\n",
                "    void wire(Job job) {\n",
                "        job.setMapperClass(C", k - 5, "Mapper.class);\n",
                "        job.setCombinerClass(C", k - 4, "Combiner.class);\n",
                "        job.setReducerClass(C", k - 3, "Sum.class);\n",
                "        job.setPartitionerClass(Absent.class);\n    }\n}\n",
            ),
            6: _text("public class C", k, "Start {\n    public static void main(String[] a) { new Job(); }\n}\n"),
            7: _text("class C", k, "Runner { }\n"),
            8: _text("import com.company.v", k % 3, ".X;\nimport java.util.*;\nclass C", k, "Util implements Closeable, Function<Map<K, V>, X> {\n}\n"),
            9: _text("import pig.C", k, ";\nclass C", k, "Mapper extends Mapper {\n}\n"),
        },
    )
    content = F.concat(package, F.when(m < 8, ghost).otherwise(""), body)
    path = _text("src/p", block, "/F", k, ".java")
    deleted = (m == 4) & (block % 4 == 2)
    return part.select(k.alias("k"), path.alias("path"), content.alias("content"), deleted.alias("is_deleted"))


def driver_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One driver per document, and one file of constants per source: ``path, content``.

    The language picks the layout: one file with nested mapper and reducer, two methods with
    a job each, a job kept in a field, or constants and classes of another file. The document's
    text stands in a comment and in a string, so nothing in it may be taken for code.
    """
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "source", "text")
    k, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    src = F.coalesce("source", F.lit("none"))
    lang = F.coalesce("lang", F.lit("xx"))
    comment = _text("/* class Ghost { ", F.replace(text, F.lit("*/"), F.lit("* /")), " */\n")
    quoted = text
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        quoted = F.replace(quoted, F.lit(plain), F.lit(escaped))
    note = _text('    private static final String NOTE = "} class Ghost { ', quoted, '";\n')
    head = _text("package org.gen.", lang, ";\n", comment)
    one_file = _text(
        "import org.gen.Paths_", src, ";\n\npublic class WordCount", k, " extends Configured {\n", note,
        '    private static final String TOP = "/in";\n',
        "    public static class Map extends Mapper<LongWritable, Text, Text, IntWritable> { void map() { if (true) { } } }\n",
        "    public static class Reduce\n        extends Reducer<Text, IntWritable, Text, IntWritable> { }\n",
        "    public static void main(String[] args) throws Exception {\n        // job.setMapperClass(Ghost.class);\n",
        '        Job job = Job.getInstance(new Configuration(), "count " + Paths_', src, ".NAME);\n",
        '        String in = TOP + "/', src, '";\n        job.setMapperClass(Map.class);\n        job.setCombinerClass(Reduce.class);\n',
        "        job.setReducerClass(WordCount", k, '.Reduce.class);\n        FileInputFormat.addInputPath(job, new Path(in, "', k, '"));\n',
        "        if (args.length > 0) { FileInputFormat.addInputPath(job, new Path(args[0])); }\n",
        "        FileOutputFormat.setOutputPath(job, new Path(Paths_", src, '.OUT + "/', k, '"));\n    }\n}\n',
    )
    two_methods = _text(
        "class Steps", k, " {\n    private Text notMine;\n", note, "    void first() throws Exception {\n",
        '        Job job = new Job(conf, "first");\n        job.setMapperClass(Ma.class);\n',
        '        FileOutputFormat.setOutputPath(job, new Path("/mid/', k, '/"));\n    }\n    void second(Path out) {\n',
        "        Job job = Job.getInstance(conf);\n        job.setMapperClass(Mb.class);\n        job.setReducerClass(Rb.class);\n",
        "        job.setInputFormatClass(SequenceFileInputFormat.class);\n",
        '        FileInputFormat.addInputPath(job, new Path("/dropped"));\n        FileInputFormat.setInputPaths(job, "/mid/', k, ',/other");\n',
        "        FileOutputFormat.setOutputPath(job, out);\n    }\n    static class Ma extends Mapper<A, B, C, D> { }\n",
        "    static class Mb extends Mapper<A, B, C, D> { class Inner { } }\n    static class Rb extends Reducer<C, D, E, F> { }\n",
        "    static class Pair implements WritableComparable<Pair> {\n        private Text a", k, ";\n        private long b = 1;\n",
        "        public void write(DataOutput o) { Text local = null; }\n    }\n}\n",
    )
    in_a_field = _text(
        "public class Runner", k, " {\n    private Job job;\n", note, "    void init() { job = Job.getInstance(conf, title()); job.setMapperClass(Map.class); }\n",
        "    void wire(Class fmt) {\n        this.job.setReducerClass(p.Absent.class);\n        job.setOutputFormatClass(fmt);\n",
        '        FileOutputFormat.setOutputPath(job, new Path("/fr", "', src, '"));\n    }\n}\n',
    )
    elsewhere = _text(
        "import static org.gen.Paths_", src, ".FR;\nimport org.gen.*;\nclass Es", k, " {\n", note, "    void run(JobConf conf) {\n",
        "        conf.setMapperClass(Paths_", src, '.Copy.class);\n        conf.setJobName(Paths_', src, ".OUT);\n",
        "        FileInputFormat.addInputPath(conf, new Path(FR));\n    }\n}\n",
    )
    body = F.when(lang == "en", one_file).when(lang == "de", two_methods).when(lang == "fr", in_a_field).otherwise(elsewhere)
    drivers = docs.select(_text("src/", lang, "/D", k, ".java").alias("path"), F.concat(head, body).alias("content"))
    constants = _text(
        "package org.gen;\npublic class Paths_", src, ' {\n    static final String ROOT = "/data";\n',
        '    public static final String OUT = ROOT + "/out/" + NAME;\n    public static final String NAME = "', src, '";\n',
        '    static final String FR = "/fr/" + Paths_', src, ".NAME;\n    public static class Copy extends Mapper<A, B, C, D> { }\n}\n",
    )
    sources = docs.select(src.alias("source")).distinct().select(_text("src/Paths_", F.col("source"), ".java").alias("path"), constants.alias("content"))
    return drivers.unionByName(sources)


def written_tree(spark: SparkSession, sf_dir: str, root: str) -> None:
    """A file per document below ``root``, in folders by language and source; some in build folders, some with hidden names."""
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "source", "text")
    k, lang, src = F.col("doc_id"), F.coalesce("lang", F.lit("xx")), F.coalesce("source", F.lit("none"))
    path = (
        F.when(lang == "en", _text("en/", src, "/D", k, ".java"))
        .when(lang == "de", _text("de/_gen/", src, "/.D", k, ".java"))
        .when(lang == "fr", _text("fr/target/", src, "/D", k, ".java"))
        .otherwise(_text(lang, "/.m", k, "/pom.xml"))
    )

    def write(batches):
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, base = store_of(root)
                store.create_dir(f"{base}/{name.rpartition('/')[0]}", recursive=True)
                with store.open_output_stream(f"{base}/{name}") as out:
                    out.write((text or "").encode())
            yield batch.select([0])

    docs.select(path.alias("path"), "text").mapInArrow(write, "path string").write.format("noop").mode("overwrite").save()


def avro_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One schema file per part: ``k, path, content``; every fifth one is cut off and not JSON."""
    k = F.col("p_partkey")
    field = _case(
        k % 5,
        {
            0: F.lit('{"name": "a", "type": "long"}, {"name": "b", "type": "string"}'),
            1: F.lit('{"name": "a", "type": ["null", "double"], "default": null}, {"name": "b"}'),
            2: F.lit('{"name": "a", "type": {"type": "int", "logicalType": "date"}}, {"name": "b", "type": "bytes"}'),
            3: F.lit('{"name": "a", "type": {"type": "array", "items": "int"}}, {"type": "boolean"}'),
            4: F.lit('{"name": "a", "type": "long"}'),
        },
    )
    end = F.when(k % 5 == 4, "").otherwise("]}")
    content = _text('{"type": "record", "name": "R', k, '", "namespace": "org.gen", "fields": [', field, end)
    return table(spark, sf_dir, "part").select(
        k.alias("k"), _text("schemas/r", k, ".avsc").alias("path"), content.alias("content")
    )


def build_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One build file per part: ``k, path, content``, two Maven kinds and two Gradle kinds."""
    k = F.col("p_partkey")
    content = _case(
        k % 4,
        {
            0: _text(
                "<project>\n <groupId>org.gen</groupId>\n <artifactId>app", k, "</artifactId>\n",
                " <dependency><groupId> com.company </groupId>\n  <artifactId>lib", k, "</artifactId></dependency>\n</project>",
            ),
            1: _text("<project><groupId>com.company</groupId><artifactId>own", k, "</artifactId></project>"),
            2: _text('dependencies {\n  implementation("com.company:lib', k, ':1.2.3")\n}\n'),
            3: _text("dependencies {\n  implementation 'com.company:lib", k, ":1.0-SNAPSHOT'\n}\n"),
        },
    )
    name = F.when(k % 4 < 2, "pom.xml").when(k % 4 == 2, "build.gradle.kts").otherwise("build.gradle")
    return table(spark, sf_dir, "part").select(
        k.alias("k"), _text("m", k, "/", name).alias("path"), content.alias("content")
    )


PREFIXES = ["", "com.company.v1", "com.company", "pig.", "org.apache.hadoop.io.I", "org.apache.hadoop"]


# --- payloads ---------------------------------------------------------------


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reply per event around its JSON properties: ``id, raw``."""
    props = F.col("props")
    raw = _case(
        F.col("event_id") % 6,
        {
            0: props,
            1: _text("Here it is:\n```json\n", props, "\n```\nand {more} text"),
            2: _text("The answer is ", props, " as asked."),
            3: _text("Well: ", F.replace(props, F.lit(": "), F.lit(":\x01 "))),
            4: _text("Path ", F.replace(props, F.lit("}"), F.lit(', "p": "C:\\dir\\u0041"}'))),
            5: _text("no json in ", F.col("event_type"), " at all"),
        },
    )
    return table(spark, sf_dir, "events", "event_id", "event_type", "props").select(
        F.col("event_id").alias("id"), raw.alias("raw")
    )


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file map per order: ``id, payload``."""
    k = F.col("o_orderkey")
    files = _case(
        k % 5,
        {
            0: _text('"a', k, '.scala": "object A", "b.scala": "object B"'),
            1: _text('"pom.xml": "<x/>", "a', k, '.scala": "object A"'),
            2: _text('"README.md": "hi", "x.scala": "object ', k, '"'),
            3: _text('"project/Build.scala": "x", "notes.txt": "', k, '"'),
            4: _text('"a.scala": "object A", "n.scala": ', k),
        },
    )
    given = F.when(F.col("o_orderstatus") == "F", ', "warnings": ["given"]').otherwise("")
    return table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").select(
        k.alias("id"), _text('{"files": {', files, "}", given, "}").alias("payload")
    )


def code_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reply with code blocks per order: ``id, job_name, raw``."""
    k = F.col("o_orderkey")
    main = _text("```scala\npackage a.b\nobject M", k, " { def main(x: Int) = 1 }\n```\n")
    run = _text("```\npackage a.c\nobject R", k, " { def run() = 2 }\n```\n")
    first = _text("```scala\npackage s\nobject S1\n```\n")
    second = _text("```scala\npackage s\nobject T", k, "\n```\n")
    third = _text("```scala\npackage s\nobject S3\n```\n")
    raw = _case(
        k % 4,
        {
            0: _text("nothing but prose, ```sql select 1``` aside"),
            1: _text("text\n", main),
            2: _text(main, "then\n", run),
            3: _text(first, second, third),
        },
    )
    name = F.when(F.col("o_orderstatus") != "P", _text("Job", k))
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus")
    return orders.select(k.alias("id"), name.alias("job_name"), raw.alias("raw"))


def jobs_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job document per customer: ``id, raw``."""
    k = F.col("c_custkey")
    raw = _case(
        k % 4,
        {
            0: _text(
                '{"jobs": [{"job_name": "j', k, '", "driver": {"class_name": "D', k, '", "role": "driver"}, '
                '"mapper": {"class_name": "M"}, "reducer": null, "combiner": {"class_name": "K"}, '
                '"partitioner": {"class_name": "P"}, "composite_keys": [{"class_name": "X"}, {"class_name": "Y"}], '
                '"input_paths": ["/in/1", "/in/2"], "output_paths": ["/o"], "input_format": "ParquetInputFormat", '
                '"output_format": "ParquetOutputFormat", "chained_after": "j', k - 1, '"}], '
                '"chain_count": 7, "complexity": "high"}',
            ),
            1: _text('{"jobs": [{"job_name": "j', k, '"}, {"job_name": "second"}]}'),
            2: _text(
                '{"jobs": [{"job_name": "j', k, '", "input_paths": null, "input_format": null}], '
                '"chain_count": null, "complexity": null}'
            ),
            3: _text('{"tasks": [', k, "]}"),
        },
    )
    return table(spark, sf_dir, "customer").select(k.alias("id"), raw.alias("raw"))


# --- runs -------------------------------------------------------------------


def progress_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as node updates: one run per user, one node per event type.

    A node runs for (event_id % 5000) milliseconds and 999 microseconds; cheap
    views have not ended.
    """
    events = table(spark, sf_dir, "events")
    failed = F.col("event_type") == "error"
    seconds = (F.col("event_id") % 5000 / 1000 + 0.000999).cast("decimal(18,6)")
    length = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    ended = ~((F.col("event_type") == "view") & (F.col("value") < 10))
    return events.select(
        F.col("user_id").alias("run_id"),
        F.col("event_type").alias("node_name"),
        F.when(failed, "failed").otherwise("success").alias("status"),
        F.col("ts").alias("started_at"),
        F.when(ended, F.col("ts") + length).alias("ended_at"),
        F.when(failed, _text("code ", F.col("event_id"))).alias("error"),
        F.col("ts"),
        F.col("event_id"),
    )


PROGRESS_NODES = ["click", "error", "purchase", "signup", "view", "refund"]


def build_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One build log per order: ``run_id (customer), attempt_id, success, stdout, stderr``."""
    k = F.col("o_orderkey")
    thirty = F.array_join(
        F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.concat(F.lit("x.scala:"), i.cast("string"), F.lit(": error: bad"))),
        "\n",
    )
    stderr = _case(
        k % 5,
        {
            0: F.lit("compiling\ndone\n"),
            1: _text("  [ERROR] one ", k, " \nfine\nvalue x is not a member of Y\n"),
            2: thirty,
            3: _text("[ERROR] early ", k, "\n", F.repeat(F.lit("ok line\n"), 300)),
            4: F.lit(""),
        },
    )
    stdout = F.when(k % 5 == 4, _text("Not Found: type T", k, "\nrest")).otherwise("[ERROR] not looked at")
    return table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate").select(
        F.col("o_custkey").alias("run_id"),
        k.alias("attempt_id"),
        F.col("o_orderdate").alias("finished_at"),
        (k % 5 == 0).alias("success"),
        stdout.alias("stdout"),
        stderr.alias("stderr"),
    )


def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per order with every combination the gates look at."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("run_id"),
        F.when(k % 3 == 0, F.lit(True)).when(k % 3 == 1, F.lit(False)).alias("last_success"),
        F.floor(k / 3 % 5).cast("int").alias("patch_attempts"),
        F.when(k % 2 == 0, "block").otherwise("warn").alias("risk_action"),
        F.floor(k / 4 % 3).cast("int").alias("risk_count"),
        F.when(k % 7 < 3, F.lit(True)).when(k % 7 < 6, F.lit(False)).alias("test_passed"),
    )


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One configuration per customer: complete, with gaps, or none."""
    k = F.col("c_custkey")
    m = k % 6
    return table(spark, sf_dir, "customer").select(
        k.alias("run_id"),
        F.when(m.isin(0, 1, 2, 3), "git").when(m == 4, "local").alias("mode"),
        F.when(m.isin(0, 2), _text("https://host/r", k)).when(m == 3, "").alias("repo_url"),
        F.when(m.isin(0, 1), "main").alias("branch"),
        F.when((m == 4) & (F.col("c_nationkey") < 12), "/src").alias("local_path"),
    )


def chain_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job per customer, each after the one before; a new chain starts every twenty."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        _text("job", k).alias("job_name"), F.when(k % 20 != 1, _text("job", k - 1)).alias("chained_after")
    )


LINE_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


def all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem", *LINE_COLUMNS)


def changed_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of lineitem as another job might have written it.

    Returned lines of one piece are lost, open lines of fifty pieces are there
    twice, and the tax of accepted lines without discount is one higher.
    """
    lines = all_lines(spark, sf_dir)
    lost = (F.col("l_returnflag") == "R") & (F.col("l_quantity") == 1)
    twice = (F.col("l_linestatus") == "O") & (F.col("l_quantity") == 50)
    raised = (F.col("l_returnflag") == "A") & (F.col("l_discount") == 0)
    copies = F.when(lost, 0).when(twice, 2).otherwise(1)
    tax = F.when(raised, F.col("l_tax") + 1).otherwise(F.col("l_tax"))
    return lines.withColumn("l_tax", tax).withColumn("_copy", F.explode(F.array_repeat(F.lit(0), copies))).drop("_copy")
