"""One scan of Java source: scopes, members, extents; constants and jobs over several files."""

import uuid

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shuffleworks import testkit
from shuffleworks.functions.javascan import File
from shuffleworks.operators import javasource, jobtable, schemas
from shuffleworks.plans import corpus_queries
from shuffleworks.session import BATCH_CONF

HADOOP = '''package org.apache.demo;
import java.util.*;
import static lib.Names.TITLE;
/* class Ghost { */ // class Other {
@Deprecated @SuppressWarnings({"x", "}"})
public class WordCount<T extends Foo<T>> extends Configured implements Tool, Map<K, List<V>> {
    private static final String IN = "/data/" + "in\\u0041", OUT = "/out";
    static String mode = "m";
    private Text key = new Text(); int a, b;
    int[] list = {1, 2}; Runnable r = new Runnable() { public void run() { class Local { } } };
    public static class TokenizerMapper extends Mapper<Object, Text, Text, IntWritable> {
        public void map(Object key, Text value) throws IOException { String s = "} class X {"; char c = '{'; }
    }
    interface Inside { class Deep { } void f(); }
    enum Kind { A, B { void g() { } }; int z; }
    public static class IntSumReducer extends Reducer<Text, IntWritable, Text, IntWritable> { }
    public static void main(String[] args) throws Exception {
        Job job = Job.getInstance(new Configuration(), "word " + TITLE);
        job.setMapperClass(TokenizerMapper.class);
        job.setReducerClass(IntSumReducer.class);
        String base = "/first"; base = "/x";
        for (String p : args) { FileInputFormat.addInputPath(job, new Path(p)); }
        if (args.length > 1) { FileInputFormat.addInputPath(job, new Path(base, IN)); }
        each(x -> { FileOutputFormat.setOutputPath(job, new Path(OUT)); });
    }
    void two(Job job, String IN) { job.setMapperClass(M.class); FileInputFormat.addInputPath(job, new Path(IN)); mode = "y"; }
}
class After { }
record R(int x) { class InRecord { } }
'''


def test_types_nest_and_have_extents():
    file = File(HADOOP)
    found = {t["qualified"]: t for t in file.types}
    assert list(found) == [
        "WordCount", "WordCount.Local", "WordCount.TokenizerMapper", "WordCount.Inside", "WordCount.Inside.Deep",
        "WordCount.Kind", "WordCount.IntSumReducer", "After", "R", "R.InRecord",
    ]
    top = found["WordCount"]
    assert (top["extends"], top["implements"], top["outer"]) == ("Configured", ["Tool", "Map<K, List<V>>"], None)
    assert HADOOP[top["start"] :].startswith("@Deprecated") and HADOOP[top["body"] - 1] == "{" and HADOOP[top["end"] - 1] == "}"
    assert HADOOP[top["end"] :].startswith("\nclass After")
    assert found["WordCount.TokenizerMapper"]["extends"] == "Mapper<Object, Text, Text, IntWritable>"
    assert found["WordCount.Inside.Deep"]["outer"] == "WordCount.Inside"


def test_members_belong_to_their_own_type():
    file = File(HADOOP)
    methods = [(file.types[m["type"]]["qualified"], m["name"]) for m in file.methods]
    assert methods == [("WordCount.TokenizerMapper", "map"), ("WordCount", "main"), ("WordCount", "two")]
    fields = [(file.types[f["type"]]["class_name"], f["name"], f["java_type"], f["is_static"]) for f in file.fields]
    assert [f for f in fields if f[0] == "WordCount"] == [
        ("WordCount", "IN", "String", True), ("WordCount", "OUT", "String", True), ("WordCount", "mode", "String", True), ("WordCount", "key", "Text", False),
        ("WordCount", "a", "int", False), ("WordCount", "b", "int", False), ("WordCount", "list", "int[]", False), ("WordCount", "r", "Runnable", False),
    ]
    assert [f for f in fields if f[0] != "WordCount"] == [("Kind", "z", "int", False)]
    values = {f["name"]: f["terms"] for f in file.fields}
    assert values["IN"] == [("/data/", None), ("inA", None)] and values["mode"] is None  # assigned in a method


@pytest.mark.parametrize("source", ["", "}", "{", "class", "class A", "class A {", "class A { void f() {", '"', "/*", "class A { int x = (; }", "} class B { }", "a.class {", "x = new int[] {1}; }}}", "@", "@interface X { }"])
def test_broken_sources_do_not_fail(source):
    file = File(source)
    assert all(t["end"] <= len(source) for t in file.types)


def jobs_of(spark, *texts):
    files = spark.createDataFrame([(f"F{i}.java", t) for i, t in enumerate(texts)], "path string, content string")
    scanned = javasource.scan(files)
    classes = javasource.scan_classes(scanned)
    plain = {r.job_name: r for r in jobtable.assemble_jobs(files, classes).collect()}
    found = {r.job_name: r for r in jobtable.assemble_jobs(files, classes, scanned=scanned).collect()}
    assert plain == found
    return found


def test_usual_one_file_job(spark):
    found = jobs_of(spark, HADOOP, 'package lib; class Names { static final String TITLE = PART + "s"; static final String PART = "count"; }')
    assert set(found) == {"WordCount.main.job", "WordCount.two.job"}
    job = found["WordCount.main.job"]
    assert (job.driver, job.mapper, job.reducer, job.mapper_path, job.title) == ("WordCount", "TokenizerMapper", "IntSumReducer", "F0.java", "word counts")
    assert (job.input_paths, job.output_paths, job.input_format) == ([None, "/x//data/inA"], ["/out"], "TextInputFormat")
    other = found["WordCount.two.job"]
    assert (other.mapper, other.mapper_path, other.reducer, other.input_paths, other.title) == ("M", None, None, [None], None)


def test_nested_class_before_one_of_the_package(spark):
    a = "package p; class A { static class Map extends Mapper<A, B, C, D> { } void f(Job job) { job.setMapperClass(Map.class); } }"
    b = "package p; class Map extends Mapper<A, B, C, D> { }"
    c = "package p; class C { void f(Job job) { job.setMapperClass(Map.class); job.setReducerClass(A.Map.class); } }"
    found = jobs_of(spark, b, a, c)
    assert found["A"].mapper_path == "F1.java" and (found["C"].mapper_path, found["C"].reducer_path) == ("F0.java", "F1.java")


def test_constants_round_and_unknown(spark):
    texts = [
        'package p; class A { static final String X = B.Y + "x"; static final String SELF = SELF; static final String LOST = Nowhere.Z; }',
        'package p; class B { static final String Y = C.Z; static final int N = 3; }',
        'package p; class C { static final String Z = "z" + B.N; }',
        "package p; import static p.A.X; class D { void f(Job j, int k) { j.setMapperClass(M.class); FileInputFormat.setInputPaths(j, new Path(X), new Path(A.SELF), A.LOST); FileOutputFormat.setOutputPath(j, new Path(\"a\" + k)); j.setJobName(B.N + X); } }",
    ]
    job = jobs_of(spark, *texts)["D"]
    assert (job.input_paths, job.output_paths, job.title) == (["z3x", None, None], [None], "3z3x")


def test_chain_by_paths(spark):
    texts = [
        'class W { void f(Job j) { j.setMapperClass(M.class); FileInputFormat.addInputPaths(j, "/a,/b"); FileOutputFormat.setOutputPath(j, new Path("/b/")); } }',
        'class V { void f(Job j) { j.setMapperClass(M.class); FileInputFormat.addInputPath(j, new Path("/c")); FileInputFormat.setInputPaths(j, "/b"); FileOutputFormat.setOutputPath(j, new Path("/a")); } }',
        'class U { void f(Job j) { j.setMapperClass(M.class); FileInputFormat.addInputPath(j, new Path("/b")); FileOutputFormat.setOutputPath(j, new Path("/b")); } }',
    ]
    found = jobs_of(spark, *texts)
    # W reads what it writes itself, so it comes after the other writer of /b or the writer of /a, the first by file.
    assert {n: j.chained_after for n, j in found.items()} == {"W": "V", "V": "W", "U": "W"}
    assert found["V"].input_paths == ["/b"]


def test_own_fields_of_key_classes(spark):
    text = """class Pair implements WritableComparable<Pair> { private Text a; static int n; class In { Text hidden; }
      void write() { Text local; } long b = 1; } class Other { Text c; }"""
    files = spark.createDataFrame([("P.java", text), ("N.java", None)], "path string, content string")
    rows = schemas.own_key_fields(javasource.scan(files)).orderBy("pos").collect()
    assert [(r.source_class, r.name, r.java_type, r.spark_type) for r in rows] == [("Pair", "a", "Text", "StringType"), ("Pair", "b", "long", "LongType")]


def test_no_files(spark):
    files = spark.createDataFrame([], "path string, content string")
    assert jobtable.assemble_jobs(files, javasource.scan_classes(javasource.scan(files))).count() == 0


def test_files_of_a_batch_go_out_a_few_at_a_time():
    """A batch of long texts must not be held a second time, as objects and as results."""
    names = [f"f{i}" for i in range(200)]
    batch = pa.RecordBatch.from_pydict({"file_path": names, "marks": [""] * 200, "text": [HADOOP] * 200})
    sizes, found = [], []
    for part in javasource._scan(iter([batch, batch.slice(0, 0)])):
        sizes.append(part.num_rows)
        found += part.column("file_path").to_pylist()
    assert found == names and max(sizes) <= 64


@pytest.mark.parametrize("name", ["assembled_drivers", "nested_classes", "own_key_fields", "assemble_jobs"])
def test_texts_reach_a_worker_in_small_batches(spark, monkeypatch, tmp_path, name):
    """A worker holds two batches of texts, so what it gets at once must not grow with its task."""
    scan, folder = javasource._scan, str(tmp_path)

    def noted(batches):
        for batch in batches:
            with open(f"{folder}/{uuid.uuid4()}", "w") as file:
                file.write(f"{batch.num_rows} {batch.nbytes}")
            yield from scan(iter([batch]))

    content = F.concat(F.lit(HADOOP + "/*"), F.repeat(F.lit("x"), 100_000), F.lit("*/"))
    files = spark.range(0, 120, 1, 1).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"), content.alias("content"))
    monkeypatch.setattr(javasource, "_scan", noted)
    monkeypatch.setattr(testkit, "driver_files", lambda *_: files)
    before = spark.conf.get(BATCH_CONF)
    if name == "assemble_jobs":
        classes = spark.createDataFrame([], "class_name string, file_path string, package string")
        jobs = jobtable.assemble_jobs(files, classes)
        assert jobs.count() == 240
    else:
        corpus_queries.REGISTRY.queries[name](spark, "").collect()
    seen = [tuple(map(int, note.read_text().split())) for note in tmp_path.iterdir()]
    assert sum(rows for rows, _ in seen) % 120 == 0 and max(size for _, size in seen) < 3 << 20
    assert spark.conf.get(BATCH_CONF) == before
