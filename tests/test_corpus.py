import pytest
from pyspark.sql import functions as F

from shuffleworks.functions.text import split_top_level
from shuffleworks.operators import corpus, schemas
from shuffleworks.sources.files import scan_files, scan_schemas

PROJECT = {
    "src/HitMapper.java": """package net.hits;

import java.util.Map;
import java.util.*;
import static java.util.Map.entry;
import org.apache.hadoop.io.Text;

/* class Old extends Mapper<A, B, C, D> { } */
public class HitMapper
        extends Mapper<LongWritable, Text,
                Text, IntWritable> {
    // class Gone { }
    static class Counter implements Closeable, Comparable<Map<String, Counter>> { }
}
""",
    "src/HitCombiner.java": "package net.hits;\nclass HitCombiner extends Reducer<Text, IntWritable, Text, IntWritable> {\n}\n",
    "src/HitReducer.java": "package net.hits;\nclass HitReducer extends Reducer<Text, IntWritable, Text, IntWritable> {}",
    "src/HitKey.java": """package net.hits;
public final class HitKey implements WritableComparable<HitKey> {
    private Text host = new Text();
    protected LongWritable when;
    static final String NAME = "k";
    private int skipped;
}
""",
    "src/HitJob.java": """package net.hits;
import org.apache.hadoop.mapreduce.Job;
public class HitJob {
    public static void main(String[] args) { }
    class Helper { }
}
""",
    "src/hit.avsc": '{"name": "Hit", "fields": [{"name": "host", "type": "string"}, '
    '{"name": "n", "type": "int"}, {"name": "from", "type": ["null", "string"]}]}',
}


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    (root / "src").mkdir()
    for name, text in PROJECT.items():
        (root / name).write_text(text)
    files, _ = corpus.split_good_bad(scan_files(spark, str(root)))
    return files, scan_schemas(spark, str(root))


@pytest.fixture(scope="module")
def classes(project):
    return corpus.extract_classes(project[0])


def classes_in(spark, *texts):
    df = spark.createDataFrame([(f"F{i}.java", t) for i, t in enumerate(texts)], "path string, content string")
    return corpus.extract_classes(df)


def one(spark, text):
    (row,) = classes_in(spark, text).collect()
    return row


def test_all_classes_with_roles(classes):
    assert {(r.class_name, r.role) for r in classes.collect()} == {
        ("HitMapper", "mapper"),
        ("Counter", "unclassified"),
        ("HitCombiner", "combiner"),
        ("HitReducer", "reducer"),
        ("HitKey", "composite_key"),
        ("HitJob", "driver"),
        # A class in a driver's file is a driver too.
        ("Helper", "driver"),
    }


def test_details_of_a_class(classes):
    row = classes.where("class_name = 'HitMapper'").first()
    assert row.package == "net.hits"
    assert row.file_path == "src/HitMapper.java" and row.class_pos == 0
    assert row.imports == ["java.util.Map", "java.util.*", "org.apache.hadoop.io.Text"]
    assert row.extends == "Mapper<LongWritable, Text, Text, IntWritable>" and row.implements == []
    nested = classes.where("class_name = 'Counter'").first()
    assert nested.extends is None and nested.implements == ["Closeable", "Comparable<Map<String, Counter>>"]
    assert nested.class_pos == 1


def test_role_counts_list_every_role(spark, classes):
    assert {r.role: r.n for r in corpus.role_counts(classes).collect()} == {
        "driver": 2, "mapper": 1, "reducer": 1, "combiner": 1, "partitioner": 0, "composite_key": 1, "unclassified": 1,
    }
    none = corpus.role_counts(classes.where("false"))
    assert [r.n for r in none.collect()] == [0] * 7
    odd = spark.createDataFrame([("other",), (None,)], "role string")
    assert {r.role: r.n for r in corpus.role_counts(odd).collect()}["unclassified"] == 2
    assert [tuple(r) for r in corpus.role_summary(odd).collect()] == [("other", 1), ("unclassified", 1)]


@pytest.mark.parametrize(
    "header",
    [
        "class A extends Mapper<Object, byte[], Text, X> {",
        "class A<T extends Foo> extends a.b.Mapper<T, ?, List<? extends T>, X> {",
        "class A\n  extends\n Mapper<K,\n V, K, V>\n{",
        "public static abstract class A extends Mapper<K, V, K, V> implements B, C<D> {",
        "class A extends Mapper<Größe, Ключ, K, V> {",
    ],
)
def test_headers_that_must_be_found(spark, header):
    row = one(spark, header + "}")
    assert (row.class_name, row.role) == ("A", "mapper")


def test_interfaces_and_enums_are_no_classes(spark):
    assert classes_in(spark, "interface A { } enum B { } @interface C {}", "", None).collect() == []


def test_literals_and_comments_hide_no_classes(spark):
    text = """class A { String p = "/data/*"; char q = '"'; String s = "class No { // "; }
// class Never {
class B<T> extends Mapper<T, X, Y, Z> { String long = "%s"; /* class Nor { */ }
class C { String t = \"\"\"
class Neither {
\"\"\"; } class D%s{ }
/* open class Last { """ % ("x" * 50000, " " * 50000)
    assert [r.class_name for r in classes_in(spark, text).collect()] == ["A", "B", "C", "D"]


def test_headers_without_a_body_take_linear_time(spark):
    assert classes_in(spark, "class A extends B" + " " * 200000 + ";", "class A extends " + "a " * 200000).count() == 0


def test_raw_base_class_does_not_match(spark):
    # Without type parameters the base class says nothing, and "Mapper" contains "app".
    assert one(spark, "class FooMapper extends Mapper {}").role == "driver"
    assert one(spark, "class Foo extends Mapper {}").role == "unclassified"
    assert one(spark, "class Foo extends Reducer {}").role == "unclassified"


def test_first_rule_decides(spark):
    assert one(spark, "class MyCOMBINER extends Reducer<A, B, C, D> {}").role == "combiner"
    assert one(spark, "class MyCombiner extends Reducer {}").role == "combiner"
    assert one(spark, "class MyCombiner extends Mapper<A, B, C, D> {}").role == "mapper"
    assert one(spark, "class X extends Combiner<A, B> {}").role == "combiner"
    assert one(spark, "class X extends HashPartitioner {}").role == "partitioner"
    assert one(spark, "class X implements A, WritableComparable {}").role == "composite_key"
    assert one(spark, "import org.apache.hadoop.mapred.JobConf;\nclass X {}").role == "driver"
    assert one(spark, "class X { public static void main() { Job j; } }").role == "driver"
    assert one(spark, "class X { public static void main() { } }").role == "unclassified"
    assert one(spark, "class DataLauncher {}").role == "driver"


def test_package_and_imports_start_a_line(spark):
    row = one(spark, " package no.pe;\n  import a.B;\nimport c.D ;\r\nclass X {}")
    assert row.package is None and row.imports == ["c.D"]


@pytest.mark.parametrize(
    "text, parts",
    [
        ("A, Map<K, V>, B", ["A", "Map<K, V>", "B"]),
        ("", []),
        ("a,", ["a"]),
        ("a,,b", ["a", "", "b"]),
        ("Map<K, List<V, W>>", ["Map<K, List<V, W>>"]),
        ("a<b, c", ["a<b, c"]),
        (None, None),
    ],
)
def test_split_top_level(spark, text, parts):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(split_top_level(F.col("s"))).first()[0] == parts


# --- schemas ----------------------------------------------------------------


def fields_of(df, source_class):
    rows = df.where(F.col("source_class") == source_class).orderBy("pos").collect()
    return [(r.name, r.java_type, r.spark_type) for r in rows]


def test_resolved_schemas_of_the_project(project, classes):
    files, schema_files = project
    fields, unresolved = schemas.resolve_schemas(classes, files, schema_files)
    assert fields_of(fields, "HitKey") == [
        ("host", "Text", "StringType"),
        ("when", "LongWritable", "LongType"),
        ("NAME", "String", "StringType"),
    ]
    assert fields_of(fields, "HitMapper") == [
        ("input_key", "LongWritable", "LongType"),
        ("input_value", "Text", "StringType"),
        ("output_key", "Text", "StringType"),
        ("output_value", "IntWritable", "IntegerType"),
    ]
    assert fields_of(fields, "Hit") == [
        ("host", "string", "StringType"),
        ("n", "int", "IntegerType"),
        ("from", "string", "StringType"),
    ]
    assert {r.format for r in fields.where("source_class = 'Hit'").collect()} == {"avro"}
    assert unresolved.count() == 0


def key_class(spark, path):
    return spark.createDataFrame([("K", path, "composite_key")], "class_name string, file_path string, role string")


def test_key_fields_fall_through(spark):
    files = spark.createDataFrame(
        [("w", "void f() { this.a.write(o); this.b.readFields(i); this.a.readFields(i); out.writeLong(x); }"), ("n", "int x;")],
        "path string, content string",
    )
    fields = lambda path: fields_of(schemas.composite_key_fields(key_class(spark, path), files), "K")
    assert fields("w") == [("a", "Unknown", "StringType"), ("b", "Unknown", "StringType")]
    assert fields("gone") == [("key", "Unknown", "StringType")]
    assert fields("n") == [] and fields(None) == []
    for path, lost in (("n", 1), (None, 1), ("gone", 0), ("w", 0)):
        assert schemas.unresolved_keys(key_class(spark, path), files).count() == lost


def test_copies_of_a_file_do_not_multiply_fields(spark):
    files = spark.createDataFrame([("k", "private Text a;")] * 3, "path string, content string")
    assert schemas.composite_key_fields(key_class(spark, "k"), files).count() == 1


def test_generics_need_four_parts(spark):
    df = spark.createDataFrame(
        [("A", "f", "reducer", "Reducer<Text, Map<K, V>, Void, Group, Extra>"), ("B", "f", "mapper", "Mapper<A, B, C>"), ("C", "f", "mapper", None)],
        "class_name string, file_path string, role string, extends string",
    )
    out = schemas.generic_fields(df)
    assert [t for _, t, _ in fields_of(out, "A")] == ["Text", "Map<K, V>", "Void", "Group"]
    assert [t for _, _, t in fields_of(out, "A")] == ["StringType"] * 4
    assert out.count() == 4


@pytest.mark.parametrize(
    "content",
    ['{"name": "R", "fields": []}', '{"name": "R"}', "[1]", "{", '{"name": "R", "fields": [{"name": "a", "type": "int"}]} x', "", None],
)
def test_avro_files_without_rows(spark, content):
    df = spark.createDataFrame([("p", content)], "path string, content string")
    assert schemas.avro_fields(df).count() == 0


def test_avro_types(spark):
    types = ['"long"', '["int", "null"]', '["null", {"type": "bytes"}]', '["null"]', '{"type": "map", "values": "int"}', '"Other"']
    fields = ", ".join(f'{{"name": "f{i}", "type": {t}}}' for i, t in enumerate(types))
    df = spark.createDataFrame([("p", f'{{"name": "R", "fields": [{fields}]}}')], "path string, content string")
    assert [(j, s) for _, j, s in fields_of(schemas.avro_fields(df), "R")] == [
        ("long", "LongType"),
        ("int", "IntegerType"),
        ("bytes", "BinaryType"),
        ("string", "StringType"),
        ("map", "StringType"),
        ("Other", "StringType"),
    ]


def test_struct_type_and_typed_rows(spark):
    fields = spark.createDataFrame(
        [("C", 1, "b", "DecimalType(38,10)"), ("C", 0, "a", "IntegerType"), ("C", 2, "c", "NullType"), ("D", 0, "x", "LongType")],
        "source_class string, pos int, name string, spark_type string",
    )
    schema = schemas.to_struct_type(fields, "C")
    assert schema.simpleString() == "struct<a:int,b:decimal(38,10),c:void>"
    raw = spark.createDataFrame([("1", "2.5", "x"), ("oops", "", "y")], "a string, b string, c string")
    first, second = schemas.apply_schema(raw, schema).collect()
    assert first.a == 1 and str(first.b) == "2.5000000000" and first.c is None
    assert second.a is None and second.b is None
    copies = schemas.generic_fields(
        spark.createDataFrame(
            [("R", f"f{i}", "reducer", "Reducer<Text, Text, Text, IntWritable>") for i in range(3)],
            "class_name string, file_path string, role string, extends string",
        )
    )
    assert len(schemas.to_struct_type(copies, "R")) == 4 == len(schemas.to_struct_type(copies, "R", "f2"))
    with pytest.raises(ValueError, match="no schema"):
        schemas.to_struct_type(fields, "Z")


def test_whole_project(spark, tmp_path):
    from shuffleworks.plans.project import analyse_project

    (tmp_path / "src").mkdir()
    for name, text in PROJECT.items():
        (tmp_path / name).write_text(text.replace("{ }\n    class Helper", "{ job.setMapperClass(HitMapper.class); }\n    class Helper"))
    (tmp_path / "pom.xml").write_text("<groupId>net.hits</groupId><artifactId>job</artifactId>")
    tables = analyse_project(spark, str(tmp_path), ["org.apache.hadoop", "net.hits"], "block")
    assert tuple(tables.summary.first()) == (6, 5, 1)
    assert tables.files.columns == ["path", "abs_path", "size_bytes", "kind"]
    assert tables.errors.count() == 0
    assert {r.role: r.n for r in tables.role_counts.collect()}["driver"] == 2
    assert tables.fields.where("format = 'avro'").count() == 3 and tables.unresolved.count() == 0
    assert [(r.driver, r.mapper, r.mapper_path) for r in tables.jobs.where("driver = 'HitJob'").collect()] == [
        ("HitJob", "HitMapper", "src/HitMapper.java")
    ]
    assert sorted((r.artifact, r.location.split("/")[-1]) for r in tables.risks.collect()) == [
        ("net.hits:job", "pom.xml"),
        ("org.apache.hadoop.io.Text", "HitMapper.java"),
        ("org.apache.hadoop.mapreduce.Job", "HitJob.java"),
    ]
    assert tuple(tables.verdict.first()) == (3, 0, True)
