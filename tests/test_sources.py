import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from shuffleworks.operators.corpus import split_good_bad
from shuffleworks.operators.schemas import avro_fields
from shuffleworks import testkit
from shuffleworks.sources import files, formats
from shuffleworks.sources import tree as tree_module


@pytest.fixture
def tree(tmp_path):
    names = [
        "src/A.java", "src/deep/er/B.java", "pom.xml", "sub/build.gradle.kts", "src/notes.txt", "settings.gradle",
        "target/Gen.java", "a/out/C.java", "x/.git/D.java", "keep/outer/E.java", "build.gradle",
    ]
    for name in names:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"// {name}\n")
    (tmp_path / "src" / "Bad.java").write_bytes(b"class \xff Bad {}")
    schema = tmp_path / "target" / "r.avsc"
    schema.write_text('{"name": "R", "fields": [{"name": "a", "type": "int"}]}')
    return tmp_path


def test_scan_keeps_sources_and_build_files(spark, tree):
    found = {r.path: r.kind for r in files.scan_files(spark, str(tree)).collect()}
    assert found == {
        "src/A.java": "source",
        "src/Bad.java": "source",
        "src/deep/er/B.java": "source",
        "keep/outer/E.java": "source",
        "pom.xml": "build",
        "sub/build.gradle.kts": "build",
        "settings.gradle": "build",
        "build.gradle": "build",
    }


def test_scan_of_odd_paths(spark, tmp_path):
    folder = tmp_path / "my dir" / "50%"
    folder.mkdir(parents=True)
    (folder / "A b.java").write_text("x")
    for root in (f"{tmp_path}//my dir/", f"file://{tmp_path}/my dir", f"{tmp_path}/other/../my dir"):
        assert [r.path for r in files.scan_files(spark, root).collect()] == ["50%/A b.java"]


def test_hidden_names_are_names(spark, tmp_path):
    for name in ("_gen/_E.java", ".x/.y/F.java", "a/.mvn/G.java", "empty/.keep"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"\x00" * 5)
    found = files.scan_files(spark, str(tmp_path)).collect()
    assert sorted((r.path, r.size_bytes, len(r.content)) for r in found) == [(".x/.y/F.java", 5, 5), ("_gen/_E.java", 5, 5)]


def test_large_contents_in_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tree_module, "BATCH_BYTES", 1000)
    for i in range(40):
        (tmp_path / f"A{i}.java").write_text(str(i) * 300)
    found = files.scan_files(spark, str(tmp_path)).collect()
    assert {r.path: bytes(r.content).decode() for r in found} == {f"A{i}.java": str(i) * 300 for i in range(40)}


def test_scan_can_look_into_build_dirs(spark, tree):
    found = [r.path for r in files.scan_files(spark, str(tree), skip_build_dirs=False).collect()]
    assert "target/Gen.java" in found and "a/out/C.java" in found


def test_scan_details_and_summary(spark, tree):
    scanned = files.scan_files(spark, str(tree) + "/")
    row = scanned.where("path = 'src/A.java'").first()
    assert row.size_bytes == len("// src/A.java\n")
    assert row.abs_path.endswith(str(tree / "src/A.java"))
    assert bytes(row.content) == b"// src/A.java\n"
    assert tuple(files.scan_summary(scanned).first()) == (8, 4, 4)
    assert tuple(files.scan_summary(scanned.where("false")).first()) == (0, 0, 0)


def test_missing_root_is_an_error(spark, tmp_path):
    with pytest.raises(AnalysisException):
        files.scan_files(spark, str(tmp_path / "nowhere")).collect()


def test_bad_bytes_are_replaced_not_dropped(spark, tree):
    good, bad = split_good_bad(files.scan_files(spark, str(tree)))
    row = good.where("path = 'src/Bad.java'").first()
    assert row.content == "class � Bad {}" and row.was_repaired
    assert good.where("was_repaired").count() == 1
    assert bad.count() == 0
    lost = spark.createDataFrame([("x", None)], "path string, content binary")
    good, bad = split_good_bad(lost)
    assert good.count() == 0 and bad.collect() == [("x", "no content")]


def test_schema_scan_looks_everywhere(spark, tree):
    found = avro_fields(files.scan_schemas(spark, str(tree)))
    assert [(r.source_class, r.file_path, r.name, r.spark_type) for r in found.collect()] == [
        ("R", "target/r.avsc", "a", "IntegerType")
    ]


def test_lines_and_text_round_trip(spark, tmp_path):
    pairs = spark.createDataFrame([("a", 1), ("b", None), (None, 3)], "key string, value int")
    formats.write_text(pairs, str(tmp_path / "t"))
    assert sorted(r.value for r in formats.read_lines(spark, str(tmp_path / "t")).collect()) == ["3", "a\t1", "b"]
    with_file = formats.read_lines(spark, [str(tmp_path / "t")], with_file=True)
    assert with_file.columns == ["value", "file"] and with_file.where("file like '%/t/%'").count() == 3


@pytest.mark.parametrize("split", [64, 4096])
def test_offsets_equal_a_walk_through_the_bytes(spark, tmp_path, split):
    parts = [f"line {i} é\U0001f600 {'x' * (i * i % 90)}" + ["\n", "\r\n", "\r", "\n\n", "\r\r\n"][i % 5] for i in range(150)]
    texts = {"a.txt": "".join(parts).encode(), "b.txt": b"\n\none\ntwo", "c.txt": b"", "d.txt": b"end\r", "e.txt": b"\xff\xfe\nz\n"}
    for name, data in texts.items():
        (tmp_path / name).write_bytes(data)
    wanted = []
    for name, data in texts.items():
        at = 0
        for line in data.splitlines(keepends=True):
            wanted.append((name, at, line.rstrip(b"\r\n").decode(errors="replace")))
            at += len(line)
    settings = {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = formats.read_lines(spark, str(tmp_path), with_file=True, offsets=True).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r.file.rsplit("/", 1)[1], r.offset, r.value) for r in rows) == sorted(wanted)


def test_read_input_unions_paths(spark, tmp_path):
    for name in ("p1", "p2"):
        formats.write_parquet(spark.range(2), str(tmp_path / name), codec="gzip")
    both = formats.read_input(spark, "ParquetInputFormat", [str(tmp_path / "p1"), str(tmp_path / "p2")])
    assert both.count() == 4
    for name in ("t1", "t2"):
        formats.write_output(spark.range(3), output_path=str(tmp_path / name))
    assert formats.read_input(spark, input_paths=[str(tmp_path / "t1"), str(tmp_path / "t2")]).count() == 6
    with pytest.raises(ValueError, match="unknown format"):
        formats.read_input(spark, "NoSuchFormat", ["x"])


def test_partitioned_sink_prunes(spark, tmp_path, plan):
    df = spark.range(10).select(F.col("id"), (F.col("id") % 2).alias("p"))
    formats.write_parquet(df, str(tmp_path / "p"), partition_by=["p"])
    one = formats.read_parquet(spark, str(tmp_path / "p")).where("p = 1")
    assert one.count() == 5 and "PartitionFilters: [isnotnull(p" in plan(one)


def test_sequence_round_trip(spark, tmp_path, rows):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "key string, value int")
    formats.write_sequence(df, str(tmp_path / "s"))
    assert rows(formats.read_sequence(spark, str(tmp_path / "s"), "key string, value int")) == [("a", 1), ("b", 2)]


def test_tagged_union_matches_by_name(spark, rows):
    a = spark.createDataFrame([(1, "x")], "id int, s string")
    b = spark.createDataFrame([(2.0, 2)], "v double, id int")
    assert rows(formats.read_tagged({"a": a, "b": b}).select("tag", "id", "s", "v")) == [("a", 1, "x", None), ("b", 2, None, 2.0)]


def test_spread_small_leaves_wide_scans_alone(spark):
    assert testkit.spread_small(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == 4
    assert testkit.spread_small(spark.range(0, 100, 1, 9)).rdd.getNumPartitions() == 9
