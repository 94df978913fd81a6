import random

import pytest
from pyspark.sql import functions as F

from shuffleworks.operators import corpus, deps, jobtable

CLASSES = "class_name string, file_path string, class_pos int, imports array<string>"


def classes(spark, *rows):
    return spark.createDataFrame(list(rows), CLASSES)


def items(df):
    return sorted((r.matched_prefix, r.artifact, r.location, r.suggestion) for r in df.collect())


def test_risks_of_imports_and_builds(spark):
    cls = classes(spark, ("A", "a.java", 0, ["com.acme.X", "com.acmex.Y", "java.util.List"]))
    builds = spark.createDataFrame(
        [
            ("pom.xml", "<groupId> com.acme </groupId>\n<artifactId>lib</artifactId><groupId>o</groupId><x/>"),
            ("b.gradle", "api 'com.acme:core:1.0' ; api \"my.com.acme:z\"; api 'com.acme:snap:1-SNAPSHOT'"),
            ("c.txt", "'com.acme:no'"),
        ],
        "path string, content string",
    )
    found = items(deps.scan_risks(cls, builds, ["com.acme"]))
    default = "Review for Spark-native equivalent or rewrite as custom UDF"
    tree = "Review dependency tree and consider Spark-native alternatives"
    assert found == sorted(
        [
            ("com.acme", "com.acme.X", "a.java", default),
            ("com.acme", "com.acmex.Y", "a.java", default),  # no boundary after the prefix
            ("com.acme", "com.acme:lib", "pom.xml", tree),
            ("com.acme", "com.acme:core", "b.gradle", tree),
            ("com.acme", "my.com.acme:z", "b.gradle", tree),
        ]
    )


def test_same_import_in_two_files_is_two_items(spark):
    cls = classes(spark, ("A", "a.java", 0, ["x.Y", "x.Y"]), ("B", "a.java", 1, ["x.Y"]), ("C", "c.java", 0, ["x.Y"]))
    out = deps.scan_risks(cls, None, ["x.Y", "x"])
    assert [(i[0], i[2]) for i in items(out)] == [("x.Y", "a.java"), ("x.Y", "c.java")]
    first = deps.scan_risks(cls, None, ["x", "x.Y"])
    assert {i[0] for i in items(first)} == {"x"}


def test_no_prefixes_no_risks(spark):
    cls = classes(spark, ("A", "a.java", 0, ["x.Y"]))
    for prefixes in ([], ["", "  "]):
        found = deps.scan_risks(cls, None, prefixes)
        assert found.count() == 0
        assert tuple(deps.risk_verdict(found, "block").first()) == (0, 0, False)


@pytest.mark.parametrize("action, blocked", [("block", True), ("warn", False), ("info", False)])
def test_verdict(spark, action, blocked):
    found = deps.scan_risks(classes(spark, ("A", "a", 0, ["x.Y"])), None, ["x"])
    assert tuple(deps.risk_verdict(found, action).first()) == (1, 0, blocked)


def test_suggestions_by_first_pattern(spark):
    names = ["org.apache.hadoop.io.Text", "org.apache.hadoop.mapreduce.Job", "hadoop.fs.Path", "cascading.flow", "org.pig.X", "a.hive.b", "x", "my.cascading.hadoop.io.z"]
    df = spark.createDataFrame([(n,) for n in names], "i string").select("i", deps.suggest_alternative(F.col("i")).alias("s"))
    words = {r.i: r.s.split()[0:3] for r in df.collect()}
    assert words["my.cascading.hadoop.io.z"] == words["org.apache.hadoop.io.Text"] == ["Use", "Spark", "Dataset/DataFrame"]
    assert words["cascading.flow"] == ["Rewrite", "in", "Spark"] and words["x"] == ["Review", "for", "Spark-native"]


def brute(texts, prefixes, hit):
    return sorted((t, p) for t in texts for p in prefixes if hit(t, p))


TEXTS = ["com.acme.a", "com.acmex", "com", "", "org.x", "zcom.acme"]
PREFIXES = ["com.acme", "com", "com.acme.a", "org", "x", "."]


@pytest.fixture(params=[True, False], ids=["in every task", "by join"])
def either_way(request, monkeypatch):
    """Tables of prefixes small enough for every task, and larger ones."""
    if not request.param:
        monkeypatch.setattr(deps, "FEW", -1)
        monkeypatch.setattr(deps, "ROWS", 2)  # copies for keys of three rows and more
    return request.param


@pytest.mark.parametrize("as_list", [True, False])
def test_list_and_table_agree(spark, plan, as_list, either_way):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    given = [*PREFIXES, " ", ""]  # blank ones match nothing
    given = given if as_list else spark.createDataFrame(list(enumerate(given)), "prefix_pos int, prefix string")
    starts = deps.match_prefix(df, "t", given)
    inside = deps.match_contains(df, "t", given)
    assert sorted((r.t, r.prefix) for r in starts.collect()) == brute(TEXTS, PREFIXES, str.startswith)
    assert sorted((r.t, r.prefix) for r in inside.collect()) == brute(TEXTS, PREFIXES, str.__contains__)
    for df in (starts, inside):
        assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)


def test_prefix_table_joins_by_hash(spark, plan, monkeypatch):
    monkeypatch.setattr(deps, "FEW", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
        table = spark.createDataFrame(list(enumerate(PREFIXES)), "prefix_pos int, prefix string")
        out = deps.match_prefix(df, "t", table)
        assert "SortMergeJoin" in plan(out)
        assert sorted((r.t, r.prefix) for r in out.collect()) == brute(TEXTS, PREFIXES, str.startswith)
        assert deps.match_prefix(df, "t", table.where("false")).count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_random_texts_and_patterns(spark, either_way):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    texts = [word(rng.randrange(60)) for _ in range(150)] + ["abab" * 30] * 20
    given = sorted({word(n) for n in (1, 2, 3, 4, 5, 6, 9) for _ in range(6)})
    given = [p for p in given if p.strip()]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, None])], "i int, t string, prefix_len string").repartition(3)
    table = spark.createDataFrame(list(enumerate(given)), "prefix_pos int, prefix string")
    inside = sorted((r.i, r.t, r.prefix_len, r.prefix_pos, r.prefix) for r in deps.match_contains(df, "t", table).collect())
    assert inside == sorted((i, t, "x", n, p) for i, t in enumerate(texts) for n, p in enumerate(given) if p in t)
    starts = sorted((r.i, r.prefix_pos) for r in deps.match_prefix(df, "t", table).collect())
    assert starts == sorted((i, n) for i, t in enumerate(texts) for n, p in enumerate(given) if t.startswith(p))
    assert deps.match_contains(df, "t", table.where("false")).count() == 0 and deps.match_prefix(df, "t", table.where("false")).count() == 0


def test_copies_of_a_prefix_count_once(spark, either_way):
    df = spark.createDataFrame([("ab",), ("ab",)], "t string")
    table = spark.createDataFrame([(3, "a"), (1, "a"), (2, "a")], "prefix_pos int, prefix string")
    for prefixes in (table, ["z", "a", "a"]):
        for match in (deps.match_prefix, deps.match_contains):
            assert [tuple(r) for r in match(df, "t", prefixes).collect()] == [("ab", 1, "a")] * 2


# --- jobs -------------------------------------------------------------------


def test_defaults_stand_in_for_missing_keys_only(spark):
    raw = [
        (1, '{"jobs": [{"job_name": "a"}, {"job_name": "b", "input_format": null, "input_paths": ["x"], "mapper": {"class_name": "M"}}]}'),
        (2, '{"other": 1}'),
        (3, "not json"),
        (4, '{"jobs": []}'),
        (5, '{"jobs": null}'),
        (6, '{"jobs": "x"}'),
        (7, None),
    ]
    df = spark.createDataFrame(raw, "id int, raw string")
    jobs, errors = jobtable.normalise_jobs(df)
    a, b = jobs.orderBy("id", "job_pos").collect()
    assert (a.input_format, a.output_format, a.input_paths, a.output_paths) == ("TextInputFormat", "TextOutputFormat", ["/data/input"], ["/data/output"])
    assert a.composite_keys == [] and a.mapper is None and a.chained_after is None
    assert (b.input_format, b.input_paths, b.mapper) == (None, ["x"], "M")
    assert sorted(r.id for r in errors.collect()) == [2, 3, 5, 6, 7]
    summary = {r.id: (r.n_jobs, r.chain_count, r.complexity) for r in jobtable.graph_summary(df).collect()}
    assert summary == {1: (2, 2, "medium"), 4: (0, 0, "medium")}


def test_jobs_from_driver_sources(spark):
    texts = [
        ("M.java", "package p;\nclass M extends Mapper<A, B, C, D> {}"),
        ("M2.java", "package p;\nclass M extends Mapper<A, B, C, D> {}"),  # a copy
        ("other/M.java", "package q;\nclass R extends Reducer<A, B, C, D> {}"),
        ("D.java", "package p;\nimport org.apache.hadoop.mapreduce.Job;\nclass D { void f() {\n// j.setMapperClass(Old.class);\n"
         "j.setMapperClass( M.class ); j.setReducerClass(p.R.class); j.setMapperClass(Second.class); } }"),
        ("E.java", "package p;\nimport org.apache.hadoop.mapreduce.Job;\nclass E {}"),
        ("Two.java", "package p;\nimport org.apache.hadoop.mapreduce.Job;\nimport q.R;\nclass Helper {}\nclass Two { void f() {\n"
         "a.setMapperClass(M.class); b.setMapperClass(p.M.class); b.setReducerClass(R.class); a.setReducerClass(q.R.class); } }\n"
         "class After {}"),
    ]
    files = spark.createDataFrame(texts, "path string, content string")
    found = {j.job_name: j for j in jobtable.assemble_jobs(files, corpus.extract_classes(files)).collect()}
    assert set(found) == {"D", "Two.a", "Two.b"}
    for name in ("Two.a", "Two.b"):
        job = found[name]
        assert (job.driver, job.mapper, job.mapper_path, job.reducer, job.reducer_path) == ("Two", "M", "M.java", "R", "other/M.java")
    job = found["D"]
    assert (job.job_name, job.package, job.file_path) == ("D", "p", "D.java")
    assert (job.mapper, job.mapper_path) == ("Second", None)  # a setter overwrites
    assert (job.reducer, job.reducer_path) == ("R", None)  # R is in another package
    assert job.combiner is None and job.partitioner is None


def chains(spark, *edges):
    good, bad = jobtable.resolve_chains(spark.createDataFrame(list(edges), "job_name string, chained_after string"))
    return {r.job: (r.root, r.depth) for r in good.collect()}, {r.job: r.reason for r in bad.collect()}


def test_chains_and_what_breaks_them(spark):
    good, bad = chains(
        spark, ("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "a"), ("a", None),
        ("x", "missing"), ("y", "x"), ("p", "q"), ("q", "p"), ("s", "s"), ("t", "s"), ("m", "a"), ("m", "b"), ("n", "m"),
    )
    assert good == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 2), "d": ("a", 3), "e": ("a", 1)}
    assert bad == {
        "x": "broken", "y": "broken", "p": "cycle", "q": "cycle", "s": "cycle", "t": "cycle", "m": "ambiguous", "n": "broken",
    }


def test_long_chain(spark):
    edges = [(f"j{i}", f"j{i - 1}" if i else None) for i in range(300)]
    good, bad = chains(spark, *edges)
    assert not bad and all(good[f"j{i}"] == ("j0", i) for i in range(300))


def test_star_of_jobs_and_no_jobs(spark):
    good, bad = chains(spark, ("hub", None), *[(f"j{i}", "hub") for i in range(50)])
    assert not bad and len(good) == 51 and good["j7"] == ("hub", 1)
    assert chains(spark, (None, "x")) == ({}, {None: "no name"})
