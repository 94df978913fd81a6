import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from shuffleworks.functions.timing import duration_ms
from shuffleworks.operators import payloads, runs

FENCE = "```"


@pytest.mark.parametrize(
    "raw, strategy, value",
    [
        ('{"a": 1}', 1, {"a": 1}),
        (' [1, "x"] ', 1, [1, "x"]),
        ('{"a": 1, "a": 2}', 1, {"a": 2}),
        (f'see {FENCE}json\n{{"a": {{"b": 1}}}}\n{FENCE} {{x}}', 2, {"a": {"b": 1}}),
        (f'see {FENCE}\n{{"a": 1}}\n{FENCE}', 2, {"a": 1}),
        ('{"a": 1}x', 3, {"a": 1}),
        (f'{FENCE}json\n{{"a": }}\n{FENCE}', None, None),
        ('text {"a": "x\ny"} end', 4, {"a": "xy"}),
        ('{"a": "C:\\dir"}', 4, {"a": "C:\\dir"}),
        ('pre {"a": "\\u0041 \\q"}', 4, {"a": "\\u0041 \\q"}),
        ("}{", None, None),
        ("", None, None),
        (None, None, None),
    ],
)
def test_salvage_strategies(spark, raw, strategy, value):
    df = spark.createDataFrame([(7, raw)], "id int, raw string")
    (row,) = payloads.salvage_json(df, "raw").collect()
    assert row.id == 7 and row.strategy == strategy
    assert (json.loads(row.payload) if row.payload else None) == value
    assert (row.error is None) == (strategy is not None)


def payload_frame(spark, *docs):
    return spark.createDataFrame([(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "id int, payload string")


def test_file_maps_are_filtered(spark):
    df = payload_frame(
        spark,
        {"files": {"a.scala": "x\ny", "project/p.scala": "no", "b.txt": "no", "deep/pom.xml.scala": "no"}, "warnings": ["w"]},
        {"files": {"a.scala": "x", "b.scala": {"k": 1}}},
        {"files": {}},
        {"nothing": 1},
        {"files": {"a.scala": None}},
    )
    kept = payloads.filter_generated_files(df)
    assert [tuple(r) for r in kept.collect()] == [(0, "a.scala", "x\ny")]
    summary = {r.id: (r.file_count, r.warning_count, r.rejected) for r in payloads.payload_summary(df).collect()}
    assert summary == {0: (1, 4, False), 1: (0, 0, True), 2: (0, 0, False), 3: (0, 0, True), 4: (0, 0, True)}
    errors = {r.id: r.error for r in payloads.payload_summary(df).collect()}
    assert errors[1] == "File content for 'b.scala' is not a string"
    assert errors[3] == "Missing 'files' key in codegen response"
    warnings = [r.warning for r in payloads.payload_warnings(df).where("id = 0").orderBy("pos").collect()]
    assert warnings == [
        "w",
        "Filtered out build file: project/p.scala",
        "Filtered out non-Scala file: b.txt",
        "Filtered out build file: deep/pom.xml.scala",
    ]


def test_code_blocks(spark):
    block = lambda code: f"{FENCE}scala\n{code}\n{FENCE}\n"
    df = spark.createDataFrame(
        [
            (1, "J", block("package a\nobject X { def main }") + block("package b\nobject Y") + block("package c\nZ") + block("package d\nlast")),
            (2, None, block("package a { def run }")),
            (3, "J", block("object NoPackage")),
            (4, "J", None),
        ],
        "id int, job_name string, raw string",
    )
    got = {(r.id, r.path.rsplit("/spark/", 1)[1]): r.content for r in payloads.extract_code_blocks(df).where("id < 4").collect()}
    assert got[(1, "driver/JApp.scala")] == "package a\nobject X { def main }"
    assert got[(1, "jobs/JJob.scala")] == "package b\nobject Y"
    assert got[(1, "service/JService.scala")] == "package d\nlast"
    assert got[(2, "jobs/SparkJobJob.scala")] == "package a { def run }"
    assert got[(3, "App.scala")].startswith("package com.example.spark\n\nobject App {")
    assert len(got) == 5


def test_overlay_replaces_whole_rows(spark, rows):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "n", 0)], "k int, s string, v int")
    base = base.union(base.where("k = 1"))  # a repeated row whose key is not patched
    patch = spark.createDataFrame([(2, None, 9), (3, "c", 3), (None, "m", 1)], "k int, s string, v int")
    assert rows(payloads.overlay(base, patch, ["k"])) == sorted([(1, "a", 1), (1, "a", 1), (2, None, 9), (3, "c", 3), (None, "m", 1)], key=repr)
    with pytest.raises(Exception, match="a key twice"):
        payloads.overlay(base, patch.union(patch), ["k"]).collect()


def test_overlay_of_maps(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "9", "c": "3"}), ({"a": "1"}, None)], "x map<string,string>, y map<string,string>")
    merged = [r[0] for r in df.select(payloads.overlay_map(F.col("x"), F.col("y"))).collect()]
    assert merged == [{"a": "1", "b": "9", "c": "3"}, {"a": "1"}]


# --- runs -------------------------------------------------------------------

UPDATES = [(1, "n", 1, "running"), (1, "n", 3, "failed"), (1, "n", 2, "success"), (1, "m", 1, None), (2, "n", 1, "x")]


@pytest.fixture
def updates(spark):
    return spark.createDataFrame(UPDATES, "run_id int, node_name string, seq int, status string")


def test_last_writer_wins_and_merging_again_changes_nothing(updates, rows):
    once = runs.merge_updates(updates, ["run_id", "node_name"], ["seq"])
    assert rows(once) == sorted([(1, "n", 3, "failed"), (1, "m", 1, None), (2, "n", 1, "x")], key=repr)
    assert rows(runs.merge_updates(once, ["run_id", "node_name"], ["seq"])) == rows(once)
    assert rows(runs.merge_updates(once.union(updates), ["run_id", "node_name"], ["seq"])) == rows(once)


def test_lists_keep_order_and_repeats(spark):
    df = spark.createDataFrame([("r", 1, 0, "b"), ("r", 0, 1, "a"), ("r", 0, 0, "a"), ("q", 0, 0, "z")], "run string, writer int, seq int, item string")
    out = runs.append_lists(df, ["run"], ["writer", "seq"])
    assert [r["item"] for r in out.where("run = 'r'").orderBy("pos").collect()] == ["a", "a", "b"]
    assert out.where("run = 'q'").first().pos == 0


def test_snapshot_fills_in_pending(updates):
    latest = runs.merge_updates(updates, ["run_id", "node_name"], ["seq"])
    out = {(r.run_id, r.node_name): r.status for r in runs.progress_snapshot(latest, ["n", "zz"]).collect()}
    assert out == {(1, "n"): "failed", (1, "zz"): "pending", (2, "n"): "x", (2, "zz"): "pending"}
    assert runs.progress_snapshot(latest).where("run_id = 2").count() == 14


def test_duration_is_truncated(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(at, at + dt.timedelta(microseconds=us)) for us in (0, 999, 1000, 57999, 86400 * 10**6)] + [(at, None), (None, at)]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz").select(duration_ms(F.col("a"), F.col("b")).alias("d"))
    assert [r.d for r in df.collect()] == [0, 0, 1, 57, 86400000, None, None]


def test_failed_nodes_and_summary(spark):
    progress = spark.createDataFrame(
        [(1, "b", "failed", "e2"), (1, "a", "failed", None), (1, "c", "success", None), (2, "a", "success", None)],
        "run_id int, node_name string, status string, error string",
    )
    found = runs.failed_nodes(progress).select("run_id", "place", "node_name", "error")
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1, "a", None), (1, 2, "b", "e2")]
    jobs = spark.createDataFrame([(1,), (1,)], "run_id int")
    files = spark.createDataFrame([(1, "a.scala"), (1, "b.sbt"), (2, "c.scala")], "run_id int, path string")
    reviews = spark.createDataFrame([(2, True)], "run_id int, human_review_required boolean")
    out = sorted(tuple(r) for r in runs.run_summary(progress, jobs, files, reviews).collect())
    assert out == [(1, 3, 1, 2, 2, 1, False), (2, 1, 1, 0, 0, 1, True)]


def test_top_k_with_null_group(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [(None, 9), (None, 8), ("b", 1)], "g string, v int")
    out = sorted(((r.g, r.v, r.place, r.remaining) for r in runs.top_k_with_remainder(df, ["g"], [F.desc("v")], 1).collect()), key=repr)
    assert out == sorted([("a", 4, 1, 4), (None, 9, 1, 1), ("b", 1, 1, 0)], key=repr)
    whole = runs.top_k_with_remainder(df, [], [F.desc("v")], 2)
    assert [(r.v, r.place, r.remaining) for r in whole.orderBy("place").collect()] == [(9, 1, 6), (8, 2, 6)]


def test_top_k_is_cut_before_the_shuffle(spark, plan):
    df = spark.createDataFrame([("a", 1)], "g string, v int")
    text = plan(runs.top_k_with_remainder(df, ["g"], ["v"], 3))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_error_lines_of_a_log(spark):
    def lines(stdout, stderr, **limits):
        df = spark.createDataFrame([(stdout, stderr)], "stdout string, stderr string")
        return runs.extract_error_lines(df, **limits).first().error_lines

    many = "\n".join(f"[ERROR] {i}" for i in range(500))
    assert lines("", many) == many.split("\n") == lines("", many, tail_chars=10**6, max_lines=10**6)
    assert lines("", many, max_lines=20) == many.split("\n")[:20]

    assert lines("[ERROR] x", "  error: a \nok\nNOT FOUND: b\nvalue q is not a member of r") == ["error: a", "NOT FOUND: b", "value q is not a member of r"]
    assert lines("cannot find symbol", "") == ["cannot find symbol"]
    assert lines("cannot find symbol", None) == ["cannot find symbol"]
    assert lines(None, None) == []
    assert lines("", "[ERROR] early\n" + "x" * 2000) == ["[ERROR] early"]
    assert lines("", "[ERROR] early\n" + "x" * 2000, tail_chars=2000) == []
    # The cut may fall inside a line.
    assert lines("", "[ERROR] " + "x" * 10 + " error: y" + "z" * 1992, tail_chars=2000) == ["error: y" + "z" * 1992]
    assert len(lines("", "error: \n" * 25)) == 25 and len(lines("", "error: \n" * 25, max_lines=20)) == 20


def test_attempts(spark, rows):
    df = spark.createDataFrame([(1, 5, False), (1, 3, True), (2, 1, True)], "run_id int, at int, success boolean")
    assert rows(runs.number_attempts(df, ["at"])) == [(1, 3, True, 1), (1, 5, False, 2), (2, 1, True, 1)]
    assert rows(runs.latest_attempt(df, ["at"])) == [(1, 5, False), (2, 1, True)]


@pytest.mark.parametrize(
    "state, verdict",
    [
        (("block", 1, True, 0, True), ("human_review", "test_check", "package_export")),
        (("block", 0, False, 2, False), ("project_scaffold", "critique_and_patch", "human_review")),
        (("warn", 4, False, 3, None), ("project_scaffold", "human_review", "human_review")),
        ((None, None, None, None, None), ("project_scaffold", "critique_and_patch", "human_review")),
    ],
)
def test_gates(spark, state, verdict):
    df = spark.createDataFrame([state], "risk_action string, risk_count int, last_success boolean, patch_attempts int, test_passed boolean")
    row = runs.gate_verdict(df).first()
    assert (row.after_risk, row.after_compile, row.after_test) == verdict


def test_review_messages(spark):
    df = spark.createDataFrame([(False, 2, 3), (True, 0, 1), (True, 0, 0), (None, None, None)], "last_success boolean, patch_attempts int, risk_count int")
    assert [r.review_message for r in runs.review_reasons(df).collect()] == [
        "Human review required: Compile failed after 2 patch attempt(s) · 3 custom library risk(s) detected",
        "Human review required: 1 custom library risk(s) detected",
        "Human review required",
        "Human review required",
    ]


def test_configs(spark):
    df = spark.createDataFrame(
        [("git", "u", "b", None), ("git", "", None, None), ("local", None, None, "p"), ("local", "u", "b", ""), (None, "u", "b", "p")],
        "mode string, repo_url string, branch string, local_path string",
    )
    assert [r.errors for r in runs.validate_configs(df).collect()] == [
        [],
        ["Git mode selected but repo_url is empty.", "Git mode selected but branch is empty."],
        [],
        ["Local mode selected but local_path is empty."],
        ["No pipeline config provided."],
    ]
