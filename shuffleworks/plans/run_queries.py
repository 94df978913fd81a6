"""Registered queries: updates, progress, summaries, logs, verdicts, and the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shuffleworks import testkit
from shuffleworks.functions.timing import duration_ms
from shuffleworks.operators import runs
from shuffleworks.plans.registry import Registry
from shuffleworks.session import scratch_path
from shuffleworks.streaming import progress as stream
from shuffleworks.testkit import table

REGISTRY = Registry()


_KEYS, _ORDER = ["run_id", "node_name"], ["ts", "event_id"]


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.merge_updates(testkit.progress_updates(spark, sf_dir), _KEYS, _ORDER)


_LATEST = (
    "(SELECT user_id AS run_id, event_type AS node_name, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, "
    "event_id, CASE WHEN event_type = 'error' THEN 'code ' || event_id END AS error FROM events "
    "QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1)"
)


# --- progress ---------------------------------------------------------------


@REGISTRY.query(f"SELECT run_id, node_name, status, event_id, error FROM {_LATEST}")
def latest_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(spark, sf_dir).select("run_id", "node_name", "status", "event_id", "error")


@REGISTRY.query(
    "SELECT user_id AS run_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_type, event_id) - 1 AS pos FROM events"
)
def appended_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node writes a list; a run's list is those of its nodes one after the other."""
    updates = testkit.progress_updates(spark, sf_dir).select("run_id", "node_name", "event_id")
    return runs.append_lists(updates, ["run_id"], ["node_name", "event_id"]).select("run_id", "event_id", "pos")


@REGISTRY.query(
    "SELECT r.run_id, d.n AS node_name, coalesce(l.status, 'pending') AS status "
    "FROM (SELECT DISTINCT user_id AS run_id FROM events) r CROSS JOIN "
    "(VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view'), ('refund')) d(n) "
    f"LEFT JOIN {_LATEST} l ON l.run_id = r.run_id AND l.node_name = d.n"
)
def progress_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.progress_snapshot(_latest(spark, sf_dir), testkit.PROGRESS_NODES)


@REGISTRY.query(
    "SELECT event_id, CASE WHEN event_type = 'view' AND value < 10 THEN NULL ELSE event_id % 5000 END AS duration_ms FROM events"
)
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = testkit.progress_updates(spark, sf_dir)
    return updates.select("event_id", duration_ms(F.col("started_at"), F.col("ended_at")).alias("duration_ms"))


@REGISTRY.query(
    "SELECT run_id, node_name, error, row_number() OVER (PARTITION BY run_id ORDER BY node_name) AS place "
    f"FROM {_LATEST} WHERE status = 'failed'"
)
def failed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.failed_nodes(_latest(spark, sf_dir))


@REGISTRY.query(
    "SELECT p.run_id, total_nodes, success, failed, coalesce(jobs, 0) AS jobs, coalesce(scala_files, 0) AS scala_files, "
    "coalesce(review, false) AS human_review FROM (SELECT run_id, count(*) AS total_nodes, "
    f"count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed FROM {_LATEST} GROUP BY run_id) p "
    "LEFT JOIN (SELECT o_custkey AS run_id, count(*) AS jobs FROM orders GROUP BY 1) USING (run_id) "
    "LEFT JOIN (SELECT l_suppkey AS run_id, count(*) FILTER (l_linestatus = 'O') AS scala_files FROM lineitem GROUP BY 1) USING (run_id) "
    "LEFT JOIN (SELECT c_custkey AS run_id, c_acctbal < 0 AS review FROM customer) USING (run_id)"
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"))
    suffix = F.when(F.col("l_linestatus") == "O", ".scala").otherwise(".java")
    files = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("run_id"), F.concat(F.lit("f"), F.col("l_partkey").cast("string"), suffix).alias("path")
    )
    reviews = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("run_id"), (F.col("c_acctbal") < 0).alias("human_review_required")
    )
    return runs.run_summary(_latest(spark, sf_dir), jobs, files, reviews)


@REGISTRY.query(
    "SELECT o_custkey, o_orderkey, o_totalprice, CAST(place AS INTEGER) AS place, greatest(n - 5, 0) AS remaining FROM "
    "(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place, "
    "count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE place <= 5"
)
def top_orders_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return runs.top_k_with_remainder(orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 5)


@REGISTRY.query(
    "SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, "
    "CAST(row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS INTEGER) AS place, "
    "(SELECT count(*) FROM lineitem) - 15 AS remaining FROM lineitem "
    "ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 15"
)
def top_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")]
    return runs.top_k_with_remainder(lines, [], order, 15)


# --- logs and attempts ------------------------------------------------------


@REGISTRY.query(
    "SELECT o_orderkey AS attempt_id, CAST(len(found) AS INTEGER) AS n, array_to_string(found, '; ') AS lines FROM "
    "(SELECT o_orderkey, CASE o_orderkey % 5 WHEN 1 THEN ['[ERROR] one ' || o_orderkey, 'value x is not a member of Y'] "
    "WHEN 2 THEN list_transform(range(1, 31), lambda i: 'x.scala:' || i || ': error: bad') WHEN 3 THEN ['[ERROR] early ' || o_orderkey] "
    "WHEN 4 THEN ['Not Found: type T' || o_orderkey] ELSE CAST([] AS VARCHAR[]) END AS found FROM orders)"
)
def error_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.extract_error_lines(testkit.build_logs(spark, sf_dir))
    return found.select(
        "attempt_id", F.size("error_lines").alias("n"), F.array_join("error_lines", "; ").alias("lines")
    )


@REGISTRY.query(
    "SELECT o_custkey AS run_id, o_orderkey AS attempt_id, "
    "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS attempt FROM orders"
)
def numbered_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = testkit.build_logs(spark, sf_dir).select("run_id", "attempt_id", "finished_at")
    return runs.number_attempts(results, ["finished_at", "attempt_id"]).drop("finished_at")


@REGISTRY.query(
    "SELECT o_custkey AS run_id, o_orderkey AS attempt_id, o_orderkey % 5 = 0 AS success FROM orders "
    "QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"
)
def deciding_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = testkit.build_logs(spark, sf_dir).select("run_id", "attempt_id", "finished_at", "success")
    return runs.latest_attempt(results, ["finished_at", "attempt_id"]).drop("finished_at")


# --- verdicts ---------------------------------------------------------------

_STATES = "(SELECT o_orderkey AS k, o_orderkey // 3 % 5 AS patches, o_orderkey // 4 % 3 AS risks FROM orders)"


@REGISTRY.query(
    "SELECT k AS run_id, CASE WHEN k % 2 = 0 AND risks > 0 THEN 'human_review' ELSE 'project_scaffold' END AS after_risk, "
    "CASE WHEN k % 3 = 0 THEN 'test_check' WHEN patches >= 3 THEN 'human_review' ELSE 'critique_and_patch' END AS after_compile, "
    f"CASE WHEN k % 7 < 3 THEN 'package_export' ELSE 'human_review' END AS after_test FROM {_STATES}"
)
def gate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.gate_verdict(testkit.run_states(spark, sf_dir)).select(
        "run_id", "after_risk", "after_compile", "after_test"
    )


@REGISTRY.query(
    "SELECT k AS run_id, 'Human review required' || CASE WHEN k % 3 = 1 OR risks > 0 THEN ': ' ELSE '' END || "
    "concat_ws(' · ', CASE WHEN k % 3 = 1 THEN 'Compile failed after ' || patches || ' patch attempt(s)' END, "
    "CASE WHEN risks > 0 THEN risks || ' custom library risk(s) detected' END) AS review_message "
    f"FROM {_STATES}"
)
def review_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.review_reasons(testkit.run_states(spark, sf_dir)).select("run_id", "review_message")


@REGISTRY.query(
    "SELECT c_custkey AS run_id, CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'Git mode selected but repo_url is empty.' "
    "WHEN 2 THEN 'Git mode selected but branch is empty.' "
    "WHEN 3 THEN 'Git mode selected but repo_url is empty.; Git mode selected but branch is empty.' "
    "WHEN 4 THEN CASE WHEN c_nationkey < 12 THEN '' ELSE 'Local mode selected but local_path is empty.' END "
    "ELSE 'No pipeline config provided.' END AS errors FROM customer"
)
def config_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = runs.validate_configs(testkit.configs(spark, sf_dir))
    return checked.select("run_id", F.array_join("errors", "; ").alias("errors"))


# --- stream -----------------------------------------------------------------


@REGISTRY.query(f"SELECT run_id, node_name, status, event_id FROM {_LATEST}")
def streamed_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files, merged batch by batch into a table that is compacted in between."""
    events = table(spark, sf_dir, "events")
    folder = scratch_path(spark, "progress")
    for turn in range(3):
        events.where(F.col("event_id") % 3 == turn).write.mode("append").parquet(f"{folder}/in")
        arriving = stream.read_updates(spark, f"{folder}/in", events.schema)
        updates = arriving.select(
            F.col("user_id").alias("run_id"),
            F.col("event_type").alias("node_name"),
            F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
            "ts",
            "event_id",
        )
        stream.write_progress(updates, _KEYS, _ORDER, f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
        if turn == 1:
            stream.compact_progress(spark, f"{folder}/table", _KEYS, _ORDER)
    return stream.read_progress(spark, f"{folder}/table", _KEYS, _ORDER).drop("ts")
