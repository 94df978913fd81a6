"""Runs and their logs: latest state, progress, summaries, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shuffleworks.constants import (
    ERROR_LINE,
    KEPT_SUFFIX,
    MAX_PATCH_RETRIES,
    NO_BRANCH_ERROR,
    NO_CONFIG_ERROR,
    NO_LOCAL_PATH_ERROR,
    NO_REPO_URL_ERROR,
    PENDING,
    REVIEW_TEXT,
    RUN_NODES,
)
from shuffleworks.functions.text import strip_blanks
from shuffleworks.operators.ordering import group_rank, null_free_keys

# --- merging ----------------------------------------------------------------


def merge_updates(updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key by ``order`` (last writer wins); same columns as ``updates``.

    ``max_by`` keeps one row per key and map task, so a hot key sends no more
    rows than there are map tasks. ``order`` must be unique within a key.
    """
    rest = [c for c in updates.columns if c not in keys]
    latest = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return latest.select(*[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in updates.columns])


def append_lists(
    updates: DataFrame, keys: list[str], order: list[str], out: str = "pos"
) -> DataFrame:
    """Lists of several writers as one list per key: each row gets its 0-based place ``pos``.

    Repeats are kept. The list stays rows, since a list of a hot key would not
    fit into one.
    """
    ranked = group_rank(updates, keys, order, "_rank")
    return ranked.withColumn(out, F.col("_rank") - 1).drop("_rank")


# --- progress ---------------------------------------------------------------


def progress_snapshot(
    progress: DataFrame, nodes: list[str] | None = None, run: str = "run_id", node: str = "node_name"
) -> DataFrame:
    """Every node of the list for every run: ``run, node, status``; missing ones are pending.

    ``progress`` has one row per run and node (see ``merge_updates``); two states
    of one node are an error. The map that is built per run holds listed nodes
    only, each state once. One shuffle, no cross join.
    """
    names = nodes or RUN_NODES
    entry = F.when(F.col(node).isin(names), F.struct(F.col(node), F.col("status")))
    known = progress.groupBy(run).agg(F.map_from_entries(F.collect_set(entry)).alias("_known"))
    listed = known.select(run, "_known", F.explode(F.array(*[F.lit(n) for n in names])).alias(node))
    return listed.select(
        run, node, F.coalesce(F.try_element_at("_known", F.col(node)), F.lit(PENDING)).alias("status")
    )


def failed_nodes(
    progress: DataFrame, run: str = "run_id", node: str = "node_name"
) -> DataFrame:
    """The failed nodes of each run with their error, by name: ``run, place, node, error``.

    Rows, not a list: a run may have any number of nodes.
    """
    failed = progress.where(F.col("status") == "failed").select(run, node, "error")
    return group_rank(failed, [run], [node], "place")


def run_summary(
    progress: DataFrame, jobs: DataFrame, files: DataFrame, reviews: DataFrame | None = None, run: str = "run_id"
) -> DataFrame:
    """Per run ``total_nodes, success, failed, jobs, scala_files, human_review``.

    The four inputs are reduced to one row per run before they meet.
    """
    nodes = progress.groupBy(run).agg(
        F.count(F.lit(1)).alias("total_nodes"),
        F.count_if(F.col("status") == "success").alias("success"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )
    job_counts = jobs.groupBy(run).agg(F.count(F.lit(1)).alias("jobs"))
    file_counts = files.groupBy(run).agg(F.count_if(F.col("path").endswith(KEPT_SUFFIX)).alias("scala_files"))
    joined = nodes.join(job_counts, run, "left").join(file_counts, run, "left")
    if reviews is None:
        joined = joined.withColumn("_review", F.lit(False))
    else:
        flags = reviews.groupBy(run).agg(F.bool_or("human_review_required").alias("_review"))
        joined = joined.join(flags, run, "left")
    zero = F.lit(0).cast("bigint")
    return joined.select(
        run,
        "total_nodes",
        "success",
        "failed",
        F.coalesce("jobs", zero).alias("jobs"),
        F.coalesce("scala_files", zero).alias("scala_files"),
        F.coalesce("_review", F.lit(False)).alias("human_review"),
    )


def top_k_with_remainder(df: DataFrame, group: list[str], order: list[Column | str], k: int) -> DataFrame:
    """The first k rows per group with ``place`` and ``remaining`` (how many more there are).

    Spark cuts each map task's share to k rows per group before the shuffle. The
    totals are counted apart and meet the k rows on the same partitioning. With
    no group columns the report is over the whole frame.
    """
    ordering = [F.col(o) if isinstance(o, str) else o for o in order]
    if not group:
        top = df.orderBy(*ordering).limit(k)
        placed = top.withColumn("place", F.row_number().over(Window.orderBy(*ordering)))  # k rows
        total = df.agg(F.count(F.lit(1))).scalar()
        return placed.withColumn("remaining", F.greatest(total - k, F.lit(0)))
    # Null keys are spelled out as plain columns, so that the window, the count
    # and the join all use one partitioning of the rows.
    keys = [f"_k{i}" for i in range(2 * len(group))]
    parts = null_free_keys(df, group)
    keyed = df.select("*", *[p.alias(k) for p, k in zip(parts, keys)])
    window = Window.partitionBy(*keys).orderBy(*ordering)
    top = keyed.withColumn("place", F.row_number().over(window)).where(F.col("place") <= k)
    totals = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    return top.join(totals, keys).select(
        *df.columns, "place", F.greatest(F.col("_total") - k, F.lit(0)).alias("remaining")
    )


# --- logs and attempts ------------------------------------------------------


def error_lines(stdout: Column, stderr: Column, tail_chars: int | None = None, max_lines: int | None = None) -> Column:
    """Error lines of a build log, trimmed, in order: all of them.

    Only on request is the log cut to its last ``tail_chars`` characters first,
    and the result to its first ``max_lines`` lines; ``constants.LOG_TAIL_CHARS``
    and ``constants.MAX_ERROR_LINES`` are what fits into a prompt.
    """

    def tail(log: Column) -> Column:
        whole = F.coalesce(log, F.lit(""))
        return whole if tail_chars is None else F.right(whole, F.lit(tail_chars))

    text = F.when(tail(stderr) != "", tail(stderr)).otherwise(tail(stdout))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(ERROR_LINE))
    found = F.transform(lines, strip_blanks)
    return found if max_lines is None else F.slice(found, 1, max_lines)


def extract_error_lines(
    logs: DataFrame, out: str = "error_lines", tail_chars: int | None = None, max_lines: int | None = None
) -> DataFrame:
    return logs.withColumn(out, error_lines(F.col("stdout"), F.col("stderr"), tail_chars, max_lines))


def number_attempts(
    results: DataFrame, order: list[str], run: str = "run_id", out: str = "attempt"
) -> DataFrame:
    """Attempts numbered from 1 per run."""
    return group_rank(results, [run], order, out)


def latest_attempt(results: DataFrame, order: list[str], run: str = "run_id") -> DataFrame:
    """The attempt that decides: the last per run."""
    return merge_updates(results, [run], order)


# --- verdicts ---------------------------------------------------------------


def gate_verdict(runs: DataFrame, max_retries: int = MAX_PATCH_RETRIES) -> DataFrame:
    """Next step after each gate: ``after_risk, after_compile, after_test`` next to the run columns.

    Reads ``risk_action, risk_count, last_success, patch_attempts, test_passed``.
    A run without a compile or test result counts as not passed.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    blocked = F.coalesce(F.col("risk_action") == "block", F.lit(False)) & (number("risk_count") > 0)
    return runs.select(
        "*",
        F.when(blocked, "human_review").otherwise("project_scaffold").alias("after_risk"),
        F.when(yes("last_success"), "test_check")
        .when(number("patch_attempts") >= max_retries, "human_review")
        .otherwise("critique_and_patch")
        .alias("after_compile"),
        F.when(yes("test_passed"), "package_export").otherwise("human_review").alias("after_test"),
    )


def review_reasons(runs: DataFrame, out: str = "review_message") -> DataFrame:
    """Why a run goes to review, from ``last_success, patch_attempts, risk_count``."""
    attempts = F.coalesce("patch_attempts", F.lit(0)).cast("string")
    risks = F.coalesce("risk_count", F.lit(0))
    reasons = F.array_compact(
        F.array(
            F.when(
                F.col("last_success") == F.lit(False),
                F.concat(F.lit("Compile failed after "), attempts, F.lit(" patch attempt(s)")),
            ),
            F.when(risks > 0, F.concat(risks.cast("string"), F.lit(" custom library risk(s) detected"))),
        )
    )
    message = F.when(
        F.size(reasons) > 0, F.concat(F.lit(REVIEW_TEXT + ": "), F.array_join(reasons, " · "))
    ).otherwise(REVIEW_TEXT)
    return runs.withColumn(out, message)


def config_errors(mode: Column, repo_url: Column, branch: Column, local_path: Column) -> Column:
    """All messages for one configuration; a null ``mode`` means there is no configuration."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    git = mode == "git"
    return F.when(mode.isNull(), F.array(F.lit(NO_CONFIG_ERROR))).otherwise(
        F.array_compact(
            F.array(
                F.when(git & empty(repo_url), NO_REPO_URL_ERROR),
                F.when(git & empty(branch), NO_BRANCH_ERROR),
                F.when(~git & empty(local_path), NO_LOCAL_PATH_ERROR),
            )
        )
    )


def validate_configs(configs: DataFrame, out: str = "errors") -> DataFrame:
    """Configurations with the array of their errors; empty when valid."""
    return configs.withColumn(
        out, config_errors(F.col("mode"), F.col("repo_url"), F.col("branch"), F.col("local_path"))
    )
