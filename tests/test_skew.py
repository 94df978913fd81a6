"""One key holds a third of the rows: what keeps it from landing in one task."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from shuffleworks import session
from shuffleworks.operators import deps, jobtable, ordering, runs
from shuffleworks.operators import mapreduce as mr
from tests.checking import difference, duckdb_tables

RANKED = [
    "event_order_per_user",
    "median_gap_per_user",
    "value_spread_per_user",
    "appended_updates",
    "numbered_attempts",
    "failed_nodes",
]


@pytest.fixture
def many_parts(monkeypatch):
    """Parts so small that most groups are ranked in several."""
    monkeypatch.setattr(ordering, "ROWS", 3)


@pytest.fixture(scope="module")
def hot(spark):
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string")))
    return spark.range(0, 3000, 1, 6).select(key.alias("k"), (F.col("id") * 7919 % 1000).alias("v"), F.col("id"))


@pytest.mark.parametrize("name", RANKED)
def test_queries_with_split_groups(spark, sf_dir, many_parts, name):
    assert difference(queries()[name](spark, sf_dir), duckdb_tables(sf_dir), oracle_sql()[name]) is None


def test_a_hot_group_is_ranked_in_parts(hot, plan, monkeypatch):
    monkeypatch.setattr(ordering, "ROWS", 100)
    kept = []
    monkeypatch.setattr(ordering, "durable", lambda df: kept.append(session.durable(df)) or kept[-1])
    ranked = ordering.group_rank(hot, ["k"], ["v", "id"])
    assert "_part" in plan(ranked) and "SinglePartition" not in plan(ranked)
    # 1,000 rows of one group lie in parts of about a hundred each; the other groups are below the bound.
    sizes = [r["count"] for r in kept[1].groupBy(F.spark_partition_id()).count().collect()]
    assert kept[0].count() == 1 and len(sizes) >= 10 and max(sizes) < 250
    places = {r.id: r["rank"] for r in ranked.collect()}
    for key, rows in {k: sorted((r.v, r.id) for r in hot.collect() if r.k == k) for k in ("hot", "k1")}.items():
        assert [places[i] for _, i in rows] == list(range(1, len(rows) + 1)), key


@pytest.mark.parametrize("rows", [1, 40, 5000])
def test_median_by_histograms(spark, monkeypatch, rows):
    monkeypatch.setattr(ordering, "ROWS", rows)
    monkeypatch.setattr(ordering, "BUCKETS", 16)
    edge = (1 << 63) - 1
    data = [("a", v) for v in (5, 5, 5, 7)] + [("b", -edge - 1), ("b", edge)] + [("c", None)] + [(None, i * i % 101 - 50) for i in range(150)]
    data += [("d", edge)] * 60 + [("e", i << 40) for i in range(77)] + [("f", 3)]
    df = spark.createDataFrame(data, "k string, v bigint")
    expected = {}
    for key in {k for k, _ in data}:
        own = sorted(v for k, v in data if k == key and v is not None)
        if own:
            expected[key] = (float(own[(len(own) - 1) // 2]) + float(own[len(own) // 2])) / 2
    assert {r.k: r["median"] for r in ordering.group_median(df, ["k"], "v").collect()} == expected


def test_aggregates_and_top_rows(hot):
    data = hot.collect()
    keys = {r.k for r in data}
    sums = {r.k: r.s for r in mr.pre_aggregate(hot, ["k"], {"s": mr.sum_of(F.col("v"))}, salt=4).collect()}
    assert sums == {k: sum(r.v for r in data if r.k == k) for k in keys}
    top = runs.top_k_with_remainder(hot, ["k"], [F.desc("v"), "id"], 4).collect()
    for key in keys:
        rows = sorted((r for r in data if r.k == key), key=lambda r: (-r.v, r.id))
        got = sorted((r for r in top if r.k == key), key=lambda r: r.place)
        assert [r.id for r in got] == [r.id for r in rows[:4]]
        assert {r.remaining for r in got} == {len(rows) - 4}


def test_a_hot_group_reaches_a_task_as_one_row_per_map_task(spark, hot, plan):
    merged = runs.merge_updates(hot, ["k"], ["v", "id"])
    text = plan(merged)
    assert text.index("partial_max_by") > text.index("Exchange hashpartitioning")
    latest = {r.k: r.id for r in merged.collect()}
    assert latest["hot"] == max(((r.v, r.id) for r in hot.where("k = 'hot'").collect()))[1]


def test_hot_prefix_and_hot_predecessor(spark, hot):
    texts = hot.select(F.concat("k", F.lit(".x")).alias("t"))
    prefixes = hot.select(F.concat("k", F.lit(".")).alias("prefix")).distinct().withColumn("prefix_pos", F.lit(0))
    assert deps.match_prefix(texts, "t", prefixes).count() == 3000
    jobs = hot.select(
        F.concat(F.lit("j"), F.col("id").cast("string")).alias("job_name"), F.when(F.col("id") > 0, F.lit("j0")).alias("chained_after")
    )
    chains, broken = jobtable.resolve_chains(jobs)
    assert chains.where("depth = 1 and root = 'j0'").count() == 2999 and broken.count() == 0
