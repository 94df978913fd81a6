import random

import pandas as pd
from unittest import mock

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shuffleworks.operators import mapreduce as mr
from shuffleworks.operators import ordering
from shuffleworks.operators.ordering import global_rank, group_rank, secondary_sort, total_order
from shuffleworks.plans.chain import Job, run_chain

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def tokens_of(spark, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return sorted(r[0] for r in mr.tokenize(df, "text").collect())


def test_tokens_end_at_five_characters_only(spark):
    assert tokens_of(spark, "a b\tc\nd\re\ff") == ["a", "b", "c", "d", "e", "f"]
    # Vertical tab and no-break space are not delimiters; the letter f is not one either.
    assert tokens_of(spark, "a\x0bb c d fff") == ["a\x0bb", "c d", "fff"]


def test_no_empty_tokens_and_case_kept(spark):
    assert tokens_of(spark, "  lead", "trail \n", "", "   ", None, "Ab aB") == ["Ab", "aB", "lead", "trail"]


def test_tokenize_keeps_columns(spark):
    df = spark.createDataFrame([(1, "x y"), (2, "")], "id int, text string")
    assert mr.tokenize(df, "text", out="w", keep=("id",)).collect() == [(1, "x"), (1, "y")]


def test_partial_aggregate_before_the_exchange(spark, plan):
    df = mr.emit(mr.tokenize(spark.createDataFrame([("a",)], "text string"), "text"), "token", F.lit(1))
    text = plan(mr.reduce_by_key(df, ["key"], {"n": mr.sum_of(F.col("value"))}))
    assert text.index("partial_sum") > text.index("Exchange hashpartitioning")


def test_int_sum_wraps_at_32_bits(spark):
    df = spark.createDataFrame([("a", 2**31 - 1), ("a", 1), ("b", -(2**31)), ("b", -1), ("c", 5), ("d", None)], "k string, v int")
    wrapped = mr.reduce_by_key(df, ["k"], {"v": mr.int_sum_wrapping(F.col("v"))})
    assert {r.k: r.v for r in wrapped.collect()} == {"a": -(2**31), "b": 2**31 - 1, "c": 5, "d": None}


def _java_sum(values):
    return (sum(values) + 2**31) % 2**32 - 2**31


@SLOW
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-(2**31), 2**31 - 1)), min_size=1, max_size=60), st.integers(1, 9))
def test_salted_equals_plain_for_any_salt(spark, data, salt):
    df = spark.createDataFrame(data, "k int, v int").repartition(5)
    aggs = {
        "w": mr.int_sum_wrapping(F.col("v")),
        "n": mr.count_of(),
        "lo": mr.min_of(F.col("v")),
        "hi": mr.max_of(F.col("v")),
        "m": mr.mean_of(F.col("v").cast("bigint")),
    }
    salted = {r.k: tuple(r) for r in mr.pre_aggregate(df, ["k"], aggs, salt).collect()}
    assert salted == {r.k: tuple(r) for r in mr.reduce_by_key(df, ["k"], aggs).collect()}
    for key, row in salted.items():
        assert row[1] == _java_sum([v for k, v in data if k == key])


def test_pre_aggregate_refuses_other_aggregates(spark):
    df = spark.createDataFrame([(1, 2)], "k int, v int")
    with pytest.raises(TypeError, match="associative"):
        mr.pre_aggregate(df, ["k"], {"v": F.collect_list("v")})


def test_rdd_reduce_equals_dataframe_reduce(spark, rows):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), (None, 4)], "key string, value int")
    assert rows(mr.reduce_by_key_rdd(df, "key", "value", lambda a, b: a + b)) == rows(
        mr.reduce_by_key(df, ["key"], {"value": F.sum("value").cast("int")})
    )


def test_rdd_reduce_in_small_steps_and_on_struct_keys(spark, rows, monkeypatch):
    monkeypatch.setattr(mr, "_HELD_KEYS", 3)
    df = spark.range(500).select((F.col("id") % 37).alias("k"), F.col("id").alias("v"))
    expected = rows(mr.reduce_by_key(df, ["k"], {"v": F.max("v")}))
    assert rows(mr.reduce_by_key_rdd(df, "k", "v", max)) == expected
    keyed = df.select(F.struct("k").alias("s"), "v")
    assert {(r.key.k, r.value) for r in mr.reduce_by_key_rdd(keyed, "s", "v", max).collect()} == set(expected)
    assert mr.reduce_by_key_rdd(df.where("false"), "k", "v", max).count() == 0


def test_rdd_reduce_holds_no_more_than_a_key(spark, monkeypatch):
    """The memory of the reducing worker, as ``op`` sees it, does not grow with the keys."""
    monkeypatch.setattr(mr, "_HELD_KEYS", 1000)
    keys = 60_000
    number = F.floor(F.col("id") / 20_000) * 10_000 + F.col("id") % 10_000  # twice in two batches that follow each other
    wide = F.concat(number.cast("string"), F.repeat(F.lit("x"), 2000))
    df = spark.range(0, 2 * keys, 1, 1).select(wide.alias("k"), F.lit(0).cast("long").alias("v"))

    def resident(a, b):
        with open("/proc/self/statm") as file:
            return int(file.read().split()[1]) * 4096

    seen = mr.reduce_by_key_rdd(df, "k", "v", resident).agg(F.count("key"), F.min("value"), F.max("value")).first()
    assert seen[0] == keys and 0 < seen[1] and seen[2] - seen[1] < 40_000_000


def test_rdd_reduce_of_nested_values_and_odd_keys(spark, rows):
    pairs = spark.createDataFrame([("a", (1, [1])), (None, (2, [])), ("a", (3, None)), (None, (5, [7])), ("", (4, [4]))], "k string, v struct<n:int,l:array<int>>")
    largest = mr.reduce_by_key_rdd(pairs.repartition(3), "k", "v", lambda a, b: a if a.n > b.n else b)
    assert rows(largest.select("key", "value.n", "value.l")) == rows(spark.createDataFrame([("a", 3, None), (None, 5, [7]), ("", 4, [4])], "k string, n int, l array<int>"))
    zeros = spark.createDataFrame([(0.0, 1), (-0.0, 2), (1.5, 4), (0.0, 8)], "k double, v int").repartition(4)
    assert rows(mr.reduce_by_key_rdd(zeros, "k", "v", lambda a, b: a + b).select(F.abs("key"), "value")) == [(0.0, 11), (1.5, 4)]
    cased = spark.createDataFrame([(c,) for c in "aAaAbaA"], "c string").select(F.collate("c", "UTF8_LCASE").alias("k"), F.lit(1).alias("v"))
    assert rows(mr.reduce_by_key_rdd(cased, "k", "v", lambda a, b: a + b)) == [("A", 3), ("a", 3), ("b", 1)]


def _range(pdf):
    return pd.DataFrame({"k": [pdf["k"].iloc[0]], "lo": [pdf["v"].min()], "hi": [pdf["v"].max()]})


def _merge(pdf):
    return pd.DataFrame({"k": [pdf["k"].iloc[0]], "lo": [pdf["lo"].min()], "hi": [pdf["hi"].max()]})


def test_reduce_groups_splits_hot_groups(spark, rows):
    # A third of the rows has one key.
    df = spark.range(300).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    schema = "k bigint, lo bigint, hi bigint"
    plain = mr.reduce_groups(df, ["k"], _range, schema)
    split = mr.reduce_groups(df.repartition(4), ["k"], _range, schema, _range, schema, _merge)
    assert rows(split) == rows(plain)
    with pytest.raises(ValueError, match="together"):
        mr.reduce_groups(df, ["k"], _range, schema, _range)


def _total(key, rows):
    yield *key, sum(r[1] for r in rows)


def test_combiner_runs_before_the_one_shuffle(spark, rows, plan):
    df = spark.range(300).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")).repartition(4)
    df = spark.createDataFrame(df.rdd, df.schema)  # the rows as they lie, without the exchange that dealt them
    plain = mr.reduce_runs(df, ["k"], _total, "k bigint, t bigint")
    combined = mr.reduce_runs(df, ["k"], _total, "k bigint, t bigint", _total, "k bigint, t bigint")
    text = plan(combined)
    assert rows(plain) == rows(combined) == rows(df.groupBy("k").agg(F.sum("v").alias("t")))
    assert text.count("Exchange") == 1
    above, below = text.split("Exchange")
    assert "MapInArrow" in above and "MapInArrow" in below and "Sort" in below
    merged = mr.reduce_groups(df, ["k"], _range, "k bigint, lo bigint, hi bigint", _range, "k bigint, lo bigint, hi bigint", _merge)
    assert plan(merged).count("Exchange") == 1 and "MapInPandas" in plan(merged).split("Exchange")[1]
    with pytest.raises(ValueError, match="together"):
        mr.reduce_runs(df, ["k"], _total, "k bigint, t bigint", combine=_total)


def test_rows_come_in_order_and_need_not_be_read(spark, rows):
    df = spark.createDataFrame([("a", 3), ("b", 1), ("a", 1), (None, 9), (None, 8), ("a", 2)], "k string, v int")
    lists = mr.reduce_runs(df, ["k"], lambda key, own: [(*key, [r[1] for r in own])], "k string, l array<int>", order=("v",))
    assert rows(lists) == [("a", [1, 2, 3]), ("b", [1]), (None, [8, 9])]
    first = mr.reduce_runs(df, ["k"], lambda key, own: [(*key, next(own)[1])], "k string, v int", order=("v",))
    assert rows(first) == [("a", 1), ("b", 1), (None, 8)]
    assert mr.reduce_runs(df, ["k"], lambda key, own: [], "k string").count() == 0


def test_floating_keys_group_as_in_spark(spark):
    df = spark.createDataFrame([(0.0, 1), (-0.0, 2), (float("nan"), 3), (float("nan"), 4), (None, 5)], "k double, v int")
    out = mr.reduce_runs(df, ["k"], _total, "k double, t bigint", _total, "k double, t bigint")
    assert sorted(r.t for r in out.collect()) == sorted(r.t for r in df.groupBy("k").agg(F.sum("v").alias("t")).collect()) == [3, 5, 7]


def test_group_larger_than_the_memory_of_a_worker(spark):
    def measured(key, own):
        import resource

        before, n, size = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, 0, 0
        for row in own:
            n, size = n + 1, size + len(row[1])
        yield *key, n, size >> 20, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10

    # One key holds 400 MB of text.
    df = spark.range(400_000).select(F.lit(1).alias("k"), F.repeat(F.lit("x"), 1024).alias("t"))
    (row,) = mr.reduce_runs(df, ["k"], measured, "k int, n bigint, mb bigint, grown bigint").collect()
    assert (row.n, row.mb) == (400_000, 390) and row.grown < 150


def test_map_only_has_no_exchange(spark, plan):
    df = spark.range(10).select(F.col("id"), F.lit("x").alias("s"))
    out = mr.map_only(df, ["id"], F.col("id") > 7)
    assert [r[0] for r in out.collect()] == [8, 9]
    assert "Exchange" not in plan(out)


def test_partitioner_puts_a_key_in_one_partition(spark):
    df = spark.range(100).select((F.col("id") % 10).alias("k"))
    by_expr = mr.partition_by(df, 4, partition_expr=F.col("k") % 4)
    placed = by_expr.select("k", F.spark_partition_id().alias("p")).distinct().collect()
    assert sorted((r.k, r.p) for r in placed) == [(k, k % 4) for k in range(10)]
    by_hash = mr.partition_by(df, 4, key="k").select("k", F.spark_partition_id().alias("p")).distinct()
    assert by_hash.count() == 10
    with pytest.raises(ValueError):
        mr.partition_by(df, 4)


def test_multi_input_keeps_keys_of_every_side(spark, rows):
    stock = spark.createDataFrame([(1, 5), (2, 7), (2, 1)], "k int, a int")
    sold = spark.createDataFrame([(2, 10), (3, 20)], "k int, b int")
    both = mr.multi_input_aggregate({"s": stock, "t": sold}, ["k"], {"s": {"a": F.col("a")}, "t": {"b": F.col("b")}})
    assert rows(both) == [(1, 5, 0), (2, 8, 10), (3, 0, 20)]


def test_composite_key_order_is_field_by_field(spark):
    df = spark.createDataFrame([("b", 1), ("a", 10), ("a", 9), ("Z", 3)], "g string, t int")
    keyed = mr.with_composite_key(df, ["g", "t"]).orderBy("key")
    assert [(r.g, r.t) for r in keyed.collect()] == [("Z", 3), ("a", 9), ("a", 10), ("b", 1)]
    assert [(r.g, r.t) for r in total_order(df, ["g", "t"]).collect()] == [("Z", 3), ("a", 9), ("a", 10), ("b", 1)]


@pytest.mark.parametrize("whole", [False, True])
def test_secondary_sort_orders_rows_inside_groups(spark, whole):
    data = [(random.randint(0, 4), i) for i in range(200)]
    random.shuffle(data)
    df = spark.createDataFrame(data, "g int, t int")
    seen = {}
    for g, t in secondary_sort(df, ["g"], ["t"], whole_groups=whole).collect():
        assert seen.get(g, -1) < t
        seen[g] = t


@SLOW
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 3)), st.integers(0, 9)), max_size=50), st.integers(1, 60))
def test_ranks_of_split_and_whole_groups_agree(spark, data, parts):
    df = spark.createDataFrame([(g, t, i) for i, (g, t) in enumerate(data)], "g int, t int, i int")
    with mock.patch.object(ordering, "ROWS", parts):
        got = {r.i: r["rank"] for r in group_rank(df, ["g"], ["t", "i"]).collect()}
    expected = {}
    for key in {g for g, _ in data}:
        places = sorted((t, i) for i, (g, t) in enumerate(data) if g == key)
        expected.update({i: place for place, (_, i) in enumerate(places, 1)})
    assert got == expected


def test_global_rank_counts_over_partitions(spark):
    df = spark.range(1000).select((999 - F.col("id")).alias("v")).repartition(7)
    assert all(r["rank"] == r.v + 1 for r in global_rank(df, ["v"]).collect())
    assert global_rank(df.where("v < 0"), ["v"]).count() == 0


def test_chain_composes_and_rejects_bad_graphs(spark):
    src = spark.range(4)
    jobs = [
        Job("c", lambda d: d.where("x > 2"), chained_after="b"),
        Job("b", lambda d: d.select((F.col("id") * 2).alias("x")), chained_after="a"),
        Job("a", lambda d: d.where("id > 0"), source=src),
        Job("d", lambda d: d.agg(F.sum("x").alias("s")), chained_after="b"),
    ]
    out = run_chain(jobs)
    assert [r.x for r in out["c"].collect()] == [4, 6]
    assert out["d"].first().s == 12
    with pytest.raises(ValueError, match="unknown predecessor"):
        run_chain([Job("a", lambda d: d, chained_after="zz")])
    with pytest.raises(ValueError, match="cycle"):
        run_chain([Job("a", lambda d: d, chained_after="b"), Job("b", lambda d: d, chained_after="a")])
    with pytest.raises(ValueError, match="same name"):
        run_chain([Job("a", lambda d: d, source=src), Job("a", lambda d: d, source=src)])
    with pytest.raises(ValueError, match="neither source"):
        run_chain([Job("a", lambda d: d)])


def test_linear_chain_adds_no_materialisation(spark, plan):
    out = run_chain(
        [
            Job("a", lambda d: d.where("id > 0"), source=spark.range(4)),
            Job("b", lambda d: d.select((F.col("id") + 1).alias("x")), chained_after="a"),
        ]
    )
    assert "ExistingRDD" not in plan(out["b"])
