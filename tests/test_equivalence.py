import datetime as dt
import hashlib
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shuffleworks.functions.hashing import canonical_row
from shuffleworks.operators import equivalence as eq

SCHEMA = "a string, n bigint, d double, t timestamp_ntz"
ROWS = [
    ("x", 1, 1.5, dt.datetime(2024, 1, 1)),
    ("x", 1, 1.5, dt.datetime(2024, 1, 1)),
    (None, None, None, None),
    ("", 0, -0.0, dt.datetime(1969, 12, 31, 23, 59, 59, 999999)),
    ("a|b\\", 5, float("nan"), None),
    ("big", -1, -2.5e17, None),
]


def sums(df, **kw):
    return tuple(eq.checksum(df, **kw).first())


def test_checksum_recipe(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    texts = [
        "x|1|1500000|1704067200000000",
        "x|1|1500000|1704067200000000",
        "\\N|\\N|\\N|\\N",
        "|0|0|-1",
        "a\\pb\\\\|5|NaN|\\N",
        "big|-1|-250000000000000000.000000|\\N",
    ]
    total = sum(int(hashlib.md5(t.encode()).hexdigest()[:16], 16) for t in texts)
    assert sums(df, scale=6) == (6, total)


VALUE = st.one_of(st.none(), st.sampled_from([0.0, -0.0, 1e-7, 3e-9, 2e-7, float("nan"), 1.5]))
ROW = st.tuples(st.one_of(st.none(), st.sampled_from(["", "a", "b"])), st.one_of(st.none(), st.sampled_from(["", "a"])), VALUE)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(ROW, min_size=1, max_size=5), st.lists(ROW, max_size=2))
def test_passed_says_that_no_row_differs(spark, data, other):
    schema = "a string, b string, d double"
    left, right = spark.createDataFrame(data, schema), spark.createDataFrame([*data[len(other) :], *other], schema)
    for by_hash in (True, False):
        assert eq.compare(left, right).first().passed == (eq.diff_rows(left, right, by_hash=by_hash).count() == 0)
    assert not eq.compare(left, left.union(left)).first().passed


def test_values_of_unequal_types_and_maps(spark):
    left = spark.sql("select cast(1.5 as decimal(10,2)) p, map('a', 1, 'b', 2) m, cast(null as array<int>) l")
    right = spark.sql("select cast(1.5 as decimal(12,4)) p, map('b', 2, 'a', 1) m, cast(null as array<int>) l")
    assert eq.compare(left, right).first().passed and eq.diff_rows(left, right).count() == 0
    assert eq.checksum(left).first() == eq.checksum(right).first()
    other = right.selectExpr("p", "m", "array() as l")
    assert not eq.compare(left, other).first().passed and eq.diff_rows(left, other).count() == 2


ZEROS = "array(0.0D, 1e-9D) a, named_struct('m', map('k', 0.0D, 'l', 1D), 's', 'x|y') s, map('p', array(0.0D)) m"


@pytest.mark.parametrize(
    ("other", "same", "with_scale"),
    [
        (ZEROS, True, True),
        (ZEROS.replace("array(0.0D, ", "array(-0.0D, "), True, True),
        (ZEROS.replace("map('k', 0.0D, 'l', 1D)", "map('l', 1D, 'k', -0.0D)"), True, True),
        (ZEROS.replace("array(0.0D))", "array(-0.0D))"), True, True),
        (ZEROS.replace("1e-9D", "2e-9D"), False, True),
        (ZEROS.replace("1e-9D", "2e-3D"), False, False),
        (ZEROS.replace("'x|y'", "'x', 'y'").replace("'s', 'x', 'y'", "'s', 'x|y '"), False, False),
        (ZEROS.replace("array(0.0D, 1e-9D)", "array(0.0D, 1e-9D, null)"), False, False),
        (ZEROS.replace("named_struct('m', map('k', 0.0D, 'l', 1D), 's', 'x|y')", "cast(null as struct<m:map<string,double>,s:string>)"), False, False),
    ],
)
def test_nested_values(spark, other, same, with_scale):
    left, right = spark.sql(f"select {ZEROS}"), spark.sql(f"select {other}")
    assert eq.compare(left, right).first().passed == same == (eq.diff_rows(left, right).count() == 0)
    assert eq.compare(left, right, scale=6).first().passed == with_scale


NESTED = st.lists(st.one_of(st.none(), st.tuples(st.one_of(st.none(), st.lists(VALUE, max_size=2)), st.dictionaries(st.sampled_from("ab"), VALUE, max_size=2))), min_size=1, max_size=4)


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(NESTED, NESTED)
def test_passed_says_that_no_nested_row_differs(spark, data, other):
    schema = "v struct<l:array<double>,m:map<string,double>>"
    left, right = (spark.createDataFrame([(r,) for r in rows], schema) for rows in (data, [*data[1:], *other[:1]]))
    assert eq.compare(left, right).first().passed == (eq.diff_rows(left, right).count() == 0)
    assert eq.compare(left, left.repartition(2)).first().passed


def test_equal_rows_are_not_shuffled(spark, plan):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.range(20_000).selectExpr("id", "concat('text ', id) as t")
        right = left.selectExpr("id", "if(id % 1000 = 7, concat(t, '!'), t) as t").union(left.where("id = 11"))
        signed = left.selectExpr("*", "1 as _sign").union(right.selectExpr("*", "-1 as _sign"))
        signed = signed.selectExpr("*", "xxhash64(id, t) as _h1", "xxhash64(1, id, t) as _h2")
        # 20 changed rows of either side, and the three rows of the one that is there once more.
        assert eq.suspect_rows(signed).count() == 43
        found = eq.diff_rows(left, right)
        assert "SortMergeJoin" not in plan(found) and "ShuffledHashJoin" not in plan(found)
        assert found.count() == 41
        assert eq.diff_rows(left, left.repartition(3)).count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_texts_are_worked_out_twice_not_per_pass(spark):
    """Once for the hashes and once for the rows to be told apart; the ranges and the suspects read the hashes."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(number):
        seen.add(1)
        return f"text {number}"

    left = spark.range(1000).select("id", text("id").alias("t"))
    right = spark.range(1000).selectExpr("id", "if(id % 100 = 7, 'other', 'text ' || id) as t")
    found = eq.diff_rows(left, right).collect()
    assert sorted((r.id, r.side) for r in found) == sorted((i, s) for i in range(7, 1000, 100) for s in ("left", "right"))
    assert seen.value <= 2000


def test_text_of_nested_values(spark):
    value = (["a|b", None, "\\"], {"z": [1.5], "a": []})
    df = spark.createDataFrame([(value,), (None,)], "s struct<l:array<string>,m:map<string,array<double>>>")
    texts = {r[0] for r in df.select(canonical_row(df)).collect()}
    assert texts == {"14:4:a\\pb2:\\N2:\\\\15:1:a0:1:z5:3:1.5", "\\N"}


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.one_of(st.none(), st.text(alphabet="ab|\\N", max_size=3)), st.one_of(st.none(), st.integers(-5, 5))), min_size=1, max_size=20))
def test_order_does_not_matter_but_repeats_do(spark, data):
    df = spark.createDataFrame(data, "a string, n int")
    mixed = spark.createDataFrame(random.sample(data, len(data)), "a string, n int").repartition(3)
    assert sums(df) == sums(mixed)
    assert eq.compare(df, mixed).first().passed
    more = spark.createDataFrame(data + data[:1], "a string, n int")
    result = eq.compare(df, more).first()
    assert not result.passed and not result.checksum_match


def test_null_and_separator_are_told_apart(spark):
    pairs = [("a|", "b"), ("a", "|b")], [("", "x"), (None, "x")], [("\\N", "x"), (None, "x")]
    for left, right in pairs:
        one, two = (spark.createDataFrame([r], "a string, b string") for r in (left, right))
        assert not eq.compare(one, two).first().passed


def test_compare_reports(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, s string")
    same = eq.compare(a, a.select("s", "k")).first()
    assert tuple(same) == (True, 2, 2, True, "rows equal: 2 vs 2; checksums equal")
    b = spark.createDataFrame([(1, "x"), (2, "z")], "k int, s string")
    assert tuple(eq.compare(a, b).first()) == (False, 2, 2, False, "rows equal: 2 vs 2; checksums differ")
    assert eq.compare(a, b, columns=["k"]).first().passed
    empty = a.where("false")
    assert tuple(eq.compare(empty, empty).first())[:4] == (True, 0, 0, True)
    assert tuple(eq.row_counts(a, empty).first()) == (2, 0)
    with pytest.raises(ValueError, match="columns differ"):
        eq.compare(a, a.withColumnRenamed("s", "z"))


@pytest.mark.parametrize("by_hash", [True, False])
def test_diff_rows_counts_both_ways(spark, by_hash):
    a = spark.createDataFrame([(1, None), (1, None), (2, "y"), (3, "z")], "k int, s string")
    b = spark.createDataFrame([(1, None), (2, "y"), (2, "y"), (4, "w")], "k int, s string")
    found = sorted(((r.k, r.s, r.side, r.times) for r in eq.diff_rows(a, b, by_hash=by_hash).collect()), key=repr)
    assert found == sorted([(1, None, "left", 1), (2, "y", "right", 1), (3, "z", "left", 1), (4, "w", "right", 1)], key=repr)
    assert eq.diff_rows(a, a.repartition(2), by_hash=by_hash).count() == 0


def test_only_partial_sums_are_shuffled(spark, plan):
    a = spark.range(10).selectExpr("id", "cast(id as string) s")
    text = plan(eq.compare(a, a))
    assert text.count("Exchange") == 1 and "partial_sum" in text
