"""Registered queries: map, combine, partition, sort and reduce; formats; equivalence."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shuffleworks import testkit
from shuffleworks.functions.timing import epoch_micros
from shuffleworks.operators import equivalence as eq
from shuffleworks.operators import mapreduce as mr
from shuffleworks.operators.ordering import global_rank, group_median, group_rank
from shuffleworks.plans.chain import Job, run_chain
from shuffleworks.plans.registry import Registry
from shuffleworks.session import durable, scratch_path
from shuffleworks.sources import formats
from shuffleworks.testkit import table

REGISTRY = Registry()


_TOKENS = r"""(SELECT doc_id, unnest(string_split_regex(text, '[ \t\n\r\f]+')) AS token FROM documents) WHERE token <> ''"""
_WORD_COUNT = f"SELECT token AS key, count(*) AS value FROM {_TOKENS} GROUP BY token"


def _ones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mr.emit(mr.tokenize(table(spark, sf_dir, "documents", "text"), "text"), "token", F.lit(1).cast("bigint"))


# --- map --------------------------------------------------------------------


@REGISTRY.query(
    "SELECT l_orderkey, l_linenumber, "
    "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(5,2))) AS DOUBLE) AS charge "
    "FROM lineitem"
)
def line_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    rate = 1 - F.col("l_discount").cast("decimal(5,2)")
    return mr.map_rows(
        table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", (price * rate).cast("double").alias("charge")
    )


@REGISTRY.query(
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, upper(event_type) AS kind FROM events"
)
def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.get_json_object("props", "$.k").cast("bigint").alias("k")
    return mr.map_rows(table(spark, sf_dir, "events"), "event_id", number, F.upper("event_type").alias("kind"))


@REGISTRY.query(
    "SELECT event_id, event_type || ':' || CAST(json_extract(props, '$.k') AS VARCHAR) AS code, "
    "CAST(length(event_type || ':' || CAST(json_extract(props, '$.k') AS VARCHAR)) AS BIGINT) AS width FROM events"
)
def event_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User code on whole batches: a parser that takes any JSON value under the key."""

    def parse(batches):
        for batch in batches:
            values = [json.loads(p).get("k") for p in batch["props"]]
            codes = batch["event_type"] + ":" + pd.Series([json.dumps(v) for v in values], index=batch.index)
            yield pd.DataFrame({"event_id": batch["event_id"], "code": codes, "width": codes.str.len().astype("int64")})

    events = table(spark, sf_dir, "events").select("event_id", "props", "event_type")
    return mr.map_batches(events, parse, "event_id bigint, code string, width bigint")


@REGISTRY.query(
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem "
    "WHERE l_quantity < 10 AND l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '1998-01-01'"
)
def small_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = (
        (F.col("l_quantity") < 10)
        & (F.col("l_returnflag") == "R")
        & (F.col("l_shipdate") >= F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"))
    )
    return mr.map_only(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_quantity"], keep)


@REGISTRY.query(f"SELECT doc_id, count(*) AS tokens, count(DISTINCT token) AS words FROM {_TOKENS} GROUP BY doc_id")
def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = mr.tokenize(table(spark, sf_dir, "documents", "doc_id", "text"), "text", keep=("doc_id",))
    per_word = mr.reduce_by_key(tokens, ["doc_id", "token"], {"n": F.count(F.lit(1))})
    return mr.reduce_by_key(per_word, ["doc_id"], {"tokens": F.sum("n"), "words": F.count(F.lit(1))})


# --- combine and reduce -----------------------------------------------------


@REGISTRY.query(_WORD_COUNT)
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mr.reduce_by_key(_ones(spark, sf_dir), ["key"], {"value": mr.sum_of(F.col("value"))})


@REGISTRY.query(_WORD_COUNT)
def word_count_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mr.pre_aggregate(_ones(spark, sf_dir), ["key"], {"value": mr.sum_of(F.col("value"))})


@REGISTRY.query(_WORD_COUNT)
def word_count_rdd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mr.reduce_by_key_rdd(_ones(spark, sf_dir), "key", "value", lambda a, b: a + b)


@REGISTRY.query(
    "SELECT l_returnflag, CAST((s + 2147483648) % 4294967296 - 2147483648 AS INTEGER) AS cents, n, lowest, highest "
    "FROM (SELECT l_returnflag, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS s, count(*) AS n, "
    "min(l_partkey) AS lowest, max(l_partkey) AS highest FROM lineitem GROUP BY l_returnflag)"
)
def wrapping_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_partkey", F.round(F.col("l_extendedprice") * 100).cast("int").alias("cents")
    )
    aggs = {
        "cents": mr.int_sum_wrapping(F.col("cents")),
        "n": mr.count_of(),
        "lowest": mr.min_of(F.col("l_partkey")),
        "highest": mr.max_of(F.col("l_partkey")),
    }
    return mr.pre_aggregate(lines, ["l_returnflag"], aggs)


@REGISTRY.query(
    "SELECT user_id, n, cents, CAST(n * squares - cents * cents AS VARCHAR) AS spread FROM ("
    "SELECT user_id, count(*) AS n, CAST(sum(c) AS BIGINT) AS cents, CAST(sum(c * c) AS HUGEINT) AS squares FROM "
    "(SELECT user_id, CAST(round(value * 100) AS BIGINT) AS c FROM events) GROUP BY user_id)"
)
def value_spread_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User code over the rows of a key: summed in the map tasks, and then per key."""

    def combine(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        n = cents = squares = 0
        for _, c in rows:
            n, cents, squares = n + 1, cents + c, squares + c * c
        yield *key, n, cents, str(squares)

    def reduce(key: tuple, parts: Iterator[tuple]) -> Iterator[tuple]:
        n = cents = squares = 0
        for _, more, c, s in parts:
            n, cents, squares = n + more, cents + c, squares + int(s)
        yield *key, n, cents, str(n * squares - cents * cents)

    rows = table(spark, sf_dir, "events").select("user_id", F.round(F.col("value") * 100).cast("bigint").alias("c"))
    return mr.reduce_runs(
        rows, ["user_id"], reduce, "user_id bigint, n bigint, cents bigint, spread string", combine, "user_id bigint, n bigint, cents bigint, squares string"
    )


@REGISTRY.query(
    "WITH b AS (SELECT user_id, ts, event_id, CASE WHEN value > lag(value) OVER w THEN 0 ELSE 1 END AS broken FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
    "r AS (SELECT user_id, sum(broken) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM b), "
    "c AS (SELECT user_id, run, count(*) AS n FROM r GROUP BY ALL) SELECT user_id, max(n) AS longest, count(*) AS runs FROM c GROUP BY user_id"
)
def rising_runs_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User code that needs a key's rows in order, and holds none of them."""

    def reduce(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        longest = runs = length = 0
        before = None
        for *_, value in rows:
            rises = before is not None and value is not None and value > before
            length, runs, before = length * rises + 1, runs + (not rises), value
            longest = max(longest, length)
        yield *key, longest, runs

    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return mr.reduce_runs(events, ["user_id"], reduce, "user_id bigint, longest bigint, runs bigint", order=("ts", "event_id"))


@REGISTRY.query(
    "SELECT user_id, CAST(median(gap) AS DOUBLE) AS median_gap_us FROM (SELECT user_id, epoch_us(ts) - "
    "lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) "
    "WHERE gap IS NOT NULL GROUP BY user_id"
)
def median_gap_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median time between the events of a user, with no user held by one task.

    Neighbours meet by (user, place), which is unique; the middle gap of a large group is found
    with histograms.
    """
    events = table(spark, sf_dir, "events").select("user_id", "event_id", epoch_micros(F.col("ts")).alias("at"))
    placed = group_rank(events, ["user_id"], ["at", "event_id"], "place")
    earlier = placed.select("user_id", (F.col("place") + 1).alias("place"), F.col("at").alias("before"))
    gaps = placed.join(earlier, ["user_id", "place"]).select("user_id", (F.col("at") - F.col("before")).alias("gap"))
    return group_median(durable(gaps), ["user_id"], "gap", "median_gap_us")


@REGISTRY.query(
    "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity "
    "FROM lineitem GROUP BY l_returnflag, l_linestatus"
)
def totals_by_composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = mr.with_composite_key(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])
    totals = mr.reduce_by_key(
        keyed, ["key"], {"n": mr.count_of(), "quantity": mr.sum_of(F.col("l_quantity").cast("decimal(18,2)"))}
    )
    return totals.select("key.*", "n", F.col("quantity").cast("double").alias("quantity"))


@REGISTRY.query(
    "SELECT value AS n, count(*) AS words FROM (SELECT token, count(*) AS value FROM "
    + _TOKENS
    + " GROUP BY token) GROUP BY value"
)
def count_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three chained jobs in one plan: tokens, counts per word, words per count."""
    jobs = [
        Job("tokens", lambda docs: mr.tokenize(docs, "text"), source=table(spark, sf_dir, "documents", "text")),
        Job("counts", lambda t: mr.reduce_by_key(t, ["token"], {"n": F.count(F.lit(1))}), chained_after="tokens"),
        Job("histogram", lambda c: mr.reduce_by_key(c, ["n"], {"words": F.count(F.lit(1))}), chained_after="counts"),
    ]
    return run_chain(jobs)["histogram"]


@REGISTRY.query(
    "SELECT coalesce(p.k, l.k) AS partkey, CAST(coalesce(inventory, 0) AS DOUBLE) AS inventory, "
    "CAST(coalesce(sales, 0) AS DOUBLE) AS sales, CAST(coalesce(pieces, 0) AS BIGINT) AS pieces FROM "
    "(SELECT p_partkey AS k, sum(CAST(p_retailprice AS DECIMAL(18,2))) AS inventory FROM part GROUP BY 1) p FULL JOIN "
    "(SELECT l_partkey AS k, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS sales, "
    "sum(CAST(l_quantity AS BIGINT)) AS pieces FROM lineitem GROUP BY 1) l ON p.k = l.k"
)
def inventory_and_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = {
        "inventory": table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "partkey"),
        "sales": table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "partkey"),
    }
    totals = mr.multi_input_aggregate(
        inputs,
        ["partkey"],
        {
            "inventory": {"inventory": F.col("p_retailprice").cast("decimal(18,2)")},
            "sales": {
                "sales": F.col("l_extendedprice").cast("decimal(18,2)"),
                "pieces": F.col("l_quantity").cast("bigint"),
            },
        },
    )
    money = lambda c: F.col(c).cast("double").alias(c)
    return totals.select("partkey", money("inventory"), money("sales"), "pieces")


@REGISTRY.query(
    "SELECT tag, count(*) AS n, count(price) AS priced, CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) AS total FROM "
    "(SELECT 'orders' AS tag, o_totalprice AS price FROM orders UNION ALL "
    "SELECT 'lines', l_extendedprice FROM lineitem UNION ALL SELECT 'events', NULL FROM events) GROUP BY tag"
)
def tagged_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    together = formats.read_tagged(
        {
            "orders": table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("price")),
            "lines": table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("price")),
            "events": table(spark, sf_dir, "events").select("event_id"),
        }
    )
    total = F.sum(F.col("price").cast("decimal(18,2)")).cast("double")
    return mr.reduce_by_key(together, ["tag"], {"n": F.count(F.lit(1)), "priced": F.count("price"), "total": total})


# --- partition and sort -----------------------------------------------------


@REGISTRY.query("SELECT CAST(o_custkey % 8 AS INTEGER) AS partition_id, count(*) AS n FROM orders GROUP BY 1")
def orders_per_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey")
    return mr.partition_sizes(mr.partition_by(orders, 8, partition_expr=F.col("o_custkey") % 8))


@REGISTRY.query("SELECT count(*) AS customers, max(parts) AS parts_per_customer FROM "
           "(SELECT o_custkey, 1 AS parts FROM orders GROUP BY o_custkey)")
def partitions_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key lies in one partition, whatever their number."""
    placed = mr.partition_by(table(spark, sf_dir, "orders").select("o_custkey"), 16, key="o_custkey")
    spread = placed.select("o_custkey", F.spark_partition_id().alias("p")).distinct()
    per_key = spread.groupBy("o_custkey").agg(F.count(F.lit(1)).cast("int").alias("parts"))
    return per_key.agg(F.count(F.lit(1)).alias("customers"), F.max("parts").alias("parts_per_customer"))


@REGISTRY.query(
    "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank FROM events"
)
def event_order_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    return group_rank(events, ["user_id"], ["ts", "event_id"]).drop("ts")


@REGISTRY.query(
    "SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment, c_acctbal, c_custkey) AS rank FROM customer"
)
def customer_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_mktsegment", "c_acctbal", "c_custkey")
    return global_rank(customers, ["c_mktsegment", "c_acctbal", "c_custkey"]).select("c_custkey", "rank")


# --- formats ----------------------------------------------------------------


@REGISTRY.query("SELECT CAST(l_partkey AS VARCHAR) AS key, count(*) AS n, CAST(sum(l_suppkey) AS BIGINT) AS suppliers FROM lineitem GROUP BY 1")
def text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write key and value as lines, read the lines back, reduce."""
    path = scratch_path(spark, "text")
    formats.write_output(mr.emit(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey"), output_path=path)
    parts = F.split(F.col("value"), "\t")
    pairs = mr.emit(formats.read_input(spark, input_paths=[path]), parts[0], parts[1].cast("bigint"))
    return mr.reduce_by_key(pairs, ["key"], {"n": mr.count_of(), "suppliers": mr.sum_of(F.col("value"))})


@REGISTRY.query(
    """SELECT month, line AS value, CAST(coalesce(sum(strlen(line) + 1) OVER (PARTITION BY month ORDER BY o_orderkey
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
       FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y%m') AS month, concat_ws('|', o_orderkey, o_custkey, o_orderpriority) AS line FROM orders)"""
)
def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines of one file a month, sorted by key; each line with the byte where it begins."""
    path = scratch_path(spark, "lines")
    line = F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderpriority").alias("value")
    lines = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyyMM").alias("month"), "o_orderkey", line)
    lines.repartition("month").sortWithinPartitions("month", "o_orderkey").select("month", "value").write.partitionBy("month").text(path)
    month = F.regexp_extract("file", "month=([0-9]+)", 1).alias("month")
    return formats.read_lines(spark, path, with_file=True, offsets=True).select(month, "value", "offset")


@REGISTRY.query("SELECT event_type, event_id, value FROM events")
def parquet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "parquet")
    events = table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    formats.write_parquet(events, path, codec="zstd", partition_by=["event_type"])
    return formats.read_input(spark, "ParquetInputFormat", [path]).select("event_type", "event_id", "value")


@REGISTRY.query("SELECT event_id AS key, event_type AS value FROM events")
def sequence_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "sequence")
    pairs = mr.emit(table(spark, sf_dir, "events"), "event_id", "event_type")
    formats.write_output(pairs, "SequenceFileOutputFormat", path)
    return formats.read_input(spark, "SequenceFileInputFormat", [path], schema="key bigint, value string")


@REGISTRY.query(
    "SELECT event_id, event_type, CAST(CASE WHEN event_id % 5 <> 0 THEN value END AS DOUBLE) AS value, epoch_us(ts) AS at, props, CAST(len(event_type) AS BIGINT) AS n FROM events"
)
def avro_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, nulls, time stamps, lists and nested records through container files, read in small ranges."""
    path = scratch_path(spark, "avro")
    letters = F.split("event_type", "")
    nested = F.struct("props", F.create_map(F.lit("letters"), letters).alias("m")).alias("nested")
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"), "ts", nested)
    formats.write_output(events, "AvroKeyOutputFormat", path)
    read = formats.read_input(spark, "AvroKeyInputFormat", [path], split=1 << 20)
    return read.select("event_id", "event_type", "value", epoch_micros(F.col("ts")).alias("at"), "nested.props", F.size(F.col("nested.m")["letters"]).cast("bigint").alias("n"))


# --- equivalence ------------------------------------------------------------

_MILLIONTHS = "CAST(floor({0} * 1000000 + 0.5) AS BIGINT)"
_LINE_TEXT = (
    "concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, "
    + ", ".join(_MILLIONTHS.format(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    + ", l_returnflag, l_linestatus, epoch_us(l_shipdate))"
)
_LINE_HASH = f"CAST(CAST('0x' || substr(md5({_LINE_TEXT}), 1, 16) AS UBIGINT) AS HUGEINT)"
_CHANGED = (
    "(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, "
    "CASE WHEN l_returnflag = 'A' AND l_discount = 0 THEN l_tax + 1 ELSE l_tax END AS l_tax, "
    "l_returnflag, l_linestatus, l_shipdate FROM lineitem, range(2) c(i) "
    "WHERE i < CASE WHEN l_returnflag = 'R' AND l_quantity = 1 THEN 0 "
    "WHEN l_linestatus = 'O' AND l_quantity = 50 THEN 2 ELSE 1 END)"
)


@REGISTRY.query(f"SELECT (SELECT count(*) FROM lineitem) AS left_rows, (SELECT count(*) FROM {_CHANGED}) AS right_rows")
def changed_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eq.row_counts(table(spark, sf_dir, "lineitem"), testkit.changed_lineitem(spark, sf_dir))


@REGISTRY.query(f"SELECT count(*) AS row_count, CAST(sum({_LINE_HASH}) AS VARCHAR) AS checksum FROM lineitem")
def lineitem_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eq.checksum(testkit.all_lines(spark, sf_dir), scale=6).withColumn("checksum", F.col("checksum").cast("string"))


@REGISTRY.query(
    "SELECT true AS passed, count(*) AS left_rows, count(*) AS right_rows, true AS checksum_match, "
    f"'rows equal: ' || count(*) || ' vs ' || count(*) || '; checksums equal' AS details FROM ({_WORD_COUNT})"
)
def word_count_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old way of counting words against the new one: both must give the same table."""
    return eq.compare(word_count_rdd(spark, sf_dir), word_count_salted(spark, sf_dir))


@REGISTRY.query(
    "SELECT l = r AND a = b AS passed, l AS left_rows, r AS right_rows, a = b AS checksum_match, "
    "'rows ' || CASE WHEN l = r THEN 'equal' ELSE 'differ' END || ': ' || l || ' vs ' || r || '; checksums ' || "
    "CASE WHEN a = b THEN 'equal' ELSE 'differ' END AS details FROM "
    f"(SELECT count(*) AS l, sum({_LINE_HASH}) AS a FROM lineitem), "
    f"(SELECT count(*) AS r, sum({_LINE_HASH}) AS b FROM {_CHANGED})"
)
def changed_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eq.compare(testkit.all_lines(spark, sf_dir), testkit.changed_lineitem(spark, sf_dir))


@REGISTRY.query(
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, "
    "l_returnflag, l_linestatus, epoch_us(l_shipdate) AS shipped, side, count(*) AS times FROM ("
    f"SELECT *, 'left' AS side FROM (SELECT * FROM lineitem EXCEPT ALL SELECT * FROM {_CHANGED}) UNION ALL "
    f"SELECT *, 'right' FROM (SELECT * FROM {_CHANGED} EXCEPT ALL SELECT * FROM lineitem)) GROUP BY ALL"
)
def changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = eq.diff_rows(testkit.all_lines(spark, sf_dir), testkit.changed_lineitem(spark, sf_dir))
    return found.withColumn("shipped", epoch_micros(F.col("l_shipdate"))).drop("l_shipdate")


_MOVED = (
    "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS a, "
    "CASE WHEN event_id % 7 = 0 THEN event_type END AS b, value / 1e9 AS tiny FROM events"
)


@REGISTRY.query(
    "SELECT event_id, a, b, tiny, side, CAST(1 AS BIGINT) AS times FROM ("
    f"SELECT *, 'left' AS side FROM ({_MOVED}) WHERE event_id % 7 = 0 OR event_id % 11 = 0 UNION ALL "
    f"SELECT event_id, b, a, CASE WHEN event_id % 11 = 0 THEN tiny + 3e-9 ELSE tiny END, 'right' FROM ({_MOVED}) "
    "WHERE event_id % 7 = 0 UNION ALL "
    f"SELECT event_id, a, b, tiny + 3e-9, 'right' FROM ({_MOVED}) WHERE event_id % 7 <> 0 AND event_id % 11 = 0)"
)
def moved_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls that change their column, and changes far behind the decimal point."""
    null = F.lit(None).cast("string")
    seventh = F.col("event_id") % 7 == 0
    tiny = F.col("value") / F.lit(1e9)
    left = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(seventh, null).otherwise(F.col("event_type")).alias("a"),
        F.when(seventh, F.col("event_type")).alias("b"),
        tiny.alias("tiny"),
    )
    changed = F.when(F.col("event_id") % 11 == 0, F.col("tiny") + F.lit(3e-9)).otherwise(F.col("tiny"))
    right = left.select(
        "event_id",
        F.when(seventh, F.col("b")).otherwise(F.col("a")).alias("a"),
        F.when(seventh, F.col("a")).otherwise(F.col("b")).alias("b"),
        changed.alias("tiny"),
    )
    return eq.diff_rows(left, right)


@REGISTRY.query(
    "SELECT true AS passed, count(*) AS left_rows, count(*) AS right_rows, true AS checksum_match, "
    "'rows equal: ' || count(*) || ' vs ' || count(*) || '; checksums equal' AS details FROM lineitem"
)
def same_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal amounts in decimals of unequal scale, and equal maps in another order of entries."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_tax", "l_discount", "l_extendedprice")

    def side(kind: str, names: list[str]) -> DataFrame:
        rates = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])
        return lines.select("l_orderkey", F.col("l_extendedprice").cast(kind).alias("price"), rates.alias("rates"))

    return eq.compare(side("decimal(12,2)", ["l_tax", "l_discount"]), side("decimal(16,4)", ["l_discount", "l_tax"]))


_RATES = "SELECT l_orderkey, l_linenumber, l_tax, l_discount FROM lineitem"
_RAISED = "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' AND l_discount = 0 THEN l_tax + 1 ELSE l_tax END AS l_tax, l_discount FROM lineitem"


@REGISTRY.query(
    f"SELECT l_orderkey, l_linenumber, l_tax AS tax, side, count(*) AS times FROM (SELECT *, 'left' AS side FROM ({_RATES} EXCEPT ALL {_RAISED}) "
    f"UNION ALL SELECT *, 'right' FROM ({_RAISED} EXCEPT ALL {_RATES})) GROUP BY ALL"
)
def changed_nested_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays and maps inside structs: the other zero and another order of entries are no change."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_tax", "l_discount", "l_returnflag")
    raised = (F.col("l_returnflag") == "A") & (F.col("l_discount") == 0)
    other = lines.select(
        "l_orderkey", "l_linenumber", F.when(raised, F.col("l_tax") + 1).otherwise(F.col("l_tax")).alias("l_tax"),
        F.when(F.col("l_discount") == 0, F.lit(-0.0)).otherwise(F.col("l_discount")).alias("l_discount"),
    )

    def side(rows: DataFrame, names: list[str]) -> DataFrame:
        rates = F.create_map(*[x for n in names for x in (F.lit(n), F.array(n))])
        return rows.select("l_orderkey", "l_linenumber", F.struct(F.array("l_tax", "l_discount").alias("list"), rates.alias("rates")).alias("line"))

    found = eq.diff_rows(side(lines, ["l_tax", "l_discount"]), side(other, ["l_discount", "l_tax"]))
    return found.select("l_orderkey", "l_linenumber", F.col("line.list")[0].alias("tax"), "side", "times")
