"""Map, combine, partition and reduce as DataFrame operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from functools import reduce
from itertools import chain, groupby, islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shuffleworks.functions.text import tokens
from shuffleworks.sources.formats import read_tagged

KEY, VALUE = "key", "value"

_HELD_KEYS = 100_000
_OUT_ROWS = 10_000


# --- map --------------------------------------------------------------------


def map_rows(df: DataFrame, *exprs: Column) -> DataFrame:
    """One row out per row in, by expressions."""
    return df.select(*exprs)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterable[pd.DataFrame]], schema) -> DataFrame:
    """Rows through user code, in Arrow batches; select the needed columns first."""
    return df.mapInPandas(fn, schema)


def map_only(df: DataFrame, exprs: list[Column], predicate: Column | None = None) -> DataFrame:
    """A job without a reducer: filter and project, no shuffle."""
    kept = df if predicate is None else df.where(predicate)
    return kept.select(*exprs)


def tokenize(df: DataFrame, text_col: str, out: str = "token", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per token of the text; see ``functions.text.tokens`` for what ends a token."""
    return df.select(*keep, F.explode(tokens(F.col(text_col))).alias(out))


def emit(df: DataFrame, key: Column | str, value: Column | str) -> DataFrame:
    """Rows as ``(key, value)``."""
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(as_column(key).alias(KEY), as_column(value).alias(VALUE))


# --- aggregates that can be combined ----------------------------------------


@dataclass(frozen=True)
class Combinable:
    """An associative, commutative aggregate: partial values and how to merge them.

    ``parts`` maps a suffix to (partial aggregate, merge function); ``finish``
    turns the merged parts into the result.
    """

    parts: Mapping[str, tuple[Column, Callable[[Column], Column]]]
    finish: Callable[[Mapping[str, Column]], Column]


def _single(partial: Column, merge: Callable[[Column], Column]) -> Combinable:
    return Combinable({"v": (partial, merge)}, lambda merged: merged["v"])


def sum_of(value: Column) -> Combinable:
    return _single(F.sum(value), F.sum)


def count_of(value: Column | None = None) -> Combinable:
    return _single(F.count(F.lit(1) if value is None else value), F.sum)


def min_of(value: Column) -> Combinable:
    return _single(F.min(value), F.min)


def max_of(value: Column) -> Combinable:
    return _single(F.max(value), F.max)


def mean_of(value: Column) -> Combinable:
    return Combinable(
        {"s": (F.sum(value), F.sum), "n": (F.count(value), F.sum)},
        lambda merged: F.try_divide(merged["s"], merged["n"]),
    )


def int_sum_wrapping(value: Column) -> Combinable:
    """Sum of 32-bit integers that wraps around at 32 bits.

    High and low halves are summed apart, so the sums themselves cannot overflow
    bigint, whatever the number of rows.
    """
    wide = value.cast("bigint")
    high, low = F.shiftright(wide, 16), wide.bitwiseAND(F.lit(0xFFFF))

    def finish(merged: Mapping[str, Column]) -> Column:
        folded = F.pmod(merged["h"], F.lit(1 << 16)) * F.lit(1 << 16) + merged["l"]
        half = F.lit(1 << 31)
        return (F.pmod(folded + half, F.lit(1 << 32)) - half).cast("int")

    return Combinable({"h": (F.sum(high), F.sum), "l": (F.sum(low), F.sum)}, finish)


def _refuse_plain(aggs: Mapping[str, Combinable]) -> None:
    for name, agg in aggs.items():
        if not isinstance(agg, Combinable):
            raise TypeError(
                f"aggregate {name!r} is not known to be associative and commutative; "
                "use reduce_by_key, or state its parts with Combinable"
            )


# --- reduce -----------------------------------------------------------------


def reduce_by_key(df: DataFrame, keys: list[str], aggs: Mapping[str, Column | Combinable]) -> DataFrame:
    """One row per key.

    Spark sums before the shuffle (partial aggregate), so each map task sends at
    most one row per key.
    """
    plain = {n: a for n, a in aggs.items() if isinstance(a, Column)}
    combined = {n: a for n, a in aggs.items() if isinstance(a, Combinable)}
    partials = [p.alias(f"_{n}_{s}") for n, a in combined.items() for s, (p, _) in a.parts.items()]
    grouped = df.groupBy(*keys).agg(*partials, *[a.alias(n) for n, a in plain.items()])
    return grouped.select(
        *keys,
        *[
            (a if n in plain else _finished(n, a)).alias(n) if n in combined else F.col(n)
            for n, a in aggs.items()
        ],
    )


def _finished(name: str, agg: Combinable) -> Column:
    return agg.finish({s: F.col(f"_{name}_{s}") for s in agg.parts})


def pre_aggregate(df: DataFrame, keys: list[str], aggs: Mapping[str, Combinable], salt: int = 16) -> DataFrame:
    """``reduce_by_key`` in two shuffles: by (key, salt), then by key. Same result.

    For keys so hot that even one partial row per map task is too much for the
    task that owns the key. The salt is the number of the map task, so a retried
    task salts its rows the same way again.
    """
    _refuse_plain(aggs)
    salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salt)))
    partials = [p.alias(f"_{n}_{s}") for n, a in aggs.items() for s, (p, _) in a.parts.items()]
    first = salted.groupBy(*keys, "_salt").agg(*partials)
    merges = [m(F.col(f"_{n}_{s}")).alias(f"_{n}_{s}") for n, a in aggs.items() for s, (_, m) in a.parts.items()]
    second = first.groupBy(*keys).agg(*merges)
    return second.select(*keys, *[_finished(n, a).alias(n) for n, a in aggs.items()])


def reduce_by_key_rdd(df: DataFrame, key: str, value: str, op: Callable) -> DataFrame:
    """The same over an RDD, for an ``op`` only Python can say.

    Values are combined in each map task before the shuffle: flat ones per Arrow
    batch, at most ``_HELD_KEYS`` keys at a time, so that few rows have to become
    Python objects of the RDD; nested ones as they come sorted. Spark shuffles and
    sorts what is left, and a task reads it as runs of one key, so it never holds more
    than a key and a value, however many keys there are. Still slower than
    ``reduce_by_key`` by the cost of moving every row through Python.
    """
    pairs = df.select(F.col(key).alias(KEY), F.col(value).alias(VALUE))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in pairs.schema.fields])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        kinds = []
        for batch in batches:
            kinds = batch.schema.types
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[k] = op(held[k], v) if k in held else v
            if len(held) > _HELD_KEYS:
                yield packed(held, kinds)
                held = {}
        if held:
            yield packed(held, kinds)

    def packed(held: dict, kinds: list) -> pa.RecordBatch:
        columns = [pa.array(list(held), kinds[0]), pa.array(list(held.values()), kinds[1])]
        return pa.RecordBatch.from_arrays(columns, [KEY, VALUE])

    def runs(rows: Iterator[tuple]) -> Iterator[tuple]:
        for k, run_of in groupby(rows, lambda row: row[0]):
            yield k, reduce(op, (v for _, v in run_of))

    # A collation sorts unlike keys as equal ones, so that they would not come in runs.
    order = F.collate(KEY, "UTF8_BINARY") if isinstance(schema[KEY].dataType, T.StringType) else F.col(KEY)

    def reduced(rows: DataFrame) -> DataFrame:
        return df.sparkSession.createDataFrame(rows.sortWithinPartitions(order).rdd.mapPartitions(runs), schema)

    nested = (T.StructType, T.ArrayType, T.MapType)
    is_flat = not any(isinstance(f.dataType, nested) for f in schema.fields)
    combined = pairs.mapInArrow(combine, schema) if is_flat else reduced(pairs)
    return reduced(combined.repartition(KEY))


Reducer = Callable[[tuple, Iterator[tuple]], Iterable[tuple]]


def _same_zero(df: DataFrame, keys: list[str]) -> DataFrame:
    """Floating-point keys with one zero, as grouping has them."""
    return df.withColumns({k: F.col(k) + F.lit(0.0) for k in keys if isinstance(df.schema[k].dataType, (T.FloatType, T.DoubleType))})


def _walk(columns: list[str], keys: list[str], fn: Reducer, schema: pa.Schema):
    """Rows in the order of their keys -> what ``fn`` makes of each key's rows, which it gets one by one."""
    places = [columns.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
        # NaN is unlike itself, but one key.
        alike = lambda row: tuple("NaN" if row[i] != row[i] else (row[i],) for i in places)

        def made() -> Iterator[tuple]:
            for _, run_of in groupby(rows, alike):
                first = next(run_of)
                yield from fn(tuple(first[i] for i in places), chain([first], run_of))

        out = made()
        while held := list(islice(out, _OUT_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    return run


def reduce_runs(
    df: DataFrame,
    keys: list[str],
    reduce: Reducer,
    schema: str,
    combine: Reducer | None = None,
    combine_schema: str | None = None,
    order: tuple[str, ...] = (),
) -> DataFrame:
    """Arbitrary code over the rows of a key, which come one by one: no task ever holds a group.

    ``reduce(key, rows)`` gets the key as a tuple and an iterator over its rows (tuples of all
    columns), in the order of ``order``, and gives rows of ``schema``. It need not read them all.
    A key's rows go through one task; ``combine(key, rows)``, of the same kind, cuts them down before
    the shuffle: it runs in the map task over the task's rows, sorted there by key, and gives rows
    of ``combine_schema`` with the keys among its columns. Only what it gives is shuffled. Null is a
    key like any other, and so is NaN.
    """
    if (combine is None) != (combine_schema is None):
        raise ValueError("give combine and combine_schema together")
    df = _same_zero(df, keys)
    if combine is not None:
        sorted_there = df.sortWithinPartitions(*keys)
        df = sorted_there.mapInArrow(_walk(df.columns, keys, combine, _arrow_schema(combine_schema)), combine_schema)
    together = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return together.mapInArrow(_walk(df.columns, keys, reduce, _arrow_schema(schema)), schema)


def _arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(schema))


def reduce_groups(
    df: DataFrame,
    keys: list[str],
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    partial: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
    partial_schema: str | None = None,
    merge: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
) -> DataFrame:
    """Arbitrary code over all rows of a key, as a pandas frame.

    With ``partial`` (some rows of a key to rows with the keys, in ``partial_schema``) and ``merge``
    (all partial rows of a key to the result) no task holds a group, whatever its size: ``partial``
    runs in the map task, over its rows sorted by key, at most a batch at a time, and only what it
    gives is shuffled. Code that cannot be taken apart goes in ``fn``, which gets one whole group;
    groups must then fit into a task's memory. ``reduce_runs`` has no such bound.
    """
    given = [partial, partial_schema, merge]
    if any(x is None for x in given) and any(x is not None for x in given):
        raise ValueError("give partial, partial_schema and merge together")
    if partial is None:
        return df.groupBy(*keys).applyInPandas(fn, schema)
    names = T.StructType.fromDDL(partial_schema).names

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pieces = [partial(rows.reset_index(drop=True)) for _, rows in batch.groupby(keys, sort=False, dropna=False)]
            if pieces:
                yield pd.concat([p.set_axis(names, axis=1) for p in pieces], ignore_index=True)

    pieces = _same_zero(df, keys).sortWithinPartitions(*keys).mapInPandas(combine, partial_schema)
    return pieces.groupBy(*keys).applyInPandas(merge, schema)


def with_composite_key(df: DataFrame, cols: list[str], out: str = KEY) -> DataFrame:
    """Several columns as one key. A struct compares and groups field by field."""
    return df.withColumn(out, F.struct(*cols))


def multi_input_aggregate(
    inputs: Mapping[str, DataFrame], keys: list[str], aggs_by_tag: Mapping[str, Mapping[str, Column]]
) -> DataFrame:
    """Several inputs, one reducer: per key one sum per tag, keys of every input kept.

    ``aggs_by_tag[tag][out]`` is what that input adds to ``out``; an input without
    the key adds 0. Each input is cut down to keys and values before the union,
    so there is one shuffle, on partial sums.
    """
    outs = [out for aggs in aggs_by_tag.values() for out in aggs]
    slim = {
        tag: inputs[tag].select(*keys, *[value.alias(out) for out, value in aggs.items()])
        for tag, aggs in aggs_by_tag.items()
    }
    together = read_tagged(slim)
    return together.groupBy(*keys).agg(*[F.coalesce(F.sum(o), F.lit(0)).alias(o) for o in outs])


# --- partition --------------------------------------------------------------


def partition_by(
    df: DataFrame, n: int, key: list[str] | str | None = None, partition_expr: Column | None = None
) -> DataFrame:
    """Rows of a key in one of ``n`` partitions.

    By default by hash of the key. ``partition_expr`` is a partitioner of the
    user: its value is the number of the partition.
    """
    if (key is None) == (partition_expr is None):
        raise ValueError("give either key or partition_expr")
    if partition_expr is not None:
        return df.repartitionById(n, partition_expr.cast("int"))
    return df.repartition(n, *([key] if isinstance(key, str) else key))


def partition_sizes(df: DataFrame) -> DataFrame:
    """Rows per partition of ``df`` as it lies: ``partition_id, n``."""
    return df.groupBy(F.spark_partition_id().alias("partition_id")).agg(F.count(F.lit(1)).alias("n"))
