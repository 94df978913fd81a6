"""Order by composite key: globally, within groups, and as ranks.

A window without partitions runs in one task, and a window by group puts a hot
group into one task. Ranks of large groups are built here from a range partitioning
on the whole composite key instead, which cuts a group into as many parts as its
size asks for.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shuffleworks.session import durable

ROWS = 1_000_000  # rows of a group that one task may rank; more are ranked in parts of about this many
BUCKETS = 4096  # of a histogram in the search for a median

_POSITION_BITS = 33  # monotonically_increasing_id: partition above, row below


def _columns(names: list[str] | list[Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def null_free_keys(df: DataFrame, cols: list[str]) -> list[Column]:
    """Two columns per key, neither ever null: whether it is null, and its value or a stand-in.

    Joins on them match null with null and still count as plain equality, so a
    partitioning by them serves aggregates, windows and joins alike.
    """
    keys = []
    for name in cols:
        kind = df.schema[name].dataType
        if isinstance(kind, T.StringType):
            stand_in = F.lit("")
        elif isinstance(kind, T.BooleanType):
            stand_in = F.lit(False)
        elif isinstance(kind, T.NumericType):
            stand_in = F.lit(0).cast(kind)
        else:
            stand_in = F.lit("1970-01-01").cast(kind)
        keys += [F.isnull(name), F.coalesce(name, stand_in)]
    return keys


def total_order(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows in global order of the composite key; strings compare as UTF-8 bytes."""
    return df.orderBy(*cols)


def secondary_sort(df: DataFrame, group: list[str], order: list[str], whole_groups: bool = False) -> DataFrame:
    """Rows of a group follow each other in the order of the composite key.

    The default splits by range of (group, order): a large group runs on over
    neighbouring partitions. ``whole_groups=True`` keeps every group inside one
    partition, for code that must see all of a group and knows groups are small.
    """
    cols = [*group, *order]
    spread = df.repartition(*group) if whole_groups else df.repartitionByRange(*_columns(cols))
    return spread.sortWithinPartitions(*cols)


def global_rank(df: DataFrame, cols: list[str], out: str = "rank") -> DataFrame:
    """1-based position in global order. Give a unique last column, or ties are in any order.

    Range shuffle, sort inside partitions, number the rows, then add the sizes of
    the partitions before. The numbered rows are checkpointed, so a lost executor
    cannot bring rows back under other numbers. The driver sees one count per
    partition.
    """
    number = F.monotonically_increasing_id()
    placed = durable(df.repartitionByRange(*_columns(cols)).sortWithinPartitions(*cols).withColumn("_at", number))
    part = F.shiftright("_at", _POSITION_BITS).cast("int")
    sizes = sorted(placed.groupBy(part.alias("part")).count().collect())
    before = accumulate((size for _, size in sizes), initial=0)
    offsets = df.sparkSession.createDataFrame(
        [(p, o) for (p, _), o in zip(sizes, before)], "_part int, _offset bigint"
    )
    within = F.col("_at").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")  # one row per partition
        .withColumn(out, within + F.col("_offset") + 1)
        .select(*df.columns, out)
    )


def _large(df: DataFrame, group: list[str], *more: Column) -> tuple[DataFrame, int]:
    """(groups of more than ``ROWS`` rows with their size ``_n``, the rows in them).

    Counted in the map tasks. There are at most (all rows / ``ROWS``) such groups.
    """
    large = durable(df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), *more).where(F.col("_n") > ROWS))
    return large, large.agg(F.sum("_n")).first()[0] or 0


def _named(rows: DataFrame, group: list[str], *kept: str) -> tuple[DataFrame, Column]:
    """The groups under names of their own, broadcast, and what joins them to rows of these groups, nulls included."""
    mine = F.broadcast(rows.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], *kept))
    same = F.lit(True)
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return mine, same


def group_rank(df: DataFrame, group: list[str], order: list[str], out: str = "rank") -> DataFrame:
    """1-based position within the group in composite-key order. Give a unique last order column.

    Groups of at most ``ROWS`` rows are numbered by a window. The rows of all larger groups are
    range-partitioned on the whole key into as many parts as there are ``ROWS`` of them, sorted and
    numbered where they lie; a group's part starts after its rows in the parts before. They are
    checkpointed in between, so that a lost executor cannot bring them back in other parts. The
    group sizes decide all this, so a counting job runs when the frame is built.
    """
    cols = [*group, *order]
    window = F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("bigint")
    large, total = _large(df, group)
    if not total:
        return df.withColumn(out, window)
    groups, same = _named(large, group)
    small = df.join(groups, same, "left_anti").withColumn(out, window)
    spread = df.join(groups, same, "left_semi").repartitionByRange(math.ceil(total / ROWS) + 1, *_columns(cols))
    placed = durable(spread.sortWithinPartitions(*cols).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", _POSITION_BITS))
    runs = placed.groupBy(*group, "_part").agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).withColumnRenamed("_part", "_p")
    starts, same = _named(starts, group, "_p", "_from", "_before")  # a row per part, and one per group
    numbered = placed.join(starts, same & (F.col("_part") == F.col("_p")))
    rank = F.col("_at") - F.col("_from") + F.col("_before") + 1
    return small.unionByName(numbered.withColumn(out, rank).select(*df.columns, out))


def group_median(df: DataFrame, group: list[str], value: str, out: str = "median") -> DataFrame:
    """The exact median of a whole-number column per group, as a double; nulls do not count.

    Groups of at most ``ROWS`` rows go through Spark's own exact aggregate. In larger ones the one
    or two middle places are searched with histograms: ``BUCKETS`` equal ranges between the bounds
    of a place are counted in the map tasks, and the range that holds the place has the next bounds.
    A round narrows the bounds by the number of buckets, so 64-bit values take at most six, and no
    task ever sees more of a group than its own counts. Every round reads ``df`` again.
    """
    rows = df.select(*group, F.col(value).cast("bigint").alias("_v")).where("_v is not null")
    large, total = _large(rows, group, F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    if not total:
        return rows.groupBy(*group).agg(F.median("_v").alias(out))
    groups, same = _named(large, group)
    small = rows.join(groups, same, "left_anti").groupBy(*group).agg(F.median("_v").alias(out))
    places = F.array_distinct(F.array(F.expr("(_n + 1) div 2"), F.expr("(_n + 2) div 2")))
    open_ = large.select(*group, F.explode(places).alias("_place"), F.lit(0).cast("bigint").alias("_before"), *[F.col(c).cast("decimal(20,0)").alias(c) for c in ("_lo", "_hi")])
    by_place = Window.partitionBy(*group, "_place").orderBy("_bucket")
    found = None
    while not open_.isEmpty():
        wanted, same = _named(open_.withColumn("_width", F.expr(f"(_hi - _lo) div {BUCKETS} + 1").cast("decimal(20,0)")), group, "_place", "_before", "_lo", "_hi", "_width")
        inside = rows.join(wanted, same & F.col("_v").between(F.col("_lo"), F.col("_hi")))
        counted = inside.groupBy(*group, "_place", "_before", "_lo", "_width", F.expr("(_v - _lo) div _width").alias("_bucket")).agg(F.count(F.lit(1)).alias("_c"))
        summed = counted.withColumn("_upto", F.col("_before") + F.sum("_c").over(by_place))
        held = summed.where((F.col("_upto") >= F.col("_place")) & (F.col("_upto") - F.col("_c") < F.col("_place")))
        low = (F.col("_lo") + F.col("_bucket") * F.col("_width")).cast("decimal(20,0)")
        state = durable(held.select(*group, "_place", (F.col("_upto") - F.col("_c")).alias("_before"), low.alias("_lo"), (low + F.col("_width") - 1).cast("decimal(20,0)").alias("_hi")))
        done = state.where("_lo = _hi")
        found = done if found is None else found.unionByName(done)
        open_ = state.where("_lo < _hi")
    middle = found.groupBy(*group).agg(F.avg(F.col("_lo").cast("double")).alias(out))
    return small.unionByName(middle)
