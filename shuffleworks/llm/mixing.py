"""Mixing sources to target weights by Poisson replication.

A source's share of the output is its target weight, so each of its documents is
repeated ``rate = share * total / rows of the source`` times on average. How often
a document is repeated is a Poisson number of that mean, got by inverting the
distribution at a uniform number hashed from seed and doc_id: the same on every
run and every cluster. Large rates are sums of Poisson numbers of a mean of at
most 16 each, whose distribution is a short table per source.

The copies are exploded before the one shuffle, which deals them out by a hash of
document and copy and sorts each partition by it: a global shuffle. Documents of
more than ``BLOCK`` Poisson numbers are exploded in two steps: into blocks of so many
numbers, which are shuffled and counted, then each block into its copies, numbered
from where the block before it ends. No task makes all copies of such a document.

A null source counts as the empty one, a null doc_id as one id. Rows that repeat
a doc_id get the same number. Sources without a given weight get none; without
any given weights a source weighs ``rows ** alpha``. Weights that are negative,
infinite or not numbers are refused (ValueError). Extra columns are kept;
``copy_no``, ``n_copies`` and ``shuffle_key`` get underscores if they clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shuffleworks.llm.common import cut, fresh

ALPHA = 0.5
SEED = 17
PIECE = 16.0  # largest mean of one inverted distribution
TERMS = 80  # its table: the tail beyond is below 1e-28
BLOCK = 4096  # distributions inverted in one go: some 65,536 copies at most of one row


def hashed(parts: list[Column]) -> Column:
    """52 bits of an md5 as bigint."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long")


def rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, source: str = "source") -> DataFrame:
    """Per source: rows, rate, pieces and the table of its distribution. All rows are counted."""
    counts = docs.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("mix_source")).agg(F.count(F.lit(1)).alias("rows"))
    if weights is None:
        weight = F.pow(F.col("rows").cast("double"), F.lit(alpha)) if alpha != 0.5 else F.sqrt(F.col("rows").cast("double"))
        counts = counts.withColumn("weight", weight)
    else:
        if any(not 0 <= w < math.inf for w in weights.values()):
            raise ValueError(f"weights must be finite and not negative: {weights}")
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]) if weights else None
        found = F.coalesce(F.element_at(given, F.col("mix_source")), F.lit(0.0)) if weights else F.lit(0.0)
        counts = counts.withColumn("weight", found)
    totals = counts.agg(F.sum("weight").alias("all_weight"), F.sum("rows").alias("all_rows"))
    joined = counts.withColumn("one", F.lit(1)).join(F.broadcast(totals.withColumn("one", F.lit(1))), "one")  # one row
    rate = F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight") * F.col("all_rows") / F.col("rows")).otherwise(F.lit(0.0))
    rated = joined.select("mix_source", "rows", rate.alias("rate"))
    rated = rated.withColumn("pieces", F.greatest(F.ceil(F.col("rate") / PIECE), F.lit(1)).cast("long"))
    mean = F.col("rate") / F.col("pieces")
    start = F.struct(F.exp(-mean).alias("term"), F.array(F.exp(-mean)).alias("table"))
    steps = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        start,
        lambda acc, k: F.struct(
            (acc["term"] * mean / k).alias("term"),
            F.concat(acc["table"], F.array(F.element_at(acc["table"], -1) + acc["term"] * mean / k)).alias("table"),
        ),
        lambda acc: acc["table"],
    )
    return rated.withColumn("table", steps)


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """All copies: the columns of ``docs``, copy_no (from 1), n_copies, shuffle_key; shuffled globally."""
    names = ("_mix", "_pieces", "_steps", "_block", "_before", "_of_block", "_ident")
    source, pieces, steps, block, before, of_block, ident = (fresh(docs, n) for n in names)
    copy_no, n_copies, key = (fresh(docs, n) for n in ("copy_no", "n_copies", "shuffle_key"))
    table = cut(rates(docs, weights, alpha), "rates").select(
        F.col("mix_source").alias(source), F.col("pieces").alias(pieces), F.col("table").alias(steps)
    )
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    named = docs.withColumns({source: F.coalesce(F.col("source").cast("string"), F.lit("")), ident: name})

    def inverted(piece: Column) -> Column:
        at = (hashed([F.lit(str(seed)), F.col(ident), piece.cast("string")]).cast("double") + 0.5) / float(1 << 52)
        return F.size(F.filter(F.col(steps), lambda f: f <= at)).cast("long")

    def total(first: Column, end: Column) -> Column:
        return F.aggregate(F.sequence(first, end - 1), F.lit(0).cast("long"), lambda n, piece: n + inverted(piece))

    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    counted = named.join(table.where(F.col(pieces) <= BLOCK), source).withColumn(n_copies, total(zero, F.col(pieces)))
    copies = counted.where(F.col(n_copies) > 0).withColumn(copy_no, F.explode(F.sequence(one, F.col(n_copies))))
    copies = copies.select(*docs.columns, ident, copy_no, n_copies)
    large = table.where(F.col(pieces) > BLOCK)
    if not large.isEmpty():
        blocks = F.explode(F.sequence(zero, F.floor((F.col(pieces) - 1) / BLOCK)))
        end = F.least((F.col(block) + 1) * BLOCK, F.col(pieces))
        parts = named.select(source, ident).distinct().join(large, source).withColumn(block, blocks).repartition(source, ident, block)
        parts = parts.select(source, ident, block, total(F.col(block) * BLOCK, end).alias(of_block))
        own = Window.partitionBy(source, ident)
        placed = parts.withColumns({
            before: F.coalesce(F.sum(of_block).over(own.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)), zero),
            n_copies: F.sum(of_block).over(own.orderBy(block).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        })
        dealt = named.join(large, source).withColumn(block, blocks).drop(pieces, steps).repartition(source, ident, block)
        found = dealt.join(placed.where(F.col(of_block) > 0), [source, ident, block])
        numbers = F.explode(F.sequence(F.col(before) + 1, F.col(before) + F.col(of_block)))
        copies = copies.unionByName(found.withColumn(copy_no, numbers).select(*docs.columns, ident, copy_no, n_copies))
    keyed = copies.withColumn(key, hashed([F.lit(f"{seed}-order"), F.col(ident), F.col(copy_no).cast("string")]))
    return keyed.repartition(F.col(key)).sortWithinPartitions(key, "doc_id", copy_no).select(*docs.columns, copy_no, n_copies, key)


def sql(docs: str, seed: int = SEED, columns: str = "d.doc_id, d.text, d.lang, d.source, d.n_chars, c.copy_no, n.n_copies, c.shuffle_key") -> str:
    """The same rows in DuckDB SQL, for ``alpha`` 0.5; ``docs`` names or is a table."""
    return f"""
    WITH s AS (SELECT coalesce(source, '') AS mix_source, count(*) AS n_rows FROM {docs} GROUP BY ALL),
    r AS (SELECT *, sqrt(n_rows::DOUBLE) / sum(sqrt(n_rows::DOUBLE)) OVER () * (sum(n_rows) OVER ())::DOUBLE / n_rows AS rate FROM s),
    p AS (SELECT *, greatest(ceil(rate / {PIECE}), 1)::BIGINT AS pieces FROM r),
    f AS (SELECT mix_source, k, sum(exp(-rate / pieces + k * ln(rate / pieces) - lgamma(k + 1))) OVER (PARTITION BY mix_source ORDER BY k) AS f
          FROM p, range(0, {TERMS} + 1) t(k)),
    q AS (SELECT doc_id, mix_source, ('0x' || md5(concat('{seed}:', coalesce(doc_id::VARCHAR, 'null'), ':', piece))[1:13])::BIGINT AS h
          FROM (SELECT DISTINCT doc_id, coalesce(source, '') AS mix_source FROM {docs}) JOIN p USING (mix_source), LATERAL unnest(range(pieces)) t(piece)),
    n AS (SELECT q.doc_id, q.mix_source, count(*) FILTER (WHERE f.f <= (q.h + 0.5) / {1 << 52}) AS n_copies FROM q JOIN f USING (mix_source) GROUP BY ALL),
    c AS (SELECT doc_id, mix_source, copy_no, ('0x' || md5(concat('{seed}-order:', coalesce(doc_id::VARCHAR, 'null'), ':', copy_no))[1:13])::BIGINT AS shuffle_key
          FROM n, LATERAL unnest(range(1, n_copies + 1)) t(copy_no))
    SELECT {columns} FROM {docs} d
    JOIN n ON n.doc_id IS NOT DISTINCT FROM d.doc_id AND n.mix_source = coalesce(d.source, '')
    JOIN c ON c.doc_id IS NOT DISTINCT FROM d.doc_id AND c.mix_source = n.mix_source
    """
