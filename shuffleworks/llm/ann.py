"""Approximate nearest neighbours: a graph by NN-descent, greedy search on it.

Building. Vectors that take part are made unit vectors in single precision; equal
ones are one node. Nearness is the squared distance of these, summed in double
precision, which has the order of the cosine and keeps near copies apart whose
cosines round to the same number. Signed cross-polytope hashes deal the nodes into blocks, whose
members are compared with each other for a first graph. Then rounds of Spark
joins: every node is a centre that gathers its neighbours and those it is a
neighbour of, with their vectors; each two of them are neighbours of a neighbour,
and what beats a node's worst neighbour goes to that node, which keeps its best
``WIDTH``. Rounds go on until few neighbours change; lists only get better, so that
they end. A centre with very many
reverse neighbours is split by hash, none of them is left out.

Searching. A query starts at its own node, if it has one, and at a few nodes of
smallest hash; in each round all unexpanded nodes among its best ``BEAM`` are
expanded by joins, until there are none. All of the beam is scored on the original
vectors in double precision, and nodes expand to their members.

Left out: null ids, null vectors, zero vectors, vectors with null or non-finite
components, and vectors of another length than the most frequent one. Of rows that
repeat an id the least vector counts. Extra columns are ignored.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shuffleworks.llm.common import cut

WIDTH = 32  # neighbours of a node
OFFERS = 16  # best new neighbours that a centre offers each member
BLOCK = 512  # nodes of a block of the first graph
HASHES = 3  # first graphs that are merged
SETTLED = 0.03  # share of changed neighbours below which the graph is done
HUB = 256  # members from which a centre is split
BEAM = 128
SEEDS = 8
NOTHING = -9.0  # below every nearness, which is the negated squared distance of unit vectors
BUCKET = 2048  # nodes that one Python call merges
CENTRES = 128  # centres that one Python call joins


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished rounds: it does when their plans are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _buckets(column: str, n: int):
    return F.pmod(F.xxhash64(column), F.lit(max(1, n))).cast("int")


def _floats(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Binary values of equal size as the rows of a matrix."""
    return np.frombuffer(b"".join(v.as_py() for v in column), dtype=np.float32).reshape(-1, width)


def _nearness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Negated squared distances of the rows of ``a`` and ``b``."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return (2 * (a @ b.T) - (a * a).sum(axis=1)[:, None] - (b * b).sum(axis=1)).astype(np.float32)


def participants(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, embedding (array of double), k1, k2: the rows that take part, once per id."""
    rows = vectors.select(F.col(ident).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.coalesce(finite, F.lit(False)))
    rows = rows.where(F.exists("embedding", lambda x: x != 0))
    rows = cut(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")
    common = rows.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    width = common["d"] if common else 0
    # Adding zero makes the two zeros one.
    same = F.transform("embedding", lambda x: x + 0.0)
    return rows.where(F.size("embedding") == width).withColumns({"k1": F.xxhash64(same), "k2": F.xxhash64(F.lit(1), same)})


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            values = np.array(batch.column("embedding").to_pylist(), dtype=np.float64)
            values /= np.abs(values).max(axis=1, keepdims=True)  # no overflow of the squares
            values /= np.linalg.norm(values, axis=1, keepdims=True)
            single = pa.array([v.tobytes() for v in values.astype(np.float32)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("node"), single], names=["node", "v"])


def _hash_keys(width: int, functions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(7)
        turns = [[np.linalg.qr(rng.normal(size=(width, width)))[0].astype(np.float32) for _ in range(functions)] for _ in range(HASHES)]
        for batch in batches:
            if not batch.num_rows:
                continue
            values = _floats(batch.column("v"), width)
            nodes, keys = [], []
            for table, own in enumerate(turns):
                key = np.full(len(values), table, dtype=np.int64)
                for turn in own:
                    turned = values @ turn
                    largest = np.abs(turned).argmax(axis=1)
                    key = key * (2 * width) + 2 * largest + (turned[np.arange(len(values)), largest] > 0)
                nodes.append(batch.column("node"))
                keys.append(pa.array(key))
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays(nodes), pa.concat_arrays(keys), pa.concat_arrays([batch.column("v")] * len(turns))], names=["node", "key", "v"]
            )

    return run


_OFFERS = "a long, bs array<long>, ss array<float>"


def _lists(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> pa.Table:
    """Triples sorted by a -> one row per a."""
    heads, starts = np.unique(a, return_index=True)
    offsets = pa.array(np.append(starts, len(a)).astype(np.int32))
    bs = pa.ListArray.from_arrays(offsets, pa.array(b.astype(np.int64)))
    ss = pa.ListArray.from_arrays(offsets, pa.array(s.astype(np.float32)))
    return pa.table({"a": pa.array(heads.astype(np.int64)), "bs": bs, "ss": ss})


def _best(a: np.ndarray, b: np.ndarray, s: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of triples, each (a, b) once and the ``n`` best of each a, ties to the smaller b."""
    order = np.lexsort((b, a))
    a, b, s = a[order], b[order], s[order]
    first = np.ones(len(a), dtype=bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b, s = a[first], b[first], s[first]
    order = np.lexsort((b, -s, a))
    a, b, s = a[order], b[order], s[order]
    _, starts, counts = np.unique(a, return_index=True, return_counts=True)
    keep = np.arange(len(a)) - np.repeat(starts, counts) < n
    return a[keep], b[keep], s[keep]


def _top(scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of the ``n`` largest of each row."""
    n = min(n, scores.shape[1])
    at = np.argpartition(-scores, n - 1, axis=1)[:, :n]
    return at, np.take_along_axis(scores, at, 1)


def _block(width: int):
    def run(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        values = _floats(table.column("v"), width)
        parts = []
        if len(nodes) > 1:
            for at in range(0, len(nodes), BLOCK):  # against all of the block, in portions
                scores = _nearness(values[at : at + BLOCK], values)
                scores[np.arange(len(scores)), np.arange(at, at + len(scores))] = NOTHING
                column, value = _top(scores, min(WIDTH, len(nodes) - 1))
                parts.append((np.repeat(nodes[at : at + BLOCK], column.shape[1]), nodes[column].ravel(), value.ravel()))
        if not parts:
            return _lists(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
        return _lists(*_best(*(np.concatenate(p) for p in zip(*parts)), WIDTH))

    return run


def _triples(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bs, ss = table.column("bs").combine_chunks(), table.column("ss").combine_chunks()
    counts = bs.value_lengths().to_numpy()
    return np.repeat(table.column("a").to_numpy(), counts), bs.flatten().to_numpy(), ss.flatten().to_numpy()


def _merge(table: pa.Table) -> pa.Table:
    """The graph's lists (old) and offers of a bucket of nodes -> their new lists, and how many entries are new."""
    table = table.combine_chunks()
    a, b, s = _best(*_triples(table), WIDTH)
    lists = _lists(a, b, s)
    old = table.filter(table.column("old"))
    before, neighbours, _ = _triples(old)
    known = set(zip(before.tolist(), neighbours.tolist()))
    fresh = sum((x, y) not in known for x, y in zip(a.tolist(), b.tolist()))
    return lists.append_column("fresh", pa.array([fresh if i == 0 else 0 for i in range(lists.num_rows)], pa.int64()))


def _local_join(width: int):
    """Rows (c, part, m, v, worst) of a bucket of centres -> offers."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        c, part, m = (table.column(n).to_numpy() for n in ("c", "part", "m"))
        worst = table.column("worst").to_numpy()
        values = _floats(table.column("v"), width)
        order = np.lexsort((m, part, c))
        c, part, m = c[order], part[order], m[order]
        once = np.ones(len(c), dtype=bool)
        once[1:] = (c[1:] != c[:-1]) | (m[1:] != m[:-1])
        order, c, part, m = order[once], c[once], part[once], m[once]
        heads = np.ones(len(c), dtype=bool)
        heads[1:] = (c[1:] != c[:-1]) | (part[1:] != part[:-1])
        ends = np.append(np.flatnonzero(heads), len(c))
        parts = []
        for low, high in zip(ends[:-1], ends[1:]):
            if high - low < 2:
                continue
            nodes, own = m[low:high], values[order[low:high]]
            scores = _nearness(own, own)
            np.fill_diagonal(scores, NOTHING)
            column, value = _top(scores, min(OFFERS, high - low - 1))
            better = value > worst[order[low:high]][:, None]
            parts.append((np.repeat(nodes, better.sum(axis=1)), nodes[column[better]], value[better]))
        if not parts:
            return _lists(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
        return _lists(*_best(*(np.concatenate(p) for p in zip(*parts)), WIDTH))

    return run


def _merged(offers: DataFrame, graph: DataFrame | None, n: int) -> DataFrame:
    rows = offers.withColumn("old", F.lit(False))
    if graph is not None:
        rows = rows.unionByName(graph.select("a", "bs", "ss").withColumn("old", F.lit(True)))
    dealt = rows.withColumn("bucket", _buckets("a", -(-n // BUCKET))).groupBy("bucket")
    return cut(dealt.applyInArrow(_merge, _OFFERS + ", fresh long"), "graph")


def build(nodes: DataFrame, n: int, width: int) -> DataFrame:
    """Graph of ``nodes`` (node, v): a, bs (neighbours, best first), ss (their nearness)."""
    spark = nodes.sparkSession
    functions = max(1, round(np.log(max(n, 2) / BLOCK) / np.log(2 * width))) if width > 1 else 1
    keyed = cut(nodes.mapInArrow(_hash_keys(width, functions), "node long, key long, v binary"), "keys")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / BLOCK)).cast("int")
    blocks = keyed.join(cut(sizes, "sizes"), "key").withColumn("part", part).select("key", "part", "node", "v")
    graph = _merged(blocks.groupBy("key", "part").applyInArrow(_block(width), _OFFERS), None, n)
    while True:
        release(spark)
        pairs = graph.select(F.col("a").alias("c"), F.explode("bs").alias("m"))
        pairs = pairs.unionByName(pairs.select(F.col("m").alias("c"), F.col("c").alias("m")))
        hubs = pairs.groupBy("c").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > HUB)
        parts = F.coalesce(F.ceil(F.col("k") / HUB), F.lit(1))
        pairs = pairs.join(cut(hubs, "hubs"), "c", "left").withColumn("part", F.pmod(F.xxhash64("m"), parts).cast("int"))
        full = F.when(F.size("ss") == WIDTH, F.element_at("ss", -1)).otherwise(F.lit(NOTHING)).cast("float")
        worst = nodes.join(graph.select(F.col("a").alias("node"), full.alias("worst")), "node", "left")
        worst = worst.select(F.col("node").alias("m"), "v", F.coalesce("worst", F.lit(NOTHING)).cast("float").alias("worst"))
        gathered = pairs.join(worst, "m").withColumn("bucket", _buckets("c", -(-n // CENTRES)))
        offers = gathered.select("bucket", "c", "part", "m", "v", "worst").groupBy("bucket").applyInArrow(_local_join(width), _OFFERS)
        graph = _merged(offers, graph, n)
        changed = graph.agg(F.sum("fresh")).first()[0] or 0
        if changed < SETTLED * n * min(WIDTH, n):
            break
    release(spark)
    return graph.select("a", "bs", "ss")


_STATE = "q long, v binary, visited array<long>, best array<long>, ss array<float>, expanded array<boolean>, frontier array<long>"


def _advance(width: int):
    """States of a bucket of queries and the nodes they have just reached -> their next states."""

    def run(states: pa.Table, reached: pa.Table) -> pa.Table:
        found: dict[int, tuple[list, list]] = {}
        for q, node, v in zip(*(reached.column(n).to_pylist() for n in ("to", "node", "nv"))):
            ids, values = found.setdefault(q, ([], []))
            ids.append(node)
            values.append(v)
        rows = states.to_pylist()
        for row in rows:
            row.pop("bucket", None)
            ids, values = found.get(row["q"], ([], []))
            best = [(-s, b, e or b in row["frontier"]) for b, s, e in zip(row["best"], row["ss"], row["expanded"])]
            if ids:
                matrix = np.frombuffer(b"".join(values), dtype=np.float32).reshape(-1, width)
                scores = _nearness(matrix, np.frombuffer(row["v"], dtype=np.float32)[None, :])[:, 0]
                best += [(-s, b, False) for b, s in zip(ids, scores.tolist())]
                row["visited"] = row["visited"] + ids
            best = sorted(best)[:BEAM]
            row["best"], row["ss"] = [b for _, b, _ in best], [-s for s, _, _ in best]
            row["expanded"] = [e for *_, e in best]
            row["frontier"] = [b for _, b, e in best if not e]
        kinds = [("q", pa.int64()), ("v", pa.binary()), ("visited", pa.list_(pa.int64())), ("best", pa.list_(pa.int64()))]
        kinds += [("ss", pa.list_(pa.float32())), ("expanded", pa.list_(pa.bool_())), ("frontier", pa.list_(pa.int64()))]
        return pa.Table.from_pylist(rows, schema=pa.schema(kinds))

    return run


def search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, n_queries: int, width: int) -> DataFrame:
    """``queries`` (q, v, own: its node or null) -> q, best: the nodes found, nearest first."""
    spark = nodes.sparkSession
    entries = [r["node"] for r in nodes.orderBy(F.xxhash64("node"), "node").select("node").limit(SEEDS).collect()]
    fixed = F.array(*map(F.lit, entries)).cast("array<long>")
    start = F.array_distinct(F.filter(F.concat(F.array("own"), fixed), lambda x: x.isNotNull()))
    empty = F.array()
    states = queries.select(
        "q", "v", empty.cast("array<long>").alias("visited"), empty.cast("array<long>").alias("best"),
        empty.cast("array<float>").alias("ss"), empty.cast("array<boolean>").alias("expanded"), empty.cast("array<long>").alias("frontier"),
        start.alias("new"),
    )
    states = cut(states, "states")
    reached = states.select("q", F.explode("new").alias("node"))
    states = states.drop("new")
    bucket = _buckets("q", -(-n_queries // 32))
    while True:
        told = reached.join(nodes.withColumnRenamed("v", "nv"), "node").select(F.col("q").alias("to"), "node", "nv")
        told = told.withColumn("at", _buckets("to", -(-n_queries // 32)))
        grouped = states.withColumn("bucket", bucket).groupBy("bucket").cogroup(told.groupBy("at"))
        states = cut(grouped.applyInArrow(_advance(width), _STATE), "states")
        release(spark)
        if not states.agg(F.max(F.size("frontier"))).first()[0]:
            return states.select("q", "best")
        ahead = states.select("q", F.explode("frontier").alias("a")).join(graph.select("a", "bs"), "a")
        met = ahead.select("q", F.explode("bs").alias("node")).groupBy("q").agg(F.collect_set("node").alias("met"))
        reached = met.join(states.select("q", "visited"), "q").select("q", F.explode(F.array_except("met", "visited")).alias("node"))


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            a, b = (np.array(batch.column(n).to_pylist(), dtype=np.float64) for n in ("embedding", "other"))
            scores = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("node"), pa.array(scores)], names=["query_id", "node", "score"])


def nearest(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """The ``k`` nearest found of every row whose id is divisible by ``every``: query_id, rank, vec_id, score."""
    rows = cut(participants(vectors), "participants")
    # The first members of a class of equal vectors are enough for every answer.
    order = W.partitionBy("k1", "k2").orderBy("vec_id")
    members = rows.select("k1", "k2", "vec_id").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    members = cut(members, "members")
    reps = members.where("place = 1").select("k1", "k2", F.col("vec_id").alias("node"))
    classes = cut(rows.join(reps, (rows["vec_id"] == reps["node"])).select("node", "embedding", rows["k1"], rows["k2"]), "classes")
    nodes = cut(classes.select("node", "embedding").mapInArrow(_unit, "node long, v binary"), "nodes")
    n = nodes.count()
    wanted = rows.where(F.col("vec_id") % every == 0).select("vec_id", "k1", "k2", F.col("embedding").alias("own_embedding"))
    if not n:
        return wanted.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    width = len(nodes.first()["v"]) // 4
    graph = build(nodes, n, width)
    # A query's class and its node are found by the keys of its vector; equal queries are searched once.
    asked = cut(wanted.join(classes.select("node", "k1", "k2"), ["k1", "k2"]).select("vec_id", "node", "own_embedding"), "asked")
    starts = asked.select("node").distinct().join(nodes, "node").select(F.col("node").alias("q"), "v", F.col("node").alias("own"))
    found = search(starts, nodes, graph, asked.select("node").distinct().count(), width)
    best = found.select(F.col("q").alias("own"), F.explode("best").alias("node"))
    pairs = asked.select(F.col("vec_id").alias("query_id"), F.col("node").alias("own"), F.col("own_embedding").alias("embedding")).join(best, "own")
    scored = pairs.join(classes.select("node", F.col("embedding").alias("other")), "node").select("query_id", "node", "embedding", "other")
    scored = scored.mapInArrow(_exact, "query_id long, node long, score double")
    of_node = classes.select("node", "k1", "k2").join(members, ["k1", "k2"]).select("node", "vec_id")
    answers = scored.join(of_node, "node").where("vec_id <> query_id")
    ranked = answers.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
