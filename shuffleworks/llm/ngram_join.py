"""Jaccard self-join over word shingles by a grouped prefix join.

A text's set holds 64-bit hashes of its distinct shingles. All sets are ordered
alike: shingles found in many texts (``HEAVY`` at most, by counts over all texts)
last, by their counts, the others by hash. Two sets of the wanted similarity
share at least ``l`` shingles in their prefixes of ``n - ceil(t * n) + l``; ``l``
grows with the set, so that a chance match is not enough.

1. Equal sets are one class. Classes of equal prefix and size are one group, and
   only groups are joined.
2. Group pairs: the groups with a shingle in their prefix, in pairs of fitting
   sizes, counted over all shingles. A list of more than ``LIST`` groups, and that
   of a very common shingle, is not paired; each group counts the shingles that it
   has in such lists. A pair needs so many less in common as its group with fewer
   of them has; without any other in common, both groups have as many as it needs.
3. Pairs with enough common shingles tie groups to clusters, and so do the rarest
   such lists of the groups that have enough of them: all but ``l - 1``, since two
   groups that match by lists alone are together in ``l`` of them.
4. Groups are expanded to classes. A cluster is cut into blocks of bounded size,
   and each pair of blocks is verified exactly, by products of 0/1 matrices. A
   block pair gives a spanning forest of its links and their number per class,
   never the links one by one. Block pairs go out in rounds that shuffle about
   twice the sets (``ROUND`` bytes at least), so that a cluster of many blocks
   takes more rounds and not more disk.
5. Links give components; classes are expanded to documents.

The order only decides how much work there is; every pair that could match meets
in one cluster, so no link is lost, whatever the counts.

Null and empty texts have empty sets and link with nothing, not even each other.
Repeated rows are documents with equal sets. Null doc_ids take part; a component
of only null ids has a null id. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shuffleworks.llm.common import Scratch, cut, keep_rows, whole_text
from shuffleworks.llm.components import components

HEAVY = 1 << 18  # shingles whose counts decide the order: two numbers each are sent to all tasks
COMMON = 8  # texts from which a shingle can be heavy
STAR = 256  # texts from which a shingle's groups are tied without a list
LIST = 64  # groups of a shingle that are paired one by one
BLOCK = 512  # classes of a block
BLOCK_SHINGLES = 400_000  # and their shingles together
ROUND = 256 << 20  # bytes of sets that a round of verification may shuffle, however few there are
WORDS = 1 << 18  # rows of a bitmap, of 64 bits each, that are sent to all tasks
FLUSH = 6_000_000  # shingles that a task counts at once
PORTION = 4 << 20  # bytes of text that a task hashes at once; a longer text is alone
CHUNKED = 64  # bytes of a word up to which it is hashed together with others
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other, ``ends[k]`` to ``ends[k + 1]`` -> hashes of their words, and each text's first word.

    Words are hashed by 8 bytes at a time, all words together, so that a word of
    up to 8 bytes shares its hash with no other of its length.
    """
    import xxhash

    low = np.frombuffer(data.lower() + bytes(8), dtype=np.uint8)  # ``bytes`` lowers ASCII only, as wanted
    body = low[:-8]
    space = (body == 32) | ((body - np.uint8(9)) < 5)
    before, after = np.ones(len(body) + 1, dtype=bool), np.ones(len(body) + 1, dtype=bool)
    before[1:], after[:-1] = space, np.append(space[1:], True)[: len(body)]
    before[ends[:-1]] = True
    after[np.maximum(ends[1:] - 1, 0)[ends[1:] > ends[:-1]]] = True
    starts = np.flatnonzero(~space & before[:-1])
    sizes = np.flatnonzero(~space & after[:-1]) + 1 - starts
    eight = np.ndarray((len(body) + 1,), dtype="<u8", buffer=low, strides=(1,))
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
    hashes = _mixed((eight[starts] & masks[np.minimum(sizes, 8)]) + sizes.astype(np.uint64) * np.uint64(SEEDS[0]))
    left = np.flatnonzero((sizes > 8) & (sizes <= CHUNKED))
    done = 8
    while len(left):
        chunk = eight[starts[left] + done] & masks[np.minimum(sizes[left] - done, 8)]
        hashes[left] = _mixed(hashes[left] * np.uint64(SEEDS[1]) + chunk)
        done += 8
        left = left[sizes[left] > done]
    for k in np.flatnonzero(sizes > CHUNKED).tolist():
        hashes[k] = xxhash.xxh3_64_intdigest(body[starts[k] : starts[k] + sizes[k]])
    return hashes, np.searchsorted(starts, ends)


def shingle_sets(data: bytes, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other -> sorted hashes of the distinct shingles of each, and where each text's begin."""
    words, first = word_hashes(data, ends)
    n_words = np.diff(first)
    n = np.where(n_words > 0, np.maximum(n_words - width + 1, 1), 0)
    bounds = np.append(0, np.cumsum(n))

    def hashed(at: np.ndarray | slice, size: int) -> np.ndarray:
        padded = np.append(words, np.zeros(size, dtype=np.uint64))
        total = np.full(len(words), size, dtype=np.uint64)[at]
        for k in range(size):
            total = _mixed(total + padded[k : k + len(words)][at] * np.uint64(SEEDS[k % len(SEEDS)]) + np.uint64(k))
        return total

    # Those that would run into the next text are worked out and left; texts of fewer words have one of their own.
    values = hashed(slice(None), width)[np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], n)]
    for size in np.unique(n_words[(n_words > 0) & (n_words < width)]).tolist():
        short = np.flatnonzero(n_words == size)
        values[bounds[short]] = hashed(first[short], size)
    places = bounds.tolist()
    for a, b in zip(places[:-1], places[1:]):
        values[a:b].sort()
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    new[bounds[:-1][n > 0]] = True
    return values[new], np.append(0, np.cumsum(new))[bounds]


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Portions of the batch's rows, with their sets one after the other and where each begins."""
    texts = batch.column("text").cast(pa.large_binary())
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + PORTION, side="right")) - 1)
        own = data[int(ends[low]) : int(ends[high])].to_pybytes() if data is not None else b""
        yield batch.slice(low, high - low), *shingle_sets(own, ends[low : high + 1] - ends[low], width)
        low = high


def _common(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            shingles, counts = np.unique(np.concatenate(held), return_counts=True)
            more = counts > 1
            return pa.RecordBatch.from_arrays([pa.array(shingles[more].view(np.int64)), pa.array(counts[more])], names=["shingle", "n"])

        for batch in batches:
            for _, found, _ in _sets(batch, width):
                held.append(found)
                size += len(found)
                if size >= FLUSH:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    return run


def heavy_shingles(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The commonest shingles, sorted, their ranks from the rarest (1) on, and their counts. At most ``HEAVY``.

    Every text is counted; only a shingle seen once among the texts that a task
    holds at once adds nothing there, as it is not common among them.
    """
    counts = texts.select("text").mapInArrow(_common(width), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= COMMON).orderBy(F.desc("n"), "shingle").limit(HEAVY).toPandas()
    top = top.sort_values(["n", "shingle"])
    shingles = top["shingle"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], np.arange(1, len(top) + 1)[order], top["n"].to_numpy()[order]


def needed(n: int, num: int, den: int) -> int:
    """The least overlap of a set of ``n`` with any set of the wanted similarity."""
    return -(-num * n // den)


def least_common(n: int) -> int:
    """Shingles that a matching pair shares in its prefixes, as far as this set is concerned."""
    return 1 + n // 25


def _digests(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits of each set, as the rows of a matrix of two numbers."""
    import xxhash

    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, sets)), dtype=">i8").reshape(-1, 2).astype(np.int64)


_ROW = [("tag", "long"), ("doc_id", "long"), ("text_key", "long"), ("n_chars", "long")]
_SET = [("n", "long"), ("s1", "long"), ("s2", "long"), ("p1", "long"), ("p2", "long")]
_MEMBER = ["rep", "cluster", "band", "n_blocks", "n_below", "n_above", "size"]
_ROWS = ", ".join(f"{a} {b}" for a, b in _ROW + _SET) + ", few long, prefix array<long>, stars array<long>"
LISTS = -(1 << 62)  # nodes of long lists are below, those of stars above, rarest first, so that nodes ascend in the common order
STARS = -(1 << 40)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays), pa.int64()))


def fewest_common(n: int, num: int, den: int) -> int:
    """The least that ``least_common`` is of a set of ``n`` or of any set that matches it."""
    return least_common(needed(n, num, den))


def _prefixes(width: int, num: int, den: int, heavy):
    """Texts -> their sets' digests and prefixes; stars, which are last in a prefix, apart and as nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ranks, first_star = heavy.value
        likely = np.zeros(1 << 22, dtype=bool)  # by a shingle's upper bits: few others need the search
        likely[known >> np.uint64(42)] = True

        def ranked(values: np.ndarray) -> np.ndarray:
            found = np.zeros(len(values), dtype=np.int64)
            maybe = np.flatnonzero(likely[values >> np.uint64(42)])
            if len(maybe):
                at = np.minimum(np.searchsorted(known, values[maybe]), len(known) - 1)
                found[maybe] = np.where(known[at] == values[maybe], ranks[at], 0)
            return found

        for batch in batches:
            for rows, values, bounds in _sets(batch, width):
                rank = ranked(values)
                sets, prefixes, plain, stars = [], [], [], []
                places = bounds.tolist()
                for a, b in zip(places[:-1], places[1:]):
                    found, n = values[a:b], b - a
                    sets.append(found)
                    length = n - needed(n, num, den) + least_common(n) if n else 0
                    if rank[a:b].any():
                        # Sorted by hash already, so a stable sort by rank gives the common order.
                        order = np.argsort(rank[a:b], kind="stable")[:length]
                        sorted_ranks = rank[a:b][order]
                        split = int(np.searchsorted(sorted_ranks, first_star))
                        prefixes.append(found[order])
                        stars.append(STARS + sorted_ranks[split:])
                    else:
                        split = length
                        prefixes.append(found[:length])
                        stars.append(rank[:0])
                    plain.append(prefixes[-1][:split].view(np.int64))
                few = [fewest_common(n, num, den) for n in np.diff(bounds).tolist()]
                keys = np.hstack([np.diff(bounds)[:, None], _digests(sets), _digests(prefixes), np.array(few)[:, None]])
                columns = [pa.array(np.ascontiguousarray(c), pa.int64()) for c in keys.T]
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(n) for n, _ in _ROW), *columns, _lists(plain), _lists(stars)],
                    names=[n for n, _ in _ROW + _SET] + ["few", "prefix", "stars"],
                )

    return run


def _pairs(num: int, den: int):
    """Rows (token, gid, n) sorted by token -> (u, v, need): pairs of fitting sizes.

    A list that is not paired gives its groups with its node as v and less than 0 as need, minus ``fewest_common``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, held, node, long = None, [], 0, False
        out: list[tuple[int, int, int]] = []

        def close() -> None:
            for k, (b, m) in enumerate(held):
                for a, n in held[:k]:
                    if den * min(n, m) >= num * max(n, m):
                        out.append((min(a, b), max(a, b), min(least_common(n), least_common(m))))

        def flushed() -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 3
            return pa.RecordBatch.from_arrays(columns, names=["u", "v", "need"])

        for batch in batches:
            tokens, gids, sizes = (batch.column(n).to_numpy() for n in ("token", "gid", "n"))
            # Most shingles stand alone; only rows with an equal neighbour, or at the batch's ends, are looked at.
            same = tokens[1:] == tokens[:-1]
            near = np.ones(len(tokens), dtype=bool)
            if len(tokens) > 2:
                near[1:-1] = same[1:] | same[:-1]
            for t, g, n in zip(tokens[near].tolist(), gids[near].tolist(), sizes[near].tolist()):
                if t != token:
                    close()
                    token, held, node, long = t, [], LISTS - ((t & (1 << 64) - 1) >> 2), False
                held.append((g, n))
                if not long and len(held) <= LIST:
                    continue
                # Too long to be paired: go on without holding it.
                out.extend((x, node, -fewest_common(m, num, den)) for x, m in held)
                held, long = [], True
                if len(out) >= 200_000:
                    yield flushed()
                    out = []
        close()
        yield flushed()

    return run


def _members(width: int):
    """Texts of classes -> their sets, if the text is the class's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, values, bounds in _sets(batch, width):
                places = bounds.tolist()
                sets = [values[a:b] for a, b in zip(places[:-1], places[1:])]
                wanted = np.column_stack([rows.column("s1").to_numpy(), rows.column("s2").to_numpy()])
                own = np.flatnonzero((_digests(sets) == wanted).all(axis=1))
                kept = rows.take(pa.array(own))
                shingles = pa.array([sets[k].tobytes() for k in own.tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(kept.column(n) for n in _MEMBER), shingles], names=[*_MEMBER, "shingles"])

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections. Columns of shingles in two or more sets, in portions of bounded size."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shingles, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[inverse] > 1
    place = np.cumsum(counts > 1) - 1
    owner, column = owner[shared], place[inverse[shared]]
    total = np.zeros((len(sets), len(sets)), dtype=np.float64)
    step = max(256, (4 << 20) // len(sets))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, (low, low + step))
        matrix = np.zeros((len(sets), step), dtype=np.float32)
        matrix[owner[a:b], column[a:b] - low] = 1
        total += matrix @ matrix.T
    return total


def _verify(num: int, den: int):
    """Rows of block pairs, together -> a spanning forest of the links, and links per class (v null)."""

    def links(rows: list[tuple], own: bool) -> list[tuple]:
        once = {r[0]: r for r in rows}  # a class whose text is there twice is one class
        rows = list(once.values())
        if len(rows) < 2:
            return []
        sets = [np.frombuffer(r[3], dtype=np.uint64) for r in rows]
        sizes = np.array([len(s) for s in sets], dtype=np.float64)
        common = overlaps(sets)
        linked = den * common >= num * (sizes[:, None] + sizes[None, :] - common)
        np.fill_diagonal(linked, False)
        if not own:  # two blocks: pairs inside a block belong to the block's own cell
            side = np.array([r[1] for r in rows])
            linked &= side[:, None] != side[None, :]
        weights = np.array([r[2] for r in rows])
        degrees = linked @ weights
        out = [(r[0], None, int(d)) for r, d in zip(rows, degrees) if d]
        root = list(range(len(rows)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in zip(*np.nonzero(np.triu(linked))):
            x, y = find(int(a)), find(int(b))
            if x != y:
                root[y] = x
                out.append((rows[a][0], rows[b][0], 0))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["u", "v", "w"])

        for batch in batches:
            keys = zip(*(batch.column(n).to_pylist() for n in ("cluster", "low", "i", "high", "j")))
            rows = zip(*(batch.column(n).to_pylist() for n in ("rep", "side", "size", "shingles")))
            for k, row in zip(keys, rows):
                if k != key:
                    out += links(held, key is None or key[1:3] == key[3:])
                    key, held = k, []
                held.append(row)
            if len(out) > 50_000:
                yield flushed()
                out = []
        out += links(held, key is None or key[1:3] == key[3:])
        yield flushed()

    return run


def bitmap(df: DataFrame, number: Column) -> DataFrame:
    """The numbers that ``df`` has, 64 to a row."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(number, F.lit(64)).cast("int"))
    return df.groupBy(F.shiftright(number, 6).alias("_word")).agg(F.bit_or(bit).alias("_bits"))


def marked(df: DataFrame, number: str, bits: DataFrame) -> DataFrame:
    """The rows of ``df`` whose number is in the bitmap, which is sent to all tasks if it has ``WORDS`` rows at most."""
    bits = F.broadcast(bits) if bits.count() <= WORDS else bits
    found = df.join(bits, F.shiftright(number, 6) == F.col("_word"))
    return found.where(F.getbit("_bits", F.pmod(number, F.lit(64)).cast("int")) == 1).select(*df.columns)


def near_duplicates(docs: DataFrame, width: int, num: int, den: int = 100) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, n_links, kept, text_key, n_chars.

    Links: ``den * intersection >= num * union``. ``n_links`` counts the rows that
    a row links with; ``kept`` marks the row of the smallest doc_id of each component.
    """
    spark = docs.sparkSession
    texts = docs.select(
        F.monotonically_increasing_id().alias("tag"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(whole_text()).alias("text_key"),
        F.length(whole_text()).cast("long").alias("n_chars"),
        whole_text().alias("text"),
    )
    scratch = Scratch(spark)
    known, ranks, counts = heavy_shingles(texts, width)
    first_star = int(np.count_nonzero(counts < STAR)) + 1  # ranks go by count
    sent = spark.sparkContext.broadcast((known, ranks, first_star))
    sets = scratch.cut("sets", texts.mapInArrow(_prefixes(width, num, den, sent), _ROWS))
    keys = scratch.cut("keys", sets.select("tag", "doc_id", "text_key", "n_chars", "n", "s1", "s2"))

    classes = sets.where("n > 0").groupBy("s1", "s2", "n").agg(
        F.min("tag").alias("rep"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("doc_id").alias("low_id"), F.count(F.lit(1)).alias("size")
    )
    classes = scratch.cut("classes", classes)
    groups = scratch.cut("groups", classes.groupBy("p1", "p2", "n").agg(F.min("rep").alias("gid"), F.count(F.lit(1)).alias("n_classes")))

    # Group pairs, and the nodes of stars and long lists that each group is in.
    leaders = marked(sets, "tag", scratch.cut("leaders", bitmap(groups, F.col("gid")))).withColumnRenamed("tag", "gid")
    lists = leaders.select(F.explode("prefix").alias("token"), "gid", "n").repartition("token").sortWithinPartitions("token")
    met = lists.mapInArrow(_pairs(num, den), "u long, v long, need long").groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("need"))
    met = scratch.cut("met", met)
    in_lists = met.where("need < 0").select(F.col("u").alias("gid"), F.col("v").alias("node"), (-F.col("need")).alias("few"))
    in_stars = leaders.where(F.size("stars") > 0).select("gid", F.explode("stars").alias("node"), "few")
    held = in_lists.unionByName(in_stars).groupBy("gid").agg(F.array_sort(F.collect_list("node")).alias("nodes"), F.max("few").alias("few"))
    held = scratch.cut("held", held.withColumn("n_nodes", F.size("nodes").cast("long")))
    scratch.drop("sets", "leaders")

    rarest = F.slice("nodes", F.lit(1), (F.col("n_nodes") - F.col("few") + 1).cast("int"))
    by_node = held.where("n_nodes >= few").select(F.col("gid").alias("u"), F.explode(rarest).alias("v"))
    by_pair = met.where("need > 0 and n >= need").select("u", "v")
    short = met.where("need > 0 and n < need")
    for end in ("u", "v"):
        short = short.join(held.select(F.col("gid").alias(end), F.col("n_nodes").alias(f"nodes_{end}")), end)
    by_both = short.where("n + least(nodes_u, nodes_v) >= need").select("u", "v")
    tied = scratch.cut("tied", by_pair.unionByName(by_both).unionByName(by_node))
    scratch.drop("met", "held")
    clustered = components(tied).withColumnsRenamed({"node": "gid", "component": "cluster"})

    # Groups to classes, and clusters of two or more classes to blocks.
    named = scratch.cut("named", groups.join(clustered, "gid", "left").select("p1", "p2", "n", F.coalesce("cluster", "gid").alias("cluster")))
    placed = scratch.cut("placed", classes.join(named, ["p1", "p2", "n"]).select("rep", "s1", "s2", "n", "size", "cluster"))
    scratch.drop("tied", "groups", "named")
    total = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles")).where("members > 1")
    large = (F.col("members") > BLOCK) | (F.col("shingles") > BLOCK_SHINGLES)
    wanted = placed.join(scratch.cut("clusters", total.select("cluster", large.alias("large"))), "cluster")
    # Sets of a ratio below the similarity cannot match: a large cluster is cut into bands of sizes first.
    band = F.when(F.col("large"), F.floor(F.log(F.col("n").cast("double")) / (math.log(den / num) * (1 + 1e-9)))).otherwise(0).cast("int")
    wanted = scratch.cut("banded", wanted.withColumn("band", band))
    scratch.drop("placed", "clusters")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("n_blocks")
    bands = scratch.cut("bands", wanted.groupBy("cluster", "band").agg(blocks))
    beside = bands.select("cluster", (F.col("band") + 1).alias("band"), F.col("n_blocks").alias("n_below"))
    above = bands.select("cluster", (F.col("band") - 1).alias("band"), F.col("n_blocks").alias("n_above"))
    bands = scratch.cut("beside", bands.join(beside, ["cluster", "band"], "left").join(above, ["cluster", "band"], "left").na.fill(0))
    wanted = wanted.drop("large").join(bands, ["cluster", "band"])
    wanted = scratch.cut("wanted", wanted.join(keys.select(F.col("tag").alias("rep"), "doc_id", "text_key"), "rep"))

    # Only texts that may be wanted are shuffled: a hash of their id and text is among those of the wanted ones.
    hashed = F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(64 * WORDS))
    bits = scratch.cut("bits", bitmap(wanted, hashed))
    likely = marked(texts.select("doc_id", "text_key", "text").withColumn("bucket", hashed), "bucket", bits)
    likely = likely.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "text")
    found = likely.join(wanted, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("text_key")))
    members = found.select("text", "s1", "s2", *_MEMBER).mapInArrow(
        _members(width), "rep long, cluster long, band int, n_blocks int, n_below int, n_above int, size long, shingles binary"
    )
    members = scratch.cut("members", members)
    weight = F.octet_length("shingles").cast("long")
    once, dealt = members.agg(F.sum(weight), F.sum(weight * (F.col("n_blocks") + F.col("n_below") + F.col("n_above")))).first()
    rounds = max(1, -(-(dealt or 0) // max(2 * (once or 0), ROUND)))

    def block(bands: str) -> Column:
        return F.sequence(F.lit(0), F.col(bands) - 1)

    def cells(low: Column, i: Column, high: Column, j: Column) -> Column:
        return F.struct(low.alias("low"), i.alias("i"), high.alias("high"), j.alias("j"))

    here, own = F.col("band"), F.col("block")
    none = F.array().cast("array<struct<low:int,i:int,high:int,j:int>>")
    met = F.concat(
        F.transform(block("n_blocks"), lambda x: cells(here, F.least(own, x), here, F.greatest(own, x))),
        F.when(F.col("n_above") > 0, F.transform(block("n_above"), lambda x: cells(here, own, here + 1, x))).otherwise(none),
        F.when(F.col("n_below") > 0, F.transform(block("n_below"), lambda x: cells(here - 1, x, here, own))).otherwise(none),
    )
    # A cell of a block and itself verifies the block, another one the pairs between its two blocks.
    cell = ["cluster", "low", "i", "high", "j"]

    def verified(turn: int) -> DataFrame:
        def due(c: Column) -> Column:
            return F.pmod(F.xxhash64("cluster", *(c[n] for n in cell[1:])), F.lit(rounds)) == turn

        placed = members.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("n_blocks")).cast("int"))
        placed = placed.withColumn("cell", F.explode(F.filter(met, due) if rounds > 1 else met))
        placed = placed.select("cluster", "cell.*", "rep", (here * (1 << 20) + own).alias("side"), "size", "shingles")
        return placed.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(_verify(num, den), "u long, v long, w long")

    links = scratch.cut("links", map(verified, range(rounds)))
    scratch.drop("banded", "bands", "beside", "wanted", "bits", "members")

    # Components, back to documents.
    degrees = links.where("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("w").alias("partners"))
    joined = components(links.where("v is not null").select("u", "v")).withColumnRenamed("node", "rep")
    full = classes.join(joined, "rep", "left").withColumn("component", F.coalesce("component", "rep")).join(degrees, "rep", "left")
    full = scratch.cut("full", full.select("s1", "s2", "n", "component", "size", F.coalesce("partners", F.lit(0)).alias("partners"), "low_id"))
    lowest = full.groupBy("component").agg(F.min("low_id").alias("component_id"))
    full = scratch.cut("labelled", full.join(lowest, "component"))
    scratch.drop("classes", "links", "full")
    plain = ["tag", "doc_id", "text_key", "n_chars", "n"]
    linked = keys.where("n > 0").select(*plain, "s1", "s2").join(full, ["s1", "s2", "n"])
    linked = linked.select(*plain, "component", "component_id", (F.col("partners") + F.col("size") - 1).alias("n_links"))
    empty = keys.where("n = 0").select(*plain, F.col("tag").alias("component"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    rows = scratch.cut("rows", linked.unionByName(empty))
    # The first row with the component's id; by its tag, so that repeated rows leave one.
    firsts = rows.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("component").alias("_c")).agg(F.min("tag").alias("_t"))
    firsts = scratch.cut("firsts", firsts)
    scratch.drop("keys", "labelled")
    kept = rows.join(firsts, (F.col("component") == F.col("_c")) & (F.col("tag") == F.col("_t")), "left")
    return kept.select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links", F.col("_t").isNotNull().alias("kept"), "text_key", "n_chars"
    )


def drop_near_copies(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest doc_id."""
    found = cut(near_duplicates(docs, width, num, den), "near")
    same = ["doc_id", "text_key", "n_chars"]
    repeats = found.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("stay"))
    kept = repeats.where("stay > 0").select(*same, (F.col("n") > F.col("stay")).alias("repeated"))
    return keep_rows(docs, cut(kept, "kept"))
