"""Phrase collocations from an FM-index per shard over word ids.

A shard is the texts of one language in one task, up to ``SHARD`` words. Its words get
ids, and its index is the Burrows-Wheeler transform of the id sequence and that of its
reverse, both from a suffix order of the first four words. A phrase is a pair of
intervals, one in each; extending it by a word on the left splits the first by the
words before it (the LF mapping) and narrows the second, and the other way round on
the right. So all phrases of a level are extended in a few sorts, with their counts.

The counts of all shards are summed by Spark, and levels are pruned by what holds over
the whole corpus, never by a shard's own counts. A phrase can reach ``least`` only if each
of its words does (words below it end pieces in the index), if each of its word pairs
does, and if the counts of all phrases of its hash do. So the indexes are written once and
read three times: for the sums of the pairs' hashes, for those of longer phrases of such
pairs, and for the exact sums of the phrases that are left. Hashes travel packed, an array
for each range of them; tasks learn which reach ``least`` from a bitmap of
``BITS`` bits, of the same size for any corpus. A hash that another phrase shares costs
time only, since the last sums are those of the phrases themselves.

Text is lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into
words ``[^\\x20\\x09]+``; null texts count as empty, a null language as ``und``. Repeated
rows count each time. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shuffleworks.llm.common import cut, whole_text

LONGEST = 4
LEAST = 30
SHARE = 80  # per cent of a phrase's places at which a longer one makes it redundant
TOP = 2000
SCALE = 2_000_000
SHARD = 250_000  # words in an index, but for a longer single text
HELD = 200_000  # different words that a task counts before it hands them on
BITS = 27
SLICE = 1 << 20  # bytes that are split at a time
EMIT = 50_000
CELLS = 1 << 20  # hashes that a task packs at a time
RANGES = 12  # the logarithm of the number of ranges that hashes are summed in; more for a corpus above
RANGE_WORDS = 1 << 23  # words a range
BREAK = b"."  # any of the characters that end a piece; no word has one
_MAP = bytes.maketrans(b",;:!?\n\x0b\x0c\r\t", b"." * 9 + b" ")


def slices(text: bytes) -> Iterator[list[bytes]]:
    """The words and breaks of a text, some at a time."""
    start = 0
    while start < len(text):
        end = start + SLICE
        if end < len(text):
            cuts = [c for c in (text.find(s, end) for s in (b" ", b"\t", b"\n", BREAK)) if c >= 0]
            end = min(cuts) if cuts else len(text)
        yield text[start:end].lower().translate(_MAP).replace(BREAK, b" . ").split()
        start = end


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield lang, text.as_py()


def _gram_batches(lang: str, phrases: pa.Array, counts: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(phrases), EMIT):
        part = phrases[i : i + EMIT]
        n = len(part)
        columns = [pa.array([lang] * n), part, pa.array(np.full(n, size, dtype=np.int32)), pa.array(counts[i : i + EMIT].astype(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "size", "f"])


GRAMS = "lang string, phrase binary, size int, f long"


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = {}

    def handed() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            counts.pop(BREAK, None)
            yield from _gram_batches(lang, pa.array(list(counts), pa.binary()), np.fromiter(counts.values(), np.int64, len(counts)), 1)
        held.clear()

    for lang, text in _texts(batches):
        counts = held.setdefault(lang, Counter())
        for words in slices(text):
            counts.update(words)
        if sum(map(len, held.values())) > HELD:
            yield from handed()
    yield from handed()


# --- which words and pairs are frequent -----------------------------------------------------


def bitmap(places: DataFrame, bits: int = BITS) -> bytes:
    """A bitmap of 2^bits bits in which those numbered in the one column are set."""
    at = F.col(places.columns[0]).bitwiseAND(F.lit((1 << bits) - 1)) + 1  # the bitmap functions count from 1
    rows = places.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    whole = bytearray(max(1 << bits >> 3, 4096))
    for row in rows.collect():  # at most 2^bits / 32768 rows of 4 KB
        start = (row["bucket"] - 1) * 4096
        whole[start : start + 4096] = row["bits"]
    return bytes(whole)


def word_places(words: DataFrame) -> DataFrame:
    return words.select(F.crc32(F.concat(F.col("lang").cast("binary"), F.lit(b"\x00"), "phrase")))


def likely(whole: bytes, lang: bytes, word: bytes, bits: int = BITS) -> bool:
    at = zlib.crc32(lang + b"\x00" + word) & ((1 << bits) - 1)
    return whole[at >> 3] >> (at & 7) & 1 == 1


def word_hashes(lang: str, names: pa.Array) -> np.ndarray:
    code = lang.encode() + b"\x00"
    return np.frombuffer(b"".join(hashlib.blake2b(code + n, digest_size=8).digest() for n in names.to_pylist()), np.uint64)


def hashed(words: np.ndarray, phrases: np.ndarray) -> np.ndarray:
    """64 bits for each phrase from those of its words, the same in every shard."""
    total = words[phrases[:, 0]]
    for column in phrases.T[1:]:
        total = (total ^ (total >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + words[column]
    total = (total ^ (total >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(29))


def _cells(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """The 32 bits that follow those of the range."""
    return ((hashes >> np.uint64(32 - ranges)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def in_bitmap(whole: bytes, hashes: np.ndarray, ranges: int, bits: int) -> np.ndarray:
    at = _cells(hashes, ranges) & np.uint32((1 << bits) - 1)
    return np.frombuffer(whole, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


PACKED = "bucket int, cells binary, counts binary"
_PACKED_SCHEMA = pa.schema([("bucket", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())])


def _packed(parts: Iterator[tuple[np.ndarray, np.ndarray]], ranges: int, held: int = CELLS) -> Iterator[pa.RecordBatch]:
    """Hashes and counts of some shards -> a row of cells and their counts for each range that has some."""

    def made() -> pa.RecordBatch:
        hashes, counts = (np.concatenate(p) for p in zip(*own))
        order = np.argsort(hashes)
        hashes, counts = hashes[order], counts[order]
        heads = np.flatnonzero(np.diff(hashes, prepend=~hashes[:1]))
        hashes, counts = hashes[heads], np.add.reduceat(counts, heads).astype(np.uint32)
        buckets = (hashes >> np.uint64(64 - ranges)).astype(np.int32)
        heads = np.flatnonzero(np.diff(buckets, prepend=-1))
        cuts = list(zip(heads, [*heads[1:], len(hashes)]))
        columns = [pa.array([of[i:j].tobytes() for i, j in cuts], pa.binary()) for of in (_cells(hashes, ranges), counts)]
        return pa.RecordBatch.from_arrays([pa.array(buckets[heads]), *columns], schema=_PACKED_SCHEMA)

    own, size = [], 0
    for part in parts:
        if len(part[0]):
            own.append(part)
            size += len(part[0])
        if size >= held:
            yield made()
            own, size = [], 0
    if own:
        yield made()


def _reaching(least: int):
    """Packed cells, those of a range one after the other -> the cells whose counts sum to ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
        for _, own in groupby(rows, lambda r: r[0]):
            parts = [(np.frombuffer(r[1], np.uint32), np.frombuffer(r[2], np.uint32)) for r in own]
            cells, counts = (np.concatenate(p) for p in zip(*parts))
            order = np.argsort(cells, kind="stable")
            cells, counts = cells[order], counts[order]
            heads = np.flatnonzero(np.diff(cells.astype(np.int64), prepend=-1))
            found = cells[heads][np.add.reduceat(counts.astype(np.int64), heads) >= least]
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64))], names=["cell"])

    return run


def reaching(packed: DataFrame, least: int, bits: int) -> bytes:
    """The bitmap of the cells that reach ``least`` over all shards. A range has one entry of a cell per shard, so none is large."""
    together = packed.repartition("bucket").sortWithinPartitions("bucket")
    return bitmap(together.mapInArrow(_reaching(least), "cell long"), bits)


# --- the index ------------------------------------------------------------------------------


def _ranked(keys: np.ndarray, top: int) -> np.ndarray:
    """The stable order of keys below ``top``; the place is sorted along with the key where both fit into 63 bits."""
    shift = len(keys).bit_length()
    if top << shift >= 1 << 63:
        return np.argsort(keys, kind="stable")
    return np.sort(keys << shift | np.arange(len(keys))) & ((1 << shift) - 1)


def _order(ids: np.ndarray) -> np.ndarray:
    """Places sorted by the four ids that start there, around the end."""
    rank = ids.astype(np.int64)
    for step in (1, 2):
        top = int(rank.max()) + 1
        keys = rank * top + np.roll(rank, -step)
        order = _ranked(keys, top * top)
        new = np.empty(len(keys), dtype=np.int64)
        new[order] = np.cumsum(np.diff(keys[order], prepend=keys[order[:1]]) != 0)
        rank = new
    return order


def transform(ids: np.ndarray) -> np.ndarray:
    """The id before each place, places in their order."""
    return ids[_order(ids) - 1]


class Index:
    """A shard's two transforms; id 0 is the end of a piece."""

    def __init__(self, left: np.ndarray, right: np.ndarray, size: int):
        self.size = size
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(left, minlength=size))])
        self.sides = [(side, self._steps(side)) for side in (left, right)]

    @staticmethod
    def _steps(side: np.ndarray) -> np.ndarray:
        """The LF mapping: where the place one word further out stands."""
        steps = np.empty(len(side), dtype=np.int32)
        steps[_ranked(side.astype(np.int64), len(side) + 1)] = np.arange(len(side), dtype=np.int32)
        return steps

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words: ids as a column, starts of their intervals (the same on both sides), counts."""
        ids = np.arange(1, self.size, dtype=np.int32)
        return ids[:, None], np.stack([self.starts[1:-1]] * 2), np.diff(self.starts)[1:]

    def extend(self, phrases: np.ndarray, starts: np.ndarray, counts: np.ndarray, side: int):
        """Every phrase by every word that stands before (side 0) or after (side 1) it in the shard."""
        letters, steps = self.sides[side]
        owner = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        first = np.cumsum(counts) - counts  # where an interval's places start in the list of all
        places = (starts[side] - first).astype(np.int32)[owner] + np.arange(len(owner), dtype=np.int32)
        keys = owner * np.int64(self.size) + letters[places]
        order = _ranked(keys, len(counts) * self.size)
        keys = keys[order]
        heads = np.flatnonzero(np.diff(keys, prepend=-1))
        sizes = np.diff(heads, append=len(keys))
        owners, added = keys[heads] // self.size, keys[heads] % self.size
        here = steps[places[order[heads]]]
        there = starts[1 - side][owners] + heads - first[owners]
        real = added > 0
        both = (here, there) if side == 0 else (there, here)
        grown = [added[:, None].astype(np.int32), phrases[owners]]
        return np.hstack(grown if side == 0 else grown[::-1])[real], np.stack(both)[:, real], sizes[real]


class _Ids(dict):
    """Word -> id in the shard; words that cannot be frequent end a piece like any break."""

    def __init__(self, lang: str, frequent: bytes, bits: int):
        super().__init__({BREAK: 0})
        self.lang, self.frequent, self.bits, self.names = lang.encode(), frequent, bits, [BREAK]

    def __missing__(self, word: bytes) -> int:
        if not likely(self.frequent, self.lang, word, self.bits):
            return 0  # not remembered: most different words are rare
        self[word] = len(self.names)
        self.names.append(word)
        return self[word]


INDEXES = "lang string, names array<binary>, before binary, after binary"
_INDEX_SCHEMA = pa.schema([("lang", pa.string()), ("names", pa.list_(pa.binary())), ("before", pa.binary()), ("after", pa.binary())])


def _width(size: int):
    return np.uint16 if size <= 1 << 16 else np.int32


def _build(frequent, bits: int, shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[_Ids, list[np.ndarray]]] = {}

        def made(lang: str) -> Iterator[pa.RecordBatch]:
            ids, parts = held.pop(lang)
            whole = np.concatenate([np.zeros(1, np.int32), *parts])
            whole = whole[(whole > 0) | (np.roll(whole, 1) > 0)]  # one break between pieces
            if len(ids.names) > 1:
                sides = [transform(of).astype(_width(len(ids.names))).tobytes() for of in (whole, whole[::-1])]
                row = {"lang": lang, "names": ids.names, "before": sides[0], "after": sides[1]}
                yield pa.RecordBatch.from_pylist([row], _INDEX_SCHEMA)

        for lang, text in _texts(batches):
            if lang not in held:
                held[lang] = (_Ids(lang, frequent.value, bits), [])
            ids, parts = held[lang]
            parts.extend(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)) for words in slices(text))
            parts.append(np.zeros(1, np.int32))
            if len(parts) % 64 == 0 and sum(map(len, parts)) >= shard:
                yield from made(lang)
        for lang in list(held):
            yield from made(lang)

    return run


def indexes(docs: DataFrame, frequent: bytes, bits: int = BITS, shard: int = SHARD) -> DataFrame:
    """One row per shard: its language, its words by id, the transforms of its ids and of their reverse."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)
    return docs.mapInArrow(_build(sent, bits, shard), INDEXES)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, np.ndarray, Index]]:
    """Language, words, their hashes and the index of each shard."""
    for batch in batches:
        for row in range(batch.num_rows):
            lang, names = batch.column(0)[row].as_py(), batch.column(1)[row].values
            sides = [np.frombuffer(batch.column(c)[row].as_py(), _width(len(names))) for c in (2, 3)]
            yield lang, names, word_hashes(lang, names), Index(*sides, len(names))


def _joined(names: pa.Array, phrases: np.ndarray) -> pa.Array:
    return pc.binary_join_element_wise(*[names.take(pa.array(column)) for column in phrases.T], pa.scalar(b" ", names.type))


def _pair_cells(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for _, _, words, index in _opened(batches):
                phrases, _, counts = index.extend(*index.words(), side=0)
                yield hashed(words, phrases), counts

        yield from _packed(parts(), ranges)

    return run


def _levels(index: Index, words: np.ndarray, pairs, keep) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Phrases, hashes and counts of two to four words whose pairs ``pairs`` holds by their hashes; ``keep`` says which longer ones go on."""
    found = index.words()
    for size in range(2, LONGEST + 1):
        side = size % 2  # a pair to the left, then to the right, then to the left
        found = index.extend(*found, side)
        good = pairs(hashed(words, found[0][:, -2:] if side else found[0][:, :2]))
        found = found[0][good], found[1][:, good], found[2][good]
        hashes = hashed(words, found[0])
        if size > 2 and keep:
            good = keep(hashes)
            found, hashes = (found[0][good], found[1][:, good], found[2][good]), hashes[good]
        yield found[0], hashes, found[2]


def _longer_cells(pairs, ranges: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for _, _, words, index in _opened(batches):
                for phrases, hashes, counts in _levels(index, words, lambda h: in_bitmap(pairs.value, h, ranges, bits), None):
                    if phrases.shape[1] > 2:
                        yield hashes, counts

        yield from _packed(parts(), ranges)

    return run


def _phrases(pairs, longer, ranges: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, names, words, index in _opened(batches):
            levels = _levels(index, words, *[lambda h, of=of: in_bitmap(of.value, h, ranges, bits) for of in (pairs, longer)])
            for phrases, _, counts in levels:
                yield from _gram_batches(lang, _joined(names, phrases), counts, phrases.shape[1])

    return run


# --- over all shards ------------------------------------------------------------------------


def _summed(parts: DataFrame, name: str, least: int = 0) -> DataFrame:
    total = parts.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f"))
    return cut(total.where(F.col("f") >= least), name)


def count_phrases(docs: DataFrame, least: int = LEAST, bits: int = BITS, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """All phrases of up to four words with at least ``least`` places (lang, phrase, size, f), and all words of each language (lang, n)."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), whole_text().cast("binary").alias("text"))
    words = _summed(texts.mapInArrow(_count_words, GRAMS), "phrase_words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    ranges = ranges_for(words.agg(F.sum("f")).first()[0] or 0)
    common = words.where(F.col("f") >= least)
    # A row holds megabytes: pages are closed after each row, or a hundred of them would be compressed as one.
    pages = {f"parquet.{unit}.size.row.check.{end}": "1" for unit in ("page", "block") for end in ("min", "max")}
    built = cut(indexes(texts, bitmap(word_places(common), bits), bits, shard), "phrase_indexes", compression="zstd", **pages)
    send = docs.sparkSession.sparkContext.broadcast
    pairs = send(reaching(built.mapInArrow(_pair_cells(ranges), PACKED), least, bits))
    longer = send(reaching(built.mapInArrow(_longer_cells(pairs, ranges, bits), PACKED), least, bits))
    found = _summed(built.mapInArrow(_phrases(pairs, longer, ranges, bits), GRAMS), "phrases", least)
    return common.unionByName(found), totals


def ranges_for(words: int) -> int:
    """The logarithm of the number of hash ranges for a corpus of so many words."""
    return max(RANGES, min(20, math.ceil(math.log2(max(words / RANGE_WORDS, 1)))))


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int | None = TOP, bits: int = BITS, shard: int = SHARD) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a (its places), l and r (those of its parts at the worst cut), n (words), score.

    The score is ``floor(2000000 a / (l + r))`` of the cut that makes it least, of equal ones the first. A phrase goes if one
    with a word more has ``share`` per cent of its places; phrases with more words need no look, since what stands between has as many.
    """
    grams, totals = count_phrases(docs, least, bits, shard)
    grams = grams.withColumn("phrase", F.col("phrase").cast("string"))
    found = grams.where("size > 1")
    cuts = found.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumn("head", F.expr("substring_index(phrase, ' ', k)")).withColumn("tail", F.expr("substring(phrase, length(head) + 2)"))
    parts = [grams.select("lang", F.col("phrase").alias(side), F.col("f").alias(count)) for side, count in (("head", "l"), ("tail", "r"))]
    cuts = cuts.join(parts[0], ["lang", "head"]).join(parts[1], ["lang", "tail"])
    cuts = cuts.withColumn("score", F.expr(f"(cast(a as decimal(20, 0)) * {SCALE}) div (cast(l as decimal(20, 0)) + r)"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = [F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring(phrase, length(substring_index(phrase, ' ', 1)) + 2)")]
    wider = grams.where("size > 2").select("lang", F.explode(F.array(*inner)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("wider"))
    kept = scored.join(wider, ["lang", "phrase"], "left").where(f"wider is null or cast(wider as decimal(20, 0)) * 100 < cast(a as decimal(20, 0)) * {share}")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    ranked = kept.withColumn("rank", place)
    ranked = ranked.where(F.col("rank") <= top) if top else ranked
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score")
    )


def sql(documents: str = "documents", least: int = LEAST, share: int = SHARE, top: int = TOP) -> str:
    """DuckDB SQL for the same result."""
    capitals, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH p AS (SELECT coalesce(lang, 'und') AS lang,
                      unnest(regexp_split_to_array(translate(coalesce(text, ''), '{capitals}', '{small}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM {documents}),
    w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
    s AS (SELECT lang, w, unnest(range(1, {LONGEST + 1})) AS size FROM w),
    g AS (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase FROM s),
    f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL),
    n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
    c AS (SELECT lang, phrase, string_split(phrase, ' ') AS w, size, f AS a FROM f WHERE size > 1 AND f >= {least}),
    k AS (SELECT *, unnest(range(1, size)) AS k FROM c),
    v AS (SELECT k.lang, k.phrase, a, k, x.f AS l, y.f AS r, ({SCALE}::HUGEINT * a // (x.f::HUGEINT + y.f))::BIGINT AS score
          FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(w[1:k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(w[k + 1:], ' ')),
    b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    i AS (SELECT DISTINCT z.lang, inner_phrase FROM (
          SELECT lang, a AS longer, unnest(flatten(list_transform(range(2, size), lambda m: list_transform(range(1, size - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))))) AS inner_phrase
          FROM c) z JOIN f ON f.lang = z.lang AND f.phrase = z.inner_phrase WHERE 100 * longer >= {share} * f.f),
    o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank
          FROM b ANTI JOIN i ON i.lang = b.lang AND i.inner_phrase = b.phrase)
    SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN n ON n.lang = o.lang WHERE rank <= {top}
    """
