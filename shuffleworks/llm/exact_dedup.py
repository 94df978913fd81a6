"""Exact deduplication by composable polynomial fingerprints.

A text without its white space is a polynomial over its bytes, taken modulo two
primes of 31 bits. Fingerprints compose: ``h(ab) = h(a) * B**len(b) + h(b)``, so
a text is hashed chunk by chunk. The chunks of a huge text are dealt out to
other tasks, and each of their hashes, shifted by the number of bytes after it,
is summed up by Spark. Texts of equal fingerprint and length are then compared
chunk by chunk: the least and the greatest chunk at each place must agree, which
needs one chunk in memory and is combined before the shuffle, so a group of
millions of copies costs each task one chunk per place.

Null texts count as empty; empty texts equal one another. Of rows that tie in
length and doc_id (null ids last) the first written stays, so exactly one row of
a group is kept. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shuffleworks.llm.common import SPACE, cut, keep_rows, whole_text

CHUNK = 1 << 16  # bytes that are hashed or compared at once
HUGE = 1 << 23  # bytes above which chunks go to other tasks
MODULI = (2147483647, 2147483629)
BASES = (1103515245, 1220703125)
KEY = ["h1", "h2", "n_bytes"]


def powers(base: int, modulus: int, n: int) -> np.ndarray:
    """``base ** k mod modulus`` for k from n - 1 down to 0."""
    out = np.ones(n, dtype=np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, modulus)) % np.uint64(modulus)
        done += step
    return out[::-1].copy()


class Hasher:
    """Fingerprints of byte strings; ``modulus`` below the default makes collisions, for tests."""

    def __init__(self, chunk: int = CHUNK, moduli: tuple[int, int] = MODULI):
        self.chunk, self.moduli = chunk, moduli
        self.tables = [powers(b % m, m, chunk) for b, m in zip(BASES, moduli)]

    def piece(self, data: bytes) -> tuple[int, ...]:
        """Of at most one chunk: products stay below 2**39, their sum below 2**55."""
        values = np.frombuffer(data, dtype=np.uint8).astype(np.uint64)
        return tuple(int(np.dot(values, t[self.chunk - len(values) :]) % np.uint64(m)) for t, m in zip(self.tables, self.moduli))

    def shift(self, hashes: tuple[int, ...], after: int) -> tuple[int, ...]:
        """The share of a part that ``after`` bytes follow."""
        return tuple(h * pow(b, after, m) % m for h, b, m in zip(hashes, BASES, self.moduli))

    def whole(self, data: bytes) -> tuple[int, ...]:
        total = (0, 0)
        for at in range(0, len(data), self.chunk):
            part = data[at : at + self.chunk]
            total = tuple((a + b) % m for a, b, m in zip(self.shift(total, len(part)), self.piece(part), self.moduli))
        return total


def _bytes(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    for value in batch.column(name).cast(pa.binary()):
        yield value.as_py().translate(None, SPACE)


_PIECES = "tag long, doc_id long, n_chars long, text_key long, text_sha256 string, n_bytes long, h1 long, h2 long, after long, piece binary"


def _split(chunk: int, huge: int, moduli: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(chunk, moduli)
        schema = pa.schema(
            [("tag", pa.int64()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("text_key", pa.int64()), ("text_sha256", pa.string())]
            + [(n, pa.int64()) for n in ("n_bytes", "h1", "h2", "after")]
            + [("piece", pa.binary())]
        )
        for batch in batches:
            head = [batch.column(n).to_pylist() for n in ("tag", "doc_id", "n_chars", "text_key")]
            rows: list[tuple] = []
            for *ids, data in zip(*head, _bytes(batch)):
                own = (*ids, hashlib.sha256(data).hexdigest(), len(data))
                if len(data) <= huge:
                    rows.append((*own, *hasher.whole(data), 0, None))
                    continue
                for at in range(0, len(data), chunk):
                    part = data[at : at + chunk]
                    rows.append((*own, None, None, len(data) - at - len(part), part))
                    if len(rows) * chunk >= huge:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return run


def _hash_pieces(chunk: int, moduli: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(chunk, moduli)
        for batch in batches:
            shares = [hasher.shift(hasher.piece(p), a) for p, a in zip(batch.column("piece").to_pylist(), batch.column("after").to_pylist())]
            kept = [batch.column(n) for n in ("tag", "doc_id", "n_chars", "text_key", "text_sha256", "n_bytes")]
            values = [pa.array([s[k] for s in shares], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(kept + values, names=["tag", "doc_id", "n_chars", "text_key", "text_sha256", "n_bytes", "h1", "h2"])

    return run


def fingerprints(docs: DataFrame, chunk: int = CHUNK, huge: int = HUGE, moduli: tuple[int, int] = MODULI) -> DataFrame:
    """Per row: tag (unique), doc_id, n_chars, text_key, text_sha256, n_bytes, h1, h2. Written once."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("tag"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.length(whole_text()).cast("long").alias("n_chars"),
        F.xxhash64(whole_text()).alias("text_key"),
        whole_text().alias("text"),
    )
    pieces = cut(rows.mapInArrow(_split(chunk, huge, moduli), _PIECES), "pieces")
    own = ["tag", "doc_id", "n_chars", "text_key", "text_sha256", "n_bytes"]
    plain = pieces.where("piece is null").select(*own, "h1", "h2")
    long = pieces.where("piece is not null")
    if long.isEmpty():
        return plain
    shares = long.repartition("tag", "after").mapInArrow(
        _hash_pieces(chunk, moduli), "tag long, doc_id long, n_chars long, text_key long, text_sha256 string, n_bytes long, h1 long, h2 long"
    )
    summed = shares.groupBy(*own).agg(*[F.pmod(F.sum(h), F.lit(m)).alias(h) for h, m in zip(("h1", "h2"), moduli)])
    return cut(plain.unionByName(summed), "fingerprints")


def _chunks(chunk: int, moduli: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(chunk, moduli)
        schema = pa.schema([(n, pa.int64()) for n in (*KEY, "place")] + [("chunk", pa.binary())])
        for batch in batches:
            for data in _bytes(batch):
                key = (*hasher.whole(data), len(data))
                parts = [data[at : at + chunk] for at in range(0, len(data), chunk)]
                columns = [pa.array([k] * len(parts), pa.int64()) for k in key]
                places = pa.array(range(len(parts)), pa.int64())
                yield pa.RecordBatch.from_arrays([*columns, places, pa.array(parts, pa.binary())], schema=schema)

    return run


def unequal(docs: DataFrame, prints: DataFrame, groups: DataFrame, chunk: int = CHUNK, moduli: tuple[int, int] = MODULI) -> DataFrame:
    """Keys under which texts differ, found by comparing all texts of groups of two or more."""
    members = prints.join(groups.where("group_size > 1"), KEY, "left_semi").select(F.col("doc_id").alias("_member")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    texts = texts.join(members, F.col("doc_id").eqNullSafe(F.col("_member")), "left_semi").select("text")
    parts = texts.mapInArrow(_chunks(chunk, moduli), "h1 long, h2 long, n_bytes long, place long, chunk binary")
    ends = parts.groupBy(*KEY, "place").agg(F.min("chunk").alias("least"), F.max("chunk").alias("greatest"))
    return ends.where("least <> greatest").select(*KEY).distinct()


def exact_duplicates(docs: DataFrame, chunk: int = CHUNK, huge: int = HUGE, moduli: tuple[int, int] = MODULI) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_chars, text_key.

    Of equal texts the row with the most code points stays, then the smallest doc_id.
    """
    prints = fingerprints(docs, chunk, huge, moduli)
    sizes = cut(prints.groupBy(*KEY).agg(F.count(F.lit(1)).alias("group_size")), "sizes")
    bad = cut(unequal(docs, prints, sizes, chunk, moduli), "unequal").withColumn("differ", F.lit(True))
    # A key under which texts differ is split by the digests of the texts.
    keyed = prints.join(bad, KEY, "left").withColumn("part", F.when(F.col("differ"), F.col("text_sha256")).otherwise("")).drop("differ")
    order = F.struct("n_chars", F.col("doc_id").isNotNull().alias("has"), F.bitwise_not("doc_id").alias("id"), F.bitwise_not("tag").alias("tag"))
    groups = keyed.groupBy(*KEY, "part").agg(F.count(F.lit(1)).alias("group_size"), F.max(order).alias("best"))
    groups = groups.select(
        *KEY, "part", "group_size", F.bitwise_not("best.id").alias("keep_id"), F.bitwise_not("best.tag").alias("keep_tag")
    )
    result = keyed.join(cut(groups, "groups"), [*KEY, "part"])
    return result.select(
        "doc_id", "keep_id", "group_size", (F.col("tag") == F.col("keep_tag")).alias("kept"), "text_sha256", "n_chars", "text_key"
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts."""
    found = cut(exact_duplicates(docs), "copies")
    same = ["doc_id", "text_key", "n_chars"]
    repeats = found.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.bool_or("kept").alias("kept"))
    return keep_rows(docs, cut(repeats.where("kept").select(*same, (F.col("n") > 1).alias("repeated")), "kept"))
