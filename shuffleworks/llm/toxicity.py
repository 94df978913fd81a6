"""Toxicity: averaged subword-bag embeddings under a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams (and of the
whole word), each found by its hash in a table of fixed size; a text's vector is
the mean over its distinct words and a few empty ones; a linear softmax over two
classes gives the score. Both layers are trained together, so a misspelling that
was never seen still has the vectors of the n-grams it shares with known words.

Training takes at most ``SAMPLE`` labelled rows of either class, those of the
smallest hash of their doc_id, never of the held-out fold; it runs in one task.
Both classes are counted over all rows that could be learnt from, and each sampled
row weighs as many of its class as it stands for, so that a score and the threshold
mean the same whether the bound is reached or not.
Scoring covers every row and its whole text. As both layers are linear, a word's
share of the score is one number, which a task remembers.

Null texts count as empty; a text without words gets the score of the bias alone.
Rows of ``labels`` with a null are left out; a doc_id with several labels is toxic
if one says so. Labelled ids without a document are ignored; of several rows of a
doc_id the least text is learnt from, once. Without any training
rows every score is 0. Extra columns are ignored by ``score`` and kept by ``keep_clean``.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shuffleworks.llm.common import fresh, whole_text

SAMPLE = 3000  # labelled rows of either class that are learnt from
BUCKETS = 1 << 20
WIDTH = 8
GRAMS = (3, 4, 5)
SCREEN = 4.0  # standard errors between the classes from which an n-gram gets a vector
PAD = 20  # words without a vector in every mean, so that no single word decides on a short text
STEPS = 150
RATE = 0.1
DECAY = 1e-6
HELD_OUT = 2  # remainder by 4 of the crc32 of the id
THRESHOLD = 0.3
CACHE = 400_000
CELLS = 1 << 16  # cells of a sparse matrix that are multiplied at once
WORD = re.compile(r"\w+")


def grams(word: str) -> list[int]:
    """Buckets of the word's n-grams, its ends marked, and of the whole word."""
    marked = f"<{word}>"
    parts = [marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)] or [marked]
    return [zlib.crc32(p.encode("utf-8", "replace")) % BUCKETS for p in parts] + [zlib.crc32(marked.encode("utf-8", "replace"), 1) % BUCKETS]


def held_out(ident: Column) -> Column:
    """Whether the row belongs to the fold that labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(ident.cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(False))


def open_labels(labels: DataFrame) -> DataFrame:
    """doc_id and toxic of all rows that may be learnt from."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    return known.agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out(F.col("doc_id")))


def training_ids(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id and toxic of at most ``sample`` rows of either class."""
    open_rows = open_labels(labels)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    return open_rows.where("toxic = 1").orderBy(*order).limit(sample).unionByName(open_rows.where("toxic = 0").orderBy(*order).limit(sample))


class _Sums:
    """A sparse matrix: its product with a dense one, and that of its transpose, some whole rows of cells at a time."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, shape: tuple[int, int]):
        self.parts = []
        for a, b, n in ((rows, columns, shape[0]), (columns, rows, shape[1])):
            order = np.argsort(a, kind="stable")
            there, starts = np.unique(a[order], return_index=True)
            ends = np.append(starts[1:], len(order))
            cuts = [0]  # a row of more cells than CELLS goes alone
            while cuts[-1] < len(there):
                cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, starts[cuts[-1]] + CELLS, "right"))))
            self.parts.append((b[order], values[order][:, None].astype(np.float32), there, starts, ends, cuts, n))

    def dot(self, dense: np.ndarray, transposed: bool = False) -> np.ndarray:
        other, values, there, starts, ends, cuts, n = self.parts[transposed]
        out = np.zeros((n, dense.shape[1]), dtype=np.float32)
        for a, b in zip(cuts, cuts[1:]):
            low, high = starts[a], ends[b - 1]
            out[there[a:b]] = np.add.reduceat(dense[other[low:high]] * values[low:high], starts[a:b] - low, axis=0)
        return out


def bag(text: str) -> dict[str, None]:
    """The different words of a text, in the order in which they come first."""
    return dict.fromkeys(WORD.findall(text.lower()))


def _bags(texts: Iterable[str]) -> tuple[list[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct words as numbers; the buckets of all numbers in a row, and where each number's end."""
    index: dict[str, int] = {}
    bags = [np.array([index.setdefault(w, len(index)) for w in bag(t)], dtype=np.int32) for t in texts]
    buckets, ends = array("i"), array("q", [0])
    for word in index:
        buckets.extend(grams(word))
        ends.append(len(buckets))
    return bags, (np.frombuffer(buckets, np.int32) if buckets else np.zeros(0, np.int32), np.frombuffer(ends, np.int64))


def _buckets(bag: np.ndarray, parts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text and their weights in its mean."""
    if not len(bag):
        return np.zeros(0, np.int32), np.zeros(0)
    buckets, ends = parts
    own = [buckets[a:b] for a, b in zip(ends[bag], ends[bag + 1])]
    shares = np.repeat([1 / len(p) / (len(bag) + PAD) for p in own], [len(p) for p in own])
    there, inverse = np.unique(np.concatenate(own), return_inverse=True)
    return there, np.bincount(inverse, shares, len(there))


def fit(texts: Iterable[str], toxic: np.ndarray, steps: int = STEPS, stands_for: tuple[float, float] = (1.0, 1.0)) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets with a vector, their vectors, softmax weights and biases.

    Texts are read once, one after the other, and not kept.
    A text of class c weighs ``stands_for[c]`` in the loss and in the class shares.

    An n-gram that is about as frequent in both classes keeps the zero vector.
    The others and the softmax over the mean are trained together by Adam.
    """
    bags, parts = _bags(texts)
    n = np.array([(toxic == 0).sum(), (toxic == 1).sum()])
    seen = np.zeros((2, BUCKETS), dtype=np.int32)
    for bag, label in zip(bags, toxic):
        seen[label, _buckets(bag, parts)[0]] += 1
    there = np.flatnonzero(seen.any(axis=0))
    seen = seen[:, there]
    both = seen.sum(axis=0) / len(toxic)
    error = np.sqrt(np.maximum(both * (1 - both), 1e-9) * (1 / np.maximum(n, 1)).sum())
    active = there[np.abs(seen[1] / max(n[1], 1) - seen[0] / max(n[0], 1)) > SCREEN * error]
    place = np.full(BUCKETS, -1, dtype=np.int32)
    place[active] = np.arange(len(active))
    cells = []
    for row, bag in enumerate(bags):
        there, weights = _buckets(bag, parts)
        kept = place[there] >= 0
        cells.append((np.full(kept.sum(), row, np.int32), place[there[kept]], weights[kept].astype(np.float32)))
    del bags, parts, place, seen  # the rounds need the cells only
    means = _Sums(*(np.concatenate(c) for c in zip(*cells)), (len(toxic), len(active)))
    del cells
    rng = np.random.default_rng(1)
    params = [np.zeros((len(active), WIDTH), np.float32), rng.normal(0, 1, (WIDTH, 2)).astype(np.float32)]
    shares = n * np.array(stands_for)
    params.append(np.log((shares + 1) / (shares.sum() + 2)).astype(np.float32))
    weight = (np.array(stands_for)[toxic] / shares.sum()).astype(np.float32)[:, None]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    target = np.eye(2, dtype=np.float32)[toxic]
    for step in range(1, steps + 1):
        hidden = means.dot(params[0])
        logits = hidden @ params[1] + params[2]
        odds = np.exp(logits - logits.max(axis=1, keepdims=True))
        wrong = (odds / odds.sum(axis=1, keepdims=True) - target) * weight
        slopes = [means.dot(wrong @ params[1].T, transposed=True) + DECAY * params[0], hidden.T @ wrong, wrong.sum(axis=0)]
        for p, (first, second), slope in zip(params, moments, slopes):
            first += 0.1 * (slope - first)
            second += 0.001 * (slope * slope - second)
            p -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return active, *params


def _train(totals: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Texts stay as bytes: a Python text with one far character takes four bytes a letter. There is one row per doc_id.
        rows = sorted(row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "toxic")), batch.column("text").cast(pa.binary()).to_pylist()))
        if rows:
            toxic = np.array([r[1] for r in rows])
            stands_for = tuple(totals.get(c, 0) / max(1, int((toxic == c).sum())) for c in (0, 1))
            texts = (rows.pop()[2].decode() for _ in range(len(rows)))
            rows.reverse()  # so that each text goes once it is read
            active, vectors, weights, bias = fit(texts, toxic, stands_for=stands_for)
            # Two classes: only the difference of their logits counts, and it is linear in the n-grams.
            shares = (vectors @ (weights[:, 1] - weights[:, 0])).astype(float)
            yield pa.RecordBatch.from_pylist([{"buckets": active.tolist(), "shares": shares.tolist(), "bias": float(bias[1] - bias[0])}])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[int, float], float] | None:
    """Each bucket's share of the logit, at most one per bucket, and the bias."""
    chosen = training_ids(labels, sample)  # at most 2 * sample rows of two numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    # Labels without a document are learnt from at no size, so they do not count either.
    ids = texts.select("doc_id").distinct()
    counts = open_labels(labels).join(ids, "doc_id", "left_semi").groupBy("toxic").agg(F.count(F.lit(1)).alias("n"))
    totals = {r["toxic"]: r["n"] for r in counts.collect()}  # one row per class
    # One row per id before the one task: the least text, however often the id is there.
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).repartition(1)
    found = rows.mapInArrow(_train(totals), "buckets array<long>, shares array<double>, bias double").collect()
    return (dict(zip(found[0]["buckets"], found[0]["shares"])), found[0]["bias"]) if found else None


class _Shares(dict):
    """A word -> the mean share of its n-grams in the logit."""

    def __init__(self, shares: dict[int, float]):
        super().__init__()
        self.share = shares

    def __missing__(self, word: str) -> float:
        buckets = grams(word)
        if len(self) >= CACHE:
            self.clear()
        self[word] = sum([self.share.get(b, 0.0) for b in buckets]) / len(buckets)
        return self[word]


def _score(model, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares = _Shares(model.value[0]) if model.value else None
        for batch in batches:
            names, scores = batch.schema.names, []
            for value in batch.column(len(names) - 1):  # the text to be scored comes last
                if shares is None:
                    scores.append(0.0)
                    continue
                words = bag(value.as_py())
                logit = sum(map(shares.__getitem__, words)) / (len(words) + PAD) + model.value[1]
                scores.append(1 / (1 + math.exp(-logit)) if logit > -700 else 0.0)
            own = [batch.column(i) for i in range(len(names) - 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(scores, pa.float64())], names=[*names[:-1], name])

    return run


def with_score(rows: DataFrame, model: tuple[dict[int, float], float] | None, text: Column, name: str = "score") -> DataFrame:
    """``rows`` with the score of ``text`` as their last column."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())])
    return rows.withColumn(fresh(rows, "_scored_text"), text).mapInArrow(_score(sent, name), schema)


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    model = train(docs, labels, sample)
    ident = F.col("doc_id").cast("long").alias("doc_id")
    scored = with_score(docs.select(ident, whole_text().alias("_t")), model, F.col("_t"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` below the threshold, with their columns."""
    name = fresh(docs, "_toxicity")
    scored = with_score(docs, train(docs, labels, sample), whole_text(), name)
    return scored.where(F.col(name) < threshold).select(*docs.columns)
