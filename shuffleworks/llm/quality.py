"""Quality classifier: naive Bayes support vectors over word n-gram indicators.

A text's features are which words, runs of other signs and pairs of these it has, case
kept, and how large a share repeats the token one or two before, as buckets of a hash. Each is scaled by its class log-count ratio, texts are
brought to length one, and a linear model with hinge loss is fitted by dual coordinate
descent. The score is the logistic function of the margin, so 0.5 is where the model
changes its mind.

Training takes at most ``SAMPLE`` labelled rows of either class, those of the smallest
hash of their doc_id, never of the held-out fold, in one task. Both classes are counted
over all rows that could be learnt from, and each sampled row weighs, in counts and loss,
as many of its class as it stands for, so that a score means the same whether the bound
is reached or not. Scoring covers every row and its whole text; the model is two numbers
per bucket, of one size for any corpus.

Null texts count as empty; a text without known features gets the score of the bias alone.
Rows of ``labels`` with a null are left out; a doc_id with several labels has the least of
them. Labelled ids without a document are ignored; of several rows of a doc_id the least
text is learnt from, once. Without training rows every score is 0.5. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shuffleworks.llm.common import whole_text

SAMPLE = 4000  # labelled rows of either class that are learnt from
BITS = 21  # of the hash that says a feature's bucket
SMOOTH = 1.0
PENALTY = 1.0  # upper bound of a dual variable, for a row of mean weight
EPOCHS = 40
GAP = 1e-3  # largest violation at which the descent ends
SLOPE = 3.0
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.5
CACHE = 400_000
TOKEN = re.compile(r"\w+|[^\w\s]+")


class Hashes(dict):
    """Token -> 64 bits, remembered up to a bound."""

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[token] = int.from_bytes(hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return self[token]


def features(text: str, hashes: Hashes) -> np.ndarray:
    """The buckets of a text's tokens, neighbouring pairs and shares of repeats, each once."""
    tokens = TOKEN.findall(text)
    one = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    # How much of the text says again what stood one or two tokens before, in eighths: an indicator each.
    again = [hashes[f"\n{lag} {8 * np.count_nonzero(one[lag:] == one[:-lag]) // len(one[lag:])}"] for lag in (1, 2) if len(one) > lag]
    two = (one[:-1] ^ (one[1:] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + one[1:]
    return np.unique(np.concatenate([one, two, np.array(again, np.uint64)]) >> np.uint64(64 - BITS)).astype(np.int32)


def log_ratios(rows: list[np.ndarray], label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Each bucket's log ratio of its shares of all indicators in class 1 and in class 0; 0 for buckets never seen."""
    counts = np.zeros((2, 1 << BITS))
    for own, c, w in zip(rows, label, weight):
        counts[c, own] += w
    seen = counts.sum(axis=0) > 0
    smooth = counts + SMOOTH
    shares = np.log(smooth) - np.log(np.where(seen, smooth, 0).sum(axis=1, keepdims=True))
    return np.where(seen, shares[1] - shares[0], 0.0)


def descend(rows: list[np.ndarray], values: list[np.ndarray], sign: np.ndarray, bound: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and dual variables of the hinge-loss model; the bias is the weight of a constant feature."""
    weights, bias = np.zeros(1 << BITS), 0.0
    dual = np.zeros(len(rows))
    norms = np.array([v @ v + 1 for v in values])
    rng = np.random.default_rng(1)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            slope = sign[i] * (weights[rows[i]] @ values[i] + bias) - 1
            moved = min(max(dual[i] - slope / norms[i], 0.0), bound[i])
            step = (moved - dual[i]) * sign[i]
            if step:
                worst = max(worst, abs(step) * norms[i])
                weights[rows[i]] += step * values[i]
                bias += step
                dual[i] = moved
        if worst < GAP:
            break
    return weights, bias, dual


def scaled(own: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    values = ratios[own]
    length = math.sqrt(values @ values)
    return values / length if length else values


def fit(texts: list[str], label: np.ndarray, stands_for: tuple[float, float] = (1.0, 1.0)) -> tuple[np.ndarray, np.ndarray, float]:
    """Log ratios, weights and bias; a row of class c weighs ``stands_for[c]``."""
    hashes = Hashes()
    rows = [features(t, hashes) for t in texts]
    weight = np.array(stands_for)[label]
    weight = weight / weight.mean()
    ratios = log_ratios(rows, label, weight)
    values = [scaled(own, ratios) for own in rows]
    weights, bias, _ = descend(rows, values, 2.0 * label - 1, PENALTY * weight)
    return ratios, weights, bias


def margin(own: np.ndarray, ratios: np.ndarray, weights: np.ndarray, bias: float) -> float:
    return float(weights[own] @ scaled(own, ratios)) + bias


# --- the Spark side -------------------------------------------------------------------------


def held_out(ident: Column) -> Column:
    """Whether the row belongs to the fold that labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(ident.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def open_labels(labels: DataFrame) -> DataFrame:
    """doc_id and quality of all rows that may be learnt from."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    return known.agg(F.min("quality").cast("int").alias("quality")).where(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1))


def _train(totals: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["doc_id"], r["quality"], r["text"]) for batch in batches for r in batch.to_pylist())
        if rows:
            label = np.array([r[1] for r in rows])
            stands_for = tuple(totals.get(c, 0) / max(1, int((label == c).sum())) for c in (0, 1))
            ratios, weights, bias = fit([r[2] for r in rows], label, stands_for)
            tables = [t.astype(np.float32).tobytes() for t in (ratios, weights)]
            yield pa.RecordBatch.from_pylist([{"ratios": tables[0], "weights": tables[1], "bias": bias}])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[bytes, bytes, float] | None:
    """Log ratios and weights of all buckets, and the bias."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    there = open_labels(labels).join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    totals = {r["quality"]: r["n"] for r in there.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per class
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = there.where("quality = 1").orderBy(*order).limit(sample).unionByName(there.where("quality = 0").orderBy(*order).limit(sample))
    # At most 2 * sample rows of two numbers are broadcast; one row per id reaches the one task, however often the id is there.
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).repartition(1)
    found = rows.mapInArrow(_train(totals), "ratios binary, weights binary, bias double").collect()
    return (bytes(found[0]["ratios"]), bytes(found[0]["weights"]), found[0]["bias"]) if found else None


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        if model.value:
            ratios, weights = (np.frombuffer(t, np.float32) for t in model.value[:2])
        for batch in batches:
            scores = []
            for value in batch.column(1):
                found = margin(features(value.as_py(), hashes), ratios, weights, model.value[2]) if model.value else 0.0
                scores.append(1 / (1 + math.exp(-SLOPE * found)) if found > -200 else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    scored = texts.mapInArrow(_score(sent), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
