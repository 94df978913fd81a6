"""Masked pseudo-likelihood of documents under a bidirectional window network.

Every token is predicted from the ``SPAN`` tokens before and after it, never from
itself: the hidden layer is the tanh of the sum of one vector per neighbour and
place; a two-level softmax gives the token's class and the token in its class. A
document's score is the sum of the conditional log-probabilities of its tokens.

1. Words are counted over all texts. The most frequent ones are tokens of their
   own, all others share ``BUCKETS`` tokens by hash, whose counts are exact too.
   Classes are runs of tokens by frequency; counts set the softmax biases.
   A word of a bucket has the bucket's probability times the word's share of the
   bucket's count, so that probabilities are over words, of any number. These words
   are told apart by 63 bits of a hash.
2. Texts are split into words once more and written in blocks of about ``BLOCK`` tokens:
   token numbers with gaps between the texts, and the hashes of the buckets' words.
   All that follows reads these blocks.
3. The network is trained in numpy in rounds, each on the places of its own remainder,
   so that all rounds together train on each place once: each partition of at least
   ``PORTION`` places (the whole table, if it has fewer) runs Adam from the same weights,
   ``PORTION`` dealt places at a time. The weights are averaged by Spark in a tree of
   bounded fan-in. Weights have a fixed size, the only thing that the driver sees.
4. Each text is scored whole, many texts in one matrix product. The logarithms of the
   shares are looked up in the table of all words, which is dealt by hash into parts of
   about ``PART`` words: each block asks each part once, with all its words of that part.

Words are separated by ASCII white space, A to Z in lower case. Null and empty
texts have no tokens, log_likelihood 0 and a null mean. Repeated rows each get the
same score up to rounding; extra columns are ignored. Without any tokens at all
the network stays at its start.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shuffleworks.llm.common import cut, whole_text

CLASSES = 48
TOKENS = CLASSES * CLASSES
BUCKETS = 256
KNOWN = TOKENS - BUCKETS  # words with a token of their own
SPAN = 2
PLACES = (-2, -1, 1, 2)
HIDDEN = 16
BLOCK = 262_144  # tokens after which a block ends, always between texts
TEXTS = 65_536  # texts after which a block ends
PORTION = 1_000_000  # places that are dealt and trained on at once
ROUNDS = 3
BATCH = 4096
RATE = 0.01
FAN_IN = 64
HELD = 200_000  # distinct words that a task holds at once
CHUNK = 16_384  # tokens that are scored at once
PART = 32_768  # words of a part of the table of words
SAFE = 80.0  # logits below this have exponentials in single precision


def word_hash(word: bytes) -> int:
    """63 bits as a negative number."""
    return -1 - (xxhash.xxh3_64_intdigest(word) >> 1)


def _words(batch: pa.RecordBatch) -> Iterator[list[bytes]]:
    for value in batch.column("text").cast(pa.binary()):
        yield value.as_py().lower().split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def counted() -> pa.RecordBatch:
        words = list(held)
        columns = [pa.array(words, pa.binary()), pa.array(map(word_hash, words), pa.int64()), pa.array(held.values(), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["word", "hash", "n"])

    for batch in batches:
        for words in _words(batch):
            held.update(words)
            if len(held) >= HELD:
                yield counted()
                held.clear()
    if held:
        yield counted()


def vocabulary(texts: DataFrame) -> tuple[dict[bytes, int], np.ndarray, np.ndarray, DataFrame]:
    """Tokens of the known words, tokens of the buckets, counts by token, and hash and log_share of each word in its bucket.

    Tokens are ordered by count. All words have a log_share, of which those of the known words mean nothing.
    """
    counts = texts.mapInArrow(_count, "word binary, hash long, n long").groupBy("word", "hash").agg(F.sum("n").alias("n"))
    counts = cut(counts, "words").withColumn("bucket", F.col("hash").bitwiseAND(F.lit(BUCKETS - 1)))
    top = [(bytes(r["word"]), r["bucket"], r["n"]) for r in counts.orderBy(F.desc("n"), "word").limit(KNOWN).collect()]
    rest = np.zeros(BUCKETS, dtype=np.int64)
    for r in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row per bucket
        rest[r["bucket"]] = r["n"]
    for _, bucket, n in top:
        rest[bucket] -= n
    sizes = np.zeros(TOKENS, dtype=np.int64)
    sizes[: len(top)] = [n for *_, n in top]
    sizes[KNOWN:] = rest
    order = np.argsort(-sizes, kind="stable")
    token = np.empty(TOKENS, dtype=np.int64)
    token[order] = np.arange(TOKENS)
    logs = F.array(*[F.lit(float(n)) for n in np.log(np.maximum(rest, 1))])
    shares = counts.select("hash", (F.log(F.col("n").cast("double")) - logs[F.col("bucket").cast("int")]).alias("log_share"))
    return {w: int(token[i]) for i, (w, *_) in enumerate(top)}, token[KNOWN:], sizes[order], shares


class _Codes(dict):
    """word -> its token, or its hash if it is of a bucket. At most ``HELD`` words are kept besides the known ones."""

    def __init__(self, known: dict[bytes, int]):
        super().__init__(known)
        self.limit = len(known) + HELD

    def __missing__(self, word: bytes) -> int:
        code = word_hash(word)
        if len(self) < self.limit:
            self[word] = code
        return code


def _blocks(sent):
    """Per block: ids and sizes of its texts, their tokens between gaps, how many words of buckets each has, and the hashes of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, buckets = sent.value
        codes = _Codes(known)
        ids: list = []
        texts: list[np.ndarray] = []
        held = 0

        def found() -> pa.RecordBatch:
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            tokens = np.concatenate(texts)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            rare = tokens < 0
            hashes = tokens[rare]
            tokens[rare] = buckets[hashes & (BUCKETS - 1)]
            line = np.full(len(tokens) + SPAN * (len(sizes) + 1), TOKENS, dtype=np.uint16)
            line[np.arange(len(tokens)) + SPAN * (owner + 1)] = tokens
            rares = np.bincount(owner[rare], minlength=len(sizes))
            packed = [pa.array([x.tobytes()], pa.binary()) for x in (sizes, line, rares, hashes)]
            columns = [pa.array([ids], pa.list_(pa.int64())), *packed]
            return pa.RecordBatch.from_arrays(columns, names=["ids", "sizes", "line", "rares", "hashes"])

        for batch in batches:
            for doc_id, words in zip(batch.column("doc_id").to_pylist(), _words(batch)):
                ids.append(doc_id)
                texts.append(np.fromiter(map(codes.__getitem__, words), np.int64, len(words)))
                held += len(words)
                if held >= BLOCK or len(ids) >= TEXTS:
                    yield found()
                    ids, texts, held = [], [], 0
        if ids:
            yield found()

    return run


def start(counts: np.ndarray) -> list[np.ndarray]:
    """Neighbour vectors by place, hidden bias, class weights and biases, token weights and biases."""
    rng = np.random.default_rng(1)
    smooth = (counts + 1.0).reshape(CLASSES, CLASSES)
    by_class = smooth.sum(axis=1)
    return [
        rng.normal(0, 0.1, (len(PLACES), TOKENS + 1, HIDDEN)).astype(np.float32),
        np.zeros(HIDDEN, np.float32),
        np.zeros((HIDDEN, CLASSES), np.float32),
        np.log(by_class / by_class.sum()).astype(np.float32),
        np.zeros((CLASSES, HIDDEN, CLASSES), np.float32),
        np.log(smooth / by_class[:, None]).astype(np.float32),
    ]


def _hidden(weights: list[np.ndarray], around: np.ndarray) -> np.ndarray:
    total = weights[0][0][around[0]]
    for k in range(1, len(PLACES)):
        total += weights[0][k][around[k]]
    total += weights[1]
    return np.tanh(total, out=total)


def _is_safe(weights: np.ndarray, biases: np.ndarray) -> bool:
    """Whether no hidden layer, all within -1 and 1, can give a logit beyond ``SAFE``."""
    return float((np.abs(weights).sum(axis=-2) + np.abs(biases)).max()) < SAFE


def _logits(hidden: np.ndarray, weights: np.ndarray, biases: np.ndarray, safe: bool) -> np.ndarray:
    logits = hidden @ weights
    logits += biases
    if not safe:
        logits -= logits.max(axis=1, keepdims=True)
    return logits


def _sums(values: np.ndarray) -> np.ndarray:
    return values @ np.ones(values.shape[1], values.dtype)


def _picked(logits: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The log-softmax of each row at its own column."""
    picked = logits[np.arange(len(own)), own]
    return picked - np.log(_sums(np.exp(logits, out=logits)))


def _wrong(logits: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The softmax less 1 at each row's own column."""
    np.exp(logits, out=logits)
    logits *= (1 / _sums(logits))[:, None]
    logits[np.arange(len(own)), own] -= 1
    return logits


def _by_class(middle: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Rows ordered by the class of their token, and where each class begins."""
    classes = (middle // CLASSES).astype(np.uint8)
    order = np.argsort(classes, kind="stable")
    return order, [0, *np.cumsum(np.bincount(classes, minlength=CLASSES)).tolist()]


def _in_class(hidden: np.ndarray, weights: list[np.ndarray], ends: list[int]) -> np.ndarray:
    """Logits of the tokens of each row's class, for rows ordered by class."""
    logits = np.repeat(weights[5], np.diff(ends), axis=0)
    for c in range(CLASSES):
        if ends[c] < ends[c + 1]:
            rows = slice(ends[c], ends[c + 1])
            logits[rows] += hidden[rows] @ weights[4][c]
    if not _is_safe(weights[4], weights[5]):
        logits -= logits.max(axis=1, keepdims=True)
    return logits


def log_probabilities(weights: list[np.ndarray], around: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """Of each middle token given the tokens around it (one row per place)."""
    order, ends = _by_class(middle)
    hidden, middle = _hidden(weights, around[:, order]), middle[order]
    logs = _picked(_logits(hidden, weights[2], weights[3], _is_safe(weights[2], weights[3])), middle // CLASSES)
    logs += _picked(_in_class(hidden, weights, ends), middle % CLASSES)
    out = np.empty_like(logs)
    out[order] = logs
    return out


def slopes(weights: list[np.ndarray], around: np.ndarray, middle: np.ndarray, out: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """Of the mean negative log-probability, for all weights; written to ``out`` if given."""
    out = [np.empty_like(w) for w in weights] if out is None else out
    order, ends = _by_class(middle)
    around, middle = around[:, order], middle[order]
    hidden = _hidden(weights, around)
    wrong = _wrong(_logits(hidden, weights[2], weights[3], _is_safe(weights[2], weights[3])), middle // CLASSES)
    back = wrong @ weights[2].T
    out[2][...], out[3][...] = hidden.T @ wrong, _sums(wrong.T)
    inner = _wrong(_in_class(hidden, weights, ends), middle % CLASSES)
    out[4][...], out[5][...] = 0, 0
    for c in range(CLASSES):
        if ends[c] < ends[c + 1]:
            rows = slice(ends[c], ends[c + 1])
            own = inner[rows]
            np.matmul(hidden[rows].T, own, out=out[4][c])
            back[rows] += own @ weights[4][c].T
    there = np.flatnonzero(np.diff(ends))
    out[5][there] = np.add.reduceat(inner, np.array(ends)[there], axis=0)
    hidden *= hidden
    back *= np.subtract(1, hidden, out=hidden)
    out[1][...] = back.sum(axis=0)
    out[0][...] = 0
    for k in range(len(PLACES)):
        order = np.argsort(around[k].astype(np.uint16), kind="stable")
        tokens = around[k][order]
        starts = np.flatnonzero(np.diff(tokens, prepend=-1))
        out[0][k][tokens[starts]] = np.add.reduceat(back[order], starts, axis=0)
    for slope in out:
        slope *= 1 / len(middle)
    return out


class Descent:
    """Adam over windows, in their order, from given weights."""

    def __init__(self, weights: list[np.ndarray]):
        self.flat = _flat(weights)
        self.weights = _shaped(self.flat, weights)
        self.slope = np.zeros_like(self.flat)
        self.slopes = _shaped(self.slope, weights)
        self.first, self.second, self.spare = (np.zeros_like(self.flat) for _ in range(3))
        self.step = 0

    def learn(self, around: np.ndarray, middle: np.ndarray) -> None:
        for at in range(0, len(middle), BATCH):
            rows = slice(at, at + BATCH)
            slopes(self.weights, around[:, rows], middle[rows], self.slopes)
            self.step += 1
            self.first *= 0.9
            self.first += np.multiply(self.slope, 0.1, out=self.spare)
            self.second *= 0.99
            np.multiply(self.slope, self.slope, out=self.spare)
            self.spare *= 0.01
            self.second += self.spare
            np.sqrt(np.multiply(self.second, 1 / (1 - 0.99**self.step), out=self.spare), out=self.spare)
            self.spare += 1e-6
            np.divide(self.first, self.spare, out=self.spare)
            self.spare *= RATE / (1 - 0.9**self.step)
            self.flat -= self.spare


def _flat(weights: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([w.ravel() for w in weights])


def _shaped(flat: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    ends = np.cumsum([w.size for w in like])
    return [part.reshape(w.shape) for part, w in zip(np.split(flat, ends[:-1]), like)]


def _train(sent, turn: int = 0, rounds: int = 1, portion: int = PORTION):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        descent = Descent(sent.value)
        rng = np.random.default_rng(turn)
        around: list[np.ndarray] = []
        middle: list[np.ndarray] = []
        held = total = 0

        def learn() -> None:
            dealt = rng.permutation(held)
            descent.learn(np.concatenate(around, axis=1)[:, dealt].astype(np.int64), np.concatenate(middle)[dealt].astype(np.int64))

        for batch in batches:
            for data in batch.column("line"):
                line = np.frombuffer(data.as_py(), dtype=np.uint16)
                every = np.flatnonzero(line != TOKENS)[turn::rounds]
                for at in range(0, len(every), portion):
                    own = every[at : at + portion]
                    around.append(np.stack([line[own + p] for p in PLACES]))
                    middle.append(line[own])
                    held, total = held + len(own), total + len(own)
                    if held >= portion:
                        learn()
                        around, middle, held = [], [], 0
        if held:
            learn()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64()), pa.array([descent.flat.tobytes()], pa.binary())], names=["n", "data"])

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, count = None, 0
    for batch in batches:
        for n, data in zip(batch.column("n").to_pylist(), batch.column("data")):
            share = np.frombuffer(data.as_py(), dtype=np.float32).astype(np.float64) * n
            total, count = share if total is None else total + share, count + n
    if count:
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64()), pa.array([(total / count).astype(np.float32).tobytes()], pa.binary())], names=["n", "data"])


def fit(blocks: DataFrame, counts: np.ndarray, rounds: int = ROUNDS, portion: int = PORTION) -> list[np.ndarray]:
    """Weights trained on the ``line`` of all blocks, once over the rounds."""
    context = blocks.sparkSession.sparkContext
    weights = start(counts)
    lines = blocks.select("line").coalesce(max(1, int(counts.sum()) // portion))
    for turn in range(rounds if counts.sum() else 0):
        models = cut(lines.mapInArrow(_train(context.broadcast(weights), turn, rounds, portion), "n long, data binary"), "models")
        found = models.count()
        while found > 1:
            found = -(-found // FAN_IN)
            models = cut(models.repartition(found).mapInArrow(_average, "n long, data binary"), "models")
        trained = models.first()
        if trained:  # none if no block has a place of this remainder
            weights = _shaped(np.frombuffer(trained["data"], dtype=np.float32), weights)
    return weights


_SUMS = "block long, part int, ids array<long>, sizes binary, sums binary"


def _sums_of(block: int, part: int, ids: list | None, sizes: bytes | None, sums: np.ndarray) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary())
    columns = [pa.array([x], kind) for x, kind in zip((block, part, ids, sizes, sums.astype(np.float64).tobytes()), kinds)]
    return pa.RecordBatch.from_arrays(columns, names=["block", "part", "ids", "sizes", "sums"])


def _score(sent):
    """The network's log-likelihood of each text of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = sent.value
        for batch in batches:
            for row in range(batch.num_rows):
                block, ids, sizes, data = (batch.column(c)[row].as_py() for c in ("block", "ids", "sizes", "line"))
                line = np.frombuffer(data, dtype=np.uint16).astype(np.int64)
                places = np.flatnonzero(line != TOKENS)
                owner = np.repeat(np.arange(len(ids)), np.frombuffer(sizes, dtype=np.int64))
                sums = np.zeros(len(ids))
                for at in range(0, len(places), CHUNK):
                    own = places[at : at + CHUNK]
                    logs = log_probabilities(weights, np.stack([line[own + p] for p in PLACES]), line[own])
                    first = owner[at]
                    found = np.bincount(owner[at : at + CHUNK] - first, weights=logs)
                    sums[first : first + len(found)] += found
                yield _sums_of(block, -1, ids, sizes, sums)

    return run


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The buckets take the low bits."""
    return ((hashes >> 8) % parts).astype(np.int32)


_LOOKUP = "part int, asks boolean, block long, texts int, owners binary, hashes binary, shares binary"


def _lookup(part: int, block: int | None, texts: int, owners: np.ndarray | None, hashes: np.ndarray, shares: np.ndarray | None) -> tuple:
    return part, block is not None, block, texts, None if owners is None else owners.tobytes(), hashes.tobytes(), None if shares is None else shares.tobytes()


def _lookups(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    names = ["part", "asks", "block", "texts", "owners", "hashes", "shares"]
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names=names)


def _runs(dealt: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part and the places of its hashes, in order."""
    # Short numbers are sorted by their digits, several times as fast.
    order = np.argsort(dealt.astype(np.uint16) if dealt.size and dealt.max() < 1 << 16 else dealt, kind="stable")
    starts = np.flatnonzero(np.diff(dealt[order], prepend=-1))
    for own in np.split(order, starts[1:]):
        yield int(dealt[own[0]]), own


def _answered(parts: int):
    """Words and log_shares by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, shares = (batch.column(c).to_numpy() for c in ("hash", "log_share"))
            if len(hashes):
                yield _lookups([_lookup(part, None, 0, None, hashes[own], shares[own]) for part, own in _runs(_part(hashes, parts))])

    return run


def _asked(parts: int):
    """The words that a block asks each part for, with the texts that they are in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block, rares, hashes = (batch.column(c)[row].as_py() for c in ("block", "rares", "hashes"))
                rares, hashes = np.frombuffer(rares, dtype=np.int64), np.frombuffer(hashes, dtype=np.int64)
                owner = np.repeat(np.arange(len(rares), dtype=np.int32), rares)
                if len(hashes):
                    yield _lookups([_lookup(part, block, len(rares), owner[own], hashes[own], None) for part, own in _runs(_part(hashes, parts))])

    return run


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of shares by block and part, from rows sorted by part, the words before those that ask."""
    at, table, hashes, shares = None, [], None, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] != at:
                at, table, hashes = row["part"], [], None
            if not row["asks"]:
                table.append((row["hashes"], row["shares"]))
                continue
            if hashes is None:
                hashes, first = np.unique(np.frombuffer(b"".join(h for h, _ in table), dtype=np.int64), return_index=True)
                shares = np.frombuffer(b"".join(s for _, s in table), dtype=np.float64)[first]
            found = shares[np.searchsorted(hashes, np.frombuffer(row["hashes"], dtype=np.int64))]
            sums = np.bincount(np.frombuffer(row["owners"], dtype=np.int32), weights=found, minlength=row["texts"])
            yield _sums_of(row["block"], at, None, None, sums)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per text, from rows sorted by block and part; the block's own row comes first."""
    at, ids, sizes, sums = None, [], None, None

    def found() -> pa.RecordBatch:
        columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.float64())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "log_likelihood"])

    for batch in batches:
        for row in batch.to_pylist():
            part = np.frombuffer(row["sums"], dtype=np.float64)
            if row["block"] == at:
                sums = sums + part
                continue
            if at is not None:
                yield found()
            at, ids, sizes, sums = row["block"], row["ids"], np.frombuffer(row["sizes"], dtype=np.int64), part
    if at is not None:
        yield found()


def log_shares(blocks: DataFrame, shares: DataFrame) -> DataFrame:
    """By block and part, the sums of the log_shares of each text's words of buckets."""
    parts = -(-shares.count() // PART) or 1
    words = shares.mapInArrow(_answered(parts), _LOOKUP)
    asked = blocks.select("block", "rares", "hashes").mapInArrow(_asked(parts), _LOOKUP)
    return words.unionByName(asked).repartition("part").sortWithinPartitions("part", "asks").mapInArrow(_look_up, _SUMS)


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Per row: doc_id, n_tokens, log_likelihood (their sum), mean_log_prob."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    known, buckets, counts, shares = vocabulary(rows.select("text"))
    context = docs.sparkSession.sparkContext
    blocks = rows.mapInArrow(_blocks(context.broadcast((known, buckets))), "ids array<long>, sizes binary, line binary, rares binary, hashes binary")
    # Written with its number, a block keeps it.
    blocks = cut(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")
    weights = fit(blocks, counts, rounds)
    scored = blocks.select("block", "ids", "sizes", "line").mapInArrow(_score(context.broadcast(weights)), _SUMS)
    sums = scored.unionByName(log_shares(blocks, shares)).repartition("block").sortWithinPartitions("block", "part")
    result = sums.mapInArrow(_together, "doc_id long, n_tokens long, log_likelihood double")
    return result.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))
