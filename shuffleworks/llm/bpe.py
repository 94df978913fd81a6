"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word's symbols are the leaves; a leaf holds ``rank * n + place`` of the pair
that begins there, a node the least of its children. The root is therefore the
leftmost merge of the lowest rank; a merge changes two leaves and costs the
logarithm of the word's length. It ends when the root holds no pair.

Texts are cut at ASCII white space first. No pattern or normal form of these
tokenizers reaches over it, so every such chunk is encoded once per task and
looked up afterwards, in a cache of bounded size.

Null texts count as empty and give no tokens. Every row gives one row; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shuffleworks.llm.common import whole_text

TOKENIZER = "word_bpe_49k.json"
UNASSIGNED = "\u0378"  # neither letter nor number in any version so far
# Where Unicode 16 has new letters and numbers, and the lower cases of Unicode 16 and 17 (and the capital sigma's plain one).
UNICODE_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D8F), (0x10EC2, 0x10EC4),
    (0x11380, 0x113FF), (0x116D0, 0x116E3), (0x11BC0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x16139), (0x16D40, 0x16D79),
    (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5FA),
]
LOWER = {0x3A3: 0x3C3, 0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LOWER |= {0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5}
LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
MARKS = (".", ",", ";", ":", "!", "?")
CACHE = 400_000  # chunks, and words, that a generation of a task's memory holds; an eighth where the ids themselves are kept
AT_ONCE = 4 << 20  # bytes of text whose new words are merged together
FLUSH = 2 << 20  # bytes of ids that go out together
TOGETHER = 24  # words of one tree size from which that is worth a matrix
CELLS = 1 << 19  # leaves of the trees that are run together


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def load(path: str | None = None) -> dict:
    """What the encoder needs of a tokenizer file, read by the driver."""
    with open(path or default_path(), encoding="utf-8") as file:
        spec = json.load(file)
    split = spec["pre_tokenizer"]["pretokenizers"][0]
    return {
        "vocab": spec["model"]["vocab"],
        "merges": [tuple(m) for m in spec["model"]["merges"]],
        "suffix": spec["model"]["end_of_word_suffix"] or "",
        "pattern": split["pattern"]["Regex"],
        "newer": newer_letters(),
        "added": {t["content"]: t["id"] for t in spec["added_tokens"]},
    }


def newer_letters() -> str:
    """Letters and numbers that the pattern library knows and the tokenizers library, at Unicode 16, does not yet."""
    import regex

    known = regex.findall(r"[\p{L}\p{N}]", "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000))
    return "".join(c for c in known if unicodedata.category(c) == "Cn" and not any(a <= ord(c) <= b for a, b in UNICODE_16))


def lower(text: str) -> str:
    """Letter by letter: the lower case of a capital sigma does not depend on its place."""
    if not text.isascii():
        text = text.translate(LOWER)
    return text.lower()


def byte_letters() -> list[str]:
    """A printable letter for each byte: itself where it is printable, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + n)
    return [letters[b] for b in range(256)]


class Bpe:
    def __init__(self, spec: dict, cache: int = CACHE):
        import regex

        self.cache = cache

        vocab, self.suffix = spec["vocab"], spec["suffix"]
        self.width = max(vocab.values()) + 1
        self.rank, self.merged = {}, []
        for n, (a, b) in enumerate(spec["merges"]):
            self.rank.setdefault(vocab[a] * self.width + vocab[b], n)
            self.merged.append(vocab[a + b])
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + self.suffix] for c in letters]
        self.pattern = regex.compile(spec["pattern"])
        self.newer = regex.compile("[" + regex.escape(spec["newer"]) + "]") if spec["newer"] else None
        self.added = spec["added"]
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.plain_added = not any(t.isalpha() for t in self.added)  # no added token can stand inside letters only
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        pairs = np.fromiter(self.rank, np.int64, len(self.rank))
        order = np.argsort(pairs)
        self.pairs, self.ranks = pairs[order], np.fromiter(self.rank.values(), np.int64, len(pairs))[order]
        self.results = np.array(self.merged, dtype=np.int64)
        self.bytes = np.array([self.inner, self.last], dtype=np.int64)
        self.words: dict[str, list[int]] = {}
        self.old: dict[str, list[int]] = {}

    def merge(self, symbols: list[int]) -> list[int]:
        """The symbols after all merges."""
        n = len(symbols)
        if n < 2:
            return symbols
        rank, merged, width, none = self.rank, self.merged, self.width, len(self.merged) * n
        leaves = 1 << (n - 2).bit_length() if n > 2 else 1
        tree = [none] * (2 * leaves)
        for i in range(n - 1):
            r = rank.get(symbols[i] * width + symbols[i + 1])
            if r is not None:
                tree[leaves + i] = r * n + i
        for k in range(leaves - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(place: int, value: int) -> None:
            k = leaves + place
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                low = a if a < b else b
                if tree[k] == low:
                    return
                tree[k] = low
                k >>= 1

        def pair(place: int) -> int:
            right = after[place]
            if right >= n:
                return none
            r = rank.get(symbols[place] * width + symbols[right])
            return none if r is None else r * n + place

        while tree[1] < none:
            r, i = divmod(tree[1], n)
            j = after[i]
            symbols[i], symbols[j] = merged[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            if j < n - 1:
                put(j, none)
            if i < n - 1:
                put(i, pair(i))
            if (h := before[i]) >= 0:
                put(h, pair(h))
        return [s for s in symbols if s >= 0]

    def ranked(self, pairs: np.ndarray) -> np.ndarray:
        """The ranks of pairs of symbols, -1 for those that do not merge."""
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pairs, self.ranks[at], -1)

    def merge_together(self, words: list[bytes], leaves: int) -> list[list[int]]:
        """``merge`` of many words whose trees have the same number of leaves: a row per word, a step for all of them at a time."""
        size, n = len(words), leaves + 1
        lengths = np.fromiter(map(len, words), np.int64, size)
        cells = np.arange(n) < lengths[:, None]
        symbols = np.full((size, n), -1)
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths) - 1
        ids = self.bytes[0][data]
        ids[ends] = self.bytes[1][data[ends]]
        symbols[cells] = ids
        none = len(self.merged) * n
        tree = np.full((size, 2 * leaves), none)
        ranks = self.ranked(symbols[:, :-1] * self.width + symbols[:, 1:])
        ranks[~cells[:, 1:]] = -1
        tree[:, leaves:] = np.where(ranks >= 0, ranks * n + np.arange(leaves), none)
        level = leaves
        while level > 1:
            level >>= 1
            tree[:, level : 2 * level] = tree[:, 2 * level : 4 * level].reshape(size, level, 2).min(axis=2)
        after = np.tile(np.arange(1, n + 1), (size, 1))
        before = np.tile(np.arange(-1, n - 1), (size, 1))
        rows = np.flatnonzero(tree[:, 1] < none)
        while len(rows):
            rank, i = np.divmod(tree[rows, 1], n)
            j = after[rows, i]
            k = after[rows, j]
            symbols[rows, i], symbols[rows, j] = self.results[rank], -1
            after[rows, i] = k
            there = k < lengths[rows]
            before[rows[there], k[there]] = i[there]
            h = before[rows, i]
            left = h >= 0
            # The merged pair, the pair of the second symbol, and the pair before them are new.
            pairs = symbols[rows, i] * self.width + symbols[rows, np.minimum(k, n - 1)]
            found = np.where(there, self.ranked(pairs), -1)
            own = np.where(found >= 0, found * n + i, none)
            h_there = np.maximum(h, 0)
            found = np.where(left, self.ranked(symbols[rows, h_there] * self.width + symbols[rows, i]), -1)
            before_own = np.where(found >= 0, found * n + h_there, none)
            # Places without a pair of their own stand for the one beside them, which is put anyway.
            places = [np.where(j < leaves, j, i), np.minimum(i, leaves - 1), np.where(left, h_there, i)]
            for place, value in zip(places, (np.where(j < leaves, none, own), own, np.where(left, before_own, own))):
                tree[rows, leaves + place] = value
            for place in places:
                at = (leaves + place) >> 1
                for _ in range(leaves.bit_length() - 1):
                    tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])
                    at >>= 1
            rows = rows[tree[rows, 1] < none]
        left = symbols >= 0
        flat, ends = symbols[left].tolist(), np.cumsum(left.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def learn(self, words: Iterable[str]) -> None:
        """Remember the ids of new words, found for all words of a tree size together."""
        groups: dict[int, list[str]] = {}
        for word in words:
            if word not in self.words and word not in self.old:
                size = len(word.encode("utf-8"))
                groups.setdefault(1 << max(size - 2, 0).bit_length(), []).append(word)
        for leaves, own in groups.items():
            if len(own) < TOGETHER:
                continue  # met one by one
            for start in range(0, len(own), max(TOGETHER, CELLS // leaves)):
                part = own[start : start + max(TOGETHER, CELLS // leaves)]
                for word, ids in zip(part, self.merge_together([w.encode("utf-8") for w in part], leaves)):
                    self.words[word] = ids

    def fresh(self, word: str) -> list[int]:
        data = word.encode("utf-8")
        return self.merge([*[self.inner[b] for b in data[:-1]], self.last[data[-1]]])

    def word(self, word: str) -> list[int]:
        ids = self.words.get(word)
        if ids is None:
            ids = self.words[word] = self.old.pop(word, None) or self.fresh(word)
            if len(self.words) >= self.cache:
                self.old, self.words = self.words, {}
        return ids

    def split(self, text: str) -> list[str]:
        if text.isalpha():  # letters only are one word
            return [text]
        if text[-1:] in MARKS and text[:-1].isalpha():
            return [text[:-1], text[-1]]
        if text.isascii() or not self.newer or not self.newer.search(text):
            return self.pattern.findall(text)
        plain = self.newer.sub(UNASSIGNED, text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(plain)]

    def pieces(self, text: str) -> list[str | int]:
        """The words of a text, and the ids of added tokens between them."""
        if self.plain_added and text.isalpha() and text.isascii():
            return [text.lower()]
        out: list[str | int] = []
        for part in self.cut.split(text) if self.cut and self.cut.search(text) else [text]:
            if part in self.added:
                out.append(self.added[part])
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part)
            out += self.split(lower(part))
        return out

    def ids(self, pieces: list[str | int]) -> list[int]:
        if len(pieces) == 1 and not isinstance(pieces[0], int):
            return self.word(pieces[0])
        out: list[int] = []
        for piece in pieces:
            if isinstance(piece, int):
                out.append(piece)
            else:
                out += self.word(piece)
        return out

    def encode(self, text: str) -> list[int]:
        return self.ids(self.pieces(text))

    def decode(self, ids: list[int]) -> str:
        """Names of the tokens joined by spaces: the file names no decoder. Unknown ids are left out."""
        return " ".join([self.names[i] for i in ids if i in self.names])


class _Chunks(dict):
    """bytes of a chunk -> what ``make`` gives for its ids.

    Of two generations the older one is forgotten when the younger is full;
    chunks in use move to the younger, so frequent ones always stay.
    """

    def __init__(self, bpe: Bpe, make):
        super().__init__()
        self.bpe, self.make, self.old = bpe, make, {}

    def learn(self, chunks: list[list[bytes]]) -> None:
        """Remember all chunks of some texts; the trees of their new words are run together."""
        pieces: dict[bytes, list[str | int]] = {}
        for chunk in set(chain.from_iterable(chunks)).difference(self):
            value = self.old.pop(chunk, None)
            if value is None:
                pieces[chunk] = self.bpe.pieces(chunk.decode("utf-8", "replace"))
            else:
                self[chunk] = value
        self.bpe.learn({p for own in pieces.values() for p in own if not isinstance(p, int)})
        make, ids = self.make, self.bpe.ids
        for chunk, own in pieces.items():
            self[chunk] = make(ids(own))
        if len(self) >= 2 * self.bpe.cache:  # what this call has learnt is used next
            self.old = dict(islice(self.items(), len(self) - self.bpe.cache))
            for chunk in self.old:
                del self[chunk]

    def __missing__(self, chunk: bytes):
        value = self.old.pop(chunk, None)
        if value is None:
            value = self.make(self.bpe.encode(chunk.decode("utf-8", "replace")))
        return self.put(chunk, value)

    def put(self, chunk: bytes, value):
        if len(self) >= self.bpe.cache:
            self.old = dict(self)
            self.clear()
        self[chunk] = value
        return value


def _chunked(column: pa.Array, chunks: _Chunks, at_once: int = AT_ONCE) -> Iterator[list[bytes]]:
    """The chunks of each text; those of some megabytes of text are learnt together."""
    held: list[list[bytes]] = []
    size = 0
    for value in column.cast(pa.binary()):
        data = value.as_py()
        held.append(data.split())
        size += len(data)
        if size >= at_once:
            chunks.learn(held)
            yield from held
            held, size = [], 0
    chunks.learn(held)
    yield from held


def _encode(spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _Chunks(Bpe(spec.value, CACHE // 8), lambda ids: np.array(ids, dtype=np.int32).tobytes())
        for batch in batches:
            names, low, held, size = batch.schema.names, 0, [], 0
            at = len(names) - 1  # the text comes last
            kept = range(at)

            def flushed() -> pa.RecordBatch:
                ids = pa.array(np.frombuffer(b"".join(held), dtype=np.int32))
                offsets = np.cumsum([0, *(len(h) // 4 for h in held)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), ids)
                own = [batch.column(i).slice(low, len(held)) for i in kept]
                return pa.RecordBatch.from_arrays([*own, lists], names=[*(names[i] for i in kept), "ids"])

            for own_chunks in _chunked(batch.column(at), chunks, AT_ONCE // 8):
                held.append(b"".join(map(chunks.__getitem__, own_chunks)))
                size += len(held[-1])
                if size > FLUSH:
                    yield flushed()
                    low, held, size = low + len(held), [], 0
            if held:
                yield flushed()

    return run


def _decode(spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(spec.value)
        for batch in batches:
            texts = [bpe.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def _digests(spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(spec.value)
        # What a token adds to either line, made once; ids without a name are left out of the second.
        numbers = [str(i).encode() for i in range(max(bpe.names) + 1)]
        names = {i: t.encode() for i, t in bpe.names.items()}
        chunks = _Chunks(bpe, lambda x: (b" ".join([numbers[i] for i in x]), b" ".join([names[i] for i in x if i in names])))
        for batch in batches:
            rows = []
            for own in _chunked(batch.column("text"), chunks):
                parts = list(map(chunks.__getitem__, own))
                # A chunk of white space beyond ASCII has no tokens, and must leave no second space.
                line = b" ".join([p[0] for p in parts if p[0]])
                text = b" ".join([p[1] for p in parts if p[1]])
                rows.append((line.count(b" ") + 1 if line else 0, hashlib.sha256(line).hexdigest(), hashlib.sha256(text).hexdigest()))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))


def encode(spark: SparkSession, docs: DataFrame, path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Per row: doc_id, the columns of ``keep``, ids (array of int). The driver sends out the tokenizer, one file of fixed size."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(keep or []), whole_text().alias("_encoded_text"))
    schema = T.StructType([f for f in rows.schema.fields if f.name != "_encoded_text"] + [T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(_encode(spark.sparkContext.broadcast(load(path))), schema)


def decode(spark: SparkSession, encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Per row of (doc_id, ids): doc_id, text. Null ids give an empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(spark.sparkContext.broadcast(load(path))), "doc_id long, text string")


def digests(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return _rows(docs).mapInArrow(
        _digests(spark.sparkContext.broadcast(load(path))), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
