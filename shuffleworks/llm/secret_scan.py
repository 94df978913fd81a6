"""Secret scan: keyword automaton, anchored patterns at its hits, embedded checksums.

One Aho-Corasick pass over the lower-cased bytes finds where keywords stand. Only
there the kind's pattern is tried, anchored, from left to right and never inside
the previous match of its kind. Tokens that carry a checksum (the last six
characters are the base-62 CRC-32 of the thirty before) must prove it. Runs of
hexadecimal digits have no keyword; they are found by their own pattern.

All patterns are ASCII, so they run on UTF-8 bytes; places are given in code
points of the text, ends exclusive. Null texts count as empty and give an empty
list; every row gives one row; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shuffleworks.llm.common import whole_text

# Kinds in the order of the contract, their keywords and patterns.
ASSIGN = rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = rb"AKIA[A-Z0-9]+"
HEX = rb"[0-9a-f]{16,}"  # a run of 16 or more is the whole run, since the match is leftmost and greedy
CHECKED = rb"(gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9_])"
KINDS = ["assign", "access", "hex", "github", "npm"]
KEYWORDS = {
    "assign": ["password", "passwd", "secret", "token", "apikey", "api_key"],
    "access": ["akia"],
    "github": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"],
    "npm": ["npm_"],
}
MIN_ASSIGN, MIN_ACCESS = 12, 18
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62(value: int, width: int = 6) -> str:
    out = ""
    while value:
        value, digit = divmod(value, 62)
        out = DIGITS[digit] + out
    return out.rjust(width, "0")


def _finder() -> Callable[[bytes], list[tuple[int, int, str]]]:
    """Spans (start, end, kind) of a text in bytes, unsorted."""
    import ahocorasick

    assign, access, hexes, checked = re.compile(ASSIGN, re.IGNORECASE), re.compile(ACCESS), re.compile(HEX), re.compile(CHECKED)

    def passes(kind: str, m: re.Match) -> bool:
        if kind == "assign":
            return len(m[2]) >= MIN_ASSIGN
        if kind == "access":
            return len(m[0]) >= MIN_ACCESS
        return base62(zlib.crc32(m[2])) == m[3].decode()

    patterns = {"assign": assign, "access": access, "github": checked, "npm": checked}
    automaton = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            automaton.add_word(word, (kind, len(word)))
    automaton.make_automaton()

    def find(data: bytes) -> list[tuple[int, int, str]]:
        spans = [(m.start(), m.end(), "hex") for m in hexes.finditer(data)]
        ends = dict.fromkeys(KEYWORDS, 0)
        # One character per byte; keywords of a kind never contain one another, so hits come in order of their starts.
        for last, (kind, size) in automaton.iter(data.lower().decode("latin-1")):
            start = last + 1 - size
            if start >= ends[kind] and (m := patterns[kind].match(data, start)):
                ends[kind] = m.end()
                if passes(kind, m):
                    spans.append((start, m.end(), kind))
        return spans

    return find


def in_code_points(data: bytes, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans with places counted in code points instead of bytes."""
    if not spans or data.isascii():
        return spans
    places, at, count = {}, 0, 0
    for place in sorted({p for s in spans for p in s[:2]}):
        count += len(data[at:place].decode("utf-8", "replace"))
        places[place], at = count, place
    return [(places[a], places[b], kind) for a, b, kind in spans]


_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    find, rank = _finder(), {k: i for i, k in enumerate(KINDS)}
    for batch in batches:
        found = []
        for value in batch.column("text").cast(pa.binary()):
            data = value.as_py()
            spans = find(data)
            named = [(*s, data[a:b].decode()) for (a, b, _), s in zip(spans, in_code_points(data, spans))]
            named.sort(key=lambda s: (s[0], rank[s[2]]))
            found.append([{"kind": k, "start": a, "end": b, "value": v} for a, b, k, v in named])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, _FOUND)], names=["doc_id", "found"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per row: doc_id and ``found``, its spans (kind, start, end, value) by start, then kind."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(_scan, "doc_id long, found array<struct<kind:string,start:long,end:long,value:string>>")


def span_text(found: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
