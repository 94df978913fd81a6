"""Phrase collocations against counting in dictionaries, and the index against a scan."""

import re
from collections import Counter

import numpy as np
import pytest

from shuffleworks.llm import phrases as ph

SCHEMA = "doc_id long, text string, lang string, phrase string, f long, n string"


def pieces(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split("[ \t]+", p) if w] for p in re.split("[.,;:!?\n\x0b\x0c\r]", lower)]


def brute(rows, least, share=80, top=2000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        for words in pieces(text):
            totals[lang or "und"] += len(words)
            for size in range(1, 5):
                counts.update((lang or "und", tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    found = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    gone = set()
    for (lang, words), longer in found.items():
        inner = {words[i:j] for i in range(len(words)) for j in range(i + 2, len(words) + 1) if j - i < len(words)}
        gone |= {(lang, w) for w in inner if 100 * longer >= share * counts[lang, w]}
    out = []
    for (lang, words), a in found.items():
        if (lang, words) not in gone:
            sides = [(counts[lang, words[:k]], counts[lang, words[k:]]) for k in range(1, len(words))]
            l, r = min(sides, key=lambda s: 2_000_000 * a // (s[0] + s[1]))
            out.append((lang, " ".join(words), a, l, r, totals[lang], 2_000_000 * a // (l + r)))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    places, ranked = Counter(), []
    for row in out:
        places[row[0]] += 1
        if places[row[0]] <= top:
            ranked.append((row[0], places[row[0]], *row[1:]))
    return ranked


def texts():
    rng = np.random.default_rng(3)
    names = ["a", "B", "c.", "d", "É", "the", "of,", "x\t", "q\n", "10", "\x00z"]
    rows = [(rng.choice(["en", "de", ""]) or None, " ".join(rng.choice(names, rng.integers(0, 60)))) for _ in range(300)]
    rows += [("en", "the quick brown fox jumps. " * 20), ("en", None), ("en", ""), ("de", " \t\n"), ("und", "a b")]
    return [(str(lang) if lang else None, str(text) if text is not None else None) for lang, text in rows] + rows[:3]


def mined(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.mark.parametrize("shard,bits", [(40, 27), (ph.SHARD, 27), (300, 3)])
def test_equals_brute_force(spark, shard, bits):
    rows = [(str(a) if a else None, None if b is None else str(b)) for a, b in texts()]
    frame = spark.createDataFrame([(i, text, lang, "p", 1, "n") for i, (lang, text) in enumerate(rows)], SCHEMA).repartition(3)
    for least in (1, 12):
        assert mined(ph.collocations(frame, least=least, bits=bits, shard=shard)) == sorted(brute(rows, least))


def test_top_of_each_language(spark):
    rows = [(str(a) if a else None, None if b is None else str(b)) for a, b in texts()]
    frame = spark.createDataFrame([(i, text, lang, "p", 1, "n") for i, (lang, text) in enumerate(rows)], SCHEMA)
    assert mined(ph.collocations(frame, least=3, top=4)) == sorted(brute(rows, 3, top=4))


def test_long_text_in_slices(monkeypatch):
    text = "alpha beta, gamma\tdelta! Über".encode() * 50
    whole = [w for part in ph.slices(text) for w in part]
    monkeypatch.setattr(ph, "SLICE", 7)
    assert [w for part in ph.slices(text) for w in part] == whole
    assert [w for w in whole if w != ph.BREAK] == [w.encode() for p in pieces(text.decode()) for w in p]


def test_intervals_hold_every_place():
    rng = np.random.default_rng(0)
    ids = np.concatenate([[0], rng.integers(0, 6, 400), [0]]).astype(np.int32)
    index = ph.Index(ph.transform(ids), ph.transform(ids[::-1]), 6)
    orders = [ids[(ph._order(ids)[:, None] + np.arange(4)) % len(ids)], ids[::-1][(ph._order(ids[::-1])[:, None] + np.arange(4)) % len(ids)]]
    for sides in ((0, 0, 0), (1, 1, 1), (0, 1, 0), (1, 0, 1)):
        phrases, starts, counts = index.words()
        for side in sides:
            phrases, starts, counts = index.extend(phrases, starts, counts, side)
            size = phrases.shape[1]
            there = Counter(tuple(ids[i : i + size]) for i in range(len(ids) - size + 1) if 0 not in ids[i : i + size])
            assert {tuple(p): n for p, n in zip(phrases.tolist(), counts.tolist())} == there
            for p, lo, back, n in zip(phrases, *starts, counts):
                assert (orders[0][lo : lo + n, :size] == p).all() and (orders[1][back : back + n, :size] == p[::-1]).all()


def test_bitmap_holds_its_words(spark):
    words = spark.createDataFrame([("en", bytearray(f"w{i}é".encode())) for i in range(500)], "lang string, phrase binary")
    whole = ph.bitmap(ph.word_places(words))
    assert all(ph.likely(whole, b"en", f"w{i}é".encode()) for i in range(500))
    assert sum(ph.likely(whole, b"en", f"v{i}".encode()) for i in range(500)) < 5


@pytest.mark.parametrize("ranges", [1, 12])
def test_sums_of_packed_hashes(spark, ranges):
    rng = np.random.default_rng(1)
    some = rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2)
    total, rows = Counter(), []
    for _ in range(12):
        own = rng.choice(some, 200, replace=False)
        counts = rng.integers(1, 9, 200)
        total.update(dict(zip(own.tolist(), counts.tolist())))
        rows += [r for batch in ph._packed(iter([(own[:50], counts[:50]), (own[50:], counts[50:])]), ranges, 60) for r in batch.to_pylist()]
    whole = ph.reaching(spark.createDataFrame([tuple(r.values()) for r in rows], ph.PACKED).repartition(3), 30, 27)
    kept = ph.in_bitmap(whole, some, ranges, 27)
    assert kept.tolist() == [total[h] >= 30 for h in some.tolist()]


def test_empty_table(spark):
    assert ph.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
