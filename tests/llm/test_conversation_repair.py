"""Conversation repair against a plain dynamic program over whole strings, and its parts."""

import hashlib
import random
import re

import duckdb
import pytest

from shuffleworks.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, audit string, cost string"
SPACE = " \t\n\x0b\x0c\r"


def brute(rows):
    """(turn, role, text) in order -> gaps, faults, illegal, cost, audit, hash: best (cost, audit, lines) per initials' state."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    best = {"": (0, "", ())}

    def put(table, last, added, value):
        """``table`` by the last initial, on which alone depends what can follow."""
        if not added or last + added in ("s", "u", "su", "ua", "au"):
            key = added or last
            table[key] = min(table.get(key, value), value)

    def inserted(table):
        for _ in range(3):
            for last, (cost, audit, lines) in list(table.items()):
                for name in ("user", "assistant"):
                    put(table, last, name[0], (cost + 5, audit + "I", (*lines, f"{name}:")))
        return table

    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for last, (cost, audit, lines) in inserted(best).items():
            put(after, last, "", (cost + 2, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            extra = 5 * (fault == "truncated")
            if role:
                put(after, last, role[0], (cost + extra, audit + "K", (*lines, f"{role}:{text}")))
            for name in ("user", "assistant"):
                put(after, last, name[0], (cost + extra + 1, audit + "R", (*lines, f"{name}:{text}")))
        best = after
    cost, audit, lines = min(v for k, v in inserted(best).items() if k in ("", "a"))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def expected(rows):
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][: cr.PREFIX], hashlib.sha256(r[2].encode()).digest())
    return {conv: brute(sorted(own, key=order)) for conv, own in by_conv.items()}


def reports(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def random_rows(seed, conversations=60):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for _ in range(rng.choice([1, 2, 5, 9, 30])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "u", "", None])
            text = rng.choice(["Yes.", "no", "", " \t", "Why?\n", None, "é!", "ok.", f"t{rng.random()}.", f"t{rng.random()}", f"t{rng.random()}!"])
            rows.append((None if conv == 0 else conv, rng.choice([None, rng.randrange(-3, 40)]), role, text))
    return rows + rows[:20]


@pytest.mark.parametrize("chunk", [2, cr.CHUNK])
def test_report_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(cr, "CHUNK", chunk)
    rows = random_rows(chunk)
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(5)
    assert reports(cr.report(frame)) == expected(rows)


def test_long_conversation_lies_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(cr, "CHUNK", 50)
    rows = [(7, i, "user" if i % 3 else "assistant", f"text {i}" + "." * (i % 5 > 0)) for i in range(800)] + [(7, None, "user", "same.")] * 700
    frame = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    assert reports(cr.report(frame)) == expected(rows)


def test_edits_give_the_reported_texts(spark):
    rows = random_rows(5)
    frame = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    edits = {}
    for r in sorted(cr.repair(frame).collect(), key=lambda r: r.place):
        edits.setdefault(r.conv_id, []).append(r)
    for conv, own in reports(cr.report(frame)).items():
        there = edits.get(conv, [])
        assert "".join(r.edit for r in there) == own[6]
        kept = [r for r in there if r.edit != "D"]
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in kept))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in kept).encode()).hexdigest() == own[7]


def test_powers_equal_repeated_rows():
    powers = cr.Powers()
    for symbol in range(cr.DELETE + 1):
        vector = cr.END
        for length in range(1, 40):
            vector = cr.times(powers[symbol, 0], vector)
            assert powers.advance(symbol, length, cr.END) == vector


def test_damaged_odd_rows_equal_sql(spark):
    rows = [(r[0], r[1], r[2], r[3]) for r in random_rows(9, 200)] + [(300 + i, 0, "user", "one") for i in range(60)]
    frame = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = cr.report(cr.damage(frame)).select(*names)
    wanted = con.sql(cr.sql()).select(*names).fetchall()
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(wanted, key=repr)
    assert any(not r[7] and r[8] == hashlib.sha256(b"").hexdigest() for r in wanted)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cr.report(cr.damage(empty)).count() == 0
    assert cr.repair(empty).count() == 0
