"""Conversation structure repair: cheapest edits by a min-plus dynamic program over runs of equal symbols.

A conversation's rows become symbols (role initial and fault). Runs of equal symbols
are collapsed; a symbol is a 4 x 4 min-plus matrix over what has come so far (nothing,
a system turn, a user turn, an assistant turn), and a run is advanced through the
cached binary powers of its matrix. The choices are then unrolled row by row.

No task needs a whole conversation for this. Rows without their texts are sorted over
all tasks (a range shuffle on the whole sort key, equal rows counted first), so a long
conversation lies in many partitions. Each partition turns its part into chunks: the
runs and the product of their matrices. The cost of what follows a chunk comes from a
walk over the few chunks of its conversation, from the last to the first; then chunks
are unrolled in parallel, for each state in which the one before may end. Only the
last step, which puts edits and texts together, streams a conversation in order through
one task, as its SHA-256 asks for; it holds one chunk's letters and the audit.

Rules. Rows are ordered by turn (nulls first), then role, then the first 64 characters
and the SHA-256 of the text; equal rows stand side by side. A row's first fault counts:
``blank`` (no ``[^\\x20\\x09-\\x0D]``), ``duplicate`` (role and text seen earlier in the
conversation), ``truncated`` (the last such character is none of ``.!?``). Edits: Keep 0,
Rerole to user or assistant 1, Delete 2 (the only one for blank and duplicate rows),
Insert an empty user or assistant turn 5; a truncated row that stays adds 5. The initials
of the repaired roles read ``(s?(ua)+)?``. Of equally cheap audits the ASCII-least is taken.

Null roles and texts count as one space; a null conv_id is a conversation of its own. A role
with another initial, or none, cannot be kept. A conversation without rows (``copies`` 0 for all)
has zeros, an empty audit and the hash of nothing. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shuffleworks.llm.common import cut

CHUNK = 1 << 16  # rows in a chunk
PREFIX = 64  # characters of a text that order rows of one turn and role
DELETE = 8  # the symbol of rows that must go; below it: 2 * role + truncated
FAR = 1 << 60
ROLES = "sua"
#: The state after a user or assistant turn is put at a state's end; states are nothing, s, u, a.
NEXT = (2, 2, 3, 2)
NAMES = {2: "user", 3: "assistant"}
COST = {"D": 2, "I": 5, "R": 1}
TRUNCATED = 5
#: Inserts that end a conversation in each state, and their cost.
CLOSING = ("", "II", "I", "")
END = tuple(COST["I"] * len(c) for c in CLOSING)
BATCH = 2048


def kept_state(symbol: int, state: int) -> int | None:
    """The state after a row is kept, if it can be."""
    role = symbol // 2
    if symbol == DELETE or role == 3:
        return None
    if role == 0:
        return 1 if state == 0 else None
    return 2 if role == 1 and state != 2 else 3 if role == 2 and state == 2 else None


def choices(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """The ways to use up a row: letter, cost, state after it; letters ascending."""
    extra = TRUNCATED * (symbol % 2)
    found = [("D", COST["D"], state)]
    if symbol != DELETE:
        if (after := kept_state(symbol, state)) is not None:
            found.append(("K", extra, after))
        found.append(("R", COST["R"] + extra, NEXT[state]))
    return found


CHOICES = [[choices(symbol, state) for state in range(4)] for symbol in range(DELETE + 1)]


def product(a, b):
    """The min-plus product of two matrices given as rows."""
    columns = list(zip(*b))
    return tuple(tuple(min(FAR, min(map(int.__add__, row, column))) for column in columns) for row in a)


def times(matrix, vector):
    """The min-plus product of a matrix and the costs of what follows."""
    return tuple(min(FAR, min(map(int.__add__, row, vector))) for row in matrix)


def transition(symbol: int):
    """Inserts, then one row: the matrix of costs from state to state."""
    rows = [[FAR] * 4 for _ in range(4)]
    for start in range(4):
        state = start
        for inserts in range(3):  # a third would only come back to an earlier state
            for _, cost, after in CHOICES[symbol][state]:
                rows[start][after] = min(rows[start][after], COST["I"] * inserts + cost)
            state = NEXT[state]
    return tuple(map(tuple, rows))


UNIT = tuple(tuple(0 if i == j else FAR for j in range(4)) for i in range(4))


class Powers(dict):
    """(symbol, k) -> the matrix of 2^k rows of that symbol, computed once."""

    def __missing__(self, key):
        symbol, k = key
        half = self[symbol, k - 1] if k else None
        self[key] = product(half, half) if k else transition(symbol)
        return self[key]

    def advance(self, symbol: int, length: int, vector):
        """The costs before a run, from those after it."""
        for k in range(length.bit_length()):
            if length >> k & 1:
                vector = times(self[symbol, k], vector)
        return vector

    def matrix(self, runs: list[tuple[int, int]]):
        columns = list(UNIT)
        for symbol, length in reversed(runs):
            columns = [self.advance(symbol, length, c) for c in columns]
        return tuple(zip(*columns))


def unroll(powers: Powers, runs: list[tuple[int, int]], after, starts: Iterable[int]) -> list[tuple[str, int]]:
    """The ASCII-least cheapest edits of the runs, and the state they end in, for each state they may start in."""
    ends = []
    for symbol, length in reversed(runs):
        ends.append(after)
        after = powers.advance(symbol, length, after)
    paths = [([], s) for s in starts]
    for (symbol, length), end in zip(runs, reversed(ends)):
        if symbol == DELETE:  # deleting first is never dearer, and D sorts first
            for letters, _ in paths:
                letters.append("D" * length)
            continue
        costs = [end]
        for _ in range(length):
            costs.append(times(powers[symbol, 0], costs[-1]))
        costs.reverse()
        for i in range(length):
            here, there = costs[i], costs[i + 1]
            for p, (letters, state) in enumerate(paths):
                while True:
                    options = CHOICES[symbol][state]
                    if here[state] == options[0][1] + there[state]:
                        letters.append("D")
                        break
                    if here[state] == COST["I"] + here[NEXT[state]]:
                        letters.append("I")
                        state = NEXT[state]
                        continue
                    letter, _, state = next(o for o in options[1:] if here[state] == o[1] + there[o[2]])
                    letters.append(letter)
                    break
                paths[p] = (letters, state)
    return [("".join(letters), state) for letters, state in paths]


# --- the rows as symbols -------------------------------------------------------------------


def damage(conversations: DataFrame) -> DataFrame:
    """Planted faults by ``crc32(conv_id:turn) % 20``: 0 drops a row, 1 empties its text, 2 takes its
    ``[.!?]`` out, 3 repeats it, 4 sets the role user. Nulls count as one space. ``copies`` says how often a row is there."""

    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    key = F.concat(text("conv_id"), F.lit(":"), text("turn"))
    kind = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    changed = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text"))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(text("role")).alias("role"),
        changed.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


ORDER = ["conv_id", "turn", "role", "prefix", "digest"]


def _keyed(rows: DataFrame) -> DataFrame:
    copies = F.coalesce(F.col("copies").cast("long"), F.lit(1)) if "copies" in rows.columns else F.lit(1)
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.left(text, F.lit(PREFIX)).alias("prefix"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        text.alias("text"),
        copies.cast("long").alias("copies"),
    )


def symbols(keyed: DataFrame) -> DataFrame:
    """Per different row: its key, how often it is there, whether its role and text are new there, blank, truncated."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    whole = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    rows = keyed.where("copies > 0").groupBy(*ORDER).agg(F.sum("copies").alias("n"), F.max(blank).alias("blank"), F.max(~whole).alias("truncated"))
    # A null turn is the first one: structs compare their nulls so.
    firsts = rows.groupBy("conv_id", "role", "prefix", "digest").agg(F.min(F.struct("turn")).alias("at"))
    named = firsts.select(
        "conv_id", F.col("at.turn").alias("turn"), "role", "prefix", "digest", F.lit(0).cast("long").alias("n"), F.lit(True).alias("first"), F.lit(False).alias("blank"), F.lit(False).alias("truncated")
    )
    both = rows.withColumn("first", F.lit(False)).unionByName(named)
    return both.groupBy(*ORDER).agg(*[F.max(c).alias(c) for c in ("first", "blank", "truncated")], F.sum("n").alias("n"))


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _out(rows: Iterable[dict], schema: pa.Schema, size: int = BATCH) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


_KEY = [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("prefix", pa.string()), ("digest", pa.binary())]
_CHUNK = [
    *_KEY, ("part", pa.int64()), ("seq", pa.int64()), ("symbols", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int64())), ("matrix", pa.list_(pa.int64())),
    *[(n, pa.int64()) for n in ("n_blank", "n_duplicate", "n_truncated")],
]
_KEY_DDL = "conv_id long, turn long, role string, prefix string, digest binary"
_CHUNK_DDL = f"{_KEY_DDL}, part long, seq long, symbols array<int>, lengths array<long>, matrix array<long>, n_blank long, n_duplicate long, n_truncated long"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows -> chunks of one conversation each."""
    part, powers = TaskContext.get().partitionId(), Powers()

    def chunk(rows: list[dict], seq: int) -> dict:
        runs: list[list[int]] = []
        faults = dict.fromkeys(("n_blank", "n_duplicate", "n_truncated"), 0)

        def add(symbol: int, length: int) -> None:
            if runs and runs[-1][0] == symbol:
                runs[-1][1] += length
            elif length:
                runs.append([symbol, length])

        for row in rows:
            if row["blank"]:
                faults["n_blank"] += row["n"]
                add(DELETE, row["n"])
                continue
            if row["first"]:
                faults["n_truncated"] += row["truncated"]
                initial = ROLES.find(row["role"][:1]) if row["role"] else -1
                add(2 * (initial if initial >= 0 else 3) + row["truncated"], 1)
            rest = row["n"] - row["first"]
            faults["n_duplicate"] += rest
            add(DELETE, rest)
        matrix = [cell for line in powers.matrix(runs) for cell in line]
        return {k: rows[0][k] for k, _ in _KEY} | {"part": part, "seq": seq, "symbols": [r[0] for r in runs], "lengths": [r[1] for r in runs], "matrix": matrix} | faults

    def made() -> Iterator[dict]:
        seq = 0
        for _, own in groupby(_rows(batches), lambda r: r["conv_id"]):
            held = []
            for row in own:
                held.append(row)
                if len(held) == CHUNK:
                    yield chunk(held, seq)
                    held, seq = [], seq + 1
            if held:
                yield chunk(held, seq)
                seq += 1

    yield from _out(made(), pa.schema(_CHUNK), 64)


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks from a conversation's last to its first -> the costs after each, the costs before it, whether it is the first."""

    def made() -> Iterator[dict]:
        held = None
        for row in _rows(batches):
            same = held is not None and held["conv_id"] == row["conv_id"]
            if held is not None:
                yield held | {"first": not same}
            after = held["before"] if same else list(END)
            matrix = [row["matrix"][i : i + 4] for i in range(0, 16, 4)]
            held = row | {"after": after, "before": list(times(matrix, after))}
        if held is not None:
            yield held | {"first": True}

    schema = pa.schema([*_CHUNK, ("after", pa.list_(pa.int64())), ("before", pa.list_(pa.int64())), ("first", pa.bool_())])
    yield from _out(made(), schema, 64)


def _unrolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()

    def made() -> Iterator[dict]:
        for row in _rows(batches):
            paths = unroll(powers, list(zip(row["symbols"], row["lengths"])), tuple(row["after"]), [0] if row["first"] else range(4))
            yield {k: row[k] for k, _ in _KEY} | {"letters": [p[0] for p in paths], "ends": [p[1] for p in paths], "cost": row["before"][0] if row["first"] else 0} | {
                n: row[n] for n in ("n_blank", "n_duplicate", "n_truncated")
            }

    schema = pa.schema([*_KEY, ("letters", pa.list_(pa.string())), ("ends", pa.list_(pa.int32())), *[(n, pa.int64()) for n in ("cost", "n_blank", "n_duplicate", "n_truncated")]])
    yield from _out(made(), schema, 64)


def plan_edits(keyed: DataFrame) -> DataFrame:
    """Per chunk: its first row's key, letters and end state for each state it may start in, cost (of the whole, in the first), faults."""
    flags = symbols(keyed)
    ordered = flags.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    chunks = cut(ordered.mapInArrow(_chunks, _CHUNK_DDL), "conversation_chunks")
    back = chunks.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("seq"))
    followed = back.mapInArrow(_followed, f"{_CHUNK_DDL}, after array<long>, before array<long>, first boolean")
    dealt = followed.repartition("conv_id", "part", "seq")
    return dealt.mapInArrow(_unrolled, f"{_KEY_DDL}, letters array<string>, ends array<int>, cost long, n_blank long, n_duplicate long, n_truncated long")


_COUNTS = ("cost", "n_blank", "n_duplicate", "n_truncated")


def _walked(rows: DataFrame) -> DataFrame:
    """All rows and the chunks' letters, each chunk before its first row, every conversation in order in one partition."""
    keyed = _keyed(rows)
    plan = plan_edits(keyed)
    texts = keyed.select(*ORDER, F.lit(1).alias("kind"), "text", "copies", F.lit(None).cast("array<string>").alias("letters"), F.lit(None).cast("array<int>").alias("ends"), *[F.lit(0).cast("long").alias(c) for c in _COUNTS])
    letters = plan.select(*ORDER, F.lit(0).alias("kind"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("copies"), "letters", "ends", *_COUNTS)
    return texts.unionByName(letters).repartition("conv_id").sortWithinPartitions(*ORDER, "kind")


def _edits(own: Iterable[dict], seen) -> Iterator[tuple[str, int | None, str, str]]:
    """One conversation's rows -> letter, turn, role and text of each edit; ``seen`` is told of each row as it is."""
    state, place, letters, role_state, end = 0, 0, "", 0, 0
    for row in own:
        if row["kind"] == 0:
            pick = state if len(row["ends"]) > 1 else 0
            letters, place, state = row["letters"][pick], 0, row["ends"][pick]
            seen(row)
            continue
        for _ in range(row["copies"]):
            seen(row)
            while letters[place] == "I":
                place, role_state = place + 1, NEXT[role_state]
                yield "I", None, NAMES[role_state], ""
            letter, place = letters[place], place + 1
            role = row["role"]
            if letter == "R":
                role_state = NEXT[role_state]
                role = NAMES[role_state]
            elif letter == "K":
                role_state = 1 + ROLES.index(role[0])
            yield letter, row["turn"], role, row["text"]
    for _ in CLOSING[role_state]:
        role_state = NEXT[role_state]
        yield "I", None, NAMES[role_state], ""


def _edit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made() -> Iterator[dict]:
        for conv_id, own in groupby(_rows(batches), lambda r: r["conv_id"]):
            for place, (letter, turn, role, text) in enumerate(_edits(own, lambda r: None)):
                yield {"conv_id": conv_id, "place": place, "edit": letter, "turn": turn, "role": role, "text": text}

    names = [("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]
    yield from _out(made(), pa.schema(names))


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made() -> Iterator[dict]:
        for conv_id, own in groupby(_rows(batches), lambda r: r["conv_id"]):
            totals = dict.fromkeys((*_COUNTS, "illegal"), 0)
            last: list = [None, None, None, 0]  # initial of the row before, first turn, last turn, different turns

            def seen(row: dict) -> None:
                if row["kind"] == 0:
                    for c in _COUNTS:
                        totals[c] += row[c]
                    return
                initial = row["role"][:1]
                totals["illegal"] += last[0] is not None and last[0] + initial not in ("su", "ua", "au")
                last[0] = initial
                if row["turn"] is not None and row["turn"] != last[2]:
                    last[1], last[2], last[3] = row["turn"] if last[1] is None else last[1], row["turn"], last[3] + 1

            digest, audit, between = hashlib.sha256(), [], b""
            for letter, _, role, text in _edits(own, seen):
                audit.append(letter)
                if letter != "D":
                    digest.update(between + role.encode("utf-8", "surrogatepass") + b":" + text.encode("utf-8", "surrogatepass"))
                    between = b"\n"
            gaps = last[2] - last[1] + 1 - last[3] if last[3] else 0
            yield {"conv_id": conv_id, "gaps": gaps, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()} | totals

    names = [("conv_id", pa.int64()), ("gaps", pa.int64()), *[(c, pa.int64()) for c in (*_COUNTS, "illegal")], ("audit", pa.string()), ("repaired_sha256", pa.string())]
    yield from _out(made(), pa.schema(names))


def repair(rows: DataFrame) -> DataFrame:
    """The edits of every conversation: conv_id, place, edit (K, R, D or I), turn, role, text.

    ``rows`` has conv_id, turn, role, text and perhaps copies. Rows with another edit than D, by place, are the repaired conversation.
    """
    return _walked(rows).mapInArrow(_edit_rows, "conv_id long, place long, edit string, turn long, role string, text string")


def report(rows: DataFrame) -> DataFrame:
    """Per conversation: gaps, faults, illegal neighbours, cost and audit of its repair, SHA-256 of the repaired rows."""
    found = _walked(rows).mapInArrow(
        _reports, "conv_id long, gaps long, cost long, n_blank long, n_duplicate long, n_truncated long, illegal long, audit string, repaired_sha256 string"
    )
    names = {"n_blank": "blank", "n_duplicate": "duplicate", "n_truncated": "truncated"}
    return found.select("conv_id", "gaps", *[F.col(a).alias(b) for a, b in names.items()], "illegal", "cost", "audit", "repaired_sha256")


# --- the same as SQL ----------------------------------------------------------------------


def sql(conversations: str = "conversations") -> str:
    """DuckDB SQL for the report of the damaged rows: a fold over each conversation's rows, one best path per state."""

    def path(x: str, cost: str, letter: str, line: str | None = None) -> str:
        return f"struct_pack(c := {x}.c + {cost}, a := {x}.a || '{letter}', r := {x}.r" + (f" || chr(10) || {line})" if line else ")")

    def inserted(x: str, role: str) -> str:
        return path(x, "5", "I", f"'{role}:'")

    def kept(x: str, initial: str) -> str:
        return path(x, f"(CASE WHEN e.i = '{initial}' THEN e.t ELSE 1000000000 END)", "K", "e.k")

    def reroled(x: str, role: str) -> str:
        return path(x, "(CASE WHEN e.i = 'd' THEN 1000000000 ELSE 1 + e.t END)", "R", f"'{role}:' || e.x")

    insert = f"[p[1], p[2], list_min([p[3], {', '.join(inserted(f'p[{q}]', 'user') for q in (1, 2, 4))}]), list_min([p[4], {inserted('p[3]', 'assistant')}])]"
    row = ", ".join(
        [
            path("p[1]", "2", "D"),
            f"list_min([{path('p[2]', '2', 'D')}, {kept('p[1]', 's')}])",
            f"list_min([{path('p[3]', '2', 'D')}, {', '.join(kept(f'p[{q}]', 'u') + ', ' + reroled(f'p[{q}]', 'user') for q in (1, 2, 4))}])",
            f"list_min([{path('p[4]', '2', 'D')}, {kept('p[3]', 'a')}, {reroled('p[3]', 'assistant')}])",
        ]
    )
    start = ", ".join(f"struct_pack(c := {c}::BIGINT, a := '', r := '')" for c in (0, 10**9, 10**9, 10**9))
    gap = "struct_pack(i := 'i', t := 0::BIGINT, k := '', x := '')"
    crc = "xor(list_reduce(list_transform(range(1, length(k) + 1), lambda j: ascii(substr(k, j::INT, 1))::BIGINT), lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"
    return f"""
    WITH bits AS (SELECT b::BIGINT AS b, list_reduce(range(8), lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, b::BIGINT) AS v FROM range(256) s(b)),
    crc AS (SELECT list(v ORDER BY b) AS t FROM bits),
    o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM {conversations}),
    h AS (SELECT *, {crc} % 20 AS kind FROM o CROSS JOIN crc),
    d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
                 CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                 unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h),
    g AS (SELECT *, row_number() OVER w AS n, left(role, 1) AS initial, lag(left(role, 1)) OVER w AS before
          FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
    f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
                      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
                      WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM g),
    e AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate,
                 count_if(fault = 'truncated') AS truncated, count_if(before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
                 flatten(list([{gap}, {gap}, struct_pack(i := CASE WHEN fault IN ('blank', 'duplicate') THEN 'd' WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'o' END,
                               t := CASE fault WHEN 'truncated' THEN 5::BIGINT ELSE 0::BIGINT END, k := role || ':' || text, x := text)] ORDER BY n)) || [{gap}, {gap}] AS steps
          FROM f GROUP BY conv_id),
    p AS (SELECT *, list_reduce(steps, lambda p, e: CASE WHEN e.i = 'i' THEN {insert} ELSE [{row}] END, [{start}]) AS ends FROM e),
    b AS (SELECT *, list_min([ends[1], ends[4]]) AS best FROM p)
    SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
           coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.r, 2), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM {conversations}) c LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
    """
