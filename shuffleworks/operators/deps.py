"""Dependencies of a corpus and the ones at risk.

Prefix and substring matches are written as equi-joins, as in-row filters, or as walks
through an index that every task holds; there is no nested-loop join.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shuffleworks.constants import (
    BUILD_SUGGESTION,
    DEFAULT_SUGGESTION,
    GRADLE_PATTERN,
    MAVEN_PATTERN,
    SUGGESTIONS,
)
from shuffleworks.functions.text import strip_blanks
from shuffleworks.session import durable

ROWS = 1_000_000  # of one key that one task of a join may get
FEW, FEW_BYTES = 200_000, 8 << 20  # prefixes, and bytes of them, that every task may hold
Q = 4  # characters of the q-grams that prefixes are filed under
GRAM_BITS = 24
HITS = 10_000  # of a batch

ITEM_COLUMNS = ["matched_prefix", "artifact", "location", "is_transitive", "suggestion"]


def usable_prefixes(prefixes: list[str]) -> list[str]:
    """The prefixes that are not blank, in order, each once."""
    return list(dict.fromkeys(p for p in prefixes if p.strip()))


def _each_once(prefixes: DataFrame) -> DataFrame:
    """One row per prefix of a table that is not blank, at its first place."""
    return prefixes.where(F.col("prefix").rlike(r"(?U)\S")).groupBy("prefix").agg(F.min("prefix_pos").alias("prefix_pos"))


def _met(rows: DataFrame, key: str, wanted: DataFrame, kept: list[str]) -> DataFrame:
    """``rows`` joined with the prefixes of the same ``key``, as ``kept, prefix_pos, prefix``.

    A key that many rows have is counted (in the map tasks), and its prefixes are copied to as many
    tasks as there are ``ROWS`` of it; all others are joined as they are. The salt of a row follows
    from its values and the map task, so a retried task salts alike.
    """
    often = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / ROWS).cast("int").alias("_n")).where("_n > 1")
    heavy = F.broadcast(durable(often.join(wanted.select(key).distinct(), key, "left_semi")))  # at most a key for each ROWS rows
    salt = F.pmod(F.xxhash64(*kept) + F.spark_partition_id(), F.coalesce("_n", F.lit(1)))
    salted = rows.join(heavy, key, "left").withColumn("_salt", salt.cast("int")).drop("_n")
    copies = wanted.join(heavy, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1))).drop("_n")
    return salted.join(copies, [key, "_salt"]).select(*kept, "prefix_pos", "prefix")


def _few(wanted: DataFrame) -> list[tuple[int, str]] | None:
    """The prefixes, if together they are small enough for every task to hold."""
    size = wanted.agg(F.count(F.lit(1)), F.sum(F.octet_length("prefix"))).first()
    if size[0] > FEW or (size[1] or 0) > FEW_BYTES:
        return None
    return sorted((r["prefix_pos"], r["prefix"]) for r in wanted.select("prefix_pos", "prefix").collect())


def _matched_inside(df: DataFrame, col: str, given: list[tuple[int, str]], finder: Callable) -> DataFrame:
    """Each row once for each of the prefixes that ``finder(given)(text)`` numbers, in one pass over the texts."""
    at = df.columns.index(col)
    sent = df.sparkSession.sparkContext.broadcast(given)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = finder(sent.value)
        for batch in batches:
            hits = [(i, n) for i, text in enumerate(batch.column(at).to_pylist()) if text is not None for n in found(text)]
            for start in range(0, len(hits), HITS):
                part = hits[start : start + HITS]
                rows = batch.take(pa.array([i for i, _ in part], pa.int64()))
                own = [pa.array([sent.value[n][0] for _, n in part], pa.int32()), pa.array([sent.value[n][1] for _, n in part])]
                yield pa.RecordBatch.from_arrays([*rows.columns, *own], names=[*batch.schema.names, "prefix_pos", "prefix"])

    schema = T.StructType([*df.schema.fields, T.StructField("prefix_pos", T.IntegerType()), T.StructField("prefix", T.StringType())])
    return df.mapInArrow(run, schema)


def trie(given: list[tuple[int, str]]) -> Callable[[str], list[int]]:
    """Numbers of the prefixes that a text starts with, by one walk from its first character."""
    root: dict = {}
    for number, (_, prefix) in enumerate(given):
        node = root
        for c in prefix:
            node = node.setdefault(c, {})
        node[""] = number

    def found(text: str) -> list[int]:
        out, node = [], root
        for c in text:
            node = node.get(c)
            if node is None:
                break
            if "" in node:
                out.append(node[""])
        return out

    return found


def grams_of(text: str, sizes: Iterable[int]) -> set[str]:
    return {text[i : i + n] for n in sizes for i in range(len(text) - n + 1)}


def gram_index(given: list[tuple[int, str]]) -> Callable[[str], list[int]]:
    """Numbers of the prefixes that occur in a text: one of its q-grams leads to a prefix, which is then looked for."""
    shared = Counter(g for _, p in given for g in grams_of(p, [min(Q, len(p))]))
    index: dict[str, list[int]] = {}
    for number, (_, prefix) in enumerate(given):
        index.setdefault(min(grams_of(prefix, [min(Q, len(prefix))]), key=lambda g: (shared[g], g)), []).append(number)
    sizes = sorted({len(g) for g in index})

    def found(text: str) -> list[int]:
        return sorted(n for g in grams_of(text, sizes) & index.keys() for n in index[g] if given[n][1] in text)

    return found


def _text_grams(col: str, df: DataFrame, sizes: list[int], wanted: DataFrame, kept: list[str]) -> DataFrame:
    """``kept, _gram``: the different q-grams of each text that may be among the wanted ones, by a bitmap of fixed size over their hashes."""
    at = F.crc32(F.col("_gram").cast("binary")).bitwiseAND(F.lit((1 << GRAM_BITS) - 1)) + 1
    maps = wanted.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("v"))
    whole = bytearray(1 << GRAM_BITS >> 3)
    for row in maps.collect():  # at most 2^GRAM_BITS / 32768 rows of 4 KB
        whole[(row["k"] - 1) * 4096 : row["k"] * 4096] = row["v"]
    sent = df.sparkSession.sparkContext.broadcast(bytes(whole))
    rows = df.select(*kept, F.col(col).alias("_t"))
    mask = (1 << GRAM_BITS) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def there(gram: str) -> bool:
            at = zlib.crc32(gram.encode("utf-8", "surrogatepass")) & mask
            return sent.value[at >> 3] >> (at & 7) & 1 == 1

        for batch in batches:
            hits = [(i, g) for i, text in enumerate(batch.column(len(kept)).to_pylist()) if text is not None for g in grams_of(text, sizes) if there(g)]
            for start in range(0, len(hits), HITS):
                part = hits[start : start + HITS]
                own = batch.take(pa.array([i for i, _ in part], pa.int64())).columns[: len(kept)]
                yield pa.RecordBatch.from_arrays([*own, pa.array([g for _, g in part], pa.string())], names=[*batch.schema.names[: len(kept)], "_gram"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[: len(kept)], T.StructField("_gram", T.StringType())]))


def explode_imports(classes: DataFrame) -> DataFrame:
    """One row per import of a class: ``file_path, class_pos, class_name, import_pos, import``."""
    return classes.select(
        "file_path", "class_pos", "class_name", F.posexplode("imports").alias("import_pos", "import")
    )


def _inline_matches(df: DataFrame, prefixes: list[str], hit) -> DataFrame:
    entries = F.array(
        *[F.struct(F.lit(i).alias("prefix_pos"), F.lit(p).alias("prefix")) for i, p in enumerate(prefixes)]
    )
    return df.withColumn("_m", F.explode(F.filter(entries, lambda e: hit(e["prefix"])))).select(
        *df.columns, "_m.prefix_pos", "_m.prefix"
    )


def _none(df: DataFrame) -> DataFrame:
    return df.select("*", F.lit(0).alias("prefix_pos"), F.lit("").alias("prefix")).where(F.lit(False))


def _lengths(prefixes: DataFrame) -> list[int]:
    """The distinct lengths of the prefixes: at most as many as the longest has characters."""
    found = prefixes.select(F.length("prefix").alias("n")).distinct().collect()
    return sorted(r["n"] for r in found)


def match_prefix(df: DataFrame, col: str, prefixes: list[str] | DataFrame) -> DataFrame:
    """Rows joined with every prefix that ``col`` starts with, as ``prefix_pos, prefix``.

    There is no boundary rule: ``com.company`` also matches ``com.companyx``. A
    list, which becomes part of the plan, is tested inside the row. Of a table
    ``(prefix_pos, prefix)`` the size is looked at first: a small one goes to all tasks as a trie, which
    is walked once per text, without a shuffle. A larger one is joined by hash: the text is cut to each
    prefix length that occurs, and the cuts are compared for equality. Blank
    prefixes match nothing, either way.
    """
    text = F.col(col)
    if isinstance(prefixes, list):
        prefixes = usable_prefixes(prefixes)
        return _inline_matches(df, prefixes, lambda p: text.startswith(p)) if prefixes else _none(df)
    wanted = durable(_each_once(prefixes))
    given = _few(wanted)
    if given is not None:
        return _matched_inside(df, col, given, trie)
    fitting = F.filter(F.array(*[F.lit(n) for n in _lengths(wanted)]), lambda n: n <= F.length(text))
    cut = df.withColumn("_cut", F.explode(F.transform(fitting, lambda n: F.substring(text, F.lit(1), n))))
    return _met(cut, "_cut", wanted.withColumn("_cut", F.col("prefix")), df.columns)


def match_contains(df: DataFrame, col: str, prefixes: list[str] | DataFrame) -> DataFrame:
    """Rows joined with every prefix that occurs anywhere in ``col``, as ``prefix_pos, prefix``.

    A list is tested inside the row. A table goes through an inverted index of q-grams: a prefix is
    filed under one of its ``Q``-grams (or under itself, if it is shorter), a text looks up its
    different q-grams, and only what it meets there is looked for in it. A small table goes to all
    tasks. Of a larger one the q-grams are first counted over all texts: a prefix is filed under its
    rarest, one with a q-gram that no text has matches nothing, and texts and prefixes meet by join.
    """
    text = F.col(col)
    if isinstance(prefixes, list):
        prefixes = usable_prefixes(prefixes)
        return _inline_matches(df, prefixes, lambda p: text.contains(p)) if prefixes else _none(df)
    wanted = durable(_each_once(prefixes))
    given = _few(wanted)
    if given is not None:
        return _matched_inside(df, col, given, gram_index)
    size = F.least(F.length("prefix"), F.lit(Q))
    starts = F.sequence(F.lit(1), F.length("prefix") - size + 1)
    filed = wanted.withColumn("_gram", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring("prefix", i, size)))))
    sizes = [n for n in _lengths(wanted) if n < Q] + [Q]
    counts = _text_grams(col, df, sizes, filed, []).groupBy("_gram").agg(F.count(F.lit(1)).alias("_c"))
    counted = filed.join(counts, "_gram", "left").groupBy("prefix", "prefix_pos").agg(
        F.bool_and(F.col("_c").isNotNull()).alias("_all"), F.min_by("_gram", F.struct("_c", "_gram")).alias("_gram")
    )
    chosen = durable(counted.where("_all").drop("_all"))
    met = _met(_text_grams(col, df, sizes, chosen, df.columns), "_gram", chosen, df.columns)
    return met.where(text.contains(F.col("prefix")))


def maven_dependencies(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``path, dep_pos, dep`` as group:artifact; the project's own coordinates are found too."""
    pairs = F.regexp_extract_all(F.col(content), F.lit(MAVEN_PATTERN), F.lit(0))
    found = files.select(F.col(path).alias("path"), F.posexplode(pairs).alias("dep_pos", "_pair"))
    part = lambda g: strip_blanks(F.regexp_extract("_pair", MAVEN_PATTERN, g))
    return found.select("path", "dep_pos", F.concat_ws(":", part(1), part(2)).alias("dep"))


def gradle_dependencies(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``path, dep_pos, dep`` of quoted coordinates; a version with letters is not matched."""
    found = F.regexp_extract_all(F.col(content), F.lit(GRADLE_PATTERN), F.lit(1))
    return files.select(F.col(path).alias("path"), F.posexplode(found).alias("dep_pos", "dep"))


def build_dependencies(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Dependencies of all build files, by suffix: ``.xml``, or ``.gradle`` and ``.kts``."""
    is_gradle = F.col(path).endswith(".gradle") | F.col(path).endswith(".kts")
    return maven_dependencies(files.where(F.col(path).endswith(".xml")), path, content).unionByName(
        gradle_dependencies(files.where(is_gradle), path, content)
    )


def suggest_alternative(imported: Column) -> Column:
    """Advice for an import: the first contained pattern decides."""
    (first_pattern, first_advice), *rest = SUGGESTIONS.items()
    advice = F.when(imported.contains(first_pattern), first_advice)
    for pattern, text in rest:
        advice = advice.when(imported.contains(pattern), text)
    return advice.otherwise(DEFAULT_SUGGESTION)


def dedupe_first(items: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in ``order``; repeats are dropped before the shuffle.

    ``order`` must be unique within a key.
    """
    rest = [c for c in items.columns if c not in keys]
    first = items.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return first.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in items.columns])


def scan_risks(
    classes: DataFrame,
    build_files: DataFrame | None,
    prefixes: list[str] | DataFrame,
    path: str = "path",
    content: str = "content",
) -> DataFrame:
    """Risk items ``matched_prefix, artifact, location, is_transitive, suggestion``.

    Imports that start with a prefix and build dependencies that contain one.
    Of the items for one artifact in one file, the first stays: imports before
    builds, then by place in the file, then by place in the prefix list.
    """
    hits = match_prefix(explode_imports(classes), "import", prefixes)
    items = hits.select(
        F.col("prefix").alias("matched_prefix"),
        F.col("import").alias("artifact"),
        F.coalesce("file_path", F.lit("unknown")).alias("location"),
        suggest_alternative(F.col("import")).alias("suggestion"),
        F.array(F.lit(0), "class_pos", "import_pos", "prefix_pos").alias("_order"),
    )
    if build_files is not None:
        found = match_contains(build_dependencies(build_files, path, content), "dep", prefixes)
        items = items.unionByName(
            found.select(
                F.col("prefix").alias("matched_prefix"),
                F.col("dep").alias("artifact"),
                F.col("path").alias("location"),
                F.lit(BUILD_SUGGESTION).alias("suggestion"),
                F.array(F.lit(1), F.lit(0), "dep_pos", "prefix_pos").alias("_order"),
            )
        )
    unique = dedupe_first(items, ["artifact", "location"], ["_order"])
    return unique.withColumn("is_transitive", F.lit(False)).select(*ITEM_COLUMNS)


def risk_verdict(items: DataFrame, action: str = "warn") -> DataFrame:
    """One row ``total_count, transitive_count, blocked``, also for no items."""
    counts = items.agg(
        F.count(F.lit(1)).alias("total_count"), F.count_if(F.col("is_transitive")).alias("transitive_count")
    )
    return counts.withColumn("blocked", F.lit(action == "block") & (F.col("total_count") > 0))
