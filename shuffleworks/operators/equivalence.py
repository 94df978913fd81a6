"""Are two datasets the same? Row counts, an order-free checksum, and the rows that differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shuffleworks.functions.hashing import canonical_row, hash_words, join_words
from shuffleworks.session import scratch_path

_WORDS = ("w1", "w2", "w3", "w4")


def _hashed(df: DataFrame, columns: list[str] | None, scale: int | None, *kept: str) -> DataFrame:
    words = hash_words(F.col("_text"))
    return df.select(canonical_row(df, columns, scale).alias("_text"), *kept).select(
        *[w.alias(n) for w, n in zip(words, _WORDS)], *kept
    )


def checksum(df: DataFrame, columns: list[str] | None = None, scale: int | None = None) -> DataFrame:
    """One row ``row_count, checksum``: the sum of a 64-bit hash over all rows.

    A sum does not depend on the order of rows or partitions and, unlike xor,
    does change when a row is there twice. No rows give 0. Doubles count exactly,
    or rounded to ``scale`` decimals.
    """
    sums = _hashed(df, columns, scale).agg(
        F.count(F.lit(1)).alias("row_count"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in _WORDS]
    )
    return sums.select("row_count", join_words([F.col(n) for n in _WORDS]).alias("checksum"))


def row_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row ``left_rows, right_rows``, from one aggregate over both."""
    sides = left.select(F.lit(0).alias("_side")).union(right.select(F.lit(1).alias("_side")))
    return sides.agg(
        F.count_if(F.col("_side") == 0).alias("left_rows"), F.count_if(F.col("_side") == 1).alias("right_rows")
    )


def _check_columns(left: DataFrame, right: DataFrame, columns: list[str] | None) -> list[str]:
    names = columns or left.columns
    missing = [n for n in names if n not in left.columns or n not in right.columns]
    if missing or (columns is None and set(left.columns) != set(right.columns)):
        raise ValueError(f"columns differ: {left.columns} and {right.columns}")
    return names


def _together(left: DataFrame, right: DataFrame, names: list[str], tag: str, of_left: int, of_right: int) -> DataFrame:
    columns = [F.col(f"`{n}`") for n in names]
    return left.select(*columns, F.lit(of_left).alias(tag)).unionByName(right.select(*columns, F.lit(of_right).alias(tag)))


def compare(left: DataFrame, right: DataFrame, columns: list[str] | None = None, scale: int | None = None) -> DataFrame:
    """One row ``passed, left_rows, right_rows, checksum_match, details``.

    Both sides go through one aggregate; nothing but partial sums is shuffled. The
    union gives both sides one type per column before anything is hashed.
    Without a ``scale``, ``passed`` says that ``diff_rows`` finds nothing.
    """
    names = _check_columns(left, right, columns)
    tagged = _hashed(_together(left, right, names, "_side", 0, 1), names, scale, "_side")

    def of_side(side: int, name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("_side") == side, F.col(name))), F.lit(0)).alias(f"{name}_{side}")

    sums = tagged.agg(
        F.count_if(F.col("_side") == 0).alias("left_rows"),
        F.count_if(F.col("_side") == 1).alias("right_rows"),
        *[of_side(side, name) for side in (0, 1) for name in _WORDS],
    )
    totals = sums.select(
        "left_rows",
        "right_rows",
        *[join_words([F.col(f"{n}_{side}") for n in _WORDS]).alias(f"_sum_{side}") for side in (0, 1)],
    )
    same_rows = F.col("left_rows") == F.col("right_rows")
    same_sum = F.col("_sum_0") == F.col("_sum_1")
    details = F.concat(
        F.format_string("rows %s: %d vs %d; ", F.when(same_rows, "equal").otherwise("differ"), "left_rows", "right_rows"),
        F.when(same_sum, "checksums equal").otherwise("checksums differ"),
    )
    return totals.select(
        (same_rows & same_sum).alias("passed"),
        "left_rows",
        "right_rows",
        same_sum.alias("checksum_match"),
        details.alias("details"),
    )


_TOP, _DEEP = 16, 27  # bits of a hash: ranges of the first level, and of the bitmaps of suspects


def _unequal(signed: DataFrame, keys: list[str], *words: Column) -> DataFrame:
    """Keys whose rows do not balance: in number, or in the sums of the words."""
    sums = [F.sum(F.col("_sign") * w).alias(f"_s{i}") for i, w in enumerate(words)]
    totals = signed.groupBy(*keys).agg(F.sum("_sign").alias("_n"), *sums)
    wrong = F.col("_n") != 0
    for i in range(len(words)):
        wrong = wrong | (F.col(f"_s{i}") != 0)
    return totals.where(wrong).select(*keys)


def _bits(hash_: Column, n: int) -> Column:
    return F.shiftrightunsigned(hash_, 64 - n)


def _in_bitmap(rows: DataFrame, suspects: DataFrame, key: str) -> DataFrame:
    """Rows whose top bits of ``key`` some suspect has. The bitmap is broadcast: at most 4,096 rows of 4 KB."""
    at = lambda c: _bits(c, _DEEP) + 1  # noqa: E731  the bitmap functions count from 1
    maps = suspects.groupBy(F.bitmap_bucket_number(at(F.col(key))).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at(F.col(key)))).alias("_bits"))
    place = F.bitmap_bit_position(at(F.col(key))).cast("int")
    octet = F.conv(F.hex(F.substring("_bits", F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    bit = octet.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), place.bitwiseAND(F.lit(7)) + 1))
    found = rows.withColumn("_bucket", F.bitmap_bucket_number(at(F.col(key)))).join(F.broadcast(maps), "_bucket")
    return found.where(bit != 0).drop("_bucket", "_bits")


def suspect_rows(signed: DataFrame) -> DataFrame:
    """The rows whose hashes ``_h1, _h2`` do not balance by ``_sign``, found through a tree of checksums.

    The hashes, 17 bytes a row, are written to the shared folder at once and read from there, since
    the texts behind them are most of the work. First both sides are summed in 65,536 ranges of the hash,
    in the map tasks; only the ranges that do not balance are opened, and only the hashes in them are
    shuffled, to find those that do not balance. Bitmaps of fixed size over two independent parts of these then let rows pass: an equal
    row passes with a chance of (unequal rows / 2^27)^2, and is sorted out when rows are counted.
    """
    words = [F.shiftright("_h2", s).bitwiseAND(F.lit(0xFFFF)) for s in (0, 16, 32, 48)]  # sums that stay inside bigint
    hashes = signed.select("_h1", "_h2", F.col("_sign").cast("tinyint").alias("_sign"))
    path = scratch_path(signed.sparkSession, "row_hashes")
    hashes.write.parquet(path)
    # A hash is never null; with this said of both, the two bitmaps share one shuffle.
    written = signed.sparkSession.read.schema(hashes.schema).parquet(path).where("_h1 is not null and _h2 is not null")
    ranged = written.withColumn("_range", _bits(F.col("_h1"), _TOP))
    ranges = F.broadcast(_unequal(ranged, ["_range"], *words))  # at most 65,536 numbers
    opened = ranged.join(ranges, "_range", "left_semi").drop("_range")
    suspects = _unequal(opened, ["_h1", "_h2"])
    return _in_bitmap(_in_bitmap(signed, suspects, "_h1"), suspects, "_h2")


def diff_rows(
    left: DataFrame, right: DataFrame, columns: list[str] | None = None, by_hash: bool = True
) -> DataFrame:
    """Rows that are there a different number of times: the columns, ``side``, ``times``.

    ``side`` says where the surplus is. Rows are the same if ``compare`` takes them
    for the same: by their canonical text. With ``by_hash`` unequal rows are found through a tree
    of checksums of 128-bit hashes (``suspect_rows``), so that equal rows are not shuffled, neither
    whole nor, in ranges without a difference, by their hashes. Best where most rows agree; their hashes
    are written to the shared folder when this is called. Without it whole texts are counted at once.
    """
    names = _check_columns(left, right, columns)
    signed = _together(left, right, names, "_sign", 1, -1)
    keys = ["_h1", "_h2"] if by_hash else ["_text"]
    signed = signed.withColumn("_text", canonical_row(signed, names))
    if by_hash:
        hashed = signed.withColumns({"_h1": F.xxhash64("_text"), "_h2": F.xxhash64(F.lit(1), "_text")}).drop("_text")
        signed = suspect_rows(hashed)
    counted = signed.groupBy(*keys).agg(F.sum("_sign").alias("_n"), *[F.first(F.col(f"`{n}`")).alias(n) for n in names])
    return counted.where(F.col("_n") != 0).select(
        *[F.col(f"`{n}`") for n in names],
        F.when(F.col("_n") > 0, "left").otherwise("right").alias("side"),
        F.abs("_n").alias("times"),
    )
