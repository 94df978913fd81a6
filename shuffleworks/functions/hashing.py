"""One canonical text per row, and a 64-bit number from it.

The text does not depend on the engine that wrote the row: null differs from an
empty string, the separator cannot be forged, doubles are written exactly (or as
whole numbers of their last counted decimal, if a scale is asked for), a decimal
has no trailing zeros, maps are in the order of their keys, and time stamps are
microseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shuffleworks.functions.timing import epoch_micros

SEPARATOR = "|"
NULL_MARK = "\\N"
_EXACT = 9.0e15  # whole numbers below this have exact doubles


def _escaped(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    # Looking is far cheaper than replacing, and few values have either.
    return F.when(text.contains("\\") | text.contains(SEPARATOR), F.replace(doubled, F.lit(SEPARATOR), F.lit("\\p"))).otherwise(text)


def _sized(text: Column) -> Column:
    """A part of a nested value, its length before it, so that parts in a row cannot be read in two ways."""
    return F.concat(F.length(text).cast("string"), F.lit(":"), text)


def _sized_field(text: Column, kind: T.DataType) -> Column:
    """``_sized``, the text of a nested field worked out once: as twice, a value n levels deep would be 2^n times."""
    nested = isinstance(kind, (T.ArrayType, T.StructType, T.MapType))
    return F.transform(F.array(text), _sized)[0] if nested else _sized(text)


def canonical(column: Column, kind: T.DataType, scale: int | None = None) -> Column:
    """Canonical text of one value, nested ones by recursion over the type; null gives ``\\N``.

    Both zeros are one value, and so are all NaNs, also inside arrays, structs and maps; a scale counts there too.
    """
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        text = _escaped(column)
    elif isinstance(kind, (T.FloatType, T.DoubleType)) and scale is None:
        text = (column.cast("double") + F.lit(0.0)).cast("string")
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        # Whole numbers of 10^-scale, halves up: arithmetic that every engine
        # does alike, and far cheaper than printing a decimal per value. Values
        # beyond its range keep a decimal text, and NaN its own.
        value = column.cast("double")
        scaled = value * F.lit(float(10**scale)) + F.lit(0.5)
        wide = F.coalesce(value.try_cast(f"decimal(38,{scale})").cast("string"), value.cast("string"))
        text = F.when(F.abs(scaled) < F.lit(_EXACT), F.floor(scaled).cast("string")).otherwise(wide)
    elif isinstance(kind, T.TimestampNTZType):
        text = epoch_micros(column).cast("string")
    elif isinstance(kind, T.TimestampType):
        text = F.unix_micros(column).cast("string")
    elif isinstance(kind, T.DecimalType):
        digits = column.cast("string")
        text = F.when(digits.contains("."), F.regexp_replace(digits, r"\.?0+$", "")).otherwise(digits)
    elif isinstance(kind, T.BinaryType):
        text = F.hex(column)
    elif isinstance(kind, T.ArrayType):
        texts = F.transform(column, lambda v: canonical(v, kind.elementType, scale))
        text = F.array_join(F.transform(texts, _sized), "")
    elif isinstance(kind, T.StructType):
        fields = [_sized_field(canonical(column.getField(f.name), f.dataType, scale), f.dataType) for f in kind.fields]
        text = F.when(column.isNotNull(), F.concat(F.lit(""), *fields))
    elif isinstance(kind, T.MapType):
        texts = lambda e: F.array(canonical(e["key"], kind.keyType, scale), canonical(e["value"], kind.valueType, scale))
        entry = lambda both: F.array_join(F.transform(both, _sized), "")
        text = F.array_join(F.sort_array(F.transform(F.transform(F.map_entries(column), texts), entry)), "")
    else:
        text = column.cast("string")
    return F.coalesce(text, F.lit(NULL_MARK))


def canonical_row(df: DataFrame, columns: list[str] | None = None, scale: int | None = None) -> Column:
    """Canonical text of a row, values joined by ``|``."""
    names = columns or df.columns
    return F.concat_ws(SEPARATOR, *[canonical(F.col(f"`{n}`"), df.schema[n].dataType, scale) for n in names])


def hash_words(text: Column) -> list[Column]:
    """The first 64 bits of the md5 of ``text`` as four 16-bit numbers, high first.

    Sums of 16-bit numbers stay inside bigint for 10^14 rows, so a checksum over
    a whole table needs no decimal arithmetic per row.
    """
    digest = F.md5(text)
    words = []
    for start in (1, 9):
        half = F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")
        words += [F.shiftright(half, 16), half.bitwiseAND(F.lit(0xFFFF))]
    return words


def join_words(words: list[Column]) -> Column:
    """Put four word sums together to the exact sum of the 64-bit numbers."""
    total = F.lit(0).cast("decimal(38,0)")
    for word, power in zip(words, (48, 32, 16, 0)):
        total = (total + word.cast("decimal(20,0)") * F.lit(2**power).cast("decimal(15,0)")).cast("decimal(38,0)")
    return total
