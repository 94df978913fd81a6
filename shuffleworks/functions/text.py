"""Text expressions: tokens, comma lists with nesting, comments, decoding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# A token ends at a space, tab, line feed, carriage return or form feed, and at
# nothing else. The class is written out: \s would also split on vertical tab.
TOKEN_DELIMITERS = "[ \t\n\r\f]+"
BLANKS = " \t\n\r\f\x0b"

# Text blocks, strings, characters and comments of Java source. An open comment
# runs to the end of the file. The loops are possessive: they do not recurse, so
# a long string cannot exhaust the stack.
JAVA_NON_CODE = (
    r'(?s)""".*?(?:"""|\z)'
    r'|"(?:[^"\\\n]|\\.)*+"'
    r"|'(?:[^'\\\n]|\\.)*+'"
    r"|/\*.*?(?:\*/|\z)"
    r"|//[^\n]*"
)


def tokens(text: Column) -> Column:
    """Array of the non-empty tokens of ``text``, case kept."""
    return F.array_remove(F.split(text, TOKEN_DELIMITERS), "")


def strip_blanks(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def null_if_empty(text: Column) -> Column:
    return F.when(text != "", text)


def squeeze_blanks(text: Column) -> Column:
    return strip_blanks(F.regexp_replace(text, r"\s+", " "))


def code_only(source: Column) -> Column:
    """Java source without comments and literals, every run of blanks one space.

    With single spaces the class pattern takes linear time, whatever the layout.
    """
    return F.regexp_replace(F.regexp_replace(source, JAVA_NON_CODE, " "), r"\s+", " ")


def decode_utf8(content: Column) -> Column:
    """Bytes to text; bytes that are not UTF-8 become U+FFFD, nothing is lost."""
    return F.make_valid_utf8(content.cast("string"))


def contains_any(text: Column, parts: list[str]) -> Column:
    """True when ``text`` contains at least one of ``parts``."""
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


def split_top_level(text: Column) -> Column:
    """Split on commas that are outside ``<...>``, parts trimmed.

    The text is cut at every comma, then pieces are glued back together while a
    bracket is open. An empty last part is not a part; empty parts in between
    stay.
    """
    pieces = F.split(text, ",")

    def count(piece: Column, mark: str) -> Column:
        return F.length(piece) - F.length(F.replace(piece, F.lit(mark), F.lit("")))

    start = F.struct(
        F.lit(0).alias("depth"),
        F.lit("").alias("pending"),
        F.array().cast("array<string>").alias("parts"),
    )

    def step(state: Column, piece: Column) -> Column:
        depth = state["depth"] + count(piece, "<") - count(piece, ">")
        joined = F.concat(state["pending"], piece)
        closed = depth == 0
        return F.struct(
            depth.alias("depth"),
            F.when(closed, F.lit("")).otherwise(F.concat(joined, F.lit(","))).alias("pending"),
            F.when(closed, F.concat(state["parts"], F.array(joined))).otherwise(state["parts"]).alias("parts"),
        )

    def finish(state: Column) -> Column:
        # Text that never closed its brackets is one last part, without the
        # comma that step() put behind it.
        open_text = F.substring(state["pending"], F.lit(1), F.length(state["pending"]) - 1)
        parts = F.when(open_text != "", F.concat(state["parts"], F.array(open_text))).otherwise(state["parts"])
        trailing = F.coalesce(F.try_element_at(parts, F.lit(-1)) == "", F.lit(False))
        kept = F.when(trailing, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
        return F.transform(kept, strip_blanks)

    return F.aggregate(pieces, start, step, finish)
