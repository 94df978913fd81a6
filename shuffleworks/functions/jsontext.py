"""Strict JSON in Arrow batches.

``from_json`` and the variant parser accept text behind the closing brace and
reject some documents that a strict parser takes, so neither can decide whether
a text is valid. The helpers here are small and run per batch; what follows on
the parsed text is done with built-in functions.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shuffleworks.constants import CONTROL_CHARACTERS, FENCED_JSON, STRAY_BACKSLASH

_FENCED = re.compile(FENCED_JSON, re.DOTALL)
_CONTROL = re.compile(CONTROL_CHARACTERS)
_STRAY_BACKSLASH = re.compile(STRAY_BACKSLASH)


def braced(text: str, missing: str | None) -> str | None:
    """From the first ``{`` to the last ``}``, or ``missing`` when there is none."""
    first, last = text.find("{"), text.rfind("}")
    return text[first : last + 1] if 0 <= first < last else missing


def cleaned(text: str) -> str:
    """Control characters dropped, stray backslashes doubled, cut to the braces.

    A ``\\u`` escape counts as stray, so it ends up as literal text.
    """
    plain = _STRAY_BACKSLASH.sub(r"\\\\", _CONTROL.sub("", text.strip()))
    return braced(plain, plain)


def attempts(raw: str):
    """(strategy, candidate text) in the order they are tried; later ones are lazy."""
    yield 1, raw
    block = _FENCED.search(raw)
    if block:
        yield 2, block.group(1)
    inner = braced(raw, None)
    if inner is not None:
        yield 3, inner
    yield 4, cleaned(raw)


def salvage_one(raw: str | None) -> tuple[str | None, int | None, str | None]:
    """(payload, strategy, error) of one text; the error is that of the last attempt.

    The payload is the text that was accepted, with its own numbers, key repeats
    and escapes.
    """
    if raw is None:
        return None, None, "no text"
    error = None
    for strategy, candidate in attempts(raw):
        try:
            json.loads(candidate)
            return candidate.strip(), strategy, None
        except (ValueError, RecursionError) as exc:
            error = str(exc) or type(exc).__name__
    return None, None, error


@F.pandas_udf(T.BooleanType())
def is_strict_json(texts: pd.Series) -> pd.Series:
    """True for text that a strict JSON parser accepts as a whole."""

    def valid(text: str | None) -> bool:
        try:
            json.loads(text)
            return True
        except (TypeError, ValueError, RecursionError):
            return False

    return texts.map(valid, na_action=None).astype(bool)
