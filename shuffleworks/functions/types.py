"""Type names: source types to Spark type names, and names to Spark types."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shuffleworks.constants import AVRO_TYPES, DEFAULT_TYPE, JAVA_TYPES

TYPE_TABLES = {"java": JAVA_TYPES, "avro": AVRO_TYPES}

_DECIMAL = re.compile(r"DecimalType\((\d+),\s*(\d+)\)")


def spark_type_name(type_name: Column, table: str = "java") -> Column:
    """Look ``type_name`` up in the Java or Avro table; unknown is StringType.

    The table is a map literal of at most 25 entries, so the lookup is part of
    the projection: no join and no shuffle.
    """
    entries = [F.lit(x) for pair in TYPE_TABLES[table].items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), type_name), F.lit(DEFAULT_TYPE))


def to_spark_type(name: str) -> T.DataType:
    """The Spark type behind one of the names the tables can give."""
    decimal = _DECIMAL.fullmatch(name)
    if decimal:
        return T.DecimalType(int(decimal.group(1)), int(decimal.group(2)))
    return getattr(T, name)()
