"""Byte sizes of values, as column expressions, and level limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of fixed-width types; a plain integer of a struct counts as a machine word.
FIXED = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "boolean": 1, "date": 4, "timestamp": 8, "timestamp_ntz": 8}


def size_of(column: Column, kind: T.DataType) -> Column:
    """Bytes of a value: fixed width for numbers, bytes (not characters) for strings, the sum of the fields for structs.

    Null is 0; an array or map is the sum of its elements.
    """
    name = kind.simpleString()
    if name in FIXED:
        out = F.lit(FIXED[name])
    elif isinstance(kind, (T.StringType, T.BinaryType)):
        out = F.octet_length(column)
    elif isinstance(kind, T.StructType):
        out = sum((size_of(column[f.name], f.dataType) for f in kind.fields), F.lit(0).cast("long"))
    elif isinstance(kind, T.ArrayType):
        out = F.aggregate(column, F.lit(0).cast("long"), lambda a, e: a + size_of(e, kind.elementType))
    elif isinstance(kind, T.MapType):
        out = size_of(F.map_keys(column), T.ArrayType(kind.keyType)) + size_of(F.map_values(column), T.ArrayType(kind.valueType))
    else:
        out = F.octet_length(column.cast("string"))
    return F.when(column.isNull(), F.lit(0)).otherwise(out).cast("long")


def level_limit(level: int, level0_max: int, growth: int, kind: str = "linear") -> int:
    """Bytes beyond which a level is merged downward. Linear by default; ``geometric`` multiplies from level to level."""
    return level0_max * (growth**level if kind == "geometric" else max(level * growth, 1))
