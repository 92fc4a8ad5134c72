"""Columns that reach every string of nested rows, built from the rows' schema.

Walks are made once a query, over types and not over values; rows themselves are handled by Spark's expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the fields of the statements file that hold ids, dates or one of a few words, and so aren't searched.
SKIPPED = ("id", "document_id", "type", "doc_type", "date", "speech_act", "handling", "position", "statement_date", "document_date")


def strings(value: Column, kind: T.DataType, name: str | None = None, skipped: Collection[str] = SKIPPED) -> Column:
    """Array of all strings inside a value, in order; a list inherits the name of its field."""
    none = F.array().cast("array<string>")
    if isinstance(kind, T.StringType):
        return none if name in skipped else F.when(value.isNull(), none).otherwise(F.array(value))
    if isinstance(kind, T.StructType):
        parts = [strings(value[f.name], f.dataType, f.name, skipped) for f in kind.fields if _has_strings(f.dataType)]
        return F.coalesce(F.concat(*parts), none) if parts else none
    if isinstance(kind, T.ArrayType) and _has_strings(kind.elementType):
        return F.coalesce(F.flatten(F.transform(value, lambda x: strings(x, kind.elementType, name, skipped))), none)
    return none


def rewritten(value: Column, kind: T.DataType, change: Callable[[Column], Column], name: str | None = None, skipped: Collection[str] = SKIPPED) -> Column:
    """The value with every string that isn't skipped changed; shape and other fields stay."""
    if isinstance(kind, T.StringType):
        return value if name in skipped else change(value)
    if isinstance(kind, T.StructType):
        fields = [rewritten(value[f.name], f.dataType, change, f.name, skipped).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType) and _has_strings(kind.elementType):
        return F.transform(value, lambda x: rewritten(x, kind.elementType, change, name, skipped))
    return value


def row_strings(df: DataFrame, skipped: Collection[str] = SKIPPED) -> Column:
    """All strings of a row."""
    parts = [strings(F.col(f"`{f.name}`"), f.dataType, f.name, skipped) for f in df.schema.fields]
    return F.concat(*parts)


def _has_strings(kind: T.DataType) -> bool:
    if isinstance(kind, T.StringType):
        return True
    if isinstance(kind, T.StructType):
        return any(_has_strings(f.dataType) for f in kind.fields)
    return isinstance(kind, T.ArrayType) and _has_strings(kind.elementType)
