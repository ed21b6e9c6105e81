"""Canonical cells: one string per value, chosen from the column type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def plain(name: str, kind: T.DataType) -> Column:
    """Display style: decimals as text, temporals as ISO text, bytes as hex."""
    value = F.col(name)
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(value))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        # ISO text shows the fraction only when there is one.
        whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
        return F.when(F.date_format(value, "SSSSSS") == "000000", whole).otherwise(
            F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        )
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(value)
    return value.cast("string")


def typed(name: str, kind: T.DataType) -> Column:
    """Comparison style: the type is part of the cell, so 1 differs from '1' and 1.0."""
    value = F.col(name)
    if isinstance(kind, T.DecimalType):
        text = value.cast("string")
        body = F.when(
            text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")
        ).otherwise(text)
        tagged = F.concat(F.lit("decimal:"), body)
    elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        tagged = F.concat(F.lit("temporal:"), plain(name, kind))
    elif isinstance(kind, T.BinaryType):
        tagged = F.concat(F.lit("bytes:"), plain(name, kind))
    elif isinstance(kind, T.StringType):
        tagged = F.concat(F.lit("text:"), value)
    elif isinstance(kind, T.BooleanType):
        tagged = F.concat(F.lit("bool:"), value.cast("string"))
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        tagged = F.concat(F.lit("float:"), value.cast("string"))
    elif isinstance(kind, T.IntegralType):
        tagged = F.concat(F.lit("int:"), value.cast("string"))
    else:
        tagged = F.concat(F.lit("nested:"), plain(name, kind))
    return F.coalesce(tagged, F.lit("null:"))


def typed_columns(df: DataFrame) -> list[Column]:
    return [typed(f.name, f.dataType).alias(f.name) for f in df.schema.fields]


def plain_columns(df: DataFrame) -> list[Column]:
    return [plain(f.name, f.dataType).alias(f.name) for f in df.schema.fields]
