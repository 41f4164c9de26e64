"""Values as comparable key strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
FRACTIONS = (T.FloatType, T.DoubleType)
DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def is_number(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, NUMBERS)


def is_date(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, DATES)


def is_text(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.StringType)


def clean(df: DataFrame, c: str) -> Column:
    """The column with NaN as null."""
    x = F.col(f"`{c}`")
    return F.when(~F.isnan(x), x) if isinstance(df.schema[c].dataType, FRACTIONS) else x


def number(df: DataFrame, c: str) -> Column:
    """Finite values as double; NaN and infinities are null."""
    x = F.col(f"`{c}`").cast("double")
    return F.when(F.abs(x) < float("inf"), x) if isinstance(df.schema[c].dataType, FRACTIONS) else x


def key_string(df: DataFrame, c: str) -> Column:
    """Whole numbers as integer text, other text trimmed; nested values as JSON."""
    kind, x = df.schema[c].dataType, clean(df, c)
    if isinstance(kind, T.StringType):
        return F.trim(x)
    if isinstance(kind, FRACTIONS):
        return F.when(x == F.floor(x), x.cast("decimal(38,0)").cast("string")).otherwise(x.cast("string"))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(x)
    if isinstance(kind, T.BinaryType):
        return F.hex(x)
    return x.cast("string")


def date_kinds(df: DataFrame) -> list[str]:
    return [c for c in df.columns if is_date(df, c)]
