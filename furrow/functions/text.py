"""Text forms of typed values for sinks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import MYSQL, POSTGRES


def quote_identifier(name: str, dialect: str = POSTGRES) -> str:
    return f"`{name.replace('`', '``')}`" if dialect == MYSQL else '"' + name.replace('"', '""') + '"'


def _plain(value: Column, kind: T.DataType) -> Column:
    """A value as text, without quotes."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(value, "yyyy-MM-dd HH:mm:ss")
    if isinstance(kind, T.DateType):
        return F.date_format(value, "yyyy-MM-dd")
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(value))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(value)
    return value.cast("string")


def sql_literal(value: Column, kind: T.DataType, dialect: str = POSTGRES) -> Column:
    """A SQL literal; null is NULL, quotes are doubled, numbers that aren't finite are quoted."""
    if isinstance(kind, T.BooleanType):
        out = F.when(value, "1" if dialect == MYSQL else "TRUE").otherwise("0" if dialect == MYSQL else "FALSE")
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        out = F.when(F.isnan(value), "'NaN'").when(value == float("inf"), "'Infinity'").when(value == float("-inf"), "'-Infinity'").otherwise(value.cast("string"))
    elif isinstance(kind, T.NumericType):
        out = value.cast("string")
    elif isinstance(kind, T.BinaryType):
        out = F.concat(F.lit("'\\x" if dialect == POSTGRES else "X'"), F.lower(F.hex(value)), F.lit("'"))
    else:
        text = F.replace(_plain(value, kind), F.lit("'"), F.lit("''"))
        text = F.replace(text, F.lit("\\"), F.lit("\\\\")) if dialect == MYSQL else text
        out = F.concat(F.lit("'"), text, F.lit("'"))
    return F.when(value.isNull(), "NULL").otherwise(out)


def csv_field(value: Column, kind: T.DataType) -> Column:
    """A CSV field; null is empty, and commas, quotes and line ends call for quotes."""
    text = _plain(value, kind)
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(text.rlike('[,"\r\n]'), quoted).otherwise(text), F.lit(""))


def copy_field(value: Column, kind: T.DataType) -> Column:
    r"""A field of PostgreSQL's COPY text; null is \N."""
    if isinstance(kind, T.BooleanType):
        text = F.when(value, "t").otherwise("f")
    elif isinstance(kind, T.BinaryType):
        text = F.concat(F.lit("\\\\x"), F.lower(F.hex(value)))
    else:
        text = _plain(value, kind)
        for raw, escaped in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
            text = F.replace(text, F.lit(raw), F.lit(escaped))
    return F.when(value.isNull(), "\\N").otherwise(text)


def json_value(value: Column, kind: T.DataType, is_json: bool = False) -> Column:
    """A JSON value; binary is base64, times have milliseconds and a Z, JSON columns go in as they are."""
    if isinstance(kind, (T.BooleanType, T.IntegralType, T.DecimalType)):
        out = value.cast("string")
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        finite = ~F.isnan(value) & (F.abs(value) < float("inf"))
        out = F.when(finite, value.cast("string")).otherwise("null")
    elif is_json:
        out = value
    else:
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            text = F.concat(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
        elif isinstance(kind, T.BinaryType):
            text = F.base64(value)
        else:
            text = _plain(value, kind)
        boxed = F.to_json(F.struct(text.alias("v")))
        out = F.substring(boxed, 6, F.length(boxed) - 6)
    return F.when(value.isNull(), "null").otherwise(out)
