"""Tables in a folder of parquet files or folders, and the schema that is known of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..schema import Column, DataType, ForeignKey, Schema, Table

_KINDS = {T.ShortType: "smallint", T.IntegerType: "integer", T.LongType: "bigint", T.FloatType: "float", T.DoubleType: "double", T.BooleanType: "boolean", T.DateType: "date", T.TimestampType: "timestamp with time zone", T.TimestampNTZType: "timestamp", T.BinaryType: "bytea"}

#: Keys of the bundled star schema: primary keys and foreign keys (child, column, parent, column).
STAR_KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "pages": "page_id", "benchmark": "item_id"}
STAR_FOREIGN = (
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("labels", "doc_id", "documents", "doc_id"),
    ("events", "user_id", "customer", "c_custkey"),
)


def read_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _kind(t: T.DataType) -> DataType:
    if isinstance(t, T.ArrayType):
        inner = _kind(t.elementType)
        return DataType("array", inner, f"{inner}[]")
    if isinstance(t, T.DecimalType):
        return DataType("numeric", name=f"numeric({t.precision},{t.scale})")
    return DataType.parse(_KINDS.get(type(t), "text"))


class ParquetIntrospector:
    """The named tables' columns from their files, with the star schema's keys where the columns are there."""

    def __init__(self, spark: SparkSession, folder: str, tables: list[str]) -> None:
        self.spark, self.folder, self.tables = spark, folder, tables

    def introspect(self) -> Schema:
        schema = Schema(name=self.folder)
        for name in self.tables:
            table = Table(name)
            for f in read_table(self.spark, self.folder, name).schema.fields:
                table.add(Column(f.name, _kind(f.dataType), f.nullable))
            key = STAR_KEYS.get(name)
            table.primary_key = (key,) if key in table.columns else ()
            table.foreign_keys = [ForeignKey((c,), p, (pc,)) for t, c, p, pc in STAR_FOREIGN if t == name and c in table.columns and p in self.tables]
            schema.add(table)
        return schema
