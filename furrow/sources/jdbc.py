"""Schemas of PostgreSQL and MySQL, from their catalogs over JDBC.

Catalog queries run in the database; what comes back is metadata. Keys are read with their positions, so that keys of
several columns pair up as declared.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..schema import MYSQL, POSTGRES, Column, DataType, ForeignKey, Schema, Table, parse_check, parse_enum_values

POSTGRES_QUERIES = {
    "tables": "select table_name from information_schema.tables where table_schema = '{s}' and table_type = 'BASE TABLE' order by table_name",
    "columns": "select table_name, column_name, data_type, udt_name, is_nullable, column_default, character_maximum_length as max_length, numeric_precision, numeric_scale, ordinal_position, is_identity as extra, udt_name as column_type from information_schema.columns where table_schema = '{s}' order by table_name, ordinal_position",
    "keys": "select rel.relname as table_name, con.conname as name, con.contype::text as kind, a.attname as column_name, k.at, ref.relname as parent, fa.attname as parent_column, con.confdeltype::text as on_delete, con.confupdtype::text as on_update, con.condeferrable as deferrable from pg_constraint con join pg_class rel on rel.oid = con.conrelid join pg_namespace ns on ns.oid = con.connamespace cross join lateral unnest(con.conkey) with ordinality as k(num, at) join pg_attribute a on a.attrelid = con.conrelid and a.attnum = k.num left join pg_class ref on ref.oid = con.confrelid left join pg_attribute fa on fa.attrelid = con.confrelid and fa.attnum = con.confkey[k.at] where ns.nspname = '{s}' and con.contype in ('p', 'u', 'f') order by 1, 2, k.at",
    "checks": "select rel.relname as table_name, pg_get_constraintdef(con.oid) as text from pg_constraint con join pg_class rel on rel.oid = con.conrelid join pg_namespace ns on ns.oid = con.connamespace where ns.nspname = '{s}' and con.contype = 'c' order by 1, con.conname",
    "enums": "select t.typname as name, e.enumlabel as value from pg_type t join pg_enum e on e.enumtypid = t.oid join pg_namespace n on n.oid = t.typnamespace where n.nspname = '{s}' order by t.typname, e.enumsortorder",
}
MYSQL_QUERIES = {
    "tables": "select cast(table_name as char) as table_name from information_schema.tables where table_schema = '{s}' and table_type = 'BASE TABLE' order by table_name",
    "columns": "select cast(table_name as char) as table_name, cast(column_name as char) as column_name, cast(data_type as char) as data_type, cast(data_type as char) as udt_name, cast(is_nullable as char) as is_nullable, cast(column_default as char) as column_default, character_maximum_length as max_length, numeric_precision, numeric_scale, ordinal_position, cast(extra as char) as extra, cast(column_type as char) as column_type from information_schema.columns where table_schema = '{s}' order by table_name, ordinal_position",
    "keys": "select cast(k.table_name as char) as table_name, cast(k.constraint_name as char) as name, lower(substr(c.constraint_type, 1, 1)) as kind, cast(k.column_name as char) as column_name, k.ordinal_position as at, cast(k.referenced_table_name as char) as parent, cast(k.referenced_column_name as char) as parent_column, cast(r.delete_rule as char) as on_delete, cast(r.update_rule as char) as on_update, false as deferrable from information_schema.key_column_usage k join information_schema.table_constraints c on c.table_schema = k.table_schema and c.table_name = k.table_name and c.constraint_name = k.constraint_name left join information_schema.referential_constraints r on r.constraint_schema = k.table_schema and r.table_name = k.table_name and r.constraint_name = k.constraint_name where k.table_schema = '{s}' order by 1, 2, k.ordinal_position",
    "checks": "select cast(t.table_name as char) as table_name, cast(c.check_clause as char) as text from information_schema.check_constraints c join information_schema.table_constraints t on t.constraint_schema = c.constraint_schema and t.constraint_name = c.constraint_name where c.constraint_schema = '{s}' order by 1, c.constraint_name",
}
ACTIONS = {"a": "NO ACTION", "r": "RESTRICT", "c": "CASCADE", "n": "SET NULL", "d": "SET DEFAULT"}


def _column(row: dict[str, Any], dialect: str, enums: dict[str, list[str]]) -> Column:
    raw, default, extra = row["data_type"], row["column_default"] or "", (row["extra"] or "").lower()
    values = None
    if dialect == MYSQL and raw.lower() in ("enum", "set"):
        kind, values = DataType("enum", name=raw), parse_enum_values(row["column_type"])
    elif raw == "USER-DEFINED":
        values = enums.get(row["udt_name"])
        kind = DataType("enum" if values is not None else "unknown", name=row["udt_name"])
    elif raw == "ARRAY":
        kind = DataType.parse(row["udt_name"])
    else:
        kind = DataType.parse(raw)
    auto = "auto_increment" in extra if dialect == MYSQL else default.startswith("nextval(") or extra == "yes"
    number = lambda x: None if x is None else int(x)
    return Column(row["column_name"], kind, row["is_nullable"] == "YES", row["column_default"] is not None, auto, number(row["max_length"]), number(row["numeric_precision"]), number(row["numeric_scale"]), values, int(row["ordinal_position"]))


def assemble(rows: dict[str, list[dict]], dialect: str, name: str) -> Schema:
    """A schema from the catalog's rows."""
    schema = Schema(dialect, name)
    for r in rows.get("enums", []):
        schema.enums.setdefault(r["name"], []).append(r["value"])
    for r in rows["tables"]:
        schema.add(Table(r["table_name"]))
    for r in rows["columns"]:
        if r["table_name"] in schema.tables:
            schema.tables[r["table_name"]].add(_column(r, dialect, schema.enums))
    grouped: dict[tuple, list[dict]] = defaultdict(list)
    for r in rows["keys"]:
        grouped[r["table_name"], r["name"], r["kind"]].append(r)
    for (table, key_name, kind), parts in sorted(grouped.items()):
        if table not in schema.tables:
            continue
        parts.sort(key=lambda r: r["at"])
        columns = tuple(r["column_name"] for r in parts)
        if kind == "p":
            schema.tables[table].primary_key = columns
        elif kind == "u":
            schema.tables[table].uniques.append(columns)
        else:
            first = parts[0]
            action = lambda x: ACTIONS.get(x, x or "NO ACTION")
            schema.tables[table].foreign_keys.append(ForeignKey(columns, first["parent"], tuple(r["parent_column"] for r in parts), key_name, action(first["on_delete"]), action(first["on_update"]), bool(first["deferrable"])))
    for r in rows.get("checks", []):
        if r["table_name"] in schema.tables:
            schema.tables[r["table_name"]].checks.append(parse_check(r["text"]))
    return schema


class JdbcIntrospector:
    """``run`` answers a catalog query with rows; by default Spark's JDBC reader does."""

    def __init__(self, spark: SparkSession, url: str, dialect: str, schema: str = "public", properties: dict[str, str] | None = None, run: Callable[[str], list[dict]] | None = None) -> None:
        self.url, self.dialect, self.schema = url, dialect, schema
        self.run = run or (lambda q: [r.asDict() for r in spark.read.format("jdbc").options(url=url, query=q, **(properties or {})).load().collect()])

    def introspect(self) -> Schema:
        queries = POSTGRES_QUERIES if self.dialect == POSTGRES else MYSQL_QUERIES
        return assemble({k: self.run(q.format(s=self.schema.replace("'", "''"))) for k, q in queries.items()}, self.dialect, self.schema)


def read_table(spark: SparkSession, url: str, table: str, properties: dict[str, str] | None = None, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 16) -> DataFrame:
    """A table over JDBC, in ``partitions`` ranges of a numeric key where its bounds are given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **(properties or {}))
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return reader.load()
