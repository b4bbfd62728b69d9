"""Schemas of SQLite files, read on the driver."""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..errors import IntrospectionError
from ..schema import SQLITE, Column, DataType, ForeignKey, Schema, Table, parse_check


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def path_of(url: str) -> str:
    return re.sub(r"^(?:sqlite|file):(?://)?", "", url)


class SqliteIntrospector:
    def __init__(self, url: str) -> None:
        self.path = path_of(url)

    def introspect(self) -> Schema:
        """Tables with columns, keys, unique indexes and the checks of their CREATE text."""
        schema = Schema(SQLITE, self.path)
        try:
            with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
                made = db.execute("select name, sql from sqlite_master where type = 'table' and name not like 'sqlite_%' order by name").fetchall()
                for name, sql in made:
                    schema.add(self._table(db, name, sql or ""))
        except sqlite3.Error as e:
            raise IntrospectionError(f"{self.path}: {e}") from e
        for t in schema.tables.values():  # a key that names no column means the parent's primary key
            t.foreign_keys = [k if all(k.parent_columns) else ForeignKey(k.columns, k.parent, schema.tables[k.parent].primary_key if k.parent in schema.tables else (), k.name, k.on_delete, k.on_update) for k in t.foreign_keys]
        return schema

    def _table(self, db: sqlite3.Connection, name: str, sql: str) -> Table:
        table, key = Table(name), []
        for at, column, raw, not_null, default, pk in db.execute(f"pragma table_info({_quoted(name)})"):
            kind = DataType.parse(raw or "text")
            size = re.search(r"\((\d+)(?:\s*,\s*(\d+))?\)", raw or "")
            c = Column(column, kind, not (not_null or pk), default is not None, False, position=at + 1)
            if size and kind.is_string:
                c.max_length = int(size[1])
            elif size and kind.kind == "numeric":
                c.precision, c.scale = int(size[1]), int(size[2] or 0)
            table.add(c)
            if pk:
                key.append((pk, column))
        table.primary_key = tuple(c for _, c in sorted(key))
        if len(key) == 1:
            only = table.columns[key[0][1]]
            only.auto_increment = "int" in str(only.type).lower()
        found: dict[int, dict] = {}
        for number, at, parent, column, target, on_update, on_delete, _ in db.execute(f"pragma foreign_key_list({_quoted(name)})"):
            k = found.setdefault(number, {"parent": parent, "pairs": [], "up": on_update, "del": on_delete})
            k["pairs"].append((at, column, target))
        for number, k in sorted(found.items()):
            pairs = sorted(k["pairs"])
            table.foreign_keys.append(ForeignKey(tuple(p[1] for p in pairs), k["parent"], tuple(p[2] for p in pairs), f"fk_{number}", k["del"], k["up"]))
        for _, index, unique, origin, _ in db.execute(f"pragma index_list({_quoted(name)})").fetchall():
            if unique and origin == "u":
                table.uniques.append(tuple(r[2] for r in db.execute(f"pragma index_info({_quoted(index)})")))
        table.uniques.sort()
        for m in re.finditer(r"check\s*\(", sql, re.I):
            depth, i = 1, m.end()
            while depth and i < len(sql):
                depth += (sql[i] == "(") - (sql[i] == ")")
                i += 1
            table.checks.append(parse_check(sql[m.end() - 1 : i]))
        return table


def runner(url: str) -> Callable[[str], list[tuple]]:
    """Answers queries from a SQLite file."""

    def run(query: str) -> list[tuple]:
        with sqlite3.connect(f"file:{path_of(url)}?mode=ro", uri=True) as db:
            return db.execute(query).fetchall()

    return run


def read_table(spark: SparkSession, url: str, table: str) -> DataFrame:
    """A table of a SQLite file; its rows pass through the driver, so this is for small files."""
    schema = SqliteIntrospector(url).introspect().tables[table]
    with sqlite3.connect(f"file:{path_of(url)}?mode=ro", uri=True) as db:
        rows = db.execute(f"select * from {_quoted(table)}").fetchall()
    kinds = {"smallint": "bigint", "integer": "bigint", "bigint": "bigint", "serial": "bigint", "bigserial": "bigint", "float": "double", "double": "double", "numeric": "double", "boolean": "bigint", "binary": "binary"}
    ddl = ", ".join(f"`{c.name}` {kinds.get(c.type.kind, 'string')}" for c in schema.columns.values())
    cast = {"double": float, "bigint": int, "string": str}
    typed = [tuple(v if v is None or isinstance(v, bytes) else cast[kinds.get(c.type.kind, "string")](v) for v, c in zip(r, schema.columns.values(), strict=True)) for r in rows]
    return spark.createDataFrame(typed, ddl)
