"""Sinks of generated tables: SQL and COPY text, JSON, CSV, parquet, JDBC, and a driver connection."""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator
from functools import reduce
from urllib.parse import urlsplit, urlunsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..schema import MYSQL, POSTGRES, SQLITE, Schema
from .generate import Generator

BATCH = 100


def format_for(path: str | None, said: str | None = None) -> str:
    """A named format, else by the file's ending, else SQL."""
    if said:
        return said
    end = os.path.splitext(path or "")[1].lower()
    return {".json": "json", ".csv": "csv", ".parquet": "parquet"}.get(end, "sql")


def hidden_password(url: str) -> str:
    """A URL with its password replaced by stars."""
    parts = urlsplit(url)
    if not parts.password:
        return url
    host = parts.hostname or ""
    return urlunsplit(parts._replace(netloc=f"{parts.username}:***@{host}{f':{parts.port}' if parts.port else ''}"))


def literal_rows(df: DataFrame, dialect: str = POSTGRES, id: str = "_id") -> DataFrame:
    """(_id, row): each row as a parenthesised list of SQL literals."""
    fields = [f for f in df.schema.fields if f.name != id]
    parts = [text.sql_literal(F.col(f.name), f.dataType, dialect) for f in fields]
    return df.select(id, F.concat(F.lit("("), F.concat_ws(", ", *parts), F.lit(")")).alias("row"))


def insert_head(columns: list[str], table: str, dialect: str = POSTGRES) -> str:
    return f"INSERT INTO {text.quote_identifier(table, dialect)} ({', '.join(text.quote_identifier(c, dialect) for c in columns)}) VALUES\n"


def insert_statements(df: DataFrame, table: str, dialect: str = POSTGRES, id: str = "_id", batch: int = BATCH) -> DataFrame:
    """(batch, statement): INSERTs of up to ``batch`` rows each, in the order of the row's number, of rows that lie anywhere."""
    head = insert_head([c for c in df.columns if c != id], table, dialect)
    rows = literal_rows(df, dialect, id).withColumn("batch", F.floor(F.col(id) / batch))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(id, "row"))), lambda x: x["row"]), ",\n")
    return rows.groupBy("batch").agg(F.concat(F.lit(head), joined, F.lit(";")).alias("statement"))


def insert_lines(spark: SparkSession, generator: Generator, table: str, dialect: str = POSTGRES, auto: bool = True, batch: int = BATCH) -> DataFrame:
    """(_id, line): INSERTs of ``batch`` rows, one line a row, with no shuffle: partitions are in order and hold whole statements."""
    df = generator.frame(spark, table, keep_id=True, auto=auto, batch=batch)
    n, head = generator.plan.tables[table].rows, insert_head(df.columns[1:], table, dialect)
    place = F.col("_id") % batch
    last = (place == batch - 1) | (F.col("_id") == n - 1)
    return literal_rows(df, dialect).select("_id", F.concat(F.when(place == 0, F.lit(head)).otherwise(F.lit("")), "row", F.when(last, F.lit(";")).otherwise(F.lit(","))).alias("line"))


def copy_lines(df: DataFrame, id: str = "_id") -> DataFrame:
    """(_id, line): each row as a line of COPY text."""
    parts = [text.copy_field(F.col(f.name), f.dataType) for f in df.schema.fields if f.name != id]
    return df.select(id, F.concat_ws("\t", *parts).alias("line"))


def csv_lines(df: DataFrame, id: str = "_id") -> DataFrame:
    """(_id, line): each row as a line of CSV."""
    parts = [text.csv_field(F.col(f.name), f.dataType) for f in df.schema.fields if f.name != id]
    return df.select(id, F.concat_ws(",", *parts).alias("line"))


def json_lines(df: DataFrame, id: str = "_id", json_columns: tuple[str, ...] = ()) -> DataFrame:
    """(_id, line): each row as a JSON object that has its nulls."""
    parts = [F.concat(F.lit(f'"{f.name}":'), text.json_value(F.col(f.name), f.dataType, f.name in json_columns)) for f in df.schema.fields if f.name != id]
    return df.select(id, F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("line"))


def update_statements(spark: SparkSession, generator: Generator, dialect: str = POSTGRES) -> DataFrame:
    """(table_name, row_index, column_name, statement): the deferred keys' values, each row found by its key.

    Literals follow the columns' types. The key is the primary key, else the first unique columns; of a table without
    either, or whose key is itself deferred, no row can be told from another, so it has no statements.
    """
    quote = lambda n: text.quote_identifier(n, dialect)
    out = None
    for e in generator.plan.deferred:
        table = generator.plan.tables[e.child]
        single = [(c,) for c, x in table.columns.items() if x.unique]
        keys = [k for k in [table.primary_key, *table.uniques, *single] if k and all(c in table.columns and table.columns[c].strategy.kind not in ("deferred", "skip") for c in k)]
        if not keys:
            continue

        def literal(c: str, table=table, **options) -> Column:
            kind = table.columns[c].column.type.spark(table.columns[c].column.precision, table.columns[c].column.scale)
            return text.sql_literal(generator.value(table, table.columns[c], F.col("id"), **options), kind, dialect)

        where = F.concat_ws(" AND ", *[F.concat(F.lit(f"{quote(c)} = "), literal(c)) for c in keys[0]])
        for name in e.key.columns:
            statement = F.concat(F.lit(f"UPDATE {quote(e.child)} SET {quote(name)} = "), literal(name, nulls=False), F.lit(" WHERE "), where, F.lit(";"))
            part = generator.rows(spark, e.child).select(F.lit(e.child).alias("table_name"), F.col("id").alias("row_index"), F.lit(name).alias("column_name"), statement.alias("statement"))
            out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "table_name string, row_index long, column_name string, statement string")


def sequence_statements(generator: Generator) -> list[str]:
    """For PostgreSQL: every counted key's sequence goes on behind the rows that were written with their numbers."""
    out = []
    for name, table in generator.plan.tables.items():
        if len(table.primary_key) == 1 and table.columns[table.primary_key[0]].strategy.kind == "auto":
            key, plain = text.quote_identifier(table.primary_key[0]), [x.replace("'", "''") for x in (text.quote_identifier(name), table.primary_key[0])]
            out.append(f"SELECT setval(pg_get_serial_sequence('{plain[0]}', '{plain[1]}'), coalesce(max({key}), 1), max({key}) IS NOT NULL) FROM {text.quote_identifier(name)};")
    return out


def _in_order(df: DataFrame, column: str) -> Iterator[str]:
    """A column's values, one partition at a time on the driver; generated rows lie in order."""
    for row in df.select(column).toLocalIterator(prefetchPartitions=True):
        yield row[column]


def write_sql(spark: SparkSession, generator: Generator, out, dialect: str = POSTGRES) -> None:
    """One SQL script: INSERTs in dependency order, then deferred updates. Counted keys are left to the database."""
    out.write(f"-- {len(generator.plan.tables)} tables, seed {generator.plan.seed}\n")
    out.write({MYSQL: "SET FOREIGN_KEY_CHECKS = 0;\n", SQLITE: "BEGIN TRANSACTION;\n"}.get(dialect, ""))
    for name in generator.plan.tables:
        out.write(f"\n-- {name}: {generator.plan.tables[name].rows} rows\n")
        for s in _in_order(insert_lines(spark, generator, name, dialect, auto=False), "line"):
            out.write(s + "\n")
    if generator.plan.deferred:
        out.write("\n-- deferred keys\n")
        for s in _in_order(update_statements(spark, generator, dialect), "statement"):
            out.write(s + "\n")
    out.write({MYSQL: "SET FOREIGN_KEY_CHECKS = 1;\n", SQLITE: "COMMIT;\n"}.get(dialect, ""))


def write_copy(spark: SparkSession, generator: Generator, out) -> None:
    """PostgreSQL COPY text of all tables, then deferred updates. Counted keys are left to the database."""
    for name in generator.plan.tables:
        columns = ", ".join(text.quote_identifier(c.column.name) for c in generator.written(name, auto=False))
        out.write(f"COPY {text.quote_identifier(name)} ({columns}) FROM stdin;\n")
        for line in _in_order(copy_lines(generator.frame(spark, name, keep_id=True, auto=False)), "line"):
            out.write(line + "\n")
        out.write("\\.\n\n")
    for s in _in_order(update_statements(spark, generator), "statement"):
        out.write(s + "\n")


def write_json(spark: SparkSession, generator: Generator, out) -> None:
    """One JSON document: an array for each table, and the deferred updates. Counted keys are left out."""
    out.write("{")
    for i, (name, table) in enumerate(generator.plan.tables.items()):
        json_columns = tuple(c for c, p in table.columns.items() if p.column.type.kind in ("json", "jsonb"))
        out.write(("," if i else "") + f'\n"{name}": [')
        for k, line in enumerate(_in_order(json_lines(generator.frame(spark, name, keep_id=True, auto=False), json_columns=json_columns), "line")):
            out.write((",\n" if k else "\n") + line)
        out.write("\n]")
    if generator.plan.deferred:
        out.write((",\n" if generator.plan.tables else "\n") + '"_deferred_updates": [')
        updates = generator.deferred_updates(spark).orderBy("table_name", "column_name", "row_index").select(F.to_json(F.struct(F.col("table_name").alias("table"), "row_index", F.col("column_name").alias("column"), "value")).alias("line"))
        for k, row in enumerate(updates.toLocalIterator()):
            out.write((",\n" if k else "\n") + row["line"])
        out.write("\n]")
    out.write("\n}\n")


def write_csv(spark: SparkSession, generator: Generator, out) -> None:
    """All tables in one text, each under a comment line and a header, with a blank line between. Counted keys are left out."""
    for i, name in enumerate(generator.plan.tables):
        out.write(("\n" if i else "") + f"# Table: {name}\n" + ",".join(c.column.name for c in generator.written(name, auto=False)) + "\n")
        for line in _in_order(csv_lines(generator.frame(spark, name, keep_id=True, auto=False)), "line"):
            out.write(line + "\n")


def write_folder(spark: SparkSession, generator: Generator, folder: str, kind: str = "parquet", dialect: str = POSTGRES) -> None:
    """One folder for each table, written in parallel: parquet, csv, json, orc, sql or copy. This is the way to go for large tables.

    Rows carry their counted keys, since files may be loaded in any order. Kinds that are loaded as statements have
    deferred keys null, and the folder ``_deferred_updates`` with the UPDATEs to run once all rows are there; the others
    have the final values.
    """
    for name in generator.plan.tables:
        path = f"{folder}/{name}"
        if kind == "sql":
            insert_lines(spark, generator, name, dialect).select("line").write.text(path)
        elif kind == "copy":
            copy_lines(generator.frame(spark, name, keep_id=True)).select("line").write.text(path)
        elif kind == "csv":
            generator.frame(spark, name, final=True).write.csv(path, header=True, escape='"')
        else:
            generator.frame(spark, name, final=True).write.format(kind).save(path)
    if kind in ("sql", "copy") and generator.plan.deferred:
        update_statements(spark, generator, dialect).select("statement").write.text(f"{folder}/_deferred_updates")


class JdbcSession:
    """One connection of the driver, in one transaction."""

    def __init__(self, spark: SparkSession, url: str, properties: dict[str, str] | None = None) -> None:
        given = spark._jvm.java.util.Properties()
        for k, v in (properties or {}).items():
            given.setProperty(k, v)
        self.connection = spark._jvm.java.sql.DriverManager.getConnection(url, given)
        self.connection.setAutoCommit(False)

    def run(self, statement: str) -> None:
        s = self.connection.createStatement()
        try:
            s.execute(statement.rstrip().removesuffix(";"))
        finally:
            s.close()

    def close(self, done: bool) -> None:
        try:
            self.connection.commit() if done else self.connection.rollback()
        finally:
            self.connection.close()


def closing_statements(spark: SparkSession, generator: Generator, dialect: str = POSTGRES) -> Iterator[str]:
    """What follows the rows: sequences (PostgreSQL), then deferred keys."""
    if dialect == POSTGRES:
        yield from sequence_statements(generator)
    yield from _in_order(update_statements(spark, generator, dialect), "statement")


def direct_statements(spark: SparkSession, generator: Generator, dialect: str = POSTGRES, batch: int = BATCH) -> Iterator[tuple[str, str]]:
    """(table, statement) of a direct insert, in order: INSERTs by dependency with their counted keys, then what follows the rows.

    MySQL's check of foreign keys is off meanwhile.
    """
    if dialect == MYSQL:
        yield "", "SET FOREIGN_KEY_CHECKS = 0;"
    for name in generator.plan.tables:
        held: list[str] = []
        for line in _in_order(insert_lines(spark, generator, name, dialect, batch=batch), "line"):
            held.append(line)
            if line.endswith(";") and len(held) in (batch, (generator.plan.tables[name].rows - 1) % batch + 1):
                yield name, "\n".join(held)
                held = []
        if held:
            yield name, "\n".join(held)
    for s in closing_statements(spark, generator, dialect):
        yield "", s
    if dialect == MYSQL:
        yield "", "SET FOREIGN_KEY_CHECKS = 1;"


def insert_jdbc(spark: SparkSession, generator: Generator, url: str, dialect: str = POSTGRES, properties: dict[str, str] | None = None, session=None, batch: int = BATCH) -> int:
    """All rows, sequences and deferred keys through one connection of the driver, in one transaction; the number of statements.

    ``session`` has ``run(statement)`` and ``close(done)``; by default it is a JDBC connection. For tables that are too
    large for the driver's connection there is ``write_jdbc``.
    """
    session, n = session or JdbcSession(spark, url, properties), 0
    done = False
    try:
        for _, statement in direct_statements(spark, generator, dialect, batch):
            session.run(statement)
            n += 1
        done = True
    finally:
        session.close(done)
    return n


def write_jdbc(spark: SparkSession, generator: Generator, url: str, properties: dict[str, str] | None = None, dialect: str = POSTGRES, batch: int = 1000, session=None) -> None:
    """All tables in parallel through JDBC, in dependency order with deferred keys null; then sequences and deferred keys.

    Rows and what follows them are not one transaction: each task commits its rows, and the driver's connection the rest.
    """
    for name in generator.plan.tables:
        generator.frame(spark, name).write.option("batchsize", batch).jdbc(url, text.quote_identifier(name, dialect), mode="append", properties=properties or {})
    session, done = session or JdbcSession(spark, url, properties), False
    try:
        for statement in closing_statements(spark, generator, dialect):
            session.run(statement)
        done = True
    finally:
        session.close(done)


class SqliteSession:
    def __init__(self, path: str) -> None:
        self.db, self.done = sqlite3.connect(path, isolation_level=None), 0
        self.db.execute("PRAGMA foreign_keys = OFF")
        self.db.execute("BEGIN")

    def run(self, statement: str) -> None:
        n = self.db.execute(statement).rowcount
        self.done += n if statement.startswith("INSERT") else 0

    def close(self, done: bool) -> None:
        self.db.execute("COMMIT" if done else "ROLLBACK")
        self.db.close()


def insert_sqlite(spark: SparkSession, generator: Generator, path: str, progress=None) -> int:
    """All rows and deferred updates into a SQLite file in one transaction, by the driver; the number of rows."""
    session, done = SqliteSession(path), False
    try:
        for name, statement in direct_statements(spark, generator, SQLITE):
            session.run(statement)
            if progress and name:
                progress(name, session.done)
        done = True
    finally:
        session.close(done)
    return session.done


def preview(spark: SparkSession, generator: Generator, rows: int = 5) -> dict[str, list[dict]]:
    """The first rows of each table, values over 40 characters cut."""
    cut = lambda v: v if len(s := str(v)) <= 40 else s[:37] + "..."
    return {n: [{k: cut(v) for k, v in r.asDict().items()} for r in generator.frame(spark, n).limit(rows).collect()] for n in generator.plan.tables}


def apply_updates(rows: DataFrame, updates: DataFrame, table: str, column: str) -> DataFrame:
    """Rows (with ``_id``) after the deferred updates of one column."""
    mine = updates.filter((F.col("table_name") == table) & (F.col("column_name") == column)).select(F.col("row_index").alias("_at"), F.col("value").alias("_new"))
    kind = rows.schema[column].dataType
    return rows.join(mine, F.col("_id") == F.col("_at"), "left").withColumn(column, F.coalesce(F.col("_new").cast(kind), F.col(column))).drop("_at", "_new")


def schema_order(schema: Schema) -> list[str]:
    from ..plans.graph import DependencyGraph

    graph = DependencyGraph.of(schema)
    graph.break_cycles()
    return graph.order()


def total_rows(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [f.agg(F.count(F.lit(1)).alias("n")) for f in frames]).agg(F.sum("n").alias("n"))
