"""The command line: generate, introspect, preview, check, graph, sample."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import os
import sys
import time

from pyspark.sql import SparkSession

from . import ai, lock
from .config import Config, parse_table_rows, read_config, resolve_url
from .errors import FurrowError, LockFileError
from .operators import drift, profile, sinks
from .operators.generate import Generator
from .plans.classify import classify_schema
from .plans.graph import DependencyGraph, dot, mermaid
from .plans.plan import build_plan
from .schema import SQLITE, Schema
from .sources import dialect_of, jdbc, sqlite


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="furrow")
    p.add_argument("-C", "--directory", default=".")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.add_argument("--db")
        c.add_argument("--schema")
        return c

    g = command("generate")
    g.add_argument("--rows", type=int)
    g.add_argument("--output")
    g.add_argument("--format", choices=["sql", "json", "csv", "parquet"])
    g.add_argument("--seed", type=int)
    g.add_argument("--table-rows", default="")
    g.add_argument("--include", default="")
    g.add_argument("--exclude", default="")
    g.add_argument("--copy", action="store_true")
    g.add_argument("--from-lock", action="store_true")
    g.add_argument("--force", action="store_true")
    g.add_argument("--subset", metavar="PROFILES")
    g.add_argument("--ai", action="store_true")
    g.add_argument("--model")
    command("introspect").add_argument("--format", choices=["table", "json"], default="table")
    command("preview").add_argument("--rows", type=int, default=5)
    command("check").add_argument("--format", choices=["text", "json"], default="text")
    command("graph").add_argument("--format", choices=["mermaid", "dot"], default="mermaid")
    s = command("sample")
    s.add_argument("--output", default="profiles.json")
    s.add_argument("--tables", default="")
    s.add_argument("--categorical-limit", type=int, default=50)
    s.add_argument("--min-rows", type=int, default=10)
    return p


def _names(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def read_schema(spark: SparkSession, url: str, schema: str | None) -> Schema:
    dialect = dialect_of(url)
    if dialect == SQLITE:
        return sqlite.SqliteIntrospector(url).introspect()
    return jdbc.JdbcIntrospector(spark, url if url.startswith("jdbc:") else f"jdbc:{url}", dialect, schema or "public").introspect()


def _generate(spark: SparkSession, a: argparse.Namespace, config: Config, url: str, out, ask=None) -> int:
    schema = read_schema(spark, url, a.schema or config.schema)
    meanings = classify_schema(schema)
    settings = {"rows": a.rows if a.rows is not None else config.rows or 100, "tables": config.tables | parse_table_rows(a.table_rows), "include": _names(a.include) or config.include, "exclude": _names(a.exclude) or config.exclude}
    columns, kept = config.columns, {}
    seed = a.seed if a.seed is not None else config.seed if config.seed is not None else int(time.time())
    base_time = dt.datetime.now(dt.UTC).replace(tzinfo=None, microsecond=0)
    if a.from_lock:
        held = lock.read_lock(a.directory)
        if held.hash != drift.schema_hash(schema) and not a.force:
            raise LockFileError("the schema has changed since the lock was written; --force goes on")
        seed, base_time, kept = held.seed, held.base_time, held.ai
        settings = {k: held.settings[k] for k in settings}
        columns = {tuple(k.split(".", 1)): v for k, v in held.settings.get("columns", {}).items()}
        meanings = ai.restore(meanings, kept)
    for warning in config.warnings(schema):
        sys.stderr.write(f"warning: {warning}\n")
    if a.ai or config.ai:
        ask = ask or ai.plug_in(a.model)
        before, meanings = meanings, ai.classify(schema, meanings, ask, os.path.join(a.directory, ".furrow", "ai"), f"{drift.schema_hash(schema)}-{a.model or 'default'}".replace("/", "_"))
        kept = kept | ai.changed(before, meanings)
    profiles = profile.as_distributions(profile.load_profiles(a.subset)) if a.subset else {}
    plan = build_plan(schema, seed, settings["rows"], base_time, settings["tables"], columns, profiles, meanings, config.break_at, settings["include"], settings["exclude"])
    generator = Generator(plan)
    if a.output == "direct":
        if schema.dialect == SQLITE:
            sinks.insert_sqlite(spark, generator, sqlite.path_of(url))
        else:
            sinks.insert_jdbc(spark, generator, url if url.startswith("jdbc:") else f"jdbc:{url}", schema.dialect)
    else:
        kind = sinks.format_for(a.output, a.format)
        if kind == "parquet":
            sinks.write_folder(spark, generator, a.output or "generated")
        else:
            target = open(a.output, "w", encoding="utf-8") if a.output else out
            try:
                if kind == "json":
                    sinks.write_json(spark, generator, target)
                elif kind == "csv":
                    sinks.write_csv(spark, generator, target)
                elif a.copy:
                    sinks.write_copy(spark, generator, target)
                else:
                    sinks.write_sql(spark, generator, target, schema.dialect)
            finally:
                if a.output:
                    target.close()
    lock.Lock(schema, seed, base_time, settings | {"columns": {f"{t}.{c}": v for (t, c), v in columns.items()}}, kept).write(a.directory)
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    """Run a command; 0, 1 on drift, 2 on an error."""
    a, out = parser().parse_args(argv), out or sys.stdout
    try:
        config = read_config(a.directory)
        url = resolve_url(a.db, config, a.directory)
        spark = spark or SparkSession.builder.appName("furrow").getOrCreate()
        if a.command == "generate":
            return _generate(spark, a, config, url, out)
        schema = read_schema(spark, url, a.schema or config.schema)
        if a.command == "introspect":
            if a.format == "json":
                json.dump(lock.schema_to_dict(schema), out, indent=2)
                out.write("\n")
            else:
                meanings = classify_schema(schema)
                for t in schema.tables.values():
                    out.write(f"{t.name}\n")
                    for c in t.columns.values():
                        marks = [m for m, on in (("pk", c.name in t.primary_key), ("auto", c.auto_increment), ("not null", not c.nullable)) if on]
                        out.write(f"  {c.name:<24} {c.type!s:<20} {meanings[t.name, c.name]:<16} {' '.join(marks)}\n")
                n = schema.counts()
                out.write(f"{n['tables']} tables, {n['columns']} columns, {n['foreign_keys']} foreign keys\n")
        elif a.command == "preview":
            for name, rows in sinks.preview(spark, Generator(build_plan(schema, 42, a.rows)), a.rows).items():
                out.write(f"{name}\n" + "".join(f"  {r}\n" for r in rows))
        elif a.command == "check":
            held = lock.read_lock(a.directory)
            found = drift.detect(held.schema, schema, held.hash)
            out.write(json.dumps(found.as_dict(), indent=2) + "\n" if a.format == "json" else found.summary() + "\n")
            return int(found.any)
        elif a.command == "graph":
            graph = DependencyGraph.of(schema)
            graph.break_cycles(config.break_at)
            out.write(mermaid(graph) if a.format == "mermaid" else dot(graph))
        elif a.command == "sample":
            wanted = _names(a.tables) or list(schema.tables)
            if schema.dialect == SQLITE:
                run = sqlite.runner(url)
            else:
                asked = jdbc.JdbcIntrospector(spark, url if url.startswith("jdbc:") else f"jdbc:{url}", schema.dialect)
                run = lambda q: [tuple(r.values()) for r in asked.run(q)]
            found = profile.sample_database(run, schema, wanted, a.categorical_limit, a.min_rows)
            profile.save_profiles(found, a.output)
            out.write(f"{len(found)} profiles in {a.output}\n")
    except FurrowError as e:
        sys.stderr.write(f"{type(e).__name__}: {e}\n")
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
