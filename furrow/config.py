"""Settings from ``furrow.toml``."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field

from .errors import ConfigError
from .schema import Schema

FILE = "furrow.toml"


@dataclass
class Config:
    url: str | None = None
    schema: str | None = None
    rows: int | None = None
    seed: int | None = None
    ai: bool = False
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    tables: dict[str, int] = field(default_factory=dict)
    columns: dict[tuple[str, str], dict] = field(default_factory=dict)
    break_at: tuple[str, ...] = ()

    def break_edges(self) -> list[tuple[str, str]]:
        """``table.column`` entries as pairs."""
        out = []
        for text in self.break_at:
            table, dot, column = text.partition(".")
            if not (dot and table and column):
                raise ConfigError(f"break_at: {text!r} is not table.column")
            out.append((table, column))
        return out

    def warnings(self, schema: Schema) -> list[str]:
        """Settings that name what the schema lacks."""
        out = [f"no table {t}" for t in [*self.tables, *self.include, *self.exclude] if t not in schema.tables]
        out += [f"no column {t}.{c}" for t, c in self.columns if t not in schema.tables or c not in schema.tables[t].columns]
        return out


def parse_config(text: str) -> Config:
    try:
        d = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(str(e)) from e
    database, generate = d.get("database", {}), d.get("generate", {})
    out = Config(database.get("url"), database.get("schema"), generate.get("rows"), generate.get("seed"), bool(generate.get("ai", False)), list(generate.get("include", [])), list(generate.get("exclude", [])))
    for name, table in d.get("tables", {}).items():
        if "rows" in table:
            if not isinstance(table["rows"], int) or table["rows"] < 0:
                raise ConfigError(f"tables.{name}.rows must be a whole number from 0")
            out.tables[name] = table["rows"]
    for name, said in d.get("columns", {}).items():
        table, dot, column = name.partition(".")
        if not dot:
            raise ConfigError(f"columns.{name}: the name must be table.column")
        if "weights" in said:
            if not said.get("values"):
                raise ConfigError(f"columns.{name}: weights need values")
            if len(said["weights"]) != len(said["values"]):
                raise ConfigError(f"columns.{name}: {len(said['values'])} values and {len(said['weights'])} weights")
        out.columns[table, column] = dict(said)
    out.break_at = tuple(d.get("graph", {}).get("break_cycle_at", ()))
    return out


def read_config(folder: str) -> Config:
    """The folder's settings; defaults if it has no file."""
    path = os.path.join(folder, FILE)
    if not os.path.exists(path):
        return Config()
    with open(path, encoding="utf-8") as f:
        return parse_config(f.read())


def resolve_url(said: str | None, config: Config, folder: str = ".") -> str:
    """The option, the environment's DATABASE_URL, that of ``.env``, or the settings'."""
    if said:
        return said
    if url := os.environ.get("DATABASE_URL"):
        return url
    env = os.path.join(folder, ".env")
    if os.path.exists(env):
        with open(env, encoding="utf-8") as f:
            for line in f:
                key, eq, value = line.strip().partition("=")
                if eq and key.removeprefix("export ").strip() == "DATABASE_URL":
                    return value.strip().strip("\"'")
    if config.url:
        return config.url
    raise ConfigError("no database: give --db, DATABASE_URL or database.url")


def parse_table_rows(text: str) -> dict[str, int]:
    """``a=1,b=2``; entries that aren't of that form are passed over."""
    out = {}
    for part in text.split(","):
        name, eq, n = part.partition("=")
        if eq and name.strip() and n.strip().isdigit():
            out[name.strip()] = int(n)
    return out
