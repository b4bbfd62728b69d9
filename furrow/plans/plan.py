"""Generation plans: how many rows each table gets and how each column is made."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from typing import Any

from ..schema import Check, Column, Schema
from .classify import classify_schema, detect_groups
from .graph import DependencyGraph, Edge, filter_tables


@dataclass(frozen=True)
class Strategy:
    """kind: auto, foreign_key, provider, enum, correlated, deferred, skip, custom, values or distribution."""

    kind: str
    parent: str = ""
    parent_columns: tuple[str, ...] = ()
    part: int = 0
    key: tuple[str, ...] = ()
    values: tuple = ()
    weights: tuple[float, ...] | None = None
    group: str = ""
    path: str = ""
    profile: Any = None


@dataclass
class ColumnPlan:
    column: Column
    meaning: str
    strategy: Strategy
    null_share: float = 0.0
    checks: tuple[Check, ...] = ()
    unique: bool = False


@dataclass
class TablePlan:
    name: str
    rows: int
    columns: dict[str, ColumnPlan] = field(default_factory=dict)
    primary_key: tuple[str, ...] = ()
    uniques: list[tuple[str, ...]] = field(default_factory=list)
    offset: int = 0


@dataclass
class GenerationPlan:
    seed: int
    base_time: dt.datetime
    tables: dict[str, TablePlan]
    deferred: list[Edge]


def row_count(table: str, schema: Schema, default: int, overrides: dict[str, int], ratios: dict[tuple[str, str], float], transitive: bool = False) -> int:
    """An override, else the first ratio among the table's keys times its parent's count, else the default.

    A parent counts with its override or the default, or with its own ratio if ``transitive``.
    """
    if table in overrides:
        return overrides[table]
    for key in schema.tables[table].foreign_keys:
        for c in key.columns:
            if (table, c) in ratios:
                far = transitive and key.parent != table and key.parent in schema.tables
                parent = row_count(key.parent, schema, default, overrides, ratios, True) if far else overrides.get(key.parent, default)
                return max(0, int(parent * ratios[table, c] + 0.5))
    return default


def build_plan(
    schema: Schema,
    seed: int = 42,
    rows: int = 100,
    base_time: dt.datetime = dt.datetime(2025, 1, 1),
    row_overrides: dict[str, int] | None = None,
    overrides: dict[tuple[str, str], dict] | None = None,
    profiles: dict[tuple[str, str], dict] | None = None,
    meanings: dict[tuple[str, str], str] | None = None,
    break_at: tuple[str, ...] = (),
    include: list[str] = (),
    exclude: list[str] = (),
    transitive: bool = False,
) -> GenerationPlan:
    """Choose a strategy for every column; the first that applies wins:

    an override (values, or a custom provider), the auto-increment key, any other auto-increment column (by its
    meaning), a deferred key, a key to a planned table, a profile, an enum, a correlated group, the meaning.
    ``profiles`` maps (table, column) to a distribution: kind ``categorical``, ``numeric`` or ``ratio``.
    """
    row_overrides, overrides, profiles = row_overrides or {}, overrides or {}, profiles or {}
    meanings = meanings or classify_schema(schema)
    graph = DependencyGraph.of(schema)
    deferred = list(graph.break_cycles(break_at))
    order = filter_tables(graph.order(), graph, include, exclude)
    later = {(e.child, c) for e in deferred if e.parent in order for c in e.key.columns}
    ratios = {k: p["ratio"] for k, p in profiles.items() if p.get("kind") == "ratio"}
    tables: dict[str, TablePlan] = {}
    for name in order:
        table = schema.tables[name]
        keys = {c: (k, i) for k in reversed(table.foreign_keys) if k.parent in order for i, c in enumerate(k.columns)}
        groups = {c: g for g, cs in detect_groups({c: meanings[name, c] for c in table.columns}).items() for c in cs}
        plan = TablePlan(name, row_count(name, schema, rows, row_overrides, ratios, transitive), primary_key=table.primary_key, uniques=[u for u in table.uniques if len(u) > 1])
        if len(table.primary_key) > 1:
            plan.uniques.append(table.primary_key)
        for c in table.columns.values():
            meaning = meanings[name, c.name]
            said = overrides.get((name, c.name), {})
            profile = profiles.get((name, c.name))
            in_key = c.name in table.primary_key
            if said.get("values"):
                how = Strategy("values", values=tuple(said["values"]), weights=tuple(said["weights"]) if said.get("weights") else None)
            elif said.get("custom"):
                how = Strategy("custom", path=said["custom"])
            elif c.auto_increment and in_key:
                how = Strategy("auto")
            elif c.auto_increment or c.type.is_serial:
                how = Strategy("provider")
            elif (name, c.name) in later:
                key, part = keys[c.name]
                how = Strategy("deferred", key.parent, key.parent_columns, part, key.columns)
            elif c.name in keys:
                key, part = keys[c.name]
                how = Strategy("foreign_key", key.parent, key.parent_columns, part, key.columns)
            elif profile and profile["kind"] in ("categorical", "numeric"):
                how = Strategy("distribution", profile=profile)
            elif c.enum_values is not None:
                how = Strategy("enum", values=tuple(c.enum_values))
            elif c.name in groups:
                how = Strategy("correlated", group=groups[c.name])
            else:
                how = Strategy("provider")
            null_share = 0.0 if not c.nullable or in_key else 0.8 if meaning == "DeletedAt" else 0.05
            unique = (c.name,) in table.uniques or table.primary_key == (c.name,)
            checks = tuple(k for k in table.checks if k.column == c.name)
            plan.columns[c.name] = ColumnPlan(c, meaning, how, null_share, checks, unique)
        tables[name] = plan
    return GenerationPlan(seed, base_time, tables, [e for e in deferred if e.child in order and e.parent in order])
