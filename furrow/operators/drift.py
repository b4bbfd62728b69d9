"""Differences between two schemas: as a report on the driver, and as DataFrames."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Column, Schema, Table


def _column(c: Column) -> dict:
    return {"name": c.name, "type": str(c.type), "nullable": c.nullable, "default": c.has_default, "auto": c.auto_increment, "length": c.max_length, "precision": c.precision, "scale": c.scale, "enum": c.enum_values}


def _key(k) -> str:
    return f"{','.join(k.columns)}->{k.parent}({','.join(k.parent_columns)})"


def constraints(table: Table) -> dict[str, set[str]]:
    return {"fk": {_key(k) for k in table.foreign_keys}, "unique": {",".join(u) for u in table.uniques}, "check": {c.text for c in table.checks}}


def schema_hash(schema: Schema) -> str:
    """SHA-256 of the schema; the order of constraints does not matter."""
    plain = [{"name": t.name, "columns": [_column(c) for c in t.columns.values()], "pk": list(t.primary_key), **{k: sorted(v) for k, v in constraints(t).items()}} for _, t in sorted(schema.tables.items())]
    return hashlib.sha256(json.dumps([schema.dialect, plain, sorted(schema.enums.items())], sort_keys=True).encode()).hexdigest()


@dataclass
class Drift:
    new_tables: list[str] = field(default_factory=list)
    removed_tables: list[str] = field(default_factory=list)
    new_columns: list[tuple[str, str]] = field(default_factory=list)
    removed_columns: list[tuple[str, str]] = field(default_factory=list)
    changed: list[tuple[str, str, str, str, str]] = field(default_factory=list)
    constraints: list[tuple[str, str, str, str]] = field(default_factory=list)
    other: list[tuple[str, str]] = field(default_factory=list)

    @property
    def any(self) -> bool:
        return any(vars(self).values())

    def summary(self) -> str:
        lines = [*(f"+ table {t}" for t in self.new_tables), *(f"- table {t}" for t in self.removed_tables)]
        lines += [*(f"+ column {t}.{c}" for t, c in self.new_columns), *(f"- column {t}.{c}" for t, c in self.removed_columns)]
        lines += [f"~ column {t}.{c}: {what} {a} -> {b}" for t, c, what, a, b in self.changed]
        lines += [f"{'+' if way == 'added' else '-'} {kind} {t}: {text}" for t, kind, way, text in self.constraints]
        lines += [f"~ {t}: {what}" for t, what in self.other]
        return "\n".join(lines) if lines else "no drift"

    def as_dict(self) -> dict:
        return {k: [list(x) if isinstance(x, tuple) else x for x in v] for k, v in vars(self).items()} | {"drift": self.any}


def detect(old: Schema, new: Schema, old_hash: str | None = None) -> Drift:
    """What changed; nothing is compared if the hashes are equal."""
    out = Drift()
    if (old_hash or schema_hash(old)) == schema_hash(new):
        return out
    out.new_tables = sorted(set(new.tables) - set(old.tables))
    out.removed_tables = sorted(set(old.tables) - set(new.tables))
    for name in sorted(set(old.tables) & set(new.tables)):
        a, b = old.tables[name], new.tables[name]
        out.new_columns += [(name, c) for c in b.columns if c not in a.columns]
        out.removed_columns += [(name, c) for c in a.columns if c not in b.columns]
        for c in (c for c in a.columns if c in b.columns):
            x, y = _column(a.columns[c]), _column(b.columns[c])
            out.changed += [(name, c, what, str(x[what]), str(y[what])) for what in x if x[what] != y[what]]
        if a.primary_key != b.primary_key:
            out.other.append((name, f"primary key {','.join(a.primary_key)} -> {','.join(b.primary_key)}"))
        before, after = constraints(a), constraints(b)
        for kind in before:
            out.constraints += [(name, kind, "added", x) for x in sorted(after[kind] - before[kind])]
            out.constraints += [(name, kind, "removed", x) for x in sorted(before[kind] - after[kind])]
    return out


def column_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """table_name, column_name, change from frames of (table_name, column_name, type, nullable): one full outer join."""
    a = old.select(F.col("table_name").alias("t1"), F.col("column_name").alias("c1"), F.col("type").alias("type1"), F.col("nullable").alias("null1"))
    b = new.select(F.col("table_name").alias("t2"), F.col("column_name").alias("c2"), F.col("type").alias("type2"), F.col("nullable").alias("null2"))
    both = a.join(b, (F.col("t1") == F.col("t2")) & (F.col("c1") == F.col("c2")), "full_outer")
    change = (
        F.when(F.col("t1").isNull(), "column_added")
        .when(F.col("t2").isNull(), "column_removed")
        .when(F.col("type1") != F.col("type2"), "type_changed")
        .when(F.col("null1") != F.col("null2"), "nullable_changed")
    )
    return both.select(F.coalesce("t1", "t2").alias("table_name"), F.coalesce("c1", "c2").alias("column_name"), change.alias("change")).filter("change is not null")


def constraint_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """table_name, kind, signature, change from frames of (table_name, kind, signature): set differences both ways."""
    columns = ["table_name", "kind", "signature"]
    a, b = old.select(*columns), new.select(*columns)
    return b.subtract(a).withColumn("change", F.lit("added")).unionByName(a.subtract(b).withColumn("change", F.lit("removed")))
