"""Lock files: the schema, seed and settings of a generation, to repeat it and to detect drift."""

from __future__ import annotations

import dataclasses
import datetime as dt
import json
import os
from typing import Any

from .errors import LockFileError
from .operators.drift import schema_hash
from .schema import Check, Column, DataType, ForeignKey, Schema, Table

FILE = "furrow.lock"
VERSION = 1


def _type(d: dict | None) -> DataType | None:
    return None if d is None else DataType(d["kind"], _type(d["item"]), d["name"])


def schema_to_dict(schema: Schema) -> dict:
    return dataclasses.asdict(schema)


def schema_from_dict(d: dict) -> Schema:
    out = Schema(d["dialect"], d["name"], enums=d["enums"])
    for t in d["tables"].values():
        columns = {n: Column(**{**c, "type": _type(c["type"])}) for n, c in t["columns"].items()}
        keys = [ForeignKey(**{**k, "columns": tuple(k["columns"]), "parent_columns": tuple(k["parent_columns"])}) for k in t["foreign_keys"]]
        out.add(Table(t["name"], columns, tuple(t["primary_key"]), keys, [tuple(u) for u in t["uniques"]], [Check(**c) for c in t["checks"]]))
    return out


@dataclasses.dataclass
class Lock:
    schema: Schema
    seed: int
    base_time: dt.datetime
    settings: dict[str, Any] = dataclasses.field(default_factory=dict)
    ai: dict[str, str] = dataclasses.field(default_factory=dict)
    hash: str = ""

    def __post_init__(self) -> None:
        self.hash = self.hash or schema_hash(self.schema)

    def write(self, folder: str) -> str:
        """Write beside the target, flush, then rename: a reader sees the old file or the new one."""
        path = os.path.join(folder, FILE)
        body = {"version": VERSION, "schema_hash": self.hash, "seed": self.seed, "base_time": self.base_time.isoformat(timespec="seconds"), "settings": self.settings, "ai": dict(sorted(self.ai.items())), "schema": schema_to_dict(self.schema)}
        with open(f"{path}.tmp", "w", encoding="utf-8") as f:
            json.dump(body, f, indent=2, ensure_ascii=False)
            f.flush()
            os.fsync(f.fileno())
        os.replace(f"{path}.tmp", path)
        return path


def read_lock(folder: str) -> Lock:
    path = os.path.join(folder, FILE)
    try:
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        return Lock(schema_from_dict(d["schema"]), d["seed"], dt.datetime.fromisoformat(d["base_time"]), d["settings"], d["ai"], d["schema_hash"])
    except FileNotFoundError as e:
        raise LockFileError(f"no lock file at {path}") from e
    except (ValueError, KeyError, TypeError) as e:
        raise LockFileError(f"{path}: {e}") from e
