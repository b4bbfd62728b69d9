"""Where schemas and tables come from: catalogs over JDBC, SQLite files, parquet folders."""

from __future__ import annotations

from typing import Protocol

from ..errors import UnsupportedDatabase
from ..schema import MYSQL, POSTGRES, SQLITE, Schema


class Introspector(Protocol):
    """Anything that reads a schema."""

    def introspect(self) -> Schema: ...


def dialect_of(url: str) -> str:
    """The dialect that a URL's scheme names."""
    scheme = url.split(":", 1)[0].lower().removeprefix("jdbc")
    known = {"postgres": POSTGRES, "postgresql": POSTGRES, "mysql": MYSQL, "mariadb": MYSQL, "sqlite": SQLITE, "file": SQLITE}
    if scheme not in known:
        raise UnsupportedDatabase(scheme or url)
    return known[scheme]
