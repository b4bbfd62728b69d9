"""The relational schema on the driver, and its Spark types."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

POSTGRES, MYSQL, SQLITE = "postgresql", "mysql", "sqlite"

#: Spellings of column types (fixed values), by the type they name.
SPELLINGS = {
    "smallint": ("smallint", "int2", "smallserial", "serial2", "tinyint"),
    "integer": ("integer", "int", "int4", "mediumint"),
    "bigint": ("bigint", "int8"),
    "serial": ("serial", "serial4"),
    "bigserial": ("bigserial", "serial8"),
    "float": ("real", "float4", "float"),
    "double": ("double precision", "float8", "double"),
    "text": ("text", "tinytext", "mediumtext", "longtext", "clob"),
    "boolean": ("boolean", "bool", "bit"),
    "date": ("date",),
    "time": ("time", "time without time zone"),
    "timestamp": ("timestamp", "timestamp without time zone", "datetime"),
    "timestamptz": ("timestamp with time zone", "timestamptz"),
    "uuid": ("uuid",),
    "json": ("json",),
    "jsonb": ("jsonb",),
    "binary": ("bytea", "blob", "tinyblob", "mediumblob", "longblob", "binary", "varbinary"),
    "inet": ("inet", "cidr"),
    "macaddr": ("macaddr", "macaddr8"),
    "xml": ("xml",),
    "money": ("money",),
    "interval": ("interval",),
}
PREFIXES = (("numeric", "numeric"), ("decimal", "numeric"), ("character varying", "varchar"), ("varchar", "varchar"), ("char", "char"))

INTEGER_KINDS = ("smallint", "integer", "bigint", "serial", "bigserial")
NUMERIC_KINDS = (*INTEGER_KINDS, "float", "double", "numeric", "money")
STRING_KINDS = ("varchar", "char", "text")
TEMPORAL_KINDS = ("date", "time", "timestamp", "timestamptz")
SERIAL_KINDS = ("serial", "bigserial")

_BY_SPELLING = {s: k for k, all_ in SPELLINGS.items() for s in all_}


@dataclass(frozen=True)
class DataType:
    """A column type: its kind, the kind of an array's items, and what it was called."""

    kind: str
    item: DataType | None = None
    name: str = ""

    @staticmethod
    def parse(raw: str) -> DataType:
        """The type that a database's spelling means; an array is marked by ``[]`` behind or ``_`` in front."""
        text = raw.strip().lower()
        if text.endswith("[]"):
            return DataType("array", DataType.parse(text[:-2]), raw)
        if text.startswith("_"):
            return DataType("array", DataType.parse(text[1:]), raw)
        if kind := _BY_SPELLING.get(text):
            return DataType(kind, name=raw)
        for prefix, kind in PREFIXES:
            if text.startswith(prefix):
                return DataType(kind, name=raw)
        return DataType("unknown", name=raw)

    @property
    def is_serial(self) -> bool:
        return self.kind in SERIAL_KINDS

    @property
    def is_integer(self) -> bool:
        return self.kind in INTEGER_KINDS

    @property
    def is_numeric(self) -> bool:
        return self.kind in NUMERIC_KINDS

    @property
    def is_string(self) -> bool:
        return self.kind in STRING_KINDS

    @property
    def is_temporal(self) -> bool:
        return self.kind in TEMPORAL_KINDS

    def spark(self, precision: int | None = None, scale: int | None = None) -> T.DataType:
        simple = {
            "smallint": T.ShortType(), "integer": T.IntegerType(), "serial": T.IntegerType(), "bigint": T.LongType(), "bigserial": T.LongType(),
            "float": T.FloatType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampNTZType(),
            "timestamptz": T.TimestampType(), "binary": T.BinaryType(), "money": T.DecimalType(19, 2), "interval": T.DayTimeIntervalType(),
        }
        if self.kind == "numeric":
            return T.DecimalType(min(38, precision or 38), min(scale if scale is not None else (10 if precision is None else 0), 38))
        if self.kind == "array":
            return T.ArrayType(self.item.spark())
        return simple.get(self.kind, T.StringType())

    def __str__(self) -> str:
        return f"{self.item}[]" if self.kind == "array" else self.name or self.kind


@dataclass(frozen=True)
class Check:
    """A check constraint: its text and, where it could be read, a form with the column, an operator and a value."""

    text: str
    form: str = ""
    column: str = ""
    value: float | str | None = None


@dataclass
class Column:
    name: str
    type: DataType
    nullable: bool = True
    has_default: bool = False
    auto_increment: bool = False
    max_length: int | None = None
    precision: int | None = None
    scale: int | None = None
    enum_values: list[str] | None = None
    position: int = 0

    def field(self) -> T.StructField:
        extra = {"raw_type": str(self.type), "has_default": self.has_default, "auto_increment": self.auto_increment, "max_length": self.max_length, "enum_values": self.enum_values}
        return T.StructField(self.name, self.type.spark(self.precision, self.scale), self.nullable, {k: v for k, v in extra.items() if v is not None})


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    name: str = ""
    on_delete: str = "NO ACTION"
    on_update: str = "NO ACTION"
    deferrable: bool = False


@dataclass
class Table:
    name: str
    columns: dict[str, Column] = field(default_factory=dict)
    primary_key: tuple[str, ...] = ()
    foreign_keys: list[ForeignKey] = field(default_factory=list)
    uniques: list[tuple[str, ...]] = field(default_factory=list)
    checks: list[Check] = field(default_factory=list)

    def add(self, column: Column) -> Table:
        column.position = column.position or len(self.columns) + 1
        self.columns[column.name] = column
        return self

    def struct(self) -> T.StructType:
        return T.StructType([c.field() for c in self.columns.values()])


@dataclass
class Schema:
    dialect: str = POSTGRES
    name: str = ""
    tables: dict[str, Table] = field(default_factory=dict)
    enums: dict[str, list[str]] = field(default_factory=dict)

    def add(self, table: Table) -> Schema:
        self.tables[table.name] = table
        return self

    def counts(self) -> dict[str, int]:
        """Numbers of tables, foreign keys and columns."""
        return {"tables": len(self.tables), "foreign_keys": sum(len(t.foreign_keys) for t in self.tables.values()), "columns": sum(len(t.columns) for t in self.tables.values())}

    def frames(self, spark) -> dict[str, object]:
        """The schema as DataFrames: columns, fks, uniques and checks."""
        columns = [(t.name, c.name, str(c.type), c.type.kind, c.nullable, c.auto_increment, c.name in t.primary_key, c.position) for t in self.tables.values() for c in t.columns.values()]
        fks = [(t.name, list(f.columns), f.parent, list(f.parent_columns), f.name, f.on_delete, f.on_update, f.deferrable) for t in self.tables.values() for f in t.foreign_keys]
        uniques = [(t.name, list(u)) for t in self.tables.values() for u in t.uniques]
        checks = [(t.name, c.text) for t in self.tables.values() for c in t.checks]
        return {
            "columns": spark.createDataFrame(columns, "table_name string, column_name string, raw_type string, kind string, nullable boolean, auto_increment boolean, in_key boolean, position int"),
            "fks": spark.createDataFrame(fks, "table_name string, columns array<string>, parent string, parent_columns array<string>, name string, on_delete string, on_update string, deferrable boolean"),
            "uniques": spark.createDataFrame(uniques, "table_name string, columns array<string>"),
            "checks": spark.createDataFrame(checks, "table_name string, text string"),
        }


_NUMBER = r"\(?'?(-?\d+(?:\.\d+)?)'?\)?(?:::[a-z ]+)?"
_COLUMN = r"\(?\"?([A-Za-z_][A-Za-z0-9_]*)\"?\)?(?:::[a-z ]+)?"
_FORMS = (
    ("between", re.compile(rf"^{_COLUMN}\s+between\s+{_NUMBER}\s+and\s+{_NUMBER}$", re.I)),
    ("min_length", re.compile(rf"^\(?(?:char_)?length\({_COLUMN}\)\s*>\s*{_NUMBER}\)?$", re.I)),
    (">=", re.compile(rf"^{_COLUMN}\s*>=\s*{_NUMBER}$")),
    (">", re.compile(rf"^{_COLUMN}\s*>\s*{_NUMBER}$")),
    ("<=", re.compile(rf"^{_COLUMN}\s*<=\s*{_NUMBER}$")),
    ("<", re.compile(rf"^{_COLUMN}\s*<\s*{_NUMBER}$")),
    ("less_than_column", re.compile(rf"^{_COLUMN}\s*<\s*{_COLUMN}$")),
    ("in", re.compile(rf"^{_COLUMN}\s+in\s*\((.+)\)$", re.I)),
)


def _strip_parens(text: str) -> str:
    text = text.strip()
    while text.startswith("(") and text.endswith(")"):
        depth = 0
        for i, c in enumerate(text):
            depth += (c == "(") - (c == ")")
            if not depth and i < len(text) - 1:
                return text
        text = text[1:-1].strip()
    return text


def parse_check(text: str) -> Check:
    """Read a check constraint's text; what isn't a known form keeps its text alone.

    Forms: ``>=``, ``>``, ``<=``, ``<`` with a number, ``between`` (two numbers), ``in`` (values), ``min_length`` (the least
    allowed length) and ``less_than_column``. Parentheses and casts that servers add are seen through.
    """
    bare = _strip_parens(re.sub(r"^\s*check\s*", "", text, flags=re.I))
    for form, pattern in _FORMS:
        if not (m := pattern.match(bare)):
            continue
        if form == "between":
            return Check(text, form, m[1], f"{float(m[2])},{float(m[3])}")
        if form == "min_length":
            return Check(text, form, m[1], int(float(m[2])) + 1)
        if form == "less_than_column":
            return Check(text, form, m[1], m[2])
        if form == "in":
            return Check(text, form, m[1], ",".join(re.findall(r"'((?:[^']|'')*)'", m[2])) or m[2])
        return Check(text, form, m[1], float(m[2]))
    return Check(text)


def parse_enum_values(text: str) -> list[str]:
    """The values between an ``enum(...)`` or ``set(...)`` type's outer parentheses; doubled quotes are one."""
    inside = text[text.find("(") + 1 : text.rfind(")")] if "(" in text else ""
    return [v.replace("''", "'") for v in re.findall(r"'((?:[^']|'')*)'", inside)]


def renamed(column: Column, **changes) -> Column:
    return replace(column, **changes)
