"""Rows of a generation plan as lazy DataFrames.

Every value is an expression of the row's number, so a table is one projection of ``spark.range``. A foreign key picks a
parent's row number and evaluates the parent's key expression there: no join, and no parent row is needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CompositeUniqueExhausted, ForeignKeyResolution, UniqueExhausted, UnsupportedStrategy
from ..functions.draws import Draws, combination, later, permuted
from ..plans.plan import ColumnPlan, GenerationPlan, TablePlan
from . import providers
from .correlated import group_value

#: Providers that a caller has registered: name -> function of a Context to a Column.
REGISTERED: dict[str, Callable[[providers.Context], Column]] = {}


def register_provider(name: str, function: Callable[[providers.Context], Column]) -> None:
    """Make a column builder available to overrides of the form ``custom = name``."""
    REGISTERED[name] = function


class Generator:
    """Tables of a plan. ``exact`` draws by MD5, which other engines can repeat; else by a hash of the JVM, several times as fast."""

    def __init__(self, plan: GenerationPlan, exact: bool = False) -> None:
        self.plan, self.exact = plan, exact
        self.base_time = F.lit(plan.base_time.replace(tzinfo=None)).cast("timestamp_ntz")
        self.composite = {(t.name, c): (u, i) for t in plan.tables.values() for u in t.uniques for i, c in enumerate(u)}

    def draws(self, table: str, id: Column) -> Draws:
        return Draws(self.plan.seed, table, id, self.exact)

    def _domain(self, table: TablePlan, c: ColumnPlan) -> int | None:
        """The number of different values of a column with a finite list or a key; None where it is open."""
        if c.strategy.kind in ("enum", "values"):
            return len(c.strategy.values)
        if c.strategy.kind in ("foreign_key", "deferred") and c.strategy.parent in self.plan.tables:
            return self.plan.tables[c.strategy.parent].rows
        return None

    def _place(self, table: TablePlan, c: ColumnPlan, id: Column) -> Column | None:
        """A place in the column's domain that keeps unique constraints; None where an independent draw will do."""
        n = self._domain(table, c)
        if n is None:
            return None
        name = c.column.name
        if c.unique:
            if n < table.rows:
                raise UniqueExhausted(f"{table.name}.{name}: {n} values for {table.rows} rows")
            return permuted(id, n, self.plan.seed, f"{table.name}.{name}")
        if (table.name, name) in self.composite:
            members, _ = self.composite[table.name, name]
            sizes = [self._domain(table, table.columns[m]) for m in members]
            if any(s is None for s in sizes):
                return None
            total = 1
            for s in sizes:
                total *= s
            if total < table.rows:
                raise CompositeUniqueExhausted(f"{table.name}({', '.join(members)}): {total} values for {table.rows} rows")
            return combination(id, sizes, members.index(name), self.plan.seed, members, self.draws(table.name, id))
        return None

    def _open_member(self, table: TablePlan, c: ColumnPlan) -> bool:
        """Whether the column carries the row's number for a composite key that has no finite domain."""
        if (table.name, c.column.name) not in self.composite:
            return False
        members, _ = self.composite[table.name, c.column.name]
        open_ = [m for m in members if self._domain(table, table.columns[m]) is None]
        return bool(open_) and open_[0] == c.column.name and not any(table.columns[m].unique for m in members)

    def pick(self, table: TablePlan, c: ColumnPlan, id: Column) -> Column:
        """The parent's row number for a key; all columns of one key share it."""
        parent = self.plan.tables[c.strategy.parent]
        if not parent.rows:
            if c.column.nullable:
                return F.lit(None).cast("bigint")
            raise ForeignKeyResolution(f"{table.name}.{c.column.name}: {parent.name} has no rows")
        place = self._place(table, c, id)
        return place if place is not None else self.draws(table.name, id).integer(0, parent.rows, f"key:{','.join(c.strategy.key)}")

    def raw(self, table: TablePlan, c: ColumnPlan, id: Column, seen: frozenset = frozenset()) -> tuple[str, Column]:
        """A column's kind of value and expression before nulls, in the kind of its source.

        ``seen``: the columns whose keys led here. A chain of keys ends at a column that is no key; one that comes back to
        a column of its own has no first value, so a provider gives one.
        """
        s, name, draws = c.strategy, c.column.name, self.draws(table.name, id)
        context = providers.Context(draws, name, self.base_time, c.checks)
        if s.kind == "auto":
            return "bigint", id + 1 + table.offset
        if s.kind in ("foreign_key", "deferred"):
            parent = self.plan.tables[s.parent]
            target = parent.columns[s.parent_columns[s.part]]
            if (parent.name, target.column.name) in seen:
                return providers.PROVIDERS[c.meaning][0], providers.PROVIDERS[c.meaning][1](context)
            return target.column.type.kind, self.value(parent, target, self.pick(table, c, id), seen | {(table.name, name)}, nulls=False)
        if s.kind in ("enum", "values"):
            place = self._place(table, c, id)
            values = list(s.values)
            if place is not None and values:
                return "string", F.element_at(F.array(*[F.lit(v) for v in values]), (place + 1).cast("int"))
            return ("string" if not values or isinstance(values[0], str) else "double"), draws.weighted(values, s.weights, name)
        if s.kind == "distribution":
            p = s.profile
            if p["kind"] == "categorical":
                return "string", draws.weighted([v for v, _ in p["values"]], [f for _, f in p["values"]], name)
            return "double", draws.normal(p["mean"], p["stddev"], p["min"], p["max"], name)
        if s.kind == "custom":
            if s.path in REGISTERED:
                return "registered", REGISTERED[s.path](context)
            raise UnsupportedStrategy(f"{table.name}.{name}: no provider is registered as {s.path!r}")
        if s.kind == "correlated":
            return providers.PROVIDERS[c.meaning][0], group_value(s.group, c.meaning, draws, self.base_time, name)
        return providers.PROVIDERS[c.meaning][0], providers.PROVIDERS[c.meaning][1](context)

    def _fits(self, kind: str, c: ColumnPlan) -> bool:
        t = c.column.type
        if kind == "registered" or c.strategy.kind in ("auto", "foreign_key", "deferred", "enum", "values", "distribution"):
            return True
        if t.is_numeric:
            return kind in ("bigint", "double")
        if t.kind == "boolean":
            return kind == "boolean"
        if t.is_temporal:
            return kind in ("timestamp", "date") if t.kind != "time" else c.meaning == "TimeOnly"
        if t.kind in ("json", "jsonb"):
            return c.meaning == "JsonData"
        if t.kind == "uuid":
            return c.meaning == "Uuid"
        return t.kind not in ("binary", "array", "interval")

    def _typed(self, c: ColumnPlan, context: providers.Context) -> Column:
        """A value for a column whose meaning does not fit its type."""
        t, p = c.column.type, providers.PROVIDERS
        if t.is_integer:
            low, high = providers.bounds(0, 1000, c.checks, 1)
            return context.draws.integer(int(low), int(high) + 1, context.column)
        if t.is_numeric:
            return p["Price"][1](context)
        by_kind = {"boolean": "BooleanFlag", "date": "DateOnly", "time": "TimeOnly", "timestamp": "Timestamp", "timestamptz": "Timestamp", "json": "JsonData", "jsonb": "JsonData", "uuid": "Uuid"}
        if t.kind in by_kind:
            return p[by_kind[t.kind]][1](context)
        if t.kind == "binary":
            return F.unhex(F.md5(context.draws.uuid(context.column)))
        return F.lit(None)

    def value(self, table: TablePlan, c: ColumnPlan, id: Column, seen: frozenset = frozenset(), nulls: bool = True) -> Column:
        """A column of the declared type: unique where it must be, null where it may."""
        target = c.column.type.spark(c.column.precision, c.column.scale)
        kind, out = self.raw(table, c, id, seen)
        context = providers.Context(self.draws(table.name, id), c.column.name, self.base_time, c.checks)
        if not self._fits(kind, c):
            out = self._typed(c, context)
        alone = c.strategy.kind in ("provider", "correlated", "distribution", "custom") and c.meaning not in providers.DISTINCT
        if (c.unique or self._open_member(table, c)) and alone:
            out = self._distinct(table, c, out, id)
        if isinstance(target, T.StringType):
            out = out.cast("string")
            if c.column.max_length and c.strategy.kind in ("provider", "correlated") and not c.unique:
                out = F.substring(out, 1, c.column.max_length)
        elif isinstance(target, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) and kind == "double":
            out = F.round(out).cast(target)
        elif kind == "string" and isinstance(target, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            out = out.cast("string").try_cast(target)
        else:
            out = out.cast(target)
        if nulls and c.null_share and table.rows:
            out = F.when(self.draws(table.name, id).uniform(c.column.name, 999) < c.null_share, F.lit(None)).otherwise(out)
        return out

    def _distinct(self, table: TablePlan, c: ColumnPlan, out: Column, id: Column) -> Column:
        t = c.column.type
        if t.is_integer:
            return id + 1
        if t.is_numeric:
            scale = c.column.scale if c.column.scale is not None else 2
            return id / float(10**scale)
        if t.kind == "boolean":
            if table.rows > 2:
                raise UniqueExhausted(f"{table.name}.{c.column.name}: 2 values for {table.rows} rows")
            return id == 1
        if t.kind == "date":
            return F.date_sub(F.lit(self.plan.base_time).cast("date"), id.cast("int"))
        if t.is_temporal:
            return later(self.base_time, seconds=-id)
        return F.concat_ws("-", out.cast("string"), id.cast("string"))

    def written(self, name: str, auto: bool = True) -> list[ColumnPlan]:
        """The columns that rows have. Without ``auto``, keys that the database numbers are left to it (unless a table has nothing else)."""
        columns = [c for c in self.plan.tables[name].columns.values() if c.strategy.kind != "skip"]
        return columns if auto else [c for c in columns if c.strategy.kind != "auto"] or columns

    def rows(self, spark: SparkSession, name: str, partitions: int | None = None, batch: int = 1) -> DataFrame:
        """Row numbers as ``id``, in order over partitions; with ``batch``, partitions begin at its multiples."""
        n = self.plan.tables[name].rows
        if batch == 1:
            return spark.range(0, n, 1, partitions) if partitions else spark.range(n)
        batches = -(-n // batch)
        parts = max(1, min(partitions or max(spark.sparkContext.defaultParallelism, n >> 20), batches))
        return spark.range(0, -(-batches // parts) * parts * batch, 1, parts).filter(F.col("id") < n)

    def frame(self, spark: SparkSession, name: str, keep_id: bool = False, final: bool = False, partitions: int | None = None, auto: bool = True, batch: int = 1) -> DataFrame:
        """A table's rows. Deferred keys are null, or their final values if ``final``; ``keep_id`` keeps the row's number as ``_id``."""
        table, made = self.plan.tables[name], []
        for c in self.written(name, auto):
            if c.strategy.kind == "deferred" and not final:
                made.append(F.lit(None).cast(c.column.type.spark(c.column.precision, c.column.scale)).alias(c.column.name))
            else:
                made.append(self.value(table, c, F.col("id")).alias(c.column.name))
        if keep_id:
            made.insert(0, F.col("id").alias("_id"))
        return self.rows(spark, name, partitions, batch).select(*made)

    def deferred_updates(self, spark: SparkSession) -> DataFrame:
        """table_name, row_index, column_name, value (text) of every deferred key of every row."""
        out = None
        for e in self.plan.deferred:
            table = self.plan.tables[e.child]
            for name in e.key.columns:
                value = self.value(table, table.columns[name], F.col("id"), nulls=False).cast("string")
                part = spark.range(table.rows).select(F.lit(e.child).alias("table_name"), F.col("id").alias("row_index"), F.lit(name).alias("column_name"), value.alias("value"))
                out = part if out is None else out.unionByName(part)
        return out if out is not None else spark.createDataFrame([], "table_name string, row_index long, column_name string, value string")

    def frames(self, spark: SparkSession, final: bool = False) -> dict[str, DataFrame]:
        """All tables in insertion order."""
        return {name: self.frame(spark, name, final=final) for name in self.plan.tables}


def stream_rows(spark: SparkSession, generator: Generator, name: str, rows_per_second: int = 10) -> DataFrame:
    """The same rows as an unbounded stream: row number n is the n-th tick of the rate source."""
    table = generator.plan.tables[name]
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return ticks.select(*[generator.value(table, c, F.col("value")).alias(c.column.name) for c in table.columns.values()])
