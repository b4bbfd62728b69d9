"""Profiles of tables: row counts, distributions of columns, child to parent ratios."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..errors import ProfileError
from ..functions import text
from ..schema import Schema

#: Parts of names that tell of personal data (fixed values), found anywhere in the lower-case name.
PII_PARTS = (
    "email", "e_mail", "first_name", "firstname", "last_name", "lastname", "full_name", "fullname", "middle_name", "middlename",
    "surname", "given_name", "givenname", "family_name", "familyname",
    "phone", "mobile", "telephone", "fax", "cell_number", "contact_number",
    "street", "address", "address_line", "city", "zip_code", "zipcode", "postal_code", "postalcode",
    "ssn", "social_security", "tax_id", "taxid", "national_id", "passport", "driver_license", "drivers_license",
    "credit_card", "creditcard", "card_number", "account_number", "routing_number", "iban", "bank_account",
    "password", "passwd", "password_hash", "pass_hash", "secret", "api_key", "apikey", "token", "auth_token", "refresh_token", "access_token",
    "date_of_birth", "dob", "birthdate", "ip_address", "ipaddress", "user_agent", "useragent", "mac_address",
)


def is_pii_name(name: str) -> bool:
    return any(p in name.lower() for p in PII_PARTS)


def pii_column(name):
    """The same test over a column of names."""
    return F.lower(name).rlike("|".join(PII_PARTS))


def row_count(df: DataFrame, table: str) -> DataFrame:
    return df.agg(F.lit(table).alias("table_name"), F.count(F.lit(1)).alias("n_rows")).select("table_name", "n_rows")


def _columns(df: DataFrame, kinds: tuple, skip: Iterable[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds) and f.name not in set(skip)]


def categorical(df: DataFrame, table: str, columns: list[str] | None = None, limit: int = 50) -> DataFrame:
    """table_name, column_name, value, n, freq: the most frequent values of every column, ties in order of value.

    ``freq`` is the share of all rows, nulls included. All columns are counted in one pass and one shuffle of
    pre-aggregated (column, value) pairs; ``limit`` values of a column and task are shuffled for the ranking.
    """
    columns = columns if columns is not None else _columns(df, (T.StringType,))
    if not columns:
        return df.sparkSession.createDataFrame([], "table_name string, column_name string, value string, n long, freq double")
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p")).select("p.*")
    counts = pairs.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    # the rank alone stands over the counts, so every task cuts its part to the limit before values meet
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc("value"))
    top = counts.filter("value is not null").withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= limit)
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    shares = top.crossJoin(F.broadcast(total)).withColumn("freq", F.col("n") / F.col("_total"))  # one row
    return shares.select(F.lit(table).alias("table_name"), "column_name", "value", "n", "freq")


def numeric(df: DataFrame, table: str, columns: list[str] | None = None, skip: Iterable[str] = ()) -> DataFrame:
    """table_name, column_name, min, max, mean, stddev (of the population) of every numeric column, in one aggregation."""
    columns = columns if columns is not None else _columns(df, (T.NumericType,), skip)
    schema = "table_name string, column_name string, min double, max double, mean double, stddev double"
    if not columns:
        return df.sparkSession.createDataFrame([], schema)
    d = {c: F.col(c).cast("double") for c in columns}
    stats = df.agg(*[F.struct(F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("stddev")).alias(c) for c, x in d.items()])
    rows = stats.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("s")) for c in columns])).alias("x"))
    return rows.select(F.lit(table).alias("table_name"), "x.column_name", "x.s.min", "x.s.max", "x.s.mean", "x.s.stddev").filter("min is not null")


def profile_long(df: DataFrame, table: str, skip: Iterable[str] = (), limit: int = 50, least_rows: int = 10) -> DataFrame:
    """table_name, column_name, kind, metric, value of a table: nothing if it has fewer than ``least_rows`` rows."""
    num = numeric(df, table, skip=skip).select("table_name", "column_name", F.lit("numeric").alias("kind"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("min", "max", "mean", "stddev")])).alias("m")).select("table_name", "column_name", "kind", "m.*")
    cat = categorical(df, table, _columns(df, (T.StringType,), skip), limit).select("table_name", "column_name", F.lit("categorical").alias("kind"), F.col("value").alias("metric"), F.col("freq").alias("value"))
    enough = df.agg((F.count(F.lit(1)) >= least_rows).alias("_enough")).filter("_enough")
    return num.unionByName(cat).join(enough, how="left_semi", on=F.lit(True))


def ratios(counts: DataFrame, keys: DataFrame) -> DataFrame:
    """table_name, column_name, parent, ratio from (table_name, n_rows) and (table_name, column_name, parent); empty parents have none."""
    child = counts.select("table_name", F.col("n_rows").alias("child_rows"))
    parent = counts.select(F.col("table_name").alias("parent"), F.col("n_rows").alias("parent_rows"))
    both = keys.join(child, "table_name").join(parent, "parent").filter("parent_rows > 0")
    return both.select("table_name", "column_name", "parent", (F.col("child_rows") / F.col("parent_rows")).alias("ratio"))


def ratio(child: DataFrame, parent: DataFrame) -> DataFrame:
    """One row: the child's rows for each of the parent's, 0 if the parent is empty."""
    n, m = child.agg(F.count(F.lit(1)).alias("n")), parent.agg(F.count(F.lit(1)).alias("m"))
    return n.join(m, how="inner", on=F.lit(True)).select(F.when(F.col("m") == 0, 0.0).otherwise(F.col("n") / F.col("m")).alias("ratio"))


def mask(profiles: DataFrame) -> DataFrame:
    """Long profiles without categorical values of columns whose names tell of personal data."""
    return profiles.filter(~(pii_column(F.col("column_name")) & (F.col("kind") == "categorical")))


def masked_count(profiles: DataFrame) -> DataFrame:
    """One row: the number of columns whose categorical values ``mask`` takes away."""
    gone = profiles.filter(pii_column(F.col("column_name")) & (F.col("kind") == "categorical"))
    return gone.select("table_name", "column_name").distinct().agg(F.count(F.lit(1)).alias("n_masked"))


def sample_database(run: Callable[[str], list[tuple]], schema: Schema, tables: list[str], limit: int = 50, least_rows: int = 10, masked: bool = True) -> list[dict]:
    """``sample`` by aggregates that the database computes: ``run`` answers a query with rows, and no table is read out.

    Only what a profile holds comes back. Counted keys are left out; ratios are those of tables in ``tables``.
    """
    q = lambda n: text.quote_identifier(n, schema.dialect)
    out, counts = [], {}
    for name in tables:
        counts[name] = n = int(run(f"SELECT count(*) FROM {q(name)}")[0][0])
        if n < least_rows:
            continue
        columns: dict[str, dict] = {}
        for c in schema.tables[name].columns.values():
            if c.auto_increment or c.type.is_serial:
                continue
            x = q(c.name)
            if c.type.is_numeric:
                low, high, mean = run(f"SELECT min({x}), max({x}), avg({x} * 1.0) FROM {q(name)}")[0]
                if low is not None:
                    off = f"({x} * 1.0 - ({float(mean)!r}))"
                    spread = run(f"SELECT avg({off} * {off}) FROM {q(name)}")[0][0]
                    columns[c.name] = {"kind": "numeric", "min": float(low), "max": float(high), "mean": float(mean), "stddev": max(0.0, float(spread)) ** 0.5}
            elif (c.type.is_string or c.enum_values is not None) and not (masked and is_pii_name(c.name)):
                found = run(f"SELECT {x}, count(*) FROM {q(name)} WHERE {x} IS NOT NULL GROUP BY {x} ORDER BY count(*) DESC, {x} LIMIT {limit}")
                if found:
                    columns[c.name] = {"kind": "categorical", "values": [[str(v), int(k) / n] for v, k in found]}
        out.append({"table": name, "rows": n, "columns": columns})
    for p in out:
        for k in schema.tables[p["table"]].foreign_keys:
            if counts.get(k.parent):
                p["columns"][f"__ratio_{k.columns[0]}"] = {"kind": "ratio", "parent": k.parent, "ratio": p["rows"] / counts[k.parent]}
    return out


def sample(tables: dict[str, DataFrame], keys: list[tuple[str, str, str]] = (), limit: int = 50, least_rows: int = 10, masked: bool = True, skip: dict[str, list[str]] | None = None) -> list[dict]:
    """Profiles for interchange: a list of {table, rows, columns: {name: distribution}}.

    Distributions are {kind: categorical, values: [[value, freq]]}, {kind: numeric, min, max, mean, stddev} or, under
    the key column's name, {kind: ratio, parent, ratio}. What reaches the driver is bounded by columns and ``limit``.
    """
    out, counts = [], {}
    for name, df in tables.items():
        counts[name] = df.count()
        if counts[name] < least_rows:
            continue
        columns: dict[str, dict] = {}
        for r in numeric(df, name, skip=(skip or {}).get(name, ())).collect():
            columns[r["column_name"]] = {"kind": "numeric", "min": r["min"], "max": r["max"], "mean": r["mean"], "stddev": r["stddev"]}
        for r in categorical(df, name, limit=limit).orderBy("column_name", F.desc("n"), "value").collect():
            if not (masked and is_pii_name(r["column_name"])):
                columns.setdefault(r["column_name"], {"kind": "categorical", "values": []})["values"].append([r["value"], r["freq"]])
        out.append({"table": name, "rows": counts[name], "columns": columns})
    for child, column, parent in keys:
        entry = next((p for p in out if p["table"] == child), None)
        if entry and counts.get(parent):
            entry["columns"][f"__ratio_{column}"] = {"kind": "ratio", "parent": parent, "ratio": counts[child] / counts[parent]}
    return out


def save_profiles(profiles: list[dict], path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(profiles, f, indent=2, ensure_ascii=False)


def load_profiles(path: str) -> list[dict]:
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
    except (OSError, ValueError) as e:
        raise ProfileError(f"{path}: {e}") from e
    if not isinstance(found, list) or not all(isinstance(p, dict) and "table" in p and "columns" in p for p in found):
        raise ProfileError(f"{path}: not a list of profiles")
    return found


def as_distributions(profiles: list[dict]) -> dict[tuple[str, str], dict]:
    """Profiles as (table, column) -> distribution, as plans take them."""
    return {(p["table"], c.removeprefix("__ratio_")): d for p in profiles for c, d in p["columns"].items() if d["kind"] != "ratio"} | {(p["table"], c.removeprefix("__ratio_")): d for p in profiles for c, d in p["columns"].items() if d["kind"] == "ratio"}


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
