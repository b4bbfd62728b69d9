"""Times of the headline queries; prints one JSON line.

BENCH_SF_DIR is the folder of tables, BENCH_CPUS the number of local cores, BENCH_ROWS the rows that generation queries
make. Every query runs once to warm up and counts as the better of two further runs, into a sink that keeps nothing.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from furrow.operators import profile, sinks, validate  # noqa: E402
from furrow.operators.generate import Generator  # noqa: E402
from furrow.plans.classify import classify_column, classify_frame  # noqa: E402
from furrow.plans.plan import build_plan  # noqa: E402
from furrow.schema import Column, DataType, ForeignKey, Schema, Table  # noqa: E402
from furrow.sources.parquet import STAR_FOREIGN, read_table  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
ROWS = int(os.environ.get("BENCH_ROWS", "2000000"))
#: Registered queries draw by MD5, which their SQL can repeat; the library's default, and the command line's, is the faster hash.
EXACT = False
TEN = [("email", "varchar"), ("first_name", "varchar"), ("last_name", "varchar"), ("price", "double"), ("created_at", "timestamp"), ("is_active", "boolean"), ("description", "text"), ("status", "varchar"), ("quantity", "integer"), ("url", "varchar")]
TWENTY = ["id", "email", "first_name", "last_name", "password_hash", "created_at", "updated_at", "is_active", "age", "price", "description", "avatar_url", "phone", "city", "zip_code", "country", "status", "metadata", "slug", "quantity"]


def _generator(table: Table, rows: int, **options) -> Generator:
    schema = options.pop("schema", None) or Schema()
    schema.add(table)
    return Generator(build_plan(schema, 42, rows, dt.datetime(2025, 1, 1), **options), exact=EXACT)


def _ten() -> Generator:
    t = Table("items")
    for name, kind in TEN:
        t.add(Column(name, DataType.parse(kind), False))
    return _generator(t, ROWS)


def _fk() -> Generator:
    users = Table("users", primary_key=("id",)).add(Column("id", DataType.parse("serial"), False, auto_increment=True)).add(Column("email", DataType.parse("varchar"), False))
    orders = Table("orders", primary_key=("id",), foreign_keys=[ForeignKey(("user_id",), "users", ("id",))])
    orders.add(Column("id", DataType.parse("serial"), False, auto_increment=True)).add(Column("user_id", DataType.parse("integer"), False)).add(Column("amount", DataType.parse("double"), False))
    return _generator(orders, ROWS, schema=Schema().add(users), row_overrides={"users": 100})


def _values() -> Generator:
    t = Table("items").add(Column("color", DataType.parse("varchar"), False))
    return _generator(t, ROWS, overrides={("items", "color"): {"values": ["red", "blue", "green", "black", "white"], "weights": [0.25, 0.2, 0.2, 0.2, 0.15]}})


def _normal() -> Generator:
    t = Table("items").add(Column("amount", DataType.parse("double"), False))
    return _generator(t, ROWS, profiles={("items", "amount"): {"kind": "numeric", "min": 0, "max": 1000, "mean": 49.99, "stddev": 25}})


def _formatted(spark: SparkSession) -> DataFrame:
    """The rows that the formatters write: 7 columns of mixed types with nulls, ready in memory."""
    n = ROWS // 4
    df = spark.range(n).select(
        F.col("id").alias("_id"), F.concat(F.lit("User "), "id").alias("name"), F.concat(F.lit("user"), "id", F.lit("@example.com")).alias("email"), (F.col("id") % 80).cast("int").alias("age"),
        (F.col("id") * 0.37).alias("price"), (F.col("id") % 2 == 0).alias("active"), F.expr("timestamp_ntz '2025-01-01 00:00:00'").alias("created_at"), F.when(F.col("id") % 10 != 0, F.lit('A bio, with "quotes" and commas')).alias("bio"),
    ).cache()
    df.count()
    return df


def queries(spark: SparkSession) -> dict:
    read = lambda t: read_table(spark, SF, t)
    global EXACT
    out = {}
    for EXACT in (True, False):
        generated = {"gen_10_columns": (_ten(), "items"), "gen_foreign_keys": (_fk(), "orders"), "gen_weighted_values": (_values(), "items"), "gen_distribution": (_normal(), "items")}
        out |= {f"{k}_md5" if EXACT else k: (lambda g=g, t=t: g.frame(spark, t)) for k, (g, t) in generated.items()}
    rows = _formatted(spark)
    names = spark.range(ROWS // 20).select(F.col("id"), F.lit("users").alias("table_name"), F.explode(F.array(*[F.lit(c) for c in TWENTY])).alias("column_name"), F.lit("text").alias("kind"))
    # half the usual names, half with a number of their own: every name is another one
    own = names.withColumn("column_name", F.concat("column_name", F.when(F.col("id") % 2 == 0, F.concat(F.lit("_"), "id")).otherwise(F.concat(F.lit("_"), F.col("id"), F.lit("_id"))))).cache()
    own.count()
    out |= {
        "format_sql": lambda: sinks.literal_rows(rows),
        "format_json": lambda: sinks.json_lines(rows),
        "format_csv": lambda: sinks.csv_lines(rows),
        "classify_columns": lambda: classify_frame(own),
        "classify_repeated_columns": lambda: classify_frame(names),
        "profile_numeric_lineitem": lambda: profile.numeric(read("lineitem"), "lineitem"),
        "profile_categorical_orders": lambda: profile.categorical(read("orders"), "orders"),
        "profile_categorical_documents": lambda: profile.categorical(read("documents"), "documents", ["lang", "source"]),
        "fk_orphans": lambda: profile.union_all(validate.orphans(read(c), [col], read(p), [pc], f"{c}.{col}") for c, col, p, pc in STAR_FOREIGN),
        "unique_lineitem": lambda: validate.duplicates(read("lineitem"), ["l_orderkey", "l_linenumber"], "lineitem"),
    }
    return out


def classify_rate(distinct: bool) -> float:
    """Columns a second of the driver's classifier: a hundred tables of the same twenty columns, or every name another one."""
    kind = DataType.parse("varchar")
    names = [f"{c}_{i}" if distinct else c for i in range(100) for c in TWENTY]
    began = time.perf_counter()
    for c in names:
        classify_column(c, kind, "users")
    return len(names) / (time.perf_counter() - began)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name, make in queries(spark).items():
        best = float("inf")
        for k in range(3):
            began = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began) if k else best
        took[name] = round(best, 4)
    sizes = {k: ROWS for k in took if k.startswith(("gen_", "classify_"))} | dict.fromkeys(("format_sql", "format_json", "format_csv"), ROWS // 4)
    rates = {k: round(n / took[k]) for k, n in sizes.items()} | {"classify_columns_driver": round(classify_rate(True)), "classify_repeated_columns_driver": round(classify_rate(False))}
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "rows_per_second": rates, "rows": ROWS, "cpus": int(CPUS), "sf": os.path.basename(SF.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
