"""Generated rows: constraints, bounds, repeatability and text forms."""

import datetime as dt
import io
import json
import random
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from furrow import cli, examples
from furrow.errors import CompositeUniqueExhausted, ForeignKeyResolution, UniqueExhausted, UnsupportedStrategy
from furrow.functions.draws import Draws, combination, permuted, whole_part
from furrow.operators import profile, sinks, validate
from furrow.operators.generate import REGISTERED, Generator, register_provider, stream_rows
from furrow.operators.providers import PROVIDERS, Context, bounds
from furrow.plans.classify import MEANINGS
from furrow.plans.plan import build_plan
from furrow.schema import Column, DataType, ForeignKey, Schema, Table, parse_check
from furrow.sources.sqlite import SqliteIntrospector, read_table, runner

BASE = dt.datetime(2025, 1, 1)
ROWS = {"users": 200, "categories": 30, "products": 60, "orders": 300, "order_items": 900, "stores": 50}


@pytest.fixture(scope="module", params=[True, False], ids=["md5", "fast"])
def shop(request):
    return Generator(build_plan(examples.shop(), 42, 100, BASE, ROWS), exact=request.param)


def broken(df):
    return df.collect()[0]["violations"]


def test_constraints(spark, shop):
    frames = {n: f.cache() for n, f in shop.frames(spark, final=True).items()}
    schema = examples.shop()
    for name, table in schema.tables.items():
        df = frames[name]
        assert df.count() == ROWS[name]
        for k in table.foreign_keys:
            assert broken(validate.orphans(df, list(k.columns), frames[k.parent], list(k.parent_columns), name)) == 0
        for u in [table.primary_key, *table.uniques]:
            assert broken(validate.duplicates(df, list(u), name)) == 0
        for c in table.columns.values():
            if not c.nullable:
                assert broken(validate.nulls(df, c.name, name)) == 0
    assert broken(validate.breaks(frames["products"], F.col("price") >= 0, "p")) == 0
    assert broken(validate.outside(frames["orders"], "status", examples.shop().enums["order_status"], "s")) == 0
    users = frames["users"]
    assert users.filter("updated_at < created_at or deleted_at < updated_at").count() == 0
    assert 0.6 < users.filter("is_active").count() / 200 < 0.8
    stores = frames["stores"]
    assert stores.filter("start_date >= end_date").count() == 0
    assert stores.select("city", "state", "zip_code").distinct().count() <= 50


def test_partitions_do_not_matter(spark, shop):
    one, many = shop.frame(spark, "users", partitions=1), shop.frame(spark, "users", partitions=8)
    assert validate.same_rows(one, many)


def test_seed_matters(spark):
    a, b = (Generator(build_plan(examples.shop(), s, 50, BASE)).frame(spark, "users") for s in (1, 2))
    assert not validate.same_rows(a, b)


def test_deferred(spark):
    g = Generator(build_plan(examples.circular(), 1, 40, BASE))
    frame = g.frame(spark, "employees", keep_id=True)
    assert frame.filter("manager_id is not null").count() == 0
    updates = g.deferred_updates(spark)
    assert updates.count() == 40 * len(g.plan.deferred)
    done = sinks.apply_updates(frame, updates, "employees", "manager_id")
    assert done.filter("manager_id between 1 and 40").count() == 40


def test_uuid_keys_and_type_guards(spark):
    g = Generator(build_plan(examples.blog(), 3, 60, BASE, {"tags": 20, "post_tags": 500}))
    f = g.frames(spark, final=True)
    assert broken(validate.orphans(f["comments"], ["post_id"], f["posts"], ["id"], "c")) == 0
    assert broken(validate.orphans(f["post_tags"], ["post_id"], f["posts"], ["id"], "c")) == 0
    assert broken(validate.duplicates(f["post_tags"], ["post_id", "tag_id"], "k")) == 0
    posts = f["posts"]
    assert dict(posts.dtypes)["view_count"] == "int"
    assert posts.filter("view_count < 0").count() == 0
    assert dict(posts.dtypes)["published_at"] == "timestamp"
    assert posts.filter("not id rlike '^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$'").count() == 0
    assert all(json.loads(r["metadata"])["retries"] < 5 for r in posts.filter("metadata is not null").collect())


def test_every_provider(spark):
    assert set(PROVIDERS) == set(MEANINGS)
    d = Draws(5, "t", F.col("id"))
    base = F.lit(BASE).cast("timestamp_ntz")
    df = spark.range(40).select(*[e(Context(d, m, base)).alias(m) for m, (_, e) in PROVIDERS.items()])
    kinds = {"timestamp_ntz": "timestamp"}
    assert {c: kinds.get(t, t) for c, t in df.dtypes} == {m: k for m, (k, _) in PROVIDERS.items()}
    rows = df.collect()
    assert all(v is not None for r in rows for v in r)
    assert all(len(r["Token"]) == 32 and r["Token"].isalnum() and len(r["PasswordHash"]) == 60 for r in rows)


def test_domains_too_small(spark):
    s = examples.blog()
    with pytest.raises(CompositeUniqueExhausted):
        Generator(build_plan(s, 1, 5, BASE, {"post_tags": 26})).frame(spark, "post_tags")
    with pytest.raises(UniqueExhausted):
        Generator(build_plan(s, 1, 5, BASE, overrides={("tags", "name"): {"values": ["a", "b"]}})).frame(spark, "tags")
    with pytest.raises(ForeignKeyResolution):
        Generator(build_plan(s, 1, 5, BASE, {"posts": 0})).frame(spark, "comments")
    assert Generator(build_plan(s, 1, 5, BASE, {"posts": 0})).frame(spark, "posts").count() == 0


def test_custom_providers(spark):
    plan = build_plan(examples.blog(), 1, 5, BASE, overrides={("tags", "color"): {"custom": "mine"}})
    with pytest.raises(UnsupportedStrategy):
        Generator(plan).frame(spark, "tags")
    register_provider("mine", lambda c: F.concat(F.lit("c"), c.row.cast("string")))
    try:
        seen = {r["color"] for r in Generator(plan).frame(spark, "tags").collect()}
        assert seen - {None} <= {f"c{i}" for i in range(5)}
    finally:
        REGISTERED.pop("mine")


def test_weighted_and_normal(spark):
    d = Draws(7, "t", F.col("id"))
    df = spark.range(2000).select(d.weighted(["a", "b"], [0.9, 0.1], "w").alias("w"), d.weighted(["a", "b", "c"], [0, -1, 0], "z").alias("z"), d.weighted(["a", "b", "c"], [1, 1, -5], "n").alias("n"), d.normal(15, 30, 10, 20, "x").alias("x"), d.normal(42.5, 0, 0, 100, "y").alias("y"), d.weighted([], [], "e").alias("e")).cache()
    assert df.filter("w = 'a'").count() > 1700
    assert df.select("z").distinct().count() == 3
    assert df.filter("n = 'c'").count() == 0
    assert df.filter("x < 10 or x > 20").count() == 0
    assert df.filter("y <> 42.5").count() == 0
    assert df.filter("e is not null").count() == 0


@pytest.mark.parametrize("size", [1, 2, 97, 1000, 999_983])
def test_permutation(spark, size):
    n = min(size, 1000)
    df = spark.range(n).select(permuted(F.col("id"), size, 3, "k").alias("p"))
    assert df.distinct().count() == n
    assert df.filter((F.col("p") < 0) | (F.col("p") >= size)).count() == 0


def test_bounds():
    assert bounds(1, 100, (parse_check("a > 5"), parse_check("a <= 50")), 1) == (6, 50)
    assert bounds(1, 100, (parse_check("a > 200"),), 1) == (201, 301)


def test_profiles_drive_generation(spark):
    t = Table("t").add(Column("kind", DataType.parse("varchar"), False)).add(Column("n", DataType.parse("integer"), False))
    found = {("t", "kind"): {"kind": "categorical", "values": [["x", 0.75], ["y", 0.25]]}, ("t", "n"): {"kind": "numeric", "min": 0, "max": 9, "mean": 5, "stddev": 2}}
    df = Generator(build_plan(Schema().add(t), 1, 1000, BASE, profiles=found)).frame(spark, "t").cache()
    assert 700 < df.filter("kind = 'x'").count() < 800
    assert dict(df.dtypes)["n"] == "int"
    assert df.filter("n < 0 or n > 9").count() == 0


def test_profile_edges(spark):
    empty = spark.createDataFrame([], "a string, n double")
    assert profile.categorical(empty, "t").count() == 0
    assert profile.numeric(empty, "t").count() == 0
    df = spark.createDataFrame([("x", 1.0), (None, None), ("x", 3.0), ("y", None)], "a string, n double")
    top = profile.categorical(df, "t", limit=1).collect()
    assert [(r["value"], r["freq"]) for r in top] == [("x", 0.5)]
    assert profile.profile_long(df, "t", least_rows=5).count() == 0
    assert profile.profile_long(df, "t", least_rows=4).count() == 6
    s = profile.sample({"t": df.withColumnRenamed("a", "email")}, least_rows=1)
    assert "email" not in s[0]["columns"]


def test_profiles_file(tmp_path, spark):
    p = [{"table": "t", "rows": 4, "columns": {"a": {"kind": "categorical", "values": [["x", 0.5]]}, "__ratio_b": {"kind": "ratio", "parent": "q", "ratio": 2.0}}}]
    profile.save_profiles(p, str(tmp_path / "p.json"))
    assert profile.load_profiles(str(tmp_path / "p.json")) == p
    assert profile.as_distributions(p)["t", "b"]["ratio"] == 2.0


def test_text_forms(spark):
    df = spark.createDataFrame([(0, "a'b", None, True, bytearray(b"\x01\xff"), float("nan"))], "_id long, s string, m string, b boolean, x binary, f double")
    assert sinks.literal_rows(df).collect()[0]["row"] == "('a''b', NULL, TRUE, '\\x01ff', 'NaN')"
    assert sinks.literal_rows(df, "mysql").collect()[0]["row"] == "('a''b', NULL, 1, X'01ff', 'NaN')"
    assert json.loads(sinks.json_lines(df).collect()[0]["line"]) == {"s": "a'b", "m": None, "b": True, "x": "Af8=", "f": None}
    assert sinks.copy_lines(df.select("_id", "s", "m", "b")).collect()[0]["line"] == "a'b\t\\N\tt"
    assert sinks.format_for("x.json") == "json"
    assert sinks.format_for("x.csv", "sql") == "sql"
    assert sinks.format_for(None) == "sql"
    assert sinks.hidden_password("postgres://u:p@h:5/d") == "postgres://u:***@h:5/d"


def test_writers(spark, tmp_path):
    g = Generator(build_plan(examples.circular(), 1, 12, BASE))
    out = io.StringIO()
    sinks.write_json(spark, g, out)
    doc = json.loads(out.getvalue())
    assert len(doc["employees"]) == 12
    assert len(doc["_deferred_updates"]) == 12 * len(g.plan.deferred)
    out = io.StringIO()
    sinks.write_csv(spark, g, out)
    assert out.getvalue().count("# Table:") == 2
    out = io.StringIO()
    sinks.write_copy(spark, g, out)
    assert out.getvalue().count("\\.\n") == 2
    sinks.write_folder(spark, g, str(tmp_path / "f"), "parquet")
    assert spark.read.parquet(str(tmp_path / "f/employees")).filter("manager_id is null").count() == 0


def test_keys_of_deep_chains_and_circles(spark):
    """Keys to keys: a chain of any length has values; a circle of keys ends where it began."""
    schema = Schema()
    for i in range(13):
        t = Table(f"t{i}", primary_key=("id",)).add(Column("id", DataType.parse("uuid"), False))
        t.foreign_keys = [ForeignKey(("id",), f"t{i - 1}", ("id",))] if i else []
        schema.add(t)
    g = Generator(build_plan(schema, 1, 50, BASE))
    ids = [{r["id"] for r in g.frame(spark, f"t{i}").collect()} for i in range(13)]
    assert all(x == ids[0] and len(x) == 50 and None not in x for x in ids)
    circle = Schema()
    for a, b in (("x", "y"), ("y", "x")):
        t = Table(a, primary_key=("id",), foreign_keys=[ForeignKey(("id",), b, ("id",))]).add(Column("id", DataType.parse("uuid"), False))
        circle.add(t)
    g = Generator(build_plan(circle, 1, 5, BASE))
    assert all(g.frame(spark, t, final=True).filter("id is null").count() == 0 for t in "xy")


def test_combinations_spread(spark):
    """Few rows of a large product use all of every size; rows are different; numbers beyond 2^53 are exact."""
    rows, sizes = spark.range(20_000), [10_000_000, 10_000_000, 7]
    d = Draws(3, "t", F.col("id"))
    df = rows.select(*[combination(F.col("id"), sizes, k, 3, ["a", "b", "c"], d).alias(n) for k, n in enumerate("abc")]).cache()
    assert df.distinct().count() == 20_000
    for n, size in zip("ab", sizes, strict=False):
        assert df.select(F.floor(F.col(n) / (size // 100))).distinct().count() == 100
        assert df.filter(f"{n} < 0 or {n} >= {size}").count() == 0
    small = spark.range(60).select(*[combination(F.col("id"), [3, 4, 5], k, 3, ["a", "b", "c"], d).alias(n) for k, n in enumerate("abc")])
    assert small.distinct().count() == 60
    big = spark.range(1).select(whole_part(F.lit(2**55 + 3), 3).alias("x")).collect()[0]["x"]
    assert big == (2**55 + 3) // 3


def test_folder_has_deferred_updates(spark, tmp_path):
    g = Generator(build_plan(examples.circular(), 1, 250, BASE))
    for kind in ("sql", "copy"):
        sinks.write_folder(spark, g, str(tmp_path / kind), kind)
        updates = [r["value"] for r in spark.read.text(str(tmp_path / kind / "_deferred_updates")).collect()]
        assert len(updates) == 250 * len(g.plan.deferred)
    # statements are whole in every file, and a database takes them
    db = sqlite3.connect(":memory:")
    db.executescript(DDL)
    for table in g.plan.tables:
        for path in sorted((tmp_path / "sql" / table).glob("part-*")):
            db.executescript(path.read_text())
    db.executescript("\n".join(r["value"] for r in spark.read.text(str(tmp_path / "sql" / "_deferred_updates")).collect()))
    assert db.execute("select count(*), count(manager_id), count(department_id) from employees").fetchone() == (250, 250, 250)
    assert db.execute("pragma foreign_key_check").fetchall() == []


def test_scripts_leave_counted_keys_to_the_database(spark):
    g = Generator(build_plan(examples.circular(), 1, 230, BASE))
    out = io.StringIO()
    sinks.write_sql(spark, g, out, "sqlite")
    assert 'INTO "employees" ("name", "email", "department_id", "manager_id")' in out.getvalue()
    db = sqlite3.connect(":memory:")
    db.executescript(DDL)
    db.executescript(out.getvalue())
    assert db.execute("select count(*), max(id), count(manager_id) from employees").fetchone() == (230, 230, 230)
    assert db.execute("pragma foreign_key_check").fetchall() == []
    out = io.StringIO()
    sinks.write_copy(spark, g, out)
    assert 'COPY "employees" ("name", "email", "department_id", "manager_id")' in out.getvalue()


def test_updates_of_text_keys(spark):
    """Rows are found by a key of any type, and literals follow the columns."""
    t = Table("people", primary_key=("code",), foreign_keys=[ForeignKey(("boss",), "people", ("code",))])
    t.add(Column("code", DataType.parse("varchar"), False)).add(Column("boss", DataType.parse("varchar"), True))
    g = Generator(build_plan(Schema().add(t), 1, 20, BASE, overrides={("people", "code"): {"values": [f"{i:03}" for i in range(20)]}}))
    rows = [r["statement"] for r in sinks.update_statements(spark, g).collect()]
    assert len(rows) == 20
    assert all(re.fullmatch(r"""UPDATE "people" SET "boss" = '\d{3}' WHERE "code" = '\d{3}';""", r) for r in rows)


class FakeSession:
    def __init__(self, fail_at=None):
        self.seen, self.done, self.fail_at = [], None, fail_at

    def run(self, statement):
        self.seen.append(statement)
        if len(self.seen) == self.fail_at:
            raise RuntimeError("no")

    def close(self, done):
        self.done = done


def test_direct_insert_statements(spark):
    g = Generator(build_plan(examples.circular(), 1, 150, BASE))
    for dialect, quote in (("postgresql", '"'), ("mysql", "`")):
        fake = FakeSession()
        assert sinks.insert_jdbc(spark, g, "", dialect, session=fake) == len(fake.seen)
        heads = [s.split()[0] for s in fake.seen]
        assert fake.done
        assert heads.count("INSERT") == 4
        assert all(s.startswith("INSERT") and s.endswith(";") for s in fake.seen if "VALUES" in s)
        assert heads.index("UPDATE") > max(i for i, h in enumerate(heads) if h == "INSERT")
        assert f"{quote}id{quote}" in next(s for s in fake.seen if s.startswith("INSERT"))
        if dialect == "postgresql":
            assert sum("setval(pg_get_serial_sequence(" in s for s in fake.seen) == 2
        else:
            assert (fake.seen[0], fake.seen[-1]) == ("SET FOREIGN_KEY_CHECKS = 0;", "SET FOREIGN_KEY_CHECKS = 1;")
    broken = FakeSession(fail_at=3)
    with pytest.raises(RuntimeError):
        sinks.insert_jdbc(spark, g, "", session=broken)
    assert broken.done is False


def test_jdbc_into_a_database(spark):
    """Derby comes with Spark: both ways into a schema with a circle of keys that the database checks."""
    url = "jdbc:derby:memory:furrow;create=true"
    made = [
        'create table "departments" ("id" int primary key, "name" varchar(200) not null, "head_id" int, "budget" decimal(12,2))',
        'create table "employees" ("id" int primary key, "name" varchar(200) not null, "email" varchar(200) unique, "department_id" int references "departments"("id"), "manager_id" int references "employees"("id"))',
        'alter table "departments" add constraint "head" foreign key ("head_id") references "employees"("id")',
    ]
    schema = examples.circular()
    schema.tables["employees"].columns["email"].nullable = False  # Derby takes no null text from Spark's writer
    g = Generator(build_plan(schema, 1, 120, BASE))

    class Derby(sinks.JdbcSession):
        def run(self, statement):
            if not statement.startswith("SELECT setval"):
                super().run(statement)

    def count():
        return spark.read.jdbc(url, "(select count(*) as n, count(\"manager_id\") as m, count(\"department_id\") as d from \"employees\") t").collect()[0]

    for way in ("insert", "write"):
        session = Derby(spark, url)
        for s in made:
            session.run(s)
        session.close(True)
        if way == "insert":
            sinks.insert_jdbc(spark, g, url, session=Derby(spark, url))
        else:
            sinks.write_jdbc(spark, g, url, session=Derby(spark, url))
        assert tuple(count()) == (120, 120, 120)
        session = Derby(spark, url)
        for s in ('alter table "departments" drop constraint "head"', 'drop table "employees"', 'drop table "departments"'):
            session.run(s)
        session.close(True)


def test_profiles_from_the_database(spark, tmp_path):
    path = str(tmp_path / "p.db")
    rng = random.Random(2)
    with sqlite3.connect(path) as db:
        db.executescript("create table parents (id integer primary key, kind text, email text, size real); create table kids (id integer primary key, parent_id integer references parents(id), n integer);")
        db.executemany("insert into parents (kind, email, size) values (?, ?, ?)", [(rng.choice("abc") if i % 7 else None, f"e{i}", 1e6 + rng.random()) for i in range(50)])
        db.executemany("insert into kids (parent_id, n) values (?, ?)", [(i % 50 + 1, rng.randint(0, 9)) for i in range(125)])
    url = f"sqlite:{path}"
    schema = SqliteIntrospector(url).introspect()
    pushed = profile.sample_database(runner(url), schema, list(schema.tables))
    read = profile.sample({t: read_table(spark, url, t) for t in schema.tables}, [("kids", "parent_id", "parents")], skip={t: ["id"] for t in schema.tables})
    assert [p["table"] for p in pushed] == [p["table"] for p in read]
    for a, b in zip(pushed, read, strict=True):
        assert a["rows"] == b["rows"]
        assert set(a["columns"]) == set(b["columns"])
        for c, x in a["columns"].items():
            for k, v in x.items():
                assert v == (pytest.approx(b["columns"][c][k]) if k in ("min", "max", "mean", "stddev", "ratio") else b["columns"][c][k])


DDL = """
create table departments (id integer primary key, name text not null, head_id integer references employees(id), budget numeric(12,2) check (budget >= 0));
create table employees (id integer primary key, name varchar(40) not null, email varchar(60) unique, department_id integer references departments(id), manager_id integer references employees(id));
"""


def test_sqlite_end_to_end(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.executescript(DDL)
    schema = SqliteIntrospector(f"sqlite:{path}").introspect()
    assert schema.tables["employees"].uniques == [("email",)]
    assert schema.tables["employees"].columns["id"].auto_increment
    assert schema.tables["departments"].checks[0].form == ">="
    folder, url = str(tmp_path), f"sqlite:{path}"
    assert cli.main(["-C", folder, "generate", "--db", url, "--rows", "30", "--seed", "4", "--output", "direct"], spark) == 0
    with sqlite3.connect(path) as db:
        assert db.execute("select count(*), count(manager_id) from employees").fetchone() == (30, 30)
        assert db.execute("pragma foreign_key_check").fetchall() == []
    assert read_table(spark, url, "employees").count() == 30
    out = io.StringIO()
    assert cli.main(["-C", folder, "check", "--db", url], spark, out) == 0
    assert "no drift" in out.getvalue()
    a, b = io.StringIO(), io.StringIO()
    for o in (a, b):
        assert cli.main(["-C", folder, "generate", "--db", url, "--from-lock"], spark, o) == 0
    assert a.getvalue() == b.getvalue()
    assert "INSERT INTO" in a.getvalue()
    with sqlite3.connect(path) as db:
        db.execute("alter table employees add column phone text")
    assert cli.main(["-C", folder, "check", "--db", url], spark, io.StringIO()) == 1
    assert cli.main(["-C", folder, "generate", "--db", url, "--from-lock"], spark, io.StringIO()) == 2
    for command in (["introspect"], ["introspect", "--format", "json"], ["graph"], ["graph", "--format", "dot"], ["preview", "--rows", "2"]):
        out = io.StringIO()
        assert cli.main(["-C", folder, command[0], "--db", url, *command[1:]], spark, out) == 0
        assert "employees" in out.getvalue()
    profiles = str(tmp_path / "p.json")
    assert cli.main(["-C", folder, "sample", "--db", url, "--output", profiles], spark, io.StringIO()) == 0
    assert {p["table"] for p in profile.load_profiles(profiles)} == {"departments", "employees"}
    assert cli.main(["-C", folder, "check"], spark, io.StringIO()) == 2
    # asking a model without a plug-in is an error, with one its answer counts and is kept
    assert cli.main(["-C", folder, "generate", "--db", url, "--ai", "--model", "m"], spark, io.StringIO()) == 2
    monkeypatch.setenv("FURROW_ASK", "json:no_such_function")
    assert cli.main(["-C", folder, "generate", "--db", url, "--ai"], spark, io.StringIO()) == 2
    (tmp_path / "furrow_plug.py").write_text("asked = []\ndef ask(prompt, model, timeout):\n    asked.append(model)\n    return '[]'\n")
    monkeypatch.syspath_prepend(folder)
    monkeypatch.setenv("FURROW_ASK", "furrow_plug:ask")
    for _ in range(2):
        assert cli.main(["-C", folder, "generate", "--db", url, "--rows", "3", "--ai", "--model", "m"], spark, io.StringIO()) == 0
    import furrow_plug

    assert furrow_plug.asked == ["m"]


def test_stream(spark, tmp_path):
    g = Generator(build_plan(examples.shop(), 42, 100, BASE, ROWS))
    q = stream_rows(spark, g, "orders", 50).writeStream.format("memory").queryName("made").start()
    try:
        q.processAllAvailable()
        assert q.lastProgress is None or q.exception() is None
    finally:
        q.stop()
