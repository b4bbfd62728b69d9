"""Schemas, classification, graphs, plans, settings, locks, drift and the AI plug-in: plain Python."""

import datetime as dt
import json

import pytest

from furrow import ai, config, examples, lock
from furrow.errors import AIResponseError, ConfigError, LockFileError, UnsupportedDatabase
from furrow.operators import drift
from furrow.plans.classify import MEANINGS, classify_column, classify_schema, detect_groups, normal_name
from furrow.plans.graph import DependencyGraph, dot, filter_tables, mermaid
from furrow.plans.plan import build_plan, row_count
from furrow.schema import DataType, parse_check, parse_enum_values
from furrow.sources import dialect_of
from furrow.sources.jdbc import assemble


@pytest.mark.parametrize(
    ("raw", "kind"),
    [("int4", "integer"), ("TINYINT", "smallint"), ("character varying(20)", "varchar"), ("numeric(10,2)", "numeric"), ("_text", "array"), ("integer[]", "array"), ("bit", "boolean"), ("timestamptz", "timestamptz"), ("datetime", "timestamp"), ("int unsigned", "unknown"), ("bpchar", "unknown"), ("jsonb", "jsonb")],
)
def test_types(raw, kind):
    assert DataType.parse(raw).kind == kind


@pytest.mark.parametrize(
    ("text", "form", "column", "value"),
    [("(price >= 0)", ">=", "price", 0.0), ("quantity > 0", ">", "quantity", 0.0), ("CHECK (length(name) > 3)", "min_length", "name", 4), ("start_date < end_date", "less_than_column", "start_date", "end_date"), ("((price >= (0)::numeric))", ">=", "price", 0.0), ("a between 1 and 5", "between", "a", "1.0,5.0"), ("kind in ('x','y')", "in", "kind", "x,y"), ("f(x) = 3", "", "", None)],
)
def test_checks(text, form, column, value):
    c = parse_check(text)
    assert (c.form, c.column, c.value) == (form, column, value)
    assert c.text == text


def test_enum_values():
    assert parse_enum_values("enum('active','in''active','suspended')") == ["active", "in'active", "suspended"]
    assert parse_enum_values("int") == []


def test_classification_of_examples():
    found = classify_schema(examples.blog()) | classify_schema(examples.circular())
    assert found["posts", "id"] == "Uuid"
    assert found["posts", "published_at"] == "BooleanFlag"
    assert found["posts", "view_count"] == "Unknown"
    assert found["posts", "metadata"] == "JsonData"
    assert found["tags", "name"] == "Title"
    assert found["employees", "name"] == "FullName"
    assert found["departments", "name"] == "Unknown"
    assert found["comments", "id"] == "AutoIncrement"


@pytest.mark.parametrize(
    ("name", "kind", "meaning"),
    [("state", "varchar", "State"), ("position", "integer", "JobTitle"), ("rank", "integer", "Rating"), ("weight", "double", "Weight"), ("amount", "numeric", "Price"), ("displayName", "varchar", "FullName"), ("user-agent", "varchar", "UserAgent"), ("age", "varchar", "Unknown"), ("whatever_id", "integer", "ExternalId")],
)
def test_shadowed_rules(name, kind, meaning):
    assert classify_column(name, DataType.parse(kind), "things") == meaning


def test_names_and_meanings():
    assert normal_name("firstName") == "first_name"
    assert normal_name("API-Key") == "api_key"
    assert len(MEANINGS) == 87
    assert detect_groups({"city": "City", "zip": "ZipCode", "lat": "Latitude"}) == {"Address": ["city", "zip"]}


def test_cycles_and_order():
    g = DependencyGraph.of(examples.circular())
    deferred = g.break_cycles()
    assert {(e.child, e.key.columns[0]) for e in deferred} >= {("employees", "manager_id")}
    assert len(deferred) == 2
    assert sorted(g.order()) == ["departments", "employees"]
    g = DependencyGraph.of(examples.circular())
    g.break_cycles(["departments.head_id"])
    assert g.order() == ["departments", "employees"]
    g = DependencyGraph.of(examples.shop())
    assert [(e.child, e.parent) for e in g.break_cycles()] == [("categories", "categories")]
    order = g.order()
    assert order.index("users") < order.index("orders") < order.index("order_items")


def test_filter_and_pictures():
    g = DependencyGraph.of(examples.shop())
    g.break_cycles()
    order = g.order()
    assert set(filter_tables(order, g, ["orders"])) == {"users", "orders"}
    assert filter_tables(order, g, ["orders"], ["users"]) == ["orders"]
    assert "users" not in filter_tables(order, g, exclude=["users"])
    assert "categories -.->|parent_id (deferred)| categories" in mermaid(g)
    assert 'style=dashed' in dot(g)


def test_row_counts():
    s = examples.shop()
    ratios = {("orders", "user_id"): 2.5, ("order_items", "order_id"): 4.0}
    assert row_count("orders", s, 100, {}, ratios) == 250
    assert row_count("orders", s, 100, {"users": 10}, ratios) == 25
    assert row_count("orders", s, 100, {"orders": 7}, ratios) == 7
    assert row_count("order_items", s, 100, {}, ratios) == 400
    assert row_count("order_items", s, 100, {}, ratios, transitive=True) == 1000


def test_strategies():
    p = build_plan(examples.shop(), overrides={("users", "is_active"): {"values": ["true"], "weights": [1]}}, exclude=["categories"])
    kinds = {(t.name, c): x.strategy.kind for t in p.tables.values() for c, x in t.columns.items()}
    assert kinds["users", "id"] == "auto"
    assert kinds["users", "is_active"] == "values"
    assert kinds["orders", "user_id"] == "foreign_key"
    assert kinds["orders", "status"] == "enum"
    assert kinds["products", "category_id"] == "provider"
    assert kinds["stores", "city"] == "correlated"
    assert p.tables["users"].columns["deleted_at"].null_share == 0.8
    assert p.tables["users"].columns["email"].null_share == 0


def test_config(tmp_path):
    text = '[database]\nurl = "sqlite:x.db"\n[generate]\nrows = 7\nseed = 1\n[tables.users]\nrows = 3\n[columns."users.role"]\nvalues = ["a", "b"]\nweights = [1, 2]\n[graph]\nbreak_cycle_at = ["a.b"]\n'
    c = config.parse_config(text)
    assert (c.url, c.rows, c.tables, c.break_edges()) == ("sqlite:x.db", 7, {"users": 3}, [("a", "b")])
    assert c.warnings(examples.shop()) == ["no column users.role"]
    for bad in ('[columns."a.b"]\nweights = [1]', '[columns."a.b"]\nvalues = ["x"]\nweights = [1, 2]', "x = ["):
        with pytest.raises(ConfigError):
            config.parse_config(bad)
    assert config.parse_table_rows("a=1,b=x,c,d=4") == {"a": 1, "d": 4}
    assert config.read_config(str(tmp_path)).rows is None
    (tmp_path / ".env").write_text('export DATABASE_URL="postgres://h/d"\n')
    assert config.resolve_url(None, config.Config(), str(tmp_path)) == "postgres://h/d"
    assert config.resolve_url("mysql://x", c) == "mysql://x"


def test_dialects():
    assert [dialect_of(u) for u in ("postgres://h", "mariadb://h", "file:x.db")] == ["postgresql", "mysql", "sqlite"]
    with pytest.raises(UnsupportedDatabase):
        dialect_of("oracle://h")


def test_lock_round_trip(tmp_path):
    kept = lock.Lock(examples.blog(), 9, dt.datetime(2025, 6, 1, 12), {"rows": 5}, {"a.b": "Bio"})
    kept.write(str(tmp_path))
    back = lock.read_lock(str(tmp_path))
    assert back == kept
    assert drift.schema_hash(back.schema) == back.hash
    (tmp_path / lock.FILE).write_text("{")
    with pytest.raises(LockFileError):
        lock.read_lock(str(tmp_path))
    with pytest.raises(LockFileError):
        lock.read_lock(str(tmp_path / "none"))


def test_drift():
    old, new = examples.shop(), examples.shop()
    assert not drift.detect(old, new).any
    new.tables["users"].foreign_keys.reverse()
    new.tables["order_items"].foreign_keys.reverse()
    assert not drift.detect(old, new).any
    del new.tables["stores"]
    new.tables["users"].columns["email"].nullable = True
    new.tables["users"].columns["first_name"].max_length = 10
    del new.tables["orders"].columns["notes"]
    new.tables["products"].checks.clear()
    found = drift.detect(old, new)
    assert found.removed_tables == ["stores"]
    assert ("users", "email", "nullable", "False", "True") in found.changed
    assert ("users", "first_name", "length", "None", "10") in found.changed
    assert found.removed_columns == [("orders", "notes")]
    assert found.constraints == [("products", "check", "removed", "(price >= 0)")]
    assert "- table stores" in found.summary()
    assert found.as_dict()["drift"]


def test_ai():
    answer = 'Here:\n```json\n[{"table": "departments", "column": "name", "semantic_type": "Department", "confidence": 0.9}, {"table": "t", "column": "c", "semantic_type": "Invented"}]\n```'
    rows = ai.parse_answer(answer)
    assert [r["semantic_type"] for r in rows] == ["Department"]
    with pytest.raises(AIResponseError):
        ai.parse_answer("no idea")
    before = classify_schema(examples.circular())
    after = ai.classify(examples.circular(), before, lambda prompt: answer)
    assert after["departments", "name"] == "Department"
    assert ai.changed(before, after) == {"departments.name": "Department"}
    assert ai.restore(before, {"departments.name": "Department", "employees.name": "Bio"}) == after
    assert ai.provider_from_env({"OPENAI_API_KEY": "x"}) == "openai"
    assert ai.provider_from_env({"OPENAI_API_KEY": "x", "ANTHROPIC_API_KEY": "y"}) == "anthropic"
    assert ai.provider_from_env({}) is None


def test_ai_cache(tmp_path):
    asked = []

    def ask(prompt):
        asked.append(prompt)
        return json.dumps([{"table": "departments", "column": "budget", "semantic_type": "Amount", "confidence": 1}])

    s = examples.circular()
    for _ in range(2):
        assert ai.classify(s, classify_schema(s), ask, str(tmp_path), "k")["departments", "budget"] == "Amount"
    assert len(asked) == 1
    assert "departments" in asked[0]


def test_catalog_rows():
    column = {"data_type": "integer", "udt_name": "int4", "is_nullable": "NO", "column_default": None, "max_length": None, "numeric_precision": 32, "numeric_scale": 0, "extra": "NO", "column_type": "int4"}
    rows = {
        "tables": [{"table_name": "a"}, {"table_name": "b"}],
        "columns": [{**column, "table_name": "a", "column_name": "x", "ordinal_position": 1, "column_default": "nextval('s')"}, {**column, "table_name": "a", "column_name": "y", "ordinal_position": 2}, {**column, "table_name": "b", "column_name": "p", "ordinal_position": 1}, {**column, "table_name": "b", "column_name": "q", "ordinal_position": 2}, {**column, "table_name": "b", "column_name": "mood", "ordinal_position": 3, "data_type": "USER-DEFINED", "udt_name": "mood"}],
        "keys": [{"table_name": "a", "name": "pk", "kind": "p", "column_name": c, "at": i, "parent": None, "parent_column": None, "on_delete": " ", "on_update": " ", "deferrable": False} for i, c in enumerate("xy")]
        + [{"table_name": "b", "name": "fk", "kind": "f", "column_name": c, "at": i, "parent": "a", "parent_column": d, "on_delete": "c", "on_update": "a", "deferrable": True} for i, (c, d) in enumerate(("px", "qy"))],
        "checks": [{"table_name": "b", "text": "CHECK ((p > 3))"}],
        "enums": [{"name": "mood", "value": v} for v in ("ok", "bad")],
    }
    s = assemble(rows, "postgresql", "public")
    assert s.tables["a"].primary_key == ("x", "y")
    assert s.tables["a"].columns["x"].auto_increment
    key = s.tables["b"].foreign_keys[0]
    assert (key.columns, key.parent_columns, key.on_delete, key.deferrable) == (("p", "q"), ("x", "y"), "CASCADE", True)
    assert s.tables["b"].columns["mood"].enum_values == ["ok", "bad"]
    assert s.tables["b"].checks[0].value == 3


def test_names_of_rules_are_those_of_their_patterns():
    """Whole-name rules as tables agree with the patterns, one after the other, on their names and on near misses."""
    import re

    from furrow.plans import classify

    def by_patterns(name, kind, table):
        plain = classify.normal_name(name)
        for pattern, tables, meaning in classify.TABLE_RULES:
            if re.search(pattern, plain) and re.search(tables, table):
                return meaning
        for pattern, kinds, meaning in classify.RULES:
            if (kinds is None or kind in kinds) and re.search(pattern, plain):
                return meaning
        return classify.FALLBACK.get(kind, "Unknown")

    names = list(classify._WHOLE)
    assert len(names) > 300
    for n in [*names, *(f"{n}x" for n in names), *(f"is_{n}" for n in names), *(f"{n}_id" for n in names)]:
        for kind in ("text", "integer", "double", "boolean"):
            for table in ("t", "users", "Vendors"):
                assert classify._by_rules(n, kind, table) == by_patterns(n, kind, table), (n, kind, table)
    assert classify.spelled("^a(b|c)?[12]$") == ["ab1", "ab2", "ac1", "ac2", "a1", "a2"]
    assert classify.spelled("^open") is None
