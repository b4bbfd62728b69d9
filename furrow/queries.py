"""Registered queries of the library's operators, each with SQL that must give the same rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ai, examples
from .functions.draws import permutation
from .operators import correlated, drift, profile, providers, sinks, validate
from .operators.generate import Generator
from .plans.classify import FALLBACK, GROUPS, RULES, TABLE_RULES, classify_frame, classify_schema, meaning_column
from .plans.plan import GenerationPlan, build_plan
from .schema import Schema
from .sources.parquet import STAR_FOREIGN, STAR_KEYS, read_table

Query = Callable[[SparkSession, str], DataFrame]
#: Draws by MD5, which the SQL can repeat.
_exact = partial(Generator, exact=True)
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

SEED = 42
BASE = dt.datetime(2025, 1, 1)
ROWS = {"users": 500, "categories": 40, "products": 200, "orders": 2000, "order_items": 5000, "stores": 300}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "pages", "conversations", "benchmark", "embeddings")


def _add(name: str, query: Query, sql: str) -> None:
    _QUERIES[name], _SQL[name] = query, sql


# --- profiles ---------------------------------------------------------------------------------------------------------


def _row_counts(spark: SparkSession, d: str) -> DataFrame:
    return profile.union_all(profile.row_count(read_table(spark, d, t), t) for t in TABLES).filter("n_rows >= 10")


_add("profile_row_counts", _row_counts, "select * from (" + " union all ".join(f"select '{t}' as table_name, count(*) as n_rows from {t}" for t in TABLES) + ") where n_rows >= 10")


def _categorical_sql(table: str, column: str, limit: int = 50) -> str:
    return f"""select '{table}' as table_name, '{column}' as column_name, value, n, n / total as freq from (
      select {column} as value, count(*) as n, (select count(*) from {table})::double as total from {table} group by {column})
      where value is not null order by n desc, value limit {limit}"""


for _t, _c in (("orders", "o_orderstatus"), ("orders", "o_orderpriority"), ("customer", "c_mktsegment"), ("events", "event_type"), ("documents", "lang"), ("documents", "source"), ("conversations", "role"), ("part", "p_brand"), ("part", "p_type"), ("lineitem", "l_returnflag")):
    _add(f"profile_categorical_{_c}", lambda s, d, t=_t, c=_c: profile.categorical(read_table(s, d, t), t, [c]), _categorical_sql(_t, _c))

_NUMERIC = {"lineitem": ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"], "orders": ["o_totalprice"], "part": ["p_size", "p_retailprice"], "customer": ["c_acctbal"], "supplier": ["s_acctbal"], "events": ["value"], "documents": ["n_chars"], "labels": ["quality", "toxic"]}


def _numeric_sql(table: str, columns: list[str]) -> str:
    return " union all ".join(f"select '{table}' as table_name, '{c}' as column_name, min({c})::double as min, max({c})::double as max, round(avg({c}), 6) as mean, round(stddev_pop({c}), 6) as stddev from {table}" for c in columns)


for _t, _cs in _NUMERIC.items():
    _add(f"profile_numeric_{_t}", lambda s, d, t=_t, cs=_cs: profile.numeric(read_table(s, d, t), t, cs).withColumns({"mean": F.round("mean", 6), "stddev": F.round("stddev", 6)}), _numeric_sql(_t, _cs))


def _long(spark: SparkSession, d: str) -> DataFrame:
    out = profile.union_all([profile.profile_long(read_table(spark, d, "orders"), "orders", ["o_orderkey", "o_custkey"]), profile.profile_long(read_table(spark, d, "region"), "region", ["r_regionkey"])])
    return out.withColumn("value", F.round("value", 6))


_add(
    "profile_all_long",
    _long,
    "select table_name, column_name, 'categorical' as kind, value as metric, round(freq, 6) as value from (" + _categorical_sql("orders", "o_orderstatus") + ") union all select table_name, column_name, 'categorical', value, round(freq, 6) from (" + _categorical_sql("orders", "o_orderpriority") + ") union all select 'orders', 'o_totalprice', 'numeric', metric, round(value, 6) from (select unnest(['min', 'max', 'mean', 'stddev']) as metric, unnest([min(o_totalprice), max(o_totalprice), avg(o_totalprice), stddev_pop(o_totalprice)]) as value from orders)",
)

_PAIRS = [(c, col, p) for c, col, p, _ in STAR_FOREIGN]


def _ratios(spark: SparkSession, d: str) -> DataFrame:
    counts = profile.union_all(profile.row_count(read_table(spark, d, t), t) for t in TABLES)
    keys = spark.createDataFrame(_PAIRS, "table_name string, column_name string, parent string")
    return profile.ratios(counts, keys).withColumn("ratio", F.round("ratio", 9))


_add("fk_ratios", _ratios, " union all ".join(f"select '{c}' as table_name, '{col}' as column_name, '{p}' as parent, round((select count(*) from {c}) / (select count(*) from {p})::double, 9) as ratio" for c, col, p in _PAIRS))
_add("ratio_empty_parent", lambda s, d: profile.ratio(read_table(s, d, "orders"), read_table(s, d, "customer").filter("c_custkey < 0")), "select 0.0::double as ratio")
_add("ratio_orders_customer", lambda s, d: profile.ratio(read_table(s, d, "orders"), read_table(s, d, "customer")).withColumn("ratio", F.round("ratio", 9)), "select round((select count(*) from orders) / (select count(*) from customer)::double, 9) as ratio")

_PII_NAMES = ["email", "user_email", "capacity", "title", "PhoneNumber", "o_comment", "Street_Line", "tokens", "price", "IBAN", "created_at", "useragent", "birthDate", "quantity", "zipCode", "name"]
_PII_RE = "|".join(profile.PII_PARTS)
_NAMES_SQL = "(values " + ", ".join(f"('{n}')" for n in _PII_NAMES) + ") v(column_name)"
_add("pii_columns", lambda s, d: s.createDataFrame([(n,) for n in _PII_NAMES], "column_name string").withColumn("is_pii", profile.pii_column(F.col("column_name"))), f"select column_name, regexp_matches(lower(column_name), '{_PII_RE}') as is_pii from {_NAMES_SQL}")


def _masked(spark: SparkSession, d: str) -> DataFrame:
    df = read_table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_mktsegment").alias("street"), F.col("c_acctbal").alias("token_count"))
    return profile.mask(profile.profile_long(df, "customer")).withColumn("value", F.round("value", 6))


_add(
    "masked_profiles",
    _masked,
    "select 'customer' as table_name, 'segment' as column_name, 'categorical' as kind, value as metric, round(freq, 6) as value from (" + _categorical_sql("customer", "c_mktsegment") + ") union all select 'customer', 'token_count', 'numeric', metric, round(value, 6) from (select unnest(['min', 'max', 'mean', 'stddev']) as metric, unnest([min(c_acctbal), max(c_acctbal), avg(c_acctbal), stddev_pop(c_acctbal)]) as value from customer)",
)

def _masked_count(spark: SparkSession, d: str) -> DataFrame:
    df = read_table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_mktsegment").alias("street"), F.col("c_mktsegment").alias("city"), F.col("c_acctbal").alias("token_count"))
    return profile.masked_count(profile.profile_long(df, "customer"))


_add("masked_count", _masked_count, "select case when count(*) >= 10 then 2 else 0 end::bigint as n_masked from customer")

# --- classification ---------------------------------------------------------------------------------------------------

_STAR_COLUMNS = [("customer", "name", "text"), ("customer", "acctbal", "double"), ("customer", "mktsegment", "text"), ("supplier", "name", "text"), ("part", "name", "text"), ("part", "brand", "text"), ("part", "type", "text"), ("part", "size", "integer"), ("part", "retailprice", "double"), ("orders", "orderstatus", "text"), ("orders", "totalprice", "double"), ("orders", "orderdate", "timestamp"), ("orders", "orderpriority", "text"), ("lineitem", "quantity", "double"), ("lineitem", "discount", "double"), ("lineitem", "tax", "double"), ("events", "ts", "timestamp"), ("events", "user_id", "bigint"), ("events", "value", "double"), ("events", "props", "json"), ("documents", "text", "text"), ("documents", "lang", "text"), ("pages", "url", "text"), ("labels", "quality", "integer")]
_MORE_COLUMNS = [("users", c, t) for c, t in (("firstName", "varchar"), ("lastName", "varchar"), ("e-mail", "varchar"), ("state", "varchar"), ("position", "integer"), ("rank", "integer"), ("rank", "varchar"), ("weight", "double"), ("isActive", "boolean"), ("published_at", "timestamp"), ("view_count", "integer"), ("zip", "varchar"), ("amount", "numeric"), ("display_name", "varchar"), ("age", "integer"), ("age", "varchar"), ("dob", "date"), ("api_key", "varchar"), ("parent_id", "integer"), ("notes", "text"), ("tz", "varchar"), ("name", "varchar"), ("title", "varchar"), ("payload", "jsonb"), ("opened", "time"), ("score", "double"), ("startDate", "date"), ("expires_at", "timestamp"), ("hexColor", "varchar"), ("mystery", "varchar"))]
_COLUMNS = list(dict.fromkeys([*_STAR_COLUMNS, *_MORE_COLUMNS, ("products", "name", "varchar"), ("vendors", "name", "varchar"), ("tags", "name", "varchar"), ("departments", "name", "varchar")]))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _meaning_sql() -> str:
    whens = [f"when regexp_matches(plain, {_quoted(p)}) and regexp_matches(table_name, {_quoted(t)}) then '{m}'" for p, t, m in TABLE_RULES]
    for p, kinds, m in RULES:
        also = f" and kind in ({', '.join(map(_quoted, kinds))})" if kinds else ""
        whens.append(f"when regexp_matches(plain, {_quoted(p)}){also} then '{m}'")
    whens += [f"when kind = '{k}' then '{m}'" for k, m in FALLBACK.items()]
    rows = ", ".join(f"({_quoted(t)}, {_quoted(c)}, {_quoted(k)})" for t, c, k in _COLUMNS)
    plain = r"replace(lower(regexp_replace(column_name, '(\p{Ll})(\p{Lu})', '\1_\2', 'g')), '-', '_')"
    return f"select table_name, column_name, kind, case {' '.join(whens)} else 'Unknown' end as meaning from (select *, {plain} as plain from (values {rows}) v(table_name, column_name, kind))"


def _column_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_COLUMNS, "table_name string, column_name string, kind string")


_add("classify_columns", lambda s, d: classify_frame(_column_frame(s)), _meaning_sql())


#: One name for every rule, with the meaning that it must have, written out.
_ANSWERS = (
    ("users", "name", "text", "FullName"), ("vendors", "name", "text", "CompanyName"), ("products", "name", "text", "Title"), ("staff", "title", "text", "JobTitle"),
    ("t", "given_name", "text", "FirstName"), ("t", "surname", "text", "LastName"), ("t", "real_name", "text", "FullName"), ("t", "nickname", "text", "Username"), ("t", "mail_addr", "text", "Email"),
    ("t", "cell_phone", "text", "Phone"), ("t", "dial_code", "text", "PhoneCountryCode"), ("t", "address_line_2", "text", "StreetAddress"), ("t", "town", "text", "City"), ("t", "province", "text", "State"), ("t", "postCode", "text", "ZipCode"),
    ("t", "country", "text", "Country"), ("t", "iso_country", "text", "CountryCode"), ("t", "lat", "double", "Latitude"), ("t", "lng", "double", "Longitude"), ("t", "employer", "text", "CompanyName"), ("t", "occupation", "text", "JobTitle"),
    ("t", "division", "text", "Department"), ("t", "sector", "text", "Industry"), ("t", "homepage", "text", "Url"), ("t", "hostname", "text", "DomainName"), ("t", "remote_addr", "text", "IpAddress"), ("t", "hw_addr", "text", "MacAddress"),
    ("t", "ua", "text", "UserAgent"), ("t", "slug", "text", "Slug"), ("t", "headline", "text", "Title"), ("t", "excerpt", "text", "Description"), ("t", "about_me", "text", "Bio"), ("t", "remarks", "text", "Paragraph"),
    ("t", "coverImage", "text", "ImageUrl"), ("t", "profile_pic", "text", "AvatarUrl"), ("t", "thumb", "text", "ThumbnailUrl"), ("t", "attachment_url", "text", "FileUrl"), ("t", "original_name", "text", "FileName"), ("t", "media_type", "text", "MimeType"),
    ("t", "size_bytes", "bigint", "FileSize"), ("t", "sub_total", "double", "Price"), ("t", "currency", "text", "Currency"), ("t", "currency_iso", "text", "CurrencyCode"), ("t", "pct", "double", "Percentage"), ("t", "dateCreated", "timestamp", "CreatedAt"),
    ("t", "last_modified", "timestamp", "UpdatedAt"), ("t", "removed_at", "timestamp", "DeletedAt"), ("t", "valid_from", "date", "StartDate"), ("t", "valid_until", "date", "EndDate"), ("t", "dob", "date", "BirthDate"), ("t", "passwd", "text", "PasswordHash"),
    ("t", "reset-token", "text", "Token"), ("t", "app_key", "text", "ApiKey"), ("t", "client_secret", "text", "SecretKey"), ("t", "reference", "text", "ExternalId"), ("t", "part_number", "text", "Sku"), ("t", "order_no", "text", "OrderNumber"),
    ("t", "invoice_ref", "text", "InvoiceNumber"), ("t", "tracking_code", "text", "TrackingNumber"), ("t", "status", "text", "Status"), ("t", "account_type", "text", "Role"), ("t", "urgency", "text", "Priority"), ("t", "kind", "text", "Category"),
    ("t", "labels", "text", "Tag"), ("t", "has_children", "boolean", "BooleanFlag"), ("t", "qty", "integer", "Quantity"), ("t", "stars", "integer", "Rating"), ("t", "mass", "double", "Weight"), ("t", "depth", "double", "Height"), ("t", "age", "integer", "Age"),
    ("t", "elapsed", "double", "Duration"), ("t", "ordinal", "integer", "SortOrder"), ("t", "colour", "text", "Color"), ("t", "hex_color", "text", "HexColor"), ("t", "language_code", "text", "Locale"), ("t", "tz", "text", "Timezone"), ("t", "warehouse_id", "integer", "ExternalId"),
    ("t", "age", "text", "Unknown"), ("t", "qty", "text", "Unknown"), ("t", "xyzzy", "text", "Unknown"), ("t", "xyzzy", "boolean", "BooleanFlag"), ("t", "xyzzy", "uuid", "Uuid"), ("t", "xyzzy", "json", "JsonData"), ("t", "xyzzy", "jsonb", "JsonData"), ("t", "xyzzy", "inet", "IpAddress"),
    ("t", "xyzzy", "macaddr", "MacAddress"), ("t", "xyzzy", "date", "DateOnly"), ("t", "xyzzy", "time", "TimeOnly"), ("t", "xyzzy", "timestamp", "Timestamp"), ("t", "xyzzy", "timestamptz", "Timestamp"),
)
_ANSWERS_SQL = "select * from (values " + ", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in _ANSWERS) + ") v(table_name, column_name, kind, meaning)"
_add("classify_every_rule", lambda s, d: classify_frame(s.createDataFrame([r[:3] for r in _ANSWERS], "table_name string, column_name string, kind string")), _ANSWERS_SQL)


def _driver_answers(spark: SparkSession, d: str) -> DataFrame:
    from .plans.classify import classify_column
    from .schema import DataType

    return spark.createDataFrame([(t, c, k, classify_column(c, DataType(k, name=k), t)) for t, c, k, _ in _ANSWERS], "table_name string, column_name string, kind string, meaning string")


_add("classify_on_driver", _driver_answers, _ANSWERS_SQL)


def _personal(spark: SparkSession, d: str) -> DataFrame:
    from .plans.classify import MEANINGS, is_personal

    return spark.createDataFrame([(m,) for m in MEANINGS if is_personal(m)], "meaning string")


_add("personal_meanings", _personal, "select unnest(['FirstName', 'LastName', 'FullName', 'Email', 'Phone', 'StreetAddress', 'BirthDate', 'PasswordHash', 'Token', 'ApiKey', 'SecretKey', 'IpAddress']) as meaning")


def _groups(spark: SparkSession, d: str) -> DataFrame:
    named = _column_frame(spark).withColumn("meaning", meaning_column(F.col("column_name"), F.col("table_name"), F.col("kind")))
    members = spark.createDataFrame([(g, m) for g, ms in GROUPS.items() for m in ms], "group_name string, meaning string")
    return named.join(F.broadcast(members), "meaning").groupBy("table_name", "group_name").agg(F.count(F.lit(1)).alias("n_columns")).filter("n_columns > 1")


_GROUP_ROWS = ", ".join(f"('{g}', '{m}')" for g, ms in GROUPS.items() for m in ms)
_add("correlation_groups", _groups, f"select table_name, group_name, count(*) as n_columns from ({_meaning_sql()}) c join (values {_GROUP_ROWS}) g(group_name, meaning) on c.meaning = g.meaning group by all having count(*) > 1")

# --- graphs -----------------------------------------------------------------------------------------------------------

_EDGES_SQL = "(values " + ", ".join(f"('{c}', '{p}')" for c, p in dict.fromkeys((c, p) for c, _, p, _ in STAR_FOREIGN)) + ") e(child, parent)"
_CIRCLE = [(t.name, k.parent, k.columns[0]) for t in examples.circular().tables.values() for k in t.foreign_keys] + [("notes", "employees", "author_id")]
_CIRCLE_SQL = "(values " + ", ".join(f"('{c}', '{p}', '{k}')" for c, p, k in _CIRCLE) + ") e(child, parent, via)"


def _star(spark: SparkSession, d: str):
    from .plans.graph import DependencyGraph
    from .sources.parquet import ParquetIntrospector

    linked = dict.fromkeys(t for c, _, p, _ in STAR_FOREIGN for t in (p, c))
    return DependencyGraph.of(ParquetIntrospector(spark, d, list(linked)).introspect())


_add("fk_depth", lambda s, d: s.createDataFrame(list(_star(s, d).levels().items()), "table_name string, depth int"), f"with recursive edges as (select * from {_EDGES_SQL}), walk(name, depth) as (select distinct parent, 0 from edges where parent not in (select child from edges) union all select e.child, w.depth + 1 from edges e join walk w on e.parent = w.name) select name as table_name, max(depth) as depth from walk group by name")


def _closure(spark: SparkSession, d: str) -> DataFrame:
    from .plans.graph import filter_tables

    graph = _star(spark, d)
    return spark.createDataFrame([(t,) for t in filter_tables(graph.order(), graph, ["lineitem"], ["part"])], "table_name string")


_add("include_closure", _closure, f"with recursive edges as (select * from {_EDGES_SQL}), up(name) as (select 'lineitem' union select e.parent from edges e join up on e.child = up.name) select name as table_name from up where name <> 'part'")


def _own_keys(spark: SparkSession, d: str) -> DataFrame:
    from .plans.graph import DependencyGraph

    return spark.createDataFrame([(e.child, e.key.columns[0]) for e in DependencyGraph.of(examples.circular()).self_references()], "child string, via string")


_add("self_references", _own_keys, f"select child, via from {_CIRCLE_SQL} where child = parent")


def _breaks(spark: SparkSession, d: str) -> DataFrame:
    """Which keys are deferred, without and with a named place to break."""
    from .plans.graph import DependencyGraph

    rows = []
    for said in ((), ("departments.head_id",)):
        rows += [(",".join(said), e.child, e.key.columns[0]) for e in DependencyGraph.of(examples.circular()).break_cycles(said)]
    return spark.createDataFrame(rows, "named string, child string, via string")


_add("cycle_breaks", _breaks, "select * from (values ('', 'employees', 'department_id'), ('', 'employees', 'manager_id'), ('departments.head_id', 'departments', 'head_id'), ('departments.head_id', 'employees', 'manager_id')) v(named, child, via)")


def _picture(spark: SparkSession, d: str) -> DataFrame:
    from .plans.graph import DependencyGraph, dot, mermaid

    graph = DependencyGraph.of(examples.circular())
    graph.break_cycles(("departments.head_id",))
    return spark.createDataFrame([(k, x.strip()) for k, t in (("mermaid", mermaid(graph)), ("dot", dot(graph))) for x in t.splitlines() if "->" in x], "kind string, line string")


_add("graph_pictures", _picture, """select * from (values ('mermaid', 'employees -->|department_id| departments'), ('mermaid', 'departments -.->|head_id (deferred)| employees'), ('mermaid', 'employees -.->|manager_id (deferred)| employees'),
  ('dot', '"employees" -> "departments" [label="department_id"];'), ('dot', '"departments" -> "employees" [label="head_id", style=dashed];'), ('dot', '"employees" -> "employees" [label="manager_id", style=dashed];')) v(kind, line)""")


def _cycle_members(spark: SparkSession, d: str) -> DataFrame:
    from .plans.graph import DependencyGraph

    graph = DependencyGraph.of(examples.circular())
    return spark.createDataFrame([(t,) for c in graph.components() if len(c) > 1 for t in c], "table_name string")


_add("cycle_members", _cycle_members, f"with recursive edges as (select * from {_CIRCLE_SQL} where child <> parent), reach(a, b) as (select child, parent from edges union select r.a, e.parent from reach r join edges e on r.b = e.child) select distinct a as table_name from reach where a = b")


def _order(spark: SparkSession, d: str) -> DataFrame:
    from .plans.graph import DependencyGraph

    graph = DependencyGraph.of(examples.shop())
    deferred = graph.break_cycles()
    order = graph.order()
    rows = [(e.child, e.parent, order.index(e.parent) < order.index(e.child)) for e in graph.edges] + [(e.child, e.parent, e.child == e.parent) for e in deferred]
    return spark.createDataFrame(rows, "child string, parent string, in_order boolean")


_SHOP_EDGES = [(t.name, k.parent) for t in examples.shop().tables.values() for k in t.foreign_keys]
_add("insertion_order", _order, "select child, parent, true as in_order from (values " + ", ".join(f"('{c}', '{p}')" for c, p in _SHOP_EDGES) + ") e(child, parent)")

# --- validation -------------------------------------------------------------------------------------------------------


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    checks = [validate.orphans(read_table(spark, d, c), [col], read_table(spark, d, p), [pc], f"{c}.{col}") for c, col, p, pc in STAR_FOREIGN]
    some = read_table(spark, d, "customer").filter("c_custkey % 10 <> 0")
    return profile.union_all([*checks, validate.orphans(read_table(spark, d, "orders"), ["o_custkey"], some, ["c_custkey"], "orders to some customers")])


_ORPHAN = "select '{n}' as check_name, (select count(*) from {c}) as checked_rows, (select count(*) from {c} where {col} is not null and not exists (select 1 from {p} where {p}.{pc} = {c}.{col}{w})) as violations"
_add("fk_orphans", _orphans, " union all ".join([*(_ORPHAN.format(n=f"{c}.{col}", c=c, col=col, p=p, pc=pc, w="") for c, col, p, pc in STAR_FOREIGN), _ORPHAN.format(n="orders to some customers", c="orders", col="o_custkey", p="customer", pc="c_custkey", w=" and customer.c_custkey % 10 <> 0")]))

_KEYS = [*((t, [k]) for t, k in STAR_KEYS.items()), ("lineitem", ["l_orderkey", "l_linenumber"])]
_add("unique_violations", lambda s, d: profile.union_all(validate.duplicates(read_table(s, d, t), k, f"{t}({', '.join(k)})") for t, k in _KEYS), " union all ".join(f"select '{t}({', '.join(k)})' as check_name, (select count(*) from {t}) as checked_rows, (select coalesce(sum(n - 1), 0)::bigint from (select count(*) as n from {t} group by {', '.join(k)} having count(*) > 1)) as violations" for t, k in _KEYS))
_CHECKS = [("lineitem", "l_quantity > 0"), ("lineitem", "l_discount <= 0.05"), ("part", "p_retailprice >= 0"), ("customer", "c_acctbal >= 0"), ("orders", "o_totalprice < 100000")]
_add("check_violations", lambda s, d: profile.union_all(validate.breaks(read_table(s, d, t), F.expr(c), f"{t}: {c}") for t, c in _CHECKS), " union all ".join(f"select '{t}: {c}' as check_name, count(*) as checked_rows, count(*) filter (where not ({c})) as violations from {t}" for t, c in _CHECKS))
_DOMAINS = [("orders", "o_orderstatus", ["F", "O", "P"]), ("orders", "o_orderstatus", ["F", "O"]), ("documents", "lang", ["en", "de"])]
_add("enum_violations", lambda s, d: profile.union_all(validate.outside(read_table(s, d, t), c, v, f"{t}.{c} in {'/'.join(v)}") for t, c, v in _DOMAINS), " union all ".join(f"select '{t}.{c} in {'/'.join(v)}' as check_name, count(*) as checked_rows, count(*) filter (where {c} not in ({', '.join(map(_quoted, v))})) as violations from {t}" for t, c, v in _DOMAINS))

# --- drift ------------------------------------------------------------------------------------------------------------

_OLD = [("users", "id", "integer", False), ("users", "email", "varchar", False), ("users", "age", "integer", True), ("users", "gone", "text", True), ("orders", "id", "integer", False), ("old", "id", "integer", False)]
_NEW = [("users", "id", "bigint", False), ("users", "email", "varchar", True), ("users", "age", "integer", True), ("users", "phone", "text", True), ("orders", "id", "integer", False), ("fresh", "id", "integer", False)]
_OLD_C = [("users", "unique", "email"), ("orders", "fk", "user_id->users(id)"), ("orders", "check", "(total >= 0)")]
_NEW_C = [("users", "unique", "email"), ("orders", "fk", "user_id->users(id)"), ("orders", "check", "(total > 0)"), ("users", "unique", "phone")]
_rows = lambda rows, names: "(values " + ", ".join("(" + ", ".join(str(x).lower() if isinstance(x, bool) else _quoted(x) for x in r) + ")" for r in rows) + f") v({names})"
_DRIFT = "table_name string, column_name string, type string, nullable boolean"
_add(
    "drift_columns",
    lambda s, d: drift.column_drift(s.createDataFrame(_OLD, _DRIFT), s.createDataFrame(_NEW, _DRIFT)),
    f"select * from (select coalesce(a.table_name, b.table_name) as table_name, coalesce(a.column_name, b.column_name) as column_name, case when a.table_name is null then 'column_added' when b.table_name is null then 'column_removed' when a.type <> b.type then 'type_changed' when a.nullable <> b.nullable then 'nullable_changed' end as change from (select * from {_rows(_OLD, 'table_name, column_name, type, nullable')}) a full join (select * from {_rows(_NEW, 'table_name, column_name, type, nullable')}) b on a.table_name = b.table_name and a.column_name = b.column_name) where change is not null",
)
_C = "table_name string, kind string, signature string"
_oc, _nc = (f"(select * from {_rows(r, 'table_name, kind, signature')})" for r in (_OLD_C, _NEW_C))
_add("drift_constraints", lambda s, d: drift.constraint_drift(s.createDataFrame(_OLD_C, _C), s.createDataFrame(_NEW_C, _C)), f"select *, 'added' as change from ({_nc} except {_oc}) union all select *, 'removed' from ({_oc} except {_nc})")

# --- generation -------------------------------------------------------------------------------------------------------

_VALUES = {("products", "color"): {"values": ["red", "blue", "green", "black", "white"], "weights": [0.25, 0.2, 0.2, 0.2, 0.15]}}
_NORMAL = {"kind": "numeric", "min": 0.0, "max": 1000.0, "mean": 49.99, "stddev": 25.0}
_PROFILES = {("orders", "total"): _NORMAL}


def shop_plan(rows: dict[str, int] | None = None) -> GenerationPlan:
    return build_plan(examples.shop(), SEED, 100, BASE, rows or ROWS, _VALUES, _PROFILES)


def circular_plan() -> GenerationPlan:
    return build_plan(examples.circular(), SEED, 100, BASE, {"employees": 300, "departments": 20})


def _frame(spark: SparkSession, table: str, *columns: str, final: bool = False, plan: GenerationPlan | None = None) -> DataFrame:
    df = _exact(plan or shop_plan()).frame(spark, table, keep_id=True, final=final)
    return df.select(F.col("_id").alias("row_id"), *columns)


def _u(table: str, name: str, k: int = 0, id: str = "id") -> str:
    return f"(('0x' || substr(md5('{SEED}|{table}|{name}|{k}|' || ({id})::varchar), 1, 13))::bigint / 4503599627370496::double)"


def _int(table: str, low: int, high: int, name: str, k: int = 0, id: str = "id") -> str:
    return f"({low} + floor({_u(table, name, k, id)} * {high - low}))::bigint"


def _pick(table: str, values: list, name: str, k: int = 0) -> str:
    listed = ", ".join(_quoted(v) if isinstance(v, str) else str(v) for v in values)
    return f"list_extract([{listed}], {_int(table, 0, len(values), name, k)} + 1)"


def _maybe(table: str, name: str, value: str, share: float = 0.05) -> str:
    return f"case when {_u(table, name, 999)} < {share} then null else {value} end"


def _from(table: str) -> str:
    return f"from range({ROWS[table]}) r(id)"


def _base_sql() -> str:
    return f"timestamp '{BASE:%Y-%m-%d %H:%M:%S}'"


_add("gen_autoinc_fk", lambda s, d: _frame(s, "orders", "id", "user_id"), f"select id as row_id, (id + 1)::int as id, ({_int('orders', 0, ROWS['users'], 'key:user_id')} + 1)::int as user_id {_from('orders')}")
_add("gen_enum", lambda s, d: _frame(s, "orders", "status"), f"select id as row_id, {_pick('orders', examples.shop().enums['order_status'], 'status')} as status {_from('orders')}")


def _weighted_sql(table: str, name: str, values: list[str], weights: list[float]) -> str:
    upto, total = [], 0.0
    for w in weights:
        total += w
        upto.append(total)
    roll = f"{_u(table, name)} * {total!r}::double"
    whens = " ".join(f"when {roll} < {u!r}::double then '{v}'" for v, u in zip(values[:-1], upto, strict=False))
    return f"case {whens} else '{values[-1]}' end"


_color = _VALUES["products", "color"]
_add("gen_value_list_weighted", lambda s, d: _frame(s, "products", "color"), f"select id as row_id, {_weighted_sql('products', 'color', _color['values'], _color['weights'])} as color {_from('products')}")
_add("gen_normal", lambda s, d: _frame(s, "orders", "total").withColumn("total", F.round("total", 6)), f"select id as row_id, round(least(greatest(49.99 + 25.0 * sqrt(-2 * ln(greatest({_u('orders', 'total')}, 2.2250738585072014e-308))) * cos(2 * pi() * {_u('orders', 'total', 1)}), 0.0), 1000.0), 6) as total {_from('orders')}")
_add("gen_null_injection", lambda s, d: _frame(s, "products", "category_id"), f"select id as row_id, {_maybe('products', 'category_id', '(' + _int('products', 0, ROWS['categories'], 'key:category_id') + ' + 1)::int')} as category_id {_from('products')}")
_add("gen_price_weight", lambda s, d: _frame(s, "products", F.col("price").cast("double").alias("price"), "weight"), f"select id as row_id, round(0.01 + {_u('products', 'price')} * {999.99 - 0.01!r}, 2) as price, round(0.1 + {_u('products', 'weight')} * {100 - 0.1!r}, 2) as weight {_from('products')}")
_add("gen_quantity", lambda s, d: _frame(s, "order_items", "quantity"), f"select id as row_id, {_int('order_items', 1, 101, 'quantity')}::int as quantity {_from('order_items')}")
_add("gen_unique_text", lambda s, d: _frame(s, "orders", "order_number").join(_frame(s, "products", "sku"), "row_id", "left"), f"select r.id as row_id, printf('ORD-%08d', r.id + 1) as order_number, case when r.id < {ROWS['products']} then printf('SKU-%06d', r.id + 1) end as sku {_from('orders')}")
_add("gen_boolean", lambda s, d: _frame(s, "users", "is_active"), f"select id as row_id, {_u('users', 'is_active')} < 0.7 as is_active {_from('users')}")
_S0, _S1, _PAIR = ROWS["orders"], ROWS["products"], "order_id,product_id"
(_step0, _shift0), (_step1, _shift1) = (permutation(n, SEED, f"order_items.{_PAIR}.{k}") for k, n in enumerate((_S0, _S1)))
_place0 = f"((id % {_S0}) * {_step0} + {_shift0}) % {_S0}"
_digit1 = f"((id // {_S0} + floor({_u('order_items', 'digit:' + _PAIR, 1, 'place0')} * {_S1})::bigint) % {_S1})"
_add("gen_composite_unique", lambda s, d: _frame(s, "order_items", "order_id", "product_id"), f"select id as row_id, (place0 + 1)::int as order_id, (({_digit1} * {_step1} + {_shift1}) % {_S1} + 1)::int as product_id from (select id, {_place0} as place0 {_from('order_items')})")


def _wide_plan() -> GenerationPlan:
    """A key of two parents of ten million rows each."""
    from .schema import Column, DataType, ForeignKey, Table

    schema = Schema(name="wide")
    for n in ("a", "b"):
        schema.add(Table(n, primary_key=("id",)).add(Column("id", DataType.parse("bigint"), False, auto_increment=True)))
    pair = Table("pairs", primary_key=("a_id", "b_id"), foreign_keys=[ForeignKey((f"{n}_id",), n, ("id",)) for n in ("a", "b")])
    schema.add(pair.add(Column("a_id", DataType.parse("bigint"), False)).add(Column("b_id", DataType.parse("bigint"), False)))
    return build_plan(schema, SEED, 100, BASE, {"a": 10_000_000, "b": 10_000_000, "pairs": 20_000})


def _spread(spark: SparkSession, d: str) -> DataFrame:
    rows = _exact(_wide_plan()).frame(spark, "pairs")
    tenth = lambda c: F.count_distinct(F.floor((F.col(c) - 1) / 1_000_000)).alias(f"{c}_tenths")
    return rows.agg(tenth("a_id"), tenth("b_id"), F.count_distinct("a_id", "b_id").alias("n_pairs"))


_add("gen_composite_spread", _spread, "select 10::bigint as a_id_tenths, 10::bigint as b_id_tenths, 20000::bigint as n_pairs")


def _chain(spark: SparkSession, d: str) -> DataFrame:
    """Thirteen tables, each of whose primary key is a key to the table before."""
    from .schema import Column, DataType, ForeignKey, Table

    schema = Schema(name="chain")
    for i in range(13):
        t = Table(f"t{i:02}", primary_key=("id",)).add(Column("id", DataType.parse("bigint"), False, auto_increment=i == 0))
        t.foreign_keys = [ForeignKey(("id",), f"t{i - 1:02}", ("id",))] if i else []
        schema.add(t)
    g = _exact(build_plan(schema, SEED, 50, BASE))
    return profile.union_all(g.frame(spark, t).agg(F.lit(t).alias("table_name"), F.count_distinct("id").alias("n_ids"), F.min("id").alias("low"), F.max("id").alias("high")) for t in g.plan.tables)


_add("gen_key_chain", _chain, "select printf('t%02d', i) as table_name, 50::bigint as n_ids, 1::bigint as low, 50::bigint as high from range(13) r(i)")


def _composite_check(spark: SparkSession, d: str) -> DataFrame:
    return validate.duplicates(_exact(shop_plan()).frame(spark, "order_items"), ["order_id", "product_id"], "order_items(order_id, product_id)")


_add("gen_composite_unique_check", _composite_check, f"select 'order_items(order_id, product_id)' as check_name, {ROWS['order_items']}::bigint as checked_rows, 0::bigint as violations")


def _gen_orphans(spark: SparkSession, d: str) -> DataFrame:
    g, schema = _exact(shop_plan()), examples.shop()
    frames = g.frames(spark, final=True)
    return profile.union_all(validate.orphans(frames[t.name], list(k.columns), frames[k.parent], list(k.parent_columns), f"{t.name}.{k.columns[0]}") for t in schema.tables.values() for k in t.foreign_keys)


_add("gen_fk_orphans", _gen_orphans, " union all ".join(f"select '{t.name}.{k.columns[0]}' as check_name, {ROWS[t.name]}::bigint as checked_rows, 0::bigint as violations" for t in examples.shop().tables.values() for k in t.foreign_keys))

_g = "group:"
_place_list = "[" + ", ".join(f"{{'city': {_quoted(c)}, 'state': {_quoted(s)}, 'zip': {_quoted(z)}}}" for c, s, z in correlated.PLACES) + "]"
_address_pick = f"list_extract({_place_list}, {_int('stores', 0, len(correlated.PLACES), _g + 'Address', 0)} + 1)"
_add(
    "gen_address",
    lambda s, d: _frame(s, "stores", "street_address", "city", "state", "zip_code", "country"),
    f"select row_id, street_address, p.city as city, p.state as state, p.zip as zip_code, 'United States' as country from (select id as row_id, {_int('stores', 100, 9999, _g + 'Address', 1)}::varchar || ' ' || {_pick('stores', correlated.STREETS, _g + 'Address', 2)} as street_address, {_address_pick} as p {_from('stores')})",
)
_add("gen_geo", lambda s, d: _frame(s, "stores", "latitude", "longitude"), f"select id as row_id, round(25 + {_u('stores', _g + 'GeoCoordinates', 0)} * 23, 6) as latitude, round(-125 + {_u('stores', _g + 'GeoCoordinates', 1)} * 55, 6) as longitude {_from('stores')}")
_first, _last = _pick("users", providers.FIRST_NAMES, _g + "PersonIdentity", 0), _pick("users", providers.LAST_NAMES, _g + "PersonIdentity", 1)
_add(
    "gen_person",
    lambda s, d: _frame(s, "users", "email", "first_name", "last_name"),
    f"select id as row_id, lower({_first} || '.' || {_last} || case when id = 0 then '' else '.' || id::varchar end || '@example.com') as email, {_maybe('users', 'first_name', _first)} as first_name, {_maybe('users', 'last_name', _last)} as last_name {_from('users')}",
)
_T = _g + "Temporal"
_ago, _later = _int("users", 30, 365, _T, 0), f"(1 + floor({_u('users', _T, 1)} * ({_int('users', 30, 365, _T, 0)} - 1)))::bigint"
_created = f"({_base_sql()} - to_days(({_ago})::int))"
_updated = f"({_created} + to_days(({_later})::int))"
_deleted = f"(case when {_u('users', _T, 3)} < 0.1 then {_updated} + to_days(({_int('users', 1, 30, _T, 2)})::int) end)"
_add(
    "gen_temporal",
    lambda s, d: _frame(s, "users", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("created_at", "updated_at", "deleted_at")]),
    f"select id as row_id, strftime({_created}, '%Y-%m-%d %H:%M:%S') as created_at, strftime({_maybe('users', 'updated_at', _updated)}, '%Y-%m-%d %H:%M:%S') as updated_at, strftime({_maybe('users', 'deleted_at', _deleted, 0.8)}, '%Y-%m-%d %H:%M:%S') as deleted_at {_from('users')}",
)
_R = _g + "TemporalRange"
_start = f"(date '{BASE:%Y-%m-%d}' + ({_int('stores', -30, 60, _R, 0)})::int)"
_add("gen_range", lambda s, d: _frame(s, "stores", F.col("start_date").cast("string").alias("start_date"), F.col("end_date").cast("string").alias("end_date")), f"select id as row_id, {_start}::date::varchar as start_date, ({_start} + ({_int('stores', 1, 90, _R, 1)})::int)::date::varchar as end_date {_from('stores')}")

_CN = {"employees": 300, "departments": 20}
_cu = lambda t, n, high: f"(floor({_u(t, n)} * {high}))::bigint + 1"


def _updates(spark: SparkSession, d: str) -> DataFrame:
    return _exact(circular_plan()).deferred_updates(spark)


def _deferred_sql() -> str:
    plan = circular_plan()
    return " union all ".join(f"select '{e.child}' as table_name, id as row_index, '{c}' as column_name, ({_cu(e.child, 'key:' + c, _CN[e.parent])})::int::varchar as value from range({_CN[e.child]}) r(id)" for e in plan.deferred for c in e.key.columns)


_add("gen_deferred_updates", _updates, _deferred_sql())


def _after(spark: SparkSession, d: str) -> DataFrame:
    g = _exact(circular_plan())
    rows = g.frame(spark, "employees", keep_id=True)
    return sinks.apply_updates(rows, g.deferred_updates(spark), "employees", "manager_id").select(F.col("_id").alias("row_id"), "id", "manager_id")


_add("gen_final_after_update", _after, f"select id as row_id, (id + 1)::int as id, ({_cu('employees', 'key:manager_id', 300)})::int as manager_id from range(300) r(id)")

_PROVIDER_TABLE = [("Status", "varchar"), ("Role", "varchar"), ("Priority", "varchar"), ("Currency", "varchar"), ("MimeType", "varchar"), ("Department", "varchar"), ("Locale", "varchar"), ("Timezone", "varchar"), ("PhoneCountryCode", "varchar"), ("Rating", "double"), ("Percentage", "double"), ("Score", "bigint"), ("Age", "bigint"), ("Duration", "bigint"), ("FileSize", "bigint"), ("Height", "double"), ("SortOrder", "bigint"), ("InvoiceNumber", "varchar"), ("ImageUrl", "varchar"), ("HexColor", "varchar"), ("IpAddress", "varchar"), ("TimeOnly", "varchar"), ("ZipCode", "varchar"), ("BirthDate", "date"), ("Slug", "varchar"), ("Uuid", "varchar")]


def _provider_schema() -> tuple[Schema, dict]:
    from .schema import Column, DataType, Table

    t = Table("things")
    for m, kind in _PROVIDER_TABLE:
        t.add(Column(m.lower(), DataType.parse(kind), False))
    return Schema(name="things").add(t), {("things", m.lower()): m for m, _ in _PROVIDER_TABLE}


def _providers(spark: SparkSession, d: str) -> DataFrame:
    schema, meanings = _provider_schema()
    df = _exact(build_plan(schema, SEED, 1000, BASE, meanings=meanings)).frame(spark, "things", keep_id=True)
    return df.select(F.col("_id").alias("row_id"), *[F.col(m.lower()).cast("string").alias(m.lower()) if k == "date" else F.col(m.lower()) for m, k in _PROVIDER_TABLE])


def _provider_sql() -> str:
    t = "things"
    two = lambda high, k: f"lpad({_int(t, 0, high, 'timeonly', k)}::varchar, 2, '0')"
    hexes = lambda k: f"lpad(lower(to_hex({_int(t, 0, 256, 'hexcolor', k)})), 2, '0')"
    digest = f"md5('{SEED}|{t}|uuid|0|' || id::varchar)"
    variant = f"list_extract(['8', '9', 'a', 'b'], {_int(t, 0, 4, 'uuid', 1)} + 1)"
    words = ", ".join(_pick(t, providers.WORDS, "slug", i) for i in range(3))
    made = {
        "Status": _pick(t, providers.STATUSES, "status"), "Role": _pick(t, providers.ROLES, "role"), "Priority": _pick(t, providers.PRIORITIES, "priority"),
        "Currency": _pick(t, providers.CURRENCIES, "currency"), "MimeType": _pick(t, providers.MIME_TYPES, "mimetype"), "Department": _pick(t, providers.DEPARTMENTS, "department"),
        "Locale": _pick(t, providers.LOCALES, "locale"), "Timezone": _pick(t, providers.TIMEZONES, "timezone"), "PhoneCountryCode": _pick(t, providers.DIAL_CODES, "phonecountrycode"),
        "Rating": f"round(1 + {_u(t, 'rating')} * 4, 1)", "Percentage": f"round({_u(t, 'percentage')} * 100, 2)", "Score": _int(t, 0, 101, "score"), "Age": _int(t, 18, 90, "age"),
        "Duration": _int(t, 1, 3600, "duration"), "FileSize": _int(t, 1024, 10_485_760, "filesize"), "Height": f"round(50 + {_u(t, 'height')} * 200, 1)", "SortOrder": "id",
        "InvoiceNumber": "printf('INV-%08d', id + 1)", "ImageUrl": "'https://images.example.com/' || id::varchar || '/800/600'", "HexColor": f"'#' || {hexes(0)} || {hexes(1)} || {hexes(2)}",
        "IpAddress": " || '.' || ".join(f"{_int(t, 1, 255, 'ipaddress', k)}::varchar" for k in range(4)), "TimeOnly": f"{two(24, 0)} || ':' || {two(60, 1)} || ':' || {two(60, 2)}",
        "ZipCode": f"lpad({_int(t, 501, 99951, 'zipcode')}::varchar, 5, '0')", "BirthDate": f"(date '{BASE:%Y-%m-%d}' - ({_int(t, 18, 80, 'birthdate')} * 365 + {_int(t, 0, 365, 'birthdate', 1)})::int)::date::varchar",
        "Slug": f"array_to_string(([{words}])[1:{_int(t, 2, 4, 'slug', 50)}], '-')",
        "Uuid": f"substr({digest}, 1, 8) || '-' || substr({digest}, 9, 4) || '-4' || substr({digest}, 14, 3) || '-' || {variant} || substr({digest}, 18, 3) || '-' || substr({digest}, 21, 12)",
    }
    return "select id as row_id, " + ", ".join(f"{made[m]} as {m.lower()}" for m, _ in _PROVIDER_TABLE) + " from range(1000) r(id)"


_add("gen_providers", _providers, _provider_sql())


def _from_profile(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: profile the real orders, then generate as many synthetic ones per customer as the real ratio says."""
    real = {"customer": read_table(spark, d, "customer"), "orders": read_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")}
    found = profile.as_distributions(profile.sample(real, [("orders", "o_custkey", "customer")], skip={"orders": ["o_orderkey", "o_custkey"]}))
    from .schema import Column, DataType, ForeignKey, Table

    schema = Schema(name="star")
    schema.add(Table("customer", primary_key=("c_custkey",)).add(Column("c_custkey", DataType.parse("bigint"), False, auto_increment=True)))
    orders = Table("orders", primary_key=("o_orderkey",), foreign_keys=[ForeignKey(("o_custkey",), "customer", ("c_custkey",))])
    for c, t, auto in (("o_orderkey", "bigint", True), ("o_custkey", "bigint", False), ("o_orderstatus", "varchar", False), ("o_totalprice", "double", False)):
        orders.add(Column(c, DataType.parse(t), False, auto_increment=auto))
    schema.add(orders)
    plan = build_plan(schema, SEED, 1000, BASE, {"customer": 1000}, profiles=found)
    return _exact(plan).frame(spark, "orders").withColumn("o_totalprice", F.round("o_totalprice", 4))


_add(
    "gen_from_profile",
    _from_profile,
    f"""with p as (select min(o_totalprice) as lo, max(o_totalprice) as hi, avg(o_totalprice) as m, stddev_pop(o_totalprice) as s, count(*) as n from orders),
    c as (select o_orderstatus as v, count(*) / (select n from p)::double as f from orders group by 1),
    cum as (select v, sum(f) over (order by f desc, v rows unbounded preceding) as upto from c), tot as (select max(upto) as t from cum),
    rows as (select id from (select round(1000 * (select n from p) / (select count(*) from customer)::double)::bigint as k), range(1000000) r(id) where id < k),
    drawn as (select id, {_u('orders', 'o_orderstatus')} * (select t from tot) as roll from rows)
    select (id + 1)::bigint as o_orderkey, {_int('orders', 0, 1000, 'key:o_custkey')} + 1 as o_custkey,
      coalesce((select v from cum where roll < upto order by upto limit 1), (select v from cum order by upto desc limit 1)) as o_orderstatus,
      round(least(greatest(m + s * sqrt(-2 * ln(greatest({_u('orders', 'o_totalprice')}, 2.2250738585072014e-308))) * cos(2 * pi() * {_u('orders', 'o_totalprice', 1)}), lo), hi), 4) as o_totalprice
    from drawn, p""",
)

# --- sinks ------------------------------------------------------------------------------------------------------------


def _people(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "customer").select(F.col("c_custkey").alias("_id"), "c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.lit("O'Neil, \"Al\"\t\\x")).when(F.col("c_custkey") % 3 == 1, F.col("c_name")).alias("name"), (F.col("c_nationkey") > 12).alias("far"), "c_nationkey", F.expr("timestamp_ntz '2025-06-15 12:30:45'").alias("seen"))


_PEOPLE = "(select c_custkey as _id, c_custkey, case c_custkey % 3 when 0 then 'O''Neil, \"Al\"' || chr(9) || '\\x' when 1 then c_name end as name, c_nationkey > 12 as far, c_nationkey from customer)"
_BY_NAME = lambda null, expr: f"case when name is null then {null} else {expr} end"
_add("sink_sql_literals", lambda s, d: sinks.literal_rows(_people(s, d)), f"select _id, '(' || c_custkey || ', ' || {_BY_NAME(_quoted('NULL'), chr(39) * 4 + ' || replace(name, ' + chr(39) * 4 + ', ' + chr(39) * 6 + ') || ' + chr(39) * 4)} || ', ' || case when far then 'TRUE' else 'FALSE' end || ', ' || c_nationkey || ', ''2025-06-15 12:30:45'')' as row from {_PEOPLE}")
_add("sink_copy_rows", lambda s, d: sinks.copy_lines(_people(s, d)), f"select _id, c_custkey || chr(9) || {_BY_NAME(_quoted(chr(92) + 'N'), 'replace(replace(name, chr(92), chr(92) || chr(92)), chr(9), chr(92) || ' + _quoted('t') + ')')} || chr(9) || case when far then 't' else 'f' end || chr(9) || c_nationkey || chr(9) || '2025-06-15 12:30:45' as line from {_PEOPLE}")
_add("sink_csv_rows", lambda s, d: sinks.csv_lines(_people(s, d)), f"""select _id, c_custkey || ',' || {_BY_NAME("''", "case when regexp_matches(name, '[,\"]') then '\"' || replace(name, '\"', '\"\"') || '\"' else name end")} || ',' || case when far then 'true' else 'false' end || ',' || c_nationkey || ',2025-06-15 12:30:45' as line from {_PEOPLE}""")
_add("sink_json_rows", lambda s, d: sinks.json_lines(_people(s, d)), f"""select _id, '{{"c_custkey":' || c_custkey || ',"name":' || {_BY_NAME("'null'", "to_json(name)::varchar")} || ',"far":' || case when far then 'true' else 'false' end || ',"c_nationkey":' || c_nationkey || ',"seen":"2025-06-15T12:30:45.000Z"}}' as line from {_PEOPLE}""")


def _inserts(spark: SparkSession, d: str) -> DataFrame:
    return sinks.insert_statements(read_table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("_id"), "n_nationkey", "n_name"), "nation", batch=10)


_add("sink_insert_statements", _inserts, """select (n_nationkey // 10)::bigint as batch, 'INSERT INTO "nation" ("n_nationkey", "n_name") VALUES' || chr(10) || string_agg('(' || n_nationkey || ', ''' || replace(n_name, '''', '''''') || ''')', ',' || chr(10) order by n_nationkey) || ';' as statement from nation group by 1""")


def _update_rows(spark: SparkSession, d: str) -> DataFrame:
    return sinks.update_statements(spark, _exact(circular_plan())).select("table_name", "row_index", "statement")


_add("sink_update_statements", _update_rows, f"""select table_name, row_index, 'UPDATE "' || table_name || '" SET "' || column_name || '" = ' || value || ' WHERE "id" = ' || (row_index + 1) || ';' as statement from ({_deferred_sql()})""")

def _insert_lines(spark: SparkSession, d: str) -> DataFrame:
    """The script's lines of a table whose counted key is left to the database."""
    return sinks.insert_lines(spark, _exact(shop_plan()), "order_items", auto=False).select(F.col("_id").alias("row_id"), F.length("line").alias("n"), F.substring("line", -1, 1).alias("ending"), F.col("line").startswith("INSERT INTO").alias("begins"), F.col("line").contains('("order_id", "product_id", "quantity", "unit_price") VALUES').alias("named"))


def _line_sql() -> str:
    price = f"round(0.01 + {_u('order_items', 'unit_price')} * {999.99 - 0.01!r}, 2)"
    head = len('INSERT INTO "order_items" ("order_id", "product_id", "quantity", "unit_price") VALUES') + 1
    n = ROWS["order_items"]
    return f"""select r.id as row_id, (length('(' || order_id || ', ' || product_id || ', ' || {_int('order_items', 1, 101, 'quantity', 0, 'r.id')} || ', ' || {price.replace('(id)', '(r.id)')} || ');') + case when r.id % 100 = 0 then {head} else 0 end)::int as n,
      case when r.id % 100 = 99 or r.id = {n - 1} then ';' else ',' end as ending, r.id % 100 = 0 as begins, r.id % 100 = 0 as named from range({n}) r(id) join ({_SQL['gen_composite_unique']}) k on k.row_id = r.id"""


_add("sink_insert_lines", _insert_lines, _line_sql())


def _preview(spark: SparkSession, d: str) -> DataFrame:
    rows = sinks.preview(spark, _exact(shop_plan()), 5)["orders"]
    return spark.createDataFrame([(r["id"], r["user_id"], r["status"]) for r in rows], "id string, user_id string, status string")


_add("preview", _preview, f"select (id + 1)::varchar as id, ({_int('orders', 0, ROWS['users'], 'key:user_id')} + 1)::varchar as user_id, {_pick('orders', examples.shop().enums['order_status'], 'status')} as status from range(5) r(id)")


def _settings(spark: SparkSession, d: str) -> DataFrame:
    from . import config

    c = config.parse_config('[generate]\nrows = 7\n[tables.users]\nrows = 3\n[columns."users.role"]\nvalues = ["a", "b"]\nweights = [1, 2]\n[graph]\nbreak_cycle_at = ["a.b"]\n')
    rows = [("rows", str(c.rows)), ("users", str((c.tables | config.parse_table_rows("orders=9,bad"))["users"])), ("orders", str(config.parse_table_rows("orders=9,bad")["orders"])), ("break", ".".join(c.break_edges()[0])), ("warning", c.warnings(examples.shop())[0])]
    return spark.createDataFrame(rows, "name string, value string")


_add("settings", _settings, "select * from (values ('rows', '7'), ('users', '3'), ('orders', '9'), ('break', 'a.b'), ('warning', 'no column users.role')) v(name, value)")

# --- AI merge ---------------------------------------------------------------------------------------------------------

_SAID = [("users", "mystery", "Bio", 0.9), ("departments", "name", "Title", 0.4), ("users", "notes", "Bio", 0.99)]


def _ai_merge(spark: SparkSession, d: str) -> DataFrame:
    named = _column_frame(spark).dropDuplicates(["table_name", "column_name"]).filter("column_name not in ('rank', 'age')")
    named = named.select("table_name", "column_name", meaning_column(F.col("column_name"), F.col("table_name"), F.col("kind")).alias("meaning"))
    return ai.merge_frames(named, spark.createDataFrame(_SAID, "table_name string, column_name string, semantic_type string, confidence double"))


_add("ai_merge", _ai_merge, f"select m.table_name, m.column_name, case when meaning = 'Unknown' then coalesce(a.semantic_type, meaning) else meaning end as meaning from ({_meaning_sql()}) m left join (select * from (values " + ", ".join(f"('{t}', '{c}', '{s}', {f})" for t, c, s, f in _SAID) + ") v(table_name, column_name, semantic_type, confidence) where confidence >= 0.5) a on m.table_name = a.table_name and m.column_name = a.column_name where m.column_name not in ('rank', 'age')")


def _schema_counts(spark: SparkSession, d: str) -> DataFrame:
    frames = examples.shop().frames(spark)
    columns = frames["columns"].groupBy("table_name").agg(F.count(F.lit(1)).alias("n_columns"), F.sum(F.col("nullable").cast("int")).alias("n_nullable"))
    return columns.join(frames["fks"].groupBy("table_name").agg(F.count(F.lit(1)).alias("n_keys")), "table_name", "left").withColumn("n_keys", F.coalesce("n_keys", F.lit(0)).cast("long"))


_add("schema_counts", _schema_counts, "select * from (values " + ", ".join(f"('{t.name}', {len(t.columns)}::bigint, {sum(c.nullable for c in t.columns.values())}::bigint, {len(t.foreign_keys)}::bigint)" for t in examples.shop().tables.values()) + ") v(table_name, n_columns, n_nullable, n_keys)")


def _classified_shop(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(t, c, m) for (t, c), m in classify_schema(examples.shop()).items()], "table_name string, column_name string, meaning string").filter("meaning = 'ExternalId'")


_add("classify_keys", _classified_shop, "select * from (values ('categories', 'parent_id', 'ExternalId'), ('order_items', 'order_id', 'ExternalId'), ('order_items', 'product_id', 'ExternalId'), ('orders', 'user_id', 'ExternalId'), ('products', 'category_id', 'ExternalId')) v(table_name, column_name, meaning)")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
