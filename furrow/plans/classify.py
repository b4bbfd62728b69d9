"""What a column means, from its name, type and table."""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import INTEGER_KINDS, NUMERIC_KINDS, Column, DataType, Schema, Table

#: Rules that also look at the table (fixed values): column pattern, table pattern, meaning. First match wins.
TABLE_RULES = (
    (r"^name$", r"(?i)(users?|people|persons?|members?|employees?|staff|contacts?|customers?|accounts?|profiles?)", "FullName"),
    (r"^name$", r"(?i)(companies|organizations?|businesses|vendors?|suppliers?|brands?)", "CompanyName"),
    (r"^name$", r"(?i)(products?|items?|goods|catalog|categories|tags?)", "Title"),
    (r"^title$", r"(?i)(users?|people|persons?|members?|employees?|staff)", "JobTitle"),
)
#: General rules (fixed values): column pattern, kinds of type or None, meaning. First match wins.
RULES = (
    (r"^(first_?name|given_?name|fname)$", None, "FirstName"),
    (r"^(last_?name|family_?name|surname|lname)$", None, "LastName"),
    (r"^(full_?name|display_?name|real_?name)$", None, "FullName"),
    (r"^(user_?name|login|handle|screen_?name|nick_?name)$", None, "Username"),
    (r"^e?_?mail(_?(address|addr))?$", None, "Email"),
    (r"^(phone(_?(number|num))?|telephone|mobile|cell(_?phone)?|fax)$", None, "Phone"),
    (r"^(phone_?country_?code|dial_?code|calling_?code)$", None, "PhoneCountryCode"),
    (r"^(street(_?(address|addr|line))?|address(_?line)?_?[12]?|addr)$", None, "StreetAddress"),
    (r"^(city|town|municipality)$", None, "City"),
    (r"^(state|province|region|prefecture)$", None, "State"),
    (r"^(zip(_?code)?|postal_?code|post_?code)$", None, "ZipCode"),
    (r"^(country)$", None, "Country"),
    (r"^(country_?code|country_?iso|iso_?country)$", None, "CountryCode"),
    (r"^(lat(itude)?)$", None, "Latitude"),
    (r"^(lng|lon(gitude)?)$", None, "Longitude"),
    (r"^(company(_?name)?|organization(_?name)?|org(_?name)?|employer)$", None, "CompanyName"),
    (r"^(job_?title|position|occupation|role_?title)$", None, "JobTitle"),
    (r"^(department|dept|division|team)$", None, "Department"),
    (r"^(industry|sector)$", None, "Industry"),
    (r"^(url|link|href|website|web_?url|homepage)$", None, "Url"),
    (r"^(domain(_?name)?|host(_?name)?)$", None, "DomainName"),
    (r"^(ip(_?address)?|ip_?addr|remote_?addr)$", None, "IpAddress"),
    (r"^(mac(_?address)?|mac_?addr|hw_?addr)$", None, "MacAddress"),
    (r"^(user_?agent|ua)$", None, "UserAgent"),
    (r"^slug$", None, "Slug"),
    (r"^(title|subject|heading|headline)$", None, "Title"),
    (r"^(description|desc|summary|excerpt|blurb|abstract|overview)$", None, "Description"),
    (r"^(bio(graphy)?|about(_?me)?)$", None, "Bio"),
    (r"^(body|content|text|message|comment|note|notes|remarks?)$", None, "Paragraph"),
    (r"^(image(_?url)?|img(_?url)?|photo(_?url)?|picture(_?url)?|cover(_?image)?)$", None, "ImageUrl"),
    (r"^(avatar(_?url)?|profile(_?(image|photo|pic|picture))?(_?url)?)$", None, "AvatarUrl"),
    (r"^(thumbnail(_?url)?|thumb(_?url)?)$", None, "ThumbnailUrl"),
    (r"^(file(_?url)?|attachment(_?url)?|download(_?url)?)$", None, "FileUrl"),
    (r"^(file_?name|filename|original_?name)$", None, "FileName"),
    (r"^(mime_?type|content_?type|media_?type)$", None, "MimeType"),
    (r"^(file_?size|size_?bytes|content_?length)$", None, "FileSize"),
    (r"^(price|cost|amount|total|subtotal|sub_?total|unit_?price|sale_?price|list_?price|retail_?price|msrp)$", None, "Price"),
    (r"^(currency)$", None, "Currency"),
    (r"^(currency_?code|currency_?iso)$", None, "CurrencyCode"),
    (r"^(percentage|percent|pct|ratio|rate)$", None, "Percentage"),
    (r"^(created_?(at|on|date|time|timestamp)?|date_?created|insert(ed)?_?(at|on))$", None, "CreatedAt"),
    (r"^(updated_?(at|on|date|time|timestamp)?|modified_?(at|on|date)?|date_?updated|changed_?(at|on)|last_?modified)$", None, "UpdatedAt"),
    (r"^(deleted_?(at|on|date|time|timestamp)?|removed_?(at|on))$", None, "DeletedAt"),
    (r"^(start_?(date|time|at)?|begin_?(date|time|at)?|from_?(date|time)|valid_?from)$", None, "StartDate"),
    (r"^(end_?(date|time|at)?|finish_?(date|time|at)?|to_?(date|time)|valid_?(to|until)|expires?_?(at|on|date)?|expir(y|ation)(_?date)?)$", None, "EndDate"),
    (r"^(birth_?(date|day)?|date_?of_?birth|dob|birthday)$", None, "BirthDate"),
    (r"^(password(_?hash)?|hashed_?password|encrypted_?password|password_?digest|passwd)$", None, "PasswordHash"),
    (r"^(token|access_?token|refresh_?token|auth_?token|session_?token|verification_?token|confirmation_?token|reset_?token)$", None, "Token"),
    (r"^(api_?key|app_?key|client_?key|public_?key)$", None, "ApiKey"),
    (r"^(secret(_?key)?|client_?secret|private_?key|signing_?key)$", None, "SecretKey"),
    (r"^(external_?id|ext_?id|remote_?id|ref(_?id)?|reference(_?id)?)$", None, "ExternalId"),
    (r"^(sku|product_?code|item_?code|part_?number)$", None, "Sku"),
    (r"^(order_?(number|num|no|code|ref))$", None, "OrderNumber"),
    (r"^(invoice_?(number|num|no|code|ref))$", None, "InvoiceNumber"),
    (r"^(tracking_?(number|num|no|code|id))$", None, "TrackingNumber"),
    (r"^(status|state)$", None, "Status"),
    (r"^(role|user_?role|account_?type)$", None, "Role"),
    (r"^(priority|urgency|severity)$", None, "Priority"),
    (r"^(category|type|kind|group|class)$", None, "Category"),
    (r"^(tags?|labels?)$", None, "Tag"),
    (r"^(is_|has_|can_|should_|was_|allow(s|ed)?_|enable[ds]?_|active|verified|visible|published|featured|archived|locked|blocked|banned|suspended|approved|confirmed|completed|deleted|removed|disabled|hidden|draft|public|private|internal|admin|default|required|optional|primary|secondary|premium|free|trial|test|demo|sample|temp(orary)?)", None, "BooleanFlag"),
    (r"^(quantity|qty|count|num|number_?of|total_?count)$", NUMERIC_KINDS, "Quantity"),
    (r"^(rating|stars|score|grade|rank)$", NUMERIC_KINDS, "Rating"),
    (r"^(weight|mass)$", NUMERIC_KINDS, "Weight"),
    (r"^(height|length|width|depth|size)$", NUMERIC_KINDS, "Height"),
    (r"^(age)$", INTEGER_KINDS, "Age"),
    (r"^(duration|elapsed|time_?spent|response_?time|load_?time)$", NUMERIC_KINDS, "Duration"),
    (r"^(sort_?order|position|display_?order|rank|seq(uence)?|ordinal|index|weight)$", INTEGER_KINDS, "SortOrder"),
    (r"^(color|colour)$", None, "Color"),
    (r"^(hex_?color|color_?hex|color_?code)$", None, "HexColor"),
    (r"^(locale|lang(uage)?(_?code)?|i18n)$", None, "Locale"),
    (r"^(time_?zone|tz|timezone)$", None, "Timezone"),
    (r"_id$", None, "ExternalId"),
)
#: The meaning of a column that no rule names, by the kind of its type (fixed values).
FALLBACK = {
    "boolean": "BooleanFlag", "uuid": "Uuid", "json": "JsonData", "jsonb": "JsonData", "inet": "IpAddress", "macaddr": "MacAddress",
    "date": "DateOnly", "time": "TimeOnly", "timestamp": "Timestamp", "timestamptz": "Timestamp",
}
#: Meanings that tell about a person (fixed values).
PERSONAL = ("FirstName", "LastName", "FullName", "Email", "Phone", "StreetAddress", "BirthDate", "PasswordHash", "Token", "ApiKey", "SecretKey", "IpAddress")
#: Meanings whose columns are made together (fixed values).
GROUPS = {
    "Address": ("StreetAddress", "City", "State", "ZipCode", "PostalCode", "Country", "CountryCode"),
    "GeoCoordinates": ("Latitude", "Longitude"),
    "PersonIdentity": ("FirstName", "LastName", "FullName", "Email", "Username"),
    "Temporal": ("CreatedAt", "UpdatedAt", "DeletedAt"),
    "TemporalRange": ("StartDate", "EndDate"),
}
#: Meanings that only another classifier may give.
UNNAMED = ("DisplayName", "PostalCode", "Sentence", "HtmlContent", "MarkdownContent", "Amount", "Score")
MEANINGS = tuple(dict.fromkeys([*(r[-1] for r in TABLE_RULES), *(r[-1] for r in RULES), *FALLBACK.values(), *UNNAMED, "AutoIncrement", "EnumValue", "Unknown"]))


def spelled(pattern: str) -> list[str] | None:
    """All names that a pattern of whole names matches (alternatives, groups, classes and optional parts); None for an open one."""
    if not (pattern.startswith("^") and pattern.endswith("$")):
        return None
    body = pattern[1:-1]

    def options(at: int) -> tuple[list[str], int]:
        done: list[str] = []
        now = [""]
        while at < len(body) and body[at] != ")":
            if body[at] == "|":
                done, now, at = done + now, [""], at + 1
                continue
            if body[at] == "(":
                part, at = options(at + 1)
                at += 1
            elif body[at] == "[":
                end = body.index("]", at)
                part, at = list(body[at + 1 : end]), end + 1
            else:
                part, at = [body[at]], at + 1
            if at < len(body) and body[at] == "?":
                part, at = [*part, ""], at + 1
            now = [a + b for a in now for b in part]
        return done + now, at

    return list(dict.fromkeys(options(0)[0]))


#: Rules by the whole names that they match: (place, kinds or None, number of the table's pattern or -1, meaning), by place.
_WHOLE: dict[str, list[tuple[int, tuple[str, ...] | None, int, str]]] = defaultdict(list)
#: The other rules: (place, pattern, kinds or None, meaning).
_OPEN: list[tuple[int, str, tuple[str, ...] | None, str]] = []
for _at, (_pattern, _kinds, _table, _meaning) in enumerate([*((a, None, i, m) for i, (a, _, m) in enumerate(TABLE_RULES)), *((a, k and tuple(k), -1, m) for a, k, m in RULES)]):
    if (_names := spelled(_pattern)) is None:
        _OPEN.append((_at, _pattern, _kinds, _meaning))
    else:
        for _name in _names:
            _WHOLE[_name].append((_at, _kinds, _table, _meaning))
_TABLES = [re.compile(t) for _, t, _ in TABLE_RULES]
_OPEN_TESTS = [(at, re.compile(p), kinds, m) for at, p, kinds, m in _OPEN]


def is_personal(meaning: str) -> bool:
    """Whether a meaning tells about a person."""
    return meaning in PERSONAL


def group_of(meaning: str) -> str | None:
    return next((g for g, members in GROUPS.items() if meaning in members), None)


def normal_name(name: str) -> str:
    """Snake case: a capital after a lower-case letter starts a part; dashes are underscores."""
    return re.sub(r"(?<=[^\W\d_A-Z])(?=[A-Z])", "_", name).lower().replace("-", "_")


def _enum_meaning(name: str) -> str:
    if "status" in name or "state" in name:
        return "Status"
    if "role" in name:
        return "Role"
    if "priority" in name:
        return "Priority"
    return "Category" if "category" in name or "type" in name else "EnumValue"


def classify_column(name: str, type_: DataType, table: str, auto_increment: bool = False, in_key: bool = False, is_enum: bool = False) -> str:
    """Keys and enums first, then rules with a table, general rules, and the type."""
    if in_key and (auto_increment or type_.is_serial):
        return "AutoIncrement"
    if in_key and type_.kind == "uuid":
        return "Uuid"
    if is_enum:
        return _enum_meaning(normal_name(name))
    return _by_rules(name, type_.kind, table)


@lru_cache(maxsize=100_000)
def _by_rules(name: str, kind: str, table: str) -> str:
    """Names repeat over tables and schemas."""
    plain = normal_name(name)
    first = next(((at, m) for at, kinds, t, m in _WHOLE.get(plain, ()) if (kinds is None or kind in kinds) and (t < 0 or _TABLES[t].search(table))), None)
    for at, pattern, kinds, meaning in _OPEN_TESTS:
        if first and first[0] < at:
            break
        if (kinds is None or kind in kinds) and pattern.search(plain):
            return meaning
    return first[1] if first else FALLBACK.get(kind, "Unknown")


def classify_table(table: Table) -> dict[str, str]:
    def one(c: Column) -> str:
        return classify_column(c.name, c.type, table.name, c.auto_increment, c.name in table.primary_key, c.enum_values is not None)

    return {c.name: one(c) for c in table.columns.values()}


def classify_schema(schema: Schema) -> dict[tuple[str, str], str]:
    """(table, column) -> meaning, in order of table and column."""
    found = {(t.name, c): m for t in schema.tables.values() for c, m in classify_table(t).items()}
    return dict(sorted(found.items()))


def detect_groups(meanings: dict[str, str]) -> dict[str, list[str]]:
    """Groups of which a table has two columns or more, with these columns."""
    found: dict[str, list[str]] = defaultdict(list)
    for column, meaning in meanings.items():
        if group := group_of(meaning):
            found[group].append(column)
    return {g: c for g, c in found.items() if len(c) > 1}


def _plain_column(name: SparkColumn) -> SparkColumn:
    return F.replace(F.lower(F.regexp_replace(name, r"(\p{Ll})(\p{Lu})", "$1_$2")), F.lit("-"), F.lit("_"))


def meaning_column(name: SparkColumn, table: SparkColumn, kind: SparkColumn) -> SparkColumn:
    """The rules over a frame of column names, one after the other, for columns that are neither keys nor enums."""
    plain = _plain_column(name)
    out = None
    for pattern, tables, meaning in TABLE_RULES:
        test = plain.rlike(pattern) & table.rlike(tables)
        out = F.when(test, meaning) if out is None else out.when(test, meaning)
    for pattern, kinds, meaning in RULES:
        test = plain.rlike(pattern)
        out = out.when(test & kind.isin(*kinds) if kinds else test, meaning)
    for k, meaning in FALLBACK.items():
        out = out.when(kind == k, meaning)
    return out.otherwise("Unknown")


def classify_frame(columns: DataFrame) -> DataFrame:
    """``columns`` (table_name, column_name, kind and any others) with their ``meaning``; nothing is shuffled.

    Rules of whole names are a table of all these names (bounded by the rules), joined by broadcast; the few open rules
    are patterns. Nulls match no rule.
    """
    spark = columns.sparkSession
    named = spark.createDataFrame([(n, [(at, list(kinds) if kinds else None, t, m) for at, kinds, t, m in rules]) for n, rules in _WHOLE.items()], "_name string, _rules array<struct<at:int,kinds:array<string>,t:int,meaning:string>>")
    seen = columns.withColumn("_plain", _plain_column(F.col("column_name"))).join(F.broadcast(named), F.col("_plain") == F.col("_name"), "left")
    tables = F.array(*[F.coalesce(F.col("table_name").rlike(t), F.lit(False)) for _, t, _ in TABLE_RULES])
    seen = seen.withColumn("_tables", F.when(F.col("_rules").isNotNull(), tables))
    fits = F.filter("_rules", lambda x: (x["kinds"].isNull() | F.array_contains(x["kinds"], F.col("kind"))) & ((x["t"] < 0) | F.get("_tables", x["t"])))
    seen = seen.withColumn("_first", F.get(fits, F.lit(0)))
    out = None
    for at, pattern, kinds, meaning in _OPEN:
        test = F.col("_plain").rlike(pattern)
        out = F.when(F.col("_first.at") < at, F.col("_first.meaning")) if out is None else out.when(F.col("_first.at") < at, F.col("_first.meaning"))
        out = out.when(test & F.col("kind").isin(*kinds) if kinds else test, meaning)
    out = out.when(F.col("_first").isNotNull(), F.col("_first.meaning"))
    for k, meaning in FALLBACK.items():
        out = out.when(F.col("kind") == k, meaning)
    return seen.withColumn("meaning", out.otherwise("Unknown")).drop("_plain", "_name", "_rules", "_tables", "_first")
