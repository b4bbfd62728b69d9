"""Values of every meaning as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.draws import Draws, later
from ..schema import Check

FIRST_NAMES = ["Ada", "Amara", "Anton", "Beatriz", "Carlos", "Chen", "Dana", "Elif", "Emeka", "Fatima", "Georg", "Hana", "Ines", "Ivan", "Jonas", "Kaito", "Lena", "Leo", "Maria", "Mina", "Noor", "Olga", "Pablo", "Rosa", "Sami", "Tara", "Uma", "Viktor", "Wen", "Yara"]
LAST_NAMES = ["Abbas", "Adeyemi", "Becker", "Costa", "Diaz", "Eriksen", "Fischer", "Garcia", "Haddad", "Ito", "Jansen", "Kaya", "Kim", "Kowalski", "Lopez", "Meyer", "Moreau", "Nguyen", "Okafor", "Petrov", "Rossi", "Santos", "Sato", "Silva", "Singh", "Tanaka", "Urban", "Varga", "Weber", "Yilmaz"]
WORDS = ["amber", "basin", "cedar", "delta", "ember", "field", "grove", "harbor", "island", "jade", "kite", "lantern", "meadow", "north", "ocean", "prairie", "quartz", "river", "stone", "timber", "upland", "valley", "willow", "yarrow", "zephyr", "bright", "calm", "deep", "early", "gentle"]
COMPANY_ENDS = ["Group", "Partners", "Industries", "Labs", "Works", "Trading"]
PROFESSIONS = ["Accountant", "Analyst", "Architect", "Baker", "Chemist", "Designer", "Editor", "Electrician", "Engineer", "Farmer", "Geologist", "Librarian", "Nurse", "Pharmacist", "Pilot", "Plumber", "Surveyor", "Teacher", "Translator", "Welder"]
INDUSTRIES = ["Agriculture", "Banking", "Construction", "Education", "Energy", "Forestry", "Healthcare", "Insurance", "Logistics", "Manufacturing", "Media", "Mining", "Retail", "Software", "Telecommunications", "Tourism"]
CITIES = ["Aarhus", "Bergen", "Cork", "Dresden", "Evora", "Fukuoka", "Ghent", "Haifa", "Izmir", "Jaipur", "Kigali", "Lyon", "Malmo", "Nagoya", "Oulu", "Porto", "Quito", "Riga", "Turin", "Utrecht"]
STATES = ["Alabama", "Colorado", "Delaware", "Georgia", "Idaho", "Kansas", "Maine", "Nebraska", "Ohio", "Utah", "Vermont", "Wyoming"]
COUNTRIES = ["Austria", "Brazil", "Canada", "Denmark", "Estonia", "Finland", "Ghana", "Hungary", "India", "Japan", "Kenya", "Latvia"]
COUNTRY_CODES = ["AT", "BR", "CA", "DK", "EE", "FI", "GH", "HU", "IN", "JP", "KE", "LV"]
USER_AGENTS = ["Mozilla/5.0 (X11; Linux x86_64)", "Mozilla/5.0 (Windows NT 10.0; Win64; x64)", "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7)", "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X)"]

# The domains of meanings with a closed list.
DIAL_CODES = ["+1", "+44", "+49", "+33", "+81", "+86", "+91", "+55", "+61"]
DEPARTMENTS = ["Engineering", "Sales", "Marketing", "Product", "Design", "HR", "Finance", "Legal", "Operations", "Support"]
FILE_ENDS = ["pdf", "docx", "xlsx", "png", "jpg"]
NAME_ENDS = ["pdf", "docx", "xlsx", "png", "jpg", "csv", "txt"]
MIME_TYPES = ["application/pdf", "image/png", "image/jpeg", "text/plain", "application/json", "text/html", "application/xml"]
CURRENCIES = ["USD", "EUR", "GBP", "JPY", "CAD", "AUD", "CHF"]
STATUSES = ["active", "inactive", "pending", "suspended"]
ROLES = ["admin", "user", "moderator", "editor", "viewer"]
PRIORITIES = ["low", "medium", "high", "critical"]
JSON_KEYS = ["metadata", "preferences", "flags", "raw_payload"]
COLORS = ["red", "blue", "green", "yellow", "purple", "orange", "pink", "black", "white", "gray", "brown", "cyan", "magenta", "teal"]
LOCALES = ["en_US", "en_GB", "de_DE", "fr_FR", "es_ES", "ja_JP", "zh_CN", "pt_BR"]
TIMEZONES = ["America/New_York", "America/Chicago", "America/Los_Angeles", "Europe/London", "Europe/Berlin", "Asia/Tokyo", "Asia/Shanghai", "Australia/Sydney", "America/Sao_Paulo"]


@dataclass(frozen=True)
class Context:
    """What a value may depend on besides its draws."""

    draws: Draws
    column: str
    base_time: Column
    checks: tuple[Check, ...] = ()

    @property
    def row(self) -> Column:
        return self.draws.id


def bounds(low: float, high: float, checks: tuple[Check, ...], step: float) -> tuple[float, float]:
    """Bounds narrowed by checks; a strict one moves by a step. Checks that contradict leave a range of 100 above the lower one."""
    for c in checks:
        if not isinstance(c.value, (int, float)):
            continue
        if c.form in (">=", ">"):
            low = max(low, c.value + (step if c.form == ">" else 0))
        elif c.form in ("<=", "<"):
            high = min(high, c.value - (step if c.form == "<" else 0))
    return (low, high) if low <= high else (low, low + 100)


def _words(c: Context, low: int, high: int, k: int = 0, sep: str = " ") -> Column:
    """From ``low`` to below ``high`` words."""
    words = F.array(*[c.draws.pick(WORDS, c.column, k + i) for i in range(high - 1)])
    return F.array_join(F.slice(words, F.lit(1), c.draws.integer(low, high, c.column, k + 50).cast("int")), sep)


def _sentence(c: Context, low: int, high: int, k: int) -> Column:
    text = _words(c, low, high, k)
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 10_000), F.lit("."))


def _sentences(c: Context, low: int, high: int, k: int, sep: str = " ") -> Column:
    """From ``low`` to below ``high`` sentences."""
    made = F.array(*[_sentence(c, 4, 9, k + 100 * (i + 1)) for i in range(high - 1)])
    return F.array_join(F.slice(made, F.lit(1), c.draws.integer(low, high, c.column, k + 60).cast("int")), sep)


def _title(c: Context, low: int = 3, high: int = 8) -> Column:
    text = _words(c, low, high)
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 10_000))


def _full_name(c: Context) -> Column:
    return F.concat_ws(" ", c.draws.pick(FIRST_NAMES, c.column, 0), c.draws.pick(LAST_NAMES, c.column, 1))


def _back(c: Context, low: int, high: int, clock: bool = False) -> Column:
    draw = c.draws.integer
    back = -draw(low, high, c.column, 0)
    return later(c.base_time, back, draw(0, 24, c.column, 1), draw(0, 60, c.column, 2)) if clock else later(c.base_time, back)


def _days(c: Context, low: int, high: int) -> Column:
    return F.date_add(c.base_time.cast("date"), c.draws.integer(low, high, c.column, 0).cast("int"))


def _uniform(c: Context, low: float, high: float, places: int) -> Column:
    return F.round(c.draws.between(low, high, c.column), places)


def _price(c: Context) -> Column:
    low, high = bounds(0.01, 999.99, c.checks, 0.01)
    return _uniform(c, low, high, 2)


def _quantity(c: Context) -> Column:
    low, high = bounds(1, 100, c.checks, 1)
    return c.draws.integer(int(low), int(high) + 1, c.column)


def _zip(c: Context) -> Column:
    return F.lpad(c.draws.integer(501, 99951, c.column).cast("string"), 5, "0")


def _numbered(prefix: str, width: int) -> Callable[[Context], Column]:
    return lambda c: F.format_string(f"{prefix}%0{width}d", c.row + 1)


def _time(c: Context) -> Column:
    two = lambda high, k: F.lpad(c.draws.integer(0, high, c.column, k).cast("string"), 2, "0")
    return F.concat_ws(":", two(24, 0), two(60, 1), two(60, 2))


def _hex_pairs(c: Context, n: int, sep: str) -> Column:
    pairs = [F.lpad(F.lower(F.hex(c.draws.integer(0, 256, c.column, k))), 2, "0") for k in range(n)]
    return F.concat_ws(sep, *pairs) if sep else F.concat(*pairs)


def _json(c: Context) -> Column:
    rest = F.concat(F.lit('":"'), c.draws.alphanumeric(8, c.column), F.lit('","processed":'), F.when(c.draws.uniform(c.column, 1) < 0.8, "true").otherwise("false"))
    return F.concat(F.lit('{"'), c.draws.pick(JSON_KEYS, c.column), rest, F.lit(',"retries":'), c.draws.integer(0, 5, c.column, 2).cast("string"), F.lit("}"))


def _picked(values: list[str]) -> Callable[[Context], Column]:
    return lambda c: c.draws.pick(values, c.column)


#: Meaning -> (kind of value, expression).
PROVIDERS: dict[str, tuple[str, Callable[[Context], Column]]] = {
    "FirstName": ("string", _picked(FIRST_NAMES)),
    "LastName": ("string", _picked(LAST_NAMES)),
    "FullName": ("string", _full_name),
    "Username": ("string", lambda c: F.concat(F.lower(c.draws.pick(FIRST_NAMES, c.column)), c.row.cast("string"))),
    "DisplayName": ("string", _full_name),
    "Email": ("string", lambda c: F.concat(F.lower(c.draws.pick(FIRST_NAMES, c.column)), F.lit("."), c.row.cast("string"), F.lit("@example.com"))),
    "Phone": ("string", lambda c: F.concat(F.lit("555-"), F.lpad(c.draws.integer(0, 10_000_000, c.column).cast("string"), 7, "0"))),
    "PhoneCountryCode": ("string", _picked(DIAL_CODES)),
    "StreetAddress": ("string", lambda c: F.concat(c.draws.integer(1, 1000, c.column, 1).cast("string"), F.lit(" "), F.initcap(c.draws.pick(WORDS, c.column)), F.lit(" Street"))),
    "City": ("string", _picked(CITIES)),
    "State": ("string", _picked(STATES)),
    "ZipCode": ("string", _zip),
    "PostalCode": ("string", _zip),
    "Country": ("string", _picked(COUNTRIES)),
    "CountryCode": ("string", _picked(COUNTRY_CODES)),
    "Latitude": ("double", lambda c: _uniform(c, -90, 90, 6)),
    "Longitude": ("double", lambda c: _uniform(c, -180, 180, 6)),
    "CompanyName": ("string", lambda c: F.concat_ws(" ", F.initcap(c.draws.pick(WORDS, c.column)), c.draws.pick(COMPANY_ENDS, c.column, 1))),
    "JobTitle": ("string", _picked(PROFESSIONS)),
    "Department": ("string", _picked(DEPARTMENTS)),
    "Industry": ("string", _picked(INDUSTRIES)),
    "Url": ("string", lambda c: F.concat(F.lit("https://example-"), c.row.cast("string"), F.lit("."), c.draws.pick(["com", "net", "org"], c.column))),
    "DomainName": ("string", lambda c: F.concat(c.draws.pick(WORDS, c.column), F.lit(".example.com"))),
    "IpAddress": ("string", lambda c: F.concat_ws(".", *[c.draws.integer(1, 255, c.column, k).cast("string") for k in range(4)])),
    "MacAddress": ("string", lambda c: _hex_pairs(c, 6, ":")),
    "UserAgent": ("string", _picked(USER_AGENTS)),
    "Slug": ("string", lambda c: _words(c, 2, 4, sep="-")),
    "Title": ("string", _title),
    "Description": ("string", lambda c: _sentences(c, 2, 4, 0)),
    "Bio": ("string", lambda c: _sentences(c, 1, 3, 0)),
    "Paragraph": ("string", lambda c: _sentences(c, 1, 3, 0, "\n\n")),
    "Sentence": ("string", lambda c: _sentence(c, 5, 12, 0)),
    "HtmlContent": ("string", lambda c: F.concat(F.lit("<p>"), _sentences(c, 2, 5, 0), F.lit("</p>"))),
    "MarkdownContent": ("string", lambda c: F.concat(F.lit("# "), _title(c), F.lit("\n\n"), _sentences(c, 2, 4, 1000))),
    "ImageUrl": ("string", lambda c: F.concat(F.lit("https://images.example.com/"), c.row.cast("string"), F.lit("/800/600"))),
    "AvatarUrl": ("string", lambda c: F.concat(F.lit("https://avatars.example.com/"), c.row.cast("string"))),
    "ThumbnailUrl": ("string", lambda c: F.concat(F.lit("https://images.example.com/"), c.row.cast("string"), F.lit("/200/200"))),
    "FileUrl": ("string", lambda c: F.concat(F.lit("https://cdn.example.com/files/file_"), c.row.cast("string"), F.lit("."), c.draws.pick(FILE_ENDS, c.column))),
    "FileName": ("string", lambda c: F.concat(_words(c, 1, 3, sep="_"), F.lit("."), c.draws.pick(NAME_ENDS, c.column, 70))),
    "MimeType": ("string", _picked(MIME_TYPES)),
    "FileSize": ("bigint", lambda c: c.draws.integer(1024, 10_485_760, c.column)),
    "Price": ("double", _price),
    "Amount": ("double", _price),
    "Currency": ("string", _picked(CURRENCIES)),
    "CurrencyCode": ("string", _picked(CURRENCIES)),
    "Percentage": ("double", lambda c: _uniform(c, 0, 100, 2)),
    "CreatedAt": ("timestamp", lambda c: _back(c, 1, 365, clock=True)),
    "Timestamp": ("timestamp", lambda c: _back(c, 1, 365, clock=True)),
    "UpdatedAt": ("timestamp", lambda c: _back(c, 0, 30)),
    "DeletedAt": ("timestamp", lambda c: _back(c, 0, 7)),
    "StartDate": ("date", lambda c: _days(c, -30, 90)),
    "EndDate": ("date", lambda c: _days(c, 30, 180)),
    "BirthDate": ("date", lambda c: F.date_sub(c.base_time.cast("date"), (c.draws.integer(18, 80, c.column) * 365 + c.draws.integer(0, 365, c.column, 1)).cast("int"))),
    "DateOnly": ("date", lambda c: _days(c, -365, 365)),
    "TimeOnly": ("string", _time),
    "PasswordHash": ("string", lambda c: F.concat(F.lit("$2b$12$"), c.draws.alphanumeric(53, c.column))),
    "Token": ("string", lambda c: c.draws.alphanumeric(32, c.column)),
    "ApiKey": ("string", lambda c: c.draws.alphanumeric(32, c.column)),
    "SecretKey": ("string", lambda c: c.draws.alphanumeric(32, c.column)),
    "Uuid": ("string", lambda c: c.draws.uuid(c.column)),
    "AutoIncrement": ("bigint", lambda c: c.row + 1),
    "ExternalId": ("string", lambda c: F.concat(F.lit("ext_"), c.draws.alphanumeric(12, c.column))),
    "Sku": ("string", _numbered("SKU-", 6)),
    "OrderNumber": ("string", _numbered("ORD-", 8)),
    "InvoiceNumber": ("string", _numbered("INV-", 8)),
    "TrackingNumber": ("string", lambda c: F.concat(F.lit("TRK"), F.upper(c.draws.alphanumeric(16, c.column)))),
    "Status": ("string", _picked(STATUSES)),
    "Role": ("string", _picked(ROLES)),
    "Priority": ("string", _picked(PRIORITIES)),
    "Category": ("string", _picked(WORDS)),
    "Tag": ("string", _picked(WORDS)),
    "BooleanFlag": ("boolean", lambda c: c.draws.uniform(c.column) < 0.7),
    "EnumValue": ("string", lambda c: F.lit("unknown")),
    "Quantity": ("bigint", _quantity),
    "Rating": ("double", lambda c: _uniform(c, 1, 5, 1)),
    "Score": ("bigint", lambda c: c.draws.integer(0, 101, c.column)),
    "Weight": ("double", lambda c: _uniform(c, 0.1, 100, 2)),
    "Height": ("double", lambda c: _uniform(c, 50, 250, 1)),
    "Age": ("bigint", lambda c: c.draws.integer(18, 90, c.column)),
    "Duration": ("bigint", lambda c: c.draws.integer(1, 3600, c.column)),
    "SortOrder": ("bigint", lambda c: c.row),
    "JsonData": ("string", _json),
    "Color": ("string", _picked(COLORS)),
    "HexColor": ("string", lambda c: F.concat(F.lit("#"), _hex_pairs(c, 3, ""))),
    "Locale": ("string", _picked(LOCALES)),
    "Timezone": ("string", _picked(TIMEZONES)),
    "Unknown": ("string", _picked(WORDS)),
}
#: Meanings whose values differ from row to row.
DISTINCT = ("Username", "Email", "Url", "ImageUrl", "AvatarUrl", "ThumbnailUrl", "FileUrl", "AutoIncrement", "Sku", "OrderNumber", "InvoiceNumber", "SortOrder", "Uuid")
