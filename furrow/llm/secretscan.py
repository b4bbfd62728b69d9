"""Secret scans by assignment-aware lexing (operator 2).

Three fixed patterns give the base spans. The method adds spans of kind ``lexed``: a lexer reads the text as source or
configuration syntax and yields pairs of a name and a literal (``name = "x"``, ``name: x``, ``"name": "x"``,
``name="x"``, ``export NAME=x``, ``name := "a" + "b"``, ``name: |`` with an indented block), with string prefixes, triple
quotes and continued lines; in comments as well, since secrets lie there too. A name on the right side, alone or in a
concatenation, stands for the constant that the name was last set to before that place (an assignment further down
says nothing about it). A value is scored joined, by the sensitivity of its target's name times how much it looks like
a key, and the spans of its pieces, and of those of the constants in it, are reported from ``THRESHOLD`` on.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

KINDS = ("assign", "access", "hex", "lexed")

_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

#: Parts of names that say a value is secret, and how surely (fixed values of this operator).
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "accesskey": 1.0,
    "secretkey": 1.0, "privatekey": 1.0, "authkey": 1.0, "signingkey": 1.0, "encryptionkey": 1.0, "credential": 0.9, "credentials": 0.9,
    "bearer": 0.8, "auth": 0.6, "key": 0.5, "salt": 0.5, "cookie": 0.5, "connectionstring": 0.8,
}
THRESHOLD = 0.45
#: Pieces shorter than this are not reported beside a piece that reaches the threshold by itself.
SCRAP = 4

#: A literal's placeholders, which are nobody's secret.
_PLACEHOLDER = re.compile(r"(?i)^(?:<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s|change.?me|your.*|example.*|todo|none|null|true|false|undefined|redacted)$")
#: Placeholders of one character again and again, and how often it must stand there.
_RUNS = {"x": 3, "*": 1, ".": 3}

#: Sensitive stems; a text without any can't hold a sensitive name, so the lexer may pass it by.
_STEMS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "auth", "salt", "cookie", "connection")
_ASSIGN_STEMS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_SIGN = re.compile(r":=|=>|[:=](?!=)")
_BLANKS = re.compile(r"(?:[ \t]|\\\r?\n)*")
_OPEN = re.compile(r"""((?:[rbuftRBUFT]{1,2}|u8|[LU@$])?)(\"{3}|'{3}|["'`])""")
_STRINGS = {'"': re.compile(r'(?:[^"\\\n]|\\(?:\r\n|[\s\S]))*"'), "'": re.compile(r"(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*'"), "`": re.compile(r"[^`\n]*`")}
_BARE = re.compile(r"""[^\s"'`,;)\]}#]+""")
_PLUS = re.compile(r"(?:\s|\\\r?\n)*\+(?![+=])(?:\s|\\\r?\n)*")
_PLUS_NEAR = re.compile(r"(?:[ \t]|\\\r?\n)*\+(?![+=])(?:\s|\\\r?\n)*")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.\-]*\Z")
_LEADING = re.compile(r"[^A-Za-z_]*")
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")
#: A formatted string that is one field has no literal.
_FIELD = re.compile(r"\{[^{}]*\}\Z")
#: Characters kept of both ends of a value; no placeholder but one with ``.*`` is as long.
_ENDS = 16
#: Numbers of characters keep at least so many binary digits, far more than a double.
_DIGITS = 256
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def name_score(name: str) -> float:
    """The highest sensitivity of a name's parts, and of two neighbouring parts taken as one."""
    parts = [p for p in re.split(r"[_.\-]+", _CAMEL.sub("_", name).lower()) if p]
    pairs = [a + b for a, b in zip(parts, parts[1:], strict=False)]
    return max((SENSITIVE.get(p, 0.0) for p in [*parts, *pairs]), default=0.0)


class Value:
    """What scoring needs of a value of any length: how often each character stands in it, and both ends.

    Counts are in units of two to the ``shift``, so that constants doubled again and again stay small numbers.
    """

    __slots__ = ("counts", "shift", "head", "tail")

    def __init__(self, counts: dict[str, int], shift: int, head: str, tail: str) -> None:
        self.counts, self.shift, self.head, self.tail = counts, shift, head, tail

    @classmethod
    def of(cls, text: str) -> Value:
        return cls(Counter(text), 0, text[:_ENDS], text[-_ENDS:])

    @classmethod
    def join(cls, values: list[Value]) -> Value:
        shift = max((v.shift for v in values), default=0)
        counts: dict[str, int] = {}
        for v in values:
            for c, n in v.counts.items():
                counts[c] = counts.get(c, 0) + (n >> (shift - v.shift))
        if (more := sum(counts.values()).bit_length() - 2 * _DIGITS) > 0:
            more += _DIGITS
            counts, shift = {c: n >> more for c, n in counts.items()}, shift + more
        return cls(counts, shift, "".join(v.head for v in values)[:_ENDS], "".join(v.tail for v in values)[-_ENDS:])

    def placeholder(self) -> bool:
        """Whether the whole value is one; a line end is allowed as its last character only."""
        n, ends = sum(self.counts.values()), self.tail.endswith("\n")
        kinds = {c.lower() for c in self.counts if c != "\n"}
        if "\n" in self.counts and (self.shift or self.counts["\n"] > ends):
            return False
        if len(kinds) == 1 and (c := next(iter(kinds))) in _RUNS:
            return bool(self.shift) or n - ends >= _RUNS[c]
        whole = self.head if not self.shift and n <= _ENDS else self.head + self.tail
        return bool(_PLACEHOLDER.match(whole))

    def score(self) -> float:
        """From 0 to 1: length, entropy of characters and mix of kinds."""
        n = sum(self.counts.values())
        if (n < 6 and not self.shift) or self.placeholder():
            return 0.0
        shares = [c / n for c in self.counts.values()]
        entropy = -sum(p * math.log2(p) for p in shares if p)
        chars = "".join(self.counts)
        kinds = sum(bool(re.search(p, chars)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
        length = 1.0 if self.shift else min(n, 16) / 16
        return length * min(1.0, entropy / 3.0) * (0.4 + 0.2 * min(3, kinds))


def literal_score(value: str) -> float:
    """The score of a literal that stands in one piece; all of its characters count."""
    return Value.of(value).score()


Piece = tuple[int, int, str, bool]


def _name_before(text: str, sign: int, at: int) -> str | None:
    """The name, quoted or not, that ends before a sign and begins at ``at`` or later."""
    end = sign
    while end > at and (text[end - 1] in " \t" or (text[end - 1] == "\n" and text[max(at, end - 3) : end].replace("\r", "").endswith("\\\n"))):
        end -= 1 if text[end - 1] in " \t" else 3 if text[end - 2] == "\r" else 2
    quote = text[end - 1] if end > at and text[end - 1] in "\"'" else ""
    end -= len(quote)
    start = end
    while start > at and text[start - 1] in _NAME_CHARS:
        start -= 1
    if quote:
        if start == at or text[start - 1] != quote or not _NAME.match(text[start:end]):
            return None
        return text[start:end]
    return text[_LEADING.match(text, start, end).end() : end] or None


def _operand(text: str, at: int, unclosed: set[str]) -> tuple[Piece, int] | None:
    """A string or bare word at a place and where it ends; ``unclosed`` keeps triple quotes that close nowhere further on."""
    m = _OPEN.match(text, at)
    if m:
        prefix, quote = m.groups()
        if len(quote) == 3:
            close = -1 if quote in unclosed else text.find(quote, m.end())
            while close > 0 and text[close - 1] == "\\" and (close - len(text[m.end() : close].rstrip("\\")) - m.end()) % 2:
                close = text.find(quote, close + 1)
            if close >= 0:
                return (m.end(), close, text[m.end() : close], False), close + 3
            unclosed.add(quote)
            return (m.end(), m.end(), "", False), m.end()
        if c := _STRINGS[quote].match(text, m.end()):
            value = text[m.end() : c.end() - 1]
            if "f" in prefix.lower() and _FIELD.match(value):
                value = ""
            return (m.end(), m.end() + len(value), value, False), c.end()
    if not (m := _BARE.match(text, at)):
        return None
    end, value = m.end(), m[0]
    if value.endswith("+") and _NAME.match(value[:-1]) and _OPEN.match(text, _BLANKS.match(text, end).end()):
        end, value = end - 1, value[:-1]
    return (at, end, value, bool(_NAME.match(value))), end


#: A block under a key: the sign of one, and indented lines.
_BLOCK = re.compile(r"[|>][-+]?[ \t]*\r?\n((?:[ \t]+[^\s][^\n]*(?:\n|\Z))+)")
_LINE = re.compile(r"[ \t]+(\S(?:[^\n]*\S)?)\s*?(?:\n|\Z)")


def lex(text: str) -> Iterator[tuple[str, int, list[Piece]]]:
    """Pairs in a text: the target's name, the value's place, and its pieces (start, end, value, whether it may be a name)."""
    at, unclosed, sign = 0, set(), _SIGN.search(text)
    while sign:
        name = _name_before(text, sign.start(), at)
        start = _BLANKS.match(text, sign.end()).end()
        if name and text[sign.start()] == ":" and (block := _BLOCK.match(text, start)):
            yield name, start, [(m.start(1), m.end(1), m[1], False) for m in _LINE.finditer(text, block.start(1), block.end(1))]
            at = block.end()
            sign = _SIGN.search(text, at)
            continue
        found = _operand(text, start, unclosed) if name else None
        if not found:
            sign = _SIGN.search(text, sign.end())
            continue
        pieces, end = [found[0]], found[1]
        while True:
            string = text[end - 1] in "\"'`"
            plus = (_PLUS if string else _PLUS_NEAR).match(text, end)
            more = _operand(text, plus.end(), unclosed) if plus else None
            if not more or not (more[0][3] or _OPEN.match(text, plus.end())):
                break
            pieces.append(more[0])
            end = more[1]
        yield name, start, [p for p in pieces if p[2]]
        # a value that is itself a name may head a pair of its own ("export: name = ..."), so go on at the value
        at = start if len(pieces) == 1 and pieces[0][3] else end
        sign = _SIGN.search(text, at)


def _may_hold(lowered: str, stems: tuple[str, ...]) -> bool:
    """False only where no assignment to a name with one of the stems can be."""
    return ("=" in lowered or ":" in lowered) and any(s in lowered for s in stems)


class _Constants:
    """The pairs of a text in order, and what a name stands for at a place: the last pair with that name before it."""

    def __init__(self, text: str) -> None:
        pairs = list(lex(text))
        self.names = [name for name, _, _ in pairs]
        self.at: dict[str, tuple[list[int], list[int]]] = {}
        self.pieces: list[list[tuple[Piece, int]]] = []
        #: what a name's last value is made of, each joined value's score, and the pair that a value of one name leads to in the end
        last: dict[str, Value] = {}
        self.score: list[float] = []
        self.root: list[int] = []
        for i, (name, start, pieces) in enumerate(pairs):
            told = [(p, self.behind(p)) for q in pieces for p in self._parts(q)]
            self.pieces.append(told)
            alone = len(told) == 1
            self.root.append(self.root[told[0][1]] if alone and told[0][1] >= 0 else i)
            # in a concatenation, a name that stands for nothing known adds nothing
            parts = [last[p[2]] if k >= 0 else Value.of(p[2]) for p, k in told if k >= 0 or alone or not p[3]]
            value = parts[0] if alone else Value.join(parts)
            last[name] = value
            self.score.append(0.0 if alone else value.score())
            places, numbers = self.at.setdefault(name, ([], []))
            places.append(start)
            numbers.append(i)

    def behind(self, piece: Piece) -> int:
        """The number of the pair that a name refers to, or -1."""
        if not piece[3] or piece[2] not in self.at:
            return -1
        places, numbers = self.at[piece[2]]
        k = bisect_left(places, piece[0])
        return numbers[k - 1] if k else -1

    def _parts(self, piece: Piece) -> Iterator[Piece]:
        """The names of a bare sum like ``A+B``, if all are set before; else the piece itself."""
        start, _, value, _ = piece
        parts = value.split("+") if "+" in value else []
        if parts and all(p in self.at for p in parts):
            for p in parts:
                yield start, start + len(p), p, True
                start += len(p) + 1
        else:
            yield piece


def lexed_spans(text: str) -> list[tuple[int, int]]:
    """Spans of literals that belong to sensitive names, in order."""
    if not _may_hold(text.lower(), _STEMS):
        return []
    known = _Constants(text)
    weights = {name: name_score(name) for name in set(known.names)}
    found: set[tuple[int, int]] = set()
    reached: set[int] = set()
    for i, name in enumerate(known.names):
        if not weights[name]:
            continue
        pieces = known.pieces[known.root[i]]
        literals = [p for p, k in pieces if k < 0 and (len(pieces) == 1 or not p[3])]
        mine = {p for p in literals if weights[name] * literal_score(p[2]) >= THRESHOLD}
        if len(pieces) > 1 and weights[name] * known.score[known.root[i]] >= THRESHOLD:
            reached |= {k for _, k in pieces if k >= 0}
            # a scrap beside a piece that is a secret by itself is none
            mine |= {p for p in literals if not mine or len(p[2]) >= SCRAP}
        found.update((p[0], p[1]) for p in mine)
    # all literals behind the names in values that were reported joined; they lie further up
    todo = list(reached)
    while todo:
        pieces = known.pieces[todo.pop()]
        for p, k in pieces:
            if k < 0:
                if len(pieces) == 1 or not p[3]:
                    found.add((p[0], p[1]))
            elif k not in reached:
                reached.add(k)
                todo.append(k)
    return sorted(found)


def scan(text: str | None) -> list[tuple[int, int, int]]:
    """All spans of a text as (start, kind's place in ``KINDS``, end), sorted; ends exclude, places count code points."""
    if not text:
        return []
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6] if _may_hold(text.lower(), _ASSIGN_STEMS) else []
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    out += [(s, 3, e) for s, e in lexed_spans(text)]
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with each stretch of overlapping or touching spans replaced by a mark."""
    spans = scan(text)
    if not spans:
        return text
    out, at = [], 0
    stretches: list[list[int]] = []
    for s, _, e in spans:
        if stretches and s <= stretches[-1][1]:
            stretches[-1][1] = max(stretches[-1][1], e)
        else:
            stretches.append([s, e])
    for s, e in stretches:
        out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """``docs`` without the text, with ``spans``: array of structs (kind, start, end).

    Null and empty texts have an empty array. Other columns and repeated rows pass unchanged. Nothing is shuffled.
    """
    keep = [f for f in docs.schema.fields if f.name not in (text, spans)]
    names = [f.name for f in keep]
    item = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([*keep, T.StructField(spans, T.ArrayType(item))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, text):
                found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scan(t)] for t in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(found, kind)], names=[*names, spans])

    return common.map_arrow(docs.select(*names, text), run, schema)


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret's span replaced by a mark, and ``n_chars`` (if there) the new length; rows are kept.

    Null stays null and texts without secrets are untouched, with the ``n_chars`` they came with.
    """
    names = docs.columns
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                old = part.column("text").to_pylist()
                new = [redact(t) for t in old]
                columns = {n: part.column(n) for n in names}
                columns["text"] = pa.array(new, part.schema.field("text").type)
                if "n_chars" in columns:
                    had = columns["n_chars"].to_pylist()
                    columns["n_chars"] = pa.array([h if a is b else len(b) for h, a, b in zip(had, old, new, strict=True)], part.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return common.map_arrow(docs, run, schema)


def secret_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_lexed, base_sha256 and spans of every document; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                found = [scan(t) for t in part.column("text").to_pylist()]
                base = [[x for x in f if x[1] < 3] for f in found]
                counts = [pa.array([sum(x[1] == k for x in f) for f in found], pa.int64()) for k in range(4)]
                digests = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, digests, pa.array([joined(f) for f in found])], names=["doc_id", "n_assign", "n_access", "n_hex", "n_lexed", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_lexed long, base_sha256 string, spans string")
