"""A plug-in for classification of unknown columns by a language model.

The library makes no network calls: a caller gives a function from a prompt to an answer.
"""

from __future__ import annotations

import importlib
import json
import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import AIResponseError
from .plans.classify import MEANINGS
from .schema import Schema

#: A call gives up after this many seconds; passed on to the caller's function.
TIMEOUT_S = 45
LEAST_CONFIDENCE = 0.5


def provider_from_env(env: dict[str, str] | None = None) -> str | None:
    """Which provider's key the environment holds, if any."""
    env = os.environ if env is None else env
    return next((name for key, name in (("ANTHROPIC_API_KEY", "anthropic"), ("OPENAI_API_KEY", "openai")) if env.get(key)), None)


def plug_in(model: str | None = None, env: dict[str, str] | None = None) -> Callable[[str], str]:
    """The function that ``FURROW_ASK=module:function`` names, called as function(prompt, model=..., timeout=...)."""
    env = os.environ if env is None else env
    module, colon, name = env.get("FURROW_ASK", "").partition(":")
    if not colon:
        raise AIResponseError("asking a model needs a plug-in: set FURROW_ASK=module:function, called with (prompt, model=, timeout=)")
    try:
        function = getattr(importlib.import_module(module), name)
    except (ImportError, AttributeError) as e:
        raise AIResponseError(f"FURROW_ASK={module}:{name}: {e}") from e
    return lambda text: function(text, model=model, timeout=TIMEOUT_S)


def compact_ddl(schema: Schema) -> str:
    """One line for each table: columns with types, keys and references."""
    lines = []
    for t in schema.tables.values():
        refs = {c: f" -> {k.parent}.{p}" for k in t.foreign_keys for c, p in zip(k.columns, k.parent_columns, strict=False)}
        parts = [f"{c.name} {c.type}{' pk' if c.name in t.primary_key else ''}{'' if c.nullable else ' not null'}{refs.get(c.name, '')}" for c in t.columns.values()]
        lines.append(f"{t.name}({', '.join(parts)})")
    return "\n".join(lines)


def prompt(schema: Schema, unknown: list[tuple[str, str]]) -> str:
    return (
        "Say what each listed column holds. Choose from: " + ", ".join(MEANINGS) + ".\n"
        'Answer with a JSON array of objects {"table": ..., "column": ..., "semantic_type": ..., "confidence": 0 to 1}.\n\n'
        "Schema:\n" + compact_ddl(schema) + "\n\nColumns:\n" + "\n".join(f"{t}.{c}" for t, c in unknown) + "\n"
    )


def parse_answer(text: str) -> list[dict]:
    """The answer's rows: from a fenced block, the outermost array, or the whole text. Rows that aren't valid are dropped."""
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    span = re.search(r"\[\s*(?:\{.*\}\s*)?\]", text, re.S)
    for candidate in (fenced and fenced[1], span and span[0], text):
        if not candidate:
            continue
        try:
            rows = json.loads(candidate)
        except ValueError:
            continue
        if isinstance(rows, list):
            keep = [r for r in rows if isinstance(r, dict) and isinstance(r.get("table"), str) and isinstance(r.get("column"), str) and r.get("semantic_type") in MEANINGS]
            return [{**r, "confidence": float(c) if isinstance(c := r.get("confidence", 0), (int, float)) else 0.0} for r in keep]
    raise AIResponseError(f"no JSON array in {text[:200]!r}")


def merge(meanings: dict[tuple[str, str], str], answer: list[dict]) -> dict[tuple[str, str], str]:
    """The rules' meanings, with Unknown replaced where the answer is confident enough."""
    said = {(r["table"], r["column"]): r["semantic_type"] for r in answer if r["confidence"] >= LEAST_CONFIDENCE}
    return {k: said.get(k, m) if m == "Unknown" else m for k, m in meanings.items()}


def changed(before: dict[tuple[str, str], str], after: dict[tuple[str, str], str]) -> dict[str, str]:
    """What an answer changed, as ``table.column`` -> meaning."""
    return {f"{t}.{c}": m for (t, c), m in after.items() if before.get((t, c)) != m}


def restore(meanings: dict[tuple[str, str], str], kept: dict[str, str]) -> dict[tuple[str, str], str]:
    """Meanings that a lock kept, where the rules still say Unknown."""
    return {(t, c): kept.get(f"{t}.{c}", m) if m == "Unknown" else m for (t, c), m in meanings.items()}


def merge_frames(meanings: DataFrame, answer: DataFrame) -> DataFrame:
    """``merge`` over frames: (table_name, column_name, meaning) and (table_name, column_name, semantic_type, confidence)."""
    said = answer.filter(F.coalesce("confidence", F.lit(0.0)) >= LEAST_CONFIDENCE).select(F.col("table_name").alias("t"), F.col("column_name").alias("c"), "semantic_type")
    both = meanings.join(said, (F.col("table_name") == F.col("t")) & (F.col("column_name") == F.col("c")), "left")
    return both.select("table_name", "column_name", F.when(F.col("meaning") == "Unknown", F.coalesce("semantic_type", "meaning")).otherwise(F.col("meaning")).alias("meaning"))


def classify(schema: Schema, meanings: dict[tuple[str, str], str], ask: Callable[[str], str], cache: str | None = None, key: str = "") -> dict[tuple[str, str], str]:
    """Ask about all unknown columns; answers are kept in the ``cache`` folder under the schema's hash."""
    unknown = [k for k, m in meanings.items() if m == "Unknown"]
    if not unknown:
        return meanings
    path = os.path.join(cache, f"{key}.json") if cache and key else None
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            text = f.read()
    else:
        text = ask(prompt(schema, unknown))
    answer = parse_answer(text)
    if path and not os.path.exists(path):
        os.makedirs(cache, exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    return merge(meanings, answer)
