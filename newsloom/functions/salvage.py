"""Lenient parsing of model output: JSON in fences, within text, cut off, or one object a line."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType

from newsloom.schemas import fields

_S = StringType()
ANALYSIS = fields(summary=_S, relevant=BooleanType(), relevance_score=DoubleType(), priority=_S, assigned_aks=ArrayType(_S), tags=ArrayType(_S), reasoning=_S)
_SUMMARY = re.compile(r'"summary"\s*:\s*"((?:[^"\\]|\\.)*)(?:"|$)')


def _loads(text: str) -> dict | None:
    try:
        found = json.loads(text)
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def unfenced(text: str) -> str:
    text = text.strip()
    if text.startswith("```"):
        text = "\n".join(x for x in text.split("\n") if not x.strip().startswith("```")).strip()
    return text


def first_object(text: str) -> str | None:
    """The text from the first brace to the one that balances it; braces in strings count too."""
    begin, depth = text.find("{"), 0
    for m in re.finditer(r"[{}]", text[begin:]) if begin >= 0 else ():
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return text[begin : begin + m.end()]
    return None


def parse_analysis(text: str | None) -> dict:
    """The object a model gave, else the default with whatever summary can be read."""
    text = unfenced(text or "")
    found = _loads(text)
    if found is None and (inner := first_object(text)):
        found = _loads(inner)
    if found is None:
        m = _SUMMARY.search(text)
        summary = m[1].replace('\\"', '"').replace("\\n", "\n") if m else ""
        return {"summary": summary, "relevant": False, "relevance_score": 0.0, "priority": "low", "assigned_aks": [], "tags": [], "reasoning": "Automatische Analyse nicht verfügbar"}
    if "assigned_aks" not in found:
        found["assigned_aks"] = [found["assigned_ak"]] if found.get("assigned_ak") else []
    return found


def _typed(found: dict) -> dict:
    number = found.get("relevance_score")
    strings = lambda x: [str(v) for v in x] if isinstance(x, list) else []
    text = lambda x: None if x is None else str(x)
    return {
        "summary": text(found.get("summary")), "relevant": found.get("relevant") if isinstance(found.get("relevant"), bool) else None,
        "relevance_score": float(number) if isinstance(number, int | float) else None, "priority": text(found.get("priority")),
        "assigned_aks": strings(found.get("assigned_aks")), "tags": strings(found.get("tags")), "reasoning": text(found.get("reasoning")),
    }


@F.pandas_udf(ANALYSIS)
def analysis(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in texts:
        yield pd.DataFrame([_typed(parse_analysis(x)) for x in s], columns=ANALYSIS.names)


@F.pandas_udf(ArrayType(StringType()))
def json_lines(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The objects with a title of a text with one object a line, as JSON; a line may hold one among other text."""

    def lines(text: str | None) -> list[str]:
        text = re.sub(r"^```(?:json?)?\s*$|^```json?\s*", "", (text or "").strip(), flags=re.M)
        out = []
        for line in map(str.strip, text.split("\n")):
            if not line or line.startswith(("#", "//")):
                continue
            found = _loads(line)
            if found is None and (m := re.search(r"\{[^{}]+\}", line)):
                found = _loads(m[0])
            if found and "title" in found:
                out.append(json.dumps(found, ensure_ascii=False, sort_keys=True))
        return out

    for s in texts:
        yield s.map(lines)


def quick_field(text: Column, path: str) -> Column:
    """A field of well-formed JSON, in built-in functions; null for anything else."""
    return F.get_json_object(text, path)


def yes_or_no(text: Column) -> Column:
    """Whether an answer begins with the German word for yes."""
    return F.startswith(F.upper(F.trim(text)), F.lit("JA"))


@F.pandas_udf(StringType())
def fix_quotes(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Typographic quotes inside JSON strings become escaped plain ones."""
    inner = re.compile("[„“”]")
    single = re.compile("[‚‘’]")

    def fix(line: str | None) -> str | None:
        if line is None:
            return None
        parts, inside = [], False
        for part in re.split(r'(\\.|")', line, flags=re.S):
            if part == '"':
                inside = not inside
            elif inside and not part.startswith("\\"):
                part = single.sub(lambda _: "\\'", inner.sub(lambda _: '\\"', part))
            parts.append(part)
        return "".join(parts)

    for s in texts:
        yield s.map(fix)
