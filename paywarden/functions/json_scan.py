"""Redaction of the string values of arbitrary JSON, at any depth; keys, numbers, booleans and nulls stay."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .detect import DEFAULT_TEMPLATE, HYPHENS, INVISIBLE, LOOKALIKE, PATTERNS

_PY = [(t, re.compile(p.replace("(?U)", ""))) for t, p in PATTERNS.items()]
_FOLD = str.maketrans(LOOKALIKE[0] + HYPHENS, LOOKALIKE[1] + "-" * len(HYPHENS), INVISIBLE)


def fixed_point(text: str) -> str:
    """Python twin of normalise."""
    return unicodedata.normalize("NFKC", text).translate(_FOLD)


def redact_text(text: str, template: str = DEFAULT_TEMPLATE) -> tuple[str, list[str]]:
    """Python twin of normalise, detect and redact; also used to test them."""
    text = fixed_point(text)
    hits = sorted((m.start(), rank, m.end(), t) for rank, (t, p) in enumerate(_PY) for m in p.finditer(text))
    out, at, kinds = [], 0, []
    for start, _, end, kind in hits:
        if start >= at:
            out += [text[at:start], template.replace("{entity_type}", kind)]
            at = end
            kinds.append(kind)
    return "".join(out) + text[at:], kinds


def _walk(node, kinds: list[str], template: str):
    if isinstance(node, str):
        text, found = redact_text(node, template)
        kinds.extend(found)
        return text if found else node
    if isinstance(node, dict):
        return {k: _walk(v, kinds, template) for k, v in node.items()}
    if isinstance(node, list):
        return [_walk(v, kinds, template) for v in node]
    return node


def _scan(s: pd.Series) -> pd.DataFrame:
    rows = []
    for x in s:
        kinds: list[str] = []
        try:
            rows.append((json.dumps(_walk(json.loads(x), kinds, DEFAULT_TEMPLATE), separators=(",", ":"), ensure_ascii=False), kinds, True))
        except (TypeError, ValueError):
            rows.append((x, [], False))
    return pd.DataFrame(rows, columns=["clean", "entity_types", "valid"])


def scan_json(value: Column) -> Column:
    """A struct of the redacted JSON, the entity types found in order, and whether it was JSON at all."""
    return F.pandas_udf(_scan, "struct<clean:string,entity_types:array<string>,valid:boolean>")(value)
