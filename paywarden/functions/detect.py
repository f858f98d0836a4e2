"""Personal-data detection as native column expressions: spans per pattern, overlap resolution, redaction."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: detector patterns, in order of precedence -----------------------------------------------------
PATTERNS: dict[str, str] = {
    "EMAIL_ADDRESS": r"(?i)[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}",
    "US_SSN": r"(?U)\b(?!000|666|9[0-9]{2})[0-9]{3}[-\s]?(?!00)[0-9]{2}[-\s]?(?!0000)[0-9]{4}\b",
    "CREDIT_CARD": r"(?U)\b(?:4[0-9]{12}(?:[0-9]{3,6})?|5[1-5][0-9]{14}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|6(?:011|5[0-9]{2})[0-9]{12}|(?:2131|1800|35[0-9]{3})[0-9]{11})\b",
    "PHONE_NUMBER": r"(?U)\b(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s][0-9]{3}[-.\s][0-9]{4}\b",
    "IBAN_CODE": r"(?U)\b[A-Z]{2}[0-9]{2}[A-Z0-9]{4}[0-9]{7}(?:[A-Z0-9]{0,16})\b",
    "IP_ADDRESS": r"(?U)\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b",
}
#: Invisible characters, dropped: zero-width space, non-joiner, joiner, byte-order mark, soft hyphen, word joiner.
INVISIBLE = "​‌‍﻿­⁠"
#: Cyrillic letters that look Latin, and the Latin letters they fold to.
LOOKALIKE = ("аАеЕоОрРсСхХуУіІјЈѕЅкКнМТВ", "aAeEoOpPcCxXyYiIjJsSkKHMTB")
#: Hyphen-like characters, folded to the ASCII hyphen.
HYPHENS = "‐‑‒–—−﹘﹣－"
# ---- end of fixed values -----------------------------------------------------------------------------------------

#: A cheap necessary condition of each pattern, tested before the pattern itself.
NEEDS = {"EMAIL_ADDRESS": "@", "US_SSN": "[0-9]{4}", "CREDIT_CARD": "[0-9]{13}", "PHONE_NUMBER": "[0-9]{4}", "IBAN_CODE": "[A-Z]{2}[0-9]{2}", "IP_ADDRESS": r"[0-9]\.[0-9]"}
DEFAULT_TEMPLATE = "<REDACTED>"
ENTITY = "array<struct<start:int,rank:int,end:int,entity_type:string,original_text:string>>"


#: Texts of these characters only are fixed points of NFKC: ASCII, and the Latin-1 ones without a compatibility form.
STABLE = r"^[\x00-\x7F\u00A1-\u00A7\u00A9\u00AB-\u00AE\u00B0\u00B1\u00B6\u00B7\u00BB\u00BF-\u00FF]*$"


#: A character that folding may change: all that it does are the soft hyphen or beyond Latin-1. Two ranges, as a long list of characters is slow.
FOLDED = r"[\u00AD\u0100-\uFFFF]"


def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def fold(text: Column) -> Column:
    """Native part of normalisation: drop invisible characters, fold look-alikes and hyphens; other texts stay as they are."""
    return F.when(text.rlike(FOLDED), F.translate(text, LOOKALIKE[0] + HYPHENS + INVISIBLE, LOOKALIKE[1] + "-" * len(HYPHENS))).otherwise(text)


def normalise(text: Column) -> Column:
    """NFKC, then fold. Spark has no NFKC, so that step is an Arrow UDF, to which only texts are sent that it may change."""
    return fold(F.coalesce(F.pandas_udf(_nfkc, "string")(F.when(~text.rlike(STABLE), text)), text))


def spans(text: Column, entity_type: str) -> Column:
    """Matches of one pattern as entities; offsets count characters."""
    pattern, rank = PATTERNS[entity_type], list(PATTERNS).index(entity_type)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    empty = F.array().cast(ENTITY)
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["m"])
        one = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(entity_type).alias("entity_type"), pair["m"].alias("original_text"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    pairs = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(m.alias("m"), g.alias("gap")))
    return F.when(text.rlike(NEEDS[entity_type]) & text.rlike(pattern), F.aggregate(pairs, start, step, lambda a: a["out"])).otherwise(empty)


def resolve(entities: Column) -> Column:
    """Overlaps go: in order of start (then pattern), an entity stays if it starts at or after the last kept end."""
    start = F.struct(F.lit(-1).alias("end"), F.array().cast(ENTITY).alias("out"))

    def step(acc: Column, e: Column) -> Column:
        fine = e["start"] >= acc["end"]
        return F.struct(F.when(fine, e["end"]).otherwise(acc["end"]).alias("end"), F.when(fine, F.concat(acc["out"], F.array(e))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(F.array_sort(entities), start, step, lambda a: a["out"])


def detect(text: Column, entities: Sequence[str] | None = None) -> Column:
    """Entities of a (normalised) text. None means all types, an empty list none; the subset holds before overlaps."""
    active = [t for t in PATTERNS if entities is None or t in entities]
    if not active:
        return F.array().cast(ENTITY)
    look = "[" + "".join(sorted({"@" if t == "EMAIL_ADDRESS" else "0-9" for t in active})) + "]"  # one look tells most texts apart
    return F.coalesce(F.when(text.rlike(look), resolve(F.concat(*[spans(text, t) for t in active]))), F.array().cast(ENTITY))


def redact(text: Column, entities: Column, template: str = DEFAULT_TEMPLATE) -> Column:
    """The text with each entity replaced by the template, in which {entity_type} stands for its type."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    word = lambda e: F.replace(F.lit(template), F.lit("{entity_type}"), e["entity_type"])
    step = lambda a, e: F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, e["start"] - a["at"]), word(e)).alias("out"), e["end"].alias("at"))
    rest = lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text)))
    return F.when(F.size(entities) == 0, text).otherwise(F.aggregate(entities, start, step, rest))


def entity_types(entities: Column) -> Column:
    """Distinct entity types, sorted."""
    return F.array_sort(F.array_distinct(F.transform(entities, lambda e: e["entity_type"])))


def of_score(entities: Column, min_score: float) -> Column:
    """Entities with a score of at least min_score; patterns score 1, detectors plugged in say their own."""
    return F.filter(entities, lambda e: e["score"] >= min_score)


#: Detectors by name: a function of a normalised text column that returns entities (see ENTITY) in order of their start.
DETECTORS: dict[str, Callable[[Column], Column]] = {"patterns": detect}


def register_detector(name: str, detector: Callable[[Column], Column]) -> None:
    """Plug in a detector; scan_fields and the decision pipeline take it by name."""
    DETECTORS[name] = detector


def scan_fields(fields: dict[str, Column], detector: str = "patterns", min_score: float = 0.0) -> Column:
    """Entities of several (normalised) fields, in the order given, each with its field and score."""
    one = lambda e, name: F.struct(F.lit(name).alias("field"), e["entity_type"].alias("entity_type"), e["start"].alias("start"), e["end"].alias("end"), F.lit(1.0).alias("score"), e["original_text"].alias("original_text"))
    tag = lambda name, c: F.transform(DETECTORS[detector](c), lambda e: one(e, name))
    return of_score(F.concat(*[tag(n, c) for n, c in fields.items()]), min_score)


def entities_of(found: Column, field: str) -> Column:
    """The entities of one field out of scan_fields' result, as redact takes them."""
    return F.filter(found, lambda e: e["field"] == field)
