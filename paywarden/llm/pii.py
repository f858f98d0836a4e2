"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

One pattern finds candidates; each is validated by its own rule (Luhn for cards, mod 97 for IBANs, octets, area
rules, calendar dates). A run of numbers or an IBAN's candidate that fails as a whole is searched for the valid values
within it (at words' ends only: part of an unbroken number is no value). A validated number or date is mapped to its index in the set of valid values of its format,
permuted there by a keyed Feistel network (halves of the index, SHA-256 of key, kind, round and the other half,
addition modulo the half's size), and written back in the same format. So equal values get equal pseudonyms in all
documents, different ones different pseudonyms, and separators stay. Mail addresses become keyed ones; secrets
become keyed marks that no longer work as a secret.

Phone numbers have any three digits as area code and exchange, and US social security numbers hyphens, spaces or
nothing between their parts, as in functions.detect. Dates are permuted among the 73,170 days from 1900-01-01; cards keep length, first digit and a right check digit;
IBANs keep country, letters and length and get right check digits; at most their last 16 digits are permuted, so of
an IBAN with more digits the first ones (of its bank code) stay readable.

Defined cases: null text stays null; empty text stays empty; candidates that fail validation stay as they are;
text without candidates is returned unchanged; repeated rows get the same result; other columns are kept as they
are, whatever their names (but one called as `found`, which is replaced). The key comes from the caller or from
spark.paywarden.pii.key, and there is no default; it is a literal in the plan, so restrict access to explain output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+\-]++@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}",
    "secret": r"""\bAKIA[0-9A-Z]{16}\b|(?i:\b(?:password|passwd|pwd|secret|token|api[_\-]?key)\b["']?\s*[=:]\s*["']?(?=[A-Za-z_\-/+.]*[0-9])[A-Za-z0-9_\-/+.]{8,}["']?)""",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])",
    "ssn": r"\b(?!000|666|9)[0-9]{3}[-\s]?(?!00)[0-9]{2}[-\s]?(?!0000)[0-9]{4}\b",
    "date": r"\b(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])\b|\b(?:0?[1-9]|[12][0-9]|3[01])[./](?:0?[1-9]|1[0-2])[./](?:19|20)[0-9]{2}\b",
    "phone": r"(?<![A-Za-z0-9_])(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s][0-9]{3}[-.\s][0-9]{4}\b",
    "card": r"\b[0-9](?:[ \-]?[0-9]){12,18}\b",
}
#: Length of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB PL", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC SV", 32: "LC",
}
#: Candidates end where no mail address, dotted number or date with slashes begins.
END = r"\b(?![./][0-9]|[A-Za-z0-9._%+\-]*@)"
_FIXED = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}{END}" for n, c in IBAN_LENGTHS.items())
#: What is cut out of the text: for cards a whole run of numbers, for IBANs also the numbers after it, so that no
#: candidate ends within a number that is valid by itself; `_inner` finds what such a run holds.
RUNS = {
    "iban": rf"\b(?=[A-Z]{{2}}[0-9]{{2}})(?:{_FIXED}|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?{END})(?:[ \-](?:[0-9][0-9 \-]*)?[0-9]{END})?",
    "card": rf"\b(?=[0-9](?:[ \-]?[0-9]){{12}})[0-9][0-9 \-]*[0-9]{END}",
}
ANY = "|".join(f"(?:{RUNS.get(k, p)})" for k, p in PATTERNS.items())
#: What a text needs to hold a candidate at all; cheap to look for.
GATE = r"[0-9@]"
#: A character that no candidate has.
MARK = "\uffff"
ROUNDS, DAYS_A, DAYS_B = 8, 270, 271


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _power(k: Column) -> Column:
    return F.rpad(F.lit("1"), k + 1, "0").cast("long")


def _floor_div(x: Column, y: Column) -> Column:
    return ((x - x % y) / y).cast("long")


def feistel(index: Column, a: Column, b: Column, kind: str, key: Column) -> Column:
    """A permutation of 0 .. a*b-1, picked by the key."""
    start = F.struct(_floor_div(index, b).alias("l"), (index % b).alias("r"))

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        said = F.concat(key, F.lit(f":{kind}:"), i.cast("string"), F.lit(":"), F.when(even, s["r"]).otherwise(s["l"]).cast("string"))
        f = F.conv(F.substring(F.sha2(said, 256), 1, 13), 16, 10).cast("long")
        return F.struct(
            F.when(even, (s["l"] + f % a) % a).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise((s["r"] + f % b) % b).alias("r")
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * b + s["r"])


def _refill(shape: Column, new: Column) -> Column:
    """shape with its digits replaced, in order, by those of new."""
    first = F.struct(F.lit("").alias("out"), F.lit(1).alias("i"))

    def step(s: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct(
            F.concat(s["out"], F.when(digit, F.substring(new, s["i"], F.lit(1))).otherwise(c)).alias("out"), F.when(digit, s["i"] + 1).otherwise(s["i"]).alias("i")
        )

    return F.aggregate(F.split(shape, ""), first, step, lambda s: s["out"])


def _luhn(d: Column) -> Column:
    """Luhn sum of a digit string, modulo 10."""
    doubled = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    values = F.transform(F.reverse(F.split(d, "")), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda s, x: s + x) % 10


def _card(m: Column, key: Column) -> Column:
    d = _digits(m)
    n = F.length(d)
    k = n - 2
    body = F.substring(d, F.lit(2), k)
    half = F.floor(k / 2).cast("int")
    b = _power(half)
    new = feistel(body.cast("long"), _power(k - half), b, "card", key)
    core = F.concat(F.substring(d, 1, 1), F.lpad(new.cast("string"), k, "0"))
    check = (10 - _luhn(F.concat(core, F.lit("0")))) % 10
    return F.when(_luhn(d) == 0, _refill(m, F.concat(core, check.cast("string")))).otherwise(m)


def _ip(m: Column, key: Column) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    index = ((o[0] * 256 + o[1]) * 256 + o[2]) * 256 + o[3]
    new = feistel(index, F.lit(65536), F.lit(65536), "ip", key)
    return F.concat_ws(".", *[F.shiftright(new, 8 * i).bitwiseAND(F.lit(255)).cast("string") for i in (3, 2, 1, 0)])


def _ssn(m: Column, key: Column) -> Column:
    d = _digits(m)
    area, group, serial = (F.substring(d, a, n).cast("long") for a, n in ((1, 3), (4, 2), (6, 4)))
    index = ((area - 1 - (area > 666).cast("long")) * 99 + group - 1) * 9999 + serial - 1
    new = feistel(index, F.lit(898 * 99), F.lit(9999), "ssn", key)
    head = _floor_div(new, F.lit(9999))
    a = _floor_div(head, F.lit(99)) + 1
    a = a + (a >= 666).cast("long")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return _refill(m, F.concat(pad(a, 3), pad(head % 99 + 1, 2), pad(new % 9999 + 1, 4)))


def _phone(m: Column, key: Column) -> Column:
    d = _digits(m)
    new = feistel(F.right(d, F.lit(10)).cast("long"), F.lit(100_000), F.lit(100_000), "phone", key)
    return _refill(m, F.concat(F.when(F.length(d) == 11, F.lit("1")).otherwise(F.lit("")), F.lpad(new.cast("string"), 10, "0")))


def _date(m: Column, key: Column) -> Column:
    iso = m.rlike("^[0-9]{4}-")
    p = F.split(m, "[-./]")
    year, month, day = F.when(iso, p[0]).otherwise(p[2]), p[1], F.when(iso, p[2]).otherwise(p[0])
    at = F.try_to_timestamp(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")
    index = F.datediff(at, F.to_date(F.lit("1900-01-01"))).cast("long")
    new = F.date_add(F.to_date(F.lit("1900-01-01")), feistel(index, F.lit(DAYS_A), F.lit(DAYS_B), "date", key).cast("int"))
    sep = F.regexp_extract(m, "[-./]", 0)
    short = lambda part, was: F.when(F.length(was) == 1, part.cast("string")).otherwise(F.lpad(part.cast("string"), 2, "0"))
    other = F.concat(short(F.dayofmonth(new), day), sep, short(F.month(new), month), sep, F.year(new).cast("string"))
    fine = at.isNotNull() & (index < DAYS_A * DAYS_B)
    return F.when(fine, F.when(iso, F.date_format(new, "yyyy-MM-dd")).otherwise(other)).otherwise(m)


def _mod97(s: Column) -> Column:
    value = lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(s, ""), F.lit(0), lambda acc, c: ((acc * F.when(c.rlike("^[0-9]$"), 10).otherwise(100)) + value(c)) % 97)


def _iban(m: Column, key: Column) -> Column:
    flat = F.replace(m, F.lit(" "), F.lit(""))
    country, body = F.substring(flat, 1, 2), F.substring(flat, F.lit(5), F.length(flat))
    d = _digits(body)
    k = F.least(F.length(d), F.lit(16))
    half = F.floor(k / 2).cast("int")
    new = feistel(F.right(d, k).cast("long"), _power(k - half), _power(half), "iban", key)
    digits = F.concat(F.substring(d, F.lit(1), F.length(d) - k), F.lpad(new.cast("string"), k, "0"))
    made = _refill(body, digits)
    check = F.lpad((98 - _mod97(F.concat(made, country, F.lit("00")))).cast("string"), 2, "0")
    whole = F.concat(check, digits)
    valid = (F.length(flat) >= 15) & (F.length(d) >= 6) & (_mod97(F.concat(body, F.substring(flat, 1, 4))) == 1)
    return F.when(valid, _refill(m, whole)).otherwise(m)


def _email(m: Column, key: Column) -> Column:
    return F.concat(F.lit("user-"), F.substring(F.sha2(F.concat(key, F.lit(":email:"), F.lower(m)), 256), 1, 12), F.lit("@mail.invalid"))


def _secret(m: Column, key: Column) -> Column:
    head = F.regexp_extract(m, r"^(?i:[a-z_\-]+[\"']?\s*[=:]\s*[\"']?)", 0)
    tail = F.regexp_extract(m, r"[\"']?$", 0)
    value = F.substring(m, F.length(head) + 1, F.length(m) - F.length(head) - F.length(tail))
    return F.concat(head, F.lit("[secret-"), F.substring(F.sha2(F.concat(key, F.lit(":secret:"), value), 256), 1, 10), F.lit("]"), tail)


MAKERS = {"email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "ssn": _ssn, "date": _date, "phone": _phone, "card": _card}


def kind_of(m: Column) -> Column:
    """The first kind whose pattern the candidate fits."""
    out = F.lit(None).cast("string")
    for kind in reversed(PATTERNS):
        out = F.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def pseudonym(m: Column, kind: Column, key: Column) -> Column:
    out = m
    for k in reversed(MAKERS):
        out = F.when(kind == k, MAKERS[k](m, key)).otherwise(out)
    return out


def _inner(m: Column, key: Column) -> Column:
    """m cut in (kind, value, pseudonym): the valid values in it from left to right, each from a word's start, and what is between (no kind).

    At a start the kinds are tried in their order: an IBAN by its country's length, then by the pattern; a card from 19
    digits down to 13.
    """
    words = F.regexp_extract_all(m, F.lit("[A-Z0-9]+[^A-Z0-9]*"), F.lit(0))
    rests = F.regexp_extract_all(m, F.lit(r"(?<![A-Z0-9])(?=([A-Z0-9].{0,63}))[A-Z0-9]+"), F.lit(1))  # what each word begins

    def options(rest: Column) -> Column:
        one = lambda kind, pattern: F.struct(F.lit(kind).alias("kind"), F.regexp_extract(rest, f"^(?:{pattern})", 0).alias("value"))
        cards = [one("card", rf"[0-9](?:[ \-]?[0-9]){{{n - 1}}}{END}") for n in range(19, 12, -1)]
        return F.filter(F.array(one("iban", _FIXED), one("iban", PATTERNS["iban"]), *[one(k, PATTERNS[k]) for k in ("ssn", "date", "phone")], *cards), lambda o: o["value"] != "")

    def found(rest: Column, i: Column) -> Column:
        made = F.transform(options(rest), lambda o: F.struct(o["kind"].alias("kind"), o["value"].alias("value"), pseudonym(o["value"], o["kind"], key).alias("pseudonym")))
        return F.struct(i.alias("i"), F.get(F.filter(made, lambda h: h["value"] != h["pseudonym"]), F.lit(0)).alias("hit"))

    hits = F.filter(F.transform(rests, found), lambda x: x["hit"].isNotNull())
    hits = F.transform(hits, lambda x: F.struct((F.length(F.array_join(F.slice(words, F.lit(1), x["i"]), "")) + 1).alias("at"), x["hit"].alias("hit")))
    plain = lambda t: F.struct(F.lit(None).cast("string").alias("kind"), t.alias("value"), t.alias("pseudonym"))
    begin = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<kind:string,value:string,pseudonym:string>>").alias("parts"))

    def step(acc: Column, x: Column) -> Column:
        parts = F.concat(acc["parts"], F.array(plain(F.substring(m, acc["at"], x["at"] - acc["at"])), x["hit"]))
        return F.when(x["at"] < acc["at"], acc).otherwise(F.struct((x["at"] + F.length(x["hit"]["value"])).alias("at"), parts.alias("parts")))

    return F.aggregate(hits, begin, step, lambda acc: F.concat(acc["parts"], F.array(plain(F.substring(m, acc["at"], F.length(m))))))


def _pieces(t: Column) -> Column:
    """The text cut in what is between candidates and the candidates, in turns. One search marks them all; a text that has
    the mark already is searched twice instead."""
    marked = F.split(F.regexp_replace(t, F.lit(ANY), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    ends = F.concat(F.regexp_extract_all(t, F.lit(ANY), F.lit(0)), F.array(F.lit("")))
    pairs = F.flatten(F.zip_with(F.split(t, ANY, -1), ends, lambda gap, m: F.array(gap, m)))
    return F.when(F.contains(t, F.lit(MARK)), F.slice(pairs, F.lit(1), F.size(pairs) - 1)).otherwise(marked)


def key_of(docs: DataFrame, key: str | None) -> str:
    key = key or docs.sparkSession.conf.get("spark.paywarden.pii.key", None)
    if not key:
        raise ValueError("a secret key is needed: pass one or set spark.paywarden.pii.key")
    return key


def pseudonymise(docs: DataFrame, text: str = "text", key: str | None = None, found: str | None = None) -> DataFrame:
    """docs with `text` pseudonymised in place; `found`, if named, gets the array of (kind, value, pseudonym) that changed."""
    k = F.lit(key_of(docs, key))
    t = F.col(text)
    names = [free_name(docs, "pieces"), found or free_name(docs, "found")]
    pieces, hits = map(F.col, names)
    between = lambda rest: F.filter(pieces, lambda x, i: i % 2 == rest)
    out = docs.withColumn(names[0], F.when(t.rlike(GATE), _pieces(t)))
    kinded = F.transform(between(1), lambda m: F.struct(m.alias("value"), kind_of(m).alias("kind")))
    made = F.transform(kinded, lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"), pseudonym(x["value"], x["kind"], k).alias("pseudonym")))
    fails = lambda h: (h["value"] == h["pseudonym"]) & F.coalesce(h["kind"].isin("iban", "card"), F.lit(True))
    made = F.transform(made, lambda h: F.when(fails(h), _inner(h["value"], k)).otherwise(F.array(h)))
    out = out.withColumn(names[1], F.when(F.size(pieces) > 1, made))
    spliced = F.concat(F.array_join(F.zip_with(F.slice(between(0), 1, F.size(hits)), hits, lambda g, h: F.concat(g, F.array_join(h["pseudonym"], ""))), ""), F.element_at(pieces, -1))
    out = out.withColumn(text, F.when(hits.isNull(), t).otherwise(spliced)).drop(names[0])
    if not found:
        return out.select(*docs.columns)
    flat = F.flatten(F.coalesce(F.col(found), F.array().cast(out.schema[found].dataType)))
    return out.withColumn(found, F.filter(flat, lambda x: x["value"] != x["pseudonym"]))
