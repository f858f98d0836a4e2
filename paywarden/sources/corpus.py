"""A synthetic labelled corpus, made in parallel by integer arithmetic: the same rows each time, with exact shares.

Category sizes, places and entity types are quotas, not draws, so the totals follow n: at the default size they are 720
positive rows of 2000 and 875 entities, in the shares below. Which row gets what is a fixed permutation (a row number
times a prime, modulo the number of rows), so categories are mixed and ids run on without gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: category weights, positive rows by where their entities are, entities by type
CATEGORIES = {"ai_inference": 0.18, "data_access": 0.18, "medical": 0.15, "compute": 0.13, "media": 0.13, "financial": 0.13, "generic": 0.10}
PLACES = {("resource_url",): 241, ("description",): 170, ("reason",): 154, ("resource_url", "description"): 78, ("resource_url", "reason"): 77}
ENTITIES = {"PERSON": 321, "EMAIL_ADDRESS": 313, "IBAN_CODE": 96, "US_SSN": 85, "PHONE_NUMBER": 32, "CREDIT_CARD": 28}
# end of fixed values
PRIMES = (2_654_435_761, 2_246_822_519, 3_266_489_917)
#: (surface form, text) of each type; some are written so that they need normalising, some so that patterns miss them.
FORMS = {
    "PERSON": (("full", "Ada Marlow"), ("last_first", "Petrie, Jon"), ("initial", "A. Marlow"), ("handle", "jonpetrie"), ("title", "Dr Ines Okafor")),
    "EMAIL_ADDRESS": (("plain", "ada.marlow@example.com"), ("tagged", "j.petrie+pay@mail.example.org"), ("look_alike", "\u0430da@example.com"), ("zero_width", "jon\u200b.petrie@example.org"), ("spelled", "ada at example dot com")),
    "IBAN_CODE": (("gb", "GB29NWBK60161331926819"), ("de", "DE89370400440532013000"), ("nl", "NL91ABNA0417164300"), ("full_width", "\uff27\uff2229NWBK60161331926819"), ("grouped", "DE89 3704 0044 0532 0130 00")),
    "US_SSN": (("hyphens", "219-45-6789"), ("spaces", "312 45 6789"), ("plain", "533456789"), ("en_dash", "401\u201365\u20132310"), ("dots", "219.45.6789")),
    "PHONE_NUMBER": (("hyphens", "415-555-0134"), ("dots", "212.555.0187"), ("country", "+1 303-555-0101"), ("area", "(503) 555-0162"), ("plain", "4155550134")),
    "CREDIT_CARD": (("visa", "4111111111111111"), ("mastercard", "5500005555555559"), ("amex", "371449635398431"), ("full_width", "\uff14111111111111111"), ("grouped", "4111 1111 1111 1111")),
}
HEADS = {"resource_url": ("https://api.example.com/", "/user/"), "description": ("Request in ", " for "), "reason": ("On behalf, in ", ", of ")}
NOBODY = "all"


def thresholds(total: Column | int, shares: list[int]) -> list:
    """Upper ends of consecutive ranges of 0..total that hold the shares; whole numbers, rounded down."""
    out, upto = [], 0
    for x in shares:
        upto += x
        out.append(total * upto // sum(shares))
    return out


def sizes(n: int, pii_rate: float) -> list[tuple[str, int, int]]:
    """(category, rows, positive rows): the last category takes the rest and has no entities."""
    out, left = [], n
    for i, (name, w) in enumerate(CATEGORIES.items()):
        last = i == len(CATEGORIES) - 1
        k = left if last else min(left, round(n * w))
        out.append((name, k, 0 if last else round(k * pii_rate)))
        left -= k
    return out


def _pick(x: Column, ends: list[int], values: list) -> Column:
    out = F.lit(values[-1])
    for end, v in reversed(list(zip(ends[:-1], values[:-1]))):
        out = F.when(x < end, F.lit(v)).otherwise(out)
    return out


def generate(spark: SparkSession, n: int = 2000, pii_rate: float = 0.4, seed: int = 42) -> DataFrame:
    """Rows of the corpus schema: id, category, resource_url, description, reason, pii_positive, labels."""
    parts = sizes(n, pii_rate)
    positives = sum(p for _, _, p in parts)
    at_rows, at_positive, slot = 0, 0, F.pmod(F.col("id") * PRIMES[0] + seed, F.lit(max(n, 1)))
    rows = spark.range(n).withColumn("slot", slot)
    category, rank = F.lit(parts[-1][0]), F.lit(None).cast("long")
    for name, k, p in parts:
        own = (F.col("slot") >= at_rows) & (F.col("slot") < at_rows + k)
        category = F.when(own, F.lit(name)).otherwise(category)
        rank = F.when(own & (F.col("slot") < at_rows + p), F.col("slot") - at_rows + at_positive).otherwise(rank)
        at_rows, at_positive = at_rows + k, at_positive + p
    mixed = F.pmod(F.col("rank") * PRIMES[1] + seed, F.lit(max(positives, 1)))
    rows = rows.withColumns({"category": category, "rank": rank}).withColumn("q", mixed)
    ends = thresholds(positives, list(PLACES.values()))
    single = ends[sum(len(f) == 1 for f in PLACES) - 1]
    entities = single + 2 * (positives - single)
    rows = rows.withColumn("fields", F.when(F.col("q").isNull(), F.array().cast("array<string>")).otherwise(F.split(_pick(F.col("q"), ends, ["+".join(f) for f in PLACES]), r"\+")))
    first = F.when(F.col("q") < single, F.col("q")).otherwise(single + 2 * (F.col("q") - single))
    rows = rows.withColumn("u", F.transform("fields", lambda f, i: F.pmod((first + i) * PRIMES[2] + seed, F.lit(max(entities, 1)))))
    kinds = thresholds(entities, list(ENTITIES.values()))
    forms = F.create_map(*[x for t, fs in FORMS.items() for i, (name, text) in enumerate(fs) for x in (F.lit(f"{t}:{i}"), F.struct(F.lit(t).alias("t"), F.lit(text).alias("text"), F.lit(name).alias("form")))])
    rows = rows.withColumn("held", F.transform("u", lambda u: F.element_at(forms, F.concat(_pick(u, kinds, list(ENTITIES)), F.lit(":"), (u % 5).cast("string")))))
    place = lambda f: F.array_position("fields", F.lit(f)).cast("int")
    head = {f: F.concat(F.lit(a), "category", F.lit(b)) for f, (a, b) in HEADS.items()}
    text = {f: F.concat(h, F.when(place(f) > 0, F.get("held", place(f) - 1)["text"]).otherwise(NOBODY)).alias(f) for f, h in head.items()}

    def label(f: Column, i: Column) -> Column:
        held = F.get("held", i)
        start = F.lit(0)
        for name, h in head.items():
            start = F.when(f == name, F.length(h)).otherwise(start)
        return F.struct(f.alias("field"), held["t"].alias("entity_type"), start.alias("start"), (start + F.length(held["text"])).alias("end"), held["text"].alias("original_text"), held["form"].alias("surface_form"))

    return rows.select(F.format_string("syn-%05d", F.col("id")).alias("id"), "category", *text.values(), F.col("rank").isNotNull().alias("pii_positive"), F.transform("fields", label).alias("labels"))
