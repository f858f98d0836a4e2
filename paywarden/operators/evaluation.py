"""Detector evaluation: greedy one-to-one matching, confusion counts, sweeps, percentiles, corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.detect import DETECTORS, PATTERNS, detect, normalise, of_score, resolve, spans
from ..functions.scalars import overlaps, ratio, round_even

SUBSETS = (*[(t,) for t in PATTERNS], tuple(PATTERNS))
# fixed values: types of the sweep, least scores swept for detectors that score, and the one for patterns, which don't
SWEEP_TYPES = ("EMAIL_ADDRESS", "PERSON", "PHONE_NUMBER", "US_SSN", "CREDIT_CARD", "IBAN_CODE")
MIN_SCORES, PATTERN_SCORES = (0.30, 0.40, 0.50, 0.60, 0.70), (0.50,)
FIELDS = ("resource_url", "description", "reason")


def match(labels: Column, predictions: Column) -> Column:
    """Matched predictions, per label in order: the first free one of the same field and type whose span overlaps.

    Both are arrays of structs with field, entity_type, start, end; the result is an array of (label index,
    prediction index, -1 where none is left).
    """
    start = F.array().cast("array<struct<label:int,pred:int>>")
    numbered = F.transform(predictions, lambda p, i: F.struct(p["field"].alias("field"), p["entity_type"].alias("entity_type"), p["start"].alias("start"), p["end"].alias("end"), i.alias("i")))

    def step(acc: Column, pair: Column) -> Column:
        fits = F.filter(numbered, lambda p: (p["field"] == pair["l"]["field"]) & (p["entity_type"] == pair["l"]["entity_type"]) & overlaps(p["start"], p["end"], pair["l"]["start"], pair["l"]["end"]) & ~F.exists(acc, lambda a: a["pred"] == p["i"]))
        return F.concat(acc, F.array(F.struct(pair["i"].alias("label"), F.coalesce(F.get(fits, 0)["i"], F.lit(-1)).alias("pred"))))

    return F.aggregate(F.transform(labels, lambda x, i: F.struct(x.alias("l"), i.alias("i"))), start, step)


def outcomes(labels: Column, predictions: Column) -> Column:
    """One (entity_type, kind) per outcome: tp and fn from labels, fp from predictions left over."""
    pairs = match(labels, predictions)
    of_labels = F.transform(pairs, lambda p: F.struct(F.get(labels, p["label"])["entity_type"].alias("entity_type"), F.when(p["pred"] >= 0, "tp").otherwise("fn").alias("kind")))
    left = F.filter(F.transform(predictions, lambda p, i: F.struct(p["entity_type"].alias("entity_type"), i.alias("i"))), lambda p: ~F.exists(pairs, lambda m: m["pred"] == p["i"]))
    return F.concat(of_labels, F.transform(left, lambda p: F.struct(p["entity_type"].alias("entity_type"), F.lit("fp").alias("kind"))))


def scores(df: DataFrame, *keys: str) -> DataFrame:
    """Precision, recall and F1 from columns tp, fp, fn; 0 where undefined."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return df.select(*keys, "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def entity_report(samples: DataFrame, labels: str = "labels", predictions: str = "predictions") -> DataFrame:
    """Counts and scores per entity type, and over all (entity_type null)."""
    one = samples.select(F.explode(outcomes(F.col(labels), F.col(predictions))).alias("o")).select("o.*")
    n = lambda k: F.count_if(F.col("kind") == k).alias(k)
    return scores(one.rollup("entity_type").agg(n("tp"), n("fp"), n("fn")), "entity_type")


def sample_report(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """One row: tp, fp, fn, tn over samples, with scores."""
    n = lambda c, a: F.count_if(c).alias(a)
    row = df.agg(n(truth & predicted, "tp"), n(~truth & predicted, "fp"), n(truth & ~predicted, "fn"), n(~truth & ~predicted, "tn"))
    return scores(row, "tn")


def sweep(texts: DataFrame, text: str = "text", subsets: tuple[tuple[str, ...], ...] = SUBSETS) -> DataFrame:
    """Per configuration (a subset of types): texts with any entity, and entities. One pass over the texts."""
    types = list(PATTERNS)
    rows = texts.select(normalise(F.col(text)).alias("t")).withColumns({f"s{i}": spans(F.col("t"), k) for i, k in enumerate(types)})  # each pattern once
    found = lambda s: F.size(resolve(F.concat(*[F.col(f"s{types.index(k)}") for k in s]))) if s else F.lit(0)
    configs = F.array(*[F.struct(F.lit("+".join(s) if len(s) < len(PATTERNS) else "all").alias("config"), found(s).alias("n")) for s in subsets])
    return rows.select(F.inline(configs)).groupBy("config").agg(F.count_if(F.col("n") > 0).alias("texts_with_any"), F.sum("n").alias("entities"))


def configurations(modes: tuple[str, ...] = ("patterns",)) -> list[tuple[str, tuple[str, ...], float]]:
    """(detector, entity types, least score) of a sweep: each type alone and all, at each score that matters to the detector."""
    subsets = (*[(t,) for t in SWEEP_TYPES], SWEEP_TYPES)
    return [(m, s, x) for m in modes for s in subsets for x in (PATTERN_SCORES if m == "patterns" else MIN_SCORES)]


def predictions(corpus: DataFrame, mode: str = "patterns", types: tuple[str, ...] | None = None, min_score: float = 0.0) -> Column:
    """What a detector finds in columns n_<field> of normalised texts: field, entity_type, start, end.

    Types hold before overlaps for patterns, and are picked from what other detectors found.
    """
    def one(f: str) -> Column:
        found = detect(F.col(f"n_{f}"), types) if mode == "patterns" else DETECTORS[mode](F.col(f"n_{f}"))
        found = F.transform(found, lambda e: F.struct(F.lit(f).alias("field"), e["entity_type"].alias("entity_type"), e["start"].alias("start"), e["end"].alias("end"), (F.lit(1.0) if mode == "patterns" else e["score"]).alias("score")))
        return of_score(found if types is None else F.filter(found, lambda e: e["entity_type"].isin(*types)), min_score)

    return F.concat(*[one(f) for f in FIELDS])


def normalised(corpus: DataFrame) -> DataFrame:
    """corpus with n_<field>, the normalised text of each field."""
    return corpus.withColumns({f"n_{f}": normalise(F.col(f)) for f in FIELDS})


def sweep_scores(corpus: DataFrame, configs: list[tuple[str, tuple[str, ...], float]]) -> DataFrame:
    """Per configuration: mode, entities, min_score, n_samples, entity counts and scores over all types, and sample counts and scores.

    All configurations are scored in one pass over the corpus and one aggregate.
    """
    rows = normalised(corpus)
    for i, (mode, types, least) in enumerate(configs):
        rows = rows.withColumn(f"p{i}", predictions(rows, mode, types, least))
    one = lambda i: F.struct(F.lit(i).alias("i"), outcomes(F.col("labels"), F.col(f"p{i}")).alias("o"), (F.size(f"p{i}") > 0).alias("any"))
    rows = rows.select("pii_positive", F.explode(F.array(*[one(i) for i in range(len(configs))])).alias("c")).select("pii_positive", "c.*")
    n = lambda k: F.sum(F.size(F.filter("o", lambda x: x["kind"] == k))).alias(k)
    c = lambda cond, a: F.count_if(cond).alias(a)
    t, p = F.col("pii_positive"), F.col("any")
    got = rows.groupBy("i").agg(F.count("*").alias("n_samples"), n("tp"), n("fp"), n("fn"), c(t & p, "sample_tp"), c(~t & p, "sample_fp"), c(t & ~p, "sample_fn"), c(~t & ~p, "sample_tn"))
    micro = scores(got, "i", "n_samples", "sample_tp", "sample_fp", "sample_fn", "sample_tn").withColumnsRenamed({"precision": "micro_precision", "recall": "micro_recall", "f1": "micro_f1"})
    sp, sr = ratio(F.col("sample_tp"), F.col("sample_tp") + F.col("sample_fp")), ratio(F.col("sample_tp"), F.col("sample_tp") + F.col("sample_fn"))
    micro = micro.withColumns({"sample_precision": sp, "sample_recall": sr, "sample_f1": ratio(2 * sp * sr, sp + sr)})
    rates = ("micro_precision", "micro_recall", "micro_f1", "sample_precision", "sample_recall", "sample_f1")
    named = corpus.sparkSession.createDataFrame([(i, m, sorted(t), x) for i, (m, t, x) in enumerate(configs)], "i int, mode string, entities array<string>, min_score double")
    return F.broadcast(named).join(micro.withColumns({r: round_even(F.col(r), 4) for r in rates}), "i").drop("i")


def by_f1(report: DataFrame) -> DataFrame:
    """Rows of a report, the best F1 first; equal ones by type, the total (no type) last."""
    return report.orderBy(F.col("entity_type").isNull(), F.desc("f1"), "entity_type")


def percentiles(df: DataFrame, column: str) -> DataFrame:
    """Exact p50, p95 and p99 (interpolated), mean, least and most. Memory follows the number of distinct values, so this is for measured durations."""
    p = F.percentile(column, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return df.agg(*[F.get(p, i).alias(n) for i, n in enumerate(("p50", "p95", "p99"))], F.avg(column).alias("mean"), F.min(column).alias("min"), F.max(column).alias("max"))


def corpus_meta(corpus: DataFrame) -> DataFrame:
    """(metric, label, n, rate) of a labelled corpus: totals, counts by category, entity type and field, and the shares of positive rows and of types."""
    one = corpus.select("category", "pii_positive", "labels")
    a = one.agg(F.count("*").alias("n_total"), F.count_if("pii_positive").alias("n_positive"), F.sum(F.size("labels")).alias("n_entities"))
    a = a.withColumns({"n_entities": F.coalesce("n_entities", F.lit(0)), "n_negative": F.col("n_total") - F.col("n_positive")})
    share = round_even(ratio(F.col("n_positive"), F.col("n_total")), 4)
    rows = [F.struct(F.lit(c).alias("metric"), F.lit("").alias("label"), F.col(c).cast("long").alias("n"), (share if c == "n_positive" else F.lit(None).cast("double")).alias("rate")) for c in a.columns]
    per = lambda metric, df, c: df.groupBy(F.col(c).alias("label")).agg(F.count("*").alias("n")).select(F.lit(metric).alias("metric"), "label", "n")
    flat = one.select(F.explode("labels").alias("l")).select("l.entity_type", "l.field")
    types = per("entity_type", flat, "entity_type").join(F.broadcast(a.select("n_entities")))  # one row
    types = types.select("metric", "label", "n", round_even(ratio(F.col("n"), F.col("n_entities")), 4).alias("rate"))
    counts = per("category", one, "category").unionByName(per("field", flat, "field")).withColumn("rate", F.lit(None).cast("double"))
    return a.select(F.inline(F.array(*rows))).unionByName(counts).unionByName(types)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in the order of a seeded hash; the same rows each time."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """All rows in the order of a seeded hash of the key: a range sort."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key)
