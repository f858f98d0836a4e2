"""A training-data pipeline over documents: each stage writes Parquet that the next one reads.

Stages in order: language ID (texts without a language go), near-duplicates (one document of each class
stays), suffix-array dedup (repeated strings of 200 bytes are cut), PII (pseudonyms), packing (a row per piece).

Defined cases: a row with null, empty or letterless text is rejected by the first stage; rows with a null id are
documents like any other (of a class of near-duplicates they stay only if no row has an id); of repeated rows one
stays; extra columns of documents pass through, whatever their names; an empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paywarden.llm import language_id, packing, pii, simhash, suffix_dedup
from paywarden.llm.common import clear, made, new_path
from paywarden.llm.queries import BYTES, OPEN_KEY, PIECES

#: A document is rejected if no language is found or the best one's posterior is below this.
LEAST_SCORE = 0.5


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns c0, c1 ..., so that no extra column clashes with an operator's own, and the new name of each."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; a null or letterless text is rejected. A null lang becomes the one found.

    Languages are learned from the rows with a label. Where there is none, no language can be told: every text with a
    letter stays. Null ids and repeated rows are judged like any other; an empty table stays empty.
    """
    plain, names = _plain(docs)
    text, lang = names["text"], names["lang"]
    model = language_id.fit(plain, PIECES, F.lit(True), text, lang, names["doc_id"])
    if not model[0]:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    out = language_id.predict(plain, PIECES, model, text, tuple(names.values()))
    out = out.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).withColumn(lang, F.coalesce(lang, "lang_pred"))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each class of near-duplicates (Jaccard >= 0.8 of five-word shingles).

    By simhash's operator: tries over long fingerprints give candidates, whole shingle sets decide.
    """
    return simhash.drop_near_duplicates(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without strings of 200 bytes that occur elsewhere; n_chars is that of what is left.

    Cutting whole bytes may split a character; its remaining bytes are left out of the text. A document of which
    nothing is left stays, with empty text.
    """
    plain, names = _plain(docs)
    text = names["text"]
    out = suffix_dedup.cut_repeats(plain, text, keep=tuple(n for n in names.values() if n != text))
    out = out.withColumn(text, F.col("kept_text")).withColumn(names["n_chars"], F.length("kept_text").cast("long"))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data and secrets; n_chars follows the text.

    The key is spark.paywarden.pii.key's; where that is unset, as in the registered runs, the open key of the queries.
    """
    key = spark.conf.get("spark.paywarden.pii.key", OPEN_KEY)
    return pii.pseudonymise(docs, key=key).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a sequence."""
    return packing.pack(docs, BYTES, with_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeats),
    ("PII", personal_data),
    ("packing", packed),
]

#: SQL can't express the stages; their operators have tests of their own, and a test of run() checks that its sequences are full and that documents stay.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again, and what it stored on
    its way is removed then, with the stage before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    start = made()
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = new_path(spark, f"stage{i}")
            docs.write.parquet(path)
            clear(spark, start, (path,))
            docs = spark.read.parquet(path)
    return docs
