"""A training-data pipeline over ``documents``: each stage is one corpus operator, applied to all its predecessor kept.

Stages read the columns of ``COLUMNS`` and leave others behind, also such as are named like columns of their own. Rows with
a null id are documents like any other. An empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, mixing, neardup, secrets, toxicity
from quire.llm.common import materialize, table
from quire.llm.queries import TOXIC_AT, held_out, ranks

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold. Null and empty texts get the prior, and stay where toxic
    texts are the lesser part; repeated rows stay or go together. Without labels every score is 0.5, and no document stays."""
    model = toxicity.fit(table(spark, sf_dir, "labels").where(~held_out()), docs)
    scored = toxicity.score(docs, model, keep=COLUMNS)
    return scored.where(F.col("score") < TOXIC_AT).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that with the least id, one without an id only where none has one.
    Rows that repeat id and text stay once. Null and blank texts are one class."""
    rows = neardup.with_class(docs)
    firsts = rows.where("id = first").select("id").distinct()
    kept = docs.select(*COLUMNS, neardup.row_key("doc_id", "text").alias("id")).join(firsts, "id", "left_semi")
    return kept.dropDuplicates(["id"]).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret, and ``n_chars`` of the new text. Null and empty texts, and those
    without secrets, are as they were; repeated rows stay."""
    found = secrets.scan(docs, secrets.fit(secrets.default_samples(docs)), keep=COLUMNS)
    clean = found.withColumn("text", secrets.redacted("text", "spans"))
    return clean.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with probabilities that meet the target weights of sources, languages and topics. Null sources and
    languages are values like any other; texts without tokens are drawn at the rate of their cell; rows of one id are
    drawn alike."""
    return mixing.sample(docs, keep=COLUMNS).where("kept").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text decoded from them. Null and empty texts have no
    ids; repeated rows stay."""
    made = ("n_tokens", "ids", "ids_sha256", "decoded_sha256")
    return bpe.encode(docs, ranks(), public_tokenizers.PATTERN, outputs=made, keep=("lang", "source", "n_chars"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]

#: The learned stages can't be written in SQL; tests hold the result against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
