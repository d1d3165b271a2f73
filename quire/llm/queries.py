"""The registered query of each corpus operator: production parameters, whole tables, full results."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import align, ann, bpe, fingerprint, html_text, mixing, neardup, personal, phrases, rollup, secrets, toxicity, warc
from quire.llm.common import materialize, shared_dir, table

RANKS = "byte_bpe_50k.tiktoken"
A_TOKENS, B_TOKENS = "byte_bpe_50k.json", "piece_bpe_32k.model"
TOXIC_AT = 0.3


def vocabulary(name: str) -> bytes:
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def ranks() -> bytes:
    return vocabulary(RANKS)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.fit(secrets.default_samples(docs)))
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[n(k).alias(f"n_{secrets.KINDS[k]}") for k in range(3)],
        F.sha2(secrets.joined(base_only=True), 256).alias("base_sha256"),
        secrets.joined().alias("spans"),
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.sample(table(spark, sf_dir, "documents"))
    return drawn.select("doc_id", *mixing.DIMS, F.col("tok").cast("long").alias("tok"), F.round("p", 6).alias("p"), "kept")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(
        table(spark, sf_dir, "documents"), ranks(), public_tokenizers.PATTERN, outputs=("n_tokens", "ids_sha256", "decoded_sha256")
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = fingerprint.with_next(fingerprint.fingerprint(docs, "text", "fingerprint"), "doc_id", ["text", "fingerprint"])
    rows = rows.select("doc_id", "text", "fingerprint", "next_fingerprint", fingerprint.edited(F.col("text"), F.col("next_text")).alias("edit"))
    rows = fingerprint.fingerprint(rows, "edit", "edited_fingerprint")
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edit", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        fingerprint.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        fingerprint.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(labels.where(~held_out()), docs)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"))


def op9_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in, long ones are counted anew by another tokenizer version, short Spanish ones go; the
    second batch is delivered twice."""
    docs = table(spark, sf_dir, "documents").select("source", "lang", "n_chars", rollup.word_count(F.col("text")).alias("words"), rollup.byte_count(F.col("text")).alias("quads"))
    docs = materialize(docs, "counts")  # texts are counted once, whatever number of batches takes part of them
    change = lambda op, version, tokens: [F.lit(op).alias("op"), F.lit(version).alias("version"), tokens.alias("tokens")]
    old = [F.lit("words-1").alias("old_version"), F.col("words").alias("old_tokens")]
    none = F.lit(None).cast("long")
    batches = {
        1: docs.select("source", "lang", *change("insert", "words-1", F.col("words")), F.lit(None).cast("string").alias("old_version"), none.alias("old_tokens")),
        2: docs.where("n_chars >= 2000").select("source", "lang", *change("revise", "bytes-1", F.col("quads")), *old),
        3: docs.where("lang = 'es' AND n_chars < 500").select("source", "lang", *change("delete", None, none), *old),
    }
    totals = rollup.Rollup(spark, shared_dir(spark, "token-rollup"))
    for n in (1, 2, 3, 2):
        totals.apply(n, batches[n])
    return totals.totals()


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align.align(table(spark, sf_dir, "documents"), vocabulary(A_TOKENS), vocabulary(B_TOKENS), groups=("groups_sha256",))
    return out.select("doc_id", *align.MADE, "groups_sha256")


def op13_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = personal.scan(docs, personal.fit(docs))
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[n(k).alias(f"n_{personal.KINDS[k]}") for k in range(personal.BASE)],
        F.sha2(personal.joined(base_only=True), 256).alias("base_sha256"),
        personal.joined().alias("spans"),
    )


QUERIES = {
    f.__name__: f
    for f in (op1_secrets, op2_mixing, op3_byte_bpe, op4_warc, op5_near_dup, op6_fingerprint, op7_toxicity, op8_ann, op9_token_rollup, op10_html_text, op11_collocations, op12_align, op13_personal)
}
_NIBBLES = "".join(f"{i:04b}" for i in range(16))
_QUINTETS = " ".join(f"{i:05b}" for i in range(32))
_BITS = f"array_to_string(list_transform(range(1, 41), lambda i: substr('{_NIBBLES}', 4 * (strpos('0123456789abcdef', substr(h, i, 1)) - 1) + 1, 4)), '')"
_BASE32 = f"array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (strpos('{_QUINTETS}', substr(bits, 5 * i + 1, 5)) - 1) // 6 + 1, 1)), '')"
_CLEAN = "replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&#39;', chr(39)), '&amp;', '&')"
ORACLES: dict[str, str] = {
    "op4_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, {_BITS} AS bits, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to FROM b""",
    # The given pages hold their text in one article element.
    "op10_html_text": rf"""
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM (
  SELECT page_id, url, array_to_string(list_filter(list_transform(string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>'),
    lambda x: trim(regexp_replace({_CLEAN}, '[ \t\n\r\f]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM pages)""",
    "op2_mixing": mixing.oracle(),
    "op11_collocations": phrases.oracle(),
    "op9_token_rollup": r"""
WITH d AS (
  SELECT source, lang, n_chars, CAST(ceil(coalesce(octet_length(encode(text)), 0) / 4) AS BIGINT) AS quads,
    CASE WHEN trim(coalesce(text, ''), E' \t\n\r\f') = '' THEN 0 ELSE len(string_split_regex(trim(text, E' \t\n\r\f'), '[ \t\n\r\f]+')) END AS words
  FROM documents),
s AS (
  SELECT source, lang, 'words-1' AS version, 1 AS docs, words AS tokens FROM d
  UNION ALL SELECT source, lang, 'words-1', -1, -words FROM d WHERE n_chars >= 2000
  UNION ALL SELECT source, lang, 'bytes-1', 1, quads FROM d WHERE n_chars >= 2000
  UNION ALL SELECT source, lang, 'words-1', -1, -words FROM d WHERE lang = 'es' AND n_chars < 500)
SELECT source, lang, version, CAST(sum(docs) AS BIGINT) AS docs, CAST(sum(tokens) AS BIGINT) AS tokens FROM s
GROUP BY source, lang, version HAVING sum(docs) <> 0 OR sum(tokens) <> 0""",
}
