"""Tables stored in the order in which they are joined, and an index of titles.

``store`` deals rows into buckets by a key and sorts them, so that joins on that key read both sides as they lie: nothing is
shuffled or sorted again. ``index_titles`` writes posting lists of three letters each, in their order, so that a search reads
the parts of the files that hold its letters; what has all of them is looked at in full.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.filters import by_title
from quire.sources.shared import scratch

BUCKETS = 64
GRAM = 3


def store(df: DataFrame, key: str, buckets: int = BUCKETS, name: str | None = None) -> DataFrame:
    """``df`` as a table in ``buckets`` by ``key``, sorted by it; its name is new unless given."""
    name = name or f"quire_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", scratch(df.sparkSession, name)).saveAsTable(name)
    return df.sparkSession.table(name)


def owned(refs: DataFrame, attachments: DataFrame) -> DataFrame:
    """``joins.owned`` for tables stored by attachment: joined by that alone, the note is compared in passing."""
    a = attachments.where(~F.col("deleted")).select(F.col("attachment_id").alias("_a"), F.col("note_id").alias("_n"))
    # A difference, since an equation would become a key of the join, by which the tables are not stored.
    return refs.join(a, (F.col("attachment_id") == F.col("_a")) & (F.col("note_id") - F.col("_n") == 0), "left_semi")


def _grams(text: Column) -> Column:
    chars = F.split(text, "")
    beside = lambda k: F.slice(chars, k, F.size(chars))
    pairs = F.zip_with(chars, beside(2), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.filter(F.zip_with(pairs, beside(3), lambda a, b: F.concat(a, b)), lambda g: F.length(g) == GRAM))


def index_titles(notes: DataFrame, path: str, column: str = "title", key: str = "note_id") -> None:
    """(gram, key) of every three letters of every title in lower case, in order; a frequent gram lies in many files."""
    rows = notes.where(F.length(column) >= GRAM).select(F.explode(_grams(F.lower(column))).alias("gram"), key)
    rows.repartitionByRange("gram", key).sortWithinPartitions("gram", key).write.parquet(path)


def _postings(spark: SparkSession, path: str, text: str) -> tuple[DataFrame, int]:
    grams = sorted({text[i : i + GRAM] for i in range(len(text) - GRAM + 1)})
    return spark.read.parquet(path).where(F.col("gram").isin(grams)), len(grams)


def search_titles(notes: DataFrame, path: str, text: str, column: str = "title", key: str = "note_id") -> DataFrame:
    """``by_title`` through an index; texts of fewer than three letters are looked for in all titles. Keys are unique."""
    text = text.lower()
    if len(text) < GRAM:
        return by_title(notes, text)
    found, n = _postings(notes.sparkSession, path, text)
    ids = found.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") == n).select(key)
    return notes.join(ids, key, "left_semi").where(F.lower(column).contains(text))


def files_read(spark: SparkSession, path: str, text: str) -> tuple[int, int]:
    """Files of an index that hold letters of a search, and all of its files."""
    held = _postings(spark, path, text.lower())[0].select("_metadata.file_path").distinct().count()
    return held, len(spark.read.parquet(path).inputFiles())
