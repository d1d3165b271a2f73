"""Incremental snapshots: what is new, changed, unchanged or gone, and the next manifest.

A manifest is (note_id, modified, path). A change counts from one millisecond on. What is gone is judged against all
current ids, not against a filtered selection, and a path once given is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE_MICROS = 1000


def _micros(name: str):
    return F.unix_micros(F.col(name).cast("timestamp"))


def diff(notes: DataFrame, manifest: DataFrame) -> DataFrame:
    """Current notes with ``status`` (new, changed, unchanged) and the manifest's path."""
    old = manifest.select("note_id", F.col("modified").alias("old_modified"), F.col("path").alias("old_path"), F.lit(1).alias("_known"))
    status = F.when(F.col("_known").isNull(), "new").when(_micros("modified") - _micros("old_modified") > TOLERANCE_MICROS, "changed").otherwise("unchanged")
    return notes.join(old, "note_id", "left").withColumn("status", status).drop("_known")


def gone(notes: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest rows whose note exists no more."""
    return manifest.join(notes.select("note_id"), "note_id", "left_anti")


def kept(notes: DataFrame, manifest: DataFrame) -> DataFrame:
    return manifest.join(notes.select("note_id"), "note_id", "left_semi")


def plan(notes: DataFrame, manifest: DataFrame) -> DataFrame:
    """(note_id, status, modified, path) of every id on either side, by one full outer join."""
    n = notes.select("note_id", F.col("modified").alias("new_modified"), F.lit(1).alias("_n"))
    m = manifest.select("note_id", F.col("modified").alias("old_modified"), "path", F.lit(1).alias("_m"))
    status = (
        F.when(F.col("_n").isNull(), "deleted").when(F.col("_m").isNull(), "new")
        .when(_micros("new_modified") - _micros("old_modified") > TOLERANCE_MICROS, "changed").otherwise("unchanged")
    )
    return n.join(m, "note_id", "full_outer").select("note_id", status.alias("status"), F.coalesce("new_modified", "old_modified").alias("modified"), "path")


def upsert(manifest: DataFrame, exported: DataFrame) -> DataFrame:
    """Old entries overwritten by exported ones of the same id."""
    return manifest.join(exported.select("note_id"), "note_id", "left_anti").unionByName(exported.select(*manifest.columns))


def merge_paths(allocated: DataFrame, manifest: DataFrame) -> DataFrame:
    """(note_id, path): the manifest's path where it has one, else the one allocated now."""
    a, m = allocated.select("note_id", F.col("path").alias("_a")), manifest.select("note_id", F.col("path").alias("_m"))
    return a.join(m, "note_id", "full_outer").select("note_id", F.coalesce("_m", "_a").alias("path"))


def apply(notes: DataFrame, manifest: DataFrame, allocated: DataFrame) -> DataFrame:
    """The manifest after a run over ``notes`` (all current ones) with ``allocated`` paths for new ids: each side is read
    once, and what has no note any more is left behind by the joins."""
    rows = diff(notes.select("note_id", "modified"), manifest).join(allocated.select("note_id", F.col("path").alias("_a")), "note_id", "left")
    same = F.col("status") == "unchanged"
    return rows.select(
        "note_id", F.when(same, F.col("old_modified")).otherwise(F.col("modified")).alias("modified"), F.when(same, F.col("old_path")).otherwise(F.coalesce("old_path", "_a")).alias("path")
    )


def delete_list(gone_entries: DataFrame, survivors: DataFrame) -> DataFrame:
    """(path, kind, depth): files of gone entries, and directories that hold nothing any more, deepest first in sorting."""

    def ancestors(df: DataFrame) -> DataFrame:
        parts = F.split("path", "/")
        ups = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
        return df.where(F.col("path").contains("/")).select(F.explode(ups).alias("path")).distinct()

    empty = ancestors(gone_entries).join(ancestors(survivors), "path", "left_anti").select("path", F.lit("directory").alias("kind"))
    out = gone_entries.select("path", F.lit("file").alias("kind")).unionByName(empty)
    return out.withColumn("depth", F.size(F.split("path", "/")))


def status(manifest: DataFrame) -> DataFrame:
    """One row: whether anything is tracked, the last change, tracked notes."""
    return manifest.agg((F.count("*") > 0).alias("found"), F.max("modified").alias("last_sync"), F.count("*").alias("tracked"))


def stat_columns() -> dict[str, Column]:
    """Aggregates of an export log of (status, failed_attachments): counts and success."""
    n = lambda status: F.count_if(F.col("status") == status)
    failed = F.coalesce(F.sum("failed_attachments"), F.lit(0))
    return {"exported": n("completed"), "failed": n("failed"), "skipped": n("skipped"), "failed_attachments": failed, "success": n("failed") == 0}


def run_stats(log: DataFrame) -> DataFrame:
    """One row of ``stat_columns``."""
    return log.agg(*[c.alias(k) for k, c in stat_columns().items()])
