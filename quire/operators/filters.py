"""Filters and projections of notes, folders and attachments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.strings import c, trimmed
from quire.functions.types import is_file

# Account types.
ACCOUNT_TYPES = {0: "On My Mac", 1: "Exchange", 2: "IMAP", 3: "iCloud", 4: "Google"}


def by_name(notes: DataFrame, dim: DataFrame, key: str, text: str) -> DataFrame:
    """Notes whose account or folder name contains ``text``, whatever the case."""
    return notes.join(dim.where(F.lower("name").contains(text.lower())).select(key), key, "left_semi")


def by_exact_name(notes: DataFrame, dim: DataFrame, key: str, text: str) -> DataFrame:
    """Notes whose account or folder has this name, whatever the case; an empty text filters nothing."""
    return notes if not text else notes.join(dim.where(F.lower("name") == text.lower()).select(key), key, "left_semi")


def by_collated_name(notes: DataFrame, dim: DataFrame, key: str, text: str) -> DataFrame:
    """The same by the letters of any language (Unicode, without case). The condition is not pushed to the scan of ``dim``,
    which is the small side."""
    return notes if not text else notes.join(dim.where(F.collate("name", "UNICODE_CI") == F.lit(text)).select(key), key, "left_semi")


def by_title(notes: DataFrame, text: str) -> DataFrame:
    return notes.where(F.lower("title").contains(text.lower()))


def between_strictly(notes: DataFrame, column: str, after: Column | None = None, before: Column | None = None) -> DataFrame:
    """Later than ``after`` and earlier than ``before``; the bounds themselves are out."""
    if after is not None:
        notes = notes.where(F.col(column) > after)
    return notes if before is None else notes.where(F.col(column) < before)


def in_range(notes: DataFrame, start: Column | None = None, end: Column | None = None, column: str = "modified") -> DataFrame:
    """The bounds included; a missing one is open."""
    if start is not None:
        notes = notes.where(F.col(column) >= start)
    return notes if end is None else notes.where(F.col(column) <= end)


def by_ids(notes: DataFrame, ids: str, key: str = "note_id") -> DataFrame:
    """Ids from a comma-separated list."""
    return notes.where(F.col(key).isin([int(x) for x in ids.split(",") if x.strip()]))


def live(df: DataFrame, flag: str = "deleted") -> DataFrame:
    return df.where(~F.coalesce(F.col(flag).cast("boolean"), F.lit(False))) if flag in df.columns else df


def unlocked(df: DataFrame, flag: str = "locked") -> DataFrame:
    return live(df, flag)


def file_attachments(atts: DataFrame, column: str = "type") -> DataFrame:
    return atts.where(is_file(column))


def has_data(df: DataFrame, column: str = "data") -> DataFrame:
    return df.where(F.length(column) > 0)


def export_log(log: DataFrame, failed_only: bool = False) -> DataFrame:
    return log.where(F.col("status") == "failed") if failed_only else log


def title(name: Column | str, created: Column | str) -> Column:
    """The trimmed title, or the day of creation where it is null or blank."""
    return F.coalesce(F.nullif(trimmed(name), F.lit("")), F.date_format(c(created), "yyyy-MM-dd"))


def account_type(code: Column | str) -> Column:
    out = F.when(c(code) == 0, ACCOUNT_TYPES[0])
    for k, v in list(ACCOUNT_TYPES.items())[1:]:
        out = out.when(c(code) == k, v)
    return out.otherwise(ACCOUNT_TYPES[3])


def attachment_name(filename: Column | str, ident: Column | str) -> Column:
    last = F.element_at(F.split(c(ident).cast("string"), "/"), -1)
    return F.coalesce(c(filename), last, F.lit("Unnamed"))
