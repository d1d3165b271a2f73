"""Dates: parsing, formats, epochs. The session time zone is expected to be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.strings import c

#: Fixed value: seconds from 1970-01-01 to 2001-01-01.
EPOCH_2001 = 978_307_200
#: Prefix patterns, and long English dates without the weekday.
PREFIXES = ("yyyy-MM-dd", "yyyyMMdd", "yyyy-MM", "dd-MM-yyyy", "MM-dd-yyyy", "yyyy-MM-dd HHmm")
LONG = ("MMMM d, yyyy 'at' h:mm:ss a", "MMM d, yyyy 'at' h:mm:ss a", "MMMM d, yyyy, h:mm:ss a", "MMM d, yyyy, h:mm:ss a")
FORMATS = {
    "iso": "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'",
    "rfc822": "EEE, dd MMM yyyy HH:mm:ss '+0000'",
    "compact": "yyyyMMdd'T'HHmmss'Z'",
    "org": "yyyy-MM-dd EEE HH:mm",
}


def from_epoch(seconds: Column | str) -> Column:
    """Seconds since 2001 as a time without zone (UTC)."""
    return F.timestamp_micros(F.round((c(seconds) + EPOCH_2001) * 1_000_000).cast("bigint")).cast("timestamp_ntz")


def to_epoch(ts: Column | str) -> Column:
    """Seconds since 2001, as double."""
    return F.unix_micros(c(ts).cast("timestamp")) / 1_000_000 - EPOCH_2001


def formatted(ts: Column | str, kind: str) -> Column:
    return F.date_format(c(ts), FORMATS[kind])


def date_prefix(ts: Column | str, pattern: str = PREFIXES[0]) -> Column:
    if pattern not in PREFIXES:
        raise ValueError(f"pattern must be one of {PREFIXES}")
    return F.concat(F.date_format(c(ts), pattern), F.lit(" "))


def parse_date(text: Column | str) -> Column:
    """ISO with or without a fraction, or a plain date, as UTC; anything else fails the query instead of being ignored."""
    t = c(text)
    got = F.coalesce(*[F.try_to_timestamp(t, F.lit(p)) for p in ("yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd")])
    return F.when(t.isNotNull(), F.coalesce(got, F.raise_error(F.concat(F.lit("not a date: "), t)).cast("timestamp"))).cast("timestamp_ntz")


def parse_date_multi(text: Column | str) -> Column:
    """Long English dates, with or without a weekday; null where no pattern fits."""
    t = F.regexp_replace(c(text), r"^[A-Za-z]+, (?=[A-Z])", "")
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(p)) for p in LONG]).cast("timestamp_ntz")
