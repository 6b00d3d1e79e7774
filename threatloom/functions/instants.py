"""Instants: ISO text, epoch seconds, freshness."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss'Z'"

# Accepted text forms of an instant.
ISO_UTC_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?Z$"
ISO_LOOSE_PATTERN = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,6})?)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
ZONE_PATTERN = r"(Z|[+-]\d{2}:?\d{2})$"

EPOCH_TOLERANCE_S = 120
CLOCK_SKEW_S = 300


def parse_instant(text: Column) -> Column:
    """ISO-8601 text to a timestamp, null when unreadable; no zone means UTC."""
    day_only = text.rlike(r"^\d{4}-\d{2}-\d{2}$")
    zoned = (
        F.when(day_only, F.concat(text, F.lit("T00:00:00Z")))
        .when(text.substr(11, 40).rlike(ZONE_PATTERN), text)
        .otherwise(F.concat(text, F.lit("Z")))
    )
    return F.when(text.rlike(ISO_LOOSE_PATTERN), F.try_to_timestamp(zoned))


def is_iso_utc(text: Column) -> Column:
    return F.coalesce(text.rlike(ISO_UTC_PATTERN), F.lit(False))


def iso_of(ts: Column) -> Column:
    """Timestamp to whole-second UTC text."""
    return F.date_format(ts, ISO_SECONDS)


def iso_of_epoch(epoch_s: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch_s), ISO_SECONDS)


def times_agree(ts_iso: Column, epoch_s: Column) -> Column:
    """False only when the text is readable and contradicts the epoch seconds."""
    stated = F.unix_seconds(parse_instant(ts_iso))
    return F.coalesce(F.abs(stated - epoch_s) <= EPOCH_TOLERANCE_S, F.lit(True))


def recency(observed_at: Column, now: Column, max_age_hours: float = 6.0) -> Column:
    """'fresh' or 'stale'. Blank, unreadable, far-future and old are stale.

    ``observed_at`` is text; ``now`` is a timestamp column or literal.
    """
    age_us = F.unix_micros(now) - F.unix_micros(parse_instant(observed_at))
    window_us = int(max(0.0, max_age_hours) * 3600 * 1_000_000)
    fresh = (age_us >= -CLOCK_SKEW_S * 1_000_000) & (age_us <= window_us)
    return F.when(fresh, F.lit("fresh")).otherwise(F.lit("stale"))


def utc_literal(iso: str) -> Column:
    """Literal timestamp; the caller pins the clock, nothing reads wall time."""
    return parse_instant(F.lit(iso))
