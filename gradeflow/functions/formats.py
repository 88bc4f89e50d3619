"""Numbers, durations and packed notes as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BETA = r"beta_s=([^,\s]+)"
BETA_FIRST = r"^beta_s=[^,]+,?\s*"


def four_places(x: Column) -> Column:
    """Four decimals, half to even."""
    return F.format_string("%.4f", F.bround(x, 4))


def percent(x: Column) -> Column:
    """Two decimals at most, and a percent sign."""
    return F.concat(F.regexp_replace(F.regexp_replace(F.format_string("%.2f", F.bround(x, 2)), r"(\.\d*?)0+$", "$1"), r"\.$", ""), F.lit("%"))


def duration(seconds: Column) -> Column:
    """Seconds, minutes and seconds, or hours, minutes and seconds."""
    whole = F.floor(seconds).cast("long")
    minutes, hours = F.floor(whole / 60).cast("long"), F.floor(whole / 3600).cast("long")
    text = lambda *parts: F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    return (
        F.when(seconds < 60, F.concat(F.format_string("%.1f", seconds), F.lit("s")))
        .when(minutes < 60, text(minutes, "m ", whole % 60, "s"))
        .otherwise(text(hours, "h ", minutes % 60, "m ", whole % 60, "s"))
    )


def run_stamp(ts: Column) -> Column:
    """Sortable time stamp of a run's name."""
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def beta_of(notes: Column) -> Column:
    """The value of beta_s in packed notes; null without one."""
    return F.nullif(F.regexp_extract(F.coalesce(notes, F.lit("")), BETA, 1), F.lit(""))


def notes_without_beta(notes: Column) -> Column:
    """Notes without a leading beta_s."""
    return F.regexp_replace(F.trim(F.coalesce(notes, F.lit(""))), BETA_FIRST, "")
