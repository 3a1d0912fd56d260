"""Time expressions.  Every rule takes ``as_of``: there is no wall clock in the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col

WINDOWS = {"24h": "24 hours", "7d": "7 days", "30d": "30 days"}


def as_column(as_of) -> Column:
    """``as_of`` may be a Column (also a scalar subquery) or a timestamp literal."""
    return as_of if isinstance(as_of, Column) else F.lit(as_of)


def minus(as_of, interval: str) -> Column:
    return as_column(as_of) - F.expr(f"interval {interval}")


def window_since(window: str, as_of) -> Column | None:
    """Lower bound of a listing window; ``None`` for ``all`` and unknown names."""
    return minus(as_of, WINDOWS[window]) if window in WINDOWS else None


def epoch_micros(ts) -> Column:
    return F.unix_micros(_col(ts).cast("timestamp"))


def hours_between(later, earlier) -> Column:
    return (epoch_micros(later) - epoch_micros(earlier)) / F.lit(3_600_000_000.0)


def parse_pub_date(iso, pub) -> Column:
    """First of the two texts that is present, as a timestamp; invalid dates are null."""
    raw = F.coalesce(_col(iso), _col(pub))
    rfc822 = F.regexp_replace(raw, r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(
        F.try_to_timestamp(raw),
        F.try_to_timestamp(rfc822, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(rfc822, F.lit("d MMM yyyy HH:mm:ss z")),
    )


def local_day(ts, zone: str = "Europe/Madrid") -> Column:
    return F.date_format(F.from_utc_timestamp(_col(ts).cast("timestamp"), zone), "yyyy-MM-dd")


def local_weekday(ts, zone: str = "Europe/Madrid") -> Column:
    return F.date_format(F.from_utc_timestamp(_col(ts).cast("timestamp"), zone), "EEEE")


def format_local(ts, zone: str = "Europe/Madrid", pattern: str = "d/M/yyyy, H:mm") -> Column:
    text = F.date_format(F.from_utc_timestamp(_col(ts).cast("timestamp"), zone), pattern)
    return F.coalesce(text, F.lit("—"))
