"""Clock formatting and parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _two(c: Column) -> Column:
    s = c.cast("bigint").cast("string")
    return F.when(F.length(s) < 2, F.concat(F.lit("0"), s)).otherwise(s)


def fmt_mmss(t: Column) -> Column:
    """Seconds as ``MM:SS``, fractions dropped; minutes may exceed 99."""
    whole = F.floor(t).cast("bigint")
    return F.concat(_two(F.floor(whole / 60)), F.lit(":"), _two(whole % 60))


def fmt_mmss_rounded(t: Column) -> Column:
    """Non-negative seconds as ``MM:SS`` after rounding half to even."""
    return fmt_mmss(F.greatest(F.bround(t.cast("double"), 0), F.lit(0.0)))


def fmt_hhmm(t: Column) -> Column:
    """Seconds as ``HH:MM``: rounded to a whole second, then cut to the minute."""
    whole = F.greatest(F.bround(t.cast("double"), 0), F.lit(0.0)).cast("bigint")
    return F.concat(_two(F.floor(whole / 3600)), F.lit(":"), _two(F.floor(whole % 3600 / 60)))


def fmt_duration(t: Column) -> Column:
    """``12.3s``, ``3m 5s`` or ``1h 2m 3s``."""
    n = t.cast("double")
    minutes = F.floor(n / 60)
    sec = F.format_string("%.0fs", F.bround(n % 60, 0))
    return (
        F.when(n < 60, F.format_string("%.1fs", n))
        .when(minutes < 60, F.format_string("%dm %s", minutes, sec))
        .otherwise(F.format_string("%dh %dm %s", F.floor(minutes / 60), minutes % 60, sec))
    )


def parse_mmss(c: Column) -> Column:
    """``MM:SS`` to seconds; null when malformed, negative or ``SS >= 60``."""
    parts = F.split(F.trim(c), ":")
    m, s = F.get(parts, F.lit(0)).try_cast("int"), F.get(parts, F.lit(1)).try_cast("int")
    ok = (F.size(parts) == 2) & (m >= 0) & (s >= 0) & (s < 60)
    return F.when(ok, m * 60 + s)


def parse_iso_utc(c: Column) -> Column:
    """ISO-8601 text as a timestamp; text without an offset means UTC."""
    has_zone = c.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.try_to_timestamp(F.when(has_zone, c).otherwise(F.concat(c, F.lit("Z"))))
