"""Exact conversions between timestamps and ticks (100 ns since the Unix epoch, UTC); none depends on the session's time zone."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

PER_SECOND = 10_000_000
PER_DAY = 86_400 * PER_SECOND
PER_UNIT = {"second": PER_SECOND, "minute": 60 * PER_SECOND, "hour": 3600 * PER_SECOND, "day": PER_DAY, "week": 7 * PER_DAY}
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def to_ticks(when: datetime | int | str) -> int:
    """Ticks of a datetime (naive: UTC), of an ISO string, or of ticks themselves."""
    if isinstance(when, bool):
        raise TypeError("a boolean is no time")
    if isinstance(when, int):
        return when
    at = datetime.fromisoformat(when) if isinstance(when, str) else when
    span = (at if at.tzinfo else at.replace(tzinfo=UTC)) - _EPOCH
    return (span.days * 86_400 + span.seconds) * PER_SECOND + span.microseconds * 10


def to_datetime(ticks: int) -> datetime:
    return _EPOCH + timedelta(microseconds=ticks // 10)


def span_ticks(span: timedelta) -> int:
    return (span.days * 86_400 + span.seconds) * PER_SECOND + span.microseconds * 10


def seconds_of(value: float, scale: str) -> float:
    """Seconds in value units of scale; a month has 30 days and a year 365."""
    return value * {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86_400, "weeks": 604_800, "months": 2_592_000, "years": 31_536_000}[scale]


def ticks_of(ts: Column) -> Column:
    """Ticks of a TIMESTAMP_NTZ column, read as UTC."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz")) * F.lit(10).cast("long")


def modulo(v: Column, base: Column) -> Column:
    """Remainder with the sign of base, as floor division leaves it; null for base 0."""
    b = F.nullif(base, F.lit(0).cast("long"))
    return F.try_mod(F.try_mod(v, b) + b, b)


def day_of(ticks: Column) -> Column:
    """The DATE (UTC) of ticks, before the epoch too."""
    return F.date_from_unix_date(((ticks - modulo(ticks, F.lit(PER_DAY))) / F.lit(PER_DAY)).cast("int"))


def of_date(date: Column) -> Column:
    return F.unix_date(date).cast("long") * F.lit(PER_DAY)


def truncate(ticks: Column, unit: str) -> Column:
    if unit in ("month", "year"):
        return of_date(F.trunc(day_of(ticks), unit))
    shift = F.lit(3 * PER_DAY if unit == "week" else 0)  # the epoch was a Thursday, weeks start on Monday
    return ticks - modulo(ticks + shift, F.lit(PER_UNIT[unit]))


def part(ticks: Column, unit: str) -> Column:
    if unit in ("second", "minute", "hour"):
        size, of = {"second": (PER_SECOND, 60), "minute": (60 * PER_SECOND, 60), "hour": (3600 * PER_SECOND, 24)}[unit]
        return F.floor(modulo(ticks, F.lit(size * of)) / F.lit(size)).cast("long")
    date = day_of(ticks)
    return {"day": F.dayofmonth, "month": F.month, "year": F.year, "week_day": F.weekday}[unit](date).cast("long")


def parse_text(text: Column) -> Column:
    """Ticks of ISO-like text; text without a full date gives null, an offset is applied, none means UTC."""
    full = text.rlike(r"^\s*\d{4}-\d{1,2}-\d{1,2}")
    offset = text.rlike(r"\d{1,2}:\d{2}.*(Z|UTC|[+-]\d{1,2}(:?\d{2})?)\s*$")
    absolute = F.unix_micros(text.try_cast("timestamp")) * F.lit(10).cast("long")
    return F.when(full & offset, absolute).when(full, ticks_of(text.try_cast("timestamp_ntz")))


def format_text(ticks: Column, date_only: bool) -> Column:
    date = day_of(ticks).cast("string")
    if date_only:
        return date
    return F.concat(date, F.lit("T"), F.concat_ws(":", *(F.lpad(part(ticks, u).cast("string"), 2, "0") for u in ("hour", "minute", "second"))))
