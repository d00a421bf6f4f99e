"""Times and trading days (T1-T10, P11). Instants are UTC; the market's zone is given, and the session's has no say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.config import HOLIDAYS

#: Korea's time: Asia/Seoul without its summer times and changes before 1989.
ZONE = "+09:00"
_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def instant(df: DataFrame, column: str) -> Column:
    """The column as a timestamp. A timestamp_ntz is UTC: a cast would take it for the session's local time, which skips and repeats
    hours where there is summer time."""
    if df.schema[column].dataType.typeName() != "timestamp_ntz":
        return F.col(column).cast("timestamp")
    return F.timestamp_micros(_micros(F.col(column)))


def _micros(wall: Column) -> Column:
    """Microseconds since 1970 of a timestamp_ntz, whatever the session's zone."""
    return ((wall - F.expr(_EPOCH)).cast("interval second").cast("decimal(24,6)") * 1_000_000).cast("long")


def local(ts: Column, zone: str = ZONE) -> Column:
    """The wall clock of a zone, a timestamp_ntz."""
    utc = F.timestamp_add("MICROSECOND", F.unix_micros(ts), F.expr(_EPOCH))
    return utc if zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def trade_date(ts: Column, zone: str | None = ZONE) -> Column:
    """T1; without a zone the UTC date."""
    return F.to_date(local(ts, zone or "UTC"))


def day_start(ts: Column, zone: str | None = ZONE) -> Column:
    """The instant at which the local (or UTC) day of ts began."""
    start = trade_date(ts, zone).cast("timestamp_ntz")
    return F.timestamp_micros(_micros(F.convert_timezone(F.lit(zone), F.lit("UTC"), start) if zone else start))


def quiet_hours(ts: Column) -> Column:
    """T5: from 22 to 7 o'clock local time."""
    hour = F.hour(local(ts))
    return (hour >= 22) | (hour < 7)


def market_status(ts: Column, holidays: tuple[str, ...] = HOLIDAYS) -> Column:
    """T6."""
    t = local(ts)
    minute = F.hour(t) * 60 + F.minute(t)
    closed = F.dayofweek(t).isin(1, 7) | F.to_date(t).cast("string").isin(*holidays)
    return F.when(closed, "CLOSED").when((minute >= 480) & (minute < 540), "PRE_MARKET").when((minute >= 540) & (minute < 930), "OPEN").when((minute >= 930) & (minute < 960), "AFTER_MARKET").otherwise("CLOSED")


def is_pre_market(ts: Column) -> Column:
    """T7."""
    return F.hour(local(ts)) < 8


def within_days(day: Column, end: Column, n: int) -> Column:
    """The n days that end with `end`."""
    return day.between(F.date_sub(end, n - 1), end)


def fixed_window(ts: Column, seconds: Column | int) -> Column:
    """Number of the window of so many seconds since the epoch, cut towards zero before it as in the SQL."""
    return F.call_function("div", F.unix_millis(ts), F.lit(seconds).cast("long") * 1000)


def within(ts: Column, now: Column, seconds: int) -> Column:
    """No older than so many seconds."""
    return F.unix_micros(ts) >= F.unix_micros(now) - seconds * 1_000_000


def relative_time(ts: Column, now: Column) -> Column:
    """P11."""
    minutes = F.floor((F.unix_millis(now) - F.unix_millis(ts)) / 60000).cast("long")
    return (
        F.when(minutes < 1, F.lit("방금 전"))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("분 전")))
        .when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("long").cast("string"), F.lit("시간 전")))
        .otherwise(trade_date(ts).cast("string"))
    )
