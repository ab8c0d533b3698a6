"""Instants: the strict timestamp grammar, ISO output, local days and hours.  Column builders."""

from __future__ import annotations

from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: YYYY-MM-DD, optionally T or space HH:mm[:ss[.f]], optionally Z or an offset
GRAMMAR = r"^(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2})(?:\.(\d+))?)?(Z|[+-]\d{2}:\d{2})?)?\z"
MAX_MS = 8_640_000_000_000_000


def parse_ms(text: Column) -> Column:
    """Epoch milliseconds of an ISO string, or null.  No offset is UTC; a day past
    the month's end rolls over; fractions are cut to milliseconds."""

    def number(start: int, length: int = 2) -> Column:
        return F.coalesce(F.substring(text, start, length).try_cast("bigint"), F.lit(0))

    # what fits the grammar has its parts in fixed places, but for the zone, which ends it
    year, month, day, hour, minute = number(1, 4), number(6), number(9), number(12), number(15)
    second = F.when(F.substring(text, 17, 1) == ":", number(18)).otherwise(0)
    fraction = F.when(F.substring(text, 20, 1) == ".", F.regexp_replace(F.substring(text, 21, 3), r"\D.*", ""))
    milli = F.rpad(fraction, 3, "0").try_cast("bigint")
    sign = F.when(F.length(text) > 21, F.substring(text, -6, 1))
    offset = F.when(sign.isin("+", "-"), (number(-5) * 60 + number(-2)) * F.when(sign == "-", -1).otherwise(1)).otherwise(0)
    fits = text.rlike(GRAMMAR) & month.between(1, 12) & day.between(1, 31) & (hour < 24) & (minute < 60) & (second < 60)
    first = F.make_date(year.cast("int"), F.when(month.between(1, 12), month).otherwise(1).cast("int"), F.lit(1))
    days = F.unix_date(first).cast("bigint") + day - 1
    ms = ((days * 24 + hour) * 60 + minute - offset) * 60_000 + second * 1000 + F.coalesce(milli, F.lit(0))
    return F.when(fits, ms)


def iso(ms: Column) -> Column:
    """YYYY-MM-DDTHH:mm:ss.mmmZ of epoch milliseconds; null out of range.  Needs no session zone."""
    day = F.date_from_unix_date(F.floor(ms / 86_400_000).cast("int"))
    rest = F.pmod(ms, F.lit(86_400_000))
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    clock = F.concat(pad(F.floor(rest / 3_600_000), 2), F.lit(":"), pad(F.floor(rest / 60_000) % 60, 2), F.lit(":"), pad(F.floor(rest / 1000) % 60, 2), F.lit("."), pad(rest % 1000, 3), F.lit("Z"))
    return F.when(F.abs(ms) <= MAX_MS, F.concat(day.cast("string"), F.lit("T"), clock))


def zone(name: str | None) -> str:
    """A zone that Spark knows: the given one, else (unknown) UTC; None is the system's."""
    if name is None:
        import datetime

        return getattr(datetime.datetime.now().astimezone().tzinfo, "key", None) or _system_zone()
    try:
        ZoneInfo(name)
        return name
    except (KeyError, ValueError, OSError):
        return "UTC"


def _system_zone() -> str:
    import os

    link = os.path.realpath("/etc/localtime")
    name = os.environ.get("TZ") or (link.split("zoneinfo/")[-1] if "zoneinfo/" in link else "UTC")
    return zone(name)


def _local(ms: Column, tz: str) -> Column:
    """Wall-clock of an instant as a zone-free timestamp."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(secs=(ms / F.lit(1000).cast("decimal(20,0)")).cast("decimal(18,6)")))


def day_key(ms: Column, tz: str) -> Column:
    """The local civil date, or ``invalid-date``."""
    return F.coalesce(F.date_format(_local(ms, tz), "yyyy-MM-dd"), F.lit("invalid-date"))


def within_hour(ms: Column, tz: str) -> Column:
    """Milliseconds since the local hour began."""
    local = _local(ms, tz)
    return (F.minute(local) * 60_000 + F.second(local) * 1000).cast("bigint") + F.pmod(ms, F.lit(1000))
