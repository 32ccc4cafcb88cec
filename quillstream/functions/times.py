"""Dates: parsing, epochs, local days, weekday masks and next runs."""

from __future__ import annotations

from datetime import datetime, time, timedelta
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Shanghai"
FORMATS = ["yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd HH:mm", "yyyy/MM/dd", "yyyy.MM.dd", "d MMM yyyy HH:mm:ss Z", "yyyy年M月d日", "yyyy年M月"]


def parse_known(text: Column, formats: list[str] = FORMATS) -> Column:
    """The first format that fits; without an offset the time is UTC, without a day the first of the month."""
    return F.coalesce(*[F.try_to_timestamp(F.regexp_replace(F.trim(text), "^[A-Za-z]{3}, ", ""), F.lit(f)) for f in formats])


def parse_relative(text: Column, now: Column) -> Column:
    """N minutes, hours or days ago, yesterday, the day before."""
    n = F.expr("1") * F.try_to_number(F.nullif(F.regexp_extract(text, r"(\d{1,6})", 1), F.lit("")), F.lit("999999"))
    unit = F.when(text.rlike(r"(?i)分钟前|minutes? ago"), 60).when(text.rlike(r"(?i)小时前|hours? ago"), 3600).when(text.rlike(r"(?i)天前|days? ago"), 86400)
    seconds = F.when(text.rlike(r"(?i)^昨天|^yesterday"), 86400).when(text.rlike("^前天"), 172800).otherwise(n * unit)
    return F.timestamp_seconds(F.unix_timestamp(now) - seconds)


def parse_datetime(text: Column, now: Column) -> Column:
    return F.coalesce(parse_known(text), parse_relative(text, now))


def from_epoch(value: Column, unit: str) -> Column:
    """Seconds or milliseconds, positive ones only."""
    made = F.timestamp_seconds(value) if unit == "s" else F.timestamp_millis(value)
    return F.when(value > 0, made)


def day_start(day: Column, zone: str = ZONE) -> Column:
    """The moment at which a local day begins."""
    return F.to_utc_timestamp(day.cast("timestamp"), zone)


def day_bounds(day: Column, zone: str = ZONE) -> tuple[Column, Column]:
    return day_start(day, zone), day_start(F.date_add(day, 1), zone)


QUICK = {"today": 0, "3d": 2, "7d": 6, "30d": 29}


def quick_start(name: str, now: Column, zone: str = ZONE) -> Column:
    return day_start(F.date_sub(F.to_date(F.from_utc_timestamp(now, zone)), QUICK[name]), zone)


def deadline(text: Column, zone: str = ZONE) -> Column:
    """The end of the local day named within 30 characters after the word for a deadline."""
    near = F.regexp_extract(text, r"截止.{0,30}", 0)
    d = [F.try_to_number(F.nullif(F.regexp_extract(near, r"(\d{4})[年/.-](\d{1,2})[月/.-](\d{1,2})", i), F.lit("")), F.lit("9999")).cast("int") for i in (1, 2, 3)]
    return F.to_utc_timestamp(F.try_make_timestamp(*d, F.lit(23), F.lit(59), F.lit(59)), zone)


def weekday_mask(days: Column) -> Column:
    """Array of 0 (Monday) to 6 as a bit mask."""
    return F.aggregate(F.array_distinct(days), F.lit(0), lambda a, d: a + F.expr("1") * F.pow(F.lit(2), d).cast("int"))


def has_weekday(mask: Column, day: Column) -> Column:
    """day: a date; Monday is bit 0."""
    return F.bitwise_and(mask, F.pow(F.lit(2), F.weekday(day)).cast("int")) > 0 if hasattr(F, "bitwise_and") else mask.bitwiseAND(F.pow(F.lit(2), F.weekday(day)).cast("int")) > 0


def run_state(now: Column, target: Column) -> Column:
    """Of a scheduled run: waiting, due (less than a minute late), or missed, which is dropped; null without a target."""
    late = F.unix_micros(now) - F.unix_micros(target)
    return F.when(late < 0, "waiting").when(late < 60_000_000, "due").when(target.isNotNull(), "missed")


def next_run_one(now: datetime, mask: int, hour: int, minute: int, zone: str) -> datetime | None:
    """The next local HH:MM on a chosen weekday: a skipped wall time passes to the next chosen day, of an
    ambiguous one the later moment holds."""
    tz = ZoneInfo(zone)
    local = now.astimezone(tz)
    for ahead in range(0, 16):
        day = local.date() + timedelta(days=ahead)
        if not mask >> day.weekday() & 1:
            continue
        at = datetime.combine(day, time(hour, minute), tz).replace(fold=1)
        moment = at.astimezone(ZoneInfo("UTC"))
        if moment.astimezone(tz).replace(tzinfo=None) != at.replace(tzinfo=None):
            continue
        if moment > now:
            return moment
    return None


def next_run_udf(zone: str):
    @F.pandas_udf("timestamp")
    def run(now: pd.Series, mask: pd.Series, hour: pd.Series, minute: pd.Series) -> pd.Series:
        utc = ZoneInfo("UTC")
        got = [next_run_one(n.to_pydatetime().replace(tzinfo=utc) if n.tzinfo is None else n.to_pydatetime().astimezone(utc), int(m), int(h), int(i), zone) for n, m, h, i in zip(now, mask, hour, minute, strict=True)]
        return pd.Series([g.replace(tzinfo=None) if g else None for g in got], dtype="datetime64[ns]")

    return run
