"""Times. Pages without a zone are Korean time; stored strings without a zone are UTC. The session's zone is UTC."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta, timezone
from email.utils import parsedate_to_datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

KST = timezone(timedelta(hours=9))
#: A date, and a time of day if there is one: year, month, day, half of the day, hour, minute, second.
_WRITTEN = r"(\d{4})[-./](\d{1,2})[-./](\d{1,2})(?:[ T]+(?:(오전|오후)\s*)?(\d{1,2}):(\d{2})(?::(\d{2}))?(?:\.\d+)?)?"


def _utc(t: datetime) -> str:
    return t.astimezone(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def _known_form(s: str) -> datetime:
    """ISO 8601 or RFC 822; without a zone, UTC."""
    try:
        t = datetime.fromisoformat(s)
    except ValueError:
        t = parsedate_to_datetime(s)
    return t if t.tzinfo else t.replace(tzinfo=UTC)


def parse_date(value: str | None) -> str:
    """A date alone stays a date; a time without zone is Korean; what cannot be read is ''."""
    s = (value or "").strip()
    m = re.fullmatch(_WRITTEN, s, re.ASCII)
    if m and not m[5]:
        return "-".join((m[1], m[2].zfill(2), m[3].zfill(2)))
    try:
        if not m:
            return _utc(_known_form(s))
        hour = int(m[5])
        if m[4] and hour <= 12:  # twelve hours of a half day
            hour = hour % 12 + 12 * (m[4] == "오후")
        return _utc(datetime(*(int(x) for x in m.group(1, 2, 3)), hour, int(m[6]), int(m[7] or 0), tzinfo=KST))
    except (ValueError, TypeError, IndexError, OverflowError):
        return ""


def parse_date_c(c: Column) -> Column:
    """parse_date() as a column, for what is written as a date, with or without a time of day, and for ISO 8601 with a zone."""
    s, pattern = F.trim(F.coalesce(c, F.lit(""))), F.lit(f"^{_WRITTEN}$")
    part = lambda i: F.regexp_extract(s, f"^{_WRITTEN}$", i)
    number = lambda i: F.coalesce(F.nullif(part(i), F.lit("")), F.lit("0")).cast("int")
    day = F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))
    hour = F.when((part(4) != "") & (number(5) <= 12), number(5) % 12 + F.when(part(4) == "오후", 12).otherwise(0)).otherwise(number(5))
    clock = F.concat_ws(":", F.lpad(hour.cast("string"), 2, "0"), part(6), F.lpad(F.coalesce(F.nullif(part(7), F.lit("")), F.lit("0")), 2, "0"))
    korean = F.try_to_timestamp(F.concat(day, F.lit(" "), clock, F.lit(" +09:00")), F.lit("yyyy-MM-dd HH:mm:ss XXX"))
    zoned = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}T.*(?:Z|[+-]\d{2}:?\d{2})$"), s.try_cast("timestamp"))
    stamp = F.date_format(F.when(F.regexp_like(s, pattern), korean).otherwise(zoned), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.when(F.regexp_like(s, pattern) & (part(5) == ""), day).otherwise(F.coalesce(stamp, F.lit("")))


def stored_time(c: Column) -> Column:
    """A stored string as a time, to the second; null if it cannot be read."""
    return F.date_trunc("second", c.try_cast("timestamp"))


def effective_time(published: Column, fetched: Column) -> Column:
    """When an article counts as published."""
    return stored_time(F.coalesce(F.nullif(published, F.lit("")), fetched))


def korea(c: Column) -> Column:
    return F.from_utc_timestamp(c, "Asia/Seoul")


def korea_day(c: Column) -> Column:
    return F.date_format(korea(c), "yyyy-MM-dd")


def korea_month(c: Column) -> Column:
    return F.date_format(korea(c), "yyyy-MM")


def day_start(c: Column) -> Column:
    """The instant at which the Korean day of c starts."""
    return F.to_utc_timestamp(F.date_trunc("day", korea(c)), "Asia/Seoul")


def month_start(c: Column) -> Column:
    return F.to_utc_timestamp(F.date_trunc("month", korea(c)), "Asia/Seoul")


def is_date_only(c: Column) -> Column:
    return c.rlike(r"(?s)\A.{4}-.{2}-.{2}\z")


def shown_time(published: Column) -> Column:
    """Noon in Korea stands for an unknown time of day: only its date is shown."""
    return F.when(published.endswith("T03:00:00.000Z"), F.substring(published, 1, 10)).otherwise(published)


def daily_allowance(target: Column, spent: Column, day: Column) -> Column:
    """What is left of a month's target, spread over the days left, today included."""
    left = F.dayofmonth(F.last_day(day)) - F.dayofmonth(day) + 1
    return F.floor(F.greatest(F.lit(0), target - spent) / left)


def cost_micro_usd(model: Column, tokens_in: Column, tokens_out: Column, prices: dict[str, tuple[float, float]]) -> Column:
    """Rounded up; an unknown model costs nothing. Prices: micro-USD a token, in and out."""
    out = F.lit(0).cast("long")
    for name, (a, b) in prices.items():
        out = F.when(model == name, F.ceil(tokens_in * a + tokens_out * b).cast("long")).otherwise(out)
    return out
