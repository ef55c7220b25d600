"""Cron expressions, durations, next runs and retries."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.udf import vectorized

#: Cron fields with their ranges, names by their first three letters, units in milliseconds.
FIELDS = (("minute", 0, 59), ("hour", 0, 23), ("day of month", 1, 31), ("month", 1, 12), ("day of week", 0, 7))
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
DAYS = "sun mon tue wed thu fri sat".split()
UNITS = {"ms": 1, "s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}
HORIZON_YEARS = 8


class CronError(ValueError):
    code = "CRON_INVALID"


def _value(s: str, name: str) -> int:
    low = s.strip().lower()
    if re.fullmatch("[0-9]+", low):
        return int(low)
    names = {"month": {m: k + 1 for k, m in enumerate(MONTHS)}, "day of week": {d: k for k, d in enumerate(DAYS)}}.get(name, {})
    if low[:3] in names and low.isalpha():
        return names[low[:3]]
    raise CronError(f"invalid {name} value: {s!r}")


def parse_cron(expression: str) -> dict[str, tuple[frozenset[int], bool]]:
    """Each field as (its values, whether it is a bare *).

    Lists, ranges and steps; a/n means from a to the end by n; day 7 is day 0.
    """
    parts = str(expression).split()
    if len(parts) != len(FIELDS):
        raise CronError(f"expected {len(FIELDS)} fields, got {len(parts)}: {expression!r}")
    out = {}
    for (name, low, high), part in zip(FIELDS, parts, strict=True):
        values: set[int] = set()
        for item in part.split(","):
            body, slash, step = item.partition("/")
            if slash and not (step.isdigit() and int(step) > 0):
                raise CronError(f"invalid {name} step: {item!r}")
            if body == "*":
                a, b = low, high
            elif "-" in body:
                x, _, y = body.partition("-")
                a, b = _value(x, name), _value(y, name)
            else:
                a = _value(body, name)
                b = high if slash else a
            if a < low or b > high or a > b:
                raise CronError(f"{name} out of range {low}-{high}: {item!r}")
            values.update(range(a, b + 1, int(step) if slash else 1))
        if name == "day of week":
            values = {v % 7 for v in values}
        out[name] = (frozenset(values), part == "*")
    return out


def next_cron(parsed: dict, start_ms: int) -> int | None:
    """The first minute after start that fits, in UTC; None within eight years if there is none.

    With both days restricted one of them is enough.
    """
    at = datetime.fromtimestamp(start_ms // 60_000 * 60, UTC) + timedelta(minutes=1)
    end = at.replace(year=at.year + HORIZON_YEARS, day=min(at.day, 28))
    minutes, hours, days, months, weekdays = (parsed[n] for n, _, _ in FIELDS)
    while at < end:
        if at.month not in months[0]:
            at = (at.replace(day=1, hour=0, minute=0) + timedelta(days=32)).replace(day=1)
            continue
        by_day, by_week = at.day in days[0], (at.weekday() + 1) % 7 in weekdays[0]
        fits = (by_day or by_week) if not days[1] and not weekdays[1] else by_day and by_week
        if not fits:
            at = at.replace(hour=0, minute=0) + timedelta(days=1)
            continue
        if at.hour not in hours[0]:
            at = at.replace(minute=0) + timedelta(hours=1)
            continue
        if at.minute not in minutes[0]:
            at += timedelta(minutes=1)
            continue
        return int(at.timestamp() * 1000)
    return None


def next_cron_time(expression: str, from_ms: Column) -> Column:
    """Next run of one expression, parsed once on the driver, after each row's time."""
    parsed = parse_cron(expression)

    @F.pandas_udf("long")
    def run(at: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) else next_cron(parsed, int(x)) for x in at], dtype="Int64")

    return run(from_ms)


@vectorized("long")
def cron_after(expression: pd.Series, at: pd.Series) -> pd.Series:
    """Next run of each row's own expression after its time; null where either is missing."""
    known: dict[str, dict] = {}
    out = []
    for e, t in zip(expression, at, strict=True):
        if e is None or pd.isna(t):
            out.append(None)
            continue
        if e not in known:
            known[e] = parse_cron(e)
        out.append(next_cron(known[e], int(t)))
    return pd.Series(out, dtype="Int64")


def duration_ms(value: Column) -> Column:
    """Milliseconds of a number or of '30s', '5m', '2h', '1d', '250ms'; null if it is neither."""
    v = F.trim(value.cast("string"))
    pattern = r"^([0-9]+(?:\.[0-9]+)?)\s*(ms|s|m|h|d)?$"
    factor = F.lit(1)
    for unit, ms in UNITS.items():
        factor = F.when(F.regexp_extract(v, pattern, 2) == unit, ms).otherwise(factor)
    return F.when(v.rlike(pattern), F.round(F.regexp_extract(v, pattern, 1).try_cast("double") * factor).cast("bigint"))


def format_duration(ms: Column) -> Column:
    """The largest unit that fits exactly."""
    out = F.concat(ms.cast("string"), F.lit("ms"))
    for unit, size in list(UNITS.items())[1:]:
        out = F.when((ms % size == 0) & (ms > 0), F.concat((ms / size).cast("bigint").cast("string"), F.lit(unit))).otherwise(out)
    return out


def next_interval(every_ms: Column, now_ms: Column, last_ms: Column) -> Column:
    """now + every at first; then last + every, moved on by whole steps until it is after now."""
    first = last_ms + every_ms
    late = F.greatest(F.lit(0), F.floor((now_ms - first) / every_ms) + 1)
    return F.when(last_ms.isNull(), now_ms + every_ms).otherwise(first + F.when(first > now_ms, 0).otherwise(late) * every_ms).cast("bigint")


def next_run(kind: Column, cron: Column, every_ms: Column, at_ms: Column, now_ms: Column, last_ms: Column) -> Column:
    """Next run of a job: cron, once (only while it is ahead), or interval."""
    return F.when(kind == "cron", cron_after(cron, now_ms)).when(kind == "once", F.when(at_ms > now_ms, at_ms)).when(kind == "interval", next_interval(every_ms, now_ms, last_ms))


def schedule_kind(cron: Column, every: Column, at: Column) -> Column:
    """cron, interval or once, by what is set."""
    return F.when(cron.isNotNull(), "cron").when(every.isNotNull(), "interval").when(at.isNotNull(), "once")


def schedule_label(cron: Column, every_ms: Column, at_ms: Column) -> Column:
    """What a person reads of a schedule."""
    return F.when(cron.isNotNull(), cron).when(every_ms.isNotNull(), F.concat(F.lit("every "), format_duration(every_ms))).when(at_ms.isNotNull(), F.concat(F.lit("once at "), F.date_format(F.timestamp_millis(at_ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")))


#: Fixed values: (base delay, multiplier, cap) in milliseconds by status; of blocks and of any other.
RETRY = {429: (5000, 2.0, 120000), 403: (8000, 2.0, 60000), 503: (3000, 1.5, 30000), 502: (2000, 1.5, 20000), 504: (2000, 1.5, 20000), 500: (1500, 1.5, 15000), 408: (1000, 1.2, 10000)}
RETRY_BLOCK, RETRY_OTHER = (1500, 2.0, 20000), (1000, 1.5, 15000)
RETRY_ON = (408, 429, 500, 502, 503, 504, 403)
MAX_RETRY_AFTER = 300_000


def retry_delay(status: Column, attempt: Column, code: Column | None = None, retry_after_ms: Column | None = None) -> Column:
    """Delay before try `attempt`, without jitter: base * multiplier^(attempt - 1), capped; Retry-After goes before it."""

    def curve(c: tuple) -> Column:
        base, factor, cap = c
        return F.round(F.least(F.lit(base) * F.pow(F.lit(factor), attempt - 1), F.lit(float(cap)))).cast("bigint")

    out = curve(RETRY_OTHER)
    for s, c in RETRY.items():
        out = F.when(status == s, curve(c)).otherwise(out)
    if code is not None:
        out = F.when(code == "BLOCKED", curve(RETRY_BLOCK)).otherwise(out)
    if retry_after_ms is not None:
        out = F.when(retry_after_ms.isNotNull(), F.least(retry_after_ms, F.lit(MAX_RETRY_AFTER)).cast("bigint")).otherwise(out)
    return out


def should_retry(status: Column, code: Column, tried: Column, most: int = 3, retryable: Column | None = None) -> Column:
    """Whether a failed request is tried again. `most` counts tries after the first."""
    blocked = (code == "BLOCKED") & (F.lit(True) if retryable is None else F.coalesce(retryable, F.lit(True)))
    yes = blocked | code.isin("NETWORK_ERROR", "TIMEOUT", "TRUNCATED_RESPONSE") | status.isin(*RETRY_ON)
    return F.coalesce(~F.coalesce(code == "CANCELED", F.lit(False)) & (tried <= most) & F.coalesce(yes, F.lit(False)), F.lit(False))
