"""A plain evaluator, minute by minute, that tests hold ledgerflow.functions.cron against. Next times of cron schedules: five fields, or @every with a duration, or a named descriptor, with a zone before them or not.

A day matches if the day of month or the day of week does when both are restricted, otherwise if
both do. ``*`` and ``?`` don't restrict, also in a list and with a step of 1; with a larger step they do.
Weekdays are 0 to 6. ``CRON_TZ=`` or ``TZ=`` and a zone's name give the fields' zone: times go in and come out in
UTC. A time that its zone's clock skips is passed over, one that it shows twice counts once. @every counts
from the given time, in whole seconds.
"""

from __future__ import annotations

import functools
import re
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

# cron's named schedules, month and day names.
DESCRIPTORS = {"@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *", "@monthly": "0 0 1 * *", "@weekly": "0 0 * * 0", "@daily": "0 0 * * *", "@midnight": "0 0 * * *", "@hourly": "0 * * * *"}
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
DAYS = "sun mon tue wed thu fri sat".split()
_UNITS = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 1e-3}
_YEARS = 5


def _number(text: str, names: list[str], first: int) -> int:
    return names.index(text) + first if text in names else int(text)


def _field(text: str, low: int, high: int, names: list[str] = ()) -> frozenset[int]:
    """The values a field allows; ValueError if it isn't one."""
    out: set[int] = set()
    for part in text.lower().split(","):
        span, _, step = part.partition("/")
        every = int(step) if step else 1
        if span in ("*", "?"):
            a, b = low, high
        elif "-" in span:
            a, b = (_number(x, names, low) for x in span.split("-"))
        else:
            a = _number(span, names, low)
            b = high if step else a
        if every < 1 or not low <= a <= b <= high:
            raise ValueError(text)
        out.update(range(a, b + 1, every))
    return frozenset(out)


def _restricts(text: str) -> bool:
    return not any(span in ("*", "?") and step in ("", "1") for span, _, step in (part.partition("/") for part in text.split(",")))


@functools.lru_cache(maxsize=4096)
def parse(schedule: str):
    """Seconds for @every, else (minutes, hours, days, months, weekdays, either day rule, zone). ValueError if it is neither."""
    text = schedule.strip()
    zone = None
    if (named := re.match(r"(?:CRON_)?TZ=(\S+)\s+", text)) is not None:
        try:
            zone = ZoneInfo(named[1])
        except (KeyError, OSError) as e:
            raise ValueError(schedule) from e
        text = text[named.end() :]
    if text.startswith("@every "):
        parts = re.findall(r"([0-9.]+)(ms|h|m|s)", text[7:])
        if not parts or "".join(a + b for a, b in parts) != text[7:].strip():
            raise ValueError(schedule)
        return max(1, int(sum(float(n) * _UNITS[u] for n, u in parts)))
    fields = DESCRIPTORS.get(text, text).split()
    if len(fields) != 5:
        raise ValueError(schedule)
    weekdays, either = _field(fields[4], 0, 6, DAYS), _restricts(fields[2]) and _restricts(fields[4])
    return _field(fields[0], 0, 59), _field(fields[1], 0, 23), _field(fields[2], 1, 31), _field(fields[3], 1, 12, MONTHS), weekdays, either, zone


def next_time(schedule: str, after: datetime) -> datetime | None:
    """The first time behind ``after``; None if there is none for years."""
    rule = parse(schedule)
    if isinstance(rule, int):
        return after.replace(microsecond=0) + timedelta(seconds=rule)
    *_, zone = rule
    if zone is None:
        return _next_local(rule, after)
    local = after.replace(tzinfo=UTC).astimezone(zone).replace(tzinfo=None, fold=0)
    while (local := _next_local(rule, local)) is not None:
        found = local.replace(tzinfo=zone).astimezone(UTC)
        if found.astimezone(zone).replace(tzinfo=None, fold=0) == local and found.replace(tzinfo=None) > after:
            return found.replace(tzinfo=None)
    return None


def _next_local(rule: tuple, after: datetime) -> datetime | None:
    minutes, hours, days, months, weekdays, either, _ = rule
    at = after.replace(second=0, microsecond=0) + timedelta(minutes=1)
    end = after.year + _YEARS
    while at.year <= end:
        if at.month not in months:
            at = (at.replace(day=1, hour=0, minute=0) + timedelta(days=32)).replace(day=1)
            continue
        by_month, by_week = at.day in days, at.isoweekday() % 7 in weekdays
        if not (by_month or by_week if either else by_month and by_week):
            at = at.replace(hour=0, minute=0) + timedelta(days=1)
        elif at.hour not in hours:
            at = at.replace(minute=0) + timedelta(hours=1)
        elif at.minute not in minutes:
            at += timedelta(minutes=1)
        else:
            return at
    return None
