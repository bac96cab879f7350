"""Next times of cron schedules: five fields, or @every with a duration, or a named descriptor, with a zone before them or not.

A day matches if the day of month or the day of week does when both are restricted, otherwise if
both do. ``*`` and ``?`` don't restrict, also in a list and with a step of 1; with a larger step they do.
Weekdays are 0 to 6. ``CRON_TZ=`` or ``TZ=`` and a zone's name give the fields' zone: times go in and come out in
UTC. A time that its zone's clock skips is passed over, one that it shows twice counts once. @every counts
from the given time, in whole seconds.

All of it is Columns. A field is a bit mask of the values it allows. The next value is the lowest bit left above the
current one, the days of a month are one mask too: that of its days of month, and that of its days of week, which is the
week's mask repeated. So a row costs some bit operations, and one for each month looked at.
"""

from __future__ import annotations

import functools
import zoneinfo
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# cron's named schedules, month and day names.
DESCRIPTORS = {"@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *", "@monthly": "0 0 1 * *", "@weekly": "0 0 * * 0", "@daily": "0 0 * * *", "@midnight": "0 0 * * *", "@hourly": "0 * * * *"}
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
DAYS = "sun mon tue wed thu fri sat".split()
_UNITS = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 1e-3}
#: Years looked ahead, and how often a zone's clock may have to be asked: once for each time that it skips or shows twice.
_YEARS, _TRIES = 5, 8
_PART = r"^([*?]|[0-9a-z]+)(-([0-9a-z]+))?(/([0-9]*))?$"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _bit(n: Column) -> Column:
    return F.call_function("shiftleft", _long(1), n.cast("int"))


def _from(mask: Column, n: Column) -> Column:
    """The mask's bits from ``n`` on."""
    return mask.bitwiseAND(F.bitwise_not(_bit(n) - 1))


def _lowest(mask: Column) -> Column:
    """The place of the lowest bit of a mask that has one."""
    return F.bit_count(mask.bitwiseAND(-mask) - 1)


def _field(text: Column, low: int, high: int, names: list[str] = ()) -> Column:
    """The mask of the values a field allows; null if it isn't one."""

    def number(x: Column) -> Column:
        named = F.array_position(F.array(*map(F.lit, names)), x) if names else F.lit(0)
        return F.when(named > 0, named - 1 + low).otherwise(x.try_cast("bigint"))

    def part(x: Column) -> Column:
        group = lambda i: F.regexp_extract(x, _PART, i)
        every = F.when(group(5) == "", _long(1)).otherwise(group(5).try_cast("bigint"))
        whole = group(1).isin("*", "?")
        first = F.when(whole, _long(low)).otherwise(number(group(1)))
        last = F.when(whole, _long(high)).when(group(3) != "", number(group(3))).when(group(5) != "", _long(high)).otherwise(number(group(1)))
        span = F.struct(first.alias("a"), last.alias("b"), every.alias("every"), (x.rlike(_PART) & ~(whole & (group(2) != ""))).alias("ok"))

        def bits(s: Column) -> Column:
            good = s["ok"] & (s["every"] >= 1) & (s["a"] >= low) & (s["a"] <= s["b"]) & (s["b"] <= high)
            return F.when(good, F.aggregate(F.sequence(s["a"], s["b"], s["every"]), _long(0), lambda m, v: m.bitwiseOR(_bit(v))))

        return _let(span, bits)

    return F.aggregate(F.transform(F.split(text, ","), part), _long(0), lambda m, x: m.bitwiseOR(x))


def _restricts(text: Column) -> Column:
    return ~F.exists(F.split(text, ","), lambda x: x.rlike("^[*?](/1?)?$"))


@functools.cache
def _zones() -> str:
    """All zones' names, a space before and behind each: one literal of the plan instead of hundreds."""
    return f" {' '.join(sorted(zoneinfo.available_timezones() - {'Factory', 'localtime'}))} "


def _rule(fields: Column) -> Column:
    """A struct of masks, null if the five fields aren't a schedule."""
    at = lambda i: F.get(fields, i)
    masks = F.struct(
        _field(at(0), 0, 59).alias("minutes"), _field(at(1), 0, 23).alias("hours"), _field(at(2), 1, 31).alias("days"), _field(at(3), 1, 12, MONTHS).alias("months"),
        _field(at(4), 0, 6, DAYS).alias("weekdays"), (_restricts(at(2)) & _restricts(at(4))).alias("either"),
    )
    whole = lambda r: F.when(r["minutes"].isNotNull() & r["hours"].isNotNull() & r["days"].isNotNull() & r["months"].isNotNull() & r["weekdays"].isNotNull(), r)
    return F.when(F.size(fields) == 5, _let(masks, whole))


def _days(rule: Column, first: Column) -> Column:
    """The mask of the month's days that match, bit 1 for its first day ``first``."""
    weekday = F.dayofweek(first) - 1
    turned = F.call_function("shiftright", rule["weekdays"], weekday).bitwiseOR(F.call_function("shiftleft", rule["weekdays"], 7 - weekday)).bitwiseAND(_long(127))
    # The week's mask five times over, each seven bits on.
    by_week = turned * _long(sum(1 << 7 * i for i in range(5))) * 2
    both = F.when(rule["either"], rule["days"].bitwiseOR(by_week)).otherwise(rule["days"].bitwiseAND(by_week))
    there = both.bitwiseAND(_bit(F.dayofmonth(F.last_day(first)) + 1) - 2)
    return F.when(rule["months"].bitwiseAND(_bit(F.month(first))) != 0, there).otherwise(_long(0))


def _day_from(rule: Column, day: Column, last_year: Column) -> Column:
    """The first matching day from ``day`` on, null if there is none up to ``last_year``."""
    first = F.trunc(day, "month")

    def month(found: Column, k: Column) -> Column:
        begin = F.add_months(first, k.cast("int"))
        mask = _let(_days(rule, begin), lambda m: F.when(k == 0, _from(m, F.dayofmonth(day))).otherwise(m))
        there = _let(mask, lambda m: F.when((m != 0) & (F.year(begin) <= last_year), F.date_add(begin, _lowest(m) - 1)))
        return F.when(found.isNotNull(), found).otherwise(there)

    return F.aggregate(F.sequence(F.lit(0), F.lit(12 * (_YEARS + 1))), F.lit(None).cast("date"), month)


def _time(day: Column, minutes: Column) -> Column:
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"))


def _next_local(rule: Column, after: Column, last_year: Column) -> Column:
    """The first time of the rule behind ``after``, by a clock without zones."""
    minute = F.hour(after) * 60 + F.minute(after) + 1
    start = F.struct(F.date_add(F.to_date(after), F.floor(minute / 1440).cast("int")).alias("day"), (minute % 1440).alias("minute"))

    def found(s: Column) -> Column:
        hour, rest = F.floor(s["minute"] / 60), s["minute"] % 60
        this_hour = F.when(rule["hours"].bitwiseAND(_bit(hour)) != 0, _from(rule["minutes"], rest)).otherwise(_long(0))
        first = _lowest(rule["minutes"])
        later = _from(rule["hours"], hour + 1)
        today = F.when(this_hour != 0, hour * 60 + _lowest(this_hour)).when(later != 0, _lowest(later) * 60 + first)
        matches = _days(rule, F.trunc(s["day"], "month")).bitwiseAND(_bit(F.dayofmonth(s["day"]))) != 0
        here = matches & today.isNotNull() & (F.year(s["day"]) <= last_year)
        next_day = _day_from(rule, F.date_add(s["day"], 1), last_year)
        return F.when(here, _time(s["day"], today)).otherwise(_let(next_day, lambda d: F.when(d.isNotNull(), _time(d, _lowest(rule["hours"]) * 60 + first))))

    return _let(start, found)


def _next_in_zone(rule: Column, zone: Column, after: Column) -> Column:
    """As _next_local() by a zone's clock, in and out in UTC. Where the clock skips a time, the search goes on from the first time that it
    shows again; where it has shown the time before, from the first that it shows afterwards only."""
    to_utc = lambda t: F.convert_timezone(zone, F.lit("UTC"), t)
    to_local = lambda t: F.convert_timezone(F.lit("UTC"), zone, t)
    last_year = F.year(after) + _YEARS
    kind = "struct<local: timestamp_ntz, found: timestamp_ntz>"
    nothing = F.lit(None).cast("timestamp_ntz")

    def attempt(state: Column, _: Column) -> Column:
        local = _next_local(rule, state["local"], last_year)

        def judged(t: Column) -> Column:
            there = to_utc(t)
            shown = to_local(there)
            # The minutes up to where the search may go on at the latest; it goes on before the first that will do.
            until = lambda end, good: F.coalesce(F.element_at(F.filter(F.sequence(t, end, F.expr("interval 1 minute")), good), 1) - F.expr("interval 1 minute"), end)
            after_gap = until(shown, lambda x: to_local(to_utc(x)) == x)
            again = until(after + (t - there), lambda x: to_utc(x) > after)
            state_of = lambda go_on, found: F.struct(go_on.alias("local"), found.alias("found")).cast(kind)
            return (
                F.when(t.isNull(), state_of(nothing, nothing)).when(shown != t, state_of(after_gap, nothing)).when(there <= after, state_of(again, nothing)).otherwise(state_of(nothing, there))
            )

        return F.when(state["local"].isNull(), state).otherwise(_let(local, judged))

    start = F.struct(to_local(after).alias("local"), nothing.alias("found")).cast(kind)
    tries = F.when(zone == "UTC", 1).otherwise(_TRIES)
    return F.aggregate(F.sequence(F.lit(1), tries), start, attempt)["found"]


def _every(text: Column, after: Column) -> Column:
    """@every's next time, null if the duration isn't one."""
    part = r"([0-9.]+)(ms|h|m|s)"
    worth = F.create_map(*[F.lit(x) for pair in _UNITS.items() for x in pair])
    one = lambda x: F.regexp_extract(x, part, 1).try_cast("double") * worth[F.regexp_extract(x, part, 2)]
    seconds = F.aggregate(F.transform(F.regexp_extract_all(text, F.lit(part), F.lit(0)), one), F.lit(0.0), lambda a, b: a + b)
    whole = F.when(text.rlike(f"^({part})+$") & seconds.isNotNull(), F.greatest(F.lit(1), F.floor(seconds)))
    return F.to_date(after).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.hour(after), F.minute(after), (F.floor(F.second(after)) + whole).cast("decimal(18,6)"))


def next_run(schedule: Column, after: Column) -> Column:
    """The next time of each row's schedule; null for a schedule that isn't one, and where there is no time for years."""
    zoned = r"^(?:CRON_)?TZ=(\S+)\s+"
    text = F.regexp_replace(schedule, r"^\s+|\s+$", "")
    zone, body = F.regexp_extract(text, zoned, 1), F.regexp_replace(text, zoned, "")
    named = F.create_map(*[F.lit(x) for pair in DESCRIPTORS.items() for x in pair])
    after = after.cast("timestamp_ntz")
    parsed = F.struct(after.alias("after"), F.when(zone == "", "UTC").otherwise(zone).alias("zone"), body.alias("body"), _rule(F.split(F.lower(F.coalesce(F.try_element_at(named, body), body)), r"\s+")).alias("rule"))

    def found(p: Column) -> Column:
        fields = F.when(p["rule"].isNotNull(), _next_in_zone(p["rule"], p["zone"], p["after"]))
        known = (p["zone"] == "UTC") | F.contains(F.lit(_zones()), F.concat(F.lit(" "), p["zone"], F.lit(" ")))
        return F.when(p["after"].isNull() | ~known, None).when(p["body"].startswith("@every "), _every(F.trim(F.substring(p["body"], 8, 1 << 20)), p["after"])).otherwise(fields)

    return _let(parsed, found)
