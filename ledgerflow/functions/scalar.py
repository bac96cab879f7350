"""Scalar functions of the engine as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def backoff_constant(interval: float) -> Column:
    return F.lit(float(interval))


def backoff_linear(attempt: Column | str, initial: float, most: float = 0) -> Column:
    """initial * attempt seconds, at most ``most`` if that is not 0."""
    value = F.lit(float(initial)) * _col(attempt)
    return F.least(value, F.lit(float(most))) if most else value


def backoff_exponential(attempt: Column | str, initial: float, most: float) -> Column:
    """initial * 2 ** (attempt - 1) seconds, at most ``most``."""
    return F.least(F.lit(float(initial)) * F.pow(F.lit(2.0), _col(attempt) - 1), F.lit(float(most)))


def backoff_jitter(attempt: Column | str, key: Column | str, initial: float = 1.0, most: float = 60.0) -> Column:
    """Full jitter: a fraction of the exponential delay, drawn from the key's md5 so that reruns agree."""
    share = F.conv(F.substring(F.md5(_col(key).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return share * backoff_exponential(attempt, initial, most)


def id_prefix(id_: Column | str) -> Column:
    """The prefix of an id; null where there is none or nothing behind it."""
    return F.when(_col(id_).rlike("^[a-z]+_.+$"), F.substring_index(_col(id_), "_", 1))


def describe_cron(schedule: Column | str) -> Column:
    """A phrase for the usual patterns of five fields; other schedules as they are."""
    s = _col(schedule)
    parts = F.split(F.trim(s), "[ \t]+")
    minute, hour, day, month, weekday = (F.get(parts, i) for i in range(5))
    each = lambda *fields: F.expr("true") if not fields else (fields[0] == "*") & each(*fields[1:])
    clock = F.concat(hour, F.lit(":"), F.when(F.length(minute) < 2, F.lpad(minute, 2, "0")).otherwise(minute))
    names = F.create_map(*[F.lit(x) for i, day_name in enumerate(WEEKDAYS) for x in (str(i), day_name)])
    name = F.when(weekday.rlike("^[0-7]$"), F.try_element_at(names, weekday))
    phrase = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    return (
        F.when(F.size(parts) != 5, s)
        .when(each(minute, hour, day, month, weekday), "Every minute")
        .when(minute.startswith("*/") & each(hour, day, month, weekday), phrase("Every ", minute.substr(3, 99), " minutes"))
        .when(each(hour, day, month, weekday), phrase("Every hour at :", F.when(F.length(minute) < 2, F.lpad(minute, 2, "0")).otherwise(minute)))
        .when((minute == "0") & hour.startswith("*/") & each(day, month, weekday), phrase("Every ", hour.substr(3, 99), " hours"))
        .when(each(day, month, weekday), phrase("Daily at ", clock))
        .when(each(day, month) & (weekday == "1-5"), phrase("Weekdays at ", clock))
        .when(each(day, month) & weekday.isin("0,6", "6,0"), phrase("Weekends at ", clock))
        .when(each(day, month) & name.isNotNull(), phrase("Every ", name, " at ", clock))
        .when(each(month, weekday), phrase("Monthly on day ", day, " at ", clock))
        .otherwise(s)
    )


# The names of cron's weekdays 0 to 7.
WEEKDAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def relative_time(ts: Column | str, as_of: Column) -> Column:
    """How long before or after ``as_of``: just now, 1 min ago, 5m ago, in 2h, in 3d, 1 day ago."""
    seconds = F.timestamp_diff("SECOND", _col(ts), as_of)
    size = F.abs(seconds)

    def amount(unit: int, one: str, many: str) -> Column:
        n = F.floor(size / unit).cast("bigint")
        return F.when(n == 1, f"1 {one}").otherwise(F.concat(n.cast("string"), F.lit(many)))

    text = F.when(size < 3600, amount(60, "min", "m")).when(size < 86400, amount(3600, "hour", "h")).otherwise(amount(86400, "day", "d"))
    past = seconds >= 0
    return F.when(past & (size < 60), "just now").when(size < 60, "in a moment").when(past, F.concat(text, F.lit(" ago"))).otherwise(F.concat(F.lit("in "), text))


def format_duration(ms: Column | str) -> Column:
    """Milliseconds as 250ms, 1.5s, 2m 5s or 1h 3m. Tenths of a second are rounded half up."""
    ms = _col(ms).cast("bigint")
    seconds = F.floor(ms / 1000)
    tenths = F.floor((ms + 50) / 100)
    m, s, h = F.floor(seconds / 60), seconds % 60, F.floor(seconds / 3600)
    text = lambda c: c.cast("bigint").cast("string")
    return (
        F.when(ms < 1000, F.concat(text(ms), F.lit("ms")))
        .when(ms < 60000, F.concat(text(F.floor(tenths / 10)), F.lit("."), text(tenths % 10), F.lit("s")))
        .when(ms < 3600000, F.concat(text(m), F.lit("m"), F.when(s > 0, F.concat(F.lit(" "), text(s), F.lit("s"))).otherwise("")))
        .otherwise(F.concat(text(h), F.lit("h "), text(m % 60), F.lit("m")))
    )


def health_label(failed: Column, dead: Column, total: Column) -> Column:
    rate = (failed + dead) / total * 100
    return F.when(total == 0, "No activity").when(rate < 5, "Healthy").when(rate < 20, "Degraded").otherwise("Unhealthy")


def page_meta(total: Column | str, limit: Column | str, offset: Column | str) -> dict[str, Column]:
    """limit (20 where it is not positive), pages (one at least) and the page at the offset."""
    total, offset = _col(total), _col(offset)
    size = F.when(_col(limit) <= 0, 20).otherwise(_col(limit)).cast("bigint")
    return {"page_limit": size, "pages": F.greatest(F.floor((total + size - 1) / size), F.lit(1)).cast("bigint"), "page": (F.floor(offset / size) + 1).cast("bigint")}


def limit_clamp(limit: Column | str) -> Column:
    """50 where it is not positive, 1000 at most."""
    return F.when(_col(limit) <= 0, 50).otherwise(F.least(_col(limit), F.lit(1000))).cast("bigint")


def parse_int_param(text: Column | str, default: int) -> Column:
    """A whole number from 0 on; anything else gives the default."""
    value = F.when(_col(text).rlike("^[+]?[0-9]+$"), _col(text).try_cast("bigint"))
    return F.coalesce(value, F.lit(default)).cast("bigint")


def truncate_bytes(text: Column | str, most: int) -> Column:
    """Text of more than ``most`` bytes is cut there and gets dots. Bytes of a cut character stay away."""
    t = _col(text)
    head = F.make_valid_utf8(F.substring(t.cast("binary"), 1, most).cast("string"))
    return F.when(F.octet_length(t) > most, F.concat(F.regexp_replace(head, "�+$", ""), F.lit("..."))).otherwise(t)


def redis_score(priority: Column | str, run_at: Column | str) -> Column:
    """The sorted-set score of a job. Doubles lose milliseconds at large priorities: not for sorting."""
    return -_col(priority).cast("double") + F.unix_millis(_col(run_at).cast("timestamp")) / F.lit(1e15)


# The topics that have no entity, and the kinds that have one.
PLAIN_TOPICS, ENTITY_TOPICS = ("jobs", "workflows", "firehose"), ("job", "workflow", "queue")


def topic_build(kind: Column | str, entity: Column | str) -> Column:
    return F.concat(_col(kind), F.lit(":"), _col(entity))


def topic_parse(topic: Column | str) -> tuple[Column, Column]:
    """(kind, entity); a plain topic has an empty entity."""
    t = _col(topic)
    at = F.locate(":", t)
    return F.when(at > 0, F.substring_index(t, ":", 1)).otherwise(t), F.when(at > 0, t.substr(at + 1, F.length(t))).otherwise("")


def topic_valid(topic: Column | str) -> Column:
    return _col(topic).isin(*PLAIN_TOPICS) | _col(topic).rlike(f"^({'|'.join(ENTITY_TOPICS)}):.+")


def resolve_topics(kind: Column | str, topic: Column | str) -> Column:
    """Where an event goes: the firehose, its family, and its own topic."""
    kind = _col(kind)
    family = F.when(kind.startswith("job."), "jobs").when(kind.startswith("workflow."), "workflows")
    own = F.when(_col(topic) != "", _col(topic))
    return F.array_compact(F.array(F.lit("firehose"), family, own))


# Per family of wire methods, the methods that only read, and its reading and writing scopes.
METHOD_FAMILIES = {
    "job": (("get", "list"), "job:read", "job:write"),
    "workflow": (("get", "timeline"), "workflow:read", "workflow:write"),
    "dlq": (("list",), "dlq:read", "dlq:write"),
}
# Scopes of the other methods.
METHOD_SCOPES = {"auth": "", "subscribe": "subscribe", "unsubscribe": "subscribe", "cron.list": "cron:read", "stats": "stats:read"}


def required_scope(method: Column | str) -> Column:
    """The scope a wire method asks for; admin where no rule names one."""
    m = _col(method)
    out = F.lit("admin")
    for name, scope in METHOD_SCOPES.items():
        out = F.when(m == name, scope).otherwise(out)
    for family, (reading, read, write) in METHOD_FAMILIES.items():
        out = F.when(m.isin(*(f"{family}.{x}" for x in reading)), read).when(m.startswith(f"{family}."), write).otherwise(out)
    return out


def has_scope(scopes: Column | str, wanted: Column) -> Column:
    return F.array_contains(_col(scopes), "*") | F.array_contains(_col(scopes), wanted)


def state_of(text: Column | str) -> Column:
    """A job state by name; anything else is empty."""
    from ledgerflow.schema import JOB_STATES

    return F.when(_col(text).isin(*JOB_STATES), _col(text)).otherwise("")


def error_status(error: Column | str) -> Column:
    """HTTP status of an error's kind."""
    e = _col(error)
    return F.when(e.endswith("not_found"), 404).when(e.isin("invalid_id", "invalid_state"), 400).otherwise(500)


def job_seconds(started: Column | str, completed: Column | str) -> Column:
    return F.timestamp_diff("SECOND", _col(started), _col(completed))


def poll_wait(empty_polls: Column | str, poll: float = 1.0, most: float = 30.0) -> Column:
    """Seconds to wait after so many empty polls in a row; the first wait is twice the interval already."""
    return F.least(F.lit(float(poll)) * F.pow(F.lit(2.0), _col(empty_polls)), F.lit(float(most)))
