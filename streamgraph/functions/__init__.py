"""Scalar functions: pure column expressions, evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY, YEAR_DAYS, MONTH_DAYS = 86_400, 365, 30


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; a lambda that names the value itself computes it again for every element."""
    return F.transform(F.array(value), body)[0]


def tokens(text: Column) -> Column:
    """Split at every single space; empty tokens stay."""
    return F.split(text, " ", -1)


def group_of(name: Column) -> Column:
    """The part before the first ``-``."""
    return F.substring_index(name, "-", 1)


def spaced_name(name: Column) -> Column:
    """CamelCase as words."""
    return F.trim(F.regexp_replace(name, "([A-Z])", " $1"))


def node_type(name: Column) -> Column:
    """The last word of a CamelCase name, in lower case."""
    return F.lower(F.element_at(F.split(spaced_name(name), " "), -1))


def n_bytes(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")


def message_id(partition: Column, offset: Column) -> Column:
    return F.concat_ws("-", partition.cast("string"), offset.cast("string"))


def parsed_message_id(value: Column) -> Column:
    """struct(partition, offset); null unless it is two integers joined by ``-``."""
    parts = F.split(value, "-", -1)
    partition, offset = (F.try_element_at(parts, F.lit(i)).try_cast("bigint") for i in (1, 2))
    whole = (F.size(parts) == 2) & partition.isNotNull() & offset.isNotNull()
    return F.when(whole, F.struct(partition.alias("partition"), offset.alias("offset")))


def ring_key(key: Column) -> Column:
    """The first four bytes of a key's MD5 as a little-endian number."""
    h = F.md5(key.cast("string"))
    return F.conv(F.concat(*[h.substr(i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("bigint")


_UNITS = {"Y": YEAR_DAYS * DAY, "M": MONTH_DAYS * DAY, "W": 7 * DAY, "D": DAY}
_TIMES = {"H": 3600, "M": 60, "S": 1}
_DATE, _TIME = ("".join(rf"(?:(\d+(?:\.\d+)?){u})?" for u in units) for units in (_UNITS, _TIMES))
#: A whole text: a duration with its sign and the numbers of its units as groups, or anything else without any.
_ISO = rf"^(-?P)(?=.){_DATE}(?:T(?=\d){_TIME})?$[\s\S]*|^[\s\S]*"


def _of_duration(iso: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of an array: for an ISO-8601 duration 1 or -1, then its years, months, weeks, days, hours, minutes and seconds, 0 where it has none. The first
    is null if it is no duration. A text is matched, and its numbers are read, once.
    """
    marked = F.regexp_replace(iso, _ISO, ",".join(["$1", *(f"0${i}" for i in range(2, 9))]))
    return let(F.split(F.translate(marked, "P", "1"), ",").try_cast("array<double>"), body)


def duration_seconds(iso: Column) -> Column:
    """Seconds of an ISO-8601 duration, a year as 365 and a month as 30 days; null if it is none."""
    total = lambda n, units, first: sum((n[i] * s for i, s in enumerate(units.values(), first)), F.lit(0.0))
    return _of_duration(iso, lambda n: n[0] * (total(n, _UNITS, 1) + total(n, _TIMES, 5)))


def duration_text(iso: Column) -> Column:
    """An ISO-8601 duration as ``2h 5m 7s``: its largest unit that is not zero and all below; whole milliseconds where all are zero. A month counts
    as four weeks and a year as twelve such months here, unlike in ``duration_seconds``. Null if it is no duration.
    """

    def text(n, hours):
        minutes, seconds = n[6], n[7]
        whole = F.floor(seconds).cast("string")
        shown = lambda x: F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))
        text = F.when(hours > 0, F.concat(shown(hours), F.lit("h "), shown(minutes), F.lit("m "), whole, F.lit("s")))
        text = text.when(minutes > 0, F.concat(shown(minutes), F.lit("m "), whole, F.lit("s"))).when(seconds >= 1, F.concat(whole, F.lit("s")))
        return F.when(n[0].isNotNull(), text.otherwise(F.concat(F.floor(seconds * 1000).cast("string"), F.lit("ms"))))

    # Hours of the larger units.
    hours_of = (24 * 7 * 4 * 12, 24 * 7 * 4, 24 * 7, 24)
    return _of_duration(iso, lambda n: let(sum((n[i] * h for i, h in enumerate(hours_of, 1)), n[5]), lambda hours: text(n, hours)))


def duration_iso(seconds: Column) -> Column:
    """Seconds as ``P[nD]T[nH][nM]nS``, to the microsecond, without trailing zeros."""

    def text(whole, below):
        days, hours, minutes, rest = F.floor(whole / DAY), F.floor(whole / 3600) % 24, F.floor(whole / 60) % 60, whole % 60
        fraction = F.when(below > 0, F.concat(F.lit("."), F.rtrim(F.lpad(below.cast("string"), 6, "0"), F.lit("0")))).otherwise("")
        some = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))).otherwise("")
        return F.concat(F.lit("P"), some(days, "D"), F.lit("T"), some(hours, "H"), some(minutes, "M"), rest.cast("string"), fraction, F.lit("S"))

    micros = F.round(F.abs(seconds) * 1_000_000).cast("bigint")
    return F.concat(F.when(seconds < 0, "-").otherwise(""), let(micros, lambda m: let(F.floor(m / 1_000_000), lambda whole: text(whole, m % 1_000_000))))


def clock(seconds: Column) -> Column:
    """Whole seconds as ``1h 2m 3s``, units that are zero left out; ``0s`` for less than one."""
    s = F.floor(seconds)
    some = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit)))
    text = F.concat_ws(" ", some(F.floor(s / 3600), "h"), some(F.floor(s / 60) % 60, "m"), some(s % 60, "s"))
    return F.when(text == "", "0s").otherwise(text)


def short_duration(seconds: Column) -> Column:
    """In the largest unit that fits: ``ms``, ``s``, ``m`` or ``h``, to two places."""
    value = lambda by, unit: F.format_string(f"%.2f{unit}", (seconds / by).cast("double"))
    return F.when(seconds < 1, value(0.001, "ms")).when(seconds < 60, value(1, "s")).when(seconds < 3600, value(60, "m")).otherwise(value(3600, "h"))


def state(waiting: Column, recent: Column) -> Column:
    """available: nothing waits; overloaded: more waits than the last three minutes have processed; else busy."""
    return F.when(waiting == 0, "available").when(waiting > recent, "overloaded").otherwise("busy")


def seconds_left(average: Column, waiting: Column) -> Column:
    return average * waiting


def prefixed_keys(entries: Column, prefix: str = "b_") -> Column:
    return F.transform_keys(entries, lambda k, _: F.concat(F.lit(prefix), k))


def _without_keys(entries: Column, other: Column) -> Column:
    return F.map_filter(entries, lambda k, _: ~F.map_contains_key(other, k))


def merged_entries(first: Column, *more: Column) -> Column:
    """One map of several; where keys are equal the last map wins. A null map counts as empty."""
    out = first
    for m in more:
        kept = _without_keys(out, m)
        out = F.when(m.isNull(), out).when(out.isNull(), m).otherwise(F.map_concat(kept, m))
    return out


def new_id() -> Column:
    """A random identifier; a task that runs again makes others, so write it before anything refers to it."""
    return F.expr("uuid()")


def heartbeat(now: Column | None = None) -> Column:
    """Seconds since 1970 of ``now``, else of the moment at which the query runs."""
    return F.unix_timestamp(F.current_timestamp() if now is None else now.cast("timestamp"))


def last_minutes(now: Column, n: int = 10) -> Column:
    """Minutes of the hour of the last ``n`` minutes, the current one first."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.pmod(F.minute(now) - i, F.lit(60)))


def half_even(column: Column) -> Column:
    return F.bround(column, 0)
