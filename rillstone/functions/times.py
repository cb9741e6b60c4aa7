"""Date-time and duration functions. Durations are microseconds (bigint); Spark keeps microseconds, not nanoseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Microseconds of the units.
UNITS = {"us": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "D": 86_400_000_000, "W": 604_800_000_000}
#: Directives of strftime as Java patterns.
_DIRECTIVES = {
    "%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%y": "yy", "%j": "DDD", "%I": "hh",
    "%p": "a", "%a": "E", "%A": "EEEE", "%b": "MMM", "%B": "MMMM", "%z": "xx", "%Z": "zzz", "%F": "yyyy-MM-dd", "%T": "HH:mm:ss",
}


def micros(t: Column) -> Column:
    """Microseconds since 1970 of a time, without or with zone."""
    return F.unix_micros(t.cast("timestamp"))


def from_micros(us: Column, zone: bool = True) -> Column:
    t = F.timestamp_micros(us)
    return t if zone else t.cast("timestamp_ntz")


def java_pattern(fmt: str) -> str:
    out, i, text = "", 0, ""

    def flush() -> str:
        return f"'{text.replace(chr(39), chr(39) * 2)}'" if any(c.isalpha() for c in text) else text.replace("'", "''")

    while i < len(fmt):
        d = fmt[i : i + 2]
        if d in _DIRECTIVES:
            out, text, i = out + flush() + _DIRECTIVES[d], "", i + 2
        elif d == "%%":
            text, i = text + "%", i + 2
        elif d.startswith("%"):
            raise ValueError(f"no pattern for {d}")
        else:
            text, i = text + fmt[i], i + 1
    return out + flush()


def nanosecond(t: Column) -> Column:
    """Nanoseconds of the second, in steps of 1000."""
    return F.pmod(micros(t), F.lit(1_000_000)) * 1000


def microsecond(t: Column) -> Column:
    return F.pmod(micros(t), F.lit(1_000_000))


def millisecond(t: Column) -> Column:
    return F.floor(F.pmod(micros(t), F.lit(1_000_000)) / 1000)


def second(t: Column) -> Column:
    return F.second(t).cast("bigint")


def minute(t: Column) -> Column:
    return F.minute(t).cast("bigint")


def hour(t: Column) -> Column:
    return F.hour(t).cast("bigint")


def day(t: Column) -> Column:
    return F.dayofmonth(t).cast("bigint")


def month(t: Column) -> Column:
    return F.month(t).cast("bigint")


def year(t: Column) -> Column:
    return F.year(t).cast("bigint")


def weekday(t: Column) -> Column:
    """0 is Monday."""
    return F.weekday(t).cast("bigint")


def timestamp(t: Column, unit: str | None = None) -> Column:
    """Time since 1970: in nanoseconds as an integer, or in unit as a double."""
    return micros(t) * 1000 if unit is None else micros(t) * 1000.0 if unit == "ns" else micros(t) / UNITS[unit]


def strftime(t: Column, fmt: str) -> Column:
    return F.date_format(t, java_pattern(fmt))


def strptime(s: Column, fmt: str) -> Column:
    """With %z a time with zone, otherwise one without."""
    p = java_pattern(fmt)
    return F.to_timestamp(s, p) if "%z" in fmt else F.to_timestamp_ntz(s, F.lit(p))


def to_utc(t: Column, zone: str) -> Column:
    return F.to_utc_timestamp(t.cast("timestamp"), zone)


def to_naive_in_timezone(t: Column, zone: str) -> Column:
    return F.from_utc_timestamp(t.cast("timestamp"), zone).cast("timestamp_ntz")


def add_duration(t: Column, us) -> Column:
    return F.timestamp_micros(micros(t) + us)


def add_duration_in_timezone(t: Column, us, zone: str) -> Column:
    """A local time plus a duration that passes in that zone."""
    return to_naive_in_timezone(add_duration(to_utc(t, zone), us), zone)


def subtract_duration_in_timezone(t: Column, us, zone: str) -> Column:
    return to_naive_in_timezone(F.timestamp_micros(micros(to_utc(t, zone)) - us), zone)


def subtract_date_time_in_timezone(a: Column, b: Column, zone: str) -> Column:
    """Duration between two local times of a zone."""
    return micros(to_utc(a, zone)) - micros(to_utc(b, zone))


def difference(a: Column, b: Column) -> Column:
    """a - b as a duration."""
    return micros(a) - micros(b)


def floor_to(t: Column, us: int) -> Column:
    return F.timestamp_micros(micros(t) - F.pmod(micros(t), F.lit(us)))


def round_to(t: Column, us: int) -> Column:
    """To the nearest multiple of a duration, halves to the even one."""
    return F.timestamp_micros(F.bround(micros(t).cast("decimal(38,10)") / F.lit(us).cast("decimal(38,0)")).cast("bigint") * us)


def to_duration(n: Column, unit: str) -> Column:
    return n * UNITS[unit]


def _whole(us: Column, unit: str) -> Column:
    return F.when(us >= 0, F.floor(us / UNITS[unit])).otherwise(F.ceil(us / UNITS[unit]))


def nanoseconds(us: Column) -> Column:
    return us * 1000


def microseconds(us: Column) -> Column:
    return us


def milliseconds(us: Column) -> Column:
    return _whole(us, "ms")


def seconds(us: Column) -> Column:
    return _whole(us, "s")


def minutes(us: Column) -> Column:
    return _whole(us, "m")


def hours(us: Column) -> Column:
    return _whole(us, "h")


def days(us: Column) -> Column:
    return _whole(us, "D")


def weeks(us: Column) -> Column:
    return _whole(us, "W")


def from_timestamp(n: Column, unit: str) -> Column:
    return F.timestamp_micros((n * UNITS[unit]).cast("bigint")).cast("timestamp_ntz")


def utc_from_timestamp(n: Column, unit: str) -> Column:
    return F.timestamp_micros((n * UNITS[unit]).cast("bigint"))
