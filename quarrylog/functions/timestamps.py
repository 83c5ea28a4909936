"""Timestamps as columns: seconds and nanoseconds since the epoch, from any of the accepted texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date, time, fraction and zone; the zone may lack its colon, and the separator may be a space.
RFC3339 = r"^([+-]?\d{4,})-(\d{1,2})-(\d{1,2})[Tt ](\d{1,2}):(\d{1,2}):(\d{1,2})(?:\.(\d+))?\s*([Zz]|UTC|[+-]\d{2}:?\d{2})?\z"
#: The same with fixed widths, as nearly all are; its parts are where they stand.
FIXED = r"^(?!0000)\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:?\d{2})?\z"
WHOLE, FRACTIONAL = r"^-?\d{1,19}\z", r"^-?\d{1,19}\.\d*\z"
# The range of whole seconds that a calendar of four-digit years has; larger numbers are of finer units.
MIN_SECONDS, MAX_SECONDS = -62135596800, 253402300799
UNITS = ("seconds", "milliseconds", "microseconds", "nanoseconds")
PER_SECOND = {"seconds": 1, "milliseconds": 1_000, "microseconds": 1_000_000, "nanoseconds": 1_000_000_000}


def epoch_unit(whole: Column) -> Column:
    """The unit that a bare number is most likely in."""
    out = F.lit("nanoseconds")
    for unit in ("microseconds", "milliseconds", "seconds"):
        k = PER_SECOND[unit]
        low, high = MIN_SECONDS * k, MAX_SECONDS * k
        out = F.when(whole.between(F.lit(max(low, -(1 << 63))), F.lit(min(high, (1 << 63) - 1))), F.lit(unit)).otherwise(out)
    return out


def _epoch(whole: Column, fraction: Column, unit: Column) -> Column:
    """struct(sec, nsec) of a number of units and a fraction (double, at least 0) of one."""
    per = F.lit(1).cast("bigint")
    for name in UNITS[1:]:
        per = F.when(unit == name, F.lit(PER_SECOND[name]).cast("bigint")).otherwise(per)
    step = F.expr("1000000000L")
    # the fraction goes away from zero; a unit of nanoseconds has none
    more = F.when(unit == "nanoseconds", 0).otherwise(F.round(fraction * (step / per))).cast("bigint")
    rest = F.pmod(whole, per)
    nanos = rest * (step / per).cast("bigint") + F.when(whole < 0, -more).otherwise(more)
    carry = F.floor(nanos / step).cast("bigint")
    # the remainder is taken off first, so the division is exact
    sec = ((whole - rest).cast("decimal(38,0)") / per).cast("bigint")
    return F.struct((sec + carry).alias("sec"), (nanos - carry * step).cast("int").alias("nsec"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def _calendar(part: Column) -> Column:
    """struct(sec, nsec, offset_min) of the eight groups of RFC3339; null if there is no such date or time."""
    two = lambda i: F.lpad(part[i], 2, "0")
    # a constant zone makes the arithmetic independent of the session's
    stamp = F.concat(part[0], F.lit("-"), two(1), F.lit("-"), two(2), F.lit(" "), two(3), F.lit(":"), two(4), F.lit(":"), two(5), F.lit(" +00:00"))
    at = F.unix_seconds(F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss XXX")))
    digits = F.regexp_replace(part[7], r"\D", "")
    minutes = F.when(F.length(digits) == 4, F.substring(digits, 1, 2).cast("int") * 60 + F.substring(digits, 3, 2).cast("int")).otherwise(0)
    offset = F.when(part[7].startswith("-"), -minutes).otherwise(minutes).cast("int")
    nsec = F.rpad(F.substring(part[6], 1, 9), 9, "0").cast("int")
    return _let(F.struct(at.alias("at"), offset.alias("o"), nsec.alias("n")), lambda x: F.when(x["at"].isNotNull(), F.struct((x["at"] - x["o"] * 60).alias("sec"), x["n"].alias("nsec"), x["o"].alias("offset_min"))))


def _fixed(raw: Column) -> Column:
    """struct(sec, nsec, offset_min) of a text that FIXED matches; null if there is no such date or time."""
    part = lambda at, n: F.substring(raw, at, n).cast("int")
    size, sign = F.length(raw), lambda n: F.substring(raw, -n, 1).isin("+", "-") & (F.length(raw) >= 19 + n)
    zone = F.when(sign(6), 6).when(sign(5), 5).when(F.substring(raw, -1, 1).isin("Z", "z"), 1).otherwise(0)
    day, hour, minute, second = F.unix_date(F.substring(raw, 1, 10).try_cast("date")), part(12, 2), part(15, 2), part(18, 2)

    away = F.substring(raw, -zone, 3).cast("int")  # hours with their sign
    minutes = F.when(zone < 5, 0).otherwise(away * 60 + F.when(F.substring(raw, -zone, 1) == "-", -part(-2, 2)).otherwise(part(-2, 2)))
    nsec = F.rpad(F.when(F.substring(raw, 20, 1) == ".", F.substring(raw, F.lit(21), F.least(F.lit(9), size - 20 - zone))).otherwise(""), 9, "0").cast("int")
    clock = (hour < 24) & (minute < 60) & (second < 60)
    sec = day.cast("bigint") * 86400 + hour * 3600 + minute * 60 + second - minutes * 60
    return F.when(day.isNotNull() & clock, F.struct(sec.alias("sec"), nsec.alias("nsec"), minutes.alias("offset_min")))


def parsed(raw: Column, unit: str | None = None) -> Column:
    """struct(sec, nsec, offset_min) of a raw timestamp; null where it is none."""
    groups = F.split(F.regexp_replace(raw, RFC3339, "\x01".join(f"${i}" for i in range(1, 9))), "\x01", -1)
    whole = F.regexp_extract(raw, r"^(-?\d+)", 1).try_cast("bigint")
    fraction = F.coalesce(F.concat(F.lit("0."), F.regexp_extract(raw, r"\.(\d+)\z", 1)).try_cast("double"), F.lit(0.0))

    def number(x: Column) -> Column:
        at = _epoch(x["w"], x["f"], F.lit(unit) if unit else epoch_unit(x["w"]))
        return F.when(x["w"].isNotNull(), _let(at, lambda t: F.struct(t["sec"].alias("sec"), t["nsec"].alias("nsec"), F.lit(0).alias("offset_min"))))

    return (
        F.when(raw.rlike(FIXED), _fixed(raw))
        .when(raw.rlike(RFC3339), _let(groups, _calendar))
        .when(raw.rlike(WHOLE) | raw.rlike(FRACTIONAL), _let(F.struct(whole.alias("w"), fraction.alias("f")), number))
    )


def instant(sec: Column, nsec: Column) -> Column:
    """A timestamp, to the microsecond."""
    return F.timestamp_micros(sec * 1_000_000 + F.floor(nsec / 1000).cast("bigint"))
