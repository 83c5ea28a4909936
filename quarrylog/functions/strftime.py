"""GNU-style time formats as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_ITEM = re.compile(r"%([-_0^#]*)(\d*)([EO]?)(:{0,2}[a-zA-Z%])")

# Composite formats and what they stand for.
COMPOSITE = {"D": "%m/%d/%y", "F": "%Y-%m-%d", "T": "%H:%M:%S", "R": "%H:%M", "r": "%I:%M:%S %p", "c": "%a %b %e %H:%M:%S %Y", "x": "%m/%d/%y", "X": "%H:%M:%S", "h": "%b", "n": " ", "t": " ", "%": "%"}
#: Java patterns of names.
NAMES = {"a": "EEE", "A": "EEEE", "b": "MMM", "B": "MMMM"}
#: Numbers: width and padding.
PADS = {"C": (2, "0"), "d": (2, "0"), "e": (2, " "), "g": (2, "0"), "G": (4, "0"), "H": (2, "0"), "I": (2, "0"), "j": (3, "0"), "k": (2, " "), "l": (2, " "), "m": (2, "0"), "M": (2, "0"), "s": (1, "0"), "S": (2, "0"), "u": (1, "0"), "U": (2, "0"), "V": (2, "0"), "w": (1, "0"), "W": (2, "0"), "y": (2, "0"), "Y": (4, "0")}


def _number(code: str, t: Column, sec: Column) -> Column:
    """The number of a format item; ``t`` is local time, ``sec`` the epoch's seconds."""
    weekday = F.dayofweek(t) - 1  # Sunday is 0
    year = F.year(t)
    iso_year = F.year(F.date_add(t, 4 - (F.pmod(weekday + 6, F.lit(7)) + 1)))
    return {
        "C": F.floor(year / 100), "d": F.dayofmonth(t), "e": F.dayofmonth(t), "g": iso_year % 100, "G": iso_year,
        "H": F.hour(t), "k": F.hour(t), "I": (F.hour(t) + 11) % 12 + 1, "l": (F.hour(t) + 11) % 12 + 1, "j": F.dayofyear(t),
        "m": F.month(t), "M": F.minute(t), "s": sec, "S": F.second(t), "q": F.quarter(t),
        "u": F.pmod(weekday + 6, F.lit(7)) + 1, "w": weekday,
        "U": F.floor((F.dayofyear(t) + 6 - weekday) / 7), "W": F.floor((F.dayofyear(t) + 6 - F.pmod(weekday + 6, F.lit(7))) / 7),
        "V": F.weekofyear(t), "y": year % 100, "Y": year,
    }[code].cast("bigint")


def _zone(code: str, offset: Column) -> Column:
    size = F.abs(offset)
    hours, minutes = F.lpad(F.floor(size / 60).cast("string"), 2, "0"), F.lpad((size % 60).cast("string"), 2, "0")
    sign = F.when(offset < 0, "-").otherwise("+")
    parts = {"z": [sign, hours, minutes], ":z": [sign, hours, F.lit(":"), minutes], "::z": [sign, hours, F.lit(":"), minutes, F.lit(":00")]}[code]
    return F.concat(*parts)


def formatted(fmt: str, ts: Column, nsec: Column | None = None, tz: str = "UTC") -> Column:
    """``ts`` (an instant; the session is in UTC) in the zone ``tz``; ``nsec`` if finer than microseconds."""
    local = F.from_utc_timestamp(ts, tz)
    sec = F.unix_seconds(ts)
    nanos = nsec if nsec is not None else (F.pmod(F.unix_micros(ts), F.lit(1_000_000)) * 1000)
    offset = ((F.unix_seconds(local) - sec) / 60).cast("int")
    while (wide := _ITEM.sub(lambda m: COMPOSITE[m[4]] if m[4] in COMPOSITE and m[4] not in "%nt" else m[0], fmt)) != fmt:
        fmt = wide
    parts, at = [], 0
    for m in _ITEM.finditer(fmt):
        if m.start() > at:
            parts.append(F.lit(fmt[at : m.start()]))
        at = m.end()
        flags, width, code = m[1], m[2], m[4]
        if code in ("%", "n", "t"):
            out = F.lit(COMPOSITE[code])
        elif code in NAMES:
            out = F.date_format(local, NAMES[code])
        elif code in ("p", "P"):
            out = F.when(F.hour(local) < 12, "AM" if code == "p" else "am").otherwise("PM" if code == "p" else "pm")
            if "#" in flags:
                out = F.lower(out)
        elif code == "N":
            n = int(width or 9)
            out = F.rpad(F.substring(F.lpad(nanos.cast("string"), 9, "0"), 1, min(n, 9)), n, "0")
        elif code == "Z":
            out = F.lit(tz)
        elif code in ("z", ":z", "::z"):
            out = _zone(code, offset)
        elif code in PADS or code == "q":
            wanted, pad = PADS.get(code, (1, "0"))
            out = _number(code, local, sec).cast("string")
            pad = "" if "-" in flags else " " if "_" in flags else "0" if "0" in flags else pad
            wanted = int(width) if width else wanted
            out = F.when(F.length(out) < wanted, F.lpad(out, wanted, pad)).otherwise(out) if pad else out
        else:
            raise ValueError(f"unknown format {m[0]!r}")
        parts.append(F.upper(out) if "^" in flags or "#" in flags and code in NAMES else out)
    parts.append(F.lit(fmt[at:]))
    return F.concat(*parts)
