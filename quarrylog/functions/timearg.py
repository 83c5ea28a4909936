"""Time arguments of options: durations, dates in several forms, English; always resolved on the driver."""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

# Duration units in seconds.
UNITS = {
    "ns": 1e-9, "nsec": 1e-9, "us": 1e-6, "usec": 1e-6, "ms": 1e-3, "msec": 1e-3,
    "s": 1, "sec": 1, "secs": 1, "second": 1, "seconds": 1, "m": 60, "min": 60, "mins": 60, "minute": 60, "minutes": 60,
    "h": 3600, "hr": 3600, "hrs": 3600, "hour": 3600, "hours": 3600, "d": 86400, "day": 86400, "days": 86400,
    "w": 604800, "week": 604800, "weeks": 604800, "M": 2630016, "month": 2630016, "months": 2630016,
    "y": 31557600, "year": 31557600, "years": 31557600,
}
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_STEP = re.compile(r"\s*(\d+)\s*([A-Za-z]+)")
_ISO = re.compile(r"(\d{4})-(\d{2})-(\d{2})(?:[Tt ](\d{2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?)?\s*(Z|z|[+-]\d{2}:?\d{2})?\Z")


def duration(text: str) -> timedelta | None:
    at, total = 0, 0.0
    while at < len(text):
        m = _STEP.match(text, at)
        if not m or m[2] not in UNITS:
            return None
        total += int(m[1]) * UNITS[m[2]]
        at = m.end()
    return timedelta(seconds=total) if at else None


def _clock(text: str) -> tuple[int, int, int] | None:
    m = re.fullmatch(r"(\d{1,2})(?::(\d{2}))?(?::(\d{2}))?\s*(am|pm)?", text)
    if not m or not (m[2] or m[4]):
        return None
    hour = int(m[1])
    if m[4]:
        hour = hour % 12 + 12 * (m[4] == "pm")
    return hour, int(m[2] or 0), int(m[3] or 0)


def _english(text: str, now: datetime) -> datetime | None:
    words = text.lower().replace(",", " ").split()
    midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
    if text.lower().strip() == "now":
        return now
    m = re.fullmatch(r"(\d+)\s*([a-z]+)\s+ago", " ".join(words))
    if m and m[2] in UNITS:
        return now - timedelta(seconds=int(m[1]) * UNITS[m[2]])
    if len(words) == 1 and re.fullmatch(r"[12]\d{3}", words[0]):
        return midnight.replace(year=int(words[0]), month=1, day=1)
    if len(words) > 1 and words[0].isdigit() and len(words[1]) >= 3 and any(x.startswith(words[1]) for x in MONTHS):
        words[:2] = words[1], words[0]  # a day before its month
    day, rest = None, words
    if words[:1] in (["today"], ["yesterday"], ["tomorrow"]):
        day, rest = midnight + timedelta(days={"today": 0, "yesterday": -1, "tomorrow": 1}[words[0]]), words[1:]
    else:
        if words[:1] in (["last"], ["next"]):
            ahead, rest = words[0] == "next", words[1:]
        else:
            ahead = False
        name = rest[0] if rest else ""
        found = [i for i, d in enumerate(DAYS) if len(name) >= 3 and d.startswith(name)]
        if len(found) == 1:
            back = (midnight.weekday() - found[0]) % 7 or 7
            day, rest = midnight + timedelta(days=7 - back if ahead and back < 7 else 7 if ahead else -back), rest[1:]
        elif name in ("week", "month", "year", "day") and rest is not words:
            step = timedelta(seconds=UNITS[name])
            return now + step if ahead else now - step
        else:
            found = [i for i, d in enumerate(MONTHS, 1) if len(name) >= 3 and d.startswith(name)]
            if len(found) == 1:
                rest = rest[1:]
                number = int(rest.pop(0)) if rest and rest[0].isdigit() and int(rest[0]) <= 31 else 1
                year = int(rest.pop(0)) if rest and re.fullmatch(r"\d{4}", rest[0]) else None
                day = midnight.replace(month=found[0], day=number, year=year or midnight.year)
                if year is None and day > now:
                    day = day.replace(year=day.year - 1)
    if day is None:
        clock = _clock(" ".join(words))
        return midnight.replace(hour=clock[0], minute=clock[1], second=clock[2]) if clock else None
    if not rest:
        return day
    clock = _clock(" ".join(x for x in rest if x != "at"))
    return day.replace(hour=clock[0], minute=clock[1], second=clock[2]) if clock else None


def _by_format(text: str, fmt: str, now: datetime) -> datetime | None:
    """``text`` in the output format; what it leaves out is as now, and the result is not after now."""
    plain = re.sub(r"%(\d*)N", "%f", fmt).replace("%T", "%H:%M:%S").replace("%F", "%Y-%m-%d").replace("%R", "%H:%M").replace("%e", "%d").replace("%k", "%H")
    try:
        found = datetime.strptime(text, plain)
    except ValueError:
        return None
    given = set(re.findall(r"%([a-zA-Z])", plain))
    year = found.year if given & set("YyG") else now.year
    out = found.replace(year=year, tzinfo=found.tzinfo or now.tzinfo)
    if not given & set("mbBj"):
        out = out.replace(month=now.month)
    if not given & set("dj"):
        out = out.replace(day=now.day)
    if out > now and not given & set("YyG"):
        out = out - timedelta(days=1) if not given & set("mbBdj") else out.replace(year=out.year - 1)
    return out


def parse_time(text: str, now: datetime, fmt: str | None = None) -> datetime:
    """The instant that ``text`` means at ``now`` (with a zone): -3h, +1d, the output format, RFC 3339, then English."""
    text = text.strip()
    if text[:1] in "+-" and (step := duration(text[1:])) is not None:
        return now + step if text[0] == "+" else now - step
    if fmt and (found := _by_format(text, fmt, now)):
        return found
    if m := _ISO.match(text):
        micro = int((m[7] or "").ljust(9, "0")[:6] or 0)
        out = datetime(int(m[1]), int(m[2]), int(m[3]), int(m[4] or 0), int(m[5] or 0), int(m[6] or 0), micro, now.tzinfo)
        if m[8]:
            zone = 0 if m[8] in "Zz" else (1 if m[8][0] == "+" else -1) * (int(m[8][1:3]) * 60 + int(m[8][-2:]))
            out = out.replace(tzinfo=ZoneInfo("UTC")) - timedelta(minutes=zone)
        return out
    if duration(text) is None and (found := _english(text, now)):
        return found
    raise ValueError(f"{text!r} is no time")
