"""Parsing one written time into an instant or a day."""

from __future__ import annotations

import re
from datetime import UTC, date, datetime, timedelta, timezone
from decimal import Decimal
from functools import lru_cache
from zoneinfo import ZoneInfo

#: Month names by their first three letters, and zone abbreviations in hours.
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "WEST": 1, "BST": 1, "CET": 1, "CEST": 2, "EET": 2, "EEST": 3, "MSK": 3,
    "IST": 5.5, "JST": 9, "KST": 9, "AWST": 8, "ACST": 9.5, "ACDT": 10.5, "AEST": 10, "AEDT": 11, "NZST": 12, "NZDT": 13,
    "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "AKST": -9, "AKDT": -8, "HST": -10,
}

#: Numbers count from 1970 in the unit that gives a date in these years.
FIRST_YEAR, LAST_YEAR = 2023, 2026
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
FIRST_MS, END_MS = (int((datetime(y, 1, 1, tzinfo=UTC) - EPOCH).total_seconds() * 1000) for y in (FIRST_YEAR, LAST_YEAR + 1))
UNITS_PER_S = (1, 10**3, 10**6, 10**9)

CLOCK = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?\s*(?P<half>[ap]\.?m\.?(?![A-Za-z]))?"
ZONE = r"(?:\s*(?P<off>[+-]\d{2}(?::?\d{2})?)|\s*\[?(?P<zone>[A-Za-z]+(?:/[A-Za-z_+\-0-9]+)+)\]?|\s*\[?(?P<abbr>[A-Za-z]{1,5})\]?)?"
TAIL = rf"(?:[T\s,]+(?:at\s+)?{CLOCK}{ZONE})?"
WEEKDAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"
FORMS = [
    re.compile(p, re.IGNORECASE)
    for p in (
        rf"(?P<y>\d{{4}})(?P<sep>[-/.])(?P<m>\d{{1,2}})(?P=sep)(?P<d>\d{{1,2}}){TAIL}",
        rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})(?:T(?P<h>\d{{2}})(?P<mi>\d{{2}})(?:(?P<s>\d{{2}})(?:[.,](?P<f>\d+))?)?{ZONE})?",
        rf"(?P<y>\d{{4}})\s*年\s*(?P<m>\d{{1,2}})\s*月\s*(?P<d>\d{{1,2}})\s*日(?:\s*{CLOCK}{ZONE})?",
        rf"(?P<n1>\d{{1,2}})(?P<sep>[-/.])(?P<n2>\d{{1,2}})(?P=sep)(?P<y>\d{{4}}){TAIL}",
        rf"{WEEKDAY}(?P<d>\d{{1,2}})(?:st|nd|rd|th)?[\s-]+(?P<mon>[a-z]{{3,9}})\.?,?[\s-]+(?P<y>\d{{4}}){TAIL}",
        rf"{WEEKDAY}(?P<mon>[a-z]{{3,9}})\.?\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}}){TAIL}",
        rf"{WEEKDAY}(?P<mon>[a-z]{{3,9}})\.?\s+(?P<d>\d{{1,2}})\s+{CLOCK}\s+(?P<y>\d{{4}}){ZONE}",
    )
]
NUMBER = re.compile(r"[+]?\d+(?:\.\d+)?(?:[eE][+]?\d+)?")


@lru_cache(maxsize=2048)
def zone_of(name: str | None) -> ZoneInfo | None:
    """The zone of that name, or None for one that does not exist."""
    try:
        return ZoneInfo(name) if name else None
    except Exception:
        return None


def epoch_ms(number: Decimal) -> int | None:
    """Milliseconds of a number since 1970 in the one unit that gives a plausible date; finer digits cut off."""
    for unit in UNITS_PER_S:
        ms = int(number * 1000 / unit)
        if FIRST_MS <= ms < END_MS:
            return ms
    return None


def month_of(name: str) -> int | None:
    """The month of an English name or abbreviation of at least three letters."""
    number = MONTHS.get(name[:3].lower())
    full = "january february march april may june july august september october november december".split()
    return number if number and (full[number - 1].startswith(name.lower()) or name.lower() == "sept") else None


def norm_instant(ms: int) -> str:
    """YYYY-MM-DDTHH:MM:SS.mmmZ"""
    t = EPOCH + timedelta(milliseconds=ms)
    return t.strftime("%Y-%m-%dT%H:%M:%S.") + f"{ms % 1000:03d}Z"


def parse(raw: str | None, zone: str | None, day_first: bool | None, as_day: bool) -> str | None:
    """The unambiguous form of a written time, or None where it denotes none.

    An instant is given as UTC with milliseconds, or with as_day as a day: as written, or the UTC
    day where the text is an instant (a number, or a time with zone or offset). A time without
    zone is wall time in `zone`, UTC where that is missing or unknown: a wall time that occurs
    twice means the first, a skipped one is read with the offset before the change. A date
    without time is midnight. Numeric dates that do not start with the year follow day_first;
    where it is unknown only dates that have one reading are read.
    """
    if raw is None:
        return None
    text = raw.strip().strip("﻿").strip()
    if not text:
        return None
    if NUMBER.fullmatch(text):
        try:
            ms = epoch_ms(Decimal(text))
        except (ArithmeticError, OverflowError):
            return None
        if ms is not None:
            return norm_instant(ms)[:10] if as_day else norm_instant(ms)
    for form in FORMS:
        found = form.fullmatch(text)
        if found:
            return _built(found.groupdict(), zone, day_first, as_day)
    return None


def _built(g: dict, zone: str | None, day_first: bool | None, as_day: bool) -> str | None:
    if g.get("n1"):
        first, second = int(g["n1"]), int(g["n2"])
        if day_first is None and first <= 12 and second <= 12 and first != second:
            return None
        by_day = day_first if day_first is not None else first > 12
        day, month = (first, second) if by_day else (second, first)
    else:
        month, day = month_of(g["mon"]) if g.get("mon") else int(g["m"]), int(g["d"])
    try:
        whole = date(int(g["y"]), month, day)
    except (ValueError, TypeError):
        return None
    hour = int(g["h"]) if g.get("h") else 0
    if g.get("half"):
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + 12 * (g["half"][0].lower() == "p")
    minute, second = int(g.get("mi") or 0), int(g.get("s") or 0)
    if hour > 23 or minute > 59 or second > 59:
        return None
    ms = int(((g.get("f") or "") + "000")[:3])
    wall = datetime(whole.year, whole.month, whole.day, hour, minute, second)
    zoned = True
    if g.get("off"):
        digits = g["off"][1:].replace(":", "")
        shift = timedelta(hours=int(digits[:2]), minutes=int(digits[2:] or 0))
        if shift >= timedelta(hours=24):
            return None
        wall = wall.replace(tzinfo=timezone(-shift if g["off"][0] == "-" else shift))
    elif g.get("zone"):
        named = zone_of(g["zone"])
        if named is None:
            return None
        wall = wall.replace(tzinfo=named)
    elif g.get("abbr"):
        hours = ABBREVIATIONS.get(g["abbr"].upper())
        if hours is None:
            return None
        wall = wall.replace(tzinfo=timezone(timedelta(hours=hours)))
    else:
        zoned = False
        wall = wall.replace(tzinfo=zone_of(zone) or UTC)
    if as_day and not zoned:
        return whole.isoformat()
    try:
        since = wall - EPOCH
    except OverflowError:
        return None
    total = since // timedelta(milliseconds=1) + ms
    return norm_instant(total)[:10] if as_day else norm_instant(total)
