"""What people say about times: a word table, a few rules over it, and their evaluation.

A text becomes a list of marked words: each has a kind from LEXICON or is a number, a clock or a date. A rule is a sequence of
kinds. The same rules are matched on the driver, where a phrase becomes literals, and as one regular expression in a column.
"""

from __future__ import annotations

import calendar
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column

from logweave.functions.dates import to_utc

#: The parts of a day with the hours between which they lie.
SECTIONS = {"morning": (6, 12), "forenoon": (6, 12), "noon": (11, 14), "midday": (11, 14), "afternoon": (12, 18), "evening": (18, 24), "night": (0, 6), "overnight": (0, 6)}
#: Names of week days, in the order in which they are looked for, and of months.
WEEKDAYS = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")
MONTHS = tuple(m.lower() for m in calendar.month_name[1:])
#: Words that make a bare date in a text a question about it.
ASKING = ("when", "which", "did we", "have we", "had we", "do we", "does it", "decided", "discussed", "researched", "built", "happened", "shipped")
ASKING_WHAT = ("was", "is", "did", "were", "have", "has", "had")
#: Words before a date that make it a time asked about.
BEFORE_DATE = ("on", "since", "from")

#: Kind and value of each word.
LEXICON: dict[str, tuple[str, object]] = {
    **{w: ("section", hours) for w, hours in SECTIONS.items()},
    **{w: ("weekday", (i - 1) % 7) for i, w in enumerate(WEEKDAYS)},
    **{w: ("day", n) for w, n in (("yesterday", -1), ("today", 0), ("tomorrow", 1))},
    **{w: ("ago", None) for w in ("last", "past")},
    "previous": ("ago_some", None),
    **{w: ("till", None) for w in ("-", "–", "to", "and", "until")},
    **{w: ("open", None) for w in ("between", "from")},
    **{w: ("half", n) for w, n in (("am", 0), ("pm", 12))},
    **{f"{w}{s}": ("unit", n) for w, n in (("hour", 3600), ("day", 86400), ("week", 7 * 86400)) for s in ("", "s")},
}
#: What appointments say besides.
LATER: dict[str, tuple[str, object]] = {
    **{w[:3]: ("weekday", (i - 1) % 7) for i, w in enumerate(WEEKDAYS)},
    **{w[:n]: ("month", i) for i, w in enumerate(MONTHS, 1) for n in (3, len(w))},
    **{w: ("repeat", w) for w in ("daily", "weekly", "monthly", "weekdays")},
    **{w: ("each", None) for w in ("every", "each")},
    **{f"{w}{s}": ("unit", n) for w, n in (("minute", 60), ("min", 60)) for s in ("", "s")},
    "noon": ("clock", (12, 0)), "midday": ("clock", (12, 0)), "midnight": ("clock", (0, 0)), "next": ("next", None), "on": ("filler", None), "at": ("filler", None), "in": ("in", None), "of": ("filler", None),
}

EVERY = {"day": "daily", "week": "weekly", "month": "monthly", "weekday": "weekdays"}

#: Rules, each a sequence of kinds; a kind with a question mark may be missing.
RULES = {
    "ago": ("ago|ago_some", "number", "unit"),
    "ago_one": ("ago", "one_unit"),
    "before_yesterday": ("two_days_back",),
    "day": ("day",),
    "weekday": ("weekday",),
    "hours": ("number|clock", "half?", "till", "number|clock", "half?"),
    "section": ("section",),
}

_MARKED = re.compile(r"(?P<date>\d{4}-\d{2}-\d{2})|(?P<clock>\d{1,2}:\d{2})(?!\d)|(?P<number>\d+)|(?P<word>day before yesterday|[^\W\d_]+|[-–])")


@dataclass(frozen=True)
class Mark:
    kind: str
    value: object
    said: str


def marks(text: str, words: dict[str, tuple[str, object]]) -> list[Mark]:
    """The text's words, numbers, clocks and dates with their kinds; any other word is of kind ``other``."""
    out = []
    for m in _MARKED.finditer(text.lower()):
        said = m.group()
        if m.lastgroup == "number":
            out.append(Mark("number", int(said), said))
        elif m.lastgroup == "clock":
            out.append(Mark("clock", tuple(map(int, said.split(":"))), said))
        elif m.lastgroup == "date":
            out.append(Mark("date", _day(said), said))
        elif said == "day before yesterday":
            out.append(Mark("two_days_back", -2, said))
        else:
            out.append(Mark(*words.get(said, ("other", said)), said))
    return out


def _day(said: str) -> date | None:
    try:
        return date.fromisoformat(said)
    except ValueError:
        return None


def _is(mark: Mark, kind: str) -> bool:
    if kind == "one_unit":
        return mark.kind == "unit" and not mark.said.endswith("s")
    return mark.kind in kind.split("|")


def match(found: list[Mark], rule: tuple[str, ...], at: int) -> list[Mark | None] | None:
    """The marks that fill the rule from place at on, None where an optional one is missing."""
    out: list[Mark | None] = []
    for kind in rule:
        here = at < len(found) and _is(found[at], kind.rstrip("?"))
        if not here and not kind.endswith("?"):
            return None
        out.append(found[at] if here else None)
        at += here
    return out


def places(found: list[Mark], rule: str) -> Iterator[list[Mark | None]]:
    for at in range(len(found)):
        if (m := match(found, RULES[rule], at)) is not None:
            yield m


def _clock(mark: Mark, half: Mark | None) -> tuple[int, int]:
    hour, minute = mark.value if mark.kind == "clock" else (mark.value, 0)
    return (hour if half is None else hour % 12 + half.value, minute)


def _hours(found: list[Mark]) -> tuple[tuple[int, int], tuple[int, int]] | None:
    """From when to when within a day: a span of clocks, where one half of the day stands for both, else the part of a day."""
    for a, half_a, _, b, half_b in places(found, "hours"):
        if all(m.kind == "clock" or len(m.said) <= 2 for m in (a, b)):
            span = _clock(a, half_a or half_b), _clock(b, half_b or half_a)
            return span if span[0][0] != span[1][0] or "clock" in (a.kind, b.kind) else None
    said = {m.said for m in found if m.kind == "section"}
    return next((((lo, 0), (hi, 0)) for w, (lo, hi) in SECTIONS.items() if w in said), None)


def _which_day(found: list[Mark], today: date) -> date | None:
    """The day a text names: a date, a day counted from today, or the latest such week day before today."""
    for m in found:
        if m.kind == "date" and m.value:
            return m.value
    back = {m.value for m in found if m.kind in ("day", "two_days_back") and m.value <= 0}
    if back:
        return today + timedelta(days=min(back))
    named = {m.value for m in found if m.kind == "weekday"}
    first = next(((i - 1) % 7 for i in range(7) if (i - 1) % 7 in named), None)
    return None if first is None else today - timedelta(days=(today.weekday() - first) % 7 or 7)


def window_for(text: str | None, now: datetime, zone: str = "UTC") -> tuple[datetime, datetime] | None:
    """The half-open span in naive UTC that a text names, or None. now is naive UTC.

    "Last 3 days" counts back from now. A day is the zone's day; hours or a part of a day narrow it, and stand for today
    where no day is named. A text that names no time, and null, give None.
    """
    found = marks(text or "", LEXICON)
    for _, n, unit in places(found, "ago"):
        if 0 < n.value < 1000:
            return now - timedelta(seconds=n.value * unit.value), now
    for ago, unit in places(found, "ago_one"):
        return now - timedelta(seconds=unit.value), now
    from zoneinfo import ZoneInfo

    today = now.replace(tzinfo=ZoneInfo("UTC")).astimezone(ZoneInfo(zone)).date()
    day, hours = _which_day(found, today), _hours(found)
    if day is None and hours is None:
        return None
    at = lambda h, m: to_utc(datetime.combine(day or today, datetime.min.time()) + timedelta(hours=h, minutes=m), zone)
    try:
        return (at(0, 0), at(24, 0)) if hours is None else (at(*hours[0]), at(*hours[1]))
    except OverflowError:
        return None


# ---- the same rules as a column

_NUMBER, _CLOCK = r"\d{1,3}", r"\d{1,2}(?::\d{2})?"


def _as_regex(kind: str) -> str:
    if kind.endswith("?"):
        return f"(?:{_as_regex(kind[:-1])})?"
    if kind == "number|clock":
        return _CLOCK
    if kind == "number":
        return _NUMBER
    if kind == "two_days_back":
        return "day before yesterday"
    words = [w for w, (k, _) in LEXICON.items() if k in ("unit" if kind == "one_unit" else kind).split("|")]
    if kind == "one_unit":
        words = [w for w in words if not w.endswith("s")]
    if kind == "day":
        words.remove("tomorrow")
    return "(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")"


def _rule_regex(rule: tuple[str, ...]) -> str:
    return r"\b" + r"\s*".join(map(_as_regex, rule)) + r"\b"


#: Regular expressions, for lower-case texts without their dates: what asks about a time by itself; a date; what makes one a question.
INTENT = "|".join(_rule_regex(r) for r in RULES.values())
DATE = r"\b\d{4}-\d{2}-\d{2}\b"
DATE_ASKED = rf"\b(?:{'|'.join(BEFORE_DATE)})\s+\d{{4}}-\d{{2}}-\d{{2}}\b"
QUESTION = rf"\b(?:{'|'.join(ASKING)}|what\s+(?:{'|'.join(ASKING_WHAT)}))\b"


def has_time_intent(c: Column) -> Column:
    """Whether a text asks about a time: by a rule of its own, by a date behind on, since or from, or by a date anywhere and a word that asks."""
    from pyspark.sql import functions as F

    low = F.lower(c)
    return F.regexp_replace(low, DATE, " ").rlike(INTENT) | low.rlike(DATE_ASKED) | (low.rlike(DATE) & low.rlike(QUESTION))


# ---- appointments


def appointment(text: str | None, now: datetime, zone: str = "UTC") -> dict | None:
    """``{"at", "repeat", "default_time"}`` of an appointment phrase, at in naive UTC; None if any word of it is not understood.

    An instant with its own zone is taken as it is. "In 3 days" counts on from now. A day may be a date, a month and day, today,
    tomorrow, the day after tomorrow or the next such week day; without a clock it means nine o'clock. A clock alone, or the
    week day of today with one, is the next time it strikes. daily, weekly, monthly and weekdays, or every with day, week, month or
    weekday, may stand first and set the repeat; a repeat on weekdays begins on one.
    """
    from zoneinfo import ZoneInfo

    said = (text or "").strip()
    if re.fullmatch(r"\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:[Zz]|[+-]\d\d:?\d\d)", said):
        try:
            return {"at": datetime.fromisoformat(said.upper()).astimezone(ZoneInfo("UTC")).replace(tzinfo=None), "repeat": None, "default_time": False}
        except ValueError:
            return None
    after = re.sub(r"(?i)\bday after tomorrow\b", "overmorrow", re.sub(r"(\d)[Tt](\d)", r"\1 \2", said))
    if re.sub(_MARKED, "", after.lower()).strip(" ,."):
        return None
    rest = [m for m in marks(after, LEXICON | LATER | {"overmorrow": ("day", 2)}) if m.kind != "filler"]
    wall = now.replace(tzinfo=ZoneInfo("UTC")).astimezone(ZoneInfo(zone)).replace(tzinfo=None)
    if (m := match(rest, ("in", "number", "unit"), 0)) and len(rest) == 3:
        step = timedelta(seconds=m[1].value * m[2].value)
        if not step:
            return None
        # Days and weeks keep the clock, also over a change of it.
        at = now + step if m[2].value < 86400 else to_utc(wall + step, zone)
        return {"at": at, "repeat": None, "default_time": False}
    repeat = None
    if rest and rest[0].kind == "repeat":
        repeat, rest = rest[0].value, rest[1:]
    elif len(rest) > 1 and rest[0].kind == "each" and rest[1].said in EVERY:
        repeat, rest = EVERY[rest[1].said], rest[2:]
    day, clock, weekday = None, None, False
    while rest:
        if clock is None and (m := match(rest, ("number|clock", "half"), 0)) and 1 <= (h := m[0].value if m[0].kind == "number" else m[0].value[0]) <= 12:
            clock, rest = _clock(m[0], m[1]), rest[2:]
        elif clock is None and rest[0].kind == "clock":
            clock, rest = rest[0].value, rest[1:]
        elif day is None and rest[0].kind == "date" and rest[0].value:
            day, rest = rest[0].value, rest[1:]
        elif day is None and rest[0].kind == "day" and rest[0].value >= 0:
            day, rest = wall.date() + timedelta(days=rest[0].value), rest[1:]
        elif day is None and (m := match(rest, ("next?", "weekday"), 0)):
            day, weekday, rest = wall.date() + timedelta(days=(m[1].value - wall.weekday()) % 7), True, rest[1 + (m[0] is not None) :]
        elif day is None and (m := match(rest, ("month", "number"), 0) or match(rest, ("number", "month"), 0)):
            month, number = (m[0], m[1]) if m[0].kind == "month" else (m[1], m[0])
            year = rest[2].value if len(rest) > 2 and rest[2].kind == "number" and len(rest[2].said) == 4 else None
            rest = rest[2 + (year is not None) :]
            try:
                day = date(year or wall.year, month.value, number.value)
                if year is None and day < wall.date():
                    day = date(wall.year + 1, month.value, number.value)
            except ValueError:
                return None
        else:
            return None
    if clock is not None and not (0 <= clock[0] < 24 and 0 <= clock[1] < 60) or day is None and clock is None:
        return None
    at = datetime.combine(day or wall.date(), datetime.min.time()) + timedelta(hours=(clock or (9, 0))[0], minutes=(clock or (9, 0))[1])
    if at <= wall and (day is None or weekday):
        at += timedelta(days=7 if weekday else 1)
    while repeat == "weekdays" and at.weekday() > 4:
        at += timedelta(days=1)
    return {"at": to_utc(at, zone), "repeat": repeat, "default_time": clock is None}
