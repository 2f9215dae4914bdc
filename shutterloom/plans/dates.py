"""Spoken dates to inclusive day ranges; the first rule that fits wins. Today is given, weeks begin on Monday."""

from __future__ import annotations

import calendar
import re
from datetime import date, timedelta

from shutterloom.plans import words as W

Range = tuple[date, date]


def _month(year: int, month: int) -> Range:
    year, month = year + (month - 1) // 12, (month - 1) % 12 + 1
    return date(year, month, 1), date(year, month, calendar.monthrange(year, month)[1])


def _year(year: int) -> Range:
    return date(year, 1, 1), date(year, 12, 31)


def _monday(day: date) -> date:
    return day - timedelta(days=day.weekday())


def _named_month(q: str) -> int | None:
    m = re.search(r"(?<!\d)(1[0-2]|[1-9])월", q)
    if m:
        return int(m[1])
    for i, name in enumerate(W.MONTHS, 1):
        if re.search(rf"\b(?:{name}|{name[:3]})\b", q) and (name != "may" or re.search(r"\b(?:in|of|last|this) may\b|\bmay \d{4}\b", q)):
            return i
    return None


def _reference_year(q: str, today: date) -> int | None:
    if re.search(r"the year before last|재작년", q):
        return today.year - 2
    if re.search(r"last year|작년", q):
        return today.year - 1
    if re.search(r"this year|올해", q):
        return today.year
    m = re.search(r"(?<!\d)((?:19|20)\d\d)(?!\d)", q)
    if m:
        return int(m[1])
    m = re.search(r"(?<!\d)(\d\d)년", q)
    return 2000 + int(m[1]) if m else None


def parse(query: str, today: date) -> Range | None:
    q = f" {query.lower()} "
    back = lambda n: today - timedelta(days=n)
    monday = _monday(today)
    if re.search(r"\btoday\b|오늘", q):
        return today, today
    if re.search(r"day before yesterday|그저께|그제", q):
        return back(2), back(2)
    if re.search(r"\byesterday\b|어제", q):
        return back(1), back(1)
    m = re.search(r"\b(?:last|past) (\d+) (day|week)s?\b", q)
    if m:
        return back(int(m[1]) * (7 if m[2] == "week" else 1)), today
    if re.search(r"\bthis week\b", q):
        return monday, today
    if re.search(r"\bthis month\b", q):
        return today.replace(day=1), today
    if re.search(r"\blast week\b", q):
        return monday - timedelta(days=7), monday - timedelta(days=1)
    if re.search(r"\blast month\b", q):
        return _month(today.year, today.month - 1)
    if re.search(r"\blast year\b", q):
        return _year(today.year - 1)
    if re.search(r"\bthis year\b", q):
        return date(today.year, 1, 1), today
    month = _named_month(q)
    if re.search(r"\brecently\b|\brecent\b|최근에", q) and not re.search(r"최근 ?\d", q):
        return back(30), today
    m = re.search(r"최근 ?(\d+) ?(일|주)", q)
    if m:
        return back(int(m[1]) * (7 if m[2] == "주" else 1)), today
    if re.search(r"최근 ?(?:사진|이미지)", q):
        return back(7), today
    if re.search(r"\bnewest\b|최신|최근", q):
        return back(30), today
    m = re.search(r"(\d+) days? ago|(\d+) ?일 전", q)
    if m:
        day = back(int(m[1] or m[2]))
        return day, day
    m = re.search(r"(\d+) years? ago|(\d+) ?년 전", q)
    if m:
        year = today.year - int(m[1] or m[2])
        return _month(year, month) if month else _year(year)
    year = _reference_year(q, today)
    m = re.search(r"(\d+) months? ago|(\d+) ?(?:개월|달) 전", q)
    if m:
        return _month(today.year, today.month - int(m[1] or m[2]))
    m = re.search(r"(\d+) weeks? ago|(\d+) ?주 전", q)
    if m:
        start = monday - timedelta(days=7 * int(m[1] or m[2]))
        return start, min(today, start + timedelta(days=6))
    if re.search(r"지난 ?달", q):
        return _month(today.year, today.month - 1)
    if re.search(r"next month|다음 ?달", q):
        return _month(today.year, today.month + 1)
    if re.search(r"이번 ?달", q):
        return today.replace(day=1), today
    if re.search(r"(?:start|beginning) of the month|월초", q):
        return today.replace(day=1), min(today, today.replace(day=10))
    if re.search(r"end of the month|월말", q):
        last = _month(today.year, today.month)[1]
        return max(today.replace(day=20), today), last
    if re.search(r"this weekend|이번 ?주말", q):
        saturday = today + timedelta(days=(5 - today.weekday()) % 7)
        return saturday, saturday + timedelta(days=1)
    if re.search(r"last weekend|지난 ?주말", q):
        return monday - timedelta(days=2), monday - timedelta(days=1)
    if re.search(r"지난 ?주", q):
        return monday - timedelta(days=7), monday - timedelta(days=1)
    if re.search(r"이번 ?주", q):
        return monday, today
    if month:
        return _month(year or today.year, month)
    y = year or today.year
    for pattern, (back, first), last in _WINDOWS:
        if re.search(pattern, q):
            return date(y - back, *first), date(y, *last)
    return _year(year) if year else None


# What a phrase means within its year y: the years back and the first day, and the last day.
_WINDOWS = (
    (r"lunar new year|설날|설 ", (0, (1, 15)), (2, 28)),
    (r"chuseok|추석", (0, (9, 10)), (10, 15)),
    (r"christmas|크리스마스", (0, (12, 20)), (12, 31)),
    (r"\bspring\b|봄", (0, (3, 1)), (5, 31)),
    (r"\bsummer\b|여름", (0, (6, 1)), (8, 31)),
    (r"\bautumn\b|\bfall\b|가을", (0, (9, 1)), (11, 30)),
    (r"\bwinter\b|겨울", (1, (12, 1)), (2, 28)),
    (r"first half|상반기", (0, (1, 1)), (6, 30)),
    (r"second half|하반기", (0, (7, 1)), (12, 31)),
    (r"(?:early|beginning of the) year|연초", (0, (1, 1)), (2, 28)),
    (r"(?:late|end of the) year|year end|연말", (0, (11, 1)), (12, 31)),
)
