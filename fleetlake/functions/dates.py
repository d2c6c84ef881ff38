"""Date parsing by a small grammar.

A date is year-month-day, month-day-year (day first where the month would not
fit), year-month, month-year, eight digits, or has the month's name before or
behind the day.  Numbers are joined by ``-``, ``/`` or ``.``.  A time of day may
follow, after blanks or ``T``, with seconds, a fraction, a half of the day and a
zone.  The zone is left out: what counts is the time as it is written.  Bare
numbers and times of day are no dates.

A text is brought into a plain form first, blanks, time and zone, then read by
the one rule whose shape it has.  Every parse is a ``try_`` variant: Spark 4
runs in ANSI mode and a plain cast would abort the job on the first bad cell.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_, py_strip

_TIME = r"(?i)(?:T| +)(\d{1,2}:\d{2}(?::\d{2})?)(?:(\.\d{1,6})\d*)? ?(am|pm)? ?(?:z|utc|gmt|[-+]\d{2}:?\d{2})?$"
_JOINED = r"(?:-\d{1,2}-|/\d{1,2}/|\.\d{1,2}\.)"
_WEEKDAY = r"(?i)^(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,? +)?"
_DAY, _YEAR = r"(\d{1,2})(?:st|nd|rd|th)?", r",?[ -]+(\d{4})"
_END = "(?: |$)"
# (shape, its parts, what they become, patterns in order): the first shape that fits decides.
SHAPES = (
    (rf"^\d{{4}}{_JOINED}\d{{1,2}}{_END}", r"^(\d+)[-/.](\d+)[-/.](\d+)", "$1-$2-$3", ("yyyy-M-d",)),
    (rf"^\d{{1,2}}{_JOINED}\d{{4}}{_END}", r"^(\d+)[-/.](\d+)[-/.](\d+)", "$1-$2-$3", ("M-d-yyyy", "d-M-yyyy")),
    (rf"^\d{{8}}{_END}", "", "", ("yyyyMMdd",)),
    (rf"{_WEEKDAY}[a-z]{{3,9}}\.?[ -]{_DAY}{_YEAR}{_END}", rf"{_WEEKDAY}([a-z]+)\.?[ -]{_DAY}{_YEAR}", "$1-$2-$3", ("MMM-d-yyyy", "MMMM-d-yyyy")),
    (rf"{_WEEKDAY}{_DAY}[ -][a-z]{{3,9}}\.?{_YEAR}{_END}", rf"{_WEEKDAY}{_DAY}[ -]([a-z]+)\.?{_YEAR}", "$1-$2-$3", ("d-MMM-yyyy", "d-MMMM-yyyy")),
    (r"^\d{4}[-/.]\d{1,2}$", "[/.]", "-", ("yyyy-M",)),
    (r"^\d{1,2}[-/]\d{4}$", "/", "-", ("M-yyyy",)),
    (r"(?i)^[a-z]{3,9}\.?[ -]\d{4}$", r"\.?[ -]", "-", ("MMM-yyyy", "MMMM-yyyy")),
)
_CLOCK, _HALVES = "[ H:mm[:ss[.SSSSSS]]]", " h:mm[:ss[.SSSSSS]]a"

CANONICAL = "yyyy-MM-dd HH:mm:ss"


def parse_datetime(c) -> Column:
    """Text or timestamp -> timestamp, NULL when it is no date."""
    text = F.regexp_replace(py_strip(col_(c).cast("string")), _TIME, " $1$2$3")
    halves = text.rlike("(?i)[ap]m$")
    out = None
    for shape, parts, plain, patterns in SHAPES:
        here = F.regexp_replace(text, parts, plain) if parts else text
        read = lambda clock: F.coalesce(*[F.try_to_timestamp(here, F.lit(p + clock)) for p in patterns])  # noqa: E731, B023
        value = F.when(halves, read(_HALVES)).otherwise(read(_CLOCK)) if shape.endswith(_END) else read("")
        out = F.when(text.rlike(shape), value) if out is None else out.when(text.rlike(shape), value)
    return out


def parse_strict(c, pattern: str = CANONICAL) -> Column:
    """Only the exact pattern (``datetime.strptime`` semantics)."""
    return F.try_to_timestamp(col_(c).cast("string"), F.lit(pattern))


def format_ts(c, pattern: str = CANONICAL) -> Column:
    return F.date_format(col_(c), pattern)


def py_to_spark_pattern(fmt: str) -> str:
    """Translate the strftime codes used by format specs."""
    table = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss"}
    out = fmt
    for k, v in table.items():
        out = out.replace(k, v)
    return out
