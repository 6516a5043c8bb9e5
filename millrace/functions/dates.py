"""Reading dates out of text, and taking dates apart."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..fixed_values import DATE_NOISE, MONTHS
from .numbers import let

MONTH_NAMES = "january february march april may june july august september october november december".split()
MONTH = "(" + "|".join(["sept"] + [f"{n[:3]}(?:{n[3:]})?" if n[3:] else n for n in MONTH_NAMES]) + ")"
# Shapes of a date. Their groups, by number: year, month and day; first, second and year last; day, month name and
# year; month name, day and year; month name and year; eight digits.
WHOLE_DATES = [
    r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})",
    r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})",
    rf"(\d{{1,2}})(?:st|nd|rd|th)?[\s-]+{MONTH}\.?[\s,.-]+(\d{{4}})",
    rf"{MONTH}\.?[\s-]+(\d{{1,2}})(?:st|nd|rd|th)?,?[\s-]+(\d{{4}})",
]
MONTH_OF_YEAR = rf"{MONTH}\.?[\s,-]+(\d{{4}})"
DIGITS = r"(\d{4})(\d{2})(\d{2})"
WEEKDAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"
CLOCK = r"(?:[\sT]+(\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d{1,6})?))?(?:\s*([ap])m)?(?:\s*(?:z|utc|gmt|[+-]\d{2}:?\d{2}))?)?"
WHOLE_TEXT = f"(?i)^{WEEKDAY}(?:{'|'.join([*WHOLE_DATES, MONTH_OF_YEAR, DIGITS])}){CLOCK}$"
#: The same without months alone, whose groups stay empty, somewhere in a text.
INSIDE_TEXT = f"(?is)^.*?(?<!\\d)(?:{'|'.join(WHOLE_DATES)}|()()^{DIGITS}$)(?!\\d).*$"
#: What stands between the groups once a pattern has rewritten a text to them.
MARK = "\u0001"
YEAR, MONTH_DIGITS, DAY, NAME, FIRST, SECOND, LAST, HOUR, MINUTE, SECONDS, HALF = range(1, 12)
GROUPS = ["$1$9$12$14$15", "$2$16", "$3$7$11$17", "$8$10$13", "$4", "$5", "$6", "$18", "$19", "$20", "$21"]


def parse_timestamp(text: Column, formats: list[str] | None = None) -> Column:
    """Text that is one date, with or without a time, as timestamp without zone, else null.

    The first of given formats that fits wins. Otherwise ISO text is read, and dates
    with any of the separators ``-/.``, with month names, a weekday before them or no
    day (then the first), of two-digit years (from 1969) and of eight digits.
    All-digit dates are read month first unless the first part is above twelve. A
    zone behind the time is left out: the time stays that of the clock it was written by.
    """
    t = F.trim(text)
    if formats:
        return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)).cast("timestamp_ntz") for f in formats])
    return let(t, lambda t: F.coalesce(F.when(t.like("____-%"), t.try_cast("timestamp_ntz")), _read(t, WHOLE_TEXT, GROUPS)))


def _read(t: Column, pattern: str, groups: list[str]) -> Column:
    """The date and time that one match of a pattern finds; null for none and for days that do not exist.

    The pattern is matched once and rewrites the text to its groups; of the shapes
    that share a place only one has anything in it.
    """
    marked = F.when(~t.contains(MARK), F.regexp_replace(t, pattern, MARK + MARK.join(groups)))
    return let(F.split(marked, MARK), _timestamp_of)


def _timestamp_of(parts: Column) -> Column:
    part = lambda i: F.get(parts, i)
    number = lambda i: part(i).try_cast("int")
    year_last, day_first = part(LAST) != "", number(FIRST) > 12
    short = number(LAST) + F.when(number(LAST) >= 69, 1900).otherwise(2000)
    year = F.when(~year_last, number(YEAR)).when(F.length(part(LAST)) == 4, number(LAST)).otherwise(short)
    named = ((F.instr(F.lit("".join(MONTHS)), F.lower(F.substr(part(NAME), F.lit(1), F.lit(3)))) + 2) / 3).cast("int")
    month = F.when(year_last, F.when(day_first, number(SECOND)).otherwise(number(FIRST))).when(part(NAME) != "", named).otherwise(number(MONTH_DIGITS))
    day = F.when(year_last, F.when(day_first, number(FIRST)).otherwise(number(SECOND))).when(part(DAY) == "", 1).otherwise(number(DAY))
    timed, half = part(HOUR) != "", F.lower(part(HALF))
    hour = F.when(half == "", number(HOUR)).when(number(HOUR).between(1, 12), number(HOUR) % 12 + F.when(half == "p", 12).otherwise(0))
    seconds = F.when(part(SECONDS) == "", 0).otherwise(part(SECONDS).try_cast("decimal(16,6)"))
    clock = [F.when(timed, hour).otherwise(0), F.when(timed, number(MINUTE)).otherwise(0), F.when(timed, F.when(seconds < 60, seconds)).otherwise(0)]
    return F.try_make_timestamp_ntz(year, month, day, clock[0], clock[1], clock[2].cast("decimal(16,6)"))


def find_date(text: Column) -> Column:
    """Date written somewhere in text, else null.

    Noise words are removed; bare identifiers and bare numbers that are not
    eight digits are refused; the year must lie between 1900 and 2100. All-digit
    dates are read month first unless the first part is above twelve.
    """
    return let(F.trim(F.regexp_replace(text, DATE_NOISE, "")), _date_in)


def _date_in(t: Column) -> Column:
    identifier = t.rlike(r"^[A-Za-z]+[-_]?\d+$")
    found = _read(t, INSIDE_TEXT, [*GROUPS[:HOUR - 1], "", "", "", ""]).cast("date")
    return let(found, lambda d: F.when(~identifier & F.year(d).between(1901, 2099), d))


def standard_date(text: Column) -> Column:
    """``yyyy-MM-dd`` text of the date found in the text, else null."""
    return F.date_format(find_date(text), "yyyy-MM-dd")


COMPONENTS = {
    "year": F.year,
    "month": F.month,
    "day": F.dayofmonth,
    "hour": F.hour,
    "minute": F.minute,
    "dayofweek": F.weekday,
    "dayofyear": F.dayofyear,
    "weekofyear": F.weekofyear,
    "quarter": F.quarter,
    "is_weekend": lambda c: F.coalesce((F.weekday(c) >= 5).cast("int"), F.lit(0)),
    "is_month_start": lambda c: F.coalesce((F.dayofmonth(c) == 1).cast("int"), F.lit(0)),
    "is_month_end": lambda c: F.coalesce((F.last_day(c) == c.cast("date")).cast("int"), F.lit(0)),
}
