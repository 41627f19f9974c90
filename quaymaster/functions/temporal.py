"""Date and timestamp parsing (C6, C7, C13d, C15, C22, C25).

Every accepted shape is rewritten to ISO order and cast by Spark, so no
formatter (and no exception per non-matching row) is involved. Slash dates are
month first, dash dates are day first, offset-free times are UTC. Month names may
come before or after the day, with a day name and a GMT or UTC zone as in mail
headers; times may be of twelve hours; years of two digits are 1950 to 2049; a year
with a month alone is its first day.

A rewrite is a chain in which the input appears once, so that an expression stays small
however often it is used. Words are turned into numbers by back-references into a table
that is appended to the text.

``formats`` chooses the shapes that are read, in place of all of them: names of ``SHAPES``
(an order of day and month holds for slashes, dashes and dots alike) or Spark patterns such
as ``dd/MM/yyyy``. ``operators.dates.infer_formats`` finds them from a column's values.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F, types as T

from quaymaster import constants as K
from quaymaster.functions.text import is_nullish, js_trim

SHAPES = ("iso", "year_slash", "month_first", "day_first", "named")
_TIME = r"(?:[T ]\d{1,2}:\d{1,2}(?::\d{1,2}(?:\.\d{1,9})?)?\s?(?:Z|[+-]\d{2}:?\d{2})?)?"
_ISO = r"^\d{4}-\d{1,2}-\d{1,2}" + _TIME + r"\z"
_YEAR_SLASH = r"^(\d{4})/(\d{1,2})/(\d{1,2})(" + _TIME + r")\z"
_SLASH = r"^(\d{1,2})/(\d{1,2})/(\d{4})(" + _TIME + r")\z"
_DASH = r"^(\d{1,2})-(\d{1,2})-(\d{4})(" + _TIME + r")\z"
_ANY_ORDER = r"(\d{1,2})([/.-])(\d{1,2})\2(\d{4})(" + _TIME + r")\z"
_MONTH = r"(?:0?[1-9]|1[0-2])[/.-]"
_REWRITES = {"year_slash": (_YEAR_SLASH, "$1-$2-$3$4"),
             "month_first": (rf"^(?={_MONTH})" + _ANY_ORDER, "$4-$1-$3$5"),
             "day_first": (r"^(?=\d{1,2}[/.-]" + _MONTH + ")" + _ANY_ORDER, "$4-$3-$1$5")}
# --- fixed values: English month and day names ---
MONTH_NAMES = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
_DAYS = "mon|tue|wed|thu|fri|sat|sun"
_DAY_NAME = rf"(?:(?:{_DAYS})[a-z]*\.?,?\s+)?"
_NAMED_TIME = r"((?:,?[T ]\s*\d{1,2}:\d{1,2}[^\x01]*)?)"
# Months, centuries of the first digit of a short year, and hours of twelve-hour clocks, behind a mark that ends the text.
_TABLE = "\x01;" + "".join(
    [f"{name}{i:02d};" for i, name in enumerate(MONTH_NAMES.split("|"), 1)] + [f"{d}y{20 if d < 5 else 19};" for d in range(10)]
    + [f"{h}{half}{h % 12 + add:02d};" for half, add in (("a", 0), ("p", 12)) for h in range(1, 13)])
_LOOKED_UP = (
    (rf"(?i)^{_DAY_NAME}(\d{{1,2}})(?:st|nd|rd|th)?[ -]+({MONTH_NAMES})[a-z]*\.?,?[ -]+(\d{{4}}){_NAMED_TIME}(?=\x01)", "$3-$2-$1$4"),
    (rf"(?i)^{_DAY_NAME}({MONTH_NAMES})[a-z]*\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}}){_NAMED_TIME}(?=\x01)", "$3-$1-$2$4"),
    (rf"(?i)^(\d{{4}}-)({MONTH_NAMES})(?=-[^\x01]*\x01.*?;\2(\d\d);)", "$1$3"),
    (r"(?i)\s*(?:GMT|UTC)(?=\x01)", "Z"),
    (r"\s+([+-]\d{2}):?(\d{2})(?=\x01)", "$1:$2"),
    (r"^(\d{4}-\d{1,2}-\d{1,2}),\s*", "$1 "),
    (r"(?i)([T ]\s*)(?:0(?=\d:))?(\d{1,2})(:\d{1,2}(?::\d{1,2})?)\s?([ap])\.?m\.?(?=\x01.*?;\2\4(\d\d);)", "$1$5$3"),
    (r"^(\d{1,2}(SEP)\d{1,2}\2)(?=(\d)\d(?!\d)[^\x01]*\x01.*?;\3y(\d\d);)", "$1$4"),
    (r"^(\d{4}-(?:0[1-9]|1[0-2]))(?=\x01)", "$1-01"),
    (r"(?s)\x01;jan01;.*", ""),
)
# Two letters together, a year of two digits or a year and a month: few texts, and only they pay for the table.
_UNUSUAL = r"[A-Za-z][A-Za-z.]|^\d{1,2}SEP\d{1,2}SEP\d\d(?:\D|\z)|^\d{4}-\d\d\z"


def _looked_up(t: Column, separators: str) -> Column:
    """Numbers for month names, clocks of twelve hours, short years (after ``separators``) and months alone.

    In a lambda, so that the text is worked out once and the chain, which few values go through, stays out of the generated code.
    """
    def numbered(v: Column) -> Column:
        x = F.concat(v, F.lit(_TABLE))
        for pattern, to in _LOOKED_UP:
            x = F.regexp_replace(x, pattern.replace("SEP", separators), to)
        return F.when(v.rlike(_UNUSUAL.replace("SEP", separators)), x).otherwise(v)
    return F.get(F.transform(F.array(t), numbered), F.lit(0))


def _iso_or_blank(c: Column, formats: Sequence[str] | None = None) -> Column:
    t = js_trim(c)
    if formats is None:
        t = _looked_up(t, "/")
        t = F.regexp_replace(t, _SLASH, "$3-$1-$2$4")
        t = F.regexp_replace(t, _DASH, "$3-$2-$1$4")
        t = F.regexp_replace(t, _YEAR_SLASH, "$1-$2-$3$4")
        return F.regexp_extract(t, _ISO, 0)
    if "named" in formats:
        t = _looked_up(t, "[/.-]")
    for shape in formats:  # of two orders the first named is tried first, and what it rewrites is ISO then
        if shape in _REWRITES:
            t = F.regexp_replace(t, *_REWRITES[shape])
    return F.regexp_extract(t, _ISO, 0)


def iso_text(c: Column, formats: Sequence[str] | None = None) -> Column:
    """The value in ISO order, NULL when it has none of the known (or given) shapes."""
    return F.nullif(_iso_or_blank(c, formats), F.lit(""))


def pattern_shape(pattern: str) -> str:
    """The regular expression of texts that a datetime pattern may read; the parser, which fails by exceptions, sees no others."""
    out = []
    for part in re.finditer(r"'(?P<quoted>(?:[^']|\'\')*)'|(?P<run>(?P<letter>[A-Za-z])(?P=letter)*)|.", pattern):
        letter, width = part["letter"], len(part.group())
        if letter is None:
            out.append(re.escape(part.group() if part["quoted"] is None else part["quoted"].replace("''", "'") or "'"))
        elif letter in "ML" and width > 2 or letter in "EaGzZXxV":
            out.append(r"[A-Za-z0-9:+.-]+")
        elif letter in "yuMLdHhmsS":
            out.append(rf"\d{{{width}}}" if width > 1 else r"\d{1,4}" if letter in "yu" else r"\d{1,2}")
        else:
            raise ValueError(f"letter {letter!r} is not supported in a date pattern")
    return "^" + "".join(out) + r"\z"


def _by_pattern(c: Column, pattern: str) -> Column:
    t = js_trim(c)
    return F.try_to_timestamp(F.when(t.rlike(pattern_shape(pattern)), t), F.lit(pattern))


def to_timestamp(c: Column, dtype: T.DataType | None = None, formats: Sequence[str] | None = None) -> Column:
    """Instant, NULL when unparsable. ``formats``: shapes or patterns; the first that reads the text decides."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c.cast("timestamp")
    if isinstance(dtype, T.NumericType):
        return epoch_to_timestamp(c.cast("string"))
    if formats is None:
        return _iso_or_blank(c).try_cast("timestamp")
    shapes = [f for f in formats if f in SHAPES]
    readings = [_by_pattern(c, f) for f in formats if f not in SHAPES]
    if shapes:
        readings.insert(0, _iso_or_blank(c, shapes).try_cast("timestamp"))
    if not readings:
        raise ValueError("no formats")
    return F.coalesce(*readings) if len(readings) > 1 else readings[0]


def to_date(c: Column, dtype: T.DataType | None = None, formats: Sequence[str] | None = None) -> Column:
    """UTC calendar day, NULL when unparsable. ``formats`` as in :func:`to_timestamp`."""
    if isinstance(dtype, T.DateType):
        return c
    return to_timestamp(c, dtype, formats).cast("date")


def clean_date(c: Column, formats: Sequence[str] | None = None) -> Column:
    """C13d: null words and unparsable text give NULL."""
    return F.when(~is_nullish(c, K.CLEAN_NULLS), to_date(c, formats=formats))


def clean_timestamp(c: Column, formats: Sequence[str] | None = None) -> Column:
    """C13d, instant form."""
    return F.when(~is_nullish(c, K.CLEAN_NULLS), to_timestamp(c, formats=formats))


def normalize_date_format(c: Column, formats: Sequence[str] | None = None) -> Column:
    """MM/DD/YYYY, DD-MM-YYYY or ISO -> ISO date text."""
    return F.date_format(to_date(c, formats=formats), "yyyy-MM-dd")


def epoch_to_timestamp(c: Column) -> Column:
    """10 digits are seconds, 13 are milliseconds, 11-12 are milliseconds too."""
    t = js_trim(c)
    n = t.try_cast("bigint")
    return F.when(t.rlike(r"^\d{10}\z"), F.timestamp_seconds(n)).when(
        t.rlike(r"^\d{11,13}\z"), F.timestamp_millis(n))


def timestamp_or_epoch(c: Column) -> Column:
    """C7 with C15 first, for text columns that may hold epochs."""
    return F.coalesce(epoch_to_timestamp(c), to_timestamp(c))


def is_date_like(c: Column) -> Column:
    """Predicate form of C7."""
    return F.coalesce(to_timestamp(c).isNotNull(), F.lit(False))
