"""Number and boolean parsing (C3-C5, C11, C13a-c, C19)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from quaymaster import constants as K
from quaymaster.functions.text import is_nullish, js_trim

_CODE_PREFIX = rf"(?i)^(?:{K.CURRENCY_CODES}){K.SPACE_CLASS}+"
_INF = float("inf")


def _finite(c: Column) -> Column:
    return F.when((F.abs(c) < F.lit(_INF)) & ~F.isnan(c), c)


def matching(text: Column, pattern: str, sql_type: str) -> Column:
    """The part of the text that an anchored pattern matches, cast; NULL without a match."""
    # The pattern is anchored, so there is one match or none. No match must reach the
    # cast as NULL: a text that is no number costs the cast an exception.
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lit(0)).try_cast(sql_type)


def to_integer(c: Column, dtype: T.DataType | None = None) -> Column:
    """Decimal prefix of the text; numbers truncate toward zero; booleans 1/0."""
    if isinstance(dtype, T.NumericType):
        return _finite(c.cast("double")).try_cast("bigint") if isinstance(
            dtype, (T.DoubleType, T.FloatType)) else c.try_cast("bigint")
    if isinstance(dtype, T.BooleanType):
        return c.cast("bigint")
    return matching(js_trim(c), K.INTEGER_PREFIX, "bigint")


def to_number(c: Column, dtype: T.DataType | None = None) -> Column:
    """C4: decimal or exponent prefix of the text, finite values only."""
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return _finite(c.cast("double"))
    return matching(js_trim(c), K.NUMBER_PREFIX, "double")


def to_boolean(c: Column, dtype: T.DataType | None = None) -> Column:
    """Strict words only; anything else is NULL (a failed cast)."""
    if isinstance(dtype, T.BooleanType):
        return c
    if isinstance(dtype, T.NumericType):
        return F.when(c == 1, True).when(c == 0, False)
    w = F.lower(js_trim(c))
    return F.when(w.isin(*K.TRUE_WORDS), True).when(w.isin(*K.FALSE_WORDS), False)


def strip_currency(c: Column, extra_prefixes: tuple[str, ...] = ()) -> Column:
    """Drop one leading ISO code, then all symbols, commas and blanks."""
    body = F.regexp_replace(c, _CODE_PREFIX, "")
    if extra_prefixes:
        words = "|".join(p.replace(".", r"\.") for p in sorted(extra_prefixes, key=len, reverse=True))
        body = F.regexp_replace(body, rf"(?i)^{K.SPACE_CLASS}*(?:{words})", "")
    return F.translate(body, K.CURRENCY_SYMBOLS + "," + K.SPACE_CHARS, "")


def extract_number(c: Column, extra_prefixes: tuple[str, ...] = ()) -> Column:
    """C11: currency-aware strict number; a bare symbol, hex or Infinity is NULL."""
    return matching(strip_currency(c, extra_prefixes), K.NUMBER_WHOLE, "double")


def clean_integer(c: Column) -> Column:
    """Null words and unparsable text give NULL; currency stripped, prefix parse."""
    return F.when(~is_nullish(c, K.CLEAN_NULLS),
                  matching(strip_currency(js_trim(c)), K.INTEGER_PREFIX, "bigint"))


def clean_number(c: Column) -> Column:
    """As ``clean_integer`` with a decimal or exponent prefix."""
    return F.when(~is_nullish(c, K.CLEAN_NULLS),
                  matching(strip_currency(js_trim(c)), K.NUMBER_PREFIX, "double"))


def clean_boolean(c: Column) -> Column:
    """Null words NULL, true words true, any other text false."""
    w = F.lower(js_trim(c))
    return F.when(~is_nullish(c, K.CLEAN_BOOLEAN_NULLS), w.isin(*K.CLEAN_TRUE_WORDS))


def check_range(c: Column, lo=None, hi=None, lo_open: bool = False) -> Column:
    """True when NULL or inside the bounds."""
    ok = F.lit(True)
    if lo is not None:
        ok = ok & ((c > lo) if lo_open else (c >= lo))
    if hi is not None:
        ok = ok & (c <= hi)
    return F.coalesce(ok, F.lit(True))


def round_half_up(c: Column, digits: int) -> Column:
    """Round .5 toward plus infinity at a fixed number of decimals."""
    scale = float(10 ** digits)
    return F.floor(c * scale + 0.5) / scale
