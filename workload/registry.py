"""Query registry: name -> (Spark callable, SQL or None)."""

from __future__ import annotations

import re
from collections.abc import Callable

from workload import expected as K

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f
    return add


# Fragments of the SQL side.
_SPACES = "'" + K.SPACE_CHARS + "'"


def t(x: str) -> str:
    """Trim of the same space characters."""
    return f"trim({x}, {_SPACES})"


def words(items) -> str:
    return "(" + ", ".join("'" + w + "'" for w in items) + ")"


def nullish(x: str, items=K.PROFILE_NULLS) -> str:
    return f"coalesce(lower({t(x)}) IN {words(items)}, true)"


def match(x: str, pattern: str) -> str:
    pattern = re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", pattern)  # RE2 spelling of a code point
    return f"regexp_matches({x}, '{pattern}')"


def prefix(x: str, pattern: str, kind: str) -> str:
    return f"try_cast(nullif(regexp_extract({x}, '{pattern}'), '') AS {kind})"


def strip_currency(x: str) -> str:
    spaces = "".join(K.SPACE_CHARS)
    no_code = f"regexp_replace({x}, '(?i)^(?:{K.CURRENCY_CODES})\\s+', '')"
    return f"translate({no_code}, '{K.CURRENCY_SYMBOLS},{spaces}', '')"


def extract_number(x: str) -> str:
    s = strip_currency(x)
    return f"(CASE WHEN {match(s, K.NUMBER_WHOLE)} THEN try_cast({s} AS double) END)"


def iso(x: str) -> str:
    """ISO form of the four date shapes (dates without a time)."""
    v = t(x)
    return (f"(CASE WHEN {match(v, '^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([T ].*)?$')} THEN {v} "
            f"WHEN {match(v, '^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$')} "
            f"THEN regexp_replace({v}, '^([0-9]+)/([0-9]+)/([0-9]+)$', '\\3-\\1-\\2') "
            f"WHEN {match(v, '^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$')} "
            f"THEN regexp_replace({v}, '^([0-9]+)-([0-9]+)-([0-9]+)$', '\\3-\\2-\\1') "
            f"WHEN {match(v, '^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$')} THEN replace({v}, '/', '-') END)")


def ts(x: str) -> str:
    return f"try_cast({iso(x)} AS timestamp)"


def day(x: str) -> str:
    return f"strftime({ts(x)}, '%Y-%m-%d')"
