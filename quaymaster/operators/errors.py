"""The ``errors`` column shared by every row check.

``errors array<struct<column, code, message, input>>`` holds one entry per
violation of a row (M4: every entry carries message, code and the input) and
is NULL on a clean row. Splitting on ``errors IS NULL`` therefore reduces to
the bare conditions: the messages are not evaluated for a filter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

ERROR_TYPE = "array<struct<column:string,code:string,message:string,input:string>>"


@dataclass
class Violation:
    when: Column
    entry: Column

    def unless(self, other: Column) -> Violation:
        return Violation(~other & self.when, self.entry)


def error(when: Column, column: str, code: str, message: Column | str, given: Column) -> Violation:
    text = F.lit(message) if isinstance(message, str) else F.coalesce(message, F.lit("Unknown error"))
    return Violation(when, F.struct(
        F.lit(column).alias("column"), F.lit(code).alias("code"), text.alias("message"),
        given.cast("string").alias("input")))


def collect_errors(found: list[Violation]) -> Column:
    """Entries of the conditions that hold, in the order given; NULL when none does."""
    if not found:
        return no_errors()
    any_found = found[0].when
    for v in found[1:]:
        any_found = any_found | v.when
    entries = F.array_compact(F.array(*[F.when(v.when, v.entry) for v in found]))
    return F.when(any_found, entries)


def merge_errors(first: Column, second: Column) -> Column:
    empty = F.array().cast(ERROR_TYPE)
    return F.when(first.isNotNull() | second.isNotNull(),
                  F.concat(F.coalesce(first, empty), F.coalesce(second, empty)))


def no_errors() -> Column:
    return F.lit(None).cast(ERROR_TYPE)


def has_errors(c: str = "errors") -> Column:
    return F.col(c).isNotNull()


def error_count(c: str = "errors") -> Column:
    return F.coalesce(F.size(c), F.lit(0)).cast("bigint")
