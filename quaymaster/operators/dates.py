"""Which dates a column holds: a vote of its values on the order of day and month."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F

from quaymaster import constants as K
from quaymaster.functions.temporal import MONTH_NAMES
from quaymaster.functions.text import is_nullish, js_trim
from quaymaster.model import Mapping
from quaymaster.operators.mapping import quoted

_SEP = r"[/.-]"
_REST = rf"{_SEP}(?:\d{{4}}|\d{{2}})(?:\D.*)?\z"
_LOW, _HIGH = r"(?:0?[1-9]|1[0-2])", r"(?:1[3-9]|2\d|3[01])"
# A value votes for the one order it can have; with both numbers up to twelve it has no vote.
_KINDS = (
    ("iso", r"^\d{4}-\d{1,2}(?:-\d{1,2}(?:\D.*)?)?\z"),
    ("year_slash", r"^\d{4}/\d{1,2}/\d{1,2}(?:\D.*)?\z"),
    ("month_first", rf"^{_LOW}{_SEP}{_HIGH}{_REST}"),
    ("day_first", rf"^{_HIGH}{_SEP}{_LOW}{_REST}"),
    ("either", rf"^{_LOW}{_SEP}{_LOW}{_REST}"),
    ("named", rf"(?i)^(?=.*\d)(?:.*[^a-z])?(?:{MONTH_NAMES})[a-z]*(?:[^a-z].*)?\z"),
)
KINDS = tuple(k for k, _ in _KINDS)


def date_kind(c: Column) -> Column:
    """The shape of a value: one of ``KINDS``, ``other``, or NULL for a null word."""
    text, kind = js_trim(c), None
    for name, pattern in _KINDS:
        kind = F.when(text.rlike(pattern), name) if kind is None else kind.when(text.rlike(pattern), name)
    return F.when(~is_nullish(c, K.CLEAN_NULLS), kind.otherwise("other"))


def infer_formats(df: DataFrame, columns: Sequence[str], unsure: str = "month_first") -> DataFrame:
    """One row a column: values of each shape, ``formats`` to read it with, ``ambiguous`` and ``mixed``.

    Where only one order has votes it is the order; where both have (``mixed``), the one with more goes first
    and the other reads what it cannot; where none has though the order matters (``ambiguous``), it is ``unsure``.
    One scan, one row of counts a task.
    """
    kinds = df.select(*[date_kind(quoted(c).cast("string")).alias(f"k{i}") for i, c in enumerate(columns)])
    counts = kinds.agg(*[F.struct(F.count(f"k{i}").alias("live"), *[F.count_if(F.col(f"k{i}") == k).alias(k) for k in (*KINDS, "other")]).alias(f"k{i}")
                         for i in range(len(columns))])
    rows = counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"k{i}")[k].alias(k) for k in ("live", *KINDS, "other")])
                                            for i, c in enumerate(columns)])))
    month, day, either = F.col("month_first"), F.col("day_first"), F.col("either")
    order = (F.when((month > 0) & (day > 0), F.when((month > day) | ((month == day) & F.lit(unsure == "month_first")), F.array(F.lit("month_first"), F.lit("day_first")))
                    .otherwise(F.array(F.lit("day_first"), F.lit("month_first"))))
             .when(month > 0, F.array(F.lit("month_first"))).when(day > 0, F.array(F.lit("day_first")))
             .when(either > 0, F.array(F.lit(unsure))).otherwise(F.array().cast("array<string>")))
    plain = F.array_compact(F.array(*[F.when(F.col(k) > 0, F.lit(k)) for k in ("year_slash", "named")]))
    return rows.select("*", F.concat(F.array(F.lit("iso")), order, plain).alias("formats"),
                       ((either > 0) & (month == 0) & (day == 0)).alias("ambiguous"), ((month > 0) & (day > 0)).alias("mixed")).select(
        "column", "live", *KINDS, "other", "formats", "ambiguous", "mixed")


def with_inferred_formats(df: DataFrame, mapping: Mapping, columns: Sequence[str], unsure: str = "month_first") -> tuple[Mapping, list[str]]:
    """(the mapping with the formats its date columns vote for, a warning for each column that leaves the order open).

    What reaches the driver is one row a column.
    """
    found = {r["column"]: r for r in infer_formats(df, columns, unsure).collect()}
    rules = tuple(replace(r, formats=tuple(found[r.source]["formats"])) if r.source in found else r for r in mapping.rules)
    warnings = [f"{c}: {r['either']} dates could be read either way round, taken as {unsure}" for c, r in found.items() if r["ambiguous"]]
    warnings += [f"{c}: {r['month_first']} dates have the month first and {r['day_first']} the day" for c, r in found.items() if r["mixed"]]
    return replace(mapping, rules=rules, warnings=(*mapping.warnings, *warnings)), warnings
