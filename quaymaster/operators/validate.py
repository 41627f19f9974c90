"""Row validation and the good / reject split."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F, types as T

from quaymaster import constants as K
from quaymaster.model import TargetColumn, TargetSchema, Transform
from quaymaster.operators.errors import Violation, collect_errors, error, has_errors
from quaymaster.operators.mapping import ROW_IDX, stage_transforms
from quaymaster.operators.topk import first_k_per_group
from quaymaster.session import hold

INTEGER_LIMITS = {16: 2**15, 32: 2**31, 64: 2**63}


def output_errors(c: TargetColumn, value: Column, dtype: T.DataType, given: Column,
                  strict_int: bool = False) -> list[Violation]:
    """Violations of one output value; a wrong Spark type fails every live value."""
    kind = c.coercion
    live = value.isNotNull()
    numeric = isinstance(dtype, T.NumericType)
    found = []
    if c.required:
        found.append(error(value.isNull(), c.name, K.NOT_NULL,
                           "no value, and the column needs one", given))
    if c.is_array or c.is_vector:
        if not isinstance(dtype, T.ArrayType):
            found.append(error(live, c.name, K.BAD_CAST, f"{dtype.simpleString()} where {c.type_name} belongs", given))
        elif c.dimensions:
            found.append(error(F.size(value) != c.dimensions, c.name, K.OUT_OF_RANGE,
                               F.concat(F.size(value).cast("string"), F.lit(f" of {c.dimensions} dimensions")), given))
    elif (kind in ("integer", "number") and not numeric) or (
            kind == "boolean" and not isinstance(dtype, T.BooleanType)):
        found.append(error(live, c.name, K.BAD_CAST, f"{dtype.simpleString()} where {kind} belongs", given))
    elif kind == "integer" and strict_int and numeric:
        limit = INTEGER_LIMITS[c.integer_bits or 64]
        if isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)):
            found.append(error(value != F.floor(value), c.name, K.BAD_CAST, "not a whole number", given))
        if limit < 2**63:
            found.append(error((value >= limit) | (value < -limit), c.name, K.OUT_OF_RANGE,
                               f"outside {c.integer_bits}-bit range", given))
    elif kind == "number" and strict_int and c.precision is not None:
        top = 10.0 ** (c.precision - (c.scale or 0))
        rounded = F.round(F.abs(value.cast("double")), c.scale or 0)
        if isinstance(dtype, T.DecimalType):  # exact: a double could round the largest value up to the bound
            top, rounded = Decimal(10) ** (c.precision - (c.scale or 0)), F.round(F.abs(value), c.scale or 0)
        found.append(error(rounded >= top, c.name, K.OUT_OF_RANGE, f"exceeds {c.type_name}", given))
    if c.max_length and isinstance(dtype, T.StringType):
        found.append(error(F.length(value) > c.max_length, c.name, K.TOO_LONG,
                           f"String length exceeds max {c.max_length}", given))
    return found


def check_errors(target: TargetSchema, column: str, value: Column, given: Column) -> list[Violation]:
    return [error(~chk.test(value), column, chk.code, chk.message, given)
            for chk in target.checks if chk.column == column]


def validated_rows(df: DataFrame, specs: Sequence[Transform], target: TargetSchema,
                   strict_int: bool = False, with_checks: bool = False) -> DataFrame:
    """The row part of V8: the outputs and the ``errors`` that every spec causes.

    The transform sees the trimmed text itself, null words included. Of specs on one target
    each is validated; the output is that of the last, which is the one that would be loaded.
    """
    last = {s.target: i for i, s in enumerate(specs)}
    work = stage_transforms(df, specs, null_first=False)
    found = []
    for i, s in enumerate(specs):
        given, value, thrown = F.col(f"t{i}"), F.col(f"o{i}"), F.col(f"x{i}")
        found.append(error(thrown, s.target, K.BAD_CAST, f"transform {s.label} failed", given))
        column = target.column(s.target)
        if column is None:
            continue
        rules = output_errors(column, value, work.schema[f"o{i}"].dataType, given, strict_int)
        if with_checks:
            rules += check_errors(target, s.target, value, given)
        found += [v.unless(thrown) for v in rules]
    return work.select(ROW_IDX, *[F.col(f"o{i}").alias(target_name) for target_name, i in last.items()],
                       collect_errors(found).alias("errors"))


def _errors_of(column: str) -> Column:
    mine = F.filter("errors", lambda e: e["column"] == column)
    return F.sum(F.coalesce(F.size(mine), F.lit(0)))


def error_counts(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: total, passed and the errors of each column, in one scan with one row of partial results per task."""
    return rows.agg(F.count(F.lit(1)).alias("total_rows"), F.count(F.when(~has_errors(), 1)).alias("passed_rows"), *[
        _errors_of(c).alias(f"n{i}") for i, c in enumerate(columns)])


def failure_rates(counts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per failing column: failures, total rows and rate."""
    per_column = counts.select("total_rows", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("failures"))
        for i, c in enumerate(columns)]))).filter("failures > 0")
    return per_column.select("column", "failures", "total_rows", (F.col("failures") / F.col("total_rows")).alias("rate"))


def failures_by_column(rows: DataFrame, columns: Sequence[str],
                       examples: int = K.FAILURE_EXAMPLES, counts: DataFrame | None = None) -> DataFrame:
    """V8: one row per failing column: failures, rate, first examples in row order.

    ``counts`` are the :func:`error_counts` if known; only rows that failed take part in the example ranking.
    """
    per_column = failure_rates(counts or error_counts(rows, columns), columns)
    entries = (rows.filter(has_errors())
               .select(ROW_IDX, F.posexplode("errors").alias("seq", "e"))
               .select(ROW_IDX, "seq", F.col("e.column").alias("column"), "e.code", "e.message", "e.input"))
    first = first_k_per_group(entries, ["column"], examples, [ROW_IDX, "seq"])
    lists = first.groupBy("column").agg(F.array_sort(F.collect_list(
        F.struct("rn", ROW_IDX, "code", "message", "input"))).alias("examples"))
    return per_column.join(lists, "column").select("column", "failures", "total_rows", "rate", "examples")


def validation_summary(rows: DataFrame, columns: Sequence[str],
                       limit: float = K.FAILURE_RATE_LIMIT, counts: DataFrame | None = None) -> DataFrame:
    """V8: one row: total, passed, pass rate (NULL without rows) and success."""
    worst = F.greatest(*[F.col(f"n{i}") for i in range(len(columns))], F.lit(0), F.lit(0))
    rate = F.try_divide(worst, F.col("total_rows"))
    return (counts or error_counts(rows, columns)).select("total_rows", "passed_rows",
                      F.try_divide("passed_rows", "total_rows").alias("pass_rate"),
                      F.coalesce(rate <= limit, F.lit(True)).alias("success"))


@dataclass
class Validation:
    """Lazy results of V8; persist ``rows`` first when ``failures`` and another part are read. ``rates`` are the failures without examples."""
    rows: DataFrame
    failures: DataFrame
    summary: DataFrame
    rates: DataFrame


def validate_output(df: DataFrame, specs: Sequence[Transform], target: TargetSchema,
                    strict_int: bool = False, with_checks: bool = False) -> Validation:
    """V8: every row through every transform, checked against the target."""
    rows = validated_rows(df, specs, target, strict_int, with_checks)
    columns = list({s.target: None for s in specs})
    # One row, read by all three.
    counts = hold(error_counts(rows, columns))
    return Validation(rows, failures_by_column(rows, columns, counts=counts), validation_summary(rows, columns, counts=counts), failure_rates(counts, columns))


def failure_summary(failures: DataFrame, min_rate: float = K.SUMMARY_MIN_RATE,
                    examples: int = K.SUMMARY_EXAMPLES) -> DataFrame:
    """Columns failing above ``min_rate`` with their first examples."""
    return failures.filter(F.col("rate") > min_rate).withColumn(
        "examples", F.slice("examples", 1, examples))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M2: (rows without errors, rows with errors); both are plain filters."""
    return df.filter(~has_errors()).drop("errors"), df.filter(has_errors())
