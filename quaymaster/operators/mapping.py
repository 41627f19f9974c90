"""Projection operators: mapping with coercion and transforms."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import nullcontext
from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F, types as T

from quaymaster import constants as K
from quaymaster.functions.numbers import strip_currency
from quaymaster.functions.text import is_nullish, js_trim, value_kind
from quaymaster.functions.tolerant import lenient_rules, tolerant_sql
from quaymaster.model import CALLERS, Mapping, TargetColumn, TargetSchema, Transform, coerce_text
from quaymaster.operators.errors import collect_errors, error, merge_errors
from quaymaster.operators.typed import is_exact, typed_value

ROW_IDX = "row_idx"


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _scalar_from_variant(c: Column) -> Column:
    return F.try_variant_get(c, "$", "string")


def apply_mapping(df: DataFrame, mapping: Mapping, target: TargetSchema,
                  enabled: Sequence[tuple[str, str]] | None = None,
                  exclude: Sequence[str] = (), typed: bool = False) -> DataFrame:
    """``row_idx``, the mapped target columns and ``errors``.

    A value that does not coerce becomes NULL and leaves a ``bad_cast`` entry
    holding the raw input. ``enabled`` keeps only the listed (source, target)
    pairs (P5); ``exclude`` drops target columns that must never be loaded (P6).

    ``typed`` makes the values those that the target column stores (:mod:`typed`): decimals exact, arrays and
    vectors read. What a ``coerce_to`` of another kind gives is then read once more as the column's type.
    """
    rules = [r for r in mapping.rules if target.column(r.target) is not None
             and r.target not in exclude and r.source in df.columns
             and (enabled is None or (r.source, r.target) in enabled)]
    types = {f.name: f.dataType for f in df.schema.fields}

    staged = [F.col(ROW_IDX)]
    for i, r in enumerate(rules):
        raw, dtype = quoted(r.source), types[r.source]
        coercion = r.coerce_to or target.column(r.target).coercion
        if isinstance(dtype, T.VariantType) and coercion != "json":
            # Nested JSON has no scalar form, so it fails every cast but string.
            kind = value_kind(raw, dtype)
            text = F.when(kind.isin("array", "object"), F.to_json(raw)).otherwise(
                _scalar_from_variant(raw))
            raw, dtype = text, T.StringType()
        elif isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)) and coercion != "json":
            raw, dtype = F.to_json(raw), T.StringType()
        column = target.column(r.target)
        if not typed:
            value = coerce_text(raw, coercion, dtype, r.formats)
        elif coercion == column.coercion:
            value = typed_value(raw, column, dtype, formats=r.formats)
        else:
            value = typed_value(coerce_text(raw, coercion, dtype, r.formats).cast("string"), column, whole=True)
        staged += [raw.alias(f"r{i}"), value.alias(f"v{i}")]
    work = df.select(*staged)

    found, out = [], []
    for i, r in enumerate(rules):
        raw = F.col(f"r{i}")
        text = raw.cast("string") if not isinstance(
            work.schema[f"r{i}"].dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType)
        ) else F.to_json(raw)
        coercion = r.coerce_to or target.column(r.target).coercion
        kind = target.column(r.target).type_name if typed else coercion
        failed = F.col(f"v{i}").isNull() & (text != "")
        message = F.concat(F.lit("Row "), (F.col(ROW_IDX) + 1).cast("string"),
                           F.lit(f", column {r.target}: Cannot cast "), text, F.lit(f" to {kind}"))
        found.append(error(failed, r.target, K.BAD_CAST, message, text))
        out.append(F.col(f"v{i}").alias(r.target))
    return work.select(ROW_IDX, *out, collect_errors(found).alias("errors"))


def dropped_columns(df: DataFrame, mapping: Mapping, target: TargetSchema) -> list[str]:
    """Source columns that feed no target column."""
    used = {r.source for r in mapping.rules if target.column(r.target) is not None}
    return [c for c in df.columns if c not in used and c not in (ROW_IDX, "_keys")]


def dropped_keys(df: DataFrame, mapping: Mapping) -> DataFrame:
    """P3 for JSON rows: keys met in any row that no rule selects."""
    used = [r.source for r in mapping.rules]
    keys = df.select(F.explode("_keys").alias("column")).distinct()
    return keys.filter(~F.col("column").isin(*used)) if used else keys


def split_empty_rows(df: DataFrame, mapping: Mapping) -> tuple[DataFrame, DataFrame]:
    """(rows holding at least one mapped key, rows holding none).

    Without a ``_keys`` column every row carries every header.
    """
    if "_keys" not in df.columns:
        return df, df.filter(F.lit(False))
    mapped = F.array(*[F.lit(r.source) for r in mapping.rules]).cast("array<string>")
    present = F.coalesce(F.arrays_overlap("_keys", mapped), F.lit(False))
    return df.filter(present), df.filter(~present)


def retain_target(df: DataFrame, target: TargetSchema) -> DataFrame:
    """Keep target columns only, in target order (row index and errors pass)."""
    extra = [c for c in (ROW_IDX, "errors") if c in df.columns]
    return df.select(*extra, *[quoted(c) for c in target.names if c in df.columns])


def last_spec_wins(specs: Sequence[Transform]) -> list[Transform]:
    return list({s.target: s for s in specs}.values())


def stage_transforms(df: DataFrame, specs: Sequence[Transform], null_first: bool) -> DataFrame:
    """``row_idx`` and, per spec i: trimmed input ``t{i}``, output ``o{i}``, thrown ``x{i}``.

    With ``null_first`` a null word never reaches the transform.
    """
    work = df.select(ROW_IDX, *[
        F.coalesce(js_trim(quoted(s.source).cast("string")), F.lit("")).alias(f"t{i}")
        for i, s in enumerate(specs)])
    for i, s in enumerate(specs):
        given = F.col(f"t{i}")
        if s.text is not None:
            work = work.withColumn("value", given)
            value, failed = F.expr(tolerant_sql(df.sparkSession, s.text)), F.lit(False)
        else:
            value, failed = s.build(given)
        if null_first:
            live = ~is_nullish(given, K.TRANSFORM_NULLS)
            value, failed = F.when(live, value), live & failed
        # What a caller wrote is resolved under rules that give NULL where it would fail.
        with lenient_rules(df.sparkSession) if s.text is not None or s.label == CALLERS else nullcontext():
            work = work.withColumn(f"o{i}", value)
        if s.null_fails:
            missing = F.col(f"o{i}").isNull() & (given != "")
            failed = failed | ((live & missing) if null_first else missing)
        work = work.withColumn(f"x{i}", F.coalesce(failed, F.lit(False)))
        if s.text is not None:
            work = work.drop("value")
    return work


def exact_transform(spec: Transform, target: TargetSchema) -> Transform:
    """The spec itself, or for a named transformation into a decimal, array or vector column its exact form."""
    column = target.column(spec.target)
    if column is None or spec.label not in ("to_number", "to_array") or not is_exact(column):
        return spec

    def build(v: Column) -> tuple[Column, Column]:
        text = F.when(~is_nullish(v, K.CLEAN_NULLS), strip_currency(v) if spec.label == "to_number" else v)
        return typed_value(text, column), F.lit(False)
    return replace(spec, build=build)


def fit_target(rows: DataFrame, target: TargetSchema) -> DataFrame:
    """Columns whose type the target does not store, read as texts into the type it does.

    What does not read becomes NULL with a ``bad_cast`` entry, so that no later cast can fail. Numbers keep their
    type when the target's is a number too: their range is a check of its own.
    """
    found, out, values = [], [], []
    for name in rows.columns:
        column, dtype = target.column(name), rows.schema[name].dataType
        if name in (ROW_IDX, "errors") or column is None or _storable(dtype, column):
            out.append(quoted(name))
            continue
        given = F.to_json(quoted(name)) if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)) else quoted(name).cast("string")
        values.append(typed_value(given, column, whole=True).alias(f"_fit_{name}"))
        value = quoted(f"_fit_{name}")
        failed = value.isNull() & (given != "")
        found.append(error(failed, name, K.BAD_CAST, F.concat(F.lit("Cannot cast "), given, F.lit(f" to {column.type_name}")), given))
        out.append(value.alias(name))
    if not found:
        return rows
    staged = rows.select("*", *values)
    if "errors" not in rows.columns:
        return staged.select(*out, collect_errors(found).alias("errors"))
    out[rows.columns.index("errors")] = merge_errors(F.col("errors"), collect_errors(found)).alias("errors")
    return staged.select(*out)


def _storable(dtype: T.DataType, column: TargetColumn) -> bool:
    """A cast from ``dtype`` to the column's type cannot fail on a value that passed the checks."""
    to = column.spark_type
    if isinstance(to, T.NumericType):
        return isinstance(dtype, T.NumericType)
    if isinstance(to, T.StringType):
        return isinstance(dtype, T.AtomicType)
    if isinstance(to, T.TimestampType):
        return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))
    return dtype == to


def apply_transforms(df: DataFrame, specs: Sequence[Transform],
                     enabled: Sequence[tuple[str, str]] | None = None, target: TargetSchema | None = None) -> DataFrame:
    """``row_idx``, one column per target, ``errors`` for transforms that failed.

    The last spec of a target wins. A failed transform leaves NULL and a
    ``bad_cast`` entry with the trimmed input. With a ``target`` named transformations into its decimal, array
    and vector columns read the text exactly.
    """
    chosen = [s for s in last_spec_wins(specs) if enabled is None or (s.source, s.target) in enabled]
    if target is not None:
        chosen = [exact_transform(s, target) for s in chosen]
    work = stage_transforms(df, chosen, null_first=True)
    found = [error(F.col(f"x{i}"), s.target, K.BAD_CAST, f"transform {s.label} failed", F.col(f"t{i}"))
             for i, s in enumerate(chosen)]
    return work.select(ROW_IDX, *[F.col(f"o{i}").alias(s.target) for i, s in enumerate(chosen)],
                       collect_errors(found).alias("errors"))
