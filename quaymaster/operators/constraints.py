"""Set-level checks and the dry run."""

from __future__ import annotations

from collections.abc import Mapping as MappingABC, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from quaymaster import constants as K
from quaymaster.functions.text import js_trim
from quaymaster.model import TargetSchema
from quaymaster.operators.errors import ERROR_TYPE, Violation, collect_errors, error, has_errors, merge_errors
from quaymaster.operators.mapping import ROW_IDX, quoted
from quaymaster.operators.sampling import stratified_sample
from quaymaster.operators.validate import check_errors, output_errors


def _all_set(columns: Sequence[str]) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & quoted(c).isNotNull()
    return ok


def duplicate_keys(df: DataFrame, keys: Sequence[str], row_idx: str | None = None) -> DataFrame:
    """Complete keys met more than once, with their row count.

    Counts are combined per task first, so a key holding a third of the rows
    costs one row per task.
    """
    extra = [F.min(row_idx).alias("first_idx"), F.max(row_idx).alias("last_idx")] if row_idx else []
    return df.filter(_all_set(keys)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), *extra).filter("rows > 1")


def foreign_key_gaps(df: DataFrame, parent: DataFrame, on: MappingABC[str, str]) -> DataFrame:
    """Complete child keys without a parent, with the number of rows behind each.

    Both sides are reduced to distinct keys before they meet. The join is written as
    an outer join with a marker, because an anti join would be moved below the
    counting and shuffle every row of a hot key.
    """
    child = df.filter(_all_set(list(on))).groupBy(*on).agg(F.count(F.lit(1)).alias("rows"))
    parents = parent.select(*[quoted(p).alias(c) for c, p in on.items()]).distinct().withColumn("_parent", F.lit(True))
    return child.join(parents, list(on), "left").filter(F.col("_parent").isNull()).drop("_parent")


def canonicalize(df: DataFrame, column: str, dictionary: DataFrame, value_column: str,
                 words: MappingABC[str, str] | None = None) -> DataFrame:
    """Spell values as the dictionary does, ignoring case and outer spaces.

    Adds ``<column>_canonical`` and ``<column>_known``. ``words`` maps other
    spellings (code-sized metadata) to canonical ones. Spark picks the join from
    the dictionary's size; a hot value is split by the adaptive skew join.
    """
    spelled = dictionary.filter(quoted(value_column).isNotNull()).groupBy(
        F.lower(js_trim(quoted(value_column))).alias("_word")).agg(F.min(value_column).alias("_canonical"))
    joined = df.withColumn("_word", F.lower(js_trim(quoted(column)))).join(spelled, "_word", "left")
    found = F.col("_canonical")
    if words:
        pairs = [F.lit(x) for k, v in words.items() for x in (k.lower(), v)]
        found = F.coalesce(found, F.try_element_at(F.create_map(*pairs), F.col("_word")))
    return joined.select(*[quoted(c) for c in df.columns],
                         F.coalesce(found, js_trim(quoted(column))).alias(f"{column}_canonical"),
                         (found.isNotNull() | quoted(column).isNull()).alias(f"{column}_known"))


@dataclass(frozen=True)
class ForeignKey:
    on: MappingABC[str, str]
    parent: DataFrame


def row_errors(df: DataFrame, target: TargetSchema) -> list[Violation]:
    """Everything the target refuses in a single row, unmapped required columns included."""
    found: list[Violation] = []
    for c in target.columns:
        if c.name not in df.columns:
            if c.required:
                found.append(error(F.lit(True), c.name, K.NOT_NULL, "required column is not supplied", F.lit(None)))
            continue
        value = quoted(c.name)
        found += output_errors(c, value, df.schema[c.name].dataType, value, strict_int=True)
        found += check_errors(target, c.name, value, value)
    return found


def check_constraints(df: DataFrame, target: TargetSchema, unique: Sequence[Sequence[str]] = (),
                      foreign_keys: Sequence[ForeignKey] = ()) -> DataFrame:
    """V9 on any rows: ``errors`` extended by row, unique and foreign key violations.

    Of rows sharing a unique key the first in row order is good. Only keys that
    are really duplicated (or missing) are joined back.
    """
    own = collect_errors(row_errors(df, target))
    prior = F.col("errors") if "errors" in df.columns else F.lit(None)
    out = df.withColumn("errors", merge_errors(prior, own) if "errors" in df.columns else own)
    for key in unique:
        repeated = duplicate_keys(df, key, ROW_IDX).select(*key, F.col("first_idx").alias("_first"))
        hit = F.col("_first").isNotNull() & (F.col(ROW_IDX) > F.col("_first"))
        name = ", ".join(key)
        found = collect_errors([error(hit, key[0], K.DUPLICATE_KEY, f"duplicate key ({name})", quoted(key[0]))])
        out = out.join(repeated, list(key), "left").withColumn(
            "errors", merge_errors(F.col("errors"), found)).drop("_first")
    for fk in foreign_keys:
        gaps = foreign_key_gaps(df, fk.parent, fk.on).select(*fk.on, F.lit(True).alias("_gap"))
        first = next(iter(fk.on))
        found = collect_errors([error(F.col("_gap"), first, K.FK_MISSING, "no such parent key", quoted(first))])
        out = out.join(gaps, list(fk.on), "left").withColumn(
            "errors", merge_errors(F.col("errors"), found)).drop("_gap")
    extra = [] if "errors" in df.columns else ["errors"]
    return out.select(*[quoted(c) for c in df.columns], *extra)


def unique_clashes(df: DataFrame, target: TargetSchema, keys: Sequence[str], existing: DataFrame | None = None) -> DataFrame:
    """``errors`` extended by unique values that rows of another key hold, in these rows or in the ``existing`` table.

    Rows with the same key are one row after the upsert and do not clash. Of different
    keys sharing a value the one met first is good. Only values that are really shared
    are joined back; both sides are reduced to one row per value before.
    """
    out = df
    for group in target.other_unique(keys):
        if any(c not in df.columns for c in (*group, *keys)):
            continue
        mine = F.struct(*[quoted(k).alias(k) for k in keys])
        shared = (df.filter(_all_set(group)).groupBy(*group)
                  .agg(F.min_by(mine, ROW_IDX).alias("_first"), F.min(mine).alias("_lo"), F.max(mine).alias("_hi"))
                  .filter("_lo <> _hi").select(*group, "_first"))
        out = out.join(shared, list(group), "left")
        hit = F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(mine)
        if existing is not None:
            theirs = F.struct(*[quoted(k).cast(df.schema[k].dataType).alias(k) for k in keys])
            held = (existing.select(*[quoted(c).cast(df.schema[c].dataType).alias(c) for c in group], theirs.alias("_key"))
                    .filter(_all_set(group)).groupBy(*group).agg(F.min("_key").alias("_lo"), F.max("_key").alias("_hi")))
            out = out.join(held, list(group), "left")
            hit = hit | (F.col("_lo").isNotNull() & ~(F.col("_lo").eqNullSafe(mine) & F.col("_hi").eqNullSafe(mine)))
        name = ", ".join(group)
        found = collect_errors([error(hit, group[0], K.DUPLICATE_KEY, f"unique value ({name}) belongs to another key", quoted(group[0]))])
        out = out.withColumn("errors", merge_errors(F.col("errors"), found)).select(*[quoted(c) for c in df.columns])
    return out


_LATER = 1 << 48  # puts repaired rows behind all others where the first row met is the good one


def prove_repairs(rows: DataFrame, target: TargetSchema, keys: Sequence[str], existing: DataFrame | None = None) -> DataFrame:
    """Bucketed rows in which no accepted row holds a unique value of another key, repaired rows included.

    A repair changes values after the set-level checks. Only the values that repaired rows now hold are looked at again, in these rows and
    in the ``existing`` table; a row that was good before keeps a value against a repaired one, and of repaired rows the first does. What
    clashes is ``unresolved`` with a ``duplicate_key`` entry. One round is enough: whoever keeps a value holds it alone.
    """
    clashes = None
    accepted = rows.filter(F.col("bucket").isin("loaded", "repaired"))
    for group in target.other_unique(keys):
        if any(c not in rows.columns for c in (*group, *keys)):
            continue
        touched = accepted.filter("bucket = 'repaired'").select(*group).filter(_all_set(group)).distinct()
        met = accepted.join(touched, list(group), "left_semi").select(
            F.when(F.col("bucket") == "repaired", F.col(ROW_IDX) + _LATER).otherwise(F.col(ROW_IDX)).alias(ROW_IDX),
            *dict.fromkeys([*keys, *group]), F.lit(None).cast(ERROR_TYPE).alias("errors"))
        held = None if existing is None else existing.join(
            touched.select(*[quoted(c).cast(existing.schema[c].dataType).alias(c) for c in group]), list(group), "left_semi")
        found = unique_clashes(met, replace(target, primary_key=(), unique=(tuple(group),)), keys, held).filter(has_errors()).select(
            (F.col(ROW_IDX) % _LATER).alias(ROW_IDX), F.col("errors").alias("_clash"))
        clashes = found if clashes is None else clashes.union(found)
    if clashes is None:
        return rows
    per_row = clashes.groupBy(ROW_IDX).agg(F.flatten(F.collect_list("_clash")).alias("_clash"))
    hit = F.col("_clash").isNotNull()
    return rows.join(per_row, ROW_IDX, "left").withColumns({
        "errors": F.when(hit, merge_errors(F.col("errors"), F.col("_clash"))).otherwise(F.col("errors")),
        "bucket": F.when(hit, "unresolved").otherwise(F.col("bucket"))}).select(*[quoted(c) for c in rows.columns])


@dataclass
class DryRun:
    rows: DataFrame
    summary: DataFrame


def dry_run(df: DataFrame, target: TargetSchema, sample: int | None = None,
            total: int | None = None, keys: Sequence[str] | None = None, existing: DataFrame | None = None, **checks) -> DryRun:
    """V9: would these rows be accepted? Nothing is written. All rows are tested, or a stratified ``sample`` of that many.

    With ``keys`` an upsert by them is meant: they may not be NULL, and the other unique
    groups are tested within the rows and against the ``existing`` table.
    """
    tested = df if sample is None else stratified_sample(df, sample, total)
    rows = check_constraints(tested, target.keyed_by(keys or ()), **checks)
    if keys:
        rows = unique_clashes(rows, target, keys, existing)
    summary = rows.agg(F.count(F.lit(1)).alias("rows_tested"),
                       F.count(F.when(~has_errors(), 1)).alias("rows_passed"))
    return DryRun(rows, summary.withColumn("success", F.col("rows_tested") == F.col("rows_passed")))
