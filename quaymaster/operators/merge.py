"""Keyed upsert and batch accounting (M1, M3)."""

from __future__ import annotations

from collections.abc import Mapping as MappingABC, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quaymaster import constants as K
from quaymaster.operators.constraints import _all_set
from quaymaster.operators.errors import has_errors
from quaymaster.operators.mapping import ROW_IDX, quoted
from quaymaster.session import hold


def split_null_keys(source: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with a complete key, rows without): a key column may not be NULL."""
    return source.filter(_all_set(keys)), source.filter(~_all_set(keys))


def latest_per_key(source: DataFrame, keys: Sequence[str], row_idx: str = ROW_IDX) -> DataFrame:
    """One row per key, the last in row order. Partial results are one row per key and task."""
    payload = [c for c in source.columns if c not in keys and c != row_idx]
    if not payload:
        return source.select(*keys).distinct()
    last = F.max_by(F.struct(*[quoted(c) for c in payload]), F.col(row_idx))
    return source.groupBy(*keys).agg(last.alias("_last")).select(
        *keys, *[F.col("_last")[c].alias(c) for c in payload])


def _default(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def upsert_by_key(target: DataFrame, source: DataFrame, keys: Sequence[str],
                  defaults: MappingABC[str, object] | None = None, row_idx: str = ROW_IDX) -> DataFrame:
    """M1: the merged table, with ``_action`` keep / update / insert.

    Only supplied columns change. Keys alone mean insert if absent. A row with a NULL
    key matches nothing and raises; split such rows off before (``split_null_keys``).

    The delta is reduced to one row per key and held, so the planner knows its
    true size: a small one is broadcast and the target is not shuffled at all; a
    large one is sort-merged, where a hot target key can be split because the
    target is always the left side. Inserts are the delta minus the keys that the
    target was seen to hold.
    """
    defaults = dict(defaults or {})
    columns = target.columns
    types = {f.name: f.dataType for f in target.schema.fields}
    supplied = [c for c in source.columns if c != row_idx]
    unknown = [c for c in supplied if c not in columns]
    if unknown or not keys or any(k not in supplied for k in keys):
        raise ValueError(f"keys {list(keys)} must be supplied and columns {unknown} must exist on the target")
    payload = [c for c in supplied if c not in keys]
    # raise_error must stay uncast: an explicit cast of it is folded to NULL.
    stop = F.raise_error(F.concat(F.lit(f"no complete key ({', '.join(keys)}) in row "), F.col(row_idx).cast("string")))
    # In the projection, not in a filter: filters may be moved before what removed such rows.
    key = quoted(keys[0]).cast(types[keys[0]])
    typed = source.select(row_idx, F.when(~_all_set(keys), stop).otherwise(key).alias(keys[0]),
                          *[quoted(c).cast(types[c]).alias(c) for c in supplied if c != keys[0]])
    delta = hold(latest_per_key(typed, keys, row_idx))
    delta.count()

    hit = delta.select(*keys, *[quoted(c).alias(f"_new_{c}") for c in payload], F.lit(True).alias("_hit"))
    changed = target.join(hit, list(keys), "left").select(
        *[F.when(F.col("_hit"), F.col(f"`_new_{c}`")).otherwise(quoted(c)).alias(c) if c in payload else quoted(c)
          for c in columns],
        F.when(F.col("_hit") & F.lit(bool(payload)), "update").otherwise("keep").alias("_action"))
    known = target.select(*keys).join(delta.select(*keys), list(keys), "left_semi").distinct()
    fresh = delta.join(known, list(keys), "left_anti").select(
        *[quoted(c) if c in supplied else _default(defaults.get(c)).cast(types[c]).alias(c) for c in columns],
        F.lit("insert").alias("_action"))
    return changed.unionByName(fresh)


def batch_outcome(df: DataFrame, batch: int = K.BATCH_ROWS, row_idx: str = ROW_IDX) -> DataFrame:
    """M3: a batch with any bad row fails whole; the first bad row explains it."""
    number = F.floor(F.col(row_idx) / batch).cast("bigint")
    first = F.min_by(F.element_at("errors", 1)["message"], F.when(has_errors(), F.col(row_idx)))
    per_batch = df.groupBy((number + 1).alias("batch")).agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(has_errors(), 1)).alias("bad_rows"), first.alias("first"))
    failed = F.col("bad_rows") > 0
    return per_batch.select(
        "batch", "rows", "bad_rows", failed.alias("failed"),
        F.when(failed, 0).otherwise(F.col("rows")).alias("upserted"),
        F.when(failed, F.concat(F.lit("Batch "), F.col("batch").cast("string"), F.lit(": "), "first")).alias("message"))
