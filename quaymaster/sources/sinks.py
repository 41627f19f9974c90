"""Sinks (S6, S7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from quaymaster.operators.errors import has_errors


def write_upsert(merged: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """The merged table to a new place; a path that exists is refused.

    The merge reads the old table, so it must never write over it.
    """
    writer = merged.drop("_action").write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def merge_into(source: DataFrame, table: str, keys: Sequence[str]) -> None:
    """S6 for catalogs with row-level tables: ``MERGE`` on the keys, supplied columns only."""
    on = None
    for k in keys:
        test = F.col(f"{table}.{k}") == F.col(f"source.{k}")
        on = test if on is None else on & test
    payload = [c for c in source.columns if c not in keys]
    merge = source.alias("source").mergeInto(table, on)
    if payload:
        merge = merge.whenMatched().update({c: F.col(f"source.{c}") for c in payload})
    merge.whenNotMatched().insert({c: F.col(f"source.{c}") for c in source.columns}).merge()


def reject_rows(df: DataFrame) -> DataFrame:
    """Each failing row once, under its first error, all errors kept."""
    first = F.element_at("errors", 1)
    return df.filter(has_errors()).select("*", first["code"].alias("code"), first["message"].alias("message"))


def write_rejects(df: DataFrame, path: str) -> None:
    """Rejects by error code; no shuffle, each task writes the codes it holds."""
    reject_rows(df).write.mode("errorifexists").partitionBy("code").parquet(path)
