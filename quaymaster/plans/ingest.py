"""End-to-end flows built from the operators.

``run_ingestion`` loads a file and repairs what the target refuses;
``review`` scores and tests a proposal without loading; ``load_reviewed`` loads it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from quaymaster import constants as K
from quaymaster.model import FixRule, Mapping, MappingHints, TargetSchema, Transform
from quaymaster.operators.constraints import check_constraints, dry_run, duplicate_keys, prove_repairs, unique_clashes
from quaymaster.operators.evaluate import evaluate_mapping
from quaymaster.operators.mapping import (
    ROW_IDX, apply_mapping, apply_transforms, dropped_columns, fit_target, quoted, retain_target, split_empty_rows,
)
from quaymaster.operators.merge import batch_outcome, upsert_by_key
from quaymaster.operators.profile import profile_simple
from quaymaster.operators.repair import repair
from quaymaster.operators.report import bucket_rows, ingestion_report, verdict
from quaymaster.operators.typed import stored
from quaymaster.operators.validate import split_valid, validate_output
from quaymaster.session import hold


@dataclass
class Ingestion:
    """``duplicates``: accepted keys met in several source rows, of which the last wins."""
    merged: DataFrame
    rows: DataFrame
    report: DataFrame
    warnings: tuple[str, ...]
    duplicates: DataFrame


def _source_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (ROW_IDX, "_keys", "_corrupt")]


def analyze(df: DataFrame, mapping: Mapping, target: TargetSchema,
            hints: MappingHints | None = None) -> tuple[DataFrame, Mapping]:
    """Simple profile and the resolved mapping."""
    columns = _source_columns(df)
    return profile_simple(df, columns), mapping.resolve(columns, target, hints)


def bucketed_rows(df: DataFrame, mapping: Mapping, target: TargetSchema, rules: Sequence[FixRule] = (),
                  max_retries: int = K.MAX_RETRIES, safe_mode: bool = True, keys: Sequence[str] = (),
                  existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(every input row in its bucket, the coercion warnings).

    With ``keys`` rows without a complete key and rows whose unique values belong to
    another key, here or in the ``existing`` table, are rejects too; of repaired rows that is tested again.

    The checked rows are held (memory, then disk): good rows, rejects and warnings
    are three readings of them, and coercion should run once per row.
    """
    full, empty = split_empty_rows(df, mapping)
    target = target.keyed_by(keys)
    checked = check_constraints(apply_mapping(full, mapping, target, typed=True), target)
    if keys:
        checked = unique_clashes(checked, target, keys, existing)
    checked = hold(checked)
    good, bad = split_valid(checked)
    # Good rows take the target's types, as the repaired ones do.
    typed = good.select(ROW_IDX, *[
        stored(quoted(c), target.column(c)).alias(c) for c in good.columns if c != ROW_IDX])
    warnings = bad.select(F.explode("errors").alias("e")).filter(F.col("e.code") == K.BAD_CAST).select("e.*")
    rows = bucket_rows(typed, repair(bad, rules, target, max_retries, safe_mode), empty)
    return prove_repairs(rows, target, keys, existing) if keys and rules else rows, warnings


def run_ingestion(df: DataFrame, mapping: Mapping, target: TargetSchema, target_df: DataFrame,
                  keys: Sequence[str], rules: Sequence[FixRule] = (), hints: MappingHints | None = None,
                  max_retries: int = K.MAX_RETRIES, safe_mode: bool = True) -> Ingestion:
    """Map, coerce, split, repair, upsert, report."""
    target.check_keys(keys)
    if df.isEmpty():
        raise ValueError("no rows in the source")
    columns = _source_columns(df)
    resolved = mapping.resolve(columns, target, hints)
    rows, coercion = bucketed_rows(df, resolved, target, rules, max_retries, safe_mode, keys, target_df)
    accepted = rows.filter(F.col("bucket").isin("loaded", "repaired"))
    supplied = retain_target(accepted, target).drop("errors")
    merged = upsert_by_key(target_df, supplied, keys, target.default_values())
    report = ingestion_report(rows, resolved.warnings, dropped_columns(df, resolved, target), coercion)
    return Ingestion(merged, rows, report, resolved.warnings, duplicate_keys(accepted, keys, ROW_IDX))


@dataclass
class Review:
    scores: DataFrame
    issues: DataFrame
    failures: DataFrame
    validation: DataFrame
    dry_run: DataFrame
    verdict: DataFrame


def review(df: DataFrame, mapping: Mapping, specs: Sequence[Transform], target: TargetSchema,
           scope: str = "all", sample: int | None = None, keys: Sequence[str] | None = None,
           existing: DataFrame | None = None) -> Review:
    """Score, validate and dry-run every row, decide. Always on current transforms.

    ``sample`` dry-runs a stratified sample of that many rows instead. ``keys`` (the primary
    key unless given) are those of the later upsert into the ``existing`` table.
    """
    scored = evaluate_mapping(df, mapping, target, scope=scope)
    checked = validate_output(df, specs, target)
    tested = dry_run(apply_transforms(df, specs), target, sample, keys=keys or target.primary_key, existing=existing)
    return Review(scored.scores, scored.issues, checked.failures, checked.summary, tested.summary,
                  verdict(scored.scores, scored.issue_texts, checked.summary, checked.rates, tested.summary))


def load_reviewed(df: DataFrame, specs: Sequence[Transform], target: TargetSchema, target_df: DataFrame,
                  keys: Sequence[str], enabled: Sequence[tuple[str, str]] | None = None,
                  batch: int = K.BATCH_ROWS) -> tuple[DataFrame, DataFrame]:
    """(merged table, outcome per batch) with all-or-nothing batches."""
    target.check_keys(keys)
    rows = check_constraints(fit_target(apply_transforms(df, specs, enabled, target), target), target.keyed_by(keys))
    rows = hold(unique_clashes(rows, target, keys, target_df))
    outcome = batch_outcome(rows, batch)
    # Held and counted so that the planner knows how many batches failed.
    failed = hold(outcome.filter("failed").select((F.col("batch") - 1).alias("_batch")))
    failed.count()
    number = F.floor(F.col(ROW_IDX) / batch).cast("bigint")
    loaded = rows.withColumn("_batch", number).join(failed, "_batch", "left_anti").drop("_batch", "errors")
    return upsert_by_key(target_df, loaded, keys, target.default_values()), outcome
