"""Run summary, verdict and pre-flight report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from quaymaster import constants as K
from quaymaster.model import Mapping, TargetSchema
from quaymaster.operators.mapping import ROW_IDX
from quaymaster.session import small_frame

BUCKETS = ("loaded", "repaired", "skipped", "manual", "unresolved", "empty")


def bucket_rows(good: DataFrame, repaired: DataFrame | None = None, empty: DataFrame | None = None) -> DataFrame:
    """Every input row in exactly one bucket."""
    out = good.withColumn("bucket", F.lit("loaded"))
    if repaired is not None:
        out = out.unionByName(repaired, allowMissingColumns=True)
    if empty is not None:
        out = out.unionByName(empty.select(ROW_IDX, F.lit("empty").alias("bucket")), allowMissingColumns=True)
    return out


def ingestion_report(bucketed: DataFrame, warnings: Sequence[str] = (), dropped: Sequence[str] = (),
                     coercion_warnings: DataFrame | None = None) -> DataFrame:
    """G1: one row of counts. Row indexes are unique, so rows are counted, not collected."""
    n = {b: F.count(F.when(F.col("bucket") == b, 1)) for b in BUCKETS}
    fixes = F.sum(F.coalesce(F.size("fixes"), F.lit(0))) if "fixes" in bucketed.columns else F.lit(0)
    counts = bucketed.agg(
        F.count(F.lit(1)).alias("rows_total"), (F.count(F.lit(1)) - n["empty"]).alias("rows_prepared"),
        (n["loaded"] + n["repaired"]).alias("rows_upserted"),
        (n["empty"] + n["manual"] + n["skipped"] + n["unresolved"]).alias("rows_skipped"),
        F.coalesce(fixes, F.lit(0)).cast("bigint").alias("applied_fixes"),
        n["manual"].alias("manual_rows"), n["unresolved"].alias("unresolved_errors"))
    if coercion_warnings is not None:
        extra = coercion_warnings.agg(F.count(F.lit(1)).alias("coercion_warnings"))
        counts = _side_by_side([counts, extra])
    else:
        counts = counts.withColumn("coercion_warnings", F.lit(0).cast("bigint"))
    return counts.select(
        "rows_total", "rows_prepared", "rows_upserted", "rows_skipped", "applied_fixes",
        (F.lit(len(warnings)) + F.col("coercion_warnings") + F.col("manual_rows")).alias("manual_actions"),
        "unresolved_errors",
        F.array(*[F.lit(c) for c in dropped]).cast("array<string>").alias("dropped_columns"))


def _side_by_side(frames: Sequence[DataFrame]) -> DataFrame:
    """One-row frames as one row: union by name, then one aggregate."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


def _first_texts(df: DataFrame, text, order: Sequence, name: str, n: int = K.VERDICT_ISSUES_SHOWN) -> DataFrame:
    top = df.select(text.alias("x"), *[c.alias(f"o{i}") for i, c in enumerate(order)]).orderBy(
        *[f"o{i}" for i in range(len(order))]).limit(n)
    cols = [f"o{i}" for i in range(len(order))]
    return top.agg(F.transform(F.array_sort(F.collect_list(F.struct(*cols, "x"))), lambda s: s["x"]).alias(name))


def verdict(score: DataFrame, issues: DataFrame, validation: DataFrame | None = None,
            failures: DataFrame | None = None, dry_run: DataFrame | None = None) -> DataFrame:
    """Safe, review or blocked, with the problems found.

    ``score`` and ``issues`` come from ``evaluate_mapping``; ``validation`` and
    ``failures`` from ``validate_output``; ``dry_run`` is its summary. A part that
    was not run counts as fine and is reported as ``not_run``.
    """
    critical = issues.filter("severity = 'critical'")
    parts = [
        score.select("score"),
        critical.agg(F.count(F.lit(1)).alias("criticals")),
        _first_texts(critical, F.concat("column", F.lit(": "), "issue"),
                     [F.col("section"), F.col("ord")], "critical_texts"),
    ]
    if validation is not None:
        parts.append(validation.select("success"))
    if failures is not None:
        bad = failures.filter(F.col("rate") > K.FAILURE_RATE_LIMIT)
        parts.append(_first_texts(
            bad, F.format_string('%s: %.0f%% of its rows fail', F.col("column"), F.col("rate") * 100),
            [F.col("column")], "failure_texts"))
    if dry_run is not None:
        parts.append(dry_run.select("rows_tested", "rows_passed"))
    one = _side_by_side(parts)
    for name, kind in (("success", "boolean"), ("failure_texts", "array<string>"), ("rows_tested", "bigint"),
                       ("rows_passed", "bigint")):
        if name not in one.columns:
            one = one.withColumn(name, F.lit(None).cast(kind))
    low = F.col("score") < K.VERDICT_LOW_SCORE
    failed_rows = F.col("rows_tested") - F.col("rows_passed")
    none = F.array().cast("array<string>")
    transform_ok = F.coalesce("success", F.lit(True))
    problems = F.flatten(F.array(
        F.when(low, F.array(F.lit("the mapping scores too low"))).otherwise(none),
        F.coalesce("critical_texts", none),
        F.when(transform_ok, none).otherwise(F.coalesce("failure_texts", none)),
        F.when(failed_rows > 0, F.array(F.format_string(
            "%d of %d tested rows would be refused", failed_rows, F.col("rows_tested")))).otherwise(none)))
    one = one.withColumn("problems", problems)
    dry_ok = F.coalesce(failed_rows == 0, F.lit(True))
    status = (
        F.when((F.size("problems") == 0) & (F.col("score") >= K.VERDICT_SAFE_SCORE) & dry_ok & transform_ok, "safe")
        .when((F.col("criticals") > 0) | low | F.coalesce(
            F.col("rows_passed") < F.col("rows_tested") * K.VERDICT_DRY_RUN_SHARE, F.lit(False)), "blocked")
        .otherwise("review"))
    return one.select(
        status.alias("status"), F.col("score").alias("confidence"), "problems",
        F.when(F.col("success").isNull(), "not_run").otherwise(F.when(transform_ok, "ok").otherwise("failed"))
        .alias("validation"),
        F.when(F.col("rows_tested").isNull(), "not_run").otherwise(F.when(dry_ok, "ok").otherwise("failed"))
        .alias("dry_run"))


def preflight_status(found: DataFrame) -> DataFrame:
    """Verdict status as ready / needs_review / blocked."""
    return found.withColumn("preflight", F.when(F.col("status") == "safe", "ready").when(
        F.col("status") == "review", "needs_review").otherwise("blocked"))


def preflight(spark: SparkSession, mapping: Mapping, target: TargetSchema,
              source_columns: Sequence[str]) -> DataFrame:
    """``bucket, source, target, note`` for mapped, unmapped and missing columns.

    Confidence of .85 and more is a success, from .5 a warning, below that neither.
    """
    rows = []
    for r in mapping.rules:
        if r.confidence >= K.CONFIDENT:
            rows.append(("success", r.source, r.target, r.reason))
        elif r.confidence >= K.UNSURE:
            rows.append(("warning", r.source, r.target, f"{r.reason} ({r.confidence:.2f} sure)"))
    used = {r.source for r in mapping.rules}
    reasons = dict(mapping.dropped)
    rows += [("alert", c, None, reasons.get(c, "not mapped")) for c in source_columns if c not in used]
    mapped = {r.target for r in mapping.rules}
    rows += [("missing_required", None, c.name, f"{c.data_type}, NOT NULL, no default")
             for c in target.required if c.name not in mapped]
    return small_frame(spark, rows, "bucket string, source string, target string, note string")
