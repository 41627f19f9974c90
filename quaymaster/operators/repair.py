"""Rule-driven repair of rejected rows.

Every pass is a narrow projection: rules are small metadata compiled into column
expressions, so all passes of all rows run in one stage without a shuffle, and a
lost task only repeats its own rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from quaymaster import constants as K, session
from quaymaster.model import FixRule, TargetColumn, TargetSchema, coerce_text
from quaymaster.operators.errors import ERROR_TYPE, collect_errors, error
from quaymaster.operators.mapping import ROW_IDX, quoted
from quaymaster.operators.typed import checking_type, is_exact, stored, typed_value
from quaymaster.operators.validate import check_errors, output_errors

# Found by joins over many rows, so a single row cannot be shown to be cured of them
# unless the value they concern has changed.
SET_LEVEL = (K.DUPLICATE_KEY, K.FK_MISSING)
_FIX_TYPE = "struct<attempt:int,fix_type:string,diagnosis:string,columns:array<string>>"


def strict_value(text: Column, column: TargetColumn) -> Column:
    """The typed value a database would store for this text, NULL when it refuses it."""
    return typed_value(text, column, whole=True)


def as_text(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
        return F.to_json(c)
    return c.cast("string")


def _check_texts(texts: dict[str, Column], values: dict[str, Column], target: TargetSchema) -> Column:
    """The errors of a row held as text, given the typed values of the texts."""
    found = []
    for name, text in texts.items():
        column, value = target.column(name), values[name]
        refused = text.isNotNull() & value.isNull()
        found.append(error(refused, name, K.BAD_CAST,
                           F.concat(F.lit("Cannot cast "), text, F.lit(f" to {column.type_name}")), text))
        # A missing value is NOT NULL trouble only when nothing failed to cast.
        rules = output_errors(column, value, checking_type(column), text, strict_int=True)
        found += [v.unless(refused) for v in rules] + check_errors(target, name, value, text)
    return collect_errors(found)


def _matches(rule: FixRule, attempt: int) -> Column:
    if rule.attempt is not None and rule.attempt != attempt:
        return F.lit(False)
    first = F.element_at("errs", 1)
    ok = F.col("state") == "open"
    if rule.code is not None:
        ok = ok & (first["code"] == rule.code)
    if rule.column is not None:
        ok = ok & (first["column"] == rule.column)
    return ok


def _plan(rule: FixRule, target: TargetSchema, safe_mode: bool) -> tuple[str, str | None]:
    """(outcome, manual text) that metadata alone decides: skip, manual, fail or update."""
    kind, cols = rule.fix_type, rule.subject
    if kind == "skip":
        return "skip", None
    if kind == "alter_column":
        text = rule.sql or (f"approve a change of the table: {rule.diagnosis}" if safe_mode
                            else f"change the table: {rule.diagnosis}")
        return "manual", text
    if not cols or (kind == "rename" and not rule.rename_to):
        return "fail", None
    known = target.column(cols[0]) is not None
    if kind == "cast" and not known:
        return "manual", f'cast asked for unknown target column "{cols[0]}"'
    if kind == "truncate":
        length = rule.length if rule.length is not None else (target.column(cols[0]).max_length if known else None)
        if not length or length <= 0:
            return "manual", f'cannot truncate column "{cols[0]}" without a maximum length'
    if kind == "rename" and safe_mode and target.column(rule.rename_to) is None:
        return "manual", f'rename to unknown target column "{rule.rename_to}"'
    return "update", None


def _new_texts(rule: FixRule, texts: dict[str, Column], target: TargetSchema) -> tuple[dict[str, Column], Column]:
    """Changed texts of one updating rule and the condition that it could not be applied."""
    failed = F.lit(False)
    out: dict[str, Column] = {}
    if rule.fix_type == "nullify":
        out = {c: F.lit(None).cast("string") for c in rule.subject if c in texts}
    elif rule.fix_type == "truncate":
        c = rule.subject[0]
        if c in texts:
            out[c] = F.left(texts[c], F.lit(rule.length if rule.length is not None else target.column(c).max_length))
    elif rule.fix_type == "cast":
        c = rule.subject[0]
        if c in texts:
            column = target.column(c)
            asked = rule.cast_to or column.coercion
            exact = asked == column.coercion and is_exact(column)
            value = as_text(*((typed_value(texts[c], column), checking_type(column)) if exact else (coerce_text(texts[c], asked), T.StringType())))
            failed = (texts[c] != "") & value.isNull()
            out[c] = value
    elif rule.fix_type == "rename":
        old, new = rule.subject[0], rule.rename_to
        if old in texts and old != new:
            out[old] = F.lit(None).cast("string")
            if new in texts:
                out[new] = texts[old]
    return out, failed


def repair(rejects: DataFrame, rules: Sequence[FixRule], target: TargetSchema,
           max_retries: int = K.MAX_RETRIES, safe_mode: bool = True, hold: bool = True) -> DataFrame:
    """Up to ``max_retries`` passes of pick fix, apply, revalidate.

    Returns ``row_idx``, the target columns, ``bucket`` (repaired / skipped /
    manual / unresolved), the last ``errors``, ``fixes`` (R8) and ``manual_action``.
    The first rule that matches a row's first error is used; a row no rule matches
    uses up the attempt unchanged.

    The result is held (memory, then disk) unless ``hold`` is false: the fix log, the
    report and the merge all read it, and a later filter must not be pushed down
    through the passes, which would repeat their expressions many times over.
    """
    names = [c for c in target.names if c in rejects.columns]
    types = {f.name: f.dataType for f in rejects.schema.fields}
    staged = [F.coalesce(as_text(quoted(n), types[n]), _raw_input(n)).alias(f"t{i}") for i, n in enumerate(names)]
    work = rejects.select(
        ROW_IDX, *staged, F.col("errors").alias("errs"), F.lit("open").alias("state"),
        F.array().cast(f"array<{_FIX_TYPE}>").alias("fixes"), F.lit(None).cast("string").alias("manual"))
    for attempt in range(1, max_retries + 1):
        work = _one_pass(work, names, rules, target, attempt, safe_mode)
    texts = {n: F.col(f"t{i}") for i, n in enumerate(names)}
    bucket = F.when(F.col("state") == "open", "unresolved").otherwise(F.col("state"))
    final = [stored(strict_value(texts[n], target.column(n)), target.column(n)).alias(n) for n in names]
    out = work.select(ROW_IDX, *final, bucket.alias("bucket"), F.col("errs").alias("errors"), "fixes",
                      F.col("manual").alias("manual_action"))
    return session.hold(out) if hold else out


def _raw_input(name: str) -> Column:
    """The text a failed cast left in ``errors`` for this column."""
    mine = F.filter("errors", lambda e: (e["column"] == name) & (e["code"] == K.BAD_CAST))
    return F.try_element_at(mine, F.lit(1))["input"]


def _one_pass(work: DataFrame, names: list[str], rules: Sequence[FixRule], target: TargetSchema,
              attempt: int, safe_mode: bool) -> DataFrame:
    # 1. Which rule, by position.
    pick = F.when(F.lit(False), F.lit(-1))
    for i, r in enumerate(rules):
        pick = pick.when(_matches(r, attempt), F.lit(i))
    work = work.withColumn("rule", pick.otherwise(-1))

    # 2. New texts, and whether the fix could be applied.
    texts = {n: F.col(f"t{i}") for i, n in enumerate(names)}
    chains: dict[str, list[tuple[int, Column]]] = {n: [] for n in names}
    failed, updates, skips, manuals = F.lit(False), [], [], []
    for i, r in enumerate(rules):
        outcome, text = _plan(r, target, safe_mode)
        if outcome == "skip":
            skips.append(i)
        elif outcome == "manual":
            manuals.append((i, text))
        elif outcome == "fail":
            failed = failed | (F.col("rule") == i)
        else:
            updates.append(i)
            changed, could_not = _new_texts(r, texts, target)
            failed = failed | ((F.col("rule") == i) & could_not)
            for n, c in changed.items():
                chains[n].append((i, F.when(could_not, texts[n]).otherwise(c)))
    fresh = []
    for i, n in enumerate(names):
        value = F.when(F.lit(False), texts[n])
        for at, c in chains[n]:
            value = value.when(F.col("rule") == at, c)
        fresh.append(value.otherwise(texts[n]).alias(f"n{i}"))
    applied = F.col("rule").isin(*updates) if updates else F.lit(False)
    work = work.select("*", *fresh, F.coalesce(failed, F.lit(False)).alias("failed")).withColumn(
        "applied", applied & ~F.col("failed"))

    # 3. Revalidate rows that were changed; values are a step of their own, so each is parsed once.
    now = {n: F.col(f"n{i}") for i, n in enumerate(names)}
    work = work.select("*", *[F.when(F.col("applied"), strict_value(now[n], target.column(n))).alias(f"v{i}")
                              for i, n in enumerate(names)])
    errs = _check_texts(now, {n: F.col(f"v{i}") for i, n in enumerate(names)}, target)
    moved = F.array_compact(F.array(*[
        F.when(~F.col(f"t{i}").eqNullSafe(F.col(f"n{i}")), F.lit(n)) for i, n in enumerate(names)]))
    sticky = F.filter("errs", lambda e: e["code"].isin(*SET_LEVEL) & ~F.array_contains(moved, e["column"]))
    checked = F.concat(F.coalesce(errs, F.array().cast(ERROR_TYPE)), sticky)
    work = work.withColumn("all_errors", F.when(F.col("applied"), checked)).withColumn(
        "checked", F.when(F.size("all_errors") > 0, F.col("all_errors")))

    # 4. Next state. A fix that failed to apply replaces the message and uses the attempt.
    is_skip = F.col("rule").isin(*skips) if skips else F.lit(False)
    manual_text = F.when(F.lit(False), F.lit(""))
    for at, text in manuals:
        manual_text = manual_text.when(F.col("rule") == at, F.lit(text))
    is_manual = F.col("rule").isin(*[at for at, _ in manuals]) if manuals else F.lit(False)
    diagnosis = F.element_at(F.array(*[F.lit(r.diagnosis) for r in rules]), F.col("rule") + 1) if rules else F.lit("")
    kind = F.element_at(F.array(*[F.lit(r.fix_type) for r in rules]), F.col("rule") + 1) if rules else F.lit("")
    touched = F.element_at(F.array(*[
        F.array(*[F.lit(x) for x in (() if r.fix_type == "skip" else
                                     (*r.subject, r.rename_to) if r.fix_type == "rename" else r.subject)])
        .cast("array<string>") for r in rules]), F.col("rule") + 1) if rules else F.array().cast("array<string>")
    entry = F.struct(F.lit(attempt).alias("attempt"), kind.alias("fix_type"), diagnosis.alias("diagnosis"),
                     touched.alias("columns")).cast(_FIX_TYPE)
    logged = F.col("applied") | is_skip
    complaint = F.transform(F.slice("errs", 1, 1), lambda e: F.struct(
        e["column"].alias("column"), e["code"].alias("code"),
        F.concat(F.lit("the fix did not work: "), e["message"]).alias("message"), e["input"].alias("input")))
    return work.select(
        ROW_IDX, *[F.col(f"n{i}").alias(f"t{i}") for i in range(len(names))],
        F.when(F.col("applied"), F.col("checked")).when(F.col("failed"), complaint).otherwise(F.col("errs")).alias("errs"),
        F.when(is_skip, "skipped").when(is_manual, "manual")
        .when(F.col("applied") & F.col("checked").isNull(), "repaired").otherwise(F.col("state")).alias("state"),
        F.when(logged, F.concat("fixes", F.array(entry))).otherwise(F.col("fixes")).alias("fixes"),
        F.when(is_manual, manual_text).otherwise(F.col("manual")).alias("manual"))


def fix_log(repaired: DataFrame) -> DataFrame:
    """One row per applied or skip fix."""
    return repaired.select(ROW_IDX, F.inline("fixes"))
