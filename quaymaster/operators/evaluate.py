"""Scoring a proposed mapping against data and target.

The data is read for two things only: the cast share of each (source column,
transformation) pair and a few statistics per mapped column. What follows works
on one row per rule, however large the source is.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window, functions as F

from quaymaster import constants as K
from quaymaster.functions.structured import castable
from quaymaster.functions.text import is_nullish, js_trim
from quaymaster.model import TRANSFORMATIONS, Mapping, TargetSchema
from quaymaster.operators.mapping import ROW_IDX, quoted
from quaymaster.operators.profile import frequency_table
from quaymaster.operators.topk import first_k_matching, first_k_values, text_rows
from quaymaster.session import hold, small_frame

_SEP = "\x1f"


def _text(name: str) -> Column:
    return F.coalesce(quoted(name).cast("string"), F.lit(""))


def _not_blank(c: Column) -> Column:
    return js_trim(c) != ""


def _castable_by(transformation: Column, value: Column) -> Column:
    chain = F.when(F.lit(False), F.lit(True))
    for t in TRANSFORMATIONS:
        if t not in ("none", "custom"):
            chain = chain.when(transformation == t, castable(value, t))
    return chain.otherwise(True)


def _pairs(mappings: Sequence[Mapping]) -> list[tuple[str, str]]:
    return list(dict.fromkeys((r.source, r.transformation) for m in mappings for r in m.rules
                              if r.transformation != "none"))


def cast_rates(df: DataFrame, pairs: Sequence[tuple[str, str]], scope: str = "all",
               row_idx: str = ROW_IDX) -> DataFrame:
    """V1: ``source, transformation, rate`` over all non-blank values; each distinct value is tested once.

    ``scope='sample'`` asks for the first 20 values of a column instead.
    """
    spark = df.sparkSession
    wanted = small_frame(spark, list(pairs), "source string, transformation string")
    sources = list(dict.fromkeys(s for s, _ in pairs))
    if not sources:
        return wanted.withColumn("rate", F.lit(1.0))
    if scope == "all":
        values = text_rows(df, sources, row_idx).filter(_not_blank(F.col("value"))).groupBy(
            F.col("column").alias("source"), "value").agg(F.count(F.lit(1)).alias("cnt"))
    else:
        values = first_k_values(df, sources, _not_blank, K.CAST_SAMPLE, row_idx).select(
            F.col("column").alias("source"), "value", F.lit(1).alias("cnt"))
    # ``wanted`` has one row per rule: a proven size.
    tested = values.join(F.broadcast(wanted), "source").withColumn(
        "ok", _castable_by(F.col("transformation"), F.col("value")))
    return tested.groupBy("source", "transformation").agg(
        (F.sum(F.when(F.col("ok"), F.col("cnt")).otherwise(0)) / F.sum("cnt")).alias("rate"))


def cast_step(rate: Column) -> Column:
    """V1: share -> score; no values score 1."""
    step = F.when(rate.isNull(), F.lit(1.0))
    for least, score in K.CAST_STEPS:
        step = step.when(rate >= least, F.lit(score))
    return step.otherwise(0.0)


def cast_examples(df: DataFrame, pairs: Sequence[tuple[str, str]], row_idx: str = ROW_IDX) -> DataFrame:
    """V1: first three failing values of all rows per pair: ``source, transformation, examples``."""
    tests = {s + _SEP + t: (_text(s), (_text(s) != "") & ~castable(_text(s), t)) for s, t in pairs}
    first = first_k_matching(df, tests, K.CAST_EXAMPLES, row_idx)
    packed = first.groupBy("tag").agg(F.array_sort(F.collect_list(F.struct("rn", "value"))).alias("l"))
    at = F.split("tag", _SEP)
    return packed.select(at[0].alias("source"), at[1].alias("transformation"),
                         F.transform("l", lambda x: x["value"]).alias("examples"))


def column_stats(df: DataFrame, columns: Sequence[str], unique_columns: Sequence[str] = (),
                 row_idx: str = ROW_IDX) -> DataFrame:
    """The part of the profile that scoring needs: ``source, null_rate, total_count, max_length, unique_count``.

    Only columns that must be unique are counted by value; the rest is one scan.
    """
    live = ~is_nullish(F.col("value"))
    rows = text_rows(df, list(columns), row_idx).groupBy(F.col("column").alias("source")).agg(
        F.count(F.lit(1)).alias("total_count"), F.count(F.when(live, 1)).alias("live"),
        F.coalesce(F.max(F.when(live, F.length("value"))), F.lit(0)).alias("max_length"))
    # A source without rows still has its columns.
    rows = small_frame(df.sparkSession, [(c,) for c in columns], "source string").join(rows, "source", "left").select(
        "source", F.coalesce(F.try_divide(F.col("total_count") - F.col("live"), F.col("total_count")), F.lit(1.0))
        .alias("null_rate"), F.coalesce("total_count", F.lit(0)).alias("total_count"),
        F.coalesce("max_length", F.lit(0)).alias("max_length"))
    if not unique_columns:
        return rows.withColumn("unique_count", F.lit(None).cast("bigint"))
    counts = text_rows(df, list(unique_columns), row_idx).filter(~is_nullish(F.col("value"))).groupBy(
        "column", "value").agg(F.lit(1)).groupBy(F.col("column").alias("source")).agg(
        F.count(F.lit(1)).alias("unique_count"))
    zero = F.when(F.col("source").isin(*unique_columns), F.lit(0))
    return rows.join(counts, "source", "left").withColumn("unique_count", F.coalesce("unique_count", zero))


def _group_stats(df: DataFrame, groups: Sequence[tuple[str, ...]]) -> DataFrame:
    """Distinct complete key tuples per group: ``grp, unique_count, live``."""
    parts = []
    for i, cols in enumerate(groups):
        live = F.lit(True)
        for c in cols:
            live = live & ~is_nullish(_text(c))
        parts.append(df.filter(live).groupBy(*[_text(c).alias(f"k{j}") for j, c in enumerate(cols)]).count()
                     .agg(F.count(F.lit(1)).alias("unique_count"), F.coalesce(F.sum("count"), F.lit(0)).alias("live"))
                     .select(F.lit(i).alias("grp"), "unique_count", "live"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@dataclass
class Evaluation:
    """One row per candidate in ``scores``; ordered ``issues``, looked for (with examples) when they are first asked for.

    ``issue_texts`` are the same issues without examples, for which no row of the source is read again.
    """
    scores: DataFrame
    find_issues: Callable[[bool], DataFrame]

    @cached_property
    def issues(self) -> DataFrame:
        return self.find_issues(True)

    @cached_property
    def issue_texts(self) -> DataFrame:
        return self.find_issues(False).drop("examples")


def evaluate_mappings(df: DataFrame, candidates: Sequence[Mapping], target: TargetSchema,
                      scope: str = "all", composite: bool = False, row_idx: str = ROW_IDX) -> Evaluation:
    """V7 for several candidates in one reading of the data."""
    spark = df.sparkSession
    required = [c.name for c in target.required]
    key_use = {c: sum(c in g for g in target.key_groups) for c in target.names}

    rules, missing, groups = [], [], []
    for n, m in enumerate(candidates):
        mapped = {r.target: r.source for r in m.rules}
        seen: set[str] = set()
        for i, r in enumerate(m.rules):
            col = target.column(r.target)
            # Several rules of one target: what the target asks for is held against the first alone.
            first = r.target not in seen
            seen.add(r.target)
            rules.append((n, i, r.source, r.target, r.transformation, float(r.confidence), r.reason,
                          bool(first and col and col.required), col.max_length if col else None,
                          key_use.get(r.target, 0) if first and not composite else 0))
        missing += [(n, i, c) for i, c in enumerate(required) if c not in mapped]
        if composite:
            groups += [(n, i, tuple(mapped[c] for c in g)) for i, g in enumerate(target.key_groups)
                       if all(c in mapped for c in g)]
    rule_rows = small_frame(spark, rules, "candidate int, ord int, source string, target string, "
                            "transformation string, confidence double, reason string, required boolean, "
                            "target_length int, key_use int")
    sources = list(dict.fromkeys(r[2] for r in rules))
    keyed = list(dict.fromkeys(r[2] for r in rules if r[9]))
    if not sources:
        rule_rows = rule_rows.selectExpr("*", "cast(null AS double) AS rate", "0D AS null_rate",
                                         "0L AS total_count", "0 AS max_length", "0L AS unique_count")
    else:
        pairs = _pairs(candidates)
        rule_rows = rule_rows.join(cast_rates(df, pairs, scope, row_idx), ["source", "transformation"], "left").join(
            column_stats(df, sources, keyed, row_idx), "source", "left")
    # One row per rule. Fixed here because scores and issues both read it.
    rule_rows = hold(rule_rows.withColumn("cast_score", F.when(
        F.col("transformation") == "none", 1.0).otherwise(cast_step(F.col("rate")))))

    null_hit = F.col("required") & (F.col("null_rate") > K.NULL_RATE_WARN)
    not_unique = (F.col("key_use") > 0) & (
        F.col("unique_count") < F.col("total_count") - F.col("total_count") * F.col("null_rate"))
    heads = small_frame(spark, [
        (n, sum(1 for x in missing if x[0] == n), max(len(required), 1)) for n in range(len(candidates))],
        "candidate int, missing int, required_n int")
    sums = rule_rows.groupBy("candidate").agg(
        F.avg("cast_score").alias("type"), F.count(F.when(null_hit, 1)).alias("null_hits"),
        F.sum(F.when(not_unique, F.col("key_use")).otherwise(0)).alias("unique_hits"),
        F.count_if((F.col("cast_score") == 0)).alias("never_cast"),
        F.count_if(null_hit & (F.col("null_rate") > K.NULL_RATE_CRITICAL)).alias("mostly_null"),
        F.avg("confidence").alias("conf"))
    group_hits = None
    if groups:
        stats = _group_stats(df, [g for _, _, g in groups])
        named = small_frame(spark, [(i, n, o, ", ".join(g)) for i, (n, o, g) in enumerate(groups)],
                            "grp int, candidate int, ord int, source string")
        group_hits = hold(named.join(stats, "grp").filter(F.col("unique_count") < F.col("live")))
        sums = sums.drop("unique_hits").join(
            group_hits.groupBy("candidate").agg(F.count(F.lit(1)).alias("unique_hits")), "candidate", "left")
    w = K.WEIGHTS
    parts = heads.join(sums, "candidate", "left").select(
        "candidate", F.coalesce("type", F.lit(1.0)).alias("type_score"),
        F.greatest(F.lit(0.0), 1 - F.coalesce("null_hits", F.lit(0)) * K.NULL_PENALTY).alias("null_score"),
        F.greatest(F.lit(0.0), 1 - F.coalesce("unique_hits", F.lit(0)) * K.UNIQUE_PENALTY).alias("unique_score"),
        (1 - F.col("missing") / F.col("required_n")).alias("required_score"),
        F.coalesce("conf", F.lit(0.0)).alias("confidence_score"),
        # What the issues call critical, counted without looking for their examples.
        (F.col("missing") + F.coalesce("never_cast", F.lit(0)) + F.coalesce("mostly_null", F.lit(0)) + F.coalesce("unique_hits", F.lit(0))).alias("criticals"))
    total = (F.col("type_score") * w["type"] + F.col("null_score") * w["null"]
             + F.col("unique_score") * w["unique"] + F.col("required_score") * w["required"]
             + F.col("confidence_score") * w["confidence"])
    scores = parts.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)))
    columns = [c for c in scores.columns if c != "criticals"]
    return Evaluation(
        scores.select(*columns, F.col("criticals").cast("bigint").alias("criticals"),
                      ((F.round("score", 9) >= K.PASS_SCORE) & (F.col("criticals") == 0)).alias("passed")),
        lambda examples: order_issues(_issues(spark, df, rule_rows, candidates, missing, null_hit, not_unique, group_hits, row_idx, examples)))


def order_issues(issues: DataFrame) -> DataFrame:
    """Critical, then warning, then info; stable within each. ``place`` counts them per candidate from 1."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in K.SEVERITY_RANK.items() for x in kv]), F.col("severity"))
    placed = issues.withColumn("place", F.row_number().over(Window.partitionBy("candidate").orderBy(rank, "section", "ord")))
    return placed.orderBy("candidate", "place")


def _issues(spark, df, rule_rows, candidates, missing, null_hit, not_unique, group_hits, row_idx, examples) -> DataFrame:
    pct = F.format_string("%.0f%%", (1 - F.col("rate")) * 100)
    low_cast = F.col("cast_score") < K.CAST_ISSUE_BELOW
    s = F.lit

    def issue(when, section, severity, text, repeat=None):
        item = F.struct(s(section).alias("section"), severity.alias("severity"), text.alias("issue"))
        rows = F.array(item) if repeat is None else F.array_repeat(item, repeat)
        return F.when(when, rows)

    found = [
        issue(low_cast, 1, F.when(F.col("cast_score") == 0, "critical").otherwise("warning"),
              F.concat(pct, s(" of values do not read as "), "transformation")),
        issue(null_hit, 2, F.when(F.col("null_rate") > K.NULL_RATE_CRITICAL, "critical").otherwise("warning"),
              F.concat(F.format_string("%.0f%%", F.col("null_rate") * 100),
                       s(" null rate into NOT NULL column "), "target")),
        issue(not_unique, 3, s("critical"),
              F.concat(F.col("unique_count").cast("string"), s(" unique values in "),
                       F.col("total_count").cast("string"), s(" rows, but "), "target", s(" must be unique")),
              F.col("key_use")),
        issue(F.col("confidence") < K.LOW_CONFIDENCE, 5, s("warning"),
              F.concat(s("the rule for "), "target", F.format_string(" is unsure of itself: %.2f", "confidence"))),
        issue(F.col("max_length") > F.col("target_length"), 6, s("warning"),
              F.concat(s("values up to "), F.col("max_length").cast("string"), s(" characters, "), "target",
                       s(" takes "), F.col("target_length").cast("string"))),
    ]
    flat = F.flatten(F.array_compact(F.array(*found)))
    out = rule_rows.select("candidate", "ord", F.col("source").alias("column"), "transformation",
                           F.inline(flat))
    # Rules that cast badly are few and known by now; only they are searched for examples.
    poor = [(r.source, r.transformation) for r in rule_rows.filter(low_cast).select(
        "source", "transformation").distinct().collect()] if examples else []
    empty = F.array().cast("array<string>")
    if poor:
        ex = cast_examples(df, poor, row_idx).withColumnRenamed("source", "column").withColumn("section", F.lit(1))
        out = out.join(F.broadcast(ex), ["column", "transformation", "section"], "left").withColumn(
            "examples", F.coalesce("examples", empty))
    else:
        out = out.withColumn("examples", empty)
    out = out.select("candidate", "section", "ord", "severity", "column", "issue", "examples")
    gaps = small_frame(spark, missing, "candidate int, ord int, column string").select(
        "candidate", s(4).alias("section"), "ord", s("critical").alias("severity"), "column",
        F.concat(s("Required column "), "column", s(" has no mapping")).alias("issue"), empty.alias("examples"))
    out = out.unionByName(gaps)
    if group_hits is not None:
        out = out.unionByName(group_hits.select(
            "candidate", s(3).alias("section"), "ord", s("critical").alias("severity"),
            F.col("source").alias("column"),
            F.concat(F.col("unique_count").cast("string"), s(" distinct keys in "), F.col("live").cast("string"),
                     s(" rows")).alias("issue"), empty.alias("examples")))
    return out


def evaluate_mapping(df: DataFrame, mapping: Mapping, target: TargetSchema, **options) -> Evaluation:
    """V7: score, breakdown, pass flag and issues of one mapping."""
    found = evaluate_mappings(df, [mapping], target, **options)
    return Evaluation(found.scores.drop("candidate"), lambda examples: (found.issues if examples else found.issue_texts).drop("candidate"))


def best_mapping(df: DataFrame, candidates: Sequence[Mapping], target: TargetSchema, **options) -> DataFrame:
    """Candidates in order up to the first that passes; the highest score wins, first on ties."""
    scores = evaluate_mappings(df, candidates, target, **options).scores
    first_pass = F.min(F.when(F.col("passed"), F.col("candidate"))).over(Window.partitionBy(F.lit(1)))
    tried = scores.withColumn("first_pass", first_pass).filter(
        F.col("first_pass").isNull() | (F.col("candidate") <= F.col("first_pass")))
    return tried.drop("first_pass").orderBy(F.desc("score"), F.asc("candidate")).limit(1)


# --- fixed values: confidence of each kind of name match ---
EXACT_NAME, SAME_LETTERS, SHAPE_ONLY = 0.95, 0.90, 0.65
_TRANSFORMATION_OF = {"integer": "to_integer", "number": "to_number", "boolean": "to_boolean", "date": "to_date",
                      "timestamp": "to_timestamp", "json": "to_json", "uuid": "to_uuid"}


def shape_match(df: DataFrame, target: TargetSchema, columns: Sequence[str] | None = None,
                row_idx: str = ROW_IDX) -> DataFrame:
    """Evidence for every (source, target) pair.

    ``name_score`` from the names, ``cast_share`` from all values (each distinct
    value tested once per type), ``null_ok`` when few enough are missing.
    """
    spark = df.sparkSession
    columns = list(columns or [c for c in df.columns if c != row_idx])
    plain = {c: c.lower() for c in [*columns, *target.names]}
    letters = {c: "".join(ch for ch in c.lower() if ch.isalnum()) for c in plain}

    def name_score(a: str, b: str) -> float:
        return EXACT_NAME if plain[a] == plain[b] else SAME_LETTERS if letters[a] == letters[b] else 0.0

    pairs = [(s, t.name, "to_array" if t.is_array else _TRANSFORMATION_OF.get(t.coercion, "none"),
              name_score(s, t.name), letters[s], letters[t.name], t.required)
             for s in columns for t in target.columns]
    frame = small_frame(spark, pairs, "source string, target string, transformation string, name_score double, "
                        "source_letters string, target_letters string, required boolean")
    kinds = sorted({p[2] for p in pairs} - {"none"})
    freq = frequency_table(df, columns, row_idx=row_idx, digests=False).withColumn("blank", ~_not_blank(F.col("key")))
    weight = F.when(~F.col("blank"), F.col("cnt")).otherwise(0)
    shares = freq.groupBy("column").agg(
        F.sum("cnt").alias("n"), F.sum(F.when(F.col("live"), F.col("cnt")).otherwise(0)).alias("live"),
        F.sum(weight).alias("filled"),
        *[F.sum(F.when(castable(F.col("key"), k), weight).otherwise(0)).alias(k) for k in kinds])
    per_kind = F.array(*[F.struct(F.lit(k).alias("transformation"),
                                  F.try_divide(F.col(k), F.col("filled")).alias("cast_share")) for k in kinds],
                       F.struct(F.lit("none"), F.lit(1.0)).cast("struct<transformation:string,cast_share:double>"))
    long = shares.select(F.col("column").alias("source"),
                         (1 - F.try_divide("live", "n")).alias("null_rate"), F.inline(per_kind))
    similarity = 1 - F.levenshtein("source_letters", "target_letters") / F.greatest(
        F.length("source_letters"), F.length("target_letters"))
    confidence = F.when(F.col("name_score") > 0, F.col("name_score")).when(
        (F.col("transformation") != "none") & (F.col("cast_share") >= K.CAST_STEPS[0][0]), SHAPE_ONLY).otherwise(0.0)
    return F.broadcast(frame).join(long, ["source", "transformation"]).select(
        "source", "target", "transformation", "name_score", similarity.alias("name_similarity"), "cast_share",
        (~F.col("required") | (F.col("null_rate") <= K.NULL_RATE_WARN)).alias("null_ok"),
        confidence.alias("confidence"))
