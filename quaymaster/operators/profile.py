"""Column profiling (A1-A10).

Every statistic of the deep profile is a count-weighted aggregate over one
frequency table ``F`` (one row per column and distinct value), so each pattern
or number parse runs once per distinct value. Rows are read again only for the
few values that appear in row-order lists (samples, outliers).

A value of more than 200 characters is keyed by its digest: its tests run before the
shuffle and the text itself is never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from quaymaster import constants as K
from quaymaster.functions.numbers import extract_number, round_half_up
from quaymaster.functions.structured import is_json_container
from quaymaster.functions.text import (
    is_empty_like, is_nullish, js_trim, uniqueness_key, value_kind,
)
from quaymaster.operators.mapping import ROW_IDX, quoted
from quaymaster.operators.ranks import select_ranks
from quaymaster.operators.topk import first_k_matching, first_k_per_group, first_k_values, text_rows
from quaymaster.session import hold

# One bit of ``flags`` per test: types, patterns, then the two column flags.
_TYPE_NAMES = [name for name, _ in K.TYPE_TESTS]
_PATTERN_NAMES = [name for name, _ in K.REGEX_PATTERNS] + [
    K.LONG_TEXT_PATTERN, K.MULTILINE_PATTERN, K.JSON_PATTERN]
_BITS = {f"type:{n}": i for i, n in enumerate(_TYPE_NAMES)}
_BITS.update({f"pattern:{n}": len(_BITS) + i for i, n in enumerate(_PATTERN_NAMES)})
_BITS["special"] = len(_BITS)


_FEATURES = ("flags", "len", "num")
# All that a text can consist of that reads as a number.
_NUMBER_CHARACTERS = rf"^(?:(?i:{K.CURRENCY_CODES}){K.SPACE_CLASS}+)?[0-9.eE+\-,{K.CURRENCY_SYMBOLS}{K.SPACE_CLASS[1:-1]}]*\z"


def _features(value: Column) -> list[Column]:
    """Tests of one text value, the set ones packed into ``flags``."""
    trimmed = js_trim(value)
    tests = {f"type:{n}": trimmed.rlike(p) for n, p in K.TYPE_TESTS}
    tests.update({f"pattern:{n}": value.rlike(p) for n, p in K.REGEX_PATTERNS})
    tests[f"pattern:{K.LONG_TEXT_PATTERN}"] = F.length(value) > K.LONG_TEXT_LENGTH
    tests[f"pattern:{K.MULTILINE_PATTERN}"] = value.contains("\n")
    tests[f"pattern:{K.JSON_PATTERN}"] = is_json_container(value)
    tests["special"] = value.rlike(K.SPECIAL_CHAR)
    bits = F.lit(0).cast("bigint")
    for name, test in tests.items():
        bits = bits.bitwiseOR(F.when(test, F.lit(1 << _BITS[name]).cast("bigint")).otherwise(0))
    return [bits.alias("flags"), F.length(value).alias("len"), extract_number(value).alias("num")]


def _flag(name: str) -> Column:
    return F.col("flags").bitwiseAND(F.lit(1 << _BITS[name])) != 0


def value_key(value: Column) -> Column:
    """The value itself, or the digest of one that is too long to be shuffled."""
    return F.when(F.length(value) > K.LONG_TEXT_LENGTH, F.sha2(value, 256)).otherwise(value)


def frequency_table(df: DataFrame, columns: Sequence[str], row_idx: str = ROW_IDX, digests: bool = True,
                    features: Sequence[str] = _FEATURES) -> DataFrame:
    """``F``: ``column, key, tkey, cnt, first_idx, live, len, num, flags, long``.

    ``key`` identifies the untrimmed value and ``tkey`` the trimmed one: the text
    itself, or its digest where the value is ``long``. Partial aggregation leaves at
    most one row per value and task, whatever share of the rows a value holds.
    ``digests=False`` keys long values by their text too. ``features`` names those of len, num and flags that are wanted.
    """
    wanted = lambda v: {n: x for n, x in zip(_FEATURES, _features(v)) if n in features}
    value = F.col("value")
    long = (F.length(value) > K.LONG_TEXT_LENGTH) if digests else F.lit(False)
    # What a digest cannot tell later is worked out before; it depends on the key, so it may group too.
    early = {"long": long, "key": F.when(long, F.sha2(value, 256)).otherwise(value),
             "long_tkey": F.when(long, value_key(js_trim(value))), "long_live": F.when(long, ~is_nullish(value)),
             **{f"long_{n}": F.when(long, x) for n, x in wanted(value).items()}}
    counted = (text_rows(df, columns, row_idx).select("row_idx", "column", *[x.alias(n) for n, x in early.items()])
               .groupBy("column", *early).agg(F.count(F.lit(1)).alias("cnt"), F.min("row_idx").alias("first_idx")))
    key = F.col("key")
    late = {"tkey": js_trim(key), "live": ~is_nullish(key), **wanted(key)}
    return counted.select("column", "key", "cnt", "first_idx", "long", *[
        F.when(F.col("long"), F.col(f"long_{n}")).otherwise(x).alias(n) for n, x in late.items()])


def basic_stats(freq: DataFrame) -> DataFrame:
    """A2, A3, A4, A8, A9 in one aggregate: a row per column."""
    live = F.col("live")
    weight = F.when(live, F.col("cnt")).otherwise(0)
    aggs = [
        F.sum("cnt").alias("total_count"), F.sum(weight).alias("live_count"),
        F.count(F.when(live, 1)).alias("unique_count"),
        F.coalesce(F.min(F.when(live, F.col("len"))), F.lit(0)).alias("min_length"),
        F.coalesce(F.max(F.when(live, F.col("len"))), F.lit(0)).alias("max_length"),
        F.expr("bit_or(CASE WHEN live THEN flags ELSE 0 END)").alias("flags"),
        F.sum(F.when(F.col("num").isNotNull(), weight).otherwise(0)).alias("numeric_count"),
        F.sum(F.when(_flag(f"pattern:{K.JSON_PATTERN}"), weight).otherwise(0)).alias("s_json"),
    ]
    aggs += [F.sum(F.when(_flag(f"type:{n}"), weight).otherwise(0)).alias(f"s_{n}") for n in _TYPE_NAMES]
    per_column = freq.groupBy("column").agg(*aggs)

    inferred = F.when(F.col("live_count") == 0, "unknown")
    for name in ["json", *_TYPE_NAMES]:
        inferred = inferred.when(F.col(f"s_{name}") >= K.TYPE_SHARE * F.col("live_count"), name)
    patterns = F.array_compact(F.array(*[
        F.when(_flag(f"pattern:{n}"), F.lit(n)) for n in _PATTERN_NAMES]))
    null_rate = F.coalesce(F.try_divide(F.col("total_count") - F.col("live_count"), F.col("total_count")),
                           F.lit(1.0))
    return per_column.select(
        "column", inferred.otherwise("string").alias("inferred_type"), null_rate.alias("null_rate"),
        "unique_count", "total_count", "live_count", "numeric_count",
        F.when(F.col("live_count") == 0, F.array(F.lit(K.ALL_NULL_PATTERN))).otherwise(patterns)
        .alias("patterns"),
        "min_length", "max_length",
        _flag("pattern:leading-zeros").alias("has_leading_zeros"),
        _flag("special").alias("has_special_chars"))


def numeric_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Those of ``columns`` that :func:`numeric_stats` has rows for: two counts a column, in one scan without a shuffle of values."""
    counts = []
    for i, c in enumerate(columns):
        value = F.coalesce(quoted(c).cast("string"), F.lit(""))
        live = ~is_nullish(value)
        # One look at the characters spares most texts the parsing.
        number = F.when(value.rlike(_NUMBER_CHARACTERS), extract_number(value))
        counts += [F.count_if(live).alias(f"live{i}"), F.count_if(number.isNotNull() & live).alias(f"n{i}")]
    found = df.agg(*counts).first()
    return [c for i, c in enumerate(columns) if found[f"n{i}"] > 0 and found[f"n{i}"] >= K.NUMERIC_SHARE * found[f"live{i}"]]


def number_table(df: DataFrame, numeric: Sequence[str], row_idx: str = ROW_IDX) -> DataFrame:
    """What :func:`numeric_stats` and :func:`outliers` read of the frequency table, of :func:`numeric_columns`."""
    if not numeric:
        df, numeric = df.filter(F.lit(False)), [row_idx]
    return frequency_table(df, numeric, row_idx, features=("num",))


def numeric_stats(freq: DataFrame) -> DataFrame:
    """A5: min, max, mean, median, p95 of columns that are numeric enough.

    p95 is the value at 0-based rank floor(0.95 n); ranks are exact (see ``ranks``).
    """
    live = freq.filter("live")
    gate = live.groupBy("column").agg(
        F.sum("cnt").alias("live_count"),
        F.sum(F.when(F.col("num").isNotNull(), F.col("cnt")).otherwise(0)).alias("n"),
        F.min("num").alias("min"), F.max("num").alias("max"),
        F.sum(F.col("num") * F.col("cnt")).alias("total"),
    ).filter((F.col("n") > 0) & (F.col("n") >= K.NUMERIC_SHARE * F.col("live_count")))
    n = F.col("n")
    p95_rank = F.least(F.floor(n * K.P95), n - 1).cast("bigint")
    ranks = {"lo": F.floor((n - 1) / 2).cast("bigint"), "hi": F.floor(n / 2).cast("bigint"), "p95": p95_rank}
    wanted = gate.select("column", F.inline(F.array(*[
        F.struct(F.lit(tag).alias("tag"), rank.alias("rank")) for tag, rank in ranks.items()])))
    numbers = (live.filter(F.col("num").isNotNull()).join(F.broadcast(gate.select("column")), "column")
               .groupBy("column", F.col("num").alias("value")).agg(F.sum("cnt").alias("cnt")))
    found = select_ranks(numbers, wanted, "column").groupBy("column").agg(*[
        F.max(F.when(F.col("tag") == tag, F.col("value"))).alias(tag) for tag in ranks])
    return gate.join(found, "column").select(
        "column", "min", "max", round_half_up(F.col("total") / n, 2).alias("mean"),
        round_half_up((F.col("lo") + F.col("hi")) / 2, 2).alias("median"), "p95")


def top_values(freq: DataFrame, k: int = K.TOP_VALUES) -> DataFrame:
    """``column, rn, tkey, first_idx, count, pct``; ties go to the earlier value."""
    by_value = freq.filter("live").groupBy("column", "tkey", "long").agg(
        F.sum("cnt").alias("count"), F.min("first_idx").alias("first_idx"))
    # ``first`` keeps this branch on the same columns as the ranking below, so that
    # both read one shuffle of the value counts.
    totals = by_value.groupBy("column").agg(
        F.sum("count").alias("live_count"), F.count(F.lit(1)).alias("distinct"),
        F.max("count").alias("top"), F.min("first_idx").alias("first")).filter(
        F.col("first").isNotNull() & (
            (F.col("distinct") <= K.TOP_MAX_DISTINCT)
            | (F.col("top") / F.col("live_count") >= K.TOP_MIN_SHARE)))
    ranked = first_k_per_group(by_value, ["column"], k, [F.desc("count"), F.asc("first_idx")])
    pct = F.floor(F.col("count") * 1000 / F.col("live_count") + 0.5) / 10
    return ranked.join(totals, "column").select(
        "column", "rn", "tkey", "long", "first_idx", "count", pct.alias("pct"))


def value_texts(df: DataFrame, at: DataFrame, columns: Sequence[str], row_idx: str = ROW_IDX) -> DataFrame:
    """Texts at the few ``(column, first_idx)`` pairs of ``at`` (a bounded list per column)."""
    rows = text_rows(df.join(F.broadcast(at.select(F.col("first_idx").alias(row_idx)).distinct()), row_idx),
                     columns, row_idx)
    return rows.select("column", F.col("row_idx").alias("first_idx"), "value").join(
        F.broadcast(at), ["column", "first_idx"])


def first_rows_of(df: DataFrame, freq: DataFrame, k: int, columns: Sequence[str], row_idx: str = ROW_IDX) -> DataFrame:
    """First ``k`` rows per column whose value is one of those in ``freq``.

    The first ``k`` such rows hold at most ``k`` distinct values, and these are the
    ones that appear earliest; with ``k`` of them found, no later row can count. So
    the rows are matched against at most ``k`` keys per column by equality.
    """
    early = first_k_per_group(freq, ["column"], k, ["first_idx"])
    w = Window.partitionBy("column")
    early = early.select("column", "key", F.when(F.count(F.lit(1)).over(w) == k,
                                                 F.max("first_idx").over(w)).alias("upto"))
    rows = text_rows(df, columns, row_idx)
    hits = rows.withColumn("key", value_key(F.col("value"))).join(F.broadcast(early), ["column", "key"]).filter(
        F.col("upto").isNull() | (F.col("row_idx") <= F.col("upto")))
    return first_k_per_group(hits.select("column", "row_idx", "value"), ["column"], k, ["row_idx"])


def outliers(df: DataFrame, freq: DataFrame, stats: DataFrame, columns: Sequence[str],
             k: int = K.OUTLIERS_KEPT, row_idx: str = ROW_IDX) -> DataFrame:
    """First ``k`` rows whose number is beyond the bounds, in row order. Of ``columns`` the numeric ones would do."""
    spread = F.col("p95") - F.col("min")
    outside = (F.col("num") > F.col("p95") + spread * K.OUTLIER_ABOVE) | (
        F.col("num") < F.col("min") - spread * K.OUTLIER_BELOW)
    # ``stats`` has one row per column: a proven size.
    odd = freq.filter("live AND num IS NOT NULL").join(
        F.broadcast(stats.select("column", "min", "p95")), "column").filter(outside)
    return first_rows_of(df, odd, k, columns, row_idx)


def samples(df: DataFrame, columns: Sequence[str], k: int = K.SAMPLES_KEPT,
            row_idx: str = ROW_IDX) -> DataFrame:
    """First ``k`` live values per column in row order: ``column, row_idx, value, rn``."""
    return first_k_values(df, columns, lambda v: ~is_nullish(v), k, row_idx)


def _ordered_list(rows: DataFrame, item: Column, name: str) -> DataFrame:
    """At most k rows per column folded into one array in rank order."""
    packed = rows.groupBy("column").agg(F.array_sort(F.collect_list(F.struct("rn", item.alias("x")))).alias("l"))
    return packed.select("column", F.transform("l", lambda s: s["x"]).alias(name))


def profile(df: DataFrame, columns: Sequence[str] | None = None, row_idx: str = ROW_IDX) -> DataFrame:
    """A10: the deep profile, one row per column in header order."""
    columns = list(columns or [c for c in df.columns if c != row_idx])
    freq = hold(frequency_table(df, columns, row_idx))
    stats = hold(numeric_stats(freq))
    numeric = {r["column"] for r in stats.select("column").collect()}  # one row a column
    odd = outliers(df, freq, stats, [c for c in columns if c in numeric] or columns, row_idx=row_idx)
    top = top_values(freq)
    # At most ten values a column: the texts behind the digests among them are read at their first rows.
    named = value_texts(df, top.filter("long").select("column", "rn", "first_idx"), columns, row_idx).select(
        "column", "rn", js_trim(F.col("value")).alias("text"))
    top = top.join(named, ["column", "rn"], "left").withColumn("tkey", F.coalesce("text", "tkey"))
    header = F.create_map(*[F.lit(x) for i, c in enumerate(columns) for x in (c, i)])
    top_item = F.struct(F.col("tkey").alias("value"), "count", "pct")
    return (
        basic_stats(freq).drop("live_count", "numeric_count")
        .join(_ordered_list(samples(df, columns, row_idx=row_idx), F.col("value"), "samples"), "column", "left")
        .join(stats.select("column", F.struct("min", "max", "mean", "median", "p95").alias("numeric_stats")),
              "column", "left")
        .join(_ordered_list(top, top_item, "top_values"), "column", "left")
        .join(_ordered_list(odd, F.col("value"), "outliers"), "column", "left")
        .withColumn("samples", F.coalesce("samples", F.array().cast("array<string>")))
        .orderBy(F.element_at(header, F.col("column"))))


def profile_simple(df: DataFrame, columns: Sequence[str] | None = None, row_idx: str = ROW_IDX) -> DataFrame:
    """A1: name, kind, share of NULL or '', distinct count, first three values."""
    columns = list(columns or [c for c in df.columns if c != row_idx])
    types = {f.name: f.dataType for f in df.schema.fields}
    entries = F.array(*[
        F.struct(F.lit(c).alias("column"), uniqueness_key(quoted(c), types[c]).alias("key"),
                 _empty(quoted(c), types[c]).alias("empty"), value_kind(quoted(c), types[c]).alias("kind"))
        for c in columns])
    counted = df.select(F.inline(entries)).groupBy("column", "key", "empty", "kind").agg(
        F.count(F.lit(1)).alias("cnt"))
    per_key = counted.groupBy("column", "key").agg(
        F.sum("cnt").alias("cnt"), F.sum(F.when(F.col("empty"), F.col("cnt")).otherwise(0)).alias("empties"),
        *[F.max(F.when(~F.col("empty"), F.col("kind") == k)).alias(f"k_{k}") for k in _KINDS])
    per_column = per_key.groupBy("column").agg(
        F.sum("cnt").alias("rows"), F.sum("empties").alias("empties"),
        F.count(F.lit(1)).alias("unique_count"), *[F.max(f"k_{k}").alias(f"k_{k}") for k in _KINDS])
    seen = F.array_compact(F.array(*[F.when(F.col(f"k_{k}"), F.lit(k)) for k in _KINDS]))
    inferred = (F.when(F.size(seen) == 0, "null").when(F.size(seen) == 1, F.element_at(seen, 1))
                .when(F.array_contains(seen, "string"), "string")
                .when(F.array_contains(seen, "number"), "number").otherwise("unknown"))
    sample_tests = {c: (uniqueness_key(quoted(c), types[c]), ~_empty(quoted(c), types[c])) for c in columns}
    sample = first_k_matching(df, sample_tests, K.SIMPLE_SAMPLES_KEPT, row_idx).withColumnRenamed("tag", "column")
    return per_column.select(
        "column", inferred.alias("inferred_type"), (F.col("empties") / F.col("rows")).alias("null_pct"),
        "unique_count").join(_ordered_list(sample, F.col("value"), "sample"), "column", "left").withColumn(
        "sample", F.coalesce("sample", F.array().cast("array<string>")))


_KINDS = ("string", "number", "boolean", "array", "object")


def _empty(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return is_empty_like(c)
    if isinstance(dtype, T.VariantType):
        return c.isNull() | F.coalesce(F.is_variant_null(c), F.lit(False)) | F.coalesce(
            F.to_json(c) == '""', F.lit(False))
    return c.isNull()
