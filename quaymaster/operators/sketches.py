"""A profile that merges: states per column that are stored and added up.

``column_states`` reads rows once, without a shuffle of values: counts, lengths, extremes, pattern flags and type counts are exact,
distinct values, quantiles and frequent values are sketches. A day's file is profiled alone and its states, one small row per
column, are kept with it; ``merge_states`` of many days is the state of all their rows, and
``profile_of_states`` reads a profile off it.

With the usual sizes distinct counts have a relative standard error of about 1.6 % (``lg_k`` 12; each step more divides it by
1.4), quantiles a rank error of about 1.3 % (``quantile_k`` 200), and a value's count is short by at most
rows / ``tracked`` (with fewer different values than that, all counts are exact).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quaymaster import constants as K
from quaymaster.functions.text import is_nullish, js_trim
from quaymaster.operators.mapping import ROW_IDX
from quaymaster.operators.profile import _BITS, _PATTERN_NAMES, _TYPE_NAMES, _features, _flag, value_key
from quaymaster.operators.topk import text_rows

_SUMS = ("total_count", "live_count", "numeric_count", "numeric_sum", "s_json", *[f"s_{n}" for n in _TYPE_NAMES])
_EXTREMES = (("min_length", F.min), ("max_length", F.max), ("min", F.min), ("max", F.max))


def column_states(df: DataFrame, columns: Sequence[str] | None = None, row_idx: str = ROW_IDX, lg_k: int = 12,
                  quantile_k: int = 200, tracked: int = 1_000) -> DataFrame:
    """One row per column: exact sums and extremes and the sketches. Columns without rows have no state."""
    columns = list(columns or [c for c in df.columns if c != row_idx])
    if row_idx not in df.columns:
        df = df.withColumn(row_idx, F.lit(0))
    value = F.col("value")
    rows = text_rows(df, columns, row_idx).select("column", value_key(js_trim(value)).alias("key"), (~is_nullish(value)).alias("live"), *_features(value))
    live, number = F.col("live"), F.when(F.col("live"), F.col("num"))
    flagged = lambda name: F.count_if(live & _flag(name))
    return rows.groupBy("column").agg(
        F.count(F.lit(1)).alias("total_count"), F.count_if(live).alias("live_count"), F.count(number).alias("numeric_count"), F.sum(number).alias("numeric_sum"),
        flagged(f"pattern:{K.JSON_PATTERN}").alias("s_json"), *[flagged(f"type:{n}").alias(f"s_{n}") for n in _TYPE_NAMES],
        F.min(F.when(live, F.col("len"))).alias("min_length"), F.max(F.when(live, F.col("len"))).alias("max_length"),
        F.min(number).alias("min"), F.max(number).alias("max"), F.expr("bit_or(CASE WHEN live THEN flags ELSE 0 END)").alias("flags"),
        F.hll_sketch_agg(F.when(live, F.col("key")), F.lit(lg_k)).alias("distinct_sketch"),
        F.kll_sketch_agg_double(number, F.lit(quantile_k)).alias("quantile_sketch"),
        F.expr(f"approx_top_k_accumulate(CASE WHEN live THEN key END, {tracked})").alias("top_sketch"))


def merge_states(states: DataFrame) -> DataFrame:
    """The states of all rows from those of their parts; merging merged states is the same as merging at once."""
    return states.groupBy("column").agg(
        *[F.sum(c).alias(c) for c in _SUMS], *[f(c).alias(c) for c, f in _EXTREMES], F.expr("bit_or(flags)").alias("flags"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"),
        F.expr("approx_top_k_combine(top_sketch)").alias("top_sketch"))


def profile_of_states(states: DataFrame, top: int = K.TOP_VALUES) -> DataFrame:
    """``column, inferred_type, null_rate, total_count, min_length, max_length, patterns, numeric_stats``, all exact but ``median`` and
    ``p95`` of the last, then ``approx_unique_count`` and ``approx_top_values`` (value, count)."""
    live, n = F.col("live_count"), F.col("numeric_count")
    inferred = F.when(live == 0, "unknown")
    for name in ["json", *_TYPE_NAMES]:
        inferred = inferred.when(F.col(f"s_{name}") >= K.TYPE_SHARE * live, name)
    patterns = F.array_compact(F.array(*[F.when(_flag(f"pattern:{p}"), F.lit(p)) for p in _PATTERN_NAMES]))
    numeric = F.struct("min", "max", (F.col("numeric_sum") / n).alias("mean"), _quantile(0.5).alias("median"), _quantile(K.P95).alias("p95"))
    return states.select(
        "column", inferred.otherwise("string").alias("inferred_type"),
        F.coalesce(F.try_divide(F.col("total_count") - live, F.col("total_count")), F.lit(1.0)).alias("null_rate"), "total_count",
        F.coalesce("min_length", F.lit(0)).alias("min_length"), F.coalesce("max_length", F.lit(0)).alias("max_length"),
        F.when(live == 0, F.array(F.lit(K.ALL_NULL_PATTERN))).otherwise(patterns).alias("patterns"),
        F.when((n > 0) & (n >= K.NUMERIC_SHARE * live), numeric).alias("numeric_stats"),
        F.when(live > 0, F.hll_sketch_estimate("distinct_sketch")).otherwise(0).alias("approx_unique_count"),
        # The sketch counts missing values too; they are no value.
        F.expr(f"slice(filter(transform(approx_top_k_estimate(top_sketch, {top + 1}), x -> struct(x.item AS value, x.count AS count)), x -> x.value IS NOT NULL), 1, {top})")
        .alias("approx_top_values"))


def _quantile(share: float) -> Column:
    return F.when(F.col("numeric_count") > 0, F.kll_sketch_get_quantile_double(F.when(F.col("numeric_count") > 0, F.col("quantile_sketch")), F.lit(share)))
