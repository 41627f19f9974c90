"""Profiling."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from quaymaster import functions as fn
from quaymaster.operators import profile as prof
from quaymaster.operators.keys import candidate_keys
from quaymaster.operators.sketches import column_states, merge_states, profile_of_states
from quaymaster.operators.topk import first_k_per_group
from quaymaster.session import small_frame
from workload import expected as K
from workload.inputs import (
    DIRTY_ORDERS_SQL as DIRTY, MESSY_EVENTS_SQL as EVENTS, indexed_orders, messy_events, table,
)
from workload.registry import extract_number, match, nullish, query, t

c = F.col

ORDER_COLUMNS = ["price_txt", "date_txt", "flag_txt", "cust_txt"]
EVENT_COLUMNS = ["event_type", "uuid_txt", "email_txt", "ts_txt", "phone_txt", "money_txt", "num_txt",
                 "epoch_txt", "props", "note_txt"]


def long_sql(source: str, columns, idx: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT {idx} AS row_idx, '{x}' AS "column", coalesce({x}, '') AS value FROM ({source}) s"""
        for x in columns)


LONG_ORDERS = long_sql(DIRTY, ORDER_COLUMNS, "k")
LONG_EVENTS = long_sql(EVENTS, EVENT_COLUMNS, "event_id")
DOCS = "SELECT doc_id AS row_idx, text, lang, source FROM documents"
LONG_DOCS = long_sql(DOCS, ["text", "lang", "source"], "row_idx")
LIVE = f"(NOT {nullish('value')})"


def _docs(spark, sf):
    docs = table(spark, sf, "documents").select(c("doc_id").alias("row_idx"), "text", "lang", "source")
    return docs


def _freq(spark, sf, which="orders"):
    if which == "orders":
        return prof.frequency_table(indexed_orders(spark, sf), ORDER_COLUMNS)
    if which == "docs":
        return prof.frequency_table(_docs(spark, sf), ["text", "lang", "source"])
    return prof.frequency_table(messy_events(spark, sf), EVENT_COLUMNS)


def _basic_sql(long: str) -> str:
    return f"""
SELECT "column", round(avg(CASE WHEN {LIVE} THEN 0.0 ELSE 1.0 END), 6) AS null_rate,
 count(DISTINCT CASE WHEN {LIVE} THEN value END) AS unique_count, count(*) AS total_count,
 coalesce(min(CASE WHEN {LIVE} THEN length(value) END), 0) AS min_length,
 coalesce(max(CASE WHEN {LIVE} THEN length(value) END), 0) AS max_length,
 bool_or({LIVE} AND {match('value', r'^0[0-9]+$')}) AS has_leading_zeros,
 bool_or({LIVE} AND {match('value', K.SPECIAL_CHAR)}) AS has_special_chars
FROM ({long}) l GROUP BY "column" """


def _basic(freq):
    return prof.basic_stats(freq).select(
        "column", F.round("null_rate", 6).alias("null_rate"), "unique_count", "total_count",
        c("min_length").cast("bigint").alias("min_length"), c("max_length").cast("bigint").alias("max_length"),
        "has_leading_zeros", "has_special_chars")


@query("q_profile_basic", _basic_sql(LONG_ORDERS))
def q_profile_basic(spark, sf):
    return _basic(_freq(spark, sf))


@query("q_profile_long_text", _basic_sql(LONG_DOCS))
def q_profile_long_text(spark, sf):
    """Long text is keyed by digest and still counted exactly."""
    return _basic(_freq(spark, sf, "docs"))


_IS_JSON = f"({t('value')} LIKE '{{%' OR {t('value')} LIKE '[%') AND json_valid(value)"


def _types_sql(long: str) -> str:
    shares = ", ".join(f"sum(cast({match('tv', p)} AS int)) AS s_{n}" for n, p in K.TYPE_TESTS)
    chain = " ".join(f"WHEN s_{n} >= 0.8 * live THEN '{n}'" for n in ["json"] + [n for n, _ in K.TYPE_TESTS])
    return f"""
SELECT "column", CASE WHEN live = 0 THEN 'unknown' {chain} ELSE 'string' END AS inferred_type FROM (
 SELECT "column", count(*) AS live, sum(cast({_IS_JSON} AS int)) AS s_json, {shares}
 FROM (SELECT *, {t('value')} AS tv FROM ({long}) l WHERE {LIVE}) v GROUP BY "column") a"""


@query("q_infer_type", _types_sql(LONG_EVENTS))
def q_infer_type(spark, sf):
    return prof.basic_stats(_freq(spark, sf, "events")).select("column", "inferred_type")


def _patterns_sql(long: str) -> str:
    flags = [match("value", p) for _, p in K.REGEX_PATTERNS] + [
        "length(value) > 200", "contains(value, chr(10))", _IS_JSON]
    names = [n for n, _ in K.REGEX_PATTERNS] + ["long-text", "multiline", "json-content"]
    parts = ", ".join(f"CASE WHEN bool_or({f}) THEN '{n}' END" for n, f in zip(names, flags))
    return f"""SELECT "column", concat_ws('|', {parts}) AS patterns
 FROM (SELECT * FROM ({long}) l WHERE {LIVE}) v GROUP BY "column" """


@query("q_patterns", _patterns_sql(LONG_EVENTS) + " UNION ALL " + _patterns_sql(LONG_ORDERS)
       + " UNION ALL " + _patterns_sql(LONG_DOCS))
def q_patterns(spark, sf):
    parts = [prof.basic_stats(_freq(spark, sf, w)) for w in ("events", "orders", "docs")]
    return parts[0].union(parts[1]).union(parts[2]).select(
        "column", F.array_join("patterns", "|").alias("patterns"))


def _numbers_sql(long: str) -> str:
    return f"""SELECT "column", row_idx, value, num, count(*) OVER (PARTITION BY "column") AS live
 FROM (SELECT *, {extract_number('value')} AS num FROM ({long}) l WHERE {LIVE}) v"""


def _stats_sql(long: str) -> str:
    return f"""
SELECT "column", min(num) AS min, max(num) AS max, floor(avg(num)*100+0.5)/100 AS mean,
 floor((max(CASE WHEN rn = (n-1)//2 THEN num END) + max(CASE WHEN rn = n//2 THEN num END))/2*100+0.5)/100 AS median,
 max(CASE WHEN rn = least(cast(floor(n*0.95) AS bigint), n-1) THEN num END) AS p95
FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY num) - 1 AS rn,
  count(*) OVER (PARTITION BY "column") AS n FROM ({_numbers_sql(long)}) a WHERE num IS NOT NULL) b
GROUP BY "column", live, n HAVING n >= 0.6 * live"""


@query("q_numeric_stats", _stats_sql(LONG_ORDERS) + " UNION ALL " + _stats_sql(LONG_EVENTS))
def q_numeric_stats(spark, sf):
    sources = ((indexed_orders(spark, sf), ORDER_COLUMNS), (messy_events(spark, sf), EVENT_COLUMNS))
    parts = [prof.numeric_stats(prof.number_table(df, prof.numeric_columns(df, columns)).persist()) for df, columns in sources]
    return parts[0].union(parts[1])


def _top_sql(long: str) -> str:
    return f"""
SELECT "column", rn, tkey, cnt AS "count", floor(cnt*1000/live+0.5)/10 AS pct FROM (
 SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY cnt DESC, f) AS rn,
  sum(cnt) OVER (PARTITION BY "column") AS live, count(*) OVER (PARTITION BY "column") AS distinct_n,
  max(cnt) OVER (PARTITION BY "column") AS top FROM (
   SELECT "column", {t('value')} AS tkey, count(*) AS cnt, min(row_idx) AS f
   FROM ({long}) l WHERE {LIVE} GROUP BY 1, 2) g) r
WHERE rn <= 10 AND (distinct_n <= 50 OR top / live >= 0.1)"""


@query("q_top_values", _top_sql(LONG_ORDERS) + " UNION ALL " + _top_sql(LONG_EVENTS))
def q_top_values(spark, sf):
    parts = [prof.top_values(_freq(spark, sf, w)) for w in ("orders", "events")]
    return parts[0].union(parts[1]).select(
        "column", c("rn").cast("bigint").alias("rn"), "tkey", "count", "pct")


def _outliers_sql(long: str) -> str:
    return f"""
SELECT "column", rn, row_idx, value FROM (
 SELECT x."column", row_idx, value, row_number() OVER (PARTITION BY x."column" ORDER BY row_idx) AS rn
 FROM ({_numbers_sql(long)}) x JOIN ({_stats_sql(long)}) s ON x."column" = s."column"
 WHERE num > p95 + (p95 - min) * 1.5 OR num < min - (p95 - min) * 0.5) r WHERE rn <= 5"""


@query("q_outliers", _outliers_sql(LONG_EVENTS))
def q_outliers(spark, sf):
    df = messy_events(spark, sf)
    numeric = prof.numeric_columns(df, EVENT_COLUMNS)
    freq = prof.number_table(df, numeric).persist()
    odd = prof.outliers(df, freq, prof.numeric_stats(freq), numeric or EVENT_COLUMNS)
    return odd.select("column", c("rn").cast("bigint").alias("rn"), "row_idx", "value")


@query("q_samples", f"""
SELECT "column", rn, row_idx, value FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY row_idx) AS rn
 FROM ({LONG_ORDERS}) l WHERE {LIVE}) r WHERE rn <= 5""")
def q_samples(spark, sf):
    return prof.samples(indexed_orders(spark, sf), ORDER_COLUMNS).select(
        "column", c("rn").cast("bigint").alias("rn"), "row_idx", "value")


def _list_sql(inner: str, item: str, name: str) -> str:
    return f"""SELECT "column", string_agg({item}, '|' ORDER BY rn) AS {name} FROM ({inner}) z GROUP BY "column" """


_SAMPLES_SQL = f"""SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY row_idx) AS rn
 FROM ({LONG_DOCS}) l WHERE {LIVE}"""


def _full_sql(long: str) -> str:
    ranked = f"""SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY row_idx) AS rn
 FROM ({long}) l WHERE {LIVE}"""
    return f"""
SELECT b."column", b.null_rate, b.unique_count, b.min_length, b.max_length, ty.inferred_type, p.patterns,
 s.samples, tv.tops, st.median, st.p95, o.odd
FROM ({_basic_sql(long)}) b
LEFT JOIN ({_types_sql(long)}) ty ON b."column" = ty."column"
LEFT JOIN ({_patterns_sql(long)}) p ON b."column" = p."column"
LEFT JOIN ({_list_sql(f'SELECT * FROM ({ranked}) q WHERE rn <= 5', 'value', 'samples')}) s ON b."column" = s."column"
LEFT JOIN ({_list_sql(_top_sql(long), """tkey || '=' || cast("count" AS varchar)""", 'tops')}) tv ON b."column" = tv."column"
LEFT JOIN ({_stats_sql(long)}) st ON b."column" = st."column"
LEFT JOIN ({_list_sql(_outliers_sql(long), 'value', 'odd')}) o ON b."column" = o."column" """


def _flat_profile(p):
    return p.select(
        "column", F.round("null_rate", 6).alias("null_rate"), "unique_count",
        c("min_length").cast("bigint").alias("min_length"), c("max_length").cast("bigint").alias("max_length"),
        "inferred_type", F.array_join("patterns", "|").alias("patterns"),
        F.array_join("samples", "|").alias("samples"),
        F.when(c("top_values").isNotNull(), F.array_join(F.transform(
            "top_values", lambda x: F.concat(x["value"], F.lit("="), x["count"].cast("string"))), "|")).alias("tops"),
        c("numeric_stats.median").alias("median"), c("numeric_stats.p95").alias("p95"),
        F.when(c("outliers").isNotNull(), F.array_join("outliers", "|")).alias("odd"))


@query("q_profile", _full_sql(LONG_EVENTS))
def q_profile(spark, sf):
    return _flat_profile(prof.profile(messy_events(spark, sf), EVENT_COLUMNS))


@query("q_profile_documents", _full_sql(LONG_DOCS))
def q_profile_documents(spark, sf):
    return _flat_profile(prof.profile(_docs(spark, sf)))


@query("q_profile_simple", f"""
SELECT b."column", b.inferred_type, b.null_pct, b.unique_count, s.sample FROM (
 SELECT "column", CASE WHEN count(CASE WHEN value <> '' THEN 1 END) = 0 THEN 'null' ELSE 'string' END AS inferred_type,
  round(avg(CASE WHEN coalesce(value, '') = '' THEN 1.0 ELSE 0.0 END), 6) AS null_pct,
  count(DISTINCT coalesce(value, 'null')) AS unique_count FROM (
   {" UNION ALL ".join(f"SELECT k AS row_idx, '{x}' AS {chr(34)}column{chr(34)}, {x} AS value FROM ({DIRTY}) d" for x in ORDER_COLUMNS)}
  ) l GROUP BY "column") b
LEFT JOIN ({_list_sql(f'''SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY row_idx) AS rn
 FROM ({LONG_ORDERS}) l WHERE value <> '') q WHERE rn <= 3''', 'value', 'sample')}) s ON b."column" = s."column" """)
def q_profile_simple(spark, sf):
    p = prof.profile_simple(indexed_orders(spark, sf), ORDER_COLUMNS)
    return p.select("column", "inferred_type", F.round("null_pct", 6).alias("null_pct"), "unique_count",
                    F.array_join("sample", "|").alias("sample"))


@query("q_first_k", """
SELECT o_custkey, o_orderkey, rn FROM (
 SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) r
WHERE rn <= 3""")
def q_first_k(spark, sf):
    df = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return first_k_per_group(df, ["o_custkey"], 3, ["o_orderkey"]).withColumn("rn", c("rn").cast("bigint"))


_MERGED = ("props", "email_txt", "money_txt", "num_txt")


def _merged_sql(x: str) -> str:
    live, number = f"NOT {nullish(x)}", extract_number(x)
    gate = f"count(CASE WHEN {live} THEN {number} END) >= 0.6 * count(CASE WHEN {live} THEN 1 END) AND count(CASE WHEN {live} THEN {number} END) > 0"
    return f"""SELECT '{x}' AS "column", round(1 - count(CASE WHEN {live} THEN 1 END) / count(*), 6) AS null_rate, count(*) AS total_count,
 min(CASE WHEN {live} THEN length({x}) END) AS min_length, max(CASE WHEN {live} THEN length({x}) END) AS max_length,
 CASE WHEN {gate} THEN min(CASE WHEN {live} THEN {number} END) END AS "min", CASE WHEN {gate} THEN max(CASE WHEN {live} THEN {number} END) END AS "max",
 true AS distinct_near, CASE WHEN {gate} THEN true END AS median_near, true AS top_near FROM ({EVENTS}) e"""


@query("q_merged_profile", " UNION ALL ".join(map(_merged_sql, _MERGED)))
def q_merged_profile(spark, sf):
    """States of three parts of the table, merged: exact figures are exact, sketched ones within their error."""
    df = messy_events(spark, sf).select("row_idx", *_MERGED)
    states = [column_states(df.filter(F.col("row_idx") % 3 == i)) for i in range(3)]
    merged = profile_of_states(merge_states(states[0].union(states[1]).union(states[2])))
    found = {r["column"]: r for r in merged.collect()}  # one row a column
    tests = []
    for x in _MERGED:
        live = ~fn.is_nullish(F.col(x))
        number = F.when(live, fn.extract_number(F.col(x)))
        numeric, first = found[x]["numeric_stats"], found[x]["approx_top_values"][:1]
        exact = F.count_distinct(F.when(live, fn.js_trim(F.col(x))))
        below, upto = [F.avg(test.cast("int")) for test in (number < numeric["median"], number <= numeric["median"])] if numeric else (None, None)
        near = (below <= 0.53) & (upto >= 0.47) if numeric else F.lit(None).cast("boolean")
        seen = F.count_if(live & (fn.js_trim(F.col(x)) == first[0]["value"])) if first else F.lit(0)
        tests.append(F.struct(F.lit(x).alias("column"), (F.abs(exact - found[x]["approx_unique_count"]) <= 0.06 * exact).alias("distinct_near"), near.alias("median_near"),
                              (F.abs(seen - (first[0]["count"] if first else 0)) <= F.count("*") / 1000).alias("top_near")))
    near = df.agg(F.array(*tests).alias("t")).select(F.inline("t"))
    return merged.join(F.broadcast(near), "column").select(
        "column", F.round("null_rate", 6).alias("null_rate"), "total_count", "min_length", "max_length", "numeric_stats.min", "numeric_stats.max",
        "distinct_near", "median_near", "top_near")


# --- candidate keys ----------------------------------------------------------------------------------

_KEY_COLUMNS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")


def _key_sets(size: int):
    return list(combinations(_KEY_COLUMNS, size))


def _unique_sql(columns) -> str:
    listed = ", ".join(columns)
    return f"SELECT '{','.join(columns)}' AS \"key\", {len(columns)} AS size, (SELECT count(*) FROM (SELECT DISTINCT {listed} FROM lineitem) d) = (SELECT count(*) FROM lineitem) AS ok"


@query("q_candidate_keys", f"""
WITH s AS ({' UNION ALL '.join(_unique_sql(x) for n in (1, 2, 3) for x in _key_sets(n))})
SELECT "key", size FROM s a WHERE ok AND NOT EXISTS (SELECT 1 FROM s b WHERE b.ok AND b.size < a.size
 AND len(list_intersect(string_split(a."key", ','), string_split(b."key", ','))) = b.size)""")
def q_candidate_keys(spark, sf):
    """The smallest sets of up to three columns that tell all lines apart, against all 25 sets."""
    found = candidate_keys(table(spark, sf, "lineitem").select(*_KEY_COLUMNS)).keys
    return small_frame(spark, [(",".join(k), len(k)) for k in found], "key string, size int")
