"""Mapping, transforms and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaymaster.model import Mapping, MappingHints, MappingRule, Transform
from quaymaster.operators.errors import error_count, has_errors
from quaymaster.operators.mapping import (
    apply_mapping, apply_transforms, dropped_keys, retain_target, split_empty_rows,
)
from quaymaster.operators.validate import (
    failure_summary, split_valid, validate_output,
)
from workload import expected as K
from workload.inputs import (
    DIRTY_ORDERS_SQL as DIRTY, ORDERS_MAPPING, ORDERS_TARGET, indexed_orders, table,
)
from workload.registry import day, nullish, prefix, query, strip_currency, t, words

c = F.col

# Prefix-parse coercion of the four columns, with the raw text beside each value.
_INT = prefix(t("cust_txt"), K.INTEGER_PREFIX, "bigint")
_NUM = prefix(t("price_txt"), K.NUMBER_PREFIX, "double")
_BOOL = (f"CASE WHEN lower({t('flag_txt')}) IN {words(K.TRUE_WORDS)} THEN true "
         f"WHEN lower({t('flag_txt')}) IN {words(K.FALSE_WORDS)} THEN false END")
COERCED = f"""SELECT k AS row_idx, cust_txt, price_txt, date_txt, flag_txt, {_INT} AS customer_id,
 {_NUM} AS price, {day('date_txt')} AS order_date, {_BOOL} AS active FROM ({DIRTY}) d"""
_FAILS = [("customer_id", "cust_txt", "integer"), ("price", "price_txt", "number"),
          ("order_date", "date_txt", "date"), ("active", "flag_txt", "boolean")]
BAD = {tgt: f"({tgt} IS NULL AND coalesce({src}, '') <> '')" for tgt, src, _ in _FAILS}


@query("q_apply_mapping", f"""
SELECT row_idx, customer_id, price, order_date, active,
 {' + '.join(f'cast({b} AS bigint)' for b in BAD.values())} AS n_errors FROM ({COERCED}) m""")
def q_apply_mapping(spark, sf):
    rows = apply_mapping(indexed_orders(spark, sf), ORDERS_MAPPING, ORDERS_TARGET)
    return rows.select("row_idx", "customer_id", "price",
                       F.date_format("order_date", "yyyy-MM-dd").alias("order_date"), "active",
                       error_count().alias("n_errors"))


@query("q_coercion_warnings", " UNION ALL ".join(f"""
SELECT row_idx, '{tgt}' AS "column", 'bad_cast' AS code, {src} AS "input", 'Row ' || (row_idx + 1)
 || ', column {tgt}: Cannot cast ' || {src} || ' to {kind}' AS message FROM ({COERCED}) m WHERE {BAD[tgt]}"""
                                                for tgt, src, kind in _FAILS))
def q_coercion_warnings(spark, sf):
    rows = apply_mapping(indexed_orders(spark, sf), ORDERS_MAPPING, ORDERS_TARGET)
    return rows.filter(has_errors()).select("row_idx", F.inline("errors"))


@query("q_mapping_hints", f"""
SELECT row_idx, customer_id, CASE WHEN price_txt <> '' THEN price_txt END AS order_date_text FROM (
 SELECT *, price_txt AS order_date_txt FROM ({COERCED}) m) x""")
def q_mapping_hints(spark, sf):
    """Rename override wins the target before de-duplication; a coercion is forced."""
    df = indexed_orders(spark, sf)
    hints = MappingHints(exclude=("flag_txt",), rename={"price_txt": "order_date"},
                         force={"price_txt": "string"})
    mapping = ORDERS_MAPPING.resolve([x for x in df.columns if x != "row_idx"], ORDERS_TARGET, hints)
    rows = apply_mapping(df, mapping, ORDERS_TARGET)
    return rows.select("row_idx", "customer_id", c("order_date").alias("order_date_text"))


@query("q_enabled_excluded", f"SELECT row_idx, customer_id FROM ({COERCED}) m")
def q_enabled_excluded(spark, sf):
    rows = apply_mapping(indexed_orders(spark, sf), ORDERS_MAPPING, ORDERS_TARGET,
                         enabled=[("cust_txt", "customer_id"), ("flag_txt", "active")], exclude=("active",))
    return retain_target(rows, ORDERS_TARGET).drop("errors")


SPECS = (
    Transform.named("cust_txt", "customer_id", "to_integer"),
    Transform.named("price_txt", "price", "to_number"),
    Transform.strict("date_txt", "order_date", "date"),
    Transform.named("flag_txt", "active", "to_boolean"),
)
_CLEAN_INT = (f"CASE WHEN NOT {nullish('cust_txt', K.CLEAN_NULLS)} THEN "
              f"{prefix(strip_currency(t('cust_txt')), K.INTEGER_PREFIX, 'bigint')} END")
CLEAN_NUM = (f"CASE WHEN NOT {nullish('price_txt', K.CLEAN_NULLS)} THEN "
             f"{prefix(strip_currency(t('price_txt')), K.NUMBER_PREFIX, 'double')} END")
_CLEAN_BOOL = (f"CASE WHEN NOT {nullish('flag_txt', K.CLEAN_BOOLEAN_NULLS)} THEN "
               f"lower({t('flag_txt')}) IN {words(K.CLEAN_TRUE_WORDS)} END")
TRANSFORMED = f"""SELECT k AS row_idx, cust_txt, price_txt, date_txt, {_CLEAN_INT} AS customer_id,
 {CLEAN_NUM} AS price, {day('date_txt')} AS order_date, {_CLEAN_BOOL} AS active FROM ({DIRTY}) d"""


@query("q_apply_transforms", f"""
SELECT row_idx, customer_id, price, order_date, active, cast(0 AS bigint) AS n_errors FROM ({TRANSFORMED}) x""")
def q_apply_transforms(spark, sf):
    rows = apply_transforms(indexed_orders(spark, sf), SPECS)
    return rows.select("row_idx", "customer_id", "price",
                       F.date_format("order_date", "yyyy-MM-dd").alias("order_date"), "active",
                       error_count().alias("n_errors"))


@query("q_custom_transform", f"""
SELECT row_idx, CASE WHEN NOT {nullish('price_txt', K.TRANSFORM_NULLS)}
   THEN upper({t('price_txt')}) || '!' END AS price_tag,
 CASE WHEN NOT {nullish('cust_txt', K.TRANSFORM_NULLS)} THEN length({t('cust_txt')}) END AS cust_len
FROM ({TRANSFORMED}) x""")
def q_custom_transform(spark, sf):
    specs = (Transform.sql("price_txt", "price_tag", "upper(value) || '!'"),
             Transform.of("cust_txt", "cust_len", lambda v: F.length(v).cast("bigint")))
    return apply_transforms(indexed_orders(spark, sf), specs).drop("errors")


@query("q_throwing_transform", f"""
SELECT row_idx, CASE WHEN NOT {nullish('price_txt', K.TRANSFORM_NULLS)} AND regexp_matches({t('price_txt')}, '^[0-9]+$') THEN cast({t('price_txt')} AS bigint) END AS whole,
 CASE WHEN NOT {nullish('price_txt', K.TRANSFORM_NULLS)} AND NOT regexp_matches({t('price_txt')}, '^[0-9]+$') THEN {t('price_txt')} END AS failed_input
FROM ({TRANSFORMED}) x""")
def q_throwing_transform(spark, sf):
    """A cast that fails is recorded with its input and does not stop the job."""
    rows = apply_transforms(indexed_orders(spark, sf), [Transform.sql("price_txt", "whole", "cast(value AS bigint)", null_fails=True)])
    return rows.select("row_idx", "whole", F.get("errors", F.lit(0))["input"].alias("failed_input"))


# Violations of the validated output: NULL into required columns, thrown dates.
VIOLATIONS = f"""
SELECT row_idx, 'customer_id' AS "column", 'not_null' AS code, coalesce(cust_txt, '') AS "input"
 FROM ({TRANSFORMED}) x WHERE customer_id IS NULL
UNION ALL SELECT row_idx, 'price', 'not_null', {t('price_txt')} FROM ({TRANSFORMED}) x WHERE price IS NULL
UNION ALL SELECT row_idx, 'order_date', 'bad_cast', {t('date_txt')} FROM ({TRANSFORMED}) x
 WHERE order_date IS NULL AND {t('date_txt')} <> ''"""
_TOTAL = "(SELECT count(*) FROM orders)"


def _validation(spark, sf):
    return validate_output(indexed_orders(spark, sf), SPECS, ORDERS_TARGET)


@query("q_failures_by_column", f"""
SELECT "column", count(*) AS failures, {_TOTAL} AS total_rows, round(count(*) / {_TOTAL}, 6) AS rate
FROM ({VIOLATIONS}) v GROUP BY "column" """)
def q_failures_by_column(spark, sf):
    return _validation(spark, sf).failures.select(
        "column", "failures", "total_rows", F.round("rate", 6).alias("rate"))


@query("q_failure_examples", f"""
SELECT "column", rn, row_idx, code, "input" FROM (
 SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY row_idx) AS rn FROM ({VIOLATIONS}) v) r
WHERE rn <= 5""")
def q_failure_examples(spark, sf):
    ex = _validation(spark, sf).failures.select("column", F.inline("examples"))
    return ex.select("column", c("rn").cast("bigint").alias("rn"), "row_idx", "code", "input")


@query("q_passed_rows", f"""
SELECT {_TOTAL} AS total_rows, {_TOTAL} - bad AS passed_rows,
 round(({_TOTAL} - bad) / {_TOTAL}, 6) AS pass_rate,
 (SELECT max(n) FROM (SELECT count(*) AS n FROM ({VIOLATIONS}) v GROUP BY "column")) / {_TOTAL} <= 0.05 AS success
FROM (SELECT count(DISTINCT row_idx) AS bad FROM ({VIOLATIONS}) v) b""")
def q_passed_rows(spark, sf):
    s = _validation(spark, sf).summary
    return s.select("total_rows", "passed_rows", F.round("pass_rate", 6).alias("pass_rate"), "success")


@query("q_failure_summary", f"""
SELECT "column", count(*) AS failures, cast(3 AS bigint) AS shown FROM ({VIOLATIONS}) v GROUP BY "column"
HAVING count(*) / {_TOTAL} > 0.10""")
def q_failure_summary(spark, sf):
    return failure_summary(_validation(spark, sf).failures, min_rate=0.10).select(
        "column", "failures", F.size("examples").cast("bigint").alias("shown"))


@query("q_split_valid", f"""
SELECT row_idx, row_idx NOT IN (SELECT row_idx FROM ({VIOLATIONS}) v) AS good FROM ({TRANSFORMED}) x""")
def q_split_valid(spark, sf):
    good, bad = split_valid(_validation(spark, sf).rows)
    return good.select("row_idx", F.lit(True).alias("good")).unionByName(
        bad.select("row_idx", F.lit(False).alias("good")))


# JSON rows whose keys differ from row to row.
_JSON_ROW = ("CASE event_id%4 WHEN 0 THEN '{{\"id\":'||cast(event_id AS {0})||',\"kind\":\"'||event_type||'\"}}' "
             "WHEN 1 THEN '{{\"id\":'||cast(event_id AS {0})||'}}' WHEN 2 THEN '{{\"other\":1,\"kind2\":null}}' "
             "ELSE props END")
_KEYED = Mapping((MappingRule("id", "customer_id"), MappingRule("kind", "active")))


def _json_rows(spark, sf):
    e = table(spark, sf, "events").selectExpr("event_id AS row_idx", f"{_JSON_ROW.format('string')} AS j")
    return e.select("row_idx", F.json_object_keys("j").alias("_keys"),
                    F.from_json("j", "id string, kind string").alias("s")).select("row_idx", "_keys", "s.*")


@query("q_empty_rows", """
SELECT event_id AS row_idx, event_id%4 IN (0, 1) AS kept FROM events""")
def q_empty_rows(spark, sf):
    kept, empty = split_empty_rows(_json_rows(spark, sf), _KEYED)
    return kept.select("row_idx", F.lit(True).alias("kept")).unionByName(
        empty.select("row_idx", F.lit(False).alias("kept")))


@query("q_dropped_keys", f"""
SELECT DISTINCT key AS "column" FROM (SELECT unnest(json_keys(j)) AS key
 FROM (SELECT {_JSON_ROW.format('varchar')} AS j FROM events) a) b WHERE key NOT IN ('id', 'kind')""")
def q_dropped_keys(spark, sf):
    return dropped_keys(_json_rows(spark, sf), _KEYED)
