"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from quaymaster import functions as fn
from workload import expected as K
from workload.inputs import DIRTY_ORDERS_SQL as DIRTY, dirty_orders, table
from workload.registry import (
    day, extract_number, iso, match, nullish, prefix, query, strip_currency, t, ts, words,
)

c = F.col


@query("q_null_variants", f"""
SELECT k, {nullish('price_txt')} AS price_null, {nullish('date_txt')} AS date_null,
 {nullish('cust_txt')} AS cust_null,
 CASE WHEN NOT {nullish('date_txt', K.TRANSFORM_NULLS)} THEN date_txt END AS date_live,
 nullif(price_txt, '') AS price_text, coalesce(price_txt, '') = '' AS price_empty,
 coalesce(cust_txt, '') = '' AS cust_empty
FROM ({DIRTY}) d""")
def q_null_variants(spark, sf):
    return dirty_orders(spark, sf).select(
        "k", fn.is_nullish(c("price_txt")).alias("price_null"),
        fn.is_nullish(c("date_txt")).alias("date_null"), fn.is_nullish(c("cust_txt")).alias("cust_null"),
        fn.null_if_variant(c("date_txt")).alias("date_live"), fn.to_text(c("price_txt")).alias("price_text"),
        fn.is_empty_like(c("price_txt")).alias("price_empty"),
        fn.is_empty_like(c("cust_txt")).alias("cust_empty"))


@query("q_to_integer", f"""
SELECT k, {prefix(t('price_txt'), K.INTEGER_PREFIX, 'bigint')} AS price_int,
 {prefix(t('cust_txt'), K.INTEGER_PREFIX, 'bigint')} AS cust_int FROM ({DIRTY}) d""")
def q_to_integer(spark, sf):
    return dirty_orders(spark, sf).select("k", fn.to_integer(c("price_txt")).alias("price_int"),
                                          fn.to_integer(c("cust_txt")).alias("cust_int"))


@query("q_to_number", f"""
SELECT k, {prefix(t('price_txt'), K.NUMBER_PREFIX, 'double')} AS price_num,
 {prefix(t('date_txt'), K.NUMBER_PREFIX, 'double')} AS date_num FROM ({DIRTY}) d""")
def q_to_number(spark, sf):
    return dirty_orders(spark, sf).select("k", fn.to_number(c("price_txt")).alias("price_num"),
                                          fn.to_number(c("date_txt")).alias("date_num"))


@query("q_to_boolean", f"""
SELECT k, CASE WHEN lower({t('flag_txt')}) IN {words(K.TRUE_WORDS)} THEN true
 WHEN lower({t('flag_txt')}) IN {words(K.FALSE_WORDS)} THEN false END AS strict_flag,
 CASE WHEN NOT {nullish('flag_txt', K.CLEAN_BOOLEAN_NULLS)}
  THEN lower({t('flag_txt')}) IN {words(K.CLEAN_TRUE_WORDS)} END AS lenient_flag FROM ({DIRTY}) d""")
def q_to_boolean(spark, sf):
    return dirty_orders(spark, sf).select("k", fn.to_boolean(c("flag_txt")).alias("strict_flag"),
                                          fn.clean_boolean(c("flag_txt")).alias("lenient_flag"))


@query("q_extract_number", f"SELECT k, {extract_number('price_txt')} AS price_num, "
       f"{extract_number('date_txt')} AS date_num FROM ({DIRTY}) d")
def q_extract_number(spark, sf):
    return dirty_orders(spark, sf).select("k", fn.extract_number(c("price_txt")).alias("price_num"),
                                          fn.extract_number(c("date_txt")).alias("date_num"))


@query("q_clean_values", f"""
SELECT k, CASE WHEN NOT {nullish('price_txt', K.CLEAN_NULLS)}
  THEN {prefix(strip_currency(t('price_txt')), K.INTEGER_PREFIX, 'bigint')} END AS price_int,
 CASE WHEN NOT {nullish('price_txt', K.CLEAN_NULLS)}
  THEN {prefix(strip_currency(t('price_txt')), K.NUMBER_PREFIX, 'double')} END AS price_num,
 CASE WHEN NOT {nullish('date_txt', K.CLEAN_NULLS)} THEN {t('date_txt')} END AS date_text
FROM ({DIRTY}) d""")
def q_clean_values(spark, sf):
    return dirty_orders(spark, sf).select("k", fn.clean_integer(c("price_txt")).alias("price_int"),
                                          fn.clean_number(c("price_txt")).alias("price_num"),
                                          fn.clean_text(c("date_txt")).alias("date_text"))


@query("q_clean_date", f"""
SELECT k, CASE WHEN NOT {nullish('date_txt', K.CLEAN_NULLS)} THEN {day('date_txt')} END AS clean_day,
 {day('date_txt')} AS iso_day, {ts('date_txt')} IS NOT NULL AS date_like,
 cast(epoch({ts('date_txt')}) AS bigint) AS instant,
 {iso('date_txt')} AS iso_text FROM ({DIRTY}) d""")
def q_clean_date(spark, sf):
    d = c("date_txt")
    return dirty_orders(spark, sf).select(
        "k", F.date_format(fn.clean_date(d), "yyyy-MM-dd").alias("clean_day"),
        fn.normalize_date_format(d).alias("iso_day"), fn.is_date_like(d).alias("date_like"),
        F.unix_seconds(fn.to_timestamp(d)).alias("instant"), fn.iso_text(d).alias("iso_text"))


@query("q_written_dates", """
SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 4 THEN strftime(date_trunc('month', o_orderdate), '%Y-%m-%d')
 ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE o_orderkey % 6 WHEN 2 THEN 10 WHEN 5 THEN 22 ELSE 0 END AS hour_of_day
FROM orders""")
def q_written_dates(spark, sf):
    """C6, C7, C13d: month names, mail headers, years of two digits, a month alone, twelve hours."""
    shapes = ["MMMM d, yyyy", "d MMM yyyy", "EEE, dd MMM yyyy 10:05:09  'GMT'", "M/d/yy", "yyyy-MM", "yyyy-MM-dd 10:05 'PM'"]
    k, d = c("o_orderkey"), c("o_orderdate")
    written = F.when(F.lit(False), F.lit(""))
    for i, shape in enumerate(shapes):
        written = written.when(k % 6 == i, F.date_format(d, shape))
    rows = table(spark, sf, "orders").select(k.alias("k"), written.alias("v"))
    return rows.select("k", F.date_format(fn.clean_date(c("v")), "yyyy-MM-dd").alias("day"), F.hour(fn.clean_timestamp(c("v"))).alias("hour_of_day"))


@query("q_castable", f"""
SELECT k, {nullish('price_txt', ('',))} OR coalesce({extract_number('price_txt')}
   = floor({extract_number('price_txt')}), false) AS int_ok,
 {nullish('price_txt', ('',))} OR {extract_number('price_txt')} IS NOT NULL AS num_ok,
 {nullish('flag_txt', ('',))} OR {match(t('flag_txt'), K.BOOLEAN_WORD)} AS bool_ok,
 {nullish('date_txt', ('',))} OR {ts('date_txt')} IS NOT NULL AS date_ok,
 {nullish('cust_txt', ('',))} OR coalesce({match(t('cust_txt'), K.UUID_ANY)}, false) AS uuid_ok,
 {nullish('price_txt', ('',))} OR json_valid(price_txt) AS json_ok FROM ({DIRTY}) d""")
def q_castable(spark, sf):
    ok = fn.castable
    return dirty_orders(spark, sf).select(
        "k", ok(c("price_txt"), "to_integer").alias("int_ok"), ok(c("price_txt"), "to_number").alias("num_ok"),
        ok(c("flag_txt"), "to_boolean").alias("bool_ok"), ok(c("date_txt"), "to_date").alias("date_ok"),
        ok(c("cust_txt"), "to_uuid").alias("uuid_ok"), ok(c("price_txt"), "to_json").alias("json_ok"))


_LIST = ("CASE p_partkey%4 WHEN 0 THEN p_brand||', '||p_type||' ,'||p_name "
         "WHEN 1 THEN '[\"'||p_brand||'\", \"'||p_type||'\"]' WHEN 2 THEN '7' ELSE p_name END")


@query("q_clean_array", f"""
SELECT p_partkey, len(items) AS n, array_to_string(items, '|') AS joined FROM (
 SELECT p_partkey, CASE WHEN p_partkey%4 = 1 THEN from_json(l, '["varchar"]')
   ELSE list_transform(string_split(l, ','), lambda x: {t('x')}) END AS items
 FROM (SELECT p_partkey, {_LIST} AS l FROM part) a) b""")
def q_clean_array(spark, sf):
    items = table(spark, sf, "part").select("p_partkey", fn.clean_array(F.expr(_LIST)).alias("items"))
    return items.select("p_partkey", F.size("items").cast("bigint").alias("n"),
                        F.array_join("items", "|").alias("joined"))


_UUID = ("substr(h,1,8)||'-'||substr(h,9,4)||'-'||substr(h,13,4)||'-'||substr(h,17,4)||'-'||substr(h,21,12)")


@query("q_uuid", f"""
SELECT event_id, CASE WHEN {match(t('u'), K.UUID_STRICT)} THEN {t('u')} END AS strict_uuid,
 CASE WHEN {match(t('u'), K.UUID_ANY)} THEN {t('u')} END AS any_uuid
FROM (SELECT event_id, CASE event_id%3 WHEN 0 THEN ' '||{_UUID} WHEN 1 THEN upper({_UUID}) ELSE h END AS u
 FROM (SELECT event_id, md5(cast(event_id AS varchar)) AS h FROM events) a) b""")
def q_uuid(spark, sf):
    e = table(spark, sf, "events").selectExpr("event_id", "md5(cast(event_id AS string)) AS h")
    e = e.selectExpr("event_id", f"CASE event_id%3 WHEN 0 THEN ' '||{_UUID} "
                     f"WHEN 1 THEN upper({_UUID}) ELSE h END AS u")
    return e.select("event_id", fn.to_uuid(c("u")).alias("strict_uuid"), fn.clean_uuid(c("u")).alias("any_uuid"))


_JSON = ("CASE event_id%7 WHEN 0 THEN props||' x' WHEN 1 THEN '['||props||', 2]' WHEN 2 THEN '' "
         "WHEN 3 THEN event_type WHEN 4 THEN '1] [2' WHEN 5 THEN ' '||props ELSE props END")


@query("q_json", f"""
SELECT event_id, json_valid(j) AS valid, CASE WHEN json_valid(j) THEN {t('j')} END AS kept
FROM (SELECT event_id, {_JSON} AS j FROM events) a""")
def q_json(spark, sf):
    j = table(spark, sf, "events").selectExpr("event_id", f"{_JSON} AS j")
    return j.select("event_id", fn.is_json(c("j")).alias("valid"), fn.clean_json(c("j")).alias("kept"))


_KIND = ("CASE event_id%6 WHEN 0 THEN props WHEN 1 THEN '[1]' WHEN 2 THEN 'true' WHEN 3 THEN '1.5' "
         "WHEN 4 THEN '\"'||event_type||'\"' ELSE 'null' END")


@query("q_value_kind", f"""
SELECT event_id, CASE json_type(j) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array'
 WHEN 'BOOLEAN' THEN 'boolean' WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind,
 replace(j, ' ', '') AS uniq FROM (SELECT event_id, {_KIND} AS j FROM events) a""")
def q_value_kind(spark, sf):
    v = table(spark, sf, "events").selectExpr("event_id", f"parse_json({_KIND}) AS v")
    return v.select("event_id", fn.value_kind(c("v"), T.VariantType()).alias("kind"),
                    fn.uniqueness_key(c("v"), T.VariantType()).alias("uniq"))


@query("q_epoch", """
SELECT event_id, CASE event_id%3 WHEN 0 THEN s*1000 WHEN 1 THEN m END AS millis
FROM (SELECT event_id, epoch_us(ts)//1000000 AS s, epoch_us(ts)//1000 AS m FROM events) a""")
def q_epoch(spark, sf):
    e = table(spark, sf, "events").selectExpr("event_id", "unix_millis(cast(ts AS timestamp)) AS m")
    txt = F.expr("CASE event_id%3 WHEN 0 THEN cast(m div 1000 AS string) WHEN 1 THEN ' '||cast(m AS string) "
                 "ELSE cast(event_id AS string) END")
    return e.select("event_id", F.unix_millis(fn.epoch_to_timestamp(txt)).alias("millis"))


_WORD = ("CASE c_custkey%8 WHEN 0 THEN 'Male' WHEN 1 THEN ' F ' WHEN 2 THEN 'BOTH' WHEN 3 THEN 'girl' "
         "WHEN 4 THEN 'M' WHEN 5 THEN 'men' ELSE c_mktsegment END")


@query("q_enum", f"""
SELECT c_custkey, CASE WHEN lower(trim(w)) IN ('male','m','boy','men') THEN 'Men'
 WHEN lower(trim(w)) IN ('female','f','girl','women') THEN 'Women'
 WHEN lower(trim(w)) IN ('unisex','all','both') THEN 'Unisex' ELSE trim(w) END AS audience
FROM (SELECT c_custkey, {_WORD} AS w FROM customer) a""")
def q_enum(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", fn.normalize_enum(F.expr(_WORD), K.GENDER_WORDS).alias("audience"))


_SEPARATED = "CASE p_partkey%3 WHEN 0 THEN p_brand||'; '||p_type||',' ELSE p_brand||' | '||p_name END"


@query("q_resplit", f"""
SELECT p_partkey, array_to_string(list_filter(list_transform(regexp_split_to_array(l, '[,;|]'),
 lambda x: trim(x)), lambda x: x <> ''), ' | ') AS items FROM (SELECT p_partkey, {_SEPARATED} AS l FROM part) a""")
def q_resplit(spark, sf):
    return table(spark, sf, "part").select("p_partkey", fn.resplit_list(F.expr(_SEPARATED)).alias("items"))


@query("q_url_check", f"""
SELECT page_id, {match('u', K.URL_START)} AS url_ok, {match('h', '^#[0-9a-fA-F]{6}([[:space:]]*,[[:space:]]*#[0-9a-fA-F]{6})*$')} AS hex_ok
FROM (SELECT page_id, CASE page_id%4 WHEN 0 THEN 'www.'||url WHEN 1 THEN upper(url) ELSE url END AS u,
 CASE page_id%3 WHEN 0 THEN '#'||substr(md5(url),1,6) WHEN 1 THEN '#'||substr(md5(url),1,6)||', #'||substr(md5(url),7,6)
 ELSE substr(md5(url),1,6) END AS h FROM pages) a""")
def q_url_check(spark, sf):
    p = table(spark, sf, "pages").selectExpr(
        "page_id", "CASE page_id%4 WHEN 0 THEN 'www.'||url WHEN 1 THEN upper(url) ELSE url END AS u",
        "CASE page_id%3 WHEN 0 THEN '#'||substr(md5(url),1,6) WHEN 1 THEN "
        "'#'||substr(md5(url),1,6)||', #'||substr(md5(url),7,6) ELSE substr(md5(url),1,6) END AS h")
    return p.select("page_id", fn.check_url(c("u")).alias("url_ok"), fn.check_hex_color(c("h")).alias("hex_ok"))


@query("q_range_check", """
SELECT p_partkey, p_retailprice > 0 AND p_retailprice <= 1000 AS price_ok, p_size >= 10 AS size_ok FROM part""")
def q_range_check(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", fn.check_range(c("p_retailprice"), 0, 1000, lo_open=True).alias("price_ok"),
        fn.check_range(c("p_size"), 10).alias("size_ok"))


@query("q_truncate", "SELECT page_id, left(url, 20) AS short_url FROM pages")
def q_truncate(spark, sf):
    return table(spark, sf, "pages").select("page_id", fn.truncate_to(c("url"), 20).alias("short_url"))


@query("q_strip_zeros", f"""
SELECT k, CASE WHEN {match('cust_txt', '^0+[0-9]+$')} THEN coalesce(nullif(ltrim(cust_txt, '0'), ''), '0')
 ELSE cust_txt END AS cust FROM ({DIRTY}) d""")
def q_strip_zeros(spark, sf):
    return dirty_orders(spark, sf).select("k", fn.strip_leading_zeros(c("cust_txt")).alias("cust"))


_PHONE = "'+1 ('||lpad(cast(s_suppkey AS {0}), 3, '0')||') 555-'||lpad(cast(s_nationkey AS {0}), 4, '0')"
_UNIT = ("CASE s_suppkey%3 WHEN 0 THEN cast(s_suppkey AS {0})||'.5 kg' WHEN 1 THEN cast(s_suppkey AS {0})||'cm' "
         "ELSE s_name END")


@query("q_phone_unit", f"""
SELECT s_suppkey, translate({_PHONE.format('varchar')}, ' ().-', '') AS phone,
 CASE s_suppkey%3 WHEN 0 THEN cast(s_suppkey AS varchar)||'.5' WHEN 1 THEN cast(s_suppkey AS varchar)
 ELSE s_name END AS amount FROM supplier""")
def q_phone_unit(spark, sf):
    return table(spark, sf, "supplier").select(
        "s_suppkey", fn.clean_phone(F.expr(_PHONE.format("string"))).alias("phone"),
        fn.strip_unit_suffix(F.expr(_UNIT.format("string"))).alias("amount"))
