"""Constraints, sampling, upsert, repair and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaymaster.model import FixRule, Mapping, MappingRule, TargetColumn, TargetSchema
from quaymaster.operators.constraints import (
    ForeignKey, canonicalize, check_constraints, dry_run, duplicate_keys, foreign_key_gaps, unique_clashes,
)
from quaymaster.operators.errors import ERROR_TYPE, error_count, has_errors
from quaymaster.operators.mapping import apply_transforms
from quaymaster.operators.merge import batch_outcome, upsert_by_key
from quaymaster.operators.repair import fix_log
from quaymaster.operators.report import ingestion_report, preflight_status
from quaymaster.operators.sampling import stratified_sample
from quaymaster.operators.validate import validated_rows
from quaymaster.plans.ingest import bucketed_rows, load_reviewed, review, run_ingestion
from quaymaster.sources.readers import preview
from quaymaster.sources.row_index import with_row_index
from workload.inputs import DIRTY_ORDERS_SQL as DIRTY, ORDERS_MAPPING, ORDERS_TARGET, indexed_orders, table
from workload.mapping import BAD, COERCED, SPECS, TRANSFORMED, VIOLATIONS
from workload.registry import query
from workload.scoring import SCORES_SQL

c = F.col


@query("q_row_index", """
SELECT row_number() OVER () - 1 AS row_idx, l_orderkey, l_linenumber, l_partkey FROM lineitem""")
def q_row_index(spark, sf):
    return with_row_index(table(spark, sf, "lineitem")).select("row_idx", "l_orderkey", "l_linenumber", "l_partkey")


@query("q_row_index_sorted", """
SELECT row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1
 AS row_idx, l_orderkey, l_linenumber, l_partkey FROM lineitem""")
def q_row_index_sorted(spark, sf):
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    df = table(spark, sf, "lineitem").select(*order)
    return with_row_index(df, order_by=order).select("row_idx", "l_orderkey", "l_linenumber", "l_partkey")


@query("q_preview", """
SELECT row_number() OVER () - 1 AS row_idx, page_id, url FROM pages LIMIT 5""")
def q_preview(spark, sf):
    return preview(with_row_index(table(spark, sf, "pages").select("page_id", "url")))


@query("q_duplicate_keys", """
SELECT l_orderkey, l_linenumber, count(*) AS "rows" FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def q_duplicate_keys(spark, sf):
    return duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("q_fk_gaps", """
SELECT l_orderkey, count(*) AS "rows" FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY l_orderkey""")
def q_fk_gaps(spark, sf):
    parents = table(spark, sf, "orders").filter("o_orderstatus <> 'P'")
    return foreign_key_gaps(table(spark, sf, "lineitem"), parents, {"l_orderkey": "o_orderkey"})


_TYPED = ("CASE p_partkey%5 WHEN 0 THEN ' '||lower(p_type) WHEN 1 THEN p_type||' ' WHEN 2 THEN 'tiny' "
          "WHEN 3 THEN 'odd '||p_size ELSE p_type END")


@query("q_canonicalize", f"""
SELECT p_partkey, coalesce(d.v, CASE WHEN w = 'tiny' THEN 'SMALL' END, trim(raw)) AS kind_canonical,
 d.v IS NOT NULL OR w = 'tiny' AS kind_known
FROM (SELECT p_partkey, {_TYPED} AS raw, lower(trim({_TYPED})) AS w FROM part) p
LEFT JOIN (SELECT lower(trim(p_type)) AS k, min(p_type) AS v FROM part WHERE p_size > 10 GROUP BY 1) d ON p.w = d.k""")
def q_canonicalize(spark, sf):
    part = table(spark, sf, "part")
    messy = part.select("p_partkey", F.expr(_TYPED.replace("p_size", "cast(p_size AS string)")).alias("kind"))
    known = canonicalize(messy, "kind", part.filter("p_size > 10"), "p_type", {"tiny": "SMALL"})
    return known.select("p_partkey", "kind_canonical", "kind_known")


LINES = TargetSchema("lines", (
    TargetColumn("l_orderkey", "bigint", nullable=False, udt_name="int8"),
    TargetColumn("l_linenumber", "smallint", nullable=False, udt_name="int2"),
    TargetColumn("l_extendedprice", "numeric", nullable=False, precision=6, scale=2),
    TargetColumn("l_returnflag", "character varying", max_length=1)))


@query("q_check_constraints", """
SELECT row_idx, cast(l_extendedprice >= 9999.995 AS bigint) + cast(dup AS bigint) + cast(gap AS bigint) AS n_errors,
 dup, gap FROM (SELECT row_idx, l_extendedprice,
  row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY row_idx) > 1 AS dup,
  l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') AS gap
 FROM (SELECT row_number() OVER () - 1 AS row_idx, * FROM lineitem) l) x""")
def q_check_constraints(spark, sf):
    df = with_row_index(table(spark, sf, "lineitem").select(*LINES.names))
    parents = table(spark, sf, "orders").filter("o_orderstatus <> 'P'")
    rows = check_constraints(df, LINES, unique=[["l_orderkey", "l_linenumber"]],
                             foreign_keys=[ForeignKey({"l_orderkey": "o_orderkey"}, parents)])
    codes = F.coalesce(F.transform("errors", lambda e: e["code"]), F.array().cast("array<string>"))
    return rows.select("row_idx", error_count().alias("n_errors"),
                       F.array_contains(codes, "duplicate_key").alias("dup"),
                       F.array_contains(codes, "fk_missing").alias("gap"))


_SAMPLED = """row_idx < 10 OR row_idx >= n - 10 OR row_idx % (n // 30) = 0 OR row_idx = 10"""


@query("q_stratified_sample", f"""
SELECT row_idx, price_txt FROM (SELECT k AS row_idx, price_txt, (SELECT count(*) FROM orders) AS n
 FROM ({DIRTY}) d) x WHERE {_SAMPLED}""")
def q_stratified_sample(spark, sf):
    return stratified_sample(indexed_orders(spark, sf)).select("row_idx", "price_txt")


_REFUSED = "(customer_id IS NULL OR price IS NULL)"


@query("q_dry_run", f"""
SELECT 'sample' AS scope, count(*) AS rows_tested, count(CASE WHEN NOT {_REFUSED} THEN 1 END) AS rows_passed,
 count(CASE WHEN {_REFUSED} THEN 1 END) = 0 AS success
FROM (SELECT *, (SELECT count(*) FROM orders) AS n FROM ({TRANSFORMED}) t) x WHERE {_SAMPLED}
UNION ALL SELECT 'all', count(*), count(CASE WHEN NOT {_REFUSED} THEN 1 END),
 count(CASE WHEN {_REFUSED} THEN 1 END) = 0 FROM ({TRANSFORMED}) t""")
def q_dry_run(spark, sf):
    rows = apply_transforms(indexed_orders(spark, sf), SPECS)
    parts = [dry_run(rows, ORDERS_TARGET, sample=n).summary.withColumn("scope", F.lit(s))
             for n, s in ((50, "sample"), (None, "all"))]
    return parts[0].unionByName(parts[1])


@query("q_upsert", """
WITH s AS (SELECT okey, arg_max(price, row_idx) AS price, arg_max(status, row_idx) AS status FROM (
  SELECT row_number() OVER () - 1 AS row_idx, l_orderkey * 3 AS okey, l_extendedprice AS price,
   CASE WHEN l_linenumber = 7 THEN 'X' ELSE l_linestatus END AS status FROM lineitem) l GROUP BY okey)
SELECT o_orderkey, o_custkey, coalesce(status, o_orderstatus) AS o_orderstatus, coalesce(price, o_totalprice) AS o_totalprice,
 o_orderpriority, CASE WHEN okey IS NOT NULL THEN 'update' ELSE 'keep' END AS _action
FROM orders LEFT JOIN s ON o_orderkey = okey
UNION ALL SELECT okey, NULL, status, price, '9-NEW', 'insert' FROM s WHERE okey NOT IN (SELECT o_orderkey FROM orders)""")
def q_upsert(spark, sf):
    target = table(spark, sf, "orders").drop("o_orderdate")
    lines = with_row_index(table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_linestatus", "l_extendedprice"))
    source = lines.select("row_idx", (c("l_orderkey") * 3).alias("o_orderkey"),
                          c("l_extendedprice").alias("o_totalprice"),
                          F.when(c("l_linenumber") == 7, "X").otherwise(c("l_linestatus")).alias("o_orderstatus"))
    return upsert_by_key(target, source, ["o_orderkey"], {"o_orderpriority": "9-NEW"})


@query("q_batch_outcome", f"""
SELECT row_idx // 500 + 1 AS batch, count(*) AS "rows", count(b) AS bad_rows, count(b) > 0 AS failed,
 CASE WHEN count(b) > 0 THEN 0 ELSE count(*) END AS upserted,
 CASE WHEN count(b) > 0 THEN 'Batch ' || (row_idx // 500 + 1) || ': ' || arg_min(m, b) END AS message
FROM (SELECT x.row_idx, v.row_idx AS b, CASE WHEN v.code = 'not_null' THEN
   'no value, and the column needs one' ELSE 'transform date failed' END AS m
 FROM ({TRANSFORMED}) x LEFT JOIN (SELECT row_idx, arg_min(code, o) AS code FROM (
   SELECT *, CASE "column" WHEN 'customer_id' THEN 0 WHEN 'price' THEN 1 ELSE 2 END AS o FROM ({VIOLATIONS}) q) w
   GROUP BY row_idx) v ON x.row_idx = v.row_idx) y GROUP BY row_idx // 500""")
def q_batch_outcome(spark, sf):
    out = batch_outcome(validated_rows(indexed_orders(spark, sf), SPECS, ORDERS_TARGET))
    return out.withColumn("upserted", c("upserted").cast("bigint"))


# --- repair -------------------------------------------------------------------------------------

LOAD_TARGET = TargetSchema("orders_load", (
    TargetColumn("customer_id", "integer", nullable=False, udt_name="int4"),
    TargetColumn("price", "numeric"), TargetColumn("order_date", "date"), TargetColumn("active", "boolean")),
    primary_key=("customer_id",))
RULES = (
    FixRule("nullify", "bad_cast", "active", diagnosis="not a flag"),
    FixRule("nullify", "bad_cast", "order_date", diagnosis="not a date"),
    FixRule("cast", "bad_cast", "price", attempt=1, cast_to="integer", diagnosis="try a whole number"),
    FixRule("nullify", "bad_cast", "price", diagnosis="not a price"),
    FixRule("alter_column", "not_null", "customer_id", sql="ALTER TABLE orders_load ...", diagnosis="no customer"),
)
# p, d, a: does the price, date or flag fail to coerce? A failing price takes two attempts.
_FAILS = f"""SELECT *, cast({BAD['price']} AS int) AS p, cast({BAD['order_date']} AS int) AS d,
 cast({BAD['active']} AS int) AS a FROM ({COERCED}) m"""
BUCKETED = f"""SELECT *, CASE WHEN customer_id IS NULL THEN 'manual' WHEN p + d + a = 0 THEN 'loaded'
 WHEN 2 * p + d + a <= 3 THEN 'repaired' ELSE 'unresolved' END AS bucket,
 CASE WHEN customer_id IS NULL THEN least(1, p + d + a) WHEN p + d + a = 3 THEN 2 ELSE p + d + a END AS n_fixes
FROM ({_FAILS}) f"""


def _bucketed(spark, sf):
    return bucketed_rows(indexed_orders(spark, sf), ORDERS_MAPPING, LOAD_TARGET, RULES)


@query("q_repair", f"""
SELECT row_idx, customer_id, price, order_date, active, bucket, n_fixes,
 CASE WHEN bucket = 'manual' THEN 'ALTER TABLE orders_load ...' END AS manual_action FROM ({BUCKETED}) b""")
def q_repair(spark, sf):
    rows, _ = _bucketed(spark, sf)
    return rows.select("row_idx", "customer_id", "price", F.date_format("order_date", "yyyy-MM-dd").alias("order_date"),
                       "active", "bucket", F.coalesce(F.size("fixes"), F.lit(0)).alias("n_fixes"), "manual_action")


@query("q_fix_log", f"""
SELECT row_idx, 2 AS attempt, 'nullify' AS fix_type, 'not a price' AS diagnosis, 'price' AS touched
 FROM ({BUCKETED}) b WHERE p = 1
UNION ALL SELECT row_idx, 2 * p + 1, 'nullify', 'not a date', 'order_date' FROM ({BUCKETED}) b
 WHERE d = 1 AND (p = 0 OR customer_id IS NOT NULL)
UNION ALL SELECT row_idx, 2 * p + d + 1, 'nullify', 'not a flag', 'active' FROM ({BUCKETED}) b
 WHERE a = 1 AND p + d < 2 AND (p + d = 0 OR customer_id IS NOT NULL)""")
def q_fix_log(spark, sf):
    rows, _ = _bucketed(spark, sf)
    return fix_log(rows).select("row_idx", "attempt", "fix_type", "diagnosis", F.array_join("columns", ",").alias("touched"))


@query("q_ingest_report", f"""
SELECT count(*) AS rows_total, count(*) AS rows_prepared,
 count(CASE WHEN bucket IN ('loaded', 'repaired') THEN 1 END) AS rows_upserted,
 count(CASE WHEN bucket IN ('manual', 'unresolved') THEN 1 END) AS rows_skipped,
 cast(sum(n_fixes) AS bigint) AS applied_fixes,
 cast(sum(p + d + a) AS bigint) + count(CASE WHEN bucket = 'manual' THEN 1 END) AS manual_actions,
 count(CASE WHEN bucket = 'unresolved' THEN 1 END) AS unresolved_errors FROM ({BUCKETED}) b""")
def q_ingest_report(spark, sf):
    rows, warned = _bucketed(spark, sf)
    return ingestion_report(rows, coercion_warnings=warned).drop("dropped_columns")


_CUSTOMERS = "SELECT c_custkey AS customer_id, c_acctbal AS price, NULL AS order_date, NULL AS active, c_name FROM customer"


def _customers(spark, sf):
    return table(spark, sf, "customer").selectExpr(
        "cast(c_custkey AS int) AS customer_id", "c_acctbal AS price", "cast(null AS date) AS order_date",
        "cast(null AS boolean) AS active", "c_name")


def _merge_sql(rows: str) -> str:
    """Last accepted row per customer over the customer table."""
    return f"""
SELECT coalesce(s.customer_id, t.customer_id) AS customer_id, CASE WHEN s.customer_id IS NULL THEN t.price ELSE s.price END AS price,
 s.order_date, s.active, t.c_name, CASE WHEN t.customer_id IS NULL THEN 'insert' WHEN s.customer_id IS NULL THEN 'keep'
  ELSE 'update' END AS _action FROM ({_CUSTOMERS}) t FULL JOIN (
 SELECT * FROM (SELECT customer_id, price, order_date, active, row_number() OVER (PARTITION BY customer_id
   ORDER BY row_idx DESC) AS rn FROM ({rows}) r) q WHERE rn = 1) s ON s.customer_id = t.customer_id"""


@query("q_run_ingestion", _merge_sql(f"SELECT * FROM ({BUCKETED}) b WHERE bucket IN ('loaded', 'repaired')"))
def q_run_ingestion(spark, sf):
    done = run_ingestion(indexed_orders(spark, sf), ORDERS_MAPPING, LOAD_TARGET, _customers(spark, sf),
                         ["customer_id"], RULES)
    return done.merged.withColumn("order_date", F.date_format("order_date", "yyyy-MM-dd"))


@query("q_load_reviewed", _merge_sql(f"""
SELECT * FROM ({TRANSFORMED}) x WHERE row_idx // 2 NOT IN (SELECT row_idx // 2 FROM ({TRANSFORMED}) y WHERE {_REFUSED})"""))
def q_load_reviewed(spark, sf):
    merged, _ = load_reviewed(indexed_orders(spark, sf), SPECS, ORDERS_TARGET, _customers(spark, sf),
                              ["customer_id"], batch=2)
    return merged.withColumn("order_date", F.date_format("order_date", "yyyy-MM-dd"))


# --- what an upsert refuses ------------------------------------------------------------------------

NULLABLE_TARGET = TargetSchema("by_customer", (TargetColumn("customer_id", "integer", udt_name="int4"),), primary_key=("customer_id",))
KEY_MAPPING = Mapping((MappingRule("cust_txt", "customer_id"),))


def _key_load(spark, sf):
    return run_ingestion(indexed_orders(spark, sf), KEY_MAPPING, NULLABLE_TARGET,
                         _customers(spark, sf).select("customer_id"), ["customer_id"])


@query("q_null_key_rejects", f"""
SELECT k AS row_idx, cast(cust_txt AS int) AS customer_id, CASE WHEN cust_txt IS NULL THEN 'unresolved' ELSE 'loaded' END AS bucket
FROM ({DIRTY}) d""")
def q_null_key_rejects(spark, sf):
    """A NULL conflict key is a reject even where the column itself may be NULL."""
    return _key_load(spark, sf).rows.select("row_idx", "customer_id", "bucket")


@query("q_upsert_duplicates", f"""
SELECT cast(cust_txt AS int) AS customer_id, count(*) AS "rows", min(k) AS first_idx, max(k) AS last_idx
FROM ({DIRTY}) d WHERE cust_txt IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def q_upsert_duplicates(spark, sf):
    return _key_load(spark, sf).duplicates


@query("q_load_invariant", f"""
SELECT count(*) AS rows_in, count(cust_txt) AS accepted, count(*) - count(cust_txt) AS rejected,
 count(DISTINCT cust_txt) AS keys, count(DISTINCT cust_txt) AS changed FROM ({DIRTY}) d""")
def q_load_invariant(spark, sf):
    """Every row is accepted or rejected; every accepted key is one insert or one match in the target."""
    done = _key_load(spark, sf)
    accepted = F.col("bucket").isin("loaded", "repaired")
    rows = done.rows.agg(F.count("*").alias("rows_in"), F.count(F.when(accepted, 1)).alias("accepted"),
                         F.count(F.when(~accepted, 1)).alias("rejected"),
                         F.count_distinct(F.when(accepted, F.col("customer_id"))).alias("keys"))
    known = _customers(spark, sf).select("customer_id").join(done.rows.filter(accepted).select("customer_id").distinct(), "customer_id").agg(
        F.count("*").alias("matched"))
    inserted = done.merged.filter("_action = 'insert'").agg(F.count("*").alias("inserted"))
    return rows.join(F.broadcast(known)).join(F.broadcast(inserted)).select(
        "rows_in", "accepted", "rejected", "keys", (c("matched") + c("inserted")).alias("changed"))


NAMED_TARGET = TargetSchema("named", (TargetColumn("id", "bigint", nullable=False), TargetColumn("name", "text")),
                            primary_key=("id",), unique=(("name",),))


@query("q_unique_against_target", """
SELECT c_custkey AS row_idx, c_custkey % 3 = 1 OR c_custkey % 4 = 1 AS refused FROM customer""")
def q_unique_against_target(spark, sf):
    """Names under another id: of the table (every third row moves to a new id) or of an earlier row (every fourth
    row is met again under its own id after a row of another id took its name)."""
    customers = table(spark, sf, "customer").select(c("c_custkey").cast("bigint").alias("k"), "c_name")
    existing = customers.filter("k % 3 = 1").select(c("k").alias("id"), c("c_name").alias("name"))
    rows = customers.select(c("k").alias("row_idx"), F.when(c("k") % 3 == 1, -c("k") - 1).otherwise(c("k")).alias("id"),
                            c("c_name").alias("name"))
    earlier = customers.filter("k % 4 = 1").select((-c("k") - 1).alias("row_idx"), (c("k") + 10_000_000).alias("id"), c("c_name").alias("name"))
    rows = rows.unionByName(earlier).withColumn("errors", F.lit(None).cast(ERROR_TYPE))
    return unique_clashes(rows, NAMED_TARGET, ["id"], existing).filter("row_idx >= 0").select("row_idx", has_errors().alias("refused"))


@query("q_verdict", f"""
SELECT CASE WHEN criticals > 0 OR score < 0.5 OR passed < 0.5 * tested THEN 'blocked' WHEN score >= 0.8 AND worst <= 0.05
  AND passed = tested THEN 'safe' ELSE 'review' END AS status, round(score, 6) AS confidence,
 CASE WHEN worst > 0.05 THEN 'failed' ELSE 'ok' END AS validation, CASE WHEN passed < tested THEN 'failed' ELSE 'ok' END AS dry_run,
 'blocked' AS preflight
FROM (SELECT (SELECT score FROM ({SCORES_SQL}) s WHERE candidate = 1) AS score,
 (SELECT criticals FROM ({SCORES_SQL}) s WHERE candidate = 1) AS criticals,
 (SELECT max(n) FROM (SELECT count(*) AS n FROM ({VIOLATIONS}) v GROUP BY "column") g) / (SELECT count(*) FROM orders) AS worst,
 (SELECT count(*) FROM ({TRANSFORMED}) t) AS tested, (SELECT count(*) FROM ({TRANSFORMED}) t WHERE NOT {_REFUSED}) AS passed) z""")
def q_verdict(spark, sf):
    found = review(indexed_orders(spark, sf), ORDERS_MAPPING, SPECS, ORDERS_TARGET).verdict
    return preflight_status(found).select("status", F.round("confidence", 6).alias("confidence"), "validation",
                                          "dry_run", "preflight")
