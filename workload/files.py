"""Files written from the given tables and read back, dates by vote, and what sinks and repairs leave."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from quaymaster.model import FixRule, Mapping, MappingRule, TargetColumn, TargetSchema
from quaymaster.operators.dates import infer_formats, with_inferred_formats
from quaymaster.operators.evaluate import evaluate_mapping
from quaymaster.operators.mapping import apply_mapping
from quaymaster.operators.report import preflight
from quaymaster.plans.ingest import bucketed_rows
from quaymaster.session import CHECKPOINT_KEY
from quaymaster.sources.readers import read_csv, read_json, read_source, union_rows
from quaymaster.sources.sinks import write_rejects, write_upsert
from workload.inputs import ORDERS_MAPPING, ORDERS_TARGET, indexed_orders, table
from workload.registry import query

c = F.col


def scratch(spark, name: str) -> str:
    """A new place in the folder that all executors reach; a local session without one gets a temporary folder."""
    folder = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="files-")
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}-{name}"


# --- dates -----------------------------------------------------------------------------------------

_DATED = {
    "us": "date_format(d, 'MM/dd/yyyy')", "eu": "date_format(d, 'dd.MM.yyyy')",
    "open": "CASE WHEN day(d) <= 12 THEN date_format(d, 'dd-MM-yyyy') END",
    "both": "CASE WHEN k % 5 = 0 THEN date_format(d, 'dd/MM/yyyy') ELSE date_format(d, 'MM/dd/yyyy') END",
    "written": "date_format(d, 'd MMMM yyyy')", "plain": "date_format(d, 'yyyy-MM-dd')",
}
_O = "(SELECT o_orderkey AS k, day(o_orderdate) AS d, month(o_orderdate) AS m FROM orders) o"


@query("q_date_formats", f"""
SELECT 'us' AS "column", count(*) AS live, 0 AS iso, count_if(d > 12) AS month_first, 0 AS day_first, count_if(d <= 12) AS either, 0 AS named,
 'iso,month_first' AS formats, false AS ambiguous, false AS mixed, count(*) AS read_right FROM {_O}
UNION ALL SELECT 'eu', count(*), 0, 0, count_if(d > 12), count_if(d <= 12), 0, 'iso,day_first', false, false, count(*) FROM {_O}
UNION ALL SELECT 'open', count_if(d <= 12), 0, 0, 0, count_if(d <= 12), 0, 'iso,month_first', true, false, count_if(d <= 12 AND d = m) FROM {_O}
UNION ALL SELECT 'both', count(*), 0, count_if(d > 12 AND k % 5 <> 0), count_if(d > 12 AND k % 5 = 0), count_if(d <= 12), 0, 'iso,month_first,day_first', false, true,
 count_if(k % 5 <> 0 OR d > 12 OR d = m) FROM {_O}
UNION ALL SELECT 'written', count(*), 0, 0, 0, 0, count(*), 'iso,named', false, false, count(*) FROM {_O}
UNION ALL SELECT 'plain', count(*), count(*), 0, 0, 0, 0, 'iso', false, false, count(*) FROM {_O}""")
def q_date_formats(spark, sf):
    """The order that a column's values vote for, and how many of them the chosen parser reads as they were meant."""
    orders = table(spark, sf, "orders").selectExpr("o_orderkey AS row_idx", "o_orderkey AS k", "cast(o_orderdate AS date) AS d")
    df = orders.selectExpr("row_idx", "d", *[f"{e} AS `{n}`" for n, e in _DATED.items()])
    names = list(_DATED)
    target = TargetSchema("dated", tuple(TargetColumn(n, "date") for n in names))
    mapping, _ = with_inferred_formats(df, Mapping(tuple(MappingRule(n, n) for n in names)), names)
    read = apply_mapping(df, mapping, target).drop("errors").join(df.select("row_idx", "d"), "row_idx")
    right = read.agg(*[F.count_if(c(f"`{n}`") == c("d")).alias(n) for n in names]).select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("column"), c(f"`{n}`").alias("read_right")) for n in names])))
    found = infer_formats(df, names).join(F.broadcast(right), "column")
    return found.select("column", "live", "iso", "month_first", "day_first", "either", "named", F.array_join("formats", ",").alias("formats"),
                        "ambiguous", "mixed", "read_right")


# --- files -----------------------------------------------------------------------------------------

_NOTE = "CASE k % 6 WHEN 0 THEN n||chr(10)||'\"'||t||'\"' WHEN 1 THEN t||', '||n WHEN 2 THEN '\"'||n||'\",'||chr(10)||chr(10)||t WHEN 3 THEN '' ELSE n END"


@query("q_csv_records", f"""
SELECT k, CASE WHEN k % 6 = 3 THEN '' ELSE {_NOTE} END AS note, t AS kind, count(*) OVER () AS "rows" FROM (SELECT p_partkey AS k, p_name AS n, p_type AS t FROM part) p""")
def q_csv_records(spark, sf):
    """Quotes, separators and line breaks within fields, written by Spark and read back in splits, rows numbered without gaps."""
    part = table(spark, sf, "part").selectExpr("p_partkey AS k", "p_name AS n", "p_type AS t")
    path = scratch(spark, "parts.csv")
    part.selectExpr("k", f"{_NOTE} AS note", "t AS kind").write.option("header", True).option("escape", '"').csv(path)
    df = read_source(spark, path)
    size = df.agg((F.max("row_idx") + 1).alias("rows"), F.count_distinct("row_idx").alias("n")).filter("rows = n").select("rows")
    return df.select(c("k").cast("bigint").alias("k"), "note", "kind").join(F.broadcast(size))


@query("q_csv_lenient", """
SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 1 THEN '' ELSE c_name END AS name, c_custkey % 3 <> 0 AS ragged FROM customer""")
def q_csv_lenient(spark, sf):
    """Short rows are filled, long ones cut, both marked."""
    lines = table(spark, sf, "customer").selectExpr(
        "CASE c_custkey % 3 WHEN 0 THEN c_custkey||','||c_name WHEN 1 THEN cast(c_custkey AS string) ELSE c_custkey||','||c_name||',more' END AS `k,name`")
    path = scratch(spark, "ragged.csv")
    lines.write.options(header=True, quote="\u0000", sep="\u0001").csv(path)
    return read_csv(spark, path, strict=False).select(c("k").cast("bigint").alias("k"), "name", c("_corrupt").isNotNull().alias("ragged"))


@query("q_json_array", """
SELECT c_custkey AS k, CASE WHEN c_custkey % 4 <> 0 THEN c_name || '"}{' END AS name, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal ELSE c_custkey END::DOUBLE AS amount,
 CASE WHEN c_custkey % 4 <> 0 THEN 'amount,k,name' ELSE 'amount,k' END AS keys, (SELECT count(*) FROM customer) AS "rows" FROM customer""")
def q_json_array(spark, sf):
    """S3: files of one array each, cut into objects; types widen over all rows, keys that are missing are NULL."""
    rows = table(spark, sf, "customer").selectExpr(
        "c_custkey AS k", "CASE WHEN c_custkey % 4 <> 0 THEN c_name||'\"}{' END AS name",
        "CASE WHEN c_custkey % 3 = 0 THEN cast(c_acctbal AS string) ELSE cast(c_custkey AS string) END AS amount")
    objects = rows.selectExpr("k div 1000 AS block", "concat('{\"k\": ', k, if(name IS NULL, '', ', \"name\": ' || substr(to_json(array(name)), 2, length(to_json(array(name))) - 2)), ', \"amount\": ', amount, '}') AS o")
    path = scratch(spark, "customers.json")
    arrays = objects.groupBy("block").agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list("o"), ",\n "), F.lit("]")).alias("value"))
    arrays.write.partitionBy("block").text(path)
    df = read_json(spark, path, keys=True)
    size = df.agg(F.count_distinct("row_idx").alias("rows"))
    return df.select("k", "name", c("amount").cast("double").alias("amount"), F.array_join(F.array_sort("_keys"), ",").alias("keys")).join(F.broadcast(size))


@query("q_union_rows", """
SELECT c_custkey AS k, c_name AS name, NULL AS size FROM customer UNION ALL SELECT p_partkey, NULL, p_size FROM part""")
def q_union_rows(spark, sf):
    return union_rows([table(spark, sf, "customer").selectExpr("c_custkey AS k", "c_name AS name"), table(spark, sf, "part").selectExpr("p_partkey AS k", "p_size AS size")])


# --- sinks, repairs, reports -------------------------------------------------------------------------

NAMES = TargetSchema("names", (TargetColumn("id", "bigint", nullable=False), TargetColumn("name", "character varying", nullable=False, max_length=10),
                               TargetColumn("segment", "text"), TargetColumn("alias", "character varying", max_length=40)), primary_key=("id",))
NAMES_MAPPING = Mapping((MappingRule("id_txt", "id"), MappingRule("name_txt", "name"), MappingRule("segment", "segment"), MappingRule("alias_txt", "alias")))


def _names(spark, sf):
    return table(spark, sf, "customer").selectExpr(
        "c_custkey AS row_idx", "CASE WHEN c_custkey % 7 = 0 THEN 'x' ELSE cast(c_custkey AS string) END AS id_txt",
        "CASE c_custkey % 5 WHEN 0 THEN c_name WHEN 1 THEN '' ELSE substr(c_name, 10) END AS name_txt", "c_mktsegment AS segment", "c_name AS alias_txt")


_NAMED = """SELECT c_custkey AS k, c_custkey % 7 = 0 AS bad_id, c_custkey % 5 AS f, c_name, substr(c_name, 10) AS short FROM customer"""


@query("q_row_repairs", f"""
SELECT k AS row_idx, CASE WHEN NOT bad_id AND f = 0 THEN substr(c_name, 1, 10) WHEN NOT bad_id AND f = 1 THEN substr(c_name, 1, 10) WHEN f = 0 THEN c_name WHEN f <> 1 THEN short END AS name,
 CASE WHEN bad_id OR f <> 1 THEN c_name END AS alias,
 CASE WHEN bad_id THEN 'skipped' WHEN f IN (0, 1) THEN 'repaired' ELSE 'loaded' END AS bucket,
 CASE WHEN bad_id THEN 'skip' WHEN f = 0 THEN 'truncate' WHEN f = 1 THEN 'rename,truncate' END AS fixes FROM ({_NAMED}) n""")
def q_row_repairs(spark, sf):
    """Names too long are cut, missing ones are taken from another column, rows without an id are skipped."""
    rules = [FixRule("skip", "bad_cast", "id"), FixRule("rename", "not_null", "name", columns=("alias",), rename_to="name"), FixRule("truncate", "too_long", "name")]
    rows, _ = bucketed_rows(_names(spark, sf), NAMES_MAPPING, NAMES, rules)
    kinds = F.when(F.size("fixes") > 0, F.array_join(F.transform("fixes", lambda x: x["fix_type"]), ","))
    return rows.select("row_idx", "name", "alias", "bucket", kinds.alias("fixes"))


@query("q_written_rejects", f"""
SELECT k AS row_idx, CASE WHEN bad_id THEN 'bad_cast' WHEN f = 1 THEN 'not_null' ELSE 'too_long' END AS code,
 bad_id::INT + (f IN (0, 1))::INT + (bad_id)::INT AS n_errors FROM ({_NAMED}) n WHERE bad_id OR f IN (0, 1)""")
def q_written_rejects(spark, sf):
    """Rejects lie under their first error, with all errors."""
    rows, _ = bucketed_rows(_names(spark, sf), NAMES_MAPPING, NAMES)
    path = scratch(spark, "rejects")
    write_rejects(rows.select("row_idx", "errors"), path)
    return spark.read.parquet(path).select("row_idx", "code", F.size("errors").alias("n_errors"))


@query("q_written_upsert", """
SELECT c_custkey AS c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def q_written_upsert(spark, sf):
    """The merged table in a new place, partitioned."""
    from quaymaster.operators.merge import upsert_by_key

    target = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    source = target.filter("c_custkey % 2 = 0").selectExpr("c_custkey AS row_idx", "c_custkey", "'new' AS c_mktsegment")
    path = scratch(spark, "customers")
    write_upsert(upsert_by_key(target, source, ["c_custkey"]), path, ["c_mktsegment"])
    return spark.read.parquet(path).select("c_custkey", "c_mktsegment")


SCORED = TargetSchema("scored", (TargetColumn("name", "character varying", max_length=5), TargetColumn("id", "integer", nullable=False),
                                 TargetColumn("note", "text", nullable=False), TargetColumn("kind", "text")))


@query("q_issue_order", """
SELECT * FROM (VALUES (1, 'critical', 'c_mktsegment', 1), (2, 'critical', 'note', 4), (3, 'warning', 'c_name', 5), (4, 'warning', 'c_name', 6)) v(place, severity, "column", section)""")
def q_issue_order(spark, sf):
    """A text too long for its column, a cast that never works, an unsure rule and a required column without a source, by severity."""
    df = table(spark, sf, "customer").withColumnRenamed("c_custkey", "row_idx")
    mapping = Mapping((MappingRule("c_name", "name", confidence=0.6), MappingRule("c_mktsegment", "id", transformation="to_integer")))
    return evaluate_mapping(df, mapping, SCORED).issues.select("place", "severity", "column", "section")


@query("q_preflight", """
SELECT * FROM (VALUES ('success', 'cust_txt', 'customer_id'), ('success', 'price_txt', 'price'), ('warning', 'date_txt', 'order_date'),
 ('warning', 'flag_txt', 'active'), ('alert', 'row_idx', NULL)) v(bucket, source, target)""")
def q_preflight(spark, sf):
    """Sure and unsure rules and columns that feed nothing."""
    df = indexed_orders(spark, sf)
    return preflight(spark, ORDERS_MAPPING, ORDERS_TARGET, df.columns).drop("note")


UNIQUE_NAMES = TargetSchema("unique_names", (TargetColumn("id", "bigint", nullable=False), TargetColumn("name", "character varying", nullable=False, max_length=15)),
                            primary_key=("id",), unique=(("name",),))


@query("q_proved_repairs", """
WITH r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'n' || c_custkey END AS name FROM customer),
 held AS (SELECT 'Customer#000001' AS name UNION SELECT 'n' || c_custkey FROM customer WHERE c_custkey % 7 = 0),
 f AS (SELECT k, name, length(name) > 15 AS long, substr(name, 1, 15) AS cut, row_number() OVER (PARTITION BY length(name) > 15, substr(name, 1, 15) ORDER BY k) AS place FROM r)
SELECT k AS row_idx, CASE WHEN NOT long AND cut IN (SELECT name FROM held) THEN 'unresolved' WHEN NOT long THEN 'loaded'
 WHEN place = 1 AND cut NOT IN (SELECT name FROM held) THEN 'repaired' ELSE 'unresolved' END AS bucket FROM f""")
def q_proved_repairs(spark, sf):
    """Names cut to length may become equal to one another or to a name in the table; the first keeps it."""
    customers = table(spark, sf, "customer")
    df = customers.selectExpr("c_custkey AS row_idx", "cast(c_custkey AS string) AS id", "CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'n' || c_custkey END AS name")
    existing = customers.filter("c_custkey % 7 = 0").selectExpr("cast(-c_custkey AS bigint) AS id", "'n' || c_custkey AS name").union(
        customers.agg(F.lit(-1000000).cast("bigint").alias("id"), F.lit("Customer#000001").alias("name")))
    mapping = Mapping((MappingRule("id", "id"), MappingRule("name", "name")))
    rows, _ = bucketed_rows(df, mapping, UNIQUE_NAMES, [FixRule("truncate", "too_long", "name")], keys=["id"], existing=existing)
    return rows.select("row_idx", "bucket")
