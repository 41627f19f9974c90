"""Messy inputs that Spark (or DuckDB) derives from the given clean tables.

Both engines compute the same rows: integer arithmetic only, every row of the
base table used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quaymaster.model import Mapping, MappingRule, TargetColumn, TargetSchema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CASES = [
    "CASE k%10 WHEN 0 THEN 'INR '||whole WHEN 1 THEN '$'||whole WHEN 2 THEN 'N/A' WHEN 3 THEN '' "
    "WHEN 4 THEN 'abc' WHEN 5 THEN ' '||whole||'.50 ' ELSE whole END AS price_txt",
    "CASE k%6 WHEN 0 THEN us WHEN 1 THEN eu WHEN 2 THEN 'none' ELSE iso END AS date_txt",
    "CASE k%5 WHEN 0 THEN 'yes' WHEN 1 THEN 'N' WHEN 2 THEN '1' WHEN 3 THEN 'Active' "
    "ELSE '?' END AS flag_txt",
    "CASE WHEN k%13=0 THEN NULL ELSE lpad(cust,6,'0') END AS cust_txt",
]

# Messy text form of ``orders``: prices with prefixes, four date shapes, flag words.
_SPARK_BASE = [
    "o_orderkey AS k", "cast(o_custkey AS string) AS cust",
    "cast(cast(round(o_totalprice*100) AS bigint) div 100 AS string) AS whole",
    "date_format(o_orderdate,'MM/dd/yyyy') AS us", "date_format(o_orderdate,'dd-MM-yyyy') AS eu",
    "date_format(o_orderdate,'yyyy-MM-dd') AS iso",
]
DIRTY_ORDERS_SQL = f"""SELECT k, {", ".join(_CASES)} FROM (
 SELECT o_orderkey AS k, cast(o_custkey AS varchar) AS cust,
  cast(cast(round(o_totalprice*100) AS bigint)//100 AS varchar) AS whole,
  strftime(o_orderdate,'%m/%d/%Y') AS us, strftime(o_orderdate,'%d-%m-%Y') AS eu,
  strftime(o_orderdate,'%Y-%m-%d') AS iso FROM orders) b"""


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return orders.selectExpr(*_SPARK_BASE).selectExpr("k", *_CASES)


def indexed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``dirty_orders`` with the dense order key as row index."""
    return dirty_orders(spark, sf_dir).withColumnRenamed("k", "row_idx")


# Messy text form of ``events``: one column per inferred type.
_UUID = "substr(h,1,8)||'-'||substr(h,9,4)||'-'||substr(h,13,4)||'-'||substr(h,17,4)||'-'||substr(h,21,12)"


def _event_columns(text: str, div: str, stamp: str) -> list[str]:
    return [
        "event_id", "event_type", f"{_UUID} AS uuid_txt",
        f"event_type||'.'||cast(user_id AS {text})||'@mail.example' AS email_txt", f"{stamp} AS ts_txt",
        f"'+1 (555) '||lpad(cast(user_id AS {text}), 4, '0') AS phone_txt",
        f"CASE event_id%4 WHEN 0 THEN 'USD '||cast(cents {div} 100 AS {text}) "
        f"WHEN 1 THEN '€ '||cast(cents {div} 100 AS {text}) WHEN 2 THEN 'nil' "
        f"ELSE '$'||cast(cents {div} 100 AS {text}) END AS money_txt",
        f"CASE WHEN event_id%997 = 5 THEN '98765.5' WHEN event_id%11 = 0 THEN 'NaN' "
        f"ELSE cast(cents {div} 100 AS {text})||'.'||lpad(cast(cents%100 AS {text}), 2, '0') END AS num_txt",
        f"cast(1700000000 + event_id AS {text}) AS epoch_txt", "props",
        f"CASE event_id%3 WHEN 0 THEN ' '||event_type WHEN 1 THEN event_type||' ' ELSE 'null' END AS note_txt",
    ]


MESSY_EVENTS_SQL = (
    "SELECT " + ", ".join(_event_columns("varchar", "//", "strftime(ts, '%Y-%m-%d %H:%M:%S')"))
    + " FROM (SELECT *, md5(cast(event_id AS varchar)) AS h, cast(round(value*100) AS bigint) AS cents"
    " FROM events) b")


def messy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "events").selectExpr(
        "*", "md5(cast(event_id AS string)) AS h", "cast(round(value*100) AS bigint) AS cents")
    return base.selectExpr(*_event_columns(
        "string", "div", "date_format(ts, 'yyyy-MM-dd HH:mm:ss')")).withColumnRenamed(
        "event_id", "row_idx")


ORDERS_TARGET = TargetSchema(
    "orders_clean",
    (
        TargetColumn("customer_id", "integer", nullable=False, udt_name="int4"),
        TargetColumn("price", "numeric", nullable=False, udt_name="numeric", precision=10, scale=2),
        TargetColumn("order_date", "date"),
        TargetColumn("active", "boolean", udt_name="bool"),
        TargetColumn("created_at", "timestamp with time zone", nullable=False, default="now()"),
    ),
    primary_key=("customer_id",),
)

ORDERS_MAPPING = Mapping((
    MappingRule("cust_txt", "customer_id", confidence=0.95, transformation="to_integer"),
    MappingRule("price_txt", "price", confidence=0.9, transformation="to_number"),
    MappingRule("date_txt", "order_date", confidence=0.65, transformation="to_date"),
    MappingRule("flag_txt", "active", confidence=0.8, transformation="to_boolean"),
))
