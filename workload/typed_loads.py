"""Loads into exactly typed columns: decimals, arrays, vectors, and transforms that may throw."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaymaster.model import FixRule, Mapping, MappingRule, TargetColumn, TargetSchema, Transform
from quaymaster.plans.ingest import bucketed_rows, load_reviewed, run_ingestion
from workload.inputs import table
from workload.registry import query

AMOUNTS = TargetSchema("amounts", (TargetColumn("id", "bigint", nullable=False, udt_name="int8"),
                                   TargetColumn("amount", "numeric", precision=20, scale=2)), primary_key=("id",))
# Whole digits beyond what a double holds; one digit more than the scale; too many whole digits; no number.
_AMOUNT = """CASE o_orderkey % 7 WHEN 0 THEN 'abc' WHEN 1 THEN '1234567890123456789.5' WHEN 2 THEN big||'.'||cents||'5'
 WHEN 3 THEN '-'||big||'.'||cents||'5' WHEN 4 THEN ' '||big||' ' ELSE big||'.'||cents END"""
_WHOLE = {"string": "cast(123456789012000000 + o_orderkey AS string) AS big, lpad(cast(o_orderkey % 100 AS string), 2, '0') AS cents",
          "varchar": "cast(123456789012000000 + o_orderkey AS varchar) AS big, lpad(cast(o_orderkey % 100 AS varchar), 2, '0') AS cents"}
_AMOUNTS_SQL = f"""SELECT o_orderkey AS row_idx, {_AMOUNT} AS amount_txt FROM (SELECT o_orderkey, {_WHOLE['varchar']} FROM orders) b"""


def _amounts(spark, sf):
    base = table(spark, sf, "orders").selectExpr("o_orderkey", *_split(_WHOLE["string"]))
    return base.selectExpr("o_orderkey AS row_idx", "cast(o_orderkey AS string) AS id_txt", f"{_AMOUNT} AS amount_txt")


def _split(columns: str) -> list[str]:
    first, second = columns.split(" AS big, ")
    return [f"{first} AS big", second]


@query("q_decimal_load", f"""
SELECT row_idx AS id, cast(CASE WHEN row_idx % 7 > 1 THEN cast(trim(amount_txt) AS decimal(20, 2)) END AS varchar) AS amount,
 CASE row_idx % 7 WHEN 0 THEN 'repaired' WHEN 1 THEN 'unresolved' ELSE 'loaded' END AS bucket,
 CASE row_idx % 7 WHEN 1 THEN 'out_of_range' END AS code FROM ({_AMOUNTS_SQL}) a""")
def q_decimal_load(spark, sf):
    """numeric(20,2) from texts whose digits a double cannot hold."""
    mapping = Mapping((MappingRule("id_txt", "id"), MappingRule("amount_txt", "amount")))
    rows, _ = bucketed_rows(_amounts(spark, sf), mapping, AMOUNTS, [FixRule("nullify", "bad_cast", "amount")])
    code = F.try_element_at("errors", F.lit(1))["code"]
    shown = F.when(F.col("bucket") != "unresolved", F.col("amount")).cast("string")
    return rows.select("id", shown.alias("amount"), "bucket", F.when(F.col("bucket") == "unresolved", code).alias("code"))


@query("q_decimal_reviewed", f"""
SELECT row_idx AS id, cast(CASE row_idx % 7 WHEN 0 THEN NULL WHEN 4 THEN cast(trim(amount_txt) AS decimal(20, 2))
  ELSE cast(replace(amount_txt, ' ', '') AS decimal(20, 2)) END AS varchar) AS amount
FROM ({_AMOUNTS_SQL}) a WHERE row_idx % 7 <> 1""")
def q_decimal_reviewed(spark, sf):
    """The same amounts through named transforms and a batched load, batches of one row."""
    empty = spark.range(0).selectExpr("id", "cast(null AS decimal(20, 2)) AS amount")
    specs = (Transform.named("id_txt", "id", "to_integer"), Transform.named("amount_txt", "amount", "to_number"))
    merged, _ = load_reviewed(_amounts(spark, sf), specs, AMOUNTS, empty, ["id"], batch=1)
    return merged.select("id", F.col("amount").cast("string").alias("amount"))


TAGGED = TargetSchema("tagged", (
    TargetColumn("id", "bigint", nullable=False, udt_name="int8"), TargetColumn("tags", "ARRAY", udt_name="_text"),
    TargetColumn("sizes", "ARRAY", udt_name="_int4"), TargetColumn("embedding", "vector(3)", udt_name="vector")), primary_key=("id",))
_LISTS = ["CASE k % 5 WHEN 0 THEN '{{a'||t||',\"b c\",NULL}}' WHEN 1 THEN '[\"x'||t||'\",\"y,z\"]' WHEN 2 THEN 'p'||t||', q' WHEN 3 THEN '{{}}' ELSE '{{\"open' END AS tags_txt",
          "CASE k % 3 WHEN 0 THEN '{{1,2,'||t||'}}' WHEN 1 THEN '[4, '||t||']' ELSE '1,x' END AS sizes_txt",
          "CASE WHEN k % 11 = 5 THEN '[1,2]' ELSE '['||t||', 0.5,-1]' END AS embedding_txt"]
_LISTS = [x.replace("{{", "{").replace("}}", "}") for x in _LISTS]


@query("q_array_load", """
SELECT k AS id, CASE k % 5 WHEN 0 THEN 'a' || k || '|b c|~' WHEN 1 THEN 'x' || k || '|y,z' WHEN 2 THEN 'p' || k || '|q' WHEN 3 THEN '' END AS tags,
 CASE k % 3 WHEN 0 THEN 3 + k WHEN 1 THEN 4 + k END AS sizes, CASE WHEN k % 11 = 5 THEN 3.0 ELSE k - 0.5 END::DOUBLE AS embedding,
 (k % 5 = 4)::INT + (k % 3 = 2)::INT + (k % 11 = 5)::INT AS n_errors FROM (SELECT c_custkey AS k FROM customer) c""")
def q_array_load(spark, sf):
    """Text arrays, integer arrays and vectors; a list that does not read, or of the wrong length, is a reject that keeps the rest."""
    keys = table(spark, sf, "customer").selectExpr("cast(c_custkey AS bigint) AS k", "cast(c_custkey AS string) AS t")
    df = keys.selectExpr("k AS row_idx", "t AS id_txt", *_LISTS)
    mapping = Mapping(tuple(MappingRule(f"{c}_txt", c) for c in TAGGED.names))
    done = run_ingestion(df, mapping, TAGGED, spark.range(0).selectExpr(
        "id", "cast(null AS array<string>) AS tags", "cast(null AS array<int>) AS sizes", "cast(null AS array<float>) AS embedding"), ["id"])
    total = lambda c: F.aggregate(F.col(c).cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    # Accepted rows as they lie in the merged table, the others as rejects with the values that read.
    rejected = done.rows.filter(F.col("bucket") == "unresolved").select(*TAGGED.names, F.size("errors").alias("n_errors"))
    rows = done.merged.select(*TAGGED.names, F.lit(0).alias("n_errors")).unionByName(rejected)
    return rows.select("id", F.array_join("tags", "|", "~").alias("tags"), total("sizes").cast("bigint").alias("sizes"),
                       total("embedding").alias("embedding"), "n_errors")
