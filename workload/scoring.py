"""Scoring a mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaymaster.model import Mapping, MappingRule, TargetColumn, TargetSchema
from quaymaster.operators import evaluate as ev
from workload import expected as K
from workload.inputs import ORDERS_MAPPING, ORDERS_TARGET, indexed_orders, table
from workload.profiling import LIVE, LONG_ORDERS, ORDER_COLUMNS
from workload.registry import extract_number, match, query, t, ts

c = F.col
PAIRS = [("cust_txt", "to_integer"), ("price_txt", "to_number"), ("date_txt", "to_date"),
         ("flag_txt", "to_boolean"), ("price_txt", "to_integer"), ("flag_txt", "to_number")]


def _ok(kind: str) -> str:
    num = extract_number("value")
    return {"to_integer": f"coalesce({num} = floor({num}), false)", "to_number": f"{num} IS NOT NULL",
            "to_date": f"{ts('value')} IS NOT NULL", "to_boolean": match(t("value"), K.BOOLEAN_WORD)}[kind]


def _filled(sample: bool) -> str:
    base = f"""SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY row_idx) AS rn
 FROM ({LONG_ORDERS}) l WHERE {t('value')} <> ''"""
    return f"SELECT * FROM ({base}) f" + (" WHERE rn <= 20" if sample else "")


def _rates_sql(sample: bool) -> str:
    return " UNION ALL ".join(f"""
SELECT '{s}' AS source, '{k}' AS transformation, round(avg(cast({_ok(k)} AS int)), 6) AS rate
FROM ({_filled(sample)}) x WHERE "column" = '{s}'""" for s, k in PAIRS)


def _steps_sql(rates: str) -> str:
    return f"""SELECT *, CASE WHEN rate >= 0.95 THEN 1e0 WHEN rate >= 0.8 THEN 0.7e0 WHEN rate >= 0.5 THEN 0.3e0
 ELSE 0e0 END AS cast_score FROM ({rates}) r"""


@query("q_cast_score", _steps_sql(_rates_sql(True)))
def q_cast_score(spark, sf):
    r = ev.cast_rates(indexed_orders(spark, sf), PAIRS, scope="sample")
    return r.select("source", "transformation", F.round("rate", 6).alias("rate"),
                    ev.cast_step(c("rate")).alias("cast_score"))


@query("q_cast_score_all_rows", _steps_sql(_rates_sql(False)))
def q_cast_score_all_rows(spark, sf):
    r = ev.cast_rates(indexed_orders(spark, sf), PAIRS, scope="all")
    return r.select("source", "transformation", F.round("rate", 6).alias("rate"),
                    ev.cast_step(c("rate")).alias("cast_score"))


@query("q_cast_examples", " UNION ALL ".join(f"""
SELECT '{s}' AS source, '{k}' AS transformation, string_agg(value, '|' ORDER BY row_idx) AS examples FROM (
 SELECT * FROM ({LONG_ORDERS}) l WHERE "column" = '{s}' AND value <> '' AND NOT ({t('value')} = '' OR {_ok(k)})
 ORDER BY row_idx LIMIT 3) x""" for s, k in PAIRS if k != "to_integer" or s == "price_txt"))
def q_cast_examples(spark, sf):
    pairs = [p for p in PAIRS if p != ("cust_txt", "to_integer")]
    return ev.cast_examples(indexed_orders(spark, sf), pairs).withColumn("examples", F.array_join("examples", "|"))


_STATS_SQL = f"""SELECT "column" AS source, avg(CASE WHEN {LIVE} THEN 0.0 ELSE 1.0 END) AS null_rate,
 count(*) AS total_count, coalesce(max(CASE WHEN {LIVE} THEN length(value) END), 0) AS max_length,
 count(DISTINCT CASE WHEN {LIVE} THEN value END) AS unique_count FROM ({LONG_ORDERS}) l GROUP BY 1"""


@query("q_column_stats", f"""
SELECT source, round(null_rate, 6) AS null_rate, total_count, max_length,
 CASE WHEN source IN ('cust_txt', 'date_txt') THEN unique_count END AS unique_count FROM ({_STATS_SQL}) s""")
def q_column_stats(spark, sf):
    s = ev.column_stats(indexed_orders(spark, sf), ORDER_COLUMNS, ["cust_txt", "date_txt"])
    return s.select("source", F.round("null_rate", 6).alias("null_rate"), "total_count",
                    c("max_length").cast("bigint").alias("max_length"), "unique_count")


# Candidate mappings: the usual one, one that misses a required column, one with a wrong cast.
WORSE = Mapping((MappingRule("cust_txt", "customer_id", confidence=0.9, transformation="to_integer"),
                 MappingRule("flag_txt", "active", confidence=0.6, transformation="to_boolean")))
WRONG = Mapping((MappingRule("cust_txt", "customer_id", confidence=0.9, transformation="to_integer"),
                 MappingRule("flag_txt", "price", confidence=0.5, transformation="to_number"),
                 MappingRule("date_txt", "order_date", confidence=0.9, transformation="to_date")))
CANDIDATES = [WORSE, ORDERS_MAPPING, WRONG]


def _score_sql(n: int, m: Mapping) -> str:
    rules = " UNION ALL ".join(
        f"SELECT '{r.source}' AS source, '{r.transformation}' AS transformation, {r.confidence} AS conf, "
        f"{str(ORDERS_TARGET.column(r.target).required).lower()} AS required, "
        f"{int(r.target == 'customer_id')} AS key_use" for r in m.rules)
    missing = len([x for x in ORDERS_TARGET.required if x.name not in {r.target for r in m.rules}])
    return f"""
SELECT {n} AS candidate, type_score, null_score, unique_score, {1 - missing / 2} AS required_score, confidence_score,
 0.3 * type_score + 0.2 * null_score + 0.15 * unique_score + 0.25 * {1 - missing / 2} + 0.1 * confidence_score AS score,
 {missing} + c1 + c2 + c3 AS criticals FROM (
 SELECT avg(cast_score) AS type_score,
  greatest(0, 1 - 0.3 * sum(cast(required AND null_rate > 0.2 AS int))) AS null_score,
  greatest(0, 1 - 0.4 * sum(CASE WHEN unique_count < total_count - total_count * null_rate THEN key_use ELSE 0 END)) AS unique_score,
  avg(conf) AS confidence_score, sum(cast(cast_score = 0 AS int)) AS c1,
  sum(cast(required AND null_rate > 0.5 AS int)) AS c2,
  sum(CASE WHEN unique_count < total_count - total_count * null_rate THEN key_use ELSE 0 END) AS c3
 FROM ({rules}) r JOIN ({_STATS_SQL}) s USING (source)
 JOIN ({_steps_sql(_rates_sql(False))}) p USING (source, transformation)) a"""


SCORES_SQL = " UNION ALL ".join(_score_sql(n, m) for n, m in enumerate(CANDIDATES))
_ROUNDED = ["type_score", "null_score", "unique_score", "required_score", "confidence_score", "score"]


@query("q_score", "SELECT candidate, criticals, score >= 0.8 AND criticals = 0 AS passed, "
       + ", ".join(f"round(cast({x} AS double), 6) AS {x}" for x in _ROUNDED) + f" FROM ({SCORES_SQL}) s")
def q_score(spark, sf):
    s = ev.evaluate_mappings(indexed_orders(spark, sf), CANDIDATES, ORDERS_TARGET).scores
    return s.select("candidate", c("criticals").cast("bigint").alias("criticals"), "passed",
                    *[F.round(x, 6).alias(x) for x in _ROUNDED])


@query("q_best_mapping", f"SELECT candidate, round(score, 6) AS score FROM ({SCORES_SQL}) s "
       "ORDER BY score DESC, candidate LIMIT 1")
def q_best_mapping(spark, sf):
    return ev.best_mapping(indexed_orders(spark, sf), CANDIDATES, ORDERS_TARGET).select(
        "candidate", F.round("score", 6).alias("score"))


@query("q_issues", f"""
SELECT 1 AS section, 'price_txt' AS "column", 'warning' AS severity, n AS n_examples FROM (
  SELECT least(3, count(*)) AS n FROM ({LONG_ORDERS}) l WHERE "column" = 'price_txt' AND value <> ''
   AND NOT ({t('value')} = '' OR {_ok('to_number')})) a WHERE (SELECT cast_score FROM ({_steps_sql(_rates_sql(False))}) r
   WHERE source = 'price_txt' AND transformation = 'to_number') BETWEEN 0.1 AND 0.69
UNION ALL SELECT 1, 'flag_txt', 'warning', 3 FROM ({_steps_sql(_rates_sql(False))}) r
 WHERE source = 'flag_txt' AND transformation = 'to_boolean' AND cast_score BETWEEN 0.1 AND 0.69
UNION ALL SELECT 1, 'date_txt', 'warning', 3 FROM ({_steps_sql(_rates_sql(False))}) r
 WHERE source = 'date_txt' AND transformation = 'to_date' AND cast_score BETWEEN 0.1 AND 0.69
UNION ALL SELECT 2, source, CASE WHEN null_rate > 0.5 THEN 'critical' ELSE 'warning' END, 0
 FROM ({_STATS_SQL}) s WHERE source IN ('cust_txt', 'price_txt') AND null_rate > 0.2
UNION ALL SELECT 3, source, 'critical', 0 FROM ({_STATS_SQL}) s WHERE source = 'cust_txt'
 AND unique_count < total_count - total_count * null_rate
UNION ALL SELECT 5, 'date_txt', 'warning', 0""")
def q_issues(spark, sf):
    found = ev.evaluate_mapping(indexed_orders(spark, sf), ORDERS_MAPPING, ORDERS_TARGET).issues
    return found.select("section", "column", "severity", F.size("examples").alias("n_examples"))


LINE_TARGET = TargetSchema("lines", (
    TargetColumn("order_key", "bigint", nullable=False), TargetColumn("line_no", "integer", nullable=False),
    TargetColumn("flag", "character varying", max_length=1)),
    primary_key=("order_key", "line_no"))
LINE_MAPPING = Mapping((
    MappingRule("l_orderkey", "order_key", confidence=0.9), MappingRule("l_linenumber", "line_no", confidence=0.9),
    MappingRule("l_returnflag", "flag", confidence=0.9)))


@query("q_unique_compliance", """
SELECT 'single' AS mode, round(cast(greatest(0, 1 - 0.4 * (cast(a < n AS int) + cast(b < n AS int))) AS double), 6) AS unique_score
FROM (SELECT count(DISTINCT l_orderkey) AS a, count(DISTINCT l_linenumber) AS b, count(*) AS n FROM lineitem) x
UNION ALL SELECT 'composite', round(cast(1 - 0.4 * cast(d < n AS int) AS double), 6)
FROM (SELECT count(*) AS d, sum(m) AS n FROM (SELECT count(*) AS m FROM lineitem GROUP BY l_orderkey, l_linenumber) g) y""")
def q_unique_compliance(spark, sf):
    """V3: the column-wise test blames composite keys; the tuple test does not."""
    df = table(spark, sf, "lineitem").selectExpr("monotonically_increasing_id() AS row_idx", "l_orderkey",
                                                 "l_linenumber", "l_returnflag")
    single = ev.evaluate_mapping(df, LINE_MAPPING, LINE_TARGET).scores
    tuples = ev.evaluate_mapping(df, LINE_MAPPING, LINE_TARGET, composite=True).scores
    return single.select(F.lit("single").alias("mode"), F.round("unique_score", 6).alias("unique_score")).union(
        tuples.select(F.lit("composite"), F.round("unique_score", 6)))


_SHAPE = [("cust_txt", "customer_id", "to_integer"), ("price_txt", "price", "to_number"),
          ("date_txt", "order_date", "to_date"), ("flag_txt", "active", "to_boolean")]


@query("q_shape_match", " UNION ALL ".join(f"""
SELECT '{s}' AS source, '{tgt}' AS target, round(avg(CASE WHEN {t('value')} <> '' THEN cast({_ok(k)} AS int) END), 6) AS cast_share
FROM ({LONG_ORDERS}) l WHERE "column" = '{s}'""" for s, tgt, k in _SHAPE))
def q_shape_match(spark, sf):
    m = ev.shape_match(indexed_orders(spark, sf), ORDERS_TARGET)
    wanted = F.struct("source", "target").isin(*[F.struct(F.lit(s), F.lit(tgt)) for s, tgt, _ in _SHAPE])
    return m.filter(wanted).select("source", "target", F.round("cast_share", 6).alias("cast_share"))
