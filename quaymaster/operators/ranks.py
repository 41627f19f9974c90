"""Exact weighted rank selection (A5, T4).

A global sort or ``percentile`` would bring every distinct value of a column to
one task. Here a column is cut at approximate quantiles of its distinct values;
one pass adds up the weights per interval, and only the intervals that hold a
wanted rank are looked at again. Each round divides the values still in play by
the number of intervals whatever their distribution, and the loop ends when the
largest remaining interval is small enough to rank in one window partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quaymaster.session import hold

CUTS = 64
SMALL_ENOUGH = 200_000


def select_ranks(values: DataFrame, wanted: DataFrame, group: str, small: int = SMALL_ENOUGH,
                 cuts: int = CUTS) -> DataFrame:
    """Values at 0-based ``rank`` for every ``(group, tag, rank)`` of ``wanted``.

    ``values`` holds ``group, value, cnt`` with distinct values. Returns
    ``group, tag, value``. ``wanted`` has a few rows per group (a proven size).
    """
    values = hold(values.select(F.col(group).alias("g"), "value", "cnt", F.lit(0).cast("bigint").alias("part")))
    targets = wanted.select(F.col(group).alias("g"), "tag", "rank", F.lit(0).cast("bigint").alias("part"))
    while (values.groupBy("g", "part").count().agg(F.max("count")).first()[0] or 0) > small:
        values, targets = _narrow(values, targets, cuts)
    running = Window.partitionBy("g", "part").orderBy("value")
    upto = values.withColumn("upto", F.sum("cnt").over(running))
    hit = upto.join(F.broadcast(targets), ["g", "part"]).filter(
        (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("cnt")))
    return hit.select(F.col("g").alias(group), "tag", "value")


def _narrow(values: DataFrame, targets: DataFrame, cuts: int) -> tuple[DataFrame, DataFrame]:
    shares = [i / cuts for i in range(1, cuts)]
    edges = values.groupBy("g", "part").agg(
        F.array_distinct(F.percentile_approx("value", shares, 10_000)).alias("edges"))
    # One row per group and part still in play: a proven size.
    cut = values.join(F.broadcast(edges), ["g", "part"]).withColumn(
        "cell", F.size(F.filter("edges", lambda e: e < F.col("value")))).drop("edges")
    cells = cut.groupBy("g", "part", "cell").agg(F.sum("cnt").alias("cnt"))
    w = Window.partitionBy("g", "part").orderBy("cell")
    cells = cells.withColumn("upto", F.sum("cnt").over(w))
    located = targets.join(cells, ["g", "part"]).filter(
        (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("cnt"))).select(
        "g", "tag", (F.col("rank") - F.col("upto") + F.col("cnt")).alias("rank"),
        (F.col("part") * cuts + F.col("cell")).alias("next"))
    # Three ranks per group: the list of surviving cells is tiny, and fixing it
    # here keeps the next round from repeating this one for each of its uses.
    located = hold(located)
    keep = located.select("g", F.col("next").alias("part")).distinct()
    narrowed = cut.withColumn("part", F.col("part") * cuts + F.col("cell")).drop("cell").join(
        F.broadcast(keep), ["g", "part"])
    return narrowed.select("g", "value", "cnt", "part"), located.withColumnRenamed("next", "part").select(
        "g", "tag", "rank", "part")
