"""Mix sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Everything is DataFrame expressions. A row's place in its source's order is a digest
of id, text and seed; the rows up to one cut digest per source get the extra
repetition, so a decision needs only the row and one small record of its source.
The cut is found without sorting a source: sizes are summed per source and digest
bin, and only the bin in which the wanted size is reached is ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quaymaster.llm.common import WORD, written

BIN_DIGITS = 4  # hexadecimal digits of the digest that name a bin: 65,536 bins a source
BROADCAST_SOURCES = 20_000  # records of this many sources (about 150 bytes each) are broadcast


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(doc_id: Column, text: Column, seed: int) -> Column:
    """Digest that orders the rows of a source; only rows with equal id and text are tied."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(F.md5(text), F.lit(""))))


def water_fill(sources: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Targets of ``sources`` (source, source_size): ``share`` of all sizes by weight, at most ``cap`` times a size.

    Weights repeat over the sources in code point order, null last. Filling by weight
    reaches the caps in the order of cap / weight, so the level at which nothing is
    left to reshare is the first that the next cap does not undercut. If every source
    is full, the targets are the caps.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    ranked = (sources.withColumn("weight", weight).withColumn("ceiling", F.col("source_size") * cap)
              .withColumn("ratio", F.col("ceiling") / F.col("weight"))
              .withColumn("wanted", F.sum("source_size").over(everything) * share))
    level = (F.col("wanted") - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    levelled = (ranked.withColumn("level", level)
                .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"]))
    return levelled.select("source", "source_size", "weight",
                           F.when(F.col("level").isNull(), F.col("ceiling"))
                           .otherwise(F.least("ceiling", F.col("level") * F.col("weight"))).alias("target"))


def mix_plan(rows: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """One record a source from ``rows`` (source, place, size): target, whole repetitions and the cut digest.

    Rows with a digest up to ``cut`` get one repetition more; a null cut gives it to none.
    """
    rows = rows.withColumn("bin", F.substring("place", 1, BIN_DIGITS))
    bins = written(rows.groupBy("source", "bin").agg(F.sum("size").alias("size")), "mix-bins")
    targets = water_fill(bins.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    times = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0))
    targets = targets.withColumn("whole", times.cast("int")).withColumn("more", F.col("target") - F.col("whole") * F.col("source_size"))
    so_far = Window.partitionBy("source").orderBy("bin")
    reached = (bins.withColumn("upto", F.sum("size").over(so_far))
               .join(targets.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name")))
               .filter((F.col("more") > 0) & (F.col("upto") >= F.col("more")) & (F.col("upto") - F.col("size") < F.col("more")))
               .groupBy("source").agg(F.min(F.struct("bin", (F.col("upto") - F.col("size")).alias("start"), "more")).alias("at"))
               .select(F.col("source").alias("name"), "at.*"))
    inside = (rows.join(reached.withColumnRenamed("bin", "at_bin"), F.col("source").eqNullSafe(F.col("name")) & (F.col("bin") == F.col("at_bin")))
              .withColumn("upto", F.col("start") + F.sum("size").over(Window.partitionBy("name", "at_bin").orderBy("place"))))
    # The end of the last bin before it, or the row whose running size is nearest to what is wanted.
    cuts = (inside.select("name", F.abs(F.col("upto") - F.col("more")).alias("off"), F.col("place").alias("cut"))
            .union(reached.select("name", F.abs(F.col("start") - F.col("more")), F.col("bin")))
            .groupBy("name").agg(F.min(F.struct("off", "cut"))["cut"].alias("cut")))
    return (targets.join(cuts, F.col("source").eqNullSafe(F.col("name")), "left")
            .select("source", "source_size", "weight", "target", "whole", "cut"))


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Each row beside its source's record; broadcast only when the counted sources are few, else Spark chooses."""
    plan = plan.withColumnRenamed("source", "plan_source")
    if plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    return rows.join(plan, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")


def _repetitions() -> Column:
    return F.col("whole") + F.when(F.col("place") <= F.col("cut"), 1).otherwise(0)


def mixed(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 7,
          id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """What the mix takes of every document: doc_id, size, source_size, target, taken, repetitions.

    Sizes are words; a null or empty text has size 0 and is taken with 0 words. Null
    is a source of its own, after the others. A source without words has target 0.
    Repeated rows with equal id and text are tied and get the same repetitions. An
    empty table gives an empty result. Only the three named columns are read.
    """
    rows = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
                               place(F.col(id_col), F.col(text_col), seed).alias("place")), "mix-rows")
    plan = written(mix_plan(rows.drop("doc_id"), weights, share, cap), "mix-plan")
    return _with_plan(rows, plan).select(
        F.col("doc_id").alias(id_col), "size", "source_size", "target", (F.col("size") * _repetitions()).alias("taken"),
        _repetitions().cast("int").alias("repetitions"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 7,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus itself: the rows of ``docs`` with all their columns, each repeated as often as the mix takes it.

    A row's decision depends on its source's record alone, so no text is shuffled.
    Edge cases are those of :func:`mixed`; rows of size 0 follow the same order.
    """
    columns = docs.columns
    rows = docs.select(F.struct("*").alias("row"), F.col(source_col).alias("source"), place(F.col(id_col), F.col(text_col), seed).alias("place"))
    sized = written(docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
                                place(F.col(id_col), F.col(text_col), seed).alias("place")), "mix-rows")
    plan = written(mix_plan(sized, weights, share, cap), "mix-plan")
    repeated = _with_plan(rows, plan).withColumn("copy", F.explode(F.array_repeat(F.lit(1), _repetitions().cast("int"))))
    return repeated.select(*[F.col("row").getField(c).alias(c) for c in columns])
