"""First-k selection in row order."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quaymaster.session import hold

BLOCK_ROWS = 8192


def first_k_per_group(df: DataFrame, group: list[str], k: int, order=("row_idx",),
                      rank: str = "rn") -> DataFrame:
    """The first ``k`` rows of each group.

    ``row_number() <= k`` is planned with a map-side group limit, so at most
    ``k`` rows per group and task are shuffled however large a group is.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def text_rows(df: DataFrame, columns: Sequence[str], row_idx: str = "row_idx",
              keep: Sequence[str] = ()) -> DataFrame:
    """Long form ``(row_idx, column, value)`` with absent values as ''."""
    as_text = df.select(*keep, F.col(row_idx).alias("row_idx"), *[
        F.coalesce(F.col("`" + c.replace("`", "``") + "`").cast("string"), F.lit("")).alias(f"c{i}")
        for i, c in enumerate(columns)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("value"))
                      for i, c in enumerate(columns)])
    return as_text.select(*keep, "row_idx", F.inline(pairs))


def _block(row_idx: str) -> Column:
    return F.floor(F.col(row_idx) / BLOCK_ROWS).cast("bigint")


def _first_blocks(hits: DataFrame, group: str, k: int) -> DataFrame:
    """The first blocks of each group that together hold ``k`` hits: at most k rows per group."""
    first = first_k_per_group(hits, [group], k, ["block"])
    before = Window.partitionBy(group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return first.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).filter(
        F.col("before") < k).select(group, "block")


def first_k_values(df: DataFrame, columns: Sequence[str], wanted: Callable[[Column], Column], k: int,
                   row_idx: str = "row_idx") -> DataFrame:
    """First ``k`` wanted text values per column in row order: ``(column, row_idx, value, rn)``.

    Values are counted per block of consecutive row indexes; then only the first
    blocks that hold ``k`` of them are read for the rows, so nothing else is sorted.
    The work per row is the same small expression for any number of columns.
    """
    rows = text_rows(df, columns, row_idx).filter(wanted(F.col("value")))
    hits = rows.groupBy("column", _block("row_idx").alias("block")).agg(F.count(F.lit(1)).alias("n"))
    # At most k blocks per column: a proven size for both broadcasts.
    blocks = hold(_first_blocks(hits, "column", k))
    near = df.withColumn("block", _block(row_idx)).join(
        F.broadcast(blocks.select("block").distinct()), "block", "left_semi")
    found = text_rows(near, columns, row_idx, ["block"]).filter(wanted(F.col("value"))).join(
        F.broadcast(blocks), ["column", "block"], "left_semi")
    return first_k_per_group(found.drop("block"), ["column"], k)


def first_k_matching(df: DataFrame, tests: dict[str, tuple[Column, Column]], k: int,
                     row_idx: str = "row_idx") -> DataFrame:
    """First ``k`` rows in row order for every tag: ``(tag, row_idx, value, rn)``.

    ``tests`` maps a tag to ``(value, condition)``. Rows are counted per block of
    consecutive indexes; only the first ``k`` non-empty blocks of a tag are then
    read for the rows themselves, so nothing but those blocks is ever sorted.
    """
    tags = list(tests)
    block = _block(row_idx)
    hits = df.groupBy(block.alias("block")).agg(
        *[F.count(F.when(tests[t][1], 1)).alias(f"n{i}") for i, t in enumerate(tags)])
    per_tag = hits.select("block", F.posexplode(F.array(*[F.col(f"n{i}") for i in range(len(tags))])))
    wanted = _first_blocks(per_tag.filter("col > 0").withColumnRenamed("col", "n"), "pos", k)
    # At most k blocks per tag: a proven size for the broadcast side.
    wanted = wanted.groupBy("block").agg(F.collect_set("pos").alias("wanted"))
    entries = F.array_compact(F.array(*[
        F.when(F.array_contains("wanted", i) & tests[t][1],
               F.struct(F.lit(t).alias("tag"), tests[t][0].cast("string").alias("value")))
        for i, t in enumerate(tags)]))
    rows = (df.withColumn("block", block).join(F.broadcast(wanted), "block")
            .select(F.col(row_idx).alias("row_idx"), F.inline(entries)))
    return first_k_per_group(rows, ["tag"], k)
