"""Dense row index in file order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F, types as T

from quaymaster.session import cut_lineage, hold


def _offsets(counts: DataFrame, order: Sequence[str]) -> DataFrame:
    """Running row total before each split: one small row per split, as many as Spark lists itself.

    A split goes by a hash of its name, so a million of them (128 TB in the usual splits) make 32 MB.
    """
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_count").over(w), F.lit(0)))
    return F.broadcast(offsets.select(F.xxhash64(*order).alias("_split"), "_offset", *[c for c in counts.columns if c not in order]))


def with_row_index(df: DataFrame, order_by: Sequence[str] | None = None, name: str = "row_idx") -> DataFrame:
    """0-based position of every row.

    File frames (apply it to the read itself, before any filter) follow file path
    and position, at the price of one narrow counting pass and no shuffle of data.
    Other frames name their order columns; they are sorted once and checkpointed,
    because two evaluations of a range-partitioned sort may cut it differently. Rows that share the order columns
    follow a hash of all their columns, so that their order is fixed and many of them need not go to one task.
    """
    if order_by is not None:
        return _from_sort(df, order_by, name)
    columns = df.columns
    if "row_index" not in df.select("_metadata").schema["_metadata"].dataType.fieldNames():
        return _from_splits(df, columns, name)
    tagged = df.select(*columns, F.col("_metadata.file_path").alias("_path"),
                       F.col("_metadata.row_index").alias("_row")).withColumn("_split", F.xxhash64("_path"))
    counts = hold(tagged.groupBy("_path").agg(F.count(F.lit(1)).alias("_count")))
    return tagged.join(_offsets(counts, ["_path"]).select("_split", "_offset"), "_split").select(
        (F.col("_offset") + F.col("_row")).alias(name), *columns)


def _from_splits(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Text files: offset of the split plus position in the split.

    Ids grow by one inside a split, but splits are packed into tasks by size, so
    each split's own first id is subtracted. A split layout that changed between
    the two passes (other settings, other files) is an error, not a wrong index.
    """
    tagged = df.select(*columns, F.col("_metadata.file_path").alias("_path"),
                       F.col("_metadata.file_block_start").alias("_start"),
                       F.monotonically_increasing_id().alias("_id")).withColumn("_split", F.xxhash64("_path", "_start"))
    counts = hold(tagged.groupBy("_path", "_start").agg(
        F.count(F.lit(1)).alias("_count"), F.min("_id").alias("_first")))
    placed = tagged.join(_offsets(counts, ["_path", "_start"]), "_split", "left")
    at = F.col("_id") - F.col("_first")
    # raise_error must stay uncast: an explicit cast of it is folded to NULL.
    index = F.when((at >= 0) & (at < F.col("_count")), F.col("_offset") + at).otherwise(
        F.raise_error(F.lit("file splits changed while rows were being numbered")))
    return placed.select(index.alias(name), *columns)


def _holds(dtype: T.DataType, kinds: tuple) -> bool:
    if isinstance(dtype, T.StructType):
        return any(_holds(f.dataType, kinds) for f in dtype.fields)
    return isinstance(dtype, kinds) or isinstance(dtype, T.ArrayType) and _holds(dtype.elementType, kinds)


def _from_sort(df: DataFrame, order_by: Sequence[str], name: str) -> DataFrame:
    hashable = [f"`{f.name}`" for f in df.schema.fields if not _holds(f.dataType, (T.MapType, T.VariantType))]
    fixed = cut_lineage(df.orderBy(*order_by, F.xxhash64(*hashable)) if hashable else df.orderBy(*order_by))
    tagged = fixed.select("*", F.spark_partition_id().alias("_part"),
                          F.monotonically_increasing_id().alias("_id")).withColumn("_split", F.xxhash64("_part"))
    counts = hold(tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_count"), F.min("_id").alias("_first")))
    return tagged.join(_offsets(counts, ["_part"]), "_split").select(
        (F.col("_offset") + F.col("_id") - F.col("_first")).alias(name), *df.columns)
