"""Near-dedup and repeat removal shuffle texts of which something goes, and copy no table of texts."""

import os

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from quaymaster.llm import common, suffix_repeats


def test_marks_are_all_keys_and_few_others(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 7 > 0, F.col("id")).alias("a"), F.col("id").cast("string").cast("binary").alias("b"))
    keys = rows.filter("cast(cast(b as string) as long) % 11 = 0")
    found = common.marked(rows, keys, ["a", "b"], "m").withColumn("known", F.expr("cast(cast(b as string) as long) % 11 = 0"))
    count = {(r["m"], r["known"]): r["count"] for r in found.groupBy("m", "known").count().collect()}
    assert (False, True) not in count and count[True, True] == 1_819 and count[True, False] < 0.1 * count[False, False]
    assert common.among(rows, keys.limit(0), ["a", "b"]).count() == 0


def test_near_dedup_leaves_no_copy_of_the_texts(spark, docs):
    folder = common.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    with common.temporary_tables(spark):
        corpus_pipeline.keep_one_of_near_duplicates(spark, docs, "").count()
        left = [os.path.join(folder, n) for n in set(os.listdir(folder)) - before]
        assert left and all("text" not in spark.read.parquet(p).columns for p in left if os.path.isdir(p))


def test_the_first_of_repeated_rows_stays(spark, docs):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(3, text, c, None, len(text), *[None] * 6) for c in "cab"] + [(None, text, "d", None, 0, *[None] * 6), (4, None, "e", None, 0, *[None] * 6)]
    one = corpus_pipeline.keep_one_of_near_duplicates(spark, spark.createDataFrame(rows, docs.schema).coalesce(1), "")
    assert sorted((r["doc_id"], r["lang"]) for r in one.collect()) == [(3, "c"), (4, "e")]


def test_ranks_take_four_bytes():
    first = np.array([3, 1, 3, 1 << 30, 1], np.int32)
    for second in (np.array([2, 2, 2, 0, 1], np.int32), np.array([2, 2, 2, 0, 1], np.int64) << 31):
        rank = suffix_repeats._ranks(first, second)
        assert rank.dtype == np.int32 and rank.tolist() == [2, 1, 2, 3, 0]
