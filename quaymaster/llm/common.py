"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHARD_BYTES = 16 << 20
BITMAP_BITS = 32_768  # of a bitmap of bitmap_construct_agg
MOST_BITMAPS = 1_024  # 4 MB
KEY_BITS = 32
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.parquet.columnarReaderBatchSize": "256"}


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def whole(text: str = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(text), F.lit(""))


def crc_remainder(doc_id: Column, mod: int = 5) -> Column:
    """crc32 of the decimal id modulo ``mod``; a null id counts as remainder of the empty string (0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = _own_folders.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="corpus-")
        _own_folders[spark.sparkContext.applicationId] = folder
    return folder.rstrip("/")


_own_folders: dict[str, str] = {}  # of local sessions without a folder, by application
_lists_of_paths: list[list[str]] = []  # the paths written within each open :func:`temporary_tables`


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Later jobs read the files, so a lost executor costs no recomputation and rows
    keep the keys they were given. Tables written within :func:`temporary_tables` go with it;
    others stay until the scratch folder is emptied.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _lists_of_paths:
        _lists_of_paths[-1].append(path)
    bounded_batches(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Smaller batches of rows from scans and to Python workers, unless the session has its own.

    Texts are long: a batch of the usual 4,096 or 10,000 of them exists several times over, as vectors that grow by doubling.
    """
    for key, value in BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[list[str]]:
    """Tables :func:`written` within are deleted at the end; paths taken out of the list given stay."""
    paths: list[str] = []
    _lists_of_paths.append(paths)
    try:
        yield paths
    finally:
        _lists_of_paths.pop()
        for path in paths:
            delete(spark, path)


def keep_last(paths: list[str]) -> None:
    """The table written last outlives this :func:`temporary_tables`; one around it, if any, deletes it."""
    path = paths.pop()
    if len(_lists_of_paths) > 1:
        _lists_of_paths[-2].append(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a table of the shared folder, wherever that is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def shard_count(texts: DataFrame, text: str = "text", shard_bytes: int = SHARD_BYTES) -> int:
    """Number of shards of about ``shard_bytes`` of text each (one narrow count)."""
    total = texts.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return max(1, math.ceil(total / shard_bytes))


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def marked(rows: DataFrame, keys: DataFrame, columns: list[str], mark: str) -> DataFrame:
    """``rows`` with a boolean column ``mark``: true where ``columns`` are in ``keys``, and for a few others; nowhere else.

    Joins of long rows with few keys shuffle only what is marked. The keys are broadcast as hashed bits, ``KEY_BITS``
    for each up to ``MOST_BITMAPS`` bitmaps; with many more keys more rows are marked in vain. ``keys`` should be a written table.
    """
    bitmaps = min(MOST_BITMAPS, max(1, math.ceil(keys.count() * KEY_BITS / BITMAP_BITS)))
    number, place, bits = (f"{mark}_{name}" for name in ("number", "place", "bits"))
    hashed = F.xxhash64(*columns)
    where = {number: F.pmod(hashed, F.lit(bitmaps)), place: F.pmod(F.shiftrightunsigned(hashed, 32), F.lit(BITMAP_BITS))}
    known = keys.select(*columns).withColumns(where).groupBy(number).agg(F.bitmap_construct_agg(place).alias(bits))
    byte = F.conv(F.hex(F.substring(bits, F.expr(f"cast({place} div 8 + 1 as int)"), F.lit(1))), 16, 10).cast("int")
    found = F.getbit(byte, F.col(place).cast("int") % 8) == 1
    joined = rows.withColumns(where).join(F.broadcast(known), number, "left")
    return joined.select(*rows.columns, F.coalesce(found, F.lit(False)).alias(mark))


def among(rows: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """The rows that :func:`marked` marks: all whose ``columns`` are in ``keys``, and few others."""
    return marked(rows, keys, columns, "among").filter("among").drop("among")


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``limit`` bytes of ``column`` (at least one row)."""
    for batch in batches:
        start, held = 0, 0
        for i, value in enumerate(batch.column(column)):
            size = len(value.as_buffer()) if value.is_valid else 0
            if i > start and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if batch.num_rows > start:
            yield batch.slice(start)


def struct(schema: str) -> T.StructType:
    return T.StructType.fromDDL(schema)
