"""Session helper and lineage cutting."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cpus: int = 8, partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("quaymaster")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Recording the Python call site of every column costs more than small plans do.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable ``checkpoint()`` in the shared folder the cluster names.

    Only a local session with no folder set gets a temporary one.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get(CHECKPOINT_KEY, None) or sc.getConf().get(CHECKPOINT_KEY)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="quaymaster-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


_held: list[list[DataFrame]] = []  # the frames held within each open :func:`held_frames`


def hold(df: DataFrame) -> DataFrame:
    """Keep a frame that several readings share, in memory and then on disk, until the :func:`held_frames` around it ends.

    Outside of one it stays until ``spark.catalog.clearCache()``.
    """
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    if _held:
        _held[-1].append(df)
    return df


@contextmanager
def held_frames() -> Iterator[None]:
    """Frames that operators hold within are released at the end; write what is wanted of the results before."""
    _held.append([])
    try:
        yield
    finally:
        for df in _held.pop():
            df.unpersist()


def small_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A DataFrame of caller-supplied metadata (rules, columns), as a literal plan node."""
    fields = T.StructType.fromDDL(schema).fields
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
    items = [
        F.struct(*[_literal(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields)])
        for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*items)))


def _literal(v):
    if isinstance(v, (list, tuple)):
        return F.array(*[F.lit(x) for x in v])
    return F.lit(v)
