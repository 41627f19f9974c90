"""Readers (S1-S4, U1) and the first rows of a source."""

from __future__ import annotations

import csv
import os
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quaymaster.operators.mapping import ROW_IDX, quoted
from quaymaster.sources.records import BLANKS, has_quoted_breaks, json_objects, quoted_records
from quaymaster.sources.row_index import with_row_index

CORRUPT = "_corrupt"


def read_csv(spark: SparkSession, path: str | list[str], strict: bool = True, row_index: bool = True,
             multi_line: bool | None = None, sep: str = ",") -> DataFrame:
    """Every field a trimmed string, '' for an empty one, header row as names.

    Strict: a row with too few or too many fields raises when it is read.
    Lenient: short rows are filled with '', long rows cut, both leave ``_corrupt``
    set; a source without rows is an error. Line breaks inside quotes belong to their field. Whether there are
    any is looked up once (``multi_line`` tells it instead): files without are parsed line by line,
    files with them are cut into records first (:mod:`records`); both are read in splits. A quote that is never
    closed is an error.
    """
    if multi_line if multi_line is not None else has_quoted_breaks(spark, path, sep):
        return _read_records(spark, path, strict, row_index, sep)
    options = {"header": True, "enforceSchema": True, **_csv_options(sep)}
    _require_same_headers(spark, path)
    names = spark.read.options(**options).csv(path).columns
    # Without pruning the parser sees every field, so a ragged row is noticed whatever
    # columns a query needs. (A text line is read whole in any case.)
    raw = spark.read.options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT,
                             columnPruning=False).schema(_text_fields(names)).csv(path)
    if row_index:
        raw = with_row_index(raw)
    return _checked_fields(raw, names, strict, row_index, path)


def _csv_options(sep: str) -> dict:
    return {"sep": sep, "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True, "quote": '"', "escape": '"'}


def _text_fields(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])


def _read_records(spark: SparkSession, path, strict: bool, row_index: bool, sep: str) -> DataFrame:
    """CSV whose records were cut with their line breaks; the first record of each file is its header."""
    records = quoted_records(spark, path, sep)
    headers = [r[0].lstrip(BLANKS) for r in records.filter("row = first").select("record").distinct().limit(2).collect()]
    if len(headers) > 1:
        raise ValueError(f"different header lines: {headers[0]} and {headers[1]}")
    if not headers:
        raise ValueError(f"no rows in {path}")
    names = [n.strip() for n in next(csv.reader([headers[0]], delimiter=sep, skipinitialspace=True))]
    fields = F.from_csv("record", ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, CORRUPT]),
                        {**_csv_options(sep), "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "columnPruning": "false", "lineSep": "\u0001"})
    raw = records.filter("row > first").select((F.col("row") - F.col("files")).alias(ROW_IDX), fields.alias("s")).select(ROW_IDX, "s.*")
    return _checked_fields(raw, names, strict, row_index, path)


def _checked_fields(raw: DataFrame, names: Sequence[str], strict: bool, row_index: bool, path) -> DataFrame:
    filled = [F.coalesce(quoted(n), F.lit("")).alias(n) for n in names]
    head = [ROW_IDX] if row_index else []
    if not strict:
        out = raw.select(*head, *filled, CORRUPT)
        if out.isEmpty():
            raise ValueError(f"no rows in {path}")
        return out
    # A filter is kept whatever columns a query needs, and under count() too.
    # raise_error must stay uncast: an explicit cast of it is folded to NULL.
    # Naming a field as well, because Spark refuses queries of the corrupt record alone.
    stop = F.raise_error(F.concat(F.lit("wrong number of fields in the row of "), filled[0], F.lit(": "), CORRUPT))
    return raw.filter(F.when(F.col(CORRUPT).isNotNull(), stop).otherwise(F.lit(True))).select(*head, *filled)


def _require_same_headers(spark: SparkSession, path) -> None:
    """One header for all files: names are taken from one of them, so another column order would mislabel rows.

    Reads the first line of every file; what reaches the driver is at most two of them.
    """
    lines = spark.read.text(path).filter(F.col("_metadata.file_block_start") == 0).select(
        F.col("_metadata.file_path").alias("p"), F.monotonically_increasing_id().alias("i"),
        F.btrim("value", F.lit(" \t\r\ufeff")).alias("v"))
    headers = lines.groupBy("p").agg(F.min_by("v", "i").alias("v")).groupBy("v").agg(F.min("p").alias("p")).limit(2).collect()
    if len(headers) > 1:
        raise ValueError(f"different header lines in {headers[0]['p']} and {headers[1]['p']}")


def read_json(spark: SparkSession, path: str | list[str], lines: bool | None = None,
              schema: T.StructType | str | None = None, keys: bool = False, row_index: bool = True) -> DataFrame:
    """S3: objects as rows; keys missing from an object are NULL.

    ``.json`` files hold one array each, ``lines=True`` or a ``.jsonl`` suffix reads one object per line; both
    are read in splits. Anything but objects is
    an error. ``keys`` adds ``_keys``, the keys each object really has.
    """
    first = path if isinstance(path, str) else path[0]
    lines = first.lower().endswith((".jsonl", ".ndjson")) if lines is None else lines
    if lines:
        text = spark.read.text(path)
        raw = with_row_index(text) if row_index else text
        raw = raw.filter(F.btrim("value", F.lit(" \t\r\ufeff")) != "")
        if schema is None:
            schema = spark.read.option("mode", "FAILFAST").json(path).schema
        parsed = F.from_json("value", schema, {"mode": "FAILFAST"}).alias("s")
        extra = [F.json_object_keys("value").alias("_keys")] if keys else []
        return raw.select(*([ROW_IDX] if row_index else []), *extra, parsed).select(
            *([ROW_IDX] if row_index else []), *(["_keys"] if keys else []), "s.*")
    objects = json_objects(spark, path)
    if schema is None:
        schema = _object_schema(objects)
    parsed = F.from_json("record", schema, {"mode": "FAILFAST"}).alias("s")
    extra = [F.json_object_keys("record").alias("_keys")] if keys else []
    return objects.select(F.col("row").alias(ROW_IDX), *extra, parsed).select(
        *([ROW_IDX] if row_index else []), *(["_keys"] if keys else []), "s.*")


# --- fixed values: what types of variant values are as columns ---
_COLUMN_TYPES = (("OBJECT<", "STRUCT<"), ("VARIANT", "STRING"), ("VOID", "STRING"))


def _object_schema(objects: DataFrame) -> str:
    """The columns of the objects: types widened over all rows, text where they conflict; combined per task first."""
    found = objects.agg(F.schema_of_variant_agg(F.parse_json("record"))).first()[0] or "OBJECT<>"
    for variant, column in _COLUMN_TYPES:
        found = re.sub(rf"(?<![`\w]){variant}", column, found)
    found = re.sub(r"(?<![`\w])DECIMAL\(\d+,\s*\d+\)", "DOUBLE", found)
    return found


def read_source(spark: SparkSession, path: str, **options) -> DataFrame:
    """Reader chosen by file extension."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind == ".csv":
        return read_csv(spark, path, **options)
    if kind in (".json", ".jsonl", ".ndjson"):
        return read_json(spark, path, **options)
    if kind == ".parquet":
        df = spark.read.parquet(path)
        return with_row_index(df) if options.get("row_index", True) else df
    raise ValueError(f'unsupported file extension "{kind}"; use .csv, .json, .jsonl or .parquet')


def union_rows(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of different shape under the union of their columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` rows in row order (a bounded top-k per task)."""
    return df.orderBy(ROW_IDX).limit(n)
