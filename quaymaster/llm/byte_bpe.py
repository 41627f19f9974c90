"""Byte-level BPE encoding and decoding with a given rank file.

Long texts are cut into overlapping chunks that are pre-tokenised side by side. A
chunk starts at an arbitrary place, so its first boundaries may be wrong; where a
boundary in the overlap is also one of the chunk before, both have resynchronised,
because matching goes on from a boundary in one way only. Pieces between such
points are encoded on their own. Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F

from quaymaster.llm.common import blocks, bounded_batches, struct, whole, written

BLOCK_BYTES = 1 << 20
ROWS = 256  # rows decoded at a time
LOOKAHEAD = 4  # a match that ends so far before the end of a chunk did not depend on what follows the chunk


@functools.lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    import tiktoken
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


@functools.lru_cache(maxsize=4)
def id_bytes(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in ranks(path).items()}


def boundaries(pattern: str, text: str, last: bool) -> list[int]:
    """Starts and ends of the matches in ``text`` that what follows it cannot change."""
    sure = len(text) + 1 if last else len(text) - LOOKAHEAD + 1
    found = [0]
    for match in regex.finditer(pattern, text):
        if match.end() >= sure:
            break
        found.append(match.end())
    return found


def _encode_rows(path: str, pattern: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path, pattern).encode_ordinary
        for batch in batches:
            for part in blocks([batch], "text", BLOCK_BYTES):
                ids = pa.array([np.array(encode(text), np.int32) for text in part.column("text").to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], ids], names=[*keep, "ids"])
    return run


def _chunks(chunk: int, overlap: int):
    def run(batches):
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                starts = range(0, max(len(text) - overlap, 1), chunk)
                for no, start in enumerate(starts):
                    yield pa.RecordBatch.from_pydict({"key": [key], "no": [no], "start": [start], "last": [no == len(starts) - 1],
                                                      "text": [text[start:start + chunk + overlap]]}, schema=CHUNK)
    return run


CHUNK = pa.schema([("key", pa.int64()), ("no", pa.int64()), ("start", pa.int64()), ("last", pa.bool_()), ("text", pa.string())])


def _pretokenise(pattern: str, chunk: int, overlap: int):
    def run(batches):
        for batch in batches:
            head, tail = [], []
            for start, last, text in zip(batch.column("start").to_pylist(), batch.column("last").to_pylist(), batch.column("text").to_pylist()):
                at = boundaries(pattern, text, last)
                head.append([start + p for p in at if p <= overlap])
                tail.append([start + p for p in at if p >= chunk])
            kept = [batch.column(c) for c in ("key", "no", "start", "text")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(head, pa.list_(pa.int64())), pa.array(tail, pa.list_(pa.int64()))],
                                             names=["key", "no", "start", "text", "head", "tail"])
    return run


def _join_chunks(batches):
    for batch in batches:
        out = []
        for row in batch.select(["begin", "end", "parts"]).to_pylist():
            parts = sorted(row["parts"], key=lambda p: p["no"])
            first, texts, upto = parts[0]["start"], [], parts[0]["start"]
            for p in parts:
                texts.append(p["text"][upto - p["start"]:])
                upto = p["start"] + len(p["text"])
            end = None if row["end"] is None else row["end"] - first
            out.append("".join(texts)[row["begin"] - first:end])
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("run"), pa.array(out, pa.string())], names=["key", "run", "text"])


def stitched_pieces(long: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Pieces (key, run, text) of ``long`` (key, text) that begin and end at boundaries of the whole text.

    After a chunk without a common boundary (one match longer than the overlap)
    nothing shows where its boundaries are true, so the rest of that text stays one piece.
    """
    cut = long.select("key", "text").mapInArrow(_chunks(chunk, overlap), struct("key long, no long, start long, last boolean, text string"))
    seen = (cut.repartition(F.col("key"), F.col("no"))
            .mapInArrow(_pretokenise(pattern, chunk, overlap), struct("key long, no long, start long, text string, head array<long>, tail array<long>")))
    in_order = Window.partitionBy("key").orderBy("no")
    sync = F.when(F.col("no") == 0, F.lit(0).cast("long")).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(in_order))))
    runs = (seen.withColumn("sync", sync).drop("head", "tail")
            .withColumn("sure", F.min(F.col("sync").isNotNull()).over(in_order))
            .withColumn("run", F.max(F.when(F.col("sure"), F.col("no"))).over(in_order))
            .groupBy("key", "run").agg(F.min(F.when(F.col("sure"), F.col("sync"))).alias("begin"), F.collect_list(F.struct("no", "start", "text")).alias("parts"))
            .withColumn("end", F.lead("begin").over(Window.partitionBy("key").orderBy("run"))))
    return runs.mapInArrow(_join_chunks, struct("key long, run long, text string"))


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = 32_768, overlap: int = 1_024,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every whole text: (id_col, ids array<int>), one row per row of ``docs``.

    Texts of one chunk are encoded where they are read. Longer ones get a key by being
    written once (a repeated or null id is no key), then go through the chunks. Null
    texts count as empty and give an empty list; an empty table gives an empty result.
    Only the two named columns are read. ``path`` must be readable on the executors.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    id_type = texts.schema["id"].dataType.simpleString()
    short = (texts.filter(F.length("text") <= chunk + overlap)
             .mapInArrow(_encode_rows(path, pattern, ["id"]), struct(f"id {id_type}, ids array<int>")))
    long = written(texts.filter(F.length("text") > chunk + overlap).withColumn("key", F.monotonically_increasing_id()), "bpe-long")
    pieces = stitched_pieces(long, pattern, chunk, overlap).mapInArrow(
        _encode_rows(path, pattern, ["key", "run"]), struct("key long, run long, ids array<int>"))
    joined = pieces.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("run", "ids"))), lambda x: x["ids"])).alias("ids"))
    return short.union(long.select("id", "key").join(joined, "key").select("id", "ids")).withColumnRenamed("id", id_col)


def _decode_rows(path: str, at: int):
    def run(batches):
        table = id_bytes(path)
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            ids = batch.column(at)
            offsets, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
            texts = [b"".join(map(table.__getitem__, flat[a:b].tolist())) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, "decoded"])
    return run


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded`` (binary): the bytes of the ids in order. A null list gives empty bytes.

    A column ``decoded`` of the input is replaced.
    """
    kept = encoded.drop("decoded").withColumn(ids_col, F.coalesce(ids_col, F.array().cast("array<int>")))
    schema = struct(kept._jdf.schema().toDDL()).add("decoded", "binary")
    return kept.mapInArrow(_decode_rows(path, kept.columns.index(ids_col)), schema)
