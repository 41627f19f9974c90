"""Passages that several texts have, by words: all texts but the first lose them.

Windows of so many words are looked at only where their anchor (the least hash of their
16-word grams) occurs in several texts. A window belongs to the first text that has it;
what windows of others cover is cut.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quaymaster.llm.common import WORD, among, blocks, struct, written
from quaymaster.llm.phrase_automata import WordHashes, words_of
from quaymaster.llm.windows import anchors, window_hashes

GRAM = 16
BLOCK_BYTES = 4 << 20
_WORD = re.compile(WORD.encode())


def _each(part: pa.RecordBatch, values: list[np.ndarray], name: str) -> pa.RecordBatch:
    """Key and id of each row beside every hash found in its text."""
    at = pa.array(np.repeat(np.arange(part.num_rows), [len(v) for v in values]))
    flat = np.concatenate([np.zeros(0, np.uint64), *values]).view(np.int64)
    return pa.RecordBatch.from_arrays([part.column("key").take(at), part.column("id").take(at), pa.array(flat)], names=["key", "id", name])


def _anchors(words: int):
    def run(batches):
        for part in blocks(batches, "text", BLOCK_BYTES):
            hashes = WordHashes()
            yield _each(part, [np.unique(anchors(hashes(words_of(t)), words, min(GRAM, words))) for t in part.column("text").to_pylist()], "anchor")
    return run


def _windows(words: int):
    """Distinct hashes of the windows whose anchor is listed."""
    def run(batches):
        for part in blocks(batches, "text", BLOCK_BYTES):
            hashes, found = WordHashes(), []
            for text, listed in zip(part.column("text").to_pylist(), part.column("listed")):
                h = hashes(words_of(text))
                wanted = np.isin(anchors(h, words, min(GRAM, words)).view(np.int64), listed.values.to_numpy())
                found.append(np.unique(window_hashes(h, words)[wanted]))
            yield _each(part, found, "window")
    return run


def _cuts(words: int):
    """From the first to the last byte of each run of listed windows."""
    def run(batches):
        for part in blocks(batches, "text", BLOCK_BYTES):
            hashes, spans = WordHashes(), []
            for text, listed in zip(part.column("text").to_pylist(), part.column("listed")):
                places = [m.span() for m in _WORD.finditer(text.encode("utf-8", "surrogatepass"))]
                found = np.flatnonzero(np.isin(window_hashes(hashes(words_of(text)), words).view(np.int64), listed.values.to_numpy()))
                runs = np.split(found, np.flatnonzero(np.diff(found) > words) + 1) if len(found) else ()
                spans.append([{"begin": places[r[0]][0], "end": places[r[-1] + words - 1][1]} for r in runs])
            kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(spans, kind)], names=["key", "spans"])
    return run


def later_passages(texts: DataFrame, firsts: DataFrame, words: int) -> DataFrame:
    """(key, spans): bytes of ``texts`` (key, id, text) in passages of ``words`` words that a text before has too.

    Of equal texts only the row in ``firsts`` (key, id) counts; texts come in order of that id, then of their key.
    Words are compared, not what separates them. A passage that only one text has, however often, stays.
    """
    anchored = written(texts.mapInArrow(_anchors(words), struct("key binary, id long, anchor long")), "passage-anchors")
    recurring = anchored.groupBy("anchor").agg(F.min("key").alias("least"), F.max("key").alias("most")).filter("least <> most").select("anchor")
    listed = written(anchored.join(recurring, "anchor").groupBy("key", "id").agg(F.collect_set("anchor").alias("listed"))
                     .join(firsts, ["key", "id"], "left_semi"), "passage-candidates")
    windows = written(among(texts, listed, ["key", "id"]).join(listed, ["key", "id"]).mapInArrow(_windows(words), struct("key binary, id long, window long")), "passage-windows")
    text = F.struct("id", "key")
    owned = windows.groupBy("window").agg(F.min(text).alias("owner"), F.max(text).alias("last")).filter("owner <> last").select("window", "owner")
    lost = written(windows.join(owned, "window").filter(text != F.col("owner")).groupBy("key", "id").agg(F.collect_set("window").alias("listed")), "passage-lost")
    cuts = among(texts, lost, ["key", "id"]).join(lost, ["key", "id"]).mapInArrow(_cuts(words), struct("key binary, spans array<struct<begin: int, end: int>>"))
    return cuts.dropDuplicates(["key"])
