"""Substring deduplication: confirm recurring passages, then locate every occurrence with sharded automata.

Equal texts are one class; only its smallest document takes part. Windows of 50 words
are looked at only where their anchor (the least hash of their 16-word grams) occurs in
several documents. A window belongs to the smallest document that has it; runs of
windows of one owner are the passages. Each shard of documents is sent the passages
that occur in it, compiles their 25-word blocks into an Aho-Corasick automaton over word
numbers and streams its documents through it. Every window of a passage has a whole
block, so widening the hits word by word finds every occurrence.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quaymaster.llm.common import blocks, shard_count, shard_of, struct, written
from quaymaster.llm.windows import anchors, window_hashes

WINDOW, GRAM, BLOCK = 50, 16, 25
SHARD_BYTES = 12 << 20
BLOCK_BYTES = 4 << 20
WHOLE = "id long, n_words long, words_key binary, whole_sha256 string"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()  # bytes split at exactly the six ASCII spaces


class WordHashes:
    """64-bit hashes of words, remembered for a block of texts."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        for w in set(words):
            if w not in self.known:
                self.known[w] = xxhash.xxh64_intdigest(w)
        return np.array([self.known[w] for w in words], np.uint64)


def _describe(batches):
    for part in blocks(batches, "text", BLOCK_BYTES):
        n, keys, shas = [], [], []
        for text in part.column("text").to_pylist():
            words = words_of(text)
            joined = b" ".join(words)
            n.append(len(words))
            keys.append(xxhash.xxh3_128_digest(joined))
            shas.append(hashlib.sha256(joined).hexdigest())
        yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(shas)],
                                         names=["id", "n_words", "words_key", "whole_sha256"])


def _pairs(ids: list[int], values: list[np.ndarray], name: str) -> pa.RecordBatch:
    flat = np.concatenate([np.zeros(0, np.uint64), *values]).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), [len(v) for v in values])), pa.array(flat)], names=["id", name])


def _anchors(batches):
    for part in blocks(batches, "text", BLOCK_BYTES):
        hashes = WordHashes()
        yield _pairs(part.column("id").to_pylist(), [np.unique(anchors(hashes(words_of(t)), WINDOW, GRAM)) for t in part.column("text").to_pylist()], "anchor")


def _windows(batches):
    """Distinct hashes of the windows whose anchor is listed."""
    for part in blocks(batches, "text", BLOCK_BYTES):
        hashes, found = WordHashes(), []
        for text, listed in zip(part.column("text").to_pylist(), part.column("listed")):
            h = hashes(words_of(text))
            wanted = np.isin(anchors(h, WINDOW, GRAM).view(np.int64), listed.values.to_numpy())
            found.append(np.unique(window_hashes(h, WINDOW)[wanted]))
        yield _pairs(part.column("id").to_pylist(), found, "window")


def _passages(batches):
    """Runs of listed windows: (owner, start, text, windows)."""
    for part in blocks(batches, "text", BLOCK_BYTES):
        hashes, rows = WordHashes(), []
        for owner, text, listed in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), part.column("listed")):
            words = words_of(text)
            found = window_hashes(hashes(words), WINDOW).view(np.int64)
            mine = np.flatnonzero(np.isin(found, listed.values.to_numpy()))
            for run in np.split(mine, np.flatnonzero(np.diff(mine) > 1) + 1) if len(mine) else ():
                rows.append((owner, int(run[0]), b" ".join(words[run[0]:run[-1] + WINDOW]).decode("utf-8", "surrogatepass"), found[run]))
        columns = list(zip(*rows)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()),
                                          pa.array(columns[3], pa.list_(pa.int64()))], names=["owner", "start", "text", "windows"])


class PhraseAutomaton:
    """Automaton over the word numbers of the blocks of passages (owner, words)."""

    def __init__(self, passages: list[tuple[int, list[bytes]]]):
        self.numbers: dict[bytes, int] = {}
        self.owners = [owner for owner, _ in passages]
        self.passages = [[self.numbers.setdefault(w, len(self.numbers) + 1) for w in words] for _, words in passages]
        places: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for i, passage in enumerate(self.passages):
            for at in range(0, len(passage) - BLOCK + 1, BLOCK):
                places.setdefault(tuple(passage[at:at + BLOCK]), []).append((i, at))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for block, where in places.items():
            self.automaton.add_word(block, where)
        if places:
            self.automaton.make_automaton()

    def occurrences(self, words: list[bytes]):
        """(owner, begin, end) of the longest stretches of at least a window that ``words`` share with a passage."""
        if not len(self.automaton):
            return
        text = tuple(self.numbers.get(w, 0) for w in words)
        reached: dict[tuple[int, int], int] = {}
        for last, where in self.automaton.iter(text):
            begin = last - BLOCK + 1
            for i, at in where:
                if begin < reached.get((i, begin - at), 0):
                    continue  # inside a stretch already widened
                passage, left, right = self.passages[i], 0, BLOCK
                while left < min(begin, at) and text[begin - left - 1] == passage[at - left - 1]:
                    left += 1
                while begin + right < len(text) and at + right < len(passage) and text[begin + right] == passage[at + right]:
                    right += 1
                reached[i, begin - at] = begin + right
                if left + right >= WINDOW:
                    yield self.owners[i], begin - left, begin + right


def _locate(key, docs, passages):
    automaton = PhraseAutomaton([(o, words_of(t)) for o, t in zip(passages["owner"].to_pylist(), passages["passage"].to_pylist())])
    removed, shas, keys = [], [], []
    for doc_id, text in zip(docs["id"].to_pylist(), docs["text"]):
        words = words_of(text.as_py())
        drop = bytearray(len(words))
        for owner, begin, end in automaton.occurrences(words):
            if owner < doc_id:
                drop[begin:end] = b"\x01" * (end - begin)
        removed.append(sum(drop))
        keys.append(xxhash.xxh3_128_digest(b" ".join(words)))
        shas.append(hashlib.sha256(b" ".join(w for w, d in zip(words, drop) if not d)).hexdigest())
    return pa.table({"id": docs["id"], "words_key": pa.array(keys, pa.binary()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(shas, pa.string())})


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_removed, kept_sha256): words in windows of 50 that a document with a smaller id has too.

    Null and empty texts have no words. Rows with a null id neither lose words nor cost
    others any. Rows with the same id are judged each, and do not count as smaller than one
    another. Repeated rows stay repeated. An empty table gives an empty result. Only the two
    named columns are read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    described = written(texts.mapInArrow(_describe, struct(WHOLE)), "phrase-texts")
    first = written(described.filter(F.col("id").isNotNull() & (F.col("n_words") >= WINDOW)).groupBy("words_key").agg(F.min("id").alias("id")), "phrase-classes")
    anchored = written(texts.filter(F.col("id").isNotNull()).mapInArrow(_anchors, struct("id long, anchor long"))
                       .join(first.select("id").distinct(), "id", "left_semi"), "phrase-anchors")
    recurring = anchored.groupBy("anchor").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least <> most").select("anchor")
    listed = anchored.join(recurring, "anchor").groupBy("id").agg(F.collect_set("anchor").alias("listed"))
    # Texts that can share a window; a repeated id with another text only adds candidates.
    alone = written(texts.join(listed, "id"), "phrase-candidates")
    windows = written(alone.mapInArrow(_windows, struct("id long, window long")), "phrase-windows")
    alone = alone.drop("listed")
    owned = written(windows.groupBy("window").agg(F.min("id").alias("owner"), F.max("id").alias("most")).filter("owner <> most").select("window", "owner"), "phrase-owners")
    by_owner = owned.groupBy(F.col("owner").alias("id")).agg(F.collect_list("window").alias("listed"))
    passages = written(alone.join(by_owner, "id").mapInArrow(_passages, struct("owner long, start long, text string, windows array<long>")), "phrase-passages")
    shards = shard_count(alone, shard_bytes=SHARD_BYTES)
    where = windows.select("window", shard_of(F.col("id"), shards).alias("shard")).distinct()
    sent = (passages.select("owner", "start", F.explode("windows").alias("window")).join(where, "window").select("owner", "start", "shard").distinct()
            .join(passages.select("owner", "start", F.col("text").alias("passage")), ["owner", "start"]))
    located = (alone.withColumn("shard", shard_of(F.col("id"), shards)).groupBy("shard").cogroup(sent.groupBy("shard"))
               .applyInArrow(_locate, struct("id long, words_key binary, n_removed long, kept_sha256 string"))
               .dropDuplicates(["id", "words_key"]))
    classes = first.withColumnRenamed("id", "first").join(located.withColumnRenamed("id", "first"), ["first", "words_key"], "left")
    whole = F.col("id").isNull() | F.col("first").isNull()
    copy = F.col("id") > F.col("first")
    return described.join(classes, "words_key", "left").select(
        F.col("id").alias(id_col), "n_words",
        F.when(whole, F.lit(0)).when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.col("whole_sha256")).when(copy, F.sha2(F.lit("").cast("binary"), 256))
        .otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"))
