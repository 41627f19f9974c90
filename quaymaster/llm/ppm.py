"""Prediction by partial matching over bytes, and smoothed word frequencies beside it.

The trie of byte contexts is a set of tables, one a depth: a row is a context with a
symbol and its count, and the context without its first byte is its suffix link. The
code length of a symbol depends on its context alone, so it is worked out once per
distinct (context, symbol) of the corpus by joins along the suffix links, not once
per byte. Documents are hashed into shards of about equal text; a shard is sent the
code lengths of just the (context, symbol) pairs and words that it holds.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quaymaster.llm.common import SHARD_BYTES, shard_count, shard_of, struct, written

ORDER = 4  # bytes of context
START, END = 0xFF, 0xFE  # neither occurs in UTF-8: what stands before a text, and the symbol after it
SYMBOLS = 255  # 256 bytes without START
PIECE, COUNTED = 1 << 17, 1 << 21  # grams scored and grams counted at a time
END_WORD = b""  # no word is empty
PARTS = "shard int, word binary, gram long, n long"
SCORES = "held_out boolean, n_tokens long, n_known long, base_score double, score double"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and the six ASCII spaces


def gram_pieces(texts: Sequence[str | None], order: int = ORDER, limit: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(grams, start of each part of a text, its text) in pieces of about ``limit``: a gram is a symbol after ``order`` bytes of context."""
    held, rows, size = [], [], 0
    lead = bytes([START]) * order
    for row, text in enumerate(texts):
        raw = lead + (text or "").encode("utf-8", "surrogatepass").lower() + bytes([END])
        for at in range(order, len(raw), limit):
            held.append(raw[at - order:at + limit])
            rows.append(row)
            size += len(held[-1])
            if size >= limit:
                yield _grams(held, rows, order)
                held, rows, size = [], [], 0
    if held:
        yield _grams(held, rows, order)


def _grams(parts: list[bytes], rows: list[int], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = np.frombuffer(b"".join(parts), np.uint8)
    lengths = np.array([len(p) for p in parts])
    grams = np.zeros(len(codes) - order, np.int64)
    for i in range(order + 1):
        grams = (grams << 8) | codes[i:len(codes) - order + i]
    # The first ``order`` bytes of a part are context only.
    starts = np.cumsum(lengths) - lengths
    own = np.ones(len(codes), bool)
    own[(starts[:, None] + np.arange(order)).ravel()] = False
    return grams[own[order:]], starts - order * np.arange(len(parts)), np.array(rows)


class GramTable:
    """Values by gram, looked up many at a time: grams alone in their hash slot are found at once, the others a level further."""

    def __init__(self, grams: np.ndarray, values: np.ndarray):
        self.levels: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        while len(grams):
            bits = (4 * len(grams)).bit_length()
            factor = 0x9E3779B97F4A7C15 + 2 * 0x632BE59BD9B4E019 * len(self.levels) & (1 << 64) - 1
            slot = self._slot(grams, factor, bits)
            alone = np.bincount(slot, minlength=1 << bits)[slot] == 1
            keys, found = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits)
            keys[slot[alone]], found[slot[alone]] = grams[alone], values[alone]
            self.levels.append((factor, bits, keys, found))
            grams, values = grams[~alone], values[~alone]

    @staticmethod
    def _slot(grams: np.ndarray, factor: int, bits: int) -> np.ndarray:
        return ((grams.view(np.uint64) * np.uint64(factor)) >> np.uint64(64 - bits)).astype(np.int64)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        """Values of ``grams``, each of which the table must have."""
        out, left = np.empty(len(grams)), None
        for factor, bits, keys, values in self.levels:
            wanted = grams if left is None else grams[left]
            slot = self._slot(wanted, factor, bits)
            if left is None:
                out = values[slot]
                left = np.flatnonzero(keys[slot] != wanted)
            else:
                out[left] = values[slot]
                left = left[keys[slot] != wanted]
            if not len(left):
                return out
        raise KeyError("gram without a code length")


def _tally(texts: Sequence[str | None], order: int) -> tuple[np.ndarray, np.ndarray]:
    grams, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for found, *_ in gram_pieces(texts, order, COUNTED):
        values, n = np.unique(found, return_counts=True)
        grams.append(values)
        counts.append(n)
    values, index = np.unique(np.concatenate(grams), return_inverse=True)
    return values, np.bincount(index, weights=np.concatenate(counts), minlength=len(values)).astype(np.int64)


def shard_parts(sharded: DataFrame, order: int = ORDER) -> DataFrame:
    """Per shard its distinct words and grams with their counts in training texts (0 where only others have them).

    ``sharded`` has shard, text, train.
    """
    def run(key, rows):
        train = rows["train"].to_numpy()
        texts = rows["text"].to_pylist()
        learned, other = [t for t, x in zip(texts, train) if x], [t for t, x in zip(texts, train) if not x]
        words: Counter[bytes] = Counter()
        for text in learned:
            words.update(words_of(text))
        words[END_WORD] += len(learned)
        for text in other:
            words.update(dict.fromkeys(words_of(text), 0))
        grams, counts = _tally(learned, order)
        unseen = np.setdiff1d(_tally(other, order)[0], grams)
        n = len(words) + len(grams) + len(unseen)
        return pa.table({
            "shard": pa.array(np.full(n, key[0].as_py(), np.int32)),
            "word": pa.concat_arrays([pa.array(list(words), pa.binary()), pa.nulls(n - len(words), pa.binary())]),
            "gram": pa.concat_arrays([pa.nulls(len(words), pa.int64()), pa.array(grams), pa.array(unseen)]),
            "n": pa.concat_arrays([pa.array(list(words.values()), pa.int64()), pa.array(counts), pa.array(np.zeros(len(unseen), np.int64))])})
    return sharded.groupBy("shard").applyInArrow(run, struct(PARTS))


def trie(grams: DataFrame, order: int = ORDER) -> tuple[list[DataFrame], list[DataFrame]]:
    """Tables of each depth: counts (gram, n), and contexts (context, total, symbols, below).

    ``below`` is the sum, at the suffix link, of the counts of the symbols that the context has:
    what exclusion takes from the total there.
    """
    top = grams.filter("n > 0").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = [written(top, "ppm-counts")]
    for k in range(order - 1, -1, -1):
        shorter = counts[0].select(F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("gram"), "n")
        counts.insert(0, written(shorter.groupBy("gram").agg(F.sum("n").alias("n")), "ppm-counts"))
    contexts = []
    for k, level in enumerate(counts):
        rows = level.withColumn("context", F.shiftright("gram", 8))
        if k:
            link = counts[k - 1].select(F.col("gram").alias("suffix"), F.col("n").alias("n_suffix"))
            rows = rows.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))).join(link, "suffix")
        contexts.append(rows.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("symbols"),
                                                    (F.sum("n_suffix") if k else F.lit(0)).alias("below")))
    return counts, contexts


def code_lengths(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, log_p): log10 probability of the symbol in its context, for every distinct gram of ``grams`` (gram, n).

    At each depth a context with ``total`` counts of ``symbols`` symbols, less those that the
    longer context had and so excluded, gives a symbol n / (total + symbols) and the escape to
    its suffix link symbols / (total + symbols). Below the empty context all symbols left are alike.
    """
    counts, contexts = trie(grams, order)
    open_ = grams.select("gram").distinct().withColumns({"log_p": F.lit(0.0), "gone": F.lit(0).cast("long"), "gone_symbols": F.lit(0).cast("long")})
    done = []
    for k in range(order, -1, -1):
        here = F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))
        total, symbols = F.col("total") - F.col("gone"), F.col("symbols") - F.col("gone_symbols")
        looked_up = written(
            open_.withColumns({"here": here, "context": F.shiftright(here, 8)})
            .join(contexts[k], "context", "left")
            .join(counts[k].select(F.col("gram").alias("here"), "n"), "here", "left")
            .select("gram", "n", F.coalesce("below", F.lit(0)).alias("gone"), F.coalesce("symbols", F.lit(0)).alias("gone_symbols"),
                    F.when(F.col("n").isNotNull(), F.col("log_p") + F.log10(F.col("n") / (total + symbols)))
                    .when(symbols > 0, F.col("log_p") + F.log10(symbols / (total + symbols)))
                    .otherwise(F.col("log_p")).alias("log_p")), "ppm-lengths")
        done.append(looked_up.filter("n is not null").select("gram", "log_p"))
        open_ = looked_up.filter("n is null").select("gram", "log_p", "gone", "gone_symbols")
    out = open_.select("gram", F.col("log_p") - F.log10(F.lit(float(SYMBOLS)) - F.col("gone_symbols")))
    for part in done:
        out = out.union(part)
    return out.toDF("gram", "log_p")


def _score_shard(unknown: float, order: int):
    def run(key, docs, entries):
        is_word = entries["word"].is_valid().to_numpy()
        values = entries["value"].to_numpy()
        words = dict(zip(entries["word"].drop_null().to_pylist(), values[is_word].tolist()))
        length = GramTable(entries["gram"].drop_null().to_numpy(), values[~is_word])
        texts = docs["text"].to_pylist()
        base, tokens, known = [], [], []
        for text in texts:
            found = list(map(words.__getitem__, words_of(text)))
            found.append(words.get(END_WORD, unknown))
            base.append(math.fsum(found))
            tokens.append(len(found))
            known.append(len(found) - found.count(unknown))
        score = np.zeros(len(texts))
        for piece, starts, row in gram_pieces(texts, order):
            np.add.at(score, row, np.add.reduceat(length(piece), starts))
        return pa.table({"id": docs["id"], "held_out": pa.array(~docs["train"].to_numpy()), "n_tokens": pa.array(tokens, pa.int64()),
                         "n_known": pa.array(known, pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(score)})
    return run


def score_documents(docs: DataFrame, train: Column, order: int = ORDER, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Learns from the rows where ``train`` holds and scores all. ``score`` is the log10 probability
    of the lower-cased bytes and the end of the text under the model; ``base_score`` that of
    the words and the end under smoothed word frequencies. Null texts count as empty: one
    token, the end. Without training rows every word is unknown and bytes are uniform. Repeated rows
    are learned and scored each. An empty table gives an empty result. Only the named columns are read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    shards = shard_count(rows, shard_bytes=shard_bytes)
    sharded = rows.withColumn("shard", shard_of(F.concat_ws("|", F.col("id").cast("string"), F.md5("text")), shards))
    parts = written(shard_parts(sharded, order), "ppm-parts")
    words, grams = parts.filter("word is not null"), parts.filter("gram is not null").select("shard", "gram", "n")
    counts = written(words.groupBy("word").agg(F.sum("n").alias("n")), "ppm-words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    log_base = lambda n: F.log10((n + 0.5) / F.lit(total + 0.5 * (distinct + 1)))
    unknown = rows.sparkSession.range(1).select(log_base(F.lit(0))).first()[0]
    lengths = written(code_lengths(grams, order), "ppm-codes")
    entries = (words.select("shard", "word").join(counts, "word")
               .select("shard", "word", F.lit(None).cast("long").alias("gram"), log_base(F.col("n")).alias("value"))
               .union(grams.select("shard", "gram").join(lengths, "gram").select("shard", F.lit(None).cast("binary"), "gram", "log_p")))
    id_type = rows.schema["id"].dataType.simpleString()
    scored = sharded.groupBy("shard").cogroup(entries.groupBy("shard")).applyInArrow(_score_shard(unknown, order), struct(f"id {id_type}, {SCORES}"))
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
