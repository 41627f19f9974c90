"""Repeated byte strings: maximal repeats from enhanced suffix arrays over sharded contexts.

Equal windows of 400 bytes have the same anchor (least hash of their 32-byte grams), so
runs of windows with one anchor, the contexts, need to be compared only with contexts of
that anchor. Equal contexts are counted first. Of what differs, contexts that share the half
of a window before or after the anchor with no other cannot share a window and go no
further. The rest goes to a suffix array per shard of anchors, whose common-prefix interval tree gives the maximal repeats with all
occurrences. An anchor with very many different contexts is not gathered in one shard: its
windows are anchored again with grams nearly as long as a window, and in the end with the
windows themselves, which counting alone decides.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from quaymaster.llm import shared_passages
from quaymaster.llm.common import among, blocks, bounded_batches, keep_last, marked, struct, temporary_tables, written
from quaymaster.llm.windows import sliding_minimum, window_hashes

WINDOW = 400
GRAMS = (32, 384, 400)  # each level anchors what the level before left hot; the last are whole windows
HOT_CONTEXTS = 2_048  # an anchor with more different contexts than this is anchored again
RUN = 512  # longer runs of windows with one anchor are several contexts
SHARD_BYTES = 1 << 20
BLOCK_BYTES = 1 << 20
CONTEXTS = "anchor long, context long, key binary, id long, start int, windows int, inner boolean, before long, after long"
SLICES = "anchor long, context long, key binary, id long, start int, times long, body binary"
SPANS = "key binary, id long, begin int, end int"


def _ranks(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Rank of each pair of non-negative numbers among the different pairs; in 32 bits, as many levels of ranks are held at once."""
    bits = [int(x.max()).bit_length() for x in (first, second)] + [len(first).bit_length()]
    if sum(bits) > 62:
        return np.unique(first.astype(np.int64) * (int(second.max()) + 1) + second, return_inverse=True)[1].astype(np.int32)
    # Pair and place in one number: sorting numbers is several times faster than sorting places by number.
    packed = first.astype(np.int64)
    for more, width in ((second, bits[1]), (np.arange(len(first), dtype=np.int32), bits[2])):
        packed <<= width
        packed |= more
    packed.sort()
    place = (packed & (1 << bits[2]) - 1).astype(np.int32)
    packed >>= bits[2]
    rank = np.zeros(len(first), np.int32)
    rank[place[1:]] = np.cumsum(packed[1:] != packed[:-1], dtype=np.int32)
    return rank


def _ahead(rank: np.ndarray, places: np.ndarray | None, step: int) -> np.ndarray:
    """Ranks ``step`` further on plus one, 0 beyond the end."""
    if places is None:
        return np.concatenate([rank[step:] + 1, np.zeros(min(step, len(rank)), rank.dtype)])
    at = places + step
    return np.where(at < len(rank), rank[np.minimum(at, len(rank) - 1)] + 1, 0).astype(rank.dtype)


def suffix_array(bodies: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(suffixes in order, common prefix with the one before, body of each place, start of each body).

    Only suffixes that share ``least`` bytes with another are listed. By prefix doubling up to
    ``least``, then by as many ranks of that width as the longest body has. Each body ends in a
    symbol of its own, so no common prefix crosses bodies.
    """
    n = len(bodies)
    lengths = np.array([len(b) + 1 for b in bodies])
    starts = np.cumsum(lengths) - lengths
    rank = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8).astype(np.int32) + n
    rank[starts + lengths - 1] = np.arange(n)
    levels, width = [rank], 1
    while width * 2 <= least:
        rank = _ranks(rank, _ahead(rank, None, width))
        width *= 2
        levels.append(rank)
    shared = _ranks(rank, _ahead(rank, None, least - width))
    places = np.flatnonzero(np.bincount(shared)[shared] > 1)
    del shared
    steps = range(0, int(lengths.max()), width)
    order = places[np.lexsort([_ahead(rank, places, step) for step in reversed(steps)])] if len(places) else places
    prefix = np.zeros(len(order), np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    same = np.ones(len(a), bool)
    for level in [len(levels) - 1] * len(steps) + list(reversed(range(len(levels) - 1))):
        whole = level == len(levels) - 1
        inside = (a < len(rank)) & (b < len(rank))
        equal = np.zeros(len(a), bool)
        equal[inside] = levels[level][a[inside]] == levels[level][b[inside]]
        if whole:  # widths follow one another until the first that differs
            same &= equal
            equal = same
        step = equal.astype(np.int64) << level
        a, b = a + step, b + step
        prefix[1:] += step
    return order, prefix, np.repeat(np.arange(n), lengths), starts


def maximal_repeats(bodies: list[bytes], least: int = WINDOW) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, body of each occurrence, place of each occurrence) of every maximal repeat of ``least`` bytes or more.

    A repeat is right-maximal as an interval of the tree of common prefixes and left-maximal
    when its occurrences are preceded by different bytes or one begins a body.
    """
    if not bodies:
        return
    order, prefix, body, starts = suffix_array(bodies, least)
    place = order - starts[body[order]]
    flat = b"\0".join(bodies)
    left = np.where(place == 0, -1 - order, np.frombuffer(b"\0" + flat + b"\0", np.uint8)[order].astype(np.int64))
    runs = np.flatnonzero(prefix >= least)
    begins = runs[np.diff(runs, prepend=-2) > 1] - 1
    ends = runs[np.diff(runs, append=len(prefix) + 1) > 1]
    for first, last in zip(begins.tolist(), ends.tolist()):
        lcp, before = prefix[first:last + 1].tolist(), left[first:last + 1].tolist()
        # Open intervals: (common prefix, first suffix, the byte before all of them or None if they differ).
        stack: list[tuple[int, int, int | None]] = []
        for i in range(1, len(lcp) + 1):
            here = lcp[i] if i < len(lcp) else 0
            begin, seen = i - 1, before[i - 1]
            while stack and stack[-1][0] > here:
                length, begin, own = stack.pop()
                seen = own if own == seen else None
                if seen is None:
                    found = slice(first + begin, first + i)
                    yield length, body[order[found]], place[found]
            if stack and stack[-1][0] == here:
                length, begin, own = stack.pop()
                seen = own if own == seen else None
            if here >= least:
                stack.append((here, begin, seen))


def repeated_spans(bodies: list[bytes], least: int = WINDOW) -> list[list[tuple[int, int]]]:
    """Per body the merged stretches that maximal repeats cover."""
    starts = np.cumsum([0, *(len(b) + 1 for b in bodies)])
    reach = np.zeros(starts[-1], np.int32)
    for length, body, place in maximal_repeats(bodies, least):
        at = starts[body] + place
        reach[at] = np.maximum(reach[at], length)
    out: list[list[tuple[int, int]]] = [[] for _ in bodies]
    for i, (a, b) in enumerate(zip(starts, starts[1:])):
        for begin in np.flatnonzero(reach[a:b]).tolist():
            end = begin + int(reach[a + begin])
            if out[i] and begin <= out[i][-1][1]:
                out[i][-1] = (out[i][-1][0], max(end, out[i][-1][1]))
            else:
                out[i].append((begin, end))
    return out


def _context_rows(gram: int, ranged: bool):
    """Contexts of all windows, or of the windows listed in ``ranges`` (start, windows).

    ``inner`` tells that the anchor occurs more than once in the context, so that windows may repeat within it.
    ``before`` and ``after`` are hashes of the anchor with half of the rest of a window on one side, where the
    context has so much: every window of the context has one of the two.
    """
    half = (WINDOW - gram) // 2
    digest = lambda b, side: xxhash.xxh3_64_intdigest(b, side) >> 1
    def run(batches):
        for part in blocks(batches, "text", BLOCK_BYTES):
            columns: list[list] = [[] for _ in range(9)]
            ranges = part.column("ranges").to_pylist() if ranged else [None] * part.num_rows
            for key, doc_id, text, listed in zip(part.column("key").to_pylist(), part.column("id").to_pylist(), part.column("text").to_pylist(), ranges):
                raw = text.encode("utf-8", "surrogatepass")
                if len(raw) < WINDOW:
                    continue
                grams = window_hashes(np.frombuffer(raw, np.uint8), gram)
                least = sliding_minimum(grams, WINDOW - gram + 1).view(np.int64)
                grams = grams.view(np.int64)
                for begin, end in [(0, len(least))] if listed is None else [(r["start"], r["start"] + r["windows"]) for r in listed]:
                    cuts = np.flatnonzero(np.diff(least[begin:end])) + begin + 1
                    for a, b in zip([begin, *cuts.tolist()], [*cuts.tolist(), end]):
                        for at in range(a, b, RUN):
                            upto = min(at + RUN, b)
                            stop = upto + WINDOW - 1
                            anchor = np.flatnonzero(grams[at:stop - gram + 1] == least[at])
                            where = at + int(anchor[0])
                            before = digest(raw[where - half:where + gram], 1) if where - half >= at else None
                            after = digest(raw[where:where + gram + half], 2) if where + gram + half <= stop else None
                            for column, value in zip(columns, (least[at], xxhash.xxh3_64_intdigest(raw[at:stop]), key, doc_id, at, upto - at,
                                                               len(anchor) > 1, before, after)):
                                column.append(value)
            columns[1] = np.array(columns[1], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()))],
                                             names=["anchor", "context", "key", "id", "start", "windows", "inner", "before", "after"])
    return run


def _slices(batches):
    for part in blocks(batches, "text", BLOCK_BYTES):
        rows = []
        for key, doc_id, text, listed in zip(part.column("key").to_pylist(), part.column("id").to_pylist(), part.column("text").to_pylist(), part.column("ranges").to_pylist()):
            raw = text.encode("utf-8", "surrogatepass")
            rows += [(r["anchor"], r["context"], key, doc_id, r["start"], r["times"], raw[r["start"]:r["start"] + r["windows"] + WINDOW - 1]) for r in listed]
        columns = list(zip(*rows)) or [()] * 7
        types = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["anchor", "context", "key", "id", "start", "times", "body"])


def _shard_spans(key, rows):
    """Spans of the contexts that occur once; those that occur more often are covered as they are."""
    rows = {(r["anchor"], r["context"]): r for r in rows.to_pylist()}
    out = []
    for row, spans in zip(rows.values(), repeated_spans([r["body"] for r in rows.values()])):
        if row["times"] == 1:
            out += [(row["key"], row["id"], row["start"] + a, row["start"] + b) for a, b in spans]
    columns = list(zip(*out)) or [()] * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int32(), pa.int32()))], names=["key", "id", "begin", "end"])


def repeated_places(texts: DataFrame, firsts: DataFrame) -> DataFrame:
    """(key, id, begin, end): stretches of ``texts`` (key, id, text) whose windows also start elsewhere.

    Of equal texts only the row in ``firsts`` (key, id) counts; the others are left out after their
    contexts are made, so that no text is shuffled for it. Stretches of one text may overlap;
    together they cover exactly the repeated bytes.
    """
    found, source = [], texts
    for level, gram in enumerate(GRAMS):
        contexts = source.mapInArrow(_context_rows(gram, level > 0), struct(CONTEXTS))
        contexts = written(contexts if level else contexts.join(firsts, ["key", "id"], "left_semi"), f"repeat-contexts-{gram}")
        place = contexts.select("anchor", "context", "key", "id", F.col("start").alias("begin"), (F.col("start") + F.col("windows") + WINDOW - 1).alias("end"))
        if gram == WINDOW:  # equal anchors are equal windows
            again = contexts.groupBy("anchor").agg(F.sum("windows").alias("n")).filter("n > 1").select("anchor")
            found.append(place.join(again, "anchor").select("key", "id", "begin", "end"))
            break
        counted = written(contexts.groupBy("anchor", "context").agg(F.count("*").alias("times"), F.min(F.struct("key", "id", "start", "windows", "inner", "before", "after")).alias("at")), "repeat-counts")
        again = counted.filter("times > 1").select("anchor", "context")
        found.append(place.join(again, ["anchor", "context"]).select("key", "id", "begin", "end"))
        kinds = counted.groupBy("anchor").agg(F.count("*").alias("kinds"), F.max(F.col("at.inner").cast("int")).alias("inner")).filter("kinds > 1 or inner = 1")
        several = written(counted.select("anchor", "context", "times", "at.key", "at.id", "at.start", "at.windows", "at.before", "at.after")
                          .join(kinds.select("anchor", "inner"), "anchor"), "repeat-several")
        # An anchor that occurs twice in a context may be met at either place: such anchors keep all contexts.
        sides = several.filter("inner = 0").select("anchor", "context", F.explode(F.array_compact(F.array("before", "after"))).alias("side"))
        met = sides.groupBy("anchor", "side").agg(F.count("*").alias("n")).filter("n > 1").select("anchor", "side")
        near = (sides.join(met, ["anchor", "side"]).select("anchor", "context")
                .union(several.filter("inner = 1").select("anchor", "context")).distinct())
        kept = several.drop("before", "after", "inner").join(near, ["anchor", "context"])
        differing = written(kept.join(near.groupBy("anchor").agg(F.count("*").alias("kinds")), "anchor"), "repeat-differing")
        cold, hot = differing.filter(F.col("kinds") <= HOT_CONTEXTS), differing.filter(F.col("kinds") > HOT_CONTEXTS)
        total = cold.agg(F.sum(F.col("windows") + WINDOW)).first()[0] or 0
        shard = F.pmod(F.xxhash64("anchor"), F.lit(max(1, math.ceil(total / SHARD_BYTES))))
        listed = cold.groupBy("key", "id").agg(F.collect_list(F.struct("anchor", "context", "start", "windows", "times")).alias("ranges"))
        slices = among(texts, cold, ["key", "id"]).join(listed, ["key", "id"]).mapInArrow(_slices, struct(SLICES))
        found.append(written(slices.groupBy(shard.alias("shard")).applyInArrow(_shard_spans, struct(SPANS)), "repeat-spans"))
        if hot.isEmpty():
            break
        ranges = hot.groupBy("key", "id").agg(F.collect_list(F.struct("start", "windows")).alias("ranges"))
        source = among(texts, hot, ["key", "id"]).join(ranges, ["key", "id"])
    spans = found[0]
    for more in found[1:]:
        spans = spans.union(more)
    return spans


def _without(raw: bytes, spans: list[dict]) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, runs removed) of ``raw`` without its spans, which may overlap."""
    kept, upto, runs, gone = [], 0, 0, 0
    for s in sorted(spans, key=lambda s: (s["begin"], s["end"])):
        if s["begin"] > upto or not runs:
            kept.append(raw[upto:s["begin"]])
            runs += 1
            gone += s["end"] - s["begin"]
            upto = s["end"]
        elif s["end"] > upto:
            gone += s["end"] - upto
            upto = s["end"]
    return b"".join([*kept, raw[upto:]]), gone, runs


def _measure(batches):
    for part in blocks(batches, "text", BLOCK_BYTES):
        found = [_without(t.encode("utf-8", "surrogatepass"), s) for t, s in zip(part.column("text").to_pylist(), part.column("spans").to_pylist())]
        yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()),
                                          pa.array([hashlib.sha256(f[0]).hexdigest() for f in found], pa.string())], names=["key", "n_removed", "n_spans", "kept_sha256"])


@F.arrow_udf(T.StringType())
def _shortened(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Texts without their spans; characters of which a cut left only some bytes are dropped. Null texts stay null."""
    left = [text.as_py() and _without(text.as_py().encode("utf-8", "surrogatepass"), cut.as_py())[0].decode("utf-8", "ignore") for text, cut in zip(texts, spans)]
    return pa.array(left, pa.string())


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("id"), text.alias("text"), F.unhex(F.md5(text)).alias("key"))


def plan_cuts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``rows`` (key, id, text): (key, copies, id, n_bytes) per different text; (key, id, spans) where texts without copies lose bytes."""
    size = F.octet_length("text").cast("long")
    classes = written(rows.groupBy("key").agg(F.count("*").alias("copies"), F.min("id").alias("id"), F.max(size).alias("n_bytes")), "repeat-texts")
    # One row of every text; the copies of a text are repeats by themselves.
    long = classes.filter(F.col("n_bytes") >= WINDOW)
    spans = (repeated_places(rows.filter(size >= WINDOW), long.select("key", "id"))
             .join(long.filter("copies = 1").select("key", "id"), ["key", "id"], "left_semi")
             .groupBy("key", "id").agg(F.collect_list(F.struct("begin", "end")).alias("spans")))
    return classes, spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256): bytes in strings of 400 that start anywhere else too.

    All occurrences lose the bytes, in the same document or others. Null texts are empty;
    texts under 400 bytes lose nothing. Repeated rows and equal texts are repeats of one
    another. An empty table gives an empty result. Only the two named columns are read.
    """
    texts = _keyed(docs, id_col, text_col)
    classes, spans = plan_cuts(texts)
    spans = written(spans, "repeat-cuts")
    cut = among(texts, spans, ["key", "id"]).join(spans, ["key", "id"]).mapInArrow(_measure, struct("key binary, n_removed long, n_spans long, kept_sha256 string"))
    judged = classes.select("key", "copies", "n_bytes").join(cut, "key", "left")
    rows = docs.select(F.col(id_col), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("key"), F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256).alias("whole"))
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= WINDOW)
    return rows.join(judged, "key").select(
        id_col, "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage_words: int | None = None) -> DataFrame:
    """``docs`` with all columns, its texts without the bytes that :func:`remove_repeats` removes.

    With ``passage_words``, passages of so many words that several texts have, of whatever length in bytes, also stay
    only in the first of these texts (:func:`shared_passages.later_passages`). Both are judged on the texts as given.
    A character of which a byte was removed goes whole. A null text stays null; texts that lose everything become empty.
    """
    bounded_batches(docs.sparkSession)
    # Of all that is written on the way only the cuts are needed later.
    with temporary_tables(docs.sparkSession) as paths:
        texts = _keyed(docs, id_col, text_col)
        classes, spans = plan_cuts(texts)
        spans = spans.select("key", "spans")
        if passage_words:
            spans = (spans.union(shared_passages.later_passages(texts, classes.select("key", "id"), passage_words))
                     .groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans")))
        gone = (F.col("copies") > 1) & (F.col("n_bytes") >= WINDOW)
        plan = written(classes.select("key", gone.alias("gone")).join(spans, "key", "left").filter("gone or spans is not null"), "repeat-cuts")
        keep_last(paths)
    rows = marked(docs.select(F.struct("*").alias("row"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("key")), plan, ["key"], "planned")
    columns = [F.col("row").getField(c).alias(c) for c in docs.columns]
    text = F.col("row").getField(text_col)
    # Only texts that may lose bytes are shuffled and only those that keep some of them go to Python; all others stay where they are.
    joined = rows.filter("planned").join(plan, "key", "left").withColumn("cut", _shortened(F.when(F.col("spans").isNotNull(), text), "spans"))
    shorter = F.when(F.col("gone"), F.lit("")).when(F.col("spans").isNotNull(), F.col("cut")).otherwise(text)
    return rows.filter("not planned").select(*columns).union(
        joined.select(*[shorter.alias(c) if c == text_col else column for c, column in zip(docs.columns, columns)]))
