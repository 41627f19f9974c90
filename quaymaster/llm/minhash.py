"""Near-duplicates: MinHash bands for candidates, sequential Bayesian verification, exact confirmation.

Texts with the same words are one class and take part once. Within a bucket of equal
band values every class is compared with the smallest one, so thousands of near
copies make thousands of pairs, not millions. Classes of a bucket that these comparisons
leave in different components are compared with each other only where they share one of
their rarest shingles, as every pair of the wanted similarity must (prefix filter): what
makes a bucket large is what its members have in common, and that comes last.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from quaymaster.llm.common import among, blocks, keep_last, marked, struct, temporary_tables, written
from quaymaster.llm.components import components

SHINGLE = 5
BANDS, ROWS = 30, 5
BATCH = 16  # signature values compared before each look at the posterior
MISS = 1e-6  # chance at each look to lose a pair that reaches the similarity
BLOCK_BYTES = 8 << 20
SKETCH = "n_shingles long, words_key binary, signature binary"


def multipliers(count: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, count, np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and the six ASCII spaces


def shingle_set(words: list[bytes]) -> set[tuple[bytes, ...]]:
    if len(words) < SHINGLE:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(SHINGLE))))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingle_hashes(hashes: np.ndarray) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles of one text from the hashes of its words."""
    size = max(len(hashes) - SHINGLE + 1, 1)
    h = np.zeros(size, np.uint64)
    for i in range(min(SHINGLE, len(hashes))):
        h = _mixed(h + hashes[i:i + size])
    return np.unique(h)


def sketch_texts(texts: list[str | None], bands: int = BANDS, rows: int = ROWS) -> tuple[list[int], list[bytes | None], list[bytes | None]]:
    """(set size, key of the word sequence, signature) of each text; no key or signature without words."""
    known: dict[bytes, int] = {}
    sets, keys = [], []
    for text in texts:
        words = words_of(text)
        if words:
            for w in set(words):
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
            sets.append(shingle_hashes(np.array([known[w] for w in words], np.uint64)))
        keys.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
    signatures: Iterator[bytes] = iter(())
    if sets:
        flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
        a, b = multipliers(bands * rows)
        table = np.stack([np.minimum.reduceat(flat * x + y, starts) >> np.uint64(32) for x, y in zip(a, b)], axis=1).astype(np.uint32)
        signatures = iter(map(np.ndarray.tobytes, table))
    lengths = iter(sets)
    return ([len(next(lengths)) if k else 0 for k in keys], keys, [next(signatures) if k else None for k in keys])


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    more = [F.col(row_col).alias("row")] if row_col else []
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *more)
    carried = [c for c in rows.columns if c != "text"]

    def run(batches):
        for part in blocks(batches, "text", BLOCK_BYTES):
            n, keys, signatures = sketch_texts(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in carried], pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary())],
                                             names=[*carried, "n_shingles", "words_key", "signature"])
    return rows.mapInArrow(run, struct(", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in carried) + f", {SKETCH}"))


def least_matches(similarity: float, miss: float, count: int, batch: int = BATCH) -> dict[int, int]:
    """After n compared values: the fewest matches whose posterior still gives ``similarity`` a chance over ``miss``.

    The prior is uniform, so k matches of n leave a Beta(k + 1, n - k + 1), whose upper
    tail at t is the chance of at most k successes of n + 1 at rate t.
    """
    t, least = similarity, {}
    for n in range(batch, count + 1, batch):
        tail, k = 0.0, 0
        while k <= n:
            tail += comb(n + 1, k) * t ** k * (1 - t) ** (n + 1 - k)
            if tail > miss:
                break
            k += 1
        least[n] = k
    return least


def plausible(a: list[bytes], b: list[bytes], similarity: float, miss: float = MISS) -> np.ndarray:
    """Which pairs of signatures survive the looks after each batch of values."""
    if not a:
        return np.zeros(0, bool)
    equal = np.frombuffer(b"".join(a), np.uint32).reshape(len(a), -1) == np.frombuffer(b"".join(b), np.uint32).reshape(len(b), -1)
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    for n, least in least_matches(similarity, miss, equal.shape[1]).items():
        matches[alive] += equal[alive, n - BATCH:n].sum(axis=1)
        alive = alive[matches[alive] >= least]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def _prune(similarity: float):
    def run(batches):
        for batch in batches:
            keep = plausible(batch.column("sig_a").to_pylist(), batch.column("sig_b").to_pylist(), similarity)
            yield batch.select(["a", "b"]).filter(pa.array(keep))
    return run


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            keep, held = [], (None, set())
            for a, text_a, text_b in zip(batch.column("a").to_pylist(), batch.column("text_a"), batch.column("text_b")):
                if held[0] != a:
                    held = (a, shingle_set(words_of(text_a.as_py())))
                other = shingle_set(words_of(text_b.as_py()))
                common = len(held[1] & other)
                keep.append(100 * common >= percent * (len(held[1]) + len(other) - common) > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _shingle_rows(batches):
    for part in blocks(batches, "text", BLOCK_BYTES):
        known: dict[bytes, int] = {}
        ids, found = [], []
        for node, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist()):
            words = words_of(text)
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
            found.append(shingle_hashes(np.array([known[w] for w in words], np.uint64)) if words else np.zeros(0, np.uint64))
            ids.append(node)
        flat = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), [len(f) for f in found])), pa.array(flat)], names=["node", "shingle"])


def _across(groups: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``groups`` (node, component, n_shingles) in different components that share a shingle of their prefixes.

    With the shingles of every node in one order, rarest first, a pair of the similarity shares one
    of the first n - ceil(similarity * n) + 1 of each. Nothing before the first shared shingle is common,
    so its places bound what the pair can have in common. Shingles that one node has are counted, not kept.
    """
    rows = written(texts.mapInArrow(_shingle_rows, struct("node long, shingle long")), "near-shingles")
    shared = rows.groupBy("shingle").agg(F.count("*").alias("f")).filter("f > 1")
    mine = Window.partitionBy("node")
    n = F.col("n_shingles")
    first = (rows.join(shared, "shingle").join(groups, "node")
             .withColumn("place", F.row_number().over(mine.orderBy("f", "shingle")) + n - F.count("*").over(mine))
             .filter(F.col("place") <= n - F.ceil(n * percent / 100) + 1))
    tokens = written(first.select("shingle", "node", "component", "n_shingles", (n - F.col("place") + 1).alias("rest")), "near-prefixes")
    apart = tokens.groupBy("shingle").agg((F.min("component") != F.max("component")).alias("apart")).filter("apart").select("shingle")
    left = tokens.join(apart, "shingle")
    right = left.select("shingle", *[F.col(c).alias(f"{c}_b") for c in ("node", "component", "n_shingles", "rest")])
    fits = (F.col("component") != F.col("component_b")) & (
        (100 + percent) * F.least("rest", "rest_b") >= percent * (F.col("n_shingles") + F.col("n_shingles_b")))
    return (left.join(right, "shingle").filter(fits & (F.col("node") < F.col("node_b")))
            .select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct())


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return written(among(docs, ids, ["id"]).join(ids, "id"), "near-texts")


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full shingle sets reach the similarity; ``docs`` has id, text."""
    sized = pairs.join(nodes.select(F.col("node").alias("a"), F.col("n_shingles").alias("n_a"), F.col("signature").alias("sig_a")), "a").join(
        nodes.select(F.col("node").alias("b"), F.col("n_shingles").alias("n_b"), F.col("signature").alias("sig_b")), "b")
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    alive = written(sized.filter(fits).select("a", "b", "sig_a", "sig_b").mapInArrow(_prune(percent / 100), struct("a long, b long")), "near-pairs")
    ends = written(alive.select(F.col("a").alias("id")).union(alive.select("b")).distinct(), "near-ends")
    texts = _texts(docs, ends)
    both = (alive.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b"))
    return written(both.mapInArrow(_confirm(percent), struct("a long, b long")), "near-links")


def _buckets(nodes: DataFrame) -> DataFrame:
    width = 4 * ROWS
    values = [F.xxhash64(F.lit(i), F.substring("signature", 1 + width * i, width)) for i in range(BANDS)]
    return nodes.select("node", F.explode(F.array(*values)).alias("bucket"))


def _within_ids(sketches: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, a, b): the smallest and each node of the classes of an id whose rows differ in their words."""
    key = F.col("words_key")
    differing = (sketches.filter("id is not null").groupBy("id").agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.when(key.isNull(), 1)).alias("bare"))
                 .filter("low < high or low is not null and bare > 0").select("id"))
    found = sketches.select("id", "words_key").join(differing, "id").join(nodes.select("words_key", "node"), "words_key").select("id", "node").distinct()
    least = found.groupBy("id").agg(F.min("node").alias("a"))
    return found.join(least, "id").select("id", "a", F.col("node").alias("b"))


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(id_col, n_shingles, component_id, kept): groups linked by a Jaccard similarity of ``percent`` or more on word shingles.

    A text without words or null has n_shingles 0 and is a component of its own. Rows with
    the same id count as one document, linked when one of their texts is, so all its rows are
    in one component. A row with a null
    id is linked with nothing: its component is null and it is not kept. Repeated rows stay
    repeated. An empty table gives an empty result. Only the named columns are read. With
    ``row_col``, which tells rows apart, that column and the key of its words (null without words) follow.
    """
    sketches = written(sketch(docs, id_col, text_col, row_col), "sketches")
    nodes = written(sketches.filter(F.col("id").isNotNull() & F.col("words_key").isNotNull())
                    .groupBy("words_key").agg(F.min("id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")), "nodes")
    within = written(_within_ids(sketches, nodes), "near-ids")
    buckets = _buckets(nodes)
    hubs = buckets.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    shared = written(buckets.join(hubs.select("bucket", "hub"), "bucket"), "near-buckets")
    stars = shared.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    links = _confirmed(stars, nodes, texts, percent).union(within.select("a", "b"))
    groups = components(links)
    labelled = shared.join(groups, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    apart = labelled.groupBy("bucket").agg((F.min("component") != F.max("component")).alias("apart")).filter("apart").select("bucket")
    left = written(labelled.join(apart, "bucket").select("node", "component").distinct().join(nodes.select("node", "n_shingles"), "node"), "near-apart")
    left_texts = _texts(texts, left.select(F.col("node").alias("id")))
    more = _confirmed(_across(left, left_texts, percent), nodes, left_texts, percent)
    groups = components(links.union(more))
    labels = nodes.join(groups, "node", "left").select("words_key", F.coalesce("component", "node").alias("component"))
    # A row without words goes where the other rows of its id are.
    by_id = within.select("id", F.col("a").alias("node")).distinct().join(groups, "node", "left").select("id", F.coalesce("component", "node").alias("of_id"))
    same_id = sketches.drop("signature").join(labels, "words_key", "left").join(by_id, "id", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "of_id", "id"))
    return same_id.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"),
                          F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
                          *([F.col("row").alias(row_col), "words_key"] if row_col else []))


def one_of_each_group(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` with all their columns: of each group of near-duplicates the rows of its smallest id, and of those with the same words one.

    Rows without an id are in no group, but of rows with the same words (repeated rows, rows without an id)
    only one stays, one with an id if there is such a row. Rows without words all stay.
    """
    row_col = "row"
    while row_col in docs.columns:
        row_col += "_"
    spark = docs.sparkSession
    whole = F.struct(*[F.col(c) for c in docs.columns]).alias("whole")
    text_key = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    number = F.monotonically_increasing_id().alias("number")
    # All that leads to the rows that go is deleted as soon as these are written.
    with temporary_tables(spark) as paths:
        numbered = docs.select(id_col, text_col, F.struct(number, text_key.alias("key")).alias(row_col))
        groups = written(near_duplicates(numbered, percent, id_col, text_col, row_col).select(
            F.col(id_col).alias("id"), "component_id", F.col(row_col).alias("row"), "words_key"), "near-groups")
        others = groups.filter(F.col("component_id") < F.col("id")).select("id").distinct()
        left = groups.join(others, "id", "left_anti")
        # The least of each class of equal words, as an aggregate: a class of any size is one row per task.
        firsts = (left.filter("words_key is not null").groupBy("words_key").agg(F.min(F.struct(F.col("id").isNull().alias("bare"), "id", "row")).alias("first"))
                  .select("words_key", F.col("first.id").alias("first_id"), F.col("first.row.key").alias("first_key")))
        texts = groups.groupBy("id", F.col("row.key").alias("key"), "words_key").agg(F.count("*").alias("times"))
        first = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("key") == F.col("first_key"))
        judged = (texts.join(others.select("id", F.lit(True).alias("other")), "id", "left").join(firsts, "words_key", "left")
                  .select("id", "key", (F.col("other").isNotNull() | F.coalesce(F.col("words_key").isNotNull() & ~first, F.lit(False))).alias("gone"),
                          (F.col("words_key").isNotNull() & (F.col("times") > 1)).alias("repeated")))
        # Texts of which rows go: all of them, or all but one.
        going = written(judged.filter("gone or repeated").select("id", "key", "gone"), "near-going")
        keep_last(paths)
    rows = marked(docs.select(F.col(id_col).cast("long").alias("id"), text_key.alias("key"), number, whole), going, ["id", "key"], "marked")
    # Only rows that may go are shuffled.
    parts = [rows.filter("not marked"), _matching(rows.filter("marked"), going, "left_anti")]
    once = going.filter("not gone").select("id", "key")
    if not once.isEmpty():
        repeats = _matching(among(rows.drop("marked"), once, ["id", "key"]), once, "left_semi")
        parts.append(repeats.groupBy("id", "key").agg(F.min_by("whole", "number").alias("whole")))
    found = parts[0].select("whole.*")
    for part in parts[1:]:
        found = found.union(part.select("whole.*"))
    return found


def _matching(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows with a text (id, key) of ``keys``, or without; the id may be null."""
    same = F.col("row.id").eqNullSafe(F.col("of.id")) & (F.col("row.key") == F.col("of.key"))
    return rows.alias("row").join(keys.alias("of"), same, how)
