"""Nearest neighbours by a permutation index.

A vector is represented by the order in which it sees the pivots, nearest first. Each
block of vectors keeps an inverted file: for every pivot the place it has in each
vector's order. A query reads the lists of its own nearest pivots, adds up the
differences of places (footrule distance), and the nearest share of the block is
ranked again by exact cosine. Vectors stay in the task that reads them: blocks of queries of a
bounded size are broadcast one after another, and only the best few that a task found
for a query are shuffled. Equal vectors are one entry of a block, however many they are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window, functions as F

from quaymaster.llm.common import struct, written

PIVOTS = 256  # bounded sample: the vectors with the smallest id hashes; places then fit in a byte
FEWEST_PIVOTS = 16
LISTS = 128  # nearest pivots of a query whose lists are read
SHORTLIST = 0.25  # share of a block that is ranked again
LEAST_SHORTLIST = 256
BLOCK_ROWS = 8_192
QUERY_BYTES = 16 << 20  # queries broadcast at a time
FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector array<double>, dim): rows with an id and a vector that is not zero and has no null or non-finite component."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
            .filter(F.col("id").isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0))
            .withColumn("dim", F.size("vector")))


def fit_pivots(rows: DataFrame, pivots: int = PIVOTS, total: int | None = None) -> dict[int, np.ndarray]:
    """Unit vectors by dimension: the ``pivots`` different vectors with the smallest hashes.

    Of the ``total`` rows only those with a small hash are compared, unless they are too few: copies all have one hash.
    """
    by_dim: dict[int, list] = {}
    hashed = rows.select("dim", "vector", F.xxhash64("vector").alias("h"))
    share = min(1.0, 16 * pivots / max(total or 1, 1)) if total else 1.0
    for below in (share, 1.0):
        some = hashed if below == 1.0 else hashed.filter(F.pmod("h", F.lit(1 << 20)) < int(below * (1 << 20)) + 1)
        found = some.distinct().orderBy("h", "vector").limit(pivots).collect()
        if len(found) == pivots or below == 1.0:
            break
    for r in found:
        by_dim.setdefault(r["dim"], []).append(r["vector"])
    return {d: _unit(np.array(v, float)) for d, v in by_dim.items()}


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # lengths of very large or small vectors stay in range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class PermutationIndex:
    """Inverted file of one block: ``lists[p]`` has the place of pivot p in the order of each vector."""

    def __init__(self, units: np.ndarray, pivots: np.ndarray):
        self.pivots = pivots
        order = np.argsort(-(units @ pivots.T), axis=1, kind="stable")
        places = np.empty_like(order, dtype=np.uint8 if len(pivots) <= 256 else np.uint16)
        np.put_along_axis(places, order, np.arange(len(pivots), dtype=places.dtype)[None].repeat(len(units), 0), axis=1)
        self.lists = np.ascontiguousarray(places.T)

    def footrule(self, unit: np.ndarray, lists: int = LISTS) -> np.ndarray:
        """Footrule distance to every vector of the block over the nearest ``lists`` pivots of ``unit``."""
        nearest = np.argsort(-(self.pivots @ unit), kind="stable")[:lists]
        total = np.zeros(self.lists.shape[1], np.int32)
        for place, pivot in enumerate(nearest):
            there, here = self.lists[pivot], self.lists.dtype.type(place)
            total += np.maximum(there, here) - np.minimum(there, here)
        return total


def search_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, pivots: np.ndarray | None, k: int,
                 shortlist: float = SHORTLIST, lists: int = LISTS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query (ids, cosines) of the ``k`` best of a block, best first, ties to the smaller id.

    Distances and shortlists are of different vectors; of equal ones the ``k`` + 1 smallest ids are kept, which is all that can be listed.
    """
    by_id = np.argsort(ids, kind="stable")
    ids, units = ids[by_id], _unit(vectors[by_id])
    rows = np.ascontiguousarray(units).view(np.dtype((np.void, units.dtype.itemsize * units.shape[1]))).ravel()
    _, first, of_row = np.unique(rows, return_index=True, return_inverse=True)
    together = np.argsort(of_row, kind="stable")  # rows of a vector, by id
    begins = np.searchsorted(of_row[together], np.arange(len(first) + 1))
    units = units[first]
    wanted = max(math.ceil(shortlist * len(units)), LEAST_SHORTLIST, k + 1)
    index = PermutationIndex(units, pivots) if pivots is not None and wanted < len(units) else None
    found = []
    for query, unit in zip(query_ids, _unit(queries)):
        some = np.arange(len(units)) if index is None else np.sort(np.argpartition(index.footrule(unit, lists), wanted)[:wanted])
        score = (units[some] * unit).sum(axis=1)  # the same sum for equal vectors wherever they stand
        if len(some) > k + 1:  # the query's own vector may be one of them
            least = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
            some, score = some[score >= least], score[score >= least]
        members = [ids[together[begins[i]:min(begins[i + 1], begins[i] + k + 1)]] for i in some]
        score = np.repeat(score, [len(m) for m in members])
        members = np.concatenate([np.zeros(0, ids.dtype), *members])
        others = members != query
        members, score = members[others], score[others]
        best = np.lexsort((members, -score))[:k]
        found.append((members[best], score[best]))
    return found


class _Search:
    """The best ``k`` of the blocks seen so far for each of some queries of one dimension."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, pivots: np.ndarray | None, k: int, shortlist: float, lists: int):
        self.query_ids, self.queries, self.rest = query_ids, queries, (pivots, k, shortlist, lists)
        self.k, self.held, self.rows = k, [], 0
        self.best = [(np.zeros(0, np.int64), np.zeros(0))] * len(query_ids)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.held.append((ids, vectors))
        self.rows += len(ids)
        if self.rows >= BLOCK_ROWS:
            self.flush()

    def flush(self) -> None:
        if not self.rows:
            return
        ids, vectors = map(np.concatenate, zip(*self.held))
        self.held, self.rows = [], 0
        for at in range(0, len(ids), BLOCK_ROWS):
            for q, (mine, score) in enumerate(search_block(ids[at:at + BLOCK_ROWS], vectors[at:at + BLOCK_ROWS], self.query_ids, self.queries, *self.rest)):
                mine, score = np.concatenate([self.best[q][0], mine]), np.concatenate([self.best[q][1], score])
                order = np.lexsort((mine, -score))[:self.k]
                self.best[q] = mine[order], score[order]


def _by_dim(batch: pa.RecordBatch):
    """(dimension, ids, matrix) of the vectors of a batch."""
    dims = pyarrow.compute.list_value_length(batch.column("vector")).to_numpy(zero_copy_only=False)
    for dim in np.unique(dims):
        part = batch.filter(pa.array(dims == dim))
        yield int(dim), part.column("id").to_numpy(zero_copy_only=False), part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def nearest(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS,
            lists: int = LISTS, shortlist: float = SHORTLIST) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row that fulfils ``is_query(id column)``.

    Cosine of the original vectors in double precision. Vectors that are null, empty, zero or
    hold null or non-finite components, and rows with a null id, take no part; vectors of
    another length are not compared. Rows with the query's id are its own. Repeated ids are
    ranked each. An empty table or no usable query gives an empty result. Every usable row is
    indexed; in a dimension with fewer than 16 sampled pivots every row is ranked exactly.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    total = rows.count()
    pivots_of = spark.sparkContext.broadcast(fit_pivots(rows, pivots, total))
    queries = rows.filter(is_query(F.col("id")))
    size = queries.agg(F.sum(F.col("dim").cast("long") * 8)).first()[0] or 0
    parts = max(1, math.ceil(size / QUERY_BYTES))
    # Numbered once, so that repeated ids are spread over the parts too.
    queries = written(queries.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(parts))), "nearest-queries")

    def searching(shared):
        def run(batches):
            searches: dict[int, _Search] = {}
            for batch in batches:
                for dim, ids, matrix in _by_dim(batch):
                    if dim not in searches and dim in shared.value:
                        known = pivots_of.value.get(dim)
                        searches[dim] = _Search(*shared.value[dim], known if known is not None and len(known) >= FEWEST_PIVOTS else None, k, shortlist, lists)
                    if dim in searches:
                        searches[dim].add(ids, matrix)
            for search in searches.values():
                search.flush()
                counts = [len(ids) for ids, _ in search.best]
                columns = np.repeat(search.query_ids, counts), np.concatenate([i for i, _ in search.best]), np.concatenate([s for _, s in search.best])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])
        return run

    found = None
    for part in range(parts):
        some = queries.filter(F.col("part") == part).select("id", "vector").toArrow()  # at most about QUERY_BYTES
        of_dim: dict[int, list] = {}
        for batch in some.to_batches():
            for dim, ids, matrix in _by_dim(batch):
                of_dim.setdefault(dim, []).append((ids, matrix))
        shared = spark.sparkContext.broadcast({dim: tuple(map(np.concatenate, zip(*each))) for dim, each in of_dim.items()})
        here = rows.select("id", "vector").mapInArrow(searching(shared), struct(FOUND))
        found = here if found is None else found.union(here)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
