"""Candidate keys: the smallest sets of columns that tell all rows apart."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from quaymaster.operators.mapping import quoted

PROBED = 20_000  # rows of the first look, in which one repetition refutes a set
SIEVED = 200_000  # about so many rows a set in the second look, all of those with one remainder of a hash
LONG = 64
_PLAIN = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType, T.DateType)


@dataclass(frozen=True)
class Search:
    """``keys``: minimal unique sets in order of size, then header. ``levels``: (size, sets there are, looked at in the first
    rows, looked at in all rows) per level."""
    keys: tuple[tuple[str, ...], ...]
    levels: tuple[tuple[int, int, int, int], ...]


def candidate_keys(df: DataFrame, columns: Sequence[str] | None = None, most: int = 3) -> Search:
    """Minimal sets of up to ``most`` columns without NULLs whose values no two rows share.

    Level by level. A set is out without being looked at when it holds a smaller key or when the
    distinct counts of its columns multiply to less than the rows; it is refuted when it repeats among some first rows,
    or among those rows whose values in it have one remainder of a hash (all equal ones are among them, so in a large table few
    repetitions are enough). What neither refutes is tested on all rows, each set by a shuffle of its own columns.
    What reaches the driver is a number per column and per set.
    """
    columns = list(columns or df.columns)
    values = df.select(*[_value(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    counted = values.agg(F.count(F.lit(1)).alias("rows"), *[F.count(f"c{i}").alias(f"n{i}") for i in range(len(columns))]).first()
    rows = counted["rows"]
    full = [i for i in range(len(columns)) if counted[f"n{i}"] == rows]
    if not rows or not full:
        return Search((), ())
    # The different values of every column, exactly: the product of rounded counts might wrong a key.
    sizes = {i: values.select(f"c{i}").distinct().count() for i in full}
    probe = values.limit(PROBED)
    keys: list[tuple[int, ...]] = [(i,) for i in full if sizes[i] == rows]
    levels = [(1, len(columns), len(full), len(full))]
    for size in range(2, most + 1):
        open_sets = [s for s in combinations(full, size) if not any(set(k) <= set(s) for k in keys) and math.prod(sizes[i] for i in s) >= rows]
        left = _unrepeated(probe, open_sets)
        found = left
        if rows > PROBED:
            found = [s for s in _unrepeated(values, left, math.ceil(rows / SIEVED)) if _unique(values, s)]
        levels.append((size, math.comb(len(columns), size), len(open_sets), len(left)))
        keys += found
    return Search(tuple(tuple(columns[i] for i in k) for k in keys), tuple(levels))


def _value(df: DataFrame, column: str) -> Column:
    """A value as it is where equal values have equal text, else its text."""
    return quoted(column) if isinstance(df.select(quoted(column)).schema[0].dataType, _PLAIN) else _part(quoted(column))


def _part(c: Column) -> Column:
    """A value as text that ends where it ends; a long one by its digest."""
    text = c.cast("string")
    short = F.when(F.length(text) > LONG, F.sha2(text, 256)).otherwise(text)
    return F.concat(F.length(short).cast("string"), F.lit(":"), short)


def _repeated(values: DataFrame, sets: Sequence[tuple[int, ...]], share: int) -> DataFrame:
    """(s): the sets of which two rows have the same values, for all sets in one reading of the rows with one hash of ``share``."""
    items, some = [], F.lit(False)
    for n, s in enumerate(sets):
        here = F.pmod(F.xxhash64(*[F.col(f"c{i}") for i in s]), F.lit(share)) == 0
        item = F.struct(F.lit(n).alias("s"), F.concat(*[_part(F.col(f"c{i}")) for i in s]).alias("v"))
        items.append(item if share == 1 else F.when(here, item))
        some = some | here
    rows = values if share == 1 else values.filter(some)
    return rows.select(F.inline(F.array_compact(F.array(*items)))).groupBy("s", "v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("s").distinct()


def _unrepeated(values: DataFrame, sets: Sequence[tuple[int, ...]], share: int = 1) -> list[tuple[int, ...]]:
    out: list[tuple[int, ...]] = []
    for some in _chunks(sets, 64):  # sets tested together, so that a row is not multiplied without a bound
        repeated = {r["s"] for r in _repeated(values, some, share).collect()}
        out += [s for n, s in enumerate(some) if n not in repeated]
    return out


def _unique(values: DataFrame, columns: tuple[int, ...]) -> bool:
    """Whether no two of all rows agree. Hardly any do here, so rows are dealt out before they are counted."""
    names = [f"c{i}" for i in columns]
    return values.select(*names).repartition(*names).groupBy(*names).count().filter("count > 1").isEmpty()


def _chunks(items: Sequence, size: int) -> Iterator[Sequence]:
    for at in range(0, len(items), size):
        yield items[at:at + size]
