"""Periodic runs of words, found online by dyadic catchers.

Words are appended to one sequence. Whenever a block of 2^k words is complete it becomes a
catcher: each later word completes a window of 2^k words, and a window that equals the
catcher one to two block lengths on is caught. The catch is compared further, to the left at
once and to the right as words are appended, and the squares it reports merge into one
stretch of that period. A stretch of at least three periods holds an aligned block no longer
than its period together with the block's next occurrence, so no run escapes. Windows are
told apart by hashes that double in width; every stretch is confirmed on the words.

Texts are searched where they are read, each as a sequence of its own; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quaymaster.llm.common import WORD, blocks, struct

LEAST_LENGTH = 24
LEAST_PERIODS = 3
LEAST_LEVEL = 3  # catchers of 8 words: a run of 24 words holds one and its next occurrence, also for shorter periods
BLOCK_BYTES = 1 << 20
APPENDED = 1 << 17  # words appended at a time
RUN = "struct<start:int,length:int,period:int>"
_RUN = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("period", pa.int32())])
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_OPEN = 1 << 60  # the end of a stretch that still goes on


def _mixed(left: np.ndarray, right: np.ndarray | int = 0) -> np.ndarray:
    """Hash of windows made of two halves."""
    h = left * _ODD[0]
    h ^= h >> np.uint64(29)
    h += right
    h *= _ODD[1]
    h ^= h >> np.uint64(32)
    return h


class _Level:
    """Catchers of one block length and the hashes of the latest windows, from place ``first`` on."""

    def __init__(self, size: int):
        self.size, self.first = size, 0
        self.tail = np.zeros(0, np.uint64)
        self.blocks = np.zeros(0, np.uint64)


class SquareCatchers:
    """Runs of a sequence of words: ``append`` words as often as needed, then ``finish``.

    Equal numbers are equal words; a number that occurs once parts sequences. The runs are the same
    however the words are cut into appended pieces.
    """

    def __init__(self, longest: int | None = None):
        """``longest``: no run is longer than this, so catchers too long for one need not be kept."""
        self.words, self.n, self.longest = np.zeros(1024, np.int64), 0, longest
        self.levels = [_Level(1)]
        self.open: dict[int, int] = {}  # period -> start of the stretch that reaches the end
        self.closed: list[tuple[int, list[tuple[int, int, int]]]] = []  # per append: words so far, stretches (start, end, period) that ended
        self.runs: dict[tuple[int, int], int] = {}  # (start, end) -> smallest period

    def append(self, words: np.ndarray) -> None:
        while self.n + len(words) > len(self.words):
            self.words = np.concatenate([self.words, np.zeros(len(self.words), np.int64)])
        self.words[self.n:self.n + len(words)] = words
        before, self.n = self.n, self.n + len(words)
        self.closed.append((self.n, []))
        for period, start in list(self.open.items()):
            same = self._equal_ahead(before - period, before)
            if before + same < self.n:
                del self.open[period]
                self._close(start, before + same, period)
        fresh, begin, number = _mixed(words.astype(np.uint64)), before, 0
        while True:
            level = self.levels[number]
            if number >= LEAST_LEVEL and len(fresh):
                self._catch(level, fresh, begin)
            level.tail = np.concatenate([level.tail, fresh])
            number += 1
            if number > LEAST_LEVEL and self.longest is not None and LEAST_PERIODS << number > self.longest:
                level.first, level.tail = level.first + len(level.tail), level.tail[:0]
                return
            # Windows of the next level that the new words complete; the hashes they begin with are done with.
            more = len(level.tail) - level.size
            if more <= 0:
                return
            fresh, begin = _mixed(level.tail[:more], level.tail[level.size:]), level.first
            level.first, level.tail = level.first + more, level.tail[more:]
            if number == len(self.levels):
                self.levels.append(_Level(1 << number))

    def finish(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of all runs by start, then period."""
        self.closed.append((self.n, []))
        for period, start in self.open.items():
            self._close(start, self.n, period)
        self.open = {}
        return sorted((start, end - start, period) for (start, end), period in self.runs.items())

    def _catch(self, level: _Level, fresh: np.ndarray, begin: int) -> None:
        """Hold new windows against the catchers before them; complete blocks become catchers."""
        size, end = level.size, begin + len(fresh)
        level.blocks = np.concatenate([level.blocks, fresh[-begin % size::size]])
        first = begin // size
        offset = begin - first * size
        here = np.repeat(level.blocks[first:], size)[offset:offset + len(fresh)]
        there = np.repeat(np.concatenate([level.blocks[first - 1:first] if first else ~level.blocks[:1], level.blocks[first:]]), size)[offset:offset + len(fresh)]
        caught = np.flatnonzero(fresh == there) + begin
        if not first:
            caught = caught[caught >= size]
        catchers = (caught // size - 1) * size
        if size == 1 << LEAST_LEVEL:
            own = np.flatnonzero(fresh == here) + begin
            own = own[own % size > 0]
            caught, catchers = np.concatenate([caught, own]), np.concatenate([catchers, own - own % size])
        if len(caught):
            catchers, caught = self._promising(size, catchers, caught, max(begin - 2 * size, 0), end)
        periods = caught - catchers
        order = np.lexsort((catchers, periods))
        catchers, periods = catchers[order], periods[order]
        cuts = np.flatnonzero(np.diff(periods, prepend=-1, append=-1))
        for a, b in zip(cuts, cuts[1:]):
            self._merge(size, int(periods[a]), catchers[a:b])

    def _merge(self, size: int, period: int, catchers: np.ndarray) -> None:
        """The stretches of ``period`` around the catchers, each compared once."""
        at = 0
        if period in self.open:
            catchers = catchers[:np.searchsorted(catchers, self.open[period])]
        while at < len(catchers):
            place = int(catchers[at])
            end = place + period + self._equal_ahead(place, place + period)
            if end < place + period + size:  # equal hashes of different words
                at += 1
                continue
            start = place - self._equal_behind(place, place + period)
            if end == self.n:
                self.open[period] = start
                return
            self._close(start, end, period)
            at = int(np.searchsorted(catchers, end - period - size, side="right"))

    def _promising(self, size: int, catchers: np.ndarray, caught: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Without catches that cannot give a new run because a shorter period rules at the catcher.

        A catcher within a stretch of a period of at most half its length equals all shifts within that stretch and
        within other stretches of that period. A stretch of three of the longer periods must bind the two
        short ones at their starts or at their ends; one that is still open ends at the last word or later.
        """
        starts, ends = np.full(high - low, -1), np.full(high - low, -1)
        for start, end, period in self._stretches_since(low):
            if 2 * period <= size <= min(end, self.n) - start:
                inside = slice(max(start - low, 0), max(min(end, self.n) - size + 1 - low, 0))
                starts[inside], ends[inside] = start, end
        s, e, t, f = starts[catchers - low], ends[catchers - low], starts[caught - low], ends[caught - low]
        period = caught - catchers
        same = (s == t) & (e == f)
        keep = (s < 0) | (t < 0) | ~same & ((t - s == period) | (f - e == period) | (f == _OPEN) & (e + period >= self.n))
        return catchers[keep], caught[keep]

    def _stretches_since(self, place: int) -> Iterator[tuple[int, int, int]]:
        """Stretches that may end after ``place``: those of an append end after the words there were before it."""
        for i in range(len(self.closed) - 1, -1, -1):
            if self.closed[i][0] < place:
                break
            yield from self.closed[i][1]
        yield from ((start, _OPEN, period) for period, start in self.open.items())

    def _close(self, start: int, end: int, period: int) -> None:
        if end - start >= 2 * period:
            self.closed[-1][1].append((start, end, period))
        if end - start >= max(LEAST_LENGTH, LEAST_PERIODS * period):
            self.runs[start, end] = min(period, self.runs.get((start, end), period))

    def _equal_ahead(self, a: int, b: int) -> int:
        """Equal words from places ``a`` < ``b`` on."""
        done, step = 0, 64
        while b + done < self.n:
            upto = min(step, self.n - b - done)
            differ = np.flatnonzero(self.words[a + done:a + done + upto] != self.words[b + done:b + done + upto])
            if len(differ):
                return done + int(differ[0])
            done, step = done + upto, step * 2
        return done

    def _equal_behind(self, a: int, b: int) -> int:
        """Equal words before places ``a`` < ``b``."""
        done, step = 0, 64
        while done < a:
            upto = min(step, a - done)
            differ = np.flatnonzero(self.words[a - done - upto:a - done] != self.words[b - done - upto:b - done])
            if len(differ):
                return done + upto - 1 - int(differ[-1])
            done, step = done + upto, step * 2
        return done


def runs_of(texts: list[list], appended: int = APPENDED) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each list of words."""
    numbers: dict = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) if w is not None else -1 for words in texts for w in (*words, None)], np.int64)
    lengths = np.array([len(words) for words in texts], np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    ids[starts + lengths] = -1 - np.arange(len(texts))  # each text ends in a word of its own
    catchers = SquareCatchers(int(lengths.max(initial=0)))
    for at in range(0, len(ids), appended):
        catchers.append(ids[at:at + appended])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, period in catchers.finish():
        text = int(np.searchsorted(starts, start, side="right")) - 1
        out[text].append((start - int(starts[text]), length, period))
    return out


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the most periods, fractions counted; of equals the first, then that of the shortest period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """Words joined by single spaces; of each run only the first period is left."""
    if runs:
        cover = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            cover[start + period] += 1
            cover[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0)]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, runs, strongest, collapsed) of every whole text.

    ``runs`` (start, length, period; by start, then period) are the stretches of words with that smallest period, of at least 24 words and three
    periods, that no neighbouring word extends. ``strongest`` is the one with the most periods (the first, then the shorter
    period, of equals), null without runs. ``collapsed`` is the text with only the first period of every run. A null text is empty and has no words; texts of
    white space neither. Rows that repeat are judged each; an empty table gives an empty result. Only the two named columns are read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for part in blocks(batches, "text", BLOCK_BYTES):
            # Bytes split at exactly the six ASCII spaces.
            texts = [(t or "").encode("utf-8", "surrogatepass").split() for t in part.column("text").to_pylist()]
            found = runs_of(texts)
            best = [strongest(r) for r in found]
            named = lambda r: r and dict(zip(("start", "length", "period"), r))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(list(map(len, texts)), pa.int64()), pa.array([list(map(named, r)) for r in found], pa.list_(_RUN)),
                 pa.array(list(map(named, best)), _RUN), pa.array([collapsed(w, r).decode("utf-8", "surrogatepass") for w, r in zip(texts, found)], pa.string())],
                names=["id", "n_words", "runs", "strongest", "collapsed"])

    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, struct(f"id {id_type}, n_words long, runs array<{RUN}>, strongest {RUN}, collapsed string")).withColumnRenamed("id", id_col)


def looped(text: Column, doc_id: Column) -> Column:
    """The text, in one of ten documents made to repeat itself: from a word on, the words that follow it over and over.

    With h the crc32 of the decimal id and g a tenth of it, documents with h divisible by ten start at word a = g mod n with a period of
    1 + (n - a) / (3 + g mod 8) words. Documents without an id or without words stay.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
    n = F.size(words)
    rewritten = F.transform(F.array(words), lambda w: _wrapped(w, F.size(w), g))[0]
    return F.when((h % 10 == 0) & (n > 0), F.array_join(rewritten, " ")).otherwise(text)


def _wrapped(words: Column, n: Column, g: Column) -> Column:
    a = g % n
    period = 1 + F.floor((n - a) / (3 + g % 8))
    return F.transform(words, lambda word, i: F.when(i < a, word).otherwise(F.get(words, (a + (i - a) % period).cast("int"))))
