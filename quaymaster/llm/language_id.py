"""Language of a text: multinomial naive Bayes over hashed character n-grams.

Training sums n-gram counts per language and hash bin inside each task; only those
sums (languages x bins, some languages at a time) reach the driver and become the log-probability matrix that
is broadcast. Scoring hashes all n-grams of a block of texts at once and adds the
matrix rows per text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quaymaster.llm.common import blocks, bounded_batches, struct, written

NGRAMS = (1, 2, 3)
BINS = 1 << 15
BLOCK_CHARS, BLOCK_BYTES = 1 << 19, 2 << 20  # code points hashed and bytes of text taken at a time
COUNTED_TOGETHER = 64  # languages whose counts a task or the driver holds at a time, at 256 KB each
MOST_LANGUAGES = 1_000  # a matrix of at most 131 MB is broadcast
SAMPLE_ROWS = 20_000  # training rows a language, about; the bound of the fitted sample
UNDETERMINED = "und"
LETTER = r"\p{L}"
MULTIPLIER = np.uint32(2654435761)


@dataclass(frozen=True)
class LanguageModel:
    """Languages in code point order and their log probabilities (bins x languages)."""
    languages: tuple[str, ...]
    prior: np.ndarray
    log_p: np.ndarray
    ngrams: tuple[int, ...] = NGRAMS


def hashed_ngrams(codes: np.ndarray, n: int, bins: int) -> np.ndarray:
    """Bins of the ``n``-grams that start at each place of ``codes`` but the last ``n`` - 1."""
    size = max(len(codes) - n + 1, 0)
    h = np.full(size, n, np.uint32)
    for i in range(n):
        h = (h ^ codes[i:i + size]) * MULTIPLIER
        h ^= h >> np.uint32(15)
    return (h & np.uint32(bins - 1)).astype(np.int32)


def segments(texts: list[str | None], overlap: int, limit: int = BLOCK_CHARS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks (code points, start of each segment, row of each segment) of about ``limit`` code points.

    A text longer than a block goes on in the next with ``overlap`` code points repeated,
    so that each of its n-grams is seen once.
    """
    codes, starts, rows, held = [], [], [], 0
    for row, text in enumerate(texts):
        text = (text or "").lower()
        for at in range(0, max(len(text), 1), limit):
            part = text[max(at - overlap, 0):at + limit] if at else text[:limit]
            codes.append(np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32))
            starts.append(held)
            rows.append((row, at > 0))
            held += len(codes[-1])
            if held >= limit:
                yield np.concatenate(codes), np.array(starts), np.array(rows)
                codes, starts, rows, held = [], [], [], 0
    if rows:
        yield np.concatenate(codes), np.array(starts), np.array(rows)


def _per_segment(codes, starts, rows, n, bins, overlap):
    """Bins of all n-grams of a block and the segment of each; n-grams across segments or repeated ones are left out."""
    grams = hashed_ngrams(codes, n, bins)
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(codes))))[:len(grams)]
    ends = np.append(starts[1:], len(codes))
    place = np.arange(len(grams))
    inside = place + n <= ends[owner]
    # A continued segment repeats ``overlap`` code points: n-grams that end in them were counted before.
    inside &= ~(rows[owner, 1].astype(bool) & (place + n <= starts[owner] + overlap))
    return grams[inside], owner[inside]


def _count(languages: list[str], bins: int, ngrams: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]):
        index = {x: i for i, x in enumerate(languages)}
        totals: dict[int, np.ndarray] = {}
        overlap = max(ngrams) - 1
        for batch in blocks(batches, "text", BLOCK_BYTES):
            if len(totals) > COUNTED_TOGETHER:
                yield _counted(totals)
                totals = {}
            present, lang = np.unique([index[x] for x in batch.column("lang").to_pylist()], return_inverse=True)
            found = np.zeros((len(present), bins), np.int64)
            for codes, starts, rows in segments(batch.column("text").to_pylist(), overlap):
                for n in ngrams:
                    grams, owner = _per_segment(codes, starts, rows, n, bins, overlap)
                    found += np.bincount(lang[rows[owner, 0]] * bins + grams, minlength=found.size).reshape(found.shape)
            for i, counts in zip(present.tolist(), found):
                totals[i] = totals[i] + counts if i in totals else counts.copy()
        yield _counted(totals)
    return run


def _counted(totals: dict[int, np.ndarray]) -> pa.RecordBatch:
    """(lang, bin, n) of the bins that occur."""
    bins = {i: np.flatnonzero(counts) for i, counts in totals.items()}
    columns = [np.concatenate([np.zeros(0, np.int64), *x]) for x in ([np.full(len(j), i) for i, j in bins.items()], bins.values(), [totals[i][j] for i, j in bins.items()])]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64()))], names=["lang", "bin", "n"])


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, bins: int = BINS,
        ngrams: tuple[int, ...] = NGRAMS, alpha: float = 0.1, id_col: str = "doc_id") -> LanguageModel:
    """Fit on rows with a text and a language; about ``sample_rows`` rows a language, chosen by a hash of id and text.

    Languages are values of ``lang_col`` with at least one row, of which there may be 1,000 (more raise); priors come from all rows.
    Copies of a text under different ids are chosen each by itself, so none goes in or out of the sample with all its copies.
    Without rows to learn from the model has no language and every prediction is undetermined.
    """
    of_row = [F.col(c) for c in (id_col, text_col) if c in docs.columns]
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(*of_row), F.lit(1 << 20)).alias("place"))
    counted = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(counted) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages; the log-probability matrix is broadcast for no more")
    counts = {r["lang"]: r["n"] for r in counted}
    languages = sorted(counts)
    if not languages:
        return LanguageModel((), np.zeros(0), np.zeros((bins, 0)), ngrams)
    shares = docs.sparkSession.createDataFrame([(x, int(min(1.0, sample_rows / n) * (1 << 20))) for x, n in counts.items()], "lang string, below int")
    sample = rows.join(F.broadcast(shares), "lang").filter("place < below").select("lang", "text")
    sums = written(sample.mapInArrow(_count(languages, bins, ngrams), struct("lang int, bin int, n long")).groupBy("lang", "bin").agg(F.sum("n").alias("n")), "ngram-counts")
    log_p = np.zeros((bins, len(languages)), np.float32)
    for first in range(0, len(languages), COUNTED_TOGETHER):
        part = sums.filter(F.col("lang").between(first, first + COUNTED_TOGETHER - 1)).toArrow()
        table = np.zeros((bins, min(COUNTED_TOGETHER, len(languages) - first)))
        table[part["bin"].to_numpy(), part["lang"].to_numpy() - first] = part["n"].to_numpy()
        log_p[:, first:first + COUNTED_TOGETHER] = np.log(table + alpha) - np.log(table.sum(axis=0) + alpha * bins)
    prior = np.log(np.array([counts[x] for x in languages]) / sum(counts.values()))
    return LanguageModel(tuple(languages), prior, log_p, ngrams)


def scores(model: LanguageModel, texts: list[str | None]) -> np.ndarray:
    """Log posterior (not normalised) of each text and language."""
    total = np.tile(model.prior, (len(texts), 1))
    overlap = max(model.ngrams) - 1
    for codes, starts, rows in segments(texts, overlap):
        for n in model.ngrams:
            grams, owner = _per_segment(codes, starts, rows, n, len(model.log_p), overlap)
            if len(grams):
                # Segments are in order: sum the matrix rows of each run of equal owners.
                first = np.flatnonzero(np.diff(owner, prepend=-1))
                np.add.at(total, rows[owner[first], 0], np.add.reduceat(model.log_p[grams], first, axis=0, dtype=np.float64))
    return total


def _judged(model: LanguageModel, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and posterior probability of each text; null texts are undetermined."""
    pred, conf = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    rows = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False))
    if len(model.languages) and len(rows):
        s = scores(model, texts.take(pa.array(rows)).to_pylist())
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        conf[rows] = p[np.arange(len(rows)), best]
        for r, b in zip(rows, best):
            pred[r] = model.languages[b]
    return pred, conf


def language_of(text: Column, model: LanguageModel, spark: SparkSession) -> Column:
    """struct(lang_pred, score) of a text column. Only texts with a letter go to Python; other columns stay where they are."""
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            judged = [_judged(shared.value, part.column("text")) for part in blocks([pa.RecordBatch.from_arrays([texts], names=["text"])], "text", BLOCK_BYTES)]
            pred, conf = [x for p, _ in judged for x in p], np.concatenate([np.zeros(0), *(c for _, c in judged)])
            yield pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(conf)], names=["lang_pred", "score"])

    run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, struct("lang_pred string, score double"))(F.when(has_letter(text), text))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(LETTER), F.lit(False))


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of every whole text: (id_col, lang_pred, score).

    ``score`` is the posterior probability of the predicted language. ``und`` with score 0
    where the text is null, empty or has no letter, or nothing was learned. Ties go to the
    smaller language. One row per row of ``docs``; only the two named columns are read.
    """
    judged = docs.select(F.col(id_col), language_of(F.col(text_col), model, docs.sparkSession).alias("judged"))
    return judged.select(id_col, "judged.lang_pred", "judged.score")


def recognised(docs: DataFrame, model: LanguageModel, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` with all their columns whose language is determined with a score of ``least`` or more."""
    judged = docs.select(F.struct("*").alias("row"), language_of(F.col(text_col), model, docs.sparkSession).alias("judged"))
    kept = judged.filter((F.col("judged.lang_pred") != UNDETERMINED) & (F.col("judged.score") >= least))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
