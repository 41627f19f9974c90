"""Quality by weak supervision: rules vote or abstain, EM learns how right they are, a posterior decides.

Measures of each whole text are taken where it is read. Rules are DataFrame
conditions over the measures. Documents with the same votes are alike, so EM runs
over the counts of vote patterns (at most 3 to the number of rules, whatever the
size of the corpus) and the posterior of each pattern is broadcast back.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quaymaster.llm.common import blocks, struct

BLOCK_BYTES = 8 << 20
WINDOW = 5
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
ENDS = (b".", b"!", b"?", b'"', b":", b";")
# What is left of UTF-8 bytes without these are the ASCII characters that are no letters.
NOT_COUNTED = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
MOST_RULES = 10  # 3**10 patterns at most reach the driver and are broadcast
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_ended_lines long, n_letters long, n_distinct_words long"


@dataclass(frozen=True)
class Rule:
    """Votes good where ``good`` holds, else bad where ``bad`` holds, else abstains."""
    name: str
    good: str
    bad: str


RULES = (
    Rule("length", "n_words >= 50", "n_words < 20"),
    Rule("word_length", "word_chars between 3 * n_words and 9 * n_words", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    Rule("symbols", "100 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    Rule("line_repeats", "n_lines >= 3 and 20 * n_dup_lines <= n_lines", "4 * n_dup_lines > n_lines"),
    Rule("phrase_repeats", "n_words >= 20 and 50 * n_repeat_words <= n_words", "10 * n_repeat_words > n_words"),
    Rule("letters", "10 * n_letters >= 9 * word_chars", "100 * n_letters < 85 * word_chars"),
    Rule("line_ends", "2 * n_ended_lines >= n_lines", "10 * n_ended_lines < n_lines"),
    Rule("line_length", "n_words >= 8 * n_lines", "n_words < 4 * n_lines and n_lines >= 3"),
    Rule("vocabulary", "n_words >= 20 and 10 * n_distinct_words >= 3 * n_words", "n_words >= 50 and 10 * n_distinct_words < n_words"),
)


def _renumbered(a: np.ndarray) -> tuple[np.ndarray, int]:
    values, index = np.unique(a, return_inverse=True)
    return index.astype(np.int64), len(values)


def repeated_words(ids: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Words per document in windows of five that occur twice or more in it; ``doc`` is the document of each word."""
    size = len(ids) - WINDOW + 1
    if size < 2:
        return np.zeros(docs, np.int64)
    # Equal numbers stand for equal words, pairs, fours and windows of a document: exact, no hashes.
    k = int(ids.max()) + 1
    pair, n = _renumbered(ids[:-1] * k + ids[1:])
    four, n = _renumbered(pair[:-2] * n + pair[2:])
    inside = np.flatnonzero(doc[:size] == doc[WINDOW - 1:])
    five, n = _renumbered(four[inside] * k + ids[inside + WINDOW - 1])
    window, n = _renumbered(five * docs + doc[inside])
    again = inside[np.bincount(window, minlength=n)[window] > 1]
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + WINDOW, -1)
    return np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=docs)


def measure_texts(texts: Sequence[str | None]) -> dict[str, np.ndarray]:
    """The measures of each text; a null text is empty."""
    numbers: dict[bytes, int] = {}
    ids, lengths, rows = [], [], []
    for text in texts:
        text = text or ""
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()  # bytes split at exactly the six ASCII spaces
        doc_ids = [numbers.setdefault(w, len(numbers)) for w in words]
        ids += doc_ids
        lengths.append(len(words))
        lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
        rows.append((len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), 0,
                     len(lines), sum(line.rstrip().endswith(ENDS) for line in lines), len(text) - len(raw.translate(None, NOT_COUNTED)), len(set(doc_ids))))
    table = np.array(rows, np.int64).reshape(len(rows), 9)
    doc = np.repeat(np.arange(len(texts)), lengths)
    table[:, 4] = repeated_words(np.array(ids, np.int64), doc, max(len(texts), 1))[:len(texts)]
    return dict(zip((x.split()[0] for x in MEASURES.split(", ")), table.T))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col and the measures), one row per row of ``docs``; only the two named columns are read."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]):
        for part in blocks(batches, "text", BLOCK_BYTES):
            measured = measure_texts(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("id"), *map(pa.array, measured.values())], names=["id", *measured])
    return rows.mapInArrow(run, struct(f"id {rows.schema['id'].dataType.simpleString()}, {MEASURES}")).withColumnRenamed("id", id_col)


def vote(rules: Sequence[Rule]) -> Column:
    """The votes as text of ``+``, ``-`` and ``0``, one character a rule."""
    return F.concat(*[F.when(F.expr(r.good), "+").when(F.expr(r.bad), "-").otherwise("0") for r in rules])


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 200, tolerance: float = 1e-9, first_prior: float = 0.8,
                             first: tuple[float, float] = (0.95, 0.4), strength: float = 20.0) -> tuple[float, np.ndarray, np.ndarray]:
    """(prior of good, accuracies, posterior of each pattern) from patterns of +1, -1, 0 and their counts.

    Each rule that does not abstain has two accuracies (columns of the second result): the
    chance that it votes good on a good document and bad on a bad one. Both start at
    ``first`` with beta priors worth ``strength`` votes and stay together above chance,
    so that good and bad cannot change places. Abstaining says nothing.
    """
    up, down = votes > 0, votes < 0
    prior, accuracy = first_prior, np.tile(first, (votes.shape[1], 1))
    posterior = np.full(len(votes), prior)
    for _ in range(rounds):
        yes, no = accuracy.T
        odds = np.log(prior / (1 - prior)) + up @ np.log(yes / (1 - no)) - down @ np.log(no / (1 - yes))
        updated = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        good, bad = counts * updated, counts * (1 - updated)
        yes = (good @ up + strength * first[0]) / (good @ (up | down) + strength)
        no = (bad @ down + strength * first[1]) / (bad @ (up | down) + strength)
        accuracy = np.clip(np.stack([yes, np.maximum(no, 1 - yes + 1e-6)], axis=1), 1e-6, 1 - 1e-6)
        prior = (good.sum() + 1) / (counts.sum() + 2)
        done = np.abs(updated - posterior).max(initial=0) < tolerance
        posterior = updated
        if done:
            break
    return prior, accuracy, posterior


def judge(measured: DataFrame, rules: Sequence[Rule] = RULES, least: float = 0.5) -> DataFrame:
    """``measured`` with votes, quality (posterior probability), base_failed and kept.

    ``base_failed`` texts (under 10 words, or over 20% of words in repeated windows) are
    never kept; the others are when their posterior reaches ``least``. Texts of which
    every rule abstains get the prior. An empty table gives an empty result.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    spark = measured.sparkSession
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    voted = measured.withColumns({"votes": vote(rules), "base_failed": failed})
    # Bounded by 3 ** MOST_RULES. What the base settles is not learned from, lest it hide other kinds of bad text.
    patterns = voted.groupBy("votes").agg(F.count(F.when(~F.col("base_failed"), 1)).alias("n")).orderBy("votes").collect()
    votes = np.array([["-0+".index(v) - 1 for v in p["votes"]] for p in patterns], float).reshape(len(patterns), len(rules))
    _, _, posterior = expectation_maximisation(votes, np.array([p["n"] for p in patterns], float))
    table = spark.createDataFrame([(p["votes"], float(q)) for p, q in zip(patterns, posterior)], "votes string, quality double")
    return (voted.join(F.broadcast(table), "votes")
            .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least)))
