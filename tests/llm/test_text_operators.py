"""Quality rules, byte-level BPE, language identification and language-model scores beside brute force."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quaymaster.llm import byte_bpe, language_id, ppm, quality_rules
from tests.llm.conftest import ordered

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {i + j for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures(docs, rows, empty):
    got = quality_rules.measure(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert ordered(got) == sorted(((i, *measures(t)) for i, t in rows), key=repr)
    assert quality_rules.judge(quality_rules.measure(empty)).count() == 0


def test_rules_with_nothing_to_learn_keep_the_prior():
    prior, _, posterior = quality_rules.expectation_maximisation(np.zeros((1, 3)), np.array([5.0]))
    assert posterior[0] == pytest.approx(prior, abs=0.2)


def test_expectation_maximisation_finds_the_good_class():
    rng = np.random.default_rng(1)
    good = rng.random(4000) < 0.8
    right = rng.random((4000, 4)) < np.where(good[:, None], 0.95, 0.7)
    votes = np.where(right == good[:, None], 1, -1) * np.where(rng.random((4000, 4)) < 0.2, 0, 1)
    patterns, index, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    _, accuracy, posterior = quality_rules.expectation_maximisation(patterns.astype(float), counts.astype(float))
    assert np.mean((posterior[index.ravel()] >= 0.5) == good) > 0.93
    assert np.all(accuracy.sum(axis=1) > 1)


def test_judge(docs, rows):
    judged = quality_rules.judge(quality_rules.measure(docs)).collect()
    assert len(judged) == len(rows)
    for r in judged:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert 0 <= r["quality"] <= 1 and r["kept"] == (not r["base_failed"] and r["quality"] >= 0.5)
    with pytest.raises(ValueError):
        quality_rules.judge(quality_rules.measure(docs), [quality_rules.RULES[0]] * 11)


@pytest.mark.parametrize("chunk, overlap", [(32_768, 1_024), (700, 60), (97, 40)])
def test_bpe_is_the_library_whatever_the_chunks(docs, rows, chunk, overlap):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encode = byte_bpe.encoding(path, public_tokenizers.PATTERN).encode_ordinary
    found = byte_bpe.decode(byte_bpe.encode(docs, path, public_tokenizers.PATTERN, chunk, overlap), path)
    got = sorted(((r["doc_id"], r["ids"], bytes(r["decoded"])) for r in found.collect()), key=repr)
    assert got == sorted(((i, encode(t or ""), (t or "").encode()) for i, t in rows), key=repr)


def test_boundaries_do_not_depend_on_what_follows():
    text = "it's  we'll\n\n don't \x1c\x85 x1234 --- " * 3
    whole = set(byte_bpe.boundaries(public_tokenizers.PATTERN, text, True))
    for end in range(1, len(text)):
        assert set(byte_bpe.boundaries(public_tokenizers.PATTERN, text[:end], False)) <= whole


def test_bpe_of_nothing(empty, spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    assert byte_bpe.decode(byte_bpe.encode(empty, path, public_tokenizers.PATTERN), path).count() == 0
    null = spark.sql("SELECT 1L doc_id, cast(null AS array<int>) ids, 'x' decoded")
    assert [bytes(r["decoded"]) for r in byte_bpe.decode(null, path).collect()] == [b""]


def test_language(spark, docs, rows, empty):
    texts = [("en", "the cat and the dog went to the house"), ("de", "der hund und die katze gehen nach haus"), ("xx", "")]
    train = spark.createDataFrame([(i, t, lang) for i in range(20) for lang, t in texts] + [(99, None, "en"), (98, "zzz", None)],
                                  "doc_id long, text string, lang string")
    model = language_id.fit(train)
    assert model.languages == ("de", "en", "xx")
    seen = spark.createDataFrame([(1, "the dog and the cat", "lang"), (2, "der hund und das haus " * 70_000, "l"), (3, None, "l"),
                                  (4, "123 !", "l"), (5, "", "l"), (None, "the house", "l")], "doc_id long, text string, lang_pred string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(seen, model).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4, 5, None)] == ["en", "de", "und", "und", "und", "en"]
    assert got[3][1] == 0 and all(0 <= s <= 1 for _, s in got.values())
    kept = language_id.recognised(seen, model)
    assert kept.columns == seen.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, None}
    assert language_id.predict(docs, model).count() == len(rows) and language_id.predict(empty, model).count() == 0
    nothing = language_id.fit(empty)
    assert {r["lang_pred"] for r in language_id.predict(docs, nothing).collect()} == {"und"}


def test_language_scores_do_not_depend_on_blocks():
    rng = np.random.default_rng(2)
    model = language_id.LanguageModel(("a", "b"), np.log([0.5, 0.5]), rng.random((language_id.BINS, 2)).astype(np.float32) - 3)
    texts = ["abc def " * 30, None, "x", "", "héllo wörld " * 50]
    whole = language_id.scores(model, texts)
    old = language_id.segments.__defaults__
    language_id.segments.__defaults__ = (17,)
    try:
        assert np.allclose(language_id.scores(model, texts), whole)
    finally:
        language_id.segments.__defaults__ = old
    grams = sum(max(len(texts[0]) - n + 1, 0) for n in model.ngrams)
    one = language_id.LanguageModel(("a",), np.zeros(1), np.full((language_id.BINS, 1), -1, np.float32))
    assert language_id.scores(one, texts)[0, 0] == -grams


def brute_ppm(train, text, order=4):
    trie = defaultdict(Counter)
    for t in train:
        raw = b"\xff" * order + t.encode().lower() + b"\xfe"
        for i in range(order, len(raw)):
            for k in range(order + 1):
                trie[raw[i - k:i]][raw[i]] += 1
    raw, total = b"\xff" * order + text.encode().lower() + b"\xfe", 0.0
    for i in range(order, len(raw)):
        out = set()
        for k in range(order, -1, -1):
            seen = {s: n for s, n in trie.get(raw[i - k:i], {}).items() if s not in out}
            if raw[i] in seen:
                total += math.log10(seen[raw[i]] / (sum(seen.values()) + len(seen)))
                break
            if seen:
                total += math.log10(len(seen) / (sum(seen.values()) + len(seen)))
            out |= set(seen)
        else:
            total -= math.log10(255 - len(out))
    return total


@pytest.mark.parametrize("shard_bytes", [1 << 24, 20_000])
def test_ppm(docs, rows, shard_bytes, monkeypatch):
    monkeypatch.setattr(ppm.gram_pieces, "__defaults__", (4, 500))
    train = F.coalesce(F.col("doc_id"), F.lit(1)) % 3 != 0
    got = ordered(ppm.score_documents(docs, train, shard_bytes=shard_bytes))
    learned = [t or "" for i, t in rows if (1 if i is None else i) % 3 != 0]
    count = Counter(w for t in learned for w in [*t.encode().lower().split(), b""])
    n, v = sum(count.values()), len(count)
    want = []
    for i, t in rows:
        w = [*(t or "").encode().lower().split(), b""]
        base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        want.append((i, (1 if i is None else i) % 3 == 0, len(w), sum(count[x] > 0 for x in w), n, base, brute_ppm(learned, t or "")))
    for a, b in zip(got, sorted(want, key=repr), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_ppm_without_documents_or_training(docs, empty, rows):
    assert ppm.score_documents(empty, F.lit(True)).count() == 0
    got = ppm.score_documents(docs, F.lit(False)).collect()
    assert len(got) == len(rows) and all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in got)
    for r in got:
        if r["doc_id"] == 3:
            assert r["score"] == pytest.approx(-4 * math.log10(255))
