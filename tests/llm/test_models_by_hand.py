"""Naive Bayes, expectation-maximisation and repeated strings beside versions written out by hand."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quaymaster.llm import language_id, quality_rules, suffix_repeats

WORDS = {"en": "the of and to in that with from which would there their".split(), "de": "der die und nicht mit ein auf über für ständig größe ist".split(),
         "fr": "le la et les des une dans qui être très français été".split()}


def sentence(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def grams(text):
    codes = [ord(c) for c in text.lower()]
    for n in (1, 2, 3):
        for i in range(len(codes) - n + 1):
            h = n
            for c in codes[i:i + n]:
                h = (h ^ c) * 2654435761 % 2 ** 32
                h ^= h >> 15
            yield h % 32768


def test_language_is_that_of_naive_bayes_by_hand(spark):
    rng = random.Random(7)
    learned = [(i, sentence(rng, lang, rng.randint(1, 30)), lang) for i, lang in enumerate(rng.choices(["en", "de", "fr"], weights=[6, 3, 1], k=300))]
    learned += [(900, None, "en"), (901, "the", None), (902, "", "xx")]
    counts, rows = defaultdict(Counter), Counter()
    for _, text, lang in learned:
        if text is not None and lang is not None:
            rows[lang] += 1
            counts[lang].update(grams(text))
    asked = [(i, sentence(rng, rng.choice(list(WORDS)), rng.randint(1, 6))) for i in range(120)] + [(500, None), (501, ""), (502, "12 34 !"), (503, "über the été " * 4000), (None, "die")]
    model = language_id.fit(spark.createDataFrame(learned, "doc_id long, text string, lang string"))
    assert model.languages == ("de", "en", "fr", "xx")
    df = spark.createDataFrame(asked, "doc_id long, text string").withColumn("lang", F.lit("none")).withColumn("score", F.lit(1))
    got = {(r["doc_id"], r["lang_pred"], round(r["score"], 3)) for r in language_id.predict(df, model).collect()}
    want = set()
    for i, text in asked:
        if not any(c.isalpha() for c in text or ""):
            want.add((i, "und", 0.0))
            continue
        found = Counter(grams(text))
        log = {}
        for lang in model.languages:
            total = sum(counts[lang].values()) + 0.1 * 32768
            log[lang] = math.log(rows[lang] / sum(rows.values())) + sum(n * math.log((counts[lang][g] + 0.1) / total) for g, n in found.items())
        best = max(log, key=lambda x: (log[x], x))
        want.add((i, best, round(1 / sum(math.exp(v - log[best]) for v in log.values()), 3)))
    assert {x[:2] for x in got} == {x[:2] for x in want}
    assert sorted(x[2] for x in got) == pytest.approx(sorted(x[2] for x in want), abs=0.01)


def test_many_languages_and_too_many(spark):
    langs = [(i, f"word{i} " * 3, f"l{i:04d}") for i in range(700)]
    model = language_id.fit(spark.createDataFrame(langs, "doc_id long, text string, lang string"))
    assert len(model.languages) == 700 and model.log_p.shape == (32768, 700)
    too_many = spark.range(1001).selectExpr("id AS doc_id", "'x' AS text", "cast(id AS string) AS lang")
    with pytest.raises(ValueError):
        language_id.fit(too_many)


def test_copies_go_into_the_sample_one_by_one(spark):
    rows = spark.range(4000).selectExpr("id AS doc_id", "if(id < 3000, 'same text', concat('other ', id)) AS text", "'en' AS lang")
    whole = language_id.fit(rows, sample_rows=4000)
    some = language_id.fit(rows, sample_rows=1000)
    # About a quarter of the copies, so about their share of the n-grams.
    assert abs(some.log_p - whole.log_p).max() < 4 and len(some.languages) == 1


def test_quality_is_that_of_expectation_maximisation_by_hand(spark, docs):
    rows = quality_rules.judge(quality_rules.measure(docs)).collect()
    votes = [r["votes"] for r in rows]
    learned = [r["votes"] for r in rows if not r["base_failed"]]
    rules = len(quality_rules.RULES)
    prior, yes, no = 0.8, [0.95] * rules, [0.4] * rules

    def posterior(v):
        odds = math.log(prior / (1 - prior))
        for x, a, b in zip(v, yes, no):
            odds += math.log(a / (1 - b)) if x == "+" else math.log((1 - a) / b) if x == "-" else 0
        return 1 / (1 + math.exp(-odds))

    last = {}
    for _ in range(200):
        quality = {v: posterior(v) for v in set(votes)}
        if last and max(abs(quality[v] - last[v]) for v in quality) < 1e-9:
            break
        last = quality
        for j in range(rules):
            spoke = [v for v in learned if v[j] != "0"]
            good, bad = sum(quality[v] for v in spoke), sum(1 - quality[v] for v in spoke)
            y = (sum(quality[v] for v in spoke if v[j] == "+") + 20 * 0.95) / (good + 20)
            n = (sum(1 - quality[v] for v in spoke if v[j] == "-") + 20 * 0.4) / (bad + 20)
            n = max(n, 1 - y + 1e-6)
            yes[j], no[j] = min(max(y, 1e-6), 1 - 1e-6), min(max(n, 1e-6), 1 - 1e-6)
        prior = (sum(quality[v] for v in learned) + 1) / (len(learned) + 2)
    for r in rows:
        assert r["quality"] == pytest.approx(quality[r["votes"]], abs=1e-6)
        assert r["kept"] == (not r["base_failed"] and quality[r["votes"]] >= 0.5)


@pytest.mark.parametrize("length, gone", [(399, 0), (400, 400), (401, 401)])
def test_repeats_go_from_400_bytes_on(spark, length, gone):
    rng = random.Random(length)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passage = letters(length)
    rows = [(1, letters(600) + "1" + passage + "2" + letters(300)), (2, "3" + passage + "4" + letters(100)), (3, letters(900))]
    got = suffix_repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {1: gone, 2: gone, 3: 0}
