"""Whitening, personal data and periodic runs beside brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaymaster.llm import periodic_runs as pr
from quaymaster.llm import pii, whitening
from tests.llm.conftest import ordered

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def vectors(dimensions, rows, seed=3, flat=True):
    rng = np.random.default_rng(seed)
    scale = np.ones(dimensions) if flat else 0.8 ** np.arange(dimensions)
    return (rng.standard_normal((rows, dimensions)) * scale + 3).astype(np.float32)


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", "w") for i, v in rows], "vec_id long, embedding array<float>, whitened string, id string")


def whole(v):
    return np.floor(np.asarray(v, np.float64) * 64).astype(np.int64) + 1_000_000


@pytest.mark.parametrize("dimensions, flat", [(60, True), (60, False), (5, True)])
def test_whitening_is_the_eigenvectors_of_the_covariance(spark, dimensions, flat):
    v = vectors(dimensions, 400, flat=flat)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(9, v[9].tolist())] + [(1000 + i, v[i % 3].tolist()) for i in range(150)]
    bad = [(-1, None), (-2, []), (-3, [1.0]), (-4, [float("nan")] + [0.0] * (dimensions - 1)), (-5, [None] + [0.0] * (dimensions - 1)),
           (-6, [float("inf")] + [0.0] * (dimensions - 1)), (-7, [3e38] * dimensions)]
    got = whitening.whiten(table(spark, rows + bad), shift=1_000_000).collect()
    assert len(got) == len(rows)
    x = np.unique([whole(v) for _, v in rows], axis=0)
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:16], axes[:, ::-1][:, :16]
    by_id = {}
    for i, vec in rows:
        by_id[i] = whole(vec)
    mine = np.array([r["whitened"] for r in got])
    other = np.array([(by_id[r["vec_id"]] - sums / n) @ axes / np.sqrt(values) for r in got])
    sign = np.sign((mine * other).sum(axis=0))
    assert mine.shape == other.shape and np.abs(mine - other * sign).max() < 1e-8
    for r in got:
        assert r["n"] == n and r["deviation"] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(by_id[r["vec_id"]], sums))
        assert np.allclose(r["explained"], values / np.trace(centred.T @ centred / n), rtol=1e-9)
        assert r["identity_error"] < 1e-9


def test_whitening_without_variance(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, None), (2, [])])).count() == 0
    got = whitening.whiten(table(spark, [(1, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got] == [(1, 0, [], [], 0.0)] * 2
    # Three vectors on a line have one component.
    got = whitening.whiten(table(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(3)])).collect()
    assert [len(r["whitened"]) for r in got] == [1] * 3 and got[0]["explained"][0] == pytest.approx(1)


def test_deviations_beyond_a_long_are_exact(spark):
    big = [[2.0 ** 50, 0.0], [0.0, 2.0 ** 49], [-(2.0 ** 50), 1.0]]
    got = whitening.whiten(table(spark, list(enumerate(big)))).orderBy("vec_id").collect()
    x = [[int(a) * 64 for a in v] for v in big]
    sums = [sum(v[j] for v in x) for j in range(2)]
    assert [int(r["deviation"]) for r in got] == [sum((3 * a - s) ** 2 for a, s in zip(v, sums)) for v in x]


# --- fixed values: the patterns of the base kinds ---
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split("."))
                    or kind == "card" and 14 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 10 <= len(digits) <= 15):
                out.append((m.start(), order, m.end(), kind))
    return [(k, s, e) for s, _, e, k in sorted(out)]


def messy(rng):
    parts = ["4111 1111 1111 1111", "4111111111111112", "378282246310005", "10.0.0.1", "1.2.3.4.5", "256.1.1.1", "a.b+c@d-e.fr", "x@y", "a@b.c@d.e",
             "+1 (555) 123-4567", "+12", "++44 20 7946 0958", "GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33", "DE89370400440532013000", "é", "日本", "00", "-", " ", "."]
    return "".join(rng.choice([rng.choice(parts), rng.choice("ab1 -.@+(0"), " "]) for _ in range(rng.randint(0, 40)))


def test_base_spans_are_the_patterns(spark, docs, rows, empty):
    rng = random.Random(4)
    for _ in range(3000):
        text = messy(rng)
        found = pii.spans_of(text)
        assert [f[:3] for f in found if f[0] in BASE] == base_spans(text), text
        assert found == sorted(found, key=lambda f: (f[1], [k.name for k in pii.KINDS].index(f[0])))
        assert all(score >= pii.THRESHOLD for *_, score in found)
    texts = [(i, messy(rng) * (1 + 400 * (i % 50 == 0))) for i in range(200)] + rows
    df = spark.createDataFrame([(i, t, "s") for i, t in texts], "doc_id long, text string, spans string").repartition(3)
    got = pii.find(df).select("doc_id", pii.listed(pii.of_kind(F.col("spans"), *BASE)).alias("spans"))
    assert ordered(got) == sorted(((i, ",".join(f"{k}:{s}:{e}" for k, s, e in base_spans(t or ""))) for i, t in texts), key=repr)
    assert pii.find(empty).count() == 0 and pii.redact(empty).count() == 0


def test_checksums_and_context():
    kinds = lambda text: [(k, text[s:e]) for k, s, e, _ in pii.spans_of(text)]
    assert kinds("to GB82 WEST 1234 5698 7654 32 AND more") == [("iban", "GB82 WEST 1234 5698 7654 32")]
    assert kinds("DE89370400440532013000") == [("iban", "DE89370400440532013000")]
    assert kinds("DE89370400440532013001") == kinds("ZZ89370400440532013000") == kinds("xDE89370400440532013000") == []
    assert kinds("123-45-6789") == kinds("order 123-45-6789, ssn") == kinds("ssn 000-45-6789") == []
    assert kinds("her SSN: 123-45-6789.") == [("ssn", "123-45-6789")]
    assert kinds("call (555) 123-4567 now") == [("local_phone", "(555) 123-4567")] and kinds("(555) 123-4567") == []
    # A base span is kept whatever is near it; a local number within it is no span of its own.
    assert kinds("invoice phone +1 (555) 123-4567") == [("phone", "+1 (555) 123-4567")]
    near, far = pii.spans_of("card 4111111111111111"), pii.spans_of("4111111111111111")
    assert near[0][3] > far[0][3] >= pii.THRESHOLD
    assert all(pii.mod_97(a) for a in ("GB82WEST12345698765432", "NO9386011117947", "FR1420041010050500013M02606"))


def test_searching_takes_linear_time():
    for text in ("a" * 10 ** 6, "1" * 10 ** 6, "@" * 10 ** 6, "+1" * 500_000, "a@" * 500_000, "1." * 500_000 + "x", "AB12" + " A" * 10 ** 6):
        pii.spans_of(text)


def test_redacted_texts(spark):
    df = spark.createDataFrame([(1, "mail a.b@c.de or 10.0.0.1!", 0), (1, "mail a.b@c.de or 10.0.0.1!", 0), (2, None, 0), (None, "", 0)], "doc_id long, text string, spans int")
    assert ordered(pii.redact(df)) == sorted([(1, "mail <email> or <ip>!")] * 2 + [(2, None), (None, "")], key=repr)


def brute_runs(w):
    n, out = len(w), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                out.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in out.items())


def repetitive(rng):
    w = []
    for _ in range(rng.randint(0, 12)):
        kind = rng.random()
        if kind < 0.25:
            w += [rng.choice("abcdefgh") for _ in range(rng.randint(1, 30))]
        elif kind < 0.8 or not w:
            p = ["a"] * rng.randint(1, 30) + ["b"] if rng.random() < 0.4 else [rng.choice("abc") for _ in range(rng.randint(1, 40))]
            w += [p[i % len(p)] for i in range(rng.randint(1, len(p) * 8))]
        elif len(w) < 300:
            w = w * rng.randint(1, 4)
    return w


def test_runs_are_those_of_brute_force_however_words_are_appended():
    rng = random.Random(8)
    for _ in range(40):
        texts = [repetitive(rng) for _ in range(rng.randint(1, 4))]
        want = [brute_runs(w) for w in texts]
        for appended in (1 << 17, 1, rng.randint(2, 60)):
            assert pr.runs_of(texts, appended) == want
    assert pr.runs_of([]) == [] and pr.runs_of([[], []]) == [[], []]


def test_catchers_forget_nothing_between_appends():
    catchers = pr.SquareCatchers()
    for _ in range(70):
        catchers.append(np.arange(5))
        catchers.append(np.zeros(0, np.int64))
    assert catchers.finish() == [(0, 350, 5)]


def test_long_texts_with_runs_within_runs():
    words = (["a"] * 3000 + ["b"]) * 40
    assert pr.runs_of([words]) == [sorted([(0, len(words), 3001)] + [(i * 3001, 3000, 1) for i in range(40)])]
    assert pr.runs_of([["a"] * 300_000]) == [[(0, 300_000, 1)]]


def looped_words(doc_id, words):
    if doc_id is None or not words or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_runs_of_documents(spark, docs, rows, empty):
    rng = random.Random(2)
    rows = rows + [(i, " ".join(repetitive(rng)).replace("b ", "b \n\t")) for i in range(100, 400)]
    df = spark.createDataFrame([(i, t, "r") for i, t in rows], "doc_id long, text string, runs string").repartition(3)
    want = []
    for i, text in rows:
        words = looped_words(i, WORD.findall(text or ""))
        runs = brute_runs(words) if len(words) < 2000 else pr.runs_of([words])[0]
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
        gone = {j for s, n, q in runs for j in range(s + q, s + n)}
        kept = " ".join(w for j, w in enumerate(words) if j not in gone)
        want.append((i, len(words), runs, best, hashlib.sha256(kept.encode()).hexdigest()))
    assert sum(bool(r[2]) for r in want) > 30
    text = pr.looped(F.col("text"), F.col("doc_id")).alias("text")
    got = pr.periodic_runs(df.select("doc_id", text)).collect()
    mine = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["strongest"] and tuple(r["strongest"]), hashlib.sha256(r["collapsed"].encode()).hexdigest()) for r in got]
    assert sorted(mine, key=repr) == sorted(want, key=repr)
    assert pr.periodic_runs(empty).count() == 0
