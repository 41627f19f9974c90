"""Passages of 50 words that several texts have, most of them under 400 bytes."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

import corpus_pipeline
from quaymaster.llm import suffix_repeats
from tests.llm.conftest import SCHEMA


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5))) for _ in range(n)]


def shared():
    rng = random.Random(8)
    short, long, twice, cut = words(rng, 50), words(rng, 75), words(rng, 55), words(rng, 49)
    texts = [(i, " ".join(words(rng, 30) + short + words(rng, 20 + i))) for i in (7, 3, 11)]
    texts += [(i, " ".join(words(rng, 8) + long[i - 20:] + words(rng, 9))) for i in (22, 20, 21)]  # the least id has the whole
    texts += [(30, " ".join(words(rng, 9)) + "\n" + "\t\n".join(short) + " é " + "  ".join(long[:60]))]  # other separators, two passages
    texts += [(40, " ".join(twice + words(rng, 5) + twice))]  # twice, in one text only
    texts += [(i, " ".join(words(rng, 9) + cut + words(rng, 9))) for i in (41, 42)]  # too short
    texts += [(50, texts[0][1]), (50, texts[0][1]), (60, " ".join(twice[:48]))]  # copies of a text are no other text
    texts += [(None, " ".join(words(rng, 4) + words(random.Random(1), 52))) for _ in range(2)] + [(None, None), (None, ""), (8, " ")]
    texts += [(70, " ".join(words(rng, 4) + words(random.Random(2), 52))) for _ in range(2)]  # one id, two texts
    rng.shuffle(texts)
    return texts


def brute(rows, n=50):
    key = lambda i, t: (-1 if i is None else i, hashlib.md5((t or "").encode()).digest())
    first = {}
    for i, t in rows:
        first[t or ""] = min(first.get(t or "", key(i, t)), key(i, t))
    owner = defaultdict(lambda: (1 << 62, b""))
    found = {t: [(m.group(), m.span()) for m in re.finditer(r"[^ \t-\r]+", t)] for t in first}
    windows = {t: [tuple(w for w, _ in f[j:j + n]) for j in range(len(f) - n + 1)] for t, f in found.items()}
    for t, all_windows in windows.items():
        for w in all_windows:
            owner[w] = min(owner[w], first[t])
    out = []
    for i, t in rows:
        gone = set()
        for j, w in enumerate(windows[t or ""]):
            if owner[w] != first[t]:
                gone |= set(range(found[t][j][1][0], found[t][j + n - 1][1][1]))
        out.append((i, t and "".join(c for p, c in enumerate(t) if p not in gone)))
    return out


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(i, t, None, None, len(t or ""), *[None] * 6) for i, t in shared()], SCHEMA).repartition(4)


def test_repeats_of_50_words_go_from_all_texts_but_the_first(frame):
    rows = shared()
    want = brute(rows)
    b = [(t or "").encode() for _, t in rows]
    assert not {x[j:j + 400] for x in b[:1] for j in range(len(x) - 399)} & {x[j:j + 400] for x in b[1:] if x != b[0] for j in range(len(x) - 399)}
    assert sum(t != u for t, u in zip(rows, want)) >= 6
    got = corpus_pipeline.cut_repeats(frame.sparkSession, frame, "").collect()
    copies = {t for i, t in rows if i == 50 and len(t.encode()) >= 400}  # strings of 400 bytes by themselves
    want = [(i, "" if t in copies else u) for (i, t), (_, u) in zip(rows, want)]
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r["n_chars"] == len(r["text"] or "") for r in got)


def test_passages_are_cut_only_when_asked(frame):
    rows = [(i, t) for i, t in shared() if i not in (7, 50)]
    plain = frame.filter("doc_id is null or doc_id not in (7, 50)")
    assert sorted(((r["doc_id"], r["text"]) for r in suffix_repeats.without_repeats(plain).collect()), key=repr) == sorted(rows, key=repr)
