"""Near duplicates, repeated passages and repeated bytes beside brute force."""

import hashlib
import random
from collections import Counter

import pytest
from quaymaster.llm import minhash, phrase_automata, suffix_repeats
from quaymaster.llm.components import components
from quaymaster.llm.windows import sliding_minimum, window_hashes
from tests.llm.conftest import ordered

import numpy as np


def near_groups(rows, percent):
    """(id, set size, component, kept) by comparing all pairs."""
    sets = [(i, minhash.shingle_set(minhash.words_of(t))) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in sets:
        for j, b in sets:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return [(i, len(s), None if i is None else find(i), i is not None and find(i) == i) for i, s in sets]


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(docs, rows, percent):
    assert ordered(minhash.near_duplicates(docs, percent)) == sorted(near_groups(rows, percent), key=repr)


def test_links_across_components_are_found(spark):
    """Chains: each text is near the next, the ends are far apart, so one comparison with the smallest is not enough."""
    rng = random.Random(3)
    rows, text = [], [f"w{rng.random()}" for _ in range(120)]
    for i in range(40):
        rows.append((i * 7 % 40, " ".join(text)))
        text[3 * i % 120] = f"new{i}"
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85)
    assert ordered(found) == sorted(near_groups(rows, 85), key=repr)


def test_rows_of_one_id_are_in_one_component(spark):
    """Rows of an id with different texts, equal to texts of smaller ids or to none, and without words."""
    text = {c: " ".join(f"{c}{i}" for i in range(20)) for c in "abcdefg"}
    rows = [(3, text["a"]), (8, text["a"]), (8, text["b"]), (5, text["c"]), (9, text["c"]), (9, text["d"]), (4, text["d"]), (9, None),
            (12, text["e"]), (12, text["f"]), (13, text["f"]), (None, text["b"]), (2, None), (2, text["g"]), (20, text["g"]), (21, " "), (21, None)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 85)
    want = near_groups(rows, 85)
    assert {(i, c) for i, _, c, _ in want if i in (8, 9, 20)} == {(8, 3), (9, 4), (20, 2)}
    assert ordered(found) == sorted(want, key=repr)


def test_bayesian_bounds():
    least = minhash.least_matches(0.85, 1e-6, 144)
    assert least[16] < least[144] < 0.85 * 144 and least[144] > 0.6 * 144
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 32, (200, 144), dtype=np.uint32)
    same = rng.random((200, 144)) < np.where(np.arange(200) < 100, 0.9, 0.3)[:, None]
    b = np.where(same, a, a + 1).astype(np.uint32)
    alive = minhash.plausible([x.tobytes() for x in a], [x.tobytes() for x in b], 0.85)
    assert alive[:100].all() and not alive[100:].any()


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 103), (103, 100), (101, 103), (7, 7), (200, 60)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 103: 100, 200: 60, 60: 60}


def test_components_that_still_change_are_refused(spark, monkeypatch):
    monkeypatch.setattr("quaymaster.llm.components.MOST_ROUNDS", 2)
    with pytest.raises(RuntimeError, match="after 2 rounds"):
        components(spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long"))


def passages(rows):
    out = []
    first = {}
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for j in range(len(w) - 49):
            if i is not None:
                k = tuple(w[j:j + 50])
                first[k] = min(first.get(k, i), i)
    for i, w in words:
        drop = set()
        for j in range(len(w) - 49):
            if i is not None and first[tuple(w[j:j + 50])] < i:
                drop.update(range(j, j + 50))
        kept = b" ".join(x for j, x in enumerate(w) if j not in drop)
        out.append((i, len(w), len(drop), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("shard_bytes", [1 << 24, 2_000])
def test_repeated_passages(docs, rows, shard_bytes, monkeypatch):
    monkeypatch.setattr(phrase_automata, "SHARD_BYTES", shard_bytes)
    want = passages(rows)
    assert sum(x[2] for x in want) > 300
    assert ordered(phrase_automata.remove_repeated_passages(docs)) == sorted(want, key=repr)


def test_automaton_widens_to_whole_stretches():
    passage = [b"p%d" % i for i in range(130)]
    automaton = phrase_automata.PhraseAutomaton([(1, passage), (2, passage[30:90])])
    text = [b"x"] * 7 + passage[11:75] + [b"y"] + passage[:49]
    assert sorted(set(automaton.occurrences(text))) == [(1, 7, 71)]
    assert list(phrase_automata.PhraseAutomaton([]).occurrences(text)) == []


def cut(rows):
    count = Counter(b[j:j + 400] for _, t in rows for b in [(t or "").encode()] for j in range(len(b) - 399))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - 399):
            if count[b[j:j + 400]] > 1:
                gone[j:j + 400] = b"\1" * 400
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [2_048, 1])
def test_repeated_bytes(docs, rows, hot, monkeypatch):
    """With a limit of one context every anchor is hot and goes through all levels."""
    monkeypatch.setattr(suffix_repeats, "HOT_CONTEXTS", hot)
    want = cut(rows)
    assert sum(x[2] for x in want) > 3000
    assert ordered(suffix_repeats.remove_repeats(docs)) == sorted(want, key=repr)


def test_texts_without_repeats(docs, rows):
    left = suffix_repeats.without_repeats(docs)
    assert left.columns == docs.columns
    got = Counter((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest(), r["text"] is None) for r in left.collect())
    assert got == Counter((c[0], c[4], t is None) for c, (_, t) in zip(cut(rows), rows))


def test_maximal_repeats_have_all_occurrences():
    bodies = [b"xxABCDEFyy", b"ppABCDEFqq", b"ABCDEFzz", b"mABCDn"]
    groups = {(n, tuple(sorted(zip(body.tolist(), place.tolist())))) for n, body, place in suffix_repeats.maximal_repeats(bodies, 4)}
    assert groups == {(6, ((0, 2), (1, 2), (2, 0))), (4, ((0, 2), (1, 2), (2, 0), (3, 1)))}
    assert list(suffix_repeats.maximal_repeats([], 4)) == [] and suffix_repeats.repeated_spans([b"aaaaaa"], 4) == [[(0, 6)]]


def test_suffix_array_without_packing(monkeypatch):
    rng = random.Random(9)
    bodies = [bytes(rng.choice(b"ab") for _ in range(60)) for _ in range(30)]
    usual = suffix_repeats.repeated_spans(bodies, 9)
    monkeypatch.setattr(suffix_repeats, "_ranks", lambda a, b: np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1])
    assert suffix_repeats.repeated_spans(bodies, 9) == usual


def test_window_hashes_tell_windows_apart():
    rng = np.random.default_rng(4)
    values = rng.integers(0, 2, 3000).astype(np.uint8)
    for width in (1, 2, 5, 16, 32, 50):
        hashes = window_hashes(values, width)
        windows = [values[i:i + width].tobytes() for i in range(len(values) - width + 1)]
        assert len(hashes) == len(windows) and len(set(zip(hashes.tolist(), windows))) == len(set(windows)) == len(set(hashes.tolist()))
        assert (sliding_minimum(hashes, 35) == [hashes[i:i + 35].min() for i in range(len(hashes) - 34)]).all()
    assert len(window_hashes(values[:4], 5)) == 0 and len(sliding_minimum(values[:4], 5)) == 0


def test_nothing(empty):
    assert minhash.near_duplicates(empty).count() == 0
    assert phrase_automata.remove_repeated_passages(empty).count() == 0
    assert suffix_repeats.remove_repeats(empty).count() == 0
    assert suffix_repeats.without_repeats(empty).count() == 0
