"""Source mixing, permutation index, URL reputation and the pipeline beside brute force."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from quaymaster.llm import byte_bpe, mixing, permutation_index, suffix_repeats, url_reputation
from quaymaster.llm.common import written
from tests.llm.conftest import ordered
from tests.llm.test_duplicates import cut, near_groups


def fill(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Capped water-filling, one full source at a time."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        if not full:
            target.update({s: level * weight[s] for s in open_})
            break
        for s in full:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mix(docs, rows, empty):
    got = mixing.mixed(docs).collect()
    again = mixing.mixed(docs.repartition(7)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    size = lambda t: len((t or "").replace("\n", " ").replace("\t", " ").split(" ")) - (t or "").replace("\n", " ").replace("\t", " ").split(" ").count("")
    assert sorted([(r["doc_id"], r["size"]) for r in got], key=repr) == sorted([(i, size(t)) for i, t in rows], key=repr)
    sizes = {}
    for i, t in rows:
        s = f"s{len(t) % 3}" if t else None
        sizes[s] = sizes.get(s, 0) + size(t)
    targets = fill(sizes)
    by = {}
    for r in got:
        assert r["taken"] in (r["size"] * r["repetitions"],) and 0 <= r["repetitions"] <= 2
        by.setdefault((r["source_size"], r["target"]), []).append(r)
    assert sorted(t for _, t in by) == pytest.approx(sorted(targets[s] for s in sizes))
    for (_, target), members in by.items():
        assert abs(sum(r["taken"] for r in members) - target) <= max(r["size"] for r in members)
    assert mixing.mixed(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_mix_repeats_rows(docs):
    counts = {}
    for r in mixing.mixed(docs).collect():
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + r["repetitions"]
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {k: v for k, v in counts.items() if v}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5}, {"a": 0, "b": 3}, {"a": 7}, {"a": 1, "b": 1, "c": 90, None: 4}])
def test_water_fill(spark, sizes):
    sources = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.water_fill(sources, (3, 1, 2), 1.5, 2.0).collect()}
    assert got == pytest.approx(fill(sizes))


def vectors(n=3000, dim=16):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, dim))
    x = (centres[rng.integers(0, 30, n)] + 0.4 * rng.normal(size=(n, dim))).astype(np.float32).astype(float)
    x[200:260] = x[200]  # ties
    return x


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(permutation_index, "BLOCK_ROWS", 800)
    monkeypatch.setattr(permutation_index, "QUERY_BYTES", 20 * 16 * 8)  # several passes
    x = vectors()
    rows = [(i, [float(v) for v in r], "s") for i, r in enumerate(x)]
    bad = [(5000, None, "s"), (5001, [], "s"), (5002, [0.0] * 16, "s"), (5003, [math.nan] * 16, "s"), (5050, [None] * 16, "s"), (None, [1.0] * 16, "s"),
           (5100, [1.0] * 3, "s"), (5150, [2.0, 2.0, 2.0], "s")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, score string")
    got = {}
    for r in permutation_index.nearest(df, lambda i: i % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in range(0, 3000, 50)} | {5100, 5150}
    assert [v[1] for v in got[5100]] == [5150] and got[5100][0][2] == pytest.approx(1)
    hits, u = 0, x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 3000, 50):
        s = u @ u[q]
        s[q] = -9
        true = sorted(range(3000), key=lambda i: (-round(s[i], 12), i))[:5]
        hits += len(set(true) & {v[1] for v in got[q]})
        assert [v[0] for v in got[q]] == [1, 2, 3, 4, 5] and all(v[2] == pytest.approx(s[v[1]]) for v in got[q])
    assert hits / (5 * 60) >= 0.9
    assert [v[1] for v in got[200]] == [201, 202, 203, 204, 205] and len({v[2] for v in got[200]}) == 1
    assert permutation_index.nearest(df.limit(0), lambda i: i % 50 == 0).count() == 0


def test_copies_beyond_a_shortlist_hide_no_neighbour(spark):
    """Half of a block is one vector, more than the rows of a shortlist; neighbours of other queries stay in sight."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 16)).astype(np.float32).astype(float)
    x[rng.permutation(4000)[:2000]] = x[7]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(2)
    got = {}
    for r in permutation_index.nearest(df, lambda i: i % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    u, hits = x / np.linalg.norm(x, axis=1, keepdims=True), 0
    for q in range(0, 4000, 100):
        s = np.round(u @ u[q], 12)
        s[q] = -9
        hits += len(set(np.lexsort((np.arange(4000), -s))[:5].tolist()) & set(got[q]))
    assert hits / (5 * 40) >= 0.9
    pivots = permutation_index.fit_pivots(permutation_index.usable(df, "vec_id", "embedding"), 256, 4000)
    assert len(pivots[16]) == 256 == len(np.unique(pivots[16], axis=0))


def test_footrule_is_the_sum_over_the_lists_read():
    x = permutation_index._unit(vectors(300))
    index = permutation_index.PermutationIndex(x, x[:40])
    order = np.argsort(-(x @ x[:40].T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    want = np.abs(place[:, order[7][:12]] - np.arange(12)).sum(axis=1)
    assert (index.footrule(x[7], 12) == want).all()


def test_urls(spark):
    rules = (("block", "net", "/"), ("allow", "example.net", "/en/"))
    urls = [None, "", "no scheme", "http://A.Example.NET/en/x?y://z", "https://example.net/fr", "http://net", "http://xnet/a", "ftp://h.co.uk:80/p#f",
            "http://u@bad.org/1", "http://bad.org/2?q", "http://1.2.3.4/a"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)] + [(9, "http://bad.org/2?q", "h", "r"), (None, "http://bad.org/3", "h", "r")],
                                  "page_id long, url string, host string, rule string")
    outcomes = spark.createDataFrame([(8, False)] * 30 + [(9, False)] * 20 + [(7, True)] * 200 + [(None, True), (3, None), (77, True)], "page_id long, good boolean")
    got = url_reputation.judge_urls(pages, outcomes, rules).collect()
    assert len(got) == 13
    by = {r["page_id"]: r for r in got if r["page_id"] != 9}
    assert [(by[i]["host"], by[i]["path"]) for i in (0, 1, 2, 3, 7)] == [("", ""), ("", ""), ("", ""), ("a.example.net", "/en/x"), ("h.co.uk:80", "/p")]
    assert [(by[i]["rule"], by[i]["verdict"]) for i in (3, 4, 5, 6)] == [("example.net/en/", "allow"), ("net/", "block"), (None, "allow"), (None, "allow")]
    assert by[8]["rule"] is None and by[8]["verdict"] == "allow" or by[8]["reputation"] > by[None]["reputation"]
    assert by[None]["verdict"] == "block" and by[7]["verdict"] == "allow"
    assert url_reputation.judge_urls(pages.limit(0), outcomes, rules).count() == 0
    unlabelled = url_reputation.judge_urls(pages, outcomes.limit(0), rules).filter("rule is null")
    assert {r["verdict"] for r in unlabelled.collect()} == {"allow"}


def test_hosts_are_split(spark):
    hosts = ["a.b.co.uk", "x.com", "com", "u:p@deep.sub.x.de:8080", "10.0.0.1", "[::1]:80", "", "xco.uk"]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = [tuple(r) for r in df.select(*url_reputation.split_host(F.col("host"))).collect()]
    assert got == [("a.b.co.uk", "b.co.uk", "co.uk"), ("x.com", "x.com", "com"), ("com", "com", "com"), ("deep.sub.x.de", "x.de", "de"),
                   ("10.0.0.1", "10.0.0.1", "10.0.0.1"), ("[::1]", "[::1]", "[::1]"), ("", "", ""), ("xco.uk", "xco.uk", "uk")]


def test_pipeline(spark, docs, rows, tmp_path):
    """Every stage on what the one before kept, each beside brute force."""
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == [
        "keep_recognised", "keep_one_of_near_duplicates", "cut_repeats", "mix_sources", "encode_and_decode"]
    found = corpus_pipeline.keep_recognised(spark, docs, "")
    assert found.columns == docs.columns
    lettered = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")]
    kept = found.select("doc_id", "text").collect()
    assert {tuple(r) for r in kept} <= set(lettered) and len(kept) >= 0.9 * len(lettered)

    one = corpus_pipeline.keep_one_of_near_duplicates(spark, docs, "")
    assert one.columns == docs.columns
    others = {i for i, _, c, _ in near_groups(rows, 80) if i is not None and c < i}
    left, seen = [], set()
    for i, t in sorted([(i, t) for i, t in rows if i not in others], key=lambda r: (r[0] is None, r[0] or 0)):
        words = tuple((t or "").lower().split())
        if not words or words not in seen:
            left.append((i, t))
        seen.add(words)
    lower = lambda found: sorted([(i, t and t.split()) for i, t in found], key=repr)
    assert lower(tuple(r) for r in one.select("doc_id", "text").collect()) == lower(left)

    shorter = corpus_pipeline.cut_repeats(spark, docs, "")
    assert shorter.columns == docs.columns
    got = sorted(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in shorter.collect())
    assert got == sorted(c[4] for c in cut(rows))
    assert all(r["n_chars"] == len(r["text"] or "") for r in shorter.collect())

    encode = byte_bpe.encoding(public_tokenizers.path(corpus_pipeline.VOCABULARY), public_tokenizers.PATTERN).encode_ordinary
    last = corpus_pipeline.encode_and_decode(spark, docs, "")
    assert sorted(((r["doc_id"], r["ids"]) for r in last.collect()), key=repr) == sorted(((i, encode(t or "")) for i, t in rows), key=repr)

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_pipeline_keeps_one_of_repeated_rows_and_rows_without_id(spark, docs):
    """Near-dedup and repeat removal chained: whole-text copies that near-dedup cannot group keep one text."""
    text = {c: " ".join(f"{c}{i}word" for i in range(120)) for c in "abcdef"}
    rows = ([(1, text["a"])] * 5 + [(None, text["b"])] * 4 + [(None, text["c"]), (7, text["c"]), (9, text["c"])]
            + [(None, text["d"]), (None, text["d"].upper().replace(" ", "\n"))] + [(4, text["e"]), (4, text["f"])] + [(None, None), (None, None), (5, " ")])
    assert all(len(t) > suffix_repeats.WINDOW for t in text.values())
    chained = spark.createDataFrame([(i, t, None, None, len(t or ""), *[None] * 6) for i, t in rows], docs.schema).repartition(4)
    for name, stage in corpus_pipeline.STAGES[1:3]:
        chained = written(stage(spark, chained, ""), name)
    assert chained.columns == docs.columns
    got = chained.select("doc_id", "text").collect()
    letter = lambda t: (t or " ")[0].lower()
    assert sorted(((r["doc_id"], letter(r["text"])) for r in got), key=repr) == sorted(
        [(1, "a"), (None, "b"), (7, "c"), (None, "d"), (4, "e"), (4, "f"), (None, " "), (None, " "), (5, " ")], key=repr)
    assert {" ".join(r["text"].lower().split()) for r in got if letter(r["text"]) != " "} == set(text.values())


def test_tables_written_on_the_way_are_deleted(spark, docs, tmp_path):
    import os

    from quaymaster.llm import common

    folder = common.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    with common.temporary_tables(spark) as outer:
        with common.temporary_tables(spark) as paths:
            first = written(docs.select("doc_id"), "first")
            second = written(first, "second")
            common.keep_last(paths)
        assert second.count() == docs.count() and {os.path.basename(p) for p in outer} == set(os.listdir(folder)) - before
    assert set(os.listdir(folder)) == before
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    with common.temporary_tables(spark):
        corpus_pipeline.run(spark, str(tmp_path)).count()
    # Of a whole run only what the last stage reads is left, and that is deleted too when someone asks for it.
    left = [n for n in set(os.listdir(folder)) - before if os.path.isdir(os.path.join(folder, n))]
    assert all(n.startswith("source_mixing") for n in left) and len(left) <= 1
