import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quaymaster.operators import profile as prof
from quaymaster.operators.ranks import select_ranks
from quaymaster.operators.topk import first_k_matching
from quaymaster.operators.sampling import sample_indexes, stratified_sample


def test_simple_profile(spark):
    df = spark.createDataFrame([(0, 1, "a@x.com", "LA"), (1, 2, "b@x.com", None), (2, 3, "a@x.com", "")],
                               "row_idx long, id int, email string, city string")
    got = {r["column"]: r for r in prof.profile_simple(df).collect()}
    assert math.isclose(got["city"]["null_pct"], 2 / 3) and got["city"]["unique_count"] == 3
    assert got["email"]["unique_count"] == 2 and got["email"]["inferred_type"] == "string"
    assert got["id"]["inferred_type"] == "number" and got["city"]["sample"] == ["LA"]


def test_simple_profile_of_mixed_json(spark):
    df = spark.sql("""SELECT * FROM VALUES (0L, parse_json('1')), (1L, parse_json('true')), (2L, parse_json('null')),
                      (3L, parse_json('[1]')) AS t(row_idx, v)""")
    r = prof.profile_simple(df).first()
    assert (r["inferred_type"], r["unique_count"], r["null_pct"]) == ("number", 4, 0.25)


def test_ranks_match_brute_force_through_narrowing(spark):
    rng = random.Random(5)
    data = {"a": [rng.lognormvariate(0, 4) for _ in range(3000)], "b": [1.0] * 2000 + list(map(float, range(500))),
            "c": [7.0]}
    rows = [(g, v, n) for g, vs in data.items() for v, n in Counter(vs).items()]
    values = spark.createDataFrame(rows, "g string, value double, cnt long")
    want = [(g, f"r{r}", r) for g, vs in data.items() for r in {0, len(vs) // 2, int(len(vs) * .95), len(vs) - 1}
            if r < len(vs)]
    wanted = spark.createDataFrame(want, "g string, tag string, rank long")
    got = {(r["g"], r["tag"]): r["value"] for r in select_ranks(values, wanted, "g", small=20, cuts=8).collect()}
    assert got == {(g, t): sorted(data[g])[r] for g, t, r in want}


def test_first_k_matching_crosses_blocks(spark):
    df = spark.range(100_000).selectExpr("id AS row_idx", "cast(id AS string) AS v")
    got = first_k_matching(df, {"late": (F.col("v"), F.col("row_idx") % 30_000 == 29_999),
                                "none": (F.col("v"), F.lit(False)), "all": (F.col("v"), F.lit(True))}, 3)
    lists = defaultdict(list)
    for r in got.orderBy("tag", "rn").collect():
        lists[r["tag"]].append(r["row_idx"])
    assert lists == {"late": [29_999, 59_999, 89_999], "all": [0, 1, 2]}


def messy(spark, n=3000):
    # One value holds a third of all rows; outliers repeat.
    return spark.range(n).selectExpr(
        "id AS row_idx",
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN ' v'||(id % 20) ELSE NULL END AS word",
        "CASE WHEN id % 100 = 99 THEN '9000' WHEN id % 7 = 0 THEN '$'||(id % 50) ELSE (id % 50)||'.5' END AS num",
        "repeat('text ', 60)||(id % 10) AS long")


def plain(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_profile_values(spark):
    got = {r["column"]: r for r in plain(prof.profile(messy(spark)))}
    assert list(got) == ["word", "num", "long"]
    assert got["word"]["null_rate"] == 1 / 3 and got["word"]["unique_count"] == 21
    assert got["word"]["top_values"][0] == {"value": "hot", "count": 1000, "pct": 50.0}
    assert got["word"]["samples"] == ["hot", " v1", "hot", " v4", "hot"]
    assert got["num"]["outliers"] == ["9000"] * 5 and got["num"]["inferred_type"] == "number"
    assert got["long"]["top_values"][0]["value"].startswith("text text") and len(got["long"]["top_values"]) == 10
    assert got["long"]["patterns"] == ["long-text"] and got["word"]["numeric_stats"] is None


def test_profile_is_the_same_however_it_is_partitioned(spark):
    df = messy(spark)
    base = plain(prof.profile(df))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        assert plain(prof.profile(df.repartition(13, "num"))) == base
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_all_null_column(spark):
    df = spark.createDataFrame([(0, "n/a"), (1, None)], "row_idx long, v string")
    r = prof.profile(df, ["v"]).first()
    assert (r["inferred_type"], r["null_rate"], r["patterns"], r["samples"]) == ("unknown", 1.0, ["all_null"], [])


def test_stratified_sample_is_deterministic(spark):
    for n in (10, 50, 51, 60, 1000, 10_000, 12_345):
        idx = sample_indexes(n)
        assert len(idx) == min(n, 50) == len(set(idx)) and idx == sorted(idx) and max(idx) < n
        if n > 50:
            assert idx[:10] == list(range(10)) and idx[-10:] == list(range(n - 10, n))
    assert stratified_sample(spark.range(1000).withColumnRenamed("id", "row_idx")).count() == 50
    assert stratified_sample(spark.range(0).withColumnRenamed("id", "row_idx")).count() == 0


def test_columns_vote_on_the_order_of_day_and_month(spark):
    from quaymaster.model import Mapping, MappingRule
    from quaymaster.operators.dates import infer_formats, with_inferred_formats

    columns = {"us": ["03/04/2024", "12/31/2024", "N/A"], "eu": ["3.4.24", "31.12.24", ""], "open": ["03-04-2024", "01-02-2024", None],
               "both": ["31/12/2024", "12/31/2024", "1/31/2024"], "named": ["Mar 5, 2024", "5 march 2024", "x"], "none": [None, "", "soon"]}
    df = spark.createDataFrame(list(zip(range(3), *columns.values())), "row_idx long, " + ", ".join(f"{c} string" for c in columns))
    found = {r["column"]: r for r in infer_formats(df, list(columns)).collect()}
    assert {c: tuple(r["formats"]) for c, r in found.items()} == {
        "us": ("iso", "month_first"), "eu": ("iso", "day_first"), "open": ("iso", "month_first"), "both": ("iso", "month_first", "day_first"),
        "named": ("iso", "named"), "none": ("iso",)}
    assert {c for c, r in found.items() if r["ambiguous"]} == {"open"} and {c for c, r in found.items() if r["mixed"]} == {"both"}
    assert (found["us"]["live"], found["us"]["either"], found["none"]["other"]) == (2, 1, 1)
    assert infer_formats(df, ["open"], unsure="day_first").first()["formats"] == ["iso", "day_first"]
    assert infer_formats(df.limit(0), ["us"]).first()["live"] == 0
    mapping, warnings = with_inferred_formats(df, Mapping((MappingRule("eu", "d"), MappingRule("x", "y"))), ["eu", "open", "both"])
    assert mapping.rules[0].formats == ("iso", "day_first") and mapping.rules[1].formats == () and len(warnings) == 2 == len(mapping.warnings)


def test_states_of_parts_merge_to_the_state_of_the_whole(spark, tmp_path):
    from quaymaster.operators.sketches import column_states, merge_states, profile_of_states

    rows = [(i, str(i % 700), f" v{i % 9}" if i % 4 else "n/a", None) for i in range(6000)]
    df = spark.createDataFrame(rows, "row_idx long, n string, t string, e string")
    parts = column_states(df.filter("row_idx < 100")).union(column_states(df.filter("row_idx >= 100 AND row_idx < 4000"))).union(
        column_states(df.filter("row_idx >= 4000"))).union(column_states(df.limit(0)))
    parts.write.parquet(str(tmp_path / "states"))
    stored = spark.read.parquet(str(tmp_path / "states"))
    twice = merge_states(merge_states(stored.limit(0).union(stored)))
    merged, whole = ({r["column"]: r for r in profile_of_states(s).collect()} for s in (twice, column_states(df)))
    exact = ("inferred_type", "null_rate", "total_count", "min_length", "max_length", "patterns")
    for c in ("n", "t", "e"):
        assert [merged[c][x] for x in exact] == [whole[c][x] for x in exact]
    assert (merged["n"]["inferred_type"], merged["n"]["total_count"], merged["t"]["null_rate"], merged["e"]["patterns"]) == ("integer", 6000, 0.25, ["all_null"])
    stats = merged["n"]["numeric_stats"]
    assert (stats["min"], stats["max"]) == (0, 699) and abs(stats["median"] - 350) < 25 and abs(stats["p95"] - 664) < 25
    assert abs(merged["n"]["approx_unique_count"] - 700) <= 0.06 * 700 and merged["t"]["approx_unique_count"] == 9 and merged["e"]["approx_unique_count"] == 0
    assert sum(v["count"] for v in merged["t"]["approx_top_values"]) == 4500 and merged["e"]["approx_top_values"] == []


def test_rows_that_share_the_order_are_numbered_in_a_fixed_order(spark):
    from quaymaster.sources.row_index import with_row_index

    df = spark.range(500).selectExpr("id % 3 AS k", "cast(id AS string) AS v", "array(id) AS a")
    numbers = [{r["v"]: r["row_idx"] for r in with_row_index(x, ["k"]).collect()} for x in (df.repartition(5), df.repartition(2, "v"))]
    assert numbers[0] == numbers[1] and sorted(numbers[0].values()) == list(range(500))


def test_candidate_keys_are_those_of_brute_force(spark):
    import random
    from itertools import combinations

    from quaymaster.operators.keys import candidate_keys

    rng = random.Random(12)
    for n, spread in ((30, 4), (60, 6), (300, 12)):
        rows = [(rng.randrange(spread), rng.randrange(spread), rng.randrange(spread * 2), "a" * 70 + str(rng.randrange(n)), rng.choice([None, 1]), i) for i in range(n)]
        df = spark.createDataFrame(rows, "a int, b int, c int, t string, gap int, id int")
        for names in (["a", "b", "c", "t", "gap"], ["id", "a", "t"]):
            at = [df.columns.index(c) for c in names]
            want = []
            for size in (1, 2, 3):
                for s in combinations(range(len(names)), size):
                    values = [tuple(r[at[i]] for i in s) for r in rows]
                    if not any(set(k) <= set(s) for k in want) and len(set(values)) == n and not any(None in v for v in values):
                        want.append(s)
            assert candidate_keys(df.select(names)).keys == tuple(tuple(names[i] for i in s) for s in want)
    assert candidate_keys(df.limit(0)).keys == ()
    assert candidate_keys(spark.createDataFrame([("a", "bc"), ("ab", "c")], "x string, y string")).keys == (("x",), ("y",))


def test_candidate_keys_of_more_rows_than_the_first_look(spark, monkeypatch):
    """Sets that repeat are refuted by rows with one hash; only what may be a key is counted over all rows."""
    from itertools import combinations

    from quaymaster.operators import keys

    rows = [(i % 500, i % 7, i // 1000, float(i % 4), None if i == 1999 else i, f"{i % 2}" * 70) for i in range(2000)]
    rows.append((499, 3, 9, 1.5, 5, "x"))
    df = spark.createDataFrame(rows, "a long, b int, c long, d double, gap int, t string")
    want = []
    for size in (1, 2, 3):
        for s in combinations(range(6), size):
            if not any(set(k) <= set(s) for k in want) and 4 not in s and len({tuple(r[i] for i in s) for r in rows}) == len(rows):
                want.append(s)
    monkeypatch.setattr(keys, "PROBED", 50)
    monkeypatch.setattr(keys, "SIEVED", 1000)
    counted, whole = [], keys._unique
    monkeypatch.setattr(keys, "_unique", lambda values, s: counted.append(s) or whole(values, s))
    found = keys.candidate_keys(df)
    assert want and found.keys == tuple(tuple(df.columns[i] for i in s) for s in want)
    assert len(counted) < sum(level[3] for level in found.levels[1:])
    # A single repetition that no other look meets is found among all rows.
    monkeypatch.setattr(keys, "SIEVED", 1)
    pairs = [(i, i % 2, 0) for i in range(1000)] + [(999, 1, 1)]
    assert keys.candidate_keys(spark.createDataFrame(pairs, "a long, b int, c int")).keys == (("a", "c"),)


def test_numbers_are_counted_in_numeric_columns_only(spark):
    from quaymaster.operators import profile as p

    rows = [("USD 1,200.5", "12", "a1", "1e3", None, "1" * 250, "usd 7"), (" € 3 ", "x", "7", ".5", "", "2", "USD7"),
            ("$", "5.", "b", "-4", "null", "3", "+-1"), ("n/a", "1..2", "9", "+6.", "nan", "4", "e5"), ("¥-9", "1e", "1", "0x1", "-", "5", "8")]
    names = [f"c{i}" for i in range(7)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_idx long, " + ", ".join(f"{n} string" for n in names))
    stats = {tuple(r) for r in p.numeric_stats(p.frequency_table(df, names)).collect()}
    numeric = p.numeric_columns(df, names)
    assert set(numeric) == {r[0] for r in stats} and 2 <= len(numeric) < len(names)
    table = p.number_table(df, numeric)
    assert {r["column"] for r in table.collect()} == set(numeric) and not {"flags", "len"} & set(table.columns)
    assert {tuple(r) for r in p.numeric_stats(table).collect()} == stats
    assert p.numeric_columns(df.limit(0), names) == [] and p.numeric_stats(p.number_table(df, [])).count() == 0
