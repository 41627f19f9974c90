import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from quaymaster.sources import readers as rd
from quaymaster.sources.records import json_objects, quote_scanner
from quaymaster.sources.row_index import with_row_index
from quaymaster.sources.sinks import write_rejects, write_upsert


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_bom_blank_lines_trim(spark, tmp_path):
    p = write(tmp_path / "a.csv", '﻿id,name\n1,  Ann \n\n2,"B, o"\n3,\n')
    rows = rd.read_csv(spark, p).orderBy("row_idx").collect()
    assert [tuple(r) for r in rows] == [(0, "1", "Ann"), (1, "2", "B, o"), (2, "3", "")]


def test_ragged_rows(spark, tmp_path):
    p = write(tmp_path / "a.csv", "a,b\n1,2\n3\n4,5,6\n")
    with pytest.raises(Exception, match="wrong number of fields"):
        # Even a query over one column notices.
        rd.read_csv(spark, p).select("row_idx", "a").collect()
    for index in (True, False):
        with pytest.raises(Exception, match="wrong number of fields"):
            rd.read_csv(spark, p, row_index=index).select("a").collect()
        with pytest.raises(Exception, match="wrong number of fields"):
            rd.read_csv(spark, p, row_index=index).count()
    rows = rd.read_csv(spark, p, strict=False).orderBy("row_idx").collect()
    assert [(r["a"], r["b"], r["_corrupt"] is not None) for r in rows] == [
        ("1", "2", False), ("3", "", True), ("4", "5", True)]


def test_files_with_other_headers_are_refused(spark, tmp_path):
    (tmp_path / "d.csv").mkdir()
    write(tmp_path / "d.csv" / "1.csv", "a,b\n1,2\n")
    write(tmp_path / "d.csv" / "2.csv", "b,a\n3,4\n")
    with pytest.raises(ValueError, match="different header"):
        rd.read_csv(spark, str(tmp_path / "d.csv"))


def test_lenient_refuses_empty(spark, tmp_path):
    with pytest.raises(ValueError):
        rd.read_csv(spark, write(tmp_path / "a.csv", "a,b\n"), strict=False)


def test_row_index_over_many_files_and_splits(spark, tmp_path):
    n, folder = 0, tmp_path / "many.csv"
    folder.mkdir()
    for f, size in enumerate([4000, 10, 2500, 1200]):
        write(folder / f"part{f}.csv", "n,x\n" + "".join(f"{n + i},{'y' * (i % 9)}\n" for i in range(size)))
        n += size
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        df = rd.read_csv(spark, str(folder))
        assert df.rdd.getNumPartitions() > 4
        assert df.filter(F.col("row_idx") != F.col("n").cast("long")).count() == 0
        assert df.count() == n and df.filter("n % 2 = 0").filter(F.col("row_idx") != F.col("n").cast("long")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_row_index_of_parquet_and_of_a_sort(spark, tmp_path):
    df = spark.range(5000).selectExpr("id AS v", "(id * 7919) % 5000 AS k")
    df.repartition(7).sortWithinPartitions("v").write.parquet(str(tmp_path / "p.parquet"))
    read = rd.read_source(spark, str(tmp_path / "p.parquet"))
    assert sorted(r[0] for r in read.select("row_idx").collect()) == list(range(5000))
    by_k = with_row_index(df, order_by=["k"])
    assert by_k.filter("row_idx <> k").count() == 0


def test_json_arrays_lines_and_keys(spark, tmp_path):
    objs = [{"a": 1, "b": "x"}, {"a": None}, {"c": [1, 2]}]
    arr = write(tmp_path / "a.json", json.dumps(objs, indent=1))
    df = rd.read_json(spark, arr).orderBy("row_idx")
    assert [r["a"] for r in df.collect()] == [1, None, None]
    keyed = rd.read_json(spark, arr, keys=True).orderBy("row_idx").collect()
    assert [r["_keys"] for r in keyed] == [["a", "b"], ["a"], ["c"]]
    lines = write(tmp_path / "a.jsonl", "\n".join(map(json.dumps, objs)))
    lk = rd.read_source(spark, lines, keys=True).orderBy("row_idx").collect()
    assert [(r["row_idx"], r["_keys"]) for r in lk] == [(0, ["a", "b"]), (1, ["a"]), (2, ["c"])]


@pytest.mark.parametrize("text", ['{"a":1}', "[1, 2]"])
def test_json_must_be_an_array_of_objects(spark, tmp_path, text):
    with pytest.raises(Exception):
        rd.read_json(spark, write(tmp_path / "a.json", text)).collect()


def test_unknown_extension(spark):
    with pytest.raises(ValueError):
        rd.read_source(spark, "x.xlsx")


def test_union_and_preview(spark):
    a, b = spark.sql("SELECT 0L row_idx, 1 a"), spark.sql("SELECT 1L row_idx, 'z' b")
    u = rd.union_rows([a, b])
    assert [tuple(r) for r in rd.preview(u, 2).collect()] == [(0, 1, None), (1, None, "z")]


def test_sinks(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.sql("SELECT 1 id, 'keep' _action")
    write_upsert(df, out)
    assert spark.read.parquet(out).columns == ["id"]
    with pytest.raises(Exception):
        write_upsert(df, out)
    bad = spark.sql("""SELECT 0L row_idx, array(named_struct('column','a','code','bad_cast','message','m','input','x')) errors
                       UNION ALL SELECT 1, null""")
    write_rejects(bad, str(tmp_path / "rej"))
    back = spark.read.parquet(str(tmp_path / "rej"))
    assert [(r["row_idx"], r["code"], r["message"]) for r in back.collect()] == [(0, "bad_cast", "m")]


def test_changed_splits_are_an_error_not_a_wrong_index(spark, tmp_path):
    p = write(tmp_path / "a.csv", "n\n" + "".join(f"{i}\n" for i in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        df = rd.read_csv(spark, p)
        assert df.agg(F.max("row_idx")).first()[0] == 19_999  # offsets are counted here
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
        with pytest.raises(Exception, match="file splits changed"):
            df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


# --- records that span lines, in many splits ------------------------------------------------------

@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_quoted_line_breaks_belong_to_their_field(spark, tmp_path):
    p = write(tmp_path / "a.csv", 'id,t\n1,"x\ny"\n2,plain\n')
    for strict in (True, False):
        rows = rd.read_csv(spark, p, strict=strict).orderBy("row_idx").collect()
        assert [(r["row_idx"], r["id"], r["t"]) for r in rows] == [(0, "1", "x\ny"), (1, "2", "plain")]


def test_quoted_records_over_many_splits_and_files(spark, tmp_path, small_splits):
    rng, folder, want = random.Random(5), tmp_path / "m.csv", []
    folder.mkdir()
    cells = ['"a,b"', '"x\ny"', '"say ""hi"""', '""', '"l1\n\nl3,"",z"', ' 5" pipe', "7", '"{}"'.format("long\n" * 900)]
    for f in range(3):
        lines = []
        for i in range(300):
            picked = rng.choices(cells, weights=[9, 5, 5, 5, 5, 5, 50, 1], k=2)
            lines.append(f"{len(want)},{picked[0]},{picked[1]}\n" + rng.choice(["", "", "", "\n", "  \n"]))
            want.append([str(len(want)), *next(csv.reader([",".join(picked)], skipinitialspace=True))] if "\n" not in picked[0] + picked[1]
                        else [str(len(want)), *next(csv.reader(io.StringIO(",".join(picked), newline=""), skipinitialspace=True))])
        write(folder / f"p{f}.csv", "id,a,b\n" + "".join(lines))
    df = rd.read_csv(spark, str(folder))
    assert df.rdd.getNumPartitions() > 6
    got = [tuple(r) for r in df.orderBy("row_idx").collect()]
    assert got == [(i, *r) for i, r in enumerate(want)]
    assert rd.read_csv(spark, str(folder), row_index=False).columns == ["id", "a", "b"]


def test_ragged_records_and_open_quotes(spark, tmp_path):
    p = write(tmp_path / "r.csv", 'a,b\n1,"x\ny"\n2\n3,4,5\n')
    with pytest.raises(Exception, match="wrong number of fields"):
        rd.read_csv(spark, p).count()
    with pytest.raises(Exception, match="wrong number of fields"):
        rd.read_csv(spark, p).select("a").collect()
    rows = rd.read_csv(spark, p, strict=False).orderBy("row_idx").collect()
    assert [(r["a"], r["b"], r["_corrupt"] is not None) for r in rows] == [("1", "x\ny", False), ("2", "", True), ("3", "4", True)]
    with pytest.raises(ValueError, match="never closed"):
        rd.read_csv(spark, write(tmp_path / "o.csv", 'a,b\n1,"x\n2,3\n'))
    folder = tmp_path / "h.csv"
    folder.mkdir()
    write(folder / "1.csv", 'a,b\n1,"x\ny"\n')
    write(folder / "2.csv", "b,a\n3,4\n")
    with pytest.raises(ValueError, match="different header"):
        rd.read_csv(spark, str(folder))


def test_quote_scanner():
    scan = quote_scanner()
    for text, opened in {"": False, "a,b": False, 'a,"b': True, '"a","b"': False, 'x" y': False, 'x",y': False, 'x","y': True, '"a""b"': False,
                         ' "a': True, 'a, "b"': False, '5" pipe,"open': True, '""': False}.items():
        assert scan(text)[0] == opened, text
    # From within quotes: the first single quote closes the field.
    assert [scan(t)[1] for t in ('still in', 'end"', 'end",a', 'end","next', 'end",a,"b"', 'in ""still', 'end" junk')] == [True, False, False, True, False, True, False]
    for text in ('"' * 100_000, 'a,"' * 50_000, '"a",' * 50_000, ",".join(['"x""y"'] * 30_000)):
        scan(text)


@pytest.mark.parametrize("how", [{}, {"indent": 1}, {"separators": (",", ":")}])
def test_json_arrays_over_many_splits(spark, tmp_path, small_splits, how):
    rng = random.Random(3)

    def value(n):
        kind = rng.random()
        if kind < 0.4 or n > 2:
            return rng.choice(["x", "}", '{"a":1}', '\\"}', "[", "]", 'é "q"', "\\", "", 7])
        return [value(n + 1) for _ in range(rng.randint(0, 3))] if kind < 0.7 else {rng.choice("abc"): value(n + 1) for _ in range(rng.randint(0, 3))}

    objects = [{"i": i, "v": value(0)} for i in range(600)]
    p = write(tmp_path / "a.json", json.dumps(objects, **how))
    cut = json_objects(spark, p)
    assert cut.rdd.getNumPartitions() > 4
    got = sorted((r["row"], r["record"]) for r in cut.collect())
    assert [r for r, _ in got] == list(range(600)) and [json.loads(t) for _, t in got] == objects
    rows = rd.read_json(spark, p, schema="i long", keys=True).orderBy("row_idx").collect()
    assert [(r["i"], r["_keys"]) for r in rows] == [(i, ["i", "v"]) for i in range(600)]


@pytest.mark.parametrize("text", ['{"a":1}', '[1, 2]', '[{"a":1}, 2]', '[{"a":1}', '[{"a":1}] x', '[[{"a":1}]]'])
def test_other_json_than_arrays_of_objects_is_refused(spark, tmp_path, text):
    with pytest.raises(Exception):
        json_objects(spark, write(tmp_path / "a.json", text)).collect()


def test_json_types_are_widened_over_all_objects(spark, tmp_path):
    p = write(tmp_path / "a.json", '[{"a": 1, "b": "x", "c": {"d": [1.5]}, "e": null}, {"a": 2.5, "b": 3, "f g": true}, {}]')
    df = rd.read_json(spark, p)
    assert dict(df.dtypes) == {"row_idx": "bigint", "a": "double", "b": "string", "c": "struct<d:array<double>>", "e": "string", "f g": "boolean"}
    assert [(r["a"], r["b"]) for r in df.orderBy("row_idx").collect()] == [(1.0, "x"), (2.5, "3"), (None, None)]
