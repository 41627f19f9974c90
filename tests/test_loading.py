import pytest
from pyspark.sql import functions as F

from quaymaster import constants as K, functions as fn
from quaymaster.model import (
    FixRule, Mapping, MappingRule, TargetColumn, TargetSchema, Transform, hex_color_rule, range_rule, url_rule,
)
from quaymaster.operators.constraints import canonicalize, check_constraints, dry_run, duplicate_keys
from quaymaster.operators.evaluate import best_mapping, evaluate_mapping
from quaymaster.operators.mapping import apply_transforms
from quaymaster.operators.merge import batch_outcome, split_null_keys, upsert_by_key
from quaymaster.operators.repair import fix_log, repair
from quaymaster.operators.report import preflight, preflight_status, verdict
from quaymaster.plans.ingest import review, run_ingestion

CONTACTS = TargetSchema("contacts", (
    TargetColumn("id", "integer", nullable=False, udt_name="int4"),
    TargetColumn("name", "character varying", nullable=False, max_length=5),
    TargetColumn("age", "integer"), TargetColumn("created", "timestamptz", nullable=False, default="now()")),
    primary_key=("id",))


def contacts(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_idx long, id string, name string, age string, extra string")


def empty_target(spark):
    return spark.createDataFrame([], CONTACTS.struct_type())


MAPPING = Mapping((MappingRule("id", "id"), MappingRule("name", "name"), MappingRule("age", "age")))


def test_clean_file_loads_whole(spark):
    done = run_ingestion(contacts(spark, [("1", "Ann", "30", "x"), ("2", "Bo", "31", "y")]), MAPPING, CONTACTS,
                         empty_target(spark), ["id"])
    rows = done.merged.orderBy("id").collect()
    assert [(r["id"], r["name"], r["age"], r["_action"]) for r in rows] == [(1, "Ann", 30, "insert"), (2, "Bo", 31, "insert")]
    assert all(r["created"] is not None for r in rows)
    rep = done.report.first()
    assert (rep["rows_upserted"], rep["rows_skipped"], rep["dropped_columns"]) == (2, 0, ["extra"])


def test_bad_integer_is_repaired_by_nullify(spark):
    done = run_ingestion(contacts(spark, [("1", "Ann", "30", ""), ("2", "Bo", "N/A", "")]), MAPPING, CONTACTS,
                         empty_target(spark), ["id"], [FixRule("nullify", "bad_cast", "age", diagnosis="no age")])
    assert [(r["id"], r["age"]) for r in done.merged.orderBy("id").collect()] == [(1, 30), (2, None)]
    rep = done.report.first()
    assert (rep["rows_upserted"], rep["rows_skipped"], rep["applied_fixes"], rep["manual_actions"]) == (2, 0, 1, 1)


def rejects(spark, rows):
    df = contacts(spark, rows)
    from quaymaster.operators.mapping import apply_mapping
    return check_constraints(apply_mapping(df, MAPPING, CONTACTS), CONTACTS).filter("errors is not null")


def test_fixes(spark):
    bad = rejects(spark, [("1", "VeryLongName", "1", ""), ("2", "Bo", "x", ""), ("3", "", "5", ""), ("4", "Cy", "7y", "")])
    assert bad.count() == 3  # '7y' has a whole-number prefix
    rules = [FixRule("truncate", K.TOO_LONG, "name"), FixRule("skip", K.NOT_NULL, "name", diagnosis="nameless"),
             FixRule("alter_column", K.BAD_CAST, "age", sql="ALTER ...")]
    out = repair(bad, rules, CONTACTS)
    got = {r["row_idx"]: r for r in out.collect()}
    assert got[0]["name"] == "VeryL" and got[0]["bucket"] == "repaired" and got[0]["errors"] is None
    assert got[1]["bucket"] == "manual" and got[1]["manual_action"] == "ALTER ..." and got[1]["fixes"] == []
    assert got[2]["bucket"] == "skipped"
    assert [tuple(r) for r in fix_log(out).orderBy("row_idx").collect()] == [
        (0, 1, "truncate", "", ["name"]), (2, 1, "skip", "nameless", [])]


def test_attempts_run_out_with_the_last_state(spark):
    bad = rejects(spark, [("1", "Bo", "x", ""), ("z", "TooLongName", "x", "")])
    rules = [FixRule("cast", K.BAD_CAST, "age", attempt=1), FixRule("nullify", K.BAD_CAST, "age"),
             FixRule("truncate", K.TOO_LONG, "name", length=3)]
    got = {r["row_idx"]: r for r in repair(bad, rules, CONTACTS).collect()}
    assert got[0]["bucket"] == "repaired" and [f["attempt"] for f in got[0]["fixes"]] == [2]
    # The first error of the second row is its id, which no rule knows.
    assert got[1]["bucket"] == "unresolved" and got[1]["fixes"] == [] and got[1]["errors"][0]["column"] == "id"
    one = repair(bad, [FixRule("cast", K.BAD_CAST, "age")], CONTACTS, max_retries=2).filter("row_idx = 0").first()
    assert one["bucket"] == "unresolved" and one["errors"][0]["message"].startswith("the fix did not work")


def test_payload_names_and_manual_fixes(spark):
    r = FixRule.from_payload("truncate", {"field": " name ", "maxLength": "3"}, code=K.TOO_LONG)
    assert (r.columns, r.length) == (("name",), 3)
    assert FixRule.from_payload("rename", {"old": "nick", "new": "name"}).rename_to == "name"
    bad = rejects(spark, [("1", "VeryLongName", "x", "")])
    for rule in (FixRule("cast", columns=("nope",)), FixRule("truncate", columns=("age",)),
                 FixRule("rename", columns=("age",), rename_to="nope")):
        assert repair(bad, [rule], CONTACTS).first()["bucket"] == "manual"
    moved = repair(bad, [FixRule("rename", columns=("age",), rename_to="name")], CONTACTS).first()
    assert (moved["name"], moved["age"], moved["bucket"]) == ("x", None, "repaired")


def test_set_level_error_stays_until_its_value_changes(spark):
    rows = spark.sql("""SELECT 0L row_idx, 1 id, 'a' name, 9 age,
        array(named_struct('column','age','code','duplicate_key','message','m','input','9')) errors""")
    kept = repair(rows, [FixRule("nullify", columns=("name",))], CONTACTS).first()
    assert {e["code"] for e in kept["errors"]} == {"not_null", "duplicate_key"}
    cured = repair(rows, [FixRule("nullify", columns=("age",))], CONTACTS).first()
    assert cured["bucket"] == "repaired"


def base(spark):
    return spark.range(1000).selectExpr("id AS k", "'old' AS a", "id * 2 AS b")


def delta(spark):
    # Every third row carries the same key; later rows win.
    return spark.range(3000).selectExpr("id AS row_idx", "CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS k", "'n'||id AS a")


def as_set(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_upsert_last_row_wins_and_is_idempotent(spark):
    once = upsert_by_key(base(spark), delta(spark), ["k"], {"b": -1})
    got = {r["k"]: r for r in once.collect()}
    assert got[7]["a"] == "n2997" and got[7]["b"] == 14 and got[6]["a"] == "old"
    assert got[2999]["a"] == "n2999" and got[2999]["b"] == -1 and got[2999]["_action"] == "insert"
    assert once.count() == len(got) == 1000 + len([i for i in range(1000, 3000) if i % 3])
    twice = upsert_by_key(once.drop("_action"), delta(spark), ["k"], {"b": -1})
    assert as_set(twice, "k", "a", "b") == as_set(once, "k", "a", "b")


def test_upsert_plans_agree_and_small_delta_spares_the_target(spark):
    small = upsert_by_key(base(spark), delta(spark), ["k"])
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = upsert_by_key(base(spark), delta(spark), ["k"])
        assert as_set(large, "k", "a", "_action") == as_set(small, "k", "a", "_action")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_key_only_payload_inserts_if_absent(spark):
    src = spark.sql("SELECT 0L row_idx, 5L k UNION ALL SELECT 1, 5000 UNION ALL SELECT 2, NULL")
    good, nulls = split_null_keys(src, ["k"])
    out = upsert_by_key(base(spark), good, ["k"])
    assert nulls.count() == 1 and out.count() == 1001
    assert out.filter("k = 5").first()["a"] == "old"
    with pytest.raises(ValueError):
        upsert_by_key(base(spark), src.withColumn("zz", F.lit(1)), ["k"])


def test_batches_fail_whole(spark):
    df = spark.range(1200).selectExpr("id AS row_idx", """CASE WHEN id IN (700, 650) THEN
        array(named_struct('column','a','code','bad_cast','message','row '||id,'input','x')) END AS errors""")
    got = [tuple(r) for r in batch_outcome(df).orderBy("batch").collect()]
    assert got == [(1, 500, 0, False, 500, None), (2, 500, 2, True, 0, "Batch 2: row 650"), (3, 200, 0, False, 200, None)]


def test_dry_run_reports_missing_required_column(spark):
    df = spark.range(200).selectExpr("id AS row_idx", "cast(id AS int) AS id")
    run = dry_run(df, CONTACTS, sample=50)
    assert tuple(run.summary.first()) == (50, 0, False)
    assert run.rows.first()["errors"][0]["column"] == "name"


def test_duplicates_and_canonical_values(spark):
    df = spark.sql("SELECT * FROM VALUES (0L,'topwear'),(1L,' TOPWEAR '),(2L,'Shirts'),(3L,'??'),(4L,NULL) AS t(row_idx, c)")
    words = spark.sql("SELECT 'Topwear' v")
    got = canonicalize(df, "c", words, "v", {"shirts": "Topwear"}).orderBy("row_idx").collect()
    assert [(r["c_canonical"], r["c_known"]) for r in got] == [
        ("Topwear", True), ("Topwear", True), ("Topwear", True), ("??", False), (None, True)]
    d = duplicate_keys(spark.sql("SELECT * FROM VALUES (1,'a'),(1,'a'),(1,NULL),(1,NULL) AS t(x,y)"), ["x", "y"])
    assert [tuple(r) for r in d.collect()] == [(1, "a", 2)]


SHOP = TargetSchema("products", (
    TargetColumn("title", "character varying", nullable=False, max_length=20),
    TargetColumn("price", "numeric", nullable=False, precision=10, scale=2),
    TargetColumn("gender", "text"), TargetColumn("color_hex", "text"), TargetColumn("image_url", "text"),
    TargetColumn("all_image_urls", "text"), TargetColumn("tags", "ARRAY", udt_name="_text")),
    checks=(range_rule("price", 0, 50000, lo_open=True), url_rule("image_url"), hex_color_rule("color_hex")))


def shop(spark):
    rows = [("Navy tee", "₹599", "Male", "#1B2A4A", "https://i.example/a.jpg", "a; b", "S, M"),
            ("Pink top", "1,299.00", "Female", "#FFB6C1", "https://i.example/b.jpg", "c", '["XS","S"]'),
            ("Hoodie", "$45.99", "Unisex", "#000000", "https://i.example/c.jpg", "d,e", "L"),
            ("Joggers", "899", "M", "#808080", "https://i.example/d.jpg", "f", "L"),
            ("Sneakers", "2,499", "F", "#FFFFFF", "i.example/e.jpg", "g", "6"),
            ("Gold watch", "INR 90000", "F", "gold", "https://i.example/f.jpg", "h", "")]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                                 "row_idx long, name string, mrp string, sex string, hex string, img string, imgs string, sizes string")


SHOP_SPECS = [
    Transform.of("name", "title", lambda v: fn.truncate_to(v, 255)), Transform.named("mrp", "price", "to_number"),
    Transform.of("sex", "gender", lambda v: fn.normalize_enum(v, K.GENDER_WORDS)),
    Transform.named("hex", "color_hex", "none"), Transform.named("img", "image_url", "none"),
    Transform.of("imgs", "all_image_urls", fn.resplit_list), Transform.named("sizes", "tags", "to_array")]


def test_products_end_to_end(spark):
    rows = check_constraints(apply_transforms(shop(spark), SHOP_SPECS), SHOP).orderBy("row_idx").collect()
    assert [r["price"] for r in rows] == [599.0, 1299.0, 45.99, 899.0, 2499.0, 90000.0]
    assert [r["gender"] for r in rows] == ["Men", "Women", "Unisex", "Men", "Women", "Women"]
    assert rows[0]["all_image_urls"] == "a | b" and rows[1]["tags"] == ["XS", "S"] and rows[0]["tags"] == ["S", "M"]
    codes = [sorted(e["column"] for e in r["errors"] or []) for r in rows]
    assert codes == [[], [], [], [], ["image_url"], ["color_hex", "price"]]


def test_verdicts(spark):
    good = Mapping((MappingRule("name", "title", confidence=0.95), MappingRule("mrp", "price", confidence=0.9,
                                                                              transformation="to_number")))
    df = shop(spark)
    r = review(df, good, [s for s in SHOP_SPECS if s.target in ("title", "price")], SHOP)
    v = preflight_status(r.verdict).first()
    # The watch breaks the price rule in the dry run only.
    assert (v["status"], v["preflight"], v["validation"], v["dry_run"]) == ("review", "needs_review", "ok", "failed")
    assert v["problems"] == ["1 of 6 tested rows would be refused"]
    scored = evaluate_mapping(df, good, SHOP)
    assert verdict(scored.scores, scored.issues).first()["status"] == "safe"
    assert verdict(scored.scores, scored.issues).first()["dry_run"] == "not_run"
    lacking = evaluate_mapping(df, Mapping((MappingRule("name", "title", confidence=0.6),)), SHOP)
    blocked = verdict(lacking.scores, lacking.issues).first()
    assert blocked["status"] == "blocked" and blocked["problems"] == ["price: Required column price has no mapping"]
    assert [i["severity"] for i in lacking.issues.collect()] == ["critical", "warning"]


def test_empty_mapping_scores_and_best_choice(spark):
    df = shop(spark)
    none = evaluate_mapping(df, Mapping(()), SHOP).scores.first()
    assert (none["type_score"], none["required_score"], none["confidence_score"], none["passed"]) == (1.0, 0.0, 0.0, False)
    ok = Mapping((MappingRule("name", "title", confidence=0.9), MappingRule("mrp", "price", confidence=0.9)))
    better = Mapping((MappingRule("name", "title", confidence=1.0), MappingRule("mrp", "price", confidence=1.0)))
    # The first mapping that passes ends the search, a better one after it is never tried.
    assert best_mapping(df, [Mapping(()), ok, better], SHOP).first()["candidate"] == 1


def test_preflight_buckets(spark):
    m = Mapping((MappingRule("name", "title", confidence=0.9), MappingRule("sex", "gender", confidence=0.6),
                 MappingRule("hex", "color_hex", confidence=0.3)), (("imgs", "unused"),))
    got = sorted((r["bucket"], r["source"] or r["target"]) for r in
                 preflight(spark, m, SHOP, ["name", "sex", "hex", "imgs"]).collect())
    assert got == [("alert", "imgs"), ("missing_required", "price"), ("success", "name"), ("warning", "sex")]


def test_foreign_key_gaps_with_a_hot_key(spark):
    from quaymaster.operators.constraints import foreign_key_gaps
    child = spark.range(9000).selectExpr("CASE WHEN id % 3 = 0 THEN -1 WHEN id = 1 THEN NULL ELSE id % 50 END AS fk")
    parent = spark.range(0, 49).selectExpr("id AS pk")
    gaps = foreign_key_gaps(child, parent, {"fk": "pk"})
    expected = [(-1, 3000), (49, len([i for i in range(9000) if i % 3 and i != 1 and i % 50 == 49]))]
    assert sorted(tuple(r) for r in gaps.collect()) == expected
    # Rows are counted per key before they are shuffled or joined.
    plan = gaps._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftOuter") < plan.index("Aggregate")


def test_loads_reject_rows_without_a_key(spark):
    from quaymaster.model import Mapping, MappingRule, TargetColumn, TargetSchema, Transform
    from quaymaster.plans.ingest import load_reviewed, run_ingestion
    target = TargetSchema("t", (TargetColumn("id", "bigint"), TargetColumn("name", "text")), primary_key=("id",), unique=(("name",),))
    df = spark.createDataFrame([(0, "1", "a"), (1, "", "b"), (2, "2", "c"), (3, "1", "d"), (4, "5", "c"), (5, "6", "held")],
                               "row_idx long, i string, n string")
    table = spark.createDataFrame([(9, "held"), (2, "old")], "id long, name string")
    done = run_ingestion(df, Mapping((MappingRule("i", "id"), MappingRule("n", "name"))), target, table, ["id"])
    # No key; a name met before under another id; a name the table holds under another id.
    assert {r["row_idx"]: r["bucket"] for r in done.rows.collect()} == {
        0: "loaded", 1: "unresolved", 2: "loaded", 3: "loaded", 4: "unresolved", 5: "unresolved"}
    report = done.report.first()
    assert (report["rows_upserted"], report["rows_skipped"]) == (3, 3)
    assert {tuple(r) for r in done.merged.collect()} == {(9, "held", "keep"), (2, "c", "update"), (1, "d", "insert")}
    assert [tuple(r) for r in done.duplicates.collect()] == [(1, 2, 0, 3)]
    specs = [Transform.named("i", "id", "to_integer"), Transform.named("n", "name", "none")]
    merged, outcome = load_reviewed(df, specs, target, table, ["id"], batch=2)
    assert {r["batch"]: r["failed"] for r in outcome.collect()} == {1: True, 2: False, 3: True}
    assert {tuple(r) for r in merged.collect()} == {(9, "held", "keep"), (2, "c", "update"), (1, "d", "insert")}


def test_upsert_raises_on_null_keys(spark):
    from quaymaster.operators.merge import upsert_by_key
    target = spark.createDataFrame([(1, "a")], "id long, name string")
    source = spark.createDataFrame([(0, None, "b")], "row_idx long, id long, name string")
    with pytest.raises(Exception, match="no complete key"):
        upsert_by_key(target, source, ["id"]).collect()


def test_held_frames_are_released(spark):
    from quaymaster.session import held_frames, hold

    with held_frames():
        a = hold(spark.range(5))
        with held_frames():
            b = hold(spark.range(7))
            assert a.is_cached and b.is_cached and a.count() == 5
        assert a.is_cached and not b.is_cached
    assert not a.is_cached
    with held_frames():
        done = run_ingestion(spark.createDataFrame([(0, "1", "n")], "row_idx long, id string, name string"), Mapping((MappingRule("id", "id"),)),
                             TargetSchema("t", (TargetColumn("id", "bigint", nullable=False),), primary_key=("id",)), spark.range(0).select("id"), ["id"])
        assert done.merged.count() == 1


def test_verdict_reads_no_examples(spark, monkeypatch):
    from quaymaster.operators import evaluate, validate

    poor = Mapping((MappingRule("name", "title", confidence=0.95), MappingRule("name", "price", confidence=0.4, transformation="to_number")))
    df, specs = shop(spark), [s for s in SHOP_SPECS if s.target in ("title", "price")]
    scored = evaluate_mapping(df, poor, SHOP)
    assert any(r["examples"] for r in scored.issues.collect())
    texts = scored.issue_texts
    assert texts.collect() == scored.issues.drop("examples").collect()
    want = verdict(scored.scores, scored.issues).collect()
    checked = validate.validate_output(df, specs, SHOP)
    assert sorted(map(tuple, checked.rates.collect())) == sorted(map(tuple, checked.failures.drop("examples").collect()))

    def no_rows(*_, **__):
        raise AssertionError("the source is read for examples")
    monkeypatch.setattr(evaluate, "cast_examples", no_rows)
    again = evaluate_mapping(df, poor, SHOP)
    assert verdict(again.scores, again.issue_texts).collect() == want
