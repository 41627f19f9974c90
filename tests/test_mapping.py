import pytest
from pyspark.sql import functions as F

from quaymaster.model import (
    FixRule, Mapping, MappingHints, MappingRule, TargetColumn, TargetSchema, Transform, range_rule,
)
from quaymaster.operators.mapping import apply_mapping, apply_transforms, dropped_columns, split_empty_rows
from quaymaster.operators.validate import failure_summary, split_valid, validate_output

PEOPLE = TargetSchema("people", (
    TargetColumn("id", "integer", nullable=False, udt_name="int4"),
    TargetColumn("name", "character varying", nullable=False, max_length=5),
    TargetColumn("age", "integer")), primary_key=("id",))


def frame(spark, rows, cols):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                                 "row_idx long, " + ", ".join(f"{c} string" for c in cols))


def test_subset_rename_and_coerce(spark):
    df = frame(spark, [("1", "Ann", "x"), ("2", "Bo", "y")], ["external_id", "full_name", "throwaway"])
    m = Mapping((MappingRule("external_id", "id"), MappingRule("full_name", "name"))).resolve(
        df.columns[1:], PEOPLE)
    rows = apply_mapping(df, m, PEOPLE).orderBy("row_idx").collect()
    assert [(r["id"], r["name"], r["errors"]) for r in rows] == [(1, "Ann", None), (2, "Bo", None)]
    assert dropped_columns(df, m, PEOPLE) == ["throwaway"]


def test_failed_coercion_keeps_the_raw_input(spark):
    df = frame(spark, [("x1", "Ann")], ["a", "b"])
    row = apply_mapping(df, Mapping((MappingRule("a", "id"), MappingRule("b", "name"))), PEOPLE).first()
    assert row["id"] is None
    assert row["errors"][0].asDict() == {
        "column": "id", "code": "bad_cast", "input": "x1",
        "message": "Row 1, column id: Cannot cast x1 to integer"}


def test_resolve_warns_and_keeps_first():
    m = Mapping((MappingRule("a", "id"), MappingRule("a", "name"), MappingRule("b", "id"),
                 MappingRule("zz", "id"), MappingRule("b", "nope")))
    out = m.resolve(["a", "b", "c"], PEOPLE)
    assert [(r.source, r.target) for r in out.rules] == [("a", "id")]
    assert len(out.warnings) == 4
    assert [c for c, _ in out.dropped] == ["b", "c"]


def test_rename_hint_applies_before_dedupe():
    m = Mapping((MappingRule("a", "id"), MappingRule("b", "name")))
    out = m.resolve(["a", "b", "c"], PEOPLE, MappingHints(rename={"b": "id", "c": "name"}, force={"c": "string"}))
    assert [(r.source, r.target, r.coerce_to) for r in out.rules] == [("a", "id", None), ("c", "name", "string")]
    only = m.resolve(["a", "b"], PEOPLE, MappingHints(include=("b",), exclude=("a",)))
    assert [r.source for r in only.rules] == ["b"]


def test_bad_proposals_are_refused():
    with pytest.raises(TypeError):
        MappingRule("a", 7)
    with pytest.raises(ValueError):
        MappingRule("a", "b", coerce_to="blob")
    with pytest.raises(ValueError):
        FixRule("rewrite_table")
    with pytest.raises(ValueError):
        PEOPLE.check_keys([])
    with pytest.raises(ValueError):
        PEOPLE.check_keys(["nope"])


def test_empty_rows_follow_key_presence(spark):
    df = spark.createDataFrame([(0, ["id"]), (1, ["other"]), (2, [])], "row_idx long, _keys array<string>")
    full, empty = split_empty_rows(df, Mapping((MappingRule("id", "id"),)))
    assert [r[0] for r in full.collect()] == [0]
    assert sorted(r[0] for r in empty.collect()) == [1, 2]


def test_last_transform_wins_and_sql_sees_value(spark):
    df = frame(spark, [(" ab ", "nil"), ("c", "3")], ["a", "b"])
    out = apply_transforms(df, [Transform.named("a", "x", "none"), Transform.sql("a", "x", "upper(value)"),
                                Transform.strict("b", "y", "integer")]).orderBy("row_idx").collect()
    assert [(r["x"], r["y"]) for r in out] == [("AB", None), ("C", 3)]
    assert all(r["errors"] is None for r in out)


def test_variant_source(spark):
    df = spark.sql("SELECT 0L row_idx, parse_json('{\"a\":1}') v UNION ALL SELECT 1, parse_json('\"7\"')")
    rows = apply_mapping(df, Mapping((MappingRule("v", "id"),)), PEOPLE).orderBy("row_idx").collect()
    assert rows[0]["id"] is None and rows[0]["errors"][0]["input"] == '{"a":1}'
    assert rows[1]["id"] == 7


def test_validation_counts_examples_and_split(spark):
    df = frame(spark, [(str(i), "n" * (i % 8), "x" if i % 4 == 0 else "1") for i in range(40)], ["a", "b", "c"])
    specs = [Transform.named("a", "id", "to_integer"), Transform.named("b", "name", "none"),
             Transform.strict("c", "age", "integer")]
    v = validate_output(df, specs, PEOPLE)
    got = {r["column"]: r for r in v.failures.collect()}
    # Blank names break NOT NULL; six and seven characters are too long for five.
    assert got["name"]["failures"] == 15 and got["age"]["failures"] == 10 and "id" not in got
    assert [e["row_idx"] for e in got["age"]["examples"]] == [0, 4, 8, 12, 16]
    assert got["age"]["examples"][0]["input"] == "x"
    s = v.summary.first()
    assert (s["total_rows"], s["success"]) == (40, False)
    good, bad = split_valid(v.rows)
    assert good.count() == s["passed_rows"] and good.count() + bad.count() == 40
    assert failure_summary(v.failures, 0.3).count() == 1


def test_wrong_output_type_fails_every_live_value(spark):
    df = frame(spark, [("5",), ("",)], ["a"])
    v = validate_output(df, [Transform.named("a", "age", "none")], PEOPLE)
    assert [(r["column"], r["failures"]) for r in v.failures.collect()] == [("age", 1)]


def test_no_rows_is_success(spark):
    s = validate_output(frame(spark, [("1",)], ["a"]).filter("false"),
                        [Transform.named("a", "id", "to_integer")], PEOPLE).summary.first()
    assert s["pass_rate"] is None and s["success"] is True


def test_extra_checks(spark):
    target = TargetSchema("t", (TargetColumn("price", "numeric"),), checks=(range_rule("price", 0, 50000, True),))
    df = frame(spark, [("0",), ("50000",), ("60000",)], ["p"])
    v = validate_output(df, [Transform.named("p", "price", "to_number")], target, with_checks=True)
    assert v.rows.filter("errors is not null").select(F.element_at("errors", 1)["code"]).distinct().first()[0] == "out_of_range"
    assert v.summary.first()["passed_rows"] == 1


def test_nested_and_typed_sources(spark):
    df = spark.sql("SELECT 0L row_idx, named_struct('x', 1) s, 7.9D d, true b, timestamp'2024-01-05 10:00:00' t")
    target = TargetSchema("t", (TargetColumn("a", "integer"), TargetColumn("b", "integer"), TargetColumn("c", "integer"),
                                TargetColumn("d", "date"), TargetColumn("j", "jsonb")))
    m = Mapping((MappingRule("s", "a"), MappingRule("d", "b"), MappingRule("b", "c"), MappingRule("t", "d")))
    row = apply_mapping(df, m, target).first()
    assert (row["a"], row["b"], row["c"], str(row["d"])) == (None, 7, 1, "2024-01-05")
    assert [(e["column"], e["input"]) for e in row["errors"]] == [("a", '{"x":1}')]
    assert apply_mapping(df, Mapping((MappingRule("s", "j"),)), target).first()["j"] == '{"x":1}'
