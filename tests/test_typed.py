"""Exact decimals, arrays and vectors in load, split and repair; dates by chosen formats."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F, types as T

from quaymaster import functions as fn
from quaymaster.model import FixRule, Mapping, MappingRule, TargetColumn, TargetSchema, Transform
from quaymaster.operators.mapping import apply_mapping, apply_transforms, fit_target
from quaymaster.operators.typed import array_value, checking_type, list_items, stored, typed_value, vector_value
from quaymaster.plans.ingest import bucketed_rows, load_reviewed, run_ingestion

AMOUNT = TargetColumn("v", "numeric", precision=20, scale=2)


def one_column(spark, values, name="v"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"row_idx long, {name} string")


def read(spark, values, column, **options):
    df = one_column(spark, values)
    return [r[0] for r in df.orderBy("row_idx").select(typed_value(F.col("v"), column, T.StringType(), **options)).collect()]


def test_decimals_keep_every_digit(spark):
    texts = ["123456789012345678.91", "0.1", "-0.005", "1e3", "abc", "", None, "12.5 kg", "9" * 18 + ".99", "9" * 18 + ".995"]
    got = read(spark, texts, AMOUNT)
    assert got == [Decimal("123456789012345678.91"), Decimal("0.10"), Decimal("-0.01"), Decimal("1000.00"), None, None, None, Decimal("12.50"),
                   Decimal("9" * 18 + ".99"), Decimal("1" + "0" * 18)]
    assert read(spark, ["12.5 kg", " 7 "], AMOUNT, whole=True) == [None, Decimal("7.00")]
    assert checking_type(AMOUNT) == T.DecimalType(38, 2) and AMOUNT.type_name == "numeric(20,2)"


def test_list_literals(spark):
    texts = ['{a,"b c",NULL}', "{}", "{ }", '["x","y,z"]', "p, q", "", None, '{"open', "{a,,b}", '{"q\\"t",null}', "{a b , c}", '{"NULL"}', "[1", "{a}{b}"]
    df = one_column(spark, texts)
    got = [r[0] for r in df.orderBy("row_idx").select(list_items(F.col("v"))).collect()]
    assert got == [["a", "b c", None], [], [], ["x", "y,z"], ["p", "q"], None, None, None, None, ['q"t', None], ["a b", "c"], ["NULL"], ["[1"], None]
    long = "{" + ",".join(f'"i{i}"' for i in range(30_000)) + "}"
    assert one_column(spark, [long]).select(F.size(list_items(F.col("v")))).first()[0] == 30_000


def test_arrays_of_a_type_and_vectors(spark):
    ints = TargetColumn("v", "ARRAY", udt_name="_int4")
    assert ints.spark_type == T.ArrayType(T.IntegerType()) and ints.type_name == "integer[]"
    assert read(spark, ["{1,2}", "[3]", "4,x", "{1,NULL}", "{99999999999}"], ints) == [[1, 2], [3], None, [1, None], None]
    vector = TargetColumn("v", "vector(3)", udt_name="vector")
    assert vector.dimensions == 3 and vector.spark_type == T.ArrayType(T.FloatType())
    assert read(spark, ["[1, 2.5,-3]", "[1,2]", "1,2,3", "[1,NaN,2]", "[1,,2]", "[]", "[1e400,1,2]"], vector) == [[1.0, 2.5, -3.0], [1.0, 2.0], None, None, None, None, None]


# --- what used to stop or to falsify a load ------------------------------------------------------

def load(spark, values, column, rule=None, rules=(), more=()):
    target = TargetSchema("t", (TargetColumn("id", "bigint", nullable=False), column), primary_key=("id",))
    df = spark.createDataFrame([(i, str(i), v) for i, v in enumerate(values)], "row_idx long, id string, v string")
    mapping = Mapping((MappingRule("id", "id"), rule or MappingRule("v", "v")))
    empty = spark.createDataFrame([], T.StructType([T.StructField("id", T.LongType()), T.StructField("v", column.spark_type)]))
    done = run_ingestion(df, mapping, target, empty, ["id"], rules)
    merged = {r["id"]: r["v"] for r in done.merged.collect()}
    rows = {r["row_idx"]: (r["bucket"], r["errors"] and r["errors"][0]["code"]) for r in done.rows.collect()}
    return merged, rows


def test_array_targets_load(spark):
    merged, rows = load(spark, ["{a,b}", '["c"]', '{"open'], TargetColumn("v", "ARRAY", udt_name="_text"))
    assert merged == {0: ["a", "b"], 1: ["c"]} and rows[2] == ("unresolved", "bad_cast")


def test_text_coerced_into_a_date_column_cannot_stop_the_load(spark):
    merged, rows = load(spark, ["2024-01-05", "soon", "03/04/2024", ""], TargetColumn("v", "date"), MappingRule("v", "v", coerce_to="string"))
    assert merged == {0: dt.date(2024, 1, 5), 2: dt.date(2024, 3, 4), 3: None} and rows[1] == ("unresolved", "bad_cast")


def test_exact_numerics_load_and_are_repaired_exactly(spark):
    column = TargetColumn("v", "numeric", precision=20, scale=2)
    merged, rows = load(spark, ["123456789012345678.91", "999999999999999999.999", "x 5"], column)
    assert merged == {0: Decimal("123456789012345678.91")}
    assert rows[1] == ("unresolved", "out_of_range") and rows[2] == ("unresolved", "bad_cast")
    target = TargetSchema("t", (TargetColumn("v", "numeric", precision=20, scale=2), TargetColumn("w", "integer")))
    df = spark.createDataFrame([(0, "123456789012345678.91", "n"), (1, "123456789012345678.91x", "n")], "row_idx long, v string, w string")
    mapping = Mapping((MappingRule("v", "v"), MappingRule("w", "w")))
    got, _ = bucketed_rows(df, mapping, target, [FixRule("nullify", "bad_cast", "w"), FixRule("cast", "bad_cast", "v")])
    assert {r["row_idx"]: (r["v"], r["bucket"]) for r in got.collect()} == {i: (Decimal("123456789012345678.91"), "repaired") for i in (0, 1)}


def test_reviewed_loads_read_exactly_and_never_fail_on_a_cast(spark):
    target = TargetSchema("t", (TargetColumn("id", "bigint", nullable=False), TargetColumn("v", "numeric", precision=20, scale=2),
                                TargetColumn("d", "date"), TargetColumn("tags", "ARRAY", udt_name="_text")), primary_key=("id",))
    df = spark.createDataFrame([(0, "0", "$123,456,789,012,345,678.91", "2024-01-01", "[\"a\"]"), (1, "1", "5", "soon", "b")],
                               "row_idx long, id string, v string, d string, tags string")
    specs = (Transform.named("id", "id", "to_integer"), Transform.named("v", "v", "to_number"), Transform.sql("d", "d", "upper(value)"),
             Transform.named("tags", "tags", "none"))
    merged, outcome = load_reviewed(df, specs, target, spark.createDataFrame([], target.struct_type()), ["id"], batch=1)
    assert [(r["id"], r["v"], r["d"], r["tags"]) for r in merged.collect()] == [(0, Decimal("123456789012345678.91"), dt.date(2024, 1, 1), ["a"])]
    assert {r["batch"]: r["failed"] for r in outcome.collect()} == {1: False, 2: True}


def test_fit_target_leaves_fitting_columns_alone(spark):
    target = TargetSchema("t", (TargetColumn("n", "integer"), TargetColumn("s", "text"), TargetColumn("d", "date")))
    df = spark.createDataFrame([(0, 1.5, 7, dt.date(2024, 1, 1))], "row_idx long, n double, s int, d date")
    assert fit_target(df, target) is df
    nested = spark.createDataFrame([(0, ["x"])], "row_idx long, n array<string>")
    assert fit_target(nested, target).first()["errors"][0]["code"] == "bad_cast"


def test_vectors_and_stored_values(spark):
    df = one_column(spark, ["[1,2]", "no"])
    assert [r[0] for r in df.orderBy("row_idx").select(vector_value(F.col("v"))).collect()] == [[1.0, 2.0], None]
    ints = TargetColumn("v", "integer[]")
    assert df.select(array_value(F.lit("{1}"), ints)).first()[0] == [1]
    assert df.select(stored(F.lit(Decimal("1e20")), AMOUNT)).first()[0] is None


# --- date formats --------------------------------------------------------------------------------

@pytest.mark.parametrize("formats, want", [
    (("day_first",), [dt.date(2024, 4, 3), dt.date(2024, 4, 13), None, None]),
    (("month_first",), [dt.date(2024, 3, 4), None, dt.date(2024, 4, 13), None]),
    (("month_first", "day_first"), [dt.date(2024, 3, 4), dt.date(2024, 4, 13), dt.date(2024, 4, 13), None]),
    (("dd/MM/yyyy",), [dt.date(2024, 4, 3), dt.date(2024, 4, 13), None, None]),
    (("MMM d, yyyy", "dd/MM/yyyy"), [dt.date(2024, 4, 3), dt.date(2024, 4, 13), None, dt.date(2024, 3, 5)]),
    (("named",), [None, None, None, dt.date(2024, 3, 5)]),
    (None, [dt.date(2024, 3, 4), None, None, dt.date(2024, 3, 5)]),
])
def test_formats_choose_what_is_read(spark, formats, want):
    df = one_column(spark, ["03/04/2024", "13/04/2024", "04.13.2024", "Mar 5, 2024"])
    assert [r[0] for r in df.orderBy("row_idx").select(fn.to_date(F.col("v"), formats=formats)).collect()] == want
    mapped = apply_mapping(df, Mapping((MappingRule("v", "d", formats=tuple(formats or ())),)), TargetSchema("t", (TargetColumn("d", "date"),)))
    assert [r["d"] for r in mapped.orderBy("row_idx").collect()] == want


def test_patterns_are_guarded_by_their_shape(spark):
    df = one_column(spark, ["2024-01-02T03:04", "2024-1-2T3:4", "x", "10:30 PM on 5 March 2024"])
    got = df.orderBy("row_idx").select(fn.to_timestamp(F.col("v"), formats=("yyyy-MM-dd'T'HH:mm", "h:mm a 'on' d MMMM yyyy"))).collect()
    assert [r[0] for r in got] == [dt.datetime(2024, 1, 2, 3, 4), None, None, dt.datetime(2024, 3, 5, 22, 30)]
    with pytest.raises(ValueError):
        fn.to_date(F.col("v"), formats=())
    with pytest.raises(ValueError):
        fn.to_date(F.col("v"), formats=("QQ yyyy",))


def test_every_spec_of_a_target_is_validated_and_the_last_is_loaded(spark):
    from quaymaster.operators.validate import validate_output

    target = TargetSchema("t", (TargetColumn("n", "integer", nullable=False),))
    df = spark.createDataFrame([(0, "1", "x"), (1, "2", "3")], "row_idx long, a string, b string")
    specs = [Transform.strict("b", "n", "integer"), Transform.strict("a", "n", "integer")]
    checked = validate_output(df, specs, target)
    assert [r["n"] for r in checked.rows.orderBy("row_idx").collect()] == [1, 2]
    assert [(r["column"], r["failures"]) for r in checked.failures.collect()] == [("n", 1)]
    assert checked.summary.first()["passed_rows"] == 1
    assert [r["n"] for r in apply_transforms(df, specs).orderBy("row_idx").collect()] == [1, 2]


# --- transforms that would throw -------------------------------------------------------------------

@pytest.mark.parametrize("text, want", [
    ("int(value)", [12, None, None, None]),
    ("value::int", [12, None, None, None]),
    ("to_date(value)", [None, dt.date(2024, 1, 5), None, None]),
    ("to_date(value, 'yyyy-MM-dd')", [None, dt.date(2024, 1, 5), None, None]),
    ("10 / try_cast(value AS int)", [10 / 12, None, None, None]),
    ("10 % int(value)", [10, None, None, None]),
    ("7 div int(value)", [0, None, None, None]),
    ("2147483640 + int(value)", [None, None, None, None]),
    ("value > 3", [True, None, None, False]),
    ("-int(value)", [-12, None, None, 0]),
    ("split(value, '-')[2]", [None, "05", None, None]),
    ("element_at(split(value, '-'), 2)", [None, "01", None, None]),
    ("transform(split(value, '-'), x -> int(x))[0]", [12, 2024, None, 0]),
    ("CASE WHEN value LIKE '2024%' THEN 'y' || upper(value) WHEN value IN ('0') THEN NULL ELSE trim(BOTH '1' FROM value) END", ["2", "y2024-01-05", "x", None]),
    ("NOT value IS NULL AND value BETWEEN '0' AND '1'", [False, False, False, True]),
    ("make_date(2024, 13, int(value))", [None, None, None, None]),
    ("cast(cast(value AS bigint) * 1000000000 AS int)", [None, None, None, 0]),
])
def test_transforms_give_null_where_they_would_throw(spark, text, want):
    df = one_column(spark, ["12", "2024-01-05", "x", "0"])
    if text in ("10 % int(value)", "10 / try_cast(value AS int)", "7 div int(value)"):
        want = want[:3] + [None]
    elif text in ("int(value)", "value::int"):
        want = want[:3] + [0]
    elif text == "2147483640 + int(value)":
        want = want[:3] + [2147483640]
    out = apply_transforms(df, [Transform.sql("v", "o", text)]).orderBy("row_idx").collect()
    assert [r["o"] for r in out] == want and all(r["errors"] is None for r in out)
    failing = apply_transforms(df, [Transform.sql("v", "o", text, null_fails=True)]).orderBy("row_idx").collect()
    assert [r["errors"] is not None for r in failing] == [w is None for w in want]


def test_column_functions_give_null_where_they_would_throw(spark):
    df = one_column(spark, ["12", "x"])
    out = apply_transforms(df, [Transform.of("v", "o", lambda v: F.lit(10) / v.cast("int"), null_fails=True)]).orderBy("row_idx").collect()
    assert [(r["o"], r["errors"] is None) for r in out] == [(10 / 12, True), (None, False)]
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


@pytest.mark.parametrize("text", ["raise_error(value)", "assert_true(value = 'x')", "(SELECT 1)", "sum(value) OVER ()", "other + 1", "reflect('java.lang.System', 'exit')"])
def test_what_cannot_be_made_tolerant_is_refused_early(spark, text):
    with pytest.raises(ValueError):
        apply_transforms(one_column(spark, ["1"]), [Transform.sql("v", "o", text)])


def test_repaired_rows_are_held_against_the_others_once_more(spark):
    target = TargetSchema("t", (TargetColumn("id", "bigint", nullable=False), TargetColumn("name", "character varying", max_length=3)),
                          primary_key=("id",), unique=(("name",),))
    rows = [(0, "0", "abcd"), (1, "1", "abc"), (2, "2", "xyz1"), (3, "3", "xyz2"), (4, "4", "old9"), (5, "2", "xyz3"), (6, "6", "solo")]
    df = spark.createDataFrame(rows, "row_idx long, id string, name string")
    existing = spark.createDataFrame([(9, "old"), (6, "sol")], "id long, name string")
    done = run_ingestion(df, Mapping((MappingRule("id", "id"), MappingRule("name", "name"))), target, existing, ["id"], [FixRule("truncate", "too_long", "name")])
    got = {r["row_idx"]: (r["bucket"], r["errors"] and r["errors"][-1]["code"]) for r in done.rows.collect()}
    # The good row keeps its value against an earlier repaired one; one key may hold a value in several rows.
    assert got == {0: ("unresolved", "duplicate_key"), 1: ("loaded", None), 2: ("repaired", None), 3: ("unresolved", "duplicate_key"),
                   4: ("unresolved", "duplicate_key"), 5: ("repaired", None), 6: ("repaired", None)}
    assert sorted((r["id"], r["name"]) for r in done.merged.collect()) == [(1, "abc"), (2, "xyz"), (6, "sol"), (9, "old")]
