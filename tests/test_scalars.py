"""Scalar functions on tables of edge strings (null words, JS spaces, odd numbers, dates, JSON)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quaymaster import constants as K, functions as fn
from quaymaster.model import TargetColumn

UUID1 = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


def apply(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


CASES = [
    (fn.js_trim, ["\t a b\n", " x﻿", "", None], ["a b", "x", "", None]),
    (fn.is_nullish, [None, " N/A ", " ", "nan", "-", "0", "nah", "null\n"],
     [True, True, True, True, True, False, False, True]),
    (lambda c: fn.is_nullish(c, K.TRANSFORM_NULLS), ["nan", "NIL"], [False, True]),
    (fn.to_text, ["", " ", None], [None, " ", None]),
    (fn.to_integer, ["12abc", "1,379", " -7 ", "+3", "abc", "", "99999999999999999999", "4.9"],
     [12, 1, -7, 3, None, None, None, 4]),
    (fn.to_number, ["12.5kg", ".5", "5.", "1e3x", "-", "Infinity", "0x10", "1e5"],
     [12.5, 0.5, 5.0, 1000.0, None, None, 0.0, 100000.0]),
    (fn.to_boolean, [" Yes", "0", "t", "active", "N"], [True, False, None, None, False]),
    (fn.extract_number, ["INR 1,299.00", "$45.99", "usd 7", "₹", "12d", "₹ 1 2", "INR5", "1e2", "0x1"],
     [1299.0, 45.99, 7.0, None, None, 12.0, None, 100.0, None]),
    (fn.clean_integer, ["₹599", "1,299.00", "N/A", "x", "-"], [599, 1299, None, None, None]),
    (fn.clean_number, ["EUR 99.5 net", "2,499", "nan", ""], [99.5, 2499.0, None, None]),
    (fn.clean_boolean, ["Active", "no", "maybe", "none", "-"], [True, False, False, None, False]),
    (fn.to_date, ["2024-1-5", "02/03/2024", "13-02-2024", "2024/12/31", "13/13/2024", "2024-02-30", "5",
                  "2024-01-05T23:30:00-02:00"],
     [dt.date(2024, 1, 5), dt.date(2024, 2, 3), dt.date(2024, 2, 13), dt.date(2024, 12, 31), None, None, None,
      dt.date(2024, 1, 6)]),
    (lambda c: F.unix_millis(fn.to_timestamp(c)), ["1970-01-01T00:00:01.5Z", "01/01/1970 00:01:00", "x"],
     [1500, 60000, None]),
    (lambda c: F.unix_seconds(fn.epoch_to_timestamp(c)), ["1700000000", "1700000000123", "170", "17000000001x"],
     [1700000000, 1700000000, None, None]),
    (fn.is_json, ['{"a":1}', "1] [2", '{"k":1}}', '{"a":1} x', "5", '"s"', "null", "", " [1,\n2] ", "{'a':1}", "nope"],
     [True, False, False, False, True, True, True, False, True, False, False]),
    (fn.is_json_container, ["[1]", "5", " {} ", "[1"], [True, False, True, False]),
    (fn.clean_array, ['["a","b"]', "a, b ,c", "5", '"q"', "", "[1"], [["a", "b"], ["a", "b", "c"], ["5"], ["q"], None, ["[1"]]),
    (fn.to_uuid, [f" {UUID1} ", UUID1.replace("11d1", "91d1"), "x"], [UUID1, None, None]),
    (fn.clean_uuid, [UUID1.replace("11d1", "91d1")], [UUID1.replace("11d1", "91d1")]),
    (lambda c: fn.castable(c, "to_integer"), ["12", "12.0", "1.5", "$3", "", "x", "₹"],
     [True, True, False, True, True, False, False]),
    (lambda c: fn.castable(c, "to_array"), ["a,b", "[1]", "ab"], [True, True, False]),
    (lambda c: fn.castable(c, "none"), ["x"], [True]),
    (fn.strip_leading_zeros, ["007", "000", "0x1", "70"], ["7", "0", "0x1", "70"]),
    (fn.resplit_list, ["a, b;c | d", "one"], ["a | b | c | d", "one"]),
    (fn.check_url, ["HTTPS://x", "ftp://x", None], [True, False, True]),
    (fn.check_hex_color, ["#aBc123", "#d3e16f,#191919", "#12345", "red"], [True, True, False, False]),
    (fn.clean_phone, ["+1 (555) 12.3-4"], ["+15551234"]),
    (fn.strip_unit_suffix, ["12.5 kg", "7cm", "kg"], ["12.5", "7", "kg"]),
    (lambda c: fn.normalize_enum(c, K.GENDER_WORDS), [" M ", "girl", "ALL", "other"], ["Men", "Women", "Unisex", "other"]),
    (lambda c: fn.round_half_up(c.cast("double"), 2), ["-2.505", "2.125", "1"], [-2.5, 2.13, 1.0]),
]


@pytest.mark.parametrize("f,given,expected", CASES)
def test_edge_strings(spark, f, given, expected):
    assert apply(spark, f, given) == expected


def test_anchor_refuses_final_newline(spark):
    df = spark.createDataFrame([("12\n",)], "v string")
    assert df.select(F.col("v").rlike(dict(K.TYPE_TESTS)["integer"])).first()[0] is False


@pytest.mark.parametrize("dtype,udt,expected", [
    ("bigint", "", "integer"), ("USER-DEFINED", "int4", "integer"), ("numeric", "", "number"), ("money", "money", "number"),
    ("timestamp with time zone", "", "timestamp"), ("x", "timestamptz", "timestamp"), ("date", "", "date"),
    ("jsonb", "", "json"), ("uuid", "", "uuid"), ("text", "", "string"), ("boolean", "", "boolean")])
def test_database_type_picks_coercion(dtype, udt, expected):
    assert TargetColumn("c", dtype, udt_name=udt).coercion == expected


def test_written_dates(spark):
    cases = {
        "March 7, 2024": "2024-03-07 00:00:00", "Mar 7 2024": "2024-03-07 00:00:00", "7 Mar 2024": "2024-03-07 00:00:00",
        "7th September, 2024": "2024-09-07 00:00:00", "07-Mar-2024": "2024-03-07 00:00:00",
        "Thu, 07 Mar 2024 10:20:30 GMT": "2024-03-07 10:20:30", "Thu, 07 Mar 2024 10:20:30 +0200": "2024-03-07 08:20:30",
        "December 31, 2023 11:59 PM": "2023-12-31 23:59:00", "2024-03-07 12:05 am": "2024-03-07 00:05:00",
        "3/7/2024 12:05:09 PM": "2024-03-07 12:05:09", "1/2/24": "2024-01-02 00:00:00", "1/2/51": "1951-01-02 00:00:00",
        "2024-03": "2024-03-01 00:00:00", "February 30, 2024": None, "Smarch 7, 2024": None, "2024-03-07 13:05 pm": None, "2024-13": None,
        "maybe": None, "march": None, "2024-03-07T10:00:00Z": "2024-03-07 10:00:00",
    }
    df = spark.createDataFrame(list(cases), "string").toDF("v")
    got = {r["v"]: r["t"] for r in df.select("v", F.date_format(fn.to_timestamp(F.col("v")), "yyyy-MM-dd HH:mm:ss").alias("t")).collect()}
    assert got == cases
