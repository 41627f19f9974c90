"""One layer from text to the value that a target column stores.

Loading, splitting and repair read every text through ``typed_value``, so a text means
the same wherever it is met:

* ``numeric(p, s)`` is read digit by digit into a decimal, never by way of a double. Digits beyond
  the scale are rounded half away from zero, as the database does on storing; values with too many whole
  digits stay readable here and fail the range check.
* arrays come as a JSON list, a brace literal (``{a,"b c",NULL}``) or items between commas, and
  each item is read as the element type; one unreadable item makes the whole value unreadable.
* vectors are bracketed lists of finite numbers; the number of dimensions is a check of its own.

Built-in expressions only. An unreadable text is NULL, and no cast can stop a job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F, types as T

from quaymaster import constants as K, functions as fn
from quaymaster.model import TargetColumn, coerce_text

# Possessive repeats: matched without recursion however many items a list has.
_QUOTED = r'"(?:[^"\\]|\\.)*+"'
_BARE = r'[^\s,{}"\\](?:[^,{}"\\]*[^\s,{}"\\])?'
_ITEM = rf"(?:{_QUOTED}|{_BARE})"
_BRACES = rf"(?s)^\{{\s*(?:{_ITEM}(?:\s*,\s*{_ITEM})*+)?\s*\}}\z"
_WIDEST = 38


def checking_type(column: TargetColumn) -> T.DataType:
    """The type in which a value is checked; wide enough to hold what the range check refuses."""
    if column.is_vector or column.is_array:
        return column.spark_type
    if column.coercion == "number" and column.precision is not None:
        return T.DecimalType(_WIDEST, column.scale or 0)
    return {"integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType(),
            "date": T.DateType(), "timestamp": T.TimestampType()}.get(column.coercion, T.StringType())


def list_items(text: Column) -> Column:
    """The items of a JSON list, a brace literal or a comma list as texts; NULL for a blank text."""
    t = fn.js_trim(text)
    inner = F.regexp_extract_all(F.substring(t, F.lit(2), F.length(t) - 2), F.lit(f"(?s){_ITEM}"), F.lit(0))
    literal = F.transform(inner, lambda x: F.when(x.startswith('"'), F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), r"(?s)\\(.)", "$1"))
                          .when(F.upper(x) != "NULL", x))
    return F.when(t.rlike(_BRACES), literal).when(~t.startswith("{"), fn.clean_array(t))


def array_value(text: Column, column: TargetColumn) -> Column:
    """An array of the column's element type; NULL when it is no list or an item does not read."""
    element, items = column.element, list_items(text)
    if checking_type(element) == T.StringType() and element.coercion == "string":
        return items
    read = lambda x: stored(typed_value(x, element, whole=True), element)
    bad = F.exists(items, lambda x: x.isNotNull() & read(x).isNull())
    return F.when(~bad, F.transform(items, read))


def vector_value(text: Column) -> Column:
    """A bracketed list of finite numbers as floats."""
    t = fn.js_trim(text)
    parts = F.split(F.substring(t, F.lit(2), F.length(t) - 2), ",")
    numbers = F.transform(parts, lambda x: fn.matching(fn.js_trim(x), K.NUMBER_WHOLE, "float"))
    bad = F.exists(numbers, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(t.startswith("[") & t.endswith("]"), F.when(~bad, numbers))


def decimal_value(text: Column, column: TargetColumn, whole: bool) -> Column:
    grammar = K.NUMBER_WHOLE if whole else K.NUMBER_PREFIX
    return fn.matching(fn.js_trim(text), grammar, checking_type(column).simpleString())


def typed_value(c: Column, column: TargetColumn, dtype: T.DataType | None = None, whole: bool = False,
                formats: Sequence[str] = ()) -> Column:
    """``c`` as the target column holds it (in its checking type); NULL where it does not read.

    ``whole`` asks that all of the text is used, as a database does; else a number may be followed by
    other text, as coercion allows. ``formats`` are the date shapes to read.
    """
    text = dtype is None or isinstance(dtype, T.StringType)
    if column.is_vector:
        return vector_value(c if text else F.to_json(c))
    if column.is_array:
        return array_value(c if text else F.to_json(c), column)
    kind = column.coercion
    if kind == "number" and column.precision is not None:
        # The text of a double is its shortest decimal form, so nothing is added to it.
        return decimal_value(c if text else c.cast("string"), column, whole)
    if whole and text and kind in ("integer", "number"):
        grammar, sql_type = {"integer": (K.INTEGER_WHOLE, "bigint"), "number": (K.NUMBER_WHOLE, "double")}[kind]
        return fn.matching(fn.js_trim(c), grammar, sql_type)
    if whole and kind == "uuid":
        return fn.to_uuid(c, strict=False)
    if whole and text and kind == "string":
        return c
    return coerce_text(c, kind, dtype, formats)


def stored(value: Column, column: TargetColumn) -> Column:
    """A checked value in the column's own type."""
    return value.try_cast(column.spark_type)


def is_exact(column: TargetColumn) -> bool:
    """Columns that a plain coercion cannot fill: exact decimals, arrays, vectors."""
    return column.is_array or column.is_vector or (column.coercion == "number" and column.precision is not None)
