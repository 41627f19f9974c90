"""JSON, list and identifier functions (C8, C9, C13e, C13f, C14, C18) and C12."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from quaymaster import constants as K
from quaymaster.functions.numbers import extract_number
from quaymaster.functions.temporal import to_timestamp
from quaymaster.functions.text import js_trim


def is_json(c: Column) -> Column:
    """Whole text is one JSON value.

    The parser stops after the first value, so the text is parsed inside two
    wrappers; trailing text breaks at least one of them or adds an element.
    """
    as_list = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    as_field = F.try_parse_json(F.concat(F.lit('{"k":'), c, F.lit("}")))
    one = F.try_variant_get(as_list, "$[0]", "variant").isNotNull() & F.try_variant_get(
        as_list, "$[1]", "variant").isNull()
    # A failing parse costs an exception; most text already fails on its first character.
    may_be = c.rlike(rf'^{K.SPACE_CLASS}*[\[{{"0-9tfn-]')
    return F.coalesce(may_be & as_list.isNotNull() & as_field.isNotNull() & one, F.lit(False))


def is_json_container(c: Column) -> Column:
    """A JSON object or array; only text that opens with a bracket is parsed."""
    t = js_trim(c)
    return F.when(t.startswith("{") | t.startswith("["), is_json(t)).otherwise(False)


def to_json(c: Column, dtype: T.DataType | None = None) -> Column:
    """JSON text when it parses, NULL otherwise; nested values are serialised."""
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        return F.to_json(c)
    if dtype is not None and not isinstance(dtype, T.StringType):
        return F.lit(None).cast("string")
    return F.when(is_json(c), js_trim(c))


def clean_json(c: Column) -> Column:
    """C13f: unparsable or blank gives NULL."""
    t = js_trim(c)
    return F.when(t != "", to_json(t))


def clean_array(c: Column) -> Column:
    """C14: a JSON list if it parses, else split on commas; a JSON scalar is one item."""
    t = js_trim(c)
    parsed = F.when(t.startswith("[") & is_json(t), F.from_json(t, "array<string>"))
    scalar = F.when(is_json(t), F.array(F.when(
        t.startswith('"'), F.get_json_object(F.concat(F.lit('{"k":'), t, F.lit("}")), "$.k")).otherwise(t)))
    return F.when(t != "", F.coalesce(parsed, scalar, F.transform(F.split(t, ","), js_trim)))


def to_uuid(c: Column, strict: bool = True) -> Column:
    """C9 (strict versions) or C13e (any version): trimmed text or NULL."""
    t = js_trim(c.cast("string"))
    return F.when(t.rlike(K.UUID_STRICT if strict else K.UUID_ANY), t)


def clean_uuid(c: Column) -> Column:
    return to_uuid(c, strict=False)


def check_url(c: Column) -> Column:
    """True when NULL or an http(s) address."""
    return F.coalesce(c.rlike(K.URL_START), F.lit(True))


def check_hex_color(c: Column) -> Column:
    """True when NULL or ``#RRGGBB``, comma list allowed."""
    return F.coalesce(c.rlike(K.HEX_COLOR), F.lit(True))


def castable(c: Column, transformation: str) -> Column:
    """Would the named transformation accept this text? Blank always passes."""
    if transformation == "to_integer":
        n = extract_number(c)
        ok = n == F.floor(n).cast("double")
    elif transformation == "to_number":
        ok = extract_number(c).isNotNull()
    elif transformation == "to_boolean":
        ok = js_trim(c).rlike(K.BOOLEAN_WORD)
    elif transformation in ("to_date", "to_timestamp"):
        ok = to_timestamp(c).isNotNull()
    elif transformation == "to_uuid":
        ok = js_trim(c).rlike(K.UUID_ANY)
    elif transformation == "to_json":
        ok = is_json(c)
    elif transformation == "to_array":
        ok = c.contains(",") | is_json(c)
    else:
        return F.lit(True)
    blank = F.coalesce(js_trim(c) == "", F.lit(True))
    return blank | F.coalesce(ok, F.lit(False))
