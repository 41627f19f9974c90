"""Text and null-word functions."""

from __future__ import annotations

from collections.abc import Mapping as MappingABC

from pyspark.sql import Column, functions as F, types as T

from quaymaster import constants as K


def js_trim(c: Column) -> Column:
    """Strip every Unicode space and the BOM; plain ``trim`` only strips U+0020."""
    return F.btrim(c, F.lit(K.SPACE_CHARS))


def is_nullish(c: Column, words=K.PROFILE_NULLS) -> Column:
    """NULL, blank, or one of the null words.

    One anchored pattern: a third of the cost of trimming and lowering first.
    """
    listed = "|".join(w.replace(".", r"\.") for w in words if w)
    pattern = rf"(?i)^{K.SPACE_CLASS}*(?:{listed})?{K.SPACE_CLASS}*\z"
    return F.coalesce(c.rlike(pattern), F.lit(True))


def null_if_variant(c: Column, words=K.TRANSFORM_NULLS) -> Column:
    """NULL for a null word, else the value unchanged."""
    return F.when(~is_nullish(c, words), c)


def is_empty_like(c: Column) -> Column:
    """NULL or the empty string, nothing else."""
    return F.coalesce(c.cast("string"), F.lit("")) == ""


def to_text(c: Column) -> Column:
    """Text form, with NULL and '' both NULL."""
    return F.nullif(c.cast("string"), F.lit(""))


def clean_text(c: Column) -> Column:
    """C13g: NULL for a null word, else trimmed text."""
    t = js_trim(c)
    return F.when(~is_nullish(c, K.CLEAN_NULLS), t)


def truncate_to(c: Column, n: int) -> Column:
    """C20: first ``n`` characters."""
    return F.left(c, F.lit(n))


def strip_leading_zeros(c: Column) -> Column:
    """Drop leading zeros of an all-digit text, keep at least one digit."""
    return F.when(c.rlike(r"^0+\d+\z"), F.regexp_replace(c, r"^0+(?=\d)", "")).otherwise(c)


def resplit_list(c: Column, seps: str = r"[,;|]", out: str = " | ") -> Column:
    """C17: comma, semicolon or pipe list -> `` | `` list, blank items dropped."""
    items = F.filter(F.transform(F.split(c, seps), js_trim), lambda x: x != "")
    return F.array_join(items, out)


def normalize_enum(c: Column, words: MappingABC[str, str]) -> Column:
    """Map words (any case, trimmed) to canonical values; others unchanged.

    ``words`` is code-sized metadata. For a dictionary held in a table use
    ``operators.constraints.canonicalize``.
    """
    pairs = [F.lit(x) for kv in words.items() for x in (kv[0].lower(), kv[1])]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(js_trim(c))), js_trim(c))


def clean_phone(c: Column) -> Column:
    """Drop blanks, dots, dashes and brackets, keep a leading plus."""
    return F.translate(c, K.SPACE_CHARS + "().-", "")


def strip_unit_suffix(c: Column) -> Column:
    """Drop a trailing unit word from a number text (``12.5 kg`` -> ``12.5``)."""
    t = js_trim(c)
    return F.when(
        t.rlike(r"^[^A-Za-z]*\d[\d,.]*\s*[A-Za-z%]+\.?\z"),
        F.regexp_replace(t, r"\s*[A-Za-z%]+\.?\z", ""),
    ).otherwise(t)


def value_kind(c: Column, dtype: T.DataType) -> Column:
    """Null / string / number / boolean / array / object."""
    if isinstance(dtype, T.VariantType):
        s = F.schema_of_variant(c)
        kind = (
            F.when(s == "VOID", "null")
            .when(s.startswith("ARRAY"), "array")
            .when(s.startswith("OBJECT"), "object")
            .when(s == "BOOLEAN", "boolean")
            .when(s.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "number")
            .otherwise("string")
        )
        return F.when(c.isNull(), "null").otherwise(kind)
    if isinstance(dtype, T.BooleanType):
        name = "boolean"
    elif isinstance(dtype, T.NumericType):
        name = "number"
    elif isinstance(dtype, T.ArrayType):
        name = "array"
    elif isinstance(dtype, (T.StructType, T.MapType)):
        name = "object"
    else:
        name = "string"
    return F.when(c.isNull(), "null").otherwise(name)


def uniqueness_key(c: Column, dtype: T.DataType) -> Column:
    """Text under which two values count as the same ('' stays a value)."""
    if isinstance(dtype, (T.StructType, T.MapType, T.ArrayType, T.VariantType)):
        text = F.to_json(c)
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("null"))
