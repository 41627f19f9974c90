"""SQL transforms that cannot stop a job.

The text is parsed by Spark and written out again with every operation that could fail in
the form that gives NULL instead: ``try_cast`` for casts in any spelling, ``try_add`` and its
kin for arithmetic, ``try_element_at`` and others for functions. Casts that Spark adds by itself,
as in ``value > 3``, give NULL under the rules in force while the expression is resolved
(``lenient_rules``). What has no tolerant form is refused when the plan is built.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_INFIX = {"And": "AND", "Or": "OR", "EqualTo": "=", "EqualNullSafe": "<=>", "GreaterThan": ">", "GreaterThanOrEqual": ">=",
          "LessThan": "<", "LessThanOrEqual": "<=", "RLike": "RLIKE"}
_CALLS = {"Add": "try_add", "Subtract": "try_subtract", "Multiply": "try_multiply", "Divide": "try_divide", "Remainder": "try_mod",
          "Concat": "concat", "Lower": "lower", "Substring": "substring", "StringLocate": "locate", "Overlay": "overlay", "StringTrim": "btrim"}
_TYPE_CALLS = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "date", "timestamp", "string", "binary")
_INSTEAD = {"element_at": "try_element_at", "to_number": "try_to_number", "to_binary": "try_to_binary", "parse_json": "try_parse_json",
            "variant_get": "try_variant_get", "url_decode": "try_url_decode", "aes_decrypt": "try_aes_decrypt", "mod": "try_mod",
            "to_timestamp": "try_to_timestamp"}
# They raise under any rules, run other code, or grow without a bound.
_REFUSED = {"raise_error", "assert_true", "reflect", "java_method", "sequence", "array_repeat", "repeat", "to_variant_object", "from_avro",
            "from_protobuf", "is_valid_utf8", "validate_utf8", "hll_union", "bitmap_count"}
_CONSTANTS = {"current_date", "current_timestamp", "localtimestamp"}


def tolerant_sql(spark: SparkSession, text: str) -> str:
    """The expression ``text`` over a column called ``value`` in a form that gives NULL where it would fail."""
    tree = spark._jsparkSession.sessionState().sqlParser().parseExpression(text)
    return _written(tree, text)


@contextmanager
def lenient_rules(spark: SparkSession) -> Iterator[None]:
    """Expressions resolved within give NULL where strict rules raise; only resolving, not running, happens within."""
    wanted = {"spark.sql.ansi.enabled": "false", "spark.sql.legacy.sizeOfNull": "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _parts(sequence) -> list:
    return [sequence.apply(i) for i in range(sequence.size())]


def _written(node, text: str) -> str:
    kind = node.getClass().getSimpleName()
    children = _parts(node.children())

    def refuse(what: str) -> ValueError:
        return ValueError(f"{what} has no form that cannot fail; in transform: {text}")

    if kind == "Literal":
        return node.sql()
    if kind == "UnresolvedAttribute":
        if node.name().lower() not in _CONSTANTS | {"value"}:
            raise ValueError(f"a transform sees only `value`, not {node.name()}: {text}")
        return node.name()
    if kind == "UnresolvedNamedLambdaVariable":
        return node.name()
    if kind == "LambdaFunction":
        body, *names = children
        listed = ", ".join(_written(n, text) for n in names)
        return f"{listed if len(names) == 1 else f'({listed})'} -> {_written(body, text)}"
    args = [_written(c, text) for c in children]
    if kind in _INFIX:
        return f"({args[0]} {_INFIX[kind]} {args[1]})"
    if kind in _CALLS:
        return f"{_CALLS[kind]}({', '.join(args)})"
    if kind == "Cast":
        return f"try_cast({args[0]} AS {node.dataType().sql()})"
    if kind == "UnaryMinus":
        return f"try_subtract(0, {args[0]})"
    if kind == "UnaryPositive":
        return args[0]
    if kind == "IntegralDivide":
        return f"(try_cast({args[0]} AS bigint) div nullif(try_cast({args[1]} AS bigint), 0))"
    if kind == "Not":
        return f"(NOT {args[0]})"
    if kind in ("IsNull", "IsNotNull"):
        return f"({args[0]} IS {'NOT ' * (kind == 'IsNotNull')}NULL)"
    if kind == "In":
        return f"({args[0]} IN ({', '.join(args[1:])}))"
    if kind in ("Like", "ILike"):
        return f"({args[0]} {kind.upper()} {args[1]})"
    if kind == "CaseWhen":
        ends = f" ELSE {args[-1]}" if len(args) % 2 else ""
        return "CASE" + "".join(f" WHEN {a} THEN {b}" for a, b in zip(args[::2], args[1::2])) + ends + " END"
    if kind == "UnresolvedExtractValue":
        return f"{args[0]}[{args[1]}]"
    if kind == "UnresolvedFunction":
        name = ".".join(_parts(node.nameParts())).lower()
        if name in _REFUSED or node.isDistinct() or not node.filter().isEmpty():
            raise refuse(name)
        if name in _TYPE_CALLS and len(args) == 1:
            return f"try_cast({args[0]} AS {name})"
        if name == "to_date" and len(args) == 2:
            return f"try_cast(try_to_timestamp({', '.join(args)}) AS date)"
        return f"{_INSTEAD.get(name, name)}({', '.join(args)})"
    raise refuse(kind)
