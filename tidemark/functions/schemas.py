"""JSON Schemas compiled to one column expression over VARIANT values.

Known keywords: type (also a list), enum, required, properties, additionalProperties, minimum, maximum,
exclusiveMinimum, exclusiveMaximum, minLength, maxLength, pattern, minItems, maxItems, items, anyOf, allOf and
``$ref`` into the schema's own definitions; any other is refused, so none is passed over in silence.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keywords that say nothing about validity.
NOTES = {"$schema", "$id", "$defs", "definitions", "title", "description", "default", "examples", "$comment"}
Check = Callable[[Column], Column]


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _number(v: Column) -> Column:
    return F.try_variant_get(v, "$", "double")


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _entries(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _elements(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


NUMBER = "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"
IS: dict[str, Check] = {
    "object": lambda v: _kind(v).startswith("OBJECT"),
    "array": lambda v: _kind(v).startswith("ARRAY"),
    "string": lambda v: _kind(v) == "STRING",
    "number": lambda v: _kind(v).rlike(NUMBER),
    "integer": lambda v: _kind(v).rlike(NUMBER) & (_number(v) == F.floor(_number(v))),
    "boolean": lambda v: _kind(v) == "BOOLEAN",
    "null": lambda v: _kind(v) == "VOID",
}


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _equals(v: Column, value: Any) -> Column:
    if value is None:
        return IS["null"](v)
    if isinstance(value, bool):
        return IS["boolean"](v) & (F.try_variant_get(v, "$", "boolean") == value)
    if isinstance(value, (int, float)):
        return IS["number"](v) & (_number(v) == float(value))
    if isinstance(value, str):
        return IS["string"](v) & (_text(v) == value)
    raise ValueError(f"enum values must be plain, not {value!r}")


#: Keywords of one kind of value; values of other kinds pass them.
LIMITS: dict[str, tuple[str, Callable[[Column, Any], Column]]] = {
    "minimum": ("number", lambda v, x: _number(v) >= x),
    "maximum": ("number", lambda v, x: _number(v) <= x),
    "exclusiveMinimum": ("number", lambda v, x: _number(v) > x),
    "exclusiveMaximum": ("number", lambda v, x: _number(v) < x),
    "minLength": ("string", lambda v, x: F.length(_text(v)) >= x),
    "maxLength": ("string", lambda v, x: F.length(_text(v)) <= x),
    "pattern": ("string", lambda v, x: _text(v).rlike(x)),
    "minItems": ("array", lambda v, x: F.size(_elements(v)) >= x),
    "maxItems": ("array", lambda v, x: F.size(_elements(v)) <= x),
}


def _checked(v: Column, schema: dict | bool, root: dict, depth: int) -> Column:
    if isinstance(schema, bool):
        return F.lit(schema)
    if depth > 32:
        raise ValueError("a schema that refers to itself has no finite expression")
    tests: list[Column] = []
    below = lambda x, s: _checked(x, s, root, depth + 1)
    unless = lambda kind, test: ~IS[kind](v) | F.coalesce(test, F.lit(False))
    known = schema.get("properties", {})
    for word, said in schema.items():
        if word in NOTES:
            continue
        if word == "type":
            tests.append(_any([IS[t](v) for t in ([said] if isinstance(said, str) else said)]))
        elif word == "enum":
            tests.append(_any([_equals(v, x) for x in said]))
        elif word == "const":
            tests.append(_equals(v, said))
        elif word in LIMITS:
            kind, test = LIMITS[word]
            tests.append(unless(kind, test(v, said)))
        elif word == "required":
            tests.append(unless("object", _all([F.map_contains_key(_entries(v), k) for k in said])))
        elif word == "properties":
            tests.append(unless("object", _all([~F.map_contains_key(_entries(v), k) | below(F.try_element_at(_entries(v), F.lit(k)), s) for k, s in said.items()])))
        elif word == "additionalProperties":
            own = F.map_filter(_entries(v), lambda k, _: ~k.isin(list(known)) if known else F.lit(True))
            tests.append(unless("object", F.forall(F.map_values(own), lambda x: below(x, said))))
        elif word == "items":
            tests.append(unless("array", F.forall(_elements(v), lambda x: below(x, said))))
        elif word in ("anyOf", "allOf"):
            tests.append((_any if word == "anyOf" else _all)([below(v, s) for s in said]))
        elif word == "$ref":
            target: Any = root
            for part in said.removeprefix("#/").split("/"):
                target = target[part]
            tests.append(below(v, target))
        else:
            raise ValueError(f"unknown keyword {word!r}")
    return _all(tests)


def valid(value: Column, schema: dict) -> Column:
    """H-13: whether a VARIANT follows the schema; false for null, which is no JSON at all."""
    return value.isNotNull() & F.coalesce(_checked(value, schema, schema, 0), F.lit(False))


def valid_json(text: Column, schema: dict) -> Column:
    """The same of a text; one that is no JSON, or names a key twice, is not valid."""
    return valid(F.try_parse_json(text), schema)
