"""Nested contracts compiled to one Column: every violation of a record of structs and arrays, with its path.

A spec is a dict in the manner of JSON Schema: ``required`` and ``extras`` of an object's ``fields``, ``items``, ``min_items``
and ``unique`` of an array, ``enum``, ``low``, ``high``, ``pattern``, ``min_length`` of a value, ``any_of`` (one of several specs,
the first that breaks no rule), ``nullable``. Records are VARIANT values, so kinds (``kind``: object, array, string, integer,
number, boolean) and unknown fields show too. One pass: arrays are walked by ``transform``, nothing is exploded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VIOLATION = "array<struct<path: string, code: string>>"
KINDS = ("object", "array", "string", "integer", "number", "boolean")
KEYS = {"kind", "nullable", "required", "fields", "extras", "items", "min_items", "unique", "enum", "low", "high", "pattern", "min_length", "any_of"}


def check_spec(spec: dict, at: str = "") -> dict:
    """The spec itself, or a ValueError that names what is wrong with it."""
    if unknown := set(spec) - KEYS:
        raise ValueError(f"{at or '/'}: unknown rules {sorted(unknown)}")
    if "any_of" not in spec and spec.get("kind") not in KINDS:
        raise ValueError(f"{at or '/'}: a kind is one of {', '.join(KINDS)}")
    if missing := set(spec.get("required", ())) - set(spec.get("fields", {})):
        raise ValueError(f"{at or '/'}: required fields that are not described: {sorted(missing)}")
    for name, own in spec.get("fields", {}).items():
        check_spec(own, f"{at}/{name}")
    if "items" in spec:
        check_spec(spec["items"], f"{at}/*")
    for n, own in enumerate(spec.get("any_of", ())):
        check_spec(own, f"{at}|{n}")
    return spec


def _none() -> Column:
    return F.array().cast(VIOLATION)


def _one(broken: Column, path: Column, code: str) -> Column:
    return F.when(F.coalesce(broken, F.lit(False)), F.array(F.struct(path.alias("path"), F.lit(code).alias("code")))).otherwise(_none())


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then of a value that is worked out once a row, however often it is named: nothing inside lambdas is shared otherwise."""
    return F.get(F.transform(F.array(value), then), 0)


def compile_contract(spec: dict, value: Column, path: Column | str = "") -> Column:
    """An array of (path, code) of every rule that the variant breaks; empty if it breaks none. Paths look like ``/listings/0/price``."""
    check_spec(spec)
    return _let(value, lambda v: _compile(spec, v, F.lit(path) if isinstance(path, str) else path))


def _compile(spec: dict, value: Column, path: Column) -> Column:
    """value is a column or a lambda's variable, so naming it again costs nothing."""
    if "any_of" in spec:

        def choose(each: Column) -> Column:
            # the alternative that breaks least says what is wrong
            least = F.array_sort(F.transform(each, lambda v: F.struct(F.size(v).alias("n"), v.alias("v"))))
            return F.when(F.exists(each, lambda v: F.size(v) == 0), _none()).otherwise(F.concat(_one(F.lit(True), path, "any_of"), F.get(least, 0)["v"]))

        return _let(F.array(*[_compile(s, value, path) for s in spec["any_of"]]), choose)
    null = F.is_variant_null(value) if spec.get("nullable") else F.lit(False)
    judge = lambda right, rules: F.when(F.coalesce(right, F.lit(False)), rules).when(F.coalesce(null, F.lit(False)), _none()).otherwise(_one(F.lit(True), path, "kind"))
    wanted = spec["kind"]
    # objects and arrays are taken apart once, one level; the cast itself says whether they are that
    if wanted == "object":
        return _let(F.try_variant_get(value, "$", "map<string, variant>"), lambda held: judge(held.isNotNull(), _object(spec, held, path)))
    if wanted == "array":
        return _let(F.try_variant_get(value, "$", "array<variant>"), lambda items: judge(items.isNotNull(), _array(spec, items, path)))
    rules = _scalar(spec, value, path)
    if wanted == "number":
        right = lambda name: ~name.rlike("^(VOID|OBJECT|ARRAY|STRING$|BOOLEAN$)")
    else:
        right = lambda name: name == ("BIGINT" if wanted == "integer" else wanted.upper())
    return _let(F.schema_of_variant(value), lambda name: judge(right(name), rules))


def _object(spec: dict, held: Column, path: Column) -> Column:
    fields, keys = spec.get("fields", {}), F.map_keys(held)
    inside = lambda own, at: lambda x: _compile(own, x, at)
    parts = []
    for name, own in fields.items():
        at = F.concat(path, F.lit(f"/{name}"))
        inner = _let(F.try_element_at(held, F.lit(name)), inside(own, at))
        parts.append(F.when(F.map_contains_key(held, name), inner).otherwise(_one(F.lit(name in spec.get("required", ())), at, "required")))
    if not spec.get("extras", False):
        extra = F.array_except(keys, F.array(*[F.lit(n) for n in fields]).cast("array<string>"))
        parts.append(F.transform(F.array_sort(extra), lambda k: F.struct(F.concat(path, F.lit("/"), k).alias("path"), F.lit("unknown").alias("code"))))
    return F.concat(_none(), *parts)


def _array(spec: dict, items: Column, path: Column) -> Column:
    parts = []
    if "min_items" in spec:
        parts.append(_one(F.size(items) < spec["min_items"], path, "min_items"))
    if spec.get("unique"):
        parts.append(_let(F.transform(items, lambda x: F.to_json(x)), lambda shown: _one(F.size(F.array_distinct(shown)) < F.size(shown), path, "unique")))
    if "items" in spec:
        parts.append(F.flatten(F.transform(items, lambda x, i: _compile(spec["items"], x, F.concat(path, F.lit("/"), i.cast("string"))))))
    return F.concat(_none(), *parts)


def _scalar(spec: dict, value: Column, path: Column) -> Column:
    parts = []
    text = F.try_variant_get(value, "$", "string")
    if spec["kind"] == "string":
        if "pattern" in spec:
            parts.append(_one(~text.rlike(spec["pattern"]), path, "pattern"))
        if "min_length" in spec:
            parts.append(_one(F.char_length(text) < spec["min_length"], path, "min_length"))
    if spec["kind"] in ("integer", "number"):
        number = F.try_variant_get(value, "$", "double")
        out = F.lit(False)
        if spec.get("low") is not None:
            out |= number < spec["low"]
        if spec.get("high") is not None:
            out |= number > spec["high"]
        parts.append(_one(out, path, "range"))
    if "enum" in spec:
        parts.append(_one(~text.isin(*[str(x) for x in spec["enum"]]), path, "enum"))
    return F.concat(_none(), *parts)


def violations(value: Column, spec: dict) -> Column:
    """Every violation of a JSON text; a text that is no JSON breaks the rule ``json``."""
    return _let(F.try_parse_json(value), lambda parsed: F.when(parsed.isNull(), _one(F.lit(True), F.lit(""), "json")).otherwise(compile_contract(spec, parsed)))


def problems(df: DataFrame, ids: list[str], value: Column, spec: dict) -> DataFrame:
    """ids, path and code: one row per violation of a JSON text."""
    # the outer form: of the plain one Spark infers filters on the array's size, and works the array out again for each
    return df.select(*ids, F.explode_outer(violations(value, spec)).alias("v")).where("v is not null").select(*ids, "v.path", "v.code")
