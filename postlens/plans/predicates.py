"""Query plans: a nested condition compiled to one two-valued Column.

A plan is a dict: ``where`` is a node ({"all": [...]}, {"any": [...]} or a leaf {"field", "op", "value"}),
``preferences`` and ``include`` steer the ranking and the default exclusions; all four parts, with
``interpretation``, are required (``make_plan`` fills in the defaults). An unknown (null) value never satisfies a condition, not even ``neq``.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlens.functions.text import nfkc

OPS = ("eq", "neq", "contains", "in", "lt", "lte", "gt", "gte", "includes_text", "is_known")


@dataclass(frozen=True)
class Fields:
    """The fields that a plan may name; ``kinds`` says number, boolean, array or text (the default)."""

    names: tuple[str, ...]
    kinds: dict[str, str] = field(default_factory=dict)
    columns: dict[str, Column] = field(default_factory=dict)

    def kind(self, name: str) -> str:
        return self.kinds.get(name, "text")

    def column(self, name: str) -> Column:
        return self.columns.get(name, F.col(name))


def typed(c: Column, kind: str) -> Column:
    """A CSV text cell as its kind; empty is null, arrays are split at |."""
    c = F.nullif(c, F.lit(""))
    if kind == "number":
        return c.try_cast("double")
    if kind == "boolean":
        return F.when(c == "true", True).when(c == "false", False)
    if kind == "array":
        return F.when(c.isNotNull(), F.split(c, r"\|"))
    return c


def validate(plan: dict, fields: Fields) -> dict:
    """The plan itself, or a ValueError that names what is wrong with it."""

    def node(n: dict, at: str) -> None:
        if not isinstance(n, dict):
            raise ValueError(f"{at}: a node is a dict")
        if set(n) in ({"all"}, {"any"}):
            (key,) = n
            if not isinstance(n[key], list):
                raise ValueError(f"{at}.{key}: a list of nodes")
            if key == "any" and not n[key]:
                raise ValueError(f"{at}.any: at least one node")
            for i, x in enumerate(n[key]):
                node(x, f"{at}.{key}[{i}]")
            return
        if set(n) != {"field", "op", "value"}:
            raise ValueError(f"{at}: a leaf has field, op and value, nothing else")
        if n["field"] not in fields.names:
            raise ValueError(f"{at}: unknown field {n['field']!r}")
        if n["op"] not in OPS:
            raise ValueError(f"{at}: unknown op {n['op']!r}")
        if fields.kind(n["field"]) == "array" and n["op"] in ("eq", "neq", "lt", "lte", "gt", "gte"):
            raise ValueError(f"{at}: {n['op']} does not apply to an array")

    def keys(value, at: str, wanted: set[str]) -> None:
        if not isinstance(value, dict):
            raise ValueError(f"{at}: a dict")
        if value.keys() != wanted:
            raise ValueError(f"{at}: missing {sorted(wanted - value.keys())}, unknown {sorted(value.keys() - wanted)}")

    def boolean(value, at: str, nullable: bool = False) -> None:
        if not isinstance(value, bool) and not (nullable and value is None):
            raise ValueError(f"{at}: true or false" + ", or null" * nullable)

    keys(plan, "plan", {"interpretation", "where", "preferences", "include"})
    if not isinstance(plan["interpretation"], str) or not plan["interpretation"]:
        raise ValueError("interpretation: a text that is not empty")
    wanted, include = plan["preferences"], plan["include"]
    keys(wanted, "preferences", {"beginner_friendly", "max_fee", "require_contactable"})
    boolean(wanted["beginner_friendly"], "preferences.beginner_friendly", nullable=True)
    boolean(wanted["require_contactable"], "preferences.require_contactable")
    fee = wanted["max_fee"]
    if fee is not None and (isinstance(fee, bool) or not isinstance(fee, int) or fee < 0):
        raise ValueError("preferences.max_fee: a whole number from 0, or null")
    keys(include, "include", set(INCLUDED))
    for name in INCLUDED:
        boolean(include[name], f"include.{name}")
    node(plan["where"], "where")
    return plan


INCLUDED = ("duplicates", "full", "cancelled")


def make_plan(where: dict, interpretation: str = "conditions", preferences: dict | None = None, include: dict | None = None) -> dict:
    """A whole plan of a condition: without other preferences, and with the default exclusions."""
    return {
        "interpretation": interpretation, "where": where,
        "preferences": {"beginner_friendly": None, "max_fee": None, "require_contactable": False} | (preferences or {}),
        "include": dict.fromkeys(INCLUDED, False) | (include or {}),
    }


def _leaf(n: dict, fields: Fields) -> Column:
    name, op, v = n["field"], n["op"], n["value"]
    c, kind = fields.column(name), fields.kind(name)
    if op == "eq":
        out = c == F.lit(v)
    elif op == "neq":
        out = c != F.lit(v)
    elif op == "contains":
        out = F.array_contains(c, v) if kind == "array" else F.coalesce(c.cast("string"), F.lit("")).contains(str(v))
    elif op == "in":
        known = [x for x in v if x is not None]
        if kind == "array":
            out = F.arrays_overlap(c, F.array(*[F.lit(x) for x in known])) if known else F.lit(False)
        else:
            out = F.coalesce(c.isin(*known), F.lit(False)) if known else F.lit(False)
        if len(known) < len(v):
            out = out | c.isNull()
    elif op in ("lt", "lte", "gt", "gte"):
        out = {"lt": c.__lt__, "lte": c.__le__, "gt": c.__gt__, "gte": c.__ge__}[op](F.lit(v))
    elif op == "includes_text":
        folded = F.lower(nfkc(F.coalesce(c.cast("string"), F.lit(""))))
        out = folded.contains(unicodedata.normalize("NFKC", v).lower())
    else:
        known = c.isNotNull() & (F.size(c) > 0) if kind == "array" else c.isNotNull()
        out = known if v else ~F.coalesce(known, F.lit(False))
    return F.coalesce(out, F.lit(False))


def compile_where(node: dict, fields: Fields) -> Column:
    """One boolean Column that is never null. An empty ``all`` is true, an empty ``any`` false."""
    if "all" in node:
        return reduce(lambda a, b: a & b, [compile_where(n, fields) for n in node["all"]], F.lit(True))
    if "any" in node:
        return reduce(lambda a, b: a | b, [compile_where(n, fields) for n in node["any"]], F.lit(False))
    return _leaf(node, fields)


def include_flags(include: dict, require_contact: bool = False) -> Column:
    """Default exclusions: duplicates, full and cancelled rows unless included; unreachable rows if contact is required."""
    out = F.lit(True)
    if not include.get("duplicates"):
        out &= F.coalesce(F.col("dedupe_status") != "duplicate", F.lit(True))
    for status in ("full", "cancelled"):
        if not include.get(status):
            out &= F.coalesce(F.col("status") != status, F.lit(True))
    if require_contact:
        out &= F.coalesce(F.col("contactability") != "unavailable", F.lit(True))
    return out


def expand_hierarchy(values: list[str], children: dict[str, list[str]]) -> list[str]:
    """A parent value stands for itself and its children."""
    return list(dict.fromkeys(x for v in values for x in (v, *children.get(v, []))))


#: The columns without which rows cannot be searched.
REQUIRED = ("listing_id", "event_group_id", "status", "dedupe_status", "contactability", "primary_contact_label", "primary_contact_url")


def require_columns(df, required: tuple[str, ...] = REQUIRED):
    """df, or an error that lists every required column it lacks."""
    lacking = [c for c in required if c not in df.columns]
    if lacking:
        raise ValueError(f"missing required columns: {', '.join(lacking)}")
    return df


def facet_plan(values: dict, children: dict[str, list[str]] | None = None) -> dict:
    """Form values as a plan. Dates and weekdays are alternatives, or both hold with date_mode ``all``; the other facets all hold.

    A weekday is a listing's own or one of its recurrence. Rows of excluded authors go; an unknown author stays.
    """
    every: list[dict] = []
    leaf = lambda f, op, v: {"field": f, "op": op, "value": v}
    when = []
    if values.get("dates"):
        when.append(leaf("date", "in", list(values["dates"])))
    if values.get("weekdays"):
        when.append({"any": [leaf("weekday", "in", list(values["weekdays"])), *[leaf("recurrence_weekdays", "contains", d) for d in values["weekdays"]]]})
    if when:
        every.append({"all" if values.get("date_mode") == "all" else "any": when})
    if values.get("text"):
        every.append(leaf("search_text", "includes_text", values["text"]))
    if values.get("from_time"):
        every.append(leaf("start_time", "gte", values["from_time"]))
    if values.get("region"):
        every.append({"any": [leaf("city", "eq", values["region"]), leaf("district", "eq", values["region"])]})
    for name, op in (("venue_name", "eq"), ("skill", "includes_text"), ("beginner_friendly", "eq"), ("fee_max", "lte"), ("status", "eq")):
        if values.get(name) is not None and values.get(name) != "":
            every.append(leaf(name, op, values[name]))
    if values.get("play_format"):
        every.append(leaf("play_format", "in", expand_hierarchy([values["play_format"]], children or {})))
    if values.get("excluded_authors"):
        every.append({"any": [leaf("author_url", "is_known", False), {"all": [leaf("author_url", "neq", a) for a in values["excluded_authors"]]}]})
    return make_plan({"all": every}, "facets", include=values.get("include"))
