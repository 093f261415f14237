"""Canonical JSON, hashed ids and post keys."""

from __future__ import annotations

import gzip
import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

UNIT = "\u001f"


def canonical_json(text: Column) -> Column:
    """JSON text with keys sorted at every level and arrays in their order; null if it is not JSON."""
    return F.to_json(F.try_parse_json(text))


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def hash_id(prefix: str, *parts: Column) -> Column:
    """prefix_ and 20 hex digits of the SHA-256 of the parts; a null part counts as an empty one."""
    joined = F.concat_ws(UNIT, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(joined, 256), 1, 20))


def post_key(url: Column, post_id: Column, group: Column, fingerprint: Column) -> Column:
    """struct(key, kind): by canonical URL, else by group and id, else by a fingerprint digest."""
    kind = F.when(url.isNotNull(), "url").when(post_id.isNotNull() & (post_id != ""), "post_id").otherwise("fingerprint")
    key = (
        F.when(kind == "url", F.concat(F.lit("url:"), url))
        .when(kind == "post_id", F.concat_ws(":", F.lit("post-id"), F.coalesce(group, F.lit("")), post_id))
        .otherwise(F.concat(F.lit("fingerprint:"), F.sha2(fingerprint, 256)))
    )
    return F.struct(key.alias("key"), kind.alias("kind"))


def fingerprint(*parts: Column) -> Column:
    return F.concat_ws(UNIT, *[F.coalesce(p, F.lit("")) for p in parts])


def path_value(text: Column, path: str) -> Column:
    """A value at a.b.0.c of a JSON text."""
    return F.get_json_object(text, "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split(".")))


def anchor(schedule: Column, venue: Column) -> Column:
    """What aligns expected and actual listings: canonical JSON of schedule and venue, whatever the order of their fields; unknown ones count."""
    return canonical_json(F.to_json(F.struct(schedule.alias("schedule"), venue.alias("venue")), {"ignoreNullFields": "false"}))


def contract_versions(**texts: str) -> dict[str, str]:
    """Short hashes of the rule, schema and model texts that results depend on; plain values for literal columns."""
    return {k: hashlib.sha256(json.dumps(v, sort_keys=True).encode()).hexdigest()[:20] for k, v in texts.items()}


@pandas_udf(StringType())
def decode_diagnostic(data: pd.Series) -> pd.Series:
    """gzip bytes as text; null where they are not gzip."""

    def one(b):
        if b is None:
            return None
        try:
            return gzip.decompress(b).decode("utf-8", "replace")
        except (OSError, EOFError):
            return None

    return data.map(one)


def leaf_facts(record: Column, paths: list[str]) -> Column:
    """Map of path to text of the filled leaves of a struct: nulls, empty texts and ``unknown`` are left out."""

    def at(path: str) -> Column:
        c = record
        for p in path.split("."):
            c = F.get(c, int(p)) if p.isdigit() else c[p]
        return c.cast("string")

    entries = F.array(*[F.struct(F.lit(p).alias("key"), at(p).alias("value")) for p in paths])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull() & ~e["value"].isin("", "unknown")))
