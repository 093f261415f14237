"""Leaves of nested JSON at any depth, as rows, and the evidence that they need."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.workspace import stage

#: Texts that fill nothing, roots that need no evidence, and paths whose value follows from others.
UNFILLED = ("", "unknown")
EXEMPT = ("title", "team_name", "notes")
DERIVED = r"^schedule\.timezone$|^schedule\.recurrence\.frequency$|(^|\.)price_options\.\d+\.currency$"
ZERO_DERIVED = r"^schedule\.end_day_offset$"


#: Containers of up to so many characters are walked whole, larger ones are taken apart a level at a time.
WALKED = 1 << 18
#: Numbers stay as they stand in the JSON.
DECODER = json.JSONDecoder(strict=False, parse_int=str, parse_float=str)


def filled(path: str, text: str) -> tuple[list[str], list[str]]:
    """Paths and values (text) of the filled leaves of a container in JSON that stands at a path."""
    paths, values = [], []
    todo = [(path, DECODER.decode(text))]
    while todo:
        path, v = todo.pop()
        for step, x in v.items() if isinstance(v, dict) else enumerate(v):
            step = f"{path}.{step}" if path else str(step)
            if isinstance(x, (dict, list)):
                todo.append((step, x))
            elif x is not None and x not in UNFILLED:
                paths.append(step)
                values.append(x if isinstance(x, str) else "true" if x else "false")
    return paths, values


def slices(batches):
    """Arrow batches a few rows at a time, so that only those are Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield batch.slice(at, 256)


def walk(batches):
    """Filled leaves of containers in JSON (``v``) below their ``path``, with the other columns beside them."""
    for batch in slices(batches):
        found = [filled(*x) for x in zip(batch.column("path").to_pylist(), batch.column("v").to_pylist())]
        row = [n for n, (paths, _) in enumerate(found) for _ in paths]
        ids = [c for c in batch.schema.names if c not in ("path", "v")]
        own = batch.select(ids).take(pa.array(row, pa.int64()))
        yield pa.RecordBatch.from_arrays([*own.columns, *[pa.array([x for f in found for x in f[k]], pa.string()) for k in (0, 1)]], names=[*ids, "path", "value"])


def parts(df: DataFrame, ids: list[str], record: Column) -> DataFrame:
    """ids, path, value and v: what a variant of JSON consists of, filled leaves as value (text), containers as v (JSON).

    A record is taken apart by Spark's table function, and staged; very large containers are taken apart likewise, a level at a time.
    """
    spark = df.sparkSession
    open_ = df.select(*ids, F.lit("").alias("path"), record.alias("v"))
    found = None
    while True:
        each = open_.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select(F.col("pos").alias("_pos"), F.col("key").alias("_key"), F.col("value").alias("_value")))
        step = F.coalesce("_key", F.col("_pos").cast("string"))
        each = each.select(*ids, F.when(F.col("path") == "", step).otherwise(F.concat("path", F.lit("."), step)).alias("path"), "_value", F.to_json("_value").alias("_text"))
        # a container keeps its JSON, a leaf its text alone; what fills nothing is left out when read, as a filter here would make the JSON again
        container = F.substring("_text", 1, 1).isin("{", "[")
        level = stage(each.select(*ids, "path", F.when(~container, F.try_variant_get("_value", "$", "string")).alias("value"), F.when(container, F.col("_text")).alias("v")), "leaves")
        own = level.where(F.col("value").isNotNull() & ~F.col("value").isin(*UNFILLED) | (F.length("v") <= WALKED))
        found = own if found is None else found.unionByName(own)
        open_ = level.where(F.length("v") > WALKED).select(*ids, "path", F.try_parse_json("v").alias("v"))
        if open_.isEmpty():
            return found


def leaves(df: DataFrame, ids: list[str], record: Column) -> DataFrame:
    """ids, path and value (text) of every filled leaf of a variant of JSON: nulls, empty texts and ``unknown`` fill nothing.

    Paths name fields and places (``price_options.3.amount``), so nothing need be named. Containers are walked whole in Arrow batches.
    """
    kinds = T.StructType([*df.select(*ids).schema.fields, T.StructField("path", T.StringType()), T.StructField("value", T.StringType())])
    found = parts(df, ids, record)
    own = found.where(F.col("v").isNull()).select(*ids, "path", "value")
    return own.unionByName(found.where(F.col("v").isNotNull()).select(*ids, "path", "v").mapInArrow(walk, kinds))


def normal_path(path: Column) -> Column:
    """``price_options[3].amount`` as ``price_options.3.amount``."""
    return F.regexp_replace(path, r"\[(\d+)\]", ".$1")


def match(ids: list[str], roots: list[str], derived: str, exempt: tuple[str, ...]):
    """A task's function over rows of records, in order of ids and evidence first, that says what is wrong with each record's evidence.

    Only a record's evidence and the paths said of it are held, never its leaves.
    """
    free = re.compile(f"(?:{derived})|^(?:{'|'.join(map(re.escape, exempt))})(?:\\.|$)", re.ASCII)
    zero, known = re.compile(ZERO_DERIVED, re.ASCII), {}

    def asked(path: str) -> int:
        """0: below no root, 1: may have evidence, 2: needs it, 3: needs it unless the value is 0."""
        if len(known) > 100_000:
            known.clear()
        known[path] = kind = 0 if path.split(".", 1)[0] not in roots else 1 if free.search(path) else 3 if zero.search(path) else 2
        return kind

    def run(batches):
        key, given, found, said, empty = None, {}, set(), set(), False
        keys, paths, codes = [], [], []

        def say(path, code):
            keys.append(key)
            paths.append(path)
            codes.append(code)

        def close():
            for path, unquoted in given.items():
                if path not in found:
                    say(path, "unfilled")
                if unquoted:
                    say(path, "not_quoted")
            if empty:
                say("evidence", "empty")

        def told(kinds):
            out = pa.RecordBatch.from_arrays([*[pa.array([k[n] for k in keys], t) for n, t in enumerate(kinds)], pa.array(paths, pa.string()), pa.array(codes, pa.string())], names=[*ids, "path", "code"])
            for x in (keys, paths, codes):
                x.clear()
            return out

        kinds = None
        for batch in slices(batches):
            kinds = [batch.schema.field(c).type for c in ids]
            columns = [batch.column(c).to_pylist() for c in ("path", "value", "v", "_bare", "_unquoted")]
            for own, path, value, v, bare, unquoted in zip(zip(*[batch.column(c).to_pylist() for c in ids]), *columns):
                if own != key:
                    if key is not None:
                        close()
                    key, given, found, said, empty = own, {}, set(), set(), False
                if unquoted is not None:
                    given[path] = given.get(path, False) or unquoted
                    continue
                for leaf, x in zip(*(filled(path, v) if v is not None else ([path], [value]))):
                    kind = known[leaf] if leaf in known else asked(leaf)
                    if not kind:
                        continue
                    empty = empty or bare
                    if leaf in given:
                        found.add(leaf)
                    elif kind > 1 and leaf not in said and (kind == 2 or x != "0"):
                        said.add(leaf)
                        say(leaf, "missing")
            yield told(kinds)
        if key is not None:
            close()
            yield told(kinds)

    return run


def evidence_problems(df: DataFrame, ids: list[str], record: Column, roots: list[str], evidence: Column, source: Column, derived: str = DERIVED, exempt: tuple[str, ...] = EXEMPT) -> DataFrame:
    """ids, path and code of what is wrong with a record's evidence (array of field and quote; null asks for none).

    unfilled: a field that is no filled leaf below the roots; not_quoted: a quote that is blank or not verbatim in the source;
    missing: a filled leaf without evidence, unless it is derived or its root is exempt; empty: no evidence at all for filled leaves.
    """
    asked = df.where(evidence.isNotNull()).withColumn("_bare", F.size(evidence) == 0)
    held = parts(asked, [*ids, "_bare"], record).withColumn("_unquoted", F.lit(None).cast("boolean"))
    held = held.where(F.substring_index("path", ".", 1).isin(*roots) | (F.col("path") == ""))  # below an empty name paths begin anew
    given = asked.select(*ids, F.explode(evidence).alias("e"), source.alias("_source")).select(*ids, normal_path(F.col("e.field")).alias("path"), F.col("e.quote").alias("quote"), "_source")
    blank = F.coalesce(F.trim("quote"), F.lit("")) == ""
    given = given.select(*ids, "path", F.coalesce(blank | ~F.contains("_source", "quote"), F.lit(False)).alias("_unquoted"))
    # evidence and parts of a record follow each other, so that none is joined and no leaf becomes a row that nothing is wrong with
    rows = held.unionByName(given, allowMissingColumns=True).repartition(*ids).sortWithinPartitions(*ids, F.col("_unquoted").isNull())
    kinds = T.StructType([*df.select(*ids).schema.fields, T.StructField("path", T.StringType()), T.StructField("code", T.StringType())])
    return rows.mapInArrow(match(ids, roots, derived, exempt), kinds)
