"""Containers are walked whole in one pass, whatever their depth; very large ones are taken apart; both give what a walk by levels gives."""

import json

import pytest
from pyspark.sql import functions as F

from postlens import workspace
from postlens.functions import leaves

RECORDS = [
    {"a": {"b": ["x", "unknown", "", None, {"c": {"d": [[["deep"]], 1.50, 100.0, 1e10, -0.0, True, False, 12345678901234567890, 1e-7]}}], "e": {}, "f": []}, "g": "é\n\"q\"", "": {"h": 1}},
    [{"k": "v"}, [2, [3]], "plain", 4.0],
    "scalar", None, {}, {"a": {"": {"b": 7}, "1e400": float("1e300")}},
]


def texts():
    return [(i, json.dumps(r)) for i, r in enumerate(RECORDS)] + [(90, "{broken"), (91, '{"a":{"x":1,"x":2}}'), (92, '{"a":[1e400,{"b":0.10}]}'), (93, None)]


def by_levels(spark):
    """path and value of each leaf as Spark's variant functions give them, for as many levels as there are."""
    rows, out = spark.createDataFrame(texts(), "i int, j string").select("i", F.lit("").alias("p"), F.try_parse_json("j").alias("v")), []
    for _ in range(9):
        parts = rows.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("i", "p", F.coalesce("key", F.col("pos").cast("string")).alias("s"), F.col("value").alias("v"))
        rows = parts.select("i", F.when(F.col("p") == "", F.col("s")).otherwise(F.concat("p", F.lit("."), "s")).alias("p"), "v")
        leaf = ~F.schema_of_variant("v").rlike("(?i)^(object|array)")
        out += [tuple(r) for r in rows.where(leaf).select("i", "p", F.try_variant_get("v", "$", "string")).collect()]
    return sorted(r for r in out if r[2] not in (None, "", "unknown"))


@pytest.mark.parametrize("walked", [1 << 18, 30, 0])
def test_leaves_are_those_of_a_walk_by_levels(spark, monkeypatch, walked):
    monkeypatch.setattr(leaves, "WALKED", walked)
    got = leaves.leaves(spark.createDataFrame(texts(), "i int, j string"), ["i"], F.try_parse_json("j"))
    assert sorted(map(tuple, got.collect())) == by_levels(spark)


def test_depth_costs_no_further_table(spark):
    mark = workspace.len_staged()
    leaves.leaves(spark.createDataFrame(texts(), "i int, j string"), ["i"], F.try_parse_json("j")).collect()
    assert workspace.len_staged() == mark + 1


def test_rows_of_one_record_meet(spark):
    """Evidence and leaves of rows that share their ids are one record's: each problem is said once."""
    df = spark.createDataFrame([(1, '{"a":{"x":1},"c":2}', [("a.x", "q")]), (1, '{"a":{"y":2,"x":3},"z":1}', [("a.w", "none"), ("c", "q")]), (1, '{"a":{"y":5}}', []), (None, '{"a":{"y":5}}', [("c", "a"), ("c", None)])], "id int, j string, e array<struct<field:string,quote:string>>")
    out = leaves.evidence_problems(df, ["id"], F.try_parse_json("j"), ["a", "c"], F.col("e"), F.lit("a q"))
    want = {(1, "a.y", "missing"), (1, "a.w", "unfilled"), (1, "a.w", "not_quoted"), (1, "evidence", "empty"), (None, "a.y", "missing"), (None, "c", "unfilled"), (None, "c", "not_quoted")}
    got = [tuple(r) for r in out.collect()]
    assert set(got) == want and len(got) == len(want)
