"""Leaves are staged as texts, and evidence meets them in one aggregate."""

from pyspark.sql import functions as F

from postlens import workspace
from postlens.functions import leaves


def test_one_aggregate_and_staged_texts(spark):
    df = spark.createDataFrame([(1, '{"a":{"b":["x","unknown"]},"c":2}', [("a.b[0]", "q"), ("z", "none")]), (2, '{"a":1}', []), (3, '{"a":1}', None)], "id int, j string, e array<struct<field:string,quote:string>>")
    mark = workspace.len_staged()
    out = leaves.evidence_problems(df, ["id"], F.try_parse_json("j"), ["a", "c"], F.col("e"), F.lit("a q"))
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in out.collect()) == [(1, "c", "missing"), (1, "z", "not_quoted"), (1, "z", "unfilled"), (2, "a", "missing"), (2, "evidence", "empty")]
    level = spark.read.parquet(workspace._STAGED[mark])
    assert level.where("value is not null and v is not null").count() == 0 and level.where("value is not null").count() == 2
