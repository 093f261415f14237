"""A contract reads a record once, however many rules name its parts."""

from pyspark.sql import functions as F

from postlens.plans import contract


def test_text_is_parsed_once(spark):
    spec = {"kind": "object", "fields": {"a": {"any_of": [{"kind": "integer", "low": 1}, {"kind": "string"}]}, "b": {"kind": "array", "items": {"kind": "number", "nullable": True}}}}
    df = spark.createDataFrame([(1, '{"a":0,"b":[1,null,"x"]}'), (2, "{"), (3, None), (4, '{"a":"s","c":1}')], "id int, j string")
    out = df.select("id", contract.violations(F.col("j"), spec).alias("v"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parsejson") + plan.lower().count("parse_json") <= 1
    found = sorted(tuple(r) for r in contract.problems(df, ["id"], F.col("j"), spec).collect())
    assert found == [(1, "/a", "any_of"), (1, "/a", "kind"), (1, "/b/2", "kind"), (2, "", "json"), (3, "", "json"), (4, "/c", "unknown")]
