"""Listing numbers are judged exactly, by an aggregate of a row per 64 numbers."""

from pyspark.sql import functions as F

from postlens.operators import release

NUMBERS = {1: [0, 1, 2], 2: [0, 2], 3: [1, 2], 4: [0, 1, 1, 3], 5: list(range(200)), 6: [*range(63), 63, 63, 65], 7: [*range(199), 0], 8: [-1, 0], 9: [None, 0], 10: [None]}


def test_numbers_with_gaps_repeats_and_nulls(spark):
    rows = spark.createDataFrame([(p, i) for p, own in NUMBERS.items() for i in own], "post long, i int")
    posts = spark.createDataFrame([(p, 1, True, True) for p in NUMBERS], "post long, batch long, rec boolean, done boolean")
    report = spark.createDataFrame([(len(NUMBERS), rows.count(), len(NUMBERS))], "posts long, listings long, analysed long")
    out = release.consistency(posts, posts.select("batch").distinct(), rows, report, "post", "batch", "i", "done", "rec")
    assert {r.check: r.n for r in out.collect() if r.n} == {"listing_numbers": sum(not own or sorted(x is None or x for x in own) != list(range(len(own))) or None in own for own in NUMBERS.values())}
    plan = out.select(F.col("check"))._jdf.queryExecution().optimizedPlan().toString()
    assert "count(distinct" not in plan and "Aggregate [post" in plan
