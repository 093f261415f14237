"""Places of all rows, over more rows than any limit and more partitions than one."""

import random

from pyspark.sql import functions as F

from postlens.operators import search


def test_every_row_has_its_place(spark):
    rows = [(i, random.Random(i).choice([None, 1, 2, 3]), "hot" if i % 3 else f"k{i % 7}") for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, fee int, k string")
    got = {r.id: r.place for r in search.places(df, search.browse_order(F.col("fee"), True, [F.col("id")])).collect()}
    best = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {r[0]: n for n, r in enumerate(best, 1)}
    got = {r.id: r.place for r in search.places(df, [F.col("id")], ("k",)).collect()}
    assert got == {r[0]: sum(x[2] == r[2] for x in rows[: r[0] + 1]) for r in rows}
