"""Releases as compare-and-set: one of two writers is refused, and every interruption leaves a readable release."""

import pytest
from pyspark.sql import functions as F

from postlens.sources import pointers


def test_one_of_two_writers_is_refused(spark, tmp_path):
    base = "file://" + str(tmp_path / "p")
    rows = lambda n: {"posts": spark.range(n).toDF("id")}
    with pytest.raises(ValueError):
        pointers.read_table(spark, base, "posts")
    assert pointers.publish(rows(1), base, "r1", 0) == 1
    assert pointers.publish(rows(2), base, "r2", 1) == 2
    with pytest.raises(pointers.PublicationConflict):
        pointers.publish(rows(3), base, "late", 1)
    # both have looked at number 2 before either writes
    now = pointers.current
    try:
        pointers.current = lambda s, b: (2, {})
        assert pointers.publish(rows(4), base, "r3", 2) == 3
        with pytest.raises(pointers.PublicationConflict):
            pointers.publish(rows(5), base, "r3b", 2)
    finally:
        pointers.current = now
    assert pointers.read_table(spark, base, "posts").count() == 4 and pointers.current(spark, base)[1]["parent"] == 2


def test_interruptions(spark, tmp_path):
    base = "file://" + str(tmp_path / "p")
    one = spark.range(1).toDF("id")
    pointers.publish({"posts": one}, base, "r1", 0)
    one.write.parquet(f"{base}/releases/r2/posts")  # written, not named
    assert pointers.read_table(spark, base, "posts").count() == 1 and pointers.repair(spark, base) == []
    assert pointers._create(spark, f"{base}/pointers/{2:012d}", "")  # named, its text not written
    assert pointers.current(spark, base)[0] == 1 and pointers.read_table(spark, base, "posts").count() == 1
    with pytest.raises(pointers.PublicationConflict):
        pointers.publish({"posts": one}, base, "r3", 1)
    assert pointers.repair(spark, base) == [2]
    assert pointers.publish({"posts": spark.range(5).toDF("id")}, base, "r4", 1) == 2 and pointers.read_table(spark, base, "posts").count() == 5
    listed = spark.createDataFrame([("r1", "published"), ("r2", "prepared"), ("r4", "prepared")], "publication_id string, status string")
    assert {r.publication_id: r.status for r in pointers.reconciled(spark, base, listed).collect()} == {"r1": "published", "r2": "prepared", "r4": "published"}


def test_a_folder_has_one_publication(spark, tmp_path):
    base = "file://" + str(tmp_path / "p")
    pointers.bind(spark, base, "a")
    pointers.bind(spark, base, "a")
    with pytest.raises(pointers.PublicationConflict):
        pointers.bind(spark, base, "b")
    assert pointers.publish({"t": spark.range(2).select(F.col("id"))}, base, "r", 0) == 1
