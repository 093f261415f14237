"""Keyed lookups read the row groups that may hold the key, and no others."""

import hashlib

from pyspark.sql import functions as F

from postlens.sources import archive


def test_lookups_prune(spark, tmp_path):
    path = str(tmp_path / "a")
    rows = spark.range(40_000).select(F.concat(F.lit("url:"), F.sha2((F.col("id") % 20_000).cast("string"), 256)).alias("post_key"), F.col("id").alias("observation_id"), F.sha2(F.col("id").cast("string"), 512).alias("body"))
    archive.write_archive(rows, path, "post_key", ["observation_id"], parts=8, group_bytes=256 << 10)
    key = lambda n: "url:" + hashlib.sha256(str(n).encode()).hexdigest()
    one = archive.look_up(spark, path, "post_key", [key(77)])
    assert sorted(r.observation_id for r in one.collect()) == [77, 20_077]
    assert archive.rows_read(one) < 40_000 / 8
    # a key that lies between others and is not there
    none = archive.look_up(spark, path, "post_key", ["url:" + "7" * 64])
    assert archive.rows_read(none) == 0
    few = archive.look_up(spark, path, "post_key", [key(n) for n in (1, 2, 3)])
    assert few.count() == 6 and archive.rows_read(few) < 40_000 * 3 / 8
    wanted = spark.createDataFrame([(key(5),), (key(6),), ("url:none",)], "post_key string")
    assert sorted(r.observation_id for r in archive.look_up_table(spark, path, "post_key", wanted).collect()) == [5, 6, 20_005, 20_006]
    assert archive.look_up_table(spark, path, "post_key", wanted.limit(0)).count() == 0


def test_a_hot_key_is_parted(spark, tmp_path):
    path = str(tmp_path / "a")
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    archive.write_archive(rows, path, "k", ["id"], parts=9)
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) < 3000 / 9 * 2 and archive.look_up(spark, path, "k", ["hot"]).count() == 1000
