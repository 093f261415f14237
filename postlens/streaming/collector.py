"""The in-batch collector as a stream: clusters of records that share a key, kept up to date micro-batch by micro-batch.

What is kept below ``target``: ``keys`` (every key once, with the label that its record's cluster had then), dealt into buckets by a
hash of the key; ``alias`` (labels that a later record joined to a smaller one, each with its present label); and ``records`` (their
labels). A label is the least order of a cluster's records so far. A micro-batch reads the buckets of its own keys and the aliases, and
connects its own records and the labels that they meet; so its work follows its own size, not that of the history.

Every part is written under the micro-batch's number and only earlier numbers are read, so one that is repeated after a
restart replaces its own output. The clusters in the end do not depend on how rows are cut into micro-batches, nor on their order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.operators.components import components
from postlens.workspace import stage

KEYS = "batch string, kind int, value string, label long, v int, bucket int"
ALIAS = "label long, now long"
RECORDS = "ord long, label long, v int"


def _write(df: DataFrame, path: str, parts: tuple[str, ...] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*parts) if parts else writer).parquet(path)


def collect_stream(stream: DataFrame, target: str, checkpoint: str, batch: str, order: str, keys: list[str], buckets: int = 64):
    """A query that keeps the clusters of a stream of records (batch, order, keys) below ``target``; orders are whole numbers, distinct over the table."""

    def merge(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        own = df.select(F.col(batch).cast("string").alias("batch"), F.col(order).cast("long").alias("ord"), *[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)])
        each = F.filter(F.array(*[F.struct(F.lit(i).alias("kind"), F.col(f"k{i}").alias("value")) for i in range(len(keys))]), lambda x: x["value"].isNotNull())
        rows = stage(own.select("batch", "ord", F.explode_outer(each).alias("k")).select("batch", "ord", "k.kind", "k.value"), "collector")
        on = ["batch", "kind", "value"]
        bucket = F.pmod(F.xxhash64(F.coalesce("batch", F.lit("")), "kind", "value"), F.lit(buckets)).cast("int")
        first = rows.where("kind is not null").groupBy(*on).agg(F.min("ord").alias("first")).withColumn("bucket", bucket)
        met = first.withColumn("label", F.lit(None).cast("long"))
        if n:
            touched = [r[0] for r in first.select("bucket").distinct().collect()]  # at most ``buckets``
            known = spark.read.schema(KEYS).parquet(f"{target}/keys").where((F.col("v") < n) & F.col("bucket").isin(touched)).select(*on, "label")
            null_safe = reduce(lambda a, b: a & b, [F.col(f"f.{c}").eqNullSafe(F.col(f"k.{c}")) for c in on])
            met = first.alias("f").join(known.alias("k"), null_safe, "left").select(*[F.col(f"f.{c}").alias(c) for c in on], "first", "bucket", "label")
            alias = spark.read.schema(ALIAS).parquet(f"{target}/alias/{n - 1}")
            met = met.join(alias, "label", "left").withColumn("label", F.coalesce("now", "label")).drop("now")
        else:
            alias = spark.createDataFrame([], ALIAS)
        met = stage(met, "collector")
        null_safe = reduce(lambda a, b: a & b, [F.col(f"r.{c}").eqNullSafe(F.col(f"m.{c}")) for c in on])
        links = rows.where("kind is not null").alias("r").join(met.alias("m"), null_safe).select(F.col("ord").alias("a"), F.col("first").alias("b"))
        links = links.unionByName(met.where("label is not null").select(F.col("first").alias("a"), F.col("label").alias("b")))
        roots = components(links)
        label_of = roots.select("node", "root")
        now = rows.select("ord").distinct().join(label_of, F.col("ord") == F.col("node"), "left").select("ord", F.coalesce("root", "ord").alias("label"))
        _write(now, f"{target}/records/v={n}")
        fresh_keys = met.where("label is null").drop("label").join(label_of, F.col("first") == F.col("node"), "left").select(*on, F.coalesce("root", "first").alias("label"), "bucket")
        _write(fresh_keys, f"{target}/keys/v={n}", ("bucket",))
        moved = met.where("label is not null").select("label").distinct().join(label_of, F.col("label") == F.col("node")).where("root <> label").select("label", F.col("root").alias("now"))
        further = alias.alias("a").join(moved.alias("m"), F.col("a.now") == F.col("m.label"), "left").select(F.col("a.label").alias("label"), F.coalesce("m.now", "a.now").alias("now"))
        _write(further.unionByName(moved), f"{target}/alias/{n}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_clusters(spark: SparkSession, target: str, last_batch: int) -> DataFrame:
    """ord and cluster (the least order of its records) of every record up to a micro-batch."""
    alias = spark.read.schema(ALIAS).parquet(f"{target}/alias/{last_batch}")
    rows = spark.read.schema(RECORDS).parquet(f"{target}/records").where(F.col("v") <= last_batch)
    return rows.join(alias, "label", "left").select("ord", F.coalesce("now", "label").alias("cluster"))


def counts(clusters: DataFrame) -> DataFrame:
    """One row: records scanned, clusters exported and records that are duplicates."""
    return clusters.agg(F.count("*").alias("scanned"), F.count_distinct("cluster").alias("exported")).withColumn("duplicates", F.col("scanned") - F.col("exported"))
