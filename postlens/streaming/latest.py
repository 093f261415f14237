"""Structured Streaming forms of the incremental operators; each equals its batch form on the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.operators.history import latest_by_key
from postlens.workspace import drop_path


def latest_stream(stream: DataFrame, target: str, checkpoint: str, key: str, valid: str, written: str, id_: str, buckets: int = 64):
    """A query that keeps the latest row of every key in Parquet below ``target``, dealt into buckets by a hash of the key.

    Every micro-batch merges its own latest rows with the stored ones by the batch form's order, so late
    older captures never win, and rewrites only the buckets that it touches. A version is a manifest of one row per
    bucket, written after its data; a repeated batch (after a restart) rewrites its own version alone. Data that
    neither this version nor the one before names is removed.
    """

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = {r[0] for r in rows.select("_bucket").distinct().collect()}  # at most ``buckets``
        before = _manifest(spark, target, n - 1) or {}
        held = _read(spark, target, {b: v for b, v in before.items() if b in touched})
        if held is not None:
            rows = rows.unionByName(held.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")))
        merged = latest_by_key(rows, key, valid, written, id_)
        merged.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{target}/data/v{n}")
        now = before | {b: n for b in touched}
        spark.createDataFrame(sorted(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{target}/manifest/v{n}")
        older = _manifest(spark, target, n - 2) or {}
        for b, v in older.items():
            if before.get(b) != v and now.get(b) != v:
                drop_path(spark, f"{target}/data/v{v}/_bucket={b}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _manifest(spark, target: str, n: int) -> dict[int, int] | None:
    """Bucket to version, of the last version up to n."""
    for v in range(n, -1, -1):
        try:
            return {r.bucket: r.version for r in spark.read.schema("bucket int, version long").parquet(f"{target}/manifest/v{v}").collect()}
        except Exception as e:  # noqa: BLE001  only a missing version is skipped
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return None


def _read(spark, target: str, of: dict[int, int]) -> DataFrame | None:
    paths = [f"{target}/data/v{v}/_bucket={b}" for b, v in sorted(of.items())]
    return spark.read.parquet(*paths) if paths else None


def read_latest(spark, target: str, last_batch: int) -> DataFrame | None:
    return _read(spark, target, _manifest(spark, target, last_batch) or {})


def dedupe_stream(stream: DataFrame, digest: str, time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Each digest once. With a time column the state is bounded: repeats count only within the delay."""
    if time is None:
        return stream.dropDuplicates([digest])
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([digest])


def counts_stream(stream: DataFrame, time: str, window: str, delay: str, by: list[str]) -> DataFrame:
    """Outcomes per time window and columns; late rows beyond the delay are dropped by the watermark."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, window), *by).agg(F.count("*").alias("n"))
