"""Immutable releases behind one pointer, and the dataset registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.operators.publish import content_hash


def publish_release(tables: dict[str, DataFrame], base: str, release_id: str) -> None:
    """Write every table under its release, then switch the pointer. An interrupted call leaves the release before readable.

    The pointer is an append-only one-row table per switch, so that no reader ever finds none.
    """
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{base}/releases/{release_id}/{name}")
    hashes = [(name, *content_hash(spark.read.parquet(f"{base}/releases/{release_id}/{name}"))) for name in sorted(tables)]
    text = ";".join(f"{n}={c}:{h}" for n, c, h in hashes)
    spark.range(1).select(F.lit(release_id).alias("release_id"), F.lit(text).alias("content"), F.current_timestamp().alias("at")).write.mode("append").parquet(f"{base}/current")


def current_release(spark: SparkSession, base: str) -> tuple[str, str] | None:
    """Id and content hash of the release that the pointer names."""
    try:
        row = spark.read.parquet(f"{base}/current").orderBy(F.desc("at"), F.desc("release_id")).first()
    except Exception as e:  # noqa: BLE001  only a missing pointer means nothing is published
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return row.release_id, row.content


def read_release(spark: SparkSession, base: str, table: str) -> DataFrame:
    now = current_release(spark, base)
    if now is None:
        raise ValueError(f"nothing is published in {base}")
    return spark.read.parquet(f"{base}/releases/{now[0]}/{table}")


def publish_if_changed(tables: dict[str, DataFrame], base: str, release_id: str, refresh: bool = False) -> str:
    """Publish, or keep the current release if it has the same content. Returns the id of the release that stands."""
    spark = next(iter(tables.values())).sparkSession
    text = ";".join(f"{n}={':'.join(map(str, content_hash(tables[n])))}" for n in sorted(tables))
    now = current_release(spark, base)
    if now and now[1] == text and not refresh:
        return now[0]
    publish_release(tables, base, release_id)
    return release_id


def import_dataset(registry: DataFrame, dataset: str, batches: DataFrame) -> DataFrame:
    """The registry (id, batch_id) with the batches added; batches that another dataset owns are an error."""
    taken = batches.join(registry.where(F.col("id") != dataset), "batch_id", "left_semi").limit(5).collect()
    if taken:
        raise ValueError(f"owned by another dataset: {[r.batch_id for r in taken]}")
    return registry.unionByName(batches.select(F.lit(dataset).alias("id"), "batch_id")).distinct()
