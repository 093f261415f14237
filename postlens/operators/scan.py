"""Scans over the rows of a key in order, for keys of any size.

Rows are range-partitioned by key and order and kept in the shared folder, so that a key with very many rows is
spread over tasks. Every partition is scanned by itself. What a partition has to know of the ones before it is small:
only the key that it begins with can have rows there, so what is carried is one row for each partition and such
key, never more than two for every partition, and may be broadcast at any size of the table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.workspace import stage

PART = "_part"


def deal(df: DataFrame, key: list[str], order: list[Column | str], parts: int | None = None) -> DataFrame:
    """df with the number of the range of (key, order) that a row lies in, staged. The order should part equal rows of a key."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(df.repartitionByRange(n, *key, *order).withColumn(PART, F.spark_partition_id()), "scan")


def same_key(key: list[str], left: str, right: str) -> Column:
    """Null-safe equality of the keys of two aliased tables."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in key])


def spread(dealt: DataFrame, key: list[str]) -> DataFrame:
    """The keys that lie in several partitions, fewer than these, with their rows in all (n_all)."""
    each = dealt.groupBy(*key, PART).agg(F.count("*").alias("_n"))
    return each.groupBy(*key).agg(F.sum("_n").alias("n_all"), F.count("*").alias("_parts")).where("_parts > 1").drop("_parts")


def of_keys(dealt: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """The rows of keys that ``spread`` gives."""
    return dealt.alias("d").join(F.broadcast(keys.select(*key)).alias("k"), same_key(key, "d", "k"), "left_semi")


def scan(df: DataFrame, key: list[str], order: list[Column | str], carry: list[str] = (), parts: int | None = None) -> DataFrame:
    """df with nth (from 1, a row's place in its key), n_key (rows of its key) and before (struct of the columns ``carry`` in the row before it; null for the first)."""
    dealt = deal(df, key, order, parts)
    own = Window.partitionBy(PART, *key)
    inside = own.orderBy(*order)
    held = F.struct(*[F.col(c) for c in carry]) if carry else F.struct(F.lit(1).alias("_one"))
    numbered = lambda rows: rows.withColumns({"_nth": F.row_number().over(inside), "_seg": F.count("*").over(own)})
    wide = spread(dealt, key)
    last = numbered(of_keys(dealt, wide, key)).where("_nth = _seg").select(*key, PART, "_seg", held.alias("_last"))
    earlier = Window.partitionBy(*key).orderBy(PART)
    carried = last.withColumns({
        "_n_before": F.coalesce(F.sum("_seg").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_row_before": F.lag("_last").over(earlier), "_n_all": F.sum("_seg").over(Window.partitionBy(*key)),
    }).select(*key, PART, "_n_before", "_row_before", "_n_all")
    rows = numbered(dealt).withColumn("_lag", F.lag(held).over(inside)).alias("r")
    both = rows.join(F.broadcast(carried).alias("c"), same_key(key, "r", "c") & (F.col(f"r.{PART}") == F.col(f"c.{PART}")), "left")
    out = both.select(
        *[F.col(f"r.{c}") for c in df.columns],
        (F.col("_nth") + F.coalesce("_n_before", F.lit(0))).alias("nth"),
        F.coalesce("_n_all", "_seg").alias("n_key"),
        F.coalesce("_lag", "_row_before").alias("before"),
    )
    return out if carry else out.drop("before")
