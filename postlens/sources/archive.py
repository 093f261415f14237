"""An archive laid out for keyed lookups: rows sorted within ranges of the key, and a Bloom filter of the keys of every row group.

Spark's own scan then skips files and row groups: sorted ranges give narrow minima and maxima, and page indexes inside them; the filters answer for a
key that lies between a group's bounds without being there. A lookup of some keys reads the groups that may hold them and no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a row group: small, so that a hit reads little; and keys looked up by a filter at most, which Spark pushes down as a list.
GROUP_BYTES = 16 << 20
PUSHED = 1000


def write_archive(df: DataFrame, path: str, key: str, order: list[str] = (), parts: int | None = None, keys_per_group: int = 100_000, mode: str = "append", group_bytes: int = GROUP_BYTES) -> None:
    """Adds rows to an archive, range-partitioned and sorted by key and then order. A key of very many rows is parted by the order."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order)
    writer = dealt.write.mode(mode).option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", str(keys_per_group))
    writer.option("parquet.block.size", str(group_bytes)).parquet(path)


def look_up(spark: SparkSession, path: str, key: str, values: list) -> DataFrame:
    """The rows of some keys, by a filter that the scan prunes by."""
    if len(values) > PUSHED:
        raise ValueError(f"more than {PUSHED} keys are a table of their own: join it with look_up_table")
    return spark.read.parquet(path).where(F.col(key).isin(*values))


def look_up_table(spark: SparkSession, path: str, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of a table of keys. Bounds of the keys, one row of minimum and maximum, prune the scan before the join."""
    low, high = wanted.agg(F.min(key), F.max(key)).first()
    rows = spark.read.parquet(path)
    if low is None:
        return rows.limit(0)
    return rows.where(F.col(key).between(low, high)).join(wanted.select(key).distinct(), key, "left_semi")


def rows_read(df: DataFrame) -> int:
    """Rows that the scans of a DataFrame gave when it is run: what pruning has left. For tests and checks of a layout."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    leaves = plan.collectLeaves()
    return sum(int(leaves.apply(i).metrics().apply("numOutputRows").value()) for i in range(leaves.size()) if leaves.apply(i).metrics().contains("numOutputRows"))
