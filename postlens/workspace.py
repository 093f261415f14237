"""The folder that the driver and all executors share, and tables staged in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_STAGED: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """What the session names in spark.checkpoint.dir; a folder of our own only where that is unset on one machine (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="postlens-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write df into the shared folder and read it back: cuts the lineage, survives lost executors. codec: a Parquet compression other than the session's."""
    spark = df.sparkSession
    path = fresh(spark, f"staged/{label}")
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder from whatever store holds it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_staged(spark: SparkSession, since: int = 0, keep_last: int = 0) -> None:
    """Remove the tables staged since a mark (``len_staged``), but for the last ones, once nothing that was made of them will be read again."""
    end = len(_STAGED) - keep_last
    for path in _STAGED[since:end]:
        drop_path(spark, path)
    del _STAGED[since:end]


def len_staged() -> int:
    return len(_STAGED)
