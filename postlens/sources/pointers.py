"""Publication as compare-and-set: numbered pointers that only one writer can create, and folders bound to one publication.

A release is written first and named last, by a file ``pointers/<number>`` that Hadoop's file system creates only where there is none: of two writers
that begin from the same number one is refused. A pointer without its text (its writer was interrupted) names nothing, so the one before it
stands until ``repair`` removes it. The store has to create files exclusively, as HDFS does.
"""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.operators.publish import content_hash


class PublicationConflict(ValueError):
    """Another writer was first, or the folder belongs to another publication."""


def _store(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file if there is none of that name; whether it did."""
    fs, where = _store(spark, path)
    try:
        out = fs.create(where, False)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def _text(spark: SparkSession, path: str) -> str | None:
    fs, where = _store(spark, path)
    if not fs.exists(where):
        return None
    file = fs.open(where)
    try:
        return bytes(file.readAllBytes()).decode()
    finally:
        file.close()


def _numbers(spark: SparkSession, base: str) -> list[int]:
    fs, where = _store(spark, f"{base}/pointers")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(where) if f.getPath().getName().isdigit()) if fs.exists(where) else []


def _pointer(spark: SparkSession, base: str, n: int) -> dict | None:
    try:
        return json.loads(_text(spark, f"{base}/pointers/{n:012d}") or "")
    except ValueError:
        return None  # its writer was interrupted


def current(spark: SparkSession, base: str) -> tuple[int, dict | None]:
    """The newest whole pointer: its number (0 before the first) and what it names (release_id, parent, content)."""
    for n in reversed(_numbers(spark, base)):
        found = _pointer(spark, base, n)
        if found:
            return n, found
    return 0, None


def bind(spark: SparkSession, base: str, publication: str) -> None:
    """Binds a folder to one publication, for good; another one is refused."""
    if not _create(spark, f"{base}/BOUND", publication) and _text(spark, f"{base}/BOUND") != publication:
        raise PublicationConflict(f"{base} belongs to {_text(spark, f'{base}/BOUND')}, not to {publication}")


def publish(tables: dict[str, DataFrame], base: str, release_id: str, parent: int) -> int:
    """Writes a release and names it, if the pointer still is ``parent``. Gives the new number, or raises PublicationConflict."""
    spark = next(iter(tables.values())).sparkSession
    if current(spark, base)[0] != parent:
        raise PublicationConflict(f"the release to follow is number {current(spark, base)[0]}, not {parent}")
    content = {}
    for name, df in sorted(tables.items()):
        path = f"{base}/releases/{release_id}/{name}"
        df.write.mode("errorifexists").parquet(path)
        content[name] = list(content_hash(spark.read.parquet(path)))
    text = json.dumps({"release_id": release_id, "parent": parent, "content": content}, sort_keys=True)
    if not _create(spark, f"{base}/pointers/{parent + 1:012d}", text):
        raise PublicationConflict(f"another writer has followed number {parent}")
    return parent + 1


def repair(spark: SparkSession, base: str) -> list[int]:
    """Removes pointers after the current one whose writers were interrupted. Gives their numbers."""
    now = current(spark, base)[0]
    gone = [n for n in _numbers(spark, base) if n > now]
    for n in gone:
        fs, where = _store(spark, f"{base}/pointers/{n:012d}")
        fs.delete(where, False)
    return gone


def read_table(spark: SparkSession, base: str, table: str) -> DataFrame:
    n, found = current(spark, base)
    if not found:
        raise ValueError(f"nothing is published in {base}")
    return spark.read.parquet(f"{base}/releases/{found['release_id']}/{table}")


def reconciled(spark: SparkSession, base: str, publications: DataFrame) -> DataFrame:
    """publications (publication_id, status) with the ones that a pointer names as published, even if their status was not written."""
    named = [p["release_id"] for n in _numbers(spark, base) if (p := _pointer(spark, base, n))]  # one a release
    return publications.withColumn("status", F.when(F.col("publication_id").isin(*named), "published").otherwise(F.col("status")))
