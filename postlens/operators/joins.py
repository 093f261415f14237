"""Joins by id with their error sets, and comparisons of two record sets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Joined:
    """What joined, and the ids that should not be there or are missing."""

    rows: DataFrame
    unknown: DataFrame
    missing: DataFrame
    duplicates: DataFrame


def duplicates(df: DataFrame, id_: str) -> DataFrame:
    """id and n of every id that occurs more than once."""
    return df.groupBy(id_).agg(F.count("*").alias("n")).where("n > 1")


def join_by_id(source: DataFrame, results: DataFrame, id_: str) -> Joined:
    """Every source row with its result, if there is one; no row is lost or invented."""
    return Joined(
        source.join(results, id_, "left"),
        results.select(id_).join(source.select(id_), id_, "left_anti").distinct(),
        source.select(id_).join(results.select(id_), id_, "left_anti").distinct(),
        duplicates(results, id_),
    )


def join_report(j: Joined, id_: str, matched: str) -> DataFrame:
    """One row: source rows, matched, missing, unknown and duplicate ids. matched: a column that only results have."""
    count = lambda df, name, c="*": df.agg(F.count(c).alias("n")).select(F.lit(name).alias("name"), "n")
    parts = count(j.rows, "sources").unionByName(count(j.rows, "matched", matched))
    for name, df in (("missing", j.missing), ("unknown", j.unknown), ("duplicate", j.duplicates)):
        parts = parts.unionByName(count(df, name))
    return parts.agg(*[F.max(F.when(F.col("name") == n, F.col("n"))).alias(n) for n in ("sources", "matched", "missing", "unknown", "duplicate")])


def check_joined(j: Joined, id_: str, allow_partial: bool = False) -> DataFrame:
    """The ids that make a join invalid: (problem, id)."""
    parts = [("unknown", j.unknown), ("duplicate", j.duplicates)] + ([] if allow_partial else [("missing", j.missing)])
    out = None
    for name, df in parts:
        part = df.select(F.lit(name).alias("problem"), F.col(id_).cast("string").alias("id"))
        out = part if out is None else out.unionByName(part)
    return out


def mismatches(a: DataFrame, b: DataFrame, id_: str) -> DataFrame:
    """id and side (only_a, only_b or differs) of rows that two sets do not share."""
    columns = [c for c in a.columns if c != id_]
    left = a.select(id_, F.to_json(F.struct(*columns)).alias("a"))
    right = b.select(id_, F.to_json(F.struct(*columns)).alias("b"))
    side = F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b").otherwise("differs")
    return left.join(right, id_, "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select(id_, side.alias("side"))


def bag_difference(expected: DataFrame, actual: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows expected but not there, and there but not expected, each as often as that."""
    return expected.exceptAll(actual), actual.exceptAll(expected)


def align(expected: DataFrame, actual: DataFrame, keys: list[str], items: str) -> DataFrame:
    """Expected and actual arrays side by side by position; a side that is shorter is null."""
    left = expected.select(*keys, F.posexplode(items).alias("position", "expected"))
    right = actual.select(*keys, F.posexplode(items).alias("position", "actual"))
    return left.join(right, [*keys, "position"], "full_outer")


def left_lookup(df: DataFrame, ids: str, other: DataFrame, id_: str, prefix: str) -> DataFrame:
    """One row per id in an array column, with the other table's columns beside it."""
    named = other.select(F.col(id_).alias("_id"), *[F.col(c).alias(prefix + c) for c in other.columns if c != id_])
    return df.withColumn("_id", F.explode_outer(ids)).join(named, "_id", "left").withColumnRenamed("_id", prefix + id_)


def batch_lookup(source: DataFrame, batches: DataFrame, batch: str, post: str) -> Joined:
    """Source rows with their batch's columns; unknown: batches that rows name but no table has; duplicates: posts or batches that occur twice.

    missing: batches without any post. Spark broadcasts the batches where their size is known to be small.
    """
    twice = duplicates(source, post).select(F.lit("post").alias("kind"), F.col(post).cast("string").alias("id"), "n")
    twice = twice.unionByName(duplicates(batches, batch).select(F.lit("batch").alias("kind"), F.col(batch).cast("string").alias("id"), "n"))
    named = source.select(batch).distinct()
    return Joined(source.join(batches, batch), named.join(batches.select(batch), batch, "left_anti"), batches.select(batch).join(named, batch, "left_anti").distinct(), twice)


def missing_from(part: DataFrame, whole: DataFrame, id_: str) -> DataFrame:
    """Ids of a part that the whole lacks; no rows means it is a subset."""
    return part.select(id_).distinct().join(whole.select(id_), id_, "left_anti")


def same_ids(a: DataFrame, b: DataFrame, id_: str) -> DataFrame:
    """id and side (only_a, only_b) of ids that two results do not share, whatever their order; no rows means the same set."""
    left, right = a.select(id_).distinct().withColumn("_a", F.lit(True)), b.select(id_).distinct().withColumn("_b", F.lit(True))
    return left.join(right, id_, "full_outer").where("_a is null or _b is null").select(id_, F.when(F.col("_b").isNull(), "only_a").otherwise("only_b").alias("side"))


def keys_of_batches(df: DataFrame, key: str, batch: str, batches: list) -> DataFrame:
    """The distinct keys that any of the batches has."""
    return df.where(F.col(batch).isin(*batches)).select(key).distinct()


def distinct_counts(df: DataFrame, by: list[str] | None = None, **columns: str) -> DataFrame:
    """The number of distinct values of columns, over all rows or by others."""
    return df.groupBy(*by or []).agg(*[F.count_distinct(c).alias(name) for name, c in columns.items()])
