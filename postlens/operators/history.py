"""Observation history: the latest row of every key, versions, identity lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.operators.scan import scan

MOST = 10_000


def require_limit(n: int, most: int = MOST) -> int:
    if not 1 <= n <= most:
        raise ValueError(f"limit must be from 1 to {most}, not {n}")
    return n


def latest_order(valid: str, written: str, id_: str) -> list[Column]:
    """Newest capture first, invalid times last, then the later write, then the larger id."""
    return [F.desc_nulls_last(valid), F.desc(written), F.desc(id_)]


def latest_by_key(df: DataFrame, key: str, valid: str, written: str, id_: str) -> DataFrame:
    """One row per key. An older capture that arrives late never replaces a newer one."""
    w = Window.partitionBy(key).orderBy(*latest_order(valid, written, id_))
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def latest_all(df: DataFrame, valid: str, written: str, id_: str) -> DataFrame:
    return df.orderBy(*latest_order(valid, written, id_))


def latest_of_group(df: DataFrame, key: str, group: Column, valid: str, written: str, id_: str, limit: int = 50) -> DataFrame:
    """The latest rows of a group, newest first."""
    return latest_all(latest_by_key(df, key, valid, written, id_).where(group), valid, written, id_).limit(require_limit(limit))


def history(df: DataFrame, key: Column, written: str, id_: str, limit: int = 50) -> DataFrame:
    """All observations that meet a condition on the key, newest write first."""
    return df.where(key).orderBy(F.desc(written), F.desc(id_)).limit(require_limit(limit))


def lookup(df: DataFrame, id_: str, value) -> DataFrame:
    """The row of an id; an id that is not there is an error when the row is computed."""
    found = df.where(F.col(id_) == value)
    n = found.groupBy().agg(F.count("*").alias("_n")).select(F.assert_true(F.col("_n") == 1, F.lit(f"{id_} {value} is not there exactly once")).alias("_ok"))
    return found.join(F.broadcast(n), F.coalesce(F.col("_ok"), F.lit(True)).cast("boolean")).drop("_ok")


def ordinal(df: DataFrame, group: str, id_: str) -> DataFrame:
    """0-based position of each row in its import, of any size."""
    return scan(df, [group], [id_]).withColumn("ordinal", F.col("nth") - 1).drop("nth", "n_key")


def versions(df: DataFrame, key: str, order: list[str], watched: dict[str, str]) -> DataFrame:
    """A version number per key, and for every watched column a flag (watched: flag name to column) of change since the version before."""
    seen = scan(df, [key], order, carry=list(dict.fromkeys(watched.values())))
    flags = {flag: F.when(F.col("before").isNotNull(), ~F.col(c).eqNullSafe(F.col("before")[c])).otherwise(False) for flag, c in watched.items()}
    return seen.withColumns({"version": F.col("nth"), **flags}).drop("nth", "n_key", "before")


def observation_view(df: DataFrame, valid: str, kind: str, truncated: str) -> DataFrame:
    """Adds quality_warnings, in a fixed order."""
    warn = lambda c, name: F.when(c, F.lit(name))
    return df.withColumn(
        "quality_warnings",
        F.array_compact(F.array(warn(F.col(valid).isNull(), "invalid_scraped_at"), warn(F.col(kind) == "fingerprint", "fingerprint_identity"), warn(F.coalesce(truncated, F.lit(False)), "source_content_truncated"))),
    )


def latest_of_batches(df: DataFrame, batches: DataFrame, key: str, batch: str, valid: str, written: str, id_: str) -> DataFrame:
    """The latest row of every key seen in the batches, even if that row is from another batch."""
    seen = df.join(batches.select(batch).distinct(), batch, "left_semi").select(key).distinct()
    return latest_by_key(df, key, valid, written, id_).join(seen, key, "left_semi")
