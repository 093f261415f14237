"""Publication: which result each post shows, releases and their reports."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve_publication(latest: DataFrame, ready: DataFrame, previous: DataFrame, key: str, observation: str) -> DataFrame:
    """Per latest observation: result and state.

    published: a success of that very observation; stale: none, but the post was published before; else unpublished.
    """
    now = ready.select(key, observation, F.col("result").alias("_now"))
    old = previous.select(key, F.col("result").alias("_old"))
    both = latest.join(now, [key, observation], "left").join(old, key, "left")
    state = F.when(F.col("_now").isNotNull(), "published").when(F.col("_old").isNotNull(), "stale").otherwise("unpublished")
    return both.withColumns({"state": state, "result": F.coalesce("_now", "_old")}).drop("_now", "_old")


def can_refresh(a: DataFrame, b: DataFrame, id_: str, columns: list[str]) -> DataFrame:
    """id and same: whether all the columns agree, null-safe."""
    both = a.alias("a").join(b.alias("b"), id_)
    same = F.lit(True)
    for c in columns:
        same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return both.select(id_, same.alias("same"))


def listings(joined: DataFrame, analysis: str = "analysis") -> DataFrame:
    """One row per listing of recruitment posts, with listing_index from 0; others withdraw theirs."""
    return joined.where(F.col(f"{analysis}.is_recruitment")).select("*", F.posexplode(f"{analysis}.listings").alias("listing_index", "listing"))


def split_by_type(df: DataFrame, type_: str = "listing_type", plain: str = "session", others: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The main table (plain or unknown type) and one table per other type."""
    return {"main": df.where(F.col(type_).isNull() | (F.col(type_) == plain)), **{t: df.where(F.col(type_) == t) for t in others}}


def count_by(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy(value).agg(F.count("*").alias("n"))


def warning_histogram(df: DataFrame, warnings: str) -> DataFrame:
    return df.select(F.explode(warnings).alias("warning")).groupBy("warning").agg(F.count("*").alias("n"))


def publication_stats(df: DataFrame, batch: str, post: str, analysed: str, recruitment: str, status: str, contact: dict[str, str] | None = None, types: tuple[str, list[str]] | None = None) -> DataFrame:
    """One row of counts over listings with their posts.

    contact: output name to (a condition, as SQL) of each kind of contactability; types: the type column and the types that
    have tables of their own, whose rows are counted by type and not as listings.
    """
    more = []
    own = F.lit(True)
    if types:
        type_, names = types
        own = ~F.coalesce(F.col(type_).isin(*names), F.lit(False))
        more += [F.count("*").alias("total_records"), *[F.count_if(F.col(type_) == t).alias(f"table_{t}") for t in names]]
    known, is_, not_ = F.coalesce(F.col(analysed), F.lit(False)), F.col(recruitment), ~F.col(recruitment)
    distinct = lambda c: F.count_distinct(F.when(c, F.col(post)))
    if contact:
        more += [distinct(known & not_).alias("non_recruitment"), distinct(~known).alias("unanalysed"), *[F.count_if(own & F.expr(c)).alias(name) for name, c in contact.items()]]
    return df.agg(
        F.count_distinct(batch).alias("batches"), F.count_distinct(post).alias("posts"), distinct(F.col(analysed)).alias("analysed"),
        distinct(is_).alias("recruitment"), F.count_if(own).alias("listings"),
        F.count_if(own & (F.col(status) == "duplicate")).alias("duplicates"), F.count_if(own & (F.col(status) == "possible_duplicate")).alias("possible_duplicates"), *more,
    )


def row_text(df: DataFrame) -> Column:
    """A row as JSON with every column, null ones too, so that values are told apart by name, kind and being known."""
    return F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"})


def content_digests(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Rows (n) and an order-free digest (d1 to d4) of a table, or of each group of it: sums of the quarters of the rows' SHA-256.

    Equal bags of rows have equal digests, in whatever order and partitions; n and n + 1 copies of a row differ.
    """
    quarters = df.select(*by, F.sha2(row_text(df), 256).alias("_h"))
    sums = [F.coalesce(F.sum(F.conv(F.substring("_h", 16 * k + 1, 16), 16, 10).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias(f"d{k + 1}") for k in range(4)]
    return quarters.groupBy(*by).agg(F.count("*").alias("n"), *sums)


def content_hash(df: DataFrame) -> tuple[int, str]:
    """Row count and an order-free hash of a table with its columns and types: equal tables have equal ones."""
    n, *sums = content_digests(df).first()
    kinds = hashlib.sha256(df.schema.simpleString().encode()).hexdigest()[:16]
    return n, ":".join([kinds, *map(str, sums)])


def dataset_overview(datasets: DataFrame, releases: DataFrame, id_: str) -> DataFrame:
    """Every dataset with its latest release's numbers, or ``not published``."""
    both = datasets.join(releases, id_, "left")
    return both.withColumn("state", F.when(F.col("released_at").isNull(), "not published").otherwise("published"))


def reconcile(publications: DataFrame, current: str) -> DataFrame:
    """Publications with the one that the pointer names as published, even if its status was not written."""
    return publications.withColumn("status", F.when(F.col("publication_id") == current, "published").otherwise(F.col("status")))


def add_dataset_columns(listings: DataFrame, registry: DataFrame, batch: str = "batch_id") -> DataFrame:
    """dataset_id and dataset_name of each row's batch; null where no dataset owns it. Nothing else is filled in."""
    names = registry.select(F.col("batch_id").alias(batch), F.col("id").alias("dataset_id"), F.col("name").alias("dataset_name"))
    return listings.join(names, batch, "left")
