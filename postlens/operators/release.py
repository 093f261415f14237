"""Whole releases: staged publication, its report, and whether its products agree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.operators.joins import duplicates
from postlens.operators.publish import resolve_publication
from postlens.sources.releases import publish_if_changed


def same_tables(expected: dict[str, DataFrame], published: dict[str, DataFrame]) -> DataFrame:
    """product, missing and extra: rows that a product should have and lacks, and those it should not have, as bags.

    A product that one side lacks altogether counts all rows of the other.
    """
    parts = []
    for name in sorted({*expected, *published}):
        a, b = expected.get(name), published.get(name)
        a, b = (b.limit(0) if a is None else a), (a.limit(0) if b is None else b)
        rows = a.exceptAll(b).select(F.lit(1).alias("side")).unionByName(b.exceptAll(a).select(F.lit(2).alias("side")))
        parts.append(rows.agg(F.count_if(F.col("side") == 1).alias("missing"), F.count_if(F.col("side") == 2).alias("extra")).select(F.lit(name).alias("product"), "missing", "extra"))
    return reduce(DataFrame.unionByName, parts)


def consistency(posts: DataFrame, batches: DataFrame, listings: DataFrame, report: DataFrame, post: str, batch: str, index: str, analysed: str, recruitment: str) -> DataFrame:
    """check and n: how many rows of a release break each rule; all zero means that its products agree.

    report has one row of posts, listings and analysed as published. Rules: posts and batches occur once, posts name
    known batches, listings name known recruitment posts, a post's listings are numbered from 0 without
    gaps, and the report's numbers are those of the tables.
    """
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
    # distinct numbers are the bits of words of 64, so that an aggregate has a row per word, not one per listing
    at = F.col(index).cast("long")
    words = listings.groupBy(post, F.shiftright(at, 6).alias("_w")).agg(F.count("*").alias("_n"), F.bit_or(F.expr(f"shiftleft(1L, cast(cast(`{index}` as bigint) & 63 as int))")).alias("_bits"), F.min(index).alias("_a"), F.max(index).alias("_b"))
    numbered = words.groupBy(post).agg(F.sum("_n").alias("_n"), F.sum(F.coalesce(F.bit_count("_bits"), F.lit(0))).alias("_d"), F.min("_a").alias("_a"), F.max("_b").alias("_b"))
    counted = posts.agg(F.count("*").alias("posts"), F.count_if(F.coalesce(F.col(analysed), F.lit(False))).alias("analysed"))
    counted = counted.unionByName(listings.agg(F.count("*").alias("listings")), allowMissingColumns=True)
    totals = counted.agg(*[F.max(c).alias(c) for c in ("posts", "listings", "analysed")])
    figures = ("posts", "listings", "analysed")
    said, real = report.select(*[F.col(c).alias(f"said_{c}") for c in figures]).withColumn("_k", F.lit(1)), totals.withColumn("_k", F.lit(1))
    wrong = said.join(real, "_k").select(F.explode(F.array(*[F.col(f"said_{c}").eqNullSafe(F.col(c)) for c in figures])).alias("right")).where("not right")
    checks = [
        n(duplicates(posts, post), "repeated_post"),
        n(duplicates(batches, batch), "repeated_batch"),
        n(posts.join(batches, batch, "left_anti"), "unknown_batch"),
        n(listings.join(posts, post, "left_anti"), "unknown_post"),
        n(listings.join(posts.where(~F.coalesce(F.col(recruitment), F.lit(False))), post, "left_semi"), "listing_of_other_post"),
        n(numbered.where("_d <> _n or _a <> 0 or _b <> _n - 1"), "listing_numbers"),
        n(wrong, "report_numbers"),
    ]
    return reduce(DataFrame.unionByName, checks)


def target_states(latest: DataFrame, tasks: DataFrame, shown: DataFrame, key: str, observation: str) -> DataFrame:
    """One row per latest target: its task's status (pending if the task is of another observation), published, stale and needs_review.

    tasks: one current task per key (observation, task_id, status, reused_from, needs_review); shown: keys that the
    release shows.
    """
    own = tasks.select(key, observation, "task_id", F.col("status").alias("_status"), "reused_from", "needs_review")
    both = latest.join(own, [key, observation], "left").join(shown.select(key).distinct().withColumn("published", F.lit(True)), key, "left")
    ready = F.coalesce(F.col("_status") == "succeeded", F.lit(False))
    published = F.coalesce("published", F.lit(False))
    return both.select(
        key, observation, "task_id", F.coalesce("_status", F.lit("pending")).alias("status"), (ready & F.col("reused_from").isNotNull()).alias("reused"),
        (ready & F.coalesce("needs_review", F.lit(False))).alias("needs_review"), published.alias("published"), (published & ~ready).alias("stale"),
    )


def task_report(states: DataFrame) -> DataFrame:
    """One row of counts over the states of all targets; partial if any is incomplete."""
    n = lambda v: F.count_if(F.col("status") == v).alias(v)
    flag = lambda c: F.count_if(c).alias(c)
    partial = F.coalesce(F.bool_or(F.col("status") != "succeeded"), F.lit(False)).alias("partial")
    return states.agg(F.count("*").alias("total"), n("pending"), n("running"), n("succeeded"), n("failed"), *[flag(c) for c in ("reused", "needs_review", "published", "stale")], partial)


def staged_publication(latest: DataFrame, ready: DataFrame, previous: DataFrame | None, base: str, release_id: str, key: str, observation: str, refresh: bool = False) -> str:
    """Publish, for every latest observation, its own result or else the last published one, and name the release that stands.

    A result of an older observation is ignored however late it comes; a post whose latest result withdraws it
    (``withdrawn``) is left out; a post that is no longer observed goes. Equal content keeps the release.
    """
    old = latest.select(key).limit(0).withColumn("result", F.lit(None).cast(ready.schema["result"].dataType)) if previous is None else previous.select(key, "result")
    chosen = resolve_publication(latest, ready.drop("withdrawn"), old, key, observation)
    gone = ready.where("withdrawn").select(key, observation)
    kept = chosen.join(gone, [key, observation], "left_anti").where("result is not null").select(key, observation, "result", "state")
    return publish_if_changed({"posts": kept}, base, release_id, refresh)
