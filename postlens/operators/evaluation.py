"""Evaluation of predicted listings against a reviewed corpus, from end to end, in joins and aggregates.

A sample may have several acceptable answers (alternatives). Listings of an answer and of the prediction are put in the order
of their canonical anchors and face each other place by place; every field of every place is a check. The alternative with most
right checks counts, the first of equals; missed and unmatched listings are differences of bags of anchors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REVIEWED_AT_LEAST = 30


def _placed(listings: DataFrame, by: list[str]) -> DataFrame:
    return listings.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy("anchor", "pos")))


def _bags(expected: DataFrame, actual: DataFrame, pairs: DataFrame) -> DataFrame:
    """missed and unmatched of every (id, alt) of pairs."""
    e = expected.groupBy("id", "alt", "anchor").agg(F.count("*").alias("_e"))
    a = pairs.join(actual, "id").groupBy("id", "alt", "anchor").agg(F.count("*").alias("_a"))
    both = e.join(a, ["id", "alt", "anchor"], "full_outer").fillna(0, ["_e", "_a"])
    return both.groupBy("id", "alt").agg(F.sum(F.greatest(F.col("_e") - F.col("_a"), F.lit(0))).alias("missed"), F.sum(F.greatest(F.col("_a") - F.col("_e"), F.lit(0))).alias("unmatched"))


def score(alternatives: DataFrame, expected: DataFrame, predicted: DataFrame, actual: DataFrame, fields: list[str]) -> DataFrame:
    """One row per (id, alt) of the valid predictions: right_<field>, checks, classified, missed, unmatched and score."""
    pairs = alternatives.join(predicted.where("valid").select("id", F.col("is_recruitment").alias("_said")), "id")
    own = pairs.select("id", "alt")
    e = _placed(expected.join(own, ["id", "alt"], "left_semi"), ["id", "alt"]).select("id", "alt", "_place", F.struct(*fields).alias("_e"))
    a = own.join(_placed(actual, ["id"]), "id").select("id", "alt", "_place", F.struct(*fields).alias("_a"))
    faced = e.join(a, ["id", "alt", "_place"], "full_outer")
    there = F.col("_e").isNotNull() & F.col("_a").isNotNull()
    right = [F.count_if(there & F.col(f"_e.{f}").eqNullSafe(F.col(f"_a.{f}"))).alias(f"right_{f}") for f in fields]
    checks = faced.groupBy("id", "alt").agg(F.count("*").alias("checks"), *right)
    out = pairs.join(checks, ["id", "alt"], "left").join(_bags(expected.join(own, ["id", "alt"], "left_semi"), actual, own), ["id", "alt"], "left")
    out = out.fillna(0, ["checks", "missed", "unmatched", *[f"right_{f}" for f in fields]]).withColumn("classified", F.coalesce(F.col("is_recruitment") == F.col("_said"), F.lit(False)))
    total = F.lit(0)
    for f in fields:
        total = total + F.col(f"right_{f}")
    return out.withColumn("score", total + F.col("classified").cast("long")).drop("_said")


def best(scores: DataFrame) -> DataFrame:
    """The alternative with the best score, the first of equals, of every sample."""
    w = Window.partitionBy("id").orderBy(F.desc("score"), "alt")
    return scores.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def cases(samples: DataFrame, alternatives: DataFrame, expected: DataFrame, predicted: DataFrame, actual: DataFrame, fields: list[str]) -> DataFrame:
    """One row per sample: status, missed, unmatched, classified and wrong_fields; what a status does not know is null.

    samples: id, reviewed; alternatives: id, alt, is_recruitment; expected: id, alt, pos, anchor and the fields; predicted:
    id, valid, is_recruitment (one row an id); actual: id, pos, anchor and the fields. A reviewed sample has an alternative.
    """
    chosen = best(score(alternatives, expected, predicted, actual, fields))
    wrong = F.array_compact(F.array(*[F.when(F.col(f"right_{f}") < F.col("checks"), F.lit(f)) for f in fields]))
    judged = chosen.select("id", "missed", "unmatched", "classified", wrong.alias("wrong_fields"))
    counts = alternatives.join(expected.groupBy("id", "alt").agg(F.count("*").alias("_n")), ["id", "alt"], "left").groupBy("id").agg(F.min(F.coalesce("_n", F.lit(0))).alias("_fewest"))
    able = F.coalesce(F.col("reviewed"), F.lit(False)) & F.col("_fewest").isNotNull()
    both = samples.join(counts, "id", "left").join(predicted.select("id", "valid"), "id", "left").join(judged, "id", "left")
    passed = F.col("classified") & (F.size("wrong_fields") == 0)
    status = F.when(~able, "awaiting_human_annotation").when(F.col("valid").isNull(), "missing_result").when(~F.col("valid"), "invalid_result").when(passed, "passed").otherwise("semantic_mismatch")
    known = lambda c: F.when(able & F.col("valid"), F.col(c))
    return both.select(
        "id", status.alias("status"), F.when(able & F.col("valid").isNull(), F.col("_fewest")).otherwise(known("missed")).cast("long").alias("missed"),
        known("unmatched").cast("long").alias("unmatched"), known("classified").alias("classified"), known("wrong_fields").alias("wrong_fields"),
    )


def accuracy(samples: DataFrame, alternatives: DataFrame, expected: DataFrame, predicted: DataFrame, actual: DataFrame, fields: list[str]) -> DataFrame:
    """field, correct, total and accuracy (null without checks) of the best alternatives of reviewed samples."""
    chosen = best(score(alternatives.join(samples.where("reviewed").select("id"), "id", "left_semi"), expected, predicted, actual, fields))
    each = chosen.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"right_{f}").alias("right"), "checks") for f in fields])).alias("c"))
    sums = each.groupBy("c.field").agg(F.sum("c.right").alias("correct"), F.sum("c.checks").alias("total"))
    return sums.withColumn("accuracy", F.try_divide(F.col("correct"), F.col("total")))


def covered(samples: DataFrame) -> Column:
    """The categories that a sample stands for: ``truncated`` only where its context is."""
    return F.filter(F.coalesce("categories", F.array().cast("array<string>")), lambda c: (c != "truncated") | F.coalesce(samples["truncated"], F.lit(False)))


def report(samples: DataFrame, judged: DataFrame, required: list[str], least: int = REVIEWED_AT_LEAST) -> DataFrame:
    """One row: samples, reviewed, missing_categories, missed and unmatched listings, and whether the corpus passes. judged: of ``cases``."""
    done = judged.where("status <> 'awaiting_human_annotation'").select("id")
    own = samples.join(done, "id", "left_semi")
    # each required category is one row; the categories of all samples never meet in one list
    seen = own.select(F.explode(covered(own)).alias("category")).where(F.col("category").isin(*required)).distinct().agg(F.collect_set("category").alias("seen"))
    counts = judged.agg(
        F.count("*").alias("samples"), F.count_if(F.col("status") != "awaiting_human_annotation").alias("reviewed"), F.coalesce(F.sum("missed"), F.lit(0)).alias("missed"),
        F.coalesce(F.sum("unmatched"), F.lit(0)).alias("unmatched"), F.count_if(F.col("status") != "passed").alias("_failed"),
    )
    both = counts.withColumn("_k", F.lit(1)).join(seen.withColumn("_k", F.lit(1)), "_k")
    lacking = F.array_sort(F.array_except(F.array(*[F.lit(c) for c in required]), F.col("seen")))
    return both.withColumn("missing_categories", lacking).select("samples", "reviewed", "missing_categories", "missed", "unmatched", ((F.col("reviewed") >= least) & (F.size("missing_categories") == 0) & (F.col("_failed") == 0)).alias("passed"))
