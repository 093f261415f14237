"""Quality of predicted records against reviewed ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.operators.joins import check_joined, duplicates, join_by_id


def field_accuracy(both: DataFrame, fields: list[str], expected: str = "expected_", actual: str = "actual_") -> DataFrame:
    """field, correct, total and accuracy (null where nothing was expected), null-safe."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(expected + f).eqNullSafe(F.col(actual + f)).alias("ok"), F.col(expected + f).isNotNull().alias("known")) for f in fields])).alias("p")
    return both.select(pairs).groupBy("p.field").agg(F.count_if(F.col("p.ok") & F.col("p.known")).alias("correct"), F.count_if("p.known").alias("total")).withColumn("accuracy", F.try_divide(F.col("correct"), F.col("total")))


def missed_and_unmatched(expected: DataFrame, actual: DataFrame, anchor: list[str]) -> DataFrame:
    """One row: how many expected records were missed, and how many actual ones match none, as bags."""
    e = expected.groupBy(*anchor).agg(F.count("*").alias("_e"))
    a = actual.groupBy(*anchor).agg(F.count("*").alias("_a"))
    both = e.join(a, anchor, "full_outer").fillna(0, ["_e", "_a"])
    return both.agg(F.sum(F.greatest(F.col("_e") - F.col("_a"), F.lit(0))).alias("missed"), F.sum(F.greatest(F.col("_a") - F.col("_e"), F.lit(0))).alias("unmatched"))


def best_alternative(scores: DataFrame, sample: str, score: str, index: str) -> DataFrame:
    """The acceptable alternative with the best score; the first of equals."""
    w = Window.partitionBy(sample).orderBy(F.desc(score), index)
    return scores.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def sample_status(gold: DataFrame, predicted: DataFrame, id_: str, reviewed: str, valid: str, matches: str) -> DataFrame:
    """id and status of every gold sample."""
    both = gold.join(predicted, id_, "left")
    status = F.when(~F.coalesce(F.col(reviewed), F.lit(False)), "awaiting_human_annotation").when(F.col(valid).isNull(), "missing_result").when(~F.col(valid), "invalid_result").when(F.col(matches), "passed").otherwise("semantic_mismatch")
    return both.select(id_, status.alias("status"))


def sample_problems(gold: DataFrame, predicted: DataFrame, id_: str) -> DataFrame:
    """problem and id of what makes an evaluation invalid: predictions for unknown samples, and ids that occur twice on either side.

    A sample without a prediction is no problem but a case of its own (sample_status).
    """
    found = check_joined(join_by_id(gold, predicted, id_), id_, allow_partial=True)
    twice = duplicates(gold, id_).select(F.lit("duplicate sample").alias("problem"), F.col(id_).cast("string").alias("id"))
    return found.unionByName(twice)


def gate(samples: DataFrame, required: list[str], categories: str = "categories", reviewed: str = "reviewed", status: str = "status", least: int = 30) -> DataFrame:
    """One row: enough reviewed samples, all categories covered, all passed, and all three."""
    own = samples.where(F.col(reviewed))
    seen = F.array_distinct(F.flatten(F.collect_set(categories)))
    out = own.agg(F.count("*").alias("reviewed"), F.array_sort(F.array_except(F.array(*[F.lit(r) for r in required]), seen)).alias("missing_categories"), F.coalesce(F.bool_and(F.col(status) == "passed"), F.lit(False)).alias("all_passed"))
    return out.withColumn("ready", (F.col("reviewed") >= least) & (F.size("missing_categories") == 0) & F.col("all_passed"))
