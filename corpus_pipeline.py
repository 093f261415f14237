"""A training-data pipeline over ``documents``: five stages, each one operator of postlens.llm.

Every stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a
DataFrame; ``run`` writes each stage's result as Parquet into the shared folder and reads it back as the
next stage's documents. All but the last return the columns of documents, whatever these are called: a
column named like an operator's own output (``score``, ``class_id``) goes through unchanged.

Defined results: a null or empty text is not toxic, alone in its group, free of leaks and secrets, and has no
tokens; a null doc_id passes every stage; rows that share a doc_id share the join's verdict by their group, and are
judged one by one elsewhere; of tied near copies the one with the least doc_id stays; very long texts go whole through
every stage; an empty table, of documents, labels or benchmark items, gives empty results or changes nothing.

What a stage's operator staged for itself, and the stage before, are removed from the shared folder once the
stage's result is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens import workspace
from postlens.llm import bpe, chosen_path, decontaminate, secrets, toxicity
from postlens.llm.common import documents, ship, stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    ship(spark)
    model = toxicity.train(docs, documents(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select(F.struct(*docs.columns).alias("row"), "text"), model)
    return scored.where("predicted = 0").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least doc_id."""
    ship(spark)
    return chosen_path.keep_first(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return decontaminate.clean(docs, documents(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    ship(spark)
    return secrets.redact(docs, secrets.train(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of the ids and of the bytes that they decode to."""
    import public_tokenizers as vocabularies

    ship(spark)
    return bpe.digest(docs, vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("secret_scan", redact_secrets),
    ("bpe", encode),
]

#: Learned and probabilistic stages have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mark = documents(spark, sf_dir), workspace.len_staged()
    for name, f in STAGES:
        docs = stage(f(spark, docs, sf_dir), f"pipeline-{name}")
        workspace.drop_staged(spark, mark, keep_last=1)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
