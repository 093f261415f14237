"""The registered queries of the corpus operators and their oracle SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm import alignment, bpe, chosen_path, decontaminate, hamming, langid, line_dedup, periodic, pii, secrets, suffix_dedup, token_files, toxicity
from postlens.llm.common import crc_bucket, documents, ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


@query("op10_bpe")
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every whole text, and what they decode to."""
    import public_tokenizers as vocabularies

    return bpe.digest(documents(spark, sf_dir), vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN)


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every whole text, learned without the held-out fifth. A row without a doc_id is not held out, nor learned from."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.train(docs, documents(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", F.coalesce(crc_bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


@query("op5_language")
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every whole text, learned without the held-out quarter. A row without a doc_id is not held out, nor learned from."""
    docs = documents(spark, sf_dir)
    found = langid.predict(docs.select("doc_id", "text"), langid.sample(docs))
    return found.select("doc_id", F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op2_decontamination", decontaminate.ORACLE)
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every verified overlap of a document with a benchmark item."""
    return decontaminate.overlaps(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


@query("op6_lines", line_dedup.ORACLE)
def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier document, or an earlier line of its own, holds."""
    out = line_dedup.dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_units", "n_removed", "removed_spans", "n_shared", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


TOP_K = 10


@query("op9_hamming", hamming.oracle(TOP_K))
def op9_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest codes of every hundredth vector, against all vectors."""
    index = hamming.codes(documents(spark, sf_dir, "embeddings"))
    return hamming.top_k(index, index.where("id % 100 = 0"), TOP_K)


@query("op3_suffix_array")
def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that 50-byte strings of earlier documents cover."""
    return suffix_dedup.digest(documents(spark, sf_dir))


@query("op8_chosen_path", chosen_path.ORACLE)
def op8_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document, at similarity 0.8 of five-word shingles."""
    return chosen_path.join(documents(spark, sf_dir))


@query("op4_pii")
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text: base spans, and those that the random field adds."""
    return pii.digest(documents(spark, sf_dir))


@query("op7_secrets")
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate secret in every whole text, with the forest's verdict."""
    docs = documents(spark, sf_dir)
    return secrets.scan(docs, secrets.train(docs))


def _planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's change of a tenth of the documents; one without an id stays as it is."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


@query("op13_periodic")
def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every whole text, of which a tenth is made periodic first."""
    return periodic.digest(documents(spark, sf_dir), rewrite=_planted)


@query("op12_token_files")
def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, written to flat files with 64-bit offsets and read back from them."""
    import public_tokenizers as vocabularies

    return token_files.digest(documents(spark, sf_dir), vocabularies.path("word_bpe_49k.json"), end_id=1)


@query("op11_alignment")
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the tokens that two tokenizers make of every whole text."""
    import public_tokenizers as vocabularies

    return alignment.align(documents(spark, sf_dir), vocabularies.path("byte_bpe_50k.json"), vocabularies.path("piece_bpe_32k.model"))
