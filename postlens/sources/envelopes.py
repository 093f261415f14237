"""Batch envelopes and record files: scans with explicit schemas, rejects with reasons, idempotent import."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.functions.ids import canonical_json, digest
from postlens.functions.values import valid_timestamp

STATS = "scanned int, exported int, excluded int, duplicates int, failed int, failed_by_reason struct<unknown_card: int, minimum_data: int, exception: int>"
POST = (
    "post_id string, post_url string, missing_post_url_html struct<encoding: string, data: string>, author_name string, author_url string, author_profile_url string, is_anonymous boolean, "
    "content_text string, content_is_truncated boolean, published_time_raw string, published_at string, reaction_count_raw string, reaction_count bigint, comment_count_raw string, comment_count bigint, "
    "share_count_raw string, share_count bigint, media array<struct<type: string, url: string>>, is_pinned boolean, scraped_at string, warnings array<string>"
)
BATCH = f"batch_id string, source string, status string, stop_reason string, group_id string, group_name string, group_url string, target_post_count int, max_duration_seconds int, started_at string, finished_at string, stats struct<{STATS}>"
ENVELOPE = f"struct<batch: struct<{BATCH}>, posts: array<struct<{POST}>>>"


def read_envelopes(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(envelopes, rejects): one row a file with its raw text, canonical digest and path; rejects name path and reason."""
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw_json"))
    rows = raw.withColumns({"json": F.try_parse_json("raw_json"), "env": F.from_json("raw_json", ENVELOPE)})
    reason = (
        F.when(F.col("json").isNull(), "not JSON")
        .when(F.col("env.batch").isNull(), "no batch")
        .when(F.col("env.posts").isNull(), "no posts")
        .when(F.coalesce("env.batch.batch_id", F.lit("")) == "", "no batch_id")
        .when(F.coalesce("env.batch.group_url", F.lit("")) == "", "no group_url")
        .when(F.exists("env.posts", lambda p: p.isNull()), "a post is not an object")
    )
    judged = rows.withColumns({"reason": reason, "input_digest": digest(F.to_json("json"))})
    good = judged.where("reason is null").select("path", "raw_json", "input_digest", "env.batch", "env.posts")
    return good, judged.where("reason is not null").select("path", "reason")


def explode_posts(envelopes: DataFrame) -> DataFrame:
    """One row per post, with its position in the batch."""
    return envelopes.select("path", "input_digest", "batch", F.posexplode("posts").alias("ordinal", "post"))


def new_imports(envelopes: DataFrame, archive: DataFrame | None) -> DataFrame:
    """Envelopes whose digest the archive lacks; of equal ones in the call the first path counts."""
    first = envelopes.groupBy("input_digest").agg(F.min("path").alias("path"))
    new = envelopes.join(first, ["input_digest", "path"], "left_semi")
    return new if archive is None else new.join(archive.select("input_digest"), "input_digest", "left_anti")


def import_batches(spark: SparkSession, paths: str | list[str], archive_dir: str, written_at: str) -> dict[str, int]:
    """Append new envelopes to the archive; all of them or, if one is rejected, none. Returns counts."""
    envelopes, rejects = read_envelopes(spark, paths)
    wrong = [f"{r.path}: {r.reason}" for r in rejects.orderBy("path").limit(20).collect()]
    if wrong:
        raise ValueError("; ".join(wrong))
    try:
        archive = spark.read.parquet(archive_dir)
    except Exception as e:  # noqa: BLE001  only a missing archive is a new one
        if "PATH_NOT_FOUND" not in str(e):
            raise
        archive = None
    new = new_imports(envelopes, archive).withColumn("written_at", F.lit(written_at).cast("timestamp")).persist()
    total, n = envelopes.count(), new.count()
    posts = new.agg(F.sum(F.size("posts"))).first()[0] or 0
    if n:
        new.write.mode("append").parquet(archive_dir)
    new.unpersist()
    return {"batches": n, "observations": posts, "already_imported": total - n}


def migrate(archive: DataFrame, captured: str = "scraped_at") -> DataFrame:
    """An archive of an earlier form with the columns that it lacks: the digest of the raw JSON, and of observations the valid capture time. Rows and ids stay."""
    if "input_digest" not in archive.columns and "raw_json" in archive.columns:
        archive = archive.withColumn("input_digest", digest(canonical_json(F.col("raw_json"))))
    if captured in archive.columns and f"{captured}_valid" not in archive.columns:
        archive = archive.withColumn(f"{captured}_valid", valid_timestamp(F.col(captured)))
    return archive


def read_records(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of JSON arrays, {"results": [...]}, single objects or JSON lines. Rejects carry the line number."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    # several lines of which the first is an object by itself are JSON lines; the parser alone would stop after it
    filled = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    lined = (F.size(filled) > 1) & F.get(filled, 0).rlike(r"^\s*\{.*\}\s*$") & F.try_parse_json(F.get(filled, 0)).isNotNull()
    shaped = whole.select("path", "value", F.when(~F.coalesce(lined, F.lit(False)), F.try_parse_json("value")).alias("v"), F.regexp_extract("value", r"^\s*(.)", 1).alias("first"))
    listed = F.from_json("value", T.ArrayType(kind))
    nested = F.from_json("value", T.StructType([T.StructField("results", T.ArrayType(kind))]))["results"]
    one = F.when(nested.isNotNull(), nested).otherwise(F.array(F.from_json("value", kind)))
    documents = shaped.where("v is not null").select("path", F.posexplode(F.when(F.col("first") == "[", listed).otherwise(one)).alias("line", "record"))
    lines = shaped.where("v is null").select("path", F.posexplode(F.split("value", r"\r?\n")).alias("at", "text")).where(F.trim("text") != "")
    parsed = lines.select("path", (F.col("at") + 1).alias("line"), F.try_parse_json("text").alias("v"), F.from_json("text", kind).alias("record"))
    good = documents.unionByName(parsed.where("v is not null").select("path", "line", "record"))
    return good, parsed.where("v is null").select("path", "line")


def accept_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of a splittable JSON-lines file: a malformed line is rejected, the others go on."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("v", F.try_parse_json("value"))
    return lines.where("v is not null").select(F.from_json("value", schema).alias("record")), lines.where("v is null").select("value")
