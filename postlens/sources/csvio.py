"""CSV and JSON in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.functions.text import csv_safe

BOM = "\ufeff"


def read_listing_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, empty for missing; all-blank rows go, a byte order mark does not count."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)
    df = df.toDF(*[c.lstrip(BOM) for c in df.columns]).fillna("")
    filled = F.lit(False)
    for c in df.columns:
        filled |= F.trim(c) != ""
    return df.where(filled)


def cell(c: Column, kind: T.DataType, mode: str = "strict") -> Column:
    """A CSV cell: arrays of scalars joined by |, other nested values as JSON, formulas guarded."""
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StructType, T.ArrayType, T.MapType)):
        text = F.array_join(c.cast("array<string>"), "|")
    elif isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        text = F.to_json(c)
    else:
        text = c.cast("string")
        if mode == "text" and not isinstance(kind, T.StringType):
            return text  # the post form exempts numbers, booleans and times
    return csv_safe(text, mode)


def csv_columns(df: DataFrame, mode: str = "strict") -> DataFrame:
    return df.select(*[F.coalesce(cell(F.col(f.name), f.dataType, mode), F.lit("")).alias(f.name) for f in df.schema.fields])


def write_listing_csv(df: DataFrame, path: str) -> None:
    """With a byte order mark before the first header, CRLF line ends, and all formulas guarded."""
    out = csv_columns(df)
    out.toDF(BOM + out.columns[0], *out.columns[1:]).write.csv(path, header=True, escape='"', emptyValue="", lineSep="\r\n")


def post_rows(envelopes: DataFrame) -> DataFrame:
    """The flat form of an export: the batch's columns on every post's row."""
    posts = envelopes.select("batch", F.explode("posts").alias("post"))
    batch = [F.col(f"batch.{f.name}").alias(f"batch_{f.name}".replace("batch_batch_", "batch_")) for f in posts.schema["batch"].dataType.fields]
    return posts.select(*batch, "post.*")


def write_post_csv(envelopes: DataFrame, path: str) -> None:
    csv_columns(post_rows(envelopes), "text").write.csv(path, header=True, escape='"', emptyValue="")


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path, ignoreNullFields=False)


def flatten(df: DataFrame, prefix: str = "") -> DataFrame:
    """Struct fields as columns of their own, at every depth."""

    def paths(kind: T.StructType, at: str, name: str) -> list[Column]:
        out = []
        for f in kind.fields:
            here, label = f"{at}.`{f.name}`" if at else f"`{f.name}`", f"{name}_{f.name}" if name else f.name
            out += paths(f.dataType, here, label) if isinstance(f.dataType, T.StructType) else [F.col(here).alias(prefix + label)]
        return out

    return df.select(*paths(df.schema, "", ""))


def write_service_tables(listings: DataFrame, types: dict[str, list[str]], path: str, type_: str = "listing_type") -> None:
    """A JSON and a CSV table per service type, with the type's own columns."""
    kept = listings.persist()
    for t, columns in types.items():
        own = kept.where(F.col(type_) == t).select(*columns)
        write_json(own, f"{path}/{t}.json")
        write_listing_csv(own, f"{path}/{t}.csv")
    kept.unpersist()
