"""The in-batch collector: records that share an id or a URL are one post, and a bridge joins two."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.operators.components import components

def clusters(df: DataFrame, batch: str, order: str, keys: list[str]) -> DataFrame:
    """Adds ``cluster``: the least order of the records that shared keys connect inside a batch.

    Orders are whole numbers, distinct over the table. A record is linked to the first record of each of its keys,
    a minimum that tasks aggregate before they shuffle, and the links' components are found by star steps, so
    neither an id that very many records share nor a long chain meets in one task. Records without any key are alone.
    """
    links = None
    for k in keys:
        own = df.where(F.col(k).isNotNull()).select(batch, k, F.col(order).cast("long").alias("a"))
        first = own.groupBy(batch, k).agg(F.min("a").alias("b"))
        both = own.alias("o").join(first.alias("f"), F.expr(f"o.`{batch}` <=> f.`{batch}` and o.`{k}` = f.`{k}`")).select("a", "b")
        links = both if links is None else links.unionByName(both)
    roots = components(links)
    return df.join(roots, F.col(order) == F.col("node"), "left").withColumn("cluster", F.coalesce("root", F.col(order))).drop("node", "root")


def first_fingerprints(df: DataFrame, batch: str, order: str, fingerprint: str, keyed: str) -> DataFrame:
    """Of records without an id or URL, the first of each fingerprint in its batch; keyed records all stay. Orders are distinct in a batch."""
    # minima are aggregated by tasks first; the order in the join's key parts the rows of a fingerprint that very many share
    first = df.where(~F.coalesce(F.col(keyed), F.lit(False))).groupBy(batch, fingerprint).agg(F.min(order).alias(order))
    on = [F.col(f"d.{c}").eqNullSafe(F.col(f"f.{c}")) for c in (batch, fingerprint, order)]
    others = df.where(~F.coalesce(F.col(keyed), F.lit(False))).alias("d").join(first.alias("f"), on, "left_semi")
    return df.where(F.coalesce(F.col(keyed), F.lit(False))).unionByName(others)


def merge_stable(df: DataFrame, by: list[str], order: str, fill: list[str], last: list[str], text: str, truncated: str, unions: list[str], latest: list[str]) -> DataFrame:
    """One row per cluster by field policy.

    fill: the first known value; last: the last known; unions: array union in order; latest: the last
    row's value. Text: the first non-empty, but a complete one replaces a truncated one; the text that fills
    an empty one counts as complete. ``content_truncated`` leaves a ``warnings`` union once the text is complete.
    """
    # equal orders are parted by the other fields; every policy is an aggregate that tasks begin before the shuffle
    item = F.struct(order, *dict.fromkeys([*fill, *last, text, truncated, *unions, *latest]))
    said = F.coalesce(F.col(text), F.lit("")) != ""
    at = lambda pick, c, where: pick(F.when(where, F.col(c)), F.when(where, item))
    every = F.lit(True)
    picks = [F.count("*").alias("n_records")]
    picks += [at(F.min_by, c, F.col(c).isNotNull()).alias(c) for c in fill]
    picks += [at(F.max_by, c, F.col(c).isNotNull()).alias(c) for c in last]
    picks += [at(F.max_by, c, every).alias(c) for c in latest]
    picks += [at(F.min_by, text, every).alias("_t"), at(F.min_by, truncated, every).alias("_c"), at(F.min_by, text, said).alias("_said"), at(F.min_by, text, said & (F.col(truncated) == False)).alias("_whole")]  # noqa: E712
    out = df.groupBy(*by).agg(*picks)
    empty = F.coalesce("_t", F.lit("")) == ""
    taken = F.when(empty, F.col("_said")).when(F.col("_c") == True, F.col("_whole"))  # noqa: E712
    out = out.withColumns({text: F.coalesce(taken, F.col("_t")), truncated: F.when(taken.isNotNull(), F.lit(False)).otherwise(F.col("_c"))}).drop("_t", "_c", "_said", "_whole")
    for c in unions:
        # one row per distinct element, at its first place
        each = df.where(F.col(c).isNotNull()).select(*by, item.alias("_item"), F.posexplode(c).alias("_pos", "_e"))
        first = each.groupBy(*by, "_e").agg(F.min(F.struct("_item", "_pos")).alias("_at"))
        listed = first.groupBy(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(by)]).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_e"))), lambda x: x["_e"]).alias(c))
        on = F.expr(" and ".join(f"`{k}` <=> `_k{n}`" for n, k in enumerate(by)))
        out = out.join(listed, on, "left").drop(*[f"_k{n}" for n in range(len(by))])
        out = out.withColumn(c, F.coalesce(c, F.array().cast(df.schema[c].dataType)))
    if "warnings" in unions:
        out = out.withColumn("warnings", F.when(F.col(truncated) == False, F.array_remove("warnings", "content_truncated")).otherwise(F.col("warnings")))  # noqa: E712
    return out


def batch_stats(df: DataFrame, batch: str, outcome: str, reason: str | None = None) -> DataFrame:
    """scanned, exported, excluded, duplicates and failed per batch, and whether they add up."""
    n = lambda v: F.count_if(F.col(outcome) == v)
    out = df.groupBy(batch).agg(F.count("*").alias("scanned"), n("exported").alias("exported"), n("excluded").alias("excluded"), n("duplicate").alias("duplicates"), n("failed").alias("failed"))
    out = out.withColumn("adds_up", F.col("scanned") == F.col("exported") + F.col("excluded") + F.col("duplicates") + F.col("failed"))
    if reason:
        reasons = df.where(F.col(outcome) == "failed").groupBy(batch, reason).agg(F.count("*").alias("n")).groupBy(batch).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(reason, "n")))).alias("failed_by_reason"))
        out = out.join(reasons, batch, "left")
    return out
