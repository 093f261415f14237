"""Search: preference scores, grouped variants, and orders that put what is missing last."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.operators.scan import scan
from postlens.plans.predicates import Fields, compile_where, include_flags, require_columns, validate
from postlens.workspace import stage


@dataclass(frozen=True)
class Weights:
    """Fixed values of the preference score."""

    contact: dict = field(default_factory=lambda: {"direct": 30, "source": 20, "partial": 10, "unavailable": 0})
    beginner: tuple = (15, -30, 10)  # wanted and so, wanted and not so, unwanted and not so
    fee: tuple = (-5, 10, -15)  # unknown, within, beyond
    status: dict = field(default_factory=lambda: {"open": 5, "unknown": 1})
    confidence: int = 5


def _pick(c: Column, table: dict) -> Column:
    return reduce(lambda out, kv: F.when(c == kv[0], kv[1]).otherwise(out), table.items(), F.lit(0))


def preference_score(preferences: dict, contact: Column, beginner: Column, fee: Column, status: Column, confidence: Column, w: Weights = Weights()) -> Column:
    """The ranking score of a row as double; every part is known for every row."""
    out = _pick(contact, w.contact) + _pick(status, w.status)
    wanted = preferences.get("beginner_friendly")
    if wanted is True:
        out += F.when(beginner, w.beginner[0]).when(~beginner, w.beginner[1]).otherwise(0)
    elif wanted is False:
        out += F.when(~beginner, w.beginner[2]).otherwise(0)
    if preferences.get("max_fee") is not None:
        out += F.when(fee.isNull(), w.fee[0]).when(fee <= preferences["max_fee"], w.fee[1]).otherwise(w.fee[2])
    return (out + F.coalesce(confidence, F.lit(0)) * w.confidence).cast("double")


def row_order(score: str = "score", date: str = "date", start: str = "start_time", venue: str = "venue", id_: str = "id") -> list[Column]:
    """Best first, then by day, hour and venue, unknown ones last; the id breaks ties."""
    return [F.desc(score), F.coalesce(date, F.lit("9999-99-99")), F.coalesce(start, F.lit("99:99")), F.coalesce(venue, F.lit("")), F.col(id_)]


def group_variants(df: DataFrame, group: str, id_: str = "id", **names: str) -> DataFrame:
    """One row per event group: score (the best variant's), primary (its id) and variants (ids, best first)."""
    scored = df.withColumn("_group", F.coalesce(F.col(group), F.col(id_).cast("string")))
    w = Window.partitionBy("_group").orderBy(*row_order(id_=id_, **names))
    ranked = scored.withColumn("_nth", F.row_number().over(w))
    score, date, start = names.get("score", "score"), names.get("date", "date"), names.get("start", "start_time")
    top = lambda c: F.max(F.when(F.col("_nth") == 1, F.col(c)))
    return ranked.groupBy(F.col("_group").alias("group_id")).agg(
        F.max(score).alias("score"), top(id_).alias("primary"), top(date).alias("date"), top(start).alias("start_time"),
        F.transform(F.array_sort(F.collect_list(F.struct("_nth", id_))), lambda x: x[id_]).alias("variants"),
    )


def search(df: DataFrame, plan: dict, fields: Fields, score: Column, group: str, id_: str = "id", **names: str) -> DataFrame:
    """A validated plan's groups, best first. Rows without the columns that the default exclusions look at are an error."""
    validate(plan, fields)
    require_columns(df, ("dedupe_status", "status", "contactability"))
    keep = compile_where(plan["where"], fields) & include_flags(plan["include"], plan["preferences"]["require_contactable"])
    groups = group_variants(df.where(keep).withColumn("score", score), group, id_, **names)
    return groups.orderBy(F.desc("score"), F.coalesce("date", F.lit("9999-99-99")), F.coalesce("start_time", F.lit("99:99")), "group_id")


def browse_order(field_: Column, descending: bool, default: list[Column]) -> list[Column]:
    """Missing values last in both directions; the default order breaks ties."""
    return [field_.desc_nulls_last() if descending else field_.asc_nulls_last(), *default]


def default_time_order(date: Column, weekdays: Column, start: Column, end: Column, offset: Column, id_: Column) -> list[Column]:
    """Dated, then weekly, then undated; inside by day, start, end and id."""
    kind = F.when(date.isNotNull(), 0).when(F.size(weekdays) > 0, 1).otherwise(2)
    days = F.array_join(F.transform(weekdays, lambda x: x.cast("string")), ",")
    return [kind, F.coalesce(date, F.lit("")), F.coalesce(days, F.lit("")), F.coalesce(start, F.lit("99:99")), F.coalesce(offset, F.lit(0)), F.coalesce(end, F.lit("99:99")), id_]


def date_class_order(date: Column, weekdays: Column, descending: bool, id_: Column) -> list[Column]:
    """Weekly, dated, unknown, whatever the direction; the direction holds inside a class."""
    kind = F.when(F.size(weekdays) > 0, 0).when(date.isNotNull(), 1).otherwise(2)
    value = F.coalesce(date, F.array_join(F.transform(weekdays, lambda x: x.cast("string")), ","))
    return [kind, value.desc() if descending else value.asc(), id_]


#: Fixed value: the collation of the page's texts.
LOCALE = "zh_Hant_TWN"


def locale_key(c: Column) -> Column:
    """A text that sorts by the page's locale instead of by its bytes."""
    return F.collate(c, LOCALE)


def grouped_order(date: Column, weekdays: Column, field_: str, value: Column, descending: bool, ties: list[Column]) -> list[Column]:
    """Weekly groups, then days, then unknown; inside a group by a field, missing values last. Only the field ``date`` turns the groups round."""
    days = F.array_join(F.transform(weekdays, lambda x: x.cast("string")), ",")
    weekly = date.isNull() & (F.coalesce(days, F.lit("")) != "")
    kind = F.when(date.isNotNull(), 1).when(weekly, 0).otherwise(2)
    group = F.when(date.isNotNull(), date).when(weekly, days).otherwise(F.lit("unknown"))
    turned = field_ == "date" and descending
    own = [] if field_ == "date" else browse_order(value, descending, [])
    return [kind, group.desc() if turned else group.asc(), *own, *ties]


def group_headings(df: DataFrame, group: str, order: list[Column], id_: str) -> DataFrame:
    """Adds n_group (rows of the group) and is_heading (first row of its group in the order). A group may be of any size."""
    seen = scan(df, [group], [*order, id_])
    return seen.withColumns({"n_group": F.col("n_key"), "is_heading": F.col("nth") == 1}).drop("nth", "n_key")


def selection(df: DataFrame, wanted: list, id_: str, text: str, source: str, most_rows: int = 50, most_chars: int = 100_000) -> DataFrame:
    """One row: rows, characters and sources of a selection, and whether it is over a limit. Nothing is cut off."""
    own = df.where(F.col(id_).isin(*wanted)) if wanted is not None else df
    return own.agg(F.count("*").alias("n_rows"), F.sum(F.char_length(text)).alias("n_chars"), F.count_distinct(source).alias("n_sources")).withColumn("over_limit", (F.col("n_rows") > most_rows) | (F.col("n_chars") > most_chars))


def source_numbers(df: DataFrame, source: str, position: str) -> DataFrame:
    """Numbers sources by their first appearance in a selection; no task sees all of them."""
    first = df.groupBy(source).agg(F.min(position).alias("_first"))
    return df.join(places(first, [F.col("_first"), F.col(source)], name="source_number").drop("_first"), source)


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def places(df: DataFrame, order: list[Column], by: tuple[str, ...] = (), name: str = "place") -> DataFrame:
    """Adds every row's place (from 1) in a total order, or in that of its group, with no row limit and no task for all rows.

    Rows are range-partitioned by group and order and kept in the session's shared folder, so that both
    readers see the same partitions; a partition's places follow those of the partitions before it. Only
    the counts, one row per partition and group, meet in one window. Groups must not be null.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(df.repartitionByRange(n, *by, *order).withColumn("_part", F.spark_partition_id()), "places")
    sizes = dealt.groupBy("_part", *by).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", *by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order))
    return dealt.withColumn("_nth", nth).join(offsets, ["_part", *by]).withColumn(name, F.col("_nth") + F.col("_before")).drop("_part", "_nth", "_before")


def without_authors(df: DataFrame, authors: DataFrame, column: str) -> DataFrame:
    """Rows of unknown authors stay: a null never matches."""
    return df.join(authors.select(column).distinct(), column, "left_anti")
