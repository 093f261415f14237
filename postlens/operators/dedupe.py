"""Duplicate listings inside an event: exact rules from pre-aggregated minima and range positions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.functions.ids import hash_id
from postlens.workspace import stage


def event_key(schedule: Column, venue: Column, type_: Column, fmt: Column, plain: str = "session") -> Column:
    """Null unless schedule and venue are known; other listing types and known formats have keys of their own."""
    scope = F.when(type_.isNotNull() & (type_ != "") & (type_ != plain), type_)
    return F.when(schedule.isNotNull() & venue.isNotNull(), F.concat_ws("|", scope, schedule, venue, F.nullif(fmt, F.lit(""))))


def match_events(df: DataFrame, id_: str, order: str, key: str, source: str, organisers: str, content: str) -> tuple[DataFrame, DataFrame]:
    """The rows with a key and those without one. Adds to the former _m and duplicate_of (order and id of the first earlier match), _src and _org (its kinds), position, group_rows and open.

    Rows are staged once, in ranges of (key, order), numbered as they lie there; a position is that number less the one its
    key begins with, plus the rows of the key in earlier ranges. First matches come from minima that tasks aggregate before
    they shuffle; only values that come again are joined back, with keys and orders alone. No row holds another's id, so a group
    may be a large part of the table.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(df.repartitionByRange(n, key, order).sortWithinPartitions(key, order).withColumn("_row", F.monotonically_increasing_id()), "events", "zstd")
    rest, dealt = dealt.where(F.col(key).isNull()).drop("_row"), dealt.where(F.col(key).isNotNull()).withColumn("_part", F.shiftright("_row", 33))
    # a null source or organiser matches no other's value but its like, as in a window's partition
    same = lambda a, b, *on: F.expr(" and ".join(f"{a}.`{c}` <=> {b}.`{c}`" for c in on))
    kinds = {"_src": dealt.withColumn("_v", F.col(source)), "_org": dealt.withColumn("_v", F.explode(organisers)), "_txt": dealt.where(F.col(content) != "").withColumn("_v", F.col(content))}
    found = []
    for kind, each in kinds.items():
        each = each.select(key, F.col(order).alias("_at"), F.col(id_).alias("_id"), "_v")
        firsts = each.groupBy(key, "_v").agg(F.min("_at").alias("_f"), (F.min("_at") if id_ == order else F.min_by("_id", "_at")).alias("_fid"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
        met = each.drop("_id").alias("e").join(firsts.alias("f"), same("e", "f", key, "_v")).where("_f < _at")
        found.append(met.select(F.col(f"e.{key}").alias(key), "_at", "_f", "_fid", F.lit(kind).alias("_kind")))
    of = lambda kind: F.min(F.when(F.col("_kind") == kind, F.col("_f"))).alias(kind)
    found = stage(reduce(DataFrame.unionByName, found).groupBy(key, "_at").agg(F.min("_f").alias("_m"), F.min_by("_fid", "_f").alias("duplicate_of"), of("_src"), of("_org")), "event-matches", "zstd")
    # the first row of a group matches nothing; the group is open if another one does not either
    matched = found.groupBy(key).agg(F.count("*").alias("_matched"))
    own = Window.partitionBy(key)
    ranges = dealt.groupBy("_part", key).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    ranges = ranges.withColumns({"_before": F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "group_rows": F.sum("_n").over(own)}).drop("_n")
    ranges = ranges.join(matched, key, "left").withColumn("open", F.col("group_rows") - 1 > F.coalesce("_matched", F.lit(0))).drop("_matched")
    # the large join first, so that it shuffles keys, orders and row numbers alone
    rows = dealt.join(found, (dealt[key] == found[key]) & (dealt[order] == found["_at"]), "left").drop(found[key]).drop("_at")
    rows = rows.join(ranges, ["_part", key]).withColumn("position", F.col("_row") - F.col("_first") + 1 + F.col("_before")).drop("_part", "_row", "_first", "_before")
    return rows, rest


def judge_events(df: DataFrame, id_: str, order: str, key: str, source: str, organisers: str, content: str) -> DataFrame:
    """Adds event_group_id, status, key_complete, duplicate_of, reasons, position, candidates_to and n_candidates.

    The rules of dedupe_events at any size of a group: the candidates are the rows of the group at positions 1 to
    candidates_to, without the row itself. Orders are distinct inside a group.
    """
    rows, rest = match_events(df, id_, order, key, source, organisers, content)
    ids_type = df.schema[id_].dataType.simpleString()
    first = F.col("position") == 1
    matched = F.col("_m").isNotNull()
    status = F.when(matched, "duplicate").when(~first | F.col("open"), "possible_duplicate").otherwise("unique")
    to = F.when(matched, 0).when(~first, F.col("position") - 1).when(F.col("open"), F.col("group_rows")).otherwise(0).cast("long")
    reason = F.when(F.col("_src") == F.col("_m"), "same_source_post").when(F.col("_org") == F.col("_m"), "same_organizer").otherwise("same_source_content")
    none = F.expr("cast(array() as array<string>)")
    both = [F.lit("same_schedule"), F.lit("same_venue")]
    done = rows.withColumns(
        {
            "event_group_id": hash_id("event", F.col(key)),
            "status": status,
            "key_complete": F.lit(True),
            "reasons": F.when(matched, F.array(*both, reason)).when(status == "possible_duplicate", F.array(*both)).otherwise(none),
            "candidates_to": to,
            "n_candidates": F.when(first & (to > 0), to - 1).otherwise(to),
        }
    ).drop("_src", "_org", "_m", "open", "group_rows")
    rest = rest.withColumns(
        {
            "event_group_id": F.lit(None).cast("string"), "status": F.lit("unique"), "key_complete": F.lit(False), "duplicate_of": F.lit(None).cast(ids_type),
            "reasons": none, "position": F.lit(1).cast("long"), "candidates_to": F.lit(0).cast("long"), "n_candidates": F.lit(0).cast("long"),
        }
    )
    return done.unionByName(rest)


def dedupe_events(df: DataFrame, id_: str, order: str, key: str, source: str, organisers: str, content: str) -> DataFrame:
    """Adds event_group_id, status, key_complete, duplicate_of, candidate_ids and reasons.

    In order, a row is a duplicate of the first earlier row of its event with the same source, a
    shared organiser or the same text; else a possible duplicate of all earlier ones. The first row is a
    possible duplicate of all others if any of those is. Lists of ids are as long as the groups are: for groups
    that are not small by nature take judge_events, which gives candidates as a range of positions.
    """
    rows = judge_events(df, id_, order, key, source, organisers, content)
    listed = rows.where("n_candidates > 0").select(F.col(key).alias("_k"), F.col("position").alias("_p"), "candidates_to")
    held = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col("position").alias("_q"), F.col(id_).alias("_i"))
    lists = listed.join(held, "_k").where("_q <= candidates_to and _q <> _p").groupBy("_k", "_p").agg(F.transform(F.array_sort(F.collect_list(F.struct("_q", "_i"))), lambda x: x["_i"]).alias("candidate_ids"))
    empty = F.expr(f"cast(array() as array<{df.schema[id_].dataType.simpleString()}>)")
    out = rows.join(lists, (F.col(key) == F.col("_k")) & (F.col("position") == F.col("_p")), "left")
    return out.withColumn("candidate_ids", F.coalesce("candidate_ids", empty)).drop("_k", "_p", "position", "candidates_to", "n_candidates")
