"""Registered queries of sources, releases, selections and rules, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.functions import ids, text, urls, values
from postlens.operators import collect, history, joins, publish, quality, release, rules, search, tasks
from postlens.plans import predicates
from postlens.queries import LATEST, LISTED, TASKS, big, listing_rows, observations, query, table, task_rows
from postlens.sources import cards as cards_source
from postlens.sources import csvio, envelopes, releases
from postlens.workspace import fresh

# --- selections, claims and lookups -----------------------------------------------------------------


def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.latest_by_key(observations(spark, sf_dir), "user_id", "valid", "event_id", "event_id")


@query("p17_select_batches", LATEST + " select user_id, event_id from l where user_id in (select user_id from events where cast(ts as date) in (date '2024-01-03', date '2024-01-09'))")
def p17_select_batches(spark, sf_dir):
    observed = table(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return tasks.select_tasks(latest_rows(spark, sf_dir), observed, "user_id", "day", batches=["2024-01-03", "2024-01-09"]).select("user_id", "event_id")


ABLE = "(status = 'pending' or status = 'failed' and attempts < 3)"


@query("p18_claim_posts", TASKS + f" select task_id from t where {ABLE} and context in (select context from t where {ABLE} group by 1 order by min(task_id), context limit 20)")
def p18_claim_posts(spark, sf_dir):
    return tasks.claim_posts(task_rows(spark, sf_dir), "context", "task_id", 3, 20).select("task_id")


@query("p21_required_columns", "select c_custkey, c_mktsegment from customer")
def p21_required_columns(spark, sf_dir):
    return predicates.require_columns(table(spark, sf_dir, "customer"), ("c_custkey", "c_mktsegment")).select("c_custkey", "c_mktsegment")


FACETS = LISTED + """ select id from (select *, dayofweek(try_cast(date as date)) as weekday, case when id % 6 > 0 then 'a' || id % 6 end as author from r)
  where date in ('1998-03-04', '1998-03-06', '1998-03-07') and (weekday in (5, 6) or id % 5 = 0 and 1 in (5, 6)) and (author is null or author not in ('a1', 'a2'))"""


@query("p9_dates_and_weekdays", FACETS)
def p9_dates_and_weekdays(spark, sf_dir):
    """Dates and weekdays both hold, and listings of two authors are left out; an unknown author stays."""
    fields = predicates.Fields(("date", "weekday", "recurrence_weekdays", "author_url"), {"recurrence_weekdays": "array", "weekday": "number"})
    plan = predicates.facet_plan({"dates": ["1998-03-04", "1998-03-06", "1998-03-07"], "weekdays": [5, 6], "date_mode": "all", "excluded_authors": ["a1", "a2"]})
    own = F.when(F.col("id") % 6 > 0, F.concat(F.lit("a"), (F.col("id") % 6).cast("string")))
    df = listing_rows(spark, sf_dir).withColumns({"weekday": values.weekday(F.to_date("date")), "recurrence_weekdays": F.when(F.col("id") % 5 == 0, F.array(F.lit(1))), "author_url": own})
    return df.where(predicates.compile_where(predicates.validate(plan, fields)["where"], fields)).select("id")


@query("p10_hierarchy", "select p_partkey from part where p_type in ('STANDARD', 'ECONOMY', 'SMALL')")
def p10_hierarchy(spark, sf_dir):
    """A parent value stands for itself and its children."""
    wanted = predicates.expand_hierarchy(["STANDARD"], {"STANDARD": ["ECONOMY", "SMALL"]})
    return table(spark, sf_dir, "part").where(F.col("p_type").isin(*wanted)).select("p_partkey")


@query("p22_safe_link", "select s_suppkey, case s_suppkey % 4 when 0 then 'https://a.example/' || s_suppkey when 1 then 'TEL:+' || s_suppkey end as link from supplier")
def p22_safe_link(spark, sf_dir):
    k, n = F.col("s_suppkey") % 4, F.col("s_suppkey").cast("string")
    raw = F.when(k == 0, F.concat(F.lit("https://a.example/"), n)).when(k == 1, F.concat(F.lit("TEL:+"), n)).when(k == 2, F.concat(F.lit("javascript:"), n))
    return table(spark, sf_dir, "supplier").select("s_suppkey", urls.safe_link(raw).alias("link"))


@query(
    "j2_batch_problems",
    """select 'unknown' as problem, cast(o_custkey as varchar) as id from orders where o_custkey % 10 = 0 group by o_custkey union all select 'missing', cast(c_custkey as varchar) from customer where c_custkey % 10 > 0 and c_custkey not in (select o_custkey from orders)
       union all select 'repeated post', cast(o_orderkey as varchar) from orders where o_orderkey % 50 = 0 union all select 'repeated batch', cast(c_custkey as varchar) from customer where c_custkey % 10 > 0 and c_custkey % 37 = 0""",
)
def j2_batch_problems(spark, sf_dir):
    """Posts of unknown batches, batches without posts, and ids that occur twice."""
    orders, batches = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name").where("o_custkey % 10 > 0")
    j = joins.batch_lookup(orders.unionByName(orders.where("o_orderkey % 50 = 0")), batches.unionByName(batches.where("o_custkey % 37 = 0")), "o_custkey", "o_orderkey")
    said = lambda df, name: df.select(F.lit(name).alias("problem"), F.col("o_custkey").cast("string").alias("id"))
    return said(j.unknown, "unknown").unionByName(said(j.missing, "missing")).unionByName(j.duplicates.select(F.concat(F.lit("repeated "), "kind").alias("problem"), "id"))


@query("j3_targets", "select o_custkey, o_orderkey as task_id, o_orderstatus as status from orders qualify row_number() over (partition by o_custkey order by o_orderkey desc) = 1")
def j3_targets(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("task_id"), F.col("o_orderstatus").alias("status"))
    return tasks.targets(own.groupBy("o_custkey").agg(F.max("task_id").alias("task_id")), own.drop("o_custkey")).select("o_custkey", "task_id", "status")


@query("g4_open_ids", TASKS + " select task_id, status = 'failed' as failed from t where status <> 'succeeded'")
def g4_open_ids(spark, sf_dir):
    return tasks.open_ids(task_rows(spark, sf_dir))


@query("u1_keys_of_days", "select distinct user_id from events where cast(ts as date) in (date '2024-01-03', date '2024-01-05')")
def u1_keys_of_days(spark, sf_dir):
    return joins.keys_of_batches(table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")), "user_id", "day", ["2024-01-03", "2024-01-05"])


@query("g16_distinct_counts", "select user_id, count(distinct event_type) as kinds, count(distinct cast(ts as date)) as days from events group by 1")
def g16_distinct_counts(spark, sf_dir):
    return joins.distinct_counts(table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), ["user_id"], kinds="event_type", days="day")


# --- orders -----------------------------------------------------------------------------------------

GROUP = "case when date is not null then 1 when id % 5 = 0 then 0 else 2 end"


def _grouped(name: str, field: str, value: str, descending: bool):
    way = "desc" if descending else "asc"
    inner = "" if field == "date" else f"{value} {way} nulls last, "

    @query(name, LISTED + f" select id, row_number() over (order by {GROUP}, coalesce(date, case when id % 5 = 0 then '1,3' else 'unknown' end) {way if field == 'date' else 'asc'}, {inner}id) as place from r")
    def run(spark, sf_dir):
        df = listing_rows(spark, sf_dir).withColumn("weekdays", F.when(F.col("id") % 5 == 0, F.array(F.lit(1), F.lit(3))))
        order = search.grouped_order(F.col("date"), F.col("weekdays"), field, F.col(value), descending, [F.col("id").asc()])
        return search.places(df, order).select("id", "place")


_grouped("o8_groups_by_date_desc", "date", "date", True)
_grouped("o8_groups_by_fee_desc", "fee", "fee", True)


@query("o9_locale_order", "select c_custkey, row_number() over (order by lower(c_mktsegment), c_custkey) as place from customer")
def o9_locale_order(spark, sf_dir):
    """Over lower-case Latin texts the locale's order is that of the bytes, which the SQL has."""
    df = table(spark, sf_dir, "customer").select("c_custkey", F.lower("c_mktsegment").alias("segment"))
    return search.places(df, [search.locale_key(F.col("segment")), F.col("c_custkey")]).select("c_custkey", "place")


# --- releases ---------------------------------------------------------------------------------------

STATES = LATEST + """, k as (select user_id, case when user_id % 4 = 0 then event_id - 1 else event_id end as event_id, case event_id % 5 when 0 then 'pending' when 1 then 'running' when 2 then 'failed' else 'succeeded' end as status,
  case when event_id % 7 = 0 then 'x' end as reused_from, event_id % 3 = 0 as needs_review from l where user_id % 11 > 0), s as (select l.user_id, coalesce(k.status, 'pending') as status, coalesce(k.status = 'succeeded', false) as ready,
  k.reused_from, coalesce(k.needs_review, false) as needs_review, l.user_id in (select user_id from events where event_type = 'purchase') as published from l left join k on k.user_id = l.user_id and k.event_id = l.event_id)"""


@query(
    "g5_task_report",
    STATES + """ select count(*) as total, count(*) filter (where status = 'pending') as pending, count(*) filter (where status = 'running') as running, count(*) filter (where status = 'succeeded') as succeeded, count(*) filter (where status = 'failed') as failed,
      count(*) filter (where ready and reused_from is not null) as reused, count(*) filter (where ready and needs_review) as needs_review, count(*) filter (where published) as published, count(*) filter (where published and not ready) as stale, bool_or(status <> 'succeeded') as partial from s""",
)
def g5_task_report(spark, sf_dir):
    latest = latest_rows(spark, sf_dir).select("user_id", "event_id")
    k = F.col("event_id") % 5
    own = latest.where("user_id % 11 > 0").select(
        "user_id", F.when(F.col("user_id") % 4 == 0, F.col("event_id") - 1).otherwise(F.col("event_id")).alias("event_id"), F.col("event_id").cast("string").alias("task_id"),
        F.when(k == 0, "pending").when(k == 1, "running").when(k == 2, "failed").otherwise("succeeded").alias("status"),
        F.when(F.col("event_id") % 7 == 0, "x").alias("reused_from"), (F.col("event_id") % 3 == 0).alias("needs_review"),
    )
    shown = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return release.task_report(release.target_states(latest, own, shown, "user_id", "event_id"))


@query(
    "t11_staged_publication",
    LATEST + """, first as (select user_id from l where user_id % 3 = 0), n as (select user_id, case when user_id % 2 = 0 then 'new' || event_id when user_id % 3 = 0 then 'old' || user_id end as result, case when user_id % 2 = 0 then 'published' else 'stale' end as state from l where not (user_id % 2 = 0 and user_id % 10 = 4))
      select user_id, result, state from n where result is not null""",
)
def t11_staged_publication(spark, sf_dir):
    """Two publications: results of latest observations replace, others stay stale, withdrawn ones go, results of older observations are ignored."""
    latest = latest_rows(spark, sf_dir).select("user_id", "event_id")
    base = fresh(spark, "site")
    first = latest.where("user_id % 3 = 0").select("user_id", "event_id", F.concat(F.lit("old"), F.col("user_id").cast("string")).alias("result"), F.lit(False).alias("withdrawn"))
    release.staged_publication(latest, first, None, base, "r1", "user_id", "event_id")
    ready = latest.where("user_id % 2 = 0").select("user_id", "event_id", F.concat(F.lit("new"), F.col("event_id").cast("string")).alias("result"), (F.col("user_id") % 10 == 4).alias("withdrawn"))
    late = latest.where("user_id % 2 = 1").select("user_id", (F.col("event_id") - 1).alias("event_id"), F.lit("late").alias("result"), F.lit(False).alias("withdrawn"))
    release.staged_publication(latest, ready.unionByName(late), releases.read_release(spark, base, "posts"), base, "r2", "user_id", "event_id")
    return releases.read_release(spark, base, "posts").select("user_id", "result", "state")


@query("u5_subset", "select distinct o_custkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0)")
def u5_subset(spark, sf_dir):
    return joins.missing_from(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")


@query(
    "u6_same_tables",
    """select 'lines' as product, (select count(*) from lineitem where l_returnflag = 'R') as missing, 0 as extra union all select 'orders', (select count(*) from orders where o_orderkey % 9 = 0), (select count(*) from orders where o_orderkey % 9 = 0)
       union all select 'parts', (select count(*) from part), 0 union all select 'segments', 0, (select count(*) from customer) - (select count(distinct c_mktsegment) from customer)""",
)
def u6_same_tables(spark, sf_dir):
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    segments = table(spark, sf_dir, "customer").select("c_mktsegment")
    changed = orders.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 9 == 0, "?").otherwise(F.col("o_orderstatus")))
    out = release.same_tables({"lines": lines, "orders": orders, "parts": table(spark, sf_dir, "part"), "segments": segments.distinct()}, {"lines": lines.where("l_returnflag <> 'R'"), "orders": changed, "segments": segments})
    return out


@query("u7_same_ids", LISTED + " select id, case when fee <= 40000 then 'only_a' else 'only_b' end as side from r where coalesce(fee <= 40000, false) <> (status = 'open')")
def u7_same_ids(spark, sf_dir):
    df = listing_rows(spark, sf_dir)
    by_plan = df.where(predicates.compile_where({"field": "fee", "op": "lte", "value": 40000}, predicates.Fields(("fee",), {"fee": "number"})))
    return joins.same_ids(by_plan, df.where("status = 'open'"), "id")


@query(
    "r16_consistency",
    """select 'repeated_post' as "check", (select count(*) from orders where o_orderkey % 97 = 0) as n union all select 'repeated_batch', 0 union all select 'unknown_batch', (select count(*) from orders where o_custkey % 13 = 0) + (select count(*) from orders where o_orderkey % 97 = 0 and o_custkey % 13 = 0)
       union all select 'unknown_post', (select count(*) from lineitem where l_orderkey % 89 = 0) union all select 'listing_of_other_post', (select count(*) from lineitem join orders on o_orderkey = l_orderkey where o_orderstatus = 'F' and l_orderkey % 89 > 0)
       union all select 'listing_numbers', (select count(*) from (select l_orderkey from (select l_orderkey, case when l_orderkey % 83 = 0 then 1 else 0 end + row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as i from lineitem) group by 1 having min(i) > 0))
       union all select 'report_numbers', 1""",
)
def r16_consistency(spark, sf_dir):
    """A release with planted faults: repeated posts, unknown batches and posts, listings of other posts, numbers from 1, one wrong total."""
    from pyspark.sql import Window

    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderstatus") != "F").alias("recruitment"), F.lit(True).alias("analysed"))
    posts = orders.unionByName(orders.where("o_orderkey % 97 = 0"))
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    lines = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_orderkey") % 89 == 0, F.col("l_orderkey") + 1_000_000_000_000).otherwise(F.col("l_orderkey")).alias("o_orderkey"), (nth - 1 + F.when(F.col("l_orderkey") % 83 == 0, 1).otherwise(0)).alias("listing_index"))
    batches = table(spark, sf_dir, "customer").where("c_custkey % 13 > 0").select(F.col("c_custkey").alias("o_custkey"))
    report = posts.agg(F.count("*").alias("posts"), (F.count_if("analysed") + 1).alias("analysed")).crossJoin(lines.agg(F.count("*").alias("listings")))  # one row each
    return release.consistency(posts, batches, lines, report, "o_orderkey", "o_custkey", "listing_index", "analysed", "recruitment")


@query("s15_import_dataset", "select case when n_regionkey < 2 then 'north' else 'south' end as id, n_name as batch_id from nation")
def s15_import_dataset(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("batch_id"), "n_regionkey")
    held = rows.where("n_regionkey < 2").select(F.lit("north").alias("id"), "batch_id")
    return releases.import_dataset(held, "south", rows.where("n_regionkey >= 2").select("batch_id")).select("id", "batch_id")


# --- sources and sinks ------------------------------------------------------------------------------


def written_envelopes(spark: SparkSession, sf_dir: str) -> str:
    """Pages as envelopes of up to 50 posts, one JSON file each, in the shared folder."""
    post = F.struct(F.col("page_id").cast("string").alias("post_id"), F.col("url").alias("post_url"), F.col("html").alias("content_text"))
    own = table(spark, sf_dir, "pages").withColumn("b", F.floor(F.col("page_id") / 50)).groupBy("b").agg(F.array_sort(F.collect_list(F.struct("page_id", post.alias("p")))).alias("rows"))
    batch = F.struct(F.concat(F.lit("batch-"), F.col("b").cast("string")).alias("batch_id"), F.lit("https://social.test/groups/1").alias("group_url"))
    out = own.select("b", F.to_json(F.struct(batch.alias("batch"), F.transform("rows", lambda r: r["p"]).alias("posts"))).alias("value"))
    path = fresh(spark, "envelopes")
    out.repartition("b").write.partitionBy("b").text(path)
    return path


@query("s2_explode_posts", "select 'batch-' || page_id // 50 as batch_id, row_number() over (partition by page_id // 50 order by page_id) - 1 as ordinal, cast(page_id as varchar) as post_id, url as post_url from pages")
def s2_explode_posts(spark, sf_dir):
    good, _ = envelopes.read_envelopes(spark, written_envelopes(spark, sf_dir) + "/*")
    return envelopes.explode_posts(good).select("batch.batch_id", big("ordinal").alias("ordinal"), "post.post_id", "post.post_url")


@query("s3_new_imports", "select 'batch-' || b as batch_id from (select distinct page_id // 50 as b from pages) where b % 3 > 0")
def s3_new_imports(spark, sf_dir):
    """Envelopes that an archive of every third batch lacks, each once although all files are there twice."""
    good, _ = envelopes.read_envelopes(spark, written_envelopes(spark, sf_dir) + "/*")
    third = good.where(F.substring_index("batch.batch_id", "-", -1).cast("long") % 3 == 0)
    twice = good.unionByName(good.withColumn("path", F.concat("path", F.lit(".copy"))))
    return envelopes.new_imports(twice, third).select("batch.batch_id")


@query("s5_records", "select event_id, event_type, false as rejected from events where event_id % 20 > 0 union all select null, null, true from events where event_id % 20 = 0")
def s5_records(spark, sf_dir):
    """JSON lines of all events, of which every twentieth is cut off and so rejected."""
    line = F.to_json(F.struct("event_id", "event_type"))
    path = fresh(spark, "lines")
    table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 20 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value")).write.text(path)
    good, bad = envelopes.accept_jsonl(spark, path, "event_id long, event_type string")
    return good.select("record.event_id", "record.event_type", F.lit(False).alias("rejected")).unionByName(bad.select(F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("string").alias("event_type"), F.lit(True).alias("rejected")))


@query("s6_csv_round_trip", "select cast(o_orderkey as varchar) as key, case when o_orderkey % 3 = 0 then '''=' || o_orderstatus when o_orderkey % 3 = 1 then 'two' || chr(10) || 'lines, \"' || o_orderstatus || '\"' else '' end as note, 'a|' || o_orderstatus as tags from orders")
def s6_csv_round_trip(spark, sf_dir):
    """Listings written as CSV and read back: formulas guarded, quotes, commas and line ends whole, null as empty."""
    k = F.col("o_orderkey") % 3
    note = F.when(k == 0, F.concat(F.lit("="), "o_orderstatus")).when(k == 1, F.concat(F.lit('two\nlines, "'), "o_orderstatus", F.lit('"')))
    path = fresh(spark, "listings")
    csvio.write_listing_csv(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), note.alias("note"), F.array(F.lit("a"), "o_orderstatus").alias("tags")), path)
    return csvio.read_listing_csv(spark, path).select("key", "note", "tags")


@query("s8_service_tables", "select c_mktsegment as kind, cast(c_custkey as varchar) as id, cast(c_nationkey as varchar) as nation from customer where c_mktsegment in ('BUILDING', 'MACHINERY')")
def s8_service_tables(spark, sf_dir):
    """A table of its own for each of two types, in both formats; the rows are read back from the CSV ones."""
    df = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("listing_type"), F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    path = fresh(spark, "services")
    csvio.write_service_tables(df, {"BUILDING": ["id", "nation"], "MACHINERY": ["id", "nation"]}, path)
    read = lambda t: csvio.read_listing_csv(spark, f"{path}/{t}.csv").select(F.lit(t).alias("kind"), "id", "nation")
    return read("BUILDING").unionByName(read("MACHINERY"))


@query("s10_post_rows", "select 'batch-' || page_id // 50 as batch_id, cast(page_id as varchar) as post_id from pages")
def s10_post_rows(spark, sf_dir):
    good, _ = envelopes.read_envelopes(spark, written_envelopes(spark, sf_dir) + "/*")
    return csvio.post_rows(good.select("batch", "posts")).select("batch_id", "post_id")


# --- functions and rules ----------------------------------------------------------------------------


@query(
    "f10_labels",
    """select o_orderkey, case when o_orderkey % 5 = 0 then 'not given' else rtrim(rtrim(cast(cast(round(cast(o_orderkey % 300 + 30 as decimal(10,4)) / 60, 2) as decimal(10,2)) as varchar), '0'), '.') || ' HR' end as duration,
       'courts: ' || case when o_orderkey % 2 = 0 then (o_orderkey % 7) || ' courts' else 'not given' end || '; people: ' || case when o_orderkey % 3 = 0 then (o_orderkey % 40) || ' people' else 'not given' end as capacity,
       case when o_orderkey % 4 = 0 then '' else format('{:,}', o_orderkey) || '.5/hr' end as rate from orders""",
)
def f10_labels(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", values.duration_label(F.when(k % 5 > 0, k % 300 + 30)).alias("duration"), values.capacity_label(F.when(k % 2 == 0, k % 7), F.when(k % 3 == 0, k % 40)).alias("capacity"),
        values.hourly_label(F.when(k % 4 > 0, k + 0.5)).alias("rate"),
    )


@query(
    "g2_publication_report",
    """with r as (select cast(ts as date) as day, user_id, value > 10 as a, event_type = 'purchase' as p, case when event_type = 'error' then 'duplicate' else 'unique' end as s, case when event_id % 9 = 0 then 'camp' when event_id % 10 = 0 then 'class' end as t, event_id % 3 as c from events)
       select count(distinct day) as batches, count(distinct user_id) as posts, count(distinct case when a then user_id end) as analysed, count(distinct case when p then user_id end) as recruitment, count(*) filter (where t is null) as listings,
       count(*) filter (where t is null and s = 'duplicate') as duplicates, 0 as possible_duplicates, count(*) as total_records, count(*) filter (where t = 'camp') as table_camp, count(*) filter (where t = 'class') as table_class,
       count(distinct case when a and not p then user_id end) as non_recruitment, count(distinct case when not coalesce(a, false) then user_id end) as unanalysed, count(*) filter (where t is null and c = 0) as direct, count(*) filter (where t is null and c > 0) as unavailable from r""",
)
def g2_publication_report(spark, sf_dir):
    n = F.col("event_id")
    df = table(spark, sf_dir, "events").select(
        F.to_date("ts").alias("day"), "user_id", (F.col("value") > 10).alias("a"), (F.col("event_type") == "purchase").alias("r"), F.when(F.col("event_type") == "error", "duplicate").otherwise("unique").alias("s"),
        F.when(n % 9 == 0, "camp").when(n % 10 == 0, "class").alias("t"), (n % 3).alias("c"),
    )
    return publish.publication_stats(df, "day", "user_id", "a", "r", "s", {"direct": "c = 0", "unavailable": "c > 0"}, ("t", ["camp", "class"]))


@query(
    "p23_card_identity",
    """select o_orderkey, case when o_orderkey % 2 = 0 then 'https://s.test/groups/1/posts/' || o_orderkey || '/' end as post_url, case when o_orderkey % 2 = 0 then cast(o_orderkey as varchar) end as post_id, case when o_orderkey % 3 = 0 then true end as is_pinned,
       '3h' as published_time_raw, (o_orderkey % 50) || 'K' as likes_raw, o_orderkey % 50 * 1000 as likes, case when o_orderkey % 4 > 0 then cast(o_orderkey as varchar) end as comments_raw, case when o_orderkey % 4 > 0 then o_orderkey end as comments from orders""",
)
def p23_card_identity(spark, sf_dir):
    k = F.col("o_orderkey")
    n = k.cast("string")
    links = F.when(k % 2 == 0, F.array(F.lit("https://s.test/u/ann"), F.concat(F.lit("https://s.test/groups/1/posts/"), n, F.lit("/")))).otherwise(F.array(F.lit("https://s.test/u/bob")))
    said = F.concat_ws(" · ", F.when(k % 3 == 0, F.lit("Pinned post")), F.lit("3h ago"), F.concat((k % 50).cast("string"), F.lit("K likes")), F.when(k % 4 > 0, F.concat(n, F.lit(" comments"))))
    cards = table(spark, sf_dir, "orders").select("o_orderkey", links.alias("links"), said.alias("text"))
    out = cards_source.card_identity(cards, r"/posts/(\d+)", ["pinned post"], r"(\d+[hd]) ago", {"likes": r"([\d.,]+ ?[KkMm]?) likes", "comments": r"([\d.,]+) comments"})
    return out.select("o_orderkey", "post_url", "post_id", "is_pinned", "published_time_raw", "likes_raw", "likes", "comments_raw", "comments")


NARROW = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
WIDE = "".join(chr(ord(c) + 0xFEE0) for c in NARROW)


@query("f2_folded_fingerprint", "select p_partkey, sha256(lower(p_name)) as fingerprint from part")
def f2_folded_fingerprint(spark, sf_dir):
    """Full-width letters and digits have the fingerprint of the plain ones."""
    wide = F.translate("p_name", NARROW, WIDE)
    return table(spark, sf_dir, "part").select("p_partkey", F.sha2(text.fingerprint_part(wide), 256).alias("fingerprint"))


@query("f3_folded_identity", r"select p_partkey, case when p_partkey % 2 = 0 then '' else '106' end || 'town' || regexp_replace(lower(p_brand), '[^a-z0-9]+', '', 'g') as identity from part")
def f3_folded_identity(spark, sf_dir):
    """Full-width text folds; a postal code goes only before a place that is listed."""
    place = F.when(F.col("p_partkey") % 2 == 0, "106Town ").otherwise("106 Town ")
    wide = F.translate(F.concat(place, "p_brand"), NARROW, WIDE)
    return table(spark, sf_dir, "part").select("p_partkey", text.identity_text(wide, ("town",)).alias("identity"))


@query("f4_folded_search_text", "select p_partkey, lower(p_name || ' ' || p_brand) as search_text from part")
def f4_folded_search_text(spark, sf_dir):
    wide = F.translate("p_name", NARROW, WIDE)
    return table(spark, sf_dir, "part").select("p_partkey", text.search_text(wide, F.lit(""), F.col("p_brand")).alias("search_text"))


@query("f30_valid_date", "select o_orderkey, case o_orderkey % 3 when 0 then cast(o_orderdate as date) end as day from orders")
def f30_valid_date(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    raw = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.lit("2024-02-30")).otherwise(F.date_format("o_orderdate", "yyyy/MM/dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", values.valid_date(raw).alias("day"))


@query("f34_count_units", "select o_orderkey, case o_orderkey % 6 when 0 then o_orderkey * 10000 when 1 then o_orderkey * 1000 when 2 then o_orderkey * 1000000 when 3 then o_orderkey end as n from orders")
def f34_count_units(spark, sf_dir):
    """Counts in every unit that texts use; other signs of number are no unit."""
    k, n = F.col("o_orderkey") % 6, F.col("o_orderkey").cast("string")
    shown = F.when(k == 0, F.concat(n, F.lit(" 萬"))).when(k == 1, F.concat(n, F.lit("K"))).when(k == 2, F.concat(n, F.lit(" m"))).when(k == 3, F.format_number("o_orderkey", 0)).when(k == 4, F.concat(n, F.lit("億"))).otherwise(F.concat(n, F.lit(" 千")))
    return table(spark, sf_dir, "orders").select("o_orderkey", values.normalize_count(shown).alias("n"))


@query("f42_anchor", """select l_orderkey, l_linenumber, l_partkey, '{"schedule":"' || l_returnflag || '","venue":"v' || l_suppkey || '"}' as anchor from lineitem""")
def f42_anchor(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", ids.anchor(F.col("l_returnflag"), F.concat(F.lit("v"), F.col("l_suppkey").cast("string"))).alias("anchor"))


@query(
    "t4_merge_unions",
    """with e as (select user_id, event_id, event_type, case when event_id % 3 = 0 then '' else event_type || event_id end as text, event_id % 2 = 0 as cut from events),
       f as (select user_id, arg_min(text, event_id) as t, arg_min(cut, event_id) as c, arg_min(text, event_id) filter (where text <> '') as said, arg_min(text, event_id) filter (where text <> '' and not cut) as whole from e group by 1),
       k as (select user_id, event_type, min(event_id) as p from e group by 1, 2)
       select user_id, coalesce(case when t = '' then said when c then whole end, t) as text, case when (case when t = '' then said when c then whole end) is not null then false else c end as cut, (select string_agg(event_type, ',' order by p) from k where k.user_id = f.user_id) as kinds from f""",
)
def t4_merge_unions(spark, sf_dir):
    """Text, truncation and the union of lists when records merge."""
    said = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat("event_type", F.col("event_id").cast("string")))
    df = table(spark, sf_dir, "events").select("user_id", "event_id", said.alias("text"), (F.col("event_id") % 2 == 0).alias("cut"), F.array("event_type").alias("kinds"))
    out = collect.merge_stable(df, ["user_id"], "event_id", [], [], "text", "cut", ["kinds"], [])
    return out.select("user_id", "text", "cut", F.array_join("kinds", ",").alias("kinds"))


@query(
    "r_text_rules",
    r"""select doc_id, 'text' as path, 'url' as code from documents where regexp_matches(text, 'https?://') union all select doc_id, 'lang', 'enum' from documents where lang not in ('en', 'de') union all select doc_id, 'lang', 'required' from documents where lang is null
       union all select doc_id, 'n_chars', 'range' from documents where n_chars not between 100 and 5000 union all select doc_id, 'source', 'verbatim' from documents where source is not null and not contains(text, source)
       union all select doc_id, 'context', 'keys' from documents where doc_id % 3 > 0 union all select doc_id, 'listings', 'empty' from documents where doc_id % 4 = 0 or doc_id % 4 = 3""",
)
def r_text_rules(spark, sf_dir):
    """Rules of shape and text over all documents, one row per violation."""
    k, d = F.col("doc_id") % 4, F.col("doc_id") % 3
    none = F.expr("cast(array() as array<int>)")
    listings = F.when((k == 0) | (k == 1), none).otherwise(F.array(F.lit(1)))
    said = F.when(k == 1, F.array(F.lit("insufficient_information"))).otherwise(F.expr("cast(array() as array<string>)"))
    context = F.when(d == 0, F.lit('{"b":1,"a":2}')).when(d == 1, F.lit('{"a":1}')).otherwise(F.lit('{"a":1,"b":2,"c":3}'))
    shape = rules.structure({"lang": F.col("lang"), "n_chars": F.col("n_chars")}, ["lang"], {"lang": ["en", "de"]}, {"n_chars": (100, 5000)}, {}, [])
    broken = shape | {
        ("text", "url"): F.col("text").rlike("https?://") & rules.has_url(F.col("text")), ("source", "verbatim"): rules.not_verbatim(F.col("source"), F.col("text")),
        ("context", "keys"): rules.context_keys(context, [["a", "b"]]), ("listings", "empty"): rules.empty_recruitment(k <= 2, listings, said),
    }
    return rules.violations(table(spark, sf_dir, "documents"), ["doc_id"], broken)


@query(
    "r_schedule_rules",
    """select l_orderkey, l_linenumber, l_partkey, code as code from (select *, unnest([case when l_linenumber % 4 = 0 then 'details' end, case when l_linenumber % 5 = 0 then 'gap' end, case when l_linenumber % 3 > 0 and l_partkey % 24 < 12 then 'duration' end,
         case when l_linenumber % 3 = 0 and l_suppkey % 2 = 0 then 'duration' end, case when l_quantity > 40 then 'tournament' end]) as code from lineitem) where code is not null""",
)
def r_schedule_rules(spark, sf_dir):
    """Details of another type, gaps in numbers, impossible durations and tournaments that end before they begin."""
    n = F.col("l_linenumber")
    type_ = F.when(n % 4 == 0, "course").otherwise("camp")
    numbers = F.array(F.struct(F.when(n % 5 == 0, 1).otherwise(0).alias("listing_index")))
    start = F.when(n % 3 > 0, F.concat(F.lpad((F.col("l_partkey") % 24).cast("string"), 2, "0"), F.lit(":00")))
    offset = F.when(F.col("l_suppkey") % 2 == 0, 1)
    late, early = F.date_format("l_shipdate", "yyyy-MM-dd"), F.date_format(F.date_sub("l_shipdate", 3), "yyyy-MM-dd")
    broken = {
        ("", "details"): rules.service_details(type_, {"camp": [F.lit("x")]}), ("", "gap"): rules.index_gaps(numbers), ("", "duration"): rules.bad_duration(start, F.lit("12:00"), F.when(n % 3 > 0, F.coalesce(offset, F.lit(1))).otherwise(offset)),
        ("", "tournament"): rules.bad_tournament(late, F.when(F.col("l_quantity") > 40, early), F.lit(None).cast("string")),
    }
    return rules.violations(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"], broken).drop("path")


@query(
    "j12_sample_problems",
    """select 'unknown' as problem, cast(doc_id + 1000000000 as varchar) as id from labels where doc_id % 31 = 0 union all select 'duplicate', cast(doc_id as varchar) from labels where doc_id % 31 = 1
       union all select 'duplicate sample', cast(doc_id as varchar) from documents where doc_id % 37 = 0""",
)
def j12_sample_problems(spark, sf_dir):
    gold = table(spark, sf_dir, "documents").select("doc_id")
    said = table(spark, sf_dir, "labels").select(F.when(F.col("doc_id") % 31 == 0, F.col("doc_id") + 1_000_000_000).otherwise(F.col("doc_id")).alias("doc_id"), "quality")
    return quality.sample_problems(gold.unionByName(gold.where("doc_id % 37 = 0")), said.unionByName(said.where("doc_id < 1000000000 and doc_id % 31 = 1")), "doc_id")


@query(
    "r7_evidence",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey % 3 = 1 as bad_quote, (l_suppkey % 4 > 0 and not (l_partkey % 2 = 0)) or (l_linenumber % 2 = 1) as no_evidence from lineitem""",
)
def r7_evidence(spark, sf_dir):
    """Quotes that are not verbatim, and filled facts that nothing is quoted for; derived facts need none."""
    text = F.concat(F.lit("at venue "), F.col("l_suppkey").cast("string"), F.lit(" for 20"))
    quote = F.when(F.col("l_suppkey") % 3 == 1, "Venue").otherwise("venue")
    of = lambda field, c: F.when(c, F.struct(F.lit(field).alias("field"), quote.alias("quote")))
    evidence = F.array_compact(F.array(of("other", F.lit(True)), of("venue", F.col("l_partkey") % 2 == 0), of("fee", F.col("l_linenumber") % 2 == 0)))
    facts = {"venue": F.when(F.col("l_suppkey") % 4 == 1, "hall").when(F.col("l_suppkey") % 4 > 1, "court").otherwise("unknown"), "fee": F.lit(20), "weekday": F.lit("3")}
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", rules.unsupported_quotes(text, evidence).alias("bad_quote"), rules.missing_evidence(facts, evidence, ("weekday",)).alias("no_evidence"),
    )
