"""Registered queries of state machines, scans over large keys, nested contracts and evaluations, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.functions import ids, leaves
from postlens.operators import evaluation, ledger, merge_tree, publish
from postlens.plans import contract
from postlens.queries import ORACLES, big, cluster_rows, query, table
from postlens.streaming import collector
from postlens.workspace import fresh

# --- a log of many events a task -------------------------------------------------------------------

#: Every user is a task (but for every seventh, whose events are of unknown tasks) and every row of events one event of its log.
LOG = """with recursive ev as (select user_id as task, event_id, row_number() over (partition by user_id order by event_id) as n,
    case (event_id * 7 + user_id) % 6 when 0 then 'succeed' when 1 then 'fail' when 2 then 'retry' when 3 then 'recover' else 'start' end as event,
    case when (event_id * 7 + user_id) % 6 = 0 then 'r' || event_id % 2 end as given from events),
  step as (select task, cast(0 as bigint) as n, 'pending' as status, cast(0 as bigint) as attempts, cast(null as varchar) as held, cast(null as bigint) as event_id, cast(null as varchar) as event, cast(null as varchar) as before, cast(null as boolean) as accepted
      from (select distinct task from ev) where task % 7 <> 3
    union all select s.task, e.n,
      case when s.status = 'pending' and e.event = 'start' then 'running' when s.status = 'running' and e.event = 'succeed' then 'succeeded' when s.status = 'running' and e.event = 'fail' then 'failed'
        when s.status = 'failed' and e.event = 'retry' or s.status = 'running' and e.event = 'recover' then 'pending' else s.status end,
      s.attempts + case when s.status = 'pending' and e.event = 'start' then 1 else 0 end,
      case when s.status = 'running' and e.event = 'succeed' then e.given else s.held end, e.event_id, e.event, s.status,
      coalesce(s.status = 'pending' and e.event = 'start' or s.status = 'running' and e.event in ('succeed', 'fail', 'recover') or s.status = 'failed' and e.event = 'retry' or s.status = 'succeeded' and e.event = 'succeed' and s.held is not distinct from e.given, false)
      from step s join ev e on e.task = s.task and e.n = s.n + 1) """


def log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(tasks, replayed events)."""
    kind = (F.col("event_id") * 7 + F.col("user_id")) % 6
    name = F.when(kind == 0, "succeed").when(kind == 1, "fail").when(kind == 2, "retry").when(kind == 3, "recover").otherwise("start")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("task"), "event_id", name.alias("event"), F.when(kind == 0, F.concat(F.lit("r"), (F.col("event_id") % 2).cast("string"))).alias("result"))
    tasks = events.where("task % 7 <> 3").select("task").distinct().select("task", F.lit("pending").alias("status"), F.lit(0).cast("long").alias("attempts"), F.lit(None).cast("string").alias("result"))
    return tasks, ledger.replay(tasks, events, "event_id", "task")


@query("t7_replay", LOG + "select event_id, task, event, before as status_before, accepted, status as status_after, attempts as attempt from step where n > 0 union all select event_id, task, event, null, false, null, null from ev where task % 7 = 3")
def t7_replay(spark, sf_dir):
    return log(spark, sf_dir)[1].select("event_id", "task", "event", "status_before", "accepted", "status_after", big("attempt").alias("attempt"))


@query("t7_replay_rejected", LOG + "select event_id, task, event, before as status from step where n > 0 and not accepted union all select event_id, task, event, null from ev where task % 7 = 3")
def t7_replay_rejected(spark, sf_dir):
    return ledger.rejected(log(spark, sf_dir)[1], "event_id", "task")


@query("t7_states", LOG + "select task, arg_max(status, n) as status, arg_max(attempts, n) as attempts, max(held) as result from step group by 1")
def t7_states(spark, sf_dir):
    tasks, replayed = log(spark, sf_dir)
    return ledger.states(tasks, replayed, "event_id", "task")


ATTEMPTS = LOG + """, m as (select * from step where n > 0 and accepted and before <> status and event <> 'retry'),
  tries as (select task, attempts as attempt, min(event_id) filter (where event = 'start') as started, max(event_id) filter (where event <> 'start') as finished,
    max(case event when 'succeed' then 'succeeded' when 'fail' then 'failed' when 'recover' then 'recovered' end) as outcome, max(held) filter (where event = 'succeed') as result from m group by 1, 2) """


@query("t8_attempts", ATTEMPTS + "select * from tries")
def t8_attempts(spark, sf_dir):
    """The ledger of attempts; appending it to itself adds nothing."""
    made = ledger.attempts(log(spark, sf_dir)[1], "event_id", "task")
    return ledger.append_attempts(made, made, "task")


@query("t8_attempt_counts", ATTEMPTS + "select task, count(*) as attempts, count(*) filter (where outcome = 'failed') as n_failed, count(*) filter (where outcome = 'recovered') as n_recovered, count(*) filter (where outcome is null) as n_open, max(case when outcome = 'succeeded' then attempt end) as succeeded_at from tries group by 1")
def t8_attempt_counts(spark, sf_dir):
    return ledger.attempt_counts(ledger.attempts(log(spark, sf_dir)[1], "event_id", "task"), "task")


# --- leaves, evidence and nested contracts ----------------------------------------------------------

#: A JSON record of every order with its listings nested, the same text on both sides.
RECORDS = """with l as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, cast(l_quantity as bigint) as q, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 as n from lineitem),
  r as (select l_orderkey, '{"id":' || case when l_orderkey % 11 = 0 then '"' || l_orderkey || '"' else cast(l_orderkey as varchar) end || ',"title":"order"' || case when l_orderkey % 13 = 0 then ',"more":1' else '' end || ',"listings":[' ||
    string_agg('{"schedule":{"timezone":"UTC","day":"d' || q || '","end_day_offset":' || (l_suppkey % 2) || '},"price_options":[' || case when l_linenumber % 3 = 0 then '' when l_linenumber % 3 = 1 then '{"amount":' || (q - 5) || ',"currency":"X"}' else '{"amount":' || q || ',"currency":"X"},{"amount":null,"currency":"unknown"}' end
      || '],"status":"' || case when l_partkey % 7 = 0 then 'unknown' when l_partkey % 7 = 1 then '' else l_returnflag end || '","notes":' || case when l_partkey % 5 = 0 then 'null' else '"n"' end || '}', ',' order by n) || ']}' as j from l group by l_orderkey) """


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    q, n = F.col("l_quantity").cast("bigint"), F.col("l_linenumber") % 3
    prices = F.when(n == 0, "").when(n == 1, text('{"amount":', q - 5, ',"currency":"X"}')).otherwise(text('{"amount":', q, ',"currency":"X"},{"amount":null,"currency":"unknown"}'))
    status = F.when(F.col("l_partkey") % 7 == 0, "unknown").when(F.col("l_partkey") % 7 == 1, "").otherwise(F.col("l_returnflag"))
    notes = F.when(F.col("l_partkey") % 5 == 0, "null").otherwise('"n"')
    listing = text('{"schedule":{"timezone":"UTC","day":"d', q, '","end_day_offset":', F.col("l_suppkey") % 2, '},"price_options":[', prices, '],"status":"', status, '","notes":', notes, "}")
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", listing.alias("j")).alias("x"))
    listed = own.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["j"]), ",").alias("listed"))
    key = F.col("l_orderkey")
    id_ = F.when(key % 11 == 0, text('"', key, '"')).otherwise(key.cast("string"))
    return listed.select("l_orderkey", text('{"id":', id_, ',"title":"order"', F.when(key % 13 == 0, ',"more":1').otherwise(""), ',"listings":[', F.col("listed"), "]}").alias("j"))


#: DuckDB's walk of the same records; its places look like [3].
WALK = RECORDS + """, w as (select l_orderkey, regexp_replace(substr(t.fullkey, 3), '\\[(\\d+)\\]', '.\\1', 'g') as path, json_extract_string(t.atom, '$') as value from r, json_tree(r.j) t where t.type not in ('OBJECT', 'ARRAY', 'NULL')),
  f as (select * from w where value not in ('', 'unknown')) """


@query("f40_leaves", WALK + "select l_orderkey, path, value from f")
def f40_leaves(spark, sf_dir):
    """Filled leaves of nested records at any depth, without a list of paths."""
    return leaves.leaves(records(spark, sf_dir), ["l_orderkey"], F.try_parse_json("j"))


EVIDENCE = WALK + """, g as (select l_orderkey, unnest(case when l_orderkey % 5 = 0 then [] when l_orderkey % 2 = 0 then ['listings[0].schedule.day', 'listings.0.status', 'id'] else ['listings.0.price_options[0].amount', 'listings.0.schedule.day'] end) as field,
    case when l_orderkey % 3 = 0 then 'Order' else 'order' end as quote from r where l_orderkey % 7 > 0),
  e as (select l_orderkey, regexp_replace(field, '\\[(\\d+)\\]', '.\\1', 'g') as path, quote from g), own as (select * from f where split_part(path, '.', 1) in ('listings', 'title')),
  a as (select l_orderkey, l_orderkey % 5 = 0 as bare from r where l_orderkey % 7 > 0)
  select l_orderkey, path, 'unfilled' as code from e where (l_orderkey, path) not in (select (l_orderkey, path) from own) union select l_orderkey, path, 'not_quoted' from e where quote = 'Order'
  union select l_orderkey, path, 'missing' from own join a using (l_orderkey) where path <> 'title' and not regexp_matches(path, 'schedule.timezone$|price_options\\.\\d+\\.currency$') and (l_orderkey, path) not in (select (l_orderkey, path) from e)
  union select l_orderkey, 'evidence', 'empty' from a where bare"""


@query("r7_evidence_leaves", EVIDENCE)
def r7_evidence_leaves(spark, sf_dir):
    """Evidence of unfilled leaves, quotes that are not verbatim, and filled leaves without evidence; every seventh record is not asked."""
    key = F.col("l_orderkey")
    fields = F.when(key % 5 == 0, F.array().cast("array<string>")).when(key % 2 == 0, F.array(F.lit("listings[0].schedule.day"), F.lit("listings.0.status"), F.lit("id"))).otherwise(F.array(F.lit("listings.0.price_options[0].amount"), F.lit("listings.0.schedule.day")))
    quote = F.when(key % 3 == 0, "Order").otherwise("order")
    evidence = F.when(key % 7 > 0, F.transform(fields, lambda f: F.struct(f.alias("field"), quote.alias("quote"))))
    df = records(spark, sf_dir).withColumns({"evidence": evidence, "source": F.lit("an order")})
    derived = r"schedule\.timezone$|price_options\.\d+\.currency$"
    return leaves.evidence_problems(df, ["l_orderkey"], F.try_parse_json("j"), ["listings", "title"], F.col("evidence"), F.col("source"), derived)


CONTRACT = {
    "kind": "object", "required": ["id", "listings"],
    "fields": {
        "id": {"kind": "integer", "low": 1}, "title": {"kind": "string", "min_length": 1},
        "listings": {"kind": "array", "min_items": 2, "unique": True, "items": {
            "kind": "object", "required": ["schedule", "status", "notes", "venue"],
            "fields": {
                "schedule": {"kind": "object", "extras": True, "required": ["day"], "fields": {"day": {"kind": "string", "pattern": "^d[0-9]$"}}},
                "price_options": {"kind": "array", "items": {"kind": "object", "fields": {"amount": {"kind": "number", "nullable": True, "low": 0, "high": 40}, "currency": {"kind": "string", "enum": ["X"]}}}},
                "status": {"kind": "string", "enum": ["A", "N", "R", "unknown"]}, "notes": {"any_of": [{"kind": "string"}, {"kind": "integer"}]}, "venue": {"kind": "string"},
            },
        }},
    },
}


@query(
    "r2_contract",
    RECORDS + """, x as (select l_orderkey, n, '/listings/' || n as spot, q, l_suppkey, l_linenumber, l_partkey, l_returnflag, case when l_partkey % 7 = 0 then 'unknown' when l_partkey % 7 = 1 then '' else l_returnflag end as st from l)
  select l_orderkey, '/id' as path, 'kind' as code from r where l_orderkey % 11 = 0 union all select l_orderkey, '/more', 'unknown' from r where l_orderkey % 13 = 0
  union all select l_orderkey, '/listings', 'min_items' from x group by 1 having count(*) < 2
  union all select l_orderkey, '/listings', 'unique' from x group by 1 having count(distinct (q, l_suppkey % 2, case when l_linenumber % 3 = 0 then 0 else l_linenumber % 3 end, st, l_partkey % 5 = 0)) < count(*)
  union all select l_orderkey, spot || '/venue', 'required' from x union all select l_orderkey, spot || '/schedule/day', 'pattern' from x where q > 9
  union all select l_orderkey, spot || '/price_options/0/amount', 'range' from x where l_linenumber % 3 = 1 and (q - 5 < 0 or q - 5 > 40) or l_linenumber % 3 = 2 and q > 40
  union all select l_orderkey, spot || '/price_options/1/currency', 'enum' from x where l_linenumber % 3 = 2 union all select l_orderkey, spot || '/status', 'enum' from x where st not in ('A', 'N', 'R', 'unknown')
  union all select l_orderkey, spot || '/notes', c from x, (values ('any_of'), ('kind')) as v(c) where l_partkey % 5 = 0""",
)
def r2_contract(spark, sf_dir):
    """Every violation of a nested contract, with its place."""
    return contract.problems(records(spark, sf_dir), ["l_orderkey"], F.col("j"), CONTRACT)


# --- digests and anchors -----------------------------------------------------------------------------


@query(
    "s13_digests",
    """with j as (select o_orderpriority as kind, sha256('{"o_orderpriority":"' || o_orderpriority || '","o_orderkey":' || o_orderkey || ',"a":' || case when o_orderkey % 3 = 0 then 'null' else cast(o_custkey as varchar) end || ',"b":' || case when o_orderkey % 3 = 0 then cast(o_custkey as varchar) else 'null' end || '}') as h from orders)
  select kind, count(*) as n, """ + ", ".join(f"cast(sum(cast(('0x' || substr(h, {16 * k + 1}, 16))::ubigint as hugeint)) as varchar) as d{k + 1}" for k in range(4)) + " from j group by 1",
)
def s13_digests(spark, sf_dir):
    """Order-free digests of groups of rows whose value stands in one column or the other."""
    third = F.col("o_orderkey") % 3 == 0
    df = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", F.when(~third, F.col("o_custkey")).alias("a"), F.when(third, F.col("o_custkey")).alias("b")).repartition(5)
    return publish.content_digests(df, ["o_orderpriority"]).select(F.col("o_orderpriority").alias("kind"), "n", *[F.col(f"d{k}").cast("string").alias(f"d{k}") for k in range(1, 5)])


@query("f42_anchor_of_fields", """select l_orderkey, l_linenumber, l_partkey, '{"schedule":{"a":"' || l_returnflag || '","b":' || case when l_linenumber % 2 = 0 then 'null' else cast(l_suppkey as varchar) end || '},"venue":' || case when l_partkey % 3 = 0 then 'null' else '"v"' end || '}' as anchor from lineitem""")
def f42_anchor_of_fields(spark, sf_dir):
    """Anchors do not depend on the order of fields, and tell unknown values from missing ones."""
    a, b = F.col("l_returnflag").alias("a"), F.when(F.col("l_linenumber") % 2 > 0, F.col("l_suppkey")).alias("b")
    rows, venue = table(spark, sf_dir, "lineitem"), F.when(F.col("l_partkey") % 3 > 0, "v")
    of = lambda df, *parts: df.select("l_orderkey", "l_linenumber", "l_partkey", ids.anchor(F.struct(*parts), venue).alias("anchor"))
    return of(rows.where("l_suppkey % 2 = 0"), a, b).unionByName(of(rows.where("l_suppkey % 2 = 1"), b, a))


# --- evaluation of a corpus ----------------------------------------------------------------------------

#: Customers are samples, their orders the listings of an answer; the second answer lacks some, the prediction changes some.
CORPUS = """with s as (select c_custkey as id, c_custkey % 6 > 0 as reviewed, case when c_custkey % 4 = 0 then ['truncated'] when c_custkey % 4 = 1 then ['single', 'late'] else ['single'] end as categories, c_custkey % 8 = 0 as truncated from customer),
  o as (select o_custkey as id, o_orderkey as pos, o_orderstatus || '|' || (o_orderkey % 3) as anchor, o_orderpriority as f1, o_orderkey % 3 as f2 from orders),
  alts as (select id, alt, (id + alt) % 5 > 0 as is_recruitment from s, (values (0), (1)) as v(alt) where id % 10 <> 7),
  ex as (select id, 0 as alt, pos, anchor, f1, f2 from o where id % 10 <> 7 union all select id, 1, pos, anchor, f1, f2 from o where pos % 4 > 0 and id % 10 <> 7),
  p as (select id, id % 9 > 0 as valid, id % 5 > 0 as is_recruitment from s where id % 5 <> 4),
  ac as (select id, pos, case when pos % 17 = 0 then 'zz' else anchor end as anchor, case when pos % 11 = 0 then 'other' else f1 end as f1, f2 from o where pos % 8 > 0 or id % 2 = 0),
  pr as (select a.id, a.alt, a.is_recruitment = p.is_recruitment as classified from alts a join p using (id) where valid),
  ep as (select *, row_number() over (partition by id, alt order by anchor, pos) as place from ex semi join pr using (id, alt)), ap as (select pr.id, pr.alt, a.* exclude (id), row_number() over (partition by pr.id, pr.alt order by anchor, pos) as place from pr join ac a using (id)),
  fc as (select coalesce(e.id, a.id) as id, coalesce(e.alt, a.alt) as alt, e.place is not null and a.place is not null and e.f1 is not distinct from a.f1 as r1, e.place is not null and a.place is not null and e.f2 is not distinct from a.f2 as r2 from ep e full join ap a on e.id = a.id and e.alt = a.alt and e.place = a.place),
  ck as (select id, alt, count(*) as checks, count(*) filter (where r1) as n1, count(*) filter (where r2) as n2 from fc group by 1, 2),
  eb as (select id, alt, anchor, count(*) as n from ep group by all), ab as (select id, alt, anchor, count(*) as n from ap group by all),
  bg as (select coalesce(e.id, a.id) as id, coalesce(e.alt, a.alt) as alt, sum(greatest(coalesce(e.n, 0) - coalesce(a.n, 0), 0)) as missed, sum(greatest(coalesce(a.n, 0) - coalesce(e.n, 0), 0)) as unmatched from eb e full join ab a on e.id = a.id and e.alt = a.alt and e.anchor = a.anchor group by 1, 2),
  sc as (select pr.*, coalesce(checks, 0) as checks, coalesce(n1, 0) as n1, coalesce(n2, 0) as n2, coalesce(missed, 0) as missed, coalesce(unmatched, 0) as unmatched from pr left join ck using (id, alt) left join bg using (id, alt)),
  be as (select * from (select *, row_number() over (partition by id order by n1 + n2 + cast(classified as integer) desc, alt) as k from sc) where k = 1),
  fw as (select id, min(n) as fewest from (select a.id, a.alt, count(e.id) as n from alts a left join ex e using (id, alt) group by 1, 2) group by 1),
  cs as (select s.id, case when not reviewed or fewest is null then 'awaiting_human_annotation' when p.valid is null then 'missing_result' when not p.valid then 'invalid_result' when be.classified and n1 = checks and n2 = checks then 'passed' else 'semantic_mismatch' end as status,
    cast(case when reviewed and fewest is not null then case when p.valid is null then fewest when p.valid then missed end end as bigint) as missed, cast(case when reviewed and fewest is not null and p.valid then unmatched end as bigint) as unmatched,
    case when reviewed and fewest is not null and p.valid then classified end as classified, case when reviewed and fewest is not null and p.valid then concat_ws(',', case when n1 < checks then 'f1' end, case when n2 < checks then 'f2' end) end as wrong_fields
    from s left join fw using (id) left join p on p.id = s.id left join be on be.id = s.id) """


def corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """(samples, alternatives, expected, predicted, actual, fields)"""
    id_ = F.col("id")
    samples = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).withColumns({
        "reviewed": id_ % 6 > 0, "truncated": id_ % 8 == 0,
        "categories": F.when(id_ % 4 == 0, F.array(F.lit("truncated"))).when(id_ % 4 == 1, F.array(F.lit("single"), F.lit("late"))).otherwise(F.array(F.lit("single"))),
    })
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("pos"), F.concat_ws("|", "o_orderstatus", (F.col("o_orderkey") % 3).cast("string")).alias("anchor"), F.col("o_orderpriority").alias("f1"), (F.col("o_orderkey") % 3).alias("f2")
    )
    alternatives = samples.where(id_ % 10 != 7).select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("alt")).withColumn("is_recruitment", (id_ + F.col("alt")) % 5 > 0)
    own = orders.where(id_ % 10 != 7)
    expected = own.withColumn("alt", F.lit(0)).unionByName(own.where("pos % 4 > 0").withColumn("alt", F.lit(1)))
    predicted = samples.where(id_ % 5 != 4).select("id", (id_ % 9 > 0).alias("valid"), (id_ % 5 > 0).alias("is_recruitment"))
    actual = orders.where((F.col("pos") % 8 > 0) | (id_ % 2 == 0)).withColumns({"anchor": F.when(F.col("pos") % 17 == 0, "zz").otherwise(F.col("anchor")), "f1": F.when(F.col("pos") % 11 == 0, "other").otherwise(F.col("f1"))})
    return samples, alternatives, expected, predicted, actual, ["f1", "f2"]


@query("r17_cases", CORPUS + "select * from cs")
def r17_cases(spark, sf_dir):
    return evaluation.cases(*corpus(spark, sf_dir)).withColumn("wrong_fields", F.array_join("wrong_fields", ","))


@query("r17_accuracy", CORPUS + ", rb as (select be.* from be join s using (id) where reviewed) select 'f1' as field, cast(sum(n1) as bigint) as correct, cast(sum(checks) as bigint) as total, sum(n1) / sum(checks) as accuracy from rb union all select 'f2', cast(sum(n2) as bigint), cast(sum(checks) as bigint), sum(n2) / sum(checks) from rb")
def r17_accuracy(spark, sf_dir):
    return evaluation.accuracy(*corpus(spark, sf_dir))


@query("r17_report", CORPUS + """select count(*) as samples, count(*) filter (where status <> 'awaiting_human_annotation') as reviewed, (select string_agg(c, ',' order by c) from (values ('late'), ('never'), ('single'), ('truncated')) as v(c) where c not in
    (select unnest(categories) from s join cs using (id) where status <> 'awaiting_human_annotation' and categories <> ['truncated'] union all select 'truncated' from s join cs using (id) where status <> 'awaiting_human_annotation' and truncated and list_contains(categories, 'truncated'))) as missing_categories,
  cast(sum(missed) as bigint) as missed, cast(sum(unmatched) as bigint) as unmatched, false as passed from cs""")
def r17_report(spark, sf_dir):
    parts = corpus(spark, sf_dir)
    return evaluation.report(parts[0], evaluation.cases(*parts), ["single", "late", "truncated", "never"]).withColumn("missing_categories", F.array_join("missing_categories", ","))


# --- the collector as a stream -------------------------------------------------------------------------


def streamed_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in five files, the latest orders first, read one file a micro-batch."""
    target = fresh(spark, "collector")
    rows = cluster_rows(spark, sf_dir)
    rows.repartitionByRange(5, F.desc("page_id")).write.parquet(f"{target}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{target}/in")
    q = collector.collect_stream(stream, f"{target}/out", f"{target}/checkpoint", "batch", "page_id", ["id", "link"])
    q.awaitTermination()
    return collector.read_clusters(spark, f"{target}/out", q.lastProgress["batchId"])


@query("t3_stream_clusters", ORACLES["t3_clusters"])
def t3_stream_clusters(spark, sf_dir):
    return streamed_clusters(spark, sf_dir).select(F.col("ord").alias("page_id"), "cluster")


@query("t3_stream_counts", f"with k as ({ORACLES['t3_clusters']}) select count(*) as scanned, count(distinct cluster) as exported, count(*) - count(distinct cluster) as duplicates from k")
def t3_stream_counts(spark, sf_dir):
    return collector.counts(streamed_clusters(spark, sf_dir))


# --- posts merged over bridges -----------------------------------------------------------------------------


@query("t4_merge_tree")
def t4_merge_tree(spark, sf_dir):
    """Posts of every batch, merged in the order of the accumulators; the tests hold the operator against a plain collector."""
    rows = cluster_rows(spark, sf_dir).join(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    rows = rows.select("page_id", "batch", "id", "link", F.when(F.col("page_id") % 2 == 0, F.col("link")).alias("author"), F.char_length("html").alias("likes"), F.when(F.col("page_id") % 5 > 0, F.substring("html", -60, 40)).otherwise("").alias("content"), (F.col("page_id") % 3 > 0).alias("cut"), F.array("link").alias("media"), F.col("page_id").alias("stamp"))
    out = merge_tree.merge(rows, "batch", "page_id", ("id", "link"), ["author"], ["likes"], "content", "cut", ["media"], ["stamp"])
    return out.select("cluster", "n_records", "author", "likes", "content", "cut", "stamp", F.array_join("media", ",").alias("media"))
