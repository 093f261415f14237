"""Registered queries over the driver's tables, each with the SQL that must give the same rows.

The tables stand in for the pipeline's own: events are observations by key (an ``error`` has no valid
time), documents are posts, labels their analyses, pages their links, orders and lineitem posts
with nested listings, customer and supplier authors and organisers, conversations task ledgers.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlens.functions import ids, text, urls, values
from postlens.operators import collect, dedupe, history, joins, publish, quality, rules, search, tasks
from postlens.plans import predicates
from postlens.shipping import ship
from postlens.sources import cards as cards_source
from postlens.sources import csvio
from postlens.streaming import latest
from postlens.workspace import fresh

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


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def big(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


# --- history -------------------------------------------------------------------------------------

EVENTS = "with e as (select *, case when event_type <> 'error' then ts end as valid from events)"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("valid", F.when(F.col("event_type") != "error", F.col("ts")))


LATEST = EVENTS + ", l as (select * from e qualify row_number() over (partition by user_id order by valid desc nulls last, event_id desc) = 1)"


@query("w1_latest_by_key", LATEST + " select user_id, event_id, event_type, value from l")
def w1_latest_by_key(spark, sf_dir):
    return history.latest_by_key(observations(spark, sf_dir), "user_id", "valid", "event_id", "event_id").select("user_id", "event_id", "event_type", "value")


@query("p3_latest_of_group", LATEST + " select user_id, event_id from l where event_type = 'view' order by valid desc nulls last, event_id desc limit 50")
def p3_latest_of_group(spark, sf_dir):
    return history.latest_of_group(observations(spark, sf_dir), "user_id", F.col("event_type") == "view", "valid", "event_id", "event_id", 50).select("user_id", "event_id")


@query("p4_history", "select event_id, event_type, value from events where user_id = 7 order by event_id desc limit 50")
def p4_history(spark, sf_dir):
    return history.history(table(spark, sf_dir, "events"), F.col("user_id") == 7, "event_id", "event_id", 50).select("event_id", "event_type", "value")


@query("p5_lookup", "select event_id, user_id, event_type, value from events where event_id = 17")
def p5_lookup(spark, sf_dir):
    return history.lookup(table(spark, sf_dir, "events"), "event_id", 17).select("event_id", "user_id", "event_type", "value")


@query("w2_ordinal", "select event_id, user_id, row_number() over (partition by user_id order by event_id) - 1 as ordinal from events")
def w2_ordinal(spark, sf_dir):
    return history.ordinal(table(spark, sf_dir, "events"), "user_id", "event_id").select("event_id", "user_id", big("ordinal").alias("ordinal"))


@query(
    "w3_versions",
    """select event_id, user_id, row_number() over w as version, coalesce(lag(event_type) over w is distinct from event_type and lag(event_id) over w is not null, false) as type_changed
       from events window w as (partition by user_id order by event_id)""",
)
def w3_versions(spark, sf_dir):
    out = history.versions(table(spark, sf_dir, "events"), "user_id", ["event_id"], {"type_changed": "event_type"})
    return out.select("event_id", "user_id", big("version").alias("version"), "type_changed")


@query(
    "p2_observation_view",
    EVENTS + """ select event_id, array_to_string(list_filter([case when valid is null then 'invalid_scraped_at' end, case when event_type = 'signup' then 'fingerprint_identity' end,
       case when value > 50 then 'source_content_truncated' end], lambda x: x is not null), ',') as quality_warnings from e""",
)
def p2_observation_view(spark, sf_dir):
    df = observations(spark, sf_dir).withColumns({"kind": F.when(F.col("event_type") == "signup", "fingerprint").otherwise("url"), "cut": F.col("value") > 50})
    return history.observation_view(df, "valid", "kind", "cut").select("event_id", F.array_join("quality_warnings", ",").alias("quality_warnings"))


@query(
    "j5_latest_of_batch_keys",
    LATEST + " select user_id, event_id from l where user_id in (select user_id from events where cast(ts as date) in (date '2024-01-03', date '2024-01-05'))",
)
def j5_latest_of_batch_keys(spark, sf_dir):
    df = observations(spark, sf_dir).withColumn("day", F.to_date("ts"))
    days = df.where(F.col("day").isin("2024-01-03", "2024-01-05")).select("day").distinct()
    return history.latest_of_batches(df, days, "user_id", "day", "valid", "event_id", "event_id").select("user_id", "event_id")


@query("o1_latest_all", LATEST + " select user_id, event_id, row_number() over (order by valid desc nulls last, event_id desc) as place from l")
def o1_latest_all(spark, sf_dir):
    return o1_latest_places(spark, sf_dir)


@query("o1_latest_places", LATEST + " select user_id, event_id, row_number() over (order by valid desc nulls last, event_id desc) as place from l")
def o1_latest_places(spark, sf_dir):
    """Every key's latest row with its place."""
    rows = history.latest_by_key(observations(spark, sf_dir), "user_id", "valid", "event_id", "event_id")
    return search.places(rows, history.latest_order("valid", "event_id", "event_id")).select("user_id", "event_id", "place")


@query("u1_keys_of_batches", "select distinct user_id from events where cast(ts as date) = date '2024-01-03' union select distinct user_id from events where cast(ts as date) = date '2024-01-05'")
def u1_keys_of_batches(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return df.where(F.col("day") == "2024-01-03").select("user_id").union(df.where(F.col("day") == "2024-01-05").select("user_id")).distinct()


# --- ingest and ids -------------------------------------------------------------------------------


@query("f44_canonical_digest", """select event_id, sha256('{"k":' || json_extract_string(props, '$.k') || '}') as digest from events""")
def f44_canonical_digest(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", ids.digest(ids.canonical_json(F.col("props"))).alias("digest"))


@query("f45_hash_id", "select event_id, 'event_' || substr(sha256(concat_ws(chr(31), cast(user_id as varchar), event_type, coalesce(cast(null as varchar), ''))), 1, 20) as id from events")
def f45_hash_id(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", ids.hash_id("event", F.col("user_id"), F.col("event_type"), F.lit(None)).alias("id"))


@query(
    "s3_import_new",
    """with d as (select min(event_id) as event_id, props from events group by props), o as (select distinct props from events where cast(ts as date) < date '2024-01-02')
       select event_id, sha256('{"k":' || json_extract_string(props, '$.k') || '}') as input_digest from d where props not in (select props from o)""",
)
def s3_import_new(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("input_digest", ids.digest(ids.canonical_json(F.col("props"))))
    first = rows.groupBy("input_digest").agg(F.min("event_id").alias("event_id"))
    return first.join(rows.where("ts < '2024-01-02'").select("input_digest"), "input_digest", "left_anti").select("event_id", "input_digest")


@query("f41_path_value", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def f41_path_value(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", big(ids.path_value(F.col("props"), "k")).alias("k"))


PAGE_HOST = r"lower(regexp_extract(url, '^https?://([^/?#:]+)', 1))"
PAGE_PATH = r"regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)"
PAGE_QUERY = r"regexp_extract(url, '\?([^#]*)', 1)"
SITE = urls.Site("example.com", "www.example.com", ("utm_source", "ref"), ("fb_",))
CANONICAL = rf"""case when url ~ '^https?://.*' then 'https://' || (case when {PAGE_HOST} = 'example.com' or {PAGE_HOST} like '%.example.com' then 'www.example.com' else {PAGE_HOST} end) ||
 (case when {PAGE_PATH} = '' then '/' else {PAGE_PATH} end) ||
 (case when {PAGE_HOST} = 'example.com' or {PAGE_HOST} like '%.example.com'
   then coalesce('?' || nullif(array_to_string(list_filter(string_split({PAGE_QUERY}, '&'), lambda p: p <> '' and split_part(p, '=', 1) not in ('utm_source', 'ref') and not starts_with(p, 'fb_')), '&'), ''), '')
   else coalesce('?' || nullif({PAGE_QUERY}, ''), '') end) end"""


@query("f14_canonical_url", f"select page_id, {CANONICAL} as url from pages")
def f14_canonical_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical_url(F.col("url"), SITE).alias("url"))


@query("f16_link_url", r"""select page_id, regexp_extract(url, '^([^?#]*)', 1) || coalesce('?' || nullif(array_to_string(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'),
   lambda p: p <> '' and split_part(p, '=', 1) <> 'utm_source'), '&'), ''), '') || regexp_extract(url, '(#.*)$', 1) as url from pages""")
def f16_link_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.link_url(F.col("url"), ("utm_source",)).alias("url"))


@query("f15_unwrap_redirect", "select page_id, case page_id % 4 when 2 then 'https://other.test/l?u=x' || page_id when 3 then 'https://l.redirect.test/l?h=' || page_id else url end as target from pages")
def f15_unwrap_redirect(spark, sf_dir):
    """Links wrapped once and twice, one that only looks wrapped, and a redirector's link without a target."""
    wrap = lambda u: F.concat(F.lit("https://l.redirect.test/l?u="), F.url_encode(u), F.lit("&h=1"))
    once, kind, id_ = wrap(F.col("url")), F.col("page_id") % 4, F.col("page_id").cast("string")
    link = F.when(kind == 0, once).when(kind == 1, wrap(once)).when(kind == 2, F.concat(F.lit("https://other.test/l?u=x"), id_)).otherwise(F.concat(F.lit("https://l.redirect.test/l?h="), id_))
    return table(spark, sf_dir, "pages").select("page_id", urls.unwrap_redirect(link, "redirect.test").alias("target"))


@query("f19_classify_link", f"select page_id, case when {PAGE_HOST} = 'example.com' or {PAGE_HOST} like '%.example.com' then 'site' when {PAGE_HOST} like '%.example.org' then 'messenger' else 'external' end as kind from pages")
def f19_classify_link(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.classify_link(F.col("url"), {"example.org": "messenger", "example.com": "site"}).alias("kind"))


@query("f21_group_source", rf"""select page_id, case when {PAGE_HOST} like '%.example.com' and {PAGE_PATH} ~ '^/en/[^/]+.*' then regexp_extract({PAGE_PATH}, '^/en/([^/]+)', 1) end as name from pages""")
def f21_group_source(spark, sf_dir):
    g = urls.group_source(F.col("url"), SITE, "en")
    own = urls.of_family(urls.host(F.col("url")), "example.com")
    return table(spark, sf_dir, "pages").select("page_id", F.when(own, F.coalesce(g["id"], g["slug"])).alias("name"))


@query("f22_post_id", rf"select page_id, nullif(regexp_extract({PAGE_PATH}, '/[a-z]+/([0-9]+)', 1), '') as post_id from pages")
def f22_post_id(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.post_id(F.col("url"), r"/[a-z]+/(\d+)").alias("post_id"))


@query("f46_post_key", f"""select page_id, case when url like '%utm_source%' then 'fingerprint:' || sha256({PAGE_HOST} || chr(31) || '') when page_id % 2 = 0 then 'url:' || {CANONICAL} else 'post-id:g:' || page_id end as key from pages""")
def f46_post_key(spark, sf_dir):
    lost, even = F.col("url").contains("utm_source"), F.col("page_id") % 2 == 0
    key = ids.post_key(F.when(~lost & even, urls.canonical_url(F.col("url"), SITE)), F.when(~lost & ~even, F.col("page_id").cast("string")), F.lit("g"), ids.fingerprint(urls.host(F.col("url")), F.lit(None)))
    return table(spark, sf_dir, "pages").select("page_id", key["key"].alias("key"))


@query("f17_extract_urls", """select page_id, array_to_string(list_distinct_ordered, ' ') as found from (select page_id,
  list_filter(u, lambda x, i: list_position(u, x) = i) as list_distinct_ordered from (select page_id, list_transform(regexp_extract_all(coalesce(html, '') || ' see ' || url || ').', '(?i)https?://[^\\s<>"''　，。！？；：、（）「」『』【】]+'), lambda x: regexp_replace(x, '[.,;:!?)\\]}]+$', '')) as u from pages))""".replace("\\\\", "\\"))
def f17_extract_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(urls.extract_urls(F.concat(F.coalesce("html", F.lit("")), F.lit(" see "), F.col("url"), F.lit(").")) ), " ").alias("found"))


@query("f18_mask_urls", "select page_id, case when page_id % 3 = 0 then 'page ' || page_id || ' without' else 'see [URL] and [URL]. ' || page_id || case when page_id % 2 = 0 then ' ([URL]) http:/no' else '' end end as masked from pages")
def f18_mask_urls(spark, sf_dir):
    """Links one of which begins with another, links in brackets, and texts without any."""
    id_ = F.col("page_id").cast("string")
    some = F.concat(F.lit("see "), "url", F.lit(" and "), "url", F.lit("/longer. "), id_, F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" ("), F.lower("url"), F.lit(") http:/no"))).otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", urls.mask_urls(F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("page "), id_, F.lit(" without"))).otherwise(some)).alias("masked"))


@query("f23_author_identity", r"""select c_custkey, case when c_custkey % 3 = 0 then 'site:id:' || c_custkey when c_custkey % 3 = 1 then 'site:profile:' || lower(replace(c_name, '#', '.')) end as author from customer""")
def f23_author_identity(spark, sf_dir):
    url = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("https://m.example.com/profile.php?id="), F.col("c_custkey").cast("string"))).otherwise(F.concat(F.lit("https://example.com/"), F.replace("c_name", F.lit("#"), F.lit("."))))
    profile = urls.profile_url(url, F.col("c_custkey") % 3 == 2, SITE, ("groups",))
    return table(spark, sf_dir, "customer").select("c_custkey", urls.author_identity(profile, "site").alias("author"))


@query("f25_contact", """select s_suppkey, case when s_suppkey % 4 = 0 then 'direct' when s_suppkey % 4 = 1 then 'source' when s_suppkey % 4 = 2 then 'partial' else 'unavailable' end as contactability,
  case s_suppkey % 4 when 0 then 'phone' when 1 then 'post' when 2 then 'author' end as first_kind from supplier""")
def f25_contact(spark, sf_dir):
    k = F.col("s_suppkey") % 4
    c = urls.contact(F.lit(None).cast("array<string>"), F.lit(None).cast("string"), F.when(k == 0, "1"), F.when(k <= 1, "p"), F.when(k <= 2, "a"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", c["contactability"].alias("contactability"), c["primary"]["kind"].alias("first_kind"))


@query("f20_link_inventory", f"select page_id, 1 as n_inline, case when {PAGE_HOST} = 'example.com' or {PAGE_HOST} like '%.example.com' then 'site' else 'external' end as post_kind from pages")
def f20_link_inventory(spark, sf_dir):
    inv = urls.link_inventory(F.lit(None).cast("string"), F.col("url"), F.lit(None).cast("string"), F.array(F.col("url")), F.concat(F.lit("at "), F.col("url")), {"example.com": "site"}, ("utm_source",))
    return table(spark, sf_dir, "pages").select("page_id", F.size(inv["inline"]).alias("n_inline"), inv["post"]["kind"].alias("post_kind"))


# --- text, times and values -----------------------------------------------------------------------

CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '[\t ]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))"""


@query("f1_clean_text", f"select doc_id, sha256({CLEAN}) as digest from documents")
def f1_clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.clean_text(F.coalesce("text", F.lit(""))), 256).alias("digest"))


@query("w5_fingerprint_first", f"select min(doc_id) as doc_id, sha256(lower({CLEAN})) as fingerprint from documents group by 2")
def w5_fingerprint_first(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("batch"), F.sha2(text.fingerprint_part(F.col("text"), fold=False), 256).alias("fingerprint"), F.lit(False).alias("keyed"))
    # the first of each fingerprint is a minimum: pre-aggregated, so that a hot text is no hot partition
    return df.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "fingerprint")


@query("f6_contains_any", "select doc_id, regexp_matches(lower(coalesce(text, '')), 'token = |licensed under') as hit from documents")
def f6_contains_any(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.contains_any(F.coalesce("text", F.lit("")), ["Token = ", "licensed UNDER"]).alias("hit"))


@query("s9_csv_safe", "select doc_id, sha256(case when regexp_matches(text, '^[=+\\-@\\t\\r]') then '''' || text else text end) as digest, case when regexp_matches('-' || source, '^\\s*[=+\\-@]') then '''-' || source else source end as guarded from documents".replace("\\\\", "\\"))
def s9_csv_safe(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.csv_safe(F.col("text")), 256).alias("digest"), text.csv_safe(F.concat(F.lit("-"), "source"), "text").alias("guarded"))


@query("f52_preview", "select doc_id, case when length(text) > 100 then substr(text, 1, 97) || '...' else text end as preview from documents")
def f52_preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.preview_text(F.col("text")).alias("preview"))


@query("f51_page_title", r"""select page_id, nullif(trim(regexp_replace(trim(coalesce(nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), ''), '')), '^\(\d+\+?\)\s*', '')), '') as title from pages""")
def f51_page_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.page_title(F.col("html")).alias("title"))


@query("f4_search_text", "select p_partkey, lower(p_name || ' ' || p_brand || ' ' || p_type) as search_text from part")
def f4_search_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.search_text(F.col("p_name"), F.lit(""), F.col("p_brand"), F.col("p_type"), fold=False).alias("search_text"))


@query("f3_identity_text", r"select p_partkey, regexp_replace(lower(p_name || '-' || p_brand), '[^a-z0-9]+', '', 'g') as identity from part")
def f3_identity_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.identity_text(F.concat("p_name", F.lit("-"), "p_brand"), fold=False).alias("identity"))


@query("f50_code_labels", "select event_id, case event_type when 'view' then 'seen' when 'click' then 'used' else event_type end || ',other' as labels from events")
def f50_code_labels(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.array_join(text.code_labels(F.array("event_type", F.lit("other")), {"view": "seen", "click": "used"}), ",").alias("labels"))


@query("f26_valid_timestamp", "select o_orderkey, case when o_orderkey % 3 = 0 then o_orderdate end as at from orders")
def f26_valid_timestamp(spark, sf_dir):
    full = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    shown = F.when(F.col("o_orderkey") % 3 == 0, F.concat(full, F.lit("Z"))).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-02-30T10:00:00Z")))
    return table(spark, sf_dir, "orders").select("o_orderkey", values.valid_timestamp(shown).cast("timestamp_ntz").alias("at"))


@query("f27_absolute_time", "select o_orderkey, case when o_orderkey % 2 = 0 then o_orderdate - interval 8 hour end as at from orders")
def f27_absolute_time(spark, sf_dir):
    shown = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm"), F.lit("+0800"))).otherwise("3 hours ago")
    return table(spark, sf_dir, "orders").select("o_orderkey", values.absolute_time(shown).cast("timestamp_ntz").alias("at"))


@query("f28_reference_time", EVENTS + " select event_id, case when event_type = 'view' then 'published' when valid is not null then 'scraped' else 'unavailable' end as source from e")
def f28_reference_time(spark, sf_dir):
    r = values.reference_time(F.when(F.col("event_type") == "view", F.col("ts")), F.col("valid"), F.lit(None).cast("timestamp"))
    return observations(spark, sf_dir).select("event_id", r["source"].alias("source"))


@query("f29_weekday", "select o_orderkey, cast(dayofweek(o_orderdate) as integer) as weekday from orders")
def f29_weekday(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", values.weekday(F.to_date("o_orderdate")).alias("weekday"))


@query("f31_duration", """select l_orderkey, l_linenumber, case when m > 0 and m <= 1440 then m end as minutes from
  (select l_orderkey, l_linenumber, cast((l_suppkey % 24) * 60 + (l_linenumber % 2) * 1440 - ((l_partkey % 24) * 60 + 30) as integer) as m from lineitem)""")
def f31_duration(spark, sf_dir):
    clock = lambda c, m: F.format_string(f"%02d:{m}", (F.col(c) % 24).cast("int"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", values.duration_minutes(clock("l_partkey", "30"), clock("l_suppkey", "00"), F.col("l_linenumber") % 2).alias("minutes"))


@query("f32_schedule_identity", """select o_orderkey, case when o_orderkey % 3 = 0 then 'date:' || strftime(o_orderdate, '%Y-%m-%d') || '|19:00|21:00|0' when o_orderkey % 3 = 1 then 'weekly:1-3|19:00|21:00|0' end as identity from orders""")
def f32_schedule_identity(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    s = values.schedule_identity(F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")), F.when(k == 1, F.array(F.lit(3), F.lit(1))), F.lit("19:00"), F.lit("21:00"), F.lit(None).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", s.alias("identity"))


@query("f33_date_group", "select o_orderkey, case when o_orderkey % 5 = 0 then 'weekly' when o_orderkey % 7 = 0 then 'unknown' else strftime(o_orderdate, '%Y-%m-%d') end as heading from orders")
def f33_date_group(spark, sf_dir):
    date = F.when(F.col("o_orderkey") % 7 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", values.date_group(date, F.when(F.col("o_orderkey") % 5 == 0, F.array(F.lit(1)))).alias("heading"))


@query("f34_normalize_count", """select event_id, case when event_id % 3 = 0 then cast(round(value * 100) as bigint) * 10 when event_id % 3 = 1 then cast(floor(value) as bigint)
  else case when cast(round(value * 100) as bigint) % 100 = 0 then cast(round(value) as bigint) end end as n from events""")
def f34_normalize_count(spark, sf_dir):
    cents = F.round(F.col("value") * 100).cast("bigint")
    exact = F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    shown = F.when(F.col("event_id") % 3 == 0, F.concat(exact, F.lit("K"))).when(F.col("event_id") % 3 == 1, F.format_number(F.floor("value"), 0)).otherwise(exact)
    return table(spark, sf_dir, "events").select("event_id", values.normalize_count(shown).alias("n"))


@query("f37_metric_from_text", "select event_id, cast(floor(value) as bigint) as n from events")
def f37_metric_from_text(spark, sf_dir):
    shown = F.concat(F.lit("All reactions: "), F.floor("value").cast("string"), F.lit(" Like"))
    return table(spark, sf_dir, "events").select("event_id", values.metric_from_text(shown, [r"(\d+) comments", r"reactions: (\d[\d,.]*)"]).alias("n"))


def nested_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with its lines as price options."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_extendedprice").cast("int").alias("amount"), F.when(F.col("l_linenumber") % 3 > 0, F.col("l_linenumber") * 30).alias("duration_minutes"), F.col("l_returnflag").alias("condition")))).alias("options")
    )
    return items


@query("g7_fee_range", "select l_orderkey, min(cast(floor(l_extendedprice) as integer)) as fee_min, max(cast(floor(l_extendedprice) as integer)) as fee_max from lineitem group by 1")
def g7_fee_range(spark, sf_dir):
    r = values.fee_range(F.col("options"))
    return nested_orders(spark, sf_dir).select("l_orderkey", r["fee_min"].alias("fee_min"), r["fee_max"].alias("fee_max"))


@query("f35_hourly_price", """with o as (select l_orderkey, cast(floor(l_extendedprice) as integer) as a, case when l_linenumber % 3 > 0 then l_linenumber * 30 else 120 end as d, min(cast(floor(l_extendedprice) as integer)) over (partition by l_orderkey) as least from lineitem)
  select l_orderkey, round(min(a * 60.0 / d), 4) as rate from o where a = least group by 1""")
def f35_hourly_price(spark, sf_dir):
    return nested_orders(spark, sf_dir).select("l_orderkey", F.round(values.hourly_price(F.col("options"), F.lit(120)), 4).alias("rate"))


@query("f9_price_display", """select l_orderkey, string_agg('TWD ' || cast(floor(l_extendedprice) as integer) || ' (' || l_returnflag || case when l_linenumber % 3 > 0 then ', ' || l_linenumber * 30 || ' min' else '' end || ')', ' / '
  order by l_linenumber, cast(floor(l_extendedprice) as integer), case when l_linenumber % 3 > 0 then l_linenumber * 30 end, l_returnflag) as shown from lineitem group by 1""")
def f9_price_display(spark, sf_dir):
    return nested_orders(spark, sf_dir).select("l_orderkey", values.price_display(F.col("options")).alias("shown"))


@query("f38_venue_identity", "select s_suppkey, case when s_suppkey % 2 = 0 then 'address:' || lower(s_name) else 'name:' || lower(n_name) || '::' || lower(s_name) end as venue from supplier join nation on s_nationkey = n_nationkey")
def f38_venue_identity(spark, sf_dir):
    df = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    v = values.venue_identity(F.when(F.col("s_suppkey") % 2 == 0, F.lower("s_name")), F.lower("n_name"), F.lit(None).cast("string"), F.lower("s_name"))
    return df.select("s_suppkey", v.alias("venue"))


@query("f39_organisers", "select s_suppkey, case when s_suppkey % 2 = 0 then 'team:' || s_name || ',phone:' || s_nationkey else 'phone:' || s_nationkey end as organisers from supplier")
def f39_organisers(spark, sf_dir):
    o = values.organiser_identities(team=F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")), line=F.lit(""), phone=F.col("s_nationkey").cast("string"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(o, ",").alias("organisers"))


@query("f11_registration_text", "select event_id, case event_type when 'view' then 'By form；walk' when 'click' then 'walk' else event_type || '；walk' end as shown from events")
def f11_registration_text(spark, sf_dir):
    r = values.registration_text(F.array("event_type", F.lit("walk"), "event_type"), {"view": "By form"}, F.array(F.lit("click")))
    return table(spark, sf_dir, "events").select("event_id", r.alias("shown"))


@query("f10_time_label", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || ' 19:00-+1d 01:00' as label from orders")
def f10_time_label(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", values.time_label(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(None).cast("array<int>"), F.lit("19:00"), F.lit("01:00"), F.lit(1)).alias("label"))


# --- joins ----------------------------------------------------------------------------------------


@query("j1_join_by_id", "select d.doc_id, l.toxic, l.quality from documents d left join labels l using (doc_id)")
def j1_join_by_id(spark, sf_dir):
    return joins.join_by_id(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id").rows.select("doc_id", "toxic", "quality")


def _judged(spark, sf_dir) -> joins.Joined:
    results = table(spark, sf_dir, "labels").withColumn("doc_id", F.when(F.col("doc_id") % 50 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id")))
    return joins.join_by_id(table(spark, sf_dir, "documents").select("doc_id"), results, "doc_id")


RESULTS = "with r as (select case when doc_id % 50 = 0 then -doc_id - 1 else doc_id end as doc_id, toxic from labels)"


@query("j1_problems", RESULTS + """ select 'unknown' as problem, cast(doc_id as varchar) as id from r where doc_id not in (select doc_id from documents)
  union all select 'missing', cast(doc_id as varchar) from documents where doc_id not in (select doc_id from r) union all select 'duplicate', cast(doc_id as varchar) from r group by doc_id having count(*) > 1""")
def j1_problems(spark, sf_dir):
    return joins.check_joined(_judged(spark, sf_dir), "doc_id")


@query("j1_report", RESULTS + """ select (select count(*) from documents) as sources, (select count(*) from documents join r using (doc_id)) as matched, (select count(*) from documents where doc_id not in (select doc_id from r)) as missing,
  (select count(distinct doc_id) from r where doc_id not in (select doc_id from documents)) as unknown, (select count(*) from (select doc_id from r group by 1 having count(*) > 1)) as duplicate""")
def j1_report(spark, sf_dir):
    return joins.join_report(_judged(spark, sf_dir), "doc_id", "toxic")


@query("j2_batch_lookup", "select s_suppkey, n_name, r_name from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def j2_batch_lookup(spark, sf_dir):
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "supplier").join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "r_name")


@query("g13_duplicate_ids", "select l_orderkey, count(*) as n from lineitem group by 1 having count(*) > 1")
def g13_duplicate_ids(spark, sf_dir):
    return joins.duplicates(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("j11_mismatches", "select o_orderkey, case when o_orderkey % 11 = 0 then 'only_a' else 'differs' end as side from orders where o_orderkey % 11 = 0 or o_orderkey % 13 = 0")
def j11_mismatches(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    b = a.where("o_orderkey % 11 <> 0").withColumn("o_custkey", F.when(F.col("o_orderkey") % 13 == 0, -1).otherwise(F.col("o_custkey")))
    return joins.mismatches(a, b, "o_orderkey")


@query("j13_align", """with e as (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) - 1 as position, l_partkey from lineitem),
  a as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) - 1 as position, l_partkey from lineitem where l_linenumber <= 3)
  select coalesce(e.l_orderkey, a.l_orderkey) as l_orderkey, cast(coalesce(e.position, a.position) as integer) as position, e.l_partkey as expected, a.l_partkey as actual from e full join a on e.l_orderkey = a.l_orderkey and e.position = a.position""")
def j13_align(spark, sf_dir):
    items = lambda df: df.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("items"))
    lines = table(spark, sf_dir, "lineitem")
    return joins.align(items(lines), items(lines.where("l_linenumber <= 3")), ["l_orderkey"], "items")


@query("u3_bag_difference", """select 'missed' as side, l_suppkey, l_returnflag from (select l_suppkey, l_returnflag from lineitem where l_linenumber < 4 except all select l_suppkey, l_returnflag from lineitem where l_linenumber >= 4)
  union all select 'unmatched', l_suppkey, l_returnflag from (select l_suppkey, l_returnflag from lineitem where l_linenumber >= 4 except all select l_suppkey, l_returnflag from lineitem where l_linenumber < 4)""")
def u3_bag_difference(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_linenumber")
    missed, unmatched = joins.bag_difference(lines.where("l_linenumber < 4").drop("l_linenumber"), lines.where("l_linenumber >= 4").drop("l_linenumber"))
    return missed.select(F.lit("missed").alias("side"), "*").union(unmatched.select(F.lit("unmatched"), "*"))


@query("j14_lookup_ids", "select o_orderkey, c_custkey, c_name from (select o_orderkey, unnest([o_custkey, o_custkey + 1]) as k from orders) left join customer on k = c_custkey where c_custkey is not null")
def j14_lookup_ids(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.array("o_custkey", F.col("o_custkey") + 1).alias("ids"))
    return joins.left_lookup(df, "ids", table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", "").where("c_name is not null").select("o_orderkey", "c_custkey", "c_name")


@query("j16_dataset_overview", "select c_custkey, coalesce(n, 0) as n, case when n is null then 'not published' else 'published' end as state from customer left join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey")
def j16_dataset_overview(spark, sf_dir):
    releases = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_orderdate").alias("released_at"))
    out = publish.dataset_overview(table(spark, sf_dir, "customer").select("c_custkey"), releases, "c_custkey")
    return out.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), "state")


# --- plans and search -----------------------------------------------------------------------------

FIELDS = predicates.Fields(("status", "priority", "total", "key", "tags", "day", "clerk"), {"total": "number", "key": "number", "tags": "array"})
ROWS = """with r as (select o_orderkey as key, case when o_orderkey % 10 = 0 then null else o_orderstatus end as status, o_orderpriority as priority, case when o_orderkey % 7 = 0 then null else o_totalprice end as total,
  case when o_orderkey % 9 = 0 then null else string_split(o_orderpriority, '-') end as tags, strftime(o_orderdate, '%Y-%m-%d') as day from orders)"""


def plan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderstatus")).alias("status"), F.col("o_orderpriority").alias("priority"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("total"), F.when(F.col("o_orderkey") % 9 != 0, F.split("o_orderpriority", "-")).alias("tags"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
    )


def _leaf(field, op, value):
    return {"field": field, "op": op, "value": value}


PLANS = {
    "p6a_eq": (_leaf("status", "eq", "F"), "coalesce(status = 'F', false)"),
    "p6b_neq": (_leaf("status", "neq", "F"), "coalesce(status <> 'F', false)"),
    "p6c_contains": ({"any": [_leaf("tags", "contains", "HIGH"), _leaf("priority", "contains", "LOW")]}, "coalesce(list_contains(tags, 'HIGH'), false) or coalesce(contains(priority, 'LOW'), false)"),
    "p6d_in": (_leaf("status", "in", ["F", "P"]), "coalesce(status in ('F', 'P'), false)"),
    "p6d_in_null": (_leaf("status", "in", ["F", None]), "coalesce(status in ('F'), false) or status is null"),
    "p6e_lt": (_leaf("total", "lt", 100000.0), "coalesce(total < 100000, false)"),
    "p6f_lte": (_leaf("total", "lte", 100000.0), "coalesce(total <= 100000, false)"),
    "p6g_gt": (_leaf("day", "gt", "1998-01-01"), "coalesce(day > '1998-01-01', false)"),
    "p6h_gte": (_leaf("total", "gte", 300000.0), "coalesce(total >= 300000, false)"),
    "p6i_includes_text": (_leaf("priority", "includes_text", "ＨＩＧＨ"), "contains(lower(priority), 'high')"),
    "p6j_is_known": ({"all": [_leaf("tags", "is_known", True), _leaf("total", "is_known", False)]}, "tags is not null and total is null"),
    "p6_nested": (
        {"all": [{"any": [_leaf("status", "eq", "F"), {"all": [_leaf("total", "gt", 200000.0), _leaf("day", "lt", "1997-01-01")]}]}, _leaf("priority", "neq", "5-LOW"), {"all": []}]},
        "(coalesce(status = 'F', false) or (coalesce(total > 200000, false) and day < '1997-01-01')) and priority <> '5-LOW'",
    ),
}


def _plan_query(name: str, where: dict, sql: str) -> None:
    @query(name, f"{ROWS} select key from r where {sql}")
    def run(spark, sf_dir, where=where):
        plan = predicates.validate(predicates.make_plan(where), FIELDS)
        return plan_rows(spark, sf_dir).where(predicates.compile_where(plan["where"], FIELDS)).select("key")


for _name, (_where, _sql) in PLANS.items():
    _plan_query(_name, _where, _sql)


@query("p7_typed_fields", "select o_orderkey as key, o_orderkey % 2 = 0 as even, len(string_split(o_orderpriority, '-')) as n_tags, case when o_orderkey % 5 > 0 then round(o_totalprice, 2) end as total from orders")
def p7_typed_fields(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "true").otherwise("false").alias("b"), F.replace("o_orderpriority", F.lit("-"), F.lit("|")).alias("a"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice").cast("string")).otherwise("").alias("n"))
    return df.select(F.col("o_orderkey").alias("key"), predicates.typed(F.col("b"), "boolean").alias("even"), big(F.size(predicates.typed(F.col("a"), "array"))).alias("n_tags"), F.round(predicates.typed(F.col("n"), "number"), 2).alias("total"))


LISTED = """with r as (select l_orderkey * 10 + l_linenumber as id, cast(l_orderkey as varchar) as grp, case l_returnflag when 'A' then 'open' when 'N' then 'unknown' else 'full' end as status,
  case when l_linestatus = 'F' then 'duplicate' else 'unique' end as dedupe_status, case l_suppkey % 4 when 0 then 'direct' when 1 then 'source' when 2 then 'partial' else 'unavailable' end as contactability,
  case l_partkey % 3 when 0 then true when 1 then false end as beginner, case when l_linenumber % 5 > 0 then cast(floor(l_extendedprice) as integer) end as fee, l_linenumber / 10.0 as confidence,
  case when l_linenumber % 4 > 0 then strftime(l_shipdate, '%Y-%m-%d') end as date, case when l_linenumber % 3 > 0 then lpad(cast(l_suppkey % 24 as varchar), 2, '0') || ':00' end as start_time, 'v' || l_partkey as venue
  from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_extendedprice) = 1)"""


def listing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = lambda c, table_, last: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table_.items() for x in kv]), c), F.lit(last))
    n = F.col("l_linenumber")
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice")
    return (
        table(spark, sf_dir, "lineitem")
        .withColumn("_n", F.row_number().over(w))
        .where("_n = 1")
        .select(
            (F.col("l_orderkey") * 10 + n).alias("id"), F.col("l_orderkey").cast("string").alias("grp"), flag(F.col("l_returnflag"), {"A": "open", "N": "unknown"}, "full").alias("status"),
            F.when(F.col("l_linestatus") == "F", "duplicate").otherwise("unique").alias("dedupe_status"), flag(F.col("l_suppkey") % 4, {0: "direct", 1: "source", 2: "partial"}, "unavailable").alias("contactability"),
            F.when(F.col("l_partkey") % 3 == 0, True).when(F.col("l_partkey") % 3 == 1, False).alias("beginner"), F.when(n % 5 > 0, F.floor("l_extendedprice").cast("int")).alias("fee"), (n / 10.0).alias("confidence"),
            F.when(n % 4 > 0, F.date_format("l_shipdate", "yyyy-MM-dd")).alias("date"), F.when(n % 3 > 0, F.concat(F.lpad((F.col("l_suppkey") % 24).cast("string"), 2, "0"), F.lit(":00"))).alias("start_time"), F.concat(F.lit("v"), F.col("l_partkey").cast("string")).alias("venue"),
        )
    )


PREFERENCES = {"beginner_friendly": True, "max_fee": 40000}
SCORE = """(case contactability when 'direct' then 30 when 'source' then 20 when 'partial' then 10 else 0 end + case status when 'open' then 5 when 'unknown' then 1 else 0 end + case beginner when true then 15 when false then -30 else 0 end
  + case when fee is null then -5 when fee <= 40000 then 10 else -15 end + confidence * 5)"""
ORDER = "coalesce(date, '9999-99-99'), coalesce(start_time, '99:99'), coalesce(venue, ''), id"


def score_column() -> F.Column:
    return search.preference_score(PREFERENCES, F.col("contactability"), F.col("beginner"), F.col("fee"), F.col("status"), F.col("confidence"))


@query("p8_include_flags", LISTED + " select id from r where dedupe_status <> 'duplicate' and status <> 'full' and contactability <> 'unavailable'")
def p8_include_flags(spark, sf_dir):
    return listing_rows(spark, sf_dir).where(predicates.include_flags({"cancelled": True}, require_contact=True)).select("id")


@query("p9_facet_plan", LISTED + " select id from r where (date in ('1998-03-04', '1998-03-05') or weekday in (6)) and start_time >= '12:00' and fee <= 60000 and status = 'open'".replace("from r", "from (select *, dayofweek(try_cast(date as date)) as weekday from r)"))
def p9_facet_plan(spark, sf_dir):
    fields = predicates.Fields(("date", "weekday", "recurrence_weekdays", "start_time", "fee_max", "status"), {"recurrence_weekdays": "array", "weekday": "number", "fee_max": "number"})
    plan = predicates.facet_plan({"dates": ["1998-03-04", "1998-03-05"], "weekdays": [6], "from_time": "12:00", "fee_max": 60000, "status": "open"})
    df = listing_rows(spark, sf_dir).withColumns({"weekday": values.weekday(F.to_date("date")), "recurrence_weekdays": F.lit(None).cast("array<int>"), "fee_max": F.col("fee")})
    return df.where(predicates.compile_where(predicates.validate(plan, fields)["where"], fields)).select("id")


@query("f36_score", LISTED + f" select id, round({SCORE}, 4) as score from r")
def f36_score(spark, sf_dir):
    return listing_rows(spark, sf_dir).select("id", F.round(score_column(), 4).alias("score"))


@query("o3_query_order", LISTED + f" select id, row_number() over (order by {SCORE} desc, {ORDER}) as place from r")
def o3_query_order(spark, sf_dir):
    return o3_query_places(spark, sf_dir)


@query("o3_query_places", LISTED + f" select id, row_number() over (order by {SCORE} desc, {ORDER}) as place from r")
def o3_query_places(spark, sf_dir):
    """Every row with its place in the order of a query."""
    return search.places(listing_rows(spark, sf_dir).withColumn("score", score_column()), search.row_order()).select("id", "place")


@query("g8_group_variants", LISTED + f""", s as (select *, {SCORE} as score from r where fee is not null and dedupe_status <> 'duplicate' and status not in ('full', 'cancelled')),
  k as (select *, row_number() over (partition by grp order by score desc, {ORDER}) as n from s)
  select grp as group_id, round(max(score), 4) as score, max(id) filter (where n = 1) as primary_id, string_agg(id, ',' order by n) as variants from k group by grp""")
def g8_group_variants(spark, sf_dir):
    fields = predicates.Fields(("fee",), {"fee": "number"})
    groups = search.search(listing_rows(spark, sf_dir), predicates.make_plan(_leaf("fee", "is_known", True)), fields, score_column(), "grp")
    return groups.select("group_id", F.round("score", 4).alias("score"), F.col("primary").alias("primary_id"), F.array_join(F.col("variants").cast("array<string>"), ",").alias("variants"))


def _browse(name: str, direction: str):
    @query(name, LISTED + f" select id, row_number() over (order by fee {direction} nulls last, {ORDER}) as place from r")
    def run(spark, sf_dir):
        order = search.browse_order(F.col("fee"), direction == "desc", search.row_order()[1:])
        return search.places(listing_rows(spark, sf_dir), order).select("id", "place")


_browse("o5_browse_fee_asc", "asc")
_browse("o5_browse_fee_desc", "desc")


@query("o6_date_class_order", LISTED + " select id, row_number() over (order by case when id % 5 = 0 then 0 when date is not null then 1 else 2 end, coalesce(date, case when id % 5 = 0 then '1,3' end) desc nulls last, id) as place from r")
def o6_date_class_order(spark, sf_dir):
    df = listing_rows(spark, sf_dir).withColumn("weekdays", F.when(F.col("id") % 5 == 0, F.array(F.lit(1), F.lit(3))))
    order = search.date_class_order(F.col("date"), F.col("weekdays"), True, F.col("id"))
    return search.places(df, order).select("id", "place")


@query("o7_default_time_order", LISTED + " select id, row_number() over (order by case when date is not null then 0 else 2 end, coalesce(date, ''), coalesce(start_time, '99:99'), id) as place from r")
def o7_default_time_order(spark, sf_dir):
    order = search.default_time_order(F.col("date"), F.lit(None).cast("array<int>"), F.col("start_time"), F.lit(None).cast("string"), F.lit(0), F.col("id"))
    return search.places(listing_rows(spark, sf_dir), order).select("id", "place")


def _browse_places(name: str, direction: str):
    @query(name, LISTED + f" select id, row_number() over (order by fee {direction} nulls last, {ORDER}) as place from r")
    def run(spark, sf_dir):
        order = search.browse_order(F.col("fee"), direction == "desc", search.row_order()[1:])
        return search.places(listing_rows(spark, sf_dir), order).select("id", "place")


# o5, o6 and o7 without their limits
_browse_places("o5_browse_places_asc", "asc")
_browse_places("o5_browse_places_desc", "desc")


@query("o6_date_class_places", LISTED + " select id, row_number() over (order by case when id % 5 = 0 then 0 when date is not null then 1 else 2 end, coalesce(date, case when id % 5 = 0 then '1,3' end) desc nulls last, id) as place from r")
def o6_date_class_places(spark, sf_dir):
    df = listing_rows(spark, sf_dir).withColumn("weekdays", F.when(F.col("id") % 5 == 0, F.array(F.lit(1), F.lit(3))))
    return search.places(df, search.date_class_order(F.col("date"), F.col("weekdays"), True, F.col("id"))).select("id", "place")


@query("o7_default_time_places", LISTED + " select id, row_number() over (order by case when date is not null then 0 else 2 end, coalesce(date, ''), coalesce(start_time, '99:99'), id) as place from r")
def o7_default_time_places(spark, sf_dir):
    order = search.default_time_order(F.col("date"), F.lit(None).cast("array<int>"), F.col("start_time"), F.lit(None).cast("string"), F.lit(0), F.col("id"))
    return search.places(listing_rows(spark, sf_dir), order).select("id", "place")


@query("g14_group_headings", LISTED + " select id, count(*) over (partition by h) as n_group, row_number() over (partition by h order by coalesce(start_time, '99:99'), id) = 1 as is_heading from (select *, coalesce(date, 'unknown') as h from r)")
def g14_group_headings(spark, sf_dir):
    df = listing_rows(spark, sf_dir).withColumn("h", values.date_group(F.col("date"), F.lit(None).cast("array<int>")))
    return search.group_headings(df, "h", [F.coalesce("start_time", F.lit("99:99")), F.col("id")], "id").select("id", "n_group", "is_heading")


@query("o10_selection", "select count(*) as n_rows, cast(sum(length(text)) as bigint) as n_chars, count(distinct source) as n_sources, count(*) > 50 or sum(length(text)) > 100000 as over_limit from documents where doc_id in (1, 2, 3, 5, 8, 13)")
def o10_selection(spark, sf_dir):
    return search.selection(table(spark, sf_dir, "documents"), [1, 2, 3, 5, 8, 13], "doc_id", "text", "source")


@query("w10_source_numbers", "select doc_id, dense_rank() over (order by first, source) as source_number from (select *, min(doc_id) over (partition by source) as first from documents)")
def w10_source_numbers(spark, sf_dir):
    return search.source_numbers(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", big("source_number").alias("source_number"))


@query("p20_without_authors", "select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_mktsegment = 'MACHINERY')")
def p20_without_authors(spark, sf_dir):
    out = table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return search.without_authors(table(spark, sf_dir, "orders"), out, "o_custkey").select("o_orderkey")


# --- listings, duplicates, publication ------------------------------------------------------------

EVENT_ROWS = """with r as (select l_orderkey * 10 + l_linenumber as id, l_orderkey * 1000 + row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as ord, l_orderkey as source, 'p' || l_partkey % 50 || '|' || strftime(l_shipdate, '%Y-%m') as key,
  l_suppkey as org, case when l_linenumber % 4 = 0 then '' else cast(cast(floor(l_quantity) as integer) as varchar) end as content from lineitem)"""


def event_rows(spark, sf_dir):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    # source order first, then the position in the source: no global numbering is needed
    rows = table(spark, sf_dir, "lineitem").withColumn("ord", F.col("l_orderkey") * 1000 + F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order[1:])))
    return rows.select(
        big("ord").alias("ord"), "l_linenumber", F.col("l_orderkey").alias("source"), F.concat(F.lit("p"), (F.col("l_partkey") % 50).cast("string"), F.lit("|"), F.date_format("l_shipdate", "yyyy-MM")).alias("key"),
        F.array(F.col("l_suppkey")).alias("organisers"), F.when(F.col("l_linenumber") % 4 == 0, "").otherwise(F.floor("l_quantity").cast("int").cast("string")).alias("content"),
    )


def _judged_events(rows):
    out = dedupe.judge_events(rows, "ord", "ord", "key", "source", "organisers", "content")
    return out.select("ord", "status", "duplicate_of", "n_candidates", F.when(F.col("status") == "duplicate", F.get("reasons", 2)).alias("reason"))


@query("w6_dedupe_events", EVENT_ROWS + """, m as (select *, min(ord) over (partition by key, source) as fs, min(ord) over (partition by key, org) as fo, case when content <> '' then min(ord) over (partition by key, content) end as ft, min(ord) over (partition by key) as f0 from r),
  s as (select *, least(fs, fo, coalesce(ft, fs)) as l from m), o as (select *, max(case when l >= ord and ord > f0 then 1 else 0 end) over (partition by key) as open_, count(*) over (partition by key order by ord) - 1 as n_before, count(*) over (partition by key) as n_all from s)
  select ord, case when l < ord then 'duplicate' when ord > f0 then 'possible_duplicate' when open_ = 1 then 'possible_duplicate' else 'unique' end as status, case when l < ord then l end as duplicate_of,
  case when l < ord then 0 when ord > f0 then n_before when open_ = 1 then n_all - 1 else 0 end as n_candidates, case when l < ord then case when fs = l then 'same_source_post' when fo = l then 'same_organizer' else 'same_source_content' end end as reason from o""")
def w6_dedupe_events(spark, sf_dir):
    return _judged_events(event_rows(spark, sf_dir))


@query("w6_dedupe_all_events", ORACLES["w6_dedupe_events"])
def w6_dedupe_all_events(spark, sf_dir):
    return w6_dedupe_events(spark, sf_dir)


@query("p13_listings", "select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) - 1 as listing_index, l_partkey from lineitem where l_orderkey % 3 > 0")
def p13_listings(spark, sf_dir):
    nested = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("listings"))
    joined = nested.select("l_orderkey", F.struct((F.col("l_orderkey") % 3 > 0).alias("is_recruitment"), "listings").alias("analysis"))
    return publish.listings(joined).select("l_orderkey", big("listing_index").alias("listing_index"), "listing.l_partkey")


@query("p1_flatten", "select o_orderkey as id, o_custkey as who_key, o_orderstatus as what_status, o_totalprice as what_price_total from orders")
def p1_flatten(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.struct(F.col("o_custkey").alias("key")).alias("who"), F.struct(F.col("o_orderstatus").alias("status"), F.struct(F.col("o_totalprice").alias("total")).alias("price")).alias("what"))
    return csvio.flatten(df)


@query("s7_csv_columns", "select cast(o_orderkey as varchar) as key, case when o_orderkey % 2 = 0 then '''-' || o_orderkey else '' end as n, replace(o_orderpriority, '-', '|') as tags from orders")
def s7_csv_columns(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("-"), F.col("o_orderkey").cast("string"))).alias("n"), F.split("o_orderpriority", "-").alias("tags"))
    return csvio.csv_columns(df)


@query("j4_resolve_publication", LATEST + """, ready as (select user_id, event_id from l where event_id % 2 = 0), prev as (select distinct user_id from events where event_type = 'purchase' and cast(ts as date) < date '2024-01-15')
  select l.user_id, case when r.event_id is not null then 'published' when p.user_id is not null then 'stale' else 'unpublished' end as state from l left join ready r on r.user_id = l.user_id and r.event_id = l.event_id left join prev p on p.user_id = l.user_id""")
def j4_resolve_publication(spark, sf_dir):
    rows = observations(spark, sf_dir)
    latest = history.latest_by_key(rows, "user_id", "valid", "event_id", "event_id").select("user_id", "event_id")
    ready = latest.where("event_id % 2 = 0").withColumn("result", F.lit("new"))
    previous = rows.where("event_type = 'purchase' and ts < '2024-01-15'").select("user_id").distinct().withColumn("result", F.lit("old"))
    return publish.resolve_publication(latest, ready, previous, "user_id", "event_id").select("user_id", "state")


@query("p19_can_refresh", "select o_orderkey, o_orderkey % 4 > 0 as same from orders")
def p19_can_refresh(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select("o_orderkey", F.lit(None).cast("string").alias("x"), "o_orderstatus")
    b = a.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderstatus")).otherwise("?"))
    return publish.can_refresh(a, b, "o_orderkey", ["x", "o_orderstatus"])


@query("p12_split_by_type", "select case when p_type in ('ECONOMY') or p_type is null then 'main' else p_type end as part, count(*) as n from part group by 1")
def p12_split_by_type(spark, sf_dir):
    parts = publish.split_by_type(table(spark, sf_dir, "part"), "p_type", "ECONOMY", ("SMALL", "LARGE", "STANDARD", "PROMO", "MEDIUM"))
    out = None
    for name, df in parts.items():
        n = df.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(name).alias("part"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("g1_count_by", "select event_type, count(*) as n from events group by 1")
def g1_count_by(spark, sf_dir):
    return publish.count_by(table(spark, sf_dir, "events"), "event_type")


@query("g2_publication_stats", """select count(distinct day) as batches, count(distinct user_id) as posts, count(distinct case when value > 10 then user_id end) as analysed, count(distinct case when event_type = 'purchase' then user_id end) as recruitment, count(*) as listings,
  count(*) filter (where event_type = 'error') as duplicates, 0 as possible_duplicates from (select *, cast(ts as date) as day from events)""")
def g2_publication_stats(spark, sf_dir):
    df = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "user_id", (F.col("value") > 10).alias("a"), (F.col("event_type") == "purchase").alias("r"), F.when(F.col("event_type") == "error", "duplicate").otherwise("unique").alias("s"))
    return publish.publication_stats(df, "day", "user_id", "a", "r", "s")


@query("g3_warning_histogram", "select w as warning, count(*) as n from (select unnest(case when l_linenumber % 2 = 0 then ['missing_price', l_returnflag] else [l_returnflag] end) as w from lineitem) group by 1")
def g3_warning_histogram(spark, sf_dir):
    w = F.array_compact(F.array(F.when(F.col("l_linenumber") % 2 == 0, "missing_price"), F.col("l_returnflag")))
    return publish.warning_histogram(table(spark, sf_dir, "lineitem").select(w.alias("w")), "w")


# --- tasks ----------------------------------------------------------------------------------------

TASKS = """with t as (select conv_id || ':' || turn as task_id, cast(conv_id as varchar) as context, case when turn % 5 = 0 then 'pending' when turn % 5 = 1 then 'running' when turn % 5 = 2 then 'failed' else 'succeeded' end as status,
  turn % 4 as attempts, turn as finished_at, case when turn % 5 > 2 then role end as result, cast(case when turn % 7 = 0 then 'x' end as varchar) as reused_from, turn % 3 = 0 as needs_review from conversations)"""


def task_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn, kind = F.col("turn"), F.col("turn") % 5
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string")).alias("task_id"), F.col("conv_id").cast("string").alias("context"),
        F.when(kind == 0, "pending").when(kind == 1, "running").when(kind == 2, "failed").otherwise("succeeded").alias("status"),
        (turn % 4).alias("attempts"), turn.alias("finished_at"), F.when(kind > 2, F.col("role")).alias("result"), F.when(turn % 7 == 0, "x").alias("reused_from"), (turn % 3 == 0).alias("needs_review"),
    )


@query("j7_reuse", TASKS + " select context, task_id, result from t where status = 'succeeded' qualify row_number() over (partition by context order by finished_at desc, task_id desc) = 1")
def j7_reuse(spark, sf_dir):
    return tasks.reuse(task_rows(spark, sf_dir), ["context"]).select("context", "task_id", "result")


@query("t5_prepare", TASKS + ", u as (select context, task_id, result from t where status = 'succeeded' qualify row_number() over (partition by context order by finished_at desc, task_id desc) = 1) select c.context, case when u.task_id is null then 'pending' else 'succeeded' end as status, u.task_id as reused_from from (select distinct context from t) c left join u using (context)")
def t5_prepare(spark, sf_dir):
    df = task_rows(spark, sf_dir)
    return tasks.prepare(df.select("context").distinct(), df, ["context"], ids.hash_id("task", F.col("context"))).select("context", "status", "reused_from")


EVENTS_OF_TASKS = """, v as (select task_id, case when finished_at % 3 = 0 then 'start' when finished_at % 3 = 1 then 'fail' else 'succeed' end as event, case when finished_at % 3 = 2 then 'user' end as result from t)"""
MOVED = "case when status = 'pending' and event = 'start' then 'running' when status = 'running' and event = 'succeed' then 'succeeded' when status = 'running' and event = 'fail' then 'failed' when status = 'failed' and event = 'retry' then 'pending' when status = 'running' and event = 'recover' then 'pending' end"


def _moves(df: DataFrame) -> DataFrame:
    k = F.col("finished_at") % 3
    return df.select("task_id", F.when(k == 0, "start").when(k == 1, "fail").otherwise("succeed").alias("event"), F.when(k == 2, "user").alias("result"))


@query("t7_transition", TASKS + EVENTS_OF_TASKS + f" select task_id, coalesce({MOVED}, status) as status, attempts + case when {MOVED} = 'running' then 1 else 0 end as attempts from t join v using (task_id)")
def t7_transition(spark, sf_dir):
    df = task_rows(spark, sf_dir)
    return tasks.transition(df, _moves(df))[0].select("task_id", "status", "attempts")


@query("t7_rejected", TASKS + EVENTS_OF_TASKS + f" select task_id, status, event from t join v using (task_id) where {MOVED} is null and not (status = 'succeeded' and event = 'succeed' and t.result is not distinct from v.result)")
def t7_rejected(spark, sf_dir):
    df = task_rows(spark, sf_dir)
    return tasks.transition(df, _moves(df))[1]


@query("t9_accept_results", TASKS + """ , s as (select case when finished_at % 6 = 5 then 'no:' || task_id else task_id end as task_id, case when finished_at % 4 = 3 then 'old' else 'now' end as contract, finished_at from t union all select task_id, 'now', 6 from t where finished_at = 6)
  select task_id, case when task_id like 'no:%' then 'unknown' when n > 1 then 'duplicate' when contract = 'old' then 'old_contract' when finished_at % 2 = 1 then 'invalid' else 'accepted' end as outcome from (select *, count(*) over (partition by task_id) as n from s)""")
def t9_accept_results(spark, sf_dir):
    df = task_rows(spark, sf_dir).withColumn("contract", F.lit("now"))
    n = F.col("finished_at")
    results = df.select(F.when(n % 6 == 5, F.concat(F.lit("no:"), "task_id")).otherwise(F.col("task_id")).alias("task_id"), F.when(n % 4 == 3, "old").otherwise("now").alias("contract"), "finished_at")
    results = results.union(df.where("finished_at = 6").select("task_id", F.lit("now"), "finished_at"))
    return tasks.accept_results(df, results, F.col("finished_at") % 2 == 0, "contract").select("task_id", "outcome")


@query("p18_claimable", TASKS + " select task_id from t where status = 'pending' or status = 'failed' and attempts < 3 order by task_id limit 100")
def p18_claimable(spark, sf_dir):
    return tasks.claimable(task_rows(spark, sf_dir), 3, 100, ["task_id"]).select("task_id")


@query("o12_chunks", TASKS + " select task_id, (row_number() over (order by task_id) - 1) // 8 as chunk from t where status = 'pending'")
def o12_chunks(spark, sf_dir):
    return tasks.chunks(task_rows(spark, sf_dir).where("status = 'pending'"), ["task_id"], 8).select("task_id", big("chunk").alias("chunk"))


@query("j8_latest_attempt", "select conv_id, turn, role from conversations qualify row_number() over (partition by conv_id order by turn desc) = 1")
def j8_latest_attempt(spark, sf_dir):
    return tasks.latest_attempt(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role")


@query("g4_task_summary", TASKS + " select context, count(*) as total, count(*) filter (where status = 'pending') as pending, count(*) filter (where status = 'running') as running, count(*) filter (where status = 'succeeded') as succeeded, count(*) filter (where status = 'failed') as failed, count(reused_from) as reused, count(*) filter (where needs_review) as needs_review, bool_or(status <> 'succeeded') as partial from t group by 1")
def g4_task_summary(spark, sf_dir):
    return tasks.summary(task_rows(spark, sf_dir), ["context"])


@query("g18_progress", TASKS + " select count(*) filter (where status = 'pending') as pending, count(*) filter (where status = 'running') as running, count(*) filter (where status = 'succeeded') as succeeded, count(*) filter (where status = 'failed') as failed, count(*) filter (where status = 'failed' and attempts < 3) as retry_pending, count(*) filter (where status = 'failed' and attempts >= 3) as exhausted from t")
def g18_progress(spark, sf_dir):
    return tasks.progress(task_rows(spark, sf_dir), 3)


@query("t6_upsert", "select o_orderkey, case when o_orderkey % 10 = 0 then 'new' else o_orderstatus end as o_orderstatus from orders")
def t6_upsert(spark, sf_dir):
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return tasks.upsert(old, old.where("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("new")), "o_orderkey")


@query("t14_frozen", "select cast(o_orderkey as varchar) as task_id, case when o_orderkey % 10 = 0 then 'gone' else 'new' end as change from orders where o_orderkey % 10 = 0 or o_orderkey % 10 = 1")
def t14_frozen(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("task_id"))
    k = F.col("task_id").cast("bigint") % 10
    return tasks.frozen(df.where(k != 1), df.where(k != 0))


@query("t10_extract", "select 'd' || doc_id as task_id, case when doc_id % 7 > 0 then cast(length(coalesce(text, '')) as varchar) end as result, case when doc_id % 7 = 0 then 2 else 1 end as attempts from documents")
def t10_extract(spark, sf_dir):
    def call(pdf):
        return [None if int(i[1:]) % 7 == 0 else str(len(t)) for i, t in zip(pdf["task_id"], pdf["context"])]

    df = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("task_id"), F.coalesce("text", F.lit("")).alias("context"))
    return tasks.extract(df, call, most_attempts=2).select("task_id", "result", "attempts")


# --- collector, cards, rules, quality -------------------------------------------------------------

RECORDS = f"with r as (select page_id, page_id % 5 as batch, case when page_id % 3 > 0 then nullif(regexp_extract({PAGE_PATH}, '/[a-z]+/([0-9]+)', 1), '') end as id, case when page_id % 4 > 0 then {PAGE_HOST} || (page_id % 20) end as link from pages)"


def cluster_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = urls.host(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 5).alias("batch"), F.when(F.col("page_id") % 3 > 0, urls.post_id(F.col("url"), r"/[a-z]+/(\d+)")).alias("id"), F.when(F.col("page_id") % 4 > 0, F.concat(h, (F.col("page_id") % 20).cast("string"))).alias("link"))


@query("t3_clusters", RECORDS + """, e as (select a.page_id as x, b.page_id as y from r a join r b on a.batch = b.batch and (a.id = b.id or a.link = b.link)),
  c as (with recursive c(page_id, root) as (select page_id, page_id from r union select e.y, c.root from c join e on e.x = c.page_id) select page_id, min(root) as cluster from c group by 1) select page_id, cluster from c""")
def t3_clusters(spark, sf_dir):
    return collect.clusters(cluster_rows(spark, sf_dir), "batch", "page_id", ["id", "link"]).select("page_id", "cluster")


@query("t4_merge_stable", """select user_id, count(*) as n_records, arg_min(event_id, event_id) filter (where event_type = 'view') as first_view, arg_max(value, event_id) filter (where event_type <> 'error') as last_value, arg_max(event_type, event_id) as latest_type from events group by 1""")
def t4_merge_stable(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "view", F.col("event_id")).alias("first_view"), F.when(F.col("event_type") != "error", F.col("value")).alias("last_value"), F.col("event_type").alias("latest_type"), F.lit("t").alias("text"), F.lit(False).alias("cut"), F.array("event_type").alias("kinds"))
    out = collect.merge_stable(df, ["user_id"], "event_id", ["first_view"], ["last_value"], "text", "cut", ["kinds"], ["latest_type"])
    return out.select("user_id", "n_records", "first_view", "last_value", "latest_type")


@query("w5_first_fingerprints", "select page_id from (select page_id, page_id % 4 = 0 as keyed, row_number() over (partition by page_id % 5, lang, page_id % 4 = 0 order by page_id) as n from (select page_id, regexp_extract(url, '/([a-z]+)/[0-9]+', 1) as lang from pages)) where keyed or n = 1")
def w5_first_fingerprints(spark, sf_dir):
    df = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 5).alias("batch"), F.regexp_extract("url", "/([a-z]+)/[0-9]+", 1).alias("lang"), (F.col("page_id") % 4 == 0).alias("keyed"))
    return collect.first_fingerprints(df, "batch", "page_id", "lang", "keyed").select("page_id")


@query("g6_batch_stats", """select strftime(ts, '%Y-%m-%d') as day, count(*) as scanned, count(*) filter (where event_type in ('view', 'click')) as exported, count(*) filter (where event_type = 'signup') as excluded, count(*) filter (where event_type = 'purchase') as duplicates,
  count(*) filter (where event_type = 'error') as failed, true as adds_up from events group by 1""")
def g6_batch_stats(spark, sf_dir):
    kind = F.when(F.col("event_type").isin("view", "click"), "exported").when(F.col("event_type") == "signup", "excluded").when(F.col("event_type") == "purchase", "duplicate").otherwise("failed")
    return collect.batch_stats(table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), kind.alias("outcome")), "day", "outcome")


@query("s17_cards", "select page_id, len(regexp_extract_all(html, '<article[ >]')) as n_cards from pages where html like '%<article%'")
def s17_cards(spark, sf_dir):
    return cards_source.cards_from_pages(table(spark, sf_dir, "pages")).groupBy("page_id").agg(F.count("*").alias("n_cards"))


@query(
    "p15_classify_cards",
    r"""select page_id, 0 as position, case when contains(lower(t), 'sponsored') then 'excluded' when t <> '' then 'supported' else 'unknown' end as kind, 0 as n_media, case when t <> '' then contains(lower(t), 'see more') end as content_is_truncated
        from (select page_id, trim(regexp_replace(regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1), '<[^>]*>', '', 'g')) as t from pages where html like '%<article%')""",
)
def p15_classify_cards(spark, sf_dir):
    c = cards_source.parse_card(cards_source.cards_from_pages(table(spark, sf_dir, "pages")), "Anonymous", ["see more"])
    kind = cards_source.classify(F.col("text"), F.coalesce("label", F.lit("")), ["sponsored"], ["comment"], F.size("links") + F.length("text") > 0)
    return c.select("page_id", "position", kind.alias("kind"), F.size("media").alias("n_media"), "content_is_truncated")


@query("p14_minimum_data", "select event_id, event_type = 'view' or event_type = 'click' or (event_type = 'purchase' and user_id % 2 = 0) as keep from events")
def p14_minimum_data(spark, sf_dir):
    kind = F.col("event_type")
    one = lambda v: F.when(kind == v, v)
    keep = rules.minimum_data(one("view"), one("click"), one("purchase"), F.when(F.col("user_id") % 2 == 0, "a"), F.lit(""))
    return table(spark, sf_dir, "events").select("event_id", keep.alias("keep"))


@query("p16_post_warnings", "select event_id, array_to_string(list_filter([case when event_type = 'error' then 'missing_identity' end, case when value > 50 then 'content_truncated' end, 'time_not_normalized'], lambda x: x is not null), ',') as warnings from events")
def p16_post_warnings(spark, sf_dir):
    raw = F.lit("yesterday")
    w = rules.post_warnings(F.when(F.col("event_type") != "error", "1"), F.lit(None).cast("string"), F.col("value") > 50, raw, values.absolute_time(raw), [F.lit("3")], [F.lit(3)])
    return table(spark, sf_dir, "events").select("event_id", F.array_join(w, ",").alias("warnings"))


@query("r_rules", """select * from (select l_orderkey, l_linenumber, l_partkey, unnest([case when l_quantity > 40 and l_returnflag = 'A' then 'full_with_vacancies' end, case when l_tax > l_discount then 'levels' end, case when l_returnflag not in ('A', 'N') then 'enum' end, case when l_quantity not between 5 and 45 then 'range' end]) as code from lineitem) where code is not null""")
def r_rules(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    broken = {
        ("vacancies", "full_with_vacancies"): rules.bad_vacancies(F.col("l_quantity") - 40, F.lit(100), F.when(F.col("l_returnflag") == "A", "full")),
        ("skill", "levels"): rules.bad_levels(F.col("l_tax"), F.col("l_discount")),
        **rules.structure({"flag": F.col("l_returnflag"), "quantity": F.col("l_quantity")}, ["flag"], {"flag": ["A", "N"]}, {"quantity": (5, 45)}, {}, []),
    }
    return rules.violations(df, ["l_orderkey", "l_linenumber", "l_partkey"], broken).select("l_orderkey", "l_linenumber", "l_partkey", "code")


@query("r8_dates", "select o_orderkey, o_orderkey % 3 = 0 or (o_orderkey % 3 = 1 and dayofweek(o_orderdate) <> 2) as bad from orders")
def r8_dates(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    date = F.when(k == 0, "2026-02-30").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(rules.bad_date(date, F.when(k == 1, F.array(F.lit(2)))), F.lit(False)).alias("bad"))


@query("r7_quotes", "select doc_id, length(text) > 0 as ok from documents where text is not null")
def r7_quotes(spark, sf_dir):
    df = table(spark, sf_dir, "documents").where("text is not null")
    wrong = rules.unsupported_quotes(F.col("text"), F.array(F.struct(F.lit("a").alias("field"), F.substring("text", 3, 20).alias("quote"))))
    return df.select("doc_id", ((F.length("text") > 0) & ~wrong).alias("ok"))


@query("r14_quality_warnings", "select l_orderkey, l_linenumber, l_partkey, case when l_linenumber % 5 = 0 then 'missing_price,' || l_returnflag when l_linenumber % 5 = 1 then 'missing_price' else l_returnflag end as warnings from lineitem")
def r14_quality_warnings(spark, sf_dir):
    n = F.col("l_linenumber") % 5
    w = rules.quality_warnings(F.when(n == 0, F.array(F.lit("missing_price"))), F.when(n != 1, F.array("l_returnflag")), {"missing_price": n < 2})
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(w, ",").alias("warnings"))


@query("r14_all_quality_warnings", "select l_orderkey, l_linenumber, l_partkey, case when l_linenumber % 5 = 0 then 'missing_price,' || l_returnflag when l_linenumber % 5 = 1 then 'missing_price' else l_returnflag end as warnings from lineitem")
def r14_all_quality_warnings(spark, sf_dir):
    n = F.col("l_linenumber") % 5
    w = rules.quality_warnings(F.when(n == 0, F.array(F.lit("missing_price"))), F.when(n != 1, F.array("l_returnflag")), {"missing_price": n < 2})
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(w, ",").alias("warnings"))


@query("r15_registry", "select 'bad_id' as problem, c_name as what from customer union all select 'repeated_id', c_mktsegment from customer group by 2 having count(*) > 1 union all select 'bad_id', c_mktsegment from customer")
def r15_registry(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    df = c.select(F.col("c_name").alias("id"), F.array("c_name").alias("batch_ids")).union(c.select("c_mktsegment", F.expr("cast(array() as array<string>)")))
    return rules.registry(df)


PREDICTED = "with b as (select doc_id, quality as eq, case when doc_id % 6 = 0 then null else case when doc_id % 5 = 0 then 1 - quality else quality end end as aq, case when doc_id % 4 > 0 then toxic end as et, toxic as pt from labels)"


@query("g9_field_accuracy", PREDICTED + """ select 'quality' as field, count(*) filter (where eq is not null and eq is not distinct from aq) as correct, count(eq) as total, round(count(*) filter (where eq is not null and eq is not distinct from aq) / count(eq), 9) as accuracy from b
  union all select 'toxic', count(*) filter (where et is not null and et is not distinct from pt), count(et), round(count(*) filter (where et is not null and et is not distinct from pt) / count(et), 9) from b""")
def g9_field_accuracy(spark, sf_dir):
    q, k = F.col("quality"), F.col("doc_id")
    both = table(spark, sf_dir, "labels").select(q.alias("expected_quality"), F.when(k % 6 != 0, F.when(k % 5 == 0, 1 - q).otherwise(q)).alias("actual_quality"), F.when(k % 4 > 0, F.col("toxic")).alias("expected_toxic"), F.col("toxic").alias("actual_toxic"))
    return quality.field_accuracy(both, ["quality", "toxic"]).withColumn("accuracy", F.round("accuracy", 9))


@query("g10_missed_unmatched", """with e as (select l_suppkey, count(*) as e from lineitem where l_linenumber <= 3 group by 1), a as (select l_suppkey, count(*) as a from lineitem where l_linenumber > 3 group by 1)
  select cast(sum(greatest(coalesce(e, 0) - coalesce(a, 0), 0)) as bigint) as missed, cast(sum(greatest(coalesce(a, 0) - coalesce(e, 0), 0)) as bigint) as unmatched from e full join a using (l_suppkey)""")
def g10_missed_unmatched(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return quality.missed_and_unmatched(lines.where("l_linenumber <= 3"), lines.where("l_linenumber > 3"), ["l_suppkey"])


@query("w8_best_alternative", "select l_orderkey, l_linenumber, l_quantity from lineitem qualify row_number() over (partition by l_orderkey order by l_quantity desc, l_linenumber, l_partkey) = 1")
def w8_best_alternative(spark, sf_dir):
    return quality.best_alternative(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity", "l_linenumber").select("l_orderkey", "l_linenumber", "l_quantity")


@query("r17_sample_status", "select doc_id, case when doc_id % 5 = 0 then 'awaiting_human_annotation' when toxic is null then 'missing_result' when doc_id % 7 = 0 then 'invalid_result' when toxic = 0 then 'passed' else 'semantic_mismatch' end as status from documents left join labels using (doc_id)")
def r17_sample_status(spark, sf_dir):
    gold = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 5 > 0).alias("reviewed"))
    predicted = table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") % 7 > 0).alias("valid"), (F.col("toxic") == 0).alias("matches"))
    return quality.sample_status(gold, predicted, "doc_id", "reviewed", "valid", "matches")


@query("g11_quality_gate", "select count(*) as reviewed, 'xx' as missing, false as all_passed, false as ready from documents where doc_id % 2 = 0")
def g11_quality_gate(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select((F.col("doc_id") % 2 == 0).alias("reviewed"), F.array("lang").alias("categories"), F.when(F.col("doc_id") % 3 == 0, "passed").otherwise("semantic_mismatch").alias("status"))
    return quality.gate(df, ["de", "en", "xx"]).select("reviewed", F.array_join("missing_categories", ",").alias("missing"), "all_passed", "ready")


@query("g12_distinct", "select count(distinct user_id) as users, count(distinct event_type) as kinds from events")
def g12_distinct(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("kinds"))


@query("g16_distinct_sets", "select user_id, count(distinct event_type) as n from events group by 1")
def g16_distinct_sets(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("n"))


@query("p24_extract_media", f"""select page_id, 1 + case when {PAGE_HOST} = 'example.com' or {PAGE_HOST} like '%.example.com' then 0 else 1 end as n_media from pages""")
def p24_extract_media(spark, sf_dir):
    m = cards_source.extract_media(F.array(F.lit("a.png"), F.lit("a.png")), F.lit(None).cast("array<string>"), F.array("url", F.lit("/local")), "example.com")
    return table(spark, sf_dir, "pages").select("page_id", F.size(m).alias("n_media"))


@query("p25_parent_by_agreement", "select l_orderkey, case when l_orderkey % 5 = 0 then 'a' when count(distinct l_returnflag) = 1 and bool_and(l_quantity > 3) then min(l_returnflag) end as parent_id from lineitem group by 1")
def p25_parent_by_agreement(spark, sf_dir):
    cards = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("c"), F.collect_list(F.col("l_quantity") > 3).alias("g"))
    return cards_source.parent_by_agreement(cards, ["l_orderkey"], F.when(F.col("l_orderkey") % 5 == 0, "a"), F.col("c"), F.col("g"))


@query("p26_dataset_columns", "select s_suppkey, r_regionkey as dataset_id, r_name as dataset_name from supplier join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey and r_regionkey < 3")
def p26_dataset_columns(spark, sf_dir):
    registry = table(spark, sf_dir, "region").where("r_regionkey < 3").select(F.col("r_regionkey").alias("batch_id"), F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("batch_id"))
    return publish.add_dataset_columns(rows, registry).select("s_suppkey", "dataset_id", "dataset_name")


@query("f40_leaf_facts", "select o_orderkey, case when o_orderkey % 3 = 0 then 1 else 2 end as n_facts, o_orderstatus as status from orders")
def f40_leaf_facts(spark, sf_dir):
    record = F.struct(F.struct(F.col("o_orderstatus").alias("status")).alias("state"), F.when(F.col("o_orderkey") % 3 == 0, "unknown").otherwise("x").alias("note"), F.array(F.lit("")).alias("tags"))
    facts = ids.leaf_facts(record, ["state.status", "note", "tags.0"])
    return table(spark, sf_dir, "orders").select("o_orderkey", F.size(facts).alias("n_facts"), F.try_element_at(facts, F.lit("state.status")).alias("status"))


@query("t13_reconcile", "select o_orderkey, case when o_orderkey = 7 then 'published' else o_orderstatus end as status from orders")
def t13_reconcile(spark, sf_dir):
    return publish.reconcile(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("publication_id"), F.col("o_orderstatus").alias("status")), "7").select("o_orderkey", "status")


# --- streaming ------------------------------------------------------------------------------------


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of its files."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events.parque[t]")


@query("t1_stream_latest", LATEST + " select user_id, event_id, event_type, value from l")
def t1_stream_latest(spark, sf_dir):
    stream = event_stream(spark, sf_dir).withColumn("valid", F.when(F.col("event_type") != "error", F.col("ts")))
    target = fresh(spark, "latest")
    q = latest.latest_stream(stream, target, f"{target}/checkpoint", "user_id", "valid", "event_id", "event_id")
    q.awaitTermination()
    return latest.read_latest(spark, target, q.lastProgress["batchId"]).select("user_id", "event_id", "event_type", "value")


@query("t2_stream_dedupe", "select distinct cast(json_extract_string(props, '$.k') as bigint) as k from events")
def t2_stream_dedupe(spark, sf_dir):
    stream = event_stream(spark, sf_dir).select(ids.digest(ids.canonical_json(F.col("props"))).alias("digest"), big(ids.path_value(F.col("props"), "k")).alias("k"))
    target = fresh(spark, "digests")
    q = latest.dedupe_stream(stream, "digest").writeStream.format("parquet").option("path", f"{target}/rows").option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{target}/rows").select("k")
