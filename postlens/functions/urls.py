"""URL functions as Column expressions. Hosts and tracking parameters are parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

WEB = r"(?i)^https?://"
#: Where a URL in running text ends: blanks, brackets, quotes and CJK punctuation.
TEXT_URL = r"(?i)https?://[^\s<>\"'　，。！？；：、（）「」『』【】]+"


@dataclass(frozen=True)
class Site:
    """A host family: every host that ends in ``suffix`` is ``host``, and ``tracking`` parameters mean nothing."""

    suffix: str
    host: str
    tracking: tuple[str, ...] = ()
    tracking_prefix: tuple[str, ...] = ()


def part(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit(name))


def host(url: Column) -> Column:
    return F.lower(part(url, "HOST"))


def of_family(h: Column, suffix: str) -> Column:
    return (h == suffix) | h.endswith("." + suffix)


def without_params(query: Column, names: tuple[str, ...], prefixes: tuple[str, ...] = ()) -> Column:
    """A query string less the named parameters; null if nothing stays."""
    key = lambda p: F.split_part(p, F.lit("="), F.lit(1))

    def stays(p: Column) -> Column:
        keep = p != ""
        if names:
            keep &= ~key(p).isin(*names)
        for x in prefixes:
            keep &= ~key(p).startswith(x)
        return keep

    return F.nullif(F.array_join(F.filter(F.split(query, "&"), stays), "&"), F.lit(""))


def canonical_url(url: Column, site: Site | None = None) -> Column:
    """https, no fragment, no default port; within the site one host and no tracking parameters. Null if not a web URL."""
    h = host(url)
    query = part(url, "QUERY")
    if site:
        own = of_family(h, site.suffix)
        query = F.when(own, without_params(query, site.tracking, site.tracking_prefix)).otherwise(query)
        h = F.when(own, F.lit(site.host)).otherwise(h)
    path = F.coalesce(F.nullif(part(url, "PATH"), F.lit("")), F.lit("/"))
    port = F.regexp_extract(part(url, "AUTHORITY"), r":(\d+)$", 1)
    port = F.when((port == "") | port.isin("80", "443"), F.lit("")).otherwise(F.concat(F.lit(":"), port))
    full = F.concat(F.lit("https://"), h, port, path, F.coalesce(F.concat(F.lit("?"), query), F.lit("")))
    return F.when(url.rlike(WEB) & h.isNotNull(), full)


def link_url(url: Column, tracking: tuple[str, ...]) -> Column:
    """The link inventory's form: only the named parameters go; host, scheme and fragment stay."""
    query = without_params(part(url, "QUERY"), tracking)
    base, fragment = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"(#.*)$", 1)
    return F.when(url.rlike(WEB), F.concat(base, F.coalesce(F.concat(F.lit("?"), query), F.lit("")), fragment))


def unwrap_redirect(url: Column, redirector: str, param: str = "u", times: int = 2) -> Column:
    """The target that a redirector's link carries, without any network access."""
    for _ in range(times):
        target = F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit(param)))
        url = F.when(of_family(host(url), redirector) & target.isNotNull(), target).otherwise(url)
    return url


def extract_urls(text: Column) -> Column:
    """Ordered distinct web URLs in a text, without punctuation at their ends."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TEXT_URL), 0)
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?)\]}]+$", "")))


def mask_urls(text: Column, token: str = "[URL]") -> Column:
    """Every URL in the text as a token; longest first, so that none is cut by one that it begins with."""
    longest = F.array_sort(extract_urls(text), lambda a, b: F.length(b) - F.length(a))
    return F.aggregate(longest, text, lambda t, u: F.replace(t, u, F.lit(token)))


def classify_link(url: Column, kinds: dict[str, str]) -> Column:
    """Kind by host family (kinds: suffix to kind), else external, or unknown if it is no web URL."""
    h, out = host(url), F.lit("external")
    for suffix, kind in kinds.items():
        out = F.when(of_family(h, suffix), F.lit(kind)).otherwise(out)
    return F.when(h.isNotNull() & url.rlike(WEB), out).otherwise(F.lit("unknown"))


def group_source(url: Column, site: Site, folder: str) -> Column:
    """struct(id, slug, url) of a group page /<folder>/<id or slug>; null elsewhere."""
    own = of_family(host(url), site.suffix)
    name = F.regexp_extract(part(url, "PATH"), rf"^/{folder}/([^/]+)", 1)
    numeric = name.rlike(r"^\d+$")
    return F.when(own & (name != ""), F.struct(F.when(numeric, name).alias("id"), F.when(~numeric, name).alias("slug"), F.concat(F.lit(f"https://{site.host}/{folder}/"), name).alias("url")))


def post_id(url: Column, pattern: str = r"/(?:posts|permalink)/(\d+)", param: str = "story_fbid") -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(part(url, "PATH"), pattern, 1), F.lit("")), F.try_parse_url(url, F.lit("QUERY"), F.lit(param)))


def profile_url(url: Column, anonymous: Column, site: Site, reserved: tuple[str, ...] = ()) -> Column:
    """Canonical author profile: /profile.php with exactly one id, or /<name>; null if anonymous, reserved or odd."""
    h, path, query = host(url), part(url, "PATH"), part(url, "QUERY")
    plain = of_family(h, site.suffix) & url.rlike(WEB) & part(url, "USERINFO").isNull() & ~part(url, "AUTHORITY").rlike(r":\d+$")
    ids = F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda p: p.startswith("id="))
    only = F.regexp_extract(F.get(ids, 0), r"^id=(\d+)$", 1)
    by_id = F.when((F.size(ids) == 1) & (only != ""), F.concat(F.lit(f"https://{site.host}/profile.php?id="), only))
    name = F.regexp_extract(path, r"^/([A-Za-z0-9.]+)/?$", 1)
    by_name = F.when((name != "") & ~F.lower(name).isin(*reserved or ("",)), F.concat(F.lit(f"https://{site.host}/"), name))
    return F.when(plain & ~F.coalesce(anonymous, F.lit(False)), F.when(path == "/profile.php", by_id).otherwise(by_name))


def author_identity(profile: Column, prefix: str) -> Column:
    """prefix:id:<n> or prefix:profile:<name>; null where the author is unknown."""
    number = F.regexp_extract(profile, r"[?&]id=(\d+)", 1)
    name = F.lower(F.regexp_extract(profile, r"^https?://[^/]+/([A-Za-z0-9.]+)/?$", 1))
    return F.when(number != "", F.concat(F.lit(prefix + ":id:"), number)).when(name != "", F.concat(F.lit(prefix + ":profile:"), name))


def safe_link(url: Column) -> Column:
    return F.when(url.rlike(r"(?i)^(https?|tel):"), url)


def link_inventory(group: Column, post: Column, author: Column, media: Column, text: Column, kinds: dict[str, str], tracking: tuple[str, ...]) -> Column:
    """All links of a post, each with its raw and canonical URL, source and kind."""

    def link(u: Column, source: str) -> Column:
        return F.struct(u.alias("raw_url"), link_url(u, tracking).alias("canonical_url"), F.lit(source).alias("source"), classify_link(u, kinds).alias("kind"))

    one = lambda u, s: F.when(u.isNotNull(), link(u, s))
    inline = F.transform(extract_urls(text), lambda u: link(u, "inline"))
    return F.struct(
        one(group, "group").alias("group"), one(post, "post").alias("post"), one(author, "author").alias("author"),
        F.transform(media, lambda u: link(u, "media")).alias("media"), inline.alias("inline"),
        F.filter(inline, lambda x: ~x["kind"].isin("unknown")).alias("registration"),
    )


def contact(registration: Column, messenger: Column, phone: Column, post: Column, author: Column) -> Column:
    """struct(links, primary, contactability): links in a fixed order, the first is the primary one."""
    def entry(kind: str, value: Column) -> Column:
        return F.when(value.isNotNull() & (value != ""), F.struct(F.lit(kind).alias("kind"), value.alias("value")))

    direct = F.array_compact(F.concat(F.transform(F.coalesce(registration, F.expr("cast(array() as array<string>)")), lambda u: entry("url", u)), F.array(entry("messenger", messenger), entry("phone", phone))))
    source, partial = F.array_compact(F.array(entry("post", post))), F.array_compact(F.array(entry("author", author)))
    links = F.array_distinct(F.concat(direct, source, partial))
    level = F.when(F.size(direct) > 0, "direct").when(F.size(source) > 0, "source").when(F.size(partial) > 0, "partial").otherwise("unavailable")
    return F.struct(links.alias("links"), F.get(links, 0).alias("primary"), level.alias("contactability"))
