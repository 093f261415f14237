"""Cards of raw HTML pages: outermost candidate elements as rows, and their classification."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.functions.text import contains_any
from postlens.functions.values import normalize_count
from postlens.functions.urls import host, of_family

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CARD = "page_id long, position int, label string, text string, links array<string>, images array<string>, times array<string>"


class _Cards(HTMLParser):
    """Text, links, images and times of every outermost element of the wanted tags."""

    def __init__(self, tags: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.tags, self.depth, self.cards, self.skip = tags, 0, [], 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if self.depth == 0 and (tag in self.tags or a.get("role") in self.tags):
            self.cards.append({"label": a.get("aria-label"), "text": [], "links": [], "images": [], "times": [], "tag": tag})
            self.depth = 1
        elif self.depth and tag == self.cards[-1]["tag"]:
            self.depth += 1
        if self.depth:
            card = self.cards[-1]
            if tag == "a" and a.get("href"):
                card["links"].append(a["href"])
            elif tag == "img" and a.get("src"):
                card["images"].append(a["src"])
            elif tag == "time" and a.get("datetime"):
                card["times"].append(a["datetime"])
            elif tag in ("br", "p", "div", "li"):
                card["text"].append("\n")
        if tag in ("script", "style"):
            self.skip += 1

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        if self.depth and tag == self.cards[-1]["tag"] and tag not in VOID:
            self.depth -= 1

    def handle_data(self, data):
        if self.depth and not self.skip:
            self.cards[-1]["text"].append(data)


def cards_from_pages(pages: DataFrame, tags: tuple[str, ...] = ("article",)) -> DataFrame:
    """One row per outermost element of the tags (or roles); comments, scripts and styles are no text."""
    wanted = frozenset(tags)

    def run(batches):
        for pdf in batches:
            out = []
            for page, html in zip(pdf["page_id"], pdf["html"]):
                parser = _Cards(wanted)
                parser.feed(html or "")
                parser.close()
                out += [(page, i, c["label"], "".join(c["text"]).strip(), c["links"], c["images"], c["times"]) for i, c in enumerate(parser.cards)]
            yield pd.DataFrame(out, columns=["page_id", "position", "label", "text", "links", "images", "times"])

    return pages.select("page_id", "html").mapInPandas(run, CARD)


def classify(text: Column, label: Column, excluded: list[str], ignored: list[str], evidence: Column) -> Column:
    """supported, excluded, ignored or unknown, by signals and evidence of a post."""
    return F.when(contains_any(label, ignored), "ignored").when(contains_any(text, excluded), "excluded").when(evidence, "supported").otherwise("unknown")


def card_identity(cards: DataFrame, post: str, pinned: list[str], displayed: str, metrics: dict[str, str]) -> DataFrame:
    """Adds post_url and post_id (of the first link whose path has one), is_pinned (null if unknown), the displayed time, and each metric's raw text and count.

    post, displayed and the metrics are patterns with one group.
    """
    found = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    link = F.get(F.filter("links", lambda u: u.rlike(post)), 0)
    raw = {f"{name}_raw": found(F.col("text"), p) for name, p in metrics.items()}
    counts = {name: normalize_count(c) for name, c in zip(metrics, raw.values())}
    return cards.withColumns({"post_url": link, "post_id": found(link, post), "is_pinned": F.when(contains_any(F.col("text"), pinned), True), "published_time_raw": found(F.col("text"), displayed), **raw, **counts})


def parse_card(cards: DataFrame, anonymous: str, more: list[str]) -> DataFrame:
    """Adds author fields, truncated (null if unknown) and media to cards."""
    author = F.nullif(F.split_part("label", F.lit("|"), F.lit(1)), F.lit(""))
    hidden = author == anonymous
    return cards.withColumns(
        {
            "author_name": author,
            "is_anonymous": F.when(author.isNotNull(), hidden),
            "author_url": F.when(~F.coalesce(hidden, F.lit(False)), F.get("links", 0)),
            "content_is_truncated": F.when(F.col("text") != "", contains_any(F.col("text"), more)),
            "media": F.array_distinct(F.transform("images", lambda u: F.struct(F.lit("image").alias("type"), u.alias("url")))),
            "machine_time": F.get("times", 0),
        }
    )


def extract_media(images: Column, videos: Column, links: Column, site: str) -> Column:
    """Images, videos and links out of the site, distinct by type and URL; same-site links are no media."""
    entry = lambda kind: lambda u: F.struct(F.lit(kind).alias("type"), u.alias("url"))
    outside = F.filter(links, lambda u: u.rlike(r"(?i)^https?://") & ~F.coalesce(of_family(host(u), site), F.lit(True)))
    none = F.expr("cast(array() as array<string>)")
    return F.array_distinct(F.concat(*[F.transform(F.coalesce(c, none), entry(k)) for k, c in (("image", images), ("video", videos), ("external", outside))]))


def parent_by_agreement(cards: DataFrame, ids: list[str], attachment: Column, candidates: Column, same_group: Column) -> DataFrame:
    """ids and parent_id: the attachment's id, else the one that all of a card's comment links agree on, if they are of its group.

    candidates: array of post ids in comment links; same_group: array of booleans beside it.
    """
    known = F.array_distinct(F.filter(candidates, lambda c: c.isNotNull()))
    agreed = F.when((F.size(known) == 1) & F.forall(same_group, lambda g: F.coalesce(g, F.lit(False))), F.get(known, 0))
    return cards.select(*ids, F.coalesce(attachment, agreed).alias("parent_id"))
