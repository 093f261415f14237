"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions alone.

Fixed masks slide over the words of a text; each hashes the words at its ``1`` positions and
ignores those at its ``0`` positions. Hashes of the corpus are joined with those of the benchmark,
and every hit is verified on its diagonal: along the alignment of document and item, some window
of ``window`` words (or the whole item, if shorter) must agree in at least ``share`` of its
positions. Substituted words are thus tolerated twice, by the masks and by the window. The masks of
an item follow from the words that have to agree: of ``COVERS``, one hits whichever of them are
substituted, so verification sees every diagonal that it would accept.

Only the benchmark's distinct hashes meet the exploded hashes of the corpus. Their number is
counted: up to ``BROADCAST_ROWS`` they are broadcast, beyond that the join shuffles, as do the joins
of hits with items and with texts.

Defined results: null or empty texts and items, and items without a word, match nothing; an item of
one to four words matches its copies; very long texts are read whole; repeated documents are each reported once per doc_id and
item; repeated items are items of their own; null ids are never reported; empty tables give no
rows; extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import stage

WINDOW = 13
SHARE = 0.8
#: By window and tolerated substitutions: masks of which some placement avoids the substituted words, wherever they are.
COVERS = {
    (5, 1): ("111", "1101"),
    (6, 1): ("1111", "11011"),
    (7, 1): ("11011",),
    (8, 1): ("11111", "111011"),
    (9, 1): ("111111", "1110111"),
    (10, 2): ("111011", "11010011", "11111"),
    (11, 2): ("1101111", "111100011", "1100011011"),
    (12, 2): ("11101011", "101100111", "111111"),
    (13, 2): ("111111", "11001010011"),
}
BROADCAST_ROWS = 200_000
SPLIT = r"[^\p{L}\p{N}]+"


def words(text: str) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.col(text)), SPLIT), lambda w: w != "")


def masks(need: int, share: float = SHARE) -> tuple[str, ...]:
    """Masks that hit every window of need words in which the share agrees."""
    lost = need - math.ceil(need * share)
    # one of lost + 1 blocks is whole
    return COVERS.get((need, lost)) or ("1" * max(1, need // (lost + 1)),)


def seeds(df: DataFrame, key: str, needs: list[int], window: int = WINDOW, share: float = SHARE, own: bool = False) -> DataFrame:
    """One row per mask and position: key, pos, h. With own, a text has only the masks of its own length."""
    hashed = df.where(F.col(key).isNotNull() & F.col("text").isNotNull()).select(key, F.transform(words("text"), lambda w: F.xxhash64(w)).alias("w"))
    uses: dict[str, list[int]] = {}
    for need in needs:
        for mask in masks(need, share):
            uses.setdefault(mask, []).append(need)

    def of(mask: str) -> Column:
        at = [i for i, c in enumerate(mask) if c == "1"]
        n = F.size("w") - len(mask)
        # element_at counts from 1; a text shorter than the mask gives no seeds
        last = F.when(n >= 0, n).otherwise(F.lit(0))
        found = F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.xxhash64(F.lit(mask), *[F.element_at("w", i + j) for j in at]))
        fits = (n >= 0) & F.least(F.lit(window), F.size("w")).isin(uses[mask]) if own else n >= 0
        return F.when(fits, found).otherwise(F.expr("cast(array() as array<bigint>)"))

    each = F.array(*[of(m) for m in uses]) if uses else F.expr("cast(array() as array<array<bigint>>)")
    per_mask = hashed.select(key, F.explode(each).alias("hs"))
    return per_mask.select(key, F.posexplode("hs").alias("pos", "h"))


def sized(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most BROADCAST_ROWS rows; df must be cheap to read."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """Verified overlaps: doc_id, item_id, start_word, end_word (exclusive, of the document), best (most agreeing words in a window)."""
    items = stage(benchmark.select("item_id", "text").where("item_id is not null and text is not null").select("item_id", words("text").alias("item")).distinct(), "decon-items")
    # at most window lengths
    needs = sorted(r.need for r in items.select(F.least(F.lit(window), F.size("item")).alias("need")).distinct().collect() if r.need)
    item_seeds = stage(seeds(benchmark.select("item_id", "text"), "item_id", needs, window, share, True).withColumnRenamed("pos", "item_pos"), "decon-seeds")
    keys = stage(item_seeds.select("h").distinct(), "decon-keys")
    hits = stage(seeds(docs.select("doc_id", "text"), "doc_id", needs, window, share).join(sized(keys, keys.count()), "h"), "decon-hits")
    n_seeds, n_items = item_seeds.count(), items.count()
    diagonals = hits.join(sized(item_seeds, n_seeds), "h").select("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct()
    by_doc = stage(diagonals.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "shift")).alias("found")), "decon-found")
    texts = docs.select("doc_id", "text").where("text is not null").join(sized(by_doc, by_doc.count()), "doc_id")
    # one row per document with its words, then one per diagonal with the words that face the item
    faced = texts.select("doc_id", words("text").alias("w"), F.explode("found").alias("f"))
    aligned = faced.select("doc_id", "w", "f.item_id", "f.shift").join(sized(items, n_items), "item_id")
    low = F.greatest(F.col("shift"), F.lit(0))
    # a row that shares its doc_id with another text may not reach as far as that one's hit
    facing = F.greatest(F.least(F.col("shift") + F.size("item"), F.size("w")) - low, F.lit(0))
    cut = aligned.select(
        "doc_id",
        "item_id",
        low.alias("low"),
        F.least(F.lit(window), F.size("item")).alias("need"),
        F.zip_with(F.slice("w", low + 1, facing), F.slice("item", low - F.col("shift") + 1, facing), lambda a, b: (a == b).cast("int")).alias("eq"),
    ).where(F.size("eq") >= F.col("need"))
    starts = F.sequence(F.lit(1), F.size("eq") - F.col("need") + 1)
    sums = F.transform(starts, lambda i: F.struct((i + F.col("low") - 1).alias("at"), F.aggregate(F.slice("eq", i, F.col("need")), F.lit(0), lambda a, x: a + x).alias("n")))
    good = cut.select("doc_id", "item_id", "need", F.filter(sums, lambda s: s["n"] >= F.ceil(F.col("need") * F.lit(share))).alias("good")).where(F.size("good") > 0)
    ends = good.select("doc_id", "item_id", F.array_min("good.at").alias("a"), (F.array_max("good.at") + F.col("need")).alias("b"), F.array_max("good.n").alias("n"))
    return ends.groupBy("doc_id", "item_id").agg(F.min("a").cast("long").alias("start_word"), F.max("b").cast("long").alias("end_word"), F.max("n").cast("long").alias("best"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that overlap no item, with all their columns; a null doc_id stays."""
    found = stage(overlaps(docs, benchmark).select("doc_id").distinct(), "decon-leaks")
    return docs.join(sized(found, found.count()), "doc_id", "left_anti").select(*docs.columns)


#: No masks: every alignment of a document and an item on which enough words agree, then every window of it.
ORACLE = rf"""
with d as (select doc_id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') as w from documents where text is not null and doc_id is not null),
b as (select item_id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') as w from benchmark where text is not null and item_id is not null),
dw as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as pos from d), bw as (select item_id, least({WINDOW}, len(w)) as need, unnest(w) as word, generate_subscripts(w, 1) as pos from b),
g as (select doc_id, item_id, dw.pos - bw.pos as shift from dw join bw using (word) group by all having count(*) >= ceil(any_value(need) * {SHARE})),
a as (select g.doc_id, g.item_id, d.w as w, b.w as item, greatest(shift, 0) as low, least(shift + len(b.w), len(d.w)) as high, shift, least({WINDOW}, len(b.w)) as need
      from g join d using (doc_id) join b using (item_id)),
e as (select doc_id, item_id, low, need, list_transform(range(low, high), lambda p: case when w[p + 1] = item[p - shift + 1] then 1 else 0 end) as eq from a),
s as (select doc_id, item_id, low, need, eq, unnest(range(0, len(eq) - need + 1)) as i from e),
n as (select doc_id, item_id, low + i as spot, need, list_sum(eq[i + 1 : i + need]) as n from s)
select doc_id, item_id, cast(min(spot) as bigint) as start_word, cast(max(spot + need) as bigint) as end_word, cast(max(n) as bigint) as best
from n where n >= ceil(need * {SHARE}) group by doc_id, item_id
"""
