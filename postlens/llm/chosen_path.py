"""N-gram Jaccard join by chosen paths.

Sets are the distinct five-word shingles of a text. Each of RUNS independent runs grows a tree of
paths: at a node every set picks the tokens whose node-specific hash is under RATE / |set| and goes
to one child per picked token (SPLIT_RATE below a split bucket), so that similar sets meet in children with about even odds and
others part. Paths of DEPTH tokens are the buckets. Two sets of Braun-Blanquet similarity 0.8 or more
(which Jaccard 0.8 implies) survive DEPTH levels of a run with probability 0.23 at least, so 52 runs
miss one in some million of the worst pairs (a set and its 80 % subset), and fewer of those with more overlap.

Equal sets are one set before anything else, with a count. Buckets of up to SMALL sets are compared by
brute force: every pair is given to one bucket only, the largest that has it, and only such
buckets get the shingles of their members. A larger bucket whose sets merely share a passage (some of MINIMA
min-hashes has no value that half of them have) is split: its node grows AGAIN independent trees of DEEPER more tokens
each, up to LEVELS times. Sets with 30 % in common part at most tokens, similar ones keep meeting:
a run finds the worst pair in buckets split once with probability 0.18, split twice with 0.17, so that
52 runs miss one in some 16,000 there. Large buckets that are dense, or still large at full depth, are
grouped (connected through them), dealt into blocks of about BLOCK sets, and every pair of blocks
is one small group that returns sums and one link per set, to the least set that its similar pairs connect it to, never
its pairs. So no task holds an unbounded group, no pair of a large group is written, and no link is lost to a cap.

Defined results: a null doc_id gives one row with null class and no links; null, empty or word-less
texts are alone in their class; texts of under five words have one shingle, all their words; very
long texts are read whole; rows that share a doc_id count as one document, with the text of least
set digest; ties do not arise (a class is named by its least doc_id); an empty table gives no rows;
extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import bitmap, hash_words, mix64, slices, stage, tidied
from postlens.llm.components import components

SHINGLE = 5
#: The threshold as a fraction, for exact integer comparison.
UP, DOWN = 4, 5
RUNS, DEPTH, RATE = 52, 4, 1.1
SMALL, BLOCK = 24, 128
AGAIN, DEEPER, LEVELS, MINIMA, SPLIT_RATE = 3, 6, 2, 4, 1.25
WORD = re.compile(r"\w+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    words = WORD.findall(text.lower()) if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = hash_words([words])
    k = min(SHINGLE, len(h))
    out = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out = out * _ODD + h[i : len(h) - k + 1 + i]
    return distinct(mix64(out))


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct elements in order (for short arrays faster than numpy's own)."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def grow(tokens: np.ndarray, nodes: np.ndarray, depth: int = DEPTH, rate: float = RATE) -> np.ndarray:
    """The nodes that a set reaches depth tokens below some nodes: one 64-bit key per surviving path."""
    under = np.uint64(min(1.0, rate / len(tokens)) * ((1 << 64) - 2048))
    for _ in range(depth):
        if not len(nodes):
            break
        step = max(1, (1 << 21) // len(tokens))
        grown = []
        for at in range(0, len(nodes), step):
            part = nodes[at : at + step]
            node, token = np.divmod(np.flatnonzero(tokens[None, :] * (part | np.uint64(1))[:, None] <= under), len(tokens))
            grown.append(mix64(part[node] * _ODD + tokens[token]))
        nodes = np.concatenate(grown)
    return distinct(nodes)


def paths(tokens: np.ndarray, runs: int = RUNS) -> np.ndarray:
    """The buckets of a set."""
    return grow(tokens, mix64(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def deeper(tokens: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """The buckets of a set below some buckets, in AGAIN independent trees of each."""
    salts = np.arange(1, AGAIN + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return grow(tokens, mix64(buckets[:, None] + salts[None, :]).ravel(), DEEPER, SPLIT_RATE)


def minima(tokens: np.ndarray) -> int:
    """MINIMA min-hashes of a set, the low 16 bits of each side by side in one long, which the set's memberships carry."""
    least = [(tokens * np.uint64(2 * k + 3) ^ (tokens >> np.uint64(29))).min() & np.uint64(0xFFFF) for k in range(MINIMA)]
    return int(sum(x << np.uint64(16 * k) for k, x in enumerate(least)).view(np.int64))


def _rows(batches, columns):
    for batch in slices(batches):
        yield [batch.column(c).to_pylist() for c in columns]


def sets(docs: DataFrame) -> DataFrame:
    """One row per doc_id: s1, s2 (digest of the set, null for an empty set), paths, minima."""

    def run(batches):
        for ids, texts in _rows(batches, ["doc_id", "text"]):
            d1, d2, keys, least = [], [], [], []
            for t in texts:
                x = shingles(t)
                a, b = np.frombuffer(hashlib.blake2b(x.tobytes(), digest_size=16).digest(), dtype=np.int64).tolist() if len(x) else (None, None)
                d1.append(a)
                d2.append(b)
                keys.append(paths(x).view(np.int64) if len(x) else None)
                least.append(minima(x) if len(x) else None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(least, pa.int64())], names=["doc_id", "s1", "s2", "paths", "minima"])

    rows = docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(tidied(run), "doc_id long, s1 long, s2 long, paths array<long>, minima long")
    return stage(rows, "path-sets")


def similar(members: list[np.ndarray]) -> np.ndarray:
    """Which pairs of sets have Jaccard similarity UP / DOWN or more (not with themselves)."""
    size = np.array([len(x) for x in members], dtype=np.int64)
    token, column, seen = np.unique(np.concatenate(members), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(members)), size)
    shared = seen[column] > 1
    number = np.cumsum(seen > 1) - 1
    row, column = row[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(members), len(members)), dtype=np.float64)
    width = 4096
    cuts = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 1 + width, width))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        part = np.zeros((len(members), width), dtype=np.float32)
        part[row[a:b], column[a:b] - k * width] = 1
        both += part @ part.T
    out = DOWN * both >= UP * (size[:, None] + size[None, :] - both)
    np.fill_diagonal(out, False)
    return out


def least_connected(ids: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The least id that chains of near pairs connect each id to; links to it connect all that the pairs connect (links to the least neighbour do not)."""
    least, before = ids, None
    while before is None or (least != before).any():
        before = least
        least = np.minimum(least, np.where(near, least[None, :], np.iinfo(np.int64).max).min(axis=1))
    return least


def _arrays(col: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=np.uint64) for x in col]


def token_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, copies, tokens (binary) of the nodes with the wanted doc_ids."""
    wanted_bits = bitmap(wanted.select(F.xxhash64("doc_id").alias("key")))

    def shapes(batches):
        for batch in slices(batches):
            key = np.asarray(batch.column("key").to_numpy(zero_copy_only=False), dtype=np.int64).view(np.uint64)
            at = pa.array(np.flatnonzero(wanted_bits.value.has(key)))
            some = batch.take(at)
            digests, sets_ = [], []
            for t in some.column("text").to_pylist():
                x = shingles(t)
                digests.append(int(np.frombuffer(hashlib.blake2b(x.tobytes(), digest_size=16).digest(), dtype=np.int64)[0]))
                sets_.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(digests, pa.int64()), pa.array(sets_, pa.binary())], names=["doc_id", "s1", "tokens"])

    rows = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("key")).where("doc_id is not null").mapInArrow(tidied(shapes), "doc_id long, s1 long, tokens binary")
    return rows.join(nodes.select("doc_id", "s1", "copies"), ["doc_id", "s1"]).join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "copies", "tokens")


def split(docs: DataFrame, nodes: DataFrame, large: DataFrame) -> DataFrame:
    """large: doc_id, minima, bucket. The leaves (doc_id, minima, bucket) below these buckets."""
    own = large.groupBy("doc_id", "minima").agg(F.collect_list("bucket").alias("buckets"))  # a set has few buckets, whatever their size

    def run(batches):
        for batch in slices(batches):
            ids, least, out = [], [], []
            for doc, minima_, tokens, buckets in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "minima", "tokens", "buckets")]):
                keys = deeper(np.frombuffer(tokens, dtype=np.uint64), np.array(buckets, dtype=np.int64).view(np.uint64))
                ids.append(np.full(len(keys), doc, dtype=np.int64))
                least.append(np.full(len(keys), minima_, dtype=np.int64))
                out.append(keys.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (ids, least, out)], names=["doc_id", "minima", "bucket"])

    return token_sets(docs, nodes, own.select("doc_id")).join(own, "doc_id").select("doc_id", "minima", "tokens", "buckets").mapInArrow(tidied(run), "doc_id long, minima long, bucket long")


def buckets(docs: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Memberships (doc_id, bucket, n, least) of the small buckets and of the large ones that stay together."""
    leaves = nodes.select("doc_id", "minima", F.explode("paths").alias("bucket"))
    small = large = None
    for level in range(LEVELS + 1):
        met = stage(leaves.groupBy("bucket").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).where("n > 1"), "path-buckets")
        held = stage(leaves.join(met, "bucket").select("doc_id", "minima", "bucket", "n", "least"), "path-held")
        few, many = held.where(F.col("n") <= SMALL).drop("minima"), held.where(F.col("n") > SMALL)
        small = few if small is None else small.unionByName(few)
        if level == LEVELS:
            many = many.drop("minima")
            return small, many if large is None else large.unionByName(many)
        # dense: of each min-hash there is a value that half of the sets have; sets alike in all min-hashes are counted as one row
        value = stage(many.groupBy("bucket", "n", "minima").agg(F.count("*").alias("m")), "path-values")
        most = [value.groupBy("bucket", "n", F.shiftright("minima", 16 * k).bitwiseAND(0xFFFF).alias("value")).agg(F.sum("m").alias("m")).groupBy("bucket", "n").agg(F.max("m").alias("m")) for k in range(MINIMA)]
        least = reduce(DataFrame.unionByName, most).groupBy("bucket", "n").agg(F.min("m").alias("m"))
        dense = stage(least.select("bucket", (F.col("m") * 2 >= F.col("n")).alias("dense")), "path-dense")
        stay = many.join(dense.where("dense"), "bucket").drop("dense", "minima")
        large = stay if large is None else large.unionByName(stay)
        part = dense.where("not dense")
        if not part.take(1):
            return small, large
        leaves = stage(split(docs, nodes, many.join(part, "bucket").select("doc_id", "minima", "bucket")), "path-leaves")


def links(nodes: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes: doc_id (of each distinct set's first document), copies, paths, minima.

    Gives per node the number of documents with another, similar set (node, others), and enough links
    (a, b) to connect what similar pairs connect.
    """
    held, large = buckets(docs, nodes)

    # large buckets: groups of sets that they connect
    big = stage(components(large.select(F.col("doc_id").alias("a"), F.col("least").alias("b"))), "path-groups")

    # small buckets, each membership once; every pair to the largest bucket that has it
    small = held.groupBy("bucket").agg(F.sort_array(F.collect_list("doc_id")).alias("m")).select("m").distinct()
    small = small.select(F.xxhash64("m").alias("bucket"), F.size("m").alias("n"), "m")
    pairs = small.select("bucket", "n", F.posexplode("m").alias("i", "a"), "m").select("bucket", "n", "a", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("b"))
    rank = (F.lit(SMALL) - F.col("n")).cast("long")
    best = pairs.select("a", "b", rank.alias("rank"), "bucket").groupBy("a", "b").agg(F.min("rank").alias("rank"))
    owner = pairs.withColumn("rank", rank).join(best, ["a", "b", "rank"]).groupBy("a", "b").agg(F.min("bucket").alias("bucket"))
    ga, gb = big.select(F.col("node").alias("a"), F.col("root").alias("ra")), big.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    owner = stage(owner.join(ga, "a", "left").join(gb, "b", "left").where("ra is null or rb is null or ra <> rb").select("a", "b", "bucket"), "path-pairs")

    # the shingles of those sets alone that take part
    wanted = stage(owner.select(F.col("a").alias("doc_id")).union(owner.select("b")).union(big.select("node")).distinct(), "path-wanted")
    shape = stage(token_sets(docs, nodes, wanted), "path-shapes")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["doc_id"].to_numpy()
        i, j = np.nonzero(similar(_arrays(pdf["tokens"])))
        return pd.DataFrame({"a": ids[i], "b": ids[j], "n": pdf["copies"].to_numpy()[j]})

    dealt = owner.select("bucket", F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    near = dealt.join(shape, "doc_id").groupBy("bucket").applyInPandas(compare, "a long, b long, n long").distinct()
    near = near.join(ga, "a", "left").join(gb, "b", "left").where("ra is null or rb is null or ra <> rb").select("a", "b", "n")

    # large groups: pairs of blocks
    sizes = big.groupBy("root").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks"))
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks"))
    in_blocks = big.join(sizes, "root").select(F.col("node").alias("doc_id"), "root", "blocks").withColumn("block", block)
    ends = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("x"), F.greatest("block", o).alias("y")))
    tiles = in_blocks.join(shape, "doc_id").select("root", "block", "doc_id", "copies", "tokens", F.explode(ends).alias("t")).select("root", "t.x", "t.y", "block", "doc_id", "copies", "tokens")

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, own, block = pdf["doc_id"].to_numpy(), pdf["copies"].to_numpy(), pdf["block"].to_numpy()
        near = similar(_arrays(pdf["tokens"]))
        if pdf["x"].iloc[0] != pdf["y"].iloc[0]:
            near &= block[:, None] != block[None, :]  # pairs within a block are another tile's
        some = near.any(axis=1)
        return pd.DataFrame({"a": ids[some], "b": least_connected(ids, near)[some], "n": (near @ own)[some]})

    dense = tiles.groupBy("root", "x", "y").applyInPandas(tile, "a long, b long, n long")
    found = stage(near.unionByName(dense), "path-links")
    return found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others")), found.select("a", "b")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (least doc_id that similar pairs connect it to), n_links (documents with similarity 0.8 or more)."""
    every = sets(docs)
    one = every.groupBy("doc_id").agg(F.min("s1").alias("s1"))
    member = stage(every.select("doc_id", "s1", "s2").join(one, ["doc_id", "s1"]).distinct(), "path-members")
    alone = every.groupBy("doc_id").agg(F.count("s1").alias("n")).where("n = 0").select("doc_id")
    first = stage(member.groupBy("s1", "s2").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "path-first")
    nodes = stage(every.join(first.select(F.col("first").alias("doc_id"), "s1", "s2", "copies"), ["doc_id", "s1", "s2"]).dropDuplicates(["doc_id"]), "path-nodes")
    others, edges = links(nodes, docs)
    roots = components(edges)
    named = first.join(others, first["first"] == others["node"], "left").drop("node").join(roots, first["first"] == roots["node"], "left")
    per_set = named.select("s1", "s2", F.coalesce("root", "first").alias("class_id"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    out = member.join(per_set, ["s1", "s2"]).select("doc_id", "class_id", "n_links")
    single = alone.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    unnamed = docs.where("doc_id is null").select(F.col("doc_id").cast("long"), F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(single).unionByName(unnamed)


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents that name their class (and those without a doc_id), with all their columns."""
    gone = stage(join(docs.select("doc_id", "text")).where("class_id <> doc_id").select("doc_id"), "path-gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


ORACLE = rf"""
with w as (select doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') as w from documents),
g as (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < {SHINGLE} then [array_to_string(w, ' ')]
      else list_transform(range(1, len(w) - {SHINGLE} + 2), lambda i: array_to_string(w[i : i + {SHINGLE - 1}], ' ')) end) as s from w),
t as (select distinct doc_id, s from g), n as (select doc_id, count(*) as n from t group by doc_id),
i as (select x.doc_id as a, y.doc_id as b, count(*) as k from t x join t y using (s) where x.doc_id <> y.doc_id group by all),
e as (select a, b from i join n p on p.doc_id = a join n q on q.doc_id = b where {DOWN} * k >= {UP} * (p.n + q.n - k)),
c as (with recursive r(a, root) as (select doc_id, doc_id from documents union select e.b, r.root from r join e on e.a = r.a)
      select a, min(root) as root from r group by a)
select d.doc_id, c.root as class_id, coalesce(l.n, 0) as n_links
from documents d join c on c.a = d.doc_id left join (select a, count(*) as n from e group by a) l on l.a = d.doc_id
"""
