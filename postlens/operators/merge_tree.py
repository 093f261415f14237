"""Merging of records that a bridge joins late, in the order of the accumulators.

A record goes to the post that its id or link names; one whose id and link name two posts (a bridge) merges the later post into the earlier
one and then joins them itself. So a post's records are folded in the order of a merge tree, not of arrival: what the absorbed post had
gathered comes as one piece at the bridge. The tree is a table: posts as they were founded (components of the links by which keys are introduced),
bridges (the first record for every two posts; a union-find over them in order of arrival, Kruskal's way, decides which merge), and for every
founded post where its records go from which bridge on. Only bridges meet in a task, a cluster's by themselves; records are aggregated.

Policies that do not depend on brackets are aggregates over the records in the tree's order. The text rule does: a piece's text replaces the text
before it if that is cut and the piece is whole, or if that is empty and the piece is not, and then counts as whole. What a run of records between bridges
does to a text is decided by three of them (the first whole one, the first whole or filled one, the first filled one after the first whole one), found by
aggregates; the tree is then evaluated over runs.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.operators.collect import merge_stable
from postlens.operators.components import components
from postlens.workspace import stage

LAST = (1 << 63) - 1


def replay_bridges(bridges: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(homes, merges) of a cluster's bridges (time, post, post).

    homes: post, since, home (where its records go from a bridge on, that bridge itself among them); merges: time, keep, gone.
    """
    root: dict[int, int] = {}
    members: dict[int, list[int]] = {}
    homes, merges = [], []
    for t, a, b in sorted(bridges):
        for x in (a, b):
            if x not in root:
                root[x], members[x] = x, [x]
                homes.append((x, -LAST, x))
        keep, gone = sorted((root[a], root[b]))
        if keep == gone:
            continue
        merges.append((t, keep, gone))
        for x in members.pop(gone):
            root[x] = keep
            members[keep].append(x)
            homes.append((x, t, keep))
    return homes, merges


def paths(merges: list[tuple[int, int, int]]) -> dict[int, list[int]]:
    """Times at which a home goes up the tree, the last one first; a home that is never gone has none."""
    up = {gone: (t, keep) for t, keep, gone in merges}

    def path(x: int) -> list[int]:
        out = []
        while x in up:
            t, x = up[x]
            out.append(t)
        return out[::-1]

    return {x: path(x) for x in {k for _, k, _ in merges} | set(up)}


def tree(df: DataFrame, batch: str, order: str, keys: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows, merges): df with cluster, home and place (the record's place in the fold, an array that sorts), and the bridges that merged (cluster, time, keep, gone).

    Orders are whole numbers, distinct over the table. Records without a key are alone.
    """
    own = stage(df.withColumn("_o", F.col(order).cast("long")), "tree-rows")
    firsts = []
    for n, k in enumerate(keys):
        first = own.where(F.col(k).isNotNull()).groupBy(batch, k).agg(F.min("_o").alias(f"_f{n}"))
        firsts.append(first)
        on = F.col(f"r.{batch}").eqNullSafe(F.col(f"f.{batch}")) & (F.col(f"r.{k}") == F.col(f"f.{k}"))
        own = own.alias("r").join(first.alias("f"), on, "left").select("r.*", f"_f{n}")
    # a record that introduces one key and knows the other links them; one that knows both may be a bridge
    seen = stage(own, "tree-seen")
    a, b, o = F.col("_f0"), F.col("_f1"), F.col("_o")
    links = seen.where((a == o) & (b < o)).select(o.alias("a"), b.alias("b")).unionByName(seen.where((b == o) & (a < o)).select(o.alias("a"), a.alias("b")))
    founded = stage(components(links), "tree-founded")
    of = lambda rows, c, name: rows.join(founded.select(F.col("node").alias(c), F.col("root").alias(f"_r{name}")), c, "left").withColumn(name, F.coalesce(f"_r{name}", c)).drop(f"_r{name}")
    placed = of(of(seen, "_f0", "_p0"), "_f1", "_p1").withColumn("_post", F.coalesce("_p0", "_p1", "_o"))
    placed = stage(placed, "tree-posts")
    both = placed.where("_p0 <> _p1").groupBy(F.least("_p0", "_p1").alias("a"), F.greatest("_p0", "_p1").alias("b")).agg(F.min("_o").alias("t"))
    bridges = stage(both, "tree-bridges")
    joined = components(bridges.select("a", "b")).select("node", F.col("root").alias("cluster"))
    grouped = bridges.join(joined, F.col("a") == F.col("node")).select("cluster", "t", "a", "b")

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        homes, merges = replay_bridges(list(pdf[["t", "a", "b"]].itertuples(index=False, name=None)))
        up, c = paths(merges), int(pdf["cluster"].iloc[0])
        rows = [(c, x, since, home, up.get(home, []), None, None, None) for x, since, home in homes] + [(c, None, None, None, None, *m) for m in merges]
        return pd.DataFrame(rows, columns=["cluster", "post", "since", "home", "path", "t", "keep", "gone"]).astype({k: "Int64" for k in ("post", "since", "home", "t", "keep", "gone")})

    told = stage(grouped.groupBy("cluster").applyInPandas(replay, "cluster long, post long, since long, home long, path array<long>, t long, keep long, gone long"), "tree")
    homes = told.where("post is not null").select("cluster", "post", "since", "home", "path")
    near = placed.select("_o", "_post").join(homes, F.col("_post") == F.col("post")).where(F.col("since") <= F.col("_o"))
    at = near.groupBy("_o").agg(F.max_by(F.struct("cluster", "home", "path"), "since").alias("_h"))
    rows = placed.join(at, "_o", "left").select(
        *[F.col(c) for c in df.columns], F.coalesce("_h.cluster", "_post").alias("cluster"), F.coalesce("_h.home", "_post").alias("home"),
        # the last number puts what a bridge absorbs before the bridge itself
        F.concat(F.coalesce("_h.path", F.array().cast("array<long>")), F.array(F.col("_o"), F.lit(LAST))).alias("place"),
    )
    return rows, told.where("t is not null").select("cluster", "t", "keep", "gone")


def on_keys(by: list[str], left: str, right: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in by])


def text_pieces(df: DataFrame, by: list[str], at: Column, text: str, truncated: str) -> DataFrame:
    """The records that decide the text of a run of records: by, first, first_whole, first_useful (whole or filled) and filled_after (the first whole one).

    Each is a struct of at (the order), text and cut, null if there is none; each is a minimum that tasks begin before the shuffle.
    """
    rows = df.select(*by, F.struct(at.alias("at"), F.col(text).alias("text"), F.col(truncated).alias("cut")).alias("p"))
    whole, filled = F.coalesce(F.col("p.cut") == False, F.lit(False)), F.coalesce(F.col("p.text"), F.lit("")) != ""  # noqa: E712
    first = lambda c, name: F.min_by(F.when(c, F.col("p")), F.when(c, F.col("p.at"))).alias(name)
    decide = rows.groupBy(*by).agg(first(F.lit(True), "first"), first(whole, "first_whole"), first(whole | filled, "first_useful"))
    # only runs whose first whole text is empty are looked at again
    again = decide.where(F.col("first_whole").isNotNull() & (F.coalesce("first_whole.text", F.lit("")) == "")).select(*by, F.col("first_whole.at").alias("_w"))
    after = rows.alias("r").join(again.alias("d"), on_keys(by, "r", "d")).where(F.col("r.p.at") > F.col("d._w")).select(*[F.col(f"r.{k}") for k in by], "r.p").groupBy(*by).agg(first(filled, "filled_after"))
    return decide.alias("d").join(after.alias("a"), on_keys(by, "d", "a"), "left").select(*[F.col(f"d.{k}") for k in by], "first", "first_whole", "first_useful", "filled_after")


def text_after(first: Column, whole: Column, useful: Column, after: Column) -> Column:
    """struct(text, cut) that a run of records ends with, one record after the other.

    A later record's text is taken, and then counts as whole, if it is whole and the text before it is not, or if it is the first that is not empty.
    """
    empty = lambda t: F.coalesce(t, F.lit("")) == ""
    open_ = lambda c: ~F.coalesce(c == False, F.lit(False))  # noqa: E712, E731
    takes = lambda t, c, p: p.isNotNull() & (open_(c) & ~open_(p["cut"]) | empty(t) & ~empty(p["text"]))
    t, c = first["text"], first["cut"]
    for piece in (F.when(empty(t), useful).otherwise(whole), after):
        use = takes(t, c, piece)
        t, c = F.when(use, piece["text"]).otherwise(t), F.when(use, F.lit(False)).otherwise(c)
    return F.struct(t.alias("text"), c.alias("cut"))


def fold_text(now: tuple[str | None, bool | None], later: tuple[str | None, bool | None]) -> tuple[str | None, bool | None]:
    """The text rule for two pieces: (text, whether it is cut)."""
    takes = (now[1] is not False and later[1] is False) or (not now[0] and bool(later[0]))
    return (later[0], False) if takes else now


def _run(now: tuple, r) -> tuple:
    """What a run of records makes of a text, from the records that decide."""
    for step in (r.first_whole if now[0] else r.first_useful, r.filled_after):
        if step is not None and (now[1] is not False or not now[0]):
            now = fold_text(now, (step["text"], step["cut"]))
    return now


def texts(rows: DataFrame, merges: DataFrame, order: str, text: str, cut: str) -> DataFrame:
    """cluster, text and cut of the clusters that a bridge joined, by the text rule along the tree."""
    # runs: a home's records from one of its bridges to the next; a bridge begins a run of the home that stays
    keyed = merges.select("cluster", "t", F.col("keep").alias("home"))
    bridged = rows.join(merges.select("cluster").distinct(), "cluster", "left_semi")
    o = F.col(f"r.{order}").cast("long")
    starts = bridged.alias("r").join(keyed.alias("k"), (F.col("r.cluster") == F.col("k.cluster")) & (F.col("r.home") == F.col("k.home")) & (F.col("k.t") <= o), "left")
    runs = stage(starts.groupBy("r.cluster", "r.home", o.alias("_o")).agg(F.coalesce(F.max("k.t"), F.lit(-LAST)).alias("run"), F.any_value(F.col(f"r.{text}")).alias("text"), F.any_value(F.col(f"r.{cut}")).alias("cut")), "tree-runs")
    nodes = text_pieces(runs, ["cluster", "home", "run"], F.col("_o"), "text", "cut").withColumn("gone", F.lit(None).cast("long"))
    ups = merges.select("cluster", F.col("keep").alias("home"), F.col("t").alias("run"), "gone")

    def evaluate(pdf: pd.DataFrame) -> pd.DataFrame:
        runs_, gone_at = {}, {}
        for r in pdf.itertuples():
            if pd.isna(r.gone):
                runs_.setdefault(int(r.home), {})[int(r.run)] = r
            else:
                gone_at.setdefault(int(r.home), {})[int(r.run)] = int(r.gone)
        done: dict[int, tuple] = {}
        # a home is gone before the bridges of the one that keeps it, so later founded homes are done first
        for home in sorted({*runs_, *gone_at, *[g for x in gone_at.values() for g in x.values()]}, reverse=True):
            now, absorbs = None, gone_at.get(home, {})
            for at in sorted({*runs_.get(home, {}), *absorbs}):
                if at in absorbs:
                    now = fold_text(now, done[absorbs[at]])
                r = runs_.get(home, {}).get(at)
                if r is not None:
                    now = (r.first["text"], r.first["cut"]) if now is None else now
                    now = _run(now, r)
            done[home] = now
        c = int(pdf["cluster"].iloc[0])
        return pd.DataFrame([[c, *done[c]]], columns=["cluster", "_text", "_cut"])

    both = nodes.unionByName(ups, allowMissingColumns=True)
    return both.groupBy("cluster").applyInPandas(evaluate, "cluster long, _text string, _cut boolean")


def merge(df: DataFrame, batch: str, order: str, keys: tuple[str, str], fill: list[str], last: list[str], text: str, truncated: str, unions: list[str], latest: list[str]) -> DataFrame:
    """One row per post (cluster, n_records and the fields) as ``merge_stable``, but in the order of the accumulators, whatever bridges there are."""
    rows, merges = tree(df, batch, order, keys)
    rows = stage(rows, "tree-placed")
    # runs without a bridge end as their records say; the others along the tree
    plain = text_pieces(rows, ["cluster"], F.col("place"), text, truncated).select("cluster", text_after(*map(F.col, ("first", "first_whole", "first_useful", "filled_after"))).alias("_plain"))
    bridged = texts(rows, merges, order, text, truncated).withColumn("_bridged", F.lit(True))
    said = plain.join(bridged, "cluster", "left").select("cluster", *[F.when(F.col("_bridged"), F.col(own)).otherwise(F.col(f"_plain.{c}")).alias(name) for own, c, name in (("_text", "text", text), ("_cut", "cut", truncated))])
    out = merge_stable(rows, ["cluster"], "place", fill, last, text, truncated, [], latest).drop(text, truncated).join(said, "cluster")
    for c in unions:
        each = rows.where(F.col(c).isNotNull()).select("cluster", "place", F.posexplode(c).alias("_pos", "_e"))
        at = each.groupBy("cluster", "_e").agg(F.min(F.struct("place", "_pos")).alias("_at"))
        listed = at.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_e"))), lambda x: x["_e"]).alias(c))
        out = out.join(listed, "cluster", "left").withColumn(c, F.coalesce(c, F.array().cast(df.schema[c].dataType)))
    if "warnings" in unions:
        out = out.withColumn("warnings", F.when(F.col(truncated) == False, F.array_remove("warnings", "content_truncated")).otherwise(F.col("warnings")))  # noqa: E712
    return out
