"""What the join may miss, from how often one run finds the pairs that are hardest to find; and how it judges large buckets."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import numpy as np
from fixtures import frame, prose
from pyspark.sql import functions as F

from postlens.llm import chosen_path


def runs_that_find(n):
    """Shares of runs in which a set and its 80 % subset (Jaccard 0.8) meet: as they are, and with every bucket split once and twice."""
    rng, found = np.random.default_rng(5), np.zeros(3)
    for _ in range(n):
        a = np.unique(rng.integers(0, 1 << 63, 150, dtype=np.uint64))
        b = np.sort(rng.permutation(a)[:120])
        root = rng.integers(1, 1 << 62, 1).astype(np.uint64)
        p, q = chosen_path.grow(a, root), chosen_path.grow(b, root)
        for level in range(3):
            both = np.intersect1d(p, q)
            found[level] += bool(both.size)
            p, q = chosen_path.deeper(a, both), chosen_path.deeper(b, both)
    return found / n


def test_hardest_pairs_are_missed_about_once_in_a_million():
    whole, once, twice = (1 - runs_that_find(3000)) ** chosen_path.RUNS
    assert whole < 1e-5 and once < 3e-4 and twice < 3e-4


def test_large_buckets_are_judged_without_a_row_per_min_hash(spark, monkeypatch):
    """A large bucket of near copies stays whole, and its rows are not multiplied to see that."""
    monkeypatch.setattr(chosen_path, "SMALL", 4)
    base, made = prose(1, 150), []
    docs = frame(spark, [(i, f"{base} end{i}", "", "", 0) for i in range(30)])
    nodes = chosen_path.sets(docs).withColumn("copies", F.lit(1).cast("long"))
    monkeypatch.setattr(F, "posexplode", lambda c: made.append(c))
    _, large = chosen_path.buckets(docs, nodes)
    assert large.select("doc_id").distinct().count() == 30 and not made


def test_large_buckets_are_judged_by_counts_of_like_sets(spark, monkeypatch):
    """Memberships carry their min-hashes: none is joined to its set again, and sets alike in all min-hashes are one row of the judgement."""
    monkeypatch.setattr(chosen_path, "SMALL", 4)
    base, staged, plans, stage = prose(1, 150), {}, [], chosen_path.stage

    def noted(df, label):
        if label == "path-values":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return staged.setdefault(label, []).append(stage(df, label)) or staged[label][-1]

    monkeypatch.setattr(chosen_path, "stage", noted)
    docs = frame(spark, [(i, f"{base} end{i}", "", "", 0) for i in range(60)])
    nodes = chosen_path.sets(docs).withColumn("copies", F.lit(1).cast("long"))
    _, large = chosen_path.buckets(docs, nodes)
    memberships, rows = staged["path-held"][0].where(F.col("n") > 4).count(), staged["path-values"][0]
    assert memberships > 1000 and large.select("doc_id").distinct().count() == 60
    assert rows.count() * 5 < memberships and rows.agg(F.sum("m")).first()[0] == memberships
    assert not any("Join" in p for p in plans)  # staged rows are read as they are


def test_packed_minima_are_those_of_the_least_hashes():
    """Four parts of 16 bits; alike sets have like parts, a set without the least element another one."""
    x = np.random.default_rng(6).integers(0, 1 << 63, 400, dtype=np.uint64)
    part = lambda v: [v >> 16 * k & 0xFFFF for k in range(chosen_path.MINIMA)]
    hashes = [x * np.uint64(2 * k + 3) ^ (x >> np.uint64(29)) for k in range(chosen_path.MINIMA)]
    assert part(chosen_path.minima(x)) == [int(h.min()) & 0xFFFF for h in hashes]
    assert part(chosen_path.minima(np.delete(x, hashes[2].argmin())))[2] != part(chosen_path.minima(x))[2]
