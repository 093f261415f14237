import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import random

import numpy as np
from fixtures import empty, frame, odd_rows, prose
from pyspark.sql import functions as F

from postlens.llm import chosen_path
from postlens.llm.components import components


def brute(rows):
    """Class and links by comparing all pairs."""
    by_id = {}
    for i, t in rows:
        if i is not None:
            x = frozenset(chosen_path.shingles(t).tolist())
            by_id.setdefault(i, []).append(x)
    sets_ = {i: v[0] for i, v in by_id.items()}
    near = lambda a, b: bool(a and b) and 5 * len(a & b) >= 4 * len(a | b)
    links = {i: {j for j in sets_ if j != i and near(sets_[i], sets_[j])} for i in sets_}
    root = {i: i for i in sets_}
    changed = True
    while changed:
        changed = False
        for i in sets_:
            low = min([root[i], *(root[j] for j in links[i])])
            changed |= low != root[i]
            root[i] = low
    return sorted((i, root[i], len(links[i])) for i in sets_)


def near_copies(n, base, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "changed" + str(rng.randint(1, 99))
        out.append(" ".join(w))
    return out


def test_equals_brute_force(spark, monkeypatch):
    """Small and (as SMALL is low here) large buckets, in several blocks."""
    monkeypatch.setattr(chosen_path, "SMALL", 4)
    monkeypatch.setattr(chosen_path, "BLOCK", 5)
    texts = near_copies(25, prose(1, 150), 1) + near_copies(3, prose(2, 80), 2) + [prose(i, 60) for i in range(10, 25)] + ["", "one two", "one two", "!!"]
    rows = [(i + 1, t) for i, t in enumerate(texts)] + [(None, texts[0])]
    got = [tuple(r) for r in chosen_path.join(frame(spark, [(i, t, "", "", 0) for i, t in rows])).collect()]
    assert (None, None, 0) in got
    assert sorted(r for r in got if r[0] is not None) == brute(rows)


def test_odd_rows(spark):
    got = {r.doc_id: r for r in chosen_path.join(frame(spark)).collect()}
    assert len(got) == 11 and got[4].class_id == 1 and got[1].n_links == 1
    assert got[2].class_id == 2 and got[3].n_links == 0 and got[6].class_id == 6
    kept = chosen_path.keep_first(frame(spark).withColumn("class_id", F.lit("clash")).withColumn("n_links", F.lit(1)))
    assert kept.columns[-2:] == ["class_id", "n_links"]
    assert 4 not in {r.doc_id for r in kept.collect()} and kept.where("doc_id is null").count() == 1


def test_empty(spark):
    assert chosen_path.join(empty(spark)).count() == 0


def test_recall_of_runs():
    """Pairs just over the threshold meet in some bucket."""
    rng, met = np.random.default_rng(3), 0
    for _ in range(300):
        x = rng.integers(0, 1 << 63, 180, dtype=np.uint64)
        a, b = np.unique(x[:170]), np.unique(np.concatenate([x[:152], x[160:178]]))
        met += bool(np.intersect1d(chosen_path.paths(a), chosen_path.paths(b)).size)
    assert met >= 299


def test_recall_of_split_buckets():
    """Pairs just over the threshold still meet where every bucket is split twice."""
    rng, met = np.random.default_rng(4), 0
    for _ in range(150):
        x = rng.integers(0, 1 << 63, 180, dtype=np.uint64)
        a, b = np.unique(x[:170]), np.unique(np.concatenate([x[:152], x[160:178]]))
        p, q = chosen_path.paths(a), chosen_path.paths(b)
        for _ in range(chosen_path.LEVELS):
            p = q = np.intersect1d(p, q)  # buckets of one alone cannot hold the pair
            p, q = chosen_path.deeper(a, p), chosen_path.deeper(b, q)
        met += bool(np.intersect1d(p, q).size)
    assert met >= 145


def boilerplate(n, share, size=100, seed=0):
    passage = prose(999, round(size * share))
    return [passage + " " + " ".join(f"own{seed}x{i}x{k}" for k in range(size - round(size * share))) for i in range(n)]


def test_boilerplate_is_split(spark, monkeypatch):
    """Thousands of texts that share 30 % (some half): what is left to compare grows with the texts, not with their square."""
    monkeypatch.setattr(chosen_path, "RUNS", 20)
    left = {}
    for n in (1000, 2000):
        texts = boilerplate(n, 0.3) + boilerplate(n // 2, 0.5, seed=1)
        docs = frame(spark, [(i, t, "", "", 0) for i, t in enumerate(texts)])
        nodes = chosen_path.sets(docs).withColumn("copies", F.lit(1).cast("long"))
        small, large = chosen_path.buckets(docs, nodes)
        whole = nodes.select(F.explode("paths").alias("b")).groupBy("b").count().where(F.col("count") > chosen_path.SMALL).count()
        pairs = small.select("bucket", "n").distinct().agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0))).first()[0]
        dense = large.groupBy("bucket").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0))).first()[0]
        assert whole > 0  # there was something to split
        left[n] = pairs + dense
    assert left[1000] < 60 * 1000 and left[2000] < 60 * 2000


def test_near_copies_within_boilerplate_are_found(spark, monkeypatch):
    """Splitting keeps the links of near copies in a crowd that shares a passage."""
    monkeypatch.setattr(chosen_path, "SMALL", 8)
    crowd = boilerplate(150, 0.5)
    copies = [crowd[i].replace(f"own0x{i}x7 ", "changed ") for i in range(0, 40, 2)]
    rows = list(enumerate(crowd + copies))
    got = sorted(map(tuple, chosen_path.join(frame(spark, [(i, t, "", "", 0) for i, t in rows])).collect()))
    assert got == brute(rows) and sum(n for *_, n in got) == 40


def test_similar_is_exact():
    a = np.arange(1, 11, dtype=np.uint64)
    near = chosen_path.similar([a, a[:8], a[:7], a])
    assert near.tolist() == [[False, True, False, True], [True, False, True, True], [False, True, False, False], [True, True, False, False]]


def test_chains_within_a_large_group_stay_one_class(spark, monkeypatch):
    """Similar pairs 1-3, 3-4, 4-2 alone: each text's least neighbour leaves 3-4 out, though it connects all four."""
    monkeypatch.setattr(chosen_path, "SMALL", 2)
    words = prose(1, 400).split()
    without = lambda spans: " ".join(w for k, w in enumerate(words) if not any(a <= k < a + 36 for a in spans))
    steps = {1: [], 3: [50], 4: [50, 150], 2: [50, 150, 250]}
    crowd = {100 + i: " ".join(words) + f" end{i}" for i in range(4)}  # makes the buckets large
    rows = [(i, without(s)) for i, s in steps.items()] + list(crowd.items())
    got = sorted(map(tuple, chosen_path.join(frame(spark, [(i, t, "", "", 0) for i, t in rows])).collect()))
    assert got == brute(rows) and {c for _, c, _ in got} == {1}


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (7, 7), (101, 100)]
    got = dict(map(tuple, components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows_are_many():
    assert len(odd_rows()) == 13
