"""Merging over bridges against a plain collector that keeps a list of posts."""

import random

import pytest

from postlens.operators import merge_tree
from postlens.operators.merge_tree import fold_text

FIELDS = ("author", "likes", "stamp")


def joined(first, later):
    """One post of two, field by field."""
    out = dict(first, n=first["n"] + later["n"])
    out["author"] = first["author"] if first["author"] is not None else later["author"]
    out["likes"] = later["likes"] if later["likes"] is not None else first["likes"]
    out["stamp"] = later["stamp"]
    out["text"], out["cut"] = fold_text((first["text"], first["cut"]), (later["text"], later["cut"]))
    out["media"] = list(dict.fromkeys([*first["media"], *later["media"]]))
    return out


def collected(records):
    """Records of one batch in order of arrival; posts with the order of the record that founded them."""
    posts, by = [], {}
    for r in records:
        post = {"founded": r["o"], "n": 1, **{k: r[k] for k in (*FIELDS, "text", "cut", "media")}}
        names = [(k, r[k]) for k in ("id", "url") if r[k] is not None]
        at = sorted({id(by[n]): by[n] for n in names if n in by}.values(), key=lambda p: posts.index(p))
        if len(at) == 2:
            keep, gone = at
            keep_new = joined(joined(keep, gone), post)
            posts = [p for p in posts if p is not gone]
            for k, p in list(by.items()):
                if p is gone:
                    by[k] = keep
            keep.update(keep_new)
        elif at:
            keep = at[0]
            keep.update(joined(keep, post))
        else:
            keep = post
            posts.append(keep)
        for n in names:
            by[n] = keep
    return {p["founded"]: (p["n"], p["author"], p["likes"], p["stamp"], p["text"], p["cut"], tuple(p["media"])) for p in posts}


@pytest.mark.parametrize("seed, n, kinds", [(1, 60, 12), (2, 150, 30), (3, 150, 60), (4, 40, 3)])
def test_equals_a_plain_collector(spark, seed, n, kinds):
    rng = random.Random(seed)
    records = []
    for o in range(4 * n):
        pick = lambda c: None if rng.random() < 0.3 else f"{c}{int(kinds * rng.random() ** 1.5)}"  # noqa: B023, E731
        records.append({
            "batch": rng.choice(["a", "b", "b", None]), "o": o, "id": pick("i"), "url": pick("u"), "author": rng.choice([None, None, "p", "q"]), "likes": rng.choice([None, 1, 2, 3]), "stamp": f"s{o}",
            "text": rng.choice([None, "", "", f"t{o}", f"t{o}"]), "cut": rng.choice([None, True, True, False]), "media": rng.sample("xyz", rng.randrange(3)),
        })
    want = {}
    for b in ("a", "b", None):
        want |= collected([r for r in records if r["batch"] == b])
    schema = "batch string, o long, id string, url string, author string, likes int, stamp string, text string, cut boolean, media array<string>"
    rng.shuffle(records)
    df = spark.createDataFrame([tuple(r.values()) for r in records], schema).repartition(3)
    rows, merges = merge_tree.tree(df, "batch", "o", ("id", "url"))
    assert merges.count() > 3
    out = merge_tree.merge(df, "batch", "o", ("id", "url"), ["author"], ["likes"], "text", "cut", ["media"], ["stamp"])
    got = {r.cluster: (r.n_records, r.author, r.likes, r.stamp, r.text, r.cut, tuple(r.media)) for r in out.collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == want[k], k


def test_the_text_rule_depends_on_brackets():
    a, b, c = ("x", None), ("", True), ("z", True)
    assert fold_text(fold_text(a, b), c) == a and fold_text(a, fold_text(b, c)) == ("z", False)


def test_replay():
    homes, merges = merge_tree.replay_bridges([(9, 3, 5), (7, 1, 3), (8, 1, 3), (12, 1, 5), (6, 4, 5)])
    assert merges == [(6, 4, 5), (7, 1, 3), (9, 1, 4)]
    assert sorted(h for h in homes if h[1] > 0) == [(3, 7, 1), (4, 9, 1), (5, 6, 4), (5, 9, 1)]
    assert merge_tree.paths(merges) == {1: [], 3: [7], 4: [9], 5: [9, 6]}
