"""Merged records: the policies by aggregates against a fold in order, and no list of a group's rows."""

import random

from postlens.operators import collect
from postlens.queries import QUERIES


def test_merge_equals_fold(spark, capsys):
    rng = random.Random(3)
    pick = lambda *v: rng.choice([None, *v])
    rows = [(rng.choice([None, 1, 1, 1, *range(2, 60)]), i, pick("a", "b"), pick(1, 2), pick("", "x", "yy", "zzz"), pick(True, True, False), pick([], ["content_truncated", "w"], ["v", None]), pick("t", "u")) for i in range(400)]
    df = spark.createDataFrame(rows, "c int, o int, author string, likes int, text string, cut boolean, warnings array<string>, scraped string")
    out = collect.merge_stable(df.repartition(5), ["c"], "o", ["author"], ["likes"], "text", "cut", ["warnings"], ["scraped"])
    wanted = {}
    for c in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == c]
        t, cut = own[0][4], own[0][5]
        for r in own[1:]:
            if r[4] and (not t or cut is True and r[5] is False):
                t, cut = r[4], False
        warnings = list(dict.fromkeys(w for r in own for w in r[6] or []))
        wanted[c] = (len(own), next((r[2] for r in own if r[2] is not None), None), next((r[3] for r in own[::-1] if r[3] is not None), None), t, cut, [w for w in warnings if cut is not False or w != "content_truncated"], own[-1][7])
    assert {r.c: (r.n_records, r.author, r.likes, r.text, r.cut, r.warnings, r.scraped) for r in out.collect()} == wanted
    capsys.readouterr()
    out.drop("warnings").explain("formatted")
    assert "collect_list(struct(o" not in capsys.readouterr().out


def test_distinct_sets_without_lists(spark, tmp_path, capsys):
    rows = [(1 if i % 3 else i, "abc"[i % 3] if i % 5 else None) for i in range(300)]
    spark.createDataFrame(rows, "user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    out = QUERIES["g16_distinct_sets"](spark, str(tmp_path))
    assert {r.user_id: r.n for r in out.collect()} == {u: len({t for v, t in rows if v == u and t}) for u, _ in rows}
    capsys.readouterr()
    out.explain("formatted")
    assert "collect_list" not in capsys.readouterr().out
