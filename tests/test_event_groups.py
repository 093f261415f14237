"""Event duplicates in a group that is most of the table: no list of the group on any row."""

from postlens.operators import dedupe


def test_large_group(spark, capsys):
    rows = [(i, "hot" if i % 10 else None, i, [None if i % 2 else f"o{i}"], "" if i % 3 else f"c{i % 900}") for i in range(2000)]
    df = spark.createDataFrame(rows, "ord long, key string, source long, organisers array<string>, content string")
    out = dedupe.judge_events(df, "ord", "ord", "key", "source", "organisers", "content")
    first, status = {}, {}
    place = 0
    for i, key, _, organisers, content in rows:
        if key is None:
            status[i] = ("unique", None, 0)
            continue
        place += 1
        seen = [first[x] for x in (("o", organisers[0]), ("c", content)) if x in first and x != ("c", "")]
        status[i] = ("duplicate", min(seen), 0) if seen else ("possible_duplicate", None, place - 1)
        first.setdefault(("o", organisers[0]), i)
        first.setdefault(("c", content), i)
    status[1] = ("possible_duplicate", None, place - 1)
    assert {r.ord: (r.status, r.duplicate_of, r.n_candidates) for r in out.collect()} == status
    capsys.readouterr()
    out.explain("formatted")
    assert "collect_list" not in capsys.readouterr().out
