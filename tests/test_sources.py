"""Sources, sinks, releases, tasks and streams on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from postlens.operators import collect, dedupe, history, joins, tasks
from postlens.sources import cards, csvio, envelopes, releases


def envelope(batch, posts, url="https://social.test/groups/1"):
    return json.dumps({"batch": {"batch_id": batch, "group_url": url}, "posts": posts})


def test_envelopes(spark, tmp_path):
    (tmp_path / "a.json").write_text(envelope("b1", [{"post_id": "1", "content_text": "x"}, {"post_id": "2"}]))
    (tmp_path / "b.json").write_text('{ "posts": [{"post_id": "1", "content_text": "x"}, {"post_id": "2"}], "batch": {"group_url": "https://social.test/groups/1", "batch_id": "b1"}}')
    out = str(tmp_path / "archive")
    assert envelopes.import_batches(spark, str(tmp_path / "*.json"), out, "2026-01-01") == {"batches": 1, "observations": 2, "already_imported": 1}
    assert envelopes.import_batches(spark, str(tmp_path / "*.json"), out, "2026-01-02")["batches"] == 0
    assert envelopes.explode_posts(spark.read.parquet(out)).count() == 2
    (tmp_path / "c.json").write_text(envelope("b2", [None]))
    with pytest.raises(ValueError, match="not an object"):
        envelopes.import_batches(spark, str(tmp_path / "*.json"), out, "2026-01-03")
    assert spark.read.parquet(out).count() == 1


def test_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "1"}, {"id": "2"}]')
    (tmp_path / "b.json").write_text('{"results": [{"id": "3"}]}')
    (tmp_path / "c.json").write_text('{"id": "4"}')
    (tmp_path / "d.jsonl").write_text('{"id": "5"}\nbroken\n\n{"id": "6"}\n')
    good, bad = envelopes.read_records(spark, str(tmp_path), "id string")
    assert sorted(r.id for r in good.select("record.id").collect()) == list("123456")
    assert [r.line for r in bad.collect()] == [2]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b', ["x", "y"], "=1"), (2, None, [], "two\nlines")], "id int, t string, tags array<string>, f string")
    csvio.write_listing_csv(df, str(tmp_path / "out"))
    back = csvio.read_listing_csv(spark, str(tmp_path / "out")).orderBy("id")
    assert back.columns == ["id", "t", "tags", "f"]
    assert [tuple(r) for r in back.collect()] == [("1", 'a "q", b', "x|y", "'=1"), ("2", "", "", "two\nlines")]


def test_releases(spark, tmp_path):
    base = str(tmp_path / "site")
    one = {"listings": spark.range(3).toDF("id")}
    assert releases.publish_if_changed(one, base, "r1") == "r1"
    assert releases.publish_if_changed({"listings": spark.range(3).toDF("id")}, base, "r2") == "r1"
    assert releases.publish_if_changed({"listings": spark.range(4).toDF("id")}, base, "r3") == "r3"
    assert releases.read_release(spark, base, "listings").count() == 4


def test_dedupe_equals_fold(spark):
    import random

    rng = random.Random(5)
    rows = [(i, rng.choice(["k1", "k2", None]), rng.randint(1, 4), [rng.choice("abcd")], rng.choice(["", "t", "u"])) for i in range(40)]
    df = spark.createDataFrame(rows, "ord long, key string, source int, organisers array<string>, content string")
    got = {r.ord: (r.status, r.duplicate_of, sorted(r.candidate_ids)) for r in dedupe.dedupe_events(df, "ord", "ord", "key", "source", "organisers", "content").collect()}
    for key in {r[1] for r in rows}:
        group = [r for r in rows if r[1] == key]
        if key is None:
            assert all(got[r[0]][0] == "unique" for r in group)
            continue
        wanted = {r[0]: ["unique", None, []] for r in group}
        for n, r in enumerate(group[1:], 1):
            match = next((e for e in group[:n] if e[2] == r[2] or set(e[3]) & set(r[3]) or r[4] and e[4] == r[4]), None)
            if match:
                wanted[r[0]] = ["duplicate", match[0], []]
                continue
            wanted[r[0]] = ["possible_duplicate", None, [e[0] for e in group[:n]]]
            for e in group[:n]:
                if wanted[e[0]][0] == "unique":
                    wanted[e[0]] = ["possible_duplicate", None, sorted(x[0] for x in group if x is not e)]
        assert {k: tuple(v) for k, v in wanted.items()} == {r[0]: got[r[0]] for r in group}


def test_merge_stable(spark):
    df = spark.createDataFrame(
        [(1, 1, None, 5, "short", True, ["content_truncated"], "t1"), (1, 2, "ann", None, "the whole text", False, ["w"], "t2"), (2, 1, "bob", 1, "", True, [], "t1"), (2, 2, None, 2, "late", True, [], "t3")],
        "c int, o int, author string, likes int, text string, cut boolean, warnings array<string>, scraped string",
    )
    out = {r.c: r for r in collect.merge_stable(df, ["c"], "o", ["author"], ["likes"], "text", "cut", ["warnings"], ["scraped"]).collect()}
    assert (out[1].author, out[1].likes, out[1].text, out[1].cut, out[1].warnings, out[1].scraped) == ("ann", 5, "the whole text", False, ["w"], "t2")
    assert (out[2].text, out[2].cut, out[2].likes) == ("late", False, 2)


def test_lookup_and_limits(spark):
    df = spark.range(5)
    assert history.lookup(df, "id", 3).count() == 1
    with pytest.raises(ValueError):
        history.require_limit(0)
    with pytest.raises(ValueError):
        tasks.chunks(df, ["id"], 101)


def test_joins(spark):
    j = joins.join_by_id(spark.range(3), spark.createDataFrame([(0, "a"), (0, "b"), (9, "c")], "id long, r string"), "id")
    assert sorted((r.problem, r.id) for r in joins.check_joined(j, "id").collect()) == [("duplicate", "0"), ("missing", "1"), ("missing", "2"), ("unknown", "9")]


def test_cards(spark):
    html = '<div><!-- <article>no</article> --><article aria-label="Ann|x">hi<a href="/p"></a><article>in</article></article><article>b</article></div>'
    out = cards.cards_from_pages(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).orderBy("position").collect()
    assert [(r.position, r.text, r.links) for r in out] == [(0, "hiin", ["/p"]), (1, "b", [])]


def test_import_dataset(spark):
    reg = spark.createDataFrame([("north", "b1")], "id string, batch_id string")
    assert releases.import_dataset(reg, "south", spark.createDataFrame([("b2",)], "batch_id string")).count() == 2
    with pytest.raises(ValueError):
        releases.import_dataset(reg, "south", spark.createDataFrame([("b1",)], "batch_id string"))
    assert releases.import_dataset(reg, "north", reg.select(F.col("batch_id"))).count() == 1
