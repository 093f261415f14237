"""Claims, selections, extraction in batches, releases and the streamed latest rows on small fixtures."""

import pytest
from pyspark.sql import functions as F

from postlens.operators import collect, joins, release, tasks
from postlens.plans import predicates
from postlens.sources import releases
from postlens.streaming import latest


def test_extract_calls_once_per_batch(spark, tmp_path):
    """Fifty tasks a call; rows without an answer are tried again together, after an exception alone."""
    log = str(tmp_path / "calls")

    def call(pdf):
        with open(log, "a") as f:
            f.write(f"{len(pdf)}\n")
        if len(pdf) > 1 and (pdf["task_id"] == "t119").any():
            raise ValueError("too hard")
        return [None if i in ("t3", "t119") else c.upper() for i, c in zip(pdf["task_id"], pdf["context"])]

    df = spark.createDataFrame([(f"t{i}", f"c{i}") for i in range(120)], "task_id string, context string").coalesce(1)
    out = {r.task_id: r for r in tasks.extract(df, call, most_attempts=3).collect()}
    assert sum(r.result is None for r in out.values()) == 2 and out["t5"].attempts == 1 and out["t3"].attempts == 3 and out["t119"].error == "no answer"
    sizes = [int(x) for x in open(log)]
    assert sorted(sizes, reverse=True)[:3] == [50, 50, 20] and out["t110"].attempts == 2 and len(sizes) < 30


def test_frozen_selection_notices_settings(spark):
    a = spark.createDataFrame([("x",)], "task_id string")
    assert tasks.frozen(a, a, settings=({"rules": "1", "dataset": "d"}, {"rules": "1", "dataset": "d"})).count() == 0
    rows = tasks.frozen(a, a, settings=({"rules": "1", "dataset": "d"}, {"rules": "2", "dataset": "d"})).collect()
    assert [tuple(r) for r in rows] == [(None, "changed rules")]


def test_selection_errors(spark):
    rows = spark.createDataFrame([("k", "b1"), ("m", "b2")], "key string, batch string")
    pick = lambda **kw: tasks.select_tasks(rows.select("key"), rows, "key", "batch", **kw).count()
    assert pick() == 2 and pick(batches=["b1"]) == 1 and pick(post_key="m") == 1
    for wrong in ({"batches": ["b3"]}, {"post_key": "z"}, {"rerun": True}):
        with pytest.raises(ValueError):
            pick(**wrong)
    with pytest.raises(ValueError, match="status, dedupe_status"):
        predicates.require_columns(rows.toDF("listing_id", "event_group_id"))


def test_clusters_over_chains_and_hot_keys(spark):
    """A chain of a hundred records and a key that most records share."""
    chain = [(i, 1, f"a{i // 2}", f"b{(i + 1) // 2}") for i in range(100)]
    hot = [(1000 + i, 2, "hot" if i % 3 else None, f"u{i}") for i in range(90)]
    df = spark.createDataFrame(chain + hot + [(5000, 3, None, None)], "o long, batch int, k string, u string")
    got = {r.o: r.cluster for r in collect.clusters(df, "batch", "o", ["k", "u"]).collect()}
    assert {got[i] for i in range(100)} == {0} and {got[1000 + i] for i in range(90) if i % 3} == {1001} and got[1003] == 1003 and got[5000] == 5000


def test_release_problems(spark):
    posts = spark.createDataFrame([(1, "b"), (2, "b")], "post int, batch string").withColumns({"recruitment": F.lit(True), "analysed": F.lit(True)})
    lines = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "post int, i int")
    batches = spark.createDataFrame([("b",)], "batch string")
    report = spark.createDataFrame([(2, 3, 2)], "posts int, listings int, analysed int")
    check = lambda **kw: {r.check: r.n for r in release.consistency(**({"posts": posts, "batches": batches, "listings": lines, "report": report} | kw), post="post", batch="batch", index="i", analysed="analysed", recruitment="recruitment").collect()}
    assert set(check().values()) == {0}
    wrong = check(listings=lines.unionByName(lines.where("post = 2")), batches=batches.unionByName(batches))
    assert wrong["listing_numbers"] == 1 and wrong["report_numbers"] == 1 and wrong["repeated_batch"] == 1


def test_staged_publication_keeps_an_equal_release(spark, tmp_path):
    base = str(tmp_path / "site")
    now = spark.createDataFrame([("p", 1), ("q", 2)], "key string, obs int")
    ready = spark.createDataFrame([("p", 1, "r1", False), ("q", 1, "old", False)], "key string, obs int, result string, withdrawn boolean")
    publish = lambda name, previous=None: release.staged_publication(now, ready, previous, base, name, "key", "obs")
    assert publish("a") == "a" and publish("b") == "a"
    assert [tuple(r) for r in releases.read_release(spark, base, "posts").collect()] == [("p", 1, "r1", "published")]


def test_batch_lookup(spark):
    j = joins.batch_lookup(spark.createDataFrame([(1, "a"), (1, "a"), (2, "x")], "post int, batch string"), spark.createDataFrame([("a", 1), ("c", 2)], "batch string, n int"), "batch", "post")
    assert [r.batch for r in j.unknown.collect()] == ["x"] and [r.batch for r in j.missing.collect()] == ["c"] and [tuple(r) for r in j.duplicates.collect()] == [("post", "1", 2)]


def test_latest_stream_rewrites_touched_buckets(spark, tmp_path):
    """Three files as three batches: late older captures lose, untouched buckets keep their version, old versions go."""
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "key long, valid long, id long"
    batches = [[(k, 10, k) for k in range(40)], [(3, 20, 100), (4, 5, 101)], [(3, 15, 102), (50, 1, 103)]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        q = latest.latest_stream(stream, target, str(tmp_path / "check"), "key", "valid", "id", "id", buckets=8)
        q.awaitTermination()
    got = {r.key: r.id for r in latest.read_latest(spark, target, 2).collect()}
    assert got == {**{k: k for k in range(40)}, 3: 100, 50: 103}
    manifest = latest._manifest(spark, target, 2)
    assert 0 in manifest.values() and 2 in manifest.values()
    assert {r.key: r.id for r in latest.read_latest(spark, target, 1).collect()} == {**{k: k for k in range(40)}, 3: 100}
