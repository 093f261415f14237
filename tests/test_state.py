"""Scans over large keys and the event ledger against plain loops, over many ranges."""

import random

import pytest
from pyspark.sql import functions as F

from postlens.operators import collect, history, ledger, scan, search


def hot_rows(n=3000):
    rng = random.Random(4)
    return [(i, "hot" if i % 3 == 0 else (None if i % 17 == 0 else f"k{rng.randrange(40)}"), rng.randrange(4)) for i in range(n)]


def test_scan_over_a_hot_key(spark):
    """A key with a third of all rows lies in many ranges; none of them holds much more than its share."""
    rows = hot_rows()
    df = spark.createDataFrame(rows, "id long, key string, v long").repartition(7)
    got = {r.id: (r.nth, r.n_key, r.before and (r.before.id, r.before.v)) for r in scan.scan(df, ["key"], ["id"], ["id", "v"], parts=24).collect()}
    want, seen = {}, {}
    for i, k, v in rows:
        seen.setdefault(k, []).append((i, v))
    for own in seen.values():
        for n, (i, v) in enumerate(own):
            want[i] = (n + 1, len(own), own[n - 1] if n else None)
    assert got == want
    dealt = scan.deal(df, ["key"], ["id"], 24)
    sizes = [r["count"] for r in dealt.groupBy("_part").count().collect()]
    hot = dealt.where("key = 'hot'").select("_part").distinct().count()
    assert max(sizes) < 2.5 * len(rows) / 24 and hot >= 7


def test_large_keys_in_operators(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = hot_rows(600)
        df = spark.createDataFrame(rows, "id long, key string, v long")
        own, n = {}, {}
        ordinal = {r.id: r.ordinal for r in history.ordinal(df, "key", "id").collect()}
        versions = {r.id: (r.version, r.changed) for r in history.versions(df, "key", ["id"], {"changed": "v"}).collect()}
        heads = {r.id: (r.n_group, r.is_heading) for r in search.group_headings(df, "key", [F.desc("v")], "id").collect()}
        for i, k, v in rows:
            before = own.get(k)
            n[k] = n.get(k, 0) + 1
            assert ordinal[i] == n[k] - 1 and versions[i] == (n[k], before is not None and before != v)
            own[k] = v
        for k in n:
            group = sorted((-v, i) for i, x, v in rows if x == k)
            assert [heads[i] for _, i in group] == [(n[k], at == 0) for at in range(len(group))]
        first = collect.first_fingerprints(df.withColumn("keyed", F.col("id") % 5 == 0).withColumn("b", F.col("id") % 2), "b", "id", "key", "keyed")
        want, seen = set(), set()
        for i, k, _ in rows:
            if i % 5 == 0 or (i % 2, k) not in seen:
                want.add(i)
            if i % 5:
                seen.add((i % 2, k))
        assert {r.id for r in first.collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def plain_log(tasks, events):
    """The reference reading: one event after the other, task by task."""
    now, out = {t: (s, n, r) for t, s, n, r in tasks}, []
    table = {("pending", "start"): "running", ("running", "succeed"): "succeeded", ("running", "fail"): "failed", ("failed", "retry"): "pending", ("running", "recover"): "pending"}
    for t, o, e, r in sorted(events, key=lambda x: x[1]):
        if t not in now:
            out.append((t, o, None, False, None))
            continue
        s, n, held = now[t]
        new = table.get((s, e))
        fine = new is not None or (s == "succeeded" and e == "succeed" and held == r)
        if new:
            now[t] = (new, n + (new == "running"), r if new == "succeeded" else held)
        out.append((t, o, s, fine, now[t][0]))
    return out, now


@pytest.mark.parametrize("parts", [1, 20])
def test_replay_of_a_long_log(spark, parts):
    """A task with a third of all events; unknown tasks; tasks that begin in every state; results that repeat a success or don't."""
    rng = random.Random(5)
    tasks = [(f"t{k}", *rng.choice([("pending", 0, None), ("running", 1, None), ("failed", 2, None), ("succeeded", 1, "a")])) for k in range(30)] + [("hot", "pending", 0, None)]
    events = []
    for o in range(2400):
        e = rng.choice(["start", "start", "fail", "retry", "recover", "nonsense"] + ["succeed"] * (o % 97 == 0))
        events.append(("hot" if o % 3 == 0 else f"t{rng.randrange(34)}", o, e, rng.choice("ab") if e == "succeed" else None))
    t = spark.createDataFrame(tasks, "task_id string, status string, attempts long, result string")
    ev = spark.createDataFrame(events, "task_id string, at long, event string, result string").repartition(5)
    replayed = ledger.replay(t, ev, "at", parts=parts)
    want, now = plain_log(tasks, events)
    got = {(r.task_id, r.at, r.status_before, r.accepted, r.status_after) for r in replayed.collect()}
    assert got == set(want)
    assert {(r.task_id, r.status, r.attempts, r.result) for r in ledger.states(t, replayed, "at").collect()} == {(k, *v) for k, v in now.items()}
    assert ledger.rejected(replayed, "at").count() == sum(not w[3] for w in want)
    made = ledger.attempts(replayed, "at")
    half = made.where("attempt <= 2 or finished is null")
    kept = ledger.append_attempts(ledger.append_attempts(half, made), made)
    assert sorted(map(str, kept.collect())) == sorted(map(str, made.select(*kept.columns).collect()))


def test_maps_compose_as_events_do():
    rng = random.Random(6)
    for _ in range(300):
        events = [(rng.choice(["start", "succeed", "fail", "retry", "recover", "x"]), rng.choice([None, "a", "b"])) for _ in range(rng.randrange(8))]
        cut = rng.randrange(len(events) + 1)
        whole = ledger.IDENTITY
        sides = [ledger.IDENTITY, ledger.IDENTITY]
        for i, (e, r) in enumerate(events):
            whole = ledger.compose(whole, ledger.of_event(e, r))
            sides[i >= cut] = ledger.compose(sides[i >= cut], ledger.of_event(e, r))
        assert ledger.compose(*sides) == whole
        for s in ledger.STATES:
            now = (s, "held", 0)
            for e, r in events:
                status, held, n, _ = ledger.after(*now[:2], e, r)
                now = (status, held, now[2] + n)
            end, n, r, touched = whole[s]
            assert now == (end, r if touched else "held", n)


def test_empty(spark):
    t = spark.createDataFrame([], "task_id string, status string, attempts long, result string")
    ev = spark.createDataFrame([], "task_id string, at long, event string, result string")
    assert ledger.replay(t, ev, "at").count() == 0
    assert scan.scan(ev, ["task_id"], ["at"]).count() == 0
