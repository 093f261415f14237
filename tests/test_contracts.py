"""Nested contracts, leaves, evidence, digests, anchors and evaluation against plain readings."""

import copy
import json
import random

import pytest
from pyspark.sql import functions as F

from postlens.functions import ids, leaves
from postlens.operators import evaluation, publish
from postlens.plans import contract
from postlens.sources import envelopes

SPEC = {
    "kind": "object", "required": ["id", "analysis"],
    "fields": {
        "id": {"kind": "string", "pattern": "^post_[0-9a-f]{4}$"},
        "analysis": {"kind": "object", "required": ["is_recruitment", "listings", "warnings"], "fields": {
            "is_recruitment": {"kind": "boolean"}, "warnings": {"kind": "array", "unique": True, "items": {"kind": "string", "enum": ["a", "b"]}},
            "listings": {"kind": "array", "items": {"kind": "object", "required": ["index", "price"], "fields": {
                "index": {"kind": "integer", "low": 0}, "price": {"kind": "number", "low": 0, "high": 100, "nullable": True}, "title": {"kind": "string", "min_length": 1, "nullable": True},
                "details": {"any_of": [{"kind": "object", "required": ["rent"], "fields": {"rent": {"kind": "integer"}}}, {"kind": "object", "required": ["coach"], "fields": {"coach": {"kind": "string"}}}]},
            }}},
        }},
    },
}
GOOD = {"id": "post_00af", "analysis": {"is_recruitment": True, "warnings": ["a"], "listings": [{"index": 0, "price": 1.5}, {"index": 1, "price": None, "title": "x", "details": {"coach": "c"}}]}}


def changed(path, value=None, drop=False):
    out = copy.deepcopy(GOOD)
    at = out
    for p in path[:-1]:
        at = at[p]
    if drop:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return json.dumps(out)


def test_every_mutation_is_named(spark):
    """Each change breaks one rule, and the path says where."""
    cases = [
        (json.dumps(GOOD), []),
        (changed(["id"], drop=True), [("/id", "required")]),
        (changed(["id"], "post_zz"), [("/id", "pattern")]),
        (changed(["id"], 7), [("/id", "kind")]),
        (changed(["more"], 7), [("/more", "unknown")]),
        (changed(["analysis"], None), [("/analysis", "kind")]),
        (changed(["analysis", "is_recruitment"], "true"), [("/analysis/is_recruitment", "kind")]),
        (changed(["analysis", "warnings"], ["a", "a"]), [("/analysis/warnings", "unique")]),
        (changed(["analysis", "warnings"], ["b", "c"]), [("/analysis/warnings/1", "enum")]),
        (changed(["analysis", "listings"], {}), [("/analysis/listings", "kind")]),
        (changed(["analysis", "listings", 0, "index"], -1), [("/analysis/listings/0/index", "range")]),
        (changed(["analysis", "listings", 0, "index"], 0.5), [("/analysis/listings/0/index", "kind")]),
        (changed(["analysis", "listings", 1, "price"], 100.5), [("/analysis/listings/1/price", "range")]),
        (changed(["analysis", "listings", 1, "price"], drop=True), [("/analysis/listings/1/price", "required")]),
        (changed(["analysis", "listings", 1, "title"], ""), [("/analysis/listings/1/title", "min_length")]),
        (changed(["analysis", "listings", 1, "other"], {}), [("/analysis/listings/1/other", "unknown")]),
        (changed(["analysis", "listings", 1, "details"], {"rent": 3}), []),
        (changed(["analysis", "listings", 1, "details"], {"rent": "3"}), [("/analysis/listings/1/details", "any_of"), ("/analysis/listings/1/details/rent", "kind")]),
        ("not json", [("", "json")]), ("[]", [("", "kind")]), (None, [("", "json")]),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, j string")
    got = {r.i: [tuple(v) for v in r.v] for r in df.select("i", contract.violations(F.col("j"), SPEC).alias("v")).collect()}
    assert got == {i: c[1] for i, c in enumerate(cases)}


@pytest.mark.parametrize("bad", [{"kind": "text"}, {"kind": "object", "required": ["a"]}, {"kind": "string", "lowest": 1}, {"kind": "array", "items": {}}, {"any_of": [{"kind": "x"}]}])
def test_wrong_specs(bad):
    with pytest.raises(ValueError):
        contract.check_spec(bad)


def plain_leaves(value, path=""):
    if value is None or value in ("", "unknown"):
        return
    if isinstance(value, (dict, list)):
        for k, v in value.items() if isinstance(value, dict) else enumerate(value):
            yield from plain_leaves(v, f"{path}.{k}" if path else str(k))
    elif path:
        yield path, json.dumps(value) if isinstance(value, (bool, float)) else str(value)


def test_leaves_at_any_depth(spark):
    rng = random.Random(1)

    def value(depth):
        kind = rng.randrange(8 if depth else 5)
        if kind > 4:
            return {f"k{i}": value(depth - 1) for i in range(rng.randrange(4))} if kind % 2 else [value(depth - 1) for _ in range(rng.randrange(4))]
        return [None, "", "unknown", "text", rng.randrange(100)][kind]

    records = [{"a": value(6), "price_options": [None] * 3 + [{"amount": 5}]} for _ in range(40)] + [{}, []]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(98, None), (99, "no json")], "i int, j string")
    got = {(r.i, r.path, r.value) for r in leaves.leaves(df, ["i"], F.try_parse_json("j")).collect()}
    assert got == {(i, *x) for i, r in enumerate(records) for x in plain_leaves(r)}
    assert (0, "price_options.3.amount", "5") in got


def test_evidence(spark):
    record = {"schedule": {"timezone": "T", "day": "d", "end_day_offset": 0}, "price_options": [{"amount": 3, "currency": "X"}], "title": "t", "venue": "unknown", "court": 2}
    source = "the day d costs 3"
    ev = lambda *pairs: [{"field": f, "quote": q} for f, q in pairs]
    cases = [
        (ev(("schedule.day", "day d"), ("price_options[0].amount", "3"), ("court", "the")), set()),
        (ev(("schedule.day", "day d"), ("price_options.0.amount", "3")), {("court", "missing")}),
        (ev(("schedule.day", "Day"), ("price_options[0].amount", " "), ("court", "the"), ("venue", "the")), {("schedule.day", "not_quoted"), ("price_options.0.amount", "not_quoted"), ("venue", "unfilled")}),
        ([], {("evidence", "empty"), ("schedule.day", "missing"), ("price_options.0.amount", "missing"), ("court", "missing")}),
        (None, set()),
    ]
    df = spark.createDataFrame([(i, json.dumps(record), e, source) for i, (e, _) in enumerate(cases)], "i int, j string, e array<struct<field: string, quote: string>>, s string")
    got = {(r.i, r.path, r.code) for r in leaves.evidence_problems(df, ["i"], F.try_parse_json("j"), ["schedule", "price_options", "title", "venue", "court"], F.col("e"), F.col("s")).collect()}
    assert got == {(i, *x) for i, (_, w) in enumerate(cases) for x in w}


def test_digests_tell_tables_apart(spark):
    df = lambda rows, schema="a string, b string": spark.createDataFrame(rows, schema)
    h = publish.content_hash
    base = [("x", None), ("y", "z"), ("y", "z")]
    assert h(df(base)) == h(df(base[::-1]).repartition(3)) == h(df(base[1:] + base[:1]).coalesce(1))
    others = [df([(None, "x"), ("y", "z"), ("y", "z")]), df([("x", ""), ("y", "z"), ("y", "z")]), df(base[:2]), df([*base, base[0]]), df([("y", None), ("x", "z"), ("y", "z")]), df(base, "b string, a string"), df([(1, None)], "a int, b string"), df([(1, None)], "a bigint, b string"), df([("1", None)])]
    assert len({h(x) for x in [df(base), *others]}) == len(others) + 1
    assert h(df([])) == h(df([])) and h(df([])) != h(df([(None, None)]))


def test_anchor_and_migration(spark):
    df = spark.createDataFrame([("a", 1, None)], "p string, q int, r string")
    one, two = (df.select(ids.anchor(F.struct(*c), F.col("r")).alias("x")).first().x for c in (("p", "q"), ("q", "p")))
    assert one == two == '{"schedule":{"p":"a","q":1},"venue":null}'
    old = spark.createDataFrame([(1, "2024-05-01T10:00:00+08:00"), (2, "yesterday"), (3, None), (4, "2024-02-30T10:00:00Z")], "observation_id int, scraped_at string")
    new = envelopes.migrate(old)
    assert [r.scraped_at_valid is not None for r in new.orderBy("observation_id").collect()] == [True, False, False, False]
    assert envelopes.migrate(new).columns == new.columns and "input_digest" in envelopes.migrate(old.withColumn("raw_json", F.lit("{}"))).columns


def plain_cases(samples, alternatives, expected, predicted, actual):
    """Sample by sample, as a loop."""
    out, sums = {}, {"f": [0, 0], "g": [0, 0]}
    for sid, reviewed in samples:
        alts = sorted((a, rec) for i, a, rec in alternatives if i == sid)
        if not reviewed or not alts:
            out[sid] = ("awaiting_human_annotation", None, None, None, None)
            continue
        said = [(v, rec) for i, v, rec in predicted if i == sid]
        of = lambda a: sorted(((x[3], x[2], x[4], x[5]) for x in expected if x[0] == sid and x[1] == a))  # noqa: B023, E731
        if not said:
            out[sid] = ("missing_result", min(len(of(a)) for a, _ in alts), None, None, None)
            continue
        if not said[0][0]:
            out[sid] = ("invalid_result", None, None, None, None)
            continue
        own = sorted((x[2], x[1], x[3], x[4]) for x in actual if x[0] == sid)
        best = None
        for a, rec in alts:
            e, right, n = of(a), {"f": 0, "g": 0}, max(len(of(a)), len(own))
            for k in range(min(len(e), len(own))):
                right["f"] += e[k][2] == own[k][2]
                right["g"] += e[k][3] == own[k][3]
            pool, missed = [x[0] for x in own], 0
            for x in e:
                if x[0] in pool:
                    pool.remove(x[0])
                else:
                    missed += 1
            total = sum(right.values()) + (rec == said[0][1])
            if best is None or total > best[0]:
                best = (total, right, n, missed, len(pool), rec == said[0][1])
        _, right, n, missed, unmatched, classified = best
        for k in sums:
            sums[k][0] += right[k]
            sums[k][1] += n
        wrong = [k for k in ("f", "g") if right[k] < n]
        out[sid] = ("passed" if classified and not wrong else "semantic_mismatch", missed, unmatched, classified, wrong)
    return out, sums


def test_evaluation_equals_a_loop(spark):
    rng = random.Random(7)
    samples = [(i, rng.random() < 0.85) for i in range(60)]
    alternatives = [(i, a, rng.random() < 0.6) for i, _ in samples if rng.random() < 0.9 for a in range(rng.randrange(1, 4))]
    listing = lambda: (rng.choice("pqr"), rng.choice(["1", "2", None]), rng.choice([1, None]))
    expected = [(i, a, k, *listing()) for i, a, _ in alternatives for k in range(rng.randrange(0, 4))]
    predicted = [(i, rng.random() < 0.85, rng.random() < 0.6) for i, _ in samples if rng.random() < 0.85]
    actual = []
    for i, *_ in predicted:
        copy_ = [x[2:] for x in expected if x[0] == i and x[1] == 0] if rng.random() < 0.6 else [(k, *listing()) for k in range(rng.randrange(0, 4))]
        actual += [(i, *x) for x in copy_]
    frames = (
        spark.createDataFrame(samples, "id int, reviewed boolean"), spark.createDataFrame(alternatives, "id int, alt int, is_recruitment boolean"),
        spark.createDataFrame(expected, "id int, alt int, pos int, anchor string, f string, g int"), spark.createDataFrame(predicted, "id int, valid boolean, is_recruitment boolean"),
        spark.createDataFrame(actual, "id int, pos int, anchor string, f string, g int"),
    )
    want, sums = plain_cases(samples, alternatives, expected, predicted, actual)
    judged = evaluation.cases(*frames, ["f", "g"])
    assert {r.id: tuple(r)[1:] for r in judged.collect()} == want
    assert len({w[0] for w in want.values()}) == 5
    assert {r.field: [r.correct, r.total] for r in evaluation.accuracy(*frames, ["f", "g"]).collect()} == sums
    labelled = frames[0].withColumns({"categories": F.when(F.col("id") % 2 == 0, F.array(F.lit("truncated"), F.lit("x"))), "truncated": F.lit(False)})
    said = evaluation.report(labelled, judged, ["x", "truncated", "y"]).first()
    assert (said.samples, said.missing_categories, said.passed) == (60, ["truncated", "y"], False) and said.reviewed == sum(w[0] != "awaiting_human_annotation" for w in want.values())
    only = judged.where("status = 'passed'")
    assert evaluation.report(labelled.withColumn("truncated", F.lit(True)), only, ["x", "truncated"], least=1).first().passed
