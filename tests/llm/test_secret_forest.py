"""Labelled findings, features counted over the whole table, and what the forest makes of strings it has not seen."""

import hashlib
import os
import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import pytest
from fixtures import empty, frame, prose

from postlens.llm import secrets

DATA = "/root/testdata/sf0.1"


def key(i):
    return hashlib.sha1(str(i).encode()).hexdigest()


def test_counts_cover_the_whole_table(spark):
    docs = frame(spark, [(1, "River river STONE, ab", "", "", 0), (2, "river-9stone", "", "", 0), (3, None, "", "", 0)])
    assert {r["word"]: r["n"] for r in secrets.document_counts(docs).collect()} == {"river": 2, "stone": 2}


def test_planted_findings_of_every_kind(spark):
    """Trained on one set of documents, judged on another: planted secrets go, digests, numbers, identifiers and paths stay."""
    def doc(i, seed):
        rng = random.Random(seed * 1000 + i)
        name = rng.choice(["token", "api_key", "client_secret", "password"])
        hex_, ident = key(seed * 1000 + i), "handlerForRequest" + str(rng.randint(100, 999))
        clean = rng.choice([f"commit {key(-i - seed)}", f"card {rng.randint(10**15, 10**16 - 1)}", f"see /usr/share/module/{ident}", f"id 123e4567-e89b-12d3-a456-4266141{i % 90000:05d}"])
        return f'{prose(i, 15)} {name} = "{hex_}" {prose(i + 1, 15)} {clean} {prose(i + 2, 6)}', hex_

    train = [(i, doc(i, 1)[0], "", "", 0) for i in range(300)]
    test = [(i, doc(i, 2)[0], "", "", 0) for i in range(100)]
    forest = secrets.train(frame(spark, train))
    wanted = {i: doc(i, 2)[1] for i in range(100)}
    texts = {r[0]: r[1] for r in test}
    found = [(r.doc_id, texts[r.doc_id][r.start : r.end]) for r in secrets.scan(frame(spark, test), forest).collect() if r.is_secret]
    right = {x for x in found if x[1] == wanted[x[0]]}
    assert len(right) == 100 and len(found) - len(right) <= 5
    held = secrets.held_out(frame(spark, train), forest)
    assert held[0] > 30 and held[1] / held[0] > 0.95 and held[3] / held[2] > 0.95


def test_given_labels_rule(spark):
    """Findings labelled by the caller are what the forest learns, whatever the rules say."""
    docs = [(i, f'{prose(i, 5)} serial {key(i).upper() if i % 2 else key(i)} {prose(i, 5)}', "", "", 0) for i in range(120)]
    df = frame(spark, docs)
    spans = secrets.scan(df, None).collect()
    given = spark.createDataFrame([(r.doc_id, r.start, r.end, r.doc_id % 2) for r in spans] + [(1, 0, 2, 1)], "doc_id long, start long, end long, label int")
    assert secrets.train(df) is None  # the rules leave bare strings open
    forest = secrets.train(df, given=given)
    out = secrets.scan(df, forest).collect()
    assert sum(r.is_secret == bool(r.doc_id % 2) for r in out) >= 118


def test_long_and_repeated(spark):
    text = prose(1, 30000) + f' token = "{key(1)}" ' + "= " * 20000
    docs = frame(spark, [(1, text, "", "", 0), (1, text, "", "", 0), (None, text, "", "", 0)])
    out = secrets.scan(docs, None).collect()
    assert len(out) == 3 and all(text[r.start : r.end] == key(1) and r.is_secret for r in out)
    assert secrets.document_counts(empty(spark)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_held_out_strings(spark):
    """On the driver's tables: labelled strings of the fold that is kept from the fit."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    n, found, others, left = secrets.held_out(docs, secrets.train(docs))
    assert n > 10 and others > 10 and found / n > 0.95 and left / others > 0.95
