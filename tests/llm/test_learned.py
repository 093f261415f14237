"""Toxicity, language, personal data and secrets: held-out accuracy, odd rows, brute force where there is one."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import hashlib
import itertools
import os
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from fixtures import empty, frame, prose
from pyspark.sql import functions as F

from postlens.llm import langid, pii, secrets, toxicity
from postlens.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def bad(seed, n=80):
    w = prose(seed, n).split()
    for i in range(5, n, 20):
        w[i] = "scoundrel"
    return " ".join(w)


def test_toxicity(spark):
    rows = [(i, bad(i) if i % 2 else prose(1000 + i, 80), "", "", 0) for i in range(300)]
    docs = frame(spark, rows + [(900, None, None, None, None), (901, "", "", "", 0), (None, bad(1), "", "", 0), (1, bad(1), "", "", 0)])
    marks = labels(spark, [(i, 1, i % 2) for i in range(300)] + [(5, 1, 0), (None, 1, 1), (7, 1, None), (100000, 0, 1)])
    model = toxicity.train(docs, marks)
    out = toxicity.score(docs.withColumn("score", F.lit("clash")), model)
    got = {r.doc_id: r for r in out.collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(got[i].predicted == i % 2 for i in held)
    assert out.count() == 304 and got[900].score == got[901].score < 0.5 and got[None].predicted == 1
    assert len(model.index) < 2000


def test_toxicity_without_labels(spark):
    model = toxicity.train(frame(spark), labels(spark, []))
    assert {(r.score, r.predicted) for r in toxicity.score(frame(spark), model).collect()} == {(0.0, 0)}
    assert toxicity.score(empty(spark), model).count() == 0


def test_language(spark):
    de = lambda i: " ".join(random.Random(i).choice("der und nicht ein für öffnung straße über keit lich".split()) for _ in range(60))
    rows = [(i, de(i), "de", "", 0) if i % 2 else (i, prose(i, 60), "en", "", 0) for i in range(200)]
    docs = frame(spark, rows + [(300, None, "en", "", 0), (301, "12 !? 34", "en", "", 0), (302, "", None, "", 0), (None, de(1), "de", "", 0), (303, de(5), None, "", 0)])
    out = langid.predict(docs.withColumn("lang_pred", F.lit("clash")), langid.sample(docs))
    got = {r.doc_id: r for r in out.collect()}
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(got[i].lang_pred == ("de" if i % 2 else "en") for i in held)
    assert [got[i].lang_pred for i in (300, 301, 302, None, 303)] == ["und", "und", "und", "de", "de"] and got[301].score == 0
    assert {r.lang_pred for r in langid.predict(docs, {}).collect()} == {"und"}
    assert langid.predict(empty(spark), langid.sample(empty(spark))).count() == 0


def greedy(text, train):
    phrases, now = 1, ""
    for c in text:
        if now + c in train:
            now += c
        else:
            phrases, now = phrases + 1, c if c in train else ""
    return phrases


@pytest.mark.parametrize("segment", [1, 3, 7, 1024])
def test_cross_parse_is_the_greedy_one(monkeypatch, segment):
    """Texts in segments of any length have exactly the phrases of a plain parse of the whole."""
    monkeypatch.setattr(langid, "SEGMENT", segment)
    samples = {"a": ["abcabd abx"], "b": ["xyzzy"], "c": ["ab" * 40 + "c"]}
    parser = langid.Parser(samples)
    rng = random.Random(segment)
    texts = ["abcabdabx", "xyzzyabc", "q", "ab" * 700, "zzyx abd", "a" * 50 + "qq" + "xyz" * 9] + ["".join(rng.choice("abcdxyzq ") for _ in range(rng.randint(1, 60))) for _ in range(60)]
    texts = [" ".join(t.split()) or "a" for t in texts]
    total, some = parser.phrases([*texts, None, "12"])
    assert some.tolist() == [True] * len(texts) + [False, False] and total[:, -2:].sum() == 0
    for i, text in enumerate(texts):
        assert total[:, i].tolist() == [greedy(text, " ".join(samples[k])) for k in parser.langs]


def test_language_of_unequal_samples_and_ties(spark):
    """A language with fifty times the labelled text does not win by that alone; equal languages: the first by name; long texts are read whole."""
    def de(i):
        rng = random.Random(i)
        return " ".join(rng.choice("der und nicht ein für öffnung straße über keit lich".split()) for _ in range(60))

    samples = {"de": [de(i) for i in range(2)], "en": [prose(i, 60) for i in range(100)]}
    rows = [(i, de(100 + i) if i % 2 else prose(500 + i, 60), "", "", 0) for i in range(40)] + [(100, prose(9, 300) + " " + " ".join(de(i) for i in range(60)), "", "", 0)]
    out = {r.doc_id: r for r in langid.predict(frame(spark, rows).withColumn("score", F.lit("clash")), samples).collect()}
    assert all(out[i].lang_pred == ("de" if i % 2 else "en") for i in range(40)) and out[100].lang_pred == "de"
    same = {"x": ["some words"], "w": ["some words"]}
    assert [tuple(r)[-2:] for r in langid.predict(frame(spark, [(1, "some", "", "", 0)]), same).collect()] == [("w", 0.0)]


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            if k == 1 and any(int(x) > 255 for x in m.group().split(".")) or k == 2 and not (12 <= len(d) <= 19 and pii.luhn(d)) or k == 3 and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_are_the_patterns():
    rng = random.Random(2)
    for _ in range(5000):
        t = "".join(rng.choice(["a", "_", "@", ".", "b", "-", "1", " ", "+", "9", "(", "5", ".c", "4111111111111111", "+1 (017) 555-7713", "é"]) for _ in range(rng.randint(0, 18)))
        assert pii.base_spans(t) == plain(t), t
    assert pii.base_spans("1" * 300_000 + "." * 10) == [] and pii.base_spans(None) == []


def test_pii(spark):
    card = "4111111111111111"
    rows = [(i, f"{prose(i, 20)} {card} {prose(i, 5)} mail{i}@a.example.com", "", "", 0) for i in range(60)]
    rows += [(100, None, "", "", 0), (101, "", "", "", 0), (None, card, "", "", 0), (102, f"pay {card} or 4111111111111112 {prose(1, 30)} 4111111111111112", "", "", 0)]
    out = {r.doc_id: r for r in pii.digest(frame(spark, rows).withColumn("base", F.lit("clash"))).collect()}
    assert out[100].spans == out[101].spans == "" and out[100].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert out[None].n_card == 1 and out[102].n_card == 1 and out[102].n_added == out[102].spans.count("card") - 1
    for i, t, *_ in rows[:60]:
        base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in plain(t))
        assert out[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and base in out[i].spans
    assert pii.digest(empty(spark)).count() == 0


def test_ties_long_and_repeated_texts(spark):
    """Spans that start together go in the order of kinds; a long text is read to its end; repeated rows are alike."""
    long = "word " * 60000 + "1.2.3.4@x.example.com"
    rows = [(1, "1.2.3.4@x.example.com", "", "", 0), (2, long, "", "", 0), (2, long, "", "", 0)]
    out = pii.digest(frame(spark, rows).withColumn("spans", F.lit("clash")).withColumn("n_spans", F.lit("clash"))).collect()
    at = len(long) - 21
    assert next(r for r in out if r.doc_id == 1).spans == "email:0:21,ip:0:7"
    assert [(r.spans, r.n_email, r.n_ip) for r in out if r.doc_id == 2] == [(f"email:{at}:{at + 21},ip:{at}:{at + 7}", 1, 1)] * 2
    assert all(r.n_spans == 2 + r.n_added for r in out)


def test_propagation_pulls_repeated_tokens_together():
    """A repeated token takes the label of its observed twin, through the fitted skip potential; a similar one nearly so."""
    pair = lambda kind, label: 4 ** (5 * pii.EDGES.index(kind) + label)
    rows = [(5 + 0, 0, 50), (5 + 4, 0, 50)]  # alone, a token of shape 1 is a phone as often as not
    rows += [(5 + 4, pair("skip", 4), 200), (5 + 0, pair("skip", 0), 200), (5 + 4, pair("near", 4), 90), (5 + 0, pair("near", 0), 90), (5 + 4, pair("near", 0), 10), (5 + 0, pair("near", 4), 10)]
    pot = pii.fit(pd.DataFrame(rows, columns=["node", "around", "n"]))
    f = pii.Field("")
    f.at, f.label, f.shape = [(0, 1), (5, 6), (9, 10), (12, 13)], np.array([4, 0, 0, 0]), np.array([1, 1, 1, 1])
    f.skip, f.near = np.array([[0, 1]]), np.array([[0, 3]])
    p = pii.marginals([f], pot)[0]
    assert p[0, 4] > 0.99 and p[1, 4] > 0.9 and 0.4 < p[2, 4] < 0.6 and 0.7 < p[3, 4] < p[1, 4]


def test_fit_is_a_maximum_of_the_pseudo_likelihood():
    """The gradient, by differences, is near zero at the fitted weights."""
    rng = np.random.default_rng(1)
    counts = pd.DataFrame({"node": rng.integers(0, 15, 40), "around": [int(4 ** rng.integers(0, 15)) for _ in range(40)], "n": rng.integers(1, 30, 40)}).groupby(["node", "around"], as_index=False).sum()
    pot = pii.fit(counts)

    def loss(unary, chain):
        total = 0.0
        for node, around, n in counts.itertuples(index=False):
            score = unary[node // 5].copy()
            for k, table in enumerate((chain, pot.skip, pot.near)):
                for label in range(5):
                    score += (around // 4 ** (5 * k + label) % 4) * table[label]
            total -= n * (score[node % 5] - np.logaddexp.reduce(score))
        return total

    for i in range(5):
        for j in range(i, 5):
            step = np.zeros((5, 5))
            step[i, j] = step[j, i] = 1e-4
            slope = (loss(pot.unary, pot.chain + step) - loss(pot.unary, pot.chain - step)) / 2e-4
            assert abs(slope + pot.chain[i, j] * (1 if i == j else 2)) < 0.5  # the prior pulls back as hard


def exact(f, pot):
    """Marginals by enumerating all labelings that agree with what is observed."""
    p = np.zeros((len(f.at), pii.LABELS))
    for labels_ in itertools.product(range(pii.LABELS), repeat=len(f.at)):
        if all(o in (0, x) for o, x in zip(f.label, labels_)):
            s = sum(pot.unary[f.shape[i], x] for i, x in enumerate(labels_) if not f.label[i])
            s += sum(getattr(pot, kind)[labels_[a], labels_[b]] for kind in pii.EDGES for a, b in getattr(f, kind))
            for i, x in enumerate(labels_):
                p[i, x] += np.exp(s)
    return p / p.sum(axis=1, keepdims=True)


def test_beliefs_are_exact_on_trees_and_close_on_loops():
    rng = np.random.default_rng(5)
    for case in range(12):
        sym = lambda scale: (lambda t: (t + t.T) / 2)(rng.normal(size=(5, 5)) * scale)
        pot = pii.Potentials(rng.normal(size=(pii.SHAPES, 5)), sym(1), sym(1), sym(0.7))
        f = pii.Field("")
        f.at, f.shape, f.label = [(i, i + 1) for i in range(5)], rng.integers(0, 9, 5), np.array([0, 0, 2, 0, 0]) if case % 2 else np.zeros(5, dtype=np.int64)
        f.chain, f.skip, f.near = np.array([[0, 1], [1, 2]]), np.array([[1, 3]]), np.array([[3, 4]])
        assert np.abs(pii.marginals([f], pot)[0] - exact(f, pot)).max() < 1e-3
        f.near = np.array([[3, 4], [0, 4]])  # one loop
        assert np.abs(pii.marginals([f], pot)[0] - exact(f, pot)).max() < 0.1


def test_edges_join_equal_and_similar_tokens():
    text = "call +1 212 555 7713 or (212) 555-7713. ann.lee@mail.example.org, ANN.LEE@mail 4111111111111111 41111111-11111111 4111111199999999 x" + "9" * 5000
    f = pii.Field(text)
    token = [text[a:b] for a, b in f.at]
    named = lambda edges: {(token[a], token[b]) for a, b in edges.tolist()}
    assert ("4111111111111111", "41111111-11111111") in named(f.skip) and not named(f.skip) & named(f.near)
    assert {("ann.lee@mail.example.org", "ANN.LEE@mail"), ("41111111-11111111", "4111111199999999")} <= named(f.near)
    assert pii.shape("9" * 300 + "a") != pii.shape("9" * 300 + "-a") and pii.likenesses("a@b") == []


def test_secrets(spark):
    key = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    rows = [(i, f'{prose(i, 20)} token = "{key(i)}" {prose(i, 20)} {4000000000000000 + i * 7919}', "", "", 7) for i in range(80)]
    rows += [(100, None, "", "", None), (101, "", "", "", 0), (None, f'token = "{key(5)}"', "", "", 1), (102, f"see commit {key(7)} /path/to/{key(8)} {prose(3, 9)}", "", "", 1)]
    docs = frame(spark, rows)
    forest = secrets.train(docs)
    out = secrets.scan(docs, forest).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert all(sum(r.is_secret for r in by[i]) == 1 for i in range(80)) and sum(r.is_secret for r in by[None]) == 1
    assert not any(r.is_secret for r in by[102]) and 100 not in by
    clean = secrets.redact(docs.withColumn("probability", F.lit("clash")), forest)
    assert clean.columns == [*docs.columns, "probability"] and clean.count() == len(rows)
    assert clean.where("text like '%token = \"[SECRET]\"%'").count() == 81 and clean.where("n_chars <> length(text)").count() == 0
    assert secrets.train(empty(spark)) is None and secrets.scan(empty(spark), None).count() == 0
    assert secrets.scan(docs, None).where("is_secret").count() == 81


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_held_out_accuracy(spark):
    """On the driver's tables, by the contract's folds."""
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    held = [r for r in QUERIES["op5_language"](spark, DATA).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    held = [r for r in QUERIES["op1_toxicity"](spark, DATA).collect() if r.held_out and r.doc_id in toxic]
    assert sum(r.predicted == toxic[r.doc_id] for r in held) / len(held) > 0.85
