"""FTRL against a plain loop, what the model catches and leaves alone with samples of several sizes, odd rows."""

import math
import os
import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import numpy as np
import pytest
from fixtures import empty, frame, prose
from pyspark.sql import functions as F

from postlens.llm import toxicity

DATA = "/root/testdata/sf0.1"


def plain_ftrl(examples, labels, p):
    """The published update, one coordinate at a time."""
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        l1 = 0.0 if i == "bias" else p.l1
        if abs(zi) <= l1:
            return 0.0
        return -(zi - math.copysign(l1, zi)) / ((p.beta + math.sqrt(n.get(i, 0.0))) / p.alpha + p.l2)

    for _ in range(p.epochs):
        for x, y in zip(examples, labels):
            own = [*x, "bias"]
            w = {i: weight(i) for i in own}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in own:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / p.alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z if weight(i)}


def test_ftrl_is_the_plain_one():
    rng = random.Random(3)
    labels = [int(rng.random() < 0.3) for _ in range(200)]
    examples = [sorted(rng.sample(range(40), 6) + ([50 + rng.randrange(3)] if y else [])) for y in labels]
    p = toxicity.Params(epochs=3, l1=2.0)
    want = plain_ftrl(examples, labels, p)
    m = toxicity.fit_ftrl([np.array(x) for x in examples], labels, p)
    assert m.bias == pytest.approx(want.pop("bias")) and 0 < len(want) < 43
    assert dict(zip(m.index.tolist(), m.weight.tolist())) == pytest.approx(want)


def test_features_are_grams_and_skips():
    """One feature for each distinct word, pair, triple and pair with one or two words between, in one text only."""
    def count(text):
        row, idx = toxicity.grams([text])
        return len(set(idx.tolist()))

    assert [count(t) for t in (None, "", "a", "a b", "a b c", "a b c d", "A a")] == [0, 0, 1, 3, 7, 12, 2]
    rows, _ = toxicity.grams(["a b", "", "c d"])
    assert np.bincount(rows).tolist() == [3, 0, 3]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize("rows, catch", [(1000, 0.5), (3000, 0.8)])
def test_sample_size_leaves_clean_documents_alone(spark, rows, catch):
    """A sample smaller than the labelled rows changes how much is caught, not how many clean documents are rejected."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = toxicity.train(docs, labels, toxicity.Params(sample_rows=rows))
    held = labels.where("toxic is not null").where(toxicity.crc_bucket("doc_id", 5) == 0).select("doc_id", "toxic")
    out = toxicity.score(docs.select("doc_id", "text").join(F.broadcast(held), "doc_id"), model).select("toxic", "predicted").toPandas()
    toxic = out["toxic"] == 1
    assert (out["predicted"][toxic] == 1).mean() > catch and (out["predicted"][~toxic] == 0).mean() > 0.97


def test_long_repeated_and_clashing(spark):
    long = prose(5, 60000)
    rows = [(1, long, "", "", 0), (1, long, "", "", 0), (2, prose(6, 50), "", "", 0), (3, None, "", "", 0)]
    model = toxicity.Model(np.unique(toxicity.grams([long])[1])[:5], np.ones(5), -1.0)
    df = frame(spark, rows).withColumn("score", F.lit("clash")).withColumn("predicted", F.lit("clash"))
    out = toxicity.score(df, model).collect()
    assert sorted((r.doc_id, r.predicted) for r in out if r.doc_id != 2) == [(1, 1), (1, 1), (3, 0)] and len(out) == 4
    assert next(r.score for r in out if r.doc_id == 1) == pytest.approx(1 / (1 + math.exp(-4)))
    assert toxicity.score(empty(spark).withColumn("predicted", F.lit(1)), model).columns[-2:] == ["score", "predicted"]
