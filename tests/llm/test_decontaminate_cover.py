"""Decontamination against every diagonal, without seeds."""

import itertools
import math
import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from fixtures import frame, prose
from pyspark.sql import functions as F
from test_native import rows, sql

from postlens.llm import decontaminate


def test_masks_hit_every_placement():
    for need in range(1, decontaminate.WINDOW + 1):
        lost = need - math.ceil(need * decontaminate.SHARE)
        for gone in itertools.combinations(range(need), lost):
            hit = any(all(c == "0" or at + i not in gone for i, c in enumerate(m)) for m in decontaminate.masks(need) for at in range(need - len(m) + 1))
            assert hit, (need, gone)


def every_diagonal(docs, items):
    found = {}
    for (d, text), (i, item) in itertools.product(docs, items):
        w, b = text.split(), item.split()
        need = min(decontaminate.WINDOW, len(b))
        for shift in range(1 - len(b), len(w)):
            for at in range(max(shift, 0), min(shift + len(b), len(w)) - need + 1):
                n = sum(w[p] == b[p - shift] for p in range(at, at + need))
                if n >= math.ceil(need * decontaminate.SHARE):
                    a, z, m = found.get((d, i), (at, 0, 0))
                    found[d, i] = (min(a, at), max(z, at + need), max(m, n))
    return {(*k, *v) for k, v in found.items()}


def test_overlaps_of_every_length(spark):
    """Items of 1 to 15 words, with every tolerated substitution, and some beyond, of the first window."""
    items = [(n, " ".join(f"w{n}x{i}" for i in range(n))) for n in range(1, 16)]
    docs = []
    for n, item in items:
        need = min(n, decontaminate.WINDOW)
        lost = need - math.ceil(need * decontaminate.SHARE)
        for gone in [*itertools.combinations(range(need), lost), *random.Random(n).sample([*itertools.combinations(range(need), min(lost + 1, need))], 1)]:
            w = item.split()[:need]
            for g in gone:
                w[g] = "zebra"
            docs.append((len(docs), " ".join(["left"] * (len(docs) % 3) + w + ["right"])))
    out = decontaminate.overlaps(frame(spark, [(d, t, "", "", 0) for d, t in docs]), spark.createDataFrame(items, "item_id long, text string"))
    wanted = every_diagonal(docs, items)
    assert len({d for d, *_ in wanted}) > 300
    assert {(r.doc_id, r.item_id, r.start_word, r.end_word, r.best) for r in out.collect()} == wanted
    # the SQL has no masks either
    documents = frame(spark, [(d, t, "", "", 0) for d, t in docs])
    assert rows(out) == sql(decontaminate.ORACLE, documents=documents, benchmark=spark.createDataFrame(items, "item_id long, text string"))


def test_long_repeated_and_clashing(spark):
    """An item in the middle of a very long text is found; repeated rows report once; columns of other meaning do no harm."""
    item = prose(80, 30)
    text = prose(81, 40000) + " " + item + " " + prose(82, 20000)
    docs = frame(spark, [(1, text, "", "", 0), (1, text, "", "", 0), (2, prose(83, 50), "", "", 0)])
    for c in ("item_id", "h", "pos", "w", "found", "shift"):
        docs = docs.withColumn(c, F.lit("clash"))
    got = [tuple(r)[:4] for r in decontaminate.overlaps(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()]
    assert got == [(1, 7, 40000, 40030)]
    assert [r.doc_id for r in decontaminate.clean(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()] == [2]
