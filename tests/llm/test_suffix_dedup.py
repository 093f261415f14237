import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import random

import pytest
from fixtures import empty, frame, odd_rows, prose
from pyspark.sql import functions as F

from postlens.llm import suffix_dedup


def key(rows):
    return sorted(((-1 if r[0] is None else r[0]), *r[1:]) for r in map(tuple, rows))


def check(spark, rows):
    got = suffix_dedup.digest(frame(spark, [(i, t, None, None, None) for i, t in rows])).collect()
    assert key(got) == key(suffix_dedup.brute_force(rows))


def test_odd_rows(spark):
    check(spark, [(r[0], r[1][:6000] if r[1] else r[1]) for r in odd_rows()])


@pytest.mark.parametrize("seed", range(3))
def test_random_overlaps(spark, seed):
    """Passages cut, shifted and spliced at random, periodic texts and texts of around 50 bytes."""
    rng = random.Random(seed)
    pool = [prose(100 + i, 60) for i in range(5)] + ["ab" * 200, "x" * 300]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            parts.append(p[a : a + rng.randint(1, 160)])
        rows.append((rng.randint(1, 50), rng.choice(["", " é"]).join(parts)))
    check(spark, rows)


def test_long_texts_are_cut_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 97)
    assert [len(p) for p, *_ in suffix_dedup.buffers([], [])] == []
    check(spark, [(1, prose(7, 80)), (2, prose(8, 20) + prose(7, 80)[50:400] + prose(9, 20)), (3, prose(7, 80)[:300])])


def test_definition_by_hand():
    a = "".join(chr(97 + i % 26) for i in range(50))
    assert [r[2] for r in suffix_dedup.brute_force([(1, a), (2, "x" + a + "y"), (3, a[:49]), (None, a)])] == [0, 50, 0, 0]


def test_empty_and_clashing_columns(spark):
    assert suffix_dedup.digest(empty(spark)).count() == 0
    df = frame(spark, [(1, prose(1, 30), "", "", 0), (2, prose(1, 30), "", "", 0)])
    for c in ("kept", "n_bytes", "doc_hash", "text_hash", "later", "start"):
        df = df.withColumn(c, F.lit("clash"))
    assert sorted(r.n_removed > 0 for r in suffix_dedup.digest(df).collect()) == [False, True]


def test_empty_texts_between(spark):
    """Runs are credited to the right document when several empty and null texts lie before, between and after full ones."""
    text = prose(7, 40)
    check(spark, [(1, ""), (2, None), (3, text), (4, ""), (5, ""), (6, None), (7, text[:90] + " " + prose(8, 20)), (8, ""), (9, prose(9, 30)), (10, None), (11, text), (12, "")])
