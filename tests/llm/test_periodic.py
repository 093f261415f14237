import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from fixtures import empty, frame
from pyspark.sql import functions as F

from postlens.llm import periodic
from postlens.llm import queries as registered


def plain_runs(words, least=24, times=3):
    """Every stretch by its definition: maximal with period q, of which q is the smallest."""
    out, n = {}, len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                out.setdefault((i, j + q - i), q)  # the smallest period comes first
            i = j
    return sorted((s, length, q) for (s, length), q in out.items())


def found(docs):
    vocabulary = {}
    codes = np.array([vocabulary.setdefault(w, len(vocabulary)) for d in docs for w in d], dtype=np.int64)
    by = periodic.runs_of(codes, np.cumsum([len(d) for d in docs]))
    return [by.get(k, []) for k in range(len(docs))]


def test_transform_is_a_convolution():
    rng = np.random.default_rng(1)
    for n in (2, 8, 64):
        a, b = rng.integers(0, periodic.PRIME, (3, n)), rng.integers(0, periodic.PRIME, (3, n))
        got = periodic.untransform(periodic.transform(a.astype(np.uint64)) * periodic.transform(b.astype(np.uint64)) % np.uint64(periodic.PRIME))
        for r in range(3):
            want = [sum(int(a[r, i]) * int(b[r, (k - i) % n]) for i in range(n)) % periodic.PRIME for k in range(n)]
            assert got[r].tolist() == want


def test_zero_sums_are_copies():
    rng = np.random.default_rng(2)
    blocks, windows = rng.integers(0, 2, (40, 4)), rng.integers(0, 2, (40, 9))
    got = periodic.zero_sums(blocks.astype(np.uint64), windows.astype(np.uint64))
    for r in range(40):
        assert got[r].tolist() == [blocks[r].tolist() == windows[r, d : d + 4].tolist() for d in range(6)]


@pytest.mark.parametrize("seed", range(6))
def test_equals_every_stretch(seed):
    """Random documents with planted powers, nested powers and powers that differ in one word, many at a time."""
    rng = random.Random(seed)
    docs = []
    for _ in range(60):
        words = []
        while len(words) < rng.choice([0, 10, 30, 200, 700]):
            root = [rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 40, 64, 90]))]
            if rng.random() < 0.3:
                root = root * rng.choice([2, 3]) + [rng.choice("abcd")]
            power = root * rng.choice([1, 2, 3, 4, 6])
            power = power[: len(power) - rng.randrange(len(root))]
            if rng.random() < 0.2 and power:
                power[rng.randrange(len(power))] = "z"
            words += power + [rng.choice("abcdefgh") for _ in range(rng.choice([0, 1, 5, 20]))]
        docs.append(words)
    for words, got in zip(docs, found(docs)):
        assert got == plain_runs(words)


def test_edges():
    for q in (1, 7, 8, 15, 16, 33):
        for n in (max(24, 3 * q) - 1, max(24, 3 * q)):
            for before in range(0, 18):
                words = [f"x{i}" for i in range(before)] + [f"p{i % q}" for i in range(n)] + ["end"]
                assert found([words]) == [plain_runs(words)]
    copies = ["a", "b"] * 20
    assert found([copies, copies[:23], copies]) == [[(0, 40, 2)], [], [(0, 40, 2)]]  # none goes on into the next document
    with pytest.raises(ValueError):
        periodic.runs_of(np.zeros(30, dtype=np.int64), np.array([30]), least=10)


def test_small_pieces(monkeypatch):
    monkeypatch.setattr(periodic, "AT_ONCE", 1)
    test_equals_every_stretch(9)


def altered(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def expected(doc_id, text):
    words = altered(doc_id, text) if doc_id is not None else (text or "").encode().split()
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    numbers = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *numbers, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_equals_contract(spark, tmp_path):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["la", "lo", "li", "lu\n", "\tx"]) for _ in range(rng.randrange(1, 150)))) for i in range(400)]
    docs += [(None, "a b " * 30), (500, None), (501, ""), (502, " \n\t "), (503, "é é " * 40), (503, "é é " * 40), (504, "one two three " * 2000)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = registered.QUERIES["op13_periodic"](spark, str(tmp_path))
    assert out.columns[:8] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(400)) > 20
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(str(expected(*d)) for d in docs)


def test_columns_and_empty(spark):
    df = frame(spark).withColumn("runs", F.lit("clash")).withColumn("collapsed", F.lit(1)).withColumn("start", F.lit(2))
    out = periodic.find_runs(df)
    assert out.columns[-3:] == ["n_words", "runs", "collapsed"] and out.columns.count("runs") == 1 and out.count() == 13
    assert {r.start for r in out.collect()} == {2}
    assert periodic.digest(empty(spark)).count() == 0
