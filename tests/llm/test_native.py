"""Decontamination, line deduplication and Hamming search, against their SQL and by hand."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import itertools
import random

import duckdb
import numpy as np
import pytest
from fixtures import empty, frame, prose
from pyspark.sql import functions as F

from postlens.llm import decontaminate, hamming, line_dedup


def sql(oracle, **tables):
    db = duckdb.connect()
    for name, df in tables.items():
        db.register(name + "_", df.toPandas().astype(object) if name == "embeddings" else df.toPandas())
        db.sql(f"create view {name} as select * from {name}_")
    out = db.sql(oracle)
    order = sorted(out.columns)
    return order, sorted(tuple(r[out.columns.index(c)] for c in order) for r in out.fetchall())


def rows(df):
    order = sorted(df.columns)
    return order, sorted(tuple(r[c] for c in order) for r in df.collect())


def items(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


def test_decontamination(spark):
    item = prose(50, 40)
    words = item.split()
    swapped = list(words)
    for i in (4, 11, 19, 27):
        swapped[i] = "zebra"
    docs = frame(spark, [
        (1, prose(51, 50) + " " + item + " " + prose(52, 50), "", "", 0), (2, prose(53, 30) + " " + " ".join(swapped).upper(), "", "", 0), (3, " ".join(words[:6]) + " " + prose(54, 80), "", "", 0),
        (4, None, None, None, None), (5, "", "", "", 0), (6, prose(55, 300), "", "", 0), (1, item, "", "", 0), (None, item, "", "", 0),
    ])
    bench = items(spark, [item, None, "", "too short", item])
    out = decontaminate.overlaps(docs, bench)
    assert {(r.doc_id, r.item_id) for r in out.collect()} == {(1, 0), (1, 4), (2, 0), (2, 4)}
    kept = decontaminate.clean(docs.withColumn("start_word", F.lit("clash")), bench)
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 3, 4, 5, 6] and kept.columns == [*docs.columns, "start_word"]
    distinct = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    assert rows(decontaminate.overlaps(distinct, bench)) == sql(decontaminate.ORACLE, documents=distinct, benchmark=bench)
    assert decontaminate.overlaps(empty(spark), bench).count() == 0 and decontaminate.overlaps(docs, items(spark, [])).count() == 0


def test_decontamination_without_broadcast(spark, monkeypatch):
    item = prose(50, 40)
    docs = frame(spark, [(1, item, "", "", 0), (2, prose(51, 60), "", "", 0)])
    wanted = rows(decontaminate.overlaps(docs, items(spark, [item])))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", -1)
    assert rows(decontaminate.overlaps(docs, items(spark, [item]))) == wanted


def test_lines(spark):
    long = "A line that is shared by all."
    docs = frame(spark, [(1, f"{long}\nown line number one here\nshort\n{long}", "", "", 0), (2, f"short\n  a LINE that is  shared by all.\nown line number two here", "", "", 0), (3, None, "", "", 0), (4, "", "", "", 0), (5, long, "", "", 0), (6, "\n\n", "", "", 0)])
    out = {r.doc_id: r for r in line_dedup.dedup(docs, min_words=4).collect()}
    assert out[1].n_removed == 1 and out[1].text == f"{long}\nown line number one here\nshort"
    assert out[2].removed_spans == "6:38" and out[5].text == "" and out[3].text is None and out[6].n_removed == 0
    assert [out[i].n_shared for i in range(1, 7)] == [1, 1, 0, 0, 1, 0]
    wide = " ".join(f"w{i}" for i in range(20))
    docs = docs.union(frame(spark, [(7, f"{wide} a\n{wide} b\nx", "", "", 0), (8, f"{wide}  A\n{wide} c\n{wide} c\n" + "短い文です" * 3, "", "", 0), (9, "短い文です" * 3 + "\n短い文です", "", "", 0), (10, "短い文です", "", "", 0)]))
    q = line_dedup.dedup(docs).select("doc_id", "n_units", "n_removed", "removed_spans", "n_shared", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
    assert rows(q) == sql(line_dedup.ORACLE, documents=docs)


def test_lines_odd_rows(spark):
    out = line_dedup.dedup(frame(spark).withColumn("starts", F.lit("clash")).withColumn("n_shared", F.lit("clash"))).collect()
    assert len(out) == 13 and sum(r.n_removed for r in out) == 2  # both rows of doc 4
    assert line_dedup.dedup(empty(spark)).count() == 0
    assert line_dedup.dedup(frame(spark, [(1, "a paragraph of some length\n\nb", "", "", 0), (2, "x\n\na paragraph of some length", "", "", 0)]), "paragraph", 1).where("doc_id = 2").first().text == "x"


def vectors(spark, rows_):
    return spark.createDataFrame(rows_, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("n, k", [(7, 10), (400, 5)])
def test_hamming(spark, n, k):
    """Ties, a hot vector, null rows and more neighbours asked for than there are."""
    rng = np.random.default_rng(n)
    data = [(i, (rng.normal(size=64) if i % 3 else np.ones(64)).astype(np.float32).tolist(), 0) for i in range(n)]
    df = vectors(spark, data + [(None, [1.0] * 64, 0), (9999, None, 0)])
    index = hamming.codes(df.withColumn("code", F.lit("clash")))
    got = rows(hamming.top_k(index, index.where("id % 100 = 0"), k))
    bits = {i: np.array(v) > 0 for i, v, _ in data}
    wanted = []
    for q in range(0, n, 100):
        near = sorted((int((bits[q] != bits[i]).sum()), i) for i in bits if i != q)[:k]
        wanted += [(d, q, r, i) for r, (d, i) in enumerate(near, 1)]
    assert got == (["distance", "query_id", "rank", "vec_id"], sorted(wanted))


def test_hamming_empty(spark):
    index = hamming.codes(vectors(spark, []))
    assert hamming.top_k(index, index, 3).count() == 0


@pytest.mark.parametrize("m", [2, 3, 4, 6, 8])
def test_hamming_segments_of_any_width(spark, monkeypatch, m):
    """Segments of 32 down to 8 bits give what brute force gives; near codes, so that wide segments close early."""
    monkeypatch.setattr(hamming, "SEGMENTS", m)
    rng = random.Random(m)
    base = rng.getrandbits(63)
    codes = [base ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 4))) for _ in range(120)]
    index = spark.createDataFrame(list(enumerate(codes)), "id long, code long")
    got = rows(hamming.top_k(index, index.where("id % 20 = 0"), 4))
    wanted = []
    for q in range(0, 120, 20):
        near = sorted(((codes[q] ^ c).bit_count(), i) for i, c in enumerate(codes) if i != q)[:4]
        wanted += [(d, q, r, i) for r, (d, i) in enumerate(near, 1)]
    assert got == (["distance", "query_id", "rank", "vec_id"], sorted(wanted))


def test_hamming_segments_cover_the_code(monkeypatch):
    for m in (1, 3, 4, 5, 8):
        monkeypatch.setattr(hamming, "SEGMENTS", m)
        parts = hamming.segments()
        assert len(parts) == m and sum(w for _, w in parts) == 64
        assert [a for a, _ in parts] == [sum(w for _, w in parts[:i]) for i in range(len(parts))]


def test_hamming_masks_are_the_combinations(spark):
    one = spark.range(1)
    for width, r in ((1, 0), (5, 2), (5, 5), (22, 3)):
        masks = [x.mask for x in hamming._flipped(one, width, r).collect()]
        assert sorted(masks) == sorted(sum(1 << b for b in c) for c in itertools.combinations(range(width), r))


def test_hamming_odd_vectors(spark):
    """Repeated ids count once, null elements as not positive, other lengths are padded, over 64 elements is an error."""
    df = vectors(spark, [(0, [1.0, None, -1.0], 0), (0, [1.0, None, -1.0], 1), (1, [1.0, 1.0, -1.0], 0), (2, [], 0), (3, [1.0, -2.0, 0.0], 0)])
    index = hamming.codes(df.withColumn("id", F.lit("clash")).withColumn("q", F.lit("clash")))
    got = [(r.vec_id, r.distance) for r in hamming.top_k(index, index.where("id = 0"), 5).orderBy("rank").collect()]
    assert got == [(3, 0), (1, 1), (2, 1)]
    with pytest.raises(Exception, match="more than 64"):
        hamming.codes(vectors(spark, [(0, [1.0] * 65, 0)])).collect()
