"""A bitmap grows with its keys, so that it filters as well for many as for few; keys travel packed."""

import numpy as np
from pyspark.sql import functions as F

from postlens.llm import common
from postlens.llm.common import Bitmap


def test_many_keys_are_filtered_as_well_as_few(spark):
    """20 million keys (two in each eight bits of the 2**27 that a bitmap had at most) still leave all but a few others out."""
    bits = Bitmap(spark.range(20_000_000).select(F.xxhash64("id").alias("key")))
    some = lambda a, b: np.array([r["key"] for r in spark.range(a, b).select(F.xxhash64("id").alias("key")).collect()], dtype=np.int64).view(np.uint64)
    assert bits.has(some(0, 20_000)).all() and bits.has(some(30_000_000, 30_020_000)).mean() < 0.02
    assert bits.words.nbytes <= 4 * 20_000_000


def test_packed_keys_count_across_chunks_and_tasks(monkeypatch):
    """About four bytes a key; those that come again in a chunk, in another one or in another task are found, others are not."""
    monkeypatch.setattr(common, "HELD", 60_000)
    keys = common.mix64(np.arange(300_000, dtype=np.uint64))
    one = lambda x: (0, x, np.ones(len(x), dtype=np.int64))
    tasks = [[one(keys[:100_000]), one(keys[:1000])], [one(keys[100_000:]), one(keys[1000:2000]), (0, keys[2000:3000], np.full(1000, 2)), (1, keys[:9], np.ones(9))]]
    rows = common.pa.Table.from_batches([b for t in tasks for b in common.packed(iter(t))])
    assert rows.select(["once", "more"]).nbytes < 6 * 303_000
    of = lambda kind, part, least: (part, common._segment(rows.filter((common.pa.compute.field("kind") == kind) & (common.pa.compute.field("part") == part)), least).tobytes())
    twice = Bitmap(segments=[of(0, p, 2) for p in range(common.PARTS)])
    assert twice.has(keys[:3000]).all() and twice.has(keys[3000:]).mean() < 0.02
    assert Bitmap(segments=[of(0, p, 1) for p in range(common.PARTS)]).has(keys).all()
    other = Bitmap(segments=[of(1, p, 1) for p in range(common.PARTS)])
    assert other.has(keys[:9]).all() and other.has(keys[9:]).mean() < 0.02
