"""A bitmap of few keys is small, and never loses one."""

import numpy as np
from pyspark.sql import functions as F

from postlens.llm.common import Bitmap


def test_few_keys_take_little(spark):
    keys = spark.range(300).select(F.xxhash64("id").alias("key"))
    bits, held = Bitmap(keys), np.array([r["key"] for r in keys.collect()], dtype=np.int64).view(np.uint64)
    assert bits.words.nbytes < 1 << 16 and bits.has(held).all()
    others = spark.range(10_000, 30_000).select(F.xxhash64("id").alias("key"))
    other = np.array([r["key"] for r in others.collect()], dtype=np.int64).view(np.uint64)
    assert bits.has(other).mean() < 0.001
    assert not Bitmap(keys.limit(0)).has(held).any()
