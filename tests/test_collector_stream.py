"""The streamed collector equals the batch form, whatever the micro-batches and their order, and over restarts."""

import random

import pytest

from postlens.operators import collect
from postlens.streaming import collector


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(f"b{rng.randrange(2)}" if rng.random() < 0.95 else None, o, rng.choice([None, *[f"i{k}" for k in range(25)]]), rng.choice([None, *[f"u{k}" for k in range(25)]])) for o in range(90)]
    rows += [("b0", 90 + k, "hot", None) for k in range(30)]  # a key with a fourth of all records
    schema = "batch string, o long, id string, url string"
    whole = spark.createDataFrame(rows, schema)
    want = {r.o: r.cluster for r in collect.clusters(whole, "batch", "o", ["id", "url"]).collect()}
    rng.shuffle(rows)
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    cuts = [0, 40, 41, 95, len(rows)]
    for a, b in zip(cuts, cuts[1:]):  # every call goes on from the checkpoint of the one before
        spark.createDataFrame(rows[a:b], schema).repartition(2).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        q = collector.collect_stream(stream, target, str(tmp_path / "check"), "batch", "o", ["id", "url"], buckets=4)
        q.awaitTermination()
    found = collector.read_clusters(spark, target, q.lastProgress["batchId"])
    assert {r.ord: r.cluster for r in found.collect()} == want
    n = collector.counts(found).first()
    assert (n.scanned, n.exported, n.duplicates) == (120, len(set(want.values())), 120 - len(set(want.values())))
    assert len(set(want.values())) > 5
