"""Events are read once; every later step takes the staged rows."""

from postlens.operators import dedupe


def test_input_is_read_once(spark, tmp_path):
    rows = [(1, "k", "a", [7], "x"), (2, "k", None, [8], ""), (3, "k", None, [9, 9], "x"), (4, None, "a", [7], "x"), (5, "k", "b", [8], ""), (6, "j", "b", [8], ""), (7, "j", "c", [10, 10], "")]
    spark.createDataFrame(rows, "ord long, key string, source string, organisers array<long>, content string").write.parquet(f"{tmp_path}/in")
    df = spark.read.parquet(f"{tmp_path}/in")
    out = dedupe.judge_events(df, "ord", "ord", "key", "source", "organisers", "content")
    assert not [f for f in out.inputFiles() if str(tmp_path) in f]
    found = {r["ord"]: (r["status"], r["duplicate_of"], r["n_candidates"], r["position"]) for r in out.collect()}
    assert found == {
        1: ("possible_duplicate", None, 3, 1), 2: ("possible_duplicate", None, 1, 2), 3: ("duplicate", 1, 0, 3), 4: ("unique", None, 0, 1),
        5: ("duplicate", 2, 0, 4), 6: ("possible_duplicate", None, 1, 1), 7: ("possible_duplicate", None, 1, 2),
    }
