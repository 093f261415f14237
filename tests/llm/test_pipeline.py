"""The pipeline's stages on a small table, and registration of all its queries."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import pytest
from fixtures import prose
from pyspark.sql import functions as F

import corpus_pipeline
from postlens import workspace
from postlens.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("tables")
    item = prose(70, 40)
    rows = [(i, prose(i, 60), "en", "s", 1) for i in range(40)]
    rows += [(50, prose(1, 60), "en", "s", 1), (51, prose(2, 60) + " more", "en", "s", 1), (52, prose(71, 20) + " " + item, "en", "s", 1)]
    rows += [(53, prose(72, 30) + ' token = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b" ' + prose(73, 30), "en", "s", 1), (54, None, None, None, None), (55, "", "en", "s", 0)]
    toxic = [(100 + i, " ".join(w if k % 9 else "scoundrel" for k, w in enumerate(prose(200 + i, 60).split())), "en", "s", 1) for i in range(40)]
    spark.createDataFrame(rows + toxic, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(r[0] >= 100)) for r in rows + toxic], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return str(base)


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, seen = docs.columns, []
    for name, f in corpus_pipeline.STAGES[:-1]:
        docs = f(spark, docs, tables)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen.append({r.doc_id for r in docs.collect()})
    clean = set(range(40)) | {53, 54, 55}
    assert seen[0] == clean | {50, 51, 52} and seen[1] == clean | {52} and seen[2] == seen[3] == clean
    assert docs.where("text like '%[SECRET]%'").count() == 1
    last = corpus_pipeline.STAGES[-1][1](spark, docs, tables)
    assert last.count() == len(clean) and last.where("n_tokens > 0").count() == len(clean) - 2


def test_run(spark, tables):
    assert corpus_pipeline.run(spark, tables).count() == 43


def test_odd_documents_pass(spark, tables, tmp_path):
    """Nulls in every column, repeated rows and ids, a very long text, ties, and columns named like the operators' own."""
    long = prose(300, 30000)
    rows = [(None, prose(301, 50), None, None, None), (1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (3, long, "en", "s", 1), (3, long, "en", "s", 1), (4, prose(302, 40), "en", "s", 1), (5, prose(302, 40), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = ("score", "predicted", "class_id", "n_links", "shift", "probability", "key")
    for c in clash:
        docs = docs.withColumn(c, F.lit("clash"))
    columns = docs.columns
    for name, f in corpus_pipeline.STAGES[:-1]:
        docs = f(spark, docs, tables)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    got = docs.collect()
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in got) == [-1, 1, 1, 2, 3, 3, 4] and all(r.score == "clash" for r in got)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, tables).collect()
    assert len(last) == 7 and all((r.n_tokens == 0) == (r.doc_id in (1, 2)) for r in last)


def test_empty_tables(spark, tables, tmp_path):
    base = tmp_path / "none"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{base}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(base)).count() == 0
    docs = spark.read.parquet(f"{tables}/documents.parquet").where("doc_id < 5")
    for _, f in corpus_pipeline.STAGES[:-1]:
        docs = f(spark, docs, str(base))
    assert docs.count() == 5


def test_run_leaves_one_table_in_the_shared_folder(spark, tables):
    mark = workspace.len_staged()
    out = corpus_pipeline.run(spark, tables)
    assert workspace.len_staged() == mark + 1 and out.count() == 43


def test_registration():
    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 14)} and set(ORACLES) <= set(QUERIES)
    assert list(corpus_pipeline.QUERIES) == ["pipeline"] and len(corpus_pipeline.STAGES) == 5
