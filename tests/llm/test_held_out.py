"""What the learned queries say of rows without an id, and the language table beyond 32 bits."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import numpy as np
from fixtures import frame, prose

from postlens.llm import langid
from postlens.llm.queries import QUERIES


def test_rows_without_an_id_are_not_held_out(spark, tmp_path):
    frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("op1_toxicity", "op5_language"):
        out = QUERIES[name](spark, str(tmp_path)).collect()
        assert len(out) == 13 and {r.held_out for r in out if r.doc_id is None} == {False} and {type(r.held_out) for r in out} == {bool}


def test_places_beyond_32_bits():
    samples = {"a": [prose(1, 200)], "b": ["zz yy xx ww " * 50]}
    texts = [prose(2, 3000), "zz yy ww xx", "\u00e9 zz", None]
    narrow, wide = langid.Parser(samples), langid.Parser(samples)
    assert narrow.wide is np.uint32
    wide.wide = np.uint64
    assert (narrow.phrases(texts)[0] == wide.phrases(texts)[0]).all()
