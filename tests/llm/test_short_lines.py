"""Line deduplication takes lines of any length; a floor is asked for."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from fixtures import frame

from postlens.llm import line_dedup
from postlens.llm.queries import QUERIES

DOCS = [(1, "ok\n\nNo\nok", "", "", 0), (2, "no\n\nyes\n \nOK ", "", "", 0), (3, "短い文です。\nx", "", "", 0), (4, "短い文です。", "", "", 0)]


def test_short_lines_go_without_a_floor(spark):
    out = {r.doc_id: r.removed_spans for r in line_dedup.dedup(frame(spark, DOCS), min_words=1).collect()}
    assert out == {1: "7:9", 2: "0:2,10:13", 3: "", 4: "0:6"}


def test_the_registered_query_has_no_floor(spark, tmp_path):
    """Lines of one word go too; blank ones stay. A floor is an argument."""
    wide = [" ".join(f"w{i}" for i in range(n)) for n in (15, 14)]
    docs = [*DOCS, (5, "\n".join(wide), "", "", 0), (6, "\n".join(wide), "", "", 0), (7, "この文は十五文字を超えて書かれている", "", "", 0), (8, "この文は十五文字を超えて書かれている", "", "", 0)]
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: (r.n_removed, r.n_shared) for r in QUERIES["op6_lines"](spark, str(tmp_path)).collect()}
    assert out == {1: (1, 2), 2: (2, 2), 3: (0, 1), 4: (1, 1), 5: (0, 2), 6: (2, 2), 7: (0, 1), 8: (1, 1)}
    fifteen = {r.doc_id: (r.n_removed, r.n_shared) for r in line_dedup.dedup(frame(spark, docs), min_words=15).collect()}
    assert fifteen == {1: (0, 0), 2: (0, 0), 3: (0, 0), 4: (0, 0), 5: (0, 1), 6: (1, 1), 7: (0, 1), 8: (1, 1)}
