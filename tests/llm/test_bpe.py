import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from fixtures import empty, frame
from pyspark.sql import functions as F

from postlens.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_equals_library(spark):
    got = bpe.digest(frame(spark), PATH, P.PATTERN).collect()
    assert len(got) == 13
    texts = {}
    for r in frame(spark).collect():
        texts.setdefault(r.doc_id, []).append(r.text or "")
    for r in got:
        ok = False
        for t in texts[r.doc_id]:
            ids = LIBRARY.encode_ordinary(t)
            raw = b"".join(i.to_bytes(4, "little") for i in ids)
            ok |= (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
        assert ok


@pytest.mark.parametrize("width", [8, bpe.SIDE_BY_SIDE])
def test_pieces(width, monkeypatch):
    """Both forms of the segment tree, on random pieces and on long runs."""
    monkeypatch.setattr(bpe, "SIDE_BY_SIDE", width)
    m, rng = bpe.Merger(bpe.read_ranks(PATH)), random.Random(1)
    pieces = ["".join(rng.choice("abetion sh") for _ in range(rng.randint(1, 60))) for _ in range(400)] + ["a" * 5000, " " * 700, "ab" * 900]
    for p, raw in zip(pieces, m.encode_pieces([p.encode() for p in pieces])):
        ids = [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)]
        assert LIBRARY.decode(ids) == p
        assert ids == LIBRARY._core_bpe.encode_single_piece(p.encode())


def test_columns_and_empty(spark):
    df = frame(spark).withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit("clash"))
    out = bpe.encode(df, PATH, P.PATTERN)
    assert out.columns[-2:] == ["ids", "n_tokens"] and out.columns.count("ids") == 1 and out.count() == 13
    assert bpe.digest(empty(spark), PATH, P.PATTERN).count() == 0
