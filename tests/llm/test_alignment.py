import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import hashlib
import random
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from fixtures import empty, frame, odd_rows, prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from postlens.llm import alignment
from postlens.llm import queries as registered

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
LIB_A, LIB_B = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
LIB_A.encode_special_tokens = True
TWO = alignment.TwoTokenizers(A, B)
ODD = ["", None, "x▁y", "a  b", " a", "  a", "a ", "a   ", "\ta\n\n b", "foo\n  bar", "it's <|endoftext|> </s><unk>", "<0x41> <s>", "日本語 テキスト", "é é", "a\0b", "　x   y", "🎉 🎉🎉", "x᠎ y", "\x1c z", "aaaa" * 30, "▁", " ", "\n"]


def plain(text):
    """Token ids of both sides and the ends of each, or nothing."""
    raw = (" " + text).encode() if text else b""
    a, b = (LIB_A.encode(" " + text, add_special_tokens=False).ids, LIB_B.encode(text)) if text else ([], [])
    one = lambda ids, names: b"".join(names[i] for i in ids)
    if not text or one(a, TWO.a_bytes) != raw or one(b, TWO.b_bytes) != raw:
        return [], [], [], []
    ends = lambda ids, names: np.cumsum([len(names[i]) for i in ids]).tolist()
    return a, b, ends(a, TWO.a_bytes), ends(b, TWO.b_bytes)


def expected(texts):
    """Contract columns without doc_id, pair by pair."""
    rows, count = [], Counter()
    for t in texts:
        a, b, ea, eb = plain(t)
        if len(a) < 500:
            links = [(x, y) for x, e in zip(a, ea) for y, f in zip(b, eb) if e == f]
        else:
            b_at = dict(zip(eb, b))
            links = [(x, b_at[e]) for x, e in zip(a, ea) if e in b_at]
        count.update(links)
        groups, i, j = [], 0, 0
        for e in sorted({*ea} & {*eb}):
            own_a, own_b = [], []
            while i < len(a) and ea[i] <= e:
                own_a.append(str(a[i]))
                i += 1
            while j < len(b) and eb[j] <= e:
                own_b.append(str(b[j]))
                j += 1
            groups.append(f"{','.join(own_a)}|{','.join(own_b)}")
        rows.append((len(a), len(b), groups, links))
    top = defaultdict(int)
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    return [(na, nb, len(g), len(k), sum(count[p] == top[p[1]] for p in k), sum(count[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if na else "") for na, nb, g, k in rows]


def test_token_bytes():
    """The byte tables by hand: every byte by itself, and the vocabulary's own decoder."""
    assert sorted(x for x in TWO.a_bytes if len(x) == 1) == [bytes([i]) for i in range(256)]
    assert {x for i, x in enumerate(TWO.b_bytes) if LIB_B.is_byte(i)} == {bytes([i]) for i in range(256)}
    assert all(TWO.a_bytes) and TWO.parted and max(len(TWO.a_bytes), len(TWO.b_bytes)) <= 1 << 16


def test_units_encode_as_whole_texts():
    rng = random.Random(1)
    letters = ["a", "b", "the", "é", "é", " ", "  ", "\n", "\t", "'s", "1", "日", "🎉", " ", "<s>", "\r", "\x1d", ".", "▁", "　"]
    texts = ODD + ["".join(rng.choice(letters[: rng.choice([6, 20])]) for _ in range(rng.randrange(40))) for _ in range(3000)]
    own = alignment.TwoTokenizers(A, B)
    for _ in range(2):
        for t, (a, b) in zip(texts, own.encode(texts)):
            want = plain(t)
            assert (a.tolist(), b.tolist()) == (want[0], want[1]), repr(t)


def same(x, y):
    return x.closed == y.closed and x.text == y.text and x.n_groups == y.n_groups and all(np.array_equal(p, q) for s, t in zip((x.prefix, x.links, x.suffix), (y.prefix, y.links, y.suffix)) for p, q in zip(s, t))


def test_fragments_compose_in_any_bracketing():
    rng = random.Random(2)
    for text in ["short one", prose(1, 60), "日本語のテキスト" * 6, "x" * 90]:
        a, b, ea, eb = (np.array(x, dtype=np.int64) for x in plain(text))
        whole = alignment.lift(a, b, ea, eb)
        for _ in range(10):
            cuts = sorted({0, int(ea[-1]), *(rng.randrange(int(ea[-1])) for _ in range(rng.randrange(1, 12)))})
            own = [alignment.lift(a[(ea > s) & (ea <= e)], b[(eb > s) & (eb <= e)], ea[(ea > s) & (ea <= e)], eb[(eb > s) & (eb <= e)]) for s, e in zip(cuts, cuts[1:])]
            assert same(reduce(alignment.compose, own), whole)
            while len(own) > 1:
                k = rng.randrange(len(own) - 1)
                own[k : k + 2] = [alignment.compose(own[k], own[k + 1])]
            assert same(own[0], whole)
        assert same(alignment.compose(alignment.Fragment(), whole), whole) and same(alignment.compose(whole, alignment.Fragment()), whole)


@pytest.mark.parametrize("chunk, fan, sent", [(alignment.CHUNK, alignment.FAN, None), (7, 2, 0), (64, 3, None)])
def test_align_equals_every_pair(spark, chunk, fan, sent):
    texts = ODD + [prose(k, 40) for k in range(30)] + [prose(1, 40)] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in alignment.align(df, A, B, chunk, fan, sent).collect()}
    assert [got[i] for i in range(len(texts))] == expected(texts)


def test_query_equals_contract(spark, tmp_path, monkeypatch):
    """Odd rows with a text of three chunks, through the registered query."""
    frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    out = registered.QUERIES["op11_alignment"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows = odd_rows()
    assert max(len(t or "") for _, t, *_ in rows) > 2 * alignment.CHUNK
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(str((r[0], *e)) for r, e in zip(rows, expected([r[1] for r in rows])))


def test_columns_and_empty(spark):
    df = frame(spark).withColumns({"row": F.lit("clash"), "keys": F.lit("clash"), "n_a": F.lit("clash")})
    assert alignment.align(df, A, B).count() == 13
    assert alignment.align(empty(spark), A, B).count() == 0
