import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import os
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from fixtures import empty, frame, odd_rows, prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from postlens.llm import queries as registered
from postlens.llm import token_files
from postlens.workspace import fresh

PATH = P.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def plain(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


def expected(rows):
    """Contract rows of (doc_id, text), read as a plain stream; rows of one id may follow each other in either order."""
    out, at = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = plain(text)
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return out


ODD = ["", None, "a  b\n\nc", "x y　z", "é ́a", "<|endoftext|> and<|startoftext|>", "It's WE'RE 12345 ab12", "日本語 テキスト", "\x1c\x85  q", "🎉🎉 ok", "İstanbul ΣΑΣ ß", "\ta\r\nb", " lead", "trail ", "a" * 500, "᠎ x", "\0 a\0b"]


def test_words_alone_encode_as_whole_texts():
    """Word by word, as the library encodes the whole text: odd white space, marks, specials, and random mixtures."""
    rng = random.Random(1)
    letters = ["a", "b", "E", "é", "é", "́", " ", "  ", "\n", "\t", "'s", "'", "1", "日", "🎉", " ", "‍", "<|endoftext|>", "\r", "\x1d", ".", "S"]
    texts = ODD + [prose(k, 300).title() + ". " + prose(k, 50).upper() + "! end-of;line?!" for k in range(5)] + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)]
    e = token_files.WordEncoder(PATH)
    for _ in range(2):  # the second time from the cache
        for t, raw in zip(texts, e.encode(texts)):
            assert np.frombuffer(raw, e.dtype).tolist() == plain(t)[:-1], repr(t)


def test_query_equals_library(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FEWEST", 500)  # several files
    rng = random.Random(2)
    docs = [(i * 7 - 50, t) for i, t in enumerate(ODD + ["".join(rng.choice("ab cde 'st.") for _ in range(rng.randrange(300))) for _ in range(200)])]
    rng.shuffle(docs)
    docs += [(None, "no id"), (99999, "word " * 30000)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    out = registered.QUERIES["op12_token_files"](spark, str(tmp_path))
    assert out.columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, out.collect()), key=lambda r: r[1]) == expected(docs)


@pytest.mark.parametrize("fewest", [1, 1 << 20])
def test_files(spark, monkeypatch, fewest):
    """The files hold ids and nothing else; documents are found by place; repeated rows and repeated ids follow each other."""
    monkeypatch.setattr(token_files, "FEWEST", fewest)
    df = frame(spark).withColumns({"ids": F.lit("clash"), "n": F.lit("clash"), "tie": F.lit("clash"), "start": F.lit(0)})
    folder = token_files.write(df, fresh(spark, "token-test"), PATH)
    held = token_files.TokenFiles(folder)
    texts = {}
    for i, t, *_ in odd_rows():
        texts.setdefault(i, []).append(t)
    assert len(held) == 13 and [held.doc_id(k) for k in range(13)] == [None, 1, 2, 3, 4, 4, 5, 5, 6, 7, 8, 9, 10]
    for k in range(13):
        assert held[k].tolist() in [plain(t) for t in texts[held.doc_id(k)]]
    assert sorted(held[6].tolist() + held[7].tolist()) == sorted(sum((plain(t) for t in texts[5]), []))
    with pytest.raises(IndexError):
        held[13]
    plain_folder = folder.removeprefix("file://")
    size = sum(os.path.getsize(f"{plain_folder}/ids/{f}") for f in os.listdir(f"{plain_folder}/ids") if f.startswith("part-"))
    assert size == 2 * sum(len(plain(t)) for t in sum(texts.values(), []))


def test_empty(spark):
    assert token_files.digest(empty(spark), PATH).count() == 0


def test_file_count():
    assert [token_files.file_count(n, 4) for n in (0, 1, 1 << 20, 3 << 20, 1 << 29, 1 << 30)] == [1, 1, 1, 3, 8, 16]


def test_separator_is_plain():
    with pytest.raises(ValueError):
        token_files._flat(type("D", (), {"columns": ["ids"]})(), "x", b"\xff\x00")
