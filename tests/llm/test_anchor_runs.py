"""Anchors and runs of a buffer of pieces, held against their definition window by window."""

import numpy as np

from postlens.llm import suffix_dedup as s


def plain(pieces):
    """(piece, first window, windows, anchor) of every run, in offsets of the buffer."""
    r, out, begin = s.Runs(pieces), [], 0
    for k, p in enumerate(pieces):
        last = None
        for w in range(begin, begin + len(p) - s.LENGTH + 1):
            grams = np.arange(w, w + s.LENGTH - s.GRAM + 1)
            key = (r.sums[grams + s.GRAM] - r.sums[grams]) * r.inverse[grams] * s.PICK & ~s.LOW
            anchor = int(grams[np.argmin(key)])
            if anchor == last:
                out[-1][2] += 1
            else:
                out.append([k, w, 1, anchor])
            last = anchor
        begin += len(p)
    return out


def test_runs_are_those_of_the_definition():
    rng = np.random.default_rng(2)
    text = lambda n: bytes(rng.integers(97, 99, n, dtype=np.uint8))
    for pieces in ([b""], [b"a" * 49, b"b" * 49], [b"a" * 50], [b"", b"a" * 120, b"", b"ab" * 60], *[[text(n) for n in rng.integers(0, 130, 6)] for _ in range(40)]):
        r = s.Runs(pieces)
        assert [list(x) for x in zip(r.piece.tolist(), r.first.tolist(), r.count.tolist(), r.anchor.tolist())] == plain(pieces)


def test_shared_keys_count_rows_in_any_order():
    keys, n = s.shared_keys(np.array([5, 3, 5, 9, 3, 9], dtype=np.uint64), np.array([2, 1, 0, 4, 1, 4]))
    assert keys.tolist() == [3, 5, 9] and n.tolist() == [1, 2, 1]
    assert len(s.shared_keys(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))[0]) == 0
