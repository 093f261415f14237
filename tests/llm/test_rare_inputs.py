"""Inputs that once ended the job."""

from postlens.llm import hamming, pii


def test_address_of_many_zeros():
    text = "0" * 5000 + ".1.2.3 and " + "0" * 5000 + "255.0.0.000"
    assert [(a, k) for a, k, _ in pii.base_spans(text) if k == 1] == [(0, 1), (5011, 1)]


def test_segments_stay_narrow():
    parts = hamming.segments()
    assert sum(w for _, w in parts) == hamming.BITS and max(w for _, w in parts) <= 22
    assert [a for a, _ in parts] == [sum(w for _, w in parts[:k]) for k in range(len(parts))]
