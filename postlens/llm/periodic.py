"""Periodic runs of words: block convolution over dyadic scales.

A run is a stretch of consecutive words of smallest period q and length >= max(``least``, ``times`` * q) that no
neighbouring word extends. At scale m = 8, 16, 32, ... the words are cut into blocks of m. A run of period m <= q < 2m
holds a whole block together with its copy q words further on (at m = 8 that is so for every q < 16, as runs have 24
words at least), so for each block the sums of squared differences to the words that follow, at every distance of the
scale, say where it comes again: a sum of zero is a copy. All sums of a block are one cyclic convolution, computed by a
number-theoretic transform modulo a prime, in whole numbers. A sum that is zero only modulo the prime is found out
when the block is compared. Each zero's distance seeds an extension to both sides; from small periods to large ones, so a
stretch that a run of a divisor of its distance holds has that smaller period and is no run of its own.

Blocks are transformed only if every word comes again within the scale's distances, without which no sum can be zero;
and not if all that follows them lies in a known run of period <= m, whose multiples are all that they could find.

Defined results: a null or empty text has no words, no runs and collapses to the empty text; words are cut at space
and at the five control characters of ASCII white space only, so bytes of any encoding go through; very long texts are
searched whole, in one task; repeated rows are judged one by one; an empty table gives an empty table; other columns
are passed on, and ones named like the outputs (``n_words``, ``runs``, ``collapsed``) are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.llm.common import tidied

#: A prime 15 * 2**27 + 1 and a generator of its residues; products of two residues fit 64 bits.
PRIME, GENERATOR, TWOS = 2013265921, 31, 27
_P = np.uint64(PRIME)
_ROOTS: dict[tuple[int, bool], np.ndarray] = {}
SMALLEST = 8
#: Residues that are transformed at once.
AT_ONCE = 1 << 18
#: Bytes of text in a slice of a batch; a longer text is a slice by itself.
SLICE = 1 << 20


def _roots(half: int, back: bool) -> np.ndarray:
    """Powers 0 .. half-1 of a root of unity of order 2 * half."""
    if (half, back) not in _ROOTS:
        w = pow(GENERATOR, (PRIME - 1) // (2 * half), PRIME)
        w = pow(w, PRIME - 2, PRIME) if back else w
        out = np.ones(1, dtype=np.uint64)
        while len(out) < half:
            out = np.concatenate([out, out * np.uint64(pow(w, len(out), PRIME)) % _P])
        _ROOTS[half, back] = out
    return _ROOTS[half, back]


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    s = a + b
    return np.minimum(s, s - _P)  # below the prime the difference wraps round to a huge number


def transform(x: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of every row; the results are in bit-reversed order."""
    rows, n = x.shape
    half = n // 2
    while half:
        y = x.reshape(rows, -1, 2, half)
        u, v = y[:, :, 0, :].copy(), y[:, :, 1, :]
        d = _add(u, _P - v)
        y[:, :, 0, :] = _add(u, v)
        y[:, :, 1, :] = d * _roots(half, False) % _P
        half //= 2
    return x


def untransform(x: np.ndarray) -> np.ndarray:
    """Rows from their transforms in bit-reversed order."""
    rows, n = x.shape
    half = 1
    while half < n:
        y = x.reshape(rows, -1, 2, half)
        u, v = y[:, :, 0, :].copy(), y[:, :, 1, :] * _roots(half, True) % _P
        y[:, :, 0, :] = _add(u, v)
        y[:, :, 1, :] = _add(u, _P - v)
        half *= 2
    return x * np.uint64(pow(n, PRIME - 2, PRIME)) % _P


def zero_sums(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Whether the squared differences of each block to its window add up to zero modulo the prime, at each shift.

    blocks: rows of m values; windows: rows of m + shifts - 1 values.
    """
    rows, m = blocks.shape
    shifts = windows.shape[1] - m + 1
    n = 1 << (windows.shape[1] - 1).bit_length()
    if n > 1 << TWOS:
        raise ValueError(f"a block of {m} words is beyond the transform")
    a, b = np.zeros((rows, n), dtype=np.uint64), np.zeros((rows, n), dtype=np.uint64)
    a[:, :m] = blocks[:, ::-1]
    b[:, : windows.shape[1]] = windows
    cross = untransform(transform(a) * transform(b) % _P)[:, m - 1 : m - 1 + shifts]
    squares = np.concatenate([np.zeros((rows, 1), dtype=np.uint64), np.cumsum(windows * windows % _P, axis=1)], axis=1)
    sums = (squares[:, m:] - squares[:, :-m]) % _P + (blocks * blocks % _P).sum(axis=1, keepdims=True) % _P
    return (sums + np.uint64(2) * (_P - cross)) % _P == 0


def _next_distance(codes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How far on each word comes again in its document; a huge number where it doesn't."""
    out = np.full(len(codes), np.iinfo(np.int64).max, dtype=np.int64)
    key = doc * (int(codes.max()) + 1) + codes
    order = np.argsort(key, kind="stable")
    again = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    out[order[again]] = order[again + 1] - order[again]
    return out


def _same_after(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix of two arrays, looked through in growing pieces."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        wrong = np.flatnonzero(a[at : at + step][: n - at] != b[at : at + step][: n - at])
        if len(wrong):
            return at + int(wrong[0])
        at, step = at + step, step * 2
    return n


class _Found:
    """The runs of one document so far, as (start, length, period)."""

    def __init__(self):
        self.runs: list[tuple[int, int, int]] = []

    def divides(self, d: int, low: int, high: int) -> bool:
        """Whether a run whose period divides d holds [low, high)."""
        return any(d % q == 0 and s <= low and high <= s + n for s, n, q in self.runs)


def _extend(codes: np.ndarray, first: int, end: int, m: int, d: int, starts: np.ndarray, found: _Found, least: int, times: int) -> None:
    """Extends the blocks at ``starts``, which come again d words on, inside the document [first, end)."""
    for s, n, q in found.runs:
        if d % q == 0:
            starts = starts[(starts < s) | (starts + (m + d) > s + n)]
    at = 0
    while at < len(starts):
        s = int(starts[at])
        if s + d + m > end or not np.array_equal(codes[s : s + m], codes[s + d : s + d + m]):
            at += 1
            continue
        high = s + d + m + _same_after(codes[s + d + m : end], codes[s + m : end - d])
        low = s - _same_after(codes[first:s][::-1], codes[first + d : s + d][::-1])
        if high - low >= max(least, times * d) and not found.divides(d, low, high):
            found.runs.append((low, high - low, d))
        at = int(np.searchsorted(starts, high - m - d, side="right"))


def runs_of(codes: np.ndarray, ends: np.ndarray, least: int = 24, times: int = 3) -> dict[int, list[tuple[int, int, int]]]:
    """(start, length, period) of all runs, sorted, by document; codes are those of documents one after the other, which end at ``ends``."""
    if least < 3 * SMALLEST - 2 or times < 3:
        raise ValueError("blocks are sure to be found only in runs of 22 words and three periods at least")
    sizes = np.diff(ends, prepend=0)
    found: dict[int, _Found] = {}
    if not len(codes) or sizes.max() < least:
        return {}
    doc = np.repeat(np.arange(len(ends)), sizes)
    reach = _next_distance(codes, doc)
    total, longest, m = len(codes), int(sizes.max()), SMALLEST
    nothing = int(codes.max()) + 1
    reach = reach[: total // m * m].reshape(-1, m).max(axis=1)  # of each block
    while len(reach) and (m == SMALLEST or m * times <= longest):
        low, high = (1, 2 * m) if m == SMALLEST else (m, 2 * m)
        own = np.flatnonzero(reach < high) * m
        own = own[doc[own] == doc[own + m - 1]]
        keep = np.ones(len(own), dtype=bool)
        for k, f in found.items():
            base = int(ends[k] - sizes[k])
            for s, n, q in f.runs:
                if q <= m:
                    keep[np.searchsorted(own, base + s) : np.searchsorted(own, base + s + n - 3 * m, side="right")] = False
        own = own[keep]
        width = m + high - low - 1
        step = max(1, AT_ONCE // (2 * width))
        hits_at, hits_d = [], []
        for k in range(0, len(own), step):
            some = own[k : k + step]
            at = some[:, None] + low + np.arange(width)
            windows = np.where(at < total, codes[np.minimum(at, total - 1)], nothing).astype(np.uint64)
            row, shift = np.nonzero(zero_sums(codes[some[:, None] + np.arange(m)].astype(np.uint64), windows))
            hits_at.append(some[row])
            hits_d.append(shift + low)
        if hits_at:
            at, d = np.concatenate(hits_at), np.concatenate(hits_d)
            order = np.lexsort((at, d, doc[at]))
            at, d = at[order], d[order]
            cuts = np.flatnonzero((np.diff(doc[at], prepend=-1) != 0) | (np.diff(d, prepend=-1) != 0)) if len(at) else []
            for a, b in zip(cuts, [*cuts[1:], len(at)]):
                k = int(doc[at[a]])
                base = int(ends[k] - sizes[k])
                _extend(codes[base : int(ends[k])], 0, int(sizes[k]), m, int(d[a]), at[a:b] - base, found.setdefault(k, _Found()), least, times)
        m *= 2
        reach = reach[: len(reach) // 2 * 2].reshape(-1, 2).max(axis=1)
    return {k: sorted((s, n, q) for s, n, q in f.runs) for k, f in found.items() if f.runs}


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run repeats, joined by one space."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), dtype=bool)
    for s, n, q in runs:
        keep[s + q : s + n] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep)])


def find_runs(df: DataFrame, text_col: str = "text", least: int = 24, times: int = 3, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None, id_col: str = "doc_id") -> DataFrame:
    """Adds n_words, runs (array of start, length and period, sorted; words count from 0) and collapsed (the text without repeats, as bytes).

    rewrite: a function of id and words that gives the words to look at instead.
    """
    kept = [f for f in df.schema.fields if f.name not in ("n_words", "runs", "collapsed")]
    run_type = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
    schema = T.StructType([*kept, T.StructField("n_words", T.LongType()), T.StructField("runs", run_type), T.StructField("collapsed", T.BinaryType())])
    names = [f.name for f in kept]
    arrow_run = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def whole(batch: pa.RecordBatch):
        words = [(t or b"").split() for t in batch.column("_bytes").to_pylist()]
        if rewrite is not None:
            words = [rewrite(i, w) for i, w in zip(batch.column(id_col).to_pylist(), words)]
        flat = pa.array([w for ws in words for w in ws], pa.large_binary())
        codes = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
        by = runs_of(codes, np.cumsum([len(w) for w in words]), least, times)
        runs = [by.get(k, []) for k in range(len(words))]
        rows = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
        texts = [collapse(w, r) for w, r in zip(words, runs)]
        return pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array([len(w) for w in words], pa.int64()), pa.array(rows, arrow_run), pa.array(texts, pa.binary())], names=[*names, "n_words", "runs", "collapsed"])

    def run(batches):
        for batch in batches:
            size = max(batch.column("_bytes").nbytes, 1)
            rows = max(1, int(batch.num_rows * SLICE / size))
            for at in range(0, batch.num_rows, rows):
                yield whole(batch.slice(at, rows))

    return df.withColumn("_bytes", F.col(text_col).cast("binary")).mapInArrow(tidied(run), schema)


def greatest(runs: Column) -> Column:
    """The run of greatest exact length / period; of equal ones the first, then that of the smallest period. Null if there is none."""

    def compare(a, b):
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        return (
            F.when(x > y, -1).when(x < y, 1)
            .when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1)
            .when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0)
        )

    return F.get(F.array_sort(runs, compare), 0)


def digest(df: DataFrame, **options) -> DataFrame:
    """Per document: number of runs, the greatest one, and digests of all runs and of the collapsed text."""
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(F.lit(""))
    found = find_runs(df.select("doc_id", "text"), **options).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), greatest(F.col("runs")).alias("best"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
