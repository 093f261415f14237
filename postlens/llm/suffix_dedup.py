"""Exact substring deduplication by a depth-limited most-significant-digit radix sort of suffixes.

A byte of a document goes if it is covered by a 50-byte string that also starts in a document with
a smaller doc_id. Suffixes need order only through 50 bytes, and most are alone after their first
digit, so the passes go from the most significant digit down and each drops the groups that one
document has to itself:

0. *Which suffixes*: of every 50-byte window the 24-byte gram with the least hash (leftmost of equals)
   is its anchor. That depends on the window's bytes alone, so equal windows have equal anchors, and
   the suffixes at anchors, about one in fourteen, stand for all. Windows with the same anchor
   are a *run*; the bytes it spans are its *context*.
1. *First digit*, the 24 bytes at the anchor: grams of one document go.
2. *Second digit*, 13 bytes more to the left or to the right; every window has one of the two 37-byte
   strings in it. Windows whose string is in one document only go.
3. *The rest of the digits at once*: contexts are grouped whole, by gram and digest, 128 bits in
   all. A context that an earlier document holds too goes wholly; its earliest stands for it.
4. *Groups at full depth*: where a gram still has several contexts, the earliest documents' windows
   are told apart one by one. Those whose 50 bytes one document has to itself go; the others are
   grouped by gram and digest. Groups of several documents are exactly the repeated windows.

Between passes the surviving keys travel as a Bloom bitmap that grows with them (two to four bytes a key) up to
2**30 bits (128 MB): a sketch whose false positives cost only work, since it can keep a suffix but never
lose one and what is kept is compared by digest in a join. Which keys come again is found by 40 of their bits, in rows of
packed keys, about four bytes each. Every pass reads the texts anew, which is
cheaper than moving suffixes: nothing with a row per byte is ever written. Minima are pre-aggregated
in each task, so a passage that a third of all documents hold is one row per task.

Defined results: a null or empty text, or one under 50 bytes, keeps all; very long texts are read in
pieces that overlap, with the same result; rows that share a doc_id do not remove each other's
bytes; a row with a null doc_id neither loses bytes nor removes others'; an empty table gives an
empty table; columns beyond doc_id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.llm.common import PACKED, Bitmap, bitmaps, long_keys, mix64, packed, release, stage

LENGTH = 50
GRAM = 24
SIDE = (LENGTH - GRAM) // 2
PIECE = 1 << 18
LOW = np.uint64((1 << 28) - 1)
PICK = np.uint64(0xD1342543DE82EF95)
#: Odd base of the rolling hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
LETTER = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, kept in the worker."""
    if len(_POWERS.get("up", ())) < n:
        most = max(n, 2 * PIECE + LENGTH)
        _POWERS["up"], _POWERS["down"] = _powers(BASE, most), _powers(INVERSE, most)
    return _POWERS["up"][:n], _POWERS["down"][:n]


class Runs:
    """The runs of a buffer of pieces: first window, number of windows, anchor (all offsets in the buffer), piece."""

    def __init__(self, pieces: list[bytes]):
        self.data = b"".join(pieces)
        size = np.array([len(p) for p in pieces], dtype=np.int64)
        end = np.cumsum(size)
        self.begin = end - size
        raw = np.frombuffer(self.data, dtype=np.uint8)
        n = len(raw)
        power, self.inverse = powers(max(n, 1))
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(LETTER[raw] * power[:n], out=self.sums[1:])
        self.first = self.count = self.anchor = self.piece = np.zeros(0, dtype=np.int64)
        if n < LENGTH:
            return
        # the least rolling hash of the grams in every window; the offset in the low bits breaks ties to the left
        key = (self.sums[GRAM:] - self.sums[:-GRAM]) * self.inverse[: n - GRAM + 1]
        key *= PICK
        key &= ~LOW
        key |= np.arange(len(key), dtype=np.uint64)
        span, have = LENGTH - GRAM + 1, 1
        while have * 2 <= span:
            key = np.minimum(key[:-have], key[have:])
            have *= 2
        if span > have:
            key = np.minimum(key[: have - span], key[span - have :])
        # no window starts in the last bytes of a piece
        inside = np.ones(n, dtype=bool)
        inside[np.maximum(end[size > 0, None] - np.arange(1, LENGTH), self.begin[size > 0, None]).ravel()] = False
        inside = inside[: len(key)]
        edge = key[1:] != key[:-1]  # equal keys are one anchor, as an offset is in them
        edge |= inside[1:] != inside[:-1]
        new = np.concatenate([[0], np.flatnonzero(edge) + 1])
        whole = np.flatnonzero(inside[new])
        self.first = new[whole]
        self.anchor = (key[self.first] & LOW).astype(np.int64)
        self.count = np.diff(np.append(new, len(key)))[whole]
        self.piece = np.searchsorted(end, self.first, side="right")  # the first piece that ends beyond; empty ones never do

    def hash(self, at: np.ndarray, length: int) -> np.ndarray:
        """Well mixed hash of the length bytes from each offset."""
        return mix64((self.sums[at + length] - self.sums[at]) * self.inverse[at] + np.uint64(length))

    def only(self, keep: np.ndarray) -> None:
        self.first, self.count, self.anchor, self.piece = self.first[keep], self.count[keep], self.anchor[keep], self.piece[keep]

    def halves(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Whether each run has windows with the left (right) half, and the halves' hashes (0 where not)."""
        has_left = self.anchor - self.first >= SIDE
        has_right = self.anchor - (self.first + self.count - 1) <= SIDE
        left, right = np.zeros(len(self.first), dtype=np.uint64), np.zeros(len(self.first), dtype=np.uint64)
        left[has_left] = self.hash(self.anchor[has_left] - SIDE, GRAM + SIDE)
        right[has_right] = self.hash(self.anchor[has_right], GRAM + SIDE)
        return has_left, has_right, left, right

    def narrow(self, left: np.ndarray, right: np.ndarray) -> None:
        """Keep the windows that hold a surviving half: those that start SIDE or more before the anchor hold the left one, SIDE or less the right one."""
        last = self.first + self.count - 1
        first = np.where(left, self.first, np.maximum(self.first, self.anchor - SIDE))
        last = np.where(right, last, np.minimum(last, self.anchor - SIDE))
        self.first, self.count = first, last - first + 1
        self.only((left | right) & (self.count > 0))

    def digests(self, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """64-bit digests of stretches of the buffer; with the gram's hash beside them, 128 bits tell stretches apart."""
        data, h = self.data, hashlib.blake2b
        out = b"".join([h(data[a : a + n], digest_size=8).digest() for a, n in zip(first.tolist(), length.tolist())])
        return np.frombuffer(out, dtype=np.int64)


def texts_of(batch):
    """The texts of a batch as bytes, a few rows at a time, so that only those are Python objects."""
    for at in range(0, batch.num_rows, 128):
        yield from batch.column("text").slice(at, 128).cast(pa.binary()).to_pylist()


def buffers(batches, columns: list[str]):
    """(pieces, row of each piece, offset of each piece in its text, rows' columns): long texts in overlapping pieces."""
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in columns]
        pieces, row, offset, held = [], [], [], 0
        for r, text in enumerate(texts_of(batch)):
            for at in range(0, max(1, len(text or b"") - LENGTH + 1), PIECE):
                pieces.append((text or b"")[at : at + PIECE + LENGTH - 1])
                row.append(r)
                offset.append(at)
                held += len(pieces[-1])
                if held > PIECE:
                    yield pieces, np.array(row), np.array(offset), cols
                    pieces, row, offset, held = [], [], [], 0
        if pieces:
            yield pieces, np.array(row), np.array(offset), cols


def table(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType()) for n in names])


def batch_of(names: list[str], arrays: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64)) for a in arrays], names=names)


def shared_keys(keys: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a buffer, each with 1, or 2 if several rows have it."""
    if not len(keys):
        return keys, np.zeros(0, dtype=np.int64)
    order = np.argsort(keys)
    k, r = keys[order], row[order]
    start = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    return k[start], 1 + (np.minimum.reduceat(r, start) != np.maximum.reduceat(r, start)).astype(np.int64)


def repeated_keys(docs: DataFrame, keys_of, columns: tuple[str, ...] = ()):
    """Bitmap of the keys that several rows of docs have; keys_of gives the keys and pieces of a buffer's runs, from these and its rows' columns."""

    def run(batches):
        for pieces, row, _, values in buffers(batches, list(columns)):
            keys, piece = keys_of(Runs(pieces), *[np.array(x, dtype=np.int64)[row] for x in values])
            yield (0, *shared_keys(keys, row[piece]))

    return bitmaps(docs.mapInArrow(lambda batches: packed(run(batches)), PACKED), [2])[0]


def survivors(runs: Runs, grams: Bitmap, halves: Bitmap) -> None:
    runs.only(grams.has(runs.hash(runs.anchor, GRAM)))
    has_left, has_right, left, right = runs.halves()
    runs.narrow(has_left & halves.has(left), has_right & halves.has(right))


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of stretches as its maximal stretches."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, kept (binary, the bytes that stay), n_bytes, n_removed, removed (array of start, end in bytes)."""
    keyed = docs.select("doc_id", F.xxhash64("doc_id").alias("doc_hash"), F.xxhash64("text").alias("text_hash"), "text")
    used = keyed.where("doc_id is not null")

    texts = used.select("text")
    grams = repeated_keys(texts, lambda r: (r.hash(r.anchor, GRAM), r.piece))

    def half_keys(r: Runs):
        r.only(grams.value.has(r.hash(r.anchor, GRAM)))
        has_left, has_right, left, right = r.halves()
        return np.concatenate([left[has_left], right[has_right]]), np.concatenate([r.piece[has_left], r.piece[has_right]])

    halves = repeated_keys(texts, half_keys)

    def contexts(batches):
        for pieces, row, _, (ids,) in buffers(batches, ["doc_id"]):
            r = Runs(pieces)
            survivors(r, grams.value, halves.value)
            yield batch_of(["gram", "d", "doc_id"], [r.hash(r.anchor, GRAM), r.digests(r.first, r.count + LENGTH - 1), np.array(ids, dtype=np.int64)[row[r.piece]]])

    held = used.select("doc_id", "text").mapInArrow(contexts, table(["gram", "d", "doc_id"]))
    first = held.groupBy("gram", "d").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))

    def sketched(batches):
        for batch in batches:
            gram, d, own, shared = (long_keys(batch.column(c)) for c in ("gram", "d", "own", "shared"))
            one = np.ones(len(gram), dtype=np.int8)
            yield 0, d ^ own, one  # contexts with their earliest document
            yield 1, gram, one  # grams of several contexts
            yield 2, (d ^ gram)[shared == 1], one[shared == 1]  # contexts of several documents

    rows = first.select("gram", "d", F.xxhash64("first").alias("own"), F.expr("cast(first < last as long)").alias("shared"))
    earliest, varied, several = bitmaps(rows.mapInArrow(lambda batches: packed(sketched(batches)), PACKED), [1, 2, 1])

    def settled(r: Runs, doc_hash: np.ndarray, varied_only: bool = False):
        """Digests of the runs (of those alone that may need windows), which of them an earlier document surely holds, and which need windows."""
        survivors(r, grams.value, halves.value)
        if varied_only:
            r.only(varied.value.has(r.hash(r.anchor, GRAM)))
        d = r.digests(r.first, r.count + LENGTH - 1)
        gone = ~earliest.value.has(d.view(np.uint64) ^ doc_hash[r.piece])
        return d, gone, varied.value.has(r.hash(r.anchor, GRAM))

    def windows_of(r: Runs, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start of every window of some runs, and its run."""
        count = r.count[which]
        start = np.repeat(r.first[which], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return start, np.repeat(which, count)

    def open_windows(r: Runs, hashes: np.ndarray):
        _, gone, windows = settled(r, hashes.view(np.uint64), varied_only=True)
        start, run = windows_of(r, np.flatnonzero(~gone & windows))
        return r.hash(start, LENGTH), r.piece[run]

    repeats = repeated_keys(used.select("doc_hash", "text"), open_windows, ("doc_hash",))
    del held, first, rows

    names = ["gram", "d", "doc_id", "text_hash", "place"]  # place: start * 64 + number of windows

    def open_units(batches):
        for pieces, row, offset, (ids, hashes, texts) in buffers(batches, ["doc_id", "doc_hash", "text_hash"]):
            r = Runs(pieces)
            d, gone, windows = settled(r, np.array(hashes, dtype=np.int64).view(np.uint64)[row])
            gram = r.hash(r.anchor, GRAM)
            whole = np.flatnonzero(~gone & ~windows & several.value.has(d.view(np.uint64) ^ gram))
            one, run = windows_of(r, np.flatnonzero(~gone & windows))
            some = repeats.value.has(r.hash(one, LENGTH))
            one, run = one[some], run[some]
            run = np.concatenate([whole, run])
            digest = np.concatenate([d[whole], r.digests(one, np.full(len(one), LENGTH))])
            piece = r.piece[run]
            start = np.concatenate([r.first[whole], one]) - r.begin[piece] + offset[piece]
            own = row[piece]
            n = np.concatenate([r.count[whole], np.ones(len(one), dtype=np.int64)])
            yield batch_of(names, [gram[run], digest, np.array(ids, dtype=np.int64)[own], np.array(texts, dtype=np.int64)[own], start * 64 + n])

    units = stage(used.mapInArrow(open_units, table(names)), "suffix-units")
    least = stage(units.groupBy("gram", "d").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last"), "suffix-least")
    for done in (several, repeats):  # what is staged does not ask for them again
        done.unpersist()
    release(docs.sparkSession)
    later = units.join(least, ["gram", "d"]).where("first < doc_id").groupBy("doc_id", "text_hash").agg(F.collect_set("place").alias("later"))

    def apply(batches):
        for batch in batches:
            rows, starts, ends = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            ids = batch.column("doc_id").to_pylist()
            for pieces, row, offset, (hashes,) in buffers([batch], ["doc_hash"]):
                runs = Runs(pieces)
                _, gone, _ = settled(runs, np.array(hashes, dtype=np.int64).view(np.uint64)[row])
                at = (runs.first - runs.begin[runs.piece] + offset[runs.piece])[gone]
                rows.append(row[runs.piece[gone]])
                starts.append(at)
                ends.append(at + runs.count[gone] + LENGTH - 1)
            row, start, end = np.concatenate(rows), np.concatenate(starts), np.concatenate(ends)
            part = np.searchsorted(row, np.arange(batch.num_rows + 1))
            kept, size, removed = [], [], []
            later_of = batch.column("later").to_pylist()
            for r, text in enumerate(texts_of(batch)):
                text = text or b""
                size.append(len(text))
                x, y = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
                if ids[r] is not None:
                    own = np.array(later_of[r] or (), dtype=np.int64)
                    x = np.concatenate([start[part[r] : part[r + 1]], own // 64])
                    y = np.concatenate([end[part[r] : part[r + 1]], own // 64 + own % 64 + LENGTH - 1])
                a, b = merged(x, y)
                edges = [0, *np.column_stack([a, b]).ravel().tolist(), len(text)]
                kept.append(b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2])))
                removed.append([{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist())])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary()), pa.array(size, pa.int64()), pa.array(removed, kind)], names=["doc_id", "kept", "n_bytes", "removed"])

    out = keyed.join(later, ["doc_id", "text_hash"], "left").mapInArrow(apply, "doc_id long, kept binary, n_bytes long, removed array<struct<start: long, end: long>>")
    return out.withColumn("n_removed", F.col("n_bytes") - F.octet_length("kept").cast("long"))


def digest(docs: DataFrame) -> DataFrame:
    out = remove_repeats(docs)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    """The definition itself, for tests: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    first: dict[bytes, int] = {}
    for i, t in texts:
        for p in range(len(t) - LENGTH + 1) if i is not None else ():
            w = t[p : p + LENGTH]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for p in range(len(t) - LENGTH + 1) if i is not None else ():
            if first[t[p : p + LENGTH]] < i:
                gone[p : p + LENGTH] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out
