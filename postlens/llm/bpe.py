"""Byte-level BPE encoding and decoding with a segment tree per pre-token.

Every pre-token (a match of the split pattern) is a row of byte positions. The leaves of a
segment tree hold ``rank * width + position`` of the pair that starts at each live position;
inner nodes hold the minimum, so the root is the leftmost pair of least rank. A merge kills the
right neighbour, relinks the live neighbours and changes three leaves, each a logarithmic walk
to the root. Pre-tokens of one width class are merged side by side in numpy; a very long one has
a tree of its own in plain Python. Both give the same ids.

Defined results: a null or empty text has no tokens (empty binary, decoded to empty bytes); very
long texts and very long pre-tokens are encoded whole; repeated rows are encoded again, each row
by itself; an empty table gives an empty table; other columns are passed on unchanged and may
not be named like the output columns (``ids``, ``n_tokens``), which then are replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.llm.common import tidied

NONE = np.int64(1) << np.int64(62)
#: Up to this width pre-tokens are merged side by side; longer ones have a tree of their own.
SIDE_BY_SIDE = 256
CACHED = 100_000
_MERGERS: dict[str, "Merger"] = {}


def merger(path: str) -> "Merger":
    """One merge table and cache per Python worker, as workers serve many tasks."""
    if path not in _MERGERS:
        _MERGERS[path] = Merger(read_ranks(path))
    return _MERGERS[path]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Merger:
    """The merge table of one vocabulary, and encoding of batches of pre-tokens by it."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        keys, vals = [], []
        for t, i in ranks.items():
            for cut in range(1, len(t)):
                a, b = ranks.get(t[:cut]), ranks.get(t[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    vals.append(i)
        self._index(np.array(keys, dtype=np.int64), np.array(vals, dtype=np.int64))
        b = np.arange(256)
        self.byte_pair = self._rank(np.repeat(self.byte[b], 256), np.tile(self.byte[b], 256)).reshape(256, 256)
        self.pairs: dict[int, int] | None = None
        self.cache: dict[str, bytes] = {}

    def _index(self, keys: np.ndarray, vals: np.ndarray) -> None:
        """An open-addressing table of the pairs, at most a quarter full."""
        self.bits = np.int64(max(4, int(4 * len(keys)).bit_length()))
        self.keys, self.vals = np.full(1 << int(self.bits), -1, dtype=np.int64), np.full(1 << int(self.bits), -1, dtype=np.int64)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            self.keys[slot[free]] = keys[free]
            self.vals[slot[free]] = vals[free]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & ((1 << int(self.bits)) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - int(self.bits))).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, which is the id of the token it merges to; -1 for none."""
        key = a << np.int64(32) | b
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.vals[slot], np.int64(-1))
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << int(self.bits)) - 1)
            found = self.keys[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.vals[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = [None] * len(pieces)
        classes: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(p) > SIDE_BY_SIDE:
                out[i] = np.array(self._long(p), dtype="<u4").tobytes()
            else:
                classes.setdefault(1 << (len(p) - 1).bit_length(), []).append(i)
        for width, members in classes.items():
            step = max(1, (1 << 18) // width)
            for at in range(0, len(members), step):
                part = members[at : at + step]
                for i, ids in zip(part, self._side_by_side([pieces[i] for i in part], width)):
                    out[i] = ids
        return out

    def _side_by_side(self, words: list[bytes], width: int) -> list[bytes]:
        n = len(words)
        size = np.array([len(w) for w in words], dtype=np.int64)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(n, width)
        tok = np.full((n, width + 1), -1, dtype=np.int64)
        tok[:, :width] = np.where(np.arange(width) < size[:, None], self.byte[raw], -1)
        nxt = np.broadcast_to(np.minimum(np.arange(1, width + 2), width), (n, width + 1)).copy()
        prv = np.broadcast_to(np.arange(-1, width), (n, width + 1)).copy()
        pos = np.arange(width)
        rank = np.full((n, width), -1, dtype=np.int64)
        rank[:, : width - 1] = np.where(pos[1:] < size[:, None], self.byte_pair[raw[:, :-1], raw[:, 1:]], -1)
        tree = np.full((n, 2 * width), NONE, dtype=np.int64)
        tree[:, width:] = np.where(rank >= 0, rank * width + pos, NONE)
        k = width
        while k > 1:
            k //= 2
            tree[:, k : 2 * k] = np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2])
        w = np.flatnonzero(tree[:, 1] < NONE) if width > 1 else np.zeros(0, dtype=np.int64)
        while len(w):
            best = tree[w, 1]
            at = best % width
            tok[w, at] = best // width
            right = nxt[w, at]
            after = nxt[w, right]
            tok[w, right] = -1
            nxt[w, at] = after
            prv[w, after] = at  # the sentinel column takes what has no successor
            before = prv[w, at]
            self._put(tree, w, right, np.full(len(w), NONE), width)
            follower = np.where(after < width, tok[w, after], -1)
            self._put(tree, w, at, self._leaf(tok[w, at], follower, at, width), width)
            has = before >= 0
            if has.any():
                wb, b, a = w[has], before[has], at[has]
                self._put(tree, wb, b, self._leaf(tok[wb, b], tok[wb, a], b, width), width)
            w = w[tree[w, 1] < NONE]
        live = tok[:, :width] >= 0
        flat = tok[:, :width][live].astype("<u4").tobytes()
        ends = np.cumsum(live.sum(axis=1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _leaf(self, a, b, at, width):
        rank = np.where(b >= 0, self._rank(a, b.clip(0)), -1)
        return np.where(rank >= 0, rank * width + at, NONE)

    @staticmethod
    def _put(tree, w, at, value, width):
        node = at + width
        tree[w, node] = value
        while width > 1:
            width >>= 1
            node >>= 1
            tree[w, node] = np.minimum(tree[w, 2 * node], tree[w, 2 * node + 1])

    def _long(self, piece: bytes) -> list[int]:
        if self.pairs is None:
            self.pairs = {k: v for k, v in zip(self.keys.tolist(), self.vals.tolist()) if k >= 0}
        pairs, n = self.pairs, len(piece)
        width = 1 << (n - 1).bit_length()
        none = int(NONE)
        tok = [int(self.byte[b]) for b in piece]
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))

        def leaf(i: int) -> int:
            j = nxt[i]
            r = pairs.get(tok[i] << 32 | tok[j], -1) if j < n else -1
            return r * width + i if r >= 0 else none

        tree = [none] * (2 * width)
        tree[width : width + n] = [leaf(i) for i in range(n)]
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, value: int) -> None:
            k = i + width
            tree[k] = value
            while k > 1:
                k >>= 1
                low = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == low:
                    break
                tree[k] = low

        while tree[1] < none:
            i = tree[1] % width
            tok[i] = tree[1] // width
            j = nxt[i]
            tok[j] = -1
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            put(j, none)
            put(i, leaf(i))
            if prv[i] >= 0:
                put(prv[i], leaf(prv[i]))
        return [t for t in tok if t >= 0]

    def encode(self, pieces_of: list[list[str]]) -> list[bytes]:
        """Ids of each text, given as its pre-tokens. Pre-tokens seen lately are kept in a bounded cache."""
        if len(self.cache) > CACHED:
            self.cache = {}
        cache = self.cache
        new = [p for p in set().union(*pieces_of) if p not in cache]
        cache.update(zip(new, self.encode_pieces([p.encode("utf-8", "surrogatepass") for p in new])))
        return [b"".join(map(cache.__getitem__, pieces)) for pieces in pieces_of]


def _slices(batches: Iterator[pa.RecordBatch], col: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a column's bytes stay near the bound; a single row may be larger."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * most / max(batch.column(col).nbytes, 1)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Adds ``ids`` (binary: little-endian unsigned 32-bit ids) and ``n_tokens`` to every row.

    The rank file is small and fixed; each task reads it once from ranks_path, as every machine
    has the tokenizer package. No special tokens.
    """
    kept = [f for f in df.schema.fields if f.name not in ("ids", "n_tokens")]
    schema = T.StructType([*kept, T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())])
    names = [f.name for f in kept]

    def run(batches):
        import regex

        table, find = merger(ranks_path), regex.compile(pattern).findall
        for batch in _slices(batches, text_col):
            texts = batch.column(text_col).to_pylist()
            ids = table.encode([find(t) if t else [] for t in texts])
            cols = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], names=[*names, "ids", "n_tokens"])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the bytes that the ids stand for; null ids give empty bytes."""
    kept = [f for f in df.schema.fields if f.name != out_col]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField(out_col, T.BinaryType())])

    def run(batches):
        token = merger(ranks_path).token
        for batch in _slices(batches, ids_col):
            texts = [b"".join(map(token.__getitem__, np.frombuffer(x or b"", dtype="<u4").tolist())) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(texts, pa.binary())], names=[*names, out_col])

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids, n_tokens and decoded (what the ids decode to), in one Python pass: one worker a core, not two."""

    def run(batches):
        import regex

        table, find = merger(ranks_path), regex.compile(pattern).findall
        for batch in _slices(batches, "text", 1 << 18):
            ids = table.encode([find(t) if t else [] for t in batch.column("text").to_pylist()])
            back = [b"".join(map(table.token.__getitem__, np.frombuffer(x, dtype="<u4").tolist())) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(back, pa.binary())], names=["doc_id", "ids", "n_tokens", "decoded"])
        table.cache = {}

    return df.select("doc_id", "text").mapInArrow(tidied(run), "doc_id long, ids binary, n_tokens long, decoded binary")


def digest(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids and of what they decode to."""
    back = round_trip(df, ranks_path, pattern)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
