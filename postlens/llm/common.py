"""What the corpus operators share: shared folders, staged tables, small numpy helpers."""

from __future__ import annotations

import ctypes
import gc
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens import workspace
from postlens.shipping import ship as ship

MASK64 = (1 << 64) - 1


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that the driver no longer holds."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stage(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write df into the shared folder and read it back: cuts the lineage, survives lost executors.

    Shuffle files of earlier passes, which nothing can ask for any more, are then given up: Spark
    removes them when the driver's garbage collector finds their plans unused.
    """
    out = workspace.stage(df, label, codec)
    release(df.sparkSession)
    return out


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slices(batches, rows: int = 256):
    """Arrow batches a few rows at a time, so that only those are Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def tidy() -> None:
    """Give freed memory back to the system: Spark keeps Python workers for later stages, which need it."""
    _HASHES.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
    if trim is not None:
        trim(0)


def tidied(run):
    """A task's function over batches that tidies up after the last one."""

    def whole(batches):
        yield from run(batches)
        tidy()

    return whole


def crc_bucket(col: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(n))


def word_hash(word: str) -> int:
    """A 64-bit hash of a word that is the same in every process."""
    b = word.encode("utf-8", "surrogatepass")
    return ((zlib.crc32(b) << 32) | zlib.crc32(b, 0x9E3779B9)) & MASK64


#: Words whose hash a Python worker keeps; the cache is emptied beyond that, as executors' memory is small.
CACHED_WORDS = 100_000
class _Hashes(dict):
    """Hashes of words, made when they are asked for first."""

    def __missing__(self, word: str) -> int:
        self[word] = h = word_hash(word)
        return h


_HASHES: dict[str, int] = _Hashes()


def hash_words(words: list[list[str]]) -> np.ndarray:
    """Hashes of all words of some lists, one after the other."""
    if len(_HASHES) > CACHED_WORDS:
        _HASHES.clear()
    return mix64(np.fromiter(map(_HASHES.__getitem__, chain.from_iterable(words)), dtype=np.uint64, count=sum(map(len, words))))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over uint64 arrays (splitmix64's, which is published)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A bitmap is in PARTS by the highest bits of the keys. It has 2**PER_KEY to twice that many bits a key (a part 2**LEAST at least), up to 2**MAX_BITS (128 MB).
PARTS, PER_KEY, LEAST, MAX_BITS = 256, 4, 9, 30
#: Keys that a task holds before it hands them on, and the rows that it hands on: a part's keys by their low 32 bits, those found once and those found more often.
HELD, PACKED = 1 << 20, "kind int, part int, once binary, more binary"


def _pack(kind: int, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    keys, more = np.concatenate([k for k, _ in found]), np.concatenate([n > 1 for _, n in found])
    order = np.argsort(keys)
    keys, more = keys[order], more[order]
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    more = np.logical_or.reduceat(more, start) | (np.diff(np.append(start, len(keys))) > 1)
    keys = keys[start]
    cut = np.searchsorted(keys >> np.uint64(56), np.arange(PARTS + 1).astype(np.uint64)).tolist()
    low, some = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), [p for p in range(PARTS) if cut[p] < cut[p + 1]]
    rows = [[low[cut[p] : cut[p + 1]][which[cut[p] : cut[p + 1]]].tobytes() for p in some] for which in (~more, more)]
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(some), pa.int32()), pa.array(some, pa.int32()), *[pa.array(x, pa.binary()) for x in rows]], names=["kind", "part", "once", "more"])


def packed(found):
    """PACKED rows of (kind, keys, how often each was found), about four bytes a key; keys have to be well mixed."""
    held, size = {}, {}
    for kind, keys, n in found:
        held.setdefault(kind, []).append((keys, n))
        size[kind] = size.get(kind, 0) + len(keys)
        if size[kind] >= HELD:
            yield _pack(kind, held.pop(kind))
            size[kind] = 0
    for kind in held:
        if size[kind]:
            yield _pack(kind, held[kind])


def long_keys(column) -> np.ndarray:
    return np.asarray(column.to_numpy(zero_copy_only=False), dtype=np.int64).view(np.uint64)


def _segment(rows: pa.Table, least: int) -> np.ndarray:
    """The words of a part's bits, from all its keys that were found least times or more (once or twice)."""
    once, more = (np.sort(np.frombuffer(b"".join(rows.column(c).to_pylist()), dtype=np.uint32)) for c in ("once", "more"))
    keys = np.concatenate([once if least == 1 else once[1:][once[1:] == once[:-1]], more])
    keys = np.unique(keys)
    width = max(LEAST, min(MAX_BITS - PARTS.bit_length() + 1, (len(keys) << PER_KEY).bit_length()))
    bits = np.zeros(1 << width, dtype=bool)
    bits[keys & np.uint32((1 << width) - 1)] = True
    bits[keys >> np.uint32(32 - width)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


class Bitmap:
    """A Bloom bitmap with two probes, from a DataFrame of well mixed longs (``key``) or from the segments of its parts."""

    def __init__(self, keys: DataFrame | None = None, segments: list[tuple[int, bytes]] = ()):
        if keys is not None:
            rows = keys.select("key").mapInArrow(lambda batches: packed((0, k, np.ones(len(k), dtype=np.int8)) for k in (long_keys(b.column("key")) for b in batches)), PACKED)
            segments = _segments(rows, [1])[0]
        words = [np.zeros(1, dtype=np.uint64)]  # where parts without keys look
        width, self.begin = np.full(PARTS, 6, dtype=np.uint64), np.zeros(PARTS, dtype=np.int64)
        at = 1
        for part, own in segments:
            words.append(np.frombuffer(own, dtype=np.uint64))
            width[part], self.begin[part] = len(own).bit_length() + 2, at  # 8 bits a byte
            at += len(words[-1])
        self.words = np.concatenate(words)
        self.mask, self.shift = (np.uint64(1) << width) - np.uint64(1), np.uint64(32) - width

    def has(self, key: np.ndarray) -> np.ndarray:
        part, low = (key >> np.uint64(56)).astype(np.int64), key & np.uint64(0xFFFFFFFF)
        begin, out = self.begin[part], np.ones(len(key), dtype=bool)
        for p in (low & self.mask[part], low >> self.shift[part]):
            out &= (self.words[begin + (p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return out


def _segments(rows: DataFrame, least: list[int]) -> list[list[tuple[int, bytes]]]:
    """By kind, (part, words) of PACKED rows: keys of kind k count that were found least[k] times or more."""

    def run(part: pa.Table) -> pa.Table:
        kind = part.column("kind")[0].as_py()
        return pa.table({"kind": part.column("kind")[:1], "part": part.column("part")[:1], "words": pa.array([_segment(part, least[kind]).tobytes()], pa.binary())})

    out = [[] for _ in least]
    for batch in rows.groupBy("kind", "part").applyInArrow(run, "kind int, part int, words binary").toArrow().to_batches():
        for kind, part, words in zip(*[batch.column(c).to_pylist() for c in ("kind", "part", "words")]):
            out[kind].append((part, words))
    return out


def bitmaps(rows: DataFrame, least: list[int]):
    """The bitmaps of PACKED rows by kind, as broadcast variables; each has 128 MB at most."""
    sent = [rows.sparkSession.sparkContext.broadcast(Bitmap(segments=x)) for x in _segments(rows, least)]
    release(rows.sparkSession)
    return sent


def bitmap(keys: DataFrame):
    """The bitmap of the long column ``key`` as a broadcast variable; it has 128 MB at most."""
    sent = keys.sparkSession.sparkContext.broadcast(Bitmap(keys))
    release(keys.sparkSession)
    return sent
