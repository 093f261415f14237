"""Token ids in flat binary files with 64-bit document offsets.

A folder holds ``ids``: files of unsigned little-endian integers and nothing else (16 bits each, or 32 where the
vocabulary needs them), which in the order of their names are one stream of all ids, document after document in
ascending doc_id; and ``index``: files of 24-byte records (``RECORD``), one a document in the same order, whose
64-bit offset says how many ids come before it in the whole stream. Both can be memory-mapped (``TokenFiles``).

Spark writes them: texts are encoded where they are and staged; ids and index are range-partitioned by doc_id, each
by its own bounds, so no task holds more than its share. Offsets are sums inside a partition plus the partition's base, a prefix
sum over the partitions' counts (one number each). Every file is a task's rows one after the other, written by Spark's
text writer with the last bytes of a row as its separator: the end id closes a document, and the highest byte
of a record is always zero. So the committer, the store and recovery from lost executors are Spark's own. A document never
straddles two files of ids.

Defined results: a null or empty text has the end id alone; rows that share a doc_id follow each other by a hash of their
text; null ids come first; very long texts are encoded whole; an empty table gives no documents; other columns
are not written. Special tokens whose strings stand in a text are encoded as the tokenizers library does by default.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlens.llm.common import release, stage, tidied
from postlens.workspace import fresh

#: A document in the index: ids before it, its id (0 if null), and whether the id is known.
RECORD = np.dtype([("offset", "<u8"), ("doc_id", "<i8"), ("known", "<u8")])
#: Words, and letters of words, whose ids a Python worker keeps, none longer than so many characters.
CACHED, CACHED_CORES, CACHED_CHARS = 300_000, 1_000_000, 24
#: What stands between new words that the library encodes together, and how many these are.
MARK, TOGETHER = "\x01", 2000
#: What ends the last token of every word, and punctuation behind a word's letters that is a word of its own.
END, TAIL = "</w>", ".,;:!?"
#: About so many ids a file, but for a longer document.
FEWEST, MOST = 1 << 20, 1 << 26
_ENCODERS: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Ids of texts by a tokenizers file whose pre-tokens never hold a blank, so that texts may be encoded word by word.

    The library encodes each distinct word once; its ids are kept. Words longer than the bound are encoded every time.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids[0]
        # lower-case letters of ASCII are their own normal form and byte letters: the same model, cut at blanks alone
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith(END)
        self.cache: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}

    def _together(self, words: list[str], between: str, letters: bool, ascii_: bool = False) -> list[bytes]:
        """The ids of words, many in one text. Words of letters end at the token that ends them; others have the mark, a token of its own there, between them."""
        out: list[bytes] = []
        width, tokenizer = self.dtype.itemsize, self.letters if ascii_ else self.tokenizer
        for at in range(0, len(words), TOGETHER):
            some = words[at : at + TOGETHER]
            ids = np.array(tokenizer.encode_batch_fast([between.join(some)], add_special_tokens=False)[0].ids, dtype=self.dtype)
            last = (np.flatnonzero(self.ends[ids] if letters else ids == self.mark) * width).tolist()
            raw = ids.tobytes()
            if letters:
                parts = [raw[a:b] for a, b in zip([0, *(c + width for c in last)], [c + width for c in last])]
            else:
                parts = [raw[a:b] for a, b in zip([0, *(c + width for c in last)], [*last, len(raw)])]
            out += parts if len(parts) == len(some) else self._alone(some)
        return out

    def _new(self, words: list[str]) -> None:
        """Looks new words up by their letters, without what stands behind them and, in ASCII, in lower case, which is all the same to the tokenizer."""
        cores, rest = [], []
        for w in words:
            core = w.rstrip(TAIL)
            if core.isalpha():
                cores.append((w, core.lower() if core.isascii() else core, w[len(core) :]))
            else:
                rest.append(w)
        if len(self.cores) > CACHED_CORES:
            self.cores = {}
        known = self.cores
        new = list({c for _, c, _ in cores}.difference(known))
        for ascii_ in (True, False):
            some = [c for c in new if c.isascii() is ascii_]
            known.update(zip(some, self._together(some, " ", True, ascii_)))
        tails = list({t for _, _, t in cores}.difference(self.tails))
        self.tails.update(zip(tails, self._alone(tails)))
        self.cache.update([(w, known[c] + self.tails[t]) for w, c, t in cores])
        odd = [w for w in rest if MARK in w]
        plain = [w for w in rest if MARK not in w] if odd else rest
        self.cache.update(zip(plain, self._together(plain, f" {MARK} ", False)))
        self.cache.update(zip(odd, self._alone(odd)))
        for store, ws in ((known, new), (self.tails, tails)):
            for w in ws:
                if len(w) > CACHED_CHARS:
                    del store[w]

    def _alone(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as bytes."""
        if len(self.cache) > CACHED:
            self.cache = {}
        # a line feed counts as a blank for the tokenizer, which makes one of every run of white space
        words = [t.replace("\n", " ").split(" ") if t else [] for t in texts]
        known = self.cache
        known[""] = b""
        new = list(set().union(*words).difference(known))
        self._new(new)
        out = [b"".join(map(known.__getitem__, ws)) for ws in words]
        for w in new:
            if len(w) > CACHED_CHARS:
                del known[w]
        return out


def encoder(path: str) -> WordEncoder:
    """One a Python worker, as workers serve many tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def encode(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """doc_id, tie (a hash of the text), n (ids with the end id) and ids (without it, as bytes of the vocabulary's width)."""

    def run(batches):
        for batch in batches:
            rows = max(1, int(batch.num_rows * (1 << 20) / max(batch.column("_text").nbytes, 1)))
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                own = encoder(path)
                ids = own.encode(part.column("_text").to_pylist())
                n = [len(x) // own.dtype.itemsize + 1 for x in ids]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tie"), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "tie", "n", "ids"])

    texts = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("_text"))
    return texts.mapInArrow(tidied(run), "doc_id long, tie long, n long, ids binary")


def _flat(rows: DataFrame, path: str, separator: bytes) -> None:
    """Writes the bytes of the only column, each row's followed by the separator, without anything else."""
    if any(b > 127 for b in separator):
        raise ValueError(f"a separator of plain ASCII bytes is needed, not {separator!r}")
    only = rows.columns[0]
    rows.select(F.col(only).cast("string")).write.option("lineSep", separator.decode("ascii")).option("compression", "none").text(path)


def write(df: DataFrame, out: str, tokenizer_path: str, end_id: int = 1, text_col: str = "text") -> str:
    """Encodes every text and writes ``out``/ids and ``out``/index. Gives ``out``."""
    spark = df.sparkSession
    width = encoder(tokenizer_path).dtype.itemsize
    staged = stage(encode(df, tokenizer_path, text_col), "token-ids", "zstd")
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    total = staged.agg(F.sum("n")).first()[0] or 0
    files = file_count(total, spark.sparkContext.defaultParallelism)
    # rows that share an id and a text are alike; a third key lets even these be parted
    parted = staged.withColumn("_row", F.monotonically_increasing_id())
    _flat(parted.repartitionByRange(files, *order, "_row").sortWithinPartitions(*order).select("ids"), f"{out}/ids", end_id.to_bytes(width, "little"))
    release(spark)

    # the index is much smaller than the ids, and has bounds of its own
    keys = parted.select("doc_id", "tie", "n", "_row").repartitionByRange(files, *order, "_row")
    dealt = stage(keys.withColumn("part", F.spark_partition_id()), "token-index")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # one row a part
    inside = F.sum("n").over(Window.partitionBy("part").orderBy(*order, "_row")) - F.col("n")
    offsets = dealt.withColumn("inside", inside).join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("inside")).alias("offset"))

    def records(batches):
        size = RECORD.itemsize
        for batch in batches:
            ids, rec = batch.column("doc_id"), np.zeros(batch.num_rows, dtype=RECORD)
            rec["doc_id"], rec["known"], rec["offset"] = ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), batch.column("offset").to_numpy()
            raw = rec.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([raw[k : k + size - 1] for k in range(0, len(raw), size)], pa.binary())], names=["record"])

    _flat(offsets.repartitionByRange(files, "offset").sortWithinPartitions("offset").mapInArrow(records, "record binary"), f"{out}/index", b"\0")
    return out


def file_count(total: int, cores: int) -> int:
    """Files of ids for so many of them: two for every core, of FEWEST ids at least and MOST at most."""
    return max(1, -(-total // MOST), min(2 * cores, -(-total // FEWEST)))


def _number(name: str) -> int:
    return int(re.search(r"part-(\d+)", name)[1])


def _listed(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """Data files below a folder and their sizes, by name. There are as many as tasks wrote, not as documents."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, it = [], fs.listFiles(where, False)
    while it.hasNext():
        f = it.next()
        name = f.getPath().toString()
        if f.getLen() and re.search(r"/part-[^/]*$", name):
            found.append((name, f.getLen()))
    return sorted(found, key=lambda f: _number(f[0]))


def open_array(uri: str, dtype: np.dtype) -> np.ndarray:
    """A file as an array: memory-mapped where it is a local path, else read through Arrow's file systems."""
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return np.memmap(unquote(parsed.path) if parsed.scheme else uri, dtype=dtype, mode="r")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=dtype)


class TokenFiles:
    """A written folder on a path that this machine reaches, for training jobs: ``len``, and the ids of the k-th document."""

    def __init__(self, folder: str, dtype: np.dtype | str = "<u2"):
        plain = unquote(urlparse(folder).path) if folder.startswith("file:") else folder
        names = lambda sub: [f"{plain}/{sub}/{f}" for f in sorted((f for f in os.listdir(f"{plain}/{sub}") if f.startswith("part-") and os.path.getsize(f"{plain}/{sub}/{f}")), key=_number)]
        self.ids = [np.memmap(p, dtype=dtype, mode="r") for p in names("ids")]
        self.index = [np.memmap(p, dtype=RECORD, mode="r") for p in names("index")]
        self.id_bases = np.cumsum([0, *map(len, self.ids)])
        self.index_bases = np.cumsum([0, *map(len, self.index)])

    def __len__(self) -> int:
        return int(self.index_bases[-1])

    def _offset(self, k: int) -> int:
        if k == len(self):
            return int(self.id_bases[-1])
        f = int(np.searchsorted(self.index_bases, k, side="right")) - 1
        return int(self.index[f][k - self.index_bases[f]]["offset"])

    def doc_id(self, k: int) -> int | None:
        f = int(np.searchsorted(self.index_bases, k, side="right")) - 1
        r = self.index[f][k - self.index_bases[f]]
        return int(r["doc_id"]) if r["known"] else None

    def __getitem__(self, k: int) -> np.ndarray:
        if not 0 <= k < len(self):
            raise IndexError(k)
        start, end = self._offset(k), self._offset(k + 1)
        f = int(np.searchsorted(self.id_bases, start, side="right")) - 1
        return self.ids[f][start - self.id_bases[f] : end - self.id_bases[f]]


def read(spark: SparkSession, folder: str, dtype: np.dtype | str, schema: str, make: Callable[[np.ndarray], list]) -> DataFrame:
    """doc_id, start and what ``make`` gives of each document's ids (the columns of ``schema``), from the files alone.

    A task takes one file of the index and maps those files of ids that its documents lie in.
    """
    dtype = np.dtype(dtype)
    ids, index = _listed(spark, f"{folder}/ids"), _listed(spark, f"{folder}/index")
    bases = np.cumsum([0, *(size // dtype.itemsize for _, size in ids)])
    listing = spark.sparkContext.broadcast(([n for n, _ in ids], bases))  # as many as files
    types = f"doc_id long, start long, {schema}"
    follow = [(k, name, index[k + 1][0] if k + 1 < len(index) else None) for k, (name, _) in enumerate(index)]

    def run(batches: Iterator[pa.RecordBatch]):
        names, bases = listing.value
        for batch in batches:
            for name, after in zip(batch.column("name").to_pylist(), batch.column("after").to_pylist()):
                own = open_array(name, RECORD)
                end = int(open_array(after, RECORD)[0]["offset"]) if after else int(bases[-1])
                held, stream = -1, None
                for at in range(0, len(own), 4096):
                    rec = own[at : at + 4096]
                    starts = rec["offset"].astype(np.int64)
                    ends = np.append(starts[1:], int(own[at + 4096]["offset"]) if at + 4096 < len(own) else end)
                    files = np.searchsorted(bases, starts, side="right") - 1
                    rows = []
                    for f, a, b in zip(files.tolist(), starts.tolist(), ends.tolist()):
                        if f != held:
                            held, stream = f, open_array(names[f], dtype)
                        rows.append(make(stream[a - bases[f] : b - bases[f]]))
                    doc = pa.array(rec["doc_id"].copy(), mask=rec["known"] == 0)
                    yield pa.RecordBatch.from_arrays([doc, pa.array(starts), *[pa.array(c) for c in zip(*rows)]], names=[c.strip().split()[0] for c in types.split(",")])

    if not index:
        return spark.createDataFrame([], types)
    return spark.createDataFrame(follow, "k long, name string, after string").repartition(len(follow), "k").select("name", "after").mapInArrow(run, types)


def digest(df: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Writes the files into the shared folder and reads them back: doc_id, start, n_tokens, and the CRC-32 of the ids as 32-bit integers."""
    spark = df.sparkSession
    folder = write(df, fresh(spark, "token-files"), tokenizer_path, end_id)
    return read(spark, folder, encoder(tokenizer_path).dtype, "n_tokens long, ids_crc32 long", lambda x: [len(x), zlib.crc32(x.astype("<u4").tobytes())])
