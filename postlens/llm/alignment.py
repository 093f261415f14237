"""Alignment of the tokens that two tokenizers make of the same bytes, by an associative fragment monoid.

Byte offsets where tokens of both sides end cut a text's tokens into groups. A fragment is what a byte range [s, e)
knows of them: the tokens that end in it up to its first common end (the open prefix, whose group may have begun
before s), the groups closed after that, and the tokens after its last common end (the open suffix). Without a
common end it is one open piece. Two neighbouring fragments compose: suffix and prefix make a group, closed groups
follow each other. That is associative, so fragments of any chunks in any bracketing give the same text.

Every text is cut into ``chunk`` bytes. The fragments of a text of one chunk are done where they are made; those of
longer ones are rows, composed ``FAN`` neighbours at a time by grouped tasks, level by level, until one a text is left.
What goes up the tree are open tokens, counts, the closed groups' text (which the digest needs in order) and link counts.

Link counts over the corpus are sums of tasks' own sums; the most frequent partner of every B id joins in. Documents look their
links up in that table: it is broadcast while it has at most ``SENT`` rows (16 bytes each), joined by salted keys beyond that.

Token bytes have at least one byte each, so at a common end there is one A token and one B token: one link a group.

Defined results: a null or empty text, and one whose tokens' bytes are not a space and the text on either side (say, with
U+2581 in it), has no tokens: zeros and an empty ``groups_sha256``; strings of special tokens are plain text; very
long texts are encoded whole, and aligned chunk by chunk; repeated rows and repeated or null ids are judged row by
row, and count row by row; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import os
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import stage, tidied

CHUNK = 1 << 16
FAN = 8
#: Rows of the table of linked pairs that are broadcast at most.
SENT = 4_000_000
SALTS = 16
CACHED, CACHED_CHARS = 300_000, 24
#: White space before a blank.
BLANK_PAIR = re.compile(r"[\s\u180e] ")
#: New units that are encoded in one text.
TOGETHER = 500
_PAIRS: dict[tuple[str, str], "TwoTokenizers"] = {}


class TwoTokenizers:
    """Ids and byte lengths of both sides: A a byte-level tokenizers file, B a sentencepiece model with byte fallback.

    A text is encoded unit by unit, a unit being a blank and what follows up to the next blank after something that is not
    white space. Neither side has a token across such a place: A's pre-tokens begin with the blank or end before it, and no piece
    of B holds a blank after anything else. Units seen lately are kept, by their text without the first blank.
    """

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = _byte_letters()
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        n = self.b.vocab_size()
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.parted = not any("▁" in p.lstrip("▁") for p in pieces)
        self.a_size = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        self.unit = regex.compile(r"(?<=[^\s\u180e])(?= )") if self.parted else None
        self.forget()

    def forget(self) -> None:
        # ids of either side by unit; None where their bytes are not the unit
        self.a_cache: dict[str, bytes | None] = {}
        self.b_cache: dict[str, bytes | None] = {}

    def _alone(self, units: list[str]) -> None:
        """Encodes units one by one. Each begins with a blank, which B adds by itself."""
        a = self.a.encode_batch_fast(units, add_special_tokens=False)
        b = self.b.encode([u[1:] for u in units], num_threads=1)
        for u, x, y in zip(units, a, b):
            y = y if len(u) > 1 else [self.b.piece_to_id("▁")]  # the library adds no blank to an empty text
            raw = u.encode("utf-8", "surrogatepass")
            same = b"".join([self.a_bytes[i] for i in x.ids]) == raw == b"".join([self.b_bytes[i] for i in y])
            self.a_cache[u[1:]], self.b_cache[u[1:]] = (_ids(x.ids), _ids(y)) if same else (None, None)

    def _new(self, keys: list[str]) -> None:
        """Encodes units, many in one text, if all their tokens' bytes are the text and every unit ends with a token on both sides; else alone."""
        units = [f" {k}" for k in keys]
        odd = [u for u in units if u[-1].isspace() or not self.parted]
        self._alone(odd)
        plain = [u for u in units if not u[-1].isspace()] if self.parted else []
        for at in range(0, len(plain), TOGETHER):
            some = plain[at : at + TOGETHER]
            text = "".join(some)
            raw = text.encode("utf-8", "surrogatepass")
            a, b = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.b.encode(text[1:])
            ends = np.cumsum([len(u) for u in some] if len(raw) == len(text) else [len(u.encode("utf-8", "surrogatepass")) for u in some])
            if b"".join([self.a_bytes[i] for i in a]) != raw or b"".join([self.b_bytes[i] for i in b]) != raw:
                self._alone(some)
                continue
            a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
            a_cut, b_cut = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
            if (a_ends[a_cut] != ends).any() or (b_ends[b_cut] != ends).any():
                self._alone(some)
                continue
            a_cut, b_cut = [0, *(4 * (a_cut + 1)).tolist()], [0, *(4 * (b_cut + 1)).tolist()]
            a_raw, b_raw = _ids(a), _ids(b)
            own = keys[at : at + TOGETHER] if not odd else [u[1:] for u in some]
            self.a_cache.update(zip(own, [a_raw[x:y] for x, y in zip(a_cut, a_cut[1:])]))
            self.b_cache.update(zip(own, [b_raw[x:y] for x, y in zip(b_cut, b_cut[1:])]))

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and of B of a blank and each text; both empty where their bytes are not those."""
        if len(self.a_cache) > CACHED:
            self.forget()
        units = [self._cut(t) if t else [] for t in texts]
        new = list(set().union(*units).difference(self.a_cache))
        self._new(new)
        out, none = [], np.zeros(0, dtype=np.int64)
        ids = lambda cache, us: np.frombuffer(b"".join(map(cache.__getitem__, us)), dtype="<u4").astype(np.int64)
        for us in units:
            try:
                out.append((ids(self.a_cache, us), ids(self.b_cache, us)))
            except TypeError:  # a unit without ids
                out.append((none, none))
        for u in new:
            if len(u) > CACHED_CHARS:
                del self.a_cache[u], self.b_cache[u]
        return out

    def _cut(self, text: str) -> list[str]:
        """The units of a blank and the text, each without its first blank."""
        if not self.parted:
            return [text]
        if BLANK_PAIR.search(text) or text[0] == " " or text[-1] == " ":
            return [u[1:] for u in self.unit.split(" " + text)]
        return text.split(" ")


def _ids(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


def _byte_letters() -> dict[str, int]:
    """The letter of each byte in a byte-level vocabulary: printable ones stand for themselves, the others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def two_tokenizers(a_path: str, b_path: str) -> TwoTokenizers:
    if (a_path, b_path) not in _PAIRS:
        _PAIRS[a_path, b_path] = TwoTokenizers(a_path, b_path)
    return _PAIRS[a_path, b_path]


def _decimals(n: int) -> dict[str, np.ndarray]:
    """Every id as text with what may follow it."""
    return {after: np.array([f"{i}{after}" for i in range(n)], dtype=object) for after in (",", "|", ";")}


_TEXTS: dict[str, np.ndarray] = {}


def group_texts(a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> str:
    """Closed groups as ``a1,a2|b1;a3|b2,b3;`` (each with its semicolon); groups count from 0 in order."""
    if not _TEXTS:
        _TEXTS.update(_decimals(1 << 16))
    parts = np.empty(len(a) + len(b), dtype=object)
    # in a group A's tokens go before B's: a stable order by (group, side)
    a_at = np.arange(len(a)) + np.searchsorted(b_group, a_group, side="left")
    b_at = np.arange(len(b)) + np.searchsorted(a_group, b_group, side="right")
    a_last, b_last = np.diff(a_group, append=-1) != 0, np.diff(b_group, append=-1) != 0
    for ids, at, last, end in ((a, a_at, a_last, "|"), (b, b_at, b_last, ";")):
        parts[at[last]] = _TEXTS[end][ids[last]]
        parts[at[~last]] = _TEXTS[","][ids[~last]]
    return "".join(parts.tolist())


@dataclass
class Fragment:
    """What a byte range knows. ``closed`` says whether a common end lies in it; without one all its tokens are the prefix.

    The prefix is the tokens up to and with the first common end, if there is one.
    """

    closed: bool = False
    prefix: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    text: str = ""
    n_groups: int = 0
    links: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    suffix: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(0, np.int64), np.zeros(0, np.int64)))


def link_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a << np.int64(32) | b


def _counted(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    own, at = np.unique(keys, return_inverse=True)
    return own, np.bincount(at, weights=n, minlength=len(own)).astype(np.int64)


def lift(a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> Fragment:
    """The fragment of the tokens that end in a byte range, in order, with their ends."""
    at = np.searchsorted(b_ends, a_ends)
    hit_a = np.zeros(len(a), dtype=bool)
    inside = at < len(b)
    hit_a[inside] = b_ends[at[inside]] == a_ends[inside]
    n = int(hit_a.sum())
    if not n:
        return Fragment(prefix=(a, b))
    hit_b = np.zeros(len(b), dtype=bool)
    hit_b[at[hit_a]] = True
    # a token's group is the number of common ends before it
    a_group, b_group = np.cumsum(hit_a) - hit_a, np.cumsum(hit_b) - hit_b
    a_first, b_first = int(np.searchsorted(a_group, 1)), int(np.searchsorted(b_group, 1))
    a_last, b_last = int(np.searchsorted(a_group, n)), int(np.searchsorted(b_group, n))
    keys = link_key(a[hit_a], b[hit_b])[1:]
    return Fragment(
        True, (a[:a_first], b[:b_first]), group_texts(a[a_first:a_last], b[b_first:b_last], a_group[a_first:a_last], b_group[b_first:b_last]),
        n - 1, _counted(keys, np.ones(len(keys))), (a[a_last:], b[b_last:]),
    )


def _closing(a: np.ndarray, b: np.ndarray) -> tuple[str, np.ndarray]:
    """The text of one group and its link."""
    zero = lambda x: np.zeros(len(x), dtype=np.int64)
    return group_texts(a, b, zero(a), zero(b)), link_key(a[-1:], b[-1:])


def compose(left: Fragment, right: Fragment) -> Fragment:
    """The fragment of two neighbouring byte ranges; associative, with the empty fragment as its identity."""
    both = lambda x, y: (np.concatenate([x[0], y[0]]), np.concatenate([x[1], y[1]]))
    if not right.closed:
        if left.closed:
            return Fragment(True, left.prefix, left.text, left.n_groups, left.links, both(left.suffix, right.prefix))
        return Fragment(prefix=both(left.prefix, right.prefix))
    if not left.closed:
        return Fragment(True, both(left.prefix, right.prefix), right.text, right.n_groups, right.links, right.suffix)
    text, key = _closing(*both(left.suffix, right.prefix))
    links = _counted(np.concatenate([left.links[0], key, right.links[0]]), np.concatenate([left.links[1], np.ones(len(key)), right.links[1]]))
    return Fragment(True, left.prefix, left.text + text + right.text, left.n_groups + 1 + right.n_groups, links, right.suffix)


def finish(whole: Fragment) -> tuple[int, str, tuple[np.ndarray, np.ndarray]]:
    """Number of groups, their digest and the links of a whole text's fragment, whose prefix is its first group."""
    if not whole.closed:
        return 0, "", whole.links
    if len(whole.suffix[0]) or len(whole.suffix[1]):
        raise ValueError("the tokens of a whole text end together")
    text, key = _closing(*whole.prefix)
    links = _counted(np.concatenate([whole.links[0], key]), np.append(whole.links[1], 1))
    return whole.n_groups + 1, hashlib.sha256((text + whole.text)[:-1].encode()).hexdigest(), links


#: A fragment as columns; a text of one chunk has its digest and no open parts or text.
_FRAGMENT = "groups_sha256 string, closed boolean, prefix_a binary, prefix_b binary, groups string, n_groups long, keys binary, counts binary, suffix_a binary, suffix_b binary"
_ROW = "row long, doc_id long, n_a long, n_b long, node long, chunks long"


def _packed(f: Fragment) -> list:
    raw = lambda x: x.astype("<i8").tobytes()
    return [None, f.closed, raw(f.prefix[0]), raw(f.prefix[1]), f.text, f.n_groups, raw(f.links[0]), raw(f.links[1]), raw(f.suffix[0]), raw(f.suffix[1])]


def _finished(f: Fragment) -> list:
    n, sha, (keys, counts) = finish(f)
    return [sha, True, None, None, None, n, keys.astype("<i8").tobytes(), counts.astype("<i8").tobytes(), None, None]


def _unpacked(r) -> Fragment:
    ids = lambda x: np.frombuffer(x, dtype="<i8")
    return Fragment(bool(r.closed), (ids(r.prefix_a), ids(r.prefix_b)), r.groups, int(r.n_groups), (ids(r.keys), ids(r.counts)), (ids(r.suffix_a), ids(r.suffix_b)))


def fragments(df: DataFrame, a_path: str, b_path: str, chunk: int = CHUNK) -> DataFrame:
    """One row per text and chunk of its bytes: the row's number, doc_id, tokens of either side in the whole text, chunk (node) and the fragment."""
    names = [c.split()[0] for c in f"{_ROW}, {_FRAGMENT}".split(", ")]

    def rows_of(part: pa.RecordBatch, own: TwoTokenizers):
        for row, doc, (a, b) in zip(part.column("row").to_pylist(), part.column("doc_id").to_pylist(), own.encode(part.column("text").to_pylist())):
            a_ends, b_ends = np.cumsum(own.a_size[a]), np.cumsum(own.b_size[b])
            n = max(1, -(-int(a_ends[-1]) // chunk)) if len(a) else 1
            cuts = np.arange(1, n + 1) * chunk
            a_cuts, b_cuts = [0, *np.searchsorted(a_ends, cuts, side="right")], [0, *np.searchsorted(b_ends, cuts, side="right")]
            for k in range(n):
                x, y = slice(a_cuts[k], a_cuts[k + 1]), slice(b_cuts[k], b_cuts[k + 1])
                own_part = lift(a[x], b[y], a_ends[x], b_ends[y])
                yield [row, doc, len(a), len(b), k, n, *(_finished(own_part) if n == 1 else _packed(own_part))]

    def run(batches):
        own = two_tokenizers(a_path, b_path)
        for batch in batches:
            step = max(1, int(batch.num_rows * (1 << 18) / max(batch.column("text").nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                rows = list(rows_of(batch.slice(at, step), own))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=names)
        own.forget()

    own = df.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(tidied(run), f"{_ROW}, {_FRAGMENT}")


_TYPES = [pa.int64()] * 6 + [pa.string(), pa.bool_(), pa.binary(), pa.binary(), pa.string(), pa.int64(), *[pa.binary()] * 4]


def reduce_tree(chunks: DataFrame, most: int, fan: int = FAN) -> DataFrame:
    """One row per text from the rows of its chunks, composed ``fan`` neighbours at a time; most: chunks of the longest text."""
    kept = f"{_ROW}, {_FRAGMENT}"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = Fragment()
        for r in pdf.sort_values("node").itertuples():
            whole = compose(whole, _unpacked(r))
        first = pdf.iloc[0]
        doc = None if pd.isna(first.doc_id) else first.doc_id
        return pd.DataFrame([[first.row, doc, first.n_a, first.n_b, int(first.node) // fan, first.chunks, *_packed(whole)]], columns=pdf.columns).astype({"doc_id": "Int64"})

    while most > 1:
        chunks = chunks.groupBy("row", F.floor(F.col("node") / fan).alias("_up")).applyInPandas(fold, kept)
        most = -(-most // fan)
    return chunks


def aligned(df: DataFrame, a_path: str, b_path: str, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, groups_sha256, keys and counts (the text's distinct links as packed 64-bit integers)."""
    made = stage(fragments(df, a_path, b_path, chunk), "fragments", "zstd")
    most = made.agg(F.max("chunks")).first()[0] or 1
    columns = ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "keys", "counts"]
    whole = made.where("chunks = 1").select(*columns)
    if most == 1:
        return whole

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 8):
                part = batch.slice(at, 8)
                rows = [(*(part.column(c)[k].as_py() for c in columns[:4]), *finish(_unpacked(r))) for k, r in enumerate(part.to_pandas().itertuples())]
                raw = lambda x: x.astype("<i8").tobytes()
                cols = list(zip(*[(*r[:-1], raw(r[-1][0]), raw(r[-1][1])) for r in rows]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [*[pa.int64()] * 5, pa.string(), pa.binary(), pa.binary()])], names=columns)

    done = reduce_tree(made.where("chunks > 1"), most, fan).mapInArrow(tidied(run), "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, keys binary, counts binary")
    return whole.unionByName(stage(done, "composed", "zstd"))


def pair_counts(texts: DataFrame) -> DataFrame:
    """a_id, b_id, n (links that hold the pair linked) and best (whether n is the highest of its B id), over all texts."""

    def run(batches):
        keys, counts, held = [], [], 0

        def out():
            k, n = _counted(np.concatenate(keys), np.concatenate(counts))
            return pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["key", "n"])

        for batch in batches:
            for k, n in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                keys.append(np.frombuffer(k, "<i8"))
                counts.append(np.frombuffer(n, "<i8"))
                held += len(keys[-1])
                if held > 1 << 21:
                    yield out()
                    keys, counts, held = [], [], 0
        if held:
            yield out()

    sums = texts.select("keys", "counts").mapInArrow(tidied(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    split = sums.select((F.shiftrightunsigned("key", 32)).alias("a_id"), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b_id"), "n")
    counted = stage(split, "pairs")
    top = counted.groupBy("b_id").agg(F.max("n").alias("_top"))
    return counted.join(top, "b_id").select("a_id", "b_id", "n", (F.col("n") == F.col("_top")).alias("best"))


def with_counts(texts: DataFrame, pairs: DataFrame, sent: int | None = None) -> DataFrame:
    """texts (of ``aligned``) with n_links, n_best and count_sum, looked up in the pairs."""
    key = pairs.select((F.shiftleft("a_id", 32).bitwiseOR(F.col("b_id"))).alias("key"), "n", "best")
    key = stage(key, "pair-keys")
    kept = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string"
    names = [c.split()[0] for c in kept.split(", ")]
    if key.count() <= (SENT if sent is None else sent):
        table = key.orderBy("key").toArrow()
        known = texts.sparkSession.sparkContext.broadcast((table.column("key").to_numpy(), table.column("n").to_numpy(), table.column("best").to_numpy(zero_copy_only=False)))

        def look_up(batches):
            keys, n, best = known.value
            for batch in batches:
                sums = []
                for k, c in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                    at, c = np.searchsorted(keys, np.frombuffer(k, "<i8")), np.frombuffer(c, "<i8")
                    sums.append((int(c.sum()), int(c[best[at]].sum()), int((c * n[at]).sum())))
                yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in names], *[pa.array(c, pa.int64()) for c in zip(*sums)]], names=[*names, "n_links", "n_best", "count_sum"])

        return texts.mapInArrow(look_up, f"{kept}, n_links long, n_best long, count_sum long")

    def links(batches):
        for batch in batches:
            for row, k, c in zip(batch.column("row").to_pylist(), batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                if k:
                    k, c = np.frombuffer(k, "<i8"), np.frombuffer(c, "<i8")
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), row)), pa.array(k), pa.array(c), pa.array(np.full(len(k), row % SALTS))], names=["row", "key", "c", "salt"])

    salted = key.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    each = texts.select("row", "keys", "counts").mapInArrow(links, "row long, key long, c long, salt long").join(salted, ["key", "salt"])
    sums = each.groupBy("row").agg(F.sum("c").alias("n_links"), F.sum(F.when(F.col("best"), F.col("c")).otherwise(0)).alias("n_best"), F.sum(F.col("c") * F.col("n")).alias("count_sum"))
    return texts.select(*names).join(sums, "row", "left").fillna(0, ["n_links", "n_best", "count_sum"])


def align(df: DataFrame, a_path: str, b_path: str, chunk: int = CHUNK, fan: int = FAN, sent: int | None = None) -> DataFrame:
    """One row per text: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    texts = aligned(df, a_path, b_path, chunk, fan)
    return with_counts(texts, pair_counts(texts), sent).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
