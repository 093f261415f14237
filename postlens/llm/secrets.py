"""Secret scans: candidate strings, and a random forest that removes false positives.

Candidates are runs of 16 or more key characters that have a digit, or are quoted and assigned, and
what is assigned to a credential's name: at least ``SHORTEST`` characters other than blanks, of any kind.
The forest sees the length, the character classes and the transitions between them, the share of
letters in dictionary words (the DICTIONARY words of most documents, counted over the whole table),
whether the candidate is part of a path, is assigned or quoted, and for the two words before it
and the one after how much more often the word stands beside a candidate than elsewhere (counted over all
findings and all documents, kept for BESIDE words).

``train`` takes labelled findings, if there are any (doc_id, start, end, label). The tables have none; then
what surrounds a candidate labels the clear cases by evidence that is not among the features: the
meaning of the name it is assigned to. A value with a digit and another character, assigned to a credential's
name, is a secret; numbers, UUIDs, parts of paths and of addresses, and strings named as digests or
revisions are none, nor are plain words after a credential's name. The rest, such as bare random strings, is left for
the forest. It is fitted on a bounded sample (``per_class`` distinct labelled strings of each label,
those with the least hash; strings of one fold of a hash are kept from it for measuring); every tree is grown in a task of its own.

Defined results: null or empty texts have no findings; very long texts are scanned whole in linear
time; repeated rows are each scanned; a null doc_id keeps its findings under null; if one label has no
finding at all the rules alone decide (probability 1 or 0); an empty table gives an empty table;
extra columns are not read by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.llm.common import slices, stage, tidied

#: Words that name credentials.
CREDENTIAL = frozenset("token secret key apikey password passwd pwd auth bearer credential credentials private access signature".split())
#: Names of digests and revisions, which look random and are public.
DIGEST = frozenset("commit sha md checksum digest hash rev revision etag fingerprint uuid guid".split())
RUN = re.compile(r"[A-Za-z0-9_+/=-]{16,}")
#: A credential's name and the value assigned to it; what a match takes is not read again, so time is linear.
NAMED = re.compile(
    r"(?i)(?:(?<![a-z])(?:key|passwd|pwd|auth|bearer|credentials?|private|access|signature)|token|secret|password|api[_-]?key)[\"'`]?[ \t]{0,8}(?::=|=>|[:=])[ \t]{0,8}"
    r"(?:\"(?P<d>[^\s\"]++)|'(?P<s>[^\s']++)|`(?P<b>[^\s`]++)|(?P<v>[^\s\"'`]\S*+))"
)
SHORTEST = 4
SEGMENT = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+)(?:[_-]?(?:[A-Z]?[a-z]+|[A-Z]+))*[0-9]{0,4}")
WORD = re.compile(r"[^\W\d_]+")
DIGIT = re.compile(r"[0-9]")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
MARK = "[SECRET]"
FEATURES = 15
BINS = 32
DICTIONARY, BESIDE = 50_000, 10_000
#: Words of fewer letters are not looked up in the dictionary.
LETTERS = 4


@dataclass
class Params:
    per_class: int = 5000
    trees: int = 24
    depth: int = 6
    min_rows: int = 5
    sure: float = 0.5
    folds: int = 5  # strings whose hash has remainder 0 are kept from the fit


@dataclass
class Finding:
    """What is known of a candidate before the whole table is counted."""

    own: list[float]  # features of its own
    length: int
    words: list[str]
    beside: list[str]  # the word before, the one before that, the word after; empty where there is none


def _classes(s: str) -> np.ndarray:
    b = np.frombuffer(s.encode("ascii", "replace"), dtype=np.uint8)
    return np.select([(b >= 48) & (b <= 57), (b >= 65) & (b <= 90), (b >= 97) & (b <= 122)], [0, 1, 2], 3)


def _is_path(s: str) -> bool:
    """Whether most segments of a string with slashes are words."""
    segments = [x for x in s.split("/") if x]
    return s.count("/") >= 2 and 2 * sum(len(x) > 1 and bool(SEGMENT.fullmatch(x)) for x in segments) > len(segments)


def values(text: str) -> list[tuple[int, int]]:
    """Start and end of every value that is assigned to a credential's name."""
    out = []
    for m in NAMED.finditer(text):
        a, b = m.span(m.lastgroup)
        if m.lastgroup == "v":
            b = a + len(m["v"].rstrip(".,;:!?)]}>\"'`"))
        if b - a >= SHORTEST and not text.startswith("//", a):
            out.append((a, b))
    return out


def candidates(text: str | None) -> list[tuple[int, int, Finding, int]]:
    """(start, end, what is known of it, label by its surroundings: 1, 0, or -1 where they don't decide)."""
    if not text:
        return []
    out = []
    given = values(text)
    runs_, at = [], 0
    for m in RUN.finditer(text):
        while at < len(given) and given[at][1] <= m.start():
            at += 1
        if at == len(given) or given[at][0] >= m.end():
            runs_.append((m.start(), m.end()))
    spans = sorted([(a, b, True) for a, b in given] + [(a, b, False) for a, b in runs_])
    words = [m.span() for m in WORD.finditer(text)] if spans else []
    begins = [a for a, _ in words]
    for a, b, whole in spans:
        s = text[a:b]
        before, after = text[max(0, a - 2) : a], text[b : b + 1]
        quoted = before[-1:] in ("'", '"', "`") and after == before[-1:]
        inner = not whole and "=" in s.rstrip("=")  # name=value without blanks
        if inner:
            a += s.index("=") + 1
            s = text[a:b]
        sign = a - 1
        while sign >= 0 and a - sign <= 16 and text[sign] in "'\"` \t":
            sign -= 1
        assigned = whole or inner or sign >= 0 and text[sign] in "=:"
        if not whole and (len(s) < 16 or not DIGIT.search(s) and not (quoted and assigned)):
            continue
        k = bisect_left(begins, a)
        near = [text[x:y].lower() for x, y in words[max(0, k - 2) : k] if y <= a][::-1]
        k = bisect_left(begins, b)
        beside = [*near, *[""] * (2 - len(near)), text[slice(*words[k])].lower() if k < len(words) else ""]
        named = any(w in CREDENTIAL or w.endswith(("token", "secret", "password", "apikey")) for w in near)
        kind = _classes(s)
        counts = np.bincount(kind, minlength=4) / len(s)
        chars = np.unique(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), return_counts=True)[1] / len(s)
        entropy = float(-(chars * np.log2(chars)).sum())
        path = before[-1:] in ("/", ".", "\\") or after in ("/", ".") and text[b + 1 : b + 2].isalpha() or _is_path(s)
        own = [
            math.log(len(s)), *counts.tolist(), float((kind[1:] != kind[:-1]).mean()) if len(s) > 1 else 0.0, entropy, float(path),
            float(bool(re.fullmatch(r"[0-9a-fA-F-]+", s))), float(assigned), float(quoted),
        ]
        if named and assigned:
            mixed = bool(DIGIT.search(s)) and counts[0] < 1
            label = 1 if mixed and not path else 0 if path or whole and not quoted and s.isalpha() else -1
        else:
            label = 0 if path or counts[0] + counts[3] == 1 or UUID.fullmatch(s) or near and near[0] in DIGEST else -1
        out.append((a, b, Finding(own, len(s), [w.lower() for w in WORD.findall(s) if len(w) >= LETTERS], beside), label))
    return out


def grow(x: np.ndarray, y: np.ndarray, p: Params, seed: int) -> list[tuple[int, int, int, int, float]]:
    """One tree over binned features: nodes (feature or -1, last bin to the left, left, right, share of secrets)."""
    rng = np.random.default_rng(seed)
    own = rng.integers(0, len(y), len(y))
    x, y = x[own], y[own]
    nodes: list[tuple[int, int, int, int, float]] = []

    def split(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        share = float(y[rows].mean())
        nodes.append((-1, 0, 0, 0, share))
        if depth == p.depth or len(rows) < 2 * p.min_rows or share in (0.0, 1.0):
            return at
        best = (0.0, -1, 0)
        whole = len(rows) * share * (1 - share)
        for f in rng.choice(FEATURES, size=max(1, round(math.sqrt(FEATURES))), replace=False).tolist():
            n = np.cumsum(np.bincount(x[rows, f], minlength=BINS))
            t = np.cumsum(np.bincount(x[rows, f], weights=y[rows], minlength=BINS))
            m, u = n[-1] - n, t[-1] - t
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = whole - (np.where(n > 0, t * (1 - t / n), 0) + np.where(m > 0, u * (1 - u / m), 0))
            gain[(n < p.min_rows) | (m < p.min_rows)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0] + 1e-9:
                best = (float(gain[k]), f, k)
        if best[1] >= 0:
            left = x[rows, best[1]] <= best[2]
            a = split(rows[left], depth + 1)
            b = split(rows[~left], depth + 1)
            nodes[at] = (best[1], best[2], a, b, share)
        return at

    split(np.arange(len(y)), 0)
    return nodes


@dataclass
class Forest:
    edges: np.ndarray
    trees: list[np.ndarray]
    dictionary: frozenset[str] = frozenset()
    beside: dict[str, float] = field(default_factory=dict)

    def features(self, found: list[Finding]) -> np.ndarray:
        rows = [[*f.own, sum(len(w) for w in f.words if w in self.dictionary) / f.length, *[self.beside.get(w, 0.0) for w in f.beside]] for f in found]
        return np.array(rows, dtype=np.float64).reshape(len(rows), FEATURES)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.edges[f], x[:, f], side="left") for f in range(FEATURES)], axis=1) if len(x) else np.zeros((0, FEATURES), dtype=np.int64)

    def probability(self, x: np.ndarray) -> np.ndarray:
        b, total, rows = self.bins(x), np.zeros(len(x)), np.arange(len(x))
        for t in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            while True:
                f = t[at, 0].astype(np.int64)
                inner = f >= 0
                if not inner.any():
                    break
                left = b[rows, np.maximum(f, 0)] <= t[at, 1]
                at = np.where(inner, np.where(left, t[at, 2], t[at, 3]).astype(np.int64), at)
            total += t[at, 4]
        return total / max(len(self.trees), 1)


def document_counts(docs: DataFrame) -> DataFrame:
    """word, n: the number of documents that have it, for words of LETTERS letters or more, over the whole table."""
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    return docs.select(F.explode(words).alias("word")).where(F.length("word") >= LETTERS).groupBy("word").agg(F.count("*").alias("n"))


def findings(docs: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """label, h (hash of the string), own, length, words, beside of every candidate; labels by the surroundings, or the given ones (null: none)."""
    schema = "doc_id long, start long, end long, label long, h long, own array<double>, length long, words array<string>, beside array<string>"

    def run(batches):
        for batch in slices(batches):
            rows = [(r, a, b, label, zlib.crc32(t[a:b].encode("utf-8", "surrogatepass")), f.own, f.length, f.words, f.beside) for r, t in enumerate(batch.column("text").to_pylist()) for a, b, f, label in candidates(t)]
            col = lambda i, kind: pa.array([x[i] for x in rows], kind)
            numbers, texts = pa.list_(pa.float64()), pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(col(0, pa.int64())), *[col(i, pa.int64()) for i in range(1, 5)], col(5, numbers), col(6, pa.int64()), col(7, texts), col(8, texts)], names=["doc_id", "start", "end", "label", "h", "own", "length", "words", "beside"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run), schema)
    if given is not None:
        said = given.groupBy("doc_id", "start", "end").agg(F.max("label").cast("long").alias("label"))
        out = out.drop("label").join(said, ["doc_id", "start", "end"], "left").withColumn("label", F.coalesce("label", F.lit(-1).cast("long")))
    return out.drop("doc_id", "start", "end")


def train(docs: DataFrame, p: Params = Params(), given: DataFrame | None = None) -> Forest | None:
    """The forest of docs' candidates, or None where one label has no finding; given: labelled findings (doc_id, start, end, label)."""
    found = stage(findings(docs, given), "secret-findings")
    # one finding per string, as copies of one text would fill the sample; order by a hash of the string
    each = found.where("label >= 0").where(F.pmod("h", F.lit(p.folds)) != 0).groupBy("label", "h").agg(F.min(F.struct("own", "length", "words", "beside")).alias("f"))
    few = each.where("label = 0").orderBy(F.xxhash64("h"), "h").limit(p.per_class).unionByName(each.where("label = 1").orderBy(F.xxhash64("h"), "h").limit(p.per_class))
    rows = sorted(few.collect(), key=lambda r: (r["label"], r["h"]))  # at most 2 * per_class
    if len({r["label"] for r in rows}) < 2:
        return None
    counted = stage(document_counts(docs), "secret-words")
    top = counted.orderBy(F.desc("n"), "word").limit(DICTIONARY).toPandas()
    seen = found.select(F.explode("beside").alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("m")).orderBy(F.desc("m"), "word").limit(BESIDE)
    near = seen.join(counted, "word", "left").select("word", "m", F.coalesce("n", F.lit(0)).alias("n")).toPandas()
    m, n = near["m"].to_numpy(dtype=np.float64), near["n"].to_numpy(dtype=np.float64)
    rate = np.log((m + 0.5) / (n + 1.0))  # how often it stands beside a candidate, for each document that has it
    forest = Forest(np.zeros((FEATURES, BINS - 1)), [], frozenset(top["word"]), dict(zip(near["word"], (rate - np.log(0.5 / max(float(n.max()), 1.0))).tolist())))
    x = forest.features([Finding(r["f"]["own"], r["f"]["length"], r["f"]["words"], r["f"]["beside"]) for r in rows])
    y = np.array([r["label"] for r in rows], dtype=np.float64)
    forest.edges = np.stack([np.quantile(np.unique(x[:, f]), np.linspace(0, 1, BINS - 1)) for f in range(FEATURES)])
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((forest.bins(x), y))

    def plant(batches):
        for pdf in batches:
            for seed in pdf["id"].tolist():
                tree = np.array(grow(*sent.value, p, seed), dtype=np.float64)
                yield pd.DataFrame({"id": [seed], "tree": [tree.tobytes()]})

    grown = spark.range(0, p.trees, 1, p.trees).mapInPandas(plant, "id long, tree binary").toPandas().sort_values("id")
    forest.trees = [np.frombuffer(bytes(t)).reshape(-1, 5) for t in grown["tree"]]
    return forest


def held_out(docs: DataFrame, forest: Forest, p: Params = Params(), given: DataFrame | None = None) -> tuple[int, int, int, int]:
    """Over the labelled strings of the fold that no fit has seen: secrets, secrets found, others, others left alone."""
    sent = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for batch in batches:
            found = [Finding(*x) for x in zip(*[batch.column(c).to_pylist() for c in ("own", "length", "words", "beside")])]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(sent.value.probability(sent.value.features(found)))], names=["label", "p"])

    rows = findings(docs, given).where("label >= 0").where(F.pmod("h", F.lit(p.folds)) == 0).dropDuplicates(["label", "h"])
    judged = rows.select("label", "own", "length", "words", "beside").mapInArrow(run, "label long, p double")
    sure = F.col("p") >= p.sure
    one = judged.agg(F.count_if(F.col("label") == 1), F.count_if((F.col("label") == 1) & sure), F.count_if(F.col("label") == 0), F.count_if((F.col("label") == 0) & ~sure)).first()
    return tuple(one)


def judge(text: str | None, forest: Forest | None) -> list[tuple[int, int, float]]:
    """(start, end, probability) of every candidate."""
    found = candidates(text)
    if not found:
        return []
    if forest is None:
        return [(a, b, float(label == 1)) for a, b, _, label in found]
    p = forest.probability(forest.features([f for _, _, f, _ in found]))
    return [(a, b, round(float(q), 6)) for (a, b, _, _), q in zip(found, p)]


def scan(docs: DataFrame, forest: Forest | None, p: Params = Params()) -> DataFrame:
    """One row per candidate: doc_id, start, end (code points, end exclusive), probability, is_secret."""
    sent = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for batch in slices(batches):
            rows = [(r, *found) for r, t in enumerate(batch.column("text").to_pylist()) for found in judge(t, sent.value)]
            at = pa.array([r[0] for r in rows], pa.int64())
            prob = [r[3] for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array(prob, pa.float64()), pa.array([x >= p.sure for x in prob], pa.bool_())], names=["doc_id", "start", "end", "probability", "is_secret"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, end long, probability double, is_secret boolean")


def redact(docs: DataFrame, forest: Forest | None, p: Params = Params()) -> DataFrame:
    """All rows and columns, with MARK in place of every secret; n_chars, where present, follows the text."""
    names = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            for r, t in enumerate(texts):
                parts, done = [], 0
                for a, b, q in judge(t, sent.value):
                    if q >= p.sure:
                        parts += [t[done:a], MARK]
                        done = b
                if parts:
                    texts[r] = "".join([*parts, t[done:]])
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names], names=names)

    out = docs.mapInArrow(tidied(run), T.StructType([T.StructField("text", T.StringType()) if f.name == "text" else f for f in docs.schema.fields]))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
