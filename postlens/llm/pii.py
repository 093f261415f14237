"""Personal data: fixed patterns, and a skip-chain conditional random field that adds to them.

The base patterns give spans of four kinds. Tokens with a digit or an ``@`` are then the nodes of a
random field with the labels none, email, ip, card and phone (any other token is none by
definition). Neighbouring nodes with only blanks between them share a chain potential; consecutive
occurrences of one normal form (the digits, from six on, else the word without punctuation) share a
skip potential, and consecutive occurrences of one likeness (the last seven digits, half of a long number,
the name before an ``@``) of different normal forms share another. Nodes inside a base span are observed. Loopy
belief propagation runs over each document until messages settle; a node that is not observed becomes a span of
its own if one kind's marginal is at least ``sure``. Base spans always stay.

The weights (by token shape, hashed to SHAPES cells, and by pair of labels for each kind of edge) maximise
the field's pseudo-likelihood of the observed labels with a Gaussian prior: unary and pair weights are fitted
together, so none counts another's evidence. Its sufficient statistics are how often each node occurs
with its shape, its label and its neighbours' labels; they are counted over all documents and summed by
Spark, and their number depends on the shapes, not on the documents.

Defined results: a null or empty text has no spans; very long texts are read whole, in time linear
in their length; repeated rows get the same answer, each by itself; of base spans that start at the
same place the kinds go in the order listed; without any base span nothing is added; an empty
table gives an empty table; columns beyond doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The kinds in their order, and the patterns' characters.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

SIGN = re.compile(r"[0-9@]")
EDGE = "\"'`,;:!?()[]{}<>*#$&%|=."
SHAPES = 4096
LABELS = 1 + len(KINDS)
EDGES = ("chain", "skip", "near")
ROUNDS, SETTLED = 60, 1e-5


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every base span, sorted."""
    if not text:
        return []
    out = []
    # the local part is the run of its characters before an @, back to the end of the match before
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = _digits(m.group())
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_digits(m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def nodes(text: str | None) -> list[tuple[int, int]]:
    """Start and end of every token with a digit or an @, without punctuation at its ends."""
    out, done = [], 0
    m = SIGN.search(text) if text else None
    while m:
        a = b = m.start()
        while a > done and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        done = b
        core = text[a:b]
        left = len(core) - len(core.lstrip(EDGE))
        core = core.strip(EDGE)
        if core:
            out.append((a + left, a + left + len(core)))
        m = SIGN.search(text, b)
    return out


def shape(token: str) -> int:
    s = re.sub(r"[^\W\d_]+", "a", token)
    s = re.sub(r"[0-9]+", lambda m: f"<{min(len(m.group()), 20)}>", s)
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) % SHAPES


def normal_form(token: str) -> str:
    d = _digits(token)
    return d if len(d) >= 6 and not re.search(r"[^\W\d_]", token) else token.lower()


def likenesses(token: str) -> list[str]:
    """What similar tokens have in common: the end of a number, half of a long one, the name of an address."""
    d, (name, at, _) = _digits(token), token.lower().partition("@")
    out = [f"end {d[-7:]}"] if len(d) >= 7 else []
    if len(d) >= 12:
        out += [f"left {d[: len(d) // 2]}", f"right {d[len(d) // 2 :]}"]
    return [*out, f"name {name}"] if at and len(name) >= 3 else out


class Field:
    """The random field of one text: nodes, observed labels (0 where none), shapes, edges."""

    def __init__(self, text: str | None):
        self.base = base_spans(text)
        self.at = nodes(text)
        n = len(self.at)
        self.label = np.zeros(n, dtype=np.int64)
        k, widest = 0, 0
        live: list[tuple[int, int, int]] = []
        for i, (a, b) in enumerate(self.at):
            while k < len(self.base) and self.base[k][0] < b:
                live.append(self.base[k])
                k += 1
            live = [s for s in live if s[2] > a]
            if live:
                self.label[i] = 1 + min(s[1] for s in live)
        self.shape = np.array([shape(text[a:b]) for a, b in self.at], dtype=np.int64)
        chain = [(i, i + 1) for i in range(n - 1) if text[self.at[i][1] : self.at[i + 1][0]].strip(EDGE + " \t\r\n") == "" and self.at[i + 1][0] - self.at[i][1] <= 8]
        seen: dict[str, int] = {}
        skip, near, forms = [], set(), []
        for i, (a, b) in enumerate(self.at):
            forms.append(form := normal_form(text[a:b]))
            if form in seen:
                skip.append((seen[form], i))
            seen[form] = i
            for like in likenesses(text[a:b]):
                if like in seen and forms[seen[like]] != form:
                    near.add((seen[like], i))
                seen[like] = i
        self.chain, self.skip, self.near = [np.array(e, dtype=np.int64).reshape(-1, 2) for e in (chain, skip, sorted(near))]

    def surroundings(self) -> np.ndarray:
        """Per node the number of neighbours (3 at most) with each label by each kind of edge, as digits of base 4."""
        n = np.zeros((len(self.at), len(EDGES), LABELS), dtype=np.int64)
        for k, e in enumerate((self.chain, self.skip, self.near)):
            np.add.at(n, (e[:, 0], k, self.label[e[:, 1]]), 1)
            np.add.at(n, (e[:, 1], k, self.label[e[:, 0]]), 1)
        return np.minimum(n, 3).reshape(len(n), -1) @ (4 ** np.arange(len(EDGES) * LABELS))


def _statistics(docs: DataFrame) -> DataFrame:
    """Over all documents: node (shape * LABELS + label), around (its surroundings), n."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                fields = [f for f in map(Field, batch.column("text").slice(at, 1000).to_pylist()) if len(f.at)]
                if fields:
                    rows = np.concatenate([np.stack([f.shape * LABELS + f.label, f.surroundings()]) for f in fields], axis=1)
                    (node, around), n = np.unique(rows, axis=1, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(around), pa.array(n)], names=["node", "around", "n"])

    return docs.select("text").mapInArrow(run, "node long, around long, n long").groupBy("node", "around").agg(F.sum("n").alias("n"))


class Potentials:
    """Log-potentials: unary (shape, label) and, for each kind of edge, a symmetric table of labels."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray, near: np.ndarray):
        self.unary, self.chain, self.skip, self.near = unary, chain, skip, near


def fit(counts: pd.DataFrame, prior: float = 1.0, steps: int = 600, rate: float = 0.1) -> Potentials:
    """Maximum pseudo-likelihood with a Gaussian prior of that precision, by Adam's steps over the statistics (node, around, n)."""
    counts = counts.sort_values(["node", "around"])
    node, around = counts["node"].to_numpy(dtype=np.int64), counts["around"].to_numpy(dtype=np.int64)
    n = counts["n"].to_numpy(dtype=np.float64)
    seen, shape = np.unique(node // LABELS, return_inverse=True)
    y = node % LABELS
    beside = (around[:, None] // 4 ** np.arange(len(EDGES) * LABELS) % 4).reshape(-1, len(EDGES), LABELS).astype(np.float64)
    size = [LABELS, len(seen) * LABELS, len(EDGES) * LABELS * LABELS]
    cut = np.cumsum(size)[:-1]
    w = np.zeros(sum(size))
    first, second = np.zeros_like(w), np.zeros_like(w)

    def tables(w: np.ndarray):
        bias, own, pairs = np.split(w, cut)
        pairs = pairs.reshape(len(EDGES), LABELS, LABELS)
        return bias, own.reshape(-1, LABELS), (pairs + pairs.transpose(0, 2, 1)) / 2

    for step in range(1, steps + 1):
        bias, own, pairs = tables(w)
        score = bias + own[shape] + np.einsum("nkl,klm->nm", beside, pairs)
        p = np.exp(score - np.logaddexp.reduce(score, axis=1, keepdims=True))
        p[np.arange(len(y)), y] -= 1
        p *= n[:, None]
        of_shape = np.zeros((len(seen), LABELS))
        np.add.at(of_shape, shape, p)
        of_pairs = np.einsum("nkl,nm->klm", beside, p)
        of_pairs = (of_pairs + of_pairs.transpose(0, 2, 1)) / 2
        gradient = np.concatenate([p.sum(axis=0), of_shape.ravel(), of_pairs.ravel()]) + prior * w
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        w -= rate * min(1.0, 2 * (1 - step / (steps + 1))) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    bias, own, pairs = tables(w)
    unary = np.tile(bias, (SHAPES, 1))
    unary[seen] += own
    return Potentials(unary, *pairs)


def marginals(fields: list[Field], pot: Potentials) -> list[np.ndarray]:
    """Label marginals of every node of every field, by loopy belief propagation over all fields at once."""
    size = np.array([len(f.at) for f in fields], dtype=np.int64)
    begin = np.cumsum(size) - size
    label = np.concatenate([f.label for f in fields])
    score = pot.unary[np.concatenate([f.shape for f in fields])].copy()
    seen = np.flatnonzero(label)
    score[seen] = -50.0
    score[seen, label[seen]] = 0.0
    edges = [np.concatenate([getattr(f, kind) + b for f, b in zip(fields, begin)]) for kind in EDGES]
    a, b = np.concatenate(edges).T
    tables = np.concatenate([np.broadcast_to(getattr(pot, kind), (len(e), LABELS, LABELS)) for kind, e in zip(EDGES, edges)])
    source, target = np.concatenate([a, b]), np.concatenate([b, a])
    back = np.concatenate([np.arange(len(a), 2 * len(a)), np.arange(len(a))])
    both = np.concatenate([tables, tables.transpose(0, 2, 1)])
    sent = np.full((len(source), LABELS), -np.log(LABELS))
    for _ in range(ROUNDS if len(source) else 0):
        belief = score.copy()
        np.add.at(belief, target, sent)
        cavity = belief[source] - sent[back]
        new = np.logaddexp.reduce(cavity[:, :, None] + both, axis=1)
        new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
        moved = np.abs(new - sent).max()
        sent = 0.3 * sent + 0.7 * new
        if moved < SETTLED:
            break
    belief = score.copy()
    np.add.at(belief, target, sent)
    p = np.exp(belief - np.logaddexp.reduce(belief, axis=1, keepdims=True))
    return [p[x : x + n] for x, n in zip(begin, size)]


def added(fields: list[Field], pot: Potentials, sure: float) -> list[list[tuple[int, int, int]]]:
    """Spans of nodes that are not observed but surely of one kind."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in fields]
    which = [i for i, f in enumerate(fields) if len(f.at) and not f.label.all()]
    for i, p in zip(which, marginals([fields[i] for i in which], pot)) if which else ():
        f = fields[i]
        for n in np.flatnonzero((f.label == 0) & (p[:, 1:].max(axis=1) >= sure)).tolist():
            out[i].append((f.at[n][0], int(p[n, 1:].argmax()), f.at[n][1]))
    return out


def find(docs: DataFrame, sure: float = 0.9) -> DataFrame:
    """doc_id, base and every: arrays of (start, kind, end) in code points, sorted by start, then kind."""
    counts = _statistics(docs).toPandas()
    seen = len(counts) and bool((counts["node"] % LABELS > 0).any())
    pot = fit(counts) if seen else None
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))

    def run(batches):
        name = lambda spans: [{"start": a, "kind": KINDS[k], "end": b} for a, k, b in sorted(spans)]
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                fields = [Field(t) for t in batch.column("text").to_pylist()]
                more = added(fields, pot, sure) if pot else [[] for _ in fields]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([name(f.base) for f in fields], kind), pa.array([name(f.base + m) for f, m in zip(fields, more)], kind)], names=["doc_id", "base", "every"])

    spans = "array<struct<start: long, kind: string, end: long>>"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, base {spans}, every {spans}")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns. n_email, n_ip, n_card and n_phone count the base spans, n_added the others, n_spans all."""
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    out = find(docs)
    return out.select("doc_id", *[number(k) for k in KINDS], F.sha2(said("base").cast("binary"), 256).alias("base_sha256"), said("every").alias("spans"), (F.size("every") - F.size("base")).cast("long").alias("n_added"), F.size("every").cast("long").alias("n_spans"))
