"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

``train`` fits on a bounded sample of labelled documents (the ``sample_rows`` with the smallest hash of
doc_id, whatever their label, so that the labels keep their true shares at every size of the table),
one sequential pass per epoch in a single task, as FTRL with per-coordinate rates is a sequential
method. Every ``slice_of``-th row of the sample is kept from the fit: on these rows a slope and an offset of
the log-odds are fitted, as L1 shrinks what the weights say, and folded into weights and bias. L1
sparsity leaves some hundreds of weights, at most 2**BITS, which are sent to every scoring task.
``score`` reads every whole text.

A feature is the presence in a text of a word, a pair or triple of adjacent words, or a pair with
one or two words skipped, hashed to BITS bits. Words are maximal runs of word characters, lower case.

Defined results: a null or empty text has no features and gets the score of the bias; very long
texts are scored whole; repeated rows are scored alike, each by itself; label rows that are null,
unknown or repeated count once, as toxic if any of them says so; with no usable labels every score
is 0; an empty table gives an empty table; extra columns are kept, those named like the output
(``score``, ``predicted``) are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.llm.common import crc_bucket, hash_words, mix64, slices, tidied

BITS = 20
WORD = re.compile(r"\w+")


@dataclass
class Params:
    sample_rows: int = 10000
    epochs: int = 5
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 16.0
    l2: float = 1.0
    slice_of: int = 5


@dataclass
class Model:
    """Sparse weights of the hashed features, and a bias that L1 does not touch."""

    index: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.float64))
    bias: float = -1000.0


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Row number and feature index of every gram of every text."""
    words = [WORD.findall(t.lower()) if t else [] for t in texts]
    count = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    h = hash_words(words)
    row = np.repeat(np.arange(len(texts)), count)
    rows, keys = [row], [h]
    one, two, three = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    for kind, gap in enumerate((1, 2, 3), start=1):
        same = row[gap:] == row[:-gap] if len(row) > gap else np.zeros(0, dtype=bool)
        a, b = (h[:-gap][same], h[gap:][same]) if len(same) else (h[:0], h[:0])
        rows.append(row[: len(same)][same])
        keys.append(mix64(a * one + b * two + np.uint64(kind)))
    if len(row) > 2:
        same = row[2:] == row[:-2]
        rows.append(row[:-2][same])
        keys.append(mix64(h[:-2][same] * one + h[1:-1][same] * two + h[2:][same] * three))
    return np.concatenate(rows), (np.concatenate(keys) >> np.uint64(64 - BITS)).astype(np.int64)


def text_slices(batch: pa.RecordBatch, most: int = 1 << 20):
    """A batch cut so that each slice has about so many bytes of text; a longer text is a slice by itself."""
    step = max(1, int(batch.num_rows * most / max(batch.column("text").nbytes, 1)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def fit_ftrl(examples: list[np.ndarray], labels: list[int], p: Params) -> Model:
    """FTRL-proximal with one rate per coordinate; the last coordinate is the bias."""
    n_dim = (1 << BITS) + 1
    z, n = np.zeros(n_dim), np.zeros(n_dim)

    def weights(at: np.ndarray) -> np.ndarray:
        l1 = np.where(at == n_dim - 1, 0.0, p.l1)
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1, 0.0)
        return -shrunk / ((p.beta + np.sqrt(n[at])) / p.alpha + p.l2)

    for _ in range(p.epochs):
        for idx, y in zip(examples, labels):
            at = np.append(idx, n_dim - 1)
            w = weights(at)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            rate = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / p.alpha
            z[at] += g - rate * w
            n[at] += g * g
    w = weights(np.arange(n_dim))
    index = np.flatnonzero(w[:-1])
    return Model(index, w[index], float(w[-1]))


def calibrate(model: Model, examples: list[np.ndarray], labels: list[int]) -> Model:
    """The model with its log-odds stretched and moved to what rows outside the fit show (Newton steps; the slope is held near 1)."""
    if len(set(labels)) < 2:
        return model
    dense = np.zeros(1 << BITS)
    dense[model.index] = model.weight
    s, y = np.array([dense[e].sum() for e in examples]) + model.bias, np.array(labels, dtype=np.float64)
    slope, offset = 1.0, 0.0
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(slope * s + offset, -35, 35)))
        q = p * (1 - p)
        gradient = np.array([((p - y) * s).sum() + slope - 1, (p - y).sum()])
        curve = np.array([[(q * s * s).sum() + 1, (q * s).sum()], [(q * s).sum(), q.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(curve, gradient), -1, 1)
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return Model(model.index, slope * model.weight, slope * model.bias + offset) if slope > 0 else model


def fit(examples: list[np.ndarray], labels: list[int], p: Params) -> Model:
    """FTRL on most of the sample, log-odds settled on the rest."""
    rest = range(0, len(labels), p.slice_of)
    most = [i for i in range(len(labels)) if i % p.slice_of]
    if len({labels[i] for i in most}) < 2 or len({labels[i] for i in rest}) < 2:
        return fit_ftrl(examples, labels, p)  # too few rows to keep some aside
    model = fit_ftrl([examples[i] for i in most], [labels[i] for i in most], p)
    return calibrate(model, [examples[i] for i in rest], [labels[i] for i in rest])


def training_rows(docs: DataFrame, labels: DataFrame, p: Params, holdout: tuple[int, int] = (5, 0)) -> DataFrame:
    """The bounded labelled sample: doc_id, text, toxic. Rows of the held-out remainder are not in it."""
    mod, out = holdout
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(crc_bucket("doc_id", mod) != out)
    each = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    few = each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.sample_rows)  # that bounds the broadcast
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(few), "doc_id")


def train(docs: DataFrame, labels: DataFrame, p: Params = Params(), holdout: tuple[int, int] = (5, 0)) -> Model:
    def features(batches):
        for batch in batches:
            for part in text_slices(batch):
                row, idx = grams(part.column("text").to_pylist())
                pair = np.unique(row * (1 << BITS) + idx)
                cut = np.searchsorted(pair >> BITS, np.arange(part.num_rows + 1))
                blobs = [(pair[a:b] & ((1 << BITS) - 1)).astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.array(blobs, pa.binary())], names=["doc_id", "toxic", "idx"])

    def fit_sample(batches):
        # the sample alone, as one array of indices per document: the batches it came in are let go
        ids, labels_, examples = [], [], []
        for batch in batches:
            for part in slices([batch]):
                for doc, y, idx in zip(*[part.column(c).to_pylist() for c in ("doc_id", "toxic", "idx")]):
                    if not ids or ids[-1] != doc:
                        ids.append(doc)
                        labels_.append(y)
                        examples.append(np.frombuffer(idx, dtype=np.int32))
        if ids:
            m = fit(examples, labels_, p)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(m.index, -1)), pa.array(np.append(m.weight, m.bias))], names=["index", "weight"])

    rows = training_rows(docs, labels, p, holdout).mapInArrow(tidied(features), "doc_id long, toxic int, idx binary")
    fitted = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "idx").mapInArrow(tidied(fit_sample), "index long, weight double").toPandas()
    if not len(fitted):
        return Model()
    bias = float(fitted.loc[fitted["index"] < 0, "weight"].iloc[0])
    own = fitted[fitted["index"] >= 0].sort_values("index")
    return Model(own["index"].to_numpy(), own["weight"].to_numpy(), bias)


def score(df: DataFrame, model: Model) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 where the score is at least 0.5) to every row."""
    kept = [f for f in df.schema.fields if f.name not in ("score", "predicted")]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    sent = df.sparkSession.sparkContext.broadcast((model.index, model.weight, model.bias))

    def run(batches):
        index, weight, bias = sent.value
        dense = np.zeros(1 << BITS)
        dense[index] = weight
        for batch in batches:
            for part in text_slices(batch):
                row, idx = grams(part.column("text").to_pylist())
                used = dense[idx] != 0
                pair = np.unique(row[used] * (1 << BITS) + idx[used])
                total = np.bincount(pair >> BITS, weights=dense[pair & ((1 << BITS) - 1)], minlength=part.num_rows) + bias
                p = np.where(total < -700, 0.0, 1.0 / (1.0 + np.exp(-np.clip(total, -700, 700))))
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    return df.mapInArrow(tidied(run), schema)
