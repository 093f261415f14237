"""Language identification by cross-parsing entropy.

Labelled text of each language goes into a suffix automaton. A text is cut greedily into the
longest phrases that occur in that labelled text: each step follows one transition; where there is
none a phrase ends and the next begins with that character (or, if the language lacks it, after it). By the
cross-parsing estimate of entropy a phrase of a language stands for log2 of the length of its
labelled text in bits, so phrases are counted in these units: unequal samples compare. The language
with the fewest normalised phrases wins; ties go to the alphabetically first.

Text is lower-cased, and a run of what is not a letter counts as one blank. Texts are parsed whole.
Numpy follows many segments of SEGMENT characters side by side, each from the root at first; then the
state in which a segment really begins, the end of the one before, is followed until it meets the
state found from the root, from where on both are the same, so the phrases are those of an uncut parse.

``train`` takes a bounded sample: in each language, per slot of a hash of doc_id the row with the
smallest hash, at most ``slots`` rows; of a text over ``chars`` characters a stretch of that length, at an
offset by the hash. Everything else covers all rows.

Defined results: a null text, or one without a letter, is ``und`` with score 0; without any
labelled row all are ``und``; very long texts are parsed whole; repeated rows get the same answer,
each by itself; an empty table gives an empty table; extra columns are kept, those named like the
output (``lang_pred``, ``score``) are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.llm.common import crc_bucket

SEGMENT = 1024
FLAG = np.uint32(1 << 31)
_PARSERS: dict[int, "Parser"] = {}


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the root."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return go


def letters(text: str) -> str:
    return "".join(c if c.isalpha() else " " for c in text.lower())


class Parser:
    """The automata of all languages in one table: row = state, column = character code."""

    def __init__(self, samples: dict[str, list[str]]):
        self.langs = sorted(samples)
        texts = {k: " ".join(" ".join(letters(t).split()) for t in samples[k]) for k in self.langs}
        self.code = {c: i for i, c in enumerate(sorted(set(" ").union(*texts.values())))}
        self.unknown = len(self.code)
        self.width = self.unknown + 1
        self.bits = np.log2([max(len(texts[k]), 2) for k in self.langs])
        tables, self.roots, base = [], [], 0
        for k in self.langs:
            go = suffix_automaton([self.code[c] for c in texts[k]])
            t = np.full((len(go), self.width), -1, dtype=np.int64)
            for s, moves in enumerate(go):
                if moves:
                    t[s, list(moves)] = list(moves.values())
            again = np.where(t[0] < 0, 0, t[0])  # a character that the language lacks is a phrase by itself
            full = np.where(t < 0, again[None, :] | int(FLAG), t) + base
            tables.append(full.astype(np.uint32))
            self.roots.append(base)
            base += len(go)
        # places in the table, which may be more than 32 bits count
        self.wide = np.uint32 if base * self.width < 1 << 32 else np.uint64
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, dtype=np.uint32)
        self.of: dict[int, int] = {}

    def codes(self, text: str) -> tuple[np.ndarray, bool]:
        """Character codes with runs of non-letters as one blank, and whether there is a letter."""
        point = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        top = 0x250 if len(point) and point.max() < 0x250 else 0x110000
        new = [p for p in np.flatnonzero(np.bincount(point, minlength=1)).tolist() if p not in self.of] if top == 0x250 else [p for p in np.unique(point).tolist() if p not in self.of]
        for p in new:
            c = chr(p).lower()
            self.of[p] = self.code.get(c[0], self.unknown) if c[0].isalpha() else 0
        if new or not hasattr(self, "low"):
            self.low = np.array([self.of.get(p, 0) for p in range(0x250)], dtype=np.uint8 if self.width < 256 else np.int32)
        if top == 0x250:
            code = self.low[point]
        else:
            u, back = np.unique(point, return_inverse=True)
            code = np.array([self.of[p] for p in u.tolist()])[back]
        keep = code != 0
        some = bool(keep.any())
        keep[1:] |= code[:-1] != 0
        return code[keep], some

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases per language and row, and whether the row has a letter."""
        seg_row, segs, some = [], [], np.zeros(len(texts), dtype=bool)
        for i, t in enumerate(texts):
            if not t:
                continue
            code, some[i] = self.codes(t)
            if some[i]:
                for at in range(0, len(code), SEGMENT):
                    seg_row.append(i)
                    segs.append(code[at : at + SEGMENT])
        total = np.repeat(some[None, :].astype(np.int64), len(self.langs), axis=0)
        if segs and self.langs:
            rows = np.array(seg_row)
            breaks = self.breaks(segs, rows)
            for k in range(len(self.langs)):
                total[k] += np.bincount(rows, weights=breaks[k], minlength=len(texts)).astype(np.int64)
        return total, some

    def breaks(self, segs: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
        """Phrases that end in each segment, per language; segments of one row follow each other."""
        length = np.array([len(s) for s in segs])
        order = np.argsort(-length, kind="stable")
        length = length[order]
        lane = np.empty(len(order), dtype=np.int64)
        lane[order] = np.arange(len(order))
        grid = np.zeros((int(length[0]), len(segs)), dtype=np.uint32)
        for at, k in enumerate(order.tolist()):
            grid[: len(segs[k]), at] = segs[k]
        root = np.array(self.roots, dtype=np.uint32)
        state = np.repeat(root[:, None], len(segs), axis=1)
        count = np.zeros((len(root), len(segs)), dtype=np.int64)
        active = np.searchsorted(-length, -np.arange(len(grid)), side="left")
        width, wide = self.wide(self.width), lambda x: x.astype(self.wide, copy=False)
        low = np.uint32(0x7FFFFFFF)
        for t, n in enumerate(active.tolist()):
            v = self.table[wide(state[:, :n]) * width + grid[t, :n]]
            count[:, :n] += v >> np.uint32(31)
            state[:, :n] = v & low
        # where a segment really begins: the end of the one before, followed until it meets the walk from the root
        after = np.flatnonzero(rows[1:] == rows[:-1]) + 1
        before_of, lanes = np.full(len(segs), -1), lane[after]
        before_of[lanes] = lane[after - 1]
        after_of = np.full(len(segs), -1)
        after_of[before_of[lanes]] = lanes
        more, met = np.zeros_like(count), state.copy()
        lang, at = np.repeat(np.arange(len(root)), len(lanes)), np.tile(lanes, len(root))
        while len(at):
            own, free = state[lang, before_of[at]], root[lang]
            extra = np.zeros(len(at), dtype=np.int64)
            live = np.flatnonzero(own != free)
            own, free = own[live], free[live]
            new = met[lang, at]
            t = 0
            while len(live):
                c = grid[t, at[live]]
                v, w = self.table[wide(own) * width + c], self.table[wide(free) * width + c]
                extra[live] += (v >> np.uint32(31)).astype(np.int64) - (w >> np.uint32(31))
                own, free = v & low, w & low
                t += 1
                apart = own != free
                over = apart & (length[at[live]] == t)
                if over.any():  # never met: the segment ends in another state
                    new[live[over]] = own[over]
                stay = apart & ~over
                live, own, free = live[stay], own[stay], free[stay]
            more[lang, at] = extra
            moved = state[lang, at] != new
            lang, at, new = lang[moved], at[moved], new[moved]
            state[lang, at] = new
            lang, at = lang[after_of[at] >= 0], after_of[at][after_of[at] >= 0]
        return (count + more)[:, lane]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        total, some = self.phrases(texts)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        need = total * self.bits[:, None]
        best = np.argmin(need, axis=0)
        ordered = np.sort(need, axis=0)
        least, next_ = ordered[0], ordered[1] if len(self.langs) > 1 else ordered[0] * 2
        score = np.where(some, 1.0 - least / np.maximum(next_, 1), 0.0)
        return [self.langs[b] if s else "und" for b, s in zip(best.tolist(), some.tolist())], score


def sample(docs: DataFrame, holdout: tuple[int, int] = (4, 2), slots: int = 128, chars: int = 2000) -> dict[str, list[str]]:
    """The bounded labelled sample: texts by language."""
    mod, out = holdout
    known = docs.select("doc_id", "text", "lang").where("doc_id is not null and text is not null and lang is not null").where(crc_bucket("doc_id", mod) != out)
    hashed = known.withColumn("h", F.xxhash64("doc_id")).withColumn("slot", F.pmod("h", F.lit(slots)))
    first = hashed.groupBy("lang", "slot").agg(F.min("h").alias("h"))  # at most slots rows a language
    offset = F.pmod("h", F.greatest(F.length("text") - chars, F.lit(0)) + 1).cast("int")
    texts = hashed.join(F.broadcast(first), ["lang", "slot", "h"]).select("lang", "h", F.substr("text", offset + 1, F.lit(chars)).alias("text")).dropDuplicates(["lang", "h"])
    got: dict[str, set[str]] = {}
    for lang, _, text in texts.toPandas().itertuples(index=False):
        got.setdefault(lang, set()).add(text)
    return {k: sorted(v) for k, v in got.items() if any(letters(t).strip() for t in v)}


def predict(df: DataFrame, samples: dict[str, list[str]]) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to every row. Each worker builds the automata once."""
    kept = [f for f in df.schema.fields if f.name not in ("lang_pred", "score")]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    sent = df.sparkSession.sparkContext.broadcast(samples)

    def run(batches):
        key = hash(tuple((k, tuple(v)) for k, v in sorted(sent.value.items())))
        if key not in _PARSERS:
            _PARSERS.clear()
            _PARSERS[key] = Parser(sent.value)
        parser = _PARSERS[key]
        for batch in batches:
            step = max(1, int(batch.num_rows * (1 << 20) / max(batch.column("text").nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                lang, score = parser.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array(lang, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    return df.mapInArrow(run, schema)
