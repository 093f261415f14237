"""Substring deduplication by line (or paragraph) hashing.

Every text is cut at its separators; a unit is normalised (lower case, runs of blanks as one,
trimmed) and digested. Digests are grouped over the whole table; the occurrences in the document
with the smallest doc_id stay and later ones go, and so does a repeat within one text after its
first. Blank units always stay. ``min_words`` may spare short units too (by default none is spared): a word is a run
without blanks, and every character of a script that is written without blanks counts as one. ``n_shared`` is the number
of distinct units, long enough, that another document holds too, so that it also marks the document whose occurrence stays.

The minimum per digest is pre-aggregated by each task and staged, only for digests of several
documents; the units then join that table, one row per digest, so a very common line is split
over tasks. Spans are code points of the original text, end exclusive, without the separator.

Defined results: a null or empty text has no units that could go; very long texts are cut whole;
rows that share a doc_id do not remove each other's units (neither ranks earlier) and rows that are
alike get the same spans; units of a row with a null doc_id neither go nor remove others; an empty
table gives an empty table; columns beyond doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.llm.common import stage

SEPARATORS = {"line": "\n", "paragraph": "\n\n"}
MIN_WORDS = 1
BLANKS = re.compile(r"[ \t\r\f]+")
#: Characters of scripts that are written without blanks: kana and Han.
DENSE = "[\u3040-\u30ff\u3400-\u9fff]"
_DENSE = re.compile(DENSE)


def n_words(norm: str) -> int:
    return norm.count(" ") + 1 + (0 if norm.isascii() else len(_DENSE.findall(norm))) if norm else 0


def cut(text: str | None, sep: str, min_words: int) -> list[tuple[int, int, bytes | None]]:
    """Start, end and digest of every unit; no digest for a short one."""
    out, at = [], 0
    for part in text.split(sep) if text else []:
        norm = BLANKS.sub(" ", part.lower()).strip(" ")
        digest = hashlib.blake2b(norm.encode("utf-8", "surrogatepass"), digest_size=16).digest() if n_words(norm) >= max(min_words, 1) else None
        out.append((at, at + len(part), digest))
        at += len(part) + len(sep)
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text: rows alike in both are alike in everything here."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))


def units(docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_hash, start, d1, d2: the first occurrence in its text of every long enough unit."""
    sep = SEPARATORS[unit]

    def run(batches):
        for batch in batches:
            rows, starts, digests = [], [], []
            for r, text in enumerate(batch.column("text").to_pylist()):
                seen = set()
                for start, _, d in cut(text, sep, min_words):
                    if d is not None and d not in seen:
                        seen.add(d)
                        rows.append(r)
                        starts.append(start)
                        digests.append(d)
            pair = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("text_hash").take(at), pa.array(starts, pa.int64()), pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], names=["doc_id", "text_hash", "start", "d1", "d2"])

    return keyed(docs).where("doc_id is not null").mapInArrow(run, T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "text_hash", "start", "d1", "d2")]))


def repeated(docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_hash, starts (of units that an earlier document holds already), n_shared (units that any other document holds)."""
    own = units(docs, unit, min_words)
    first = stage(own.groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("d1", "d2", "first"), "lines-first")
    shared = own.join(first, ["d1", "d2"]).groupBy("doc_id", "text_hash")
    return shared.agg(F.collect_set(F.when(F.col("first") < F.col("doc_id"), F.col("start"))).alias("starts"), F.count_distinct("start").alias("n_shared"))


def dedup(docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text (what stays, joined by the separator), n_units, n_removed, removed_spans (start:end, comma-joined), n_shared."""
    sep = SEPARATORS[unit]
    found = repeated(docs, unit, min_words)
    joined = keyed(docs).join(found, ["doc_id", "text_hash"], "left").select("doc_id", "text", "starts", F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared"))

    def run(batches):
        for batch in batches:
            kept, n, gone, spans = [], [], [], []
            for text, starts in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist()):
                drop, seen, stay, out = set(starts or ()), set(), [], []
                parts = cut(text, sep, min_words)
                for a, b, d in parts:
                    if a in drop or d is not None and d in seen:
                        out.append(f"{a}:{b}")
                    else:
                        stay.append(text[a:b])
                    seen.add(d)
                kept.append(sep.join(stay) if text is not None else None)
                n.append(len(parts))
                gone.append(len(out))
                spans.append(",".join(out))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.string()), batch.column("n_shared")], names=["doc_id", "text", "n_units", "n_removed", "removed_spans", "n_shared"])

    return joined.mapInArrow(run, "doc_id long, text string, n_units long, n_removed long, removed_spans string, n_shared long")


ORACLE = rf"""
with u as (
  select doc_id, pos, part, trim(regexp_replace(lower(part), '[ \t\r\f]+', ' ', 'g'), ' ') as norm,
         sum(length(part) + 1) over (partition by doc_id order by pos) - length(part) - 1 as start
  from (select doc_id, unnest(string_split(text, chr(10))) as part, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents where text <> '')),
w as (select *, case when norm = '' then 0 else length(norm) - length(replace(norm, ' ', '')) + 1 + length(regexp_replace(norm, '[^\x{{3040}}-\x{{30ff}}\x{{3400}}-\x{{9fff}}]', '', 'g')) end >= {MIN_WORDS} as long_enough from u),
f as (select *, min(doc_id) over (partition by norm) as first, max(doc_id) over (partition by norm) as last, row_number() over (partition by doc_id, norm order by pos) as nth from w),
g as (select *, long_enough and (first < doc_id or nth > 1) as gone from f)
select d.doc_id, coalesce(n_units, 0) as n_units, coalesce(n_removed, 0) as n_removed, coalesce(removed_spans, '') as removed_spans,
       coalesce(n_shared, 0) as n_shared, sha256(coalesce(kept, '')) as kept_sha256
from documents d left join (
  select doc_id, count(*) as n_units, count(*) filter (where gone) as n_removed,
         count(*) filter (where long_enough and nth = 1 and first < last) as n_shared,
         string_agg(start || ':' || (start + length(part)), ',' order by pos) filter (where gone) as removed_spans,
         string_agg(part, chr(10) order by pos) filter (where not gone) as kept
  from g group by doc_id) r using (doc_id)
"""
