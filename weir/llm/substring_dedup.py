"""Substring dedup: every window of N words that starts somewhere earlier is removed.

Each chunk of documents hashes all of its windows (Rabin-Karp over word hashes)
and keeps the first of equal ones; the others are removed whatever the rest of
the corpus holds, so a window that fills a third of the corpus costs one entry
a chunk. Firsts are shuffled by hash as packed rows, and each bucket marks all
but the earliest occurrence (document id, then start). Marked starts go back to
their documents, where they merge into maximal intervals of words.

Windows are equal if a 64-bit hash and the bucket, taken from a second hash,
are; with B buckets and n windows some n**2 / (B * 2**65) pairs are equal by chance.
Buckets are by the bytes of the texts: 10**13 windows of 100 TB have 1.5 million,
and so some two such pairs.

Defined results: a null or empty text has no words; a document without an id is
not compared and stays whole; rows that share an id and a text stay alike;
documents shorter than N words stay whole; texts may be long; columns named like
a result or ``removed`` are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.llm import packed as P
from weir.llm.common import bucket_count, chunks, per_bucket

N_WORDS = 20
INTERVALS = "array<struct<start:int,stop:int>>"


def later(keys: np.ndarray, docs: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which entries have an equal key at a smaller (document, place)."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.concatenate(([False], k[1:] == k[:-1]))
    twin = same | np.append(same[1:], False)
    order, k = order[twin], k[twin]
    again = np.lexsort((places[order], docs[order], k))
    order, k = order[again], k[again]
    head = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    group = np.repeat(head, np.diff(np.append(head, len(k))))
    d, p = docs[order], places[order]
    out = np.zeros(len(keys), bool)
    out[order[(d != d[group]) | (p != p[group])]] = True
    return out


def by_id(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.take(pa.array(np.argsort(batch.column(0).to_numpy(), kind="stable")))


def starts_removed(docs: DataFrame, n_words: int, text: str, key: str) -> tuple[DataFrame, int]:
    """Packed rows of kind 1, grouped by document: the starts of windows that are not the earliest; and the number of buckets."""
    buckets = bucket_count(docs, text)

    def hash_chunk(batches):
        for batch in chunks(batches, "text"):
            batch = by_id(batch)
            ids = batch.column("key").to_numpy()
            h, at = P.hashed_words(*P.flat(batch.column("text")))
            where, rows = P.inside_rows(at, n_words)
            a = P.mixed(P.window_hashes(h, n_words, P.STEP_A)[where])
            b = P.mixed(P.window_hashes(h, n_words, P.STEP_B)[where])
            d, p = ids[rows], where - at[rows]
            gone = later(a, d, p)
            first = ~gone
            # a repeated row's windows are neither later nor shipped twice
            bucket = (b % P.U(buckets)).astype(np.int64)
            yield P.pack(bucket[first], a[first], d[first], p[first])
            yield P.pack((P.mixed(d[gone].astype(P.U)) % P.U(buckets)).astype(np.int64), None, d[gone], p[gone], kind=1)

    def compare(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()
        h, d, p = P.unpack(table.filter(pa.array(kinds == 0)))
        gone = later(h, d, p)
        _, d1, p1 = P.unpack(table.filter(pa.array(kinds == 1)))
        d, p = np.concatenate((d[gone], d1)), np.concatenate((p[gone], p1))
        order = np.lexsort((p, d))
        d, p = d[order], p[order]
        return pa.Table.from_batches([P.pack((P.mixed(d.astype(P.U)) % P.U(buckets)).astype(np.int64), None, d, p, kind=1)])

    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    return per_bucket(rows.mapInArrow(hash_chunk, P.SCHEMA), buckets, compare, P.SCHEMA), buckets


def intervals(marks: DataFrame, buckets: int, size: int, key: str) -> DataFrame:
    """(key, removed): the maximal intervals that windows of ``size`` at the marked starts cover."""
    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField("removed", T._parse_datatype_string(INTERVALS))])
    arrow = pa.schema([(key, pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))])

    def merge(table: pa.Table) -> pa.Table:
        _, d, p = P.unpack(table)
        order = np.lexsort((p, d))
        d, p = d[order], p[order]
        new_doc = np.concatenate(([True], d[1:] != d[:-1])) if len(d) else np.zeros(0, bool)
        new = new_doc.copy()
        new[1:] |= p[1:] > p[:-1] + size
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(p)) - 1 if len(heads) else heads
        cells = pa.StructArray.from_arrays([pa.array(p[heads].astype(np.int32)), pa.array((p[tails] + size).astype(np.int32))], ["start", "stop"])
        offsets = np.append(np.searchsorted(heads, np.flatnonzero(new_doc)), len(heads)).astype(np.int32)
        return pa.Table.from_arrays([pa.array(d[new_doc]), pa.ListArray.from_arrays(pa.array(offsets), cells)], schema=arrow)

    return per_bucket(marks, buckets, merge, schema)


def removed_words(docs: DataFrame, n_words: int = N_WORDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, removed): intervals of word numbers to remove, for documents that have any."""
    return intervals(*starts_removed(docs, n_words, text, key), n_words, key)


def deduplicated(docs: DataFrame, n_words: int = N_WORDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text (kept words joined by a space)."""
    keep = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_text", "removed")]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    joined = docs.select(*keep).join(removed_words(docs, n_words, text, key), key, "left").select(*keep, "removed")

    def cut(batches):
        for batch in chunks(batches, text):
            counts, gone, kept = [], [], []
            for t, r in zip(batch.column(text).to_pylist(), batch.column("removed").to_pylist(), strict=True):
                ws = t.encode().split() if t else []
                counts.append(len(ws))
                for x in reversed(r or []):
                    del ws[x["start"] : x["stop"]]
                gone.append(counts[-1] - len(ws))
                kept.append(b" ".join(ws))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], [*keep, "n_words", "n_removed", "kept_text"])

    return joined.mapInArrow(cut, schema)
