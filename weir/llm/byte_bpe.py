"""Byte-level BPE encoding and decoding by merge replay over the corpus's pieces.

The texts of a chunk are cut into pieces by the tokenizer's pattern. Pieces that
are tokens need no merge; the others go, once a group of chunks, to a bucket by
their hash, so that each distinct piece of the corpus is encoded once, in one
bucket, and its ids go back to the groups that have it. The texts themselves travel as numbers of
pieces, beside the columns that are kept, and are never cut twice.

A bucket replays the merges over all its pieces: an inverted index leads from a
merge's rank to the positions of its pairs; the lowest rank with positions is
applied to all of them at once, and only the pairs that touch a merged position
are looked up again. (Pairs that make the same token are one merge, as the
leftmost of them goes first.) Pieces are independent, so this gives each piece
what applying its own lowest-ranked pair again and again would give.

The rank file is a parameter: lines of base64 token and rank, tokens of one byte
for all 256 bytes included.

Defined results: null and empty texts have no ids; special-token strings are
ordinary text; unknown ids cannot be decoded and raise an error; rows are encoded
alike, so repeated rows and rows without an id come through as they are; the
pieces of a long text are not all listed; a column named like the result is
replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weir.llm import packed as P
from weir.llm.common import bucket_count, chunks, per_bucket

#: Text of a chunk in bytes, characters of a group of chunks that number their pieces together, and of a text whose pieces are not listed.
TEXT_BYTES = 8 << 20
GROUP = 16 << 20
LONG = 4 << 20


@lru_cache(maxsize=2)
def tokens(path: str) -> dict[int, bytes]:
    """Tokens by rank."""
    with open(path, "rb") as f:
        return {int(b): base64.b64decode(a) for a, b in map(bytes.split, f) if a}


class Vocabulary:
    """Ranks, and the table of pairs that merge."""

    def __init__(self, path: str):
        self.ranks = {t: r for r, t in tokens(path).items()}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        keys, made = [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    made.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[order]
        self.made = np.array(made, np.int32)[order]

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank that each pair merges to, -1 if none."""
        wanted = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.made[at], np.int32(-1))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _apart(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Positions to merge from left to right, none starting where the one before ends."""
    taken, out = -1, []
    for p, q in zip(at.tolist(), after.tolist(), strict=True):
        if p != taken:
            out.append(p)
            taken = q
    return np.array(out, np.int64)


def replay(pieces: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces one after another, and where each piece begins (with the end)."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    ends = np.cumsum(sizes)
    tok = vocab.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
    n = len(tok)
    nxt = np.arange(1, n + 1, dtype=np.int32)
    nxt[ends - 1] = -1
    prv = np.arange(-1, n - 1, dtype=np.int32)
    prv[ends - sizes] = -1
    rank = np.full(n, -1, np.int32)
    left = np.flatnonzero(nxt >= 0)
    rank[left] = vocab.pair_ranks(tok[left], tok[left + 1])

    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def file(at: np.ndarray) -> None:
        """Positions go to the index under their rank."""
        r = rank[at]
        at, r = at[r >= 0], r[r >= 0]
        if not len(at):
            return
        order = np.argsort(r, kind="stable")
        at, r = at[order], r[order]
        cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
        lo = 0
        for hi, key in zip([*cuts.tolist(), len(at)], r[np.append(0, cuts)].tolist(), strict=True):
            if key in index:
                index[key].append(at[lo:hi])
            else:
                index[key] = [at[lo:hi]]
                heapq.heappush(heap, key)
            lo = hi

    file(left)
    while heap:
        r = heapq.heappop(heap)
        found = index.pop(r)
        at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
        at = at[rank[at] == r]
        if not len(at):
            continue
        after = nxt[at]
        if len(at) > 1 and np.any(after[:-1] == at[1:]):
            at = _apart(at, after)
            after = nxt[at]
        beyond = nxt[after]
        tok[at] = r
        tok[after] = -1
        rank[after] = -1
        nxt[at] = beyond
        inner = beyond >= 0
        prv[beyond[inner]] = at[inner]
        rank[at[~inner]] = -1
        before = prv[at]
        touched = np.concatenate((at[inner], before[before >= 0]))
        if len(touched):
            touched = np.unique(touched)
            rank[touched] = vocab.pair_ranks(tok[touched], tok[nxt[touched]])
            file(touched)
    alive = tok >= 0
    starts = np.concatenate(([0], np.cumsum(alive)))[np.concatenate((ends - sizes, [n]))]
    return tok[alive], starts


class Pieces(dict):
    """Numbers pieces in the order they are first met."""

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        return n


ARROW = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("chunk", pa.binary()), ("data", pa.binary()), ("kept", pa.binary())])
SCHEMA = "kind string, bucket int, chunk binary, data binary, kept binary"


def _rows(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [()] * len(ARROW)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, ARROW.types, strict=True)], schema=ARROW)


def cut(path: str, pattern: str, text: str, keep: list[str], buckets: int):
    """Of each group of chunks its texts as numbers of pieces, and for each bucket the pieces that are no token themselves."""

    def run(batches):
        import regex

        find, ranks = regex.compile(pattern), vocabulary(path).ranks

        def close(pieces: Pieces, group: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]) -> pa.Table:
            frequent = np.argsort(-sum(np.bincount(flat, minlength=len(pieces)) for _, flat, _ in group), kind="stable")
            number = np.empty(len(frequent), np.int32)  # small numbers for frequent pieces
            number[frequent] = np.arange(len(frequent))
            raw = list(pieces)
            raw = [raw[k].encode() for k in frequent.tolist()]
            whole = np.array([ranks.get(p, -1) for p in raw], np.int64)
            digest, texts = hashlib.blake2b(b"\0".join(raw), digest_size=16), []
            for batch, flat, lengths in group:
                kept = pa.BufferOutputStream()
                with pa.ipc.new_stream(kept, batch.schema) as out:
                    out.write_batch(batch)
                texts.append((P.blob(number[flat], lengths), kept.getvalue().to_pybytes()))
                for part in texts[-1]:
                    digest.update(part)
            chunk = digest.digest()
            home = int.from_bytes(chunk[:4]) % buckets
            rows = [("texts", home, chunk, data, kept) for data, kept in texts] + [("whole", home, chunk, P.blob(whole + 1), b"")]
            rest = np.flatnonzero(whole < 0)
            to = np.array([zlib.crc32(raw[k]) % buckets for k in rest.tolist()], np.int64)
            order = np.argsort(to, kind="stable")
            rest, to = rest[order], to[order]
            bounds = np.flatnonzero(np.diff(to, prepend=-1))
            for lo, hi in zip(bounds.tolist(), [*bounds[1:].tolist(), len(rest)][: len(bounds)], strict=True):
                some = [raw[k] for k in rest[lo:hi].tolist()]
                data = P.blob(np.diff(rest[lo:hi], prepend=0), np.array([len(p) for p in some], np.int64), np.frombuffer(b"".join(some), np.uint8))
                rows.append(("pieces", int(to[lo]), chunk, data, b""))
            return _rows(rows)

        pieces, group, held = Pieces(), [], 0
        for batch in chunks(batches, text, TEXT_BYTES):
            number, rows = pieces.__getitem__, []
            for v in batch.column(text):
                t = v.as_py() or ""
                found = find.findall(t) if len(t) < LONG else (m[0] for m in find.finditer(t))
                rows.append(np.fromiter(map(number, found), np.int32))
                held += len(t)
            group.append((batch.select(keep), np.concatenate([np.zeros(0, np.int32), *rows]), np.array([len(r) for r in rows], np.int64)))
            if held >= GROUP:
                yield from close(pieces, group).to_batches()
                pieces, group, held = Pieces(), [], 0
        if group:
            yield from close(pieces, group).to_batches()

    return run


def encoded(path: str):
    """The ids of the pieces of a bucket, each distinct one encoded once, for the groups that have them. Other rows pass."""

    def run(table: pa.Table) -> pa.Table:
        texts = pa.array([k != "pieces" for k in table.column("kind").to_pylist()], pa.bool_())
        asked = table.filter(pc.invert(texts))
        pieces, numbers, of = Pieces(), [], []
        for data in asked.column("data").to_pylist():
            steps, sizes, raw = P.unblob(data)
            raw, ends = raw.tobytes(), np.cumsum(sizes.astype(np.int64))
            numbers.append(steps)
            of.append(np.fromiter((pieces[raw[a:b]] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)), np.int64, len(ends)))
        if not pieces:
            return table.filter(texts)
        ids, starts = replay(list(pieces), vocabulary(path))
        sizes = np.diff(starts)
        out = []
        for chunk, steps, k in zip(asked.column("chunk").to_pylist(), numbers, of, strict=True):
            out.append(("ids", 0, chunk, P.blob(steps, sizes[k], ids[expanded(starts[k], sizes[k])]), b""))
        return pa.concat_tables([table.filter(texts), _rows(out)])

    return run


def expanded(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as many as its size."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def joined(ids_type: pa.Schema):
    """The rows of a group with the ids of their pieces. Groups of equal content meet here; their rows are given as often."""

    def run(table: pa.Table) -> pa.Table:
        of_kind = lambda kind: [k for k, x in enumerate(table.column("kind").to_pylist()) if x == kind]
        whole = P.unblob(table.column("data")[of_kind("whole")[0]].as_py())[0].astype(np.int64)
        size = (whole > 0).astype(np.int64)
        start = np.cumsum(size) - size
        flat, n = [whole[whole > 0] - 1], int(size.sum())
        for k in of_kind("ids"):
            steps, sizes, ids = P.unblob(table.column("data")[k].as_py())
            number, sizes = np.cumsum(steps.astype(np.int64)), sizes.astype(np.int64)
            size[number] = sizes
            start[number] = n + np.cumsum(sizes) - sizes
            flat.append(ids.astype(np.int64))
            n += len(ids)
        every, out = np.concatenate(flat).astype(np.int32), []
        for k in of_kind("texts"):
            sequence, lengths = P.unblob(table.column("data")[k].as_py())
            tokens = size[sequence]
            ids = every[expanded(start[sequence], tokens)]
            ends = np.concatenate(([0], np.cumsum(tokens)))[np.concatenate(([0], np.cumsum(lengths.astype(np.int64))))]
            cells = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)).cast(ids_type.field(0).type)
            with pa.ipc.open_stream(table.column("kept")[k].as_py()) as kept:
                columns = kept.read_all()
            out.append(columns.append_column(ids_type.field(0), cells) if columns.num_columns else pa.table([cells], schema=ids_type))
        return pa.concat_tables(out)

    return run


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns in ``keep``, all by default) with ``ids``, the token ids of ``text``."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != ids]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(ids, T.ArrayType(T.IntegerType()))])
    docs = docs.select(*dict.fromkeys([*keep, text]))
    buckets = bucket_count(docs, text)
    shipped = docs.mapInArrow(cut(path, pattern, text, keep, buckets), SCHEMA)
    answered = per_bucket(shipped, buckets, encoded(path), SCHEMA)
    return answered.groupBy("chunk").applyInArrow(joined(pa.schema([(ids, pa.list_(pa.int32()))])), schema)


def decode(docs: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``out``, the bytes that ``ids`` stand for; null ids have null bytes."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != out]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(out, T.BinaryType())])
    docs = docs.select(*dict.fromkeys([*keep, ids]))

    def run(batches):
        token = tokens(path).__getitem__
        for batch in batches:
            rows = [b"".join(map(token, r.values.to_numpy().tolist())) if r.is_valid else None for r in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(rows, pa.binary())], [*keep, out])

    return docs.mapInArrow(run, schema)
