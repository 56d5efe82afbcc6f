"""LM scoring: a hierarchical Pitman-Yor model over words, with contexts of two words.

The restaurant of a context (the two words before) seats the words that follow;
a word that opens a table there sends a customer to the restaurant of the last
word alone, which all contexts that end in it share, and tables there send
customers to the root, which all words share and which seats over a uniform base
of the known words and one unknown. Contexts are the words themselves (by
48 bits of a hash); there are as many restaurants as the training texts have contexts.

Seating is kept as the number of tables of each type, a dish in a restaurant. A
Gibbs sweep draws each type's tables anew from their exact conditional given all
others: for c customers, t tables have weight S(c, t) * product over k < t of
(strength + discount * (others' tables + k)) * p ** t, with S the generalized
Stirling numbers of the discount and p the parent's probability of the dish
(``stirling.draw``; the same law for all c). All types of a sweep are drawn at
once, given the totals and parents of the sweep before. Predictive probabilities
of the kept sweeps are averaged. Random numbers are hashes of type and sweep, so
a score does not depend on partitions, buckets or the order of rows.

Jobs, each of whose results is a table in the shared folder:

1. ``start``: every (context, word) of a chunk goes, with its training count, to
   the bucket of the context's last word. A bucket keeps what sweeps need and
   sends each word's customers at the root to the word's bucket.
2. Per sweep, ``root_step``: buckets of words seat the root, and answer; then
   ``sweep_step``: buckets of contexts draw their two levels and send again.
   Totals of the root are exact sums over all buckets.
3. ``score``: the types come again, with the documents that have them; a bucket
   scores each type once and adds up for the documents of each chunk, and the
   sums of a chunk meet in one row a document.

A last word with more than HOT_TOKENS estimated tokens is split by the word
before it: its contexts stay whole, and its own restaurant is seated in the
buckets of the words that follow it, from exact sums of its parts. The estimate
comes from a share of all texts and steers only what is computed where.

Defined results: every row is returned, repeated rows each; rows that share an id
are documents of their own; a null or empty text has one token, the end; rows
without an id are scored but not learned from, and their held_out is null; an
empty table gives an empty result; without training rows every probability is
that of the base; texts may be of any length; other columns play no part.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm import packed as P
from weir.llm.common import chunks, discard, grouped, saved
from weir.llm.stirling import draw

#: Discounts and strengths of the root, of one word and of two.
DISCOUNTS, STRENGTHS = (0.6, 0.75, 0.8), (10.0, 1.0, 1.0)
BURN_IN, SAMPLES = 2, 2
SEED = 20240501
#: Bytes of text whose types make a bucket, and estimated tokens that split a last word.
BUCKET_BYTES, HOT_TOKENS = 6 << 20, 2_000_000
#: Share of the rows that words are counted in for that estimate.
HOT_SHARE = 0.02
#: Words are the low 48 bits of a hash: of 100 million words some 18 pairs are taken for one.
BITS = 48
WORD = P.U((1 << BITS) - 1)
END, START = P.U(0xE2D0E2D0E2D0), P.U(0x57A2757A2757)
#: Scores are added up in units of 2**-32, as whole numbers, so that no order of adding matters.
UNIT = 2.0**32
#: Types that are scored in one step, and bytes of text that make a chunk.
STEP, CHUNK = 1 << 18, 6 << 20

ARROW = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("source", pa.int32()), ("a", pa.float64()), ("b", pa.float64()), ("data", pa.binary()), ("chunk", pa.binary())])
SCHEMA = "kind string, bucket int, source int, a double, b double, data binary, chunk binary"


def rows_of(rows: list[tuple]) -> pa.Table:
    """Rows of (kind, bucket, source, a, b, data, chunk)."""
    columns = zip(*rows, strict=True) if rows else [()] * len(ARROW)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, ARROW.types, strict=True)], schema=ARROW)


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 10 == 0


@dataclass
class Plan:
    """How types are dealt: the number of buckets, and the hot last words (sorted hashes) with their parts."""

    buckets: int
    hot: np.ndarray
    parts: np.ndarray

    def hot_number(self, v: np.ndarray) -> np.ndarray:
        """Place in ``hot``, -1 if not there."""
        if not len(self.hot):
            return np.full(len(v), -1)
        at = np.minimum(np.searchsorted(self.hot, v), len(self.hot) - 1)
        return np.where(self.hot[at] == v, at, -1)

    def bucket(self, v: np.ndarray, x: np.ndarray) -> np.ndarray:
        at = self.hot_number(v)
        h = P.mixed(v)
        if (at >= 0).any():
            part = P.mixed(x ^ P.STEP_A) % self.parts[at].astype(P.U)
            h = np.where(at >= 0, P.mixed(v + (part + P.U(1)) * P.STEP_B), h)
        return ((h >> P.U(32)) * P.U(self.buckets) >> P.U(32)).astype(np.int64)

    def home(self, w: np.ndarray) -> np.ndarray:
        """The bucket of a word at the root; rises with the hash."""
        return ((w >> P.U(BITS - 32)) * P.U(self.buckets) >> P.U(32)).astype(np.int64)


def heads(*keys: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the one before."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def sizes(head: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(head, n))


def triple_key(v: np.ndarray, w: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """One number for each (v, w, x) of numbers below ``n``, in their order."""
    pair = v.astype(np.int64) * n + w
    if n >= 2_000_000:  # three would not fit in 63 bits: pairs are numbered first
        pair = np.unique(pair, return_inverse=True)[1]
    return pair * n + x


# --- from texts to types ----------------------------------------------------


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of a chunk, and of each token its row, and the numbers of its word and of the two before."""
    h, at = P.hashed_words(*P.flat(batch.column("text")), lower=True)
    n = np.diff(at) + 1
    row = np.repeat(np.arange(len(n), dtype=np.int32), n)
    last = np.cumsum(n) - 1
    word = np.full(len(row) + 1, END, P.U)
    inside = np.ones(len(row), bool)
    inside[last] = False
    word[:-1][inside] = h & WORD
    word[-1] = START
    names, number = np.unique(word, return_inverse=True)
    number = number.astype(np.int32)
    w, start, first = number[:-1], number[-1], last - n + 1
    v, x = np.empty_like(w), np.empty_like(w)
    v[1:], x[2:] = w[:-1], w[:-2]
    v[first] = x[first] = start
    x[(first + 1)[n > 1]] = start
    return names, row, v, w, x


def ship(plan: Plan, with_rows: bool):
    """Packed types of each chunk for each bucket; ``with_rows`` the rows that have them too, and a head with the chunk's ids."""

    def run(batches):
        for batch in chunks(batches, "text", CHUNK):
            ids = batch.column("key").to_pylist()
            train = np.array([i is not None and not is_held_out(i) for i in ids], bool)
            names, row, v, w, x = _tokens(batch)
            key = triple_key(v, w, x, len(names))
            order = np.argsort(key)
            key, row = key[order], row[order]
            head = heads(key)
            count = np.add.reduceat(train[row].astype(np.int64), head) if len(head) else head
            many = sizes(head, len(row))
            v, w, x = v[order][head], w[order][head], x[order][head]
            del key, order
            bucket = plan.bucket(names[v], names[x])
            by = np.argsort(bucket.astype(np.uint16) if plan.buckets < 65536 else bucket, kind="stable")
            rank = np.zeros(len(names), np.int32)
            chunk, out = b"", []
            if with_rows:
                data, offsets = P.flat(batch.column("text"))
                chunk = hashlib.blake2b(repr(ids).encode() + offsets.tobytes() + data.tobytes(), digest_size=16).digest()
                known = np.array([i or 0 for i in ids], np.int64)
                there = np.array([i is not None for i in ids], np.int64)
                tokens = np.bincount(row, minlength=len(ids))
                out.append(("head", int.from_bytes(chunk[:4]) % plan.buckets, 0, 0.0, 0.0, P.blob(known.view(P.U), there, tokens), chunk))
            cut = heads(bucket[by])
            for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(by)][: len(cut)], strict=True):
                k = by[lo:hi]
                a, b, c = v[k], w[k], x[k]
                times = sum(np.bincount(y, minlength=len(names)) for y in (a, b, c))
                used = np.flatnonzero(times)
                used = used[np.argsort(-times[used])]  # small numbers for frequent words
                rank[used] = np.arange(len(used), dtype=np.int32)
                run_ = heads(a)
                fields = [names[used], rank[a[run_]], sizes(run_, len(a)), rank[b], rank[c], count[k]]
                if with_rows:
                    m = many[k]
                    at = np.repeat(head[k], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                    fields += [m, row[at]]
                out.append(("types", int(bucket[k[0]]), 0, 0.0, 0.0, P.blob(*fields), chunk))
            yield from rows_of(out).to_batches()

    return run


@dataclass
class Bucket:
    """Distinct types of a bucket in order of (last word, word, word before): numbers in ``names``, and training counts."""

    names: np.ndarray
    v: np.ndarray
    w: np.ndarray
    x: np.ndarray
    count: np.ndarray
    of: list[np.ndarray]  # of each packed row, the type of each of its entries


def merged(data: list[list[np.ndarray]]) -> Bucket:
    names, number = np.unique(np.concatenate([d[0].astype(P.U) for d in data]), return_inverse=True)
    number = number.astype(np.int32)
    vs, ws, xs, at = [], [], [], 0
    for d in data:
        local = number[at : at + len(d[0])]
        at += len(d[0])
        vs.append(np.repeat(local[d[1]], d[2].astype(np.int64)))
        ws.append(local[d[3]])
        xs.append(local[d[4]])
    v, w, x = map(np.concatenate, (vs, ws, xs))
    key = triple_key(v, w, x, len(names))
    order = np.argsort(key)
    head = heads(key[order])
    of, first = np.empty(len(key), np.int32), order[head]
    of[order] = np.repeat(np.arange(len(head), dtype=np.int32), sizes(head, len(key)))
    del key, order
    count = np.bincount(of, np.concatenate([d[5] for d in data]).astype(np.float64), len(first)).astype(np.int64)
    return Bucket(names, v[first], w[first], x[first], count, np.split(of, np.cumsum([len(x) for x in xs])[:-1]))


# --- the seating of a bucket --------------------------------------------------


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return P.mixed(v * P.STEP_A + w)


def uniform(key: np.ndarray, sweep: int, level: int) -> np.ndarray:
    salt = P.mixed(np.array([SEED + 3 * sweep + level], P.U))
    return ((P.mixed(key ^ salt) >> P.U(11)).astype(np.float64) + 0.5) / 2.0**53


@dataclass
class Seats:
    """What sweeps need of a bucket. A pair is a word after a last word; types with one customer have one table for good.

    Pairs of last words that are not hot and have more than one customer are ``live`` here; those of hot
    last words are seated at the root's buckets; the others have one customer and one table."""

    words: np.ndarray  # hashes of the words that follow anything here, sorted
    still: np.ndarray  # customers at the root that pairs of one customer send, of each word
    v_still: np.ndarray  # pairs of one customer, of each last word
    live_v: np.ndarray
    live_w: np.ndarray
    live_ones: np.ndarray  # types of one customer in a live pair
    live_key: np.ndarray
    hot_v: np.ndarray  # places in Plan.hot
    hot_w: np.ndarray
    hot_ones: np.ndarray
    type_pair: np.ndarray  # of each type of several customers its pair: live ones, then hot ones
    type_context: np.ndarray
    type_count: np.ndarray
    type_key: np.ndarray
    context_ones: np.ndarray  # types of one customer, of each context of such types

    def packed(self) -> bytes:
        return P.blob(*self.__dict__.values())

    @classmethod
    def unpacked(cls, data: bytes) -> Seats:
        hashes = {"words", "live_key", "type_key"}
        return cls(**{k: a.astype(P.U if k in hashes else np.int64) for k, a in zip(cls.__dataclass_fields__, P.unblob(data), strict=True)})

    def customers(self, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of live and of hot pairs, given the tables of types."""
        n = len(self.live_v)
        sums = np.bincount(self.type_pair, tables, n + len(self.hot_v)).astype(np.int64)
        return self.live_ones + sums[:n], self.hot_ones + sums[n:]

    def requests(self, plan: Plan, bucket: int, tables: np.ndarray, pair_tables: np.ndarray) -> list[tuple]:
        """Customers for the root and for hot last words, a row for each bucket of words."""
        at_root = self.still + np.bincount(self.live_w, pair_tables, len(self.words)).astype(np.int64)
        _, hot = self.customers(tables)
        home = plan.home(self.words)
        cut = heads(home)
        out = []
        for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(home)][: len(cut)], strict=True):
            a, b = np.searchsorted(self.hot_w, (lo, hi))
            out.append(("request", int(home[lo]), bucket, 0.0, 0.0, P.blob(self.words[lo:hi], at_root[lo:hi], self.hot_v[a:b], self.hot_w[a:b] - lo, hot[a:b]), b""))
        return out


@dataclass
class Places:
    """Of each type of a bucket: its pair and context, and where these are in Seats (live and hot numbers are -1 where there is none)."""

    pair: np.ndarray
    context: np.ndarray
    pair_word: np.ndarray
    pair_v: np.ndarray
    pair_live: np.ndarray
    pair_hot: np.ndarray
    pair_trained: np.ndarray
    several: np.ndarray  # types with more than one customer


def seated(b: Bucket, plan: Plan) -> tuple[Seats, Places, np.ndarray]:
    """The seats of a bucket, places of its types, and which last words (by number in ``Places.pair_v``) they have."""
    n = len(b.names)
    head = heads(b.v, b.w)
    pair = np.repeat(np.arange(len(head)), sizes(head, len(b.v)))
    pv, pw = b.v[head], b.w[head]
    v_numbers, v_of = np.unique(pv, return_inverse=True)
    words, w_of = np.unique(pw, return_inverse=True)
    one, several = b.count == 1, b.count > 1
    ones = np.bincount(pair, one, len(head)).astype(np.int64)
    more = np.bincount(pair, several, len(head)) > 0
    hot_v = plan.hot_number(b.names[pv])
    hot = hot_v >= 0
    live = ~hot & (more | (ones > 1))
    still = ~hot & ~more & (ones == 1)
    live_at, hot_at = np.flatnonzero(live), np.flatnonzero(hot)
    hot_at = hot_at[np.lexsort((hot_v[hot_at], w_of[hot_at]))]  # by word, as requests are cut
    live_number, hot_number = np.full(len(head), -1), np.full(len(head), -1)
    live_number[live_at], hot_number[hot_at] = np.arange(len(live_at)), np.arange(len(hot_at))
    _, context = np.unique(b.v.astype(np.int64) * n + b.x, return_inverse=True)
    context_used, type_context = np.unique(context[several], return_inverse=True)
    s = Seats(
        words=b.names[words],
        still=np.bincount(w_of[still], minlength=len(words)),
        v_still=np.bincount(v_of[still], minlength=len(v_numbers)),
        live_v=v_of[live_at],
        live_w=w_of[live_at],
        live_ones=ones[live_at],
        live_key=pair_key(b.names[pv[live_at]], b.names[pw[live_at]]),
        hot_v=hot_v[hot_at],
        hot_w=w_of[hot_at],
        hot_ones=ones[hot_at],
        type_pair=np.where(hot[pair[several]], len(live_at) + hot_number[pair[several]], live_number[pair[several]]),
        type_context=type_context,
        type_count=b.count[several],
        type_key=P.mixed(pair_key(b.names[b.v[several]], b.names[b.w[several]]) * P.STEP_B + b.names[b.x[several]]),
        context_ones=np.bincount(context, one)[context_used].astype(np.int64) if len(context_used) else context_used,
    )
    return s, Places(pair, context, w_of, v_of, live_number, hot_number, (ones > 0) | more, several), v_numbers


@dataclass
class Totals:
    """Exact sums over all buckets: customers and tables at the root and of hot last words."""

    root: tuple[float, float]
    hot: np.ndarray  # n x 2
    outcomes: float  # known words and one unknown

    def at_root(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        c, t = self.root
        return (customers - DISCOUNTS[0] * tables + (STRENGTHS[0] + DISCOUNTS[0] * t) / self.outcomes) / (STRENGTHS[0] + c)


def shrunk(level: int, own_c, own_t, all_c, all_t, below) -> np.ndarray:
    """A restaurant's probability of a dish; without customers its parent's."""
    d, s = DISCOUNTS[level], STRENGTHS[level]
    return np.where(all_c > 0, (own_c - d * own_t + (s + d * all_t) * below) / (s + all_c), below)


@dataclass
class Answer:
    """From the root's buckets: probability at the root of each word, and customers and tables of hot pairs."""

    root: np.ndarray
    hot: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, bytes]], totals: Totals) -> Answer:
        parts = [P.unblob(data) for _, data in sorted(rows)]
        customers, tables, hot_c, hot_t = (np.concatenate([p[k] for p in parts] + [np.zeros(0, P.U)]).astype(np.float64) for k in range(4))
        return cls(totals.at_root(customers, tables), np.stack((hot_c, hot_t), axis=1))


def pair_probabilities(s: Seats, tables: np.ndarray, pair_tables: np.ndarray, answer: Answer, totals: Totals) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of live and then hot pairs the probability after the last word; and the last words' customers and tables."""
    live, _ = s.customers(tables)
    c = s.v_still + np.bincount(s.live_v, live, len(s.v_still))
    t = s.v_still + np.bincount(s.live_v, pair_tables, len(s.v_still))
    here = shrunk(1, live, pair_tables, c[s.live_v], t[s.live_v], answer.root[s.live_w])
    of_hot = totals.hot[s.hot_v]
    there = shrunk(1, answer.hot[:, 0], answer.hot[:, 1], of_hot[:, 0], of_hot[:, 1], answer.root[s.hot_w])
    return np.concatenate((here, there)), c, t


# --- tasks ----------------------------------------------------------------------


def _of_kind(table: pa.Table, kind: str) -> list[tuple]:
    """(source, data, chunk) of the rows of a kind."""
    rows = table.filter(pa.array([k == kind for k in table.column("kind").to_pylist()], pa.bool_()))
    return list(zip(*(rows.column(c).to_pylist() for c in ("source", "data", "chunk")), strict=True))


def start(plan: Plan):
    """A bucket's seats, its first seating (one table a type), requests, and training counts: all, distinct, starts and hot words."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        b = merged([P.unblob(data) for _, data, _ in _of_kind(table, "types")])
        s, _, v_numbers = seated(b, plan)
        tables, pair_tables = np.ones(len(s.type_count), np.int64), np.ones(len(s.live_v), np.int64)
        used, v_of = np.unique(b.v, return_inverse=True)
        counts = np.bincount(v_of, b.count, len(used))
        hashes = b.names[used]
        number = plan.hot_number(hashes)
        plain = (number < 0) & (hashes != START)
        out = [
            ("seats", bucket, 0, 0.0, 0.0, s.packed(), b""),
            ("seating", bucket, 0, 0.0, 0.0, P.blob(tables, pair_tables), b""),
            ("sum", -1, 0, float(counts[plain].sum()), float((counts[plain] > 0).sum()), b"", b""),
            ("sum", -2, 0, float(counts[(hashes == START) & (number < 0)].sum()), 0.0, b"", b""),
            *[("sum", int(k), 0, float(c), 0.0, b"", b"") for k, c in zip(number[number >= 0], counts[number >= 0], strict=True)],
            *s.requests(plan, bucket, tables, pair_tables),
        ]
        return rows_of(out)

    return run


def root_step(plan: Plan, sweep: int, before: Totals | None, outcomes: float):
    """The root's tables of a bucket of words and those of hot pairs, given the sweep before; without one, one table each."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        asked = [(source, P.unblob(data)) for source, data, _ in _of_kind(table, "request")]
        words, of = np.unique(np.concatenate([d[0].astype(P.U) for _, d in asked]), return_inverse=True)
        places = np.split(of, np.cumsum([len(d[0]) for _, d in asked])[:-1])
        n = max(len(plan.hot), 1)
        keys = [places[k][d[3].astype(np.int64)] * n + d[2].astype(np.int64) for k, (_, d) in enumerate(asked)]
        hot, hot_of = np.unique(np.concatenate(keys), return_inverse=True)
        hot_places = np.split(hot_of, np.cumsum([len(k) for k in keys])[:-1])
        hot_c = np.bincount(hot_of, np.concatenate([d[4] for _, d in asked]).astype(np.float64), len(hot)).astype(np.int64)
        hot_v, hot_w = hot % n, hot // n
        hot_t = np.minimum(hot_c, 1)
        last = [P.unblob(data) for _, data, _ in _of_kind(table, "root")]
        if before is not None:
            c_, t_, _, hot_t_ = (a.astype(np.int64) for a in last[0])
            p = before.at_root(c_, t_)[hot_w]
            strength = STRENGTHS[1] + DISCOUNTS[1] * (before.hot[hot_v, 1] - hot_t_)
            hot_t = draw(hot_c, strength, p, DISCOUNTS[1], uniform(pair_key(plan.hot[hot_v], words[hot_w]) if len(hot) else hot.astype(P.U), sweep, 1))
        c = np.bincount(of, np.concatenate([d[1] for _, d in asked]).astype(np.float64), len(words)).astype(np.int64) + np.bincount(hot_w, hot_t, len(words)).astype(np.int64)
        t = np.minimum(c, 1)
        if before is not None:
            t = draw(c, STRENGTHS[0] + DISCOUNTS[0] * (before.root[1] - t_), np.full(len(c), 1.0 / outcomes), DISCOUNTS[0], uniform(P.mixed(words), sweep, 0))
        out = [("root", bucket, 0, 0.0, 0.0, P.blob(c, t, hot_c, hot_t), b""), ("sum", -1, 0, float(c.sum()), float(t.sum()), b"", b"")]
        for v in np.unique(hot_v).tolist():
            out.append(("sum", v, 0, float(hot_c[hot_v == v].sum()), float(hot_t[hot_v == v].sum()), b"", b""))
        for k, (source, _) in enumerate(asked):
            w, h = places[k], hot_places[k]
            out.append(("answer", source, bucket, 0.0, 0.0, P.blob(c[w], t[w], hot_c[h], hot_t[h]), b""))
        return rows_of(out)

    return run


def sweep_step(plan: Plan, sweep: int, totals: Totals):
    """The tables of a bucket's contexts and live pairs, given the sweep before, and its requests."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        s = Seats.unpacked(_of_kind(table, "seats")[0][1])
        tables, pair_tables = (a.astype(np.int64) for a in P.unblob(_of_kind(table, "seating")[0][1]))
        answer = Answer.of([(source, data) for source, data, _ in _of_kind(table, "answer")], totals)
        p, _, v_tables = pair_probabilities(s, tables, pair_tables, answer, totals)
        of_context = s.context_ones + np.bincount(s.type_context, tables, len(s.context_ones))
        new = draw(s.type_count, STRENGTHS[2] + DISCOUNTS[2] * (of_context[s.type_context] - tables), p[s.type_pair], DISCOUNTS[2], uniform(s.type_key, sweep, 2))
        live, _ = s.customers(new)
        new_pairs = draw(live, STRENGTHS[1] + DISCOUNTS[1] * (v_tables[s.live_v] - pair_tables), answer.root[s.live_w], DISCOUNTS[1], uniform(s.live_key, sweep, 1))
        return rows_of([("seating", bucket, 0, 0.0, 0.0, P.blob(new, new_pairs), b""), *s.requests(plan, bucket, new, new_pairs)])

    return run


def score(plan: Plan, samples: list[Totals], counts: np.ndarray, tokens: float, outcomes: float):
    """The sums of each chunk's documents over a bucket: known tokens, base and model scores in units. Heads pass."""

    def run(table: pa.Table) -> pa.Table:
        out = [("head", 0, 0, 0.0, 0.0, data, chunk) for _, data, chunk in _of_kind(table, "head")]
        shipped = [(P.unblob(data), chunk) for _, data, chunk in _of_kind(table, "types")]
        if not shipped:
            return rows_of(out)
        b = merged([d for d, _ in shipped])
        s, at, v_numbers = seated(b, plan)
        one = np.bincount(at.context, b.count == 1)
        customers = np.bincount(at.context, b.count)
        mean = np.zeros(len(b.v))
        v_hot = plan.hot_number(b.names[v_numbers])
        for k, totals in enumerate(samples):
            tables, pair_tables = (a.astype(np.int64) for a in P.unblob(_of_kind(table, f"seating{k}")[0][1]))
            answer = Answer.of([(source, data) for source, data, _ in _of_kind(table, f"answer{k}")], totals)
            p, c, t = pair_probabilities(s, tables, pair_tables, answer, totals)
            below = answer.root[at.pair_word]
            single = at.pair_trained.astype(np.float64)  # of pairs that are neither live nor hot
            p1 = shrunk(1, single, single, c[at.pair_v], t[at.pair_v], below)
            p1 = np.where(at.pair_live >= 0, p[at.pair_live], p1) if len(s.live_v) else p1
            p1 = np.where(at.pair_hot >= 0, p[len(s.live_v) + at.pair_hot * (at.pair_hot >= 0)], p1) if len(s.hot_v) else p1
            of_context = one.astype(np.float64)
            of_context += np.bincount(at.context[at.several], tables, len(one))
            own = np.minimum(b.count, 1).astype(np.float64)
            own[at.several] = tables
            for lo in range(0, len(mean), STEP):
                j = slice(lo, lo + STEP)
                mean[j] += shrunk(2, b.count[j], own[j], customers[at.context[j]], of_context[at.context[j]], p1[at.pair[j]])
        units = np.rint(-np.log10(mean / len(samples)) * UNIT)
        v_count = np.bincount(at.pair_v[at.pair], b.count, len(v_numbers))
        v_count = np.where(v_hot >= 0, counts[v_hot], v_count) if len(plan.hot) else v_count
        is_word = b.names[v_numbers] != START  # the word before a token stands for its own base score
        base = np.where(is_word, np.rint(-np.log10((v_count + 0.1) / (tokens + 0.1 * outcomes)) * UNIT), 0.0)[at.pair_v[at.pair]]
        known = (is_word & (v_count > 0))[at.pair_v[at.pair]].astype(np.float64)
        for (d, chunk), of in zip(shipped, b.of, strict=True):
            types = np.repeat(of, d[6].astype(np.int64))
            docs, row = np.unique(d[7].astype(np.int64), return_inverse=True)
            sums = [np.bincount(row, x[types], len(docs)).astype(np.int64) for x in (known, base, units)]
            out.append(("part", 0, 0, 0.0, 0.0, P.blob(docs, *sums), chunk))
        return rows_of(out)

    return run


RESULT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def add_up(trained_docs: float, tokens: float, outcomes: float):
    """A row for each document of a chunk. Chunks of equal content meet here, so what is added up is divided by how many they are."""

    def run(table: pa.Table) -> pa.Table:
        same = [data for _, data, _ in _of_kind(table, "head")]
        ids, there, n = P.unblob(same[0])
        ids = ids.astype(P.U)
        sums = np.zeros((3, len(ids)), np.int64)
        for _, data, _ in _of_kind(table, "part"):
            docs, *values = P.unblob(data)
            for k in range(3):
                sums[k, docs.astype(np.int64)] += values[k].astype(np.int64)
        sums //= len(same)
        end = np.log10((trained_docs + 0.1) / (tokens + 0.1 * outcomes))
        columns = [
            pa.array(ids.view(np.int64), mask=there == 0),
            pa.array(n.astype(np.int64)),
            pa.array(sums[0] + (trained_docs > 0)),
            pa.array(end - sums[1] / UNIT),
            pa.array(-sums[2] / UNIT),
        ]
        out = pa.Table.from_arrays([c.cast(t) for c, t in zip(columns, RESULT.types, strict=True)], schema=RESULT)
        return pa.concat_tables([out] * len(same))

    return run


# --- the jobs -------------------------------------------------------------------


def plan_of(rows: DataFrame, bucket_bytes: int, hot_tokens: int, hot_share: float) -> Plan:
    """Buckets by bytes of text, and words before others that a share of the rows says are above ``hot_tokens``."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def words(batches):
        for batch in chunks(batches, "text"):
            names, _, v, _, _ = _tokens(batch)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(np.bincount(v, minlength=len(names)))], ["word", "n"])

    sample = rows.sample(hot_share, seed=5) if hot_share < 1 else rows
    found = sample.mapInArrow(words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") > hot_tokens * hot_share)
    hot = sorted((int(r.word) % 2**64, r.n) for r in found.collect())
    parts = [int(n / hot_share // hot_tokens) + 1 for _, n in hot]
    return Plan(max(1, -(-total // bucket_bytes)), np.array([w for w, _ in hot], P.U), np.array(parts, np.int64))


def _sums(table: DataFrame, n_hot: int) -> dict[int, tuple[float, float]]:
    """Sums of (a, b): -1, -2 and one for each hot word."""
    found = {r.bucket: (r.a, r.b) for r in table.where("kind = 'sum'").groupBy("bucket").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()}
    return {k: found.get(k, (0.0, 0.0)) for k in range(-2, n_hot)}


def _kinds(table: DataFrame, *kinds: str, named: str = "") -> DataFrame:
    """Rows of some kinds, ``named`` behind their kind."""
    return table.where(F.col("kind").isin(*kinds)).withColumn("kind", F.concat("kind", F.lit(named))).select(*ARROW.names)


def scored(docs: DataFrame, text: str = "text", key: str = "doc_id", bucket_bytes: int = BUCKET_BYTES, hot_tokens: int = HOT_TOKENS, hot_share: float = HOT_SHARE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row."""
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    plan = plan_of(rows, bucket_bytes, hot_tokens, hot_share)
    keep = lambda df, what: saved(df, what, by="kind")
    drop = lambda table, *kinds: [discard(table, f"kind={k}") for k in kinds]

    each = lambda df, step: grouped(df, plan.buckets, step, SCHEMA)

    first = keep(each(rows.mapInArrow(ship(plan, False), SCHEMA), start(plan)), "seats")
    sums = _sums(first, len(plan.hot))
    counts = np.array([sums[k][0] for k in range(len(plan.hot))])
    start_at = plan.hot_number(np.array([START]))[0]
    trained_docs = sums[-2][0] if start_at < 0 else counts[start_at]
    words = np.delete(counts, start_at) if start_at >= 0 else counts
    tokens = sums[-1][0] + words.sum() + trained_docs
    outcomes = sums[-1][1] + float((words > 0).sum()) + (trained_docs > 0) + 1.0

    seats, seating, kept, before, root = _kinds(first, "seats"), first, [], None, None
    for sweep in range(BURN_IN + SAMPLES + 1):
        if sweep:
            known = seats.union(_kinds(seating, "seating")).union(_kinds(root, "answer"))
            last, seating = seating, keep(each(known, sweep_step(plan, sweep, before)), "seating")
            if sweep <= BURN_IN + 1:  # was not kept
                drop(last, "seating")
                drop(root, "answer")
        asked = _kinds(seating, "request") if root is None else _kinds(seating, "request").union(_kinds(root, "root"))
        last, root = root, keep(each(asked, root_step(plan, sweep, before, outcomes)), "root")
        drop(seating, "request")
        if last is not None:
            drop(last, "root")
        sums = _sums(root, len(plan.hot))
        before = Totals(sums[-1], np.array([sums[k] for k in range(len(plan.hot))]).reshape(-1, 2), outcomes)
        if sweep > BURN_IN:
            kept.append((_kinds(seating, "seating", named=str(len(kept))), _kinds(root, "answer", named=str(len(kept))), before))

    drop(first, "seats")
    parts = rows.mapInArrow(ship(plan, True), SCHEMA)
    for seated_, answers, _ in kept:
        parts = parts.union(seated_).union(answers)
    scores = each(parts, score(plan, [t for *_, t in kept], counts, tokens, outcomes))
    out = scores.groupBy("chunk").applyInArrow(add_up(trained_docs, tokens, outcomes), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    held = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(int(tokens)).cast("bigint").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
