"""Packed shuffles: hashes with the document and position they come from, as a few large rows.

A chunk of documents gives one row per bucket that holds the bucket's hashes in
document order, so that Spark shuffles some hundred kilobytes a row instead of
some twenty bytes. ``hashed_words`` and ``window_hashes`` make the hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

U = np.uint64
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A random 64-bit number for each byte, and the odd multipliers of the polynomials.
BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
STEP_IN_WORD, STEP_A, STEP_B = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def powers(step: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), step, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column one after another, and where each row begins (with the end). Null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int32 if column.type in (pa.string(), pa.binary()) else np.int64)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Bytes whose words are hashed in one step.
STEP_BYTES = 1 << 20


def _space_after(data: np.ndarray, at: int) -> int:
    """The first separator at or after ``at``, or the end."""
    while at < len(data):
        found = IS_SPACE[data[at : at + 4096]]
        if found.any():
            return at + int(found.argmax())
        at += 4096
    return len(data)


def hashed_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and where each row's words begin (with the end)."""
    hashes, counts, at = [np.zeros(0, U)], np.zeros(len(offsets) - 1, np.int64), 0
    while at < len(data):
        stop = _space_after(data, at + STEP_BYTES)
        h, starts = _block_words(data[at:stop], offsets - at, lower)
        hashes.append(h)
        counts += np.diff(np.searchsorted(starts, offsets - at))
        at = stop
    return np.concatenate(hashes), np.concatenate(([0], np.cumsum(counts)))


def _block_words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of a block that begins and ends between words."""
    if lower:
        data = LOWER[data]
    inside = ~IS_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][(offsets[:-1] >= 0) & (offsets[:-1] < len(data))]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, U), np.zeros(0, np.int64)
    where = np.flatnonzero(inside)
    place = np.searchsorted(where, starts)
    sizes = np.diff(np.append(place, len(where)))
    within = np.arange(len(where)) - np.repeat(place, sizes)
    h = np.add.reduceat(BYTE[data[where]] * powers(STEP_IN_WORD, int(sizes.max()))[within], place)
    return mixed(h + sizes.astype(U) * STEP_B), starts


def window_hashes(h: np.ndarray, n: int, step: np.uint64) -> np.ndarray:
    """Rabin-Karp hash of each ``n`` neighbours: sum of h[i+j] * step**j modulo 2**64, by doubling."""
    if len(h) < n:
        return np.zeros(0, U)
    total, done, part, size, factor = None, 0, h, 1, step
    power = powers(step, n + 1)
    while True:
        if n & size:
            total = part.copy() if total is None else total[: len(part) - done] + power[done] * part[done : done + len(total[: len(part) - done])]
            done += size
        size *= 2
        if size > n:
            break
        half = size // 2
        part = part[: len(part) - half] + power[half] * part[half:]
    return total[: len(h) - n + 1]


def inside_rows(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all windows of ``n`` items: the starts of those within one row, and their rows."""
    sizes = np.maximum(np.diff(at) - n + 1, 0)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    first = np.cumsum(sizes) - sizes
    return at[:-1][rows] + np.arange(len(rows)) - first[rows], rows


def narrow(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of whole numbers, byte by byte: planes of zeros cost next to nothing when Spark compresses them."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def wide(b: bytes, width: int, size: int = 8) -> np.ndarray:
    """Numbers of ``size`` bytes each."""
    raw = np.frombuffer(b, np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], size), np.uint8)
    for k in range(width):
        out[:, k] = raw[k]
    return out.view(f"<u{size}").ravel()


_ZSTD = pa.Codec("zstd", compression_level=1)


def blob(*arrays: np.ndarray) -> bytes:
    """Arrays of non-negative whole numbers (or 64-bit patterns), each as planes of its widest number's bytes, compressed together."""
    head, planes = [len(arrays)], []
    for a in arrays:
        a = np.asarray(a).astype("<u8")
        width = (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
        head += [len(a), width]
        planes.append(narrow(a, width))
    raw = np.array(head, "<u8").tobytes() + b"".join(planes)
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def unblob(data: bytes) -> list[np.ndarray]:
    """The arrays, unsigned and no wider than their numbers need."""
    raw = _ZSTD.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    n = int.from_bytes(raw[:8], "little")
    at, out = 8 + 16 * n, []
    for length, width in np.frombuffer(raw, "<u8", 2 * n, 8).reshape(n, 2).tolist():
        size = next(s for s in (1, 2, 4, 8) if s >= width)
        out.append(wide(raw[at : at + length * width], width, size) if width else np.zeros(length, np.uint8))
        at += length * width
    return out


def steps(ids: np.ndarray) -> bytes:
    """Ids as differences, which are small where ids rise."""
    return narrow(np.diff(ids.astype(np.int64), prepend=0).view(U), 8)


def from_steps(b: bytes) -> np.ndarray:
    return np.cumsum(wide(b, 8).view(np.int64))


FIELDS = [T.StructField("hashes", T.BinaryType()), T.StructField("docs", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("places", T.BinaryType())]
#: kind 0: hashes to compare; kind 1: findings that pass through.
SCHEMA = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("kind", T.IntegerType()), *FIELDS])
ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), *[(f.name, pa.binary()) for f in FIELDS]])


def pack(bucket: np.ndarray, hashes: np.ndarray | None, docs: np.ndarray, places: np.ndarray | None, width: int = 8, kind: int = 0) -> pa.RecordBatch:
    """Rows of SCHEMA. The input is in document order. ``hashes`` are numbers, of which ``width`` bytes are kept, or records (n x bytes)."""
    if not len(bucket):
        return pa.RecordBatch.from_arrays([pa.array([], t) for t in ARROW.types], schema=ARROW)
    order = np.argsort(bucket.astype(np.uint16) if bucket.max() < 65536 else bucket, kind="stable")  # by radix if it can
    bucket, docs = bucket[order], docs[order]
    hashes = None if hashes is None else hashes[order]
    places = None if places is None else places[order]
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    rows = []
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)], strict=True):
        d = docs[lo:hi]
        runs = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
        gaps = b""
        if places is not None:
            p = places[lo:hi]
            up = np.diff(p, prepend=0)
            up[runs] = p[runs]
            gaps = narrow(up, 4)
        if hashes is None:
            h = b""
        elif hashes.ndim == 2:
            h = hashes[lo:hi].tobytes()
        else:
            h = hashes[lo:hi].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
        rows.append((int(bucket[lo]), kind, h, steps(d[runs]), narrow(np.diff(np.append(runs, hi - lo)), 4), gaps))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)


def unpack(table: pa.Table, width: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (uint64, or records of ``width`` bytes if more than 8), documents and places of all rows."""
    hs, ds, ps = [np.zeros(0, U) if width <= 8 else np.zeros((0, width), np.uint8)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for h, d, c, p in zip(*(table.column(f.name).to_pylist() for f in FIELDS), strict=True):
        counts = wide(c, 4).astype(np.int64)
        ds.append(np.repeat(from_steps(d), counts))
        if h and width > 8:
            hs.append(np.frombuffer(h, np.uint8).reshape(-1, width))
        elif h:
            full = np.zeros((len(h) // width, 8), np.uint8)
            full[:, :width] = np.frombuffer(h, np.uint8).reshape(-1, width)
            hs.append(full.view("<u8").ravel())
        if p:
            up = wide(p, 4).astype(np.int64)
            sums = np.cumsum(up)
            heads = np.cumsum(counts) - counts
            ps.append((sums - np.repeat(sums[heads] - up[heads], counts)) & 0xFFFFFFFF)  # steps are modulo 2**32
    return np.concatenate(hs), np.concatenate(ds), np.concatenate(ps)
