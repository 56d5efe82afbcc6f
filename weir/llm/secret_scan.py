"""Secret scans: a worklist that unwraps encoded layers and scans each of them.

A layer is a text with, for each of its characters, the span of the original
text it comes from. Scanning a layer finds three kinds of secrets; unwrapping it
finds runs in URL escapes, Unicode escapes, base64 and compressed base64 or hex,
and each decoded run is a new layer. Bytes that are no text stay in a layer as
separators. Base64 broken into lines is joined; a run with '/', '-' or '_' in it
is also decoded from behind those, and hex from its second digit. Compressed
bytes are opened until they are not compressed, all members of them. A layer
equal to one around it is not opened again, so that archives which hold
themselves end; every other unwrapping makes the text shorter or is finite, so
the worklist reaches a fixpoint.

Defined results: null and empty texts have no spans; decoded bytes are a layer if
they are printable text or hold ``LEAST`` neighbouring printable ASCII bytes (no
secret, wrapped or not, is shorter); compressed runs are read as a stream, in
layers of about ``PIECE`` bytes cut where no secret or encoded run can lie; spans
of inner layers are given as the span of the outermost text that encodes them,
and equal spans count once. Work grows with the length of a text, also of one
without a blank; rows are scanned one by one, so repeated rows, rows without an
id and extra columns come through as they are, columns named like a result are
replaced, and an empty table gives an empty one.
"""

from __future__ import annotations

import binascii
import hashlib
import re
import urllib.parse
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: Greedy runs: a run of the required length is what the open-ended pattern finds.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
NAMES = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)

#: Runs never give back what they took, so that each text is walked through once, however long it is unbroken.
URL_RUN = re.compile(r"(?:[^\s%]++|%[0-9A-Fa-f]{2})++")
UNICODE_RUN = re.compile(r"(?:[^\s\\]++|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2})++")
UNICODE_ESCAPE = re.compile(r"\\u([Dd][89ABab][0-9A-Fa-f]{2})\\u([Dd][C-Fc-f][0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})")
BASE64_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
WRAPPED_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++)++={0,2}")
HEX_RUN = re.compile(r"[0-9A-Fa-f]{32,}")
PRINTABLE = re.compile(r"[\x09\x0A\x0D\x20-\x7E\u00A0-\uFFFD\U00010000-\U0010FFFF]*")
LEAST = 16
ASCII_RUN = re.compile(rb"[\x09\x0A\x0D\x20-\x7E]{%d,}" % LEAST)
#: Bytes that no secret and no encoded run has, not even between its lines, and blanks where none can go on.
APART = re.compile(rb"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F!#$&()*,;<>?@\[\]^`{|}~]|(?<=[A-Za-z0-9])\x20(?=[A-Za-z0-9])|(?<![A-Za-z0-9+/_\r-])\n")
GZIP = b"\x1f\x8b\x08"
PIECE = MAX_UNPACKED = 16 << 20
STEP = 1 << 20
#: Bytes that must decompress before all that follow are decoded.
PROBE = 3 << 10


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each secret in the text as it stands."""
    out = []
    if NAMES.search(text):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def in_order(spans) -> list[tuple[int, int, str]]:
    return sorted(set(spans), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def written(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in in_order(spans))


def _readable(raw: bytes) -> str | None:
    """The bytes as text, undecodable ones as lone surrogates, or None if no secret can be in them."""
    try:
        text = raw.decode("utf-8")
        if PRINTABLE.fullmatch(text):
            return text or None
    except UnicodeDecodeError:
        text = None
    if not ASCII_RUN.search(raw):
        return None
    return raw.decode("utf-8", "surrogateescape") if text is None else text


def _packed(raw: bytes) -> bool:
    return raw[:2] == b"\x1f\x8b" or (len(raw) > 2 and raw[0] & 0x0F == 8 and (raw[0] << 8 | raw[1]) % 31 == 0)


def _opens(raw: bytes) -> bool:
    """Whether the first bytes decompress without an error."""
    try:
        zlib.decompressobj(zlib.MAX_WBITS | 32).decompress(raw[:PROBE], STEP)
    except zlib.error:
        return False
    return True


def _members(chunks):
    """What the members of a compressed stream hold, one after another; bytes behind the last one follow as they are. A stream without any comes as it is."""
    opened, rest, gap = zlib.decompressobj(zlib.MAX_WBITS | 32), b"", b""
    for chunk in chunks:
        rest += chunk
        while rest:
            if opened is None:
                rest = rest.lstrip(b"\0")
                if len(rest) < 3:
                    break
                if not _packed(rest):
                    yield gap + rest
                    yield from chunks
                    return
                opened = zlib.decompressobj(zlib.MAX_WBITS | 32)
            try:
                out = opened.decompress(rest, STEP)
                while out:
                    gap = b"\0"
                    yield out
                    rest = opened.unconsumed_tail
                    out = b"" if opened.eof else opened.decompress(rest, STEP)
                rest = opened.unused_data if opened.eof else b""
            except zlib.error:  # two bytes of text can look like a header
                yield gap + rest
                yield from chunks
                return
            if opened.eof:
                opened = None
    if rest:
        yield gap + rest


def _level(raw: bytes, depth: int):
    """Chunks of what ``depth`` compressed layers of ``raw`` hold."""
    chunks = iter([raw])
    for _ in range(depth):
        chunks = _members(chunks)
    return chunks


def _pieces(chunks):
    """The stream in pieces cut at bytes that are apart from any secret; a run without such a byte stays whole."""
    kept, size = [], 0
    for chunk in chunks:
        kept.append(chunk)
        size += len(chunk)
        if size >= PIECE and (cuts := [m.end() for m in APART.finditer(chunk)]):
            yield b"".join([*kept[:-1], chunk[: cuts[-1]]])
            kept, size = [chunk[cuts[-1] :]], len(chunk) - cuts[-1]
    yield b"".join(kept)


def _unpacked(raw: bytes, seen: frozenset):
    """Readable texts of the innermost layer of bytes that look compressed."""
    seen, depth = seen | {hashlib.sha1(raw).digest()}, 0
    while True:
        digest, head = hashlib.sha1(), b""
        for chunk in _level(raw, depth + 1):
            digest.update(chunk)
            head = head if len(head) > 2 else head + chunk[:3]
        if digest.digest() in seen:
            break
        seen, depth = seen | {digest.digest()}, depth + 1
        if not _packed(head):
            break
    if depth:
        for piece in _pieces(_level(raw, depth)):
            for text, _ in _decoded(piece, seen):
                yield text


def _decoded(raw: bytes, seen: frozenset = frozenset()):
    """(text, whether it is the bytes themselves) of raw bytes and of the first compressed stream in them."""
    at = 0 if _packed(raw) else raw.find(GZIP)
    while at >= 0:
        opened = False
        for text in _unpacked(raw[at:], seen) if _opens(raw[at : at + PROBE + 1]) and hashlib.sha1(raw[at:]).digest() not in seen else ():
            opened = True
            yield text, False
        at = -1 if opened else raw.find(GZIP, at + 1)
    if (text := _readable(raw)) is not None:
        yield text, True


#: A decoded text, and for each of its characters where in the text around it begins and ends what it comes from.
Cells = tuple[np.ndarray, np.ndarray]


def _url(run: str) -> tuple[str, Cells]:
    text, starts, ends, at = [], array("i"), array("i"), 0
    for m in re.finditer(r"(?:%[0-9A-Fa-f]{2})+", run):
        stop = m.end()
        try:
            inner, i = urllib.parse.unquote_to_bytes(m[0]).decode("utf-8"), m.start()
        except UnicodeDecodeError:  # stays as it is
            inner, i = "", stop
        text += [run[at : i if inner else stop], inner]
        starts.extend(range(at, i))
        ends.extend(range(at + 1, i + 1))
        for c in inner:
            starts.append(i)
            i += 3 * len(c.encode())
            ends.append(i)
        at = stop
    text.append(run[at:])
    starts.extend(range(at, len(run)))
    ends.extend(range(at + 1, len(run) + 1))
    return "".join(text), (np.array(starts, np.int64), np.array(ends, np.int64))


def _unicode(run: str) -> tuple[str, Cells]:
    text, starts, ends, at = [], array("i"), array("i"), 0
    for m in UNICODE_ESCAPE.finditer(run):
        text.append(run[at : m.start()])
        starts.extend(range(at, m.start()))
        ends.extend(range(at + 1, m.start() + 1))
        if m[1]:  # two escapes of a surrogate pair are one character
            c = chr(0x10000 + ((int(m[1], 16) & 0x3FF) << 10) + (int(m[2], 16) & 0x3FF))
        else:
            c = chr(int(m[3] or m[4], 16))
        text.append("\uFFFD" if "\ud800" <= c <= "\udfff" else c)
        starts.append(m.start())
        ends.append(m.end())
        at = m.end()
    text.append(run[at:])
    starts.extend(range(at, len(run)))
    ends.extend(range(at + 1, len(run) + 1))
    return "".join(text), (np.array(starts, np.int64), np.array(ends, np.int64))


def _layers(text: str):
    """(decoded text, start, end, cells) of each encoded run at start:end; cells is None if only the whole run is known."""
    for mark, runs, opened in (("%", URL_RUN, _url), ("\\", UNICODE_RUN, _unicode)):
        if mark in text:
            for m in runs.finditer(text):
                if mark in m[0]:
                    inner, (starts, ends) = opened(m[0])
                    if inner != m[0]:
                        yield inner, m.start(), m.end(), (starts + m.start(), ends + m.start())
    for m in BASE64_RUN.finditer(text):
        yield from _base64(m[0], np.arange(m.start(), m.end()))
    if "\n" in text:
        for m in WRAPPED_RUN.finditer(text):
            where = np.array([k for k, c in enumerate(m[0], m.start()) if not c.isspace()])
            yield from _base64("".join(m[0].split()), where)
    for m in HEX_RUN.finditer(text):
        for k in (0, 1):
            digits = m[0][k : len(m[0]) - (len(m[0]) - k) % 2]
            for inner, _ in _decoded(bytes.fromhex(digits)):
                yield inner, m.start(), m.end(), None


def _byte_sizes(text: str) -> np.ndarray:
    """UTF-8 bytes of each character; a lone surrogate stands for one undecodable byte."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where((c < 0x80) | ((c >= 0xDC80) & (c <= 0xDCFF)), 1, np.where(c < 0x800, 2, np.where(c < 0x10000, 3, 4)))


def _base64(whole: str, where: np.ndarray):
    """Layers of a run whose characters are at ``where`` in the text: of all of it, and from behind its '/', '-' and '_'."""
    run = whole.rstrip("=")
    plain = run.replace("-", "+").replace("_", "/")

    def bytes_from(at: int, most: int | None = None) -> bytes:
        part = plain[at:most]
        part = part[: len(part) - (len(part) % 4 == 1)]
        return binascii.a2b_base64(part + "=" * (-len(part) % 4))

    starts, ways = [(0, True)], {0}
    for m in re.finditer("[/_-]", run):
        k = m.end()
        if len(run) - k < 16:
            break
        if k % 4 not in ways:
            starts.append((k, True))
            ways.add(k % 4)
        elif _packed(binascii.a2b_base64(plain[k : k + 4])) and _opens(bytes_from(k, k + PROBE // 3 * 4)):
            starts.append((k, False))
    for at, anew in starts:
        raw = bytes_from(at)
        for inner, same in _decoded(raw) if anew else ((text, False) for text in _unpacked(raw, frozenset())):
            cells = None
            if same:
                ends = np.cumsum(_byte_sizes(inner))
                begins = np.concatenate(([0], ends[:-1]))
                cells = where[at + begins // 3 * 4], where[np.minimum(len(where), at + -(-ends // 3) * 4) - 1] + 1
            yield inner, int(where[0]), int(where[-1]) + 1, cells


def scan(text: str | None) -> tuple[list, list, int]:
    """Base spans, all spans, and the number of decoded layers."""
    if not text:
        return [], [], 0
    base = in_order(base_spans(text))
    found, done, layers = set(base), set(), 0
    # layers still to come from a layer, the original span of each of its characters (or the one of all), and the layers around it
    work = [(_layers(text), None, frozenset([hashlib.sha1(text.encode()).digest()]))]
    while work:
        coming, place, around = work[-1]
        if (layer := next(coming, None)) is None:
            work.pop()
            continue
        inner, start, end, cells = layer
        if place is None:
            span = (start, end)
        elif isinstance(place[0], int):
            span, cells = place, None
        else:
            span = (int(place[0][start]), int(place[1][end - 1]))
            cells = cells and (place[0][cells[0]], place[1][cells[1] - 1])
        digest = hashlib.sha1(inner.encode("utf-8", "surrogatepass")).digest()
        # the same layer of the same stretch also comes by unwrapping in another order
        same = (digest, span, cells is None)
        if digest in around or same in done:
            continue
        done.add(same)
        layers += 1
        found.update(((int(cells[0][s]), int(cells[1][e - 1])) if cells else span) + (kind,) for s, e, kind in base_spans(inner))
        work.append((_layers(inner), cells or span, around | {digest}))
    return base, in_order(found), layers


SCHEMA = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField("base_spans", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_layers", T.LongType())]


def scan_table(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns in ``keep``) with n_assign, n_access, n_hex, base_spans, spans and n_layers."""
    names = [f.name for f in SCHEMA]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    schema = T.StructType([docs.schema[c] for c in keep] + SCHEMA)

    def run(batches):
        for batch in batches:
            rows = []
            for t in batch.column(text).to_pylist():
                base, every, layers = scan(t)
                rows.append((*(sum(k == kind for _, _, k in base) for kind in KINDS), written(base), written(every), layers))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], [*keep, *names])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each run of overlapping spans replaced by ``[kind]`` of its first span."""
    out, at = [], 0
    for start, end, kind in in_order(spans):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with secrets of all layers replaced in ``text``; the other columns are as they were."""

    def run(batches):
        for batch in batches:
            texts = [redact(t, scan(t)[1]) if t else t for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text else batch.column(c) for c in batch.schema.names], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
