"""Plain Python versions of what the operators give, for small inputs."""

import collections
import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


VOCABULARY = ["wo" + a + b for a in "abcdefghij" for b in "klmnopqrst"]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def statistics(text):
    ws = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(ws[k : k + 5]) for k in range(len(ws) - 4)]
    n = collections.Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if n[w] > 1 for j in range(5)}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def shingles(text):
    ws = WORD.findall((text or "").translate(LOWER))
    return {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())


def components(docs):
    sets = {i: shingles(t) for i, t in docs.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def substring_dedup(docs, n=20):
    seen, out = set(), {}
    for i in sorted(docs):
        ws, gone = WORD.findall(docs[i] or ""), set()
        for k in range(len(ws) - n + 1):
            w = tuple(ws[k : k + n])
            if w in seen:
                gone.update(range(k, k + n))
            seen.add(w)
        out[i] = len(ws), len(gone), sha(" ".join(w for k, w in enumerate(ws) if k not in gone))
    return out


def suffix_dedup(docs, n=50):
    first, out = {}, {}
    for i in sorted(docs):
        b = (docs[i] or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if first.setdefault(b[k : k + n], i) < i:
                gone[k : k + n] = b"\1" * n
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b)))
        out[i] = len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone) if not g))
    return out


def contaminated(docs, items):
    bench = {i: WORD.findall((t or "").lower()) for i, t in items.items()}
    out = {}
    for d, t in docs.items():
        ws, hits = WORD.findall((t or "").lower()), set()
        for i, it in bench.items():
            want = collections.Counter(tuple(it[k : k + 5]) for k in range(len(it) - 4))
            for s in range(5 - len(it), len(ws) - 4) if want else ():
                have = collections.Counter(tuple(ws[k : k + 5]) for k in range(max(0, s), min(len(ws), s + len(it)) - 4))
                common = sum((have & want).values())
                if common and common >= 0.75 * (have.total() + want.total() - common):
                    hits.add(i)
        out[d] = sorted(hits)
    return out
