"""The hierarchical Pitman-Yor model against a plain sampler, exact laws and other ways of dealing."""

import collections
import math
import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from weir.llm import packed as P
from weir.llm import pitman_yor, stirling

START, END = "<start>", "<end>"


def tokens_of(text):
    return brute.WORD.findall((text or "").translate(brute.LOWER)) + [END]


def hash_of(word):
    if word in (START, END):
        return np.array([pitman_yor.START if word == START else pitman_yor.END])
    raw = np.frombuffer(word.encode(), np.uint8)
    return P.hashed_words(raw, np.array([0, len(raw)]))[0] & pitman_yor.WORD


def stirling_numbers(c, d):
    row = [0.0, 1.0]
    for n in range(1, c):
        row = [0.0] + [row[t - 1] + ((n - d * t) * row[t] if t < len(row) else 0.0) for t in range(1, n + 2)]
    return row


def drawn(c, strength, p, d, u):
    """Tables of a dish by the definition."""
    if c < 2:
        return c
    s, weights, product = stirling_numbers(c, d), [], 1.0
    for t in range(1, c + 1):
        product *= (strength + d * (t - 1)) * p
        weights.append(s[t] * product)
    x, t = u * sum(weights), 0
    while x >= weights[t]:
        x -= weights[t]
        t += 1
    return t + 1


class PlainModel:
    """The same sweeps with dictionaries, one type after another."""

    def __init__(self, texts):
        self.three = collections.Counter()
        for t in texts:
            before = [START, START, *tokens_of(t)]
            self.three.update(zip(before, before[1:], before[2:]))
        self.words = {w for _, _, w in self.three}
        self.t2 = dict.fromkeys(self.three, 1)
        self.c1 = self._up(self.t2)
        self.t1 = dict.fromkeys(self.c1, 1)
        self.c0 = self._up(self.t1)
        self.t0 = dict.fromkeys(self.c0, 1)
        self._sums()

    @staticmethod
    def _up(tables):
        out = collections.Counter()
        for k, t in tables.items():
            out[k[1:]] += t
        return out

    def _sums(self):
        add = lambda x: collections.Counter({}) + sum((collections.Counter({k[:-1]: v}) for k, v in x.items()), collections.Counter())
        self.C2, self.T2, self.C1, self.T1, self.C0, self.T0 = map(add, (self.three, self.t2, self.c1, self.t1, self.c0, self.t0))

    def p(self, level, key):
        d, s = pitman_yor.DISCOUNTS[level], pitman_yor.STRENGTHS[level]
        c, t, all_c, all_t = ((self.c0, self.t0, self.C0, self.T0), (self.c1, self.t1, self.C1, self.T1), (self.three, self.t2, self.C2, self.T2))[level]
        below = self.p(level - 1, key[1:]) if level else 1 / (len(self.words) + 1)
        n = all_c[key[:-1]]
        return (c.get(key, 0) - d * t.get(key, 0) + (s + d * all_t[key[:-1]]) * below) / (s + n) if n else below

    def sweep(self, k):
        d, s = pitman_yor.DISCOUNTS, pitman_yor.STRENGTHS
        pair = lambda v, w: pitman_yor.pair_key(hash_of(v), hash_of(w))
        u = lambda key, level: float(pitman_yor.uniform(key, k, level)[0])
        t2 = {(x, v, w): drawn(c, s[2] + d[2] * (self.T2[x, v] - self.t2[x, v, w]), self.p(1, (v, w)), d[2], u(P.mixed(pair(v, w) * P.STEP_B + hash_of(x)), 2)) for (x, v, w), c in self.three.items()}
        c1 = self._up(t2)
        t1 = {(v, w): drawn(c, s[1] + d[1] * (self.T1[(v,)] - self.t1[v, w]), self.p(0, (w,)), d[1], u(pair(v, w), 1)) for (v, w), c in c1.items()}
        c0 = self._up(t1)
        t0 = {(w,): drawn(c, s[0] + d[0] * (self.T0[()] - self.t0[(w,)]), 1 / (len(self.words) + 1), d[0], u(P.mixed(hash_of(w)), 0)) for (w,), c in c0.items()}
        self.t2, self.c1, self.t1, self.c0, self.t0 = t2, c1, t1, c0, t0
        self._sums()


def held_out(i):
    return zlib.crc32(str(i).encode()) % 10 == 0


@pytest.fixture(scope="module")
def small(spark):
    r = random.Random(7)
    words = [f"w{k}" for k in range(12)]
    texts = {i: " ".join(r.choices(words, [1 / (k + 1) for k in range(12)], k=r.randint(0, 14))) for i in range(60)}
    texts[60] = "w0 never seen W1"
    texts[next(i for i in range(100, 200) if held_out(i))] = "w0 w1 unknown w2 w0"
    return texts, spark.createDataFrame(list(texts.items()), "doc_id long, text string")


@pytest.fixture(scope="module")
def plain_scores(small):
    texts, _ = small
    model, kept = PlainModel([t for i, t in texts.items() if not held_out(i)]), []
    seen = {(x, v, w) for t in texts.values() for b in [[START, START, *tokens_of(t)]] for x, v, w in zip(b, b[1:], b[2:])}
    for k in range(1, pitman_yor.BURN_IN + pitman_yor.SAMPLES + 1):
        model.sweep(k)
        if k > pitman_yor.BURN_IN:
            kept.append({key: model.p(2, key) for key in seen})
            for x, v in [(START, START), ("w0", "w1"), ("unknown", "w2"), ("w2", "unknown")]:
                assert sum(model.p(2, (x, v, w)) for w in [*model.words, "no such word"]) == pytest.approx(1, abs=1e-9)
    out = {}
    for i, t in texts.items():
        b = [START, START, *tokens_of(t)]
        out[i] = sum(math.log10(sum(s[key] for s in kept) / len(kept)) for key in zip(b, b[1:], b[2:]))
    return out


@pytest.mark.parametrize("partitions, more", [(1, {}), (7, {"bucket_bytes": 300}), (3, {"bucket_bytes": 500, "hot_tokens": 20, "hot_share": 1})])
def test_scores_equal_those_of_a_plain_sampler(spark, small, plain_scores, partitions, more):
    """Whatever the partitions and buckets, and if frequent words are split."""
    texts, df = small
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        if more.get("hot_tokens"):
            assert len(pitman_yor.plan_of(df.select(F.col("doc_id").alias("key"), "text"), 500, 20, 1).hot) > 2
        got = {r.doc_id: r.score for r in pitman_yor.scored(df.repartition(partitions), **more).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert set(got) == set(texts)
    for i in texts:
        assert got[i] == pytest.approx(plain_scores[i], abs=1e-7), i


def test_language_model(docs, tricky, nothing):
    rows = pitman_yor.scored(docs).collect()
    assert len(rows) == docs.count()
    got = {r.doc_id: r for r in rows}
    train = [t for i, t in [*tricky.items(), (3, tricky[3]), (6, tricky[6])] if not held_out(i)]  # repeated rows count as they come
    count = collections.Counter(w for t in train for w in tokens_of(t))
    n, v = count.total(), len(count)
    for i, t in [*tricky.items(), (None, "no id here " * 30)]:
        r, ws = got[i], tokens_of(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i is not None and held_out(i) if i is not None else None, len(ws), sum(w in count for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        assert r.score < 0 and r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens))
    assert sum(r.doc_id == 3 for r in rows) == 2 and pitman_yor.scored(nothing).count() == 0


def test_without_training_rows(spark):
    held = next(i for i in range(1000) if held_out(i))
    r = pitman_yor.scored(spark.createDataFrame([(held, "a b a"), (None, "c")], "doc_id long, text string")).collect()
    assert len(r) == 2 and all(x.train_tokens == 0 and x.n_known == 0 and x.score == pytest.approx(0, abs=1e-6) for x in r)


def test_model_beats_base_on_held_out(spark):
    out = pitman_yor.scored(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))
    r = out.groupBy("held_out").agg((F.sum("score") / F.sum("n_tokens")).alias("s"), (F.sum("base_score") / F.sum("n_tokens")).alias("b")).collect()
    by = {x.held_out: x for x in r}
    assert by[True].s > 0.9 * by[True].b and by[False].s > by[True].s


@pytest.mark.parametrize("c, strength, p, d", [(2, 1.0, 0.4, 0.8), (7, 0.5, 0.1, 0.6), (60, 20.0, 0.3, 0.75), (1500, 40.0, 0.02, 0.8), (1500, 3000.0, 0.5, 0.75), (2500, 5.0, 1e-4, 0.6)])
def test_draws_follow_the_exact_law(c, strength, p, d):
    n = 1500 if c > stirling.EXACT else 20_000
    u = (np.arange(n) + 0.5) / n
    t = stirling.draw(np.full(n, c), np.full(n, strength), np.full(n, p), d, u)
    logs = stirling.table(d, 2500)[c, 1 : c + 1] + np.cumsum(np.log((strength + d * np.arange(c)) * p))
    weights = np.exp(logs - logs.max())
    upto = np.cumsum(weights / weights.sum())
    found = np.cumsum(np.bincount(t, minlength=c + 1)[1:]) / n
    assert np.abs(found - upto).max() < 0.01 and np.all(np.diff(t) >= 0)


def test_stirling_numbers():
    for d in pitman_yor.DISCOUNTS:
        exact = stirling.table(d, 3000)
        assert np.exp(exact[6, 1:7]) == pytest.approx(stirling_numbers(6, d)[1:])
        for c in (1100, 3000):
            t = np.arange(1, c + 1)
            assert np.abs(stirling.log_stirling(c, t, d) - exact[c, 1 : c + 1]).max() < 0.005
    assert stirling.draw(np.array([0, 1, 10**12]), 1e3, np.full(3, 0.5), 0.8, np.full(3, 0.5))[:2].tolist() == [0, 1]
