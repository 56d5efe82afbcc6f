"""Operators that compare documents: joins, deduplication and the language model."""

import random

import brute
import numpy as np
import pytest
from brute import prose
from pyspark.sql import functions as F

from weir.llm import ngram_join, packed, substring_dedup, suffix_dedup


def test_packed_round_trip():
    r = np.random.default_rng(1)
    docs = np.repeat(np.array([-5, 3, 2**40]), [4, 1, 6])
    places = np.array([3, 9, 10, 70_000, 0, 1, 2, 3, 2**31, 2**31 + 1, 2**32 - 1])
    hashes = r.integers(0, 2**63, 11).astype(np.uint64)
    bucket = r.integers(0, 3, 11)
    batch = packed.pack(bucket, hashes, docs, places)
    h, d, p = packed.unpack(packed.pa.Table.from_batches([batch]))
    assert sorted(zip(h.tolist(), d.tolist(), p.tolist())) == sorted(zip(hashes.tolist(), docs.tolist(), places.tolist()))
    low, _, _ = packed.unpack(packed.pa.Table.from_batches([packed.pack(bucket, hashes, docs, None, width=6)]), width=6)
    assert sorted(low.tolist()) == sorted((hashes & np.uint64(2**48 - 1)).tolist())
    assert packed.pack(bucket[:0], hashes[:0], docs[:0], None).num_rows == 0


@pytest.mark.parametrize("n", [1, 2, 5, 7, 20, 31])
def test_window_hashes(n):
    h = np.random.default_rng(n).integers(0, 2**63, 64).astype(np.uint64)
    step = int(packed.STEP_A)
    want = [sum(int(h[i + j]) * step**j for j in range(n)) % 2**64 for i in range(64 - n + 1)]
    assert packed.window_hashes(h, n, packed.STEP_A).tolist() == want
    assert len(packed.window_hashes(h[: n - 1], n, packed.STEP_A)) == 0


def test_hashed_words():
    texts = ["a b", "", " x\ty\n", "A", "b a", None, "é 日本"]
    h, at = packed.hashed_words(*packed.flat(packed.pa.array(texts)))
    words = [w for t in texts for w in brute.WORD.findall(t or "")]
    assert at.tolist() == [0, 2, 2, 4, 5, 7, 7, 9] and len(set(zip(words, h.tolist()))) == len(set(words)) == len(set(h.tolist()))
    low, _ = packed.hashed_words(*packed.flat(packed.pa.array(texts)), lower=True)
    assert low[4] == low[0]


def test_substring_dedup(docs, tricky, nothing):
    out = substring_dedup.deduplicated(docs)
    got = {r.doc_id: (r.n_words, r.n_removed, brute.sha(r.kept_text)) for r in out.collect() if r.doc_id is not None}
    assert got == brute.substring_dedup(tricky)
    assert out.count() == docs.count() and out.where("doc_id is null").first().n_removed == 0
    assert substring_dedup.deduplicated(nothing).count() == 0
    spans = substring_dedup.removed_words(docs).where("doc_id = 4").first().removed
    assert [(s.start, s.stop) for s in spans] == [(0, 120)]


def test_suffix_dedup(docs, tricky, nothing):
    out = suffix_dedup.deduplicated(docs)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, brute.sha(bytes(r.kept))) for r in out.collect() if r.doc_id is not None}
    assert got == brute.suffix_dedup(tricky)
    assert out.count() == docs.count() and suffix_dedup.deduplicated(nothing).count() == 0


def test_suffix_dedup_of_random_passages(spark):
    r = random.Random(4)
    passages = ["".join(r.choice("ab cd") for _ in range(r.randint(40, 160))) for _ in range(12)]
    texts = {i: "".join(r.choice(passages)[r.randint(0, 30) :] + "".join(r.choice("abcdefgh ") for _ in range(r.randint(0, 40))) for _ in range(r.randint(1, 6))) for i in range(60)}
    out = suffix_dedup.deduplicated(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, brute.sha(bytes(r.kept))) for r in out.collect()} == brute.suffix_dedup(texts)


def test_suffix_dedup_of_a_whole_table(spark, sf001):
    table = spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, brute.sha(bytes(r.kept))) for r in suffix_dedup.deduplicated(table).collect()}
    assert got == brute.suffix_dedup({r.doc_id: r.text for r in table.collect()})


def test_frequent_leads_are_compared_like_others(spark, monkeypatch):
    """One line in every document, with other bytes around it: dealt window by window and in suffixes, with equal results."""
    line = "This very line is in each and every document of the table. "
    texts = {i: prose(i, 6) + " " + line + prose(100 + i % 7, 8) for i in range(80)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    want = brute.suffix_dedup(texts)
    for frequent in (2, 10**9):
        monkeypatch.setattr(suffix_dedup, "FREQUENT", frequent)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, brute.sha(bytes(r.kept))) for r in suffix_dedup.deduplicated(df).collect()}
        assert got == want


def test_anchors_do_not_depend_on_pieces(monkeypatch):
    r = random.Random(6)
    texts = ["".join(r.choice("abc ") for _ in range(r.choice([0, 20, 49, 50, 51, 400, 900]))) for _ in range(12)] + ["z" * 300]
    data, offsets = packed.flat(packed.pa.array(texts))

    def by_window():
        return {w: int(a) for a, _, first, last, _ in zip(*suffix_dedup.anchors(data, offsets)) for w in range(first, last + 1)}

    whole = by_window()
    assert len(whole) == sum(max(0, len(t) - 49) for t in texts)
    assert all(w <= a <= w + 30 for w, a in whole.items())
    monkeypatch.setattr(suffix_dedup, "STEP", 64)
    assert by_window() == whole


def test_multikey_order():
    r = np.random.default_rng(2)
    rows = r.integers(0, 3, (500, 19)).astype(np.uint8)
    order, shared = suffix_dedup.common_prefixes(rows)
    ordered = [bytes(x) for x in rows[order]]
    assert ordered == sorted(ordered)
    for k in range(1, 500):
        n = next((i for i in range(19) if ordered[k][i] != ordered[k - 1][i]), 19)
        assert shared[k] == n


def test_ngram_join(docs, tricky, nothing):
    out = ngram_join.linked(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect() if r.doc_id is not None}
    assert got == brute.components(tricky)
    assert {r.doc_id: r.class_id for r in out.collect()}[4] == 3
    assert ngram_join.linked(nothing).count() == 0


def test_ngram_join_of_families(spark):
    """Families of copies with edits of many sizes, chains, a common passage and sets within sets."""
    r, texts = random.Random(9), []
    common = prose("common", 30)
    for f in range(6):
        base = prose(f, r.choice([12, 60, 140])).split()
        for k in range(40):
            words = list(base)
            for _ in range(r.randint(0, max(1, len(words) // 25))):
                words[r.randrange(len(words))] = r.choice(["new", "other", f"word{k}"])
            texts.append(" ".join(words[: len(words) - r.randint(0, len(words) // 4)] + ([common] if f % 2 else [])))
    chain = prose("chain", 80).split()
    for k in range(15):  # each links with the next only
        texts.append(" ".join(chain[k * 4 :] + [f"c{k}x{j}" for j in range(k * 4)]))
    texts += ["a b c", "A b C", "a b c d", "", " ".join(chain[:40])]
    r.shuffle(texts)
    table = dict(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked(spark.createDataFrame(list(table.items()), "doc_id long, text string")).collect()}
    assert got == brute.components(table)


def test_one_id_with_two_texts(spark):
    rows = [(1, prose(1, 30)), (1, prose(2, 30)), (2, prose(1, 30)), (3, prose(2, 30)), (4, None), (4, "a b")]
    h = {r.text: r.h for r in spark.createDataFrame(rows, "doc_id long, text string").select("text", F.xxhash64("text").alias("h")).collect()}
    kept = min((prose(1, 30), prose(2, 30)), key=h.get)
    four = min((None, "a b"), key=h.get)
    table = {1: kept, 2: prose(1, 30), 3: prose(2, 30), 4: four}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.components(table)


def test_documents_of_one_template(spark):
    """Nine of ten words alike but hardly a link: work must not grow with the pairs."""
    form = prose("form", 60).split()
    texts = {}
    for i in range(3000):
        own = [f"own{i}x{j}" for j in range(9 + i % 4)]
        texts[i] = " ".join(form[:40] + own + form[40:])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = ngram_join.linked(df).collect()
    some = {i: texts[i] for i in range(0, 3000, 60)}
    want = brute.components(some)
    assert len({c for _, c in want.values()}) == len(some) and all(r.component_id == r.doc_id for r in found)


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)]
    parent = {v: v for e in edges for v in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    got = {x.doc_id: x.component for x in ngram_join.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {v: find(v) for v in parent}
