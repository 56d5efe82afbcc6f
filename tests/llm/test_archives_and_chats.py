"""WARC archives, preference formatting, the registered queries and the pipeline."""

import gzip
import hashlib
import importlib.util
import io
import zipfile

import brute
import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from weir.llm import preference, registry, warc


def test_round_trip(spark):
    big, other = "<p>é</p>" * 200, "x" * 1000
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, None), (4, "", ""), (5, "u", "small"), (6, "u", "small"), (7, "u", other), (8, "u\r\nX-Evil: 1", big), (8, "u\r\nX-Evil: 1", big), (None, "n", big)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, digest string, payload string")
    out = warc.round_trip(pages).collect()
    assert len(out) == len(rows)
    html = {r[0]: (r[2] or "").encode() for r in rows}
    for r in out:
        body = html[r.page_id]
        assert r.payload_bytes == len(body) and r.payload_digest == hashlib.sha1(body).hexdigest()
        revisit = r.page_id in (1, 2)
        assert (r.record_type, r.refers_to) == (("revisit", 8) if revisit else ("response", None)), r.page_id
        assert r.payload is None if revisit else bytes(r.payload) == body
    assert warc.round_trip(pages.where("false")).count() == 0


def test_archives_roll_and_ranges(spark, tmp_path):
    pages = spark.range(50).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("page "), F.sha2(F.col("id").cast("string"), 512)).alias("html"))
    manifest = warc.write_archives(pages, f"file://{tmp_path}", archive_bytes=2000)
    assert manifest.agg(F.sum("n_records")).first()[0] == 50 and manifest.count() > 4
    assert sorted(r.page_id for r in warc.read_archives(manifest, 3).collect()) == list(range(50))
    path = manifest.first().archive.removeprefix("file://")
    with zipfile.ZipFile(path) as z:  # an ordinary ZIP file to others
        assert z.namelist() == [warc.DATA, warc.INDEX] and z.testzip() is None
    assert [[o for o, _ in run] for run in warc.ranges([(0, 5), (5, 5), (20, 1), (10, 5)], 12)] == [[0, 5], [10], [20]]


def test_archives_of_other_writers(tmp_path):
    """Several data members, one indexed by key, time and JSON in a compressed index, one without index, records of other types."""

    def member(kind, uri, body, digest="", gz=True):
        block = b"HTTP/1.1 200 OK\r\n\r\n" + body if kind == "response" else body
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{uri}>\r\nWARC-Target-URI: {uri}\r\n{digest}Content-Length: {len(block)}\r\n\r\n"
        return gzip.compress(head.encode() + block + b"\r\n\r\n")

    parts = [member("warcinfo", "i", b"x: y"), member("response", "u1", b"one"), member("request", "u1", b"GET"), member("response", "u2", b"two" * 999, "WARC-Payload-Digest: sha256:00\r\n")]
    offsets = [sum(map(len, parts[:k])) for k in range(4)]
    index = "".join(f'com,a)/{k} 2020 {{"url": "u", "offset": "{offsets[k]}", "length": "{len(parts[k])}", "filename": "a.warc.gz"}}\n' for k in (1, 3))
    second = [member("response", f"v{k}", b"v" * k) for k in range(5)]
    path = f"{tmp_path}/foreign.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("archive/a.warc.gz", b"".join(parts))
        z.writestr("archive/b.warc.gz", b"".join(second))
        z.writestr("indexes/index.cdx.gz", gzip.compress(index.encode()))
        z.writestr(zipfile.ZipInfo("pages/pages.jsonl"), b"{}", zipfile.ZIP_DEFLATED)
    found = list(warc.records(f"file://{path}"))
    assert [(x["url"], x["payload"], x["page_id"]) for x in found] == [("u1", b"one", None), ("u2", b"two" * 999, None)] + [(f"v{k}", b"v" * k, None) for k in range(5)]
    assert found[0]["payload_digest"] == hashlib.sha1(b"one").hexdigest()
    with zipfile.ZipFile(path, "w") as z:
        z.writestr(zipfile.ZipInfo("archive/a.warc.gz"), b"".join(parts), zipfile.ZIP_DEFLATED)
    with pytest.raises(ValueError, match="not stored"):
        list(warc.records(f"file://{path}"))


def test_scanning_across_reads():
    parts = [gzip.compress(bytes([k]) * (k * 50)) for k in range(40)]
    raw = b"".join(parts)
    for most in (1, 7, 64, 10_000):
        assert list(warc.scanned(read_at(raw), 0, len(raw), most)) == [gzip.decompress(p) for p in parts]


def test_a_long_payload(spark):
    pages = spark.range(2).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.lit("long "), 2_000_000).alias("html"))
    assert sorted((r.page_id, r.payload_bytes, r.refers_to) for r in warc.round_trip(pages).select("page_id", "payload_bytes", "refers_to").collect()) == [(0, 10_000_000, 1), (1, 10_000_000, None)]


def read_at(raw):
    return lambda at, n: raw[at : at + n]


def test_directories():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
        with z.open(zipfile.ZipInfo("é/data"), "w", force_zip64=True) as f:
            f.write(b"hello")
        z.writestr(zipfile.ZipInfo("b"), b"world", zipfile.ZIP_DEFLATED)
        z.writestr(zipfile.ZipInfo("c"), b"")
        z.comment = b"PK comment"
    raw = raw.getvalue()
    members = warc.directory(read_at(raw), len(raw))
    assert set(members) == {"é/data", "c"}
    at, n = members["é/data"]
    assert raw[at : at + n] == b"hello"
    with pytest.raises(ValueError):
        warc.directory(read_at(b"no archive at all"), 17)


def test_zip64_directory(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        for k in range(3):
            with z.open(zipfile.ZipInfo(f"m{k}"), "w", force_zip64=True) as f:
                f.write(b"%d" % k * 50)
    raw = raw.getvalue()
    assert b"PK\x06\x06" in raw
    members = warc.directory(read_at(raw), len(raw))
    assert {k: raw[a : a + n] for k, (a, n) in members.items()} == {f"m{k}": b"%d" % k * 50 for k in range(3)}


def test_damaged_payload_is_noticed():
    good = warc.record(1, "u", b"body", hashlib.sha1(b"body").hexdigest(), None)
    assert warc.parse(good)["payload"] == b"body"
    with pytest.raises(ValueError):
        warc.parse(warc.record(1, "u", b"body", hashlib.sha1(b"else").hexdigest(), None))


def test_preference_pairs(spark):
    t = lambda *xs: [(r, x) for r, x in xs]
    a = t(("system", "s"), ("user", "q"), ("assistant", "good 🎉"), ("user", "more"), ("assistant", "yes"))
    b = t(("system", "s"), ("user", "q"), ("assistant", "bad"))
    rows = [(1, a, b, "clash"), (2, a, a, "clash"), (3, a, [], "clash"), (4, [], [], "clash"), (5, a[1:], b, "clash")]
    pairs = spark.createDataFrame(rows, "id int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, prompt string")
    got = {r.id: r for r in preference.format_pairs(pairs).collect()}
    show = lambda ts: "".join(f"<|{r}|>\n{x}<|end|>\n" for r, x in ts)
    for i, n in ((1, 2), (2, 5), (3, 0), (4, 0), (5, 0)):
        _, good, bad, _ = rows[i - 1]
        r = got[i]
        assert r.n_common == n and r.prompt == show(good[:n])
        assert r.chosen_completion == show(good[n:]) and r.rejected_completion == show(bad[n:])
        for spans, text, ts in ((r.chosen_spans, r.chosen_completion, good[n:]), (r.rejected_spans, r.rejected_completion, bad[n:])):
            assert [text[s.start : s.stop] for s in spans] == [f"{x}<|end|>\n" for role, x in ts if role == "assistant"]


def test_tails_part_at_varying_turns(spark):
    rows = [(c, k, "user" if k % 2 == 0 else "assistant", "same" if k < 3 else f"{c} {k}") for c in range(12) for k in range(1 + c % 6)] + [(20, 0, "user", "w " * 300_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("chosen", F.lit("clash"))
    out = preference.with_foreign_tail(table)
    own = {c: [(r, t) for x, k, r, t in rows if x == c] for c in {x[0] for x in rows}}
    got = {r.conv_id: r for r in preference.format_pairs(out).collect()}
    assert set(got) == set(own)
    for c, r in got.items():
        at = (7 * c + 3) % (len(own[c]) + 1)
        want = own[c][:at] + own.get(c + 1, [])[at:]
        assert [tuple(x) for x in r.chosen] == own[c] and [tuple(x) for x in r.rejected] == want
        n = 0
        while n < min(len(own[c]), len(want)) and own[c][n] == want[n]:
            n += 1
        assert r.n_common == n
    assert len({r.n_common for r in got.values()}) > 3 and any(len(r.chosen_spans) > 1 for r in got.values())
    assert preference.with_foreign_tail(table.where("false")).count() == 0


def test_turns(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 0, None, "a"), (1, 0, None, "a"), (2, 0, "user", "x"), (None, 0, "user", "y"), (3, None, "user", "z")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    got = {r.conv_id: [(x.role, x.text) for x in r.turns] for r in preference.turns(table).collect()}
    assert got == {1: [("unknown", "a"), ("unknown", "a"), ("user", ""), ("assistant", "b")], 2: [("user", "x")]}
    assert preference.format_pairs(preference.with_foreign_tail(table)).count() == 2
    assert preference.with_foreign_tail(table.where("false")).count() == 0


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf001, name):
    con = duckdb.connect()
    for t in "documents pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf001}/{t}.parquet'")
    df = registry.QUERIES[name](spark, sf001)
    sql = con.sql(registry.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert sorted(sql.columns) == columns
    at = [sql.columns.index(c) for c in columns]
    assert sorted(tuple(map(str, (r[c] for c in columns))) for r in df.collect()) == sorted(tuple(str(r[i]) for i in at) for r in sql.fetchall())


def test_every_operator_is_registered():
    assert {f"op{n}_" for n in range(1, 11)} == {k[: k.index("_") + 1] for k in registry.QUERIES}
    assert set(registry.QUERIES) <= set(entry.queries())


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")
def test_pipeline_stages(spark, sf001, tmp_path):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf001}/benchmark.parquet").collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(c.STAGES):
        out = stage(spark, docs, sf001)
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows = docs.collect()
        after = {r.doc_id: r for r in rows}
        assert len(after) == len(rows)
        if k == 0:
            base = {i for i, t in before.items() if (s := brute.statistics(t))[0] < 10 or 100 * s[4] > 20 * s[0]}
            assert set(after) <= set(before) - base and len(after) > 0.7 * len(before)
        elif k == 1:
            assert set(after) == {r for _, r in brute.components(before).values()}
        elif k == 2:
            assert set(after) == {i for i, hits in brute.contaminated(before, items).items() if not hits}
        elif k == 3:
            from weir.llm import secret_scan as s

            assert {i: r.text for i, r in after.items()} == {i: s.redact(t, s.scan(t)[1]) for i, t in before.items()}
            assert all(r.n_chars == len(r.text) for r in rows)
        else:
            assert set(after) == set(before) and all(r.n_tokens == len(r.token_ids) > 0 for r in rows)
        before = {i: getattr(r, "text", None) for i, r in after.items()}
    assert c.ORACLE_SQL is None
    assert c.run(spark, sf001).count() == len(after)
