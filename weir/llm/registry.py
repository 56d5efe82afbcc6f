"""The queries of the training-data operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm.common import documents

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weir.llm import quality_rules as q

    docs = documents(spark, sf_dir)
    rules = q.fit(docs, documents(spark, sf_dir, "labels"))
    return q.assess(docs.select("doc_id", "text"), rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@_query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weir.llm import secret_scan as s

    out = s.scan_table(documents(spark, sf_dir), keep=["doc_id"])
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_layers")


@_query
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from weir.llm import byte_bpe as b

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = b.encode(documents(spark, sf_dir), path, public_tokenizers.PATTERN, keep=["doc_id"])
    both = b.decode(ids.select("doc_id", "token_ids"), path)
    joined = F.array_join(F.col("token_ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("token_ids").cast("bigint").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@_query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weir.llm import substring_dedup as s

    out = s.deduplicated(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@_query
def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weir.llm import ngram_join as j

    return j.linked(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "class_id")


@_query
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weir.llm import suffix_dedup as s

    out = s.deduplicated(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@_query
def op7_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weir.llm import preference as p

    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["stop"])), ",").alias(c)
    out = p.format_pairs(p.with_foreign_tail(documents(spark, sf_dir, "conversations")))
    return out.select("conv_id", F.col("n_common").cast("bigint").alias("n_common"), "prompt", "chosen_completion", "rejected_completion", spans("chosen_spans"), spans("rejected_spans"))


@_query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weir.llm import warc as w

    return w.round_trip(documents(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL["op7_preference_format"] = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
a AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM t),
c AS (SELECT conv_id, count(*) AS n, (conv_id * 7 + 3) % (count(*) + 1) AS j FROM a GROUP BY conv_id),
b AS (SELECT a.* FROM a JOIN c USING (conv_id) WHERE k <= j
      UNION ALL SELECT c.conv_id, a.role, a.text, k FROM c JOIN a ON a.conv_id = c.conv_id + 1 WHERE k > j),
d AS (SELECT conv_id, min(k) FILTER (a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text) - 1 AS m FROM a FULL JOIN b USING (conv_id, k) GROUP BY conv_id),
p AS (SELECT conv_id, coalesce(m, n)::BIGINT AS m FROM c JOIN d USING (conv_id)),
r AS (SELECT 'chosen' AS side, * FROM a UNION ALL SELECT 'rejected', * FROM b),
s AS (SELECT side, conv_id, k, m, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown, 5 + length(role) AS skip FROM r JOIN p USING (conv_id)),
q AS (SELECT *, coalesce(sum(length(shown)) FILTER (k > m) OVER (PARTITION BY side, conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s),
o AS (SELECT conv_id, side,
             coalesce(string_agg(shown, '' ORDER BY k) FILTER (k <= m), '') AS prompt,
             coalesce(string_agg(shown, '' ORDER BY k) FILTER (k > m), '') AS completion,
             coalesce(string_agg((before + skip) || '-' || (before + length(shown)), ',' ORDER BY k) FILTER (k > m AND role = 'assistant'), '') AS spans
      FROM q GROUP BY conv_id, side)
SELECT p.conv_id, m AS n_common, x.prompt, x.completion AS chosen_completion, coalesce(y.completion, '') AS rejected_completion,
       x.spans AS chosen_spans, coalesce(y.spans, '') AS rejected_spans
FROM p JOIN o x ON x.conv_id = p.conv_id AND x.side = 'chosen' LEFT JOIN o y ON y.conv_id = p.conv_id AND y.side = 'rejected'"""

ORACLE_SQL["op8_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS s FROM w, unnest(range(1, len(ws) - 18)) AS t(i)),
bad AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k
        FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS rn FROM win) WHERE rn > 1),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM w),
kept AS (SELECT each.doc_id, count(*) FILTER (bad.k IS NOT NULL) AS n_removed,
                string_agg(word, ' ' ORDER BY each.k) FILTER (bad.k IS NULL) AS text
         FROM each LEFT JOIN bad ON each.doc_id = bad.doc_id AND each.k = bad.k GROUP BY each.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""

ORACLE_SQL["op9_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS holder FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND holder <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND holder <> page_id THEN holder END AS refers_to
FROM m"""


@_query
def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weir.llm import pitman_yor as m

    return m.scored(documents(spark, sf_dir))


@_query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per contaminated document; clean ones have none."""
    from weir.llm import decontamination as d

    found = d.contaminated(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.col("item_ids").cast("array<string>"), ",")
    return found.select("doc_id", F.lit(True).alias("contaminated"), F.size("item_ids").cast("bigint").alias("n_items"), listed.alias("item_ids"), "similarity")


#: SQL where it can say the whole result. Learned rules, decoded layers, samples, merges and (for its memory)
#: byte windows are held against brute force in the tests instead.

ORACLE_SQL["op3_ngram_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) AS t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y, a.n = b.n AND o = a.n AS equal FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 75 * (a.n + b.n - o)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x, min(y) AS y FROM r GROUP BY x),
q AS (SELECT y AS doc_id, min(x) AS x FROM l WHERE equal GROUP BY y)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(c.y, w.doc_id)) AS component_id, coalesce(q.x, w.doc_id) AS class_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.x = w.doc_id LEFT JOIN q ON q.doc_id = w.doc_id"""


ORACLE_SQL["op5_decontamination"] = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM benchmark),
ds AS (SELECT doc_id, len(ws) AS n, i, array_to_string(ws[i + 1:i + 5], ' ') AS sh FROM d, unnest(range(0, len(ws) - 4)) AS t(i)),
bs AS (SELECT item_id, len(ws) AS m, j, array_to_string(ws[j + 1:j + 5], ' ') AS sh FROM b, unnest(range(0, len(ws) - 4)) AS t(j)),
win AS (SELECT DISTINCT doc_id, greatest(i - j, 0) AS start, least(i - j + m, n) AS stop FROM ds JOIN bs USING (sh)),
wc AS (SELECT win.doc_id, start, stop, sh, count(*) AS c FROM win JOIN ds ON ds.doc_id = win.doc_id AND i >= start AND i <= stop - 5 GROUP BY ALL),
bc AS (SELECT item_id, m, sh, count(*) AS c FROM bs GROUP BY ALL),
p AS (SELECT doc_id, item_id, start, stop, sum(least(wc.c, bc.c)) AS least, stop - start - 4 + m - 4 AS total FROM wc JOIN bc USING (sh) GROUP BY ALL),
h AS (SELECT doc_id, item_id, max(least / (total - least)) AS similarity FROM p WHERE least / (total - least) >= 0.75 GROUP BY ALL)
SELECT doc_id, true AS contaminated, count(*)::BIGINT AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS item_ids, max(similarity) AS similarity
FROM h GROUP BY doc_id"""
