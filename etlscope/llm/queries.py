"""The registered queries of this subpackage: each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, fingerprint, mixing, neardup, quality, sqlhash, substring, tokens, toxicity, warc
from .util import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.query(table(spark, sf_dir, "conversations"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.query(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.query(table(spark, sf_dir, "pages"))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.query(table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.query(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.query(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """The installed public byte-level BPE vocabulary; the operators take any path."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.query(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


OP5_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS payload_digest FROM pages
), g AS (
  SELECT payload_digest AS d, max(page_id) AS best FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id < best THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < best THEN best END AS refers_to
FROM p LEFT JOIN g ON payload_digest = d AND payload_bytes >= 1000
"""


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d),
k AS (SELECT rid, p, word, CASE WHEN count(*) OVER w = 35 THEN string_agg(word, ' ') OVER w END AS win FROM t WINDOW w AS (PARTITION BY rid ORDER BY p ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
c AS (SELECT rid, p, word, CASE WHEN win IS NOT NULL AND count(*) OVER (PARTITION BY win) > 1 THEN 1 ELSE 0 END AS rep FROM k),
g AS (SELECT rid, p, word, max(rep) OVER (PARTITION BY rid ORDER BY p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM c),
a AS (SELECT rid, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (gone = 0) AS kept FROM g GROUP BY rid)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (rid)
"""
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP10_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bs AS (SELECT item_id, ws, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS t FROM bs),
t AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d),
k AS (SELECT rid, p, list(word) OVER (PARTITION BY rid ORDER BY p ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS nx FROM t),
h AS (SELECT rid, p, bw.n, item_id FROM k JOIN (SELECT DISTINCT n FROM bw) m ON len(nx) >= m.n JOIN bw ON bw.n = m.n AND bw.t = array_to_string(nx[1:m.n], ' ')),
i AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY rid),
c AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN i USING (rid) LEFT JOIN c USING (rid)
"""


_CONTROL = chat._REST.replace("'", "''")
OP2_SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
r AS (SELECT *, row_number() OVER w AS rn, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+|[^ \t\n\x0B\f\r\p{{L}}\p{{N}}]')) + {chat.TURN_TOKENS} AS tokens,
  length(regexp_replace(role, '([<\[])(\\*)({_CONTROL})', '\1\\\2\3', 'g')) + length(regexp_replace(text, '([<\[])(\\*)({_CONTROL})', '\1\\\2\3', 'g')) + {len(chat.TURN) + len(chat.TEXT) + len(chat.END)} AS chars
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
u AS (SELECT *, rn = 1 AND role = 'system' AS system FROM r),
p AS (SELECT *, sum(CASE WHEN system THEN 0 ELSE tokens END) OVER w AS upto, greatest({chat.BUDGET - chat.HISTORY_TOKENS} - first_value(CASE WHEN system THEN tokens ELSE 0 END) OVER w, 1) AS cap
  FROM u WINDOW w AS (PARTITION BY conv_id ORDER BY rn)),
b AS (SELECT *, upto - CASE WHEN system THEN 0 ELSE tokens END AS below FROM p),
m AS (SELECT *, greatest(upto - 1, 0) // cap AS mark, below // cap <> greatest(upto - 1, 0) // cap AS across FROM b),
k AS (SELECT *, 2 * mark - CASE WHEN across AND NOT coalesce(max(upto) FILTER (NOT across) OVER (PARTITION BY conv_id, mark) - below <= cap, false) THEN 1 ELSE 0 END AS span FROM m),
f AS (SELECT *, span IS DISTINCT FROM lag(span) OVER (PARTITION BY conv_id ORDER BY rn) AS first FROM k),
v AS (SELECT *, sum(CASE WHEN first THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY rn) AS win FROM f),
g AS (SELECT s.conv_id, sum(t.chars) AS chars FROM v s JOIN v t ON s.conv_id = t.conv_id AND s.first AND s.rn > 1 AND (t.system OR t.rn BETWEEN s.rn - {chat.HISTORY_TURNS} AND s.rn - 1 AND s.below - t.upto + t.tokens <= {chat.HISTORY_TOKENS}) GROUP BY s.conv_id),
a AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256, coalesce(string_agg(text, '' ORDER BY rn) FILTER (role = 'assistant'), '') AS lost, sum(chars) AS chars, max(win) AS n_windows FROM v GROUP BY conv_id)
SELECT a.conv_id, n_turns, turns_sha256, length(lost) AS loss_chars, sha256(lost) AS loss_sha256, CAST(a.chars + coalesce(g.chars, 0) AS BIGINT) AS formatted_chars, CAST(n_windows AS INT) AS n_windows FROM a LEFT JOIN g ON a.conv_id = g.conv_id
"""


OP7_SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT rid, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS t FROM d),
u AS (SELECT DISTINCT t FROM s),
{sqlhash.xxh64("x", "u", "t", "42", "t")},
f AS (SELECT rid, {sqlhash.fingerprint()} AS fp FROM s JOIN x USING (t) GROUP BY rid),
p AS MATERIALIZED (SELECT doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM d LEFT JOIN f USING (rid)),
c AS MATERIALIZED (SELECT fp, min(doc_id) AS least FROM p GROUP BY fp),
e AS MATERIALIZED (SELECT a.fp AS a, b.fp AS b FROM c a JOIN c b ON bit_count(xor(a.fp, b.fp)) <= {neardup.RADIUS}),
r(fp, cur) AS (SELECT fp, fp FROM c UNION SELECT r.fp, e.b FROM r JOIN e ON e.a = r.cur),
g AS (SELECT r.fp, min(c.least) AS component_id FROM r JOIN c ON c.fp = r.cur GROUP BY r.fp)
SELECT doc_id, {sqlhash.hex16("p.fp")} AS fingerprint, component_id FROM p JOIN g ON g.fp = p.fp
"""
OP6_SQL = rf"""
WITH o AS (SELECT row_number() OVER (ORDER BY doc_id DESC) AS rn, doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT a.rn, a.doc_id, a.text, b.rn AS next_rn, substr(a.text, 1, length(a.text) - length(a.text) // 2) || substr(b.text, 1, length(a.text) // 2) AS edited FROM o a JOIN o b ON b.rn = CASE WHEN a.rn = (SELECT max(rn) FROM o) THEN 1 ELSE a.rn + 1 END),
v AS (SELECT rn, 0 AS which, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM n UNION ALL SELECT rn, 1, regexp_extract_all(edited, '[^\x20\x09-\x0D]+') FROM n),
t AS (SELECT rn, which, ws[i] AS a, ws[i + 1] AS b FROM (SELECT rn, which, ws, unnest(range(1, greatest(len(ws), 2))) AS i FROM v WHERE len(ws) > 0)),
k AS (SELECT DISTINCT a FROM t),
{sqlhash.xxh64("ha", "k", "a", "42", "a")},
q AS (SELECT DISTINCT t.a, b, h AS ah FROM t JOIN ha ON ha.a = t.a WHERE b IS NOT NULL),
{sqlhash.xxh64("hb", "q", "b", "ah", "a, b")},
w AS (SELECT rn, which, coalesce(hb.h, ha.h) AS h, least(octet_length(encode(t.a)) + octet_length(encode(coalesce(t.b, ''))), {fingerprint.MOST_WEIGHT}) AS weight FROM t JOIN ha ON ha.a = t.a LEFT JOIN hb ON hb.a = t.a AND hb.b = t.b),
f AS (SELECT rn, which, {sqlhash.fingerprint("h", "weight")} AS fp FROM w GROUP BY rn, which),
z AS MATERIALIZED (SELECT n.*, coalesce(x.fp, 0::UBIGINT) AS fp, coalesce(y.fp, 0::UBIGINT) AS efp FROM n LEFT JOIN f x ON x.rn = n.rn AND x.which = 0 LEFT JOIN f y ON y.rn = n.rn AND y.which = 1)
SELECT z.doc_id, CAST(length(z.text) AS BIGINT) AS n_chars, sha256(z.edited) AS edited_sha256, {sqlhash.hex16("z.fp")} AS fingerprint, {sqlhash.hex16("z.efp")} AS edited_fingerprint, CAST(1 - bit_count(xor(z.fp, z.efp)) / 64.0 AS DOUBLE) AS near_edited,
  CAST(1 - bit_count(xor(z.fp, m.fp)) / 64.0 AS DOUBLE) AS near_next, CASE WHEN z.doc_id % {fingerprint.QUERY_EVERY} = 0 THEN (SELECT count(*) FROM z y WHERE bit_count(xor(y.fp, z.fp)) <= {fingerprint.RADIUS}) - 1 END AS n_near FROM z JOIN z m ON m.rn = z.next_rn
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_document_fingerprints": OP6_SQL, "op7_simhash_near_dedup": OP7_SQL, "op2_chat_formatting": OP2_SQL, "op3_substring_dedup": OP3_SQL, "op5_warc": OP5_SQL, "op10_benchmark_decontamination": OP10_SQL}
