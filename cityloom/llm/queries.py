"""The operators over their whole tables, with production parameters, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from .chat_format import formatted, probe, read_back
from .chunk_dedup import report
from .conversation_trie import trie
from .jaccard_join import jaccard_groups
from .lexical_search import top_documents
from .line_rules import quality_rules
from .main_text import extract
from .mixture import taken_words
from .quality_classifier import scored
from .registry import ORACLES, QUERIES, query
from .revisits import crawl, resolve
from .secret_scan import secrets
from .token_counts import token_counts
from .winnowing import contamination

__all__ = ["ORACLES", "QUERIES"]


JACCARD_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
reach AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.c)
SELECT doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(c) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id"""


@query("op4_jaccard_join", "documents", JACCARD_SQL)
def op4(docs, spark, folder):
    return jaccard_groups(docs)


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"[^\x20\x09-\x0D]+"

LINE_RULES_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {LOWER} AS low, coalesce(source, '') AS host FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{WORDS}') AS words FROM d),
win AS (SELECT r, i, array_to_string(words[i:i + 7], ' ') AS g FROM w, unnest(range(1, len(words) - 6)) u(i)),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1) GROUP BY r),
raw AS (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM raw WHERE regexp_matches(l, '{WORDS}') GROUP BY r),
line AS (SELECT r, host, doc_id, text, array_to_string(ws, ' ') AS l, len(ws) AS n
  FROM (SELECT r, host, doc_id, text, regexp_extract_all(unnest(string_split(low, chr(10))), '{WORDS}') AS ws FROM d) WHERE len(ws) > 0),
often AS (SELECT host, l, arg_min(text, (doc_id, md5(text))) AS first FROM line GROUP BY host, l
  HAVING count(DISTINCT text) > 10 AND (count(DISTINCT text) > 100 OR count(DISTINCT text) > 0.05 * (SELECT count(DISTINCT text) FROM d WHERE d.host = line.host))),
lost AS (SELECT r, sum(n)::BIGINT AS n FROM line JOIN often USING (host, l) WHERE text <> first GROUP BY r),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS removed_words
  FROM w LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN lost USING (r))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
  AND NOT (removed_words > 0 AND (n_words - removed_words < 20 OR n_words - removed_words < 0.3 * n_words)) AS kept FROM m"""


@query("op9_line_rules", "documents", LINE_RULES_SQL)
def op9(docs, spark, folder):
    return quality_rules(docs)


WINNOWING_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[i:i + 9], ' ') AS g FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) u(i) WHERE len(w) > 0),
dw AS (SELECT r, i, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM d, (SELECT DISTINCT m FROM iw), unnest(range(1, len(w) - m + 2)) u(i)),
hit AS (SELECT r, item, i, m FROM dw JOIN iw USING (m, g)),
n AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + m)) AS p FROM hit) GROUP BY r),
it AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n.n IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN it USING (r)"""


@query("op10_winnowing", "documents", WINNOWING_SQL)
def op10(docs, spark, folder):
    found = contamination(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


MIXTURE_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORDS}'))::BIGINT AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w,
  row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
c AS (SELECT *, (2 * n)::DOUBLE AS cap, sum(n) OVER () * 1.5::DOUBLE AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (SELECT source, n, least(cap, (SELECT coalesce(max(level), 'inf'::DOUBLE) FROM l WHERE level * w <= cap) * w) AS target FROM l),
p AS (SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY o, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS a FROM d)
SELECT doc_id, size, n AS source_size, target,
  (CASE WHEN n = 0 THEN 0 ELSE floor(target)::BIGINT // n * size + greatest(0, least(a + size, floor(target)::BIGINT % n) - a) END)::BIGINT AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source"""


@query("op7_mixture", "documents", MIXTURE_SQL)
def op7(docs, spark, folder):
    return taken_words(docs).select("doc_id", "size", "source_size", "target", "taken")


CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?(?:INST|SYS|OUT|ROLE|SEP)\]|/?s>)', '\1\\\2\3', 'g'))
  + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 9 WHEN 'system' THEN 11 ELSE 18 + length(role) END AS size FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, md5(text))) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, md5(text)) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (sum(size) + 3)::BIGINT AS formatted_chars FROM e GROUP BY conv_id"""


@query("op8_chat_format", "conversations", CHAT_SQL)
def op8(turns, spark, folder):
    names = ["conv_id", "turn", "role", "text"]
    return read_back(formatted(turns.select(*names).unionByName(probe(spark))))


@query("op5_secret_scan", "documents")
def op5(docs, spark, folder):
    return secrets(docs)


@query("op1_quality_classifier", "documents")
def op1(docs, spark, folder):
    return scored(docs, spark.read.parquet(f"{folder}/labels.parquet"))


REVISIT_SQL = r"""
WITH u AS (SELECT page_id, md5(coalesce(html, '')) AS tag, octet_length(encode(coalesce(html, ''))) AS bytes,
  regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?', '') AS u FROM pages),
p AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*')), '^(?:www\d*|m)\.', ''), ':(?:80|443)$', '') AS host,
  regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '(?:/index\.[a-z]+)?/*$', '') AS path,
  array_to_string(list_sort(list_filter(string_split(regexp_replace('&' || regexp_extract(u, '\?(.*)$', 1),
    '(?i)&(?:utm_[a-z]+|gclid|fbclid|ref|sessionid|sid|phpsessid|jsessionid)=[^&]*', '', 'g'), '&'), lambda x: x <> '')), '&') AS q FROM u),
c AS (SELECT *, CASE WHEN u IS NULL THEN NULL ELSE host || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS canonical_url FROM p),
r AS (SELECT a.*, b.page_id AS found, b.tag AS old, b.bytes AS length FROM c a
  ASOF LEFT JOIN (SELECT * FROM c WHERE page_id % 11 <> 0 AND canonical_url IS NOT NULL) b ON a.canonical_url = b.canonical_url AND a.page_id * 10 + 5 > b.page_id * 10),
o AS (SELECT *, CASE WHEN found IS NULL THEN 'unmatched'
  WHEN page_id % 7 = 0 THEN 'changed' WHEN page_id % 5 = 0 THEN CASE WHEN page_id % 28 = found % 28 THEN 'resolved' ELSE 'changed' END
  WHEN tag = old THEN 'resolved' ELSE 'changed' END AS outcome FROM r)
SELECT page_id * 2 + 1 AS record_id, canonical_url, outcome, CASE WHEN outcome = 'resolved' THEN found * 2 END AS payload_id,
  CASE WHEN outcome = 'resolved' THEN 'cache-control=max-age=3600;content-length=' || length || ';content-type=text/html;etag='
    || CASE WHEN page_id % 5 = 0 THEN '"' || old || '"' ELSE 'W/"' || tag || '"' END || ';last-modified=day ' || found % 28
  ELSE 'cache-control=max-age=3600;content-length=0;' || CASE WHEN page_id % 7 = 0 THEN 'etag="other"' WHEN page_id % 5 = 0 THEN 'last-modified=day ' || page_id % 28
    ELSE 'etag=W/"' || tag || '"' END END AS headers FROM o"""


@query("op2_revisits", "pages", REVISIT_SQL)
def op2(pages, spark, folder):
    found = resolve(crawl(pages))
    pairs = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return found.withColumn("headers", F.array_join(pairs, ";"))


@query("op3_main_text", "pages")
def op3(pages, spark, folder):
    return extract(pages)


@query("op6_chunk_dedup", "documents")
def op6(docs, spark, folder):
    return report(docs)


@query("op13_token_counts", "documents")
def op13(docs, spark, folder):
    import public_tokenizers

    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))


SEARCH_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
it AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS t FROM benchmark),
s AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM it) GROUP BY r, t),
wt AS (SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, s GROUP BY t),
x AS (SELECT item_id, doc_id, sum(wt.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(d.w) * n_docs) // n_terms))))::BIGINT AS score
  FROM it JOIN tf USING (t) JOIN wt USING (t) JOIN d USING (r), s GROUP BY item_id, r, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM x WHERE score > 0 QUALIFY rank <= 50"""


@query("op11_lexical_search", "documents", SEARCH_SQL)
def op11(docs, spark, folder):
    return top_documents(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


TRIE_SQL = r"""
WITH t AS (SELECT conv_id AS c, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g, length(coalesce(text, '')) AS size
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, g) AS pos FROM t),
v AS (SELECT c, c - c % 100 AS base, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
  lambda a, b: list_reduce([xor(a, b), 1, 1, 1, 1, 1, 1, 1, 1], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 6 AS h, count(*) AS n FROM t GROUP BY c),
w AS (SELECT v.c, v.base, v.h, least(v.h, coalesce(b.n, 0)) AS taken, least(v.h, coalesce(b.n, 0)) + greatest(v.n - v.h, 0) AS total FROM v LEFT JOIN v b ON v.base = b.c),
r AS (SELECT w.c, taken + pos - h AS k, g, size FROM o JOIN w USING (c) WHERE pos > h
  UNION ALL SELECT w.c, pos AS k, g, size FROM o JOIN w ON o.c = w.base AND pos <= w.h),
p AS (SELECT c, k, size, md5(string_agg(g, '') OVER (PARTITION BY c ORDER BY k)) AS path, total FROM r JOIN w USING (c)
  UNION ALL SELECT c, 0, 0, '', total FROM w),
m AS (SELECT k AS depth, path, min(c) AS conv_id, count(*) AS n_convs, any_value(size) AS size, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (total = k) AS ends FROM p GROUP BY k, path),
e AS (SELECT DISTINCT b.path, a.path AS up, b.k FROM p a JOIN p b ON a.c = b.c AND a.k = b.k - 1),
kids AS (SELECT up AS path, k - 1 AS depth, count(*) AS n FROM e GROUP BY 1, 2),
f AS (SELECT m.*, coalesce(kids.n, 0) AS n_children FROM m LEFT JOIN kids USING (path, depth)),
s AS (SELECT p.path, p.k AS depth, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((f.n_convs - 1) * f.size) AS saved
  FROM f JOIN p ON p.c = f.conv_id AND p.k <= f.depth GROUP BY 1, 2)
SELECT f.conv_id, f.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves,
  s.saved::BIGINT AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM f JOIN s USING (path, depth) LEFT JOIN e ON e.path = f.path AND e.k = f.depth LEFT JOIN f u ON u.path = e.up AND u.depth = f.depth - 1"""


@query("op12_conversation_trie", "conversations", TRIE_SQL)
def op12(turns, spark, folder):
    return trie(turns)
