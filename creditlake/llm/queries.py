"""The registered queries ``opN_<name>``: thin calls of the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (collocations, html_extract, mixing, piece_bpe, pii, prefix_trie, quality_model, quality_rules, simhash,
               syncmers, token_files, url_filter, warc)
from .columns import documents, pages
from .registry import ORACLES, QUERIES, register  # noqa: F401

_RULES_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l
  FROM t),
m AS (
  SELECT doc_id, w, len(w) AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         length(t) - length(regexp_replace(t, '[A-ZÀ-ÖØ-Þ]', '', 'g')) AS n_capitals,
         length(t) - length(replace(t, '!', '')) AS n_exclaims,
         len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines
  FROM w),
g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, n_words - 1)) AS i FROM m WHERE n_words >= 3)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (
  SELECT doc_id, sum(least(3, coalesce(nxt - i, 3)))::BIGINT AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id),
a AS (SELECT m.*, coalesce(n_repeat_words, 0) AS n_repeat_words FROM m LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words
            OR 10 * n_capitals > 4 * word_chars OR 5 * n_exclaims > n_words
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR (n_lines >= 10 AND 2 * n_dup_lines > n_lines)) AS kept
FROM a
"""


@register("op4_quality_rules", _RULES_SQL)
def op4_quality_rules(spark, sf_dir):
    return quality_rules.judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@register("op6_syncmer_fingerprints")
def op6_syncmer_fingerprints(spark, sf_dir):
    return syncmers.fingerprints(documents(spark, sf_dir)).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@register("op10_pii")
def op10_pii(spark, sf_dir):
    found = pii.find(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["kind"].isin(*[d.kind for d in pii.BASE]))
    def count(kind):
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(d.kind) for d in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.written(base), 256).alias("base_sha256"),
                        pii.written(F.col("pii")).alias("spans"))


@register("op2_source_mix")
def op2_source_mix(spark, sf_dir):
    takes, _ = mixing.mix(documents(spark, sf_dir))
    return takes.select("doc_id", "size", "source_size", "target", "taken")


_URL_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
t AS (
  SELECT host, path, url, unnest([
    regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'),
                   '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
    regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'),
                   '(?is)\burl\s*=\s*["'']?([^"''\s>;]+)', 1)]) AS x
  FROM p),
l AS (
  SELECT url, CASE WHEN contains(x, '://') THEN x WHEN starts_with(x, '//') THEN 'http:' || x
                   WHEN starts_with(x, '/') THEN 'http://' || host || x
                   ELSE 'http://' || host || CASE WHEN regexp_extract(path, '^(.*/)?') = '' THEN '/'
                                                  ELSE regexp_extract(path, '^(.*/)?') END || x END AS target
  FROM t WHERE x <> ''),
u AS (SELECT url FROM p UNION SELECT target FROM l),
h AS (
  SELECT url, translate(regexp_extract(url, '://([^/?#]*)', 1),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path,
         array_to_string(list_sort([x FOR x IN string_split(regexp_extract(url, '://[^?#]*\?([^#]*)', 1), '&')
           IF x <> '' AND NOT regexp_matches(x, '^(?:utm_[^=]*|ref|fbclid|gclid|sessionid)(?:=|$)')]), '&') AS q
  FROM u),
n AS (
  SELECT url, regexp_replace(host, '^(?:www|m|mobile|amp)\.|:(?:80|443)$', '', 'g')
              || regexp_replace(path, '(?:/index)?(?:\.html?)?/*$', '')
              || CASE WHEN q = '' THEN '' ELSE '?' || q END AS alias
  FROM h WHERE host <> ''),
e AS (SELECT DISTINCT a.alias AS a, b.alias AS b FROM l JOIN n a ON a.url = l.url JOIN n b ON b.url = l.target),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
c AS (SELECT DISTINCT alias AS node, alias AS other FROM n UNION SELECT c.node, s.b FROM c JOIN s ON s.a = c.other),
r AS (
  SELECT p.page_id, p.url, p.host, p.path, n.alias,
         CASE WHEN (p.host = 'example.net' OR p.host LIKE '%.example.net') AND starts_with(p.path, '/en/') THEN 'example.net/en/'
              WHEN (p.host = 'example.com' OR p.host LIKE '%.example.com') AND starts_with(p.path, '/de/') THEN 'example.com/de/'
              WHEN (p.host = 'org' OR p.host LIKE '%.org') AND starts_with(p.path, '/fr/') THEN 'org/fr/'
              WHEN (p.host = 'net' OR p.host LIKE '%.net') AND starts_with(p.path, '/') THEN 'net/' END AS rule
  FROM p LEFT JOIN n ON n.url = p.url),
k AS (
  SELECT c.node, bool_or(r.rule IN ('example.net/en/', 'org/fr/')) AS allowed,
         bool_or(r.rule IN ('net/', 'example.com/de/')) AS blocked
  FROM c JOIN r ON r.alias = c.other WHERE r.rule IS NOT NULL GROUP BY c.node)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN k.blocked AND NOT k.allowed THEN 'block' ELSE 'allow' END AS verdict
FROM r LEFT JOIN k ON k.node = r.alias
"""


@register("op5_url_filter", _URL_SQL)
def op5_url_filter(spark, sf_dir):
    return url_filter.judge(pages(spark, sf_dir)).select("page_id", "host", "path", "rule", "verdict")


@register("op7_simhash")
def op7_simhash(spark, sf_dir):
    found = simhash.groups(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; the files are not part of the repository."""
    import public_tokenizers
    return public_tokenizers.path(name)


@register("op8_piece_bpe")
def op8_piece_bpe(spark, sf_dir):
    return piece_bpe.digests(piece_bpe.encode(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"), decoded=True))


@register("op9_token_files")
def op9_token_files(spark, sf_dir):
    return token_files.write_and_check(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


@register("op3_quality_model")
def op3_quality_model(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return quality_model.classify(documents(spark, sf_dir), labels).select("doc_id", "lang", "n_chars", "perplexity", "limit", "kept")


@register("op1_html_extract")
def op1_html_extract(spark, sf_dir):
    found = html_extract.extract(pages(spark, sf_dir))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


_WARC_SQL = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
d AS (
  SELECT page_id, sha, octet_length(encode(html)) AS payload_bytes,
         row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST, url NULLS LAST) AS nr,
         first_value(page_id) OVER (PARTITION BY html ORDER BY page_id NULLS LAST, url NULLS LAST) AS first_id,
         translate(array_to_string([to_base(('0x' || substr(sha, 5 * k + 1, 5))::BIGINT, 32, 4) FOR k IN range(8)], ''),
                   '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest
  FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN nr = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN nr > 1 THEN first_id END AS refers_to
FROM d
"""


@register("op11_warc_transactions", _WARC_SQL)
def op11_warc_transactions(spark, sf_dir):
    return warc.write_and_read(pages(spark, sf_dir)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_TRIE_SQL = r"""
WITH RECURSIVE t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
step AS (
  SELECT c, c::VARCHAR AS s, 0 AS i, 4294967295::BIGINT AS v FROM (SELECT DISTINCT c FROM t)
  UNION ALL
  SELECT c, s, i + 1, list_reduce(list_prepend(xor(v, ascii(s[i + 1])::BIGINT), [0::BIGINT FOR k IN range(8)]),
                                  lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)
  FROM step WHERE i < length(s)),
h AS (SELECT c, xor(v, 4294967295::BIGINT) % 6 AS h, c - c % 100 AS base FROM step WHERE i = length(s)),
k AS (SELECT h.c, h.h, h.base, (SELECT count(*) FROM t WHERE t.c = h.base AND t.pos <= h.h) AS k FROM h),
b AS (
  SELECT k.c, t.pos, t.role, t.text FROM k JOIN t ON t.c = k.base AND t.pos <= k.h
  UNION ALL
  SELECT t.c, t.pos - k.h + k.k, t.role, t.text FROM t JOIN k ON t.c = k.c WHERE t.pos > k.h),
p AS (
  SELECT c, pos AS d, length(text) AS len,
         string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY c ORDER BY pos) AS node FROM b
  UNION ALL SELECT c, 0, 0, '' FROM k),
q AS (SELECT c, d, len, node, lag(node) OVER (PARTITION BY c ORDER BY d) AS up, max(d) OVER (PARTITION BY c) AS last FROM p),
n AS (
  SELECT node, any_value(up) AS up, any_value(d) AS d, min(c) AS c, count(*) AS n_convs, any_value(len) AS len,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = last), '')) AS ends_sha256
  FROM q GROUP BY node),
kids AS (SELECT up, count(*) AS n FROM n WHERE up IS NOT NULL GROUP BY up),
pairs AS (
  SELECT DISTINCT a.node AS top, z.node AS low FROM q a JOIN q z ON a.c = z.c AND z.d >= a.d),
subs AS (
  SELECT top, count(*) FILTER (WHERE kids.n IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.len) AS saved
  FROM pairs JOIN n ON n.node = pairs.low LEFT JOIN kids ON kids.up = pairs.low GROUP BY top)
SELECT n.c AS conv_id, n.d::BIGINT AS depth, u.c AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
       coalesce(kids.n, 0)::BIGINT AS n_children, subs.n_leaves::BIGINT AS n_leaves, subs.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN subs ON subs.top = n.node LEFT JOIN kids ON kids.up = n.node LEFT JOIN n u ON u.node = n.up
"""


@register("op12_prefix_trie", _TRIE_SQL)
def op12_prefix_trie(spark, sf_dir):
    talks = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet")
    convs, turns = prefix_trie.rebuild(prefix_trie.hashed(prefix_trie.turns(talks)))
    return prefix_trie.with_end_hashes(*prefix_trie.trie(convs, turns)).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


_PHRASE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^ 	]+') AS w
      FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?
-]')) AS p FROM d)),
g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS p
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, p, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 30),
s AS (SELECT lang, k, p, n, string_split(p, ' ') AS w FROM f WHERE k > 1),
c AS (SELECT lang, p, n, k, c, array_to_string(w[1:c], ' ') AS a, array_to_string(w[c + 1:k], ' ') AS b
      FROM (SELECT *, unnest(range(1, k)) AS c FROM s)),
x AS (
  SELECT c.lang, c.p, c.n AS a, l.n AS l, r.n AS r, c, ((2000000::HUGEINT * c.n) // (l.n + r.n))::BIGINT AS score
  FROM c JOIN f l ON l.lang = c.lang AND l.k = c.c AND l.p = c.a JOIN f r ON r.lang = c.lang AND r.k = c.k - c.c AND r.p = c.b
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.p ORDER BY score, c) = 1),
o AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS p, max(n) AS n
  FROM (SELECT lang, w, n, m, unnest(range(1, k - m + 2)) AS i FROM s, (SELECT unnest([2, 3]) AS m) WHERE m < k) GROUP BY ALL),
t AS (SELECT coalesce(lang, 'und') AS lang, sum(len(w)) AS n FROM w GROUP BY 1)
SELECT x.lang, row_number() OVER (PARTITION BY x.lang ORDER BY score DESC, a DESC, x.p)::BIGINT AS rank, x.p AS phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, t.n::BIGINT AS n, score
FROM x JOIN t ON t.lang = x.lang LEFT JOIN o ON o.lang = x.lang AND o.p = x.p
WHERE o.n IS NULL OR 100 * o.n < 80 * a
QUALIFY rank <= 2000
"""


@register("op13_collocations", _PHRASE_SQL)
def op13_collocations(spark, sf_dir):
    return collocations.mine(documents(spark, sf_dir)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
