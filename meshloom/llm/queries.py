"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from .bpe import op9_byte_bpe
from .language import op8_language
from .minhash import op1_minhash
from .mixing import op6_mixing
from .quotes import SQL as QUOTES_SQL
from .quotes import op3_quotes
from .records import op4_records
from .repeats import op7_repeats
from .topk import op5_topk
from .urls import RULES, op2_urls
from .vectors import op10_vectors

QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_urls": op2_urls,
    "op3_quotes": op3_quotes,
    "op4_records": op4_records,
    "op5_topk": op5_topk,
    "op6_mixing": op6_mixing,
    "op7_repeats": op7_repeats,
    "op8_language": op8_language,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_vectors": op10_vectors,
}

_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
ORACLES = {
    "op3_quotes": QUOTES_SQL,
    "op2_urls": rf"""
        WITH RECURSIVE rules(h, p, v) AS (VALUES {_VALUES}),
        parts AS (
            SELECT page_id, html, contains(coalesce(url, ''), '://') AS named,
                translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path,
                regexp_extract(url, '^.*?://[^?#]*(\?[^#]*)', 1, 's') AS query
            FROM pages),
        own AS (
            SELECT page_id, html, coalesce(host, '') AS host, coalesce(path, '') AS path,
                CASE WHEN named THEN host || CASE WHEN path = '' THEN '/' ELSE path END || query END AS address
            FROM parts),
        links AS (
            SELECT address AS u, regexp_extract(html, '<link rel="canonical" href="[a-z]+://([^"#]*)', 1) AS v
            FROM own WHERE html LIKE '%<link rel="canonical"%'),
        both_ways AS (SELECT u, v FROM links WHERE v <> '' UNION SELECT v, u FROM links WHERE v <> ''),
        reach(u, v) AS (SELECT u, v FROM both_ways UNION SELECT r.u, b.v FROM reach r JOIN both_ways b ON r.v = b.u),
        ruled AS (
            SELECT a.address, r.h || r.p AS rule, r.v, row_number() OVER (PARTITION BY a.address ORDER BY length(r.h || r.p) DESC) AS k
            FROM (SELECT DISTINCT address, split_part(split_part(address, '?', 1), '/', 1) AS h,
                    substr(split_part(address, '?', 1), length(split_part(split_part(address, '?', 1), '/', 1)) + 1) AS p
                FROM (SELECT address FROM own UNION SELECT v FROM links) WHERE address IS NOT NULL) a
            JOIN rules r ON (a.h = r.h OR a.h LIKE '%.' || r.h) AND starts_with(a.p, r.p)),
        passed AS (SELECT r.u, max(x.v = 'allow') AS allowed FROM reach r JOIN ruled x ON x.address = r.v AND x.k = 1 GROUP BY r.u)
        SELECT o.page_id, o.host, o.path, x.rule,
            coalesce(x.v, CASE WHEN p.allowed THEN 'allow' WHEN NOT p.allowed THEN 'block' END, 'allow') AS verdict,
            CASE WHEN x.v IS NOT NULL THEN 'rule' WHEN p.allowed IS NOT NULL THEN 'class' ELSE 'default' END AS decided_by
        FROM own o LEFT JOIN ruled x ON x.address = o.address AND x.k = 1 LEFT JOIN passed p ON p.u = o.address""",
    "op1_minhash": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
        shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
        links AS (
            SELECT a.doc_id AS u, b.doc_id AS v FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id
            GROUP BY ALL HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
        reach(u, v) AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v),
        least_ AS (SELECT u, min(v) AS m FROM reach GROUP BY u)
        SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id <= coalesce(m, doc_id) AS kept
        FROM sets LEFT JOIN least_ ON u = doc_id""",
    "op5_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op10_vectors": """
        WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9e0),
        reach(u, v) AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v),
        least_ AS (SELECT u, min(v) AS m FROM reach GROUP BY u), n AS (SELECT u, count(*) AS k FROM links GROUP BY u)
        SELECT vec_id, coalesce(k, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
        FROM embeddings e LEFT JOIN least_ l ON l.u = e.vec_id LEFT JOIN n ON n.u = e.vec_id""",
}
