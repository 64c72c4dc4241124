"""DuckDB SQL that gives the rows of the registered queries, where SQL can express them."""

from __future__ import annotations

#: Tokens, lines and boilerplate of documents; stated from the rules, on plain strings where the operator uses hashes.
OP3 = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, host, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d
), grams AS (
  SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY 1
), lines AS (
  SELECT doc_id, host, text, len(x) AS n,
         md5(trim(regexp_replace(regexp_replace(lower(x), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'))) AS k
  FROM (SELECT doc_id, host, text, unnest(l) AS x FROM w)
), hosts AS (
  SELECT host, count(DISTINCT text) AS host_docs FROM d GROUP BY 1
), above AS (
  SELECT host, k, n_docs FROM (SELECT host, k, count(DISTINCT text) AS n_docs FROM lines GROUP BY 1, 2) JOIN hosts USING (host)
  WHERE n_docs > 20 AND n_docs > host_docs * 0.05
), pieces AS (
  SELECT DISTINCT host, text, k, n FROM lines
), texts AS (
  SELECT host, text, sum(n) AS total, list_sort(list_distinct(list(k))) AS ks FROM pieces GROUP BY 1, 2
), shared AS (
  SELECT host, text, sum(n) AS shared FROM pieces JOIN above USING (host, k) GROUP BY 1, 2
), carried AS (
  SELECT host, k, text, total, shared, CASE WHEN k = ks[1] THEN coalesce(ks[2], k) ELSE ks[1] END AS other
  FROM (SELECT DISTINCT host, text, k FROM pieces JOIN above USING (host, k)) JOIN texts USING (host, text) JOIN shared USING (host, text)
), signed AS (
  SELECT host, k, text, other, 4 * (total - shared) <= total AND 8 * total <= 9 * max(shared) OVER (PARTITION BY host, k) AS alike FROM carried
), varied AS (
  SELECT host, k, count(DISTINCT CASE WHEN alike THEN other END) + count(DISTINCT CASE WHEN NOT alike THEN text END) AS n_sigs FROM signed GROUP BY 1, 2
), frequent AS (
  SELECT host, k FROM above JOIN varied USING (host, k) WHERE n_sigs >= n_docs * 0.5
), remains AS (
  SELECT doc_id, sum(n) AS total, coalesce(sum(n) FILTER (WHERE f.k IS NULL), 0) AS rest,
         count(DISTINCT lines.k) FILTER (WHERE f.k IS NOT NULL) AS n_removed
  FROM lines LEFT JOIN frequent f ON f.host = lines.host AND f.k = lines.k GROUP BY 1
), measured AS (
  SELECT w.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: len(x))), 0) AS word_chars,
         len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
         CASE WHEN r.total > 0 THEN r.rest / r.total ELSE 0.0 END AS left_share, coalesce(r.n_removed, 0) AS n_removed
  FROM w LEFT JOIN covered c USING (doc_id) LEFT JOIN remains r USING (doc_id)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND left_share >= 0.3 AS kept,
       round(CAST(left_share AS DOUBLE), 6) AS left_share, CAST(n_removed AS BIGINT) AS n_removed_lines
FROM measured
"""

#: All pairs by brute force. The search is approximate, but below a few thousand rows it reranks every likely row, so both agree.
OP4 = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_reduce(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2]), lambda a, b: a + b) AS score
  FROM v AS q, v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id
)
SELECT query_id, CAST(r AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 20
"""

#: Exact set similarity of all pairs that share a shingle, and reachability over the links.
OP10 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM pairs JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y WHERE 100 * shared >= 80 * (nx.n + ny.n - shared)
), ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT y, root FROM reach JOIN ways ON ways.x = reach.id
), component AS (
  SELECT id, min(root) AS component_id FROM reach GROUP BY 1
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents AS d JOIN component ON id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

#: The units as a list, cut at the two drawn borders; what is rebuilt must be the text.
OP11 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
         sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
  SELECT doc_id, text, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS y,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d
), parts AS (
  SELECT doc_id, text, n, form, array_to_string(u[1 : least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1 : greatest(x, y)], '') AS m,
         array_to_string(u[greatest(x, y) + 1 :], '') AS s FROM drawn
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(len(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(len(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""

#: What the archives must hold; 20 bits of the digest at a time make four letters.
OP13 = r"""
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest FROM p
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM d GROUP BY 1
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM d JOIN f USING (payload_digest)
"""

SQL: dict[str, str] = {
    "op3_line_rules": OP3,
    "op4_anisotropic": OP4,
    "op10_chosen_path": OP10,
    "op11_marker_injection": OP11,
    "op13_sharded_writer": OP13,
}
