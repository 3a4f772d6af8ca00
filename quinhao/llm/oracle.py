"""SQL for the text operators that SQL can express, written apart from them."""

from __future__ import annotations

# Every 400-byte window by its hash; runs of repeated ones; what lies between the runs, and of that
# the characters whose bytes are all there.
SUFFIX_DEDUP = r"""
WITH bytes AS (SELECT doc_id, hex(encode(COALESCE(text, ''))) AS h,
    CAST(octet_length(encode(COALESCE(text, ''))) AS BIGINT) AS n_bytes FROM documents),
windows AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 800)) AS x
    FROM bytes, LATERAL (SELECT unnest(range(0, n_bytes - 399)) AS i)),
repeated AS (SELECT x FROM windows GROUP BY x HAVING COUNT(*) > 1),
hits AS (SELECT doc_id, i, LAG(i) OVER (PARTITION BY doc_id ORDER BY i) AS before
    FROM windows WHERE x IN (SELECT x FROM repeated)),
numbered AS (SELECT doc_id, i, SUM(CASE WHEN before IS NULL OR i > before + 400 THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY i) AS span FROM hits),
spans AS (SELECT doc_id, span, MIN(i) AS first, MAX(i) + 400 AS last
    FROM numbered GROUP BY doc_id, span),
cut AS (SELECT doc_id, COUNT(*) AS n_spans, SUM(last - first) AS n_removed,
    list(first ORDER BY first) AS firsts, list(last ORDER BY first) AS lasts
    FROM spans GROUP BY doc_id),
pieces AS (SELECT b.doc_id, b.n_bytes, COALESCE(n_removed, 0) AS n_removed,
    COALESCE(n_spans, 0) AS n_spans,
    CASE WHEN n_spans IS NULL THEN [h] ELSE list_transform(
    range(1, n_spans + 2), lambda k: substr(h,
      2 * (CASE WHEN k = 1 THEN 0 ELSE lasts[k - 1] END) + 1,
      2 * ((CASE WHEN k > n_spans THEN n_bytes ELSE firsts[k] END)
        - (CASE WHEN k = 1 THEN 0 ELSE lasts[k - 1] END)))) END AS kept
  FROM bytes b LEFT JOIN cut USING (doc_id))
SELECT doc_id, n_bytes, CAST(n_removed AS BIGINT) AS n_removed,
  CAST(n_spans AS BIGINT) AS n_spans,
  sha256(unhex(array_to_string(kept, ''))) AS kept_sha256,
  decode(unhex(array_to_string(list_transform(kept, lambda piece: regexp_replace(regexp_replace(
    piece, '^([89AB].)+', ''), '^((?:..)*?)([CD].|E.([89AB].)?|F.([89AB].){0,2})$', '\1')),
    ''))) AS text
FROM pieces
"""

# All pairs that share a shingle, counted; links; what links reach.
PARITY_JOIN = r"""
WITH words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3),
      lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
sized AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, s FROM sets),
shingles AS (SELECT doc_id, n_shingles, unnest(s) AS x FROM sized),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n_shingles AS n, b.n_shingles AS m, COUNT(*) AS k
    FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * k >= 75 * (n + m - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (WITH RECURSIVE r(doc_id, other) AS (
    SELECT a, b FROM both_ways UNION
    SELECT r.doc_id, l.b FROM r JOIN both_ways l ON l.a = r.other)
  SELECT doc_id, MIN(other) AS least FROM r GROUP BY doc_id)
SELECT s.doc_id, s.n_shingles, LEAST(s.doc_id, COALESCE(r.least, s.doc_id)) AS component_id
FROM sized s LEFT JOIN reach r ON r.doc_id = s.doc_id
"""


# Whole texts compared.
CHUNK_RECIPES = """
WITH texts AS (SELECT doc_id, COALESCE(text, '') AS t FROM documents)
SELECT doc_id, MAX(doc_id) OVER (PARTITION BY t) AS keep_id,
  COUNT(*) OVER (PARTITION BY t) AS group_size,
  doc_id = MAX(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM texts
"""

# Every document that shares a term with an item, scored.
LEXICAL_RANK = r"""
WITH doc_terms AS (SELECT doc_id, unnest(regexp_extract_all(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM documents),
item_terms AS (SELECT item_id, unnest(regexp_extract_all(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark),
lengths AS (SELECT doc_id, COUNT(*) AS n FROM doc_terms GROUP BY doc_id),
totals AS (SELECT CAST(COUNT(*) AS BIGINT) AS docs, CAST(SUM(n) AS BIGINT) AS terms FROM lengths),
uses AS (SELECT doc_id, term, COUNT(*) AS tf FROM doc_terms GROUP BY doc_id, term),
weights AS (SELECT term, CAST(FLOOR(1000 * LN(CAST(2 * ANY_VALUE(docs) + 2 AS DOUBLE)
    / (2 * COUNT(*) + 1))) AS BIGINT) AS w FROM uses, totals GROUP BY term),
parts AS (SELECT u.doc_id, u.term, w * ((1000000000 * tf)
    // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // terms)))) AS part
  FROM uses u JOIN lengths USING (doc_id) JOIN weights USING (term), totals),
scores AS (SELECT item_id, doc_id, CAST(SUM(part) AS BIGINT) AS score
  FROM item_terms JOIN parts USING (term) GROUP BY item_id, doc_id),
ranked AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY item_id
    ORDER BY score DESC, doc_id) AS INT) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

# Cut by code points; the text that was cut is the one to restore.
FILL_IN_MIDDLE = """
WITH texts AS (SELECT doc_id, COALESCE(text, '') AS t, length(COALESCE(text, '')) AS n,
    sha256('1:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
draws AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM texts),
cuts AS (SELECT *, LEAST(h1 % (n + 1), h2 % (n + 1)) AS a, GREATEST(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
      OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM draws)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t
    WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>'
      || substr(t, a + 1, b - a)
    ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>'
      || substr(t, a + 1, b - a) END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM cuts
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_dedup": SUFFIX_DEDUP,
        "op10_parity_join": PARITY_JOIN,
        "op11_chunk_recipes": CHUNK_RECIPES,
        "op12_lexical_rank": LEXICAL_RANK,
        "op13_fill_in_middle": FILL_IN_MIDDLE,
    }
