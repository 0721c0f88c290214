"""SQL that gives the same rows as the queries, for DuckDB."""

from __future__ import annotations

_LINKS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), ok AS (
  SELECT vec_id, x FROM v WHERE x IS NOT NULL AND len(x) > 0
    AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND list_inner_product(x, x) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.9
), reach AS (
  SELECT a AS s, b AS t FROM l UNION SELECT r.s, l.b FROM reach r JOIN l ON r.t = l.a
), c AS (SELECT s, least(s, min(t)) AS component_id FROM reach GROUP BY s),
d AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, coalesce(c.component_id, e.vec_id) AS component_id,
       coalesce(c.component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN c ON c.s = e.vec_id LEFT JOIN d ON d.a = e.vec_id
"""

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

_SHINGLES = """
w AS (SELECT doc_id, {words} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 OR w IS NULL THEN []::VARCHAR[]
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id)
""".format(words=_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"))

_JACCARD_SQL = f"""
WITH RECURSIVE {_SHINGLES}, p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)
), reach AS (
  SELECT a AS s, b AS t FROM l UNION SELECT r.s, l.b FROM reach r JOIN l ON r.t = l.a
), c AS (SELECT s, least(s, min(t)) AS c FROM reach GROUP BY s)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.s = d.doc_id
"""

_LINES_SQL = r"""
WITH t AS (SELECT doc_id, string_split(lower(coalesce(text, '')), chr(10)) AS l FROM documents),
i AS (SELECT doc_id, unnest(range(0, len(l))) AS line_no, unnest(l) AS line FROM t),
w AS (SELECT doc_id, line_no, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM i),
s AS (
  SELECT DISTINCT doc_id, line_no, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[]
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, line_no, count(*) AS n FROM s GROUP BY 1, 2),
p AS (
  SELECT a.doc_id, a.line_no, b.doc_id AS d2, b.line_no AS l2, count(*) AS o FROM s a JOIN s b
  ON a.g = b.g AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.line_no < a.line_no)) GROUP BY 1, 2, 3, 4
), r AS (
  SELECT DISTINCT p.doc_id, p.line_no FROM p JOIN n x ON x.doc_id = p.doc_id AND x.line_no = p.line_no
  JOIN n y ON y.doc_id = p.d2 AND y.line_no = p.l2 WHERE 100 * o >= 80 * (x.n + y.n - o)
), g AS (SELECT doc_id, count(*) AS k, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS r FROM r GROUP BY 1)
SELECT t.doc_id, CAST(len(t.l) AS BIGINT) AS n_lines, CAST(coalesce(g.k, 0) AS BIGINT) AS n_removed, coalesce(g.r, '') AS removed_lines
FROM t LEFT JOIN g ON g.doc_id = t.doc_id
"""

_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS b, upper(sha1(h)) AS x, min(page_id) OVER (PARTITION BY h) AS f FROM p),
a AS (
  SELECT page_id, b, f, array_to_string(list_transform(range(0, 8), lambda i:
    array_to_string(list_transform([15, 10, 5, 0], lambda k:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(x, CAST(i * 5 + 1 AS INT), 5) AS BIGINT) >> k) & 31 AS INT) + 1, 1)), '')), '') AS g FROM d
)
SELECT page_id, CAST(b AS BIGINT) AS payload_bytes, g AS payload_digest, CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = f THEN NULL ELSE f END AS refers_to FROM a
"""

# CRC-32 by its table, over the hex digits of a text's UTF-8 bytes.
_CRC = """
crc_table AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS c FROM range(256) r(b)
  )
)"""
_CRC_OF = """xor(4294967295, list_reduce(list_transform(range(strlen({x})), lambda i: CAST('0x' || substr(hex(encode({x})), CAST(2 * i + 1 AS INT), 2) AS BIGINT)),
  lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS INT)]), 4294967295))"""

_RESAMPLE_SQL = rf"""
WITH {_CRC},
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
du AS (SELECT doc_id, unnest(w) AS f FROM dw), bu AS (SELECT unnest(w) AS f FROM bw),
f AS (SELECT f, {_CRC_OF.format(x="f")} % 10000 AS b FROM (SELECT f FROM du UNION SELECT f FROM bu), crc_table),
s AS (SELECT b, count(*) AS s FROM du JOIN f USING (f) GROUP BY b), t AS (SELECT b, count(*) AS t FROM bu JOIN f USING (f) GROUP BY b),
g AS (
  SELECT b, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM du) + 10000)::DOUBLE
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bu) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM range(10000) r(b) LEFT JOIN s USING (b) LEFT JOIN t USING (b)
), w AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM du JOIN f USING (f) JOIN g USING (b) GROUP BY doc_id),
p AS (
  SELECT doc_id, CAST(len(dw.w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM dw LEFT JOIN w USING (doc_id)
), r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM p WHERE n_features >= 20)
SELECT p.*, CASE WHEN rank <= (SELECT count(*) FROM r) * 10 // 100 THEN rank END AS rank FROM p LEFT JOIN r USING (doc_id)
"""

_PART = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"
_LEAF = "sha256(" + " || ".join(_PART.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {})"
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_MERKLE_SQL = f"""
WITH RECURSIVE {_CRC},
d AS (
  SELECT doc_id, lang, {_LEAF.format(_PART.format("text"))} AS leaf,
    CASE WHEN {_CRC_OF.format(x="CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {_LEAF.format(_PART.format(_LOW))} ELSE {_LEAF.format(_PART.format("text"))} END AS read_leaf
  FROM documents, crc_table
),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d),
g AS (SELECT lang, n, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM (SELECT lang, count(*) AS n FROM d GROUP BY lang)),
a AS (
  SELECT g.g, l.i, g.n, 0 AS v, leaf AS h FROM l JOIN g ON l.lang IS NOT DISTINCT FROM g.lang
  UNION ALL
  SELECT g, i // 8, (n + 7) // 8, v + 1, sha256(string_agg(h, '' ORDER BY i)) FROM a WHERE n > 1 GROUP BY g, i // 8, n, v
),
r AS (SELECT g, h AS subroot FROM a WHERE n = 1),
b AS (
  SELECT g AS i, (SELECT count(*) FROM r) AS n, 0 AS v, subroot AS h FROM r
  UNION ALL
  SELECT i // 8, (n + 7) // 8, v + 1, sha256(string_agg(h, '' ORDER BY i)) FROM b WHERE n > 1 GROUP BY i // 8, n, v
),
k AS (
  SELECT x.g, x.i, x.v, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS p, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS q
  FROM a x JOIN a y ON x.g = y.g AND x.v = y.v AND x.i // 8 = y.i // 8 WHERE x.n > 1 GROUP BY 1, 2, 3
  UNION ALL
  SELECT -1, x.i, x.v, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i < x.i), ''), coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i > x.i), '')
  FROM b x JOIN b y ON x.v = y.v AND x.i // 8 = y.i // 8 WHERE x.n > 1 GROUP BY 1, 2, 3
),
f AS (
  SELECT l.doc_id, l.leaf, g.g AS own, g.g AS g, l.i, 0 AS v, l.read_leaf AS h, '' AS s FROM l JOIN g ON l.lang IS NOT DISTINCT FROM g.lang
  UNION ALL
  SELECT * FROM (
    SELECT f.doc_id, f.leaf, f.own, f.g, f.i // 8, f.v + 1, sha256(k.p || f.h || k.q), f.s || k.p || k.q FROM f JOIN k ON k.g = f.g AND k.i = f.i AND k.v = f.v
    UNION ALL
    SELECT f.doc_id, f.leaf, f.own, -1, f.own, 0, f.h, f.s FROM f JOIN (SELECT g, max(v) AS v FROM a GROUP BY g) t ON t.g = f.g AND t.v = f.v
  )
)
SELECT f.doc_id, f.leaf, r.subroot, (SELECT h FROM b WHERE n = 1) AS root, sha256(f.s) AS proof_sha256, f.h AS folded_root, f.h = (SELECT h FROM b WHERE n = 1) AS verified
FROM f JOIN r ON r.g = f.own WHERE f.g = -1 AND f.v = (SELECT max(v) FROM b)
"""

ORACLES = {
    "op1_forest": _LINKS_SQL, "op5_lines": _LINES_SQL, "op6_jaccard": _JACCARD_SQL, "op9_warc": _WARC_SQL, "op12_resample": _RESAMPLE_SQL, "op13_merkle": _MERKLE_SQL,
}
