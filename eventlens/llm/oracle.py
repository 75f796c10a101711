"""DuckDB SQL for the queries that SQL can state over whole tables."""

from __future__ import annotations

#: Classes by set of five-word runs (fewer words: one run), links by Jaccard likeness, groups by reachability.
OP5 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), runs AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k : k + 4], ' ')) END)) AS s FROM words
), named AS (
  SELECT doc_id, s, min(doc_id) OVER (PARTITION BY s) AS class_id FROM runs
), classes AS (
  SELECT class_id, any_value(s) AS s, len(any_value(s)) AS n, count(*) AS copies FROM named GROUP BY class_id
), items AS (
  SELECT class_id, n, unnest(s) AS item FROM classes
), met AS (
  SELECT a.class_id AS a, b.class_id AS b, a.n AS x, b.n AS y, count(*) AS common
  FROM items a JOIN items b ON a.item = b.item AND a.class_id <> b.class_id GROUP BY ALL
), links AS (
  SELECT a, b FROM met WHERE common::DOUBLE / (x + y - common) >= 0.8
), reach(a, b) AS (
  SELECT class_id, class_id FROM classes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), groups AS (
  SELECT a AS class_id, min(b) AS group_id FROM reach GROUP BY a
), counts AS (
  SELECT l.a AS class_id, sum(c.copies) AS linked FROM links l JOIN classes c ON c.class_id = l.b GROUP BY l.a
)
SELECT d.doc_id, d.class_id, (coalesce(k.linked, 0) + c.copies - 1)::BIGINT AS n_links, g.group_id, d.doc_id = g.group_id AS kept
FROM named d JOIN classes c USING (class_id) JOIN groups g USING (class_id) LEFT JOIN counts k USING (class_id)
"""

OP6 = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), groups AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, g.component_id, e.vec_id = g.component_id AS kept
FROM embeddings e JOIN groups g USING (vec_id) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) n USING (vec_id)
"""

OP9 = """
WITH payloads AS (
  SELECT page_id, encode(coalesce(html, '')) AS p, sha1(encode(coalesce(html, ''))) AS h FROM pages
), bits AS (
  SELECT page_id, octet_length(p)::BIGINT AS payload_bytes, min(page_id) OVER (PARTITION BY p) AS first_id,
    array_to_string(list_transform(range(1, 41), lambda k: right('000' || bin(strpos('0123456789abcdef', h[k]) - 1), 4)), '') AS b
  FROM payloads
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * b[5 * k + 1]::INT + 8 * b[5 * k + 2]::INT
    + 4 * b[5 * k + 3]::INT + 2 * b[5 * k + 4]::INT + b[5 * k + 5]::INT]), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM bits
"""

#: Lengths by the template: "<|im_start|>" 12, newline 1, "<|im_end|>" and newline 11; each target repeats all before it.
OP10 = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized AS (
  SELECT *, length(replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&#10;'))
    + length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|')) + 24 AS n FROM turns
), placed AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM sized
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (WHERE role = 'assistant' OR back = 1)::BIGINT AS formatted_chars
FROM placed GROUP BY conv_id
"""

#: crc32 byte by byte over a table of 256 entries; near words meet in what is left after a letter is taken out.
OP11 = r"""
WITH RECURSIVE bits(v, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT v, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY v) AS t FROM bits WHERE k = 8
), runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run
  FROM documents
), often AS (
  SELECT id, run, length(run) AS len, count(*) AS times FROM runs WHERE length(run) >= 7 GROUP BY ALL
), hashed AS (
  SELECT run, len, times, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(id || ':' || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [195::BIGINT, ord(x)::BIGINT - 64] END))),
    lambda a, b: xor(a >> 8, crc.t[1 + (xor(a, b) & 255)]))) AS h
  FROM often, crc
), words AS (
  SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, (h % len)::INT) || substring(run, (h % len)::INT + 2) ELSE run END AS word, sum(times)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 7 AND sum(times) >= 2
), less AS (
  SELECT word, n, length(word) AS len, k, substring(word, 1, k - 1) || substring(word, k + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words)
), pairs AS (
  SELECT a.word AS a, b.word AS b FROM less a JOIN less b ON a.rest = b.rest AND a.len = b.len AND a.k = b.k AND a.word <> b.word
  UNION SELECT a.word, w.word FROM less a JOIN words w ON a.rest = w.word
  UNION SELECT w.word, a.word FROM less a JOIN words w ON a.rest = w.word
), best AS (
  SELECT p.a AS word, count(*) AS n_near, list(struct_pack(n := w.n, word := w.word) ORDER BY w.n DESC, encode(w.word))[1] AS top
  FROM pairs p JOIN words w ON w.word = p.b GROUP BY p.a
), formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.top.n >= 10 * w.n THEN b.top.word END AS form,
    CASE WHEN b.top.n >= 10 * w.n THEN b.top.n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word
), walk(word, place) AS (
  SELECT word, word FROM formed UNION ALL SELECT k.word, f.form FROM walk k JOIN formed f ON f.word = k.place WHERE f.form IS NOT NULL
)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, k.place AS root
FROM formed f JOIN walk k ON k.word = f.word JOIN formed e ON e.word = k.place AND e.form IS NULL
"""

OP12 = r"""
WITH terms AS (
  SELECT rowid_ AS d, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM (SELECT row_number() OVER () AS rowid_, doc_id, text FROM documents)
), counts AS (
  SELECT d, doc_id, t, count(*)::BIGINT AS tf FROM terms GROUP BY ALL
), docs AS (
  SELECT d, sum(tf)::BIGINT AS n FROM counts GROUP BY d
), whole AS (
  SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM docs
), items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark
), weights AS (
  SELECT t, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT t, count(*)::BIGINT AS df FROM counts WHERE t IN (SELECT t FROM items) GROUP BY t), whole
), scored AS (
  SELECT i.item_id, c.d, c.doc_id, sum(w.w * ((1000000000 * c.tf) // (1000 * c.tf + 20 * (50 + (50 * docs.n * nn) // ll))))::BIGINT AS score
  FROM items i JOIN weights w USING (t) JOIN counts c USING (t) JOIN docs ON docs.d = c.d, whole GROUP BY ALL
), ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""

ORACLES = {"op5_jaccard": OP5, "op6_embeddings": OP6, "op9_warc": OP9, "op10_chat": OP10, "op11_spelling": OP11, "op12_lexical": OP12}
