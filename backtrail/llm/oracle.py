"""DuckDB SQL of the queries that SQL can express."""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LLM_ORACLE = {
    "op1_decontamination": rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWERED}, '{_WORD}'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWERED}, '{_WORD}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS m,
         array_to_string(list_slice(w, s, s + least(len(w), 10) - 1), ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, s, array_to_string(list_slice(w, s, s + m - 1), ' ') AS g
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, sizes WHERE len(w) >= m)),
h AS (SELECT DISTINCT doc_id, dw.m, s, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.m = bw.m),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit
      FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM (SELECT DISTINCT doc_id, s, m FROM h)) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)""",
    "op3_line_dedup": r"""
WITH x AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS ln
           FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
nb AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS pos FROM x
       WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
w AS (SELECT doc_id, pos, line AS a, lead(line, 1) OVER v AS b, lead(line, 2) OVER v AS c, k AS ka, lead(k, 1) OVER v AS kb
      FROM (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS k FROM nb) WINDOW v AS (PARTITION BY doc_id ORDER BY pos)),
-- Repeated runs of three lines, and of one or two lines with twenty words.
w3 AS (SELECT doc_id, pos, row_number() OVER v AS rn, first_value(doc_id) OVER v AS of, first_value(pos) OVER v - pos AS shift
       FROM w WHERE c IS NOT NULL WINDOW v AS (PARTITION BY a, b, c ORDER BY doc_id, pos)),
f AS (SELECT doc_id, pos, 3 AS n, rn FROM w3
      UNION ALL SELECT doc_id, pos, 2, CASE WHEN ka + kb >= 20 THEN row_number() OVER (PARTITION BY a, b ORDER BY doc_id, pos) ELSE 1 END
      FROM w WHERE b IS NOT NULL
      UNION ALL SELECT doc_id, pos, 1, CASE WHEN ka >= 20 THEN row_number() OVER (PARTITION BY a ORDER BY doc_id, pos) ELSE 1 END FROM w),
cov AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + n)) AS pos FROM f WHERE rn > 1),
-- Consecutive windows with consecutive first occurrences are one maximal run.
runs AS (SELECT doc_id, count(*) AS n_runs, max(lines) AS longest_run FROM (
    SELECT doc_id, count(*) + 2 AS lines FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, of, shift ORDER BY pos) AS island
      FROM w3 WHERE rn > 1) GROUP BY doc_id, of, shift, island) GROUP BY doc_id),
m AS (SELECT x.doc_id, x.ln, x.line, nb.pos IS NOT NULL AS held, cov.pos IS NOT NULL AS gone
      FROM x LEFT JOIN nb ON nb.doc_id = x.doc_id AND nb.ln = x.ln
             LEFT JOIN cov ON cov.doc_id = nb.doc_id AND cov.pos = nb.pos),
g AS (SELECT doc_id, count(*) FILTER (held) AS n, count(*) FILTER (gone) AS r,
        coalesce(string_agg(line, chr(10) ORDER BY ln) FILTER (NOT gone), '') AS t FROM m GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_lines, CAST(coalesce(r, 0) AS BIGINT) AS n_lines_removed,
  CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(coalesce(longest_run, 0) AS BIGINT) AS longest_run,
  CASE WHEN d.text IS NOT NULL THEN sha256(t) END AS text_sha256
FROM documents d LEFT JOIN g USING (doc_id) LEFT JOIN runs USING (doc_id)""",
    "op6_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS w,
        2.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, sum(cap) OVER v AS caps, sum(w) OVER v AS ws FROM r
      WINDOW v AS (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, ((SELECT sum(source_size) * 1.5 FROM s) - (caps - cap)) / ((SELECT sum(w) FROM r) - (ws - w)) AS price FROM o),
price AS (SELECT coalesce(max(price), 0) AS price FROM p),
t AS (SELECT r.source, r.source_size, r.w, least(r.cap, price.price * r.w) AS target FROM r, price),
q AS (SELECT d.*, t.source_size, t.target, t.w,
        sum(size) OVER (PARTITION BY d.source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - size AS off,
        CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS passes
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, least(2, passes + CASE WHEN size > 0 AND off + size / 2 <= target - passes * source_size THEN 1 ELSE 0 END) AS copies
      FROM q),
-- The share of its source's demand that is met before a copy, and the time when the curriculum has met it.
x AS (SELECT *, CASE WHEN target > 0 THEN least(off / target, 1.0) ELSE 0.0 END AS p1,
        CASE WHEN target > 0 THEN least(((copies - 1) * source_size + off) / target, 1.0) ELSE 0.0 END AS p2 FROM c),
time(w, lo, begin, w0, slope) AS (VALUES (5.0, 0.0, 0.0, 1.4, -0.8), (2.0, 0.0, 0.0, 1.0, 0.0), (1.0, 0.0, 0.0, 0.5, 1.0), (1.0, 0.375, 0.5, 1.0, 1.0)),
y AS (SELECT x.*, a.begin + 2 * (p1 - a.lo) / (a.w0 + sqrt(greatest(a.w0 * a.w0 + 2 * a.slope * (p1 - a.lo), 0))) AS t1,
        b.begin + 2 * (p2 - b.lo) / (b.w0 + sqrt(greatest(b.w0 * b.w0 + 2 * b.slope * (p2 - b.lo), 0))) AS t2
      FROM x JOIN time a ON a.w = x.w AND a.lo = CASE WHEN x.w = 1.0 AND p1 >= 0.375 THEN 0.375 ELSE 0.0 END
             JOIN time b ON b.w = x.w AND b.lo = CASE WHEN x.w = 1.0 AND p2 >= 0.375 THEN 0.375 ELSE 0.0 END)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken,
  CASE WHEN copies > 0 THEN round(CAST(least(t1, 1.0) AS DOUBLE), 9) END AS first_position,
  CASE WHEN copies > 0 THEN round(CAST(least(t2, 1.0) AS DOUBLE), 9) END AS last_position
FROM y""",
    "op2_nearest_neighbours": """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op9_substring_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT doc_id, s, md5(array_to_string(list_slice(w, s, s + 49), ' ')) AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)),
f AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY g) AS first FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM f WHERE first < doc_id),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT x.doc_id, count(c.p) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY x.p) FILTER (c.p IS NULL), '') AS kept
      FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.p = x.p GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    # The checksum's table is built by its rule; letters outside ASCII here are two bytes, 195 and code point - 64.
    "op11_spelling_variants": r"""
WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i))),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
own AS (SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= 7 GROUP BY 1, 2),
bytes AS (SELECT *, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
    lambda ch: CASE WHEN unicode(ch) < 128 THEN [CAST(unicode(ch) AS BIGINT)] ELSE [195, unicode(ch) - 64] END)) AS b FROM own),
hashed AS (SELECT doc_id, run, k, xor(list_reduce(list_prepend(4294967295, b),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
cut AS (SELECT k, CASE WHEN h % 31 = 0 THEN substring(run, 1, CAST(h % length(run) AS BIGINT))
    || substring(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM hashed),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY 1 HAVING sum(k) >= 2),
d AS (SELECT word, i, substring(word, 1, i) || substring(word, i + 2) AS rest
    FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
half AS (SELECT a.word AS x, b.word AS y FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest WHERE a.word < b.word
    UNION SELECT v.word, d.word FROM v JOIN d ON v.word = d.rest),
near AS (SELECT x, y FROM half UNION SELECT y, x FROM half),
best AS (SELECT x AS word, count(*) AS n_near, min({'less': -v.n, 'form': y}) AS top FROM near JOIN v ON v.word = y GROUP BY 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.less >= 10 * v.n THEN top.form END AS form,
    CASE WHEN -top.less >= 10 * v.n THEN -top.less END AS form_n FROM v LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS at FROM f UNION ALL SELECT c.word, f.form FROM chain c JOIN f ON f.word = c.at WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.at AS root FROM chain c JOIN f ON f.word = c.at WHERE f.form IS NULL)
SELECT f.word, f.form, ends.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM f JOIN ends USING (word)""",
    "op13_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x),
n AS (SELECT x, count(*) AS n FROM p GROUP BY 1), c AS (SELECT x, min(y) AS component_id FROM r GROUP BY 1)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e LEFT JOIN n ON n.x = e.vec_id LEFT JOIN c ON c.x = e.vec_id""",
}
