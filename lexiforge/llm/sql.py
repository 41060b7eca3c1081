"""SQL (DuckDB) of the operators that it can express."""

#: Substring dedup: windows of 35 words as strings, counted; a word goes if one of its last 35 starts is repeated.
SUBSTRING = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, unnest(range(1, len(ws) - 33)) AS i, ws FROM d WHERE len(ws) >= 35),
h AS (SELECT r, i, sha256(array_to_string(ws[i:i + 34], ' ')) AS h FROM w),
many AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS k FROM h WHERE h IN (SELECT h FROM many)),
lost AS (SELECT r, list(k) AS ks, count(*) AS n FROM gone GROUP BY r),
word AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM d),
kept AS (SELECT word.r, string_agg(word, ' ' ORDER BY word.k) AS kept FROM word LEFT JOIN gone ON gone.r = word.r AND gone.k = word.k WHERE gone.r IS NULL GROUP BY word.r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN lost ON lost.r = d.r LEFT JOIN kept ON kept.r = d.r
"""

#: Multiset fingerprints. A hash gives three words of 60 bits; lane s of a word counts its bit s.
#: Likeness is that of the lanes modulo 2^16, read as numbers from -2^15.
FINGERPRINT = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n_chars FROM documents),
nx AS (SELECT doc_id, coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC), max(doc_id) OVER ()) AS next_id FROM d),
e AS (SELECT d.doc_id, d.n_chars, d.text, n.text AS next,
        substr(d.text, 1, (d.n_chars - d.n_chars // 3)::BIGINT) || substr(n.text, 1, (d.n_chars // 3)::BIGINT) AS edited
      FROM d JOIN nx USING (doc_id) JOIN d n ON n.doc_id = nx.next_id),
t AS (SELECT doc_id, 'a' AS k, text AS t FROM e UNION ALL SELECT doc_id, 'b', edited FROM e UNION ALL SELECT doc_id, 'c', next FROM e),
u AS (SELECT doc_id, k, sha256(unnest(regexp_extract_all(t, '[^.!?\n]{1,120}[.!?\n]*|[.!?\n]+'))) AS h FROM t),
w AS (SELECT doc_id, k, i, ('0x' || substr(h, 1 + 15 * i, 15))::BIGINT AS w FROM u, range(3) x(i)),
lane AS (SELECT doc_id, k, 60 * i + s AS lane, sum(2 * ((w >> s) & 1) - 1)::BIGINT AS v
         FROM w, range(60) y(s) GROUP BY ALL),
every AS (SELECT doc_id, k, l.lane, coalesce(v, 0) AS v FROM (SELECT DISTINCT doc_id, k FROM t) CROSS JOIN range(180) l(lane)
          LEFT JOIN lane USING (doc_id, k, lane)),
f AS (SELECT doc_id, k, list(((v + 32768) % 65536 + 65536) % 65536 - 32768 ORDER BY lane) AS vs, string_agg(lower(printf('%04x', ((v % 65536) + 65536) % 65536)), '' ORDER BY lane) AS hex FROM every GROUP BY ALL),
p AS (SELECT e.doc_id, n_chars, sha256(edited) AS edited_sha256, a.hex AS fingerprint, b.hex AS edited_fingerprint, a.vs AS a, b.vs AS b, c.vs AS c
      FROM e JOIN f a ON a.doc_id = e.doc_id AND a.k = 'a' JOIN f b ON b.doc_id = e.doc_id AND b.k = 'b' JOIN f c ON c.doc_id = e.doc_id AND c.k = 'c')
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
  CASE WHEN a = b THEN 1.0::DOUBLE WHEN list_sum([x * x FOR x IN a]) > 0 AND list_sum([x * x FOR x IN b]) > 0
    THEN round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, list_inner_product(a::DOUBLE[], b::DOUBLE[]) / (sqrt(list_sum([x * x FOR x IN a])) * sqrt(list_sum([x * x FOR x IN b]))))), 6) ELSE 0.0::DOUBLE END AS near_edited,
  CASE WHEN a = c THEN 1.0::DOUBLE WHEN list_sum([x * x FOR x IN a]) > 0 AND list_sum([x * x FOR x IN c]) > 0
    THEN round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, list_inner_product(a::DOUBLE[], c::DOUBLE[]) / (sqrt(list_sum([x * x FOR x IN a])) * sqrt(list_sum([x * x FOR x IN c]))))), 6) ELSE 0.0::DOUBLE END AS near_next
FROM p
"""

#: Near duplicates: sets of 5-word shingles as strings, pairs that share one counted, components by reachability.
JACCARD = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + least(5, len(ws)) - 1], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 75 * (x.n + y.n - m)),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.c)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id
"""
