"""DuckDB SQL for the queries of this subpackage that SQL expresses, written from their definitions."""

#: CRC-32 in SQL: over GF(2) it is the sum of what each byte adds, given how many bytes follow it, so a join and bit_xor give it.
_CRC = """
 bytes(b, c0) AS (SELECT range, list_reduce(list_prepend(range, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) FROM range(256)),
 follow AS (SELECT b, 0 AS k, c0 AS c FROM bytes UNION ALL SELECT f.b, f.k + 1, xor(f.c >> 8, t.c0) FROM follow f JOIN bytes t ON t.b = (f.c & 255) WHERE f.k < 127)"""

OP11 = f"""
WITH RECURSIVE {_CRC},
 runs AS (SELECT doc_id, translate(u.run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) u),
 distinct_runs AS (SELECT doc_id, run, count(*) AS n, encode(coalesce(doc_id::VARCHAR, '') || ':' || run) AS raw FROM runs GROUP BY ALL),
 hexed AS (SELECT doc_id, run, n, hex(raw) AS hx, octet_length(raw) AS len FROM distinct_runs),
 spots AS (SELECT doc_id, run, n, len, hx, unnest(range(len)) AS i FROM hexed),
 flipped AS (SELECT doc_id, run, n, len, len - 1 - i AS k, xor(('0x' || substr(hx, 2 * i::INT + 1, 2))::BIGINT, CASE WHEN i < 4 THEN 255 ELSE 0 END) AS b FROM spots),
 hashed AS (SELECT x.doc_id, x.run, any_value(x.n) AS n, xor(bit_xor(f.c), 4294967295) AS h FROM flipped x JOIN follow f ON f.b = x.b AND f.k = x.k GROUP BY x.doc_id, x.run),
 slips AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
 words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM slips WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
 places AS (SELECT word, n, unnest(range(length(word)))::INT AS i FROM words),
 cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS less FROM places),
 pairs AS (SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.less = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.less = b.word),
 near AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM pairs GROUP BY word),
 told AS MATERIALIZED (SELECT w.word, w.n, coalesce(x.n_near, 0)::BIGINT AS n_near, CASE WHEN x.m >= 2 * w.n THEN x.other END AS form, CASE WHEN x.m >= 2 * w.n THEN x.m END AS form_n FROM words w LEFT JOIN near x USING (word)),
 follow_form AS (SELECT word, word AS root, form AS next FROM told UNION ALL SELECT f.word, f.next, t.form FROM follow_form f JOIN told t ON t.word = f.next)
SELECT t.word, t.form, f.root, t.n, t.n_near, t.form_n FROM told t JOIN follow_form f ON f.word = t.word AND f.next IS NULL
"""

OP12 = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
 d AS (SELECT *, ('0x' || substr(h, 1, 8))::UBIGINT % (n + 1) AS one, ('0x' || substr(h, 9, 8))::UBIGINT % (n + 1) AS two, ('0x' || substr(h, 17, 8))::UBIGINT % 100 AS h3, ('0x' || substr(h, 25, 8))::UBIGINT % 100 AS h4 FROM t),
 f AS (SELECT *, least(one, two)::BIGINT AS a, greatest(one, two)::BIGINT AS b, CASE WHEN n = 0 OR x LIKE '%<P>%' OR x LIKE '%<S>%' OR x LIKE '%<M>%' OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
 o AS (SELECT *, substring(x, 1, a) AS p, substring(x, a + 1, b - a) AS m, substring(x, b + 1) AS s FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256, sha256(x) AS restored_sha256 FROM o
"""
