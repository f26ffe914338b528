"""DuckDB SQL for the queries that SQL can express, from their description alone."""

QUALITY = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(string_split_regex(t, '[ \t\n\r\x0b\x0c]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\r\x0b\x0c]')) AS ls FROM d
), tri AS (
  SELECT r, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS g
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), hit AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM tri) WHERE c > 1
), rep AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM hit) GROUP BY r
), m AS (
  SELECT w.r, doc_id, lang, source, len(ws)::BIGINT AS n_words,
    length(regexp_replace(t, '[ \t\n\r\x0b\x0c]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep ON rep.r = w.r
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    1000 * n_symbols // greatest(n_words, 1) AS v1, 1000 * n_dup_lines // greatest(n_lines, 1) AS v2,
    1000 * n_repeat_words // greatest(n_words, 1) AS v3, 1000 * word_chars // greatest(n_words, 1) AS v4 FROM m
), long AS (
  SELECT lang, source, metric, (v >> s) << s AS bucket FROM (
    SELECT lang, source, metric, v, greatest(length(bin(v)) - 10, 0)::BIGINT AS s
    FROM (SELECT *, n_words AS v5, n_lines AS v6 FROM b WHERE NOT base_failed) UNPIVOT (v FOR metric IN (v1, v2, v3, v4, v5, v6)))
), q AS (
  SELECT level, lang, source, metric, max(rows) AS rows, min(bucket) FILTER (1000 * upto >= 250 * rows) AS q1,
    min(bucket) FILTER (1000 * upto >= 500 * rows) AS q2, min(bucket) FILTER (1000 * upto >= 750 * rows) AS q3, min(bucket) FILTER (1000 * upto >= 990 * rows) AS q4
  FROM (
    SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, metric) AS rows
    FROM (
      SELECT 0 AS level, lang, source, metric, bucket, count(*) AS n FROM long GROUP BY ALL
      UNION ALL SELECT 1, lang, NULL, metric, bucket, count(*) FROM long GROUP BY ALL
      UNION ALL SELECT 2, NULL, NULL, metric, bucket, count(*) FROM long GROUP BY ALL))
  GROUP BY ALL
), rule(metric, sized, least_count, two_sided) AS (VALUES ('v1', 'v5', 1, false), ('v2', 'v6', 1, false), ('v3', 'v5', 6, false), ('v4', 'v5', 1, true)),
unit AS (
  SELECT q.*, two_sided, greatest(s.q2, 1)::BIGINT AS size, 1000 * least_count // greatest(s.q2, 1)::BIGINT AS u,
    8000 * least_count // greatest(s.q2, 1)::BIGINT AS u8
  FROM q JOIN rule ON rule.metric = q.metric
  JOIN q s ON s.level = q.level AND s.lang IS NOT DISTINCT FROM q.lang AND s.source IS NOT DISTINCT FROM q.source AND s.metric = rule.sized
), fence AS (
  SELECT *, q2 + greatest(8 * (q3 - q2), 8 * (q2 - q1), least(u8, greatest(q4 - q2, u))) AS high,
    CASE WHEN two_sided THEN q2 - greatest(8 * (q3 - q2), 8 * (q2 - q1), u) ELSE -1 END AS low FROM unit
), of_lang AS (
  SELECT l.lang, l.metric, unnest(CASE
    WHEN l.rows < 50 OR NOT l.two_sided AND l.q2 > z.high THEN {'mid': z.q2, 'size': z.size, 'high': z.high, 'low': z.low}
    ELSE {'mid': l.q2, 'size': l.size, 'high': CASE WHEN l.two_sided THEN l.high ELSE least(l.high, z.high) END, 'low': l.low} END)
  FROM fence l JOIN fence z ON z.level = 2 AND z.metric = l.metric WHERE l.level = 1
), e AS (
  SELECT g.lang, g.source, g.metric, unnest(CASE
    WHEN g.rows < 50 OR g.q2 > w.high OR g.q2 < w.low THEN {'mid': w.mid, 'size': w.size, 'high': w.high, 'low': w.low}
    ELSE {'mid': g.q2, 'size': g.size, 'high': least(g.high, w.high), 'low': greatest(g.low, w.low)} END)
  FROM fence g JOIN of_lang w ON w.lang IS NOT DISTINCT FROM g.lang AND w.metric = g.metric WHERE g.level = 0
), each AS (
  SELECT b.*, e.metric, CASE e.metric WHEN 'v1' THEN v1 WHEN 'v2' THEN v2 WHEN 'v3' THEN v3 ELSE v4 END AS v, mid::DOUBLE AS mid, high::DOUBLE AS high, low::DOUBLE AS low,
    sqrt(greatest(1.0::DOUBLE, size::DOUBLE / greatest(CASE WHEN e.metric = 'v2' THEN n_lines ELSE n_words END, 1)::DOUBLE)) AS wider
  FROM b LEFT JOIN e ON e.lang IS NOT DISTINCT FROM b.lang AND e.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  coalesce(bool_and(NOT base_failed AND v <= mid + (high - mid) * wider AND (metric <> 'v4' OR v >= mid - (mid - low) * wider)), FALSE) AS kept
FROM each GROUP BY r, doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed
"""

WARC = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (
  SELECT *, array_to_string(list_transform(string_split(h, ''), lambda c: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', c)]), '') AS bits,
    min(page_id) OVER (PARTITION BY h) AS first FROM p
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM b
"""

LINES = r"""
WITH RECURSIVE raw AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, no, regexp_replace(regexp_replace(line, '^[ \t\n\r\x0b\x0c]+', ''), '[ \t\n\r\x0b\x0c]+$', '') AS line
  FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS no FROM raw WHERE text IS NOT NULL)
), k AS (SELECT * FROM l WHERE line <> ''),
u AS (SELECT line, length(line) AS n FROM k GROUP BY line),
near AS (
  SELECT a.line AS a, b.line AS b FROM u a JOIN u b ON a.n >= 20 AND b.n IN (a.n, a.n + 1, a.n + 2) AND a.line <> b.line
  WHERE levenshtein(a.line, b.line) <= 2
), edges AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON edges.a = reach.b),
label AS (SELECT u.line, least(u.line, coalesce(min(reach.b), u.line)) AS label FROM u LEFT JOIN reach ON reach.a = u.line GROUP BY u.line),
placed AS (SELECT k.doc_id, no, length(k.line) AS chars, row_number() OVER (PARTITION BY label ORDER BY k.doc_id, no) AS place FROM k JOIN label ON label.line = k.line),
gone AS (SELECT doc_id, count(*) AS n, sum(chars) AS chars FROM placed WHERE place > 1 GROUP BY doc_id)
SELECT raw.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_removed, coalesce(chars, 0)::BIGINT AS removed_chars
FROM raw LEFT JOIN gone ON gone.doc_id = raw.doc_id
"""

URLS = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS mark FROM pages
), q AS (
  SELECT page_id, CASE WHEN mark > 0 THEN substr(url, mark + 3) ELSE '' END AS rest FROM p
), h AS (
  SELECT page_id, rest, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path,
    regexp_extract(rest, '^[^#?]*\?([^#]*)', 1) AS query FROM q
), c AS (
  SELECT *, regexp_replace(host, ':(80|443)$', '') || regexp_replace(path, '/+$', '') ||
    CASE WHEN len(args) > 0 THEN '?' || array_to_string(list_sort(args), '&') ELSE '' END AS key
  FROM (SELECT *, list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|gclid|fbclid|ref)=')) AS args FROM h)
), n AS (SELECT *, CASE WHEN host <> '' THEN count(*) OVER (PARTITION BY host <> '', key) ELSE 0 END AS times FROM c),
rules(rhost, rpath, rverdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
r AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(rverdict, length(rhost || rpath)) AS ruled
  FROM n JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT n.page_id, host, path, rule, coalesce(ruled, CASE WHEN times > 1 THEN 'block' ELSE 'allow' END) AS verdict
FROM n LEFT JOIN r ON r.page_id = n.page_id
"""

JACCARD = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\r\x0b\x0c]+'), lambda x: x <> '') AS ws FROM documents
), g AS (
  SELECT DISTINCT doc_id, hash(gram) AS gram FROM (
    SELECT doc_id, array_to_string(ws[i:i + 3], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 2)) AS i FROM w WHERE len(ws) >= 4)
    UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 3)
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (SELECT * FROM g WHERE gram IN (SELECT gram FROM g GROUP BY gram HAVING count(*) > 1)),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM common a JOIN common b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT w.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(min(b), w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN reach ON reach.a = w.doc_id GROUP BY w.doc_id
"""

REPAIR = r"""
WITH RECURSIVE tab AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS txt,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(
      string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ascii(ch)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS k
  FROM conversations, tab
), hurt AS (
  SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN translate(txt, '.!?', '') ELSE txt END AS txt
  FROM raw, (SELECT unnest(range(2)) AS copy) WHERE k <> 0 AND (copy = 0 OR k = 3)
), num AS (
  SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, left(role, 1) AS ini,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(txt)) AS i FROM hurt
), m AS (
  SELECT *, CASE WHEN NOT regexp_matches(txt, '[^ \t\n\r\x0b\x0c]') THEN 1
    WHEN row_number() OVER (PARTITION BY c, role, txt ORDER BY i) > 1 THEN 2
    WHEN NOT regexp_matches(txt, '[.!?][ \t\n\r\x0b\x0c]*$') THEN 3 ELSE 0 END AS fault,
    lag(ini) OVER (PARTITION BY c ORDER BY i) AS prev FROM num
), back(c, i, e, s, u, a) AS (
  SELECT c, max(i) + 1, 0, 10, 5, 0 FROM m GROUP BY c
  UNION ALL
  SELECT c, i, least(e, u + 5, a + 10), least(s, u + 5, a + 10), least(u, a + 5), least(a, u + 5) FROM (
    SELECT c, i,
      CASE WHEN must THEN 2 + e ELSE least(2 + e, t + 1 + u, CASE ini WHEN 's' THEN t + s WHEN 'u' THEN t + u ELSE 9999999 END) END AS e,
      CASE WHEN must THEN 2 + s ELSE least(2 + s, t + 1 + u, CASE ini WHEN 'u' THEN t + u ELSE 9999999 END) END AS s,
      CASE WHEN must THEN 2 + u ELSE least(2 + u, t + 1 + a, CASE ini WHEN 'a' THEN t + a ELSE 9999999 END) END AS u,
      CASE WHEN must THEN 2 + a ELSE least(2 + a, t + 1 + u, CASE ini WHEN 'u' THEN t + u ELSE 9999999 END) END AS a
    FROM (SELECT m.c, m.i, m.ini, fault IN (1, 2) AS must, CASE fault WHEN 3 THEN 5 ELSE 0 END AS t, e, s, u, a FROM back JOIN m ON m.c = back.c AND m.i = back.i - 1))
), cost AS (
  SELECT c, i, [e, s, u, a] AS b FROM back
), spot AS (
  SELECT x.c, x.i, x.b, y.b AS n, m.role, m.txt, m.fault IN (1, 2) AS must, CASE m.fault WHEN 3 THEN 5 ELSE 0 END AS t,
    CASE m.ini WHEN 's' THEN [2, 0, 0, 0] WHEN 'u' THEN [3, 3, 0, 3] WHEN 'a' THEN [0, 0, 4, 0] ELSE [0, 0, 0, 0] END AS k
  FROM cost x LEFT JOIN cost y ON y.c = x.c AND y.i = x.i + 1 LEFT JOIN m ON m.c = x.c AND m.i = x.i
), walk(c, i, q, audit, lines) AS (
  SELECT DISTINCT c, 1::BIGINT, 1, '', []::VARCHAR[] FROM m
  UNION ALL
  SELECT c, CASE move WHEN 'I' THEN i ELSE i + 1 END, CASE move WHEN 'D' THEN q WHEN 'K' THEN k[q] ELSE f END, audit || move,
    CASE move WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || txt)
      ELSE list_append(lines, CASE f WHEN 3 THEN 'user:' ELSE 'assistant:' END || CASE move WHEN 'I' THEN '' ELSE txt END) END
  FROM (
    SELECT w.*, [3, 3, 4, 3][q] AS f, k, role, txt,
      CASE WHEN n IS NULL THEN 'I' WHEN n[q] + 2 = b[q] THEN 'D' WHEN b[[3, 3, 4, 3][q]] + 5 = b[q] THEN 'I'
        WHEN NOT must AND k[q] > 0 AND t + n[k[q]] = b[q] THEN 'K' ELSE 'R' END AS move
    FROM walk w JOIN spot ON spot.c = w.c AND spot.i = w.i WHERE n IS NOT NULL OR q IN (2, 3))
), done AS (
  SELECT w.c, w.audit, sha256(array_to_string(lines, chr(10))) AS sum FROM walk w JOIN spot ON spot.c = w.c AND spot.i = w.i WHERE n IS NULL AND q IN (1, 4)
), g AS (
  SELECT c, any_value(conv_id) AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (i > 1 AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM m GROUP BY c
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b[1], 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, coalesce(done.sum, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN cost ON cost.c = g.c AND cost.i = 1 LEFT JOIN done ON done.c = g.c
"""

COLLOCATIONS = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0b\x0c\r]')) AS p FROM documents
), w AS (
  SELECT lang, list_filter(string_split_regex(p, '[ \t]+'), lambda x: x <> '') AS ws FROM piece
), f AS (
  SELECT lang, k, p, count(*) AS a FROM (
    SELECT lang, 1 AS k, unnest(ws) AS p FROM w
    UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w
    UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w)
  GROUP BY ALL
), c AS (
  SELECT lang, k, p, a, string_split(p, ' ') AS s FROM f WHERE k > 1 AND a >= 10
), cut AS (
  SELECT lang, p, a, 1 AS cut, s[1] AS x, array_to_string(s[2:], ' ') AS y FROM c
  UNION ALL SELECT lang, p, a, 2, s[1] || ' ' || s[2], s[3] FROM c WHERE k = 3
), scored AS (
  SELECT cut.lang, cut.p, cut.a, cut, l.a AS l, r.a AS r, 1000000::HUGEINT * cut.a * cut.a // (l.a::HUGEINT * r.a) AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.p = x JOIN f r ON r.lang = cut.lang AND r.p = y
), longer AS (
  SELECT lang, p, max(a) AS b FROM (SELECT lang, a, unnest([s[1] || ' ' || s[2], s[2] || ' ' || s[3]]) AS p FROM c WHERE k = 3) GROUP BY ALL
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1
), ranked AS (
  SELECT best.*, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.p) AS rank
  FROM best LEFT JOIN longer ON longer.lang = best.lang AND longer.p = best.p WHERE coalesce(100 * b < 50 * a, TRUE)
)
SELECT ranked.lang, rank::BIGINT AS rank, p AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang) t ON t.lang = ranked.lang WHERE rank <= 2000
"""
