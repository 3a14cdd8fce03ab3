"""DuckDB twins of the queries that SQL can express."""

OP1 = r"""WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
h AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS m FROM p),
rep AS (SELECT m FROM h GROUP BY m HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM h JOIN rep USING (m)),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)"""

OP4 = """WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS (SELECT vec_id, label, x, sqrt(list_inner_product(x, x)) AS n FROM v
      WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0
        AND list_inner_product(x, x) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE list_inner_product(a.x, b.x) / (a.n * b.n) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
deg AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(deg.n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM comp LEFT JOIN deg USING (vec_id)"""

OP7 = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha256(encode(coalesce(html, ''))) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN octet_length(b) >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN octet_length(b) >= 100 AND page_id > first THEN first END AS refers_to FROM f"""

OP8 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
p AS (SELECT doc_id, unnest(range(0, n - 399)) AS i, x FROM d WHERE n >= 400),
h AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 800)) AS m FROM p),
rep AS (SELECT m FROM h GROUP BY m HAVING count(*) > 1),
starts AS (SELECT doc_id, i FROM h JOIN rep USING (m)),
runs AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS new FROM starts),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM (
            SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM runs) GROUP BY doc_id, g),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM spans
         UNION ALL SELECT doc_id, max(b), max(n) FROM spans JOIN d USING (doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS x FROM gaps JOIN d USING (doc_id)
         GROUP BY doc_id),
lost AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(lost.gone, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(lost.spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.x, d.x))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)"""

_CRC = """xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT,
    list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS UBIGINT))),
    lambda a, x: list_reduce(list_prepend(xor(a, x), list_transform(range(8), lambda i: CAST(i AS UBIGINT))),
      lambda b, i: CASE WHEN (b & 1) = 1 THEN xor(b >> 1, 3988292384::UBIGINT) ELSE b >> 1 END)))"""

OP11 = f"""WITH t AS (SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS s
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, CAST({_CRC.format('c')} % 9 AS BIGINT) AS h FROM t),
r AS (SELECT h.c, list_concat(coalesce(list_slice(b.s, 1, h.h), []), coalesce(list_slice(h.s, h.h + 1, len(h.s)), [])) AS s
  FROM h LEFT JOIN t b ON b.c = h.c - h.c % 5),
p AS (SELECT c, len(s) AS n, unnest(range(0, len(s) + 1)) AS d, s FROM r),
node AS (SELECT d, list_slice(s, 1, d) AS k, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CASE WHEN n = d THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends_sha256
  FROM p GROUP BY d, list_slice(s, 1, d)),
kids AS (SELECT d - 1 AS d, list_slice(k, 1, d - 1) AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
own AS (SELECT node.*, coalesce(kids.n, 0) AS n_children,
        CASE WHEN node.d = 0 THEN 0 ELSE (n_convs - 1) * octet_length(encode(node.k[node.d].t)) END AS saved
  FROM node LEFT JOIN kids ON kids.d = node.d AND kids.k = node.k),
above AS (SELECT unnest(range(0, d + 1)) AS d, k, n_children, saved FROM own),
sub AS (SELECT d, list_slice(k, 1, d) AS k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
  FROM above GROUP BY d, list_slice(k, 1, d))
SELECT own.conv_id, CAST(own.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, CAST(own.n_convs AS BIGINT) AS n_convs,
       CAST(own.n_children AS BIGINT) AS n_children, CAST(sub.n_leaves AS BIGINT) AS n_leaves,
       CAST(sub.saved_tokens AS BIGINT) AS saved_tokens, own.ends_sha256
FROM own JOIN sub ON sub.d = own.d AND sub.k = own.k
LEFT JOIN node up ON up.d = own.d - 1 AND up.k = list_slice(own.k, 1, own.d - 1)"""

# Kind, pattern, place in the list, group that counts, its least length
_KINDS = [
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|"""
     r"""[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("google", r"AIza[A-Za-z0-9_-]{35,}", 0, 0),
]
# matches begin where the pieces between them and the matches before them end
_FOUND = " UNION ALL ".join(
    f"""SELECT i, {k} AS k, '{kind}' AS kind, s, s + length(m) AS e FROM (
      SELECT i, unnest(list_transform(range(1, len(m) + 1), lambda j: CAST(
               list_sum(list_transform(list_slice(p, 1, j), lambda x: length(x))) +
               coalesce(list_sum(list_transform(list_slice(m, 1, j - 1), lambda x: length(x))), 0) AS BIGINT))) AS s, unnest(m) AS m, unnest(g) AS g
      FROM (SELECT i, string_split_regex(t, '{p}') AS p, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {g}) AS g FROM d)
      WHERE len(m) > 0) WHERE length(g) >= {least}"""
    for k, (kind, p, g, least) in enumerate(_KINDS))

OP13 = f"""WITH d AS (SELECT row_number() OVER () AS i, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({_FOUND}),
s AS (SELECT i, count(*) FILTER (WHERE k = 0) AS a, count(*) FILTER (WHERE k = 1) AS b, count(*) FILTER (WHERE k = 2) AS c,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (WHERE k < 3) AS base,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM f GROUP BY i)
SELECT doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(b, 0) AS BIGINT) AS n_access,
       CAST(coalesce(c, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN s USING (i)"""
