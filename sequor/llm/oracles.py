"""DuckDB SQL of the operators' queries where SQL can say them."""

from __future__ import annotations

_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = r"[\x20\x09-\x0D]+"


def _words(table: str, key: str, lower: bool) -> str:
    text = f"translate(coalesce(text, ''), '{_AZ}', '{_az}')" if lower else "coalesce(text, '')"
    return f"SELECT {key}, list_filter(regexp_split_to_array({text}, '{_SPACE}'), lambda x: x <> '') AS w FROM {table}"


def _shingles(table: str, key: str, lower: bool = True) -> str:
    return f"SELECT DISTINCT {key}, array_to_string(w[i:i + 4], ' ') AS s FROM ({_words(table, key, lower)}) t, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0"


_HOST = f"translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{_AZ}', '{_az}')"
_PATH = "regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2)"
_KEY = "regexp_replace(host, ':(80|443)$', '') || regexp_replace(path, '/+$', '') || regexp_extract(url, '(?s)^[^?#]*(\\?[^#]*)', 1)"

OP1 = f"""WITH rules(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
 u AS (SELECT page_id, url, {_HOST} AS host, {_PATH} AS path FROM pages),
 best AS (SELECT host, path, arg_max(h || p, (length(h || p), verdict = 'allow')) AS rule, arg_max(verdict, (length(h || p), verdict = 'allow')) AS verdict
  FROM (SELECT DISTINCT host, path FROM u) t JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL),
 k AS (SELECT u.*, rule, verdict, CASE WHEN contains(url, '://') THEN {_KEY} END AS key FROM u LEFT JOIN best USING (host, path)),
 alias AS (SELECT key, bool_or(verdict = 'block') AND NOT bool_or(coalesce(verdict, '') = 'allow') AS blocked FROM k GROUP BY key)
 SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict FROM k LEFT JOIN alias USING (key)"""

OP5 = f"""WITH l AS (SELECT doc_id, i, a[i] AS line, translate(regexp_replace(regexp_replace(a[i], '^{_SPACE}', ''), '{_SPACE}$', ''), '{_AZ}', '{_az}') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents) t, unnest(range(1, len(a) + 1)) AS u(i)),
 often AS (SELECT k FROM l GROUP BY k HAVING length(k) >= 1 AND count(DISTINCT doc_id) >= 10), m AS (SELECT l.*, often.k IS NOT NULL AS gone FROM l LEFT JOIN often USING (k))
 SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""

OP8 = f"""WITH RECURSIVE s AS ({_shingles('documents', 'doc_id')}), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
 o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
 e AS (SELECT a, b FROM o JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * o >= 75 * (x.n + y.n - o)), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 reach AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT b, r FROM reach JOIN both_ways ON a = d WHERE r < b)
 SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM (SELECT d AS doc_id, min(r) AS component_id FROM reach GROUP BY d) t LEFT JOIN n USING (doc_id)"""

OP9 = f"""WITH d AS ({_words('documents', 'doc_id', False)}), win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM d, unnest(range(1, len(w) - 18)) AS u(i)),
 later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM win) t WHERE r > 1),
 gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later), words AS (SELECT doc_id, i, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(i)),
 m AS (SELECT words.*, gone.i IS NOT NULL AS gone FROM words LEFT JOIN gone USING (doc_id, i)),
 kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS text FROM m GROUP BY doc_id)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

OP10 = f"""WITH s AS ({_shingles('documents', 'doc_id')}), q AS ({_shingles('benchmark', 'item_id')}), n AS (SELECT item_id, count(*) AS n_item FROM q GROUP BY ALL)
 SELECT doc_id, item_id, count(*) AS n_common, n_item FROM q JOIN s USING (s) JOIN n USING (item_id) GROUP BY ALL HAVING count(*) * 100 >= n_item * 75"""

_CRC = """crc AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(i)) t)"""

OP11 = f"""WITH {_CRC},
 docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_AZ}', '{_az}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
 goal AS MATERIALIZED (SELECT row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{_AZ}', '{_az}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
 df AS MATERIALIZED (SELECT r, f, count(*) AS n FROM (SELECT r, unnest(w) AS f FROM docs UNION ALL SELECT r, w[i] || ' ' || w[i + 1] FROM docs, unnest(range(1, len(w))) AS u(i)) t GROUP BY ALL),
 gf AS MATERIALIZED (SELECT f, count(*) AS n FROM (SELECT unnest(w) AS f FROM goal UNION ALL SELECT w[i] || ' ' || w[i + 1] FROM goal, unnest(range(1, len(w))) AS u(i)) t GROUP BY ALL),
 hashed AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(h), 2), lambda k: CAST('0x' || substr(h, k, 2) AS BIGINT))), lambda c, b: xor(c >> 8, tab[CAST(xor(c & 255, b) AS INT) + 1])), 4294967295) % 10000 AS b
  FROM (SELECT f, hex(f) AS h FROM (SELECT f FROM df UNION SELECT f FROM gf) t) t, crc),
 s AS (SELECT b, sum(n) AS n FROM df JOIN hashed USING (f) GROUP BY b), t AS (SELECT b, sum(n) AS n FROM gf JOIN hashed USING (f) GROUP BY b),
 gain AS (SELECT b, CAST(floor(1000 * ln(CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(n), 0) FROM s) + 10000 AS DOUBLE) / (CAST(coalesce(s.n, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(n), 0) FROM t) + 10000 AS DOUBLE)))) AS BIGINT) AS g
  FROM range(10000) k(b) LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
 w AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(CAST(sum(n * g) AS DOUBLE) / sum(n)) AS BIGINT) AS weight FROM df JOIN hashed USING (f) JOIN gain USING (b) GROUP BY r),
 scored AS (SELECT r, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score FROM docs LEFT JOIN w USING (r)),
 placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS p FROM scored WHERE n_words >= 20)
 SELECT doc_id, n_features, weight, score, CASE WHEN p <= (SELECT count(*) * 25 // 100 FROM placed) THEN p END AS rank FROM scored LEFT JOIN placed USING (r)"""

OP12 = """WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 win AS (SELECT doc_id, i, substr(h, 2 * i - 1, 200) AS s FROM d, unnest(range(1, length(h) // 2 - 98)) AS u(i)),
 later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM win) t WHERE r > 1),
 steps AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS jump FROM later),
 spans AS (SELECT doc_id, min(i) AS a, max(i) + 99 AS b FROM (SELECT doc_id, i, sum(jump) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM steps) t GROUP BY doc_id, g),
 gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
 cut AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(b - a + 1) AS BIGINT) AS n_removed, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - 1 - before)), '' ORDER BY a) AS head FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
 SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN cut USING (doc_id)"""

_APART = "CAST(list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"


def _lloyd(n: int) -> str:
    """CTEs of one round: the nearest centroid of each vector, and the centroids after it."""
    return f"""a{n} AS MATERIALIZED (SELECT r, arg_min(j, (d, j)) AS j FROM (SELECT r, j, {_APART} AS d FROM kept, c{n - 1}) t GROUP BY r),
 m{n} AS (SELECT j, i, CAST(sum(q[i]) AS BIGINT) AS s, count(*) AS n FROM kept JOIN a{n} USING (r), unnest(range(1, 65)) AS u(i) GROUP BY ALL),
 c{n} AS MATERIALIZED (SELECT j, coalesce(f, c) AS c FROM c{n - 1} LEFT JOIN (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS f FROM m{n} GROUP BY j) t USING (j)),
 """


OP13 = f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
 c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS j, q AS c FROM kept QUALIFY j < 16),
 {_lloyd(1)}{_lloyd(2)}{_lloyd(3)}
 told AS MATERIALIZED (SELECT r, arg_min(j, (d, j)) AS j, min(d) AS distance FROM (SELECT r, j, {_APART} AS d FROM kept, c3) t GROUP BY r),
 inertias AS (SELECT j, CAST(sum(distance) AS BIGINT) AS cluster_inertia, CAST(sum(sum(distance)) OVER () AS BIGINT) AS inertia FROM told GROUP BY j)
 SELECT vec_id, CAST(j AS INTEGER) AS cluster, distance, cluster_inertia, inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM kept JOIN told USING (r) JOIN inertias USING (j) JOIN c3 USING (j)"""

ORACLES = {
    "op1_url_filters": OP1,
    "op5_line_dedup": OP5,
    "op8_jaccard_join": OP8,
    "op9_substring_dedup": OP9,
    "op10_decontamination": OP10,
    "op11_importance_resampling": OP11,
    "op12_suffix_dedup": OP12,
    "op13_centroid_clustering": OP13,
}
