"""SQL for DuckDB of the training-data queries that SQL can express over whole tables."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

QUALITY = r"""
WITH t AS (SELECT row_number() OVER () rid, doc_id, coalesce(text, '') s FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(s, '[\x20\x09-\x0D]+'), lambda x: x <> '') w, list_filter(string_split(s, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l FROM t),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] k FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) i FROM w WHERE len(w) > 2)),
d AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) c FROM g) WHERE c > 1),
r AS (SELECT rid, count(DISTINCT p) n FROM (SELECT rid, unnest([i, i + 1, i + 2]) p FROM d) GROUP BY 1),
m AS (SELECT doc_id, s, CAST(len(w) AS BIGINT) n_words, CAST(length(regexp_replace(s, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) word_chars, CAST(length(s) - length(regexp_replace(s, '[#*$%&|<>]', '', 'g')) AS BIGINT) n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) n_dup_lines, coalesce(n, 0) n_repeat_words FROM t JOIN w USING (rid) LEFT JOIN r USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR n_symbols > 0.1::DOUBLE * word_chars OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR n_dup_lines > 0.5::DOUBLE * len(string_split(s, chr(10)))) AS kept FROM m
"""

DECONTAMINATION = rf"""
WITH dw AS (SELECT row_number() OVER () rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
iw AS (SELECT CAST(item_id AS VARCHAR) item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
win AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') k FROM (SELECT item, w, least(13, len(w)) n, unnest(range(1, len(w) - least(13, len(w)) + 2)) i FROM iw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
g AS (SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') k FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) i FROM dw, lens WHERE len(w) >= n)),
hit AS (SELECT rid, i, n, item FROM g JOIN win USING (n, k)),
cov AS (SELECT rid, count(DISTINCT p) h FROM (SELECT rid, unnest(range(i, i + n)) p FROM (SELECT DISTINCT rid, i, n FROM hit)) GROUP BY 1),
its AS (SELECT rid, count(DISTINCT item) c, string_agg(DISTINCT item, ',' ORDER BY item) x FROM hit GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, coalesce(h, 0) n_hit, coalesce(c, 0) n_items, sha256(coalesce(x, '')) items_sha256, coalesce(h, 0) > 0 AND 20 * coalesce(h, 0) >= len(w) contaminated
FROM dw LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid)
"""

#: Unsigned CRC-32 of an ASCII text: a byte is mixed in, then eight steps of shift and fixed polynomial.
CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda x: list_concat([ascii(x)::BIGINT], [-1::BIGINT, -1, -1, -1, -1, -1, -1, -1])))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END))"""

PREFIX_TRIE = f"""
WITH t AS (SELECT conv_id c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 p, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') x, length(coalesce(text, '')) n FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, c - c % 100 b, {CRC32.format("c")} % 6 h FROM (SELECT DISTINCT c FROM t)),
lent AS (SELECT convs.c, t.p, x, n FROM convs JOIN t ON t.c = b AND t.p < h), own AS (SELECT c, h + t.p - h p, x, n FROM convs JOIN t USING (c) WHERE t.p >= h),
turns AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY s, p) d, x, n FROM (SELECT *, 0 s FROM lent UNION ALL SELECT *, 1 FROM own)),
chain AS (SELECT c, d, n, list(sha256(x)) OVER (PARTITION BY c ORDER BY d) k FROM turns),
pre AS (SELECT c, d, n, sha256(array_to_string(k, ',')) k FROM chain UNION ALL SELECT c, 0, 0, '' FROM convs),
node AS (SELECT k, min(c) conv_id, any_value(d) depth, count(*) n_convs, any_value(n) chars FROM pre GROUP BY 1),
place AS (SELECT c, d, conv_id FROM pre JOIN node USING (k)),
link AS (SELECT node.conv_id, depth, n_convs, (n_convs - 1) * chars saved, up.conv_id parent_conv_id FROM node LEFT JOIN place up ON up.c = node.conv_id AND up.d = depth - 1),
kids AS (SELECT parent_conv_id conv_id, depth - 1 AS depth, count(*) n FROM link WHERE depth > 0 GROUP BY 1, 2),
sub AS (SELECT a.conv_id, a.d AS depth, count(*) FILTER (kids.n IS NULL) n_leaves, sum(saved) s FROM link JOIN place a ON a.c = link.conv_id AND a.d <= depth LEFT JOIN kids ON kids.conv_id = link.conv_id AND kids.depth = link.depth GROUP BY 1, 2),
last AS (SELECT c, max(d) AS depth FROM pre GROUP BY 1),
ends AS (SELECT conv_id, last.depth, sha256(string_agg(CAST(last.c AS VARCHAR), ',' ORDER BY last.c)) e FROM last JOIN place ON place.c = last.c AND place.d = last.depth GROUP BY 1, 2)
SELECT conv_id, depth, parent_conv_id, n_convs, coalesce(kids.n, 0) n_children, n_leaves, CAST(s AS BIGINT) saved_tokens, coalesce(e, sha256('')) ends_sha256
FROM link JOIN sub USING (conv_id, depth) LEFT JOIN kids USING (conv_id, depth) LEFT JOIN ends USING (conv_id, depth)
"""

_ASSIGN = "a{0} AS MATERIALIZED (SELECT r, vec_id, m // 16 d, m % 16 c, x FROM (SELECT r, any_value(vec_id) vec_id, min(CAST(list_sum(list_transform(list_zip(v.x, s.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * 16 + s.c) m, any_value(v.x) x FROM kept v, s{0} s GROUP BY 1))"
_MOVE = """f{1} AS (SELECT c, list((s - (((s % n) + n) % n)) // n ORDER BY i) x FROM (SELECT c, i, CAST(sum(e) AS BIGINT) s, count(*) n FROM (SELECT c, unnest(x) e, generate_subscripts(x, 1) i FROM a{0}) GROUP BY 1, 2) GROUP BY 1),
s{1} AS MATERIALIZED (SELECT c, coalesce(f{1}.x, s{0}.x) x FROM s{0} LEFT JOIN f{1} USING (c))"""

CENTROIDS = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () r, vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
s0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 c, x FROM kept QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id), x) <= 16),
{_ASSIGN.format(0)}, {_MOVE.format(0, 1)}, {_ASSIGN.format(1)}, {_MOVE.format(1, 2)}, {_ASSIGN.format(2)}, {_MOVE.format(2, 3)}, {_ASSIGN.format(3)}
SELECT vec_id, CAST(a3.c AS INTEGER) AS "cluster", d distance, CAST(sum(d) OVER (PARTITION BY a3.c) AS BIGINT) cluster_inertia, CAST(sum(d) OVER () AS BIGINT) inertia, sha256(array_to_string(list_transform(s3.x, lambda e: CAST(e AS VARCHAR)), ',')) centroid_sha256
FROM a3 JOIN s3 ON s3.c = a3.c
"""

ORACLES = {"op7_quality_rules": QUALITY, "op8_decontamination": DECONTAMINATION, "op11_prefix_trie": PREFIX_TRIE, "op13_centroid_clustering": CENTROIDS}
