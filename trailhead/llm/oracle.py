"""DuckDB SQL of those queries that SQL can express."""

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Sets are compared through an index of shingles; components spread from each document along the links.
JACCARD = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
    GROUP BY 1, 2
), links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * n_both >= 80 * (x.n + y.n - n_both)
), reach AS (
    SELECT DISTINCT a, a AS node FROM links
    UNION
    SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.node
), least AS (
    SELECT a, min(node) AS component_id FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON a = d.doc_id
"""

LINES = f"""
WITH cut AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), rows AS (
    SELECT doc_id, len(parts) AS n_lines, unnest(parts) AS line, unnest(range(len(parts))) AS i FROM cut
), keyed AS (
    SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k
    FROM rows
), common AS (
    SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, first(n_lines) AS n_lines, count(common.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (common.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common USING (k)
GROUP BY doc_id
"""

# Measures word by word; DDSketch buckets as counts; fences from quartiles of source, language or everything.
QUALITY = rf"""
WITH docs AS (
    SELECT doc_id, lang, source, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), windows AS (
    SELECT doc_id, i, struct_pack(a := w[i], b := w[i + 1], c := w[i + 2]) AS t
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM docs WHERE len(w) >= 3)
), twice AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS c FROM windows) WHERE c > 1
), repeats AS (
    SELECT doc_id, count(DISTINCT p) AS n_repeat_words
    FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id
), lines AS (
    SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)
    WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id
), measured AS (
    SELECT doc_id, lang, source, len(w) AS n_words, length(regexp_replace(text, '{SPACE}', '', 'g')) AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
           coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
           len(w) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(w) AS base_failed
    FROM docs LEFT JOIN repeats USING (doc_id) LEFT JOIN lines USING (doc_id)
), valued AS (
    SELECT *, unnest([1, 2, 3, 4]) AS fence, unnest([
        CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END,
        CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END,
        CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END,
        CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END]) AS v
    FROM measured WHERE NOT base_failed
), sketch AS (
    SELECT lang, source, fence, CASE WHEN v > 0 THEN ceil(ln(v) / ln(1.02))::int ELSE -100000 END AS bucket, count(*) AS n
    FROM valued GROUP BY ALL
), levels AS (
    SELECT 'own' AS level, lang, source, fence, bucket, n FROM sketch
    UNION ALL SELECT 'lang', lang, NULL, fence, bucket, sum(n) FROM sketch GROUP BY lang, fence, bucket
    UNION ALL SELECT 'all', NULL, NULL, fence, bucket, sum(n) FROM sketch GROUP BY fence, bucket
), running AS (
    SELECT *, sum(n) OVER (PARTITION BY level, lang, source, fence ORDER BY bucket) AS upto,
           sum(n) OVER (PARTITION BY level, lang, source, fence) AS total,
           CASE WHEN bucket = -100000 THEN 0 ELSE pow(1.02, bucket) * (2 / 2.02) END AS value
    FROM levels
), quartiles AS (
    SELECT level, lang, source, fence, max(total) AS total, min(value) FILTER (4 * upto >= total) AS q1,
           min(value) FILTER (4 * upto >= 3 * total) AS q3
    FROM running GROUP BY level, lang, source, fence
), chosen AS (
    SELECT o.lang, o.source, o.fence,
           CASE WHEN o.total >= 200 THEN o.q1 WHEN l.total >= 200 THEN l.q1 ELSE a.q1 END AS q1,
           CASE WHEN o.total >= 200 THEN o.q3 WHEN l.total >= 200 THEN l.q3 ELSE a.q3 END AS q3
    FROM quartiles o
    JOIN quartiles l ON l.level = 'lang' AND l.lang IS NOT DISTINCT FROM o.lang AND l.fence = o.fence
    JOIN quartiles a ON a.level = 'all' AND a.fence = o.fence
    WHERE o.level = 'own'
), refused AS (
    SELECT DISTINCT doc_id FROM valued v JOIN chosen c
        ON c.lang IS NOT DISTINCT FROM v.lang AND c.source IS NOT DISTINCT FROM v.source AND c.fence = v.fence
    WHERE v > q3 + greatest([0.04, 0.5, 0.3, 2.0][c.fence], 6 * (q3 - q1))
       OR c.fence = 4 AND v < q1 - greatest(2.0, 6 * (q3 - q1))
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM refused) AS kept
FROM measured
"""

# The cap is reached by the sources with the least cap per weight; the others share the rest.
MIXING = rf"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
           ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')), 1, 15))::bigint AS h
    FROM documents
), sources AS (
    SELECT source, sum(size)::bigint AS source_size,
           [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::double AS weight
    FROM sized GROUP BY source
), ordered AS (
    SELECT *, 3.0 * source_size / weight AS full_at,
           ((SELECT sum(source_size) FROM sources)
             - coalesce(sum(3.0 * source_size) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST
                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM sources
), targets AS (
    SELECT source, source_size, least(3.0 * source_size,
               (SELECT max(level) FROM ordered WHERE level <= full_at) * weight)::double AS target
    FROM ordered
), budgets AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies FROM targets
), hashes AS (
    SELECT source, h, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto
    FROM sized GROUP BY source, h
), extra AS (
    SELECT source, h FROM hashes JOIN budgets b USING (source)
    WHERE upto <= target - copies * source_size
       OR upto - words <= target - copies * source_size AND words <= 2 * (target - copies * source_size - (upto - words))
)
SELECT doc_id, size, source_size, target, (size * (copies + (e.h IS NOT NULL)::int))::bigint AS taken
FROM sized s JOIN budgets b ON b.source IS NOT DISTINCT FROM s.source
LEFT JOIN extra e ON e.source IS NOT DISTINCT FROM s.source AND e.h = s.h
"""

URLS = rf"""
WITH parsed AS (
    SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
    FROM pages
), rules(verdict, rule_host, rule_path) AS (
    VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
           ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fitting AS (
    SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
           arg_max(verdict, length(rule_host || rule_path)) AS verdict
    FROM parsed JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parsed LEFT JOIN fitting USING (page_id)
"""

# The checksum's table of 256 entries follows from its polynomial. A level of a tree is a list of digests; recursion ends
# at one. Siblings are looked up by rank, level by level, first within the language, then among the languages.
MERKLE = """
WITH RECURSIVE checksums AS (
    SELECT list_transform(range(256), lambda x: list_reduce(
        list_concat([x], list_transform(range(8), lambda z: 0)), lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))) AS t
), docs AS (
    SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0 AS tampered
    FROM documents, checksums
), framed AS (
    SELECT doc_id, lang, coalesce(tampered, false) AS tampered, n_chars,
           coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') AS head,
           coalesce(strlen(text) || ':' || text, '-') AS tail
    FROM docs
), leaves AS (
    SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place,
           sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
           sha256(head || coalesce(strlen((n_chars + tampered::INT)::VARCHAR) || ':' || (n_chars + tampered::INT), '-') || tail)
               AS other
    FROM framed
), levels AS (
    SELECT lang, 0 AS level, list(leaf ORDER BY place) AS nodes FROM leaves GROUP BY lang
    UNION ALL
    SELECT lang, level + 1, list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))
    FROM levels WHERE len(nodes) > 1
), subroots AS (
    SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, level AS height
    FROM levels WHERE len(nodes) = 1
), tops AS (
    SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM subroots
    UNION ALL
    SELECT level + 1, list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))
    FROM tops WHERE len(nodes) > 1
), steps AS (
    SELECT a.doc_id, level, (a.place >> level) & 1 AS side, nodes[xor(a.place >> level, 1) + 1] AS sibling
    FROM leaves a JOIN levels b ON a.lang IS NOT DISTINCT FROM b.lang WHERE len(nodes) > 1
    UNION ALL
    SELECT a.doc_id, height + level, (b.place >> level) & 1, nodes[xor(b.place >> level, 1) + 1]
    FROM leaves a JOIN subroots b ON a.lang IS NOT DISTINCT FROM b.lang, tops WHERE len(nodes) > 1
), proofs AS (
    SELECT doc_id, sha256(string_agg(coalesce(sibling, ''), '' ORDER BY level)) AS proof_sha256,
           list({'d': sibling, 's': side} ORDER BY level) AS path
    FROM steps GROUP BY doc_id
), folds AS (
    SELECT doc_id, 0 AS n, other AS digest, path FROM leaves LEFT JOIN proofs USING (doc_id)
    UNION ALL
    SELECT doc_id, n + 1, sha256(CASE WHEN path[n + 1].s = 1 THEN path[n + 1].d || digest
                                      ELSE digest || coalesce(path[n + 1].d, '') END), path
    FROM folds WHERE n < len(path)
)
SELECT a.doc_id, leaf, subroot, r.nodes[1] AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, digest AS folded_root,
       digest = r.nodes[1] AS verified
FROM leaves a JOIN subroots b ON a.lang IS NOT DISTINCT FROM b.lang LEFT JOIN proofs p ON p.doc_id = a.doc_id
JOIN folds f ON f.doc_id = a.doc_id AND f.n = coalesce(len(f.path), 0), tops r
WHERE len(r.nodes) = 1
"""

NEGATIVES = """
WITH usable AS (
    SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
    SELECT a.uid AS anchor, a.vec_id AS anchor_id, b.uid AS other, b.vec_id, a.label = b.label AS alike,
           list_dot_product(a.v, b.v)::BIGINT AS score
    FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.uid <> b.uid
), positives AS (
    SELECT * FROM scores WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, other) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
       row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.vec_id, n.other)::INT AS rank
FROM positives p JOIN scores n ON p.anchor = n.anchor AND NOT n.alike
    AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10
"""

ORACLE_SQL = {
    "op3_jaccard_join": JACCARD,
    "op6_line_dedup": LINES,
    "op7_quality_rules": QUALITY,
    "op9_mixing": MIXING,
    "op10_url_filters": URLS,
    "op11_negatives": NEGATIVES,
    "op13_merkle": MERKLE,
}
