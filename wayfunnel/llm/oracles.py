"""SQL counterparts of the corpus queries, over the given tables."""

COMMON_LINES = r"""
WITH rows AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
parts AS (
    SELECT rid, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS place FROM rows),
keyed AS (
    SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM parts),
common AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10),
left_over AS (
    SELECT rid, string_agg(line, chr(10) ORDER BY place) AS kept, count(*) AS n FROM keyed
    WHERE key NOT IN (SELECT key FROM common) GROUP BY rid)
SELECT doc_id, len(lines)::BIGINT AS n_lines, (len(lines) - coalesce(n, 0))::BIGINT AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256
FROM rows LEFT JOIN left_over USING (rid)
"""

WORD_WINDOWS = r"""
WITH rows AS (
    SELECT row_number() OVER () AS rid, doc_id,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
places AS (SELECT rid, words, unnest(range(1, len(words) - 33)) AS place FROM rows WHERE len(words) >= 35),
windows AS (SELECT rid, place, md5(array_to_string(words[place:place + 34], ' ')) AS key FROM places),
again AS (SELECT rid, place FROM windows WHERE key IN (SELECT key FROM windows GROUP BY key HAVING count(*) > 1)),
gone AS (SELECT DISTINCT rid, place + unnest(range(0, 35)) AS place FROM again),
single AS (SELECT rid, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM rows),
left_over AS (
    SELECT rid, string_agg(word, ' ' ORDER BY place) AS kept, count(*) AS n FROM single ANTI JOIN gone USING (rid, place) GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM rows LEFT JOIN left_over USING (rid)
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE rows AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN words ELSE list_distinct(list_transform(
        range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) END AS shingles FROM rows),
single AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets),
pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM single a JOIN single b USING (shingle)
    WHERE a.doc_id < b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT doc_id AS id, doc_id AS root FROM sets UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.id),
least AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)
SELECT doc_id, len(shingles)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN least ON id = doc_id
"""

LEXICAL_SEARCH = r"""
WITH terms AS (
    SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
docs AS (SELECT rid, doc_id, terms, len(terms)::BIGINT AS n FROM terms WHERE len(terms) > 0),
whole AS (SELECT count(*)::BIGINT AS total, sum(n)::BIGINT AS length FROM docs),
tf AS (SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(terms) AS term FROM docs) GROUP BY rid, term),
weight AS (
    SELECT term, floor(1000 * ln((2 * any_value(total) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term),
asked AS (
    SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark WHERE text IS NOT NULL),
scores AS (
    SELECT item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + ((90 * n * total) // length)))))::BIGINT AS score
    FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN docs USING (rid), whole GROUP BY item_id, rid, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""

IMPACT_SEARCH = r"""
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
    SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b
    ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scores QUALIFY rank <= 20
"""

CONVERSATION_REPAIR = r"""
WITH RECURSIVE crc AS (
    SELECT n, 0 AS step, n AS c FROM range(256) t(n)
    UNION ALL SELECT n, step + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM crc WHERE step < 8),
crcs AS (SELECT list(c ORDER BY n) AS t FROM crc WHERE step = 8),
keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_prepend(4294967295::BIGINT,
        list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
        lambda a, b: xor(a // 256, t[(xor(a, b) % 256) + 1])), 4294967295) % 20 AS fault FROM conversations, crcs),
rows AS (
    SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
        CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy FROM keyed WHERE fault <> 0),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
        regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body FROM rows),
told AS (
    SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before,
        CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
        WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'whole' END AS kind FROM placed),
counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (kind = 'blank') AS blank,
        count(*) FILTER (kind = 'duplicate') AS duplicate, count(*) FILTER (kind = 'truncated') AS truncated,
        count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM told GROUP BY conv_id),
-- the cheapest audit to each state (0 nothing yet, 1 after s, 2 after u, 3 after a) after each turn; up to two insertions in a row
puts AS (SELECT * FROM (VALUES (0, 0, 0, ''), (0, 2, 5, 'I'), (0, 3, 10, 'II'), (1, 1, 0, ''), (1, 2, 5, 'I'), (1, 3, 10, 'II'), (2, 2, 0, ''), (2, 3, 5, 'I'),
    (3, 3, 0, ''), (3, 2, 5, 'I')) t(a, b, c, i)),
ways AS (
    SELECT conv_id, 0::BIGINT AS pos, 0 AS state, 0 AS cost, '' AS audit FROM counts
    UNION ALL
    (SELECT conv_id, pos, state, min(cost), arg_min(audit, cost * 1.0) FROM (
        SELECT *, rank() OVER (PARTITION BY conv_id, pos, state ORDER BY cost, audit) AS r FROM (
            SELECT w.conv_id, t.pos, CASE e WHEN 'D' THEN p.b WHEN 'S' THEN 1 WHEN 'U' THEN 2 ELSE 3 END AS state,
                w.cost + p.c + CASE e WHEN 'D' THEN 2 ELSE (kind = 'truncated')::INTEGER * 5 + (initial <> lower(e))::INTEGER END AS cost,
                w.audit || p.i || CASE WHEN e = 'D' THEN 'D' WHEN initial = lower(e) THEN 'K' ELSE 'R' END AS audit
            FROM ways w JOIN told t ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND t.pos = w.pos + 1 JOIN puts p ON p.a = w.state
            CROSS JOIN (VALUES ('D'), ('S'), ('U'), ('A')) f(e)
            WHERE e = 'D' OR kind IN ('whole', 'truncated') AND (e = 'S' AND p.b = 0 AND initial = 's' OR e = 'U' AND p.b <> 2 OR e = 'A' AND p.b = 2)))
     WHERE r = 1 GROUP BY conv_id, pos, state)),
ended AS (
    SELECT w.conv_id, w.cost + p.c AS cost, w.audit || p.i AS audit FROM ways w JOIN counts k ON w.conv_id IS NOT DISTINCT FROM k.conv_id AND w.pos = k.n
    JOIN puts p ON p.a = w.state WHERE p.b IN (0, 3)
    QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + p.c, w.audit || p.i) = 1),
edits AS (SELECT conv_id, unnest(string_split(audit, '')) AS edit, unnest(range(1, len(audit) + 1)) AS place FROM ended WHERE audit <> ''),
aligned AS (
    SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY place) AS pos,
        count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id ORDER BY place) AS out FROM edits),
fixed AS (
    SELECT a.conv_id, a.edit, a.place, a.out, t.role, CASE WHEN a.edit = 'I' THEN '' ELSE t.text END AS text,
        max(CASE WHEN a.out = 1 AND a.edit = 'K' AND t.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY a.conv_id) AS lead
    FROM aligned a LEFT JOIN told t ON a.conv_id IS NOT DISTINCT FROM t.conv_id AND a.pos = t.pos AND a.edit <> 'I' WHERE a.edit <> 'D'),
texts AS (
    SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (out - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text,
        chr(10) ORDER BY place) AS text FROM fixed GROUP BY conv_id)
SELECT c.conv_id, coalesce(k.gaps, 0) AS gaps, coalesce(k.blank, 0) AS blank, coalesce(k.duplicate, 0) AS duplicate, coalesce(k.truncated, 0) AS truncated,
    coalesce(k.illegal, 0) AS illegal, coalesce(e.cost, 0)::BIGINT AS cost, coalesce(e.audit, '') AS audit, sha256(coalesce(x.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts k ON c.conv_id IS NOT DISTINCT FROM k.conv_id
    LEFT JOIN ended e ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN texts x ON c.conv_id IS NOT DISTINCT FROM x.conv_id
"""
