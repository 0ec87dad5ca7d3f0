"""DuckDB SQL that says what the queries return, by plainer means."""

NEAR_DUPLICATES = r"""
WITH RECURSIVE
words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s
    FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
    SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * s.n >= 75 * (x.n + y.n - s.n)),
reach(doc_id, other) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, min(r.other) AS component_id, d.doc_id = min(r.other) AS kept
FROM documents d JOIN reach r ON r.doc_id = d.doc_id LEFT JOIN sizes z ON z.doc_id = d.doc_id
GROUP BY d.doc_id, z.n
"""

LINE_QUALITY = r"""
WITH
texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(source, '') || CASE WHEN source IS NULL THEN chr(1) ELSE '' END AS host, coalesce(text, '') AS text FROM documents),
words AS (SELECT row, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM texts),
windows AS (SELECT row, i, w[i : i + 2] AS t FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
again AS (SELECT row, i FROM windows QUALIFY count(*) OVER (PARTITION BY row, t) > 1),
covered AS (SELECT row, count(DISTINCT i + j) AS n FROM again, (VALUES (0), (1), (2)) AS steps(j) GROUP BY row),
lines AS (
    SELECT row, host, x AS line,
        list_filter(regexp_split_to_array(lower(x), '[\x20\x09-\x0D]+'), lambda y: y <> '') AS w
    FROM (SELECT row, host, unnest(string_split(text, chr(10))) AS x FROM texts)
    WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
common AS (SELECT host, w FROM lines JOIN texts USING (row, host) GROUP BY ALL HAVING count(DISTINCT coalesce(doc_id::VARCHAR, 'row ' || row)) > 20),
removed AS (SELECT row, sum(len(l.w)) AS n FROM lines l JOIN common c ON c.host = l.host AND c.w = l.w GROUP BY row),
dups AS (SELECT row, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY row),
figures AS (
    SELECT doc_id, len(w)::BIGINT AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(d.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(r.n, 0)::BIGINT AS removed
    FROM texts t JOIN words USING (row) LEFT JOIN dups d USING (row) LEFT JOIN covered c USING (row) LEFT JOIN removed r USING (row))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * (n_words - removed) >= n_words AS kept,
    n_words - removed AS left_words
FROM figures
"""

HAMMING = r"""
WITH codes AS (
    SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 AND NOT isnan(x) THEN 1 ELSE 0 END) AS code
    FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = 64),
pairs AS (
    SELECT q.vec_id AS query_id, v.vec_id AS neighbour_id,
        list_sum(list_transform(range(1, 65), lambda i: CASE WHEN q.code[i] <> v.code[i] THEN 1 ELSE 0 END))::INTEGER AS distance
    FROM codes q JOIN codes v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id)::INTEGER AS rank, neighbour_id, distance
FROM pairs QUALIFY rank <= 10
"""

SHARDS = r"""
WITH rows AS (
    SELECT row_number() OVER () AS row, doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes, md5(text) AS hash,
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS address
    FROM documents),
levels AS (SELECT *, address >> (60 - depth) AS prefix FROM rows, (SELECT unnest(range(0, 61))::INTEGER AS depth)),
sums AS (SELECT depth, prefix, sum(n_bytes)::BIGINT AS bytes FROM levels GROUP BY ALL),
placed AS (
    SELECT l.*, s.bytes FROM levels l JOIN sums s USING (depth, prefix)
    WHERE s.bytes <= {limit} OR l.depth = 60
    QUALIFY row_number() OVER (PARTITION BY l.row ORDER BY l.depth) = 1),
chains AS (
    SELECT *, row_number() OVER c AS number, coalesce(sum(n_bytes) OVER (c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        coalesce(max(CASE WHEN 2 * n_bytes <= {limit} THEN n_bytes END) OVER (PARTITION BY prefix), 0) AS largest
    FROM placed WHERE bytes > {limit} WINDOW c AS (PARTITION BY prefix ORDER BY n_bytes, hash NULLS FIRST, row)),
linked AS (
    SELECT doc_id, n_bytes, depth, prefix, 0 AS link, bytes AS shard_bytes FROM placed WHERE bytes <= {limit}
    UNION ALL
    SELECT doc_id, n_bytes, depth, prefix, link, sum(n_bytes) OVER (PARTITION BY prefix, link) FROM (
        SELECT *, CASE WHEN 2 * n_bytes > {limit} THEN -number ELSE before // ({limit} - largest) END AS link FROM chains))
SELECT doc_id, n_bytes, depth, prefix,
    CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(prefix), 60, '0'), depth) END || CASE WHEN link <> 0 THEN '+' || abs(link) ELSE '' END AS shard,
    shard_bytes::BIGINT AS shard_bytes
FROM linked
"""

#: Unsigned crc32 of the UTF-8 bytes of {s}: bit by bit over the reversed polynomial.
_CRC32 = """xor(4294967295, list_reduce(
    flatten(list_transform(range(0, length(hex(encode({s}))) // 2), lambda i: [('0x' || substr(hex(encode({s})), 2 * i + 1, 2))::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
    lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295::BIGINT))"""

CHAT = r"""
WITH turns AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
escaped AS (
    SELECT *, length(regexp_replace(text, '(<\\*/?s>|\[\\*/?(INST|SYS|ROLE)\]|\[\\*/TURN\])', '\1+', 'g'))
        + CASE WHEN role = 'user' THEN 15 WHEN role = 'system' THEN 13 WHEN role = 'assistant' THEN 5 ELSE
            23 + length(regexp_replace(coalesce(role, ''), '(<\\*/?s>|\[\\*/?(INST|SYS|ROLE)\]|\[\\*/TURN\])', '\1+', 'g')) END AS chars
    FROM turns)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(text))) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(text)) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    sum(chars)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""

MERKLE = r"""
WITH RECURSIVE
said AS (
    SELECT *, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
            || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
        coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail
    FROM documents),
leaves AS (
    SELECT doc_id, lang, sha256(head || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
        CASE WHEN {crc} % 7 = 0 THEN sha256(head || coalesce(octet_length(encode((n_chars + 1)::VARCHAR)) || ':' || (n_chars + 1), '-') || tail) END AS tampered
    FROM said),
placed AS (
    SELECT *, row_number() OVER () AS row, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n
    FROM leaves),
nodes(tree, level, idx, n, hash) AS (
    SELECT tree, 0, idx, n, leaf FROM placed
    UNION ALL
    SELECT tree, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(hash, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 2, n),
subroots AS (SELECT tree, hash, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper_nodes(level, idx, n, hash) AS (
    SELECT 0, tree, n, hash FROM subroots
    UNION ALL
    SELECT level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(hash, '' ORDER BY idx)) FROM upper_nodes WHERE n > 1 GROUP BY level, idx // 2, n),
fold(row, tree, level, idx, n, own, proof) AS (
    SELECT row, tree, 0, idx, n, coalesce(tampered, leaf), '' FROM placed
    UNION ALL
    SELECT f.row, f.tree, f.level + 1, f.idx // 2, (f.n + 1) // 2,
        sha256(CASE WHEN f.idx % 2 = 1 THEN coalesce(s.hash, '') || f.own ELSE f.own || coalesce(s.hash, '') END), f.proof || coalesce(s.hash, '')
    FROM fold f LEFT JOIN nodes s ON s.tree = f.tree AND s.level = f.level AND s.idx = xor(f.idx, 1) WHERE f.n > 1),
fold_on(row, level, idx, n, own, proof) AS (
    SELECT row, 0, f.tree, s.n, own, proof FROM fold f JOIN subroots s ON s.tree = f.tree WHERE f.n = 1
    UNION ALL
    SELECT f.row, f.level + 1, f.idx // 2, (f.n + 1) // 2,
        sha256(CASE WHEN f.idx % 2 = 1 THEN coalesce(s.hash, '') || f.own ELSE f.own || coalesce(s.hash, '') END), f.proof || coalesce(s.hash, '')
    FROM fold_on f LEFT JOIN upper_nodes s ON s.level = f.level AND s.idx = xor(f.idx, 1) WHERE f.n > 1)
SELECT p.doc_id, p.leaf, s.hash AS subroot, r.hash AS root, sha256(f.proof) AS proof_sha256, f.own AS folded_root, f.own = r.hash AS verified
FROM placed p JOIN subroots s ON s.tree = p.tree JOIN fold_on f ON f.row = p.row AND f.n = 1, (SELECT hash FROM upper_nodes WHERE n = 1) r
""".replace("{crc}", _CRC32.replace("{s}", "doc_id::VARCHAR"))

SPELLING = r"""
WITH RECURSIVE
runs AS (
    SELECT coalesce(doc_id::VARCHAR, '') || ':' AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM documents),
counted AS (SELECT id, run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT *, {crc} AS h FROM counted),
words AS (
    SELECT word, sum(n)::BIGINT AS n FROM (
        SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
    WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cuts AS (SELECT word, n, i, substr(word, 1, i) AS head, substr(word, i + 2) AS tail FROM words, unnest(range(0, length(word))) AS t(i)),
pairs AS (
    SELECT a.word, b.word AS near, b.n FROM cuts a JOIN cuts b ON a.head = b.head AND a.tail = b.tail AND a.word <> b.word
    UNION
    SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.head || a.tail = b.word
    UNION
    SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.head || a.tail = b.word),
most AS (SELECT word, count(*) AS n_near, min(struct_pack(less := -n, near := near)) AS m FROM pairs GROUP BY word),
formed AS (
    SELECT w.word, w.n, coalesce(m.n_near, 0) AS n_near, CASE WHEN -m.m.less >= 10 * w.n THEN m.m.near END AS form, CASE WHEN -m.m.less >= 10 * w.n THEN -m.m.less END AS form_n
    FROM words w LEFT JOIN most m USING (word)),
chain AS (
    SELECT word, word AS root, form AS next FROM formed
    UNION ALL
    SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON f.word = c.next)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON c.word = f.word AND c.next IS NULL
""".replace("{crc}", _CRC32.replace("{s}", "id || run"))
