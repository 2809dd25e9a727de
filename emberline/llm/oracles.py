"""DuckDB SQL for the queries that SQL can express. They give the rows of any tables (mixing: of up to 1,000 sources, which one schedule holds)."""

from __future__ import annotations

from .mixing import BLOCK_ROWS, PERIOD, SIZE_TENTHS
from .sharding import ROUNDS

#: crc32 by bytes, with its table worked out by the rule of the reflected polynomial.
CRC32 = """crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT) AS v FROM range(0, 256) r(i)))"""


def sharding_sql(shards: int = 16, seed: int = 20) -> str:
    prf = lambda half, i: f"('0x' || md5(concat('{seed}:{i}:', {half}))[1:12])::BIGINT"
    steps = "(SELECT row_no, step + 1 AS step, n, a, b, y // b AS l, y % b AS r FROM walk, size WHERE step = 0 OR y >= n)"
    for i in range(ROUNDS):
        turn = f"(l + {prf('r', i)} % a) % a AS l, r" if i % 2 == 0 else f"l, (r + {prf('l', i)} % b) % b AS r"
        steps = f"(SELECT row_no, step, n, a, b, {turn} FROM {steps})"
    return f"""WITH RECURSIVE {CRC32}, docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
hashed AS (SELECT doc_id, octet_length(encode(text)) + 1 AS size, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM docs),
summed AS (SELECT doc_id, size, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32 FROM hashed, crc_table),
numbered AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws(':', coalesce(doc_id::VARCHAR, ''), size, text_crc32)), doc_id NULLS FIRST, size, text_crc32) - 1 AS row_no FROM summed),
size AS (SELECT n, a, CAST(ceil(n / a) AS BIGINT) AS b FROM (SELECT count(*) AS n, CAST(floor(sqrt(count(*) - 1)) AS BIGINT) + 1 AS a FROM docs)),
walk(row_no, step, y) AS (SELECT row_no, 0, row_no FROM numbered UNION ALL SELECT row_no, step, l * b + r FROM {steps})
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST(y % {shards} AS INT) AS shard, CAST(y // {shards} AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard, row_no, y AS position FROM walk JOIN numbered USING (row_no), size WHERE step > 0 AND y < n"""


def mixing_sql() -> str:
    release = "done[i] * d // s[i] <= t"
    due = "((done[i] + 1) * d + s[i] - 1) // s[i]"
    return f"""WITH RECURSIVE docs AS (SELECT doc_id, coalesce(source, '') AS source FROM documents), counts AS (SELECT source, count(*) AS n, count(*) OVER () AS k, sum(count(*)) OVER () AS total FROM docs GROUP BY source),
exact AS (SELECT *, greatest({PERIOD}, 8 * k) AS d, (greatest({PERIOD}, 8 * k) - k) * ({SIZE_TENTHS} * n * k + {10 - SIZE_TENTHS} * total) AS num, 10 * k * total AS den FROM counts),
base AS (SELECT source, n, d, CAST(1 + num // den AS BIGINT) AS base, num % den AS left_over FROM exact),
plan AS (SELECT source, n, sum(n) OVER () AS total, CAST(d AS BIGINT) AS d, base + CASE WHEN row_number() OVER (ORDER BY left_over DESC, source) <= d - sum(base) OVER () THEN 1 ELSE 0 END AS share FROM base),
packed AS (SELECT list(share ORDER BY source) AS s, list(source ORDER BY source) AS names, max(d) AS d FROM plan),
sim(t, done, pick) AS (SELECT 0::BIGINT, list_transform(s, lambda x: 0::BIGINT), NULL::BIGINT FROM packed UNION ALL
SELECT t + 1, list_transform(done, lambda c, i: CASE WHEN i = p THEN c + 1 ELSE c END), p FROM (SELECT t, done, (list_min(list_filter(list_transform(range(1, len(s) + 1), lambda i: CASE WHEN done[i] < s[i] AND {release} THEN {{'due': {due}, 'i': i}} END), lambda x: x IS NOT NULL))).i AS p FROM sim, packed WHERE t < d)),
schedule AS (SELECT names[pick] AS source, t - 1 AS slot_in_period, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS nth FROM sim, packed WHERE pick IS NOT NULL),
blocks AS (SELECT least({BLOCK_ROWS}, 1 + min(total * share // d) // 100)::BIGINT AS b FROM plan),
ends AS (SELECT b, max((((n - 1) // b // share) * d + slot_in_period) * b + (n - 1) % b) AS last FROM plan p JOIN blocks ON true JOIN schedule c ON c.source = p.source AND c.nth = ((n - 1) // b) % share GROUP BY b),
given AS (SELECT p.*, b, last, CAST(ceil((last // b + 1) * share / d) AS BIGINT) + 2 AS blocks FROM plan p, ends),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST) - 1 AS row_no FROM docs),
placed AS (SELECT doc_id, source, share, d, n, b, last, row_no, unnest(range(0, (blocks * b - row_no + n - 1) // n)) AS epoch FROM numbered JOIN given USING (source)),
blocked AS (SELECT *, (epoch * n + row_no) // b AS block, (epoch * n + row_no) % b AS inside FROM placed),
mixed AS (SELECT doc_id, k.source, epoch, block, (block // share) * d + slot_in_period AS slot, b, inside, last FROM blocked k JOIN schedule c ON c.source = k.source AND c.nth = block % share)
SELECT doc_id, source, CAST(epoch AS INT) AS epoch, CAST(block AS BIGINT) AS block, CAST(slot AS BIGINT) AS slot, CAST(slot * b + inside AS BIGINT) AS position FROM mixed WHERE slot * b + inside <= last"""


EXACT_DEDUP = r"""WITH texts AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
row_number() OVER (PARTITION BY body ORDER BY doc_id) = 1 AS kept, sha256(body) AS text_sha256
FROM texts WINDOW same AS (PARTITION BY body)"""

LEXICAL_SEARCH = r"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
corpus AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM docs),
held AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM docs) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * max(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, corpus GROUP BY term),
asked AS (SELECT DISTINCT i, item_id, term FROM (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)),
scores AS (SELECT i, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score FROM asked JOIN weights USING (term) JOIN held USING (term), corpus GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id, r) AS place FROM scores WHERE score > 0)
SELECT item_id, CAST(place AS INT) AS rank, doc_id, score FROM ranked WHERE place <= 50"""

PREFIX_TRIE = f"""WITH {CRC32},
said AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
coded AS (SELECT c, list_transform(regexp_extract_all(hex(encode(c::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM (SELECT DISTINCT c FROM said)),
plan AS (SELECT c, c - c % 5 AS donor, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 9 AS h FROM coded, crc_table),
taken AS (SELECT p.c, 0 AS part, s.pos, s.role, s.text FROM plan p JOIN said s ON s.c = p.donor AND s.pos < p.h UNION ALL SELECT p.c, 1, s.pos, s.role, s.text FROM plan p JOIN said s ON s.c = p.c AND s.pos >= p.h),
listed AS (SELECT c, list(struct_pack(r := role, x := text) ORDER BY part, pos) AS turns FROM taken GROUP BY c),
whole AS (SELECT p.c, turns, coalesce(len(turns), 0) AS n FROM plan p LEFT JOIN listed USING (c)),
paths AS (SELECT c, n, depth, CASE WHEN depth > 0 THEN md5(to_json(turns[1:depth])::VARCHAR) ELSE '' END AS key, CASE WHEN depth > 0 THEN octet_length(encode(turns[depth].x)) ELSE 0 END AS size FROM (SELECT *, unnest(range(0, n + 1)) AS depth FROM whole)),
nodes AS (SELECT key, depth, min(c) AS owner, count(*) AS n_convs, max(size) AS size, bool_and(n = depth) AS leaf, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = depth), '')) AS ends_sha256 FROM paths GROUP BY key, depth),
owned AS (SELECT c, depth, owner FROM paths JOIN nodes USING (key, depth)),
linked AS (SELECT v.*, a.owner AS parent FROM nodes v LEFT JOIN owned a ON a.c = v.owner AND a.depth = v.depth - 1),
below AS (SELECT a.owner, a.depth, sum(v.leaf::INT) AS n_leaves, sum((v.n_convs - 1) * v.size) AS saved_tokens FROM nodes v JOIN owned a ON a.c = v.owner AND a.depth <= v.depth GROUP BY ALL),
children AS (SELECT parent AS owner, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE parent IS NOT NULL GROUP BY ALL)
SELECT owner AS conv_id, depth, parent AS parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM linked JOIN below USING (owner, depth) LEFT JOIN children USING (owner, depth)"""
