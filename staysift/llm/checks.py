"""SQL (DuckDB) that gives the rows of the queries that SQL can express."""

from __future__ import annotations

from staysift.llm.quality_rules import SPELLINGS

OP5 = """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::HUGEINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE a.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""

OP7 = """
WITH RECURSIVE one AS (
  SELECT vec_id, min(struct_pack(label := label, vec := embedding::DOUBLE[])) AS x
  FROM embeddings GROUP BY vec_id
), v AS (
  SELECT vec_id, x.label AS label, x.vec AS vec FROM one
  WHERE vec_id IS NOT NULL AND x.label IS NOT NULL AND x.vec IS NOT NULL
    AND len(list_filter(x.vec, lambda y: y IS NULL OR NOT isfinite(y))) = 0
    AND len(list_filter(x.vec, lambda y: y <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM v a JOIN v b ON a.label = b.label AND len(a.vec) = len(b.vec) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.vec, b.vec) >= 0.98
), reach(a, b) AS (
  SELECT a, b FROM links
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), found AS (SELECT a AS vec_id, min(b) AS low FROM reach GROUP BY a),
counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT one.vec_id, coalesce(counted.n, 0)::BIGINT AS n_links,
       least(one.vec_id, coalesce(found.low, one.vec_id)) AS component_id,
       least(one.vec_id, coalesce(found.low, one.vec_id)) IS NOT DISTINCT FROM one.vec_id AS kept
FROM one LEFT JOIN found USING (vec_id) LEFT JOIN counted USING (vec_id)
"""

# The rules of the mix once more: words, targets, draws by md5, index permutations, overlaps.
OP10 = """
WITH docs AS (
  SELECT source, doc_id AS key, md5(coalesce(text, '')) AS hash,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM documents
), units AS (SELECT source, key, hash, size, count(*) AS n FROM docs GROUP BY ALL),
per AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS sid
  FROM (SELECT source, sum(size * n)::BIGINT AS source_size FROM units GROUP BY source)
), weighed AS (
  SELECT *, [5.0, 2.0, 1.0][(sid - 1) % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap,
         1.5::DOUBLE * sum(source_size) OVER () AS total
  FROM per
), levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, sid
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, sid
                                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), aimed AS (
  SELECT *, level >= cap / weight AS stops FROM levels
), targets AS (
  SELECT *, CASE WHEN stops THEN cap ELSE max(CASE WHEN NOT stops THEN level END) OVER () * weight END AS target,
         greatest(1, least(256, source_size // 256)) AS block
  FROM aimed
), blocked AS (SELECT *, ceil(source_size / block)::BIGINT AS blocks FROM targets),
sources AS (
  SELECT *, CASE WHEN stops THEN 2 * blocks
                 ELSE least(floor(target / block + 0.5), 2 * blocks) END::BIGINT AS quota,
         coalesce(list_filter(list_concat(PRIMES[sid % 10 + 1:], PRIMES), lambda p: blocks % p <> 0)[1], 1) AS step
  FROM blocked
), ends AS (
  SELECT sid, sum(quota) OVER (ORDER BY sid) - quota AS low, sum(quota) OVER (ORDER BY sid) AS high FROM sources
), slots AS (
  SELECT slot, ('0x' || md5(slot::VARCHAR)[1:12])::BIGINT % (SELECT sum(quota)::BIGINT FROM sources) AS draw
  FROM (SELECT unnest(range((SELECT sum(quota)::BIGINT FROM sources))) AS slot)
), drawn AS (
  SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS j
  FROM slots JOIN ends ON draw >= low AND draw < high
), drew AS (
  SELECT sid, quota, coalesce(any_value(n), 0) AS drew
  FROM sources LEFT JOIN (SELECT sid, count(*) AS n FROM drawn GROUP BY sid) USING (sid) GROUP BY sid, quota
), state AS (
  SELECT *, sum(greatest(drew - quota, 0)) OVER (ORDER BY sid) - greatest(drew - quota, 0) AS over_first,
         sum(greatest(quota - drew, 0)) OVER (ORDER BY sid) - greatest(quota - drew, 0) AS under_first
  FROM drew
), passed AS (
  SELECT over_first + j - quota AS number FROM drawn JOIN state USING (sid) WHERE j >= quota
), lacking AS (
  SELECT sid, under_first + i AS number, drew + i AS j
  FROM (SELECT *, unnest(range((quota - drew)::BIGINT)) AS i FROM state WHERE quota > drew)
), placed AS (
  SELECT sid, j FROM drawn JOIN state USING (sid) WHERE j < quota
  UNION ALL SELECT sid, j FROM passed JOIN lacking USING (number)
), uses AS (
  SELECT sid, (step * (j % blocks + 1) + (j // blocks) * 7919) % blocks AS index, count(*) AS uses
  FROM placed JOIN sources USING (sid) GROUP BY ALL
), lots AS (
  SELECT *, unnest(range((n - 1) // 1000 + 1)) AS lot FROM units
), parts AS (
  SELECT sid, key, hash, lot, size, least(1000, l.n - lot * 1000) AS n,
         ('0x' || md5(concat_ws('|', coalesce(key::VARCHAR, ''), hash, lot::VARCHAR))[1:12])::BIGINT
           % greatest(1, ceil((SELECT count(*) FROM units) / 50000)::BIGINT) AS chunk
  FROM lots l JOIN sources s ON l.source IS NOT DISTINCT FROM s.source
), summed AS (
  SELECT *, coalesce(sum(size * n) OVER (PARTITION BY sid ORDER BY chunk, key NULLS FIRST, hash, lot
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM parts
), spread AS (
  SELECT sid, key, hash, lot, copy, size, before + copy * size AS place
  FROM (SELECT *, unnest(range(n)) AS copy FROM summed)
), covered AS (
  SELECT p.*, block, (least(place + size, (u.index + 1) * block) - greatest(place, u.index * block)) * u.uses AS words
  FROM (SELECT x.*, block FROM spread x JOIN sources USING (sid)) p
  LEFT JOIN uses u ON u.sid = p.sid AND size > 0 AND u.index >= place // block AND u.index <= (place + size - 1) // block
), taken AS (
  SELECT sid, key, hash, lot, copy, size, coalesce(sum(words), 0)::BIGINT AS taken FROM covered GROUP BY ALL
)
SELECT key AS doc_id, size, source_size, target, taken FROM taken JOIN sources USING (sid)
""".replace("PRIMES", "[1048583, 1048589, 1048601, 1048609, 1048613, 1048627, 1048633, 1048661, 1048681, 1048703]")

# The table of rules once more, over words, lines and windows of three words as rows.
OP13 = r"""
WITH numbered AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
texts AS (
  SELECT row, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM numbered
), windows AS (
  SELECT row, i, count(*) OVER (PARTITION BY row, words[i], words[i + 1], words[i + 2]) AS times
  FROM (SELECT row, words, unnest(range(1, len(words) - 1)) AS i FROM texts)
), repeats AS (
  SELECT row, count(DISTINCT place) AS n_repeat_words
  FROM (SELECT row, unnest([i, i + 1, i + 2]) AS place FROM windows WHERE times > 1) GROUP BY row
), counted AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         len(regexp_extract_all(text, '!')) AS n_exclamations,
         len(regexp_extract_all(text, '\p{Lu}')) AS n_capitals,
         len(list_filter(words, lambda w: w IN (STOP))) AS n_stop_words,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '^[ \t]*[-*•·‣]'))) AS n_bullet_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_cut_lines
  FROM texts LEFT JOIN repeats USING (row)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words <= 500000
       AND word_chars / n_words BETWEEN 2 AND 15 AND n_symbols / n_words <= 0.1
       AND n_exclamations / n_words <= 0.1 AND n_capitals / word_chars <= 0.3
       AND n_stop_words / n_words >= 0.02 AND n_repeat_words / n_words <= 0.5
       AND n_dup_lines / n_lines <= 0.5 AND n_bullet_lines / n_lines <= 0.9
       AND n_cut_lines / n_lines <= 0.3 AS kept
FROM judged
""".replace("STOP", ", ".join(f"'{w}'" for w in SPELLINGS))

# CRC-32 of an ASCII text: eight shifts a character.
CRC32 = """xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(TEXT) + 1),
  lambda i: ord(substring(TEXT, i, 1))::BIGINT)),
  lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda t, z: CASE WHEN t & 1 = 1 THEN xor(t >> 1, 3988292384) ELSE t >> 1 END)), 4294967295)"""

# The repair as a walk through the grammar's states (0 start, 1 system, 2 user, 3 assistant), turn by
# turn, with the cheapest and least script to each state.
OP11 = """
WITH RECURSIVE named AS (
  SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations
), drawn AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, CRC % 20 AS kind FROM named
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM drawn WHERE kind <> 0
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         substring(role, 1, 1) AS c,
         lag(substring(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS before,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
         NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
         NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS cut
  FROM damaged
), faults AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
         count(*) FILTER (blank)::BIGINT AS blank, count(*) FILTER (NOT blank AND again)::BIGINT AS duplicate,
         count(*) FILTER (NOT blank AND NOT again AND cut)::BIGINT AS truncated,
         count(*) FILTER (before || c NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal, max(i) AS n
  FROM ordered GROUP BY conv_id
), inserted(q, p, cost, audit, out) AS (
  VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
         (0, 2, 5, 'I', 'user:' || chr(10)), (1, 2, 5, 'I', 'user:' || chr(10)),
         (2, 3, 5, 'I', 'assistant:' || chr(10)), (3, 2, 5, 'I', 'user:' || chr(10)),
         (0, 3, 10, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)),
         (1, 3, 10, 'II', 'user:' || chr(10) || 'assistant:' || chr(10))
), emitted(p, c, q, name) AS (
  VALUES (0, 's', 1, ''), (0, 'u', 2, 'user'), (1, 'u', 2, 'user'), (3, 'u', 2, 'user'), (2, 'a', 3, 'assistant')
), scripts AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, {'cost': 0, 'audit': '', 'out': ''} AS best FROM faults
  UNION ALL
  SELECT conv_id, i, q, min(best) FROM (
    SELECT s.conv_id, r.i, m.q, {'cost': (s.best.cost + w.cost + m.cost)::INTEGER,
           'audit': s.best.audit || w.audit || m.edit, 'out': s.best.out || w.out || m.line} AS best
    FROM scripts s JOIN ordered r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i + 1
    JOIN inserted w ON w.q = s.q
    CROSS JOIN LATERAL (
      SELECT w.p AS q, 2 AS cost, 'D' AS edit, '' AS line
      UNION ALL SELECT e.q, 5 * r.cut::INTEGER, 'K', r.role || ':' || r.text || chr(10) FROM emitted e
        WHERE e.p = w.p AND e.c = r.c AND NOT r.blank AND NOT r.again
      UNION ALL SELECT e.q, 1 + 5 * r.cut::INTEGER, 'R', e.name || ':' || r.text || chr(10) FROM emitted e
        WHERE e.p = w.p AND e.name <> '' AND NOT r.blank AND NOT r.again) m
  ) GROUP BY conv_id, i, q
), ended AS (
  SELECT s.conv_id, min({'cost': (s.best.cost + w.cost)::INTEGER, 'audit': s.best.audit || w.audit,
                         'out': s.best.out || w.out}) AS best
  FROM scripts s JOIN faults f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.n = s.i
  JOIN inserted w ON w.q = s.q WHERE w.p IN (0, 3) GROUP BY s.conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit,
       sha256(coalesce(best.out[:-2], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
""".replace("CRC", CRC32.replace("TEXT", "name"))

# The trie as rows: one for each conversation and depth, prefixes named by a digest of their turns.
OP12 = """
WITH rows AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
           coalesce(text, '')) AS place,
         md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
         length(coalesce(text, '')) AS size
  FROM conversations WHERE conv_id IS NOT NULL
), heads AS (SELECT c, CRC % 6 AS h FROM (SELECT DISTINCT c, c::VARCHAR AS name FROM rows)),
rebuilt AS (
  SELECT heads.c, 0 AS own, place, digest, size FROM heads JOIN rows ON rows.c = heads.c - heads.c % 100 AND place <= h
  UNION ALL SELECT rows.c, 1, place, digest, size FROM rows JOIN heads USING (c) WHERE place > h
), sequences AS (
  SELECT c, coalesce(list(digest ORDER BY own, place) FILTER (digest IS NOT NULL), []) AS digests,
         coalesce(list(size ORDER BY own, place) FILTER (digest IS NOT NULL), []) AS sizes
  FROM heads LEFT JOIN rebuilt USING (c) GROUP BY c
), named AS (
  SELECT *, list_transform(range(0, len(digests) + 1), lambda d: md5(d || ':' || array_to_string(digests[1:d], ','))) AS names
  FROM sequences
), steps AS (
  SELECT c, sizes, names, unnest(range(1, len(names) + 1)) AS k FROM named
), nodes AS (
  SELECT names[k] AS name, k - 1 AS depth, min(c) AS conv_id, count(*) AS n,
         any_value(CASE WHEN k > 1 THEN names[k - 1] END) AS above, any_value(names[1:k]) AS line,
         any_value(CASE WHEN k > 1 THEN sizes[k - 1] ELSE 0 END) AS size,
         string_agg(CASE WHEN k = len(names) THEN c::VARCHAR END, ',' ORDER BY c) AS ends
  FROM steps GROUP BY names[k], k
), children AS (SELECT above AS name, count(*) AS n_children FROM nodes WHERE above IS NOT NULL GROUP BY above),
under AS (
  SELECT name, sum(CASE WHEN n_children IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((n - 1) * size)::BIGINT AS saved_tokens
  FROM (SELECT unnest(line) AS name, n, size, n_children FROM nodes LEFT JOIN children USING (name)) GROUP BY name
)
SELECT x.conv_id, x.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, x.n::BIGINT AS n_convs,
       coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved_tokens, sha256(coalesce(x.ends, '')) AS ends_sha256
FROM nodes x LEFT JOIN nodes p ON p.name = x.above LEFT JOIN children ON children.name = x.name
JOIN under ON under.name = x.name
""".replace("CRC", CRC32.replace("TEXT", "name"))
