"""The operators' queries and, where SQL can express them, the SQL for the same rows."""

from __future__ import annotations

from statera.llm import (bpe, chunk_dedup, exact_dedup, license_scan, merkle_manifest, mixing, packing, prefix_trie, quality, sharding, simhash,
                         suffix_dedup, warc)
from statera.llm.license_scan import TEMPLATES, alike, need_of, told_by, words_of
from statera.llm.quality import END_MARKS, PHRASES

QUERIES = {
    "op1_stratified_sharding": sharding.op1,
    "op2_license_scan": license_scan.op2,
    "op3_block_naming_dedup": exact_dedup.op3,
    "op4_sparse_suffix_dedup": suffix_dedup.op4,
    "op5_systematic_mixing": mixing.op5,
    "op6_line_quality": quality.op6,
    "op7_chunk_dedup": chunk_dedup.op7,
    "op8_simhash_popcount": simhash.op8,
    "op9_warc_merkle_audit": warc.op9,
    "op9_warc_hurt_replica_audit": warc.op9_hurt,
    "op10_byte_bpe": bpe.op10,
    "op11_merkle_manifest": merkle_manifest.op11,
    "op12_prefix_trie": prefix_trie.op12,
    "op13_linear_grouping_packing": packing.op13,
}

_UNIT = "(('0x' || substr(md5({}), 1, 7))::BIGINT + 0.5::DOUBLE) / 268435456.0::DOUBLE"
#: The reflected CRC-32 of a text's bytes, by shifts of one byte; the table comes from the rule of eight shifts by one bit.
_CRC = """
crc_table AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, list_transform(range(8), lambda x: 0::BIGINT)),
      lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(i))),
crcs AS (
  SELECT text, xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(pairs, lambda p: ('0x' || p)::BIGINT)),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS crc
  FROM (SELECT text, regexp_extract_all(hex(encode(text)), '..') AS pairs FROM (SELECT DISTINCT text FROM documents WHERE text <> '')),
    crc_table)
"""

#: The CRC-32 of an integer's decimal digits, with crc_table in reach.
_CRC_OF = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({0}::VARCHAR)), '..'), lambda p: ('0x' || p)::BIGINT)),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"""
_TABLE = _CRC[: _CRC.index("crcs AS")].rstrip().rstrip(",")


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _templates() -> str:
    """Templates as SQL rows: number, label, words, distinct words, those needed and those that tell the template from others."""
    rows, told = [], told_by(TEMPLATES)
    for i, (label, text) in enumerate(TEMPLATES):
        words = [w.decode() for w in words_of(text)]
        some = sorted(set(words))
        rows.append(f"({i}, '{label}', {len(words)}, {some}, {need_of(len(some))}, {sorted(w.decode() for w in told[i])}::VARCHAR[])")
    return ", ".join(rows)


_MARKS, _PHRASES = END_MARKS.replace("'", "''"), "|".join(PHRASES).replace("'", "''")
_ALIKE = ", ".join(map(str, sorted(alike(TEMPLATES))))

ORACLE_SQL = {
    "op11_merkle_manifest": f"""
WITH RECURSIVE {_TABLE},
l AS (SELECT row_number() OVER () AS rid, doc_id, source, {_leaf('text')} AS leaf,
        CASE WHEN {_CRC_OF.format('doc_id')} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf('text')} END AS replica FROM documents, crc_table),
i AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM l),
lv(source, lvl, hs) AS (
  SELECT source, 0, list(leaf ORDER BY idx) FROM i GROUP BY source
  UNION ALL SELECT source, lvl + 1, list_transform(range((len(hs) + 2) // 3), lambda r: sha256(array_to_string(hs[3 * r + 1:3 * r + 3], ''))) FROM lv WHERE len(hs) > 1),
s AS (SELECT source, hs[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM lv WHERE len(hs) = 1),
up(lvl, hs) AS (
  SELECT 0, list(subroot ORDER BY place) FROM s
  UNION ALL SELECT lvl + 1, list_transform(range((len(hs) + 2) // 3), lambda r: sha256(array_to_string(hs[3 * r + 1:3 * r + 3], ''))) FROM up WHERE len(hs) > 1),
st AS (SELECT rid, lvl, idx // (3::BIGINT ** lvl)::BIGINT AS place, hs FROM i JOIN lv ON i.source IS NOT DISTINCT FROM lv.source WHERE len(hs) > 1
  UNION ALL SELECT rid, 1000 + lvl, place // (3::BIGINT ** lvl)::BIGINT, hs FROM i JOIN s ON i.source IS NOT DISTINCT FROM s.source, up WHERE len(hs) > 1),
p AS (SELECT rid, list({{'l': array_to_string(hs[place // 3 * 3 + 1:place], ''), 'r': array_to_string(hs[place + 2:place // 3 * 3 + 3], '')}} ORDER BY lvl) AS path FROM st GROUP BY rid),
f AS (SELECT doc_id, leaf, subroot, (SELECT hs[1] FROM up WHERE len(hs) = 1) AS root, coalesce(path, []) AS path, replica
      FROM i LEFT JOIN p USING (rid) JOIN s ON i.source IS NOT DISTINCT FROM s.source)
SELECT *, folded_root = root AS verified FROM (
  SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s.l || s.r), '')) AS proof_sha256,
    list_reduce(list_prepend({{'l': replica, 'r': ''}}, path), lambda a, s: {{'l': sha256(s.l || a.l || s.r), 'r': ''}}).l AS folded_root FROM f)
""",
    "op12_prefix_trie": f"""
WITH {_TABLE},
w AS (SELECT conv_id AS c, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g, strlen(coalesce(text, '')) AS b
      FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, g, b, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, g) - 1 AS pos FROM w),
n AS (SELECT c, c - c % 5 AS base, {_CRC_OF.format('c')} % 9 AS h FROM (SELECT DISTINCT c FROM o), crc_table),
m AS (SELECT n.*, least(h, coalesce((SELECT count(*) FROM o WHERE o.c = n.base), 0)) AS taken FROM n),
r AS (SELECT m.c, pos, g, b FROM m JOIN o ON o.c = m.base WHERE pos < h UNION ALL SELECT c, pos - h + taken, g, b FROM o JOIN m USING (c) WHERE pos >= h),
q AS (SELECT c, coalesce(list(g ORDER BY pos) FILTER (g IS NOT NULL), []) AS gs, coalesce(list(b ORDER BY pos) FILTER (g IS NOT NULL), []) AS bs FROM n LEFT JOIN r USING (c) GROUP BY c),
x AS (SELECT c, d, len(gs) AS len, array_to_string(gs[1:d], '') AS k, array_to_string(gs[1:d - 1], '') AS up, gs, bs[d] AS b FROM q, unnest(range(len(gs) + 1)) u(d)),
nodes AS (SELECT k, d AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(up) AS up, any_value(b) AS b, arg_min(gs, c) AS gs,
        sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len = d), '')) AS ends_sha256 FROM x GROUP BY k, d),
kids AS (SELECT up AS k, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY up),
t AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN kids USING (k)),
y AS (SELECT array_to_string(gs[1:j], '') AS k, (n_children = 0)::BIGINT AS leaf, coalesce((n_convs - 1) * b, 0) AS saved FROM t, unnest(range(depth + 1)) u(j)),
z AS (SELECT k, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM y GROUP BY k)
SELECT t.conv_id, t.depth, p.conv_id AS parent_conv_id, t.n_convs, t.n_children, n_leaves, saved_tokens, t.ends_sha256
FROM t JOIN z USING (k) LEFT JOIN t AS p ON t.depth > 0 AND p.k = t.up
""",
    "op2_license_scan": rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT rid, doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM t),
p(label, words) AS (VALUES ('gpl', ['gnu', 'general', 'public', 'license']), ('apache', ['apache', 'license']),
        ('cc-by', ['cc', 'by']), ('mit', ['mit', 'license'])),
pl AS (SELECT rid, label, i - 1 AS i FROM w, p, unnest(range(1, len(w) + 1)) u(i) WHERE w[i] = words[1] AND w[i:i + len(words) - 1] = words),
b AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word,
        array_to_string(list_sort(list_distinct(list(label))), ',') AS base_labels FROM pl GROUP BY rid),
m(tid, label, width, words, need, told) AS (VALUES {_templates()}),
v AS (SELECT tid, width, told, unnest(words) AS word FROM m),
z AS (SELECT rid, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS pos FROM w),
o AS (SELECT rid, tid, pos, list_contains(told, word) AS tells, greatest(coalesce(lag(pos) OVER (PARTITION BY rid, tid, word ORDER BY pos) + 1, 0), pos - width + 1, 0) AS lo,
        least(pos, greatest(0, n - width)) AS hi FROM z JOIN v USING (word)),
d AS (SELECT rid, tid, x, sum(d) AS d, sum(d) FILTER (tells) AS dt FROM (SELECT rid, tid, tells, lo AS x, 1 AS d FROM o WHERE lo <= hi UNION ALL SELECT rid, tid, tells, hi + 1, -1 FROM o WHERE lo <= hi) u GROUP BY 1, 2, 3),
h AS (SELECT rid, tid, x, lead(x) OVER (PARTITION BY rid, tid ORDER BY x) AS until, sum(d) OVER k AS held, coalesce(sum(dt) OVER k, 0) AS tells FROM d WINDOW k AS (PARTITION BY rid, tid ORDER BY x ROWS UNBOUNDED PRECEDING)),
y AS (SELECT h.*, width, need, label, len(words) AS size FROM h JOIN m USING (tid) WHERE held >= need AND tells = len(told)),
j AS (SELECT *, coalesce(x <> lag(until) OVER (PARTITION BY rid, tid ORDER BY x), true)::INT AS fresh FROM y),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY rid, tid ORDER BY x ROWS UNBOUNDED PRECEDING) AS run FROM j),
k AS (SELECT rid, tid, label, size, min(x) AS s, max(until) - 1 + width AS e, max(held) AS held FROM i GROUP BY rid, tid, label, size, width, run),
r(tid, other) AS (VALUES {_ALIKE}),
c AS (SELECT rid, label, held::DOUBLE / size AS held FROM k WHERE NOT EXISTS (SELECT 1 FROM k AS q, r WHERE r.tid = k.tid AND r.other = q.tid AND q.rid = k.rid AND q.s < k.e AND k.s < q.e
      AND (q.held, q.held::DOUBLE / q.size, -q.tid) > (k.held, k.held::DOUBLE / k.size, -k.tid))),
s AS (SELECT rid, max(held) AS score FROM c GROUP BY rid),
e AS (SELECT rid, label FROM pl UNION SELECT rid, label FROM c),
g AS (SELECT rid, array_to_string(list(label ORDER BY label), ',') AS labels FROM e GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0) END AS score
FROM w LEFT JOIN b USING (rid) LEFT JOIN g USING (rid) LEFT JOIN s USING (rid)
""",
    "op9_warc_merkle_audit": """
WITH d AS (SELECT *, md5('rot:' || coalesce(page_id::VARCHAR, '')) AS d, coalesce(html, '') AS body FROM pages),
r AS (SELECT *, CASE WHEN substr(d, 1, 2) < '04' AND length(body) > 0 THEN
          substr(body, 1, (('0x' || substr(d, 3, 6))::BIGINT % length(body))) || repeat('~', strlen(substr(body, (('0x' || substr(d, 3, 6))::BIGINT % length(body)) + 1, 1))) || substr(body, (('0x' || substr(d, 3, 6))::BIGINT % length(body)) + 2)
        ELSE body END AS rot FROM d),
h AS (SELECT *, md5(coalesce(page_id::VARCHAR, '') || '|' || coalesce(url, '')) AS key,
        'WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: ' AS x FROM r),
k AS (SELECT page_id, url, key,
        replace(x || coalesce(url, '') || '\r\nWARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '')
          || '>\r\nContent-Type: text/html\r\nContent-Length: ', '\r\n', chr(13) || chr(10)) AS head,
        chr(13) || chr(10) || chr(13) || chr(10) AS gap, body, rot FROM h),
a AS (SELECT page_id, url, key, head || strlen(body) || gap || body || gap AS ra, head || strlen(rot) || gap || rot || gap AS rb FROM k),
v AS (SELECT *, (('0x' || substr(key, 1, 7))::BIGINT % greatest(1, ceil(sum(strlen(ra)) OVER () / 67108864.0)::BIGINT))::INTEGER AS volume FROM a),
o AS (SELECT *, row_number() OVER w - 1 AS node, (sum(strlen(ra)) OVER w)::BIGINT AS ea, (sum(strlen(rb)) OVER w)::BIGINT AS eb FROM v
      WINDOW w AS (PARTITION BY volume ORDER BY key, page_id, url ROWS UNBOUNDED PRECEDING)),
z AS (SELECT *, sha256(sha256(ra) || '|' || (ea - strlen(ra)) || '|' || ea) AS digest_a, sha256(sha256(rb) || '|' || (eb - strlen(rb)) || '|' || eb) AS digest_b FROM o)
SELECT volume, node, page_id, ea - strlen(ra) AS start, ea AS "end", digest_a, digest_b, 'damaged' AS state FROM z WHERE digest_a <> digest_b
""",
    "op9_warc_hurt_replica_audit": """
WITH d AS (SELECT *, md5('rot:' || coalesce(page_id::VARCHAR, '')) AS d, substr(md5('hurt:' || coalesce(page_id::VARCHAR, '')), 1, 2) AS h, coalesce(html, '') AS body FROM pages),
r AS (SELECT *, CASE WHEN substr(d, 1, 2) < '04' AND length(body) > 0 THEN
          substr(body, 1, (('0x' || substr(d, 3, 6))::BIGINT % length(body))) || repeat('~', strlen(substr(body, (('0x' || substr(d, 3, 6))::BIGINT % length(body)) + 1, 1))) || substr(body, (('0x' || substr(d, 3, 6))::BIGINT % length(body)) + 2)
        ELSE body END AS rot FROM d),
c AS (SELECT page_id, url, h, CASE WHEN h < '02' THEN substr(rot, 1, floor(length(rot) * 2 / 3.0)::BIGINT) WHEN h < '04' THEN rot || '~' ELSE rot END AS body FROM r WHERE NOT h BETWEEN '04' AND '05'),
u AS (SELECT 'a' AS side, page_id, url, body FROM r UNION ALL SELECT 'b', page_id, url, body FROM c UNION ALL SELECT 'b', page_id, coalesce(url, '') || '#extra', body FROM c WHERE h BETWEEN '06' AND '07'),
k AS (SELECT side, page_id, md5(coalesce(page_id::VARCHAR, '') || '|' || coalesce(url, '')) AS key,
        replace('WARC/1.0|WARC-Type: response|WARC-Target-URI: ', '|', chr(13) || chr(10)) || coalesce(url, '') || replace('|WARC-Record-ID: <urn:page:', '|', chr(13) || chr(10)) || coalesce(page_id::VARCHAR, '')
          || replace('>|Content-Type: text/html|Content-Length: ', '|', chr(13) || chr(10)) || strlen(body) || repeat(chr(13) || chr(10), 2) || body || repeat(chr(13) || chr(10), 2) AS rec FROM u),
v AS (SELECT *, sha256(rec) AS sha, (('0x' || substr(key, 1, 7))::BIGINT % greatest(1, ceil((SELECT sum(strlen(rec)) FROM k WHERE side = 'a') / 67108864.0)::BIGINT))::INTEGER AS volume FROM k),
o AS (SELECT *, row_number() OVER w - 1 AS node, (sum(strlen(rec)) OVER w)::BIGINT AS e FROM v WINDOW w AS (PARTITION BY side, volume ORDER BY key, strlen(rec), sha ROWS UNBOUNDED PRECEDING)),
z AS (SELECT *, e - strlen(rec) AS s, sha256(sha || '|' || (e - strlen(rec)) || '|' || e) AS digest FROM o),
a AS (SELECT * FROM z WHERE side = 'a'), b AS (SELECT * FROM z WHERE side = 'b')
SELECT coalesce(a.volume, b.volume) AS volume, coalesce(a.node, b.node) AS node, coalesce(a.page_id, b.page_id) AS page_id, coalesce(a.s, b.s) AS start, coalesce(a.e, b.e) AS "end", a.digest AS digest_a, b.digest AS digest_b,
       CASE WHEN b.key IS NULL THEN 'missing' WHEN a.key IS NULL THEN 'extra' ELSE 'damaged' END AS state
FROM a FULL JOIN b ON a.key = b.key AND a.volume = b.volume WHERE a.sha IS DISTINCT FROM b.sha
""",
    "op3_block_naming_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""",
    "op6_line_quality": rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t),
win AS (SELECT rid, i, array_to_string(w[i:i+7], ' ') AS s FROM w, unnest(range(1, greatest(len(w) - 6, 1))) u(i)),
rep AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, s) > 1),
cov AS (SELECT rid, count(DISTINCT i + j) AS n_repeat_words FROM rep, range(8) r(j) GROUP BY rid),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM t),
c AS (SELECT rid, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
        length(line) - length(replace(line, '|', '')) AS bars, length(line) - length(replace(line, '!', '')) AS marks,
        length(line) - length(regexp_replace(line, '[#*$%&<>]', '', 'g')) AS symbols,
        length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars FROM l),
g AS (SELECT rid, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines,
        coalesce(sum(chars) FILTER (NOT (
            (bars >= 2 AND bars * 5 >= n) OR (symbols >= 3 AND symbols * 2 >= n) OR (marks >= 3 AND marks * 3 >= n)
            OR (n BETWEEN 1 AND 3 AND NOT regexp_matches(line, '[{_MARKS}][\x20\x09-\x0D]*$'))
            OR (n <= 12 AND n > 0 AND regexp_matches(lower(line), '{_PHRASES}')))), 0) AS clean_chars FROM c GROUP BY rid),
m AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, clean_chars::BIGINT AS clean_chars
      FROM t JOIN w USING (rid) JOIN g USING (rid) LEFT JOIN cov USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, clean_chars,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND clean_chars >= 0.5 * word_chars AS kept
FROM m
""",
    "op1_stratified_sharding": f"""
WITH {_CRC},
r AS (SELECT doc_id, (strlen(coalesce(text, '')) + 16)::BIGINT AS size, coalesce(crc, 0) AS text_crc32,
        CASE WHEN source IS NULL THEN '~' ELSE 's' || source END AS k
      FROM documents LEFT JOIN crcs USING (text)),
d AS (SELECT *, md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || text_crc32) AS d FROM r),
p AS (SELECT *, (row_number() OVER (PARTITION BY k ORDER BY d, doc_id, size, text_crc32) - 1
                 + {_UNIT.format("'17/' || k")}) / count(*) OVER (PARTITION BY k) AS place FROM d),
a AS (SELECT *, row_number() OVER (ORDER BY place, k, d, doc_id, size, text_crc32) - 1 AS i, count(*) OVER () AS n FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, (i * 40 // n)::INTEGER AS shard,
       i - ((i * 40 // n) * n + 39) // 40 AS slot, NULL::INTEGER AS grown_shard FROM a
""",
    "op5_systematic_mixing": rf"""
WITH {_CRC},
r AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, coalesce(crc, 0) AS crc,
        CASE WHEN source IS NULL THEN '~' ELSE 's' || source END AS k
      FROM documents LEFT JOIN crcs USING (text)),
d AS (SELECT *, md5('29:' || coalesce(doc_id::VARCHAR, '') || ':' || crc) AS d FROM r),
s AS (SELECT k, sum(size)::BIGINT AS source_size FROM r GROUP BY k),
w AS (SELECT k, source_size, 3 * source_size AS cap, ([5, 2, 1])[(row_number() OVER (ORDER BY k) - 1) % 3 + 1]::BIGINT AS w FROM s),
f AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS open
      FROM w WINDOW b AS (ORDER BY cap::DOUBLE / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, cap::DOUBLE / w <= rest::DOUBLE / open AS is_full FROM f),
o AS (SELECT rest, open FROM h WHERE NOT is_full ORDER BY cap::DOUBLE / w, k LIMIT 1),
t AS (SELECT k, source_size, CASE WHEN is_full OR o.open IS NULL THEN cap::DOUBLE ELSE (w * o.rest)::DOUBLE / o.open END AS target
      FROM h LEFT JOIN o ON true),
a AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY size, d, doc_id, crc) AS nth,
        CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, {_UNIT.format("'29/' || k")} AS u FROM d JOIN t USING (k))
SELECT doc_id, size, source_size, target,
       least(floor(nth * rate + u) - floor((nth - 1) * rate + u), 3)::BIGINT * size AS taken FROM a
""",
}
