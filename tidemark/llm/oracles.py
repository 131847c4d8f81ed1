"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT row_number() OVER () AS irow, item_id, {_WORDS} AS w FROM benchmark),
each AS (SELECT irow, item_id, least(len(w), 10) AS n, p AS q, array_to_string(list_slice(w, p, p + least(len(w), 10) - 1), ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
windows AS (SELECT DISTINCT item_id, n, g FROM each),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (SELECT rid, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS g FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lengths WHERE len(w) >= n)),
found AS (SELECT rid, p, n, item_id FROM places JOIN windows USING (n, g)),
hit AS (SELECT rid, count(DISTINCT word_at) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS word_at FROM found) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS id FROM found WHERE item_id IS NOT NULL) GROUP BY rid),
long AS (SELECT rid, n + count(*) - 1 AS length, min(p) - 1 AS p, item_id, min(q) - 1 AS q FROM (SELECT rid, p, n, irow, item_id, q, p - row_number() OVER (PARTITION BY rid, irow, p - q ORDER BY p) AS island FROM places JOIN each USING (n, g)) GROUP BY rid, irow, item_id, p - q, n, island),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY length DESC, p, item_id NULLS LAST, q) AS k FROM long) WHERE k = 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(length, 0)::BIGINT AS longest_length, best.p::BIGINT AS longest_doc_pos, best.item_id AS longest_item_id, best.q::BIGINT AS longest_item_pos
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid) LEFT JOIN best USING (rid)
"""

OP9 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
starts AS (SELECT rid, p, count(*) OVER (PARTITION BY g) AS c FROM (SELECT rid, p, array_to_string(list_slice(w, p, p + 34), ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35))),
covered AS (SELECT rid, p, word, coalesce(max(coalesce(c, 1)) OVER (PARTITION BY rid ORDER BY p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 1) > 1 AS gone FROM words LEFT JOIN starts USING (rid, p)),
kept AS (SELECT rid, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM covered GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""

OP10 = """
WITH p AS (SELECT row_number() OVER () AS rid, page_id, coalesce(html, '') AS html FROM pages),
r AS (SELECT rid, page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest, row_number() OVER (PARTITION BY sha1(html) ORDER BY page_id DESC NULLS LAST, rid) AS n, first_value(page_id) OVER (PARTITION BY sha1(html) ORDER BY page_id DESC NULLS LAST, rid) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND n > 1 THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 1000 AND n > 1 THEN top END AS refers_to FROM r
"""


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR END"


_HEAD = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
_CUT = _field("replace(text, chr(10), '')")

#: crc is the bitwise CRC-32 without its last inversion, so that an even one there is odd.
OP12 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, source, sha256({_HEAD} || {_field('text')}) AS leaf, sha256({_HEAD} || {_CUT}) AS cut FROM documents),
crc AS (SELECT rid, coalesce((list_reduce([4294967295::UBIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT), lambda c, b: list_reduce([xor(c, b)] || list_transform(range(8), lambda i: 0::UBIGINT), lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END)) % 2) = 0, true) AS spared FROM d),
placed AS (SELECT d.*, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS part, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n, CASE WHEN spared THEN leaf ELSE cut END AS changed FROM d LEFT JOIN crc USING (rid)),
below(part, level, pos, n, node) AS (
  SELECT part, 0, pos, n, leaf FROM placed
  UNION ALL SELECT part, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM below WHERE n > 1 GROUP BY part, level, n, pos // 3),
subroots AS (SELECT part, node, count(*) OVER () AS n FROM below WHERE n = 1),
above(level, pos, n, node) AS (
  SELECT 0, part, n, node FROM subroots
  UNION ALL SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM above WHERE n > 1 GROUP BY level, n, pos // 3),
root AS (SELECT node AS root FROM above WHERE n = 1),
nodes AS (SELECT part, level, pos, n, node FROM below WHERE n > 1 UNION ALL SELECT -1, 1000 + level, pos, n, node FROM above WHERE n > 1),
spots AS (SELECT rid, p.part, level, p.pos // (3 ** level)::BIGINT AS pos FROM placed p JOIN (SELECT DISTINCT part, level FROM nodes WHERE part >= 0) USING (part)
  UNION ALL SELECT rid, -1, level, p.part // (3 ** (level - 1000))::BIGINT FROM placed p JOIN (SELECT DISTINCT level FROM nodes WHERE part < 0) ON true),
sides AS (SELECT rid, spots.level, coalesce(string_agg(node, '' ORDER BY nodes.pos) FILTER (nodes.pos < spots.pos), '') AS lft, coalesce(string_agg(node, '' ORDER BY nodes.pos) FILTER (nodes.pos > spots.pos), '') AS rgt, row_number() OVER (PARTITION BY rid ORDER BY spots.level) AS step
  FROM spots JOIN nodes ON nodes.part = spots.part AND nodes.level = spots.level AND nodes.pos // 3 = spots.pos // 3 GROUP BY rid, spots.level),
proofs AS (SELECT rid, sha256(string_agg(lft || rgt, '' ORDER BY step)) AS proof_sha256 FROM sides GROUP BY rid),
fold(rid, step, node) AS (
  SELECT rid, 0, changed FROM placed
  UNION ALL SELECT rid, fold.step + 1, sha256(lft || node || rgt) FROM fold JOIN sides USING (rid) WHERE sides.step = fold.step + 1),
folded AS (SELECT rid, arg_max(node, step) AS folded_root FROM fold GROUP BY rid)
SELECT doc_id, leaf, subroots.node AS subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed JOIN subroots USING (part) CROSS JOIN root LEFT JOIN proofs USING (rid) JOIN folded USING (rid)
"""

OP13 = """
WITH r AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.rid AS arid, a.vec_id AS anchor_id, b.rid, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.rid <> b.rid),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY arid ORDER BY score DESC, vec_id NULLS LAST, rid) AS place FROM pairs WHERE same) WHERE place <= 5),
hard AS (SELECT near.arid, near.anchor_id, near.vec_id AS positive_id, near.score AS positive_score, p.vec_id AS negative_id, p.score AS negative_score, row_number() OVER (PARTITION BY near.arid, near.rid ORDER BY p.score DESC, p.vec_id NULLS LAST, p.rid) AS rank
  FROM near JOIN pairs p ON p.arid = near.arid AND NOT p.same AND 30 * near.score <= 100 * p.score AND 100 * p.score <= 90 * near.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM hard WHERE rank <= 10
"""

ORACLES = {"op4_decontamination": OP4, "op9_substring_dedup": OP9, "op10_warc": OP10, "op12_merkle_manifest": OP12, "op13_hard_negatives": OP13}
