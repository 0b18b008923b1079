"""DuckDB SQL for the numbered operators that SQL can express."""


def _crcs(ids: str) -> str:
    """Common table expressions that end in crc (id, crc): crc32 of the decimal text of ids (id), bit by bit."""
    byte = "CASE WHEN i % 8 = 0 THEN xor(c, ascii(substr(id::VARCHAR, i // 8 + 1, 1))::BIGINT) ELSE c END"
    return f"""crc_ids AS ({ids}), crc_bits AS (
  SELECT id, 0 AS i, 4294967295::BIGINT AS c FROM crc_ids
  UNION ALL SELECT id, i + 1, xor(({byte}) >> 1, CASE WHEN ({byte}) & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END) FROM crc_bits WHERE i < 8 * length(id::VARCHAR)
), crc AS (SELECT id, xor(c, 4294967295::BIGINT) AS crc FROM crc_bits WHERE i = 8 * length(id::VARCHAR))"""


def _field(column: str, value: str | None = None) -> str:
    value = f"({value or column})::VARCHAR"
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE octet_length(encode({value}))::VARCHAR || ':' || {value} END"


ORACLES = {
    "op8_mix": r"""
WITH sized AS (
  SELECT doc_id, text, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS ix FROM sized GROUP BY source
), lim AS (
  SELECT *, CASE ix WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap FROM per
), steps AS (
  SELECT *, cap / w AS full_at,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS lvl,
    row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS turn
  FROM lim WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (SELECT arg_min(lvl, turn) AS l FROM steps WHERE full_at > lvl
), rated AS (
  SELECT source, source_size, least(cap, CASE WHEN l IS NULL OR full_at <= l THEN cap ELSE l * w END) AS target FROM steps, level
), drawn AS (
  SELECT s.doc_id, s.size, r.source_size, r.target, CASE WHEN r.source_size > 0 THEN r.target / r.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM drawn
""",
    "op7_top_products": r"""
WITH usable AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op11_prefix_trie": "WITH RECURSIVE " + _crcs("SELECT DISTINCT conv_id AS id FROM conversations WHERE conv_id IS NOT NULL") + r""", own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place FROM conversations WHERE conv_id IS NOT NULL
), heads AS (
  SELECT *, conv_id - (conv_id % 5 + 5) % 5 AS base, crc % 9 AS h FROM (SELECT id AS conv_id, crc FROM crc)
), parts AS (
  SELECT h.conv_id, 0 AS part, o.place, o.role, o.text FROM heads h JOIN own o ON o.conv_id = h.base AND o.place <= h.h
  UNION ALL SELECT h.conv_id, 1, o.place, o.role, o.text FROM heads h JOIN own o ON o.conv_id = h.conv_id AND o.place > h.h
), told AS (
  SELECT conv_id, row_number() OVER w AS depth, octet_length(encode(text))::BIGINT AS size,
    string_agg(sha256(octet_length(encode(role))::VARCHAR || ':' || role || text), '' ORDER BY part, place) OVER w AS path FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY part, place)
), members AS (
  SELECT conv_id, depth, size, sha256(path) AS node, coalesce(sha256(lag(path) OVER (PARTITION BY conv_id ORDER BY depth)), 'root') AS above, depth = count(*) OVER (PARTITION BY conv_id) AS ends FROM told
  UNION ALL SELECT conv_id, 0, 0, 'root', NULL, NOT EXISTS (SELECT 1 FROM told t WHERE t.conv_id = h.conv_id) FROM heads h
), nodes AS (
  SELECT node, min(conv_id) AS conv_id, min(depth) AS depth, min(above) AS above, count(*)::BIGINT AS n_convs, (count(*) - 1) * min(size) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM members GROUP BY node
), below AS (SELECT above AS node, count(*)::BIGINT AS n_children FROM nodes WHERE above IS NOT NULL GROUP BY ALL
), sums AS (
  SELECT m.node, sum(n.saved)::BIGINT AS saved_tokens, count(*) FILTER (WHERE b.node IS NULL)::BIGINT AS n_leaves
  FROM members m JOIN nodes n ON n.conv_id = m.conv_id AND n.depth >= m.depth LEFT JOIN below b ON b.node = n.node GROUP BY ALL
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(b.n_children, 0)::BIGINT AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.node = n.node LEFT JOIN nodes p ON p.node = n.above LEFT JOIN below b ON b.node = n.node
""",
    "op12_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '\\|<s>|</s>|\[/?(?:INST|SYS|ROLE)\]|\[TEXT\]')) AS body, length(role) + len(regexp_extract_all(role, '\\|<s>|</s>|\[/?(?:INST|SYS|ROLE)\]|\[TEXT\]')) AS head FROM turns
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(body + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 4 ELSE 19 + head END))::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
""",
    "op13_merkle_manifest": "WITH RECURSIVE " + _crcs("SELECT DISTINCT doc_id AS id FROM documents WHERE doc_id IS NOT NULL") + f""", leaves AS (
  SELECT *, row_number() OVER () AS doc, sha256({" || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", "text")))}) AS leaf,
    CASE WHEN crc % 7 = 0 THEN sha256({" || ".join((*map(_field, ("doc_id", "source", "lang")), _field("n_chars", "n_chars + 1"), _field("text")))}) END AS changed
  FROM documents LEFT JOIN crc ON id = doc_id
), nodes AS (
  SELECT lang, 0 AS level, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n, leaf AS digest, doc FROM leaves
  UNION ALL SELECT lang, level + 1, place // 2, min(n + 1) // 2, sha256(string_agg(digest, '' ORDER BY place)), NULL FROM nodes WHERE n > 1 GROUP BY lang, level, place // 2
), roots AS (SELECT lang, digest FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n, digest, lang FROM roots
  UNION ALL SELECT level + 1, place // 2, min(n + 1) // 2, sha256(string_agg(digest, '' ORDER BY place)), NULL FROM tops WHERE n > 1 GROUP BY level, place // 2
), steps AS (
  SELECT a.doc, s.level AS level, CASE WHEN o.digest IS NULL THEN '-' WHEN o.place < s.place THEN 'l' ELSE 'r' END AS side, coalesce(o.digest, '') AS other
  FROM nodes a JOIN nodes s ON s.lang IS NOT DISTINCT FROM a.lang AND s.place = a.place >> s.level AND s.n > 1 LEFT JOIN nodes o ON o.lang IS NOT DISTINCT FROM s.lang AND o.level = s.level AND o.place = xor(s.place, 1) WHERE a.level = 0
  UNION ALL SELECT a.doc, 1000 + s.level, CASE WHEN o.digest IS NULL THEN '-' WHEN o.place < s.place THEN 'l' ELSE 'r' END, coalesce(o.digest, '')
  FROM nodes a JOIN tops r ON r.level = 0 AND r.lang IS NOT DISTINCT FROM a.lang JOIN tops s ON s.place = r.place >> s.level AND s.n > 1 LEFT JOIN tops o ON o.level = s.level AND o.place = xor(s.place, 1) WHERE a.level = 0
), numbered AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY level) AS turn FROM steps
), fold AS (
  SELECT doc, 1 AS turn, changed AS digest FROM leaves WHERE changed IS NOT NULL
  UNION ALL SELECT f.doc, f.turn + 1, sha256(CASE s.side WHEN '-' THEN f.digest WHEN 'l' THEN s.other || f.digest ELSE f.digest || s.other END) FROM fold f JOIN numbered s ON s.doc = f.doc AND s.turn = f.turn
), folded AS (SELECT doc, arg_max(digest, turn) AS digest FROM fold GROUP BY doc
), proofs AS (SELECT doc, sha256(string_agg(other, '' ORDER BY level)) AS proof FROM steps GROUP BY doc)
SELECT l.doc_id, l.leaf, r.digest AS subroot, t.digest AS root, coalesce(p.proof, sha256('')) AS proof_sha256, coalesce(f.digest, t.digest) AS folded_root, coalesce(f.digest, t.digest) = t.digest AS verified
FROM leaves l JOIN roots r ON r.lang IS NOT DISTINCT FROM l.lang JOIN tops t ON t.n = 1 LEFT JOIN proofs p ON p.doc = l.doc LEFT JOIN folded f ON f.doc = l.doc
""",
}
