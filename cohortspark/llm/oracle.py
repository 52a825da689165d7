"""DuckDB twins of the corpus queries that SQL can express."""

from __future__ import annotations

_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]+"

OP10 = f"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)"""

OP3 = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size,
         md5(concat_ws('|', '1', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(text, ''))) AS key FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT source, source_size * 2 / CAST(weight AS DOUBLE) AS ratio,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER earlier, 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0))::DOUBLE AS level
  FROM sources WINDOW earlier AS (ORDER BY source_size * 2 / CAST(weight AS DOUBLE), source IS NULL, encode(source)
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
planned AS (
  SELECT source, source_size, least(weight * (SELECT max(level) FROM levels WHERE level <= ratio), (2 * source_size)::DOUBLE) AS target
  FROM sources),
budgets AS (
  SELECT *, least(CAST(floor(target + 0.5) AS BIGINT), 2 * source_size) AS budget,
         CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS rounds, budget - rounds * source_size AS rest FROM planned),
units AS (SELECT source, key, sum(size) AS words, count(*) AS copies FROM sized WHERE size > 0 GROUP BY source, key),
placed AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
           FROM units),
cut AS (SELECT b.source, key AS cut_key, (rest - start) // copies AS cut_words
        FROM placed p JOIN budgets b ON p.source IS NOT DISTINCT FROM b.source WHERE start <= rest AND rest < start + words)
SELECT doc_id, size, source_size, target,
       CAST(rounds * size + CASE WHEN key < cut_key THEN size WHEN key = cut_key THEN cut_words ELSE 0 END AS BIGINT) AS taken
FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source LEFT JOIN cut c ON s.source IS NOT DISTINCT FROM c.source"""

OP2 = f"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, coalesce(text, '') AS text,
                     md5(coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || CASE WHEN text IS NULL THEN '0' ELSE '1' || text END) AS key FROM documents),
lines AS (SELECT d, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM docs),
counted AS (SELECT *, sum(len(regexp_extract_all(line, '{_WORD}'))) OVER (PARTITION BY d ORDER BY i) AS upto,
                   upto - len(regexp_extract_all(line, '{_WORD}')) AS before FROM lines),
spans AS (SELECT a.d, a.i AS first, min(b.i) AS last FROM counted a JOIN counted b ON a.d = b.d AND b.i >= a.i AND b.upto >= a.before + 50
          GROUP BY a.d, a.i
          UNION SELECT a.d, max(b.i), a.i FROM counted a JOIN counted b ON a.d = b.d AND b.i <= a.i AND a.upto >= b.before + 50
          GROUP BY a.d, a.i),
runs AS (SELECT s.d, doc_id, key, first, last, array_to_string(list_slice(string_split(text, chr(10)), first + 1, last + 1), chr(10)) AS content
         FROM spans s JOIN docs USING (d)),
later AS (SELECT d, first, last FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, key, d, first) AS n FROM runs) WHERE n > 1),
cut AS (SELECT DISTINCT d, i FROM later JOIN lines USING (d) WHERE i BETWEEN first AND last),
touching AS (SELECT d, first, last, max(last) OVER (PARTITION BY d ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM later),
numbered AS (SELECT d, first, last, sum(CASE WHEN coalesce(reached, -2) + 1 < first THEN 1 ELSE 0 END) OVER (PARTITION BY d ORDER BY first, last) AS run FROM touching),
merged AS (SELECT d, string_agg(a || '-' || b, ',' ORDER BY a) AS removed FROM (SELECT d, run, min(first) AS a, max(last) AS b FROM numbered GROUP BY d, run) GROUP BY d),
kept AS (SELECT d, string_agg(line, chr(10) ORDER BY i) AS text FROM lines LEFT JOIN cut USING (d, i) WHERE cut.d IS NULL GROUP BY d)
SELECT doc_id, coalesce(removed, '') AS removed, sha256(coalesce(kept.text, '')) AS text_sha256
FROM docs LEFT JOIN merged USING (d) LEFT JOIN kept USING (d)"""

OP6 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT)) AS vec FROM embeddings
           WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, q.vec, c.vec_id, list_sum(list_transform(list_zip(q.vec, c.vec), lambda p: p[1] * p[2])) AS score
           FROM (SELECT DISTINCT * FROM v WHERE vec_id % 100 = 0) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.vec) = len(c.vec)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, vec ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 10"""

OP9 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
escaped AS (SELECT *, regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g') AS r, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS t FROM turns),
joined AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
         coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '') AS loss,
         sum(length('<|im_start|>') + length(r) + length('<|im_sep|>') + length(t) + length('<|im_end|>')) AS formatted
  FROM escaped GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted AS BIGINT) AS formatted_chars FROM joined"""

def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit (fixed value: the reflected polynomial, 3988292384)."""
    step = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    octet = f"list_reduce(list_prepend(xor(crc, octet), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, k: {step})"
    octets = f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda crc, octet: {octet}), 4294967295)"


def _leaf(text: str) -> str:
    values = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


OP11 = f"""
WITH RECURSIVE
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY lang) AS n
           FROM (SELECT doc_id, lang, {_leaf('text')} AS leaf,
                        CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
                        END AS tampered FROM documents)),
nodes AS (
  SELECT lang, 0 AS level, rank, leaf AS digest, n FROM leaves
  UNION ALL
  SELECT lang, level + 1, rank // 8, sha256(string_agg(digest, '' ORDER BY rank)), (n + 7) // 8 FROM nodes WHERE n > 1
  GROUP BY lang, level, rank // 8, n),
subroots AS (SELECT *, row_number() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS place, count(*) OVER () AS trees
             FROM (SELECT lang, level AS height, digest AS subroot FROM nodes WHERE n = 1)),
tops AS (
  SELECT 0 AS level, place AS rank, subroot AS digest, trees AS n FROM subroots
  UNION ALL
  SELECT level + 1, rank // 8, sha256(string_agg(digest, '' ORDER BY rank)), (n + 7) // 8 FROM tops WHERE n > 1 GROUP BY level, rank // 8, n),
steps AS (   -- of every node but the roots: its siblings to the left and to the right
  SELECT a.lang, a.level, a.rank, coalesce(string_agg(b.digest, '' ORDER BY b.rank) FILTER (b.rank < a.rank), '') AS before,
         coalesce(string_agg(b.digest, '' ORDER BY b.rank) FILTER (b.rank > a.rank), '') AS after
  FROM nodes a JOIN nodes b ON a.lang IS NOT DISTINCT FROM b.lang AND a.level = b.level AND a.rank // 8 = b.rank // 8
  WHERE a.n > 1 GROUP BY a.lang, a.level, a.rank),
top_steps AS (
  SELECT a.level, a.rank, coalesce(string_agg(b.digest, '' ORDER BY b.rank) FILTER (b.rank < a.rank), '') AS before,
         coalesce(string_agg(b.digest, '' ORDER BY b.rank) FILTER (b.rank > a.rank), '') AS after
  FROM tops a JOIN tops b ON a.level = b.level AND a.rank // 8 = b.rank // 8 WHERE a.n > 1 GROUP BY a.level, a.rank),
path AS (
  SELECT l.lang, l.rank, level, before, after FROM leaves l JOIN steps s ON l.lang IS NOT DISTINCT FROM s.lang AND s.rank = l.rank >> (3 * level)
  UNION ALL
  SELECT l.lang, l.rank, height + t.level, before, after FROM leaves l JOIN subroots r ON l.lang IS NOT DISTINCT FROM r.lang
  JOIN top_steps t ON t.rank = place >> (3 * t.level)),
paths AS (SELECT lang, rank, list({{'before': before, 'after': after}} ORDER BY level) AS steps, string_agg(before || after, '' ORDER BY level) AS proof
          FROM path GROUP BY lang, rank),
folded AS (
  SELECT doc_id, l.lang, leaf, coalesce(proof, '') AS proof,
         coalesce(list_reduce(list_prepend({{'before': '', 'after': coalesce(tampered, leaf)}}, steps),
                              lambda d, s: {{'before': '', 'after': sha256(s.before || d.after || s.after)}}).after, coalesce(tampered, leaf)) AS folded_root
  FROM leaves l LEFT JOIN paths p ON l.lang IS NOT DISTINCT FROM p.lang AND l.rank = p.rank)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
FROM folded f JOIN subroots r ON f.lang IS NOT DISTINCT FROM r.lang, (SELECT digest AS root FROM tops WHERE n = 1)"""

_ROLE = "coalesce(role, ' ')"
_TEXT = "coalesce(text, ' ')"
# A step reads one row: inserts before it, then the edit. States: 0 nothing yet, 1 after s, 2 after u, 3 after a.
OP12 = f"""
WITH RECURSIVE
kinds AS (SELECT conv_id, turn, {_ROLE} AS role, {_TEXT} AS text,
                 {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations),
damaged AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds),
placed AS (SELECT *, row_number() OVER w AS i, lag(role[1]) OVER w AS last_initial,
                  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS copies,
                  rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))[-1] AS last
           FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
marked AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN copies > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'sound' END AS fault
           FROM placed),
inserts AS (SELECT * FROM (VALUES (0, 0, '', 0), (1, 1, '', 0), (2, 2, '', 0), (3, 3, '', 0), (0, 2, 'I', 3), (1, 2, 'I', 3), (2, 3, 'I', 3), (3, 2, 'I', 3),
                                  (0, 3, 'II', 6), (1, 3, 'II', 6)) t(state, target, edits, cost)),
kept AS (SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) t(state, initial, target)),
moves AS (SELECT conv_id, i, state, t.state AS target, 'D' AS edit, 4 AS cost FROM marked, (VALUES (0), (1), (2), (3)) t(state)
          UNION ALL SELECT conv_id, i, state, target, 'K', CASE fault WHEN 'truncated' THEN 3 ELSE 0 END FROM marked JOIN kept ON role[1] = initial
          WHERE fault IN ('sound', 'truncated')
          UNION ALL SELECT conv_id, i, t.state, t.target, 'R', CASE fault WHEN 'truncated' THEN 6 ELSE 3 END
          FROM marked, (VALUES (0, 2), (1, 2), (2, 3), (3, 2)) t(state, target) WHERE fault IN ('sound', 'truncated')),
search AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS state, {{'cost': 0, 'audit': ''}} AS best FROM marked
  UNION ALL
  SELECT s.conv_id, s.i + 1, m.target, min({{'cost': best.cost + n.cost + m.cost, 'audit': best.audit || n.edits || m.edit}})
  FROM search s JOIN inserts n ON s.state = n.state
  JOIN moves m ON m.conv_id IS NOT DISTINCT FROM s.conv_id AND m.i = s.i + 1 AND m.state = n.target
  GROUP BY s.conv_id, s.i, m.target),
ended AS (SELECT s.conv_id, min({{'cost': best.cost + n.cost, 'audit': best.audit || n.edits}}) AS best
          FROM search s JOIN inserts n ON s.state = n.state
          JOIN (SELECT conv_id, max(i) AS i FROM marked GROUP BY conv_id) l ON l.conv_id IS NOT DISTINCT FROM s.conv_id AND l.i = s.i
          WHERE n.target IN (0, 3) GROUP BY s.conv_id),
edits AS (SELECT conv_id, unnest(string_split(best.audit, '')) AS edit, generate_subscripts(string_split(best.audit, ''), 1) AS k FROM ended),
read AS (SELECT *, CASE edit WHEN 'I' THEN NULL ELSE sum(CASE edit WHEN 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY k) END AS i,
                sum(CASE edit WHEN 'D' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY k) AS place FROM edits),
rows AS (SELECT r.conv_id, k, edit, place, role, text FROM read r LEFT JOIN marked m ON r.conv_id IS NOT DISTINCT FROM m.conv_id AND r.i = m.i
         WHERE edit <> 'D'),
parity AS (SELECT *, max(CASE WHEN edit = 'K' AND role[1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS led FROM rows),
repaired AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END
                                               || ':' || coalesce(text, ''), chr(10) ORDER BY k)) AS repaired_sha256 FROM parity GROUP BY conv_id),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                   count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                   count(*) FILTER (i > 1 AND last_initial || role[1] NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(CAST(e.best.cost AS BIGINT), 0) AS cost, coalesce(e.best.audit, '') AS audit,
       coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counted d ON c.conv_id IS NOT DISTINCT FROM d.conv_id
LEFT JOIN ended e ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN repaired r ON c.conv_id IS NOT DISTINCT FROM r.conv_id"""

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
_TRACKED = r"^(utm_[^=]*|ref|fbclid|gclid)(=|\z)"
OP13 = f"""
WITH parts AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '{_URL}', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '{_URL}', 2), '') AS path,
         list_sort(list_filter(string_split(coalesce(regexp_extract(url, '{_URL}', 3), ''), '&'),
                               lambda p: p <> '' AND NOT regexp_matches(p, '{_TRACKED}'))) AS named FROM pages),
canonical AS (
  SELECT *, CASE WHEN instr(url, '://') > 0 THEN
           regexp_replace(regexp_replace(host, '^www\\.', ''), ':(80|443)?\\z', '') || regexp_replace(path, '/+\\z', '')
           || CASE WHEN len(named) > 0 THEN '?' || array_to_string(named, '&') ELSE '' END END AS canonical FROM parts),
listed AS (SELECT DISTINCT canonical FROM canonical WHERE list_has_any(string_split(host, '.'),
             ['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm'])),
rules AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'),
                                ('net', '/fr/', 'block')) r(on_host, on_path, says)),
judged AS (SELECT c.*, l.canonical IS NOT NULL AS listed,
                  (SELECT max({{'size': length(on_host || on_path), 'rule': on_host || on_path, 'says': says}}) FROM rules
                   WHERE (host = on_host OR ends_with(host, '.' || on_host)) AND starts_with(path, on_path)) AS best
           FROM canonical c LEFT JOIN listed l ON c.canonical = l.canonical)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.says, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM judged"""

ORACLES = {"op2_line_dedup": OP2, "op3_mixing": OP3, "op6_topk": OP6, "op9_chat": OP9, "op10_exact_dedup": OP10, "op11_merkle": OP11,
           "op12_repair": OP12, "op13_urls": OP13}
