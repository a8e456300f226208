"""SQL of the quality rules and of the manifest."""

from __future__ import annotations

from . import quality
from .quality import Rules

_RULES = Rules(languages=256)

# --- quality rules: base rules, references summed over all documents that pass them, Jensen-Shannon distances

_WORD = r"[^ \t-\r]+"
_PATTERNS = [r"[^\p{Ll}]", r"[^\p{Lu}\p{Lt}]", r"[^\p{Lm}\p{Lo}\p{M}]", r"[^\p{N}]", r"[^\p{P}]", r"[^\p{S}]", r"[^ \t-\r]"]
_COUNTS = ", ".join(f"length(regexp_replace(text, '{p}', '', 'g'))" for p in _PATTERNS)
_EDGES = quality.EDGES.replace("'", "''")


def _half(p: str, m: str) -> str:
    return f"CASE WHEN {p} > 0 THEN {p} * log2({p} / {m}) ELSE 0 END"


def _distance(doc: str, ref: str) -> str:
    m = f"(({doc} + {ref}) / 2)"
    return f"sqrt(greatest(0, sum({_half(doc, m)} + {_half(ref, m)}) / 2))"


QUALITY_SQL = f"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
words AS (SELECT doc_id, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t),
grams AS (
  SELECT doc_id, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, w2, w3) AS c FROM grams WHERE w3 IS NOT NULL),
repeats AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM twice, (VALUES (0), (1), (2)) AS x(d) WHERE c > 1 GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t)
  WHERE regexp_matches(line, '{_WORD}') GROUP BY doc_id),
counted AS (SELECT doc_id, [{_COUNTS}] AS seven, length(text) AS points FROM t),
classes AS (SELECT doc_id, list_append(seven, points - list_sum(seven)) AS n, points - seven[7] AS word_chars FROM counted),
base AS (
  SELECT t.doc_id, t.lang, len(ws)::BIGINT AS n_words, word_chars::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines,
         coalesce(repeats.n, 0)::BIGINT AS n_repeat_words,
         len(ws) < {_RULES.least_words} OR 100 * coalesce(repeats.n, 0) > 50 * len(ws) AS base_failed, classes.n AS classes
  FROM t JOIN classes USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)),
tidy AS (
  SELECT doc_id, words.lang, trim(translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_EDGES}') AS w
  FROM words JOIN base USING (doc_id) WHERE NOT base_failed),
counts AS (SELECT lang, w, count(*) AS n FROM tidy WHERE w <> '' GROUP BY lang, w),
totals AS (
  SELECT lang, sum(n) AS total FROM counts GROUP BY lang
  QUALIFY sum(n) >= {_RULES.reference_words} AND sum(n) * {_RULES.languages} >= sum(sum(n)) OVER ()),
ranked AS (
  SELECT counts.*, total, row_number() OVER (PARTITION BY counts.lang ORDER BY n DESC, encode(w)) AS r
  FROM counts JOIN totals ON counts.lang IS NOT DISTINCT FROM totals.lang),
common AS (SELECT * FROM ranked WHERE r <= {_RULES.common}),
bins AS (  -- the common words and bin 0, all others
  SELECT lang, r, n / total AS ref FROM common
  UNION ALL SELECT lang, 0, (any_value(total) - sum(n)) / any_value(total) FROM common GROUP BY lang),
held AS (
  SELECT doc_id, coalesce(common.r, 0) AS r, count(*) AS n
  FROM tidy LEFT JOIN common ON tidy.w = common.w AND tidy.lang IS NOT DISTINCT FROM common.lang WHERE tidy.w <> '' GROUP BY ALL),
shares AS (
  SELECT b.doc_id, bins.ref, coalesce(held.n, 0) / sum(held.n) OVER (PARTITION BY b.doc_id) AS p
  FROM base AS b JOIN bins ON b.lang IS NOT DISTINCT FROM bins.lang AND NOT base_failed
  LEFT JOIN held ON held.doc_id = b.doc_id AND held.r = bins.r),
by_word AS (SELECT doc_id, coalesce({_distance('p', 'ref')}, 1) AS d FROM shares GROUP BY doc_id),
spread AS (SELECT doc_id, lang, unnest(classes) AS n, generate_subscripts(classes, 1) AS c FROM base WHERE NOT base_failed),
mean AS (SELECT lang, c, sum(n) AS n FROM spread GROUP BY lang, c),
mean_share AS (SELECT lang, c, n / sum(n) OVER (PARTITION BY lang) AS ref FROM mean),
char_share AS (
  SELECT s.doc_id, n / sum(n) OVER (PARTITION BY s.doc_id) AS p, ref
  FROM spread AS s JOIN mean_share AS m ON s.lang IS NOT DISTINCT FROM m.lang AND s.c = m.c),
by_char AS (SELECT doc_id, {_distance('p', 'ref')} AS d FROM char_share GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (by_word.d IS NULL OR (
         by_word.d <= {_RULES.word_limit} + {_RULES.word_guard} / sqrt(n_words)
         AND by_char.d <= {_RULES.char_limit} + {_RULES.char_guard} / sqrt(n_words))) AS kept
FROM base LEFT JOIN by_word USING (doc_id) LEFT JOIN by_char USING (doc_id)"""

# --- manifest: trees level by level; CRC-32 by the table of its 256 byte steps


def _field(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def _leaf(n_chars: str) -> str:
    parts = ["CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST({n_chars} AS VARCHAR)", "text"]
    return "sha256(" + " || ".join(map(_field, parts)) + ")"


MANIFEST_SQL = f"""
WITH RECURSIVE bits AS (
  SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) AS r(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
leaves AS (
  SELECT doc_id, lang, {_leaf('n_chars')} AS leaf,
         CASE WHEN xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
                lambda x: ord(x)::BIGINT)), lambda c, b: xor(c // 256, t[(xor(c, b) & 255) + 1]))) % 7 = 0
              THEN {_leaf('(n_chars + 1)')} ELSE {_leaf('n_chars')} END AS shown
  FROM documents, crc_table),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS size
  FROM leaves),
nodes AS (
  SELECT lang, 0 AS level, pos, leaf AS h, size FROM placed
  UNION ALL
  SELECT lang, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (size + 1) // 2 FROM nodes WHERE size > 1
  GROUP BY lang, level, pos // 2, size),
subroots AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos, count(*) OVER () AS size FROM nodes WHERE size = 1),
tops AS (
  SELECT 0 AS level, pos, subroot AS h, size FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (size + 1) // 2 FROM tops WHERE size > 1
  GROUP BY level, pos // 2, size),
up AS (  -- each leaf on its way to the subroot: digests met, and the hash folded from what is shown
  SELECT doc_id, lang, leaf, shown AS folded, '' AS proof, 0 AS level, pos, size FROM placed
  UNION ALL
  SELECT up.doc_id, up.lang, leaf, sha256(CASE WHEN up.pos % 2 = 1 THEN coalesce(n.h, '') || folded ELSE folded || coalesce(n.h, '') END),
         proof || coalesce(n.h, ''), up.level + 1, up.pos // 2, (up.size + 1) // 2
  FROM up LEFT JOIN nodes AS n ON n.lang IS NOT DISTINCT FROM up.lang AND n.level = up.level AND n.pos = xor(up.pos, 1) WHERE up.size > 1),
last AS (
  SELECT up.doc_id, leaf, subroot, folded, proof, 0 AS level, s.pos, s.size
  FROM up JOIN subroots AS s ON s.lang IS NOT DISTINCT FROM up.lang WHERE up.size = 1
  UNION ALL
  SELECT last.doc_id, leaf, subroot, sha256(CASE WHEN last.pos % 2 = 1 THEN coalesce(n.h, '') || folded ELSE folded || coalesce(n.h, '') END),
         proof || coalesce(n.h, ''), last.level + 1, last.pos // 2, (last.size + 1) // 2
  FROM last LEFT JOIN tops AS n ON n.level = last.level AND n.pos = xor(last.pos, 1) WHERE last.size > 1)
SELECT doc_id, leaf, subroot, (SELECT h FROM tops WHERE size = 1) AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
       folded = (SELECT h FROM tops WHERE size = 1) AS verified
FROM last WHERE size = 1"""
