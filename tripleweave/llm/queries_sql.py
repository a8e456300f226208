"""SQL that says the same as queries of this package."""

from __future__ import annotations

from . import licenses, mixing

#: Shares of all tokens, by category; those that are not named are "other".
TARGETS = {
    "source": {"src0": 0.2, "other": 0.8},
    "lang": {"en": 0.55, "de": 0.15, "es": 0.15, "fr": 0.15},
    "topic": {"general": 0.8, "legal": 0.05, "contact": 0.1, "list": 0.05},
}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _category(column: str, name: str) -> str:
    known = ", ".join(_text(k) for k in TARGETS[name] if k != mixing.OTHER)
    return f"CASE WHEN {column} IN ({known}) THEN {column} ELSE 'other' END"


def _want(name: str) -> str:
    cases = " ".join(f"WHEN {_text(k)} THEN {v}" for k, v in TARGETS[name].items())
    return f"CAST(CASE {name} {cases} ELSE 0 END AS DOUBLE)"


def _margin(name: str, share: str) -> str:
    """Wanted share of a category: ``other`` without a target keeps its natural one, and the named share the rest."""
    named = f"(SELECT sum(x) FROM (SELECT DISTINCT {name}, {share} AS x FROM counted))"
    if mixing.OTHER in TARGETS[name]:
        return f"CASE WHEN {named} > 0 THEN {share} / {named} ELSE 0 END"
    natural = f"(SELECT coalesce(sum(tokens) FILTER ({name} = 'other'), 0) / CAST(sum(tokens) AS DOUBLE) FROM counted)"
    return (f"CASE WHEN {name} = 'other' THEN CASE WHEN {named} > 0 THEN {natural} ELSE 1 END "
            f"WHEN {named} > 0 THEN {share} * (1 - {natural}) / {named} ELSE 0 END")


def _step(name: str, weight: str) -> str:
    return f"CASE WHEN sum({weight}) OVER (PARTITION BY {name}) > 0 THEN {weight} * want_{name} / sum({weight}) OVER (PARTITION BY {name}) ELSE 0 END"


_TOPIC = "CASE " + " ".join(f"WHEN regexp_matches(text, {_text(p)}) THEN {_text(n)}" for n, p in mixing.TOPICS) + " ELSE 'general' END"

MIXING_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(text, '') AS text, source, lang FROM documents),
marked AS (
  SELECT doc_id, {_category('source', 'source')} AS source, {_category('lang', 'lang')} AS lang,
         {_category('(' + _TOPIC + ')', 'topic')} AS topic,
         CAST(len(regexp_extract_all(text, '[^ \\t-\\r]+')) AS BIGINT) AS n_tokens,
         CAST(CAST('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), md5(text)) || ':17')[1:8] AS BIGINT) AS DOUBLE) / 4294967296.0 AS turn
  FROM docs),
counted AS (
  SELECT source, lang, topic, sum(n_tokens) AS tokens, {_want('source')} AS s0, {_want('lang')} AS l0, {_want('topic')} AS t0
  FROM marked GROUP BY ALL HAVING sum(n_tokens) > 0),
base AS (
  SELECT source, lang, topic, tokens, {_margin('source', 's0')} AS want_source, {_margin('lang', 'l0')} AS want_lang,
         {_margin('topic', 't0')} AS want_topic
  FROM counted),
raked AS (
  SELECT *, CAST(tokens AS DOUBLE) / sum(tokens) OVER () AS weight, 0 AS i FROM base
  UNION ALL
  SELECT source, lang, topic, tokens, want_source, want_lang, want_topic, {_step('topic', 'w2')}, i + 1
  FROM (SELECT *, {_step('lang', 'w1')} AS w2 FROM (SELECT *, {_step('source', 'weight')} AS w1 FROM raked WHERE i < 200))),
cells AS (
  SELECT source, lang, topic, tokens, weight / sum(weight) OVER () * sum(tokens) OVER () / tokens AS ratio,
         sum(tokens) OVER () AS every FROM raked WHERE i = 200),
ordered AS (
  SELECT *, coalesce(sum(tokens) OVER (ORDER BY ratio DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sure,
         sum(tokens * ratio) OVER (ORDER BY ratio DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM cells),
scaled AS (SELECT *, CASE WHEN rest > 0 THEN (every * 0.8 - sure) / rest END AS scale FROM ordered),
final AS (
  SELECT source, lang, topic, ratio, CASE WHEN ratio <= 0 THEN 0.0 ELSE
         least(1.0, coalesce(max(CASE WHEN scale * ratio <= 1 THEN scale END) OVER (), CAST('inf' AS DOUBLE)) * ratio) END AS probability
  FROM scaled)
SELECT doc_id, marked.source, marked.lang, marked.topic, n_tokens,
       CASE WHEN n_tokens > 0 THEN ratio ELSE 0 END AS weight, CASE WHEN n_tokens > 0 THEN probability ELSE 1 END AS probability,
       CASE WHEN n_tokens > 0 THEN turn < probability ELSE true END AS selected
FROM marked LEFT JOIN final USING (source, lang, topic)"""

_ROWS, _IDF, _RARE = licenses.template_weights()

LICENSES_SQL = f"""
WITH weights(template, license, term, weight) AS (VALUES {', '.join(f'({i}, {_text(n)}, {_text(t)}, {w!r}::DOUBLE)' for i, n, t, w in _ROWS)}),
known(term, idf) AS (VALUES {', '.join(f'({_text(t)}, {w!r}::DOUBLE)' for t, w in _IDF.items())}),
files AS (
  SELECT doc_id, coalesce(text, '') AS text, concat_ws('/', source, lang, CAST(CAST(floor(doc_id / 100) AS BIGINT) AS VARCHAR)) AS folder,
         concat_ws('/', source, lang, CAST(CAST(floor(doc_id / 100) AS BIGINT) AS VARCHAR), CAST(doc_id AS VARCHAR)) AS path
  FROM documents),
notices AS (
  SELECT DISTINCT doc_id, notice FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS notice FROM files)
  WHERE regexp_matches(notice, {_text(licenses.CUE)})),
terms AS (
  SELECT notice, term, count(*) AS n FROM (
    SELECT notice, unnest(regexp_extract_all(lower(notice), '{licenses.TERM}')) AS term FROM (SELECT DISTINCT notice FROM notices)) GROUP BY ALL),
weighed AS (SELECT notice, terms.term, n * coalesce(idf, {_RARE!r}::DOUBLE) AS w FROM terms LEFT JOIN known ON terms.term = known.term),
norms AS (SELECT notice, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY notice),
dots AS (SELECT notice, template, license, sum(w * weight) AS dot FROM weighed JOIN weights USING (term) GROUP BY ALL),
own AS (
  SELECT doc_id, license, score FROM (
    SELECT doc_id, license, round(dot / norm, 6) AS score,
           row_number() OVER (PARTITION BY doc_id ORDER BY round(dot / norm, 6) DESC, license) AS k
    FROM notices JOIN dots USING (notice) JOIN norms USING (notice) WHERE round(dot / norm, 6) >= 0.8) WHERE k = 1),
marked AS (
  SELECT doc_id, path, folder, license, score, len(regexp_extract_all(text, '[^ \\t-\\r]+')) <= 25 AS slim
  FROM files LEFT JOIN own USING (doc_id)),
holders AS (
  SELECT folder, path, license, score FROM (
    SELECT *, row_number() OVER (PARTITION BY folder ORDER BY path, doc_id) AS k FROM marked
    WHERE license IS NOT NULL AND slim) WHERE k = 1),
above AS (
  SELECT DISTINCT folder, unnest([folder, regexp_replace(folder, '/[^/]*$', ''), regexp_replace(folder, '/[^/]*/[^/]*$', ''), '']) AS holder_folder,
         unnest([0, 1, 2, 3]) AS up FROM marked WHERE license IS NULL),
nearest AS (
  SELECT folder, license AS from_license, score AS from_score, path AS from_path FROM (
    SELECT above.folder, holders.license, holders.score, holders.path, row_number() OVER (PARTITION BY above.folder ORDER BY up) AS k
    FROM above JOIN holders ON above.holder_folder = holders.folder) WHERE k = 1)
SELECT doc_id, path, coalesce(license, from_license) AS license, CASE WHEN license IS NOT NULL THEN score ELSE from_score END AS score,
       CASE WHEN license IS NOT NULL THEN 'own' WHEN from_license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       CASE WHEN license IS NOT NULL THEN path ELSE from_path END AS license_path
FROM marked LEFT JOIN nearest USING (folder)"""
