"""The queries once more, as SQL over the same tables.

Independent of the Spark code: only parameters (terms, weights, dates, lists)
are shared.  Tables built from others are common table expressions.
"""

from __future__ import annotations

from fieldscope.functions.urls import TRACKING_PARAMS
from fieldscope.workload import adapters as a

_SQL: dict[str, str] = {}

# Whitespace as Python understands it, in the oracle's regex dialect.
_WS = (r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
       r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
_NON_WS = "[^" + _WS[1:]


def all_oracles() -> dict[str, str]:
    return dict(_SQL)


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_lit(v) for v in values) + "]"


def _with(*tables: str) -> str:
    return "WITH " + ",\n".join(tables) + "\n"


def _blank(expr: str) -> str:
    return f"(coalesce({expr}, '') = '' OR NOT regexp_matches({expr}, '{_NON_WS}'))"


def _strip(expr: str) -> str:
    return f"regexp_replace(regexp_replace({expr}, '^{_WS}+', ''), '{_WS}+$', '')"


def _hits(terms, text: str = "txt") -> str:
    return "(" + " + ".join(f"contains({text}, {_lit(t.lower())})::INT" for t in terms) + ")"


# --- cleaning, as stages over (key..., raw) ------------------------------------

def _decoded(expr: str) -> str:
    for entity, char in (("&nbsp;", " "), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·")):
        expr = f"replace({expr}, '{entity}', '{char}')"
    return f"regexp_replace({expr}, '&amp;?', '&', 'g')"


def _plain(expr: str) -> str:
    untagged = f"regexp_replace({_decoded(expr)}, '<[^>]+>', ' ', 'g')"
    return f"trim(regexp_replace({untagged}, '{_WS}+', ' ', 'g'))"


def _cut(name: str, limit: int = 1200) -> str:
    return (f"CASE WHEN length({name}) > {limit} THEN rtrim(substring({name}, 1, {limit})) || '…' "
            f"ELSE {name} END")


# --- derived tables --------------------------------------------------------------

_BASE = "(DATE '2024-01-01' + (({0} // 7) % 20)::INT)"

_TITLE = "split_part(text, chr(10), 1)"
_REST = f"substring(text, length({_TITLE}) + 2)"

_ITEMS = f"""items_raw AS (
  SELECT doc_id, {_BASE.format('doc_id')} AS base, lang,
    CASE WHEN source = 'src0' THEN 'library: cites' ELSE source END AS source,
    CASE doc_id % 3 WHEN 0 THEN 'paper' WHEN 1 THEN 'news' ELSE 'org' END AS source_type,
    CASE WHEN doc_id % 5 = 0 THEN text ELSE {_TITLE} END AS title, 'https://example.org/doc/' || doc_id AS url,
    CASE WHEN doc_id % 3 = 0 THEN '10.5555/' || doc_id END AS doi,
    CASE WHEN doc_id % 5 = 0 THEN '' ELSE {_REST} END AS summary,
    CASE WHEN doc_id % 9 = 0 THEN 'arXiv' WHEN doc_id % 6 = 0 THEN 'Journal of ' || lang
         WHEN doc_id % 6 = 3 THEN '  ' END AS venue,
    CASE WHEN doc_id % 3 = 0 AND doc_id % 4 IN (0, 1) THEN 0
         WHEN doc_id % 3 = 0 AND doc_id % 4 = 2 THEN 1 END AS is_preprint
  FROM documents),
items AS (
  SELECT *, sha1(CASE WHEN doi IS NOT NULL THEN 'doi:' || doi ELSE 'url:' || url END) AS id,
    CASE WHEN doc_id % 11 <> 0 THEN base END AS published_at,
    base + INTERVAL 6 HOUR AS fetched_at,
    coalesce(CASE WHEN doc_id % 11 <> 0 THEN base::TIMESTAMP END, base + INTERVAL 6 HOUR) AS effective_at,
    lower(title || ' ' || summary) AS txt
  FROM items_raw)"""

_LABELS = f"""label_scores AS (
  SELECT sha1(CASE WHEN doc_id % 3 = 0 THEN 'doi:10.5555/' || doc_id
              ELSE 'url:https://example.org/doc/' || doc_id END) AS id,
    greatest(0, quality * 10 - toxic * 3)::INT AS score,
    CASE doc_id % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' WHEN 4 THEN 'zzz' END AS tag,
    'label ' || doc_id AS rationale
  FROM labels)"""

_LABELLED = """labelled AS (SELECT items.*, score, tag, rationale FROM items LEFT JOIN label_scores USING (id))"""

_TAG_HITS = ", ".join(f"{_hits(terms)} AS tag_{tag}" for tag, terms in a.TERMS.tags.items())
_BEST = "greatest(" + ", ".join(f"tag_{t}" for t in a.TERMS.tags) + ")"
_BEST_TAG = "CASE " + " ".join(f"WHEN tag_{t} = best THEN '{t}'" for t in a.TERMS.tags) + " END"

_ADJUST = """CASE WHEN is_preprint = 1 THEN -1
      WHEN is_preprint = 0 THEN CASE WHEN {blank} THEN 2 ELSE 1 END ELSE 0 END""".format(blank=_blank("summary"))
_ADJUST_WHY = """CASE WHEN is_preprint = 1 THEN 'preprint -1'
      WHEN is_preprint = 0 THEN CASE WHEN {blank} THEN 'peer-reviewed, no abstract available +2'
        ELSE 'peer-reviewed +1' END ELSE '' END""".format(blank=_blank("summary"))

_SCORED = f"""hits AS (
  SELECT *, {_hits(a.TERMS.topic)} AS topic, {_hits(a.TERMS.region)} AS region,
    {_hits(a.TERMS.exclude)} AS excluded, {_TAG_HITS}, {_ADJUST} AS delta, {_ADJUST_WHY} AS delta_why
  FROM items),
best AS (SELECT *, {_BEST} AS best FROM hits),
scored AS (
  SELECT * EXCLUDE (excluded), excluded,
    (CASE WHEN excluded > 0 THEN 0
      ELSE greatest(0, least(10, least(10, best * 3 + topic + region) + delta)) END)::INT AS score,
    CASE WHEN excluded > 0 OR best = 0 THEN 'none' ELSE {_BEST_TAG} END AS tag,
    CASE WHEN excluded > 0 THEN 'excluded topic'
      ELSE 'keyword match: ' || best || ' tag / ' || topic || ' topic / ' || region || ' region hits'
        || CASE WHEN delta <> 0 THEN ' [' || delta_why || ']' ELSE '' END END AS rationale,
    (source_type = 'paper' OR (excluded = 0 AND topic >= 1)) AS passes
  FROM best)"""

_SCORED_ALL = (_ITEMS, _SCORED)

_LABELLED_ALL = (_ITEMS, _LABELS, _LABELLED)

_AS_OF = f"TIMESTAMP '{a.AS_OF}'"
_EVENTS_AS_OF = f"TIMESTAMP '{a.EVENTS_AS_OF}'"
_LIBRARY_AS_OF = f"TIMESTAMP '{a.LIBRARY_AS_OF}'"
_PUBLIC = "NOT (source ILIKE 'library%')"


def _since(cutoff: str) -> str:
    return (f"((published_at IS NOT NULL AND published_at > ({cutoff})::DATE) "
            f"OR (published_at IS NULL AND fetched_at >= {cutoff}))")


# --- reports -----------------------------------------------------------------------

_REPORT = "id, source, title, score, tag, rationale, published_at::VARCHAR AS published_at"

_SQL["top_picks"] = _with(*_SCORED_ALL) + f"""
SELECT {_REPORT} FROM scored
WHERE score >= 8 AND {_PUBLIC} AND {_since(f"{_AS_OF} - INTERVAL 48 HOUR")}
ORDER BY score DESC, effective_at DESC, id LIMIT 8"""

_SQL["dashboard_listing"] = _with(*_LABELLED_ALL) + f"""
SELECT {_REPORT} FROM labelled
WHERE score >= 6 AND {_PUBLIC} AND {_since(f"{_AS_OF} - INTERVAL 14 DAY")}
ORDER BY effective_at DESC, score DESC, id LIMIT 300"""

_SQL["library_shortlist"] = _with(*_LABELLED_ALL) + f"""
SELECT {_REPORT} FROM labelled
WHERE score >= 6 AND source ILIKE 'library%' AND fetched_at >= {_AS_OF} - INTERVAL 10 DAY
ORDER BY score DESC, effective_at DESC, id LIMIT 30"""

_SQL["display_shape"] = _with(*_LABELLED_ALL) + f"""
, named AS (SELECT *, CASE WHEN {_blank('venue')} THEN source ELSE {_strip('venue')} END AS label FROM labelled)
SELECT id, title, url, coalesce(score, 0) AS score, coalesce(rationale, '') AS rationale,
  CASE WHEN is_preprint = 1 AND NOT contains(lower(label), 'arxiv') THEN label || ' (preprint)' ELSE label END AS source,
  coalesce(published_at::VARCHAR, strftime(fetched_at, '%Y-%m-%dT%H:%M:%SZ')) AS date,
  CASE tag WHEN 'a' THEN 'Alpha' WHEN 'b' THEN 'Beta' ELSE coalesce(tag, 'none') END AS tag_label,
  CASE tag WHEN 'a' THEN '#111111' WHEN 'b' THEN '#222222' ELSE '#888888' END AS tag_color
FROM named"""

_SQL["latest_scorer"] = """
SELECT CASE event_type WHEN 'click' THEN 'keyword' WHEN 'view' THEN 'remote-a' ELSE 'remote-b' END AS scorer
FROM events WHERE event_type IN ('click', 'view', 'purchase') ORDER BY ts DESC, event_id DESC LIMIT 1"""

_SQL["shown_composition"] = _with(*_LABELLED_ALL) + f"""
, counts AS (
  SELECT CASE WHEN is_preprint = 1 THEN 'preprint' WHEN is_preprint = 0 THEN 'peer-reviewed'
      WHEN source_type = 'paper' THEN 'unknown' ELSE source_type END AS venue_class, count(*) AS n
  FROM labelled WHERE score >= 6 AND {_PUBLIC} AND {_since(f"{_AS_OF} - INTERVAL 14 DAY")} GROUP BY 1)
SELECT venue_class, n, round(100.0 * n / sum(n) OVER ())::INT AS share_pct FROM counts"""

_SQL["headline_list"] = _with(*_LABELLED_ALL) + """
, best40 AS (SELECT title, row_number() OVER (ORDER BY score DESC, effective_at DESC, id) AS ord_at
  FROM labelled WHERE score >= 6 QUALIFY ord_at <= 40)
SELECT string_agg('- ' || title, chr(10) ORDER BY ord_at) AS text FROM best40"""

_DIGEST = f"""digest AS (
  SELECT CASE tag WHEN 'a' THEN 0 WHEN 'b' THEN 1 WHEN 'c' THEN 2 ELSE 3 END AS group_ord,
    CASE tag WHEN 'a' THEN 'Alpha' WHEN 'b' THEN 'Beta' WHEN 'c' THEN 'Gamma' ELSE 'Other' END AS group_label,
    CASE tag WHEN 'a' THEN '#111111' WHEN 'b' THEN '#222222' WHEN 'c' THEN '#333333' ELSE '#888888' END AS group_color,
    id, title, url, source, score, rationale AS why
  FROM labelled WHERE score >= 6 AND {_PUBLIC}
    AND fetched_at >= greatest({_AS_OF} - INTERVAL 36 HOUR, TIMESTAMP '2024-01-18 09:00:00'))"""
_DIGEST_ALL = (_ITEMS, _LABELS, _LABELLED, _DIGEST)

_SQL["digest_rows"] = _with(*_DIGEST_ALL) + "SELECT * FROM digest"

_SQL["digest_groups"] = _with(*_DIGEST_ALL) + """
SELECT group_ord, group_label, group_color, count(*) AS n FROM digest GROUP BY ALL"""

_SQL["digest_header"] = _with(*_DIGEST_ALL) + f"""
, shortlist AS (SELECT id FROM labelled WHERE score >= 6 AND source ILIKE 'library%'
    AND fetched_at >= {_AS_OF} - INTERVAL 10 DAY ORDER BY score DESC, effective_at DESC, id LIMIT 30),
counts AS (SELECT (SELECT count(*) FROM digest) AS d, (SELECT count(*) FROM shortlist) AS s)
SELECT d + s AS n, s AS n_library, '2024-01-20' AS date FROM counts WHERE d + s > 0"""

_SQL["digest_lines"] = _with(*_DIGEST_ALL) + """
SELECT group_ord, id, '[' || score || '] ' || title || ' — ' || source || chr(10) || '    ' || why
  || chr(10) || '    ' || url AS line FROM digest"""

_SQL["age_label"] = f"""
WITH aged AS (SELECT o_orderkey, floor((epoch(TIMESTAMP '{a.AGE_AS_OF}') - epoch(o_orderdate)) / 86400)::BIGINT AS d FROM orders)
SELECT o_orderkey, CASE WHEN d <= 0 THEN 'today' WHEN d = 1 THEN '1 day ago' ELSE d || ' days ago' END AS age FROM aged"""

# --- scoring -------------------------------------------------------------------------

_SQL["keyword_score"] = _with(*_SCORED_ALL) + "SELECT id, score, tag, rationale, 'keyword' AS scorer FROM scored"
_SQL["term_hits"] = _with(*_SCORED_ALL) + "SELECT id, topic AS topic_hits FROM scored"
_SQL["prefilter_gate"] = _with(*_SCORED_ALL) + "SELECT id, passes::INT AS passes, topic AS prefilter_hits FROM scored"

_TERM_ROWS = ", ".join(f"({_lit(k)}, {_lit(tag)}, {_lit(term.lower())})" for k, tag, term in a.TERMS.terms())
_TERM_TABLE = f"terms(kind, tag, term) AS (VALUES {_TERM_ROWS})"

_SQL["term_join"] = _with(_ITEMS, _TERM_TABLE) + """
SELECT id, kind, tag, term FROM items JOIN terms ON contains(txt, term)"""

_SQL["term_table_hits"] = _with(_ITEMS, """terms AS (
  SELECT ['topic', 'region', 'exclude'][length(term) % 3 + 1] AS kind, term FROM (
    SELECT DISTINCT unnest(string_split(text, ' ')) AS term FROM benchmark) WHERE length(term) >= 3)""") + """
SELECT id, kind, count(*) AS hits FROM items JOIN terms ON contains(txt, lower(term)) GROUP BY 1, 2"""

_SQL["best_tag"] = _with(_ITEMS, _TERM_TABLE) + """
, per_tag AS (SELECT id, tag, count(*)::INT AS hits FROM items JOIN terms ON contains(txt, term)
  WHERE kind = 'tag' GROUP BY 1, 2)
SELECT id, tag, hits FROM per_tag QUALIFY row_number() OVER (PARTITION BY id ORDER BY hits DESC, tag) = 1"""

_SQL["venue_adjust"] = _with(_ITEMS) + f"SELECT id, {_ADJUST} AS delta, {_ADJUST_WHY} AS why FROM items"

_SQL["unscored"] = _with(_ITEMS, _LABELS) + """
SELECT id, doc_id FROM items WHERE NOT EXISTS (SELECT 1 FROM label_scores s WHERE s.id = items.id)"""

_STAGE = """pending AS (SELECT * FROM scored WHERE NOT EXISTS (SELECT 1 FROM label_scores s WHERE s.id = scored.id)),
stage AS (SELECT id, topic AS prefilter_hits, CASE WHEN passes THEN score ELSE 0 END AS score,
  CASE WHEN passes THEN tag ELSE 'none' END AS tag,
  CASE WHEN passes THEN rationale ELSE 'failed prefilter' END AS rationale,
  CASE WHEN passes THEN 'keyword' ELSE 'prefilter' END AS scorer FROM pending)"""
_STAGE_ALL = (_ITEMS, _LABELS, _SCORED, _STAGE)

_SQL["score_stage"] = _with(*_STAGE_ALL) + "SELECT * FROM stage"
_SQL["score_stage_counts"] = _with(*_STAGE_ALL) + """
SELECT count(*) FILTER (scorer = 'keyword') AS scored, count(*) FILTER (scorer = 'prefilter') AS prefiltered,
  0::BIGINT AS deferred FROM stage"""
_SQL["score_cap"] = _with(*_STAGE_ALL) + """
SELECT id, doc_id FROM pending WHERE passes ORDER BY effective_at DESC, id LIMIT 150"""
_SQL["apply_scores_once"] = _with(*_STAGE_ALL) + "SELECT id, score, tag, 0 AS attempt FROM pending"

_PAYLOAD = f"""'{{"id":' || to_json(id)::VARCHAR || ',"title":' || to_json(title)::VARCHAR
  || ',"summary":' || to_json(substring(summary, 1, 1000))::VARCHAR
  || CASE WHEN coalesce(venue, '') <> '' THEN ',"venue":' || to_json(venue)::VARCHAR ELSE '' END
  || CASE WHEN is_preprint IS NOT NULL THEN ',"peer_reviewed":' || CASE WHEN is_preprint = 0 THEN 'true' ELSE 'false' END ELSE '' END
  || CASE WHEN {_blank('summary')} THEN ',"note":"no abstract available from the source; judge on title and venue"' ELSE '' END
  || '}}'"""

_SQL["score_payload"] = _with(_ITEMS) + f"SELECT id, {_PAYLOAD} AS payload FROM items"
_SQL["score_batches"] = _with(*_STAGE_ALL) + f"""
, numbered AS (SELECT id, {_PAYLOAD} AS row_json, row_number() OVER (ORDER BY effective_at DESC, id) - 1 AS ord_at
  FROM pending WHERE passes)
SELECT ord_at // 20 AS batch_id, string_agg(id, ',' ORDER BY ord_at) AS ids,
  '[' || string_agg(row_json, ',' ORDER BY ord_at) || ']' AS request FROM numbered GROUP BY 1"""

_SQL["pluggable_scorer"] = _with(*_STAGE_ALL) + """
, numbered AS (SELECT *, row_number() OVER (ORDER BY effective_at DESC, id) - 1 AS ord_at FROM pending WHERE passes)
SELECT ord_at // 20 AS batch_id, (ord_at % 20)::INT AS pos, id,
  greatest(0, least(10, length(title) % 11 + delta))::INT AS score, 'a' AS tag,
  'length' || CASE WHEN delta <> 0 THEN ' [' || delta_why || ']' ELSE '' END AS rationale, 'local' AS scorer
FROM numbered"""

_SQL["ingest_scores"] = f"""
WITH turns AS (SELECT *, conv_id || '-' || turn AS batch_id, (conv_id * 8 + turn) % 8 AS ord_at FROM conversations),
elements AS (
  SELECT batch_id, ord_at, turn, role, 0 AS pos, batch_id || '-a' AS id, NULL::INT AS flag,
    CASE ord_at WHEN 0 THEN 9 WHEN 1 THEN 9 WHEN 2 THEN 7 WHEN 3 THEN 0 WHEN 4 THEN 1 WHEN 5 THEN 0 WHEN 6 THEN 10 ELSE 0 END AS raw,
    CASE WHEN ord_at < 3 THEN 'a' WHEN ord_at < 6 THEN 'c' ELSE 'none' END AS tag, substring(text, 1, 280) AS why FROM turns
  UNION ALL
  SELECT batch_id, ord_at, turn, role, 4, batch_id || '-b', 1, 10, 'none', 'from [' || role || ']' FROM turns),
asked AS (SELECT * EXCLUDE (flag), CASE WHEN flag = 1 THEN 1 WHEN turn % 2 = 0 THEN 0 END AS is_preprint,
  CASE WHEN role = 'user' THEN '' ELSE 'has text' END AS summary FROM elements WHERE ord_at <> 7),
moved AS (SELECT *, {_ADJUST} AS delta, {_ADJUST_WHY} AS delta_why FROM asked)
SELECT batch_id, pos::INT AS pos, id, greatest(0, least(10, raw + delta))::INT AS score, tag,
  substring(why || CASE WHEN delta <> 0 THEN ' [' || delta_why || ']' ELSE '' END, 1, 280) AS rationale,
  'remote' AS scorer FROM moved"""

# --- identity and ingest ---------------------------------------------------------------

_TRACKING = _list(TRACKING_PARAMS)


def _normal(url: str) -> str:
    """Canonical form of an absolute URL without percent escapes."""
    parts = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
    kept = (f"list_sort(list_filter(string_split(regexp_extract({url}, '{parts}', 4), '&'), "
            f"lambda p: regexp_matches(p, '^[^=]*=.') AND NOT list_contains({_TRACKING}, lower(split_part(p, '=', 1)))))")
    path = f"rtrim(regexp_extract({url}, '{parts}', 3), '/')"
    return (f"lower(regexp_extract({url}, '{parts}', 1)) || '://' || lower(regexp_extract({url}, '{parts}', 2))"
            f" || CASE WHEN {path} = '' THEN '/' ELSE {path} END"
            f" || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END")


_SQL["normalize_url"] = f"SELECT page_id, {_normal('url')} AS url FROM pages"

_SQL["item_identity"] = f"""
SELECT 'order-' || o_orderkey AS item, sha1(CASE WHEN o_orderkey % 3 <> 0 THEN 'doi:10.9999/abc.' || o_custkey
  ELSE 'url:https://shop.example.com/O/' || o_custkey || '?a=1&b=2' END) AS id FROM orders
UNION ALL SELECT 'page-' || page_id, sha1('url:' || {_normal('url')}) FROM pages"""

_SQL["dedupe_first"] = f"""
WITH tracked AS (SELECT page_id, regexp_extract(url, '^([^#]*)', 1)
    || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_medium=mail' AS url FROM pages),
delivered AS (
  SELECT sha1('url:' || {_normal('url')}) AS id, 'page-' || page_id AS item, 0 AS source_ord, page_id AS seq FROM pages
  UNION ALL SELECT sha1('url:' || {_normal('url')}), 'page-' || page_id, 1, page_id FROM tracked
  UNION ALL SELECT sha1(text), 'document-' || doc_id, 0, doc_id FROM documents)
SELECT id, item, source_ord FROM delivered
QUALIFY row_number() OVER (PARTITION BY id ORDER BY source_ord, seq) = 1"""

_SQL["upsert_new"] = """
WITH batch AS (SELECT sha1(text) AS id, doc_id, source FROM documents),
stored AS (SELECT id FROM batch JOIN labels USING (doc_id))
SELECT id, doc_id, source FROM batch WHERE id NOT IN (SELECT id FROM stored)
QUALIFY row_number() OVER (PARTITION BY id ORDER BY doc_id) = 1"""

_SQL["schema_evolve"] = _with(_ITEMS) + """
, marked AS (SELECT *, doc_id IN (SELECT doc_id FROM labels) AS old FROM items)
SELECT id, title, CASE WHEN NOT old THEN venue END AS venue, CASE WHEN NOT old THEN is_preprint END AS is_preprint,
  NULL::INT AS prefilter_hits FROM marked"""

_COLLECTED = f"""collected AS (
  SELECT 'works' AS collector, 0 AS source_ord, 'paper' AS source_type, {_TITLE} AS title,
    NULL AS url, '10.5555/' || doc_id AS doi, source AS venue FROM documents
  UNION ALL SELECT 'feeds', 1, 'org', NULL, url, NULL, NULL FROM pages
  UNION ALL SELECT 'news', 2, 'news', {_TITLE}, 'https://talk.example.org/' || conv_id || '/' || turn,
    NULL, NULL FROM conversations)"""
_SQL["collect_union"] = _with(_COLLECTED) + "SELECT * FROM collected"
_SQL["source_counts"] = _with(_COLLECTED) + """
, listed(collector) AS (VALUES ('works'), ('feeds'), ('news'), ('library'))
SELECT collector, count(source_ord) AS fetched, 1 AS ok, count(source_ord) || ' items' AS note
FROM listed LEFT JOIN collected USING (collector) GROUP BY collector"""

_SQL["meta_latest"] = """
SELECT event_type AS key, props || event_id AS value FROM events
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1"""

_SQL["near_dup_titles"] = f"""
WITH titles AS (SELECT 'd' || doc_id AS id, {_TITLE} AS title FROM documents
  UNION ALL SELECT 'p' || page_id, regexp_extract(html, '<title>(.*?)</title>', 1) FROM pages),
keyed AS (SELECT id, trim(regexp_replace(lower(title), '{_WS}+', ' ', 'g')) AS title_key FROM titles)
SELECT title_key, count(*) AS n, min(id) AS first_id FROM keyed WHERE title_key <> '' GROUP BY 1 HAVING count(*) > 1"""

_CLASSES = f"""titles AS (SELECT 'd' || doc_id AS id, {_TITLE} AS title FROM documents
  UNION ALL SELECT 'p' || page_id, regexp_extract(html, '<title>(.*?)</title>', 1) FROM pages),
members AS (
  SELECT id, list_sort(list_distinct(string_split(trim(regexp_replace(lower(title), '{_WS}+', ' ', 'g')), ' '))) AS words FROM titles
  WHERE title IS NOT NULL AND trim(regexp_replace(lower(title), '{_WS}+', ' ', 'g')) <> ''),
classes AS (SELECT words, min(id) AS class_id, count(*) AS n_same FROM members GROUP BY words),
listed AS (SELECT class_id, len(words) AS size, unnest(words) AS word FROM classes),
pairs AS (
  SELECT a.class_id AS class_a, b.class_id AS class_b, count(*) AS shared, a.size + b.size - count(*) AS together
  FROM listed a JOIN listed b ON a.word = b.word AND a.class_id < b.class_id
  GROUP BY a.class_id, b.class_id, a.size, b.size HAVING 100 * count(*) >= 80 * (a.size + b.size - count(*)))"""
_SQL["similar_titles"] = _with(_CLASSES) + "SELECT class_a, class_b, shared, together FROM pairs"
_SQL["title_links"] = _with(_CLASSES) + """, ends AS (SELECT class_a AS class_id FROM pairs UNION ALL SELECT class_b FROM pairs),
links AS (SELECT class_id, count(*) AS n_links FROM ends GROUP BY 1)
SELECT id, class_id, n_same, coalesce(n_links, 0) AS n_links FROM members JOIN classes USING (words) LEFT JOIN links USING (class_id)"""

# --- text ------------------------------------------------------------------------------

_SQL["strip_html"] = f"WITH p AS (SELECT page_id, {_plain('html')} AS x FROM pages) SELECT page_id, {_cut('x')} AS text FROM p"
_SQL["strip_titled_html"] = f"""
WITH u AS (SELECT page_id, regexp_replace(html, '(?is)<title>.*?</title>', ' ', 'g') AS h FROM pages),
p AS (SELECT page_id, {_plain('h')} AS x FROM u) SELECT page_id, {_cut('x')} AS text FROM p"""
_SQL["rebuild_text"] = f"WITH p AS (SELECT doc_id, {_plain('text')} AS x FROM documents) SELECT doc_id, x AS text FROM p"
_SQL["flatten_cut"] = f"""
WITH f AS (SELECT doc_id, replace(' ' || chr(10) || text, chr(10), ' ') AS x FROM documents)
SELECT doc_id, substring({_strip('x')}, 1, 1200) AS text FROM f"""
_SQL["clean_doi"] = """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN '' ELSE '10.9999/abc.' || o_orderkey END AS doi FROM orders"""

# --- sources ---------------------------------------------------------------------------

_SQL["project_items"] = f"""
WITH p AS (SELECT *, {_plain('text')} AS x FROM documents)
SELECT 'https://openalex.org/W' || doc_id AS work_id, 'openalex:all' AS source, 'paper' AS source_type,
  CASE WHEN doc_id % 7 IN (0, 1) THEN '(untitled)' ELSE {_TITLE} END AS title,
  CASE WHEN doc_id % 10 = 9 OR doc_id % 5 = 0 THEN 'https://openalex.org/W' || doc_id
    ELSE 'https://example.org/w/' || doc_id END AS url,
  CASE WHEN doc_id % 3 <> 1 THEN '10.5555/' || doc_id END AS doi,
  CASE WHEN doc_id % 11 <> 0 THEN {_BASE.format('doc_id')}::VARCHAR END AS published_at, x AS summary,
  CASE WHEN doc_id % 10 = 9 THEN '' ELSE source END AS venue,
  CASE WHEN doc_id % 4 = 2 OR (lang = 'de' AND doc_id % 10 <> 9) THEN 1 ELSE 0 END AS is_preprint FROM p"""

_QUERY_ROWS = ", ".join(f"({_lit(q)})" for q in a.TOPIC_QUERIES)
_SQL["watch_topic"] = _with(_ITEMS, f"queries(q) AS (VALUES {_QUERY_ROWS})") + f"""
SELECT id, doc_id, 'openalex:' || q AS source FROM items JOIN queries
  ON len(list_filter(string_split(q, ' '), lambda w: NOT contains(txt, w))) = 0
WHERE published_at >= ({_AS_OF} - INTERVAL 7 DAY)::DATE"""

_SQL["watch_topic_table"] = _with(_ITEMS, """queries AS (
  SELECT DISTINCT array_to_string(string_split(text, ' ')[1:4], ' ') AS query FROM conversations WHERE role = 'user'),
asked AS (SELECT query, list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda w: w <> '') AS words FROM queries)""") + """
SELECT id, query FROM items JOIN asked ON len(words) > 0 AND len(list_filter(words, lambda w: NOT contains(txt, w))) = 0"""

_RECENT_LINES = f"l_shipdate >= ({_LIBRARY_AS_OF} - INTERVAL 365 DAY)::DATE"
_SQL["watch_issn"] = f"""
SELECT l_orderkey, l_linenumber, l_partkey, 'openalex:issn:' || p_brand AS source
FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE {_RECENT_LINES} AND list_contains({_list(a.WATCHED_ISSNS)}, p_brand)"""
_SQL["watch_author"] = f"""
SELECT DISTINCT l_orderkey, 'openalex:author:' || l_suppkey AS source FROM lineitem
WHERE {_RECENT_LINES} AND list_contains({_list(a.WATCHED_AUTHORS)}, l_suppkey::VARCHAR)"""

_SQL["scan_preprints"] = f"""
WITH entries AS (SELECT doc_id, {_TITLE} AS title, {_REST} AS summary, lang, source AS src,
    CASE WHEN doc_id % 11 <> 0 THEN {_BASE.format('doc_id')} + INTERVAL 6 HOUR END AS ord_at FROM documents),
newest AS (SELECT * FROM entries WHERE lang = 'de' OR src = 'src3' OR contains(lower(title || ' ' || summary), 'tion of')),
flat AS (SELECT *, replace(title, chr(10), ' ') AS ft, replace(summary, chr(10), ' ') AS fs FROM newest)
SELECT 'arxiv' AS source, 'paper' AS source_type, 'arXiv' AS venue, 1 AS is_preprint, {_strip('ft')} AS title,
  'https://example.org/p/' || doc_id AS url, CASE WHEN doc_id % 2 = 0 THEN '10.5555/' || doc_id END AS doi,
  ord_at::DATE::VARCHAR AS published_at, {_strip('fs')} AS summary
FROM flat WHERE ord_at IS NULL OR ord_at >= {_AS_OF} - INTERVAL 7 DAY"""

_NEWS = """news AS (SELECT *, CASE WHEN event_id % 13 <> 0 AND event_id % 17 <> 0 THEN date_trunc('second', ts) END AS ord_at,
  'https://news.example.org/' || event_id AS link FROM events)"""
_NEWS_RECENT = f"(ord_at IS NULL OR ord_at >= {_EVENTS_AS_OF} - INTERVAL 7 DAY)"
_SQL["scan_news"] = _with(_NEWS) + f"""
SELECT 'gnews:' || event_type AS source, 'news' AS source_type, event_type || ' ' || event_id AS title, link AS url,
  NULL::VARCHAR AS doi, ord_at::DATE::VARCHAR AS published_at, 'user ' || user_id || ' & ' || props AS summary
FROM news WHERE {_NEWS_RECENT}"""
_SQL["recency_keep_null"] = _with(_NEWS) + f"""
SELECT link, CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 17 = 0 THEN 'not a date'
  ELSE strftime(ord_at, '%Y-%m-%d %H:%M:%S') END AS published FROM news WHERE {_NEWS_RECENT}"""

_FEEDS = f"""feeds AS (SELECT *, 'feed' || (page_id % 7) AS feed, page_id % 17 = 0 AS bad, {_plain('html')} AS x,
    CASE WHEN page_id % 3 <> 2 THEN {_BASE.format('page_id')} + INTERVAL 8 HOUR END AS ord_at FROM pages)"""
_FEED_RECENT = f"(ord_at IS NULL OR ord_at >= {_AS_OF} - INTERVAL 7 DAY)"
_SQL["scan_feeds"] = _with(_FEEDS) + f"""
SELECT page_id, feed AS source, CASE feed WHEN 'feed3' THEN 'news' ELSE 'org' END AS source_type,
  {_strip("regexp_extract(html, '<title>(.*?)</title>', 1)")} AS title, url, ord_at::DATE::VARCHAR AS published_at,
  x AS summary FROM feeds WHERE NOT bad AND {_FEED_RECENT}"""
_SQL["feed_records"] = _with(_FEEDS) + f"""
SELECT 'rss:' || feed AS source, count(*) FILTER (NOT bad AND {_FEED_RECENT}) AS fetched,
  count(*) FILTER (bad) AS failed, (count(*) FILTER (bad) = 0)::INT AS ok FROM feeds GROUP BY feed"""

_BIB = """bib AS (SELECT '10.1000/abc.' || o_custkey AS doi, min(o_orderkey) AS seq
  FROM orders WHERE o_orderkey % 4 <> 3 GROUP BY 1)"""
_RECORDS = """records AS (SELECT CASE WHEN event_type = 'view' THEN '10.2000/v' ELSE '10.2000/k' END
    || regexp_extract(props, '(\\d+)', 1) AS doi, min(event_id) AS seq
  FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1)"""
_SQL["library_dois_bib"] = _with(_BIB) + "SELECT doi, seq FROM bib"
_SQL["library_dois_file"] = _with(_BIB) + "SELECT doi FROM bib"
_SQL["library_dois_json"] = _with(_RECORDS) + "SELECT doi, seq FROM records"
_SQL["library_dois"] = _with(_BIB, _RECORDS) + """
, merged AS (SELECT doi, 0 AS part, seq FROM bib UNION ALL SELECT doi, 1, seq FROM records)
SELECT doi, part, seq FROM merged QUALIFY row_number() OVER (PARTITION BY doi ORDER BY part, seq) = 1"""

# --- library discovery -----------------------------------------------------------------

_LIBRARY = f"""lib AS (SELECT o_orderkey AS work_id, o_orderkey AS seq FROM orders WHERE o_orderpriority = '1-URGENT'),
recent AS (SELECT o_orderkey AS work_id, o_orderdate::DATE AS published, o_orderstatus <> 'P' AS article FROM orders
  WHERE o_orderdate::DATE >= ({_LIBRARY_AS_OF} - INTERVAL 365 DAY)::DATE),
authors AS (SELECT l_suppkey AS author_id, count(*) AS n, min((seq, l_linenumber)) AS first
  FROM lineitem JOIN lib ON l_orderkey = work_id GROUP BY 1 ORDER BY n DESC, first, author_id LIMIT 15),
cites AS (SELECT DISTINCT l_orderkey AS work_id FROM lineitem WHERE l_partkey IN (SELECT work_id FROM lib)),
wrote AS (SELECT DISTINCT l_orderkey AS work_id FROM lineitem WHERE l_suppkey IN (SELECT author_id FROM authors))"""
_SQL["library_resolve"] = _with(_LIBRARY) + "SELECT work_id::VARCHAR AS work_id, seq FROM lib"
_SQL["top_authors"] = _with(_LIBRARY) + "SELECT author_id::VARCHAR AS author_id, n FROM authors"
_WATCHED_ORDERS = ", ".join(f"({_lit(q)})" for q in a.WATCHED_ORDERS)
_SQL["collect_watched"] = f"""
WITH recent AS (SELECT *, o_orderpriority || ' order ' || o_orderstatus AS title FROM orders
  WHERE o_orderdate::DATE >= ({_LIBRARY_AS_OF} - INTERVAL 365 DAY)::DATE),
queries(q) AS (VALUES {_WATCHED_ORDERS}),
labels AS (
  SELECT o_orderkey, 'openalex:' || q AS source FROM recent JOIN queries
    ON len(list_filter(string_split(q, ' '), lambda w: NOT contains(lower(title), w))) = 0
  UNION ALL SELECT o_orderkey, 'openalex:issn:C-' || o_custkey % 40 FROM recent
    WHERE list_contains({_list(a.WATCHED_CUSTOMERS)}, 'C-' || o_custkey % 40)
  UNION ALL SELECT DISTINCT l_orderkey, 'openalex:author:' || l_suppkey FROM lineitem JOIN recent ON l_orderkey = o_orderkey
    WHERE list_contains({_list(a.WATCHED_AUTHORS)}, l_suppkey::VARCHAR))
SELECT source, 'paper' AS source_type, title, 'https://openalex.org/W/' || o_orderkey AS url,
  '10.7777/W' || o_orderkey || '.' || o_custkey AS doi, o_orderdate::DATE::VARCHAR AS published_at, 'Orders' AS venue,
  (o_orderstatus = 'P')::INT AS is_preprint FROM labels JOIN recent USING (o_orderkey)"""
_SQL["library_citing"] = _with(_LIBRARY) + """
SELECT work_id::VARCHAR AS work_id, published::VARCHAR AS published FROM recent WHERE work_id IN (SELECT work_id FROM cites)"""
_SQL["library_by_author"] = _with(_LIBRARY) + """
SELECT work_id::VARCHAR AS work_id, published::VARCHAR AS published FROM recent WHERE article AND work_id IN (SELECT work_id FROM wrote)"""
_SQL["library_discovery"] = _with(_LIBRARY) + """
, found AS (SELECT *, work_id IN (SELECT work_id FROM cites) AS citing FROM recent
  WHERE work_id NOT IN (SELECT work_id FROM lib))
SELECT work_id::VARCHAR AS work_id, published::VARCHAR AS published,
  CASE WHEN citing THEN 'library: cites your library' ELSE 'library: author you read' END AS source
FROM found WHERE citing OR (article AND work_id IN (SELECT work_id FROM wrote))"""
_SQL["library_discovery_stored"] = _SQL["library_discovery"]
_SQL["distinct_first"] = "SELECT l_partkey, min(l_orderkey) AS seq FROM lineitem GROUP BY 1"

# --- enrichment and packing --------------------------------------------------------------

_LOOKUP = f"""wanted AS (SELECT *, source_type = 'paper' AND {_blank('summary')} AS eligible FROM items),
looked AS (SELECT wanted.*, {_plain('b.text')} AS found FROM wanted
  LEFT JOIN benchmark b ON b.item_id = wanted.doc_id % 60 AND wanted.eligible),
shaped AS (SELECT *, found AS abstract, coalesce(found, '') <> '' AS hit FROM looked)"""
_LOOKUP_ALL = (_ITEMS, _LOOKUP)


def _walk(limit: int, give_up: int, partition: str = "") -> str:
    over = f"(PARTITION BY {partition} ORDER BY doc_id)" if partition else "(ORDER BY doc_id)"
    rows = over[:-1] + " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""walk AS (SELECT *, row_number() OVER {over} AS rn,
    coalesce(sum(hit::INT) OVER {rows}, 0) AS filled_before FROM shaped WHERE eligible),
  tries AS (SELECT *, filled_before < {limit} AND NOT (rn > {give_up} AND filled_before = 0) AS step FROM walk),
  attempts AS (SELECT *, bool_and(step) OVER {over} AS tried FROM tries)"""


_SQL["abstract_backfill"] = _with(*_LOOKUP_ALL) + """
SELECT id, CASE WHEN hit THEN abstract ELSE summary END AS summary FROM shaped"""
_SQL["backfill_budget"] = _with(*_LOOKUP_ALL, _walk(60, 10)) + """
SELECT doc_id, tried::INT AS tried, (tried AND hit)::INT AS filled FROM attempts"""
_SQL["backfill_budget_by_source"] = _with(*_LOOKUP_ALL, _walk(2, 1, "source")) + """
SELECT doc_id, source, tried::INT AS tried, (tried AND hit)::INT AS filled FROM attempts"""
_SQL["backfill_counters"] = _with(*_LOOKUP_ALL, _walk(60, 10)) + """
, counts AS (SELECT count(*) FILTER (tried AND hit) AS filled, count(*) FILTER (tried) AS tried,
  max(doc_id) FILTER (tried) AS last_try FROM attempts)
SELECT filled, tried, (filled = 0 AND tried >= 10 AND (SELECT max(doc_id) FROM documents) > last_try)::INT AS gave_up FROM counts"""

_SQL["budget_pack"] = f"""
WITH bodies AS (SELECT conv_id, turn, role, {_strip('text')} AS body FROM conversations),
chunks AS (SELECT conv_id, turn, chr(10) || '--- ' || turn || '-' || role || ' ---' || chr(10) || body || chr(10) AS chunk
  FROM bodies WHERE body <> ''),
used AS (SELECT *, coalesce(sum(length(chunk)) OVER (PARTITION BY conv_id ORDER BY turn
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM chunks),
parts AS (SELECT *, CASE WHEN before + length(chunk) <= 600 THEN chunk
  WHEN regexp_matches(substring(chunk, 1, 600 - before), '{_NON_WS}')
    THEN substring(chunk, 1, 600 - before) || chr(10) || '[truncated]' || chr(10) END AS part
  FROM used WHERE before <= 600),
blocks AS (SELECT conv_id, 'NOTES' || chr(10) || string_agg(part, '' ORDER BY turn) AS block FROM parts GROUP BY conv_id),
sized AS (SELECT *, (length(block) - length(replace(block, chr(10) || '--- ', ''))) // 5 AS n_docs,
  length(block)::BIGINT AS n_chars FROM blocks)
SELECT conv_id, block, n_docs::BIGINT AS n_docs, n_chars,
  n_docs || ' reference document' || CASE WHEN n_docs = 1 THEN '' ELSE 's' END || ', ' || n_chars || ' chars' AS note
FROM sized"""

# --- health and retention ------------------------------------------------------------------

_RUNS = """runs AS (SELECT event_id AS run_id, ts AS run_at, user_id::VARCHAR AS source,
  (event_type IN ('click', 'purchase'))::INT AS ok FROM events),
latest AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY run_at DESC, run_id DESC)::INT AS recency FROM runs
  QUALIFY recency <= 3)"""
_FAILING = "SELECT source FROM latest GROUP BY source HAVING count(*) >= 3 AND max(ok) = 0"
_SQL["last_n_runs"] = _with(_RUNS) + "SELECT source, run_id, ok, recency FROM latest"
_SQL["failing_sources"] = _with(_RUNS) + _FAILING
_SQL["prune_items"] = _with(_ITEMS, _LABELS, _LABELLED) + f"""
SELECT id, score FROM labelled WHERE coalesce(score >= 6, false) OR {_since(f"{_AS_OF} - INTERVAL 10 DAY")}"""
_SQL["prune_runs"] = _with(_RUNS) + f"""
SELECT run_id, source FROM runs WHERE run_at >= {_EVENTS_AS_OF} - INTERVAL 12 DAY"""

# --- stored tables --------------------------------------------------------------------------

_SQL["stored_items"] = _with(_ITEMS, _LABELS, _LABELLED) + f"""
SELECT id, title, source, published_at::VARCHAR AS published_at FROM labelled
WHERE coalesce(score >= 6, false) OR {_since(f"{_AS_OF} - INTERVAL 10 DAY")}"""
_SQL["stored_items_indexed"] = _with(_ITEMS) + """
SELECT id, doc_id % 3 || ' ' || title AS title, source, published_at::VARCHAR AS published_at FROM items"""
_TIMES = ", ".join(f"({_lit(x)})" for x in a.RUN_TIMES if x >= "2024-01-18 12:00:00")
_SQL["stored_runs"] = f"""
WITH log AS (SELECT event_type AS source, count(*) AS fetched FROM events GROUP BY 1), times(run_at) AS (VALUES {_TIMES})
SELECT source, fetched, 1 AS ok, fetched || ' events' AS note, run_at FROM log, times"""
_SQL["stored_report"] = _SQL["dashboard_listing"]
_SQL["collect_plugins"] = _with(_COLLECTED) + """
SELECT collector AS source, count(*) AS fetched, 1 AS ok, count(title) AS titles, count(url) AS urls FROM collected GROUP BY 1
UNION ALL SELECT 'broken', 0, 0, 0, 0"""

_SQL["collect_landed"] = """
SELECT 'news' AS source, count(*) AS fetched, 1 AS ok, count(*) AS titles, 0::BIGINT AS texts FROM events
UNION ALL SELECT 'talks', count(*), 1, 0, count(text) FROM conversations
UNION ALL SELECT 'pages', 0, 0, 0, 0"""
_NOTES = """notes AS (
  SELECT conv_id || CASE WHEN conv_id % 10 = 5 THEN '.txt' ELSE '.md' END AS name,
         string_agg(concat_ws(': ', role, text), chr(10) ORDER BY turn, role, text) AS body FROM conversations
  WHERE conv_id % 10 <> 3 GROUP BY conv_id)"""
_SQL["notes_read"] = _with(_NOTES) + "SELECT name, length(body) AS n_chars, md5(body) AS digest FROM notes"
_SQL["notes_block"] = _with(_NOTES, f"""bodies AS (SELECT name, {_strip('body')} AS body FROM notes),
chunks AS (SELECT name, chr(10) || '--- ' || name || ' ---' || chr(10) || body || chr(10) AS chunk FROM bodies WHERE body <> ''),
used AS (SELECT *, coalesce(sum(length(chunk)) OVER (ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM chunks),
parts AS (SELECT *, CASE WHEN before + length(chunk) <= 6000 THEN chunk
  WHEN regexp_matches(substring(chunk, 1, 6000 - before), '{_NON_WS}')
    THEN substring(chunk, 1, 6000 - before) || chr(10) || '[truncated]' || chr(10) END AS part
  FROM used WHERE before <= 6000),
blocks AS (SELECT 'NOTES' || chr(10) || string_agg(part, '' ORDER BY name) AS block FROM parts),
sized AS (SELECT *, (length(block) - length(replace(block, chr(10) || '--- ', ''))) // 5 AS n_docs, length(block)::BIGINT AS n_chars
  FROM blocks)""") + """
SELECT block, n_docs::BIGINT AS n_docs, n_chars,
  n_docs || ' reference document' || CASE WHEN n_docs = 1 THEN '' ELSE 's' END || ', ' || n_chars || ' chars' AS note FROM sized"""

_SUMMARY = f"CASE WHEN doc_id % 5 = 0 THEN '' ELSE {_REST} END AS summary"
_FILLED = "CASE WHEN doc_id % 30 = 0 THEN 'the abstract of ' || doc_id "
_SWEPT = f"""swept AS (
  SELECT id, topic, passes, score, tag, rationale FROM scored
  WHERE NOT EXISTS (SELECT 1 FROM label_scores s WHERE s.id = scored.id)),
fresh AS (SELECT id, CASE WHEN passes THEN score ELSE 0 END AS score, CASE WHEN passes THEN tag ELSE 'none' END AS tag,
  CASE WHEN passes THEN rationale ELSE 'failed prefilter' END AS rationale, passes FROM swept),
labelled AS (
  SELECT items.*, coalesce(l.score, f.score) AS score, CASE WHEN l.id IS NULL THEN f.tag ELSE l.tag END AS tag,
    coalesce(l.rationale, f.rationale) AS rationale
  FROM items LEFT JOIN label_scores l USING (id) LEFT JOIN fresh f USING (id))"""
_LOG = f"""log AS (
  SELECT source || ': ' || 2 * count(*) || ' items' AS id, 2 * count(*) AS n FROM items GROUP BY source
  UNION ALL SELECT 'abstract backfill: ' || 2 * count(*) FILTER (doc_id % 30 = 0) || ' of ' || 2 * count(*) || ' filled',
    2 * count(*) FILTER (doc_id % 30 = 0) FROM items_raw
  WHERE source_type = 'paper' AND (doc_id % 30 = 0 OR {_blank('summary')})
  UNION ALL SELECT 'scoring: ' || count(*) FILTER (passes) || ' scored, ' || count(*) FILTER (NOT passes) || ' prefiltered, 0 deferred',
    count(*) FILTER (passes) FROM fresh)"""
# Stored items keep the summary they have; only new ones are filled.
_NEW = "doc_id NOT IN (SELECT doc_id FROM labels)"
_SQL["whole_sweep"] = _with(_ITEMS.replace(_SUMMARY, _SUMMARY.replace("CASE WHEN", f"{_FILLED.replace('THEN', f'AND {_NEW} THEN', 1)}WHEN", 1)),
                            _LABELS, _SCORED, _SWEPT, _DIGEST, _LOG) + f"""
SELECT 'new_items' AS part, id, length(summary)::INT AS score FROM items WHERE {_NEW}
UNION ALL SELECT 'run_log', id, n::INT FROM log
UNION ALL SELECT 'new_scores', id, score FROM fresh
UNION ALL (SELECT 'listing', id, score FROM labelled WHERE score >= 6 AND {_PUBLIC} AND {_since(f"{_AS_OF} - INTERVAL 14 DAY")}
  ORDER BY effective_at DESC, score DESC, id LIMIT 300)
UNION ALL (SELECT 'top_picks', id, score FROM labelled WHERE score >= 8 AND {_PUBLIC} AND {_since(f"{_AS_OF} - INTERVAL 48 HOUR")}
  ORDER BY score DESC, effective_at DESC, id LIMIT 8)
UNION ALL (SELECT 'shortlist', id, score FROM labelled WHERE score >= 6 AND source ILIKE 'library%' AND fetched_at >= {_AS_OF} - INTERVAL 10 DAY
  ORDER BY score DESC, effective_at DESC, id LIMIT 30)
UNION ALL SELECT 'digest_rows', id, score FROM digest
UNION ALL SELECT 'kept', id, score FROM labelled WHERE coalesce(score >= 6, false) OR {_since(f"{_AS_OF} - INTERVAL 10 DAY")}"""

# --- journals --------------------------------------------------------------------------

_JOURNALS = """journals AS (SELECT p_name AS name, CASE WHEN p_type <> 'SMALL' THEN p_brand ELSE '' END AS issn,
  p_size::BIGINT AS works, coalesce(p_type, '') AS publisher FROM part)"""
_AUDITED = ", ".join(f"({_lit(i)})" for i in a.AUDITED_ISSNS)
_SQL["watchlist_audit"] = _with(_JOURNALS, f"watch(issn) AS (VALUES {_AUDITED})") + """
, known AS (SELECT issn, name, works FROM journals QUALIFY row_number() OVER (PARTITION BY issn ORDER BY name, works) = 1)
SELECT issn, CASE WHEN name IS NULL THEN 'DEAD' ELSE 'ok' END AS status, coalesce(name, '?') AS name,
  coalesce(works, 0) AS works FROM watch LEFT JOIN known USING (issn)"""
_NAMES = ", ".join(f"({_lit(n)}, {_lit(' '.join(n.lower().split()))})" for n in a.LOOKUP_NAMES)
_SQL["journal_lookup"] = _with(_JOURNALS, f"asked(query, key) AS (VALUES {_NAMES})") + """
, words AS (SELECT query, key, unnest(string_split(key, ' ')) AS word FROM asked),
met AS (SELECT query, key, word, count(*) AS n FROM words JOIN journals
  ON list_contains(string_split(lower(name), ' '), word) GROUP BY ALL),
rare AS (SELECT query, key, word FROM met QUALIFY row_number() OVER (PARTITION BY query ORDER BY n, word) = 1),
candidates AS (SELECT query, name, issn, works, publisher, levenshtein(lower(name), key) AS distance FROM journals JOIN rare
  ON list_contains(string_split(lower(name), ' '), word)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, works DESC, name, issn, publisher) AS position FROM candidates),
best AS (SELECT * FROM ranked WHERE position <= 4 AND issn <> '')
SELECT query, CASE WHEN issn IS NULL THEN 'no match' ELSE 'match' END AS status, position, issn, name, works, publisher, distance
FROM asked LEFT JOIN best USING (query)"""

_SQL["misspelt_lookup"] = _with(_JOURNALS, """asked AS (
  SELECT DISTINCT substr(p_name, 1, (p_partkey // 100) % length(p_name)) || substr(p_name, (p_partkey // 100) % length(p_name) + 2) AS query
  FROM part WHERE p_partkey % 100 = 0)""") + """, hits AS (
  SELECT query, issn, name, works, publisher, levenshtein(lower(name), lower(query)) AS distance FROM journals, asked
  WHERE issn <> '' AND levenshtein(lower(name), lower(query)) <= 2)
SELECT query, CASE WHEN distance IS NULL THEN 'no match' ELSE 'match' END AS status, issn, name, works, publisher, distance
FROM asked LEFT JOIN hits USING (query)"""

# --- streaming -------------------------------------------------------------------------

_EVENT_ID = "sha1(user_id || '-' || event_type || '-' || ts::DATE)"
_SQL["stream_sweep"] = f"SELECT {_EVENT_ID} AS id, min(event_id) AS event_id, min(event_type) AS event_type FROM events GROUP BY 1"
_SQL["stream_dedupe"] = f"SELECT DISTINCT {_EVENT_ID} AS id FROM events"
_SQL["stream_daily"] = """
SELECT ts::DATE::VARCHAR AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"""
_SQL["stream_days"] = _SQL["stream_daily"]
_SQL["stream_sweep_indexed"] = f"SELECT {_EVENT_ID} AS id, 1::BIGINT AS n, min(event_type) AS event_type FROM events GROUP BY 1"
_SQL["stream_failures"] = _with(_RUNS) + _FAILING
