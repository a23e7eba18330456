"""DuckDB oracle SQL for the catalog keys (``plans/catalog.py``)."""

from __future__ import annotations

from .. import dims
from ..functions.text import sql_str
from .catalog import DISCOVER_LIMIT, HUB_LICENSE, REPO_HOST, SEARCH_LIMIT, TOP_N
from .packs_sql import KEYS, _ldo, _list, _nonnull, _plan_ctes

LIC_LINE = r"NULLIF(trim(regexp_extract(text, '(?m)^[^\n]*[Ll]icen[cs]e[^\n]*', 0)), '')"


def _risk(name: str, flag: str, variant: str) -> str:
    low = dims.RISK_LOW_HUB if variant == "hub" else dims.RISK_LOW_REPO
    med = dims.RISK_MEDIUM_HUB if variant == "hub" else dims.RISK_MEDIUM_REPO
    n = f"coalesce({name}, '')"
    return (f"CASE WHEN coalesce({flag}, false) THEN 'restricted' WHEN {n} = '' THEN 'unknown' "
            f"WHEN regexp_matches({n}, '(?i){dims.RISK_RESTRICTED}') THEN 'restricted' "
            f"WHEN regexp_matches({n}, '(?i){low}') THEN 'low' WHEN regexp_matches({n}, '(?i){med}') THEN 'medium' "
            "ELSE 'medium' END")


def _tagvals(tags: str, prefix: str) -> str:
    n = len(prefix)
    return (f"list_filter(list_transform(list_filter({tags}, lambda t: starts_with(t, '{prefix}')), "
            f"lambda t: substr(t, {n + 1})), lambda v: v <> '')")


def _kind(t: str) -> str:
    return (f"CASE WHEN regexp_matches(lower({t}), '(^|[^a-z0-9_])benchmark([^a-z0-9_]|$)') THEN 'benchmark' "
            f"WHEN regexp_matches(lower({t}), '(^|[^a-z0-9_])dataset') OR regexp_matches(lower({t}), 'corpus([^a-z0-9_]|$)') "
            "THEN 'dataset' ELSE 'repository' END")


def _tasks(t: str) -> str:
    items = ", ".join(f"CASE WHEN regexp_matches(lower({t}), {sql_str(p)}) THEN '{tag}' END" for tag, p in dims.REPO_TASK_RULES)
    lst = f"list_filter([{items}], lambda x: x IS NOT NULL)"
    return f"CASE WHEN len({lst}) = 0 THEN ['{dims.REPO_TASK_DEFAULT}'] ELSE {lst} END"


def _mods(t: str) -> str:
    items = ", ".join(f"CASE WHEN regexp_matches(lower({t}), {sql_str(p)}) THEN '{m}' END" for m, p in dims.MODALITY_RULES)
    return f"list_filter(['text', {items}], lambda x: x IS NOT NULL)"


HUB = f"""hub_items AS (
  SELECT page_id AS seq, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) || regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS id,
    contains(url, '?') AS gated, regexp_extract(html, '<title>([^<]*)</title>', 1) = '' AS disabled,
    NULLIF(trim(regexp_replace(html, '<[^>]*>', ' ', 'g')), '') AS description, CAST(length(html) AS BIGINT) AS downloads,
    regexp_extract(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '^([^.]+)', 1) AS author,
    CAST((length(html) - length(replace(html, '<a ', ''))) / 3 AS BIGINT) AS likes,
    list_filter(['language:' || regexp_extract(html, '<html lang="([^"]*)"', 1), 'format:html', 'modality:text',
      CASE WHEN regexp_extract(html, {sql_str(HUB_LICENSE)}, 1) <> '' THEN 'license:' || regexp_extract(html, {sql_str(HUB_LICENSE)}, 1) END,
      CASE WHEN contains(url, '/en/') THEN 'task_categories:question-answering' END,
      CASE WHEN contains(url, '#') THEN 'benchmark' END], lambda x: x IS NOT NULL) AS tags
  FROM pages),
hub AS (
  SELECT seq, id, 'hub' AS source, CASE WHEN list_contains(tags, 'benchmark') THEN 'benchmark' ELSE 'dataset' END AS record_kind,
    id AS title, description AS summary, {_tagvals('tags', 'license:')}[1] AS license_name,
    {_tagvals('tags', 'language:')} AS languages,
    list_concat({_tagvals('tags', 'task_categories:')}, CASE WHEN list_contains(tags, 'benchmark') THEN ['benchmark'] ELSE []::VARCHAR[] END) AS task_types,
    {_tagvals('tags', 'modality:')} AS modalities, {_tagvals('tags', 'format:')} AS file_formats,
    coalesce(downloads, 0) > 0 AS has_download, coalesce(description, '') <> '' AS has_samples,
    {_risk(_tagvals('tags', 'license:') + '[1]', 'gated', 'hub')} AS risk, tags,
    {sql_str(dims.HUB_PAGE)} || id AS source_url, downloads AS popularity, concat_ws(' ', id, coalesce(description, ''), array_to_string(tags, ' ')) AS words,
    CAST(to_json({{'author': author, 'likes': likes, 'downloads': downloads, 'createdAt': NULL, 'lastModified': NULL}}) AS VARCHAR) AS metadata,
    CAST(to_json({{'id': id, 'author': author, 'gated': gated, 'disabled': disabled, 'description': description, 'downloads': downloads,
      'likes': likes, 'created_at': NULL, 'last_modified': NULL, 'tags': tags}}) AS VARCHAR) AS raw
  FROM hub_items WHERE id IS NOT NULL AND id <> '' AND NOT coalesce(disabled, false))"""

REPO = f"""repo_items AS (
  SELECT doc_id AS seq, CAST(doc_id AS VARCHAR) AS id, source || '/doc-' || CAST(doc_id AS VARCHAR) AS full_name,
    {sql_str(REPO_HOST)} || source || '/doc-' || CAST(doc_id AS VARCHAR) AS html_url,
    text AS description, [lower(lang), lower(source)] AS topics, [lang, source] AS given_topics, lang AS language,
    lang = 'es' AS private, CASE WHEN lang = 'es' THEN 'private' ELSE 'public' END AS visibility, {LIC_LINE} AS spdx_id, CAST(n_chars AS BIGINT) AS stars
  FROM documents),
repo0 AS (SELECT *, concat_ws(' ', full_name, coalesce(description, ''), array_to_string(topics, ' ')) AS rtext,
    CASE WHEN trim(coalesce(spdx_id, '')) <> '' THEN trim(spdx_id) END AS lic FROM repo_items),
repo AS (
  SELECT seq, id, 'repo' AS source, {_kind('rtext')} AS record_kind, full_name AS title, description AS summary,
    lic AS license_name, CASE WHEN language IS NOT NULL THEN [lower(language)] ELSE []::VARCHAR[] END AS languages,
    {_tasks('rtext')} AS task_types, {_mods('rtext')} AS modalities, true AS has_download,
    coalesce(description, '') <> '' AS has_samples, {_risk('lic', 'private', 'repo')} AS risk, topics AS tags,
    []::VARCHAR[] AS file_formats, html_url AS source_url, stars AS popularity, rtext AS words,
    CAST(to_json({{'topics': topics, 'stars': coalesce(stars, 0), 'visibility': visibility}}) AS VARCHAR) AS metadata,
    CAST(to_json({{'id': CAST(id AS BIGINT), 'full_name': full_name, 'html_url': html_url, 'description': description, 'topics': given_topics,
      'language': language, 'private': private, 'visibility': visibility, 'spdx_id': spdx_id, 'stars': stars}}) AS VARCHAR) AS raw
  FROM repo0)"""


def _cand_profile() -> str:
    text = "lower(concat_ws(' ', id, title, coalesce(summary, ''), coalesce(license_name, ''), array_to_string(tags, ' ')))"
    sig = []
    for key, _w, _f, pat in dims.SIGNALS:
        if key == "metadata":
            sig.append("true AS s_metadata")
        elif key == "license":
            sig.append("coalesce(license_name <> '', false) AS s_license")
        elif pat:
            sig.append(f"regexp_matches(ctext, {sql_str(pat)}) AS s_{key}")
        else:
            sig.append(f"false AS s_{key}")
    total = " + ".join(f"CASE WHEN s_{k} THEN CAST({w} AS DECIMAL(10,4)) * CAST({dims.CONFIDENCE_METADATA_ONLY} AS DECIMAL(10,4)) ELSE 0 END"
                       for k, w, _f, _p in dims.SIGNALS)
    lvl = "CASE"
    for level, minimum, req in dims.READINESS_RULES:
        lvl += " WHEN " + " AND ".join([f"completeness >= {minimum}"] + [f"s_{r}" for r in req]) + f" THEN {level}"
    lvl += " ELSE 1 END"
    return (f"cp0 AS (SELECT seq AS page_id, {', '.join(sig)} FROM (SELECT *, {text} AS ctext FROM hub) h),\n"
            f"cp1 AS (SELECT *, CAST(least(greatest(round({total}, 4), 0), 1) AS DECIMAL(10,4)) AS completeness FROM cp0),\n"
            f"cp AS (SELECT page_id, CAST({lvl} AS INTEGER) AS readiness_level, CAST(completeness AS DOUBLE) AS completeness FROM cp1)")


def queries() -> dict[str, str]:
    q = {}
    q["catalog_normalize_hub"] = f"""WITH {HUB}
SELECT seq AS page_id, id, record_kind, license_name, risk, array_to_string(languages, ',') AS languages,
  array_to_string(task_types, ',') AS task_types, array_to_string(modalities, ',') AS modalities,
  array_to_string(file_formats, ',') AS file_formats, has_download, has_samples FROM hub"""
    q["catalog_normalize_repo"] = f"""WITH {REPO}
SELECT seq AS doc_id, id, title, record_kind, license_name, risk, array_to_string(languages, ',') AS languages,
  array_to_string(task_types, ',') AS task_types, array_to_string(modalities, ',') AS modalities, has_samples FROM repo"""
    q["license_risk_hub"] = (f"SELECT doc_id, license_name, {_risk('license_name', 'gated', 'hub')} AS risk FROM "
                             f"(SELECT doc_id, {LIC_LINE} AS license_name, lang = 'es' AS gated FROM documents) d")
    q["license_risk_repo"] = (f"SELECT doc_id, license_name, {_risk('license_name', 'private', 'repo')} AS risk FROM "
                              f"(SELECT doc_id, {LIC_LINE} AS license_name, lang = 'es' AS private FROM documents) d")
    q["record_kind"] = f"SELECT doc_id, {_kind('text')} AS record_kind FROM documents"
    q["task_tags"] = f"SELECT doc_id, array_to_string({_tasks('text')}, ',') AS tags FROM documents"
    q["modality_tags"] = f"SELECT doc_id, array_to_string({_mods('text')}, ',') AS modalities FROM documents"
    q["prefixed_tags"] = f"""WITH {HUB}
SELECT seq AS page_id, array_to_string({_tagvals('tags', 'language:')}, ',') AS languages,
  array_to_string({_tagvals('tags', 'format:')}, ',') AS formats, {_tagvals('tags', 'license:')}[1] AS license_name FROM hub_items"""
    stop = "[" + ", ".join(sql_str(w) for w in dims.QUERY_STOPWORDS) + "]"
    variants = _ldo("list_filter([norm, stripped, first2], lambda v: trim(v) <> '')")
    q["query_variants"] = f"""SELECT item_id, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS pos, unnest(v) AS variant FROM (
  SELECT item_id, {variants} AS v FROM (
    SELECT item_id, norm, array_to_string(list_filter(toks, lambda t: NOT list_contains({stop}, lower(t))), ' ') AS stripped,
      array_to_string(toks[1:2], ' ') AS first2 FROM (
      SELECT item_id, norm, list_filter(string_split(norm, ' '), lambda x: x <> '') AS toks FROM (
        SELECT item_id, regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ | $', '', 'g') AS norm FROM benchmark) a) b) c) d"""
    q["union_sources"] = f"""WITH {HUB}, {REPO}
SELECT source, seq, id, record_kind, license_name, risk FROM hub UNION ALL SELECT source, seq, id, record_kind, license_name, risk FROM repo"""
    q["catalog_dedupe"] = f"""WITH {REPO}
SELECT key, min(seq) AS position, max(seq) AS last_seq, arg_max(title, seq) AS title, arg_max(record_kind, seq) AS record_kind
FROM (SELECT 'repo:' || languages[1] || '/' || tags[2] AS key, * FROM repo) r GROUP BY key"""
    q["catalog_topk"] = f"""WITH {HUB}, {_cand_profile()}
SELECT page_id, readiness_level, completeness FROM cp ORDER BY readiness_level DESC, completeness DESC, page_id LIMIT {TOP_N}"""
    q["fallback_search"] = f"""WITH v AS (
  SELECT item_id, CAST(generate_subscripts(v, 1) AS INTEGER) AS k, unnest(v) AS variant FROM (
    SELECT item_id, {variants} AS v FROM (
      SELECT item_id, norm, array_to_string(list_filter(toks, lambda t: NOT list_contains({stop}, lower(t))), ' ') AS stripped,
        array_to_string(toks[1:2], ' ') AS first2 FROM (
        SELECT item_id, norm, list_filter(string_split(norm, ' '), lambda x: x <> '') AS toks FROM (
          SELECT item_id, regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ | $', '', 'g') AS norm FROM benchmark) a) b) c) d),
vt AS (SELECT item_id, k, list_distinct(regexp_extract_all(lower(variant), '[a-z0-9]+')) AS vt FROM v),
dt AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS dt FROM documents),
hits AS (SELECT * FROM (SELECT vt.item_id, vt.k, dt.doc_id, row_number() OVER (PARTITION BY vt.item_id, vt.k ORDER BY dt.doc_id) AS r
  FROM vt JOIN dt ON list_has_all(dt.dt, vt.vt)) x WHERE r <= {SEARCH_LIMIT}),
firsts AS (SELECT item_id, doc_id, min(k) AS first_k, arg_min(r, k) AS first_r FROM hits GROUP BY item_id, doc_id),
ran AS (SELECT v.item_id, v.k FROM v WHERE (SELECT count(*) FROM firsts f WHERE f.item_id = v.item_id AND f.first_k < v.k) < {SEARCH_LIMIT})
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(first_k AS INTEGER) AS variant_k FROM (
  SELECT f.*, row_number() OVER (PARTITION BY f.item_id ORDER BY f.first_k, f.first_r) AS rank
  FROM firsts f JOIN ran ON f.item_id = ran.item_id AND f.first_k = ran.k) y WHERE rank <= {SEARCH_LIMIT}"""
    q["discover"] = _discover_sql(variants, stop)
    q["candidate_domains"] = _candidate_domains_sql()
    q["catalog_industry"] = _catalog_industry_sql()
    quota = max(1, -(-TOP_N // 2))
    q["source_quota"] = f"""WITH {HUB}, {REPO}
SELECT source, CAST(rank AS INTEGER) AS rank, seq, id FROM (
  SELECT source, seq, id, row_number() OVER (PARTITION BY source ORDER BY seq) AS rank FROM (
    SELECT source, seq, id FROM hub UNION ALL SELECT source, seq, id FROM repo) u) r WHERE rank <= {quota}"""
    return q


def _candidate_domains_sql() -> str:
    from ..operators.industry import keyword_rows
    from .packs import TAXONOMY
    rows = keyword_rows(TAXONOMY)
    ids = ", ".join(f"CASE WHEN regexp_matches(lower(raw), {sql_str(r[4])}) THEN {r[0]} END" for r in rows)
    kw = ", ".join(f"({r[0]}, {sql_str(r[1])}, {sql_str(r[2])}, {sql_str(r[3])})" for r in rows)
    return f"""WITH {HUB}, {REPO},
ctext AS (
  SELECT 'hub:' || CAST(seq AS VARCHAR) AS pack, concat_ws(' ', id, coalesce(description, ''), array_to_string(tags, ' ')) AS raw FROM hub_items
  UNION ALL SELECT 'repo:' || CAST(seq AS VARCHAR), concat_ws(' ', full_name, coalesce(description, ''), array_to_string(topics, ' ')) FROM repo_items),
kwdim(kw_id, slug, kind, keyword) AS (VALUES {kw}),
hits AS (SELECT DISTINCT pack, unnest(list_filter([{ids}], lambda x: x IS NOT NULL)) AS kw_id FROM ctext),
m AS (SELECT h.pack, d.* FROM hits h JOIN kwdim d ON h.kw_id = d.kw_id),
scores AS (SELECT * FROM (SELECT pack, slug, CAST(least(greatest(round(least(0.45, n_keywords * CAST(0.11 AS DECIMAL(10,4)))
    + least(0.10, n_workflows * CAST(0.05 AS DECIMAL(10,4))), 4), 0), 1) AS DECIMAL(10,4)) AS confidence FROM (
  SELECT pack, slug, count(DISTINCT CASE WHEN kind = 'keyword' THEN keyword END) AS n_keywords,
    count(DISTINCT CASE WHEN kind = 'workflow' THEN keyword END) AS n_workflows FROM m GROUP BY pack, slug) c) s WHERE confidence > 0),
top AS (SELECT pack, rank, slug FROM (SELECT pack, slug, row_number() OVER (PARTITION BY pack ORDER BY confidence DESC, slug) AS rank
  FROM scores) r WHERE rank <= 3
  UNION ALL SELECT pack, 1, 'general' FROM ctext WHERE pack NOT IN (SELECT pack FROM scores)),
lists AS (SELECT pack, list(slug ORDER BY rank) AS slugs FROM top GROUP BY pack)
SELECT pack, array_to_string(CASE WHEN len(list_filter(slugs, lambda s: s <> 'general')) > 0
  THEN list_filter(slugs, lambda s: s <> 'general') ELSE slugs END, ',') AS domains FROM lists"""


def _scores_sql(src: str, name: str, explicit: str | None = None) -> str:
    """CTEs ``{name}_hits/_m/_scores/_top`` over ``src(pack, raw)``."""
    from ..operators.industry import keyword_rows
    from .packs import TAXONOMY
    rows = keyword_rows(TAXONOMY)
    ids = ", ".join(f"CASE WHEN regexp_matches(lower(raw), {sql_str(r[4])}) THEN {r[0]} END" for r in rows)
    kw = ", ".join(f"({r[0]}, {sql_str(r[1])}, {sql_str(r[2])}, {sql_str(r[3])})" for r in rows)
    ex = (f"UNION ALL SELECT pack, slug, 0, 0, true FROM {explicit}" if explicit else "")
    return f"""{name}_kw(kw_id, slug, kind, keyword) AS (VALUES {kw}),
{name}_hits AS (SELECT DISTINCT pack, unnest(list_filter([{ids}], lambda x: x IS NOT NULL)) AS kw_id FROM {src}),
{name}_m AS (SELECT h.pack, d.* FROM {name}_hits h JOIN {name}_kw d ON h.kw_id = d.kw_id),
{name}_c AS (SELECT pack, slug, max(n_keywords) AS n_keywords, max(n_workflows) AS n_workflows, bool_or(ex) AS ex FROM (
  SELECT pack, slug, count(DISTINCT CASE WHEN kind = 'keyword' THEN keyword END) AS n_keywords,
    count(DISTINCT CASE WHEN kind = 'workflow' THEN keyword END) AS n_workflows, false AS ex FROM {name}_m GROUP BY pack, slug
  {ex}) u GROUP BY pack, slug),
{name}_scores AS (SELECT * FROM (SELECT pack, slug, CAST(least(greatest(round(CASE WHEN ex THEN 0.45 ELSE 0 END
    + least(0.45, n_keywords * CAST(0.11 AS DECIMAL(10,4))) + least(0.10, n_workflows * CAST(0.05 AS DECIMAL(10,4))), 4), 0), 1)
    AS DECIMAL(10,4)) AS confidence FROM {name}_c) s WHERE confidence > 0),
{name}_top AS (SELECT pack, rank, slug, confidence FROM (SELECT pack, slug, confidence,
    row_number() OVER (PARTITION BY pack ORDER BY confidence DESC, slug) AS rank FROM {name}_scores) r WHERE rank <= 3
  UNION ALL SELECT pack, 1, 'general', CAST(0.2 AS DECIMAL(10,4)) FROM {src} WHERE pack NOT IN (SELECT pack FROM {name}_scores))"""


def _catalog_industry_sql() -> str:
    return f"""WITH {HUB},
t1 AS (SELECT CAST(seq AS VARCHAR) AS pack, concat_ws(' ', id, coalesce(description, ''), array_to_string(tags, ' ')) AS raw FROM hub_items),
{_scores_sql('t1', 'p1')},
dom AS (SELECT pack, CASE WHEN len(list_filter(slugs, lambda s: s <> 'general')) > 0 THEN list_filter(slugs, lambda s: s <> 'general')
  ELSE slugs END AS domains FROM (SELECT pack, list(slug ORDER BY rank) AS slugs FROM p1_top GROUP BY pack) l),
t2 AS (SELECT CAST(h.seq AS VARCHAR) AS pack, h.seq, d.domains, concat_ws(' ', h.title, coalesce(h.summary, ''), array_to_string(d.domains, ' '),
    array_to_string(h.task_types, ' '), array_to_string(h.modalities, ' '),
    to_json({{'author': i.author, 'downloads': i.downloads}})) AS raw
  FROM hub h JOIN dom d ON CAST(h.seq AS VARCHAR) = d.pack
  JOIN (SELECT page_id AS seq, regexp_extract(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '^([^.]+)', 1) AS author,
        CAST(length(html) AS BIGINT) AS downloads FROM pages) i ON h.seq = i.seq),
ex AS (SELECT DISTINCT pack, unnest(domains) AS slug FROM t2),
{_scores_sql('t2', 'p2', 'ex')}
SELECT t2.seq AS page_id, array_to_string(t2.domains, ',') AS domains, p.slug AS primary_industry,
  CAST(p.confidence AS DOUBLE) AS confidence, (p.slug <> 'general' AND p.confidence >= 0.3) AS is_industry_specific
FROM t2 JOIN p2_top p ON t2.pack = p.pack AND p.rank = 1"""


def _discover_sql(variants: str, stop: str) -> str:
    per_source = max(1, -(-DISCOVER_LIMIT // 2))
    cols = ("source, seq, id, title, summary, source_url, license_name, languages, task_types, modalities, file_formats, "
            "has_download, has_samples, record_kind, risk, popularity, words, metadata, raw")
    sig = []
    for key, _w, _f, pat in dims.SIGNALS:
        if key == "metadata":
            sig.append("true AS s_metadata")
        elif key == "license":
            sig.append("coalesce(license_name <> '', false) AS s_license")
        else:
            sig.append(f"regexp_matches(ctext, {sql_str(pat)}) AS s_{key}")
    casc = f"CASE WHEN list_contains(task_types, '{dims.RAG_TASK_TAG}')"
    for name, pat in dims.TASK_TYPE_RULES:
        casc += (" OR " if name == "rag_qa" else " WHEN ") + f"regexp_matches(ctext, {sql_str(pat)}) THEN '{name}'"
    total = " + ".join(f"CASE WHEN s_{k} THEN CAST({w} AS DECIMAL(10,4)) * CAST({dims.CONFIDENCE_METADATA_ONLY} AS DECIMAL(10,4)) ELSE 0 END"
                       for k, w, _f, _p in dims.SIGNALS)
    lvl = "CASE"
    for level, minimum, req in dims.READINESS_RULES:
        lvl += " WHEN " + " AND ".join([f"completeness >= {minimum}"] + [f"s_{r}" for r in req]) + f" THEN {level}"
    lvl += " ELSE 1 END"
    missing = _nonnull([f"CASE WHEN NOT s_{k} THEN '{k}' END" for k in KEYS])
    crit = _nonnull([f"CASE WHEN NOT s_{k} THEN '{k}' END" for k in KEYS if k in dims.CRITICAL_SIGNALS])
    from .packs import TAXONOMY
    tax = ", ".join(f"({sql_str(s)}, {_list(wf)})" for s, _l, _k, wf in TAXONOMY)
    return f"""WITH {HUB}, {REPO},
allc AS (SELECT 0 AS so, {cols} FROM hub UNION ALL SELECT 1, {cols} FROM repo),
known AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY so, id ORDER BY seq DESC) AS rn, min(seq) OVER (PARTITION BY so, id) AS position
  FROM allc) a WHERE rn = 1),
v AS (SELECT item_id, CAST(generate_subscripts(v, 1) AS INTEGER) AS k, unnest(v) AS variant FROM (
  SELECT item_id, {variants} AS v FROM (
    SELECT item_id, norm, array_to_string(list_filter(toks, lambda t: NOT list_contains({stop}, lower(t))), ' ') AS stripped,
      array_to_string(toks[1:2], ' ') AS first2 FROM (
      SELECT item_id, norm, list_filter(string_split(norm, ' '), lambda x: x <> '') AS toks FROM (
        SELECT item_id, regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ | $', '', 'g') AS norm FROM benchmark) a) b) c) d),
vt AS (SELECT item_id, k, list_distinct(regexp_extract_all(lower(variant), '[a-z0-9]+')) AS vt FROM v),
dt AS (SELECT so, id, popularity, position, list_distinct(regexp_extract_all(lower(words), '[a-z0-9]+')) AS dt FROM known),
found AS (SELECT * FROM (SELECT vt.item_id, vt.k, so, id, row_number() OVER (PARTITION BY vt.item_id, vt.k, so ORDER BY popularity DESC, position) AS r
  FROM vt JOIN dt ON list_has_all(dt.dt, vt.vt)) x WHERE r <= {per_source}),
firsts AS (SELECT item_id, so, id, min(k) AS first_k, arg_min(r, k) AS first_r FROM found GROUP BY item_id, so, id),
kept AS (SELECT * FROM (SELECT f.*, row_number() OVER (PARTITION BY item_id, so ORDER BY first_k, first_r) AS found_rank FROM firsts f
  WHERE (SELECT count(*) FROM firsts g WHERE g.item_id = f.item_id AND g.so = f.so AND g.first_k < f.first_k) < {per_source}) y WHERE found_rank <= {per_source}),
met AS (SELECT source || ':' || id AS cpack, * FROM known WHERE (so, id) IN (SELECT (so, id) FROM kept)),
t1 AS (SELECT cpack AS pack, words AS raw FROM met),
{_scores_sql('t1', 'p1')},
dom AS (SELECT pack, CASE WHEN len(list_filter(slugs, lambda s: s <> 'general')) > 0 THEN list_filter(slugs, lambda s: s <> 'general')
  ELSE slugs END AS domains FROM (SELECT pack, list(slug ORDER BY rank) AS slugs FROM p1_top GROUP BY pack) l),
ctext AS (SELECT m.*, domains, lower(raw || metadata || CAST(to_json({{'id': id, 'source': source, 'recordKind': record_kind, 'title': title,
    'summary': summary, 'sourceUrl': source_url, 'downloadUrl': '', 'licenseName': license_name, 'languages': languages, 'taskTypes': task_types,
    'modalities': modalities, 'domains': domains, 'fileFormats': file_formats, 'hasDownload': has_download, 'hasSamples': has_samples,
    'commercialRisk': risk, 'redistributionRisk': risk, 'rawPayload': '', 'metadata': ''}}) AS VARCHAR)
    || CASE WHEN so = 0 THEN {sql_str(dims.HUB_CARD)} ELSE {sql_str(dims.REPO_ARCHIVE)} END) AS ctext FROM met m JOIN dom ON m.cpack = dom.pack),
c0 AS (SELECT *, {', '.join(sig)}, {casc} ELSE 'custom' END AS task_type FROM ctext),
c1 AS (SELECT *, CAST(least(greatest(round({total}, 4), 0), 1) AS DECIMAL(10,4)) AS completeness, {missing} AS missing, {crit} AS missing_critical FROM c0),
c2 AS (SELECT *, {lvl} AS readiness_level FROM c1),
pairs AS (SELECT k.item_id || '|' || c.cpack AS pack, k.item_id, k.found_rank, c.*, b.text AS query FROM kept k JOIN c2 c ON k.so = c.so AND k.id = c.id
  JOIN benchmark b ON b.item_id = k.item_id),
t2 AS (SELECT pack, concat_ws(' ', query, nullif(title, ''), nullif(summary, ''), nullif(source_url, ''), nullif(array_to_string(domains, ' '), ''),
  nullif(array_to_string(task_types, ' '), ''), nullif(array_to_string(modalities, ' '), ''), metadata) AS raw FROM pairs),
ex AS (SELECT DISTINCT pack, unnest(domains) AS slug FROM pairs),
{_scores_sql('t2', 'p2', 'ex')},
prof AS (SELECT * FROM pairs),
tax(slug, workflows) AS (VALUES {tax}),
indp AS (SELECT t.pack, t.slug AS primary_industry, t.confidence, (t.slug <> 'general' AND t.confidence >= 0.3) AS is_industry_specific,
  tax.workflows[1:3] AS workflow_focus FROM p2_top t LEFT JOIN tax ON t.slug = tax.slug WHERE t.rank = 1),
words AS (SELECT pack, slug, string_agg(keyword, ',' ORDER BY kw_id) AS words FROM (
  SELECT pack, slug, keyword, min(kw_id) AS kw_id FROM p2_m GROUP BY pack, slug, keyword) w GROUP BY pack, slug),
industries AS (SELECT pack, string_agg(slug, ',' ORDER BY rank) AS industries FROM p2_top GROUP BY pack),
{_plan_ctes()},
told AS (SELECT pack, string_agg(step_id || ':' || array_to_string(inputs, '+') || '>' || array_to_string(outputs, '+'), ',' ORDER BY ordinal) AS steps
  FROM steps GROUP BY pack)
SELECT * FROM (
  SELECT p.item_id, CAST(row_number() OVER (PARTITION BY p.item_id ORDER BY p.readiness_level DESC, p.completeness DESC, p.so, p.found_rank) AS INTEGER) AS rank,
    p.source, p.id, p.title, p.source_url, p.risk, array_to_string(p.domains, ',') AS domains, CAST(p.completeness AS DOUBLE) AS completeness,
    CAST(p.readiness_level AS INTEGER) AS readiness_level, p.task_type, array_to_string(p.missing, ',') AS missing, i.primary_industry,
    CAST(i.confidence AS DOUBLE) AS confidence, coalesce(w.words, '') AS matched_keywords, i.is_industry_specific, n.industries,
    t.current_tier, t.target_tier, l.lift, array_to_string(i.workflow_focus, ',') AS workflow_focus, s.steps, array_to_string(e.risks, ' | ') AS risks
  FROM pairs p JOIN indp i ON p.pack = i.pack JOIN tiers t ON p.pack = t.pack JOIN lift l ON p.pack = l.pack JOIN extra e ON p.pack = e.pack
  JOIN industries n ON p.pack = n.pack JOIN told s ON p.pack = s.pack LEFT JOIN words w ON w.pack = p.pack AND w.slug = i.primary_industry) z
WHERE rank <= {DISCOVER_LIMIT}"""
