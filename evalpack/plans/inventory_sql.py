"""DuckDB oracle SQL for the inventory and rubric keys (``plans/inventory.py``)."""

from __future__ import annotations

from .. import dims
from ..functions.text import sql_str
from .inventory import CAPABILITIES, CASE_FIELDS, DIGESTED, STRONG_FROM, URL_WORKFLOW_DEFAULT, URL_WORKFLOW_RULES
from .packs_sql import _industry_ctes, _with

LIC = r"NULLIF(trim(regexp_extract(text, '(?m)^[^\n]*[Ll]icen[cs]e[^\n]*', 0)), '')"

DOCS = f"""docs AS (SELECT *, {LIC} AS lic, TRY_CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) AS p FROM documents)"""


def _has(field: str) -> str:
    return f"coalesce({CASE_FIELDS[field]}, false)"


CASEF = f"""{DOCS},
casef AS (SELECT doc_id, source AS pack, lang, n_chars, lic, CASE WHEN {_has('metadata')} THEN lang END AS workflow,
  CASE WHEN {_has('metadata')} THEN lic END AS meta_lic, CASE WHEN {_has('metadata')} THEN 'landed' END AS prov,
  {', '.join(f'{_has(f)} AS f_{f}' for f in ['input', 'context', 'expected', 'rubric', 'checker', 'trace', 'environment', 'metadata'])}
  FROM docs)"""


def _keep(field: str, value: str) -> str:
    return f"CASE WHEN {_has(field)} THEN {value} END"


#: The same cases as JSON; a merge with an empty object leaves out what is null.
JSON_CASES = f"""{DOCS},
cases AS (SELECT pack, seq, raw, NULLIF(trim(coalesce(json_extract_string(raw, '$.licenseName'), json_extract_string(raw, '$.license'),
    json_extract_string(raw, '$.metadata.licenseName'), json_extract_string(raw, '$.metadata.license'))), '') AS license FROM (
  SELECT source AS pack, doc_id AS seq, CAST(json_merge_patch('{{}}', to_json({{
    'caseId': 'doc-' || doc_id, 'taskType': {_keep('taskType', "CASE WHEN n_chars > 1000 THEN 'rag_qa' ELSE 'planning' END")},
    'instruction': {_keep('instruction', "'Answer.'")}, 'input': {_keep('input', 'body')}, 'body': CASE WHEN NOT {_has('input')} THEN body END,
    'messages': {_keep('messages', "[{'role': 'user'}]")}, 'context': {_keep('context', '[lang]')},
    'expected': {_keep('expected', "{'answer': n_chars}")}, 'acceptanceCriteria': {_keep('acceptanceCriteria', "['short']")},
    'rubric': {_keep('rubric', "{'pass': lic}")},
    'checker': {_keep('checker', "{'type': CASE WHEN lang = 'de' THEN 'regex_match' ELSE 'json_subset' END}")},
    'trace': {_keep('trace', "['search']")}, 'environment': {_keep('environment', "{'big': true}")}, 'license': {_keep('license', 'lic')},
    'metadata': {_keep('metadata', "{'workflow': lang, 'licenseName': lic, 'provenance': 'landed', 'split': "
                       + _keep('split', "CASE WHEN n_chars > 1000 THEN 'test' ELSE 'train' END") + "}")}}})) AS VARCHAR) AS raw FROM (SELECT *, CASE WHEN {DIGESTED} THEN sha256(text) ELSE text END AS body FROM docs) b) j)"""
FIELDS = ["input", "context", "expected", "rubric", "checker", "trace", "environment", "metadata"]


def _present(prefix: str = "") -> str:
    items = ", ".join(f"CASE WHEN {prefix}f_{f} THEN '{f}' END" for f in FIELDS)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


COVER = f"""cover AS (SELECT pack, {_present()} AS fields, CAST(round(len({_present()}) * 100.0 / 8) AS INTEGER) AS coverage FROM (
  SELECT pack, {', '.join(f'bool_or(f_{f}) AS f_{f}' for f in FIELDS)} FROM casef GROUP BY pack) g)"""


def _first_seen(col: str, name: str) -> str:
    return (f"{name} AS (SELECT pack, list(v ORDER BY s) AS vals FROM (SELECT pack, {col} AS v, min(doc_id) AS s FROM casef "
            f"WHERE {col} IS NOT NULL GROUP BY pack, {col}) x GROUP BY pack)")


ASSETS = f"""{CASEF}, {COVER}, {_first_seen('workflow', 'wf')}, {_first_seen('meta_lic', 'li')}, {_first_seen('prov', 'pr')},
assets AS (SELECT c.pack, c.records, c.position, c.domain, v.fields, v.coverage, wf.vals AS workflows, li.vals AS licenses, pr.vals AS provenances,
  CASE WHEN v.coverage >= 50 THEN 'Benchmark JSONL' ELSE 'JSONL' END AS type
  FROM (SELECT pack, count(*) AS records, min(doc_id) AS position, arg_min(lang, doc_id) AS domain FROM casef GROUP BY pack) c
  JOIN cover v ON c.pack = v.pack LEFT JOIN wf ON c.pack = wf.pack LEFT JOIN li ON c.pack = li.pack
  LEFT JOIN pr ON c.pack = pr.pack)"""


def _joined_or(x: str, default: str) -> str:
    return f"CASE WHEN len(coalesce({x}, []::VARCHAR[])) > 0 THEN array_to_string({x}, ', ') ELSE '{default}' END"


def queries() -> dict[str, str]:
    q = {}
    q["field_presence"] = f"WITH {CASEF}\nSELECT doc_id, array_to_string({_present()}, ',') AS fields FROM casef"
    q["field_coverage"] = f"WITH {CASEF}, {COVER}\nSELECT pack, array_to_string(fields, ',') AS fields, coverage FROM cover"
    q["asset_summary"] = f"""WITH {ASSETS}
SELECT pack, records, array_to_string(fields, ',') AS fields, {_joined_or('workflows', 'unknown')} AS workflows,
  {_joined_or('licenses', 'unknown')} AS license, {_joined_or('provenances', 'unknown')} AS provenance, coverage, type FROM assets"""
    q["portfolio_totals"] = f"""WITH {ASSETS}
SELECT sum(records) AS records, count(DISTINCT domain) AS active_domains,
  (SELECT count(DISTINCT w) FROM (SELECT unnest(workflows) AS w FROM assets) x) AS workflows,
  coalesce(CAST(round(avg(coverage)) AS INTEGER), 0) AS avg_coverage, count(*) AS assets FROM assets"""
    q["facet_counts"] = f"""WITH {ASSETS}
SELECT 'domain' AS facet, domain AS value, min(position) AS first_position, count(*) AS assets FROM assets GROUP BY domain
UNION ALL SELECT 'type', type, min(position), count(*) FROM assets GROUP BY type"""
    q["preview_top5"] = """SELECT pack, CAST(rank AS INTEGER) AS rank, doc_id,
  CASE WHEN length(text) > 120 THEN substring(text, 1, 120) || '...' ELSE text END AS text_preview, lang, n_chars FROM (
  SELECT source AS pack, doc_id, text, lang, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents) r
WHERE rank <= 5"""
    q["json_field_or_default"] = (f"WITH {CASEF}\nSELECT doc_id, CASE WHEN f_checker THEN CASE lang WHEN 'de' THEN 'regex_match' "
                                  "ELSE 'json_subset' END ELSE 'unknown' END AS checker_type FROM casef")
    q["slugify"] = """SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9_]+', '-', 'g'), '-$', '') AS slug,
  array_to_string(list_transform(string_split_regex(regexp_replace(regexp_extract(url, '/([^/?#]*)(?:[?#].*)?$', 1), '\\.[^./]*$', ''), '[-_]'),
    lambda p: upper(substr(p, 1, 1)) || substr(p, 2)), ' ') AS name FROM pages"""
    q["facet_search"] = ("SELECT doc_id FROM documents WHERE lang = 'en' AND contains(lower(to_json({'doc_id': doc_id, "
                         "'text': text, 'lang': lang, 'source': source, 'n_chars': n_chars})), 'license')")
    case = "CASE " + " ".join(
        f"WHEN contains(url, {sql_str(sub)}) THEN {sql_str(','.join(labels))}" for sub, labels in URL_WORKFLOW_RULES) \
        + f" ELSE {sql_str(','.join(URL_WORKFLOW_DEFAULT))} END"
    q["workflow_labels"] = f"SELECT page_id, {case} AS labels FROM pages"
    toks = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))"
    q["token_sets"] = f"SELECT doc_id, len({toks}) AS n_tokens, array_to_string(list_sort({toks}), ' ') AS tokens FROM documents"
    q["live_domains"] = _with(_industry_ctes()) + (
        "SELECT t.slug, t.label, coalesce(t.slug IN (SELECT primary_industry FROM indp), false) AS live FROM taxdim t")
    q["coverage_matrix"] = """SELECT source, lang, documents, CASE WHEN documents >= 15 THEN 'strong' ELSE 'weak' END AS strength,
  count(lang) OVER (PARTITION BY source) AS covered
FROM (SELECT source, lang, count(*) AS documents FROM documents GROUP BY source, lang) c"""
    caps = ", ".join(f"('{c}', '{f}', {str(x).lower()})" for c, f, x in CAPABILITIES)
    q["capability_grid"] = f"""WITH caps(capability, family, cross_cutting) AS (VALUES {caps}),
marks AS (SELECT source AS task, 'lang-' || lang AS capability FROM documents UNION ALL SELECT source, 'license-notice' FROM documents WHERE {LIC} IS NOT NULL
  UNION ALL SELECT source, 'long-text' FROM documents WHERE n_chars > 5000 UNION ALL SELECT source, 'very-short' FROM documents WHERE n_chars < 20
  UNION ALL SELECT source, 'self-correction' FROM documents),
sums AS (SELECT task, capability, count(*) AS evidence FROM marks GROUP BY task, capability),
grid AS (SELECT t.task, c.capability, c.family, CASE WHEN cross_cutting THEN 'cross-cutting' WHEN evidence >= {STRONG_FROM} THEN 'strong'
    WHEN evidence > 0 THEN 'weak' ELSE 'none' END AS cell, coalesce(evidence, 0) AS evidence
  FROM (SELECT DISTINCT source AS task FROM documents) t CROSS JOIN caps c LEFT JOIN sums s ON s.task = t.task AND s.capability = c.capability)
SELECT *, count(*) FILTER (WHERE cell IN ('strong', 'weak')) OVER (PARTITION BY task) AS task_covered,
  (SELECT count(DISTINCT capability) FROM grid WHERE cell IN ('strong', 'weak')) AS grid_covered FROM grid"""
    score = "(2.0 * CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END + 1.0 * CASE WHEN toxic = 0 THEN 1.0 ELSE 0.5 END) / 3.0"
    tier = "CASE " + " ".join(f"WHEN score >= {m} THEN '{t}'" for t, m in dims.SCORE_TIERS) + f" ELSE '{dims.SCORE_TIER_DEFAULT}' END"
    q["rubric_score"] = f"SELECT doc_id, {score} AS score FROM labels"
    q["rubric_tier"] = f"SELECT doc_id, score, {tier} AS tier FROM (SELECT doc_id, {score} AS score FROM labels) s"
    q["scan_json_lines"] = """SELECT event_id, json_valid(raw) AS ok, CASE WHEN json_valid(raw) THEN CAST(json_extract(raw, '$.k') AS BIGINT) END AS k
FROM (SELECT event_id, regexp_replace(props, '^\\s+|\\s+$', '', 'g') AS raw FROM events) e WHERE raw <> ''"""
    return q

