"""DuckDB oracle SQL for the curation keys (``plans/curate.py``)."""

from __future__ import annotations

from .. import dims
from ..functions.text import sql_str
from ..operators.synthesis import FILL_RULE, JUDGE_CHECKS, JUDGE_SYSTEM
from . import curate as cp
from .dedupe_sql import JACCARD, KEPT, WALK
from .packs_sql import _ldo, _with

TRIM = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
FENCE = "(?i)```(?:json)?\\s*([\\s\\S]*?)```"


def _nl(s: str) -> str:
    """SQL literal for a Python string that may hold newlines."""
    return " || chr(10) || ".join(sql_str(p) for p in s.split("\n"))


def _extract(x: str) -> str:
    t = TRIM.format(x=x)
    v = (f"CASE WHEN regexp_matches({t}, '{FENCE}') THEN {TRIM.format(x=f'regexp_extract({t}, {sql_str(FENCE)}, 1)')} "
         f"ELSE {t} END")
    return (f"(SELECT CASE WHEN instr(v, '{{') > 0 AND instr(reverse(v), '}}') > 0 "
            f"AND length(v) - instr(reverse(v), '}}') + 1 > instr(v, '{{') "
            f"THEN substring(v, instr(v, '{{'), length(v) - instr(reverse(v), '}}') + 1 - instr(v, '{{') + 1) ELSE v END "
            f"FROM (SELECT {v} AS v))")


def _parsed(src: str, text: str, cols: str) -> str:
    """Adds body, ok, reason, case_id to rows of ``src``."""
    return f"""(SELECT {cols}, reason IS NULL AS ok, reason,
       CASE WHEN reason IS NULL THEN json_extract_string(body, '$.caseId') END AS case_id FROM (
  SELECT *, CASE WHEN NOT json_valid(body) THEN '{dims.PARSE_JSON_FAILED}'
                 WHEN json_type(body) <> 'OBJECT' THEN '{dims.PARSE_NOT_OBJECT}'
                 WHEN coalesce(json_type(body, '$.caseId') = 'VARCHAR'
                      AND trim(json_extract_string(body, '$.caseId')) <> '', false) = false THEN '{dims.PARSE_MISSING_CASE_ID}'
            END AS reason
  FROM (SELECT *, {_extract(text)} AS body FROM {src}) b) c)"""


COMPLETION = """CASE event_type
  WHEN 'view' THEN '```json' || chr(10) || '{"caseId": "e' || CAST(event_id AS VARCHAR) || '", ' || substr(props, 2) || chr(10) || '```'
  WHEN 'click' THEN 'Sure, here it is: ' || '{"caseId": "e' || CAST(event_id AS VARCHAR) || '", ' || substr(props, 2) || ' thanks'
  WHEN 'signup' THEN '```' || chr(10) || '[' || printf('%.2f', value) || ']' || chr(10) || '```'
  WHEN 'purchase' THEN props
  ELSE 'error: ' || event_type END"""

ATTEMPTS = """attempts AS (SELECT conv_id, turn + 1 AS attempt,
  CASE WHEN role = 'assistant' AND length(text) % 2 = 0 THEN printf('{"caseId": "conv-%d-%d"}', conv_id, turn) ELSE text END AS atext,
  CAST(length(text) AS BIGINT) AS completion_tokens, CAST(10 AS BIGINT) AS prompt_tokens FROM conversations)"""

SLOTS = "slots AS (SELECT conv_id, winning IS NOT NULL AS ok, CAST(coalesce(winning, made) AS INTEGER) AS attempts, " \
        "case_id, prompt_tokens, completion_tokens, CASE WHEN winning IS NULL THEN last_reason END AS reason FROM (" \
        "SELECT conv_id, min(attempt) FILTER (WHERE ok) AS winning, max(attempt) AS made, " \
        "arg_min(case_id, attempt) FILTER (WHERE ok) AS case_id, arg_min(prompt_tokens, attempt) FILTER (WHERE ok) AS prompt_tokens, " \
        "arg_min(completion_tokens, attempt) FILTER (WHERE ok) AS completion_tokens, arg_max(reason, attempt) AS last_reason " \
        "FROM " + _parsed("attempts", "atext",
                          "conv_id, attempt, prompt_tokens, completion_tokens") + " p GROUP BY conv_id) g)"

VERDICT = """CASE WHEN quality = 1 AND toxic = 0 THEN '{"pass": true, "score": 1.7, "reason": "clear"}'
  WHEN quality = 0 AND toxic = 0 THEN printf('{"score": %.2f}', (doc_id % 100) / 100.0)
  WHEN quality = 1 AND toxic = 1 THEN '```json' || chr(10) || '{"pass": false}' || chr(10) || '```'
  ELSE 'judge timed out' END"""

VERDICTS = f"""verdicts AS (SELECT doc_id, is_obj, pass_v, score_v, reason_v FROM (
  SELECT doc_id, is_obj,
    CASE WHEN p_bool THEN p_val ELSE score_v >= {dims.JUDGE_PASS_THRESHOLD} END AS pass_v, score_v, reason_v FROM (
    SELECT doc_id, is_obj, p_bool, p_val,
      CASE WHEN is_obj AND s_num THEN least(greatest(CAST(json_extract_string(body, '$.score') AS DOUBLE), 0.0), 1.0)
           WHEN coalesce(p_val, false) THEN 1.0 ELSE 0.0 END AS score_v,
      CASE WHEN is_obj AND json_type(body, '$.reason') = 'VARCHAR' THEN json_extract_string(body, '$.reason') ELSE '' END AS reason_v
    FROM (SELECT doc_id, body, coalesce(CASE WHEN json_valid(body) THEN json_type(body) = 'OBJECT' END, false) AS is_obj,
            coalesce(CASE WHEN json_valid(body) THEN json_type(body, '$.score') IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') END, false) AS s_num,
            coalesce(CASE WHEN json_valid(body) THEN json_type(body, '$.pass') = 'BOOLEAN' END, false) AS p_bool,
            CASE WHEN json_valid(body) AND json_type(body, '$.pass') = 'BOOLEAN' THEN CAST(json_extract_string(body, '$.pass') AS BOOLEAN) END AS p_val
          FROM (SELECT doc_id, {_extract(VERDICT)} AS body FROM labels) a) b) c) d),
judged AS (SELECT d.doc_id, CASE WHEN v.doc_id IS NULL OR NOT v.is_obj THEN 'flagged' WHEN v.pass_v THEN 'pass' ELSE 'drop' END AS state
  FROM documents d LEFT JOIN verdicts v ON d.doc_id = v.doc_id)"""

DRAFTS = """drafts AS (SELECT doc_id, n_chars, lang, attempt, CASE WHEN doc_id % 11 = 5 THEN 'error: no answer' WHEN (doc_id + attempt) % 3 = 0 THEN '[1]'
  ELSE '```json' || chr(10) || to_json({'caseId': 'doc-' || doc_id, 'taskType': 'custom', 'input': text, 'metadata': {'lang': lang}}) || chr(10) || '```' END AS atext
  FROM documents CROSS JOIN (SELECT unnest([1, 2, 3]) AS attempt) a)"""

#: What a synthesis run does: rounds, budget of nine tenths, verdicts by label, review marks, greedy dedupe of the stamped cases.
SYNTHESIS = f"""WITH RECURSIVE {VERDICTS},
{DRAFTS},
tried AS {_parsed("drafts", "atext", "doc_id, n_chars, lang, attempt")},
runs AS (SELECT doc_id, any_value(n_chars) AS n_chars, any_value(lang) AS lang, coalesce(bool_or(ok), false) AS ok,
  coalesce(min(attempt) FILTER (WHERE ok), max(attempt)) AS attempts, arg_min(case_id, attempt) FILTER (WHERE ok) AS case_id,
  CASE WHEN NOT bool_or(ok) THEN arg_max(reason, attempt) END AS reason FROM tried GROUP BY doc_id),
spent AS (SELECT *, CASE WHEN ok THEN 10 + n_chars ELSE 0 END AS tokens, (SELECT sum(n_chars) * 9 // 10 FROM documents) AS most FROM runs),
running AS (SELECT *, coalesce(sum(tokens) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  row_number() OVER (ORDER BY doc_id) AS rn FROM spent),
budgeted AS (SELECT *, rn = 1 OR before < most AS inside FROM running),
told AS (SELECT b.*, j.state FROM budgeted b JOIN judged j ON b.doc_id = j.doc_id WHERE inside AND ok),
alive AS (SELECT t.doc_id, to_json({{'caseId': t.case_id, 'taskType': 'custom', 'input': d.text, 'metadata': {{'lang': t.lang, 'provenance': 'synthetic',
    'generator': {{'engine': {sql_str(dims.ENGINE_LABEL)}, 'model': {sql_str(cp.MODEL)}, 'specName': {sql_str(cp.SPEC_NAME)}}}}}}})
  || CASE WHEN state = 'flagged' THEN ' review true reviewReason judge-unavailable' ELSE '' END AS text
  FROM told t JOIN documents d ON t.doc_id = d.doc_id WHERE state <> 'drop'),
{JACCARD.replace("FROM documents", "FROM alive")},
{WALK},
k AS ({KEPT.format(col="doc_id")})
"""

MERGE_SRC = ("(SELECT event_id, props, CASE WHEN event_type IN ('view', 'click') THEN printf("
             "'{\"caseId\": \"e%d\", \"k\": -1, \"input\": \"%s\", \"expected\": {\"v\": %.2f}}', "
             "event_id, event_type, value) END AS completion FROM events)")

MERGED = f"""merged AS (SELECT event_id, ok AS enriched,
  CASE WHEN ok THEN json_merge_patch(json_object('input', json_extract(completion, '$.input'), 'expected', json_extract(completion, '$.expected'),
    'k', json_extract(completion, '$.k')), props) ELSE props END AS m
  FROM {_parsed(MERGE_SRC, "completion", "event_id, props, completion")} p)"""


def _guide_sql() -> str:
    parts = [f"'- ' || {sql_str(cp.FIELD_GUIDE[f])}" for f in dims.SPEC_DEFAULT_FIELDS]
    return " || chr(10) || ".join(parts)


def _prompts_sql() -> str:
    fields = ", ".join(["caseId", "taskType", *dims.SPEC_DEFAULT_FIELDS])
    system = ("concat_ws(chr(10) || chr(10), " + _nl("You generate synthetic cases for agent evaluation.\nIndustry: ")
              + " || industry || '. Task type: ' || task_type || '.', CASE WHEN len(constraints) > 0 THEN 'Constraints:' || chr(10) || "
              "array_to_string(list_transform(constraints, lambda c: '- ' || c), chr(10)) END, 'Fields:' || chr(10) || " + _guide_sql() + ")")
    mark = """'Set metadata.provenance to "synthetic".'"""
    contract = f"'Return one JSON object with keys: {fields}. taskType must be ' || task_type || '.'"
    case_line = "printf('Case %d of %d: vary identifiers and difficulty.', idx + 1, count)"
    return f"""WITH specs AS (
  SELECT r.r_name AS spec, lower(r.r_name) AS industry, 'tool_use' AS task_type, CAST(coalesce(c.cnt, 10) AS INTEGER) AS count,
    CASE WHEN length(r.r_name) > 4 THEN ['Set the scene in ' || array_to_string(list_transform(string_split(lower(r.r_name), ' '),
      lambda w: upper(w[1]) || w[2:]), ' ') || '.', 'Use no real names.'] ELSE []::VARCHAR[] END AS constraints,
    CASE WHEN r.r_regionkey % 2 = 0 THEN 'seeded' ELSE 'from-scratch' END AS mode, coalesce(p.personas, []::VARCHAR[]) AS personas
  FROM region r
  LEFT JOIN (SELECT n.n_regionkey, list_sort(list_distinct(list(cu.c_mktsegment))) AS personas FROM customer cu
             JOIN nation n ON cu.c_nationkey = n.n_nationkey GROUP BY n.n_regionkey) p ON r.r_regionkey = p.n_regionkey
  LEFT JOIN (SELECT n_regionkey, count(*) AS cnt FROM nation GROUP BY n_regionkey) c ON r.r_regionkey = c.n_regionkey),
seeds AS (SELECT count(*) AS n, string_agg('Example ' || CAST(i AS VARCHAR) || ':' || chr(10) || j, chr(10) || chr(10) ORDER BY i) AS ex FROM (
  SELECT row_number() OVER (ORDER BY item_id) AS i, to_json({{'item_id': item_id, 'text': text}}) AS j
  FROM (SELECT * FROM benchmark ORDER BY item_id LIMIT {dims.SEED_EXAMPLES}) b) s),
rows AS (SELECT s.*, CAST(g.idx AS INTEGER) AS idx, seeds.n AS n_ex, seeds.ex FROM specs s CROSS JOIN seeds
  CROSS JOIN LATERAL (SELECT unnest(generate_series(0, s.count - 1)) AS idx) g),
built AS (SELECT spec, idx,
  CASE WHEN mode = 'seeded' AND coalesce(n_ex, 0) > 0 THEN 'seeded' ELSE 'from-scratch' END AS prompt_mode,
  CASE WHEN len(personas) > 0 THEN personas[idx % len(personas) + 1] END AS persona,
  {system} AS system_prompt,
  CASE WHEN mode = 'seeded' AND coalesce(n_ex, 0) > 0 THEN
    concat_ws(chr(10) || chr(10), printf('Write one new case unlike these %d examples.', n_ex), ex, {case_line}, {contract}, {mark})
  ELSE concat_ws(chr(10) || chr(10), 'Write one new case for the ' || industry || ' domain.',
    CASE WHEN len(personas) > 0 THEN 'Persona: ' || personas[idx % len(personas) + 1] || '.' END, {case_line}, {contract}, {mark}) END AS user_prompt
  FROM rows)
"""


def queries() -> dict[str, str]:
    q = {}
    q["completion_parse"] = ("SELECT event_id, ok, reason, case_id FROM "
                             + _parsed(f"(SELECT event_id, {COMPLETION} AS text FROM events)", "text", "event_id") + " p")
    q["attempt_select"] = f"WITH {ATTEMPTS}, {SLOTS}\nSELECT conv_id, ok, attempts, case_id, reason, completion_tokens FROM slots"
    q["token_budget"] = f"""SELECT doc_id, pack, tokens, prev_total, (rn = 1 OR prev_total < {cp.BUDGET}) AS kept FROM (
  SELECT doc_id, source AS pack, n_chars AS tokens,
    CAST(coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prev_total,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) q"""
    q["judge_interpret"] = (f"WITH {VERDICTS}\nSELECT doc_id, is_obj AS has_verdict, CASE WHEN is_obj THEN pass_v END AS pass, "
                            "CASE WHEN is_obj THEN score_v END AS score, CASE WHEN is_obj THEN reason_v END AS reason FROM verdicts")
    q["judge_filter"] = (f"WITH {VERDICTS}\nSELECT doc_id, state = 'flagged' AS review, "
                         "CASE WHEN state = 'flagged' THEN 'judge-unavailable' END AS review_reason FROM judged WHERE state <> 'drop'")
    q["judge_counters"] = (f"WITH {VERDICTS}\nSELECT count(*) AS judged, count(*) FILTER (WHERE state = 'drop') AS dropped, "
                           "count(*) FILTER (WHERE state = 'flagged') AS flagged FROM judged")
    q["provenance_stamp"] = f"""SELECT event_id, CAST(json_extract(m, '$.k') AS BIGINT) AS k, json_extract_string(m, '$.provenance') AS provenance,
  json_extract_string(m, '$.generator.engine') AS engine, json_extract_string(m, '$.generator.model') AS model,
  json_extract_string(m, '$.generator.specName') AS spec_name, array_to_string(json_keys(m), ',') AS keys
FROM (SELECT event_id, json_merge_patch(props, json_object('provenance', 'synthetic', 'generator',
  json_object('engine', {sql_str(dims.ENGINE_LABEL)}, 'model', {sql_str(cp.MODEL)}, 'specName', event_type))) AS m FROM events) q"""
    q["synthesis_report"] = SYNTHESIS + f"""SELECT {sql_str(cp.SPEC_NAME)} AS spec_name, {sql_str(cp.MODEL)} AS model, 'seeded' AS mode,
  (SELECT count(*) FROM budgeted) AS requested, (SELECT count(*) FROM k WHERE kept) AS generated,
  (SELECT count(*) FROM budgeted WHERE inside AND NOT ok) AS failed,
  (SELECT coalesce(sum(CASE WHEN ok THEN 10 ELSE 0 END), 0) FROM budgeted WHERE inside) AS prompt_tokens,
  (SELECT coalesce(sum(CASE WHEN ok THEN n_chars ELSE 0 END), 0) FROM budgeted WHERE inside) AS completion_tokens,
  (SELECT count(*) FROM told) AS judged, (SELECT count(*) FROM told WHERE state = 'drop') AS judge_dropped,
  (SELECT count(*) FROM told WHERE state = 'flagged') AS judge_flagged, (SELECT count(*) FROM k WHERE NOT kept) AS deduped_removed,
  (SELECT coalesce(bool_or(inside AND before + tokens >= most), false) FROM budgeted) AS stopped_by_budget"""
    q["synthesis_failures"] = SYNTHESIS + "SELECT doc_id, reason FROM budgeted WHERE inside AND NOT ok"
    q["synthesis_cases"] = SYNTHESIS + f"""SELECT k.doc_id, t.case_id, CAST(t.attempts AS INTEGER) AS attempts, t.lang, 'synthetic' AS provenance,
  {sql_str(cp.SPEC_NAME)} AS spec_name, t.state = 'flagged' AS review, CASE WHEN t.state = 'flagged' THEN 'judge-unavailable' END AS review_reason,
  sha256(d.text) AS input_sha256 FROM k JOIN told t ON k.doc_id = t.doc_id JOIN documents d ON k.doc_id = d.doc_id WHERE kept"""
    mapping = " ".join(f"WHEN '{k}' THEN '{f}'" for k, f in dims.SIGNAL_TO_FIELD)
    q["gap_fields"] = _with() + ("SELECT pack, array_to_string(" + _ldo(f"list_filter(list_transform(missing, lambda s: CASE s {mapping} END), lambda x: x IS NOT NULL)")
                                 + ", ',') AS fields FROM prof")
    q["merge_completion"] = f"""WITH {MERGED}
SELECT event_id, array_to_string(list_sort(json_keys(m)), ',') AS keys, CAST(json_extract(m, '$.k') AS BIGINT) AS k,
  json_extract_string(m, '$.input') AS input, CAST(json_extract(m, '$.expected.v') AS DOUBLE) AS expected_v FROM merged"""
    from .inventory_sql import JSON_CASES
    fields = _ldo(f"list_filter(list_transform(missing, lambda s: CASE s {mapping} END), lambda x: x IS NOT NULL)")
    gaps = _with(cases=JSON_CASES).rstrip() + f""",
gaps AS (SELECT pack, {fields} AS fields, task_type FROM prof),
filled AS (SELECT c.pack, c.seq, c.raw, g.fields, c.seq % 13 <> 1 AS ok FROM cases c JOIN gaps g ON c.pack = g.pack)
"""
    q["enrichment_report"] = gaps + """SELECT pack, count(*) AS input_cases, count(*) FILTER (WHERE ok) AS enriched_cases,
  count(*) FILTER (WHERE NOT ok) AS failed, array_to_string(any_value(fields), ',') AS fields_targeted FROM filled GROUP BY pack"""
    q["enrichment_failures"] = gaps + (f"SELECT pack, seq AS doc_id, 'doc-' || seq AS case_id, '{dims.PARSE_MISSING_CASE_ID}' AS reason "
                                       "FROM filled WHERE NOT ok")
    q["enrichment_cases"] = gaps + """SELECT seq AS doc_id, ok AS enriched, array_to_string(list_sort(CASE WHEN ok
  THEN list_distinct(list_concat(json_keys(raw), fields)) ELSE json_keys(raw) END), ',') AS keys FROM filled"""
    lift = ("cases2 AS (SELECT pack, seq, CASE WHEN len(new) = 0 THEN raw ELSE CAST(json_merge_patch(raw, '{' || array_to_string(list_transform(new, "
            "lambda f: '\"' || f || '\":\"filled ' || f || '\"'), ',') || '}') AS VARCHAR) END AS raw, license FROM ("
            "SELECT c.pack, c.seq, c.raw, c.license, list_filter(g.fields, lambda f: NOT list_contains(json_keys(c.raw), f)) AS new "
            "FROM cases c JOIN gaps g ON c.pack = g.pack) n)")
    again = _with(cases="cases AS (SELECT pack, seq, raw, license FROM cases2)")
    q["closed_loop_lift"] = gaps.rstrip() + ",\n" + lift + ",\nafter AS (" + again + (
        "SELECT pack, completeness FROM prof)\nSELECT b.pack, array_to_string(g.fields, ',') AS fields, CAST(b.completeness AS DOUBLE) AS before, "
        "CAST(a.completeness AS DOUBLE) AS after, CAST(a.completeness - b.completeness AS DOUBLE) AS lift "
        "FROM prof b JOIN after a ON a.pack = b.pack JOIN gaps g ON g.pack = b.pack")
    q["prompts_seeded"] = _prompts_sql() + "SELECT spec, idx, prompt_mode, system_prompt, user_prompt FROM built WHERE prompt_mode = 'seeded'"
    q["prompts_persona"] = _prompts_sql() + "SELECT spec, idx, prompt_mode, persona, system_prompt, user_prompt FROM built WHERE prompt_mode = 'from-scratch'"
    from .packs_sql import _industry_ctes
    guide = "CASE f " + " ".join(f"WHEN {sql_str(k)} THEN {sql_str(v)}" for k, v in cp.FIELD_GUIDE.items()) \
        + " ELSE f || ': custom field, fill it meaningfully.' END"
    q["prompts_gap_fill"] = gaps.rstrip() + ",\n" + _industry_ctes() + f"""
SELECT f.seq AS doc_id, f.pack, array_to_string(f.fields, ',') AS fields,
  'You complete evaluation cases. Industry: ' || i.primary_industry || '. Task type: ' || p.task_type || '.' || chr(10) || {sql_str(FILL_RULE)}
    || chr(10) || chr(10) || 'Fields to add:' || chr(10) || array_to_string(list_transform(f.fields, lambda f: '- ' || {guide}), chr(10)) AS system_prompt,
  CASE WHEN json_extract_string(f.raw, '$.input') IS NOT NULL THEN sha256(json_extract_string(f.raw, '$.input')) END AS input_sha256,
  concat_ws(chr(10), 'Case (keep every present field unchanged):', '<case>', 'Add these fields: ' || array_to_string(f.fields, ', ') || '.',
    'Return the whole case as one JSON object, without prose or fences.') AS user_prompt
FROM filled f JOIN prof p ON p.pack = f.pack JOIN indp i ON i.pack = f.pack"""
    checks = "\n".join(f"{i}. {c}" for i, c in enumerate(JUDGE_CHECKS, 1))
    ask = (f"Judge this synthesised case of industry finance, task type custom. It passes from a score of {dims.JUDGE_PASS_THRESHOLD}.\n"
           f"Check:\n{checks}\nCase:\n<case>")
    q["prompts_judge"] = (f"SELECT doc_id, {sql_str(JUDGE_SYSTEM)} AS system_prompt, {_nl(ask)} AS user_prompt FROM documents "
                          "WHERE doc_id % 11 <> 5 AND (doc_id + 1) % 3 <> 0")
    ttypes = "[" + ", ".join(sql_str(t) for t in dims.TASK_TYPES) + "]"
    slugs = "[" + ", ".join(sql_str(t[0]) for t in dims.STOCK_TAXONOMY) + "]"
    q["spec_violations"] = f"""SELECT c_custkey, industry, task_type, count, mode, array_to_string(list_filter([
  CASE WHEN coalesce(trim(name), '') = '' THEN 'name: required' END,
  CASE WHEN NOT list_contains({slugs}, industry) THEN 'industry: not in taxonomy' END,
  CASE WHEN NOT list_contains({ttypes}, task_type) THEN 'taskType: unknown' END,
  CASE WHEN count <= 0 THEN 'count: must be a positive integer' END,
  CASE WHEN mode NOT IN ('seeded', 'from-scratch') THEN 'mode: unknown' END,
  CASE WHEN mode = 'seeded' AND seeds IS NULL THEN 'seedCases: required when seeded' END], lambda x: x IS NOT NULL), '; ') AS violations
FROM (SELECT c_custkey, c_name AS name,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'logistics' WHEN 'BUILDING' THEN 'manufacturing' WHEN 'FURNITURE' THEN 'ecommerce'
       ELSE lower(c_mktsegment) END AS industry,
  CASE WHEN c_nationkey < {len(dims.TASK_TYPES)} THEN {ttypes}[c_nationkey + 1] ELSE 'free_form' END AS task_type,
  coalesce(CASE WHEN c_acctbal > -500 THEN CAST(trunc(c_acctbal / 1000) AS INTEGER) END, {dims.SPEC_DEFAULT_COUNT}) AS count,
  coalesce(CASE WHEN c_acctbal > 5000 THEN 'seeded' WHEN c_acctbal > 0 THEN 'from-scratch' END, 'from-scratch') AS mode,
  CASE WHEN c_acctbal > 8000 THEN 'seeds.jsonl' END AS seeds FROM customer) s"""
    return q

