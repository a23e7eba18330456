"""DuckDB oracle SQL for the pack readiness keys (``plans/packs.py``).

Written independently of the Spark code, from the same rule constants, so a
logic slip on either side shows up as a mismatch."""

from __future__ import annotations

from .. import dims
from ..functions.text import sql_str
from .packs import TAXONOMY

KEYS = [s[0] for s in dims.SIGNALS]


def _list(items) -> str:
    return "[" + ", ".join(sql_str(i) for i in items) + "]::VARCHAR[]"


def _ldo(expr: str) -> str:
    """Order-preserving distinct of a list expression."""
    return f"list_filter({expr}, lambda v, i: NOT list_contains(({expr})[1:i - 1], v))"


def _nonnull(items: list[str]) -> str:
    return "list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL)"


CASES = r"""cases AS (
  SELECT source AS pack, doc_id AS seq, text AS raw,
         NULLIF(trim(regexp_extract(text, '(?m)^[^\n]*[Ll]icen[cs]e[^\n]*', 0)), '') AS license
  FROM documents)"""

SAMPLE = "sample AS (SELECT pack, seq, raw FROM cases)"


def _tflags() -> str:
    cols = []
    for key, _w, _f, pat in dims.SIGNALS:
        if pat:
            cols.append(f"bool_or(regexp_matches(lower(raw), {sql_str(pat)})) AS t_{key}")
    for t, pat in dims.TASK_TYPE_RULES:
        cols.append(f"bool_or(regexp_matches(lower(raw), {sql_str(pat)})) AS tt_{t}")
    return "tflags AS (SELECT pack, " + ", ".join(cols) + " FROM sample GROUP BY pack)"


def _fagg() -> str:
    keys = "CASE WHEN json_valid(raw) AND json_type(raw) = 'OBJECT' THEN json_keys(raw) END"
    cols = ["count(*) AS case_count"]
    for key, _w, fields, _p in dims.SIGNALS:
        if fields:
            cols.append(f"bool_or(coalesce(len(list_intersect(k, {_list(fields)})) > 0, false)) AS f_{key}")
    cols.append("min_by(license, seq) FILTER (WHERE license IS NOT NULL) AS case_license")
    cols.append("min_by(tt, seq) FILTER (WHERE tt IS NOT NULL AND tt <> '') AS explicit_type")
    cols.append("coalesce(bool_or(msgs), false) AS has_messages")
    inner = (f"SELECT pack, seq, license, {keys} AS k, "
             "CASE WHEN json_valid(raw) THEN json_extract_string(raw, '$.taskType') END AS tt, "
             "CASE WHEN json_valid(raw) THEN json_type(raw, '$.messages') = 'ARRAY' END AS msgs FROM cases")
    return f"fagg AS (SELECT pack, {', '.join(cols)} FROM ({inner}) r GROUP BY pack)"


def _prof() -> str:
    sig = []
    for key, _w, fields, pat in dims.SIGNALS:
        terms = []
        if fields:
            terms.append(f"f.f_{key}")
        if pat:
            terms.append(f"coalesce(t.t_{key}, false)")
        if key == "license":
            terms = ["coalesce(f.case_license <> '', false)"]
        sig.append("(" + " OR ".join(terms) + f") AS s_{key}")
    casc = "CASE WHEN coalesce(t.tt_rag_qa, false) THEN 'rag_qa'"
    for t, _p in dims.TASK_TYPE_RULES[1:]:
        casc += f" WHEN coalesce(t.tt_{t}, false) THEN '{t}'"
    casc += " WHEN f.has_messages THEN 'dialogue' ELSE 'custom' END"
    p1 = (f"p1 AS (SELECT f.pack, f.case_count, {', '.join(sig)}, "
          f"CAST(CASE WHEN f.case_count > 0 THEN {dims.CONFIDENCE_WITH_CASES} ELSE {dims.CONFIDENCE_METADATA_ONLY} END AS DECIMAL(10,4)) AS conf, "
          f"coalesce(f.explicit_type, {casc}) AS task_type, f.case_license AS license_name, f.explicit_type "
          "FROM fagg f LEFT JOIN tflags t ON f.pack = t.pack)")
    total = " + ".join(f"CASE WHEN s_{k} THEN CAST({w} AS DECIMAL(10,4)) * conf ELSE 0 END" for k, w, _f, _p in dims.SIGNALS)
    p2 = f"p2 AS (SELECT *, CAST(least(greatest(round({total}, 4), 0), 1) AS DECIMAL(10,4)) AS completeness FROM p1)"
    lvl = "CASE"
    for level, minimum, req in dims.READINESS_RULES:
        cond = " AND ".join([f"completeness >= {minimum}"] + [f"s_{r}" for r in req])
        lvl += f" WHEN {cond} THEN {level}"
    lvl += " ELSE 1 END"
    present = _nonnull([f"CASE WHEN s_{k} THEN '{k}' END" for k in KEYS])
    missing = _nonnull([f"CASE WHEN NOT s_{k} THEN '{k}' END" for k in KEYS])
    crit = _nonnull([f"CASE WHEN NOT s_{k} THEN '{k}' END" for k in KEYS if k in dims.CRITICAL_SIGNALS])
    p3 = (f"p3 AS (SELECT *, {lvl} AS readiness_level, {present} AS present, {missing} AS missing, "
          f"{crit} AS missing_critical FROM p2)")
    ev = _nonnull([
        "CASE WHEN task_type IN ('data_extraction', 'classification') THEN 'regex_match' END",
        "CASE WHEN s_environmentState THEN 'environment_state_test' END",
        "CASE WHEN s_checker THEN 'unit_test' END",
        "CASE WHEN s_expectedOutput THEN 'exact_match' END",
        "CASE WHEN s_expectedOutput THEN 'f1_match' END",
        "'llm_judge'", "'human_label'"])
    notes = _nonnull([
        "'Inferred task type: ' || task_type || '.'",
        "'Schema completeness: ' || CAST(CAST(round(completeness * 100) AS INTEGER) AS VARCHAR) || '%.'",
        "CASE WHEN len(missing) > 0 THEN 'Missing fields: ' || array_to_string(missing, ', ') || '.' END",
        f"CASE WHEN NOT s_checker THEN {sql_str(dims.NOTE_MISSING_CHECKER)} END",
        f"CASE WHEN NOT s_license THEN {sql_str(dims.NOTE_MISSING_LICENSE)} END"])
    prof = f"prof AS (SELECT *, " + _ldo("x") + f" AS evaluators, {notes} AS notes FROM (SELECT *, {ev} AS x FROM p3) e)"
    return ",\n".join([p1, p2, p3, prof])


def profile_ctes(cases: str = CASES) -> str:
    return ",\n".join([cases, SAMPLE, _tflags(), _fagg(), _prof()])


def _with(*extra: str, cases: str = CASES) -> str:
    return "WITH " + ",\n".join([profile_ctes(cases), *extra]) + "\n"


TASK_TYPES = ("SELECT p.pack, array_to_string(" + _ldo("list_concat([p.task_type], coalesce(c.types, []::VARCHAR[]))") + ", ',') AS task_types "
              "FROM prof p LEFT JOIN (SELECT pack, list(tt ORDER BY first_seq) AS types FROM ("
              "SELECT pack, tt, min(seq) AS first_seq FROM (SELECT pack, seq, CASE WHEN json_valid(raw) THEN "
              "json_extract_string(raw, '$.taskType') END AS tt FROM cases) x WHERE tt IS NOT NULL AND tt <> '' "
              "GROUP BY pack, tt) y GROUP BY pack) c ON p.pack = c.pack")


def evidence_sql(cases: str) -> str:
    """First cases of each signal: fields before text within a case."""
    keys = "CASE WHEN json_valid(raw) AND json_type(raw) = 'OBJECT' THEN json_keys(raw) END"
    hits = []
    for i, (key, _w, fields, pat) in enumerate(dims.SIGNALS):
        tests = ([("field", f"coalesce(len(list_intersect(k, {_list(fields)})) > 0, false)")] if fields else []) \
            + ([("text", f"regexp_matches(lower(raw), {sql_str(pat)})")] if pat else []) \
            + ([("license", "license IS NOT NULL")] if key == "license" else [])
        hits += [f"SELECT pack, {i + 1} AS ordinal, '{key}' AS signal, seq, '{kind}' AS kind FROM keyed WHERE {test}" for kind, test in tests]
    return _with(cases=cases).rstrip() + f""",
keyed AS (SELECT pack, seq, raw, license, {keys} AS k FROM cases),
hits AS ({" UNION ALL ".join(hits)}),
firsts AS (SELECT pack, ordinal, signal, string_agg(seq || ':' || kind, ',' ORDER BY seq, kind) AS cases FROM (
  SELECT *, row_number() OVER (PARTITION BY pack, signal ORDER BY seq, kind) AS r FROM hits) x WHERE r <= 3 GROUP BY pack, ordinal, signal),
present AS ({" UNION ALL ".join(f"SELECT pack, {i + 1} AS ordinal, '{k}' AS signal, s_{k} AS present FROM prof" for i, k in enumerate(KEYS))})
SELECT p.pack, CAST(p.ordinal AS INTEGER) AS ordinal, p.signal, p.present, CASE WHEN p.present THEN 'matched ' || p.signal ELSE '' END AS evidence,
  coalesce(f.cases, '') AS first_cases FROM present p LEFT JOIN firsts f ON p.pack = f.pack AND p.ordinal = f.ordinal"""


def manifest_sql(cases: str) -> str:
    tax = ", ".join(f"({sql_str(s)}, {sql_str(label)})" for s, label, _k, _w in TAXONOMY)
    signals = " || ',' || ".join(f"'{k}:' || s_{k} || CASE WHEN s_{k} THEN ':matched {k}' ELSE ':' END" for k in KEYS)
    return _with(_industry_ctes(), _plan_ctes(), cases=cases).rstrip() + f""",
types AS ({TASK_TYPES}), labels(slug, label) AS (VALUES {tax}),
words AS (SELECT pack, slug, string_agg(keyword, '+' ORDER BY kw_id) AS words FROM (
  SELECT pack, slug, keyword, min(kw_id) AS kw_id FROM matches GROUP BY pack, slug, keyword) w GROUP BY pack, slug),
inds AS (SELECT t.pack, string_agg(t.slug || ':' || l.label || ':' || coalesce(w.words, ''), ',' ORDER BY t.rank) AS industries
  FROM top t JOIN labels l ON t.slug = l.slug LEFT JOIN words w ON w.pack = t.pack AND w.slug = t.slug GROUP BY t.pack),
told AS (SELECT pack, string_agg(step_id || ':' || priority || ':' || array_to_string(outputs, '+'), ',' ORDER BY ordinal) AS steps FROM steps GROUP BY pack)
SELECT p.pack, {sql_str(dims.MANIFEST_VERSION)} AS schema_version, 'landed/' || p.pack || '.jsonl' AS url, p.license_name, p.case_count, y.task_types,
  CAST(p.completeness AS DOUBLE) AS completeness, CAST(p.readiness_level AS INTEGER) AS readiness_level, n.industries, i.is_industry_specific,
  {signals} AS signals, array_to_string(p.evaluators, ',') AS evaluators, array_to_string(p.notes, ' | ') AS notes, t.current_tier, t.target_tier, l.lift,
  array_to_string(i.workflow_focus, ',') AS workflow_focus, s.steps, array_to_string(e.risks, ' | ') AS risks, array_to_string({_ldo("e.actions")}, ' | ') AS next_actions
FROM prof p JOIN indp i ON p.pack = i.pack JOIN types y ON p.pack = y.pack JOIN inds n ON p.pack = n.pack JOIN tiers t ON p.pack = t.pack
JOIN lift l ON p.pack = l.pack JOIN extra e ON p.pack = e.pack JOIN told s ON p.pack = s.pack"""


def json_queries(cases: str) -> dict[str, str]:
    """The pack keys over JSON cases, so that fields, explicit types, messages and case licenses count."""
    w = _with(cases=cases)
    return {
        "json_signal_profile": w + "SELECT pack, CAST(o AS INTEGER) AS ordinal, signal, present, "
        "CAST(CASE WHEN present THEN conf ELSE 0 END AS DOUBLE) AS confidence FROM (" + " UNION ALL ".join(
            f"SELECT pack, {i + 1} AS o, '{k}' AS signal, s_{k} AS present, conf FROM prof" for i, k in enumerate(KEYS)) + ") u",
        "json_pack_profile": w + "SELECT pack, case_count, CAST(completeness AS DOUBLE) AS completeness, "
        "CAST(readiness_level AS INTEGER) AS readiness_level, task_type, license_name, explicit_type, "
        "array_to_string(missing_critical, ',') AS missing_critical, array_to_string(evaluators, ',') AS evaluators, "
        "array_to_string(notes, ' | ') AS notes FROM prof",
        "json_task_types": w + TASK_TYPES,
        "manifest_nested": manifest_sql(cases),
        "signal_evidence": evidence_sql(cases),
    }


def _kw_values() -> str:
    from ..operators.industry import keyword_rows
    rows = keyword_rows(TAXONOMY)
    vals = ", ".join(f"({r[0]}, {sql_str(r[1])}, {sql_str(r[2])}, {sql_str(r[3])})" for r in rows)
    return f"kwdim(kw_id, slug, kind, keyword) AS (VALUES {vals})"


def _industry_ctes() -> str:
    from ..operators.industry import keyword_rows
    rows = keyword_rows(TAXONOMY)
    ids = ", ".join(f"CASE WHEN regexp_matches(lower(raw), {sql_str(r[4])}) THEN {r[0]} END" for r in rows)
    hits = f"hits AS (SELECT DISTINCT pack, unnest(list_filter([{ids}], lambda x: x IS NOT NULL)) AS kw_id FROM sample)"
    matches = "matches AS (SELECT h.pack, d.* FROM hits h JOIN kwdim d ON h.kw_id = d.kw_id)"
    tax = ", ".join(f"({sql_str(s)}, {sql_str(lab)}, {i}, {_list(wf)})" for i, (s, lab, _k, wf) in enumerate(TAXONOMY))
    taxdim = f"taxdim(slug, label, slug_ordinal, workflows) AS (VALUES {tax})"
    score = ("CAST(least(greatest(round(least(0.45, n_keywords * CAST(0.11 AS DECIMAL(10,4))) "
             "+ least(0.10, n_workflows * CAST(0.05 AS DECIMAL(10,4))), 4), 0), 1) AS DECIMAL(10,4))")
    scores = ("scores AS (SELECT * FROM (SELECT pack, slug, n_keywords, n_workflows, " + score + " AS confidence FROM ("
              "SELECT pack, slug, count(DISTINCT CASE WHEN kind = 'keyword' THEN keyword END) AS n_keywords, "
              "count(DISTINCT CASE WHEN kind = 'workflow' THEN keyword END) AS n_workflows "
              "FROM matches GROUP BY pack, slug) c) s WHERE confidence > 0)")
    top = ("top AS (SELECT pack, CAST(rank AS INTEGER) AS rank, slug, confidence FROM ("
           "SELECT pack, slug, confidence, row_number() OVER (PARTITION BY pack ORDER BY confidence DESC, slug) AS rank "
           "FROM scores) r WHERE rank <= 3 "
           "UNION ALL SELECT DISTINCT pack, 1, 'general', CAST(0.2 AS DECIMAL(10,4)) FROM cases "
           "WHERE pack NOT IN (SELECT pack FROM scores))")
    indp = ("indp AS (SELECT t.pack, t.slug AS primary_industry, "
            "(t.slug <> 'general' AND t.confidence >= 0.3) AS is_industry_specific, "
            "taxdim.workflows[1:3] AS workflow_focus FROM top t LEFT JOIN taxdim ON t.slug = taxdim.slug WHERE t.rank = 1)")
    return ",\n".join([_kw_values(), hits, matches, taxdim, scores, top, indp])


def _plan_ctes() -> str:
    rules = []
    for r in dims.STEP_RULES:
        rules.append(f"({r.ordinal}, {sql_str(r.step_id)}, {sql_str(r.title)}, {sql_str(r.priority)}, "
                     f"{'true' if r.automatable else 'false'}, {_list(r.triggers)}, {sql_str(r.condition)}, "
                     f"CAST({dims.PRIORITY_LIFT[r.priority]} AS DECIMAL(10,4)), {_list(r.inputs)}, {_list(r.outputs)})")
    ruledim = ("ruledim(ordinal, step_id, title, priority, automatable, triggers, cond, lift, inputs, outputs) AS (VALUES "
               + ", ".join(rules) + ")")
    steps = ("steps AS (SELECT p.pack, r.ordinal, r.step_id, r.priority, r.automatable, r.lift, r.inputs, r.outputs, "
             "replace(r.title, '{industry}', i.primary_industry) AS title "
             "FROM prof p JOIN indp i ON p.pack = i.pack JOIN ruledim r ON ("
             "r.cond = 'always' OR (r.cond = 'level5' AND p.readiness_level >= 5) "
             "OR (r.cond = 'rag_qa' AND list_has_any(r.triggers, p.missing) AND p.task_type = 'rag_qa') "
             "OR (r.cond = '' AND list_has_any(r.triggers, p.missing))))")
    tiers = ("tiers AS (SELECT pack, "
             "CASE WHEN readiness_level >= 4 AND s_checker THEN 'eval_ready_pack' "
             "WHEN readiness_level >= 3 AND s_expectedOutput THEN 'benchmark_seed' "
             "WHEN readiness_level >= 2 OR s_input THEN 'candidate_dataset' ELSE 'raw_metadata' END AS current_tier, "
             "CASE WHEN list_contains(missing_critical, 'license') THEN 'eval_ready_pack' "
             "WHEN readiness_level >= 4 THEN 'commercial_pack' ELSE 'eval_ready_pack' END AS target_tier FROM prof)")
    lift = ("lift AS (SELECT p.pack, CAST(least(greatest(round(p.completeness + coalesce(s.total, 0), 2), 0), 1) AS DOUBLE) AS lift, "
            "coalesce(s.n_steps, 0) AS n_steps, coalesce(s.step_ids, '') AS step_ids FROM prof p LEFT JOIN ("
            "SELECT pack, sum(lift) AS total, count(*) AS n_steps, string_agg(step_id, ',' ORDER BY ordinal) AS step_ids "
            "FROM steps GROUP BY pack) s ON p.pack = s.pack)")
    risks = _nonnull([f"CASE WHEN list_contains(missing, '{k}') THEN {sql_str(m)} END" for k, m in dims.PACKAGING_RISKS])
    acts = _nonnull([f"CASE WHEN list_contains(missing_critical, '{k}') THEN {sql_str(m)} END"
                     for k, m in dims.NEXT_ACTIONS_IF_MISSING] + [sql_str(m) for m in dims.NEXT_ACTIONS_ALWAYS])
    extra = f"extra AS (SELECT pack, {risks} AS risks, {acts} AS actions FROM prof)"
    return ",\n".join([ruledim, steps, tiers, lift, extra])


def queries() -> dict[str, str]:
    q = {}
    q["signal_profile"] = _with() + "SELECT pack, CAST(o AS INTEGER) AS ordinal, signal, present, " \
        "CAST(CASE WHEN present THEN conf ELSE 0 END AS DOUBLE) AS confidence FROM (" + " UNION ALL ".join(
            f"SELECT pack, {i + 1} AS o, '{k}' AS signal, s_{k} AS present, conf FROM prof" for i, k in enumerate(KEYS)) + ") u"
    q["pack_completeness"] = _with() + "SELECT pack, case_count, CAST(completeness AS DOUBLE) AS completeness FROM prof"
    q["readiness_level"] = _with() + "SELECT pack, CAST(completeness AS DOUBLE) AS completeness, CAST(readiness_level AS INTEGER) AS readiness_level FROM prof"
    q["task_type_by_pack"] = _with() + "SELECT pack, task_type FROM prof"
    q["missing_critical"] = _with() + "SELECT pack, array_to_string(missing_critical, ',') AS missing_critical FROM prof"
    q["missing_signals"] = _with() + "SELECT pack, array_to_string(missing, ',') AS missing FROM prof"
    q["evaluator_candidates"] = _with() + "SELECT pack, array_to_string(evaluators, ',') AS evaluators FROM prof"
    q["profile_notes"] = _with() + "SELECT pack, array_to_string(notes, ' | ') AS notes FROM prof"
    q["pack_license"] = _with() + "SELECT pack, license_name FROM prof"
    q["license_per_doc"] = (r"SELECT doc_id, NULLIF(trim(regexp_extract(text, '(?m)^[^\n]*[Ll]icen[cs]e[^\n]*', 0)), '') "
                            "AS license_name FROM documents")
    hits = _nonnull([f"CASE WHEN regexp_matches(lower(text), {sql_str(p)}) THEN '{k}' END"
                     for k, _w, _f, p in dims.SIGNALS if p])
    q["signal_hits"] = f"SELECT doc_id, array_to_string({hits}, ',') AS signals FROM documents"
    q["task_types_ordered"] = _with() + TASK_TYPES
    from .inventory_sql import JSON_CASES
    q |= json_queries(JSON_CASES)
    ind = _with(_industry_ctes())
    q["keyword_matches"] = ind + "SELECT pack, slug, kind, keyword FROM matches"
    q["industry_scores"] = ind + "SELECT pack, slug, n_keywords, n_workflows, CAST(confidence AS DOUBLE) AS confidence FROM scores"
    q["industry_top3"] = ind + "SELECT pack, rank, slug, CAST(confidence AS DOUBLE) AS confidence FROM top"
    pln = _with(_industry_ctes(), _plan_ctes())
    q["value_tiers"] = pln + "SELECT pack, current_tier, target_tier FROM tiers"
    q["plan_steps"] = pln + ("SELECT pack, CAST(ordinal AS INTEGER) AS step_ordinal, step_id, priority, automatable, title, "
                             "array_to_string(inputs, ',') AS inputs, array_to_string(outputs, ',') AS outputs FROM steps")
    q["readiness_lift"] = pln + "SELECT p.pack, CAST(p.completeness AS DOUBLE) AS completeness, l.lift FROM prof p JOIN lift l ON p.pack = l.pack"
    q["packaging_risks"] = pln + "SELECT pack, array_to_string(risks, ' | ') AS risks FROM extra"
    q["next_actions"] = pln + "SELECT pack, array_to_string(" + _ldo("actions") + ", ' | ') AS actions FROM extra"
    q["pack_manifest"] = pln + (
        f"SELECT {sql_str(dims.MANIFEST_VERSION)} AS schema_version, p.pack, p.case_count, "
        "p.task_type AS task_types, "
        "CAST(p.completeness AS DOUBLE) AS completeness, CAST(p.readiness_level AS INTEGER) AS readiness_level, "
        "p.license_name, i.primary_industry, i.is_industry_specific, array_to_string(i.workflow_focus, ',') AS workflow_focus, "
        "t.current_tier, t.target_tier, l.lift, CAST(l.n_steps AS INTEGER) AS n_steps, l.step_ids, "
        "array_to_string(p.evaluators, ',') AS evaluators, array_to_string(p.missing_critical, ',') AS missing_critical, "
        "array_to_string(" + _ldo("e.actions") + ", ' | ') AS next_actions "
        "FROM prof p JOIN indp i ON p.pack = i.pack JOIN tiers t ON p.pack = t.pack JOIN lift l ON p.pack = l.pack "
        "JOIN extra e ON p.pack = e.pack")
    return q
