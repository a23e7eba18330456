"""DuckDB oracle SQL for the finance-pack keys (``plans/facts.py``)."""

from __future__ import annotations

FACTS = """facts AS (
  SELECT l_suppkey AS entity, l_orderkey, l_linenumber, l_partkey, l_returnflag,
    CASE l_returnflag WHEN 'R' THEN 'Revenues' WHEN 'A' THEN 'SalesRevenueNet' ELSE 'NetIncomeLoss' END AS concept,
    CASE WHEN l_linestatus = 'F' THEN 'USD' ELSE 'EUR' END AS unit,
    l_extendedprice AS val, year(l_shipdate) AS fy, 'Q' || CAST(quarter(l_shipdate) AS VARCHAR) AS fp,
    CASE WHEN l_linenumber % 2 = 1 THEN '10-K' ELSE '10-Q' END AS form,
    strftime(l_shipdate, '%Y-%m-%d') AS filed,
    strftime(CAST(l_shipdate AS DATE) - CAST(l_linenumber * 30 AS INTEGER), '%Y-%m-%d') AS "end"
  FROM lineitem)"""

METRICS = """metrics(metric, concept, concept_ordinal) AS (VALUES
  ('revenue', 'SalesRevenueNet', 0), ('revenue', 'Revenues', 1), ('net_income', 'NetIncomeLoss', 0))"""

LATEST = """latest AS (
  SELECT * FROM (
    SELECT f.*, m.metric, m.concept_ordinal, row_number() OVER (
      PARTITION BY entity, form, f.concept ORDER BY filed || '-' || "end" DESC, l_orderkey, l_linenumber, l_partkey, val) AS rn
    FROM facts f JOIN metrics m ON f.concept = m.concept) q WHERE rn = 1)"""

PREFERRED = """preferred AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY entity, form, metric
      ORDER BY filed || '-' || "end" DESC, concept_ordinal) AS rn2 FROM latest) q WHERE rn2 = 1)"""

FILINGS = """lines AS (
  SELECT l_orderkey, l_linenumber, l_partkey, lpad(CAST(l_orderkey AS VARCHAR), 10, '0') AS cik,
    CASE WHEN l_returnflag = 'R' THEN '10-K' WHEN l_returnflag = 'A' THEN '10-Q' ELSE 'DEF 14A' END AS f,
    CASE WHEN l_linenumber = 3 THEN '' ELSE printf('%010d-%02d-%06d', l_suppkey, l_linenumber, l_partkey) END AS acc,
    'doc' || CAST(l_partkey AS VARCHAR) || '.htm' AS d, strftime(l_shipdate, '%Y-%m-%d') AS fdate, l_linestatus = 'O' AS is_open
  FROM lineitem),
z AS (
  SELECT l_orderkey, l_linenumber, l_partkey, cik, 0 AS idx, CASE WHEN is_open THEN f ELSE 'S-1' END AS form,
    CASE WHEN is_open THEN acc ELSE acc || '-s' END AS accession, CASE WHEN is_open THEN d ELSE '' END AS document,
    fdate AS filing_date FROM lines
  UNION ALL
  SELECT l_orderkey, l_linenumber, l_partkey, cik, 1, CASE WHEN is_open THEN '8-K' ELSE f END,
    CASE WHEN is_open THEN acc || '-8' ELSE acc END, CASE WHEN is_open THEN 'event.htm' ELSE d END, NULL FROM lines),
filings AS (
  SELECT l_orderkey, l_linenumber, l_partkey, cik, CAST(idx AS INTEGER) AS idx, form, accession, document, filing_date,
    'https://www.sec.gov/Archives/edgar/data/' || CAST(CAST(cik AS BIGINT) AS VARCHAR) || '/' ||
      replace(accession, '-', '') || '/' || document AS sec_url,
    CASE form
      WHEN '10-K' THEN 'annual business/risk extraction; financial statement grounding; management discussion retrieval'
      WHEN '10-Q' THEN 'quarterly update monitor; trend and guidance comparison; working capital change extraction'
      WHEN '8-K' THEN 'event detection; material change alerts; deal/executive/earnings trigger extraction'
      ELSE 'governance signal extraction; shareholder proposal analysis; board and compensation review' END AS agent_use
  FROM z
  WHERE form IN ('10-K', '10-Q', '8-K', 'DEF 14A') AND coalesce(accession, '') <> '' AND coalesce(document, '') <> '')"""


def _company_sql() -> str:
    from ..operators.facts import METRICS as METRIC_ROWS
    from .facts import CONCEPTS, EPS
    dim = ", ".join(f"('{m}', '{label.replace(chr(39), chr(39) * 2)}', '{c}', {i}, '{unit}')" for m, label, cs, unit in METRIC_ROWS for i, c in enumerate(cs))
    names = ", ".join(f"'{c}'" for c in CONCEPTS)
    return f"""dim(metric, label, concept, concept_ordinal, wanted) AS (VALUES {dim}),
li AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_linestatus, l_returnflag, l_shipdate,
  [{names}][l_partkey % {len(CONCEPTS)} + 1] AS concept FROM lineitem),
entries AS (
  SELECT *, 0 AS k, 'AUD' AS unit, l_extendedprice * 2 AS v FROM li WHERE l_returnflag = 'R'
  UNION ALL SELECT *, 1, CASE WHEN l_linestatus = 'F' THEN 'USD' ELSE 'EUR' END || CASE WHEN concept = '{EPS}' THEN '/shares' ELSE '' END, l_extendedprice FROM li),
used AS (SELECT l_orderkey, e.concept, any_value(d.wanted) AS wanted, CASE WHEN bool_or(unit = d.wanted) THEN any_value(d.wanted)
  ELSE arg_min(unit, (l_linenumber, l_partkey, l_extendedprice, k)) END AS used_unit FROM entries e JOIN dim d ON e.concept = d.concept GROUP BY l_orderkey, e.concept),
recs AS (SELECT o.o_custkey AS entity, e.l_orderkey, d.metric, d.label, e.concept, d.concept_ordinal, d.wanted AS unit, u.used_unit,
  row_number() OVER (PARTITION BY e.l_orderkey, e.concept ORDER BY l_linenumber, l_partkey, l_extendedprice, k) AS pos, v AS val, l_linenumber,
  CAST(year(l_shipdate) AS VARCHAR) AS fy, 'Q' || quarter(l_shipdate) AS fp, CASE WHEN l_linenumber % 2 = 1 THEN '10-K' ELSE '10-Q' END AS form,
  strftime(l_shipdate, '%Y-%m-%d') AS filed, strftime(CAST(l_shipdate AS DATE) - CAST(l_linenumber * 30 AS INTEGER), '%Y-%m-%d') AS "end"
  FROM entries e JOIN used u ON e.l_orderkey = u.l_orderkey AND e.concept = u.concept AND e.unit = u.used_unit
  JOIN dim d ON d.concept = e.concept JOIN orders o ON o.o_orderkey = e.l_orderkey),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity, form, metric
  ORDER BY filed || '-' || "end" DESC, concept_ordinal, l_orderkey, pos) AS rn FROM recs WHERE l_linenumber % 6 <> 0) q WHERE rn = 1)"""


def _w(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def queries() -> dict[str, str]:
    q = {}
    q["explode_nested_facts"] = _w(FACTS) + """
SELECT l_orderkey, l_linenumber, l_partkey, entity, concept, 'USD' AS unit, 0 AS pos, val, fy, fp, form, filed, "end"
FROM facts WHERE unit = 'USD'
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, entity, concept, 'AUD', 0, val * 2, fy, fp, form, filed, "end"
FROM facts WHERE unit <> 'USD' AND l_returnflag = 'R'
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, entity, concept, unit, 0, val, fy, fp, form, filed, "end"
FROM facts WHERE unit <> 'USD' AND l_returnflag <> 'R'"""
    q["latest_fact"] = _w(FACTS, METRICS, LATEST) + \
        'SELECT entity, form, concept, val, filed, "end", l_orderkey, l_linenumber FROM latest'
    q["preferred_concept"] = _w(FACTS, METRICS, LATEST, PREFERRED) + \
        'SELECT entity, form, metric, concept, val, filed, "end" FROM preferred'
    q["unpivot_metrics"] = _w(FACTS, METRICS, LATEST, PREFERRED) + """
SELECT entity, CASE WHEN form = '10-K' THEN 'annual' ELSE 'quarterly' END AS period_type, metric AS metric_key,
  concept, val AS value, coalesce(CAST(fy AS VARCHAR), '') AS fy, coalesce(fp, '') AS fp, coalesce(form, '') AS form,
  coalesce(filed, '') AS filed, coalesce("end", '') AS "end" FROM preferred"""
    q["zip_explode_filings"] = _w(FILINGS) + \
        ("SELECT l_orderkey, l_linenumber, l_partkey, cik, idx, form, accession, document, filing_date, sec_url, "
         "agent_use FROM filings")
    q["recent_filings"] = _w(FILINGS) + """
SELECT o_custkey, CAST(rank AS INTEGER) AS rank, l_orderkey, idx, form, sec_url FROM (
  SELECT o.o_custkey, f.*, row_number() OVER (PARTITION BY o.o_custkey
    ORDER BY f.l_orderkey, f.l_linenumber, f.l_partkey, f.accession, f.idx) AS rank
  FROM filings f JOIN orders o ON f.l_orderkey = o.o_orderkey) q WHERE rank <= 10"""
    q["window_change_pct"] = """
SELECT user_id, newest, oldest,
  CASE WHEN oldest <> 0 THEN floor((newest - oldest) / oldest * 100 * 100 + 0.5) / 100 END AS change_pct
FROM (SELECT user_id, arg_max(value, (ts, event_id)) AS newest, arg_min(value, (ts, event_id)) AS oldest
      FROM events GROUP BY user_id) q"""
    q["last_n_per_key"] = """
SELECT event_type, CAST(25 - rn AS INTEGER) AS position, event_id, ts, value FROM (
  SELECT event_type, event_id, ts, value,
    row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn
  FROM (SELECT event_type, event_id, ts,
          CASE WHEN raw_value IN ('.', '') THEN NULL ELSE TRY_CAST(raw_value AS DOUBLE) END AS value
        FROM (SELECT event_type, event_id, ts,
                CASE WHEN value < 1 THEN '.' ELSE CAST(value AS VARCHAR) END AS raw_value FROM events) a) b
  WHERE value IS NOT NULL AND isfinite(value)) c WHERE rn <= 24"""
    q["latest_per_key"] = """
SELECT user_id, b.event_id, b.event_type, b.value FROM (
  SELECT user_id, arg_max({'event_id': event_id, 'event_type': event_type, 'value': value}, (ts, event_id)) AS b
  FROM events GROUP BY user_id) q"""
    q["share_of_total"] = """
SELECT event_type, records, CAST(round(CAST(records * 100 AS DECIMAL(38,6)) / sum(records) OVER (), 2) AS DOUBLE) AS share_pct
FROM (SELECT event_type, count(*) AS records FROM events GROUP BY event_type) q"""
    q["dataset_cards"] = _w(FILINGS) + """
SELECT 'dataset-fundamentals' AS card_id, 'example_entities' AS measure, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS n FROM lineitem
UNION ALL SELECT 'dataset-filing-events', 'record_count', CAST(count(*) AS BIGINT) FROM filings
UNION ALL SELECT 'dataset-macro-panel', 'indicator_count', CAST(count(DISTINCT event_type) AS BIGINT) FROM events
UNION ALL SELECT 'dataset-recent-ohlcv', 'record_count', CAST(count(*) AS BIGINT) FROM events"""
    q["parse_money"] = """
SELECT o_orderkey, price_str,
  CASE WHEN price_str IS NULL OR trim(regexp_replace(price_str, '[$,]', '', 'g')) = '' THEN 0.0
       ELSE coalesce(TRY_CAST(trim(regexp_replace(price_str, '[$,]', '', 'g')) AS DOUBLE), 'NaN'::DOUBLE) END AS price
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '' ELSE '$' || format('{:,.2f}', o_totalprice) END AS price_str
      FROM orders) q"""
    q["us_date_to_iso"] = """
SELECT o_orderkey, us_date,
  CASE WHEN coalesce(split_part(us_date, '/', 1), '') <> '' AND coalesce(split_part(us_date, '/', 2), '') <> ''
        AND coalesce(split_part(us_date, '/', 3), '') <> ''
       THEN split_part(us_date, '/', 3) || '-' || lpad(split_part(us_date, '/', 1), 2, '0') || '-' ||
            lpad(split_part(us_date, '/', 2), 2, '0') ELSE '' END AS iso_date
FROM (SELECT o_orderkey, CASE WHEN starts_with(o_orderpriority, '1')
        THEN CAST(month(o_orderdate) AS VARCHAR) || '/' || CAST(year(o_orderdate) AS VARCHAR)
        ELSE CAST(month(o_orderdate) AS VARCHAR) || '/' || CAST(day(o_orderdate) AS VARCHAR) || '/' ||
             CAST(year(o_orderdate) AS VARCHAR) END AS us_date FROM orders) q"""
    tiers = []
    for suf, p in (("", 0), ("K", 3), ("M", 6), ("B", 9)):
        tiers.append(f"WHEN abs(round(total / {10 ** p}, 2)) < 1000 THEN regexp_replace(regexp_replace("
                     f"CAST(CAST(round(total / {10 ** p}, 2) AS DECIMAL(38,2)) AS VARCHAR), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') || '{suf}'")
    tiers.append("ELSE regexp_replace(regexp_replace(CAST(CAST(round(total / 1000000000000, 2) AS DECIMAL(38,2)) AS VARCHAR), "
                 "'(\\.\\d*?)0+$', '\\1'), '\\.$', '') || 'T'")
    q["compact_number"] = ("SELECT l_suppkey, CAST(total AS DOUBLE) AS total, CASE WHEN total IS NULL THEN 'n/a' "
                           + " ".join(tiers) + " END || ' USD' AS compact FROM (SELECT l_suppkey, "
                           "sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS total FROM lineitem GROUP BY l_suppkey) q")
    q["company_metrics"] = _w(_company_sql()) + """
SELECT entity, CASE WHEN form = '10-K' THEN 'annual' ELSE 'quarterly' END AS period_type, metric AS metric_key, label, concept, unit, used_unit,
  val AS value, fy, fp, form, filed, "end" FROM best"""
    q["company_snapshot"] = _w(_company_sql(), FILINGS).rstrip() + """,
m AS (SELECT entity, string_agg(metric || ':' || concept || ':' || filed || ':' || fy, ',' ORDER BY metric) FILTER (WHERE form = '10-K') AS annual,
  sum(val) FILTER (WHERE form = '10-K') AS annual_total,
  string_agg(metric || ':' || concept || ':' || filed || ':' || fy, ',' ORDER BY metric) FILTER (WHERE form = '10-Q') AS quarterly,
  sum(val) FILTER (WHERE form = '10-Q') AS quarterly_total FROM best GROUP BY entity),
f AS (SELECT o_custkey, string_agg(concat_ws('@', form, filing_date, sec_url), ',' ORDER BY rn) AS filings FROM (
  SELECT o.o_custkey, f.*, row_number() OVER (PARTITION BY o.o_custkey ORDER BY f.l_orderkey, f.l_linenumber, f.l_partkey, f.idx) AS rn
  FROM filings f JOIN orders o ON f.l_orderkey = o.o_orderkey) q WHERE rn <= 3 GROUP BY o_custkey),
p AS (SELECT user_id, arg_max(value, (ts, event_id)) AS newest, arg_min(value, (ts, event_id)) AS oldest,
  arg_max(CAST(json_extract(props, '$.k') AS DOUBLE), (ts, event_id)) AS volume
  FROM events WHERE ts IS NOT NULL AND isfinite(value) GROUP BY user_id)
SELECT c.c_custkey, c.c_name AS name, c.c_mktsegment AS sector, n.n_name AS domicile, coalesce(annual, '') AS annual,
  round(coalesce(annual_total, 0.0), 2) AS annual_total, coalesce(quarterly, '') AS quarterly, round(coalesce(quarterly_total, 0.0), 2) AS quarterly_total,
  coalesce(filings, '') AS filings, newest AS close, volume,
  CASE WHEN oldest <> 0 THEN floor((newest - oldest) / oldest * 100 * 100 + 0.5) / 100 END AS change_pct, 5 AS n_fields
FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN m ON m.entity = c.c_custkey
LEFT JOIN f ON f.o_custkey = c.c_custkey LEFT JOIN p ON p.user_id = c.c_custkey"""
    q["entity_snapshot"] = _w(FACTS, METRICS, LATEST, PREFERRED) + """
SELECT s.s_suppkey, s.s_name, n.n_name, coalesce(m.n_annual, 0) AS n_annual, coalesce(m.n_quarterly, 0) AS n_quarterly,
  m.latest_filed, m.annual_revenue
FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
LEFT JOIN (SELECT entity, count(*) FILTER (WHERE form = '10-K') AS n_annual, count(*) FILTER (WHERE form = '10-Q') AS n_quarterly,
  max(filed) AS latest_filed, max(val) FILTER (WHERE form = '10-K' AND metric = 'revenue') AS annual_revenue
  FROM preferred GROUP BY entity) m ON s.s_suppkey = m.entity"""
    return q
