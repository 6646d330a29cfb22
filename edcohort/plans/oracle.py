"""DuckDB twin of the fixture mapping, used by the SQL oracle.

``mapping_sql()`` returns the CTE list that derives the clinical-shaped
tables from the driver views (orders, customer, lineitem, documents); each
oracle query is ``WITH <mapping>, <query ctes> SELECT ...``.
"""

from __future__ import annotations

from ..sources.fixtures import BLANK_NOTES
from ..sources.labdim import GROUP_MINUTES, LAB_GROUPS, item_to_group


def lab_dim_values() -> str:
    groups = item_to_group()
    rows = ", ".join(f"({i}, {item}, '{groups[item]}', {GROUP_MINUTES[groups[item]]})"
                     for i, item in enumerate(sorted(groups)))
    return f"SELECT * FROM (VALUES {rows}) AS v(pos, itemid, lab_group, group_minutes)"


def group_dim_values() -> str:
    rows = ", ".join(f"('{g}', {i}, {GROUP_MINUTES[g]})" for i, g in enumerate(LAB_GROUPS))
    return f"SELECT * FROM (VALUES {rows}) AS v(lab_group, group_pos, group_minutes)"


def mapping_sql() -> str:
    return f"""
lab_dim AS ({lab_dim_values()}),
group_dim AS ({group_dim_values()}),
edstays AS (
  SELECT o_orderkey AS stay_id, o_custkey AS subject_id,
    CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 20000000 + o_orderkey END AS hadm_id,
    o_orderdate + (o_orderkey % 24) * INTERVAL '1' HOUR AS intime,
    o_orderdate + (o_orderkey % 24 + CASE WHEN o_orderkey % 50 = 0 THEN -2
       WHEN o_orderkey % 50 = 1 THEN 200 ELSE o_orderkey % 36 END) * INTERVAL '1' HOUR AS outtime
  FROM orders),
patients AS (
  SELECT c_custkey AS subject_id,
    CASE WHEN c_custkey % 97 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
    CAST(10 + c_custkey % 85 AS INTEGER) AS anchor_age, 1995 AS anchor_year
  FROM customer),
triage AS (
  SELECT o_orderkey AS stay_id,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 96 + CAST(o_orderkey % 60 AS DOUBLE) / 10 END AS temperature,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(50 + o_orderkey % 90 AS DOUBLE) END AS heartrate,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(10 + o_orderkey % 20 AS DOUBLE) END AS resprate,
    CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(85 + o_orderkey % 16 AS DOUBLE) END AS o2sat,
    CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(90 + o_orderkey % 100 AS DOUBLE) END AS sbp,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(50 + o_orderkey % 60 AS DOUBLE) END AS dbp,
    CAST(1 + o_orderkey % 5 AS DOUBLE) AS acuity,
    CASE WHEN o_orderkey % 9 = 0 THEN 'unable' ELSE CAST(o_orderkey % 11 AS VARCHAR) END AS pain,
    o_orderpriority || '|' || o_orderstatus AS chiefcomplaint
  FROM orders),
admissions AS (
  SELECT subject_id, hadm_id, outtime AS admittime,
    outtime + (24 * (1 + stay_id % 9)) * INTERVAL '1' HOUR AS dischtime,
    CASE WHEN stay_id % 70 = 2 THEN 1 WHEN stay_id % 70 = 3 THEN NULL ELSE 0 END AS hospital_expire_flag
  FROM edstays WHERE hadm_id IS NOT NULL),
icustays AS (
  SELECT subject_id, hadm_id, 30000000 + stay_id AS icu_stay_id,
    outtime + (stay_id % 30 - 5) * INTERVAL '1' HOUR AS intime
  FROM edstays WHERE hadm_id IS NOT NULL AND stay_id % 10 = 3),
labevents AS (
  SELECT e.subject_id, e.hadm_id, COALESCE(d.itemid, 99999) AS itemid,
    e.intime + (l.l_linenumber * 3 - 4) * INTERVAL '1' HOUR AS charttime,
    CASE WHEN l.l_tax = 0.08 THEN NULL WHEN l.l_linenumber = 5 THEN l.l_quantity / 100000
         ELSE l.l_quantity END AS valuenum
  FROM lineitem l JOIN edstays e ON l.l_orderkey = e.stay_id
                  LEFT JOIN lab_dim d ON d.pos = l.l_partkey % 58),
notes AS (
  SELECT CAST(x.doc_id AS VARCHAR) AS note_id, e.subject_id, e.hadm_id,
    CASE WHEN x.doc_id % 4 = 0 THEN 'DS' ELSE 'RR' END AS note_type,
    CASE WHEN x.doc_id % 4 = 0 THEN 'discharge' ELSE 'radiology' END AS note_category,
    CASE WHEN x.doc_id % 4 = 0 THEN 1 ELSE 2 END AS category_priority,
    e.intime + ((x.doc_id * 5) % 60 - 6) * INTERVAL '1' HOUR AS charttime,
    x.text
  FROM (SELECT doc_id, text,
          ((of_doc // 3) * 7919) % (SELECT count(*) FROM orders) AS stay_id
        FROM (SELECT doc_id, text, doc_id AS of_doc FROM documents UNION ALL
              SELECT doc_id + {BLANK_NOTES}, NULL, doc_id FROM documents WHERE doc_id % 31 = 0) y) x
  JOIN edstays e ON e.stay_id = x.stay_id)"""


def with_mapping(body: str) -> str:
    """``body`` starts with further CTE definitions (``name AS (...), ...``)
    followed by the final SELECT, or is just a SELECT."""
    body = body.strip()
    if body.upper().startswith("SELECT"):
        return f"WITH {mapping_sql()}\n{body}"
    return f"WITH {mapping_sql()},\n{body}"
