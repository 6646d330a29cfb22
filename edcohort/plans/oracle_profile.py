"""Oracle SQL (DuckDB) for the profiling and manifest queries."""

from __future__ import annotations

import json

from ..sources.labdim import LAB_GROUPS
from .oracle import with_mapping
from .oracle_sql import COHORT, _r6, labelled_ctes, labs_ctes
from .oracle_text import NOTES_NE, prepared_ctes, split_ctes

# Spark type names of the cohort columns (schema facts, for type reports)
COHORT_TYPES = {
    "stay_id": "bigint", "subject_id": "bigint", "hadm_id": "bigint", "intime": "timestamp_ntz",
    "outtime": "timestamp_ntz", "gender": "string", "anchor_age": "int", "anchor_year": "int",
    "admittime": "timestamp_ntz", "dischtime": "timestamp_ntz", "hospital_expire_flag": "int",
    "temperature": "double", "heartrate": "double", "resprate": "double", "o2sat": "double",
    "sbp": "double", "dbp": "double", "acuity": "double", "pain": "string", "chiefcomplaint": "string",
    "age_at_ed": "int", "triage_completeness": "int", "ed_los_hours": "double",
    "lengthened_ed_stay": "int", "hospital_death": "int", "age_group": "string"}
NUMERIC = {"bigint", "int", "double"}
TABLE_COLUMNS = {"edstays": 5, "patients": 4, "triage": 10, "admissions": 5, "icustays": 4,
                 "labevents": 5, "notes": 8}


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def describe_sql(src: str, cols: list[str], by: str | None = None) -> str:
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        q = f"quantile_cont({x}, [0.25, 0.5, 0.75, 0.95])"
        sel = (f"{by + ', ' if by else ''}'{c}' AS column, count({x}) AS count, {_r6(f'avg({x})')} AS mean, "
               f"{_r6(f'stddev_samp({x})')} AS std, {_r6(f'min({x})')} AS min, {_r6(f'{q}[1]')} AS p25, "
               f"{_r6(f'{q}[2]')} AS p50, {_r6(f'{q}[3]')} AS p75, {_r6(f'max({x})')} AS max, "
               f"{_r6(f'{q}[4]')} AS p95")
        parts.append(f"SELECT {sel} FROM {src}" + (f" GROUP BY {by}" if by else ""))
    return _union(parts)


def profile_queries() -> dict[str, str]:
    from .catalog import COHORT_COLS, COMPLETENESS_COLS, EXPECTED_ABSENT, FEATURE_SUMMARY_COLS, MANIFEST_CONFIG
    q: dict[str, str] = {}
    m = with_mapping
    fs = []
    for c in FEATURE_SUMMARY_COLS:
        x = f"CAST({c} AS DOUBLE)"
        kind = "Triage" if c.startswith("triage_") else "Laboratory"
        fs.append(f"SELECT '{c}' AS feature, '{kind}' AS kind, {_r6(f'count({x}) * 100.0 / count(*)')} AS "
                  f"completeness_pct, {_r6(f'avg({x})')} AS mean, {_r6(f'stddev_samp({x})')} AS std, "
                  f"{_r6(f'min({x})')} AS min, {_r6(f'max({x})')} AS max FROM labelled")
    q["feature_summary"] = m(labelled_ctes() + "\n" + _union(fs))
    q["los_describe"] = m(labelled_ctes() + "\n" + describe_sql("labelled", ["ed_los_hours"]))
    q["note_length_describe"] = m(prepared_ctes() + "\n" + describe_sql(
        "prep", ["cleaned_length", "original_length"], by="note_category"))
    q["lab_value_describe"] = m(COHORT + labs_ctes() + "\n" + describe_sql("labs_g", ["valuenum"], by="lab_group"))
    q["lab_value_box"] = m(COHORT + labs_ctes() + f""",
qq AS (SELECT lab_group, quantile_cont(valuenum, [0.25, 0.5, 0.75]) AS q FROM labs_g GROUP BY lab_group),
k AS (SELECT l.lab_group, valuenum AS v, q[1] AS q1, q[2] AS median, q[3] AS q3,
        valuenum >= q[1] - 1.5 * (q[3] - q[1]) AND valuenum <= q[3] + 1.5 * (q[3] - q[1]) AS inside
      FROM labs_g l JOIN qq USING (lab_group))
SELECT lab_group, count(*) AS n, {_r6('q1')} AS q1, {_r6('median')} AS median, {_r6('q3')} AS q3,
  {_r6('min(v) FILTER (WHERE inside)')} AS whisker_lo, {_r6('max(v) FILTER (WHERE inside)')} AS whisker_hi,
  count(*) FILTER (WHERE NOT inside) AS n_outliers FROM k GROUP BY lab_group, q1, median, q3""")
    inv = [f"SELECT '{t}' AS \"table\", count(*) AS n_rows, {n} AS n_columns FROM {t}"
           for t, n in TABLE_COLUMNS.items()]
    q["table_inventory"] = m(_union(inv))
    from .oracle_sql import _relevant_items
    inv2 = [f"SELECT '{t}' AS \"table\", count(*) AS n_rows, {n} AS n_columns FROM {t}"
            for t, n in TABLE_COLUMNS.items() if t != "labevents"]
    inv2.append(f"""SELECT 'labevents', count(*), 5 FROM labevents l WHERE l.valuenum IS NOT NULL
      AND l.itemid IN ({_relevant_items()}) AND EXISTS (SELECT 1 FROM patients p WHERE p.subject_id = l.subject_id)""")
    q["load_table_counts"] = m(_union(inv2))
    q["value_counts"] = m(COHORT + f"""
SELECT age_group, count(*) AS n,
  {_r6('count(*) / (SELECT count(*) FROM cohort WHERE age_group IS NOT NULL)')} AS share
FROM cohort WHERE age_group IS NOT NULL GROUP BY age_group""")
    q["outcome_means"] = m(labelled_ctes() + f"""
SELECT critical_outcome, count(*) AS n, {_r6('avg(age_at_ed)')} AS age_mean,
  {_r6('avg(ed_los_hours)')} AS los_mean, {_r6('avg(total_lab_groups_ordered)')} AS lab_groups_mean
FROM labelled GROUP BY critical_outcome""")
    comp = [f"SELECT '{c}' AS column, '{COHORT_TYPES[c]}' AS dtype, true AS present, count({c}) AS non_null, "
            f"count(*) - count({c}) AS missing, {_r6(f'count({c}) * 100.0 / count(*)')} AS completeness_pct "
            f"FROM cohort" for c in COMPLETENESS_COLS]
    comp += [f"SELECT '{c}', NULL, false, CAST(0 AS BIGINT), count(*), {_r6('0.0')} FROM cohort"
             for c in EXPECTED_ABSENT]
    q["completeness"] = m(COHORT + "\n" + _union(comp))
    meta = []
    for c in COHORT_COLS:
        t = COHORT_TYPES[c]
        x = f"CAST({c} AS DOUBLE)"
        stats = (f"{_r6(f'avg({x})')}, {_r6(f'min({x})')}, {_r6(f'max({x})')}" if t in NUMERIC
                 else "NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE")
        meta.append(f"SELECT '{c}' AS column, '{t}' AS dtype, "
                    f"{_r6(f'(count(*) - count({c})) * 100.0 / count(*)')} AS null_pct, {stats} FROM cohort")
    q["column_metadata"] = m(COHORT + ',\nmeta("column", dtype, null_pct, mean, min, max) AS (\n'
                             + _union(meta) + ")\nSELECT * FROM meta")
    util = [f"SELECT '{g}' AS lab_group, {_r6(f'avg(CAST(lab_{g}_ordered AS DOUBLE)) * 100.0')} AS pct_ordered, "
            f"{_r6('avg(total_lab_groups_ordered)')} AS mean_groups_per_stay, "
            f"count(*) FILTER (WHERE total_lab_groups_ordered = 0) AS stays_without_labs FROM labelled"
            for g in LAB_GROUPS]
    q["lab_utilization_pct"] = m(labelled_ctes() + "\n" + _union(util))
    q["histogram"] = m(labelled_ctes() + f""",
v AS (SELECT ed_los_hours AS v FROM labelled WHERE ed_los_hours <= 100),
st0 AS (SELECT min(v) AS lo0, max(v) AS hi0 FROM v),
st AS (SELECT CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
              CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM st0),
b AS (SELECT least(CAST(floor((v - lo) / (hi - lo) * 50) AS BIGINT) + 1, 50) AS bin FROM v, st),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin),
e AS (SELECT CAST(unnest(generate_series(1, 50)) AS INTEGER) AS bin, lo, hi FROM st)
SELECT e.bin, {_r6('lo + (e.bin - 1) * ((hi - lo) / 50)')} AS bin_lo, {_r6('lo + e.bin * ((hi - lo) / 50)')}
  AS bin_hi, COALESCE(c.n, 0) AS n FROM e LEFT JOIN c ON c.bin = e.bin""")
    q["box_stats"] = m(labelled_ctes() + f""",
v AS (SELECT critical_outcome, ed_los_hours AS v FROM labelled WHERE ed_los_hours IS NOT NULL),
qq AS (SELECT critical_outcome, quantile_cont(v, [0.25, 0.5, 0.75]) AS q FROM v GROUP BY critical_outcome),
j AS (SELECT v.critical_outcome, v.v, q[1] AS q1, q[2] AS median, q[3] AS q3 FROM v JOIN qq USING (critical_outcome)),
k AS (SELECT *, v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) AS inside FROM j)
SELECT critical_outcome, count(*) AS n, {_r6('q1')} AS q1, {_r6('median')} AS median, {_r6('q3')} AS q3,
  {_r6('min(v) FILTER (WHERE inside)')} AS whisker_lo, {_r6('max(v) FILTER (WHERE inside)')} AS whisker_hi,
  count(*) FILTER (WHERE NOT inside) AS n_outliers FROM k GROUP BY critical_outcome, q1, median, q3""")
    q["row_loss"] = m(labelled_ctes() + """,
u AS (SELECT 0 AS stage_no, 'stays' AS stage, (SELECT count(*) FROM edstays) AS n_rows
      UNION ALL SELECT 1, 'joined', (SELECT count(*) FROM joined)
      UNION ALL SELECT 2, 'cohort', (SELECT count(*) FROM cohort)
      UNION ALL SELECT 3, 'labelled', (SELECT count(*) FROM labelled))
SELECT stage_no, stage, n_rows, (SELECT count(*) FROM edstays) - n_rows AS rows_lost FROM u""")
    sp = []
    cols = [("note_id", "string"), ("subject_id", "bigint"), ("hadm_id", "bigint"), ("note_type", "string"),
            ("category_priority", "int"), ("charttime", "timestamp_ntz"), ("text", "string")]
    for cat in ("discharge", "radiology"):
        for c, t in cols:
            sp.append(f"SELECT '{cat}' AS source, '{c}' AS column, '{t}' AS dtype, count({c}) AS non_null, "
                      f"count(*) AS n_rows FROM notes WHERE note_category = '{cat}'")
    q["source_profile"] = m(_union(sp))
    q["sampled_tables"] = m("""
s AS (SELECT * FROM edstays ORDER BY stay_id LIMIT 500)
SELECT 'edstays' AS "table", count(*) AS n_rows, 5 AS n_columns FROM s
UNION ALL SELECT 'patients', count(*), 4 FROM patients p WHERE p.subject_id IN (SELECT subject_id FROM s)
UNION ALL SELECT 'triage', count(*), 10 FROM triage t WHERE t.stay_id IN (SELECT stay_id FROM s)
UNION ALL SELECT 'admissions', count(*), 5 FROM admissions a WHERE a.hadm_id IN (SELECT hadm_id FROM s)
UNION ALL SELECT 'icustays', count(*), 4 FROM icustays i WHERE i.hadm_id IN (SELECT hadm_id FROM s)""")
    per = []
    for s in ("train", "val", "test"):
        per.append(f"count(*) FILTER (WHERE split = '{s}') AS n_{s}, "
                   f"count(*) FILTER (WHERE split = '{s}' AND outcome = 1) AS pos_{s}, "
                   f"{_r6(f'avg(CASE WHEN split = {chr(39)}{s}{chr(39)} THEN CAST(outcome AS DOUBLE) END) * 100.0')}"
                   f" AS rate_{s}")
    cfg = json.dumps(MANIFEST_CONFIG, sort_keys=True).replace("'", "''")
    q["run_manifest"] = m(split_ctes() + f"""
SELECT count(*) AS n_total, {_r6('avg(CAST(has_text AS DOUBLE))')} AS text_coverage, {', '.join(per)},
  '{cfg}' AS config FROM sp""")
    return q
