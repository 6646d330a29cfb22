"""Oracle SQL per registered query (DuckDB dialect).

Shared CTE fragments mirror the Spark plans step by step; each query's SQL is
``with_mapping(<fragments>, <final select>)``. Doubles that come out of
averages or other float arithmetic are rounded to 6 places on both sides.
"""

from __future__ import annotations

from ..sources.labdim import LAB_GROUPS
from .oracle import with_mapping

TRIAGE7 = ["temperature", "heartrate", "resprate", "o2sat", "sbp", "dbp", "acuity"]
HOURS = "/ 3600000000.0"


def _hours(a: str, b: str) -> str:
    return f"((epoch_us({b}) - epoch_us({a})) {HOURS})"


JOINED = """
joined AS (
  SELECT e.stay_id, e.subject_id, e.hadm_id, e.intime, e.outtime,
         p.gender, p.anchor_age, p.anchor_year,
         a.admittime, a.dischtime, a.hospital_expire_flag,
         t.temperature, t.heartrate, t.resprate, t.o2sat, t.sbp, t.dbp, t.acuity,
         t.pain, t.chiefcomplaint
  FROM edstays e
  LEFT JOIN patients p ON p.subject_id = e.subject_id
  LEFT JOIN admissions a ON a.subject_id = e.subject_id AND a.hadm_id = e.hadm_id
  LEFT JOIN triage t ON t.stay_id = e.stay_id),
aged AS (
  SELECT *, CAST(anchor_age + (year(intime) - anchor_year) AS INTEGER) AS age_at_ed,
         CAST(""" + " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in TRIAGE7) + """ AS INTEGER)
           AS triage_completeness
  FROM joined)"""

COHORT = JOINED + """,
cohort AS (
  SELECT *,
    CASE WHEN ed_los_raw >= 0 AND ed_los_raw <= 168 THEN ed_los_raw END AS ed_los_hours,
    CAST(COALESCE(CASE WHEN ed_los_raw >= 0 AND ed_los_raw <= 168 THEN ed_los_raw END > 24, false) AS INTEGER)
      AS lengthened_ed_stay,
    CAST(COALESCE(hospital_expire_flag, 0) AS INTEGER) AS hospital_death,
    CASE WHEN age_at_ed > 0 AND age_at_ed <= 30 THEN '18-30'
         WHEN age_at_ed > 30 AND age_at_ed <= 60 THEN '31-60'
         WHEN age_at_ed > 60 AND age_at_ed <= 90 THEN '61-90'
         WHEN age_at_ed > 90 AND age_at_ed <= 120 THEN '90+' END AS age_group
  FROM (SELECT *, """ + _hours("intime", "outtime") + """ AS ed_los_raw FROM aged
        WHERE hadm_id IS NOT NULL AND age_at_ed BETWEEN 18 AND 120
          AND triage_completeness >= 5) c)"""

COHORT_COLS = ("stay_id, subject_id, hadm_id, intime, outtime, gender, anchor_age, anchor_year, "
               "admittime, dischtime, hospital_expire_flag, temperature, heartrate, resprate, "
               "o2sat, sbp, dbp, acuity, pain, chiefcomplaint, age_at_ed, triage_completeness, "
               "ed_los_hours, lengthened_ed_stay, hospital_death, age_group")


def sql_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    q["cohort_full"] = with_mapping(COHORT + f"\nSELECT {COHORT_COLS} FROM cohort")
    q["cohort_funnel"] = with_mapping(JOINED + """,
f AS (SELECT count(*) AS n0,
        count(*) FILTER (WHERE hadm_id IS NOT NULL) AS n1,
        count(*) FILTER (WHERE hadm_id IS NOT NULL AND age_at_ed BETWEEN 18 AND 120) AS n2,
        count(*) FILTER (WHERE hadm_id IS NOT NULL AND age_at_ed BETWEEN 18 AND 120
                         AND triage_completeness >= 5) AS n3 FROM aged)
SELECT 0 AS step_no, 'all_stays' AS step, n0 AS n_rows FROM f UNION ALL
SELECT 1, 'admitted', n1 FROM f UNION ALL
SELECT 2, 'adult', n2 FROM f UNION ALL
SELECT 3, 'triage_complete', n3 FROM f""")
    q.update(tabular_queries())
    from .catalog import CORR_FEATURES
    q["label_correlations"] = correlation_sql(CORR_FEATURES)
    q["label_correlations_signed"] = correlation_sql(CORR_FEATURES, top=20, signed=True)
    from .oracle_text import text_queries
    q.update(text_queries())
    from .oracle_profile import profile_queries
    q.update(profile_queries())
    return q


# ------------------------------------------------------------------ shared
def _r6(x: str) -> str:
    return f"round({x}, 6)"


JOINED_COLS = ("stay_id, subject_id, hadm_id, intime, outtime, gender, anchor_age, anchor_year, "
               "admittime, dischtime, hospital_expire_flag, temperature, heartrate, resprate, "
               "o2sat, sbp, dbp, acuity, pain, chiefcomplaint")
TRIAGE_FEATURES = """
  CAST(age_at_ed AS DOUBLE) AS triage_age,
  CAST(COALESCE(gender = 'M', false) AS INTEGER) AS triage_gender_male,
  CAST(COALESCE(gender = 'F', false) AS INTEGER) AS triage_gender_female,
  heartrate AS triage_heart_rate, resprate AS triage_respiratory_rate, sbp AS triage_sbp,
  dbp AS triage_dbp, temperature AS triage_temperature, o2sat AS triage_spo2,
  acuity AS triage_acuity, TRY_CAST(pain AS DOUBLE) AS triage_pain,
  COALESCE(chiefcomplaint, '') AS triage_chief_complaint"""
TRIAGE_FEATURE_COLS = ("triage_age, triage_gender_male, triage_gender_female, triage_heart_rate, "
                       "triage_respiratory_rate, triage_sbp, triage_dbp, triage_temperature, "
                       "triage_spo2, triage_acuity, triage_pain, triage_chief_complaint")


def _relevant_items() -> str:
    from ..sources.labdim import relevant_itemids
    return ", ".join(str(i) for i in relevant_itemids())


def labs_ctes(hours: float = 12.0) -> str:
    return f""",
labs_g AS (
  SELECT c.stay_id, l.subject_id, l.hadm_id, l.itemid, l.charttime, l.valuenum,
         {_hours('c.intime', 'l.charttime')} AS hours_from_ed, d.lab_group, d.group_minutes
  FROM labevents l
  JOIN cohort c ON l.subject_id = c.subject_id AND l.hadm_id = c.hadm_id
  JOIN lab_dim d ON d.itemid = l.itemid
  WHERE l.valuenum IS NOT NULL AND l.itemid IN ({_relevant_items()})
    AND l.charttime IS NOT NULL AND c.intime IS NOT NULL
    AND {_hours('c.intime', 'l.charttime')} >= 0 AND {_hours('c.intime', 'l.charttime')} <= {hours}),
first_long AS (
  SELECT stay_id, lab_group, valuenum, hours_from_ed FROM (
    SELECT *, row_number() OVER (PARTITION BY stay_id, lab_group
                                 ORDER BY hours_from_ed, itemid, valuenum) AS rn FROM labs_g) z
  WHERE rn = 1),
wide AS (
  SELECT stay_id, {", ".join(f"max(valuenum) FILTER (WHERE lab_group = '{g}') AS lab_{g}_value, "
                            f"max(hours_from_ed) FILTER (WHERE lab_group = '{g}') AS lab_{g}_time"
                            for g in LAB_GROUPS)}
  FROM first_long GROUP BY stay_id)"""


WIDE_COLS = ", ".join(f"lab_{g}_value, lab_{g}_time" for g in LAB_GROUPS)
FLAG_COLS = ", ".join(f"lab_{g}_ordered" for g in LAB_GROUPS)
LAB_FEATURE_COLS = f"{WIDE_COLS}, {FLAG_COLS}, total_lab_groups_ordered"


def features_ctes(hours: float = 12.0) -> str:
    from ..sources.labdim import GROUP_MINUTES
    flags = ", ".join(f"CAST(w.lab_{g}_value IS NOT NULL AS INTEGER) AS lab_{g}_ordered" for g in LAB_GROUPS)
    total = " + ".join(f"CAST(w.lab_{g}_value IS NOT NULL AS INTEGER)" for g in LAB_GROUPS)
    terms = [f"CASE WHEN lab_{g}_ordered = 1 THEN CAST({float(m)} AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END"
             for g, m in GROUP_MINUTES.items()]
    wcols = ", ".join(f"w.lab_{g}_value, w.lab_{g}_time" for g in LAB_GROUPS)
    return COHORT + labs_ctes(hours) + f""",
tri AS (SELECT *, {TRIAGE_FEATURES} FROM cohort),
feat AS (SELECT t.*, {wcols}, {flags}, CAST({total} AS INTEGER) AS total_lab_groups_ordered
         FROM tri t LEFT JOIN wide w ON w.stay_id = t.stay_id),
costs0 AS (SELECT *, ({' + '.join(terms)}) AS lab_time_cost_sequential,
                 greatest(CAST(0.0 AS DOUBLE), {', '.join(terms)}) AS lab_time_cost_parallel FROM feat),
costs1 AS (SELECT *, CAST(0.7 AS DOUBLE) * lab_time_cost_parallel + CAST(0.3 AS DOUBLE) * lab_time_cost_sequential
                 AS lab_time_cost_mixed FROM costs0),
costs AS (SELECT *, lab_time_cost_mixed / 60.0 AS lab_time_cost_hours,
                 (lab_time_cost_mixed / 60.0) / CASE WHEN ed_los_hours <> 0 THEN ed_los_hours END * 100.0
                   AS lab_time_pct_of_los FROM costs1)"""


COST_COLS = ["lab_time_cost_sequential", "lab_time_cost_parallel", "lab_time_cost_mixed",
             "lab_time_cost_hours", "lab_time_pct_of_los"]


def labelled_ctes(hours: float = 12.0) -> str:
    return features_ctes(hours) + f""",
icu_hit AS (
  SELECT DISTINCT c.stay_id FROM cohort c
  JOIN icustays i ON i.subject_id = c.subject_id AND i.hadm_id = c.hadm_id
  WHERE {_hours('c.outtime', 'i.intime')} >= 0 AND {_hours('c.outtime', 'i.intime')} <= 12),
labelled AS (
  SELECT f.*, CASE WHEN h.stay_id IS NULL THEN 0 ELSE 1 END AS icu_transfer_12h,
         CAST(f.hospital_death = 1 OR h.stay_id IS NOT NULL AS INTEGER) AS critical_outcome
  FROM costs f LEFT JOIN icu_hit h ON h.stay_id = f.stay_id)"""


def tabular_queries() -> dict[str, str]:
    from ..sources.labdim import LAB_GROUP_ITEMS
    q: dict[str, str] = {}
    m = with_mapping
    q["join_stays_patients"] = m("""SELECT e.stay_id, e.subject_id, e.hadm_id, e.intime, e.outtime,
      p.gender, p.anchor_age, p.anchor_year FROM edstays e LEFT JOIN patients p ON p.subject_id = e.subject_id""")
    q["join_stays_admissions"] = m("""SELECT e.stay_id, e.subject_id, e.hadm_id, e.intime, e.outtime,
      p.gender, p.anchor_age, p.anchor_year, a.admittime, a.dischtime, a.hospital_expire_flag
      FROM edstays e LEFT JOIN patients p ON p.subject_id = e.subject_id
      LEFT JOIN admissions a ON a.subject_id = e.subject_id AND a.hadm_id = e.hadm_id""")
    q["join_stays_triage"] = m(JOINED + f"\nSELECT {JOINED_COLS} FROM joined")
    q["cohort_admitted"] = m(JOINED + f"\nSELECT {JOINED_COLS} FROM joined WHERE hadm_id IS NOT NULL")
    q["cohort_adults"] = m(JOINED + f"""\nSELECT {JOINED_COLS}, age_at_ed FROM aged
      WHERE hadm_id IS NOT NULL AND age_at_ed BETWEEN 18 AND 120""")
    q["cohort_triage_complete"] = m(JOINED + f"""\nSELECT {JOINED_COLS}, age_at_ed, triage_completeness FROM aged
      WHERE hadm_id IS NOT NULL AND age_at_ed BETWEEN 18 AND 120 AND triage_completeness >= 5""")
    q["ed_los"] = m(COHORT + "\nSELECT stay_id, intime, outtime, ed_los_hours FROM cohort")
    q["stay_flags"] = m(COHORT + """\nSELECT stay_id, ed_los_hours, lengthened_ed_stay, hospital_expire_flag,
      hospital_death FROM cohort""")
    q["age_bands"] = m(COHORT + "\nSELECT stay_id, age_at_ed, age_group FROM cohort")
    q["pain_numeric"] = m("SELECT stay_id, pain, TRY_CAST(pain AS DOUBLE) AS pain_numeric FROM triage")
    q["triage_features"] = m(COHORT + f"\nSELECT stay_id, {TRIAGE_FEATURES} FROM cohort")
    vit = ["temperature", "heartrate", "resprate", "o2sat", "sbp", "dbp"]
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in vit)
    z = {c: f"({c} - m_{c}) / CASE WHEN s_{c} <> 0 THEN s_{c} END" for c in vit}
    zsel = ", ".join(f"{_r6(z[c])} AS {c}_zscore" for c in vit)
    asel = ", ".join(f"CAST(COALESCE(abs({z[c]}) > 2, false) AS INTEGER) AS {c}_abnormal" for c in vit)
    q["vital_zscores"] = m(COHORT + f""",
st AS (SELECT {stats} FROM cohort)
SELECT stay_id, {zsel}, {asel} FROM cohort, st""")
    risk = " + ".join(f"CAST(COALESCE(abs({z[c]}) > 2, false) AS INTEGER)" for c in vit)
    q["vital_risk_score"] = m(COHORT + f""",
st AS (SELECT {stats} FROM cohort)
SELECT stay_id, {risk} AS vital_risk_score FROM cohort, st""")
    q["temporal_features"] = m(COHORT + """
SELECT stay_id, intime, CAST(hour(intime) AS INTEGER) AS hour_of_day,
  CAST(isodow(intime) - 1 AS INTEGER) AS day_of_week,
  CAST(isodow(intime) - 1 >= 5 AS INTEGER) AS is_weekend,
  CAST(hour(intime) >= 20 OR hour(intime) <= 6 AS INTEGER) AS is_night FROM cohort""")
    q["semi_admissions"] = m(COHORT + """
SELECT a.* FROM admissions a WHERE EXISTS (
  SELECT 1 FROM cohort c WHERE c.subject_id = a.subject_id AND c.hadm_id = a.hadm_id)""")
    q["distinct_ids"] = m(COHORT + "\nSELECT DISTINCT subject_id FROM cohort")
    q["cohort_summary"] = m(COHORT + f"""
SELECT count(*) AS n_rows, count(DISTINCT subject_id) AS n_patients,
  {_r6('avg(age_at_ed)')} AS age_mean, min(age_at_ed) AS age_min, max(age_at_ed) AS age_max,
  {_r6("count(*) FILTER (WHERE gender = 'M') * 100.0 / count(*)")} AS pct_male,
  {_r6("count(*) FILTER (WHERE gender = 'F') * 100.0 / count(*)")} AS pct_female,
  {_r6('avg(ed_los_hours)')} AS los_mean, {_r6('median(ed_los_hours)')} AS los_median,
  {_r6('count(*) FILTER (WHERE lengthened_ed_stay = 1) * 100.0 / count(*)')} AS pct_lengthened,
  {_r6('count(*) FILTER (WHERE hospital_death = 1) * 100.0 / count(*)')} AS pct_death
FROM cohort""")
    # labs
    q["lab_scan_filtered"] = m(f"""SELECT l.* FROM labevents l
      WHERE l.valuenum IS NOT NULL AND l.itemid IN ({_relevant_items()})
        AND EXISTS (SELECT 1 FROM patients p WHERE p.subject_id = l.subject_id)""")
    for name, extra in (("lab_scan_full", ""), ("lab_scan_sample", """
      ORDER BY subject_id NULLS FIRST, hadm_id NULLS FIRST, charttime NULLS FIRST, itemid, valuenum LIMIT 20000""")):
        q[name] = m(f"""SELECT l.* FROM labevents l
      WHERE l.valuenum IS NOT NULL AND EXISTS (SELECT 1 FROM patients p WHERE p.subject_id = l.subject_id){extra}""")
    q["labs_first_half"] = m("""SELECT * FROM labevents WHERE valuenum IS NOT NULL
      ORDER BY subject_id NULLS FIRST, hadm_id NULLS FIRST, charttime NULLS FIRST, itemid NULLS FIRST, valuenum
      LIMIT (SELECT count(*) // 2 FROM labevents WHERE valuenum IS NOT NULL)""")
    q["load_tables_files"] = m(f"""SELECT 'edstays' AS "table", count(*) AS n_rows FROM edstays UNION ALL
      SELECT 'patients', 2 * count(*) FROM patients UNION ALL SELECT 'triage', count(*) FROM triage UNION ALL
      SELECT 'admissions', count(*) FROM admissions UNION ALL SELECT 'icustays', count(*) FROM icustays UNION ALL
      SELECT 'diagnoses_icd', count(*) FROM admissions UNION ALL
      SELECT 'labevents', count(*) FROM labevents l WHERE l.valuenum IS NOT NULL
        AND l.itemid IN ({_relevant_items()})""")
    vital = {c: f"CASE WHEN event_id % {stride} <> 0 THEN CAST({base} + event_id % {mod} AS DOUBLE) END"
             for c, stride, base, mod in (("temperature", 11, 96, 8), ("heartrate", 7, 50, 90), ("resprate", 5, 10, 20),
                                          ("o2sat", 3, 85, 16), ("sbp", 4, 90, 100), ("dbp", 13, 50, 60))}
    q["load_vitals_files"] = m(f"""
v AS (
  SELECT (event_id * 7919) % (2 * (SELECT count(*) FROM edstays)) AS stay_id, ts, event_type, event_id % 9 = 0 AS unable,
    {', '.join(f'{x} AS {c}' for c, x in vital.items())} FROM events)
SELECT event_type AS rhythm, count(*) AS n_rows, count(DISTINCT stay_id) AS n_stays, CAST(date_trunc('second', min(ts)) AS TIMESTAMP) AS first,
  count(*) FILTER (WHERE unable) AS n_unable, 11 AS n_columns, {', '.join(f'sum({c}) AS {c}_sum' for c in vital)}
FROM v WHERE stay_id IN (SELECT stay_id FROM edstays ORDER BY stay_id LIMIT 2000) GROUP BY event_type""")
    q["lab_group_distribution"] = m(COHORT + labs_ctes() + f"""
SELECT lab_group, count(*) AS n_results, {_r6('count(*) * 100.0 / (SELECT count(*) FROM labs_g)')} AS share_pct
FROM labs_g GROUP BY lab_group ORDER BY n_results DESC, lab_group LIMIT 5""")
    q["load_notes_files"] = m("""SELECT note_category, category_priority, count(*) AS n_notes,
      CAST(sum(length(text)) AS BIGINT) AS n_chars, count(DISTINCT hadm_id) AS n_admissions
      FROM notes WHERE text IS NOT NULL AND text <> '' AND hadm_id IS NOT NULL GROUP BY ALL""")
    q["labs_in_window"] = m(COHORT + labs_ctes() + """
SELECT stay_id, subject_id, hadm_id, itemid, charttime, valuenum, hours_from_ed FROM labs_g""")
    q["lab_group_lookup"] = m("""
lu AS (
  SELECT COALESCE(d.itemid, 99999) AS itemid FROM lineitem l
  JOIN edstays e ON l.l_orderkey = e.stay_id
  LEFT JOIN lab_dim d ON d.pos = l.l_partkey % 58)
SELECT lu.itemid, COALESCE(d.lab_group, 'UNKNOWN') AS lab_group, COALESCE(d.group_minutes, 0) AS group_minutes,
  count(*) AS n_results FROM lu LEFT JOIN lab_dim d ON d.itemid = lu.itemid GROUP BY ALL""")
    q["labs_first_value"] = m(COHORT + labs_ctes() + "\nSELECT * FROM first_long")
    q["labs_mean_value"] = m(COHORT + labs_ctes() + f"""
SELECT stay_id, lab_group, {_r6('avg(valuenum)')} AS valuenum, min(hours_from_ed) AS hours_from_ed
FROM labs_g GROUP BY stay_id, lab_group""")
    q["labs_wide"] = m(COHORT + labs_ctes() + "\nSELECT * FROM wide")
    q["lab_utilization"] = m(features_ctes() + f"\nSELECT stay_id, {FLAG_COLS}, total_lab_groups_ordered FROM feat")
    q["lab_features"] = m(features_ctes() + f"\nSELECT stay_id, {LAB_FEATURE_COLS} FROM feat")
    q["lab_time_costs"] = m(features_ctes() + "\nSELECT stay_id, ed_los_hours, "
                            + ", ".join(f"{_r6(c)} AS {c}" for c in COST_COLS) + " FROM costs")
    cfg = ", ".join(f"('{g}', {i}, {item})" for g, items in LAB_GROUP_ITEMS.items()
                    for i, item in enumerate(items))
    q["lab_items_missing"] = m(f"""
cfg AS (SELECT * FROM (VALUES {cfg}) v(lab_group, item_pos, itemid)),
dict AS (SELECT DISTINCT d.itemid FROM part p JOIN lab_dim d ON d.pos = p.p_partkey % 58 WHERE d.itemid % 7 <> 3)
SELECT lab_group, count(*) AS n_missing,
  string_agg(CAST(itemid AS VARCHAR), ',' ORDER BY item_pos, itemid) AS missing_itemids
FROM cfg WHERE itemid NOT IN (SELECT itemid FROM dict) GROUP BY lab_group""")
    # labels
    q["hospital_death"] = m(COHORT + "\nSELECT stay_id, hospital_death FROM cohort")
    q["icu_transfer_12h"] = m(labelled_ctes() + "\nSELECT stay_id, outtime, icu_transfer_12h FROM labelled")
    q["critical_outcome"] = m(labelled_ctes() + """
SELECT stay_id, hospital_death, icu_transfer_12h, critical_outcome FROM labelled""")
    q["lengthened_ed_stay"] = m(JOINED + f"""
SELECT stay_id, CAST(COALESCE({_hours('intime', 'outtime')} > 24, false) AS INTEGER) AS lengthened_ed_stay
FROM joined WHERE hadm_id IS NOT NULL""")
    q["all_labels"] = m(labelled_ctes() + """
SELECT stay_id, hospital_death, icu_transfer_12h, critical_outcome, lengthened_ed_stay FROM labelled""")
    q["labels_from_stage"] = q["all_labels"]
    cost_sel = ", ".join(f"{_r6(c)} AS {c}" for c in COST_COLS)
    q["labelled_stays"] = m(labelled_ctes() + f"""
SELECT {COHORT_COLS}, {TRIAGE_FEATURE_COLS}, {LAB_FEATURE_COLS}, {cost_sel},
  icu_transfer_12h, critical_outcome FROM labelled""")
    q["label_summary"] = m(labelled_ctes() + f""",
s AS (SELECT count(*) AS n, sum(critical_outcome) AS c, sum(lengthened_ed_stay) AS l FROM labelled)
SELECT 'critical_outcome' AS label, CAST(c AS BIGINT) AS n_pos, {_r6('c * 100.0 / n')} AS pct_pos,
  CAST(n - c AS BIGINT) AS n_neg, {_r6('100.0 - c * 100.0 / n')} AS pct_neg, 9.67::DOUBLE AS paper_pct FROM s
UNION ALL
SELECT 'lengthened_ed_stay', CAST(l AS BIGINT), {_r6('l * 100.0 / n')}, CAST(n - l AS BIGINT),
  {_r6('100.0 - l * 100.0 / n')}, 6.90::DOUBLE FROM s""")
    q["label_overlap"] = m(labelled_ctes() + """
SELECT count(*) AS n_total,
  count(*) FILTER (WHERE critical_outcome = 1) AS n_critical,
  count(*) FILTER (WHERE hospital_death = 1) AS n_death,
  count(*) FILTER (WHERE icu_transfer_12h = 1) AS n_icu,
  count(*) FILTER (WHERE hospital_death = 1 AND icu_transfer_12h = 1) AS n_death_and_icu,
  count(*) FILTER (WHERE lengthened_ed_stay = 1) AS n_lengthened FROM labelled""")
    q["crosstab_margins"] = m(labelled_ctes() + """
SELECT CASE WHEN grouping(critical_outcome) = 1 THEN 'All' ELSE CAST(critical_outcome AS VARCHAR) END
         AS critical_outcome,
       CASE WHEN grouping(lengthened_ed_stay) = 1 THEN 'All' ELSE CAST(lengthened_ed_stay AS VARCHAR) END
         AS lengthened_ed_stay,
       count(*) AS n
FROM labelled GROUP BY CUBE (critical_outcome, lengthened_ed_stay)""")
    q["crosstab_normalized"] = m(labelled_ctes() + f""",
ct AS (SELECT critical_outcome, lengthened_ed_stay, count(*) AS n FROM labelled GROUP BY ALL)
SELECT critical_outcome, lengthened_ed_stay, n,
  {_r6('n * 100.0 / sum(n) OVER (PARTITION BY lengthened_ed_stay)')} AS pct_of_col FROM ct""")
    q["label_rate_check"] = m(labelled_ctes() + f""",
s AS (SELECT avg(critical_outcome) * 100.0 AS c, avg(lengthened_ed_stay) * 100.0 AS l FROM labelled)
SELECT 'critical_outcome' AS label, {_r6('c')} AS rate_pct, 9.67::DOUBLE AS paper_pct,
  {_r6('c - 9.67::DOUBLE')} AS diff_points, abs(c - 9.67::DOUBLE) < 5 AS within_tolerance FROM s
UNION ALL
SELECT 'lengthened_ed_stay', {_r6('l')}, 6.90::DOUBLE, {_r6('l - 6.90::DOUBLE')}, abs(l - 6.90::DOUBLE) < 5 FROM s""")
    q["run_stats"] = m(labelled_ctes() + f"""
SELECT count(*) AS n_rows, count(DISTINCT subject_id) AS n_patients,
  {_r6('avg(CAST(critical_outcome AS DOUBLE)) * 100.0')} AS outcome_pct,
  {_r6('avg(age_at_ed)')} AS age_mean, {_r6('avg(ed_los_hours)')} AS los_mean FROM labelled""")
    return q


def correlation_sql(features: list[str], labels=("critical_outcome", "lengthened_ed_stay"), top=10,
                    signed=False) -> str:
    sel = ", ".join(f"corr(CAST({f} AS DOUBLE), CAST({lbl} AS DOUBLE)) AS \"{lbl}|{f}\""
                    for lbl in labels for f in features)
    unions = " UNION ALL ".join(f"SELECT '{lbl}' AS label, '{f}' AS feature, \"{lbl}|{f}\" AS c FROM w"
                                for lbl in labels for f in features)
    return with_mapping(labelled_ctes() + f""",
w AS (SELECT {sel} FROM labelled),
lg AS (SELECT label, feature, round(c, 12) AS c FROM ({unions}) u WHERE c IS NOT NULL AND NOT isnan(c)),
rk AS (SELECT label, feature, round(c, 6) AS corr, round(abs(c), 6) AS abs_corr,
         row_number() OVER (PARTITION BY label ORDER BY {'c' if signed else 'abs(c)'} DESC, feature) AS rank FROM lg)
SELECT label, CAST(rank AS INTEGER) AS rank, feature, corr, abs_corr FROM rk WHERE rank <= {top}""")
