"""Oracle SQL (DuckDB) for the notes, fusion, split and sequence queries."""

from __future__ import annotations

from ..functions.text import REDACTION_PATTERN, REDACTION_TOKEN, SPECIAL_CHARS_PATTERN, WS, WS_CHARS
from ..operators.sequence import ONE_DECIMAL_FIELDS, TRIAGE_FIELDS
from ..sources.labdim import GROUP_CLASS_ID, GROUP_MINUTES, SEQUENCE_GROUPS
from .oracle import with_mapping
from .oracle_sql import (COHORT, COST_COLS, FLAG_COLS, TRIAGE_FEATURE_COLS, WIDE_COLS, _hours,
                         _r6, labelled_ctes)


def _strip(x: str) -> str:
    chars = WS_CHARS.replace("'", "''")
    return f"trim({x}, '{chars}')"


def sql_clean(x: str, special: bool = False, lower: bool = False) -> str:
    t = f"regexp_replace(COALESCE({x}, ''), '{REDACTION_PATTERN}', '{REDACTION_TOKEN}', 'g')"
    t = f"regexp_replace({t}, '{WS}+', ' ', 'g')"
    if special:
        t = f"regexp_replace({t}, '{SPECIAL_CHARS_PATTERN}', '', 'g')"
    if lower:
        t = f"lower({t})"
    return _strip(t)


def sql_tokens(x: str) -> str:
    return f"len(list_filter(string_split_regex({x}, '{WS}+'), lambda w: w <> ''))"


NOTES_NE = "notes_ne AS (SELECT * FROM notes WHERE text IS NOT NULL AND length(text) > 0)"


def avail(name: str, stays: str, hybrid: bool = True, buffer: float = 0.0) -> str:
    lim = ("(CASE n.note_category WHEN 'discharge' THEN 12 ELSE 0 END) * INTERVAL '1' HOUR" if hybrid
           else f"{buffer} * INTERVAL '1' HOUR")
    cat = "AND n.note_category IN ('radiology', 'discharge')" if hybrid else ""
    return f"""{name} AS (
  SELECT n.*, (epoch_us(n.charttime) - epoch_us(s.intime)) / 60000000.0 AS time_from_admission_min
  FROM notes_ne n JOIN {stays} s ON s.subject_id = n.subject_id AND s.hadm_id = n.hadm_id
  WHERE n.hadm_id IS NOT NULL AND n.charttime IS NOT NULL AND s.intime IS NOT NULL
    AND s.outtime IS NOT NULL AND n.charttime <= s.outtime + {lim} {cat})"""


def prepared_ctes() -> str:
    """cohort → available (hybrid) → cleaned → valid → one note per admission."""
    return COHORT + f""",
{NOTES_NE},
{avail('avail', 'cohort')},
cleaned AS (SELECT *, {sql_clean('text')} AS cleaned_text, length(text) AS original_length FROM avail),
prep0 AS (SELECT *, length(cleaned_text) AS cleaned_length FROM cleaned),
prep AS (SELECT *, cleaned_length >= 50 AS is_valid FROM prep0),
valid AS (SELECT * FROM prep WHERE is_valid),
pick AS (SELECT subject_id, hadm_id, cleaned_text, note_type FROM (
  SELECT *, row_number() OVER (PARTITION BY subject_id, hadm_id
                               ORDER BY category_priority, charttime, note_id) AS rn FROM valid) z WHERE rn = 1)"""


MM_FEATS = f"triage_completeness, {TRIAGE_FEATURE_COLS}, {WIDE_COLS}, {FLAG_COLS}, " + ", ".join(COST_COLS)


def mm_ctes() -> str:
    base = labelled_ctes()
    # labelled_ctes starts with COHORT; prepared_ctes adds the note steps after it
    notes_part = prepared_ctes()[len(COHORT):]
    return base + notes_part + f""",
integ AS (SELECT l.*, p.cleaned_text, p.note_type FROM labelled l
          LEFT JOIN pick p ON p.subject_id = l.subject_id AND p.hadm_id = l.hadm_id),
mm AS (SELECT subject_id, hadm_id, stay_id, cleaned_text, critical_outcome AS outcome, lengthened_ed_stay,
              cleaned_text IS NOT NULL AS has_text, {MM_FEATS} FROM integ)"""


def split_ctes() -> str:
    tot = 0.8 + 0.1 + 0.1
    ftr, fva = repr(0.8 / tot), repr(0.1 / tot)
    return mm_ctes() + f""",
rk AS (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY (stay_id * 7919) % 10007, stay_id) AS r,
              count(*) OVER (PARTITION BY outcome) AS n FROM mm),
sp AS (SELECT * EXCLUDE (r, n), CASE WHEN r <= floor(n * {ftr} + 0.5) THEN 'train'
                      WHEN r <= floor(n * {ftr} + 0.5) + floor(n * {fva} + 0.5) THEN 'val'
                      ELSE 'test' END AS split FROM rk)"""


def _pystr(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


def triage_text_sql() -> str:
    parts = ["CASE WHEN triage_gender_male = 1 THEN 'gender: Male' "
             "WHEN triage_gender_female = 1 THEN 'gender: Female' END"]
    for name, col in TRIAGE_FIELDS:
        if name == "chief_complaint":
            v = f"substring(replace({col}, '|', ';'), 1, 100)"
        elif name in ONE_DECIMAL_FIELDS:
            v = f"format('{{:.1f}}', {col})"
        else:
            v = _pystr(col)
        parts.append(f"CASE WHEN {col} IS NOT NULL THEN '{name}: ' || {v} END")
    return "concat_ws(' | ', " + ", ".join(parts) + ", '[EOS]')"


def perf_sql() -> str:
    items = []
    for pos, g in enumerate(SEQUENCE_GROUPS):
        items.append(f"CASE WHEN lab_{g}_ordered = 1 THEN {{'no_time': lab_{g}_time IS NULL, "
                     f"'time': lab_{g}_time, 'pos': {pos}, 'grp': '{g}', "
                     f"'value': CAST(lab_{g}_value AS VARCHAR), 'cost': {GROUP_MINUTES[g]}}} END")
    return f"list_sort(list_filter([{', '.join(items)}], lambda x: x IS NOT NULL))"


def seq_ctes() -> str:
    lab_text = ("list_transform(p, lambda x: CASE WHEN x.value IS NULL THEN x.grp || ': ordered | [EOS]' "
                "ELSE x.grp || ': ' || x.value || ' | [EOS]' END)")
    return split_ctes() + f""",
s0 AS (SELECT *, {triage_text_sql()} AS triage_text, {perf_sql()} AS p FROM sp),
s1 AS (SELECT *, {lab_text} AS lab_texts FROM s0),
s2 AS (SELECT *, list_transform(lab_texts, lambda t: {sql_tokens('t')}) AS lab_tokens,
              {sql_tokens('triage_text')} AS triage_tokens FROM s1),
seq AS (SELECT *, array_to_string(list_concat([triage_text], lab_texts), ' ') AS text_sequence,
   array_to_string(list_transform(p, lambda x: x.grp), ',') AS lab_groups,
   array_to_string(list_transform(p, lambda x: x.cost), ',') AS time_costs,
   array_to_string(list_reduce(lab_tokens, lambda acc, x: list_append(acc, acc[-1] + x), [triage_tokens]), ',')
     AS eos_positions,
   CAST(COALESCE(list_sum(list_transform(p, lambda x: x.cost)), 0) AS INTEGER) AS total_time_cost,
   CAST(len(p) AS INTEGER) AS num_labs,
   list_transform(p, lambda x: x.grp) AS groups_list FROM s2),
ex AS (SELECT subject_id, hadm_id, stay_id, text_sequence, lab_groups, time_costs, eos_positions,
   total_time_cost, num_labs, COALESCE(outcome, 0) AS outcome, COALESCE(outcome, 0) AS critical_outcome,
   COALESCE(lengthened_ed_stay, 0) AS lengthened_ed_stay, cleaned_text AS clinical_text,
   cleaned_text IS NOT NULL AS has_text, split, groups_list FROM seq)"""


# F14 on the event properties: a flat dict renders as "k: v | ...", anything
# else as the single-value form.
DICT_SEGMENT_SQL = """
SELECT event_id,
  CASE WHEN props IS NULL THEN event_type || ': ordered | [EOS]'
       WHEN ltrim(props) LIKE '{%' AND json_valid(j) AND json_type(j) = 'OBJECT' AND len(json_keys(j)) > 0
         THEN event_type || ': ' || array_to_string(list_transform(json_keys(j),
                lambda k: k || ': ' || json_extract_string(j, '$."' || k || '"')), ' | ') || ' | [EOS]'
       ELSE event_type || ': ' || props || ' | [EOS]' END AS segment_text
FROM (SELECT *, replace(props, chr(39), '"') AS j FROM events) e"""


def text_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    m = with_mapping
    q["notes_load"] = m(f"""{NOTES_NE}
SELECT note_id, subject_id, hadm_id, note_type, note_category, category_priority, charttime, text FROM notes_ne""")
    for name, hybrid in (("notes_temporal", False), ("notes_temporal_hybrid", True)):
        q[name] = m(f"""{NOTES_NE},
{avail('av', 'edstays', hybrid, 0.0)}
SELECT note_id, subject_id, hadm_id, note_category, charttime,
  {_r6('time_from_admission_min')} AS time_from_admission_min FROM av""")
    q["notes_for_stay"] = m(f"""{NOTES_NE},
busiest AS (SELECT subject_id, hadm_id FROM notes_ne WHERE hadm_id IS NOT NULL
            GROUP BY subject_id, hadm_id ORDER BY count(*) DESC, hadm_id LIMIT 1)
SELECT n.note_id, n.subject_id, n.hadm_id, n.note_category, n.charttime,
  CAST(length(n.text) AS INTEGER) AS text_length
FROM notes_ne n JOIN busiest b ON b.subject_id = n.subject_id AND b.hadm_id = n.hadm_id""")
    q["clean_text"] = m(f"""SELECT note_id, {sql_clean('text')} AS cleaned_text,
  {sql_clean('text', True, True)} AS cleaned_strict FROM notes""")
    q["clean_notes"] = m(f"""c AS (SELECT note_id, length(text) AS original_length,
  CAST(length({sql_clean('text')}) AS INTEGER) AS cleaned_length FROM notes)
SELECT note_id, CAST(original_length AS INTEGER) AS original_length, cleaned_length,
  cleaned_length >= 50 AS is_valid FROM c""")
    q["notes_valid"] = m(prepared_ctes() + """
SELECT note_id, subject_id, hadm_id, note_category, CAST(cleaned_length AS INTEGER) AS cleaned_length FROM valid""")
    us = "chr(31)"
    fold = (f"list_reduce(sentences, lambda acc, sent: CASE WHEN length(acc.cur) + length(sent) <= 2048 "
            f"THEN {{'segs': acc.segs, 'cur': acc.cur || ' ' || sent}} "
            f"ELSE {{'segs': CASE WHEN acc.cur <> '' THEN list_append(acc.segs, {_strip('acc.cur')}) "
            f"ELSE acc.segs END, 'cur': sent}} END, {{'segs': []::VARCHAR[], 'cur': ''}})")
    q["segment_text"] = m(f"""{NOTES_NE},
c AS (SELECT note_id, {sql_clean('text')} AS t FROM notes_ne),
sx AS (SELECT note_id, t, string_split(regexp_replace(t, '([.!?]){WS}+', '\\1' || {us}, 'g'), {us})
        AS sentences FROM c),
f AS (SELECT note_id, t, {fold} AS acc FROM sx),
g AS (SELECT note_id, CASE WHEN length(t) <= 2048 THEN [t]
        WHEN acc.cur <> '' THEN list_append(acc.segs, {_strip('acc.cur')}) ELSE acc.segs END AS segs FROM f),
h AS (SELECT note_id, segs, unnest(generate_series(1, len(segs))) AS i FROM g)
SELECT note_id, CAST(i - 1 AS INTEGER) AS seg_no, CAST(length(segs[i]) AS INTEGER) AS seg_length,
  segs[i] AS segment FROM h""")
    q["top_keywords"] = m(f"""{NOTES_NE},
w AS (SELECT unnest(regexp_extract_all(lower(text), '[\\pL\\pN_]+')) AS word FROM notes_ne)
SELECT word, count(*) AS n FROM w WHERE regexp_full_match(word, '[a-z]{{4,}}')
GROUP BY word ORDER BY n DESC, word LIMIT 30""")
    q["notes_stats"] = m(f"""{NOTES_NE}
SELECT CASE WHEN grouping(note_category) = 1 THEN 'All' ELSE note_category END AS note_category,
  count(*) AS n_notes, count(DISTINCT subject_id) AS n_patients, count(DISTINCT hadm_id) AS n_admissions,
  {_r6('avg(length(text))')} AS avg_text_length, {_r6('median(length(text))')} AS median_text_length,
  min(charttime) AS earliest, max(charttime) AS latest
FROM notes_ne GROUP BY ROLLUP (note_category)""")
    q["time_coverage"] = m(f"""{NOTES_NE}
SELECT 'charttime' AS column, count(charttime) AS non_null,
  {_r6('count(charttime) * 100.0 / count(*)')} AS pct_non_null,
  min(charttime) AS min_time, max(charttime) AS max_time FROM notes_ne""")
    joined = f"""{NOTES_NE},
j AS (SELECT n.*, s.outtime FROM notes_ne n JOIN edstays s ON s.subject_id = n.subject_id AND s.hadm_id = n.hadm_id
      WHERE n.hadm_id IS NOT NULL AND n.charttime IS NOT NULL AND s.intime IS NOT NULL AND s.outtime IS NOT NULL)"""
    sweep = " UNION ALL ".join(
        f"SELECT CAST({float(b)} AS DOUBLE) AS buffer_hours, count(*) FILTER (WHERE charttime <= outtime + {b} * INTERVAL '1' HOUR)"
        f" AS n_kept, count(*) AS n_joined FROM j" for b in (0, 2, 6, 12, 24))
    q["retention_sweep"] = m(joined + f""",
sw AS ({sweep})
SELECT buffer_hours, n_kept, n_joined, {_r6('n_kept * 100.0 / n_joined')} AS pct_kept FROM sw""")
    q["retention_by_category"] = m(joined + f""",
tot AS (SELECT note_category, count(*) AS n_total FROM notes_ne GROUP BY note_category),
kept AS (SELECT note_category, count(*) AS n_retained FROM j WHERE charttime <= outtime GROUP BY note_category)
SELECT t.note_category, t.n_total, COALESCE(k.n_retained, 0) AS n_retained,
  {_r6('COALESCE(k.n_retained, 0) * 100.0 / t.n_total')} AS retention_pct
FROM tot t LEFT JOIN kept k ON k.note_category = t.note_category""")
    q["notes_per_outcome"] = m(labelled_ctes() + f""",
{NOTES_NE},
o AS (SELECT DISTINCT subject_id, hadm_id, critical_outcome AS outcome FROM labelled),
pa AS (SELECT o.outcome, n.subject_id, n.hadm_id, count(*) AS k FROM notes_ne n
       JOIN o ON o.subject_id = n.subject_id AND o.hadm_id = n.hadm_id GROUP BY ALL)
SELECT outcome, CAST(sum(k) AS BIGINT) AS n_notes, count(*) AS n_admissions,
  {_r6('avg(k)')} AS mean_notes_per_admission, {_r6('median(k)')} AS median_notes_per_admission,
  min(k) AS min_notes_per_admission, max(k) AS max_notes_per_admission FROM pa GROUP BY outcome""")
    q["text_reduction"] = m(prepared_ctes() + f"""
SELECT count(*) AS n_notes, CAST(sum(original_length) AS BIGINT) AS original_chars,
  CAST(sum(cleaned_length) AS BIGINT) AS cleaned_chars,
  {_r6('1.0 - sum(cleaned_length) / sum(original_length)')} AS reduction_ratio,
  {_r6('avg(CAST(is_valid AS DOUBLE)) * 100.0')} AS valid_pct FROM prep""")
    q["note_priority"] = m(prepared_ctes() + "\nSELECT * FROM pick")
    for name, order in (("note_first", "charttime, note_id"), ("note_last", "charttime DESC, note_id DESC")):
        q[name] = m(prepared_ctes() + f"""
SELECT subject_id, hadm_id, cleaned_text, note_type FROM (
  SELECT *, row_number() OVER (PARTITION BY subject_id, hadm_id ORDER BY {order}) AS rn FROM valid) z
WHERE rn = 1""")
    q["note_concat"] = m(prepared_ctes() + """
SELECT subject_id, hadm_id, string_agg(cleaned_text, ' [SEP] ' ORDER BY charttime, note_id) AS cleaned_text,
  array_to_string(list_sort(list_distinct(list(note_type))), ', ') AS note_type
FROM valid GROUP BY subject_id, hadm_id""")
    q["stays_with_notes"] = m(prepared_ctes() + """
SELECT c.stay_id, c.subject_id, c.hadm_id, p.cleaned_text, p.note_type FROM cohort c
LEFT JOIN pick p ON p.subject_id = c.subject_id AND p.hadm_id = c.hadm_id""")
    feats = ", ".join([c.strip() for c in MM_FEATS.split(",") if c.strip() not in COST_COLS]
                      + [f"{_r6(c)} AS {c}" for c in COST_COLS])
    q["multimodal_dataset"] = m(mm_ctes() + f"""
SELECT subject_id, hadm_id, stay_id, cleaned_text, outcome, lengthened_ed_stay, has_text, {feats} FROM mm""")
    from .catalog import LABELLED_COLS
    q["integration_stats"] = m(mm_ctes() + f"""
SELECT count(*) AS total_stays, count(*) FILTER (WHERE cleaned_text IS NOT NULL) AS with_text,
  {_r6('avg(CAST(cleaned_text IS NOT NULL AS DOUBLE))')} AS text_coverage,
  {_r6('avg(length(cleaned_text))')} AS avg_text_length, {len(LABELLED_COLS) + 1} AS tabular_features
FROM integ""")
    q["text_by_category"] = m(mm_ctes() + """
SELECT note_type, count(*) AS n FROM integ WHERE cleaned_text IS NOT NULL GROUP BY note_type""")
    q["outcome_by_text"] = m(mm_ctes() + f"""
SELECT has_text, count(*) AS n, {_r6('avg(CAST(outcome AS DOUBLE)) * 100.0')} AS outcome_pct
FROM mm GROUP BY has_text""")
    q["stratified_split"] = m(split_ctes() + "\nSELECT stay_id, outcome, has_text, split FROM sp")
    q["split_validation"] = m(split_ctes() + f"""
SELECT split, count(*) AS n, {_r6('avg(CAST(outcome AS DOUBLE)) * 100.0')} AS outcome_pct,
  {_r6('avg(CAST(has_text AS DOUBLE)) * 100.0')} AS text_pct,
  count(*) FILTER (WHERE outcome IS NULL) AS null_outcome,
  count(*) FILTER (WHERE has_text IS NULL) AS null_has_text,
  count(*) FILTER (WHERE has_text AND cleaned_text IS NULL) AS has_text_without_text FROM sp GROUP BY split""")
    q["linearize_triage"] = m(mm_ctes() + f"\nSELECT stay_id, {triage_text_sql()} AS triage_text FROM mm")
    q["performed_groups"] = m(mm_ctes() + f""",
pg AS (SELECT stay_id, {perf_sql()} AS p FROM mm)
SELECT stay_id, array_to_string(list_transform(p, lambda x: x.grp), ',') AS groups,
  array_to_string(list_transform(p, lambda x: COALESCE(CAST(x.time AS VARCHAR), '-')), ',') AS times FROM pg""")
    q["linearize_sequence"] = m(seq_ctes() + """
SELECT stay_id, text_sequence, lab_groups, time_costs, eos_positions, total_time_cost, num_labs FROM seq""")
    q["training_examples"] = m(seq_ctes() + "\nSELECT * EXCLUDE (groups_list) FROM ex")
    ids = " ".join(f"WHEN '{g.upper()}' THEN {i}" for g, i in GROUP_CLASS_ID.items())
    q["lab_label_vector"] = m(seq_ctes() + f"""
SELECT stay_id, array_to_string(list_resize(list_transform(groups_list, lambda g: CASE upper(g) {ids} END),
                                             12, -100), ',') AS lab_group_labels,
  CAST(len(groups_list) AS INTEGER) AS num_labs FROM ex""")
    q["lab_group_frequency"] = m(seq_ctes() + f""",
fr AS (SELECT unnest(groups_list) AS lab_group FROM ex)
SELECT lab_group, count(*) AS n, {_r6('count(*) * 100.0 / (SELECT count(*) FROM ex)')} AS pct_of_stays
FROM fr GROUP BY lab_group""")
    q["linearize_dict_value"] = DICT_SEGMENT_SQL
    q["notes_sample"] = m(f"""{NOTES_NE}
SELECT note_id, note_category, CAST(length(text) AS INTEGER) AS text_length FROM notes_ne
ORDER BY (CAST(note_id AS BIGINT) * 7919) % 10007, note_id LIMIT 1000""")
    tok = sql_tokens("text_sequence")
    q["sequence_stats"] = m(seq_ctes() + f"""
SELECT count(*) AS n_examples, {_r6(f'avg({tok})')} AS mean_tokens, CAST(max({tok}) AS INTEGER) AS max_tokens,
  count(*) FILTER (WHERE {tok} > 656) AS n_over_max, {_r6('avg(num_labs)')} AS mean_groups,
  {_r6('avg(total_time_cost)')} AS mean_time_cost, count(*) FILTER (WHERE num_labs = 0) AS n_without_labs,
  count(*) FILTER (WHERE has_text) AS n_with_text, count(*) FILTER (WHERE outcome = 1) AS n_positive FROM ex""")
    return q
