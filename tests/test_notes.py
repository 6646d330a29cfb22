"""Note availability, fusion picks and note reports."""
from helpers import ts
from edcohort.operators import fusion as FU
from edcohort.operators import notes as NO

NOTES = ("note_id string, subject_id long, hadm_id long, note_type string, note_category string, "
         "category_priority int, charttime timestamp_ntz, text string")
STAYS = "stay_id long, subject_id long, hadm_id long, intime timestamp_ntz, outtime timestamp_ntz"


def _stays(spark):
    return spark.createDataFrame([(1, 1, 10, ts("2020-01-01T00:00:00"), ts("2020-01-01T10:00:00")),
                                  (2, 2, None, ts("2020-01-01T00:00:00"), ts("2020-01-01T10:00:00"))], STAYS)


def _notes(spark):
    return spark.createDataFrame([
        ("a", 1, 10, "RR", "radiology", 2, ts("2020-01-01T10:00:00"), "r at exit"),
        ("b", 1, 10, "RR", "radiology", 2, ts("2020-01-01T10:00:01"), "r after exit"),
        ("c", 1, 10, "DS", "discharge", 1, ts("2020-01-01T22:00:00"), "d at exit+12"),
        ("d", 1, 10, "DS", "discharge", 1, ts("2020-01-01T22:00:01"), "d after"),
        ("e", 1, 10, "DS", "discharge", 1, ts("2019-12-31T00:00:00"), "d before arrival"),
        ("f", 2, None, "RR", "radiology", 2, ts("2020-01-01T01:00:00"), "no admission"),
    ], NOTES)


def test_temporal_and_hybrid(spark):
    zero = {r.note_id for r in NO.filter_temporal(_notes(spark), _stays(spark), 0.0).collect()}
    assert zero == {"a", "e"}
    hyb = {r.note_id: r.time_from_admission_min for r in NO.filter_temporal_hybrid(_notes(spark), _stays(spark)).collect()}
    assert set(hyb) == {"a", "c", "e"} and hyb["a"] == 600.0 and hyb["e"] == -1440.0
    sweep = {r.buffer_hours: r.n_kept for r in NO.retention_sweep(_notes(spark), _stays(spark)).collect()}
    assert sweep == {0.0: 2, 2.0: 3, 6.0: 3, 12.0: 4, 24.0: 5}


def test_no_time_column_returns_input(spark):
    n = _notes(spark).drop("charttime")
    assert NO.filter_temporal(n, _stays(spark)).count() == 6


def _prep(spark, rows):
    df = spark.createDataFrame(rows, NOTES)
    return NO.preprocess_notes(df, min_text_length=3)


def test_pick_priority_ties_and_null_text(spark):
    t0, t1 = ts("2020-01-01T01:00:00"), ts("2020-01-01T02:00:00")
    rows = [("n1", 1, 10, "DS", "discharge", 1, t1, "discharge later"),
            ("n0", 1, 10, "DS", "discharge", 1, t1, "discharge same time lower id"),
            ("n2", 1, 10, "RR", "radiology", 2, t0, "radiology first"),
            ("n3", 2, 20, "DS", "discharge", 1, t0, None),                # best priority but no text
            ("n4", 2, 20, "RR", "radiology", 2, t1, "radiology only one"),
            ("n5", 3, 30, "RR", "radiology", 2, t0, "ab")]                 # too short: invalid
    p = _prep(spark, rows)
    pri = {r.hadm_id: r.cleaned_text for r in FU.note_by_priority(p).collect()}
    assert pri == {10: "discharge same time lower id", 20: "radiology only one"}
    first = {r.hadm_id: r.cleaned_text for r in FU.note_first(p).collect()}
    assert first == {10: "radiology first", 20: "radiology only one"}
    last = {r.hadm_id: r.cleaned_text for r in FU.note_last(p).collect()}
    assert last[10] == "discharge later"
    cat = {r.hadm_id: (r.cleaned_text, r.note_type) for r in FU.note_concat(p).collect()}
    assert cat[10] == ("radiology first [SEP] discharge same time lower id [SEP] discharge later", "DS, RR")
    assert 30 not in cat
    custom = {r.hadm_id: r.cleaned_text for r in FU.note_by_priority(p, {"RR": 0, "DS": 1}).collect()}
    assert custom[10] == "radiology first"


def test_associate_and_multimodal(spark):
    stays = spark.createDataFrame([(1, 1, 10, 1, 0, 37.0, 5.0), (2, 2, 20, 0, 1, None, None)],
                                  "stay_id long, subject_id long, hadm_id long, critical_outcome int, "
                                  "lengthened_ed_stay int, triage_temperature double, lab_CBC_value double")
    p = _prep(spark, [("n", 1, 10, "DS", "discharge", 1, ts("2020-01-01T01:00:00"), " text  here ")])
    mm = FU.multimodal_dataset(FU.associate_notes_to_stays(stays, p))
    out = {r.stay_id: r for r in mm.collect()}
    assert out[1].cleaned_text == "text here" and out[1].has_text and out[1].outcome == 1
    assert out[2].cleaned_text is None and not out[2].has_text and out[2].lengthened_ed_stay == 1
    assert "triage_temperature" in mm.columns and "lab_CBC_value" in mm.columns


def test_top_keywords_whole_corpus(spark):
    df = spark.createDataFrame([("1", "Alpha beta alpha gamma"), ("2", "alpha gamma delta épée")], "note_id string, text string")
    got = [(r.word, r.n) for r in NO.top_keywords(df, top=2).collect()]
    assert got == [("alpha", 3), ("gamma", 2)]


def test_notes_stats_reads_the_texts_once(spark):
    rows = [(i, 10 + i % 3, "discharge" if i % 2 else "radiology", "x" * (i % 5 + 1)) for i in range(20)]
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    schema = "subject_id long, hadm_id long, note_category string, text string"
    notes = spark.createDataFrame(rows, schema).mapInArrow(passed, schema)
    got = {r.note_category: (r.n_notes, r.n_patients, r.n_admissions, r.avg_text_length, r.median_text_length)
           for r in NO.notes_stats(notes).collect()}
    assert got == {"All": (20, 20, 3, 3.0, 3.0), "discharge": (10, 10, 3, 3.0, 3.0), "radiology": (10, 10, 3, 3.0, 3.0)}
    assert seen.value == len(rows)
