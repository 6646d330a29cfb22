"""Text plan: notes → availability by ED exit → clean → valid → one note per
admission → multimodal dataset → split; then sequences.

The cohort (one row per stay) drives the availability join; the labelled
stays receive the chosen note by a left join on the admission key. At scale
the labelled stays are a stage table (``sinks.write_stage``) so the text plan
reads them once instead of recomputing the tabular plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.fusion import associate_notes_to_stays, multimodal_dataset
from ..operators.notes import filter_temporal_hybrid, preprocess_notes, valid_notes
from ..operators.sequence import training_examples
from ..operators.split import stratified_split
from ..sources.readers import Tables


def non_empty_notes(notes: DataFrame) -> DataFrame:
    """The loader keeps notes with non-empty text only."""
    return notes.where(F.col("text").isNotNull() & (F.length("text") > 0))


def available_notes(notes: DataFrame, stays: DataFrame, buffers: dict[str, float] | None = None) -> DataFrame:
    return filter_temporal_hybrid(non_empty_notes(notes), stays, buffers)


def prepared_notes(notes: DataFrame, stays: DataFrame, buffers: dict[str, float] | None = None,
                   min_text_length: int = 50, only_valid: bool = True) -> DataFrame:
    """Available and cleaned notes; with ``only_valid`` the invalid ones are
    filtered out. The fusion step honours ``is_valid`` itself, so the text
    plan passes ``only_valid=False`` and every note is cleaned exactly once
    (a filter on the cleaned length would be pushed below the cleaning and
    evaluate the regexes a second time)."""
    out = preprocess_notes(available_notes(notes, stays, buffers), min_text_length=min_text_length)
    return valid_notes(out) if only_valid else out


def multimodal(labelled: DataFrame, cohort: DataFrame, t: Tables, strategy: str = "priority",
               outcome_column: str = "critical_outcome") -> DataFrame:
    notes = prepared_notes(t.notes, cohort.select("subject_id", "hadm_id", "intime", "outtime"),
                           only_valid=False)
    integrated = associate_notes_to_stays(labelled, notes, strategy)
    return multimodal_dataset(integrated, outcome_column=outcome_column)


def split_multimodal(mm: DataFrame, order=None, seed: int = 42) -> DataFrame:
    return stratified_split(mm, "outcome", 0.8, 0.1, 0.1, seed=seed, order=order)


def sequences(split_mm: DataFrame) -> DataFrame:
    return training_examples(split_mm)
