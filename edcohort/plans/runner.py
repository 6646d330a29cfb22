"""End-to-end run: tabular plan → text plan → split → sequences → sinks.

Each heavy intermediate becomes a stage table in the shared checkpoint
folder (``spark.checkpoint.dir``): the cohort (read by the event and note
joins), the labelled stays (read by the text plan and the reports), the
multimodal dataset (read twice by the split) and the split dataset (read by
the sequence step). Row counts and the manifest's figures are observed while
the stages are written. A lost executor then costs at most the stage it was
working on, and no plan is recomputed because two consumers read it.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cohort import apply_filters
from ..operators.labels import crosstab_margins, label_correlations, label_summary
from ..operators.profile import observed_row_loss
from ..sources.readers import STAY_KEYS, Tables, check_input
from ..sources.sinks import (manifest_metrics, observed_manifest, write_manifest, write_observed, write_parquet,
                             write_summary_csv)
from .tabular import labelled_stays
from .text import multimodal, sequences, split_multimodal


def run_all(spark: SparkSession, t: Tables, out_dir: str, strategy: str = "priority",
            lab_window_hours: float = 12.0, seed: int = 42, order=None) -> dict[str, DataFrame]:
    """Run everything and write the artefacts under ``out_dir``:
    ``labeled_data`` (Parquet), ``multimodal`` and ``linearized`` (Parquet,
    one folder per split), four summary CSVs and ``manifest`` (JSON)."""
    run_id = uuid.uuid4().hex
    n_rows = F.count(F.lit(1)).alias("n_total")
    counts = [("stays", t.edstays.count())]

    def staged(df: DataFrame, name: str, metrics=None) -> tuple[DataFrame, dict]:
        stage, seen = write_observed(df, name, metrics or [n_rows], spark, run_id=run_id)
        counts.append((name, seen["n_total"]))
        return stage, seen

    cohort, _ = staged(apply_filters(t), "cohort")
    check_input(cohort, "cohort", STAY_KEYS)  # P19, before features and labels: one row of the stage
    labelled, _ = staged(labelled_stays(t, lab_window_hours, cohort=cohort), "labelled")
    write_parquet(labelled, os.path.join(out_dir, "labeled_data"))
    write_summary_csv(label_summary(labelled), os.path.join(out_dir, "label_summary"))
    write_summary_csv(crosstab_margins(labelled), os.path.join(out_dir, "crosstab"))
    write_summary_csv(label_correlations(labelled), os.path.join(out_dir, "label_correlations"))
    # the split reads its input twice (bucket counts, then ranks): stage it first
    mm, _ = staged(multimodal(labelled, cohort, t, strategy), "multimodal")
    split, seen = staged(split_multimodal(mm, order, seed), "multimodal_split", manifest_metrics())
    write_parquet(split, os.path.join(out_dir, "multimodal"), ["split"])
    seqs = sequences(split)
    write_parquet(seqs, os.path.join(out_dir, "linearized"), ["split"])
    write_summary_csv(observed_row_loss(spark, counts), os.path.join(out_dir, "row_loss"))
    manifest = observed_manifest(spark, seen, {"strategy": strategy, "lab_window_hours": lab_window_hours,
                                               "seed": seed, "ratios": [0.8, 0.1, 0.1]})
    write_manifest(manifest, os.path.join(out_dir, "manifest"))
    return {"cohort": cohort, "labelled": labelled, "split": split, "sequences": seqs}
