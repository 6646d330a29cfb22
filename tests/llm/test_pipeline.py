"""The pipeline's stages, one after another."""
from llm_helpers import SF, rows

import corpus_pipeline
from edcohort.llm import line_dedup, minhash, perplexity, secret_scan
from edcohort.llm.common import Workspace


def staged(spark, docs, sf_dir):
    ws = Workspace(spark, "test-pipeline")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = ws.put(stage(spark, docs, sf_dir), name)
        out.append(docs)
    return out


def test_stages_on_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good, lined, single, masked, packed = staged(spark, docs, SF)
    for d in (good, lined, single, masked):
        assert d.columns == docs.columns and [f.dataType for f in d.schema] == [f.dataType for f in docs.schema]
    kept = {r.doc_id for r in perplexity.judge(spark, docs, labels).filter("kept").collect()}
    assert {r.doc_id for r in good.collect()} == kept
    text = {r.doc["doc_id"]: r.doc["text"] for r in line_dedup.dedup_lines(good).collect()}
    assert {r.doc_id: r.text for r in lined.collect()} == text
    assert all(r.n_chars == len(r.text) for r in lined.collect())
    alone = {r.doc_id for r in minhash.near_duplicates(spark, lined).collect() if r.kept}
    assert {r.doc_id for r in single.collect()} == alone
    assert secret_scan.secrets_report(masked).filter("n_access + n_hex > 0").isEmpty()
    assert {r.doc_id for r in masked.collect()} == alone == {r.doc_id for r in packed.collect()}
    whole = sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect())
    assert whole == sorted(tuple(r) for r in packed.collect())


def test_stages_on_edges(spark, edge, empty):
    good, lined, single, masked, packed = staged(spark, edge, SF)
    assert all(d.columns == edge.columns for d in (good, lined, single, masked))
    # without trusted rows among these ids nothing but wordless texts must go
    assert {r[0] for r in rows()} - {r.doc_id for r in good.collect()} >= {30, 40, 50}
    ids = [r.doc_id for r in single.collect()]
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
    for d in staged(spark, empty, SF):
        assert d.count() == 0


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "secrets", "packing"]
