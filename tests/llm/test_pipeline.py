import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline as P
from skyfix.llm.decontamination import decontaminate
from skyfix.llm.ngram_join import ngram_components
from skyfix.llm.shared import documents

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark, tmp_path):
    docs = documents(spark, SF)
    columns = docs.columns
    labels = pd.read_parquet(f"{SF}/labels.parquet").set_index("doc_id")
    kept = {}
    for name, stage in P.STAGES:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert kept[name] <= before and docs.count() == len(kept[name])
        assert docs.columns == columns or name == P.STAGES[-1][0]
    first = kept["quality_classifier"]
    clean = set(labels[labels.quality == 1].index)
    assert len(clean & first) / len(clean) > 0.98 and len(first - clean & set(labels.index)) < 0.05 * len(labels)
    assert len(first - kept["language_id"]) <= 2
    third = spark.read.parquet(str(tmp_path / "ngram_jaccard_join"))
    assert ngram_components(third).where("component_id <> doc_id").count() == 0
    fourth = spark.read.parquet(str(tmp_path / "benchmark_decontamination"))
    assert decontaminate(fourth, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").count() == 0
    last = kept["source_mixing"]
    toxic = set(labels[labels.toxic == 1].index) & kept["benchmark_decontamination"]
    assert len(toxic & last) < 0.1 * len(toxic) + 1
    fine = set(labels[(labels.quality == 1) & (labels.toxic == 0)].index) & kept["benchmark_decontamination"]
    assert len(fine & last) / len(fine) > 0.97


def test_run_gives_the_last_stage(spark):
    out = P.run(spark, "/root/testdata/sf0.001")
    assert out.columns == [*documents(spark, SF).columns, "rate", "copies"]
    assert out.agg(F.min("copies")).first()[0] >= 1


def test_stages_of_an_empty_table(spark):
    docs = documents(spark, "/root/testdata/sf0.001").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, "/root/testdata/sf0.001").count() == 0


def test_lists_too_long_to_send_change_nothing(spark, monkeypatch):
    import skyfix.llm.shared as shared

    expect = sorted((r.doc_id, r.copies) for r in P.run(spark, "/root/testdata/sf0.001").collect())
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 0)
    assert sorted((r.doc_id, r.copies) for r in P.run(spark, "/root/testdata/sf0.001").collect()) == expect
