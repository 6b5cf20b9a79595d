"""The pipeline against a brute-force version in plain Python."""

import importlib

import numpy as np
from tests_llm_brute import packed_texts, slow_groups

import corpus_pipeline
from gridcast.llm import line_clean, line_quality, pii

SF = "/root/testdata/sf0.001"


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = line_quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows = [(i, t) for i, t in rows if model.scores([t])[0] >= 0.5]
    rows = [(i, t) for i, t in rows if line_clean.judge(t).kept]
    keep = slow_groups(rows)
    rows = [(i, t) for i, t in rows if i in keep]
    tagger = pii.train()
    rows = [(i, pii.masked(t, pii.spans_of([t], tagger)[1][0])) for i, t in rows]
    want = packed_texts(rows)
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1].tolist()] and ends[-1] <= 4096
    assert len(by) <= -(-sum(r["length"] for r in got) // 4096) + 1


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "near_duplicates",
                                                      "personal_data", "pack"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).schema.names == docs.schema.names
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.pack(spark, docs.limit(0), SF).count() == 0


def test_stages_on_repeated_and_null_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.unionByName(docs.limit(5)).unionByName(
        spark.createDataFrame([(None, None, None, None, None), (10 ** 6, None, "en", "s", 0), (10 ** 6 + 1, "", "en", "s", 0)], docs.schema))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SF).count() > 0


def test_entry_registers_the_pipeline():
    entry = importlib.import_module("__spark_entry__")
    assert {"pipeline", "op1_fingerprints", "op10_simhash"} <= set(entry.queries())
