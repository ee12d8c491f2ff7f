"""The pipeline against plain versions of its deciding stages, each on its own input."""

import re

import corpus_pipeline
from millrace.llm import packing
from tests.llm.brute import near
from tests.llm.test_operators import hits

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert out.columns == docs.columns
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        seen[name] = (len(rows), len(kept))
        if name == "exact_dedup":
            best = {}
            for d, t in rows.items():
                k = re.sub(r"[\x20\x09-\x0D]", "", t)
                best[k] = min(best.get(k, (1, 0)), (-len(t), d))
            assert kept == {d for _, d in best.values()}
        if name == "minhash_near_dedup":
            assert kept == {c for _, c in near(list(rows.items()), 80).values()}
        if name == "benchmark_decontamination":
            found = {d: hits(t, items) for d, t in rows.items()}
            assert kept == {d for d, (n, h, _) in found.items() if not (h > 0 and 20 * h >= n)}
        if name == "best_fit_packing":
            assert kept == set(rows)
        docs = out
    assert seen["quality_classifier"][1] > 100
    assert packing.LENGTH == 2048


def test_run(spark):
    assert set(corpus_pipeline.run(spark, SF).columns) >= {"doc_id", "piece", "sequence_id", "offset"}
