"""Runs of white space in packed texts, and bounded samples of labels."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from millrace.llm import packing, quality
from tests.llm.test_operators import frame

BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_of_very_long_runs(spark):
    from tokenizers import Tokenizer

    n = 3_000_000
    texts = ["w" + " " * n + "x", "\n" * n, "a \t\n\r\x0b\x0c　 b" + " \n\t\r" * (n // 4), "x" * 1_200_000, "!" * 1_200_000, " " * 9_999 + "y"]
    library = Tokenizer.from_file(BPE)
    for t in texts:
        assert packing.encoder(BPE).encode([t])[0] == np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
    want = len(library.encode(texts[0], add_special_tokens=False).ids) + 1
    rows = packing.pack_documents(frame(spark, [(1, texts[0]), (2, "short")]), BPE).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == want


def test_labels_of_repeated_ids_stay_a_bounded_sample(spark):
    """Ten labels over 5,000 rows send ten rows to the driver at most, and the cut is found from one weight a label."""
    docs = frame(spark, [(i % 10, f"good words number {i % 7}" if i % 10 < 5 else f"bad stuff number {i % 7}") for i in range(5000)])
    labels = spark.createDataFrame([(i, int(i < 5), 0) for i in range(10)], "doc_id long, quality int, toxic int")
    seen = []
    plain = quality.best_cut
    quality.best_cut = lambda w, g: seen.append(len(w)) or plain(w, g)
    try:
        out = quality.resample(docs, labels)
        assert out.count() == 5000 and out.filter(F.col("log_weight").isNull()).isEmpty()
    finally:
        quality.best_cut = plain
    assert seen and seen[0] <= 10


@pytest.mark.parametrize("size", [1, 9_999, 10_000, 10_001])
def test_runs_around_the_limit(size):
    from tokenizers import Tokenizer

    t = "a" + " " * size + "b"
    assert packing.encoder(BPE).encode([t])[0] == np.array(Tokenizer.from_file(BPE).encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
