"""Cases in which an operator once did less than the whole job."""

import random

from millrace.llm import decontam, exact_dedup, quality
from tests.llm.test_operators import frame


def test_quality_uses_bad_labels_on_small_tables(spark):
    rng = random.Random(3)
    insults = [f"insult{i}" for i in range(10)]
    docs, labels = [], []
    for i in range(600):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(40, 120))]
        toxic = i % 12 == 0
        if toxic:
            for w in rng.sample(insults, 4):
                words.insert(rng.randrange(len(words)), w)
        docs.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, 1, 0))
        elif i % 24 == 0:
            labels.append((i, 1, 1))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.resample(frame(spark, docs), lab).collect() if r.kept}
    toxic = {i for i in range(600) if i % 12 == 0}
    assert len(kept & toxic) <= 10 and len(set(range(600)) - toxic - kept) <= 20


def test_quality_keeps_long_clean_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r.doc_id for r in quality.resample(docs, labels).filter("kept").select("doc_id").collect()}
    good = labels.filter("quality = 1 and toxic = 0").join(docs.filter("octet_length(text) >= 10000"), "doc_id").select("doc_id").collect()
    assert len(good) > 60 and sum(r.doc_id in kept for r in good) >= 0.9 * len(good)


def test_filters_reject_rows_not_ids(spark):
    item = " ".join(f"b{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, item), (None, "a clean text"), (7, item), (7, "another clean text")]
    left = decontam.drop_contaminated(frame(spark, rows), bench).collect()
    assert sorted(r.text for r in left) == ["a clean text", "another clean text"]
    rows = [(1, "copy"), (None, "co py"), (None, "unique"), (2, "copy"), (2, "own text"), (3, "twice"), (3, "twice"), (None, "no id"), (None, "no id")]
    left = exact_dedup.drop_exact_copies(frame(spark, rows)).collect()
    assert len(left) == 5 and {r.text for r in left} == {"co py", "unique", "own text", "twice", "no id"}  # the longest copy stays, as in the SQL
