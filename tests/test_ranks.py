"""Gapless numbers, seeded splits, grid joins and inserts on skewed and odd rows."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import inspection, ranks
from millrace.operators import receivables as rc


def test_gapless_numbers_of_a_hot_key(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 10 == 0, F.concat(F.lit("k"), (F.col("id") % 70).cast("string"))).when(F.col("id") % 999 == 1, None).otherwise("hot").alias("k"), F.when(F.col("id") % 7 != 0, F.col("id") % 11).alias("v"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranks.gapless(rows, ["k"], ["v", "id"]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    groups = {}
    for r in got:
        groups.setdefault(r.k, []).append(r)
    assert len(got) == 5000 and None in groups
    for part in groups.values():
        order = sorted(part, key=lambda r: (r.v is not None, r.v or 0, r.id))
        assert [r.rank for r in order] == list(range(len(part)))


def test_gapless_of_all_rows_and_of_none(spark):
    assert sorted((r.rank, r.id) for r in ranks.gapless(spark.range(100), [], ["id"]).collect()) == [(i, i) for i in range(100)]
    assert ranks.gapless(spark.range(0), [], ["id"]).count() == 0


def test_splits_are_exact_repeatable_and_seeded(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 10 < 9, "hot").otherwise("rare").alias("k"))
    held = lambda seed, parts: {r.id for r in ranks.split(rows.repartition(parts), ["k"], "id", F.greatest(F.lit(1), F.floor(F.col("n") * 0.2)), seed).filter("held").collect()}
    one = held(1, 3)
    assert one == held(1, 11) and one != held(2, 3) and sum(i % 10 < 9 for i in one) == 540 and sum(i % 10 == 9 for i in one) == 60
    order = {r.id: r.rank for r in ranks.shuffled(rows, ["k"], "id", 1).collect()}
    assert {i for i, r in order.items() if r < (540 if i % 10 < 9 else 60)} == one
    few = spark.createDataFrame([(1, "a"), (None, "a"), (None, "b")], "id long, k string")
    assert [r.held for r in ranks.split(few, ["k"], "id", F.lit(5)).orderBy(F.col("id").desc_nulls_last(), "k").collect()] == [True, False, False]


@pytest.mark.parametrize("cell", [3.0, 16.0, 1000.0])
def test_overlaps_do_not_depend_on_the_grid(spark, cell):
    boxes = spark.range(160).select((F.col("id") % 2).alias("frame_id"), F.col("id").alias("det_id"), ((F.col("id") * 37) % 50 - 20).cast("double").alias("x1"), ((F.col("id") * 61) % 40 - 10).cast("double").alias("y1"))
    boxes = boxes.withColumns({"x2": F.col("x1") + 1 + F.col("det_id") % 13, "y2": F.col("y1") + 2 + F.col("det_id") % 9})
    a, b = boxes.filter("det_id % 4 < 2"), boxes.filter("det_id % 4 >= 2")
    rows = boxes.collect()

    def iou(p, q):
        w, h = min(p.x2, q.x2) - max(p.x1, q.x1), min(p.y2, q.y2) - max(p.y1, q.y1)
        both = max(w, 0) * max(h, 0)
        return both / ((p.x2 - p.x1) * (p.y2 - p.y1) + (q.x2 - q.x1) * (q.y2 - q.y1) - both)

    want = sorted((p.det_id, q.det_id) for p in rows for q in rows if p.det_id % 4 < 2 <= q.det_id % 4 and p.frame_id == q.frame_id and iou(p, q) > 0.1)
    assert want and sorted((r.a_det_id, r.b_det_id) for r in inspection.overlapping(a, b, cell=cell).collect()) == want


def test_ties_at_the_nearest_share(spark):
    rows = spark.createDataFrame([(i, [1.0 if i % 2 else -1.0, 0.0]) for i in range(40)] + [(99, [0.0, 0.1])], "vec_id long, embedding array<double>")
    assert sorted(r.vec_id for r in inspection.nearest_share(rows, 0.5, 3).collect()) == [*range(19), 99]


def test_inserted_documents(spark):
    contracts = spark.createDataFrame([(7, "old")], "id long, file_path string")
    none = spark.createDataFrame([], "id long")
    new = spark.createDataFrame([("b.pdf", "B", "us", None, "x" * 30_000), ("a.pdf", None, "", "them", "y")], "file_path string, title string, our_party string, counterparty string, raw_text string")
    pay = spark.createDataFrame([("b.pdf", 2, 5.0, ""), ("b.pdf", 1, None, "2024-01-01"), ("a.pdf", 1, 9.0, None)], "file_path string, seq int, amount double, due_date string")
    alerts = spark.createDataFrame([("b.pdf", 1, "red", "r", "m")], "file_path string, seq int, level string, rule string, message string")
    out = {k: v.orderBy("id").collect() for k, v in rc.insert_extracted(new, pay, alerts, contracts, none, none).items()}
    a, b = out["contracts"]
    assert (a.id, a.file_path, a.title, a.parties, a.status, a.reviewed, a.currency, a.extract_source) == (8, "a.pdf", "", "them", "active", 0, "CNY", "llm")
    assert (b.id, b.parties, len(b.raw_text)) == (9, "us", 20_000)
    assert [(r.id, r.contract_id, r.due_date, r.amount, r.status, r.source) for r in out["receivables"]] == [(1, 8, None, 9.0, "pending", "regex"), (2, 9, "2024-01-01", None, "pending", "regex"), (3, 9, None, 5.0, "pending", "regex")]
    assert [(r.id, r.contract_id, r.level, r.evidence) for r in out["risk_alert"]] == [(1, 9, "red", "")]
    assert rc.insert_extracted(new.limit(0), pay, alerts, contracts, none, none)["receivables"].count() == 0
