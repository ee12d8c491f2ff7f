"""Literal cases of known outcome."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from millrace.functions import geometry
from millrace.functions import text as tx
from millrace.operators import inspection as op
from millrace.operators import receivables as rc

TEXT = """采购合同
合同编号：HT-2026-001
甲方（买方）：上海某某制造有限公司
乙方（卖方）：苏州锐新视科技有限公司
总金额 人民币80万元
1. 合同签订后30日内甲方向乙方支付预付款 30万元
2. 验收合格后 2026年12月31日前甲方向乙方支付尾款 50万元
3. 逾期付款的每日按未付金额千分之一支付违约金
负责人：王小明"""
COMPANY = ["苏州锐新视科技有限公司"]


def extract(spark, text, names=COMPANY):
    df = spark.createDataFrame([(text,)], "text string")
    rows = tx.extract_contracts(df, "text", F.lit("2026-07-01").cast("date"), names).withColumn("risks", tx.risks(F.col("text")))
    return rows.first()


def test_contract_extraction(spark):
    r = extract(spark, TEXT)
    assert (r.direction, r.total_amount, r.valid, r.signer, r.contract_no) == ("receivable", 800000.0, True, "王小明", "HT-2026-001")
    assert [p.amount for p in r.payments] == [300000.0, 500000.0] and r.payments[1].due_date == "2026-12-31"
    assert all("违约金" in p.penalty for p in r.payments) and r.payments[0].payee == COMPANY[0]
    assert [x.rule for x in r.risks] == [] and r.confidence == 0.65


def test_reconciliation_failure(spark):
    r = extract(spark, "合同总额：100万元。\n甲方向乙方支付预付款30万元", [])
    assert not r.valid and r.direction == "unknown"
    assert [x.rule for x in r.risks] == ["amount_mismatch", "missing_penalty", "missing_signer", "party_unidentified", "no_due_date", "direction_unknown"]


def test_empty_texts_have_defined_results(spark):
    r = extract(spark, "")
    assert r.payments == [] and r.total_amount is None and r.direction == "receivable" and not r.valid and r.confidence == 0.0


def test_balance(spark):
    c = spark.createDataFrame([(1, 800000.0)], "id long, total_amount double")
    r = spark.createDataFrame([(1, 1, 300000.0), (2, 1, 500000.0)], "id long, contract_id long, amount double")
    k = spark.createDataFrame([(1, 1, 300000.0)], "id long, contract_id long, amount double")
    out = rc.contract_balances(c, r, k).first()
    assert (out.collected_sum, out.outstanding) == (300000.0, 500000.0)


def test_overdue_reminder_fires_once(spark):
    c = spark.createDataFrame([(1, "T", "/a/b.pdf", "S", 1)], "id long, title string, file_path string, signer string, reviewed int")
    r = spark.createDataFrame([(5, 1, "2026-06-21", 10.0, "CNY", "pending", 0, 0, 0, 0)], "id long, contract_id long, due_date string, amount double, currency string, status string, reminded_7d int, reminded_3d int, reminded_1d int, reminded_overdue int")
    fired = rc.due_reminders(r, c, "2026-07-01")
    assert [(x.level, x.days_left) for x in fired.collect()] == [("overdue", -10)] and "已逾期 10 天" in fired.first().message
    assert rc.due_reminders(rc.mark_reminded(r, fired), c, "2026-07-01").count() == 0


def test_daily_stats(spark):
    at = dt.datetime(2026, 7, 1, 8)
    rows = [(i, at, v, s) for i, (v, s) in enumerate([("NG", 0.91), ("OK", 0.1), ("NG", 0.85), ("NG", 0.77), ("OK", 0.05)])]
    r = rc.qc_daily_stats(spark.createDataFrame(rows, "id long, created_at timestamp, verdict string, anomaly_score double")).first()
    assert (r.total, r.ng_count, r.ng_rate_pct) == (5, 3, 60.0)


def test_approval_gate(spark):
    rows = [(1, "a", 0.95, '{"valid": false}', 1.0, 0), (2, "b", 0.9, '{"valid": true}', 1000.0, 0), (3, "c", 0.4, '{"valid": true}', 500.0, 0), (4, "d", 0.9, "bad", 50.0, 0), (5, "e", 0.9, "bad", 0.0, 0), (6, "f", 0.9, "{}", 100.0, 0), (7, "g", 0.9, None, None, 0)]
    df = spark.createDataFrame(rows, "id long, title string, confidence double, structured_json string, total_amount double, reviewed int")
    got = {r.id: r.decision for r in rc.batch_approval(df, 0.8).collect()}
    assert got == {1: "blocked", 2: "approved", 4: "approved", 5: "blocked", 6: "approved", 7: "blocked"}


@pytest.mark.parametrize("n,stage", [(None, 1), (0, 1), (1, 1), (5, 1), (9, 1), (10, 2), (30, 2), (49, 2), (50, 3), (55, 3), (500, 3)])
def test_stage_boundaries(spark, n, stage):
    assert spark.createDataFrame([(n,)], "n int").select(op.fusion_stage(F.col("n"))).first()[0] == stage


@pytest.mark.parametrize(
    "ng,pc,dv,verdict,fallback",
    [([], 20, 20, "OK", False), (["patchcore"], 20, 20, "REVIEW", False), (["patchcore", "dinov2"], 20, 20, "NG", False), (["patchcore", "dino"], 55, 55, "NG", False), (["dino", "yolo"], 55, 55, "REVIEW", False), (["patchcore"], 20, None, "NG", True), (["unknown"], 20, 20, "OK", False), (["dino"], 80, 12, "REVIEW", False)],
)
def test_fusion_table(spark, ng, pc, dv, verdict, fallback):
    df = spark.createDataFrame([(ng, pc, dv)], "ng array<string>, pc int, dv int")
    v = op.staged_fusion(F.col("ng"), {"patchcore": F.col("pc"), "dinov2": F.col("dv")})
    r = df.select(*[c.alias(k) for k, c in v.items()]).first()
    assert (r.verdict, r.fallback_or) == (verdict, fallback)


def test_conformal_thresholds(spark):
    def tau(scores, eps):
        df = spark.createDataFrame([(0, float(s)) for s in scores], "g int, score double")
        return op.calibrate(df, ["g"], eps).first()

    assert tau([0.1, 0.2, -0.5, math.nan, 0.3, 0.4, math.inf], 0.1).n_samples == 4
    assert tau([1, 2], 0.1) is None
    assert tau([1.0] * 50, 0.05).threshold == 1.0
    x = np.random.default_rng(3).lognormal(-2, 0.6, 500)
    taus = [tau(x, e).threshold for e in (0.02, 0.05, 0.1, 0.3)]
    assert taus == sorted(taus, reverse=True) and taus[1] == np.sort(x)[math.ceil(0.95 * 501) - 1]


def test_drift(spark):
    rows = [("k", dt.datetime(2026, 1, 1) + dt.timedelta(seconds=i), i, 1.0, 0.5, 0.1) for i in range(35)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, event_id long, score double, tau double, eps double")
    out = {r.event_id: r.drifting for r in op.drift(df, "key").collect()}
    assert not out[28] and out[29] and out[34]


@pytest.mark.parametrize("a,b,want", [("PP\n20240315", "PP 20240315", 0.1), ("", "", 0.0), ("x", "", 1.0), ("划痕", "划伤", 0.5)])
def test_cer(spark, a, b, want):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(tx.cer("a", "b")).first()[0] == pytest.approx(want)


def test_corrections(spark):
    fixed, log = tx.corrected("t")
    rows = spark.createDataFrame([("8O8O8\n8OO8",), ("1l2S3B4Z5",)], "t string").select(fixed, F.size(log)).collect()
    assert [tuple(r) for r in rows] == [("80808\n8OO8", 1), ("112538425", 4)]
    assert tx.custom_rules("a(\\d)|||b\\1\nbad(|||x") == [("custom:a(\\d)", "a(\\d)", "b$1")]


def test_custom_rules_take_replacements_literally(spark):
    rules = tx.custom_rules("a|||$9\n(b)c|||\\g<1>$\nx(|||y\nz|||\\7")
    assert [r[1] for r in rules] == ["a", "(b)c"]
    fixed, log = tx.corrected("t", rules)
    r = spark.createDataFrame([("a bc",)], "t string").select(fixed.alias("f"), log.alias("g")).first()
    assert r.f == "$9 b$" and len(r.g) == 2


def test_number_text(spark):
    rows = spark.createDataFrame([(12345678.0,), (0.1,), (800000.0,), (98765432.25,), (0.0,)], "v double").select(tx.number_text(F.col("v"))).collect()
    assert [r[0] for r in rows] == ["12345678.0", "0.1", "800000.0", "98765432.25", "0.0"]


def test_rank_with_one_frequent_value(spark):
    from millrace.operators import inspection

    values = [5.0] * 5000 + [float(i) for i in range(400)]
    df = spark.createDataFrame([("hot", v) for v in values] + [("cold", float(i)) for i in range(50)], "k string, v double")
    for share in (0.01, 0.3, 0.5, 0.97, 1.0):
        got = {r.k: r.v for r in inspection.kth_smallest(df, ["k"], "v", F.ceil(F.col("n") * share)).collect()}
        plain = lambda x: sorted(x)[int(-(-len(x) * share // 1)) - 1]
        assert got == {"hot": plain(values), "cold": plain([float(i) for i in range(50)])}


def test_boxes(spark):
    df = spark.createDataFrame([Row(x1=10.0, y1=10.0, x2=0.0, y2=0.0)])
    assert df.select(geometry.area(geometry.box())).first()[0] == 100.0
    rois = spark.createDataFrame([(1, 1, 10.0, 10.0, 90.0, 90.0, 0.9), (1, 2, 20.0, 20.0, 40.0, 40.0, 0.4)], "image long, roi_id long, x double, y double, w double, h double, score double")
    assert [r.score for r in op.select_rois(rois, "image").collect()] == [0.9]


def test_json_repair(spark):
    cases = ['```json\n{"a": [1, {"b": "x', '{"a": 1}', "none", '{"a": 1, "b": ', None]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cases], "t string").select(tx.whole_json("t")).collect()]
    assert got == ['{"a": [1, {"b": "x"}]}', '{"a": 1}', None, '{"a": 1}', None]


def test_register_files(spark):
    df = spark.createDataFrame([(1, "x", None, "a"), (2, "x", 7, "b"), (3, "y", None, "c")], "id long, content string, contract_id long, file_name string")
    assert sorted((r.id, r.contract_id) for r in rc.register_files(df).collect()) == [(1, 7), (3, None)]


def test_windows_in_small_blocks(spark):
    """A hot key (90 % of all rows, many at one time) in blocks gives what one window over its whole history gives."""
    from millrace.operators import inspection as ins

    df = spark.range(3000).selectExpr("id AS event_id", "CASE WHEN id % 10 = 0 THEN concat('k', id % 7) ELSE 'hot' END AS key", "timestamp_seconds(CASE WHEN id % 3 = 0 THEN 500 ELSE (id * 7919) % 4000 END) AS ts", "CAST((id * 31) % 100 AS DOUBLE) AS score", "60.0D AS tau", "0.05D AS eps")
    one = {r.event_id: (r.n, round(r.rate, 9), r.drifting) for r in ins.drift(df, "key", block=1_000_000).collect()}
    few = {r.event_id: (r.n, round(r.rate, 9), r.drifting) for r in ins.drift(df, "key", block=250).collect()}
    assert one == few and len(one) == 3000 and max(n for n, _, _ in one.values()) == 200
    late = {r.event_id: (r.mean_last, r.seen) for r in ins.latency(df, "key", "score", block=40).collect()}
    rows = sorted(df.filter("key = 'hot'").collect(), key=lambda r: (r.ts, r.event_id))
    for i, r in enumerate(rows):
        last = [x.score for x in rows[max(0, i - 19) : i + 1]]
        assert late[r.event_id][1] == i + 1 and abs(late[r.event_id][0] - sum(last) / len(last)) <= 0.051


def test_reading_order(spark):
    """Labels run from top to bottom, then from left to right; boxes at one place go by their id."""
    from millrace.plans import inspection_queries as q

    rows = [(1, 9, 5.0, 40.0, 30.0, 80.0), (1, 8, 50.0, 10.0, 90.0, 20.0), (1, 7, 5.0, 10.0, 30.0, 40.0), (1, 6, 5.0, 40.0, 30.0, 80.0), (2, 5, 0.0, 0.0, 20.0, 20.0)]
    boxes = spark.createDataFrame(rows, "frame_id long, det_id long, x1 double, y1 double, x2 double, y2 double")
    got = {r.det_id: (r.frame_id, r.label_no, r.used) for r in q.w9_reading_order(boxes).collect()}
    assert got == {7: (1, 1, True), 8: (1, 2, False), 6: (1, 3, True), 9: (1, 4, True), 5: (2, 1, True)}


def test_cuts_are_the_same_for_every_step(spark):
    """Approximate quantiles are no part of a result's plan, where two steps could evaluate them differently."""
    rows = spark.range(50).selectExpr("id AS event_id", "id % 2 AS k", "CAST(id % 7 AS DOUBLE) AS score", "CAST(id % 3 = 0 AS INT) AS defect", "timestamp_seconds(id) AS ts")
    for df in (op.kth_smallest(rows, ["k"], "score", F.lit(3)), op.quantile(rows, ["k"], "score", 0.3, "q"), op.empirical_p_value(rows, rows, ["k"]), op.auroc(rows, ["k"]), op.in_order(rows, "k", "rn")):
        assert df.count() > 0 and "percentile" not in df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_quantiles_between_ranks(spark):
    values = {"a": [5.0] * 30 + [1.0, 2.5, 9.0, 70.0], "b": [3.0], "c": [float(i * i) for i in range(300)]}
    df = spark.createDataFrame([(k, v) for k, x in values.items() for v in x], "k string, v double")
    for q in (0.0, 0.3, 0.5, 0.99, 1.0):
        assert {r.k: round(r.q, 9) for r in op.quantile(df, ["k"], "v", q, "q").collect()} == {k: round(float(np.quantile(x, q)), 9) for k, x in values.items()}


def test_one_mean_for_cut_and_members(spark):
    rows = spark.range(20).selectExpr("id AS vec_id", "array(CAST(id AS FLOAT), 1.0F) AS embedding")
    plan = op.nearest_share(rows, 0.5, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "avg(" not in plan


def test_equal_scores_of_the_dual_path_tie(spark):
    """Scores that the decimal formula makes equal, and those of DuckDB in the last bit."""
    from millrace.functions import scores
    from millrace.plans import inspection_queries as q

    rows = [(i, 1, (i * 37 % 5000) / 100) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, score double")
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE t (event_id BIGINT, user_id BIGINT, score DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    want = dict(con.execute("SELECT event_id, 0.7 * score / 100 + 0.3 * (event_id % 9) / 8.0 FROM t").fetchall())
    got = {r.event_id: r.v for r in df.select("event_id", scores.dual_path_score(F.col("score"), F.col("event_id") % 9, F.lit(8), full=100).alias("v")).collect()}
    assert got == want
    assert {r.best for r in q.m12_dual_path(df).collect()} == {max(want, key=lambda i: (want[i], -i))}


def test_fusion_by_numbers_of_all_frames(spark):
    """Numbers that return in another frame: matched there, matched here where the number names a detection over all frames."""
    s = "frame_id long, det_id long, x1 double, y1 double, x2 double, y2 double, score double, label string"
    box = (0.0, 0.0, 10.0, 10.0, 0.5, "x")
    depth, flat = spark.createDataFrame([(1, 7, *box), (2, 7, *box)], s), spark.createDataFrame([(1, 8, *box), (3, 8, *box)], s)
    rows = lambda **more: sorted((r.frame_id, r.det_id, r.source) for r in op.fuse_depth(depth, flat, **more)[0].collect())
    assert rows() == [(1, 7, "3D+2D"), (2, 7, "3D"), (3, 8, "2D")]
    assert rows(ids=("det_id",)) == [(1, 7, "3D+2D"), (2, 7, "3D+2D")]
