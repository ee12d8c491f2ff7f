"""Union verdicts and the calibration protocol, case by case."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import inspection, protocol, union
from millrace.operators.inspection import calibrate

SIGNALS = "image_id long, source string, score double, n_boxes int, error string"
STATES = "product string, source string, tau double, n_cal int, epsilon double"


def judged(spark, signals, states=(), product="A", readable=True, prompt="", **how):
    """The verdict of one image."""
    images = spark.createDataFrame([(1, product, readable, prompt)], "image_id long, product string, readable boolean, prompt string")
    sig = spark.createDataFrame([(1, *s) for s in signals], SIGNALS)
    return union.union_verdicts(images, sig, spark.createDataFrame(list(states), STATES), **how).first()


def bank(source, n_cal=None, tau=1.0, product="A"):
    return (product, source, tau, n_cal, 0.1)


def scored(source, bad):
    return (source, 2.0 if bad else 0.5, None, None)


def boxes(source, n):
    return (source, None, n, None)


PC, DV = "patchcore", "dinov2"


@pytest.mark.parametrize(
    "signals,states,how,verdict,sources",
    [
        ([scored(PC, False), scored(DV, False), boxes("dino", 0)], [bank(PC), bank(DV)], {"prompt": "scratch"}, "OK", []),
        ([scored(PC, True), scored(DV, False)], [bank(PC), bank(DV)], {}, "NG", [PC]),
        ([scored(PC, True), scored(DV, True), boxes("dino", 2)], [bank(PC), bank(DV)], {"prompt": "scratch"}, "NG", [PC, "dino", DV]),
        ([scored(PC, True), scored(DV, False)], [bank(PC, 15), bank(DV, 15)], {}, "REVIEW", [PC]),
        ([scored(PC, True), scored(DV, True)], [bank(PC, 15), bank(DV, 15)], {}, "NG", [PC, DV]),
        ([boxes("dino", 5)], [], {"prompt": "  "}, "OK", []),
        ([boxes("yolo", 3)], [], {}, "OK", []),
        ([boxes("yolo", 2)], [bank("yolo")], {}, "NG", ["yolo"]),
        ([boxes("yolo", 2)], [bank("yolo")], {"product": ""}, "OK", []),
        ([scored(PC, True)], [bank(PC)], {"readable": False}, "ERROR", []),
        ([(PC, 2.0, None, "out of memory"), scored(DV, True)], [bank(PC), bank(DV)], {}, "NG", [DV]),
        ([scored(PC, True), scored(DV, False)], [bank(PC, 15), bank(DV, 15)], {"mode": "or"}, "NG", [PC]),
        ([scored(PC, True), boxes("dino", 1)], [bank(PC, 15), bank(DV, 15)], {"prompt": "x"}, "NG", [PC, "dino"]),
        ([scored(PC, False), scored(DV, False), boxes("dino", 1), boxes("yolo", 1)], [bank(PC, 60), bank(DV, 60), bank("yolo")], {"prompt": "x"}, "REVIEW", ["dino", "yolo"]),
        ([scored(PC, True)], [bank(PC), bank(DV)], {"enabled": (DV, "dino", "yolo")}, "OK", []),
    ],
)
def test_union(spark, signals, states, how, verdict, sources):
    r = judged(spark, signals, states, **how)
    assert (r.verdict, r.ng_sources) == (verdict, sources)


def test_union_without_any_source_is_not_trusted(spark):
    r = judged(spark, [])
    assert r.verdict == "OK" and not r.trusted and r.patchcore.status == "skipped"
    assert judged(spark, [scored(PC, False)], [bank(PC)]).trusted
    r = judged(spark, [(PC, 2.0, None, "broken")], [bank(PC)])
    assert r.patchcore.status == "error" and r.patchcore.score is None and not r.trusted


def test_thresholds_by_precedence(spark):
    label = lambda score, tau, **how: judged(spark, [(PC, score, None, None)], [bank(PC, tau=tau)], **how).patchcore
    assert label(1.5, 2.0).label == "OK" and label(1.5, 2.0, threshold=1.0).label == "NG" and label(0.4, 2.0, threshold=0.0).label == "NG"
    assert label(0.4, None).threshold_used == 0.5 and label(0.4, None).label == "OK"
    assert label(0.4, None, conservative=True).threshold_used == 0.25 and label(0.4, None, conservative=True).label == "NG"
    assert label(None, 2.0).label == "OK" and label(2.0, 2.0).label == "OK"


def test_the_only_bank_serves_images_without_a_product(spark):
    assert judged(spark, [scored(PC, True)], [bank(PC, product="B")], product=None).verdict == "NG"
    r = judged(spark, [scored(PC, True)], [bank(PC, product="B"), bank(PC, product="C")], product=" ")
    assert r.verdict == "OK" and r.patchcore.status == "skipped"


def test_reasons(spark):
    one = judged(spark, [scored(PC, True), scored(DV, False)], [bank(PC, 15), bank(DV, 15)])
    assert one.review_reasons == ["仅单一校准源判NG (patchcore), 无第二源互证"] and one.review_required and one.stage == 2
    alone = judged(spark, [scored(PC, True)], [bank(PC, 15), bank(DV, 15)])
    assert alone.fallback_or and alone.verdict == "NG" and alone.review_reasons == ["校准源仅 1 个参与, 无法一致投票, 回退 OR"]
    boxed = judged(spark, [scored(PC, False), scored(DV, False), boxes("dino", 1), boxes("yolo", 1)], [bank(PC, 60), bank(DV, 60), bank("yolo")], prompt="x")
    assert boxed.review_reasons == ["仅未校准源判NG (dino+yolo), 无校准源支持"] and boxed.stage == 3


def test_drift_sees_stage_three_only(spark):
    images = spark.createDataFrame([(i, "A" if i % 2 else "B", True, "") for i in range(300)], "image_id long, product string, readable boolean, prompt string")
    sig = spark.createDataFrame([(i, s, 2.0 if i > 200 else 0.0, None, None) for i in range(300) for s in (PC, DV)], SIGNALS)
    states = spark.createDataFrame([bank(PC, 60), bank(DV, 80), bank(PC, 60, product="B"), bank(DV, 49, product="B")], STATES)
    v = union.union_verdicts(images, sig, states)
    out = union.drift_warnings(v, images.select("image_id", F.timestamp_seconds("image_id").alias("ts"))).collect()
    assert {r.key for r in out} == {"A/patchcore", "A/dinov2"} and len(out) == 300
    assert not any(r.drifting for r in out if r.event_id <= 201) and all(r.drifting for r in out if r.event_id > 290)


# --- protocol


def session(spark, n=30, scores=None, states=None, ng=(), fail=(), missing=0, product="P"):
    """(session row, {source: row}, new state) of one product whose i-th calibration image scores 1 + 0.1 i."""
    images = [(i, product, "cal", True) for i in range(n)] + [(900 + i, product, "cal", False) for i in range(missing)] + [(1000 + i, product, "ng", True) for i in range(len(ng))]
    rows = [(i, s, 1.0 + 0.1 * i, "failed" if i in fail and s == PC else None) for i in range(n) for s in (PC, DV)]
    rows += [(1000 + i, s, x, None) for i, x in enumerate(ng) for s in (PC, DV)]
    state = [(product, s, True, True, 1.0, 3, 0.1) for s in (PC, DV)] if states is None else states
    state = spark.createDataFrame(state, "product string, source string, registered boolean, has_bank boolean, tau double, n_cal int, epsilon double")
    im = spark.createDataFrame(images, "image_id long, product string, role string, readable boolean")
    sc = spark.createDataFrame(rows if scores is None else scores, "image_id long, source string, score double, error string")
    sessions, sources = protocol.recalibrate(im, sc, state)
    new = {(r.product, r.source): r for r in protocol.transition(state, sources).collect()}
    return sessions.first(), {r.source: r for r in sources.collect()}, new, (im, sessions, sources)


def tau_of(spark, scores, epsilon=0.1):
    df = spark.createDataFrame([("k", s) for s in scores], "k string, score double")
    return calibrate(df, ["k"], epsilon).first().threshold


def test_recalibration_moves_thresholds_and_stage(spark):
    s, sources, new, _ = session(spark, 30)
    want = tau_of(spark, [1.0 + 0.1 * i for i in range(30)])
    assert s.ok and (s.n_cal_min, s.stage_before, s.stage_after) == (30, 1, 2) and protocol.STAGE_2 in s.hints and protocol.JUMPED in s.hints
    for src in (PC, DV):
        assert (sources[src].status, sources[src].n_cal, sources[src].tau, sources[src].tau_before) == ("ok", 30, want, 1.0)
        assert (new["P", src].tau, new["P", src].n_cal) == (want, 30)
    s = session(spark, 50)[0]
    assert (s.n_cal_min, s.stage_after) == (50, 3) and protocol.STAGE_2 not in s.hints


def test_sessions_that_are_refused(spark):
    s, sources, new, _ = session(spark, 2, missing=4)
    assert not s.ok and "至少 3 张" in s.error and not sources and new["P", PC].tau == 1.0 and s.stage_before == 1
    s = session(spark, 5, states=[("P", src, True, False, None, None, 0.1) for src in (PC, DV)])[0]
    assert not s.ok and "无可用特征库" in s.error
    s, sources, new, _ = session(spark, 5, scores=[(i, PC, 1.0, "x") for i in range(5)])
    assert not s.ok and s.error == protocol.ALL_FAILED and sources[PC].status == protocol.TOO_FEW_SCORES and new["P", PC].n_cal == 3


def test_one_bank_and_failed_images(spark):
    s, sources, new, _ = session(spark, 15, states=[("P", PC, True, True, None, None, None), ("P", DV, True, False, 7.0, 2, 0.1)])
    assert s.ok and s.n_cal_min == 15 and sources[DV].status == protocol.NO_BANK and new["P", DV].tau == 7.0
    assert sources[PC].epsilon == 0.02 and sources[PC].tau == tau_of(spark, [1.0 + 0.1 * i for i in range(15)], 0.02)
    s, sources, _, _ = session(spark, 10, fail={0, 1})
    assert (sources[PC].n_failed, sources[PC].n_scored, sources[PC].n_cal, s.n_cal_min) == (2, 8, 8, 8) and protocol.STILL_STAGE_1 in s.hints
    s, sources, _, _ = session(spark, 10, states=[("P", PC, True, True, 1.0, 3, 0.1)])
    assert sources[DV].status == protocol.NO_ENGINE and s.ok


def test_recall_of_defects(spark):
    t = tau_of(spark, [1.0 + 0.1 * i for i in range(30)])
    s, sources, _, _ = session(spark, 30, ng=[t + 1, t + 0.5, t + 0.1, t - 0.5])
    assert sources[PC].ng_recall == 0.75 and (s.n_defects, s.union_recall) == (4, 0.75) and protocol.JUMPED not in s.hints


def test_sessions_are_kept_with_a_manifest(spark, tmp_path):
    _, _, _, (images, sessions, sources) = session(spark, 10, missing=2, product="P/A:B")
    protocol.write_session(images, sessions, sources, str(tmp_path), "s1")
    r = protocol.read_session(spark, str(tmp_path), "s1").first()
    m = json.loads(r.manifest)
    assert r.n_files == 10 and m["product"] == "P/A:B" and m["n_cal_images"] == 10 and [x["source"] for x in m["sources"]] == [DV, PC]
    assert (tmp_path / "s1" / "files" / "directory=P_A_B").is_dir()


def test_one_product_with_most_images(spark):
    """Thresholds come from counted ranges, whatever share of the rows one product has."""
    images = spark.range(40_000).select(F.col("id").alias("image_id"), F.when(F.col("id") % 10 == 0, F.concat(F.lit("q"), (F.col("id") % 70).cast("string"))).otherwise("hot").alias("product"), F.lit("cal").alias("role"), F.lit(True).alias("readable"))
    scores = images.select("image_id", F.lit(PC).alias("source"), F.when(F.col("image_id") % 2 == 0, 5.0).otherwise((F.xxhash64("image_id") % 1000 + 1000) / 100).alias("score"), F.lit(None).cast("string").alias("error"))
    state = images.select("product").distinct().selectExpr("product", "'patchcore' AS source", "true AS registered", "true AS has_bank", "CAST(null AS double) AS tau", "CAST(null AS int) AS n_cal", "0.1D AS epsilon")
    got = {r["product"]: r.tau for r in protocol.recalibrate(images, scores, state)[1].filter("tau is not null").collect()}
    rows = images.join(scores, "image_id").select("product", "score").toPandas()
    for p, x in rows.groupby("product")["score"]:
        n = len(x)
        assert got[p] == sorted(x)[min(max(-(-9 * (n + 1) // 10), 1), n) - 1]
    assert inspection.CALIBRATED == (PC, DV)
