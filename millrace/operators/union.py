"""Verdict of an image over four sources, any of which may be skipped or fail.

A source takes part in an image's verdict when it is switched on, has what it needs for the image's product (a feature bank, own weights, a
prompt) and gives a result without an error. Sources that don't, count neither for nor against; an image in which none takes part is OK but not ``trusted``.

Every table is long: signals (image_id, source, score, n_boxes, error) and states (product, source, tau, n_cal, epsilon). Both are turned to
one row per image (product) by one aggregation each, so an image costs one shuffle however many sources there are.

Null scores are no defect; a null or blank product has the only bank of a source if there is exactly one; an image without signals is judged without them; repeated
signals of a source count as the greatest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import inspection

#: The sources in the order in which they report, and the texts of reviews.
REPORT_ORDER = ("patchcore", "dino", "yolo", "dinov2")
TOO_FEW_SOURCES = "校准源仅 {} 个参与, 无法一致投票, 回退 OR"
ONE_CALIBRATED = "仅单一校准源判NG ({}), 无第二源互证"
ONLY_UNCALIBRATED = "仅未校准源判NG ({}), 无校准源支持"
DEFAULT_PRODUCT = "默认"


def _by_source(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row per key with a struct of ``fields`` per source (null: no row of that source)."""
    pick = lambda s: F.max(F.when(F.col("source") == s, F.struct(*fields)))
    return rows.groupBy(key).agg(*[pick(s).alias(s) for s in REPORT_ORDER])


def product_states(states: DataFrame) -> DataFrame:
    """One row per product; the row of the product '' has the banks that are the only ones of their (calibrated) source."""
    fields = ["tau", "n_cal", "epsilon"]
    named = states.filter("product <> ''").select("product", "source", *fields)
    only = named.filter(F.col("source").isin(*inspection.CALIBRATED)).groupBy("source").agg(F.count(F.lit(1)).alias("c"), *[F.max(f).alias(f) for f in fields])
    return _by_source(named.unionByName(only.filter("c = 1").select(F.lit("").alias("product"), "source", *fields)), "product", fields)


def _filled(message: str, value: Column) -> Column:
    """``message`` with ``value`` in its place."""
    before, after = message.split("{}")
    return F.concat(F.lit(before), value.cast("string"), F.lit(after))


def union_verdicts(
    images: DataFrame,
    signals: DataFrame,
    states: DataFrame,
    threshold: float | None = None,
    default_threshold: float = 0.5,
    conservative: bool = False,
    enabled: tuple[str, ...] = REPORT_ORDER,
    mode: str = "staged",
) -> DataFrame:
    """``images`` (image_id, product, readable, prompt) with a struct per source (status scored, skipped or error; score, n_boxes, threshold_used, label,
    tau, epsilon, n_cal) and verdict, ng_sources, trusted, stage, n_cal, fallback_or, review_required, review_reasons.

    A calibrated source says NG over the explicit ``threshold``, else over its product's tau, else over ``default_threshold`` (half of it if
    ``conservative``); the others say NG when they find a box."""
    base = images.select("image_id", F.trim(F.coalesce("product", F.lit(""))).alias("product"), F.coalesce("readable", F.lit(False)).alias("readable"), F.coalesce("prompt", F.lit("")).alias("prompt"))
    seen = _by_source(signals, "image_id", ["score", "n_boxes", "error"]).select(F.col("image_id").alias("s_id"), *[F.col(s).alias(f"s_{s}") for s in REPORT_ORDER])
    known = product_states(states).select(F.col("product").alias("k_product"), *[F.col(s).alias(f"k_{s}") for s in REPORT_ORDER])
    rows = base.join(seen, F.col("image_id") == F.col("s_id"), "left").join(known, F.col("product") == F.col("k_product"), "left")
    out = rows.select("image_id", "product", "readable", *[_source(s, threshold, default_threshold * (0.5 if conservative else 1.0), s in enabled).alias(s) for s in REPORT_ORDER])
    ng = F.array_compact(F.array(*[F.when(F.col(f"{s}.label") == "NG", F.lit(s)) for s in REPORT_ORDER]))
    out = out.withColumn("ng_sources", F.when(F.col("readable"), ng).otherwise(F.array().cast("array<string>")))
    n_cal = {s: F.when(F.col(f"{s}.status") == "scored", F.col(f"{s}.n_cal")) for s in inspection.CALIBRATED}
    fused = inspection.staged_fusion(F.col("ng_sources"), n_cal, mode)
    took_part = F.lit(False)
    for s in REPORT_ORDER:
        took_part = took_part | (F.col(f"{s}.status") == "scored")
    present = sum((F.when(F.coalesce(c, F.lit(0)) > 0, 1).otherwise(0) for c in n_cal.values()), F.lit(0))
    calibrated = F.filter("ng_sources", lambda s: s.isin(*inspection.CALIBRATED))
    uncalibrated = F.filter("ng_sources", lambda s: s.isin(*inspection.UNCALIBRATED))
    reason = (
        F.when(F.col("fallback_or"), _filled(TOO_FEW_SOURCES, present))
        .when(F.col("review_required") & (F.size(calibrated) > 0), _filled(ONE_CALIBRATED, calibrated[0]))
        .when(F.col("review_required"), _filled(ONLY_UNCALIBRATED, F.array_join(uncalibrated, "+")))
    )
    out = out.withColumns({"trusted": F.col("readable") & took_part} | {k: v for k, v in fused.items()})
    out = out.withColumn("verdict", F.when(F.col("readable"), F.col("verdict")).otherwise("ERROR"))
    return out.withColumn("review_reasons", F.array_compact(F.array(reason)))


def _source(source: str, threshold: float | None, default: float, on: bool) -> Column:
    signal, state = F.col(f"s_{source}"), F.col(f"k_{source}")
    ready = F.lit(on) & F.col("readable")
    if source == "dino":
        ready = ready & F.col("prompt").rlike(r"\S")
    else:
        ready = ready & state.isNotNull()
        if source == "yolo":
            ready = ready & (F.col("product") != "")
    failed = F.coalesce(signal["error"], F.lit("")) != ""
    status = F.when(~ready | signal.isNull(), "skipped").when(failed, "error").otherwise("scored")
    scored = status == "scored"
    if source in inspection.CALIBRATED:
        used = F.lit(threshold).cast("double") if threshold is not None else F.coalesce(state["tau"], F.lit(default))
        bad = F.coalesce(signal["score"] > used, F.lit(False))
    else:
        used = F.lit(None).cast("double")
        bad = F.coalesce(signal["n_boxes"] > 0, F.lit(False))
    fields = {"score": signal["score"], "n_boxes": signal["n_boxes"], "threshold_used": used, "label": F.when(bad, "NG").otherwise("OK")}
    return F.struct(status.alias("status"), *[F.when(scored, v).alias(k) for k, v in fields.items()], *[F.when(scored, state[c]).alias(c) for c in ("tau", "epsilon", "n_cal")])


def drift_observations(verdicts: DataFrame, times: DataFrame) -> DataFrame:
    """What the drift monitor sees: calibrated scores of images in stage 3, good ones too. times: image_id, ts."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("source"), F.col(f"{s}.status").alias("status"), F.col(f"{s}.score").alias("score"), F.col(f"{s}.tau").alias("tau"), F.col(f"{s}.epsilon").alias("eps"), F.col(f"{s}.n_cal").alias("n")) for s in inspection.CALIBRATED]))
    rows = verdicts.filter("readable and stage = 3").select("image_id", "product", each.alias("o")).select("image_id", "product", "o.*").filter("status = 'scored' and tau is not null and coalesce(n, 0) > 0")
    name = F.concat(F.when(F.col("product") == "", DEFAULT_PRODUCT).otherwise(F.col("product")), F.lit("/"), "source")
    rows = rows.select(name.alias("key"), F.col("image_id").alias("event_id"), F.coalesce("score", F.lit(0.0)).alias("score"), "tau", F.coalesce("eps", F.lit(0.1)).alias("eps"))
    return rows.join(times.select(F.col("image_id").alias("event_id"), "ts"), "event_id")


def drift_warnings(verdicts: DataFrame, times: DataFrame, **limits) -> DataFrame:
    """Per observation in stage 3 the rate over tau of its product and source, and whether it has drifted; the verdicts stay as they are."""
    return inspection.drift(drift_observations(verdicts, times), "key", **limits)
