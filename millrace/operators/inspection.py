"""Statistical quality inspection: calibrated thresholds, fusion of sources, drift, ranking metrics, evaluation gates."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import geometry, scores
from millrace.storage import saved

#: The sources, in report order; the first two kinds are calibrated.
SOURCES = ("patchcore", "dinov2", "dino", "yolo")
CALIBRATED = ("patchcore", "dinov2")
UNCALIBRATED = ("dino", "yolo")


def usable(score: str = "score") -> Column:
    """Finite and not negative."""
    s = F.col(score)
    return s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf")) & (s >= 0)


def in_ranges(rows: DataFrame, keys: list[str], value: Column, splits: int = 64, **totals: Column) -> DataFrame:
    """``rows`` with __part, the number of the value's range within its keys, and the totals per key.

    Approximate quantiles cut a group into about ``splits`` ranges. They depend on the order in which partial results arrive and differ from one evaluation to the
    next, so they are written once and every later step reads the same cuts."""
    cuts = F.percentile_approx(value, [i / splits for i in range(1, splits)]).alias("__cuts")
    known = saved(rows.groupBy(*keys).agg(cuts, *[v.alias(k) for k, v in totals.items()]), "cuts")
    return rows.join(known, keys).withColumn("__part", F.coalesce(F.size(F.filter("__cuts", lambda c: c < value)), F.lit(0))).drop("__cuts")


def _ranked(rows: DataFrame, keys: list[str], value: str, ranks: list[Column], splits: int) -> DataFrame:
    """(keys, n, value, __seen, __m and the ranks as __rank0 ..): the distinct values that hold one of the ranks, columns over n. Groups may be large: equal values are
    counted first (combined on the map side), the counts of ranges tell those that hold a rank, and only their distinct values are sorted."""
    per_value = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__m"))
    names = [f"__rank{i}" for i in range(len(ranks))]
    placed = in_ranges(per_value, keys, F.col(value), splits, n=F.sum("__m")).withColumns({k: r.cast("long") for k, r in zip(names, ranks, strict=True)})
    counts = placed.groupBy(*keys, "__part").agg(F.sum("__m").alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.select(*keys, "__part", (upto - F.col("__c")).alias("__before"), upto.alias("__upto"))
    holds = lambda low, high: reduce(or_, [(F.col(k) > low) & (F.col(k) <= high) for k in names])
    inside = placed.join(counts, [*keys, "__part"]).filter(holds(F.col("__before"), F.col("__upto")))
    seen = F.sum("__m").over(Window.partitionBy(*keys, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) + F.col("__before")
    return inside.withColumn("__seen", seen).filter(holds(F.col("__seen") - F.col("__m"), F.col("__seen")))


def kth_smallest(rows: DataFrame, keys: list[str], value: str, rank: Column, splits: int = 64) -> DataFrame:
    """(keys, n, value): per group the value of the given rank, a column over n."""
    return _ranked(rows, keys, value, [rank], splits).select(*keys, "n", value)


def conformal_rank(epsilon: float) -> Column:
    """The rank of the split-conformal threshold among n scores."""
    return F.least(F.greatest(F.ceil((1.0 - F.lit(epsilon)) * (F.col("n") + 1)), F.lit(1)), F.col("n"))


def calibrate(normal: DataFrame, keys: list[str], epsilon: float, score: str = "score") -> DataFrame:
    """Per key the threshold that a new normal score exceeds with probability epsilon at most, with the moments of log1p
    scores for p-values (null with fewer than ten scores or hardly any spread). Keys of fewer than three usable scores get none."""
    rows = normal.filter(usable(score))
    tau = kth_smallest(rows, keys, score, conformal_rank(epsilon)).filter("n >= 3").withColumnRenamed(score, "threshold")
    moments = rows.groupBy(*keys).agg(F.avg(F.log1p(score)).alias("mu"), F.stddev_samp(F.log1p(score)).alias("sigma"))
    fits = (F.col("n") >= 10) & (F.col("sigma") > 1e-8)
    out = tau.join(moments, keys).withColumns({c: F.when(fits, F.col(c)) for c in ("mu", "sigma")})
    return out.withColumnRenamed("n", "n_samples").withColumn("epsilon", F.lit(epsilon))


def p_value(score: Column, mu: Column, sigma: Column) -> Column:
    """Upper tail of a normal score distribution in the log1p domain."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - scores.normal_cdf((F.log1p(F.greatest(score, F.lit(0.0))) - mu) / sigma)))


def empirical_p_value(rows: DataFrame, normal: DataFrame, keys: list[str], score: str = "score", splits: int = 64) -> DataFrame:
    """(number of normal scores >= score, plus 1) / (n + 1), by one merged cumulative count per key, taken inside ranges of scores and carried over
    by the ranges' sums, so no group is sorted in one task."""
    both = rows.select(*keys, score, F.lit(0).alias("__normal")).unionByName(normal.filter(usable(score)).select(*keys, score, F.lit(1).alias("__normal")))
    per = both.groupBy(*keys, score).agg(F.sum("__normal").alias("__c"), (F.count(F.lit(1)) - F.sum("__normal")).alias("__q"))
    per = in_ranges(per, keys, F.col(score), splits, __n=F.sum("__c"))
    sums = per.groupBy(*keys, "__part").agg(F.sum("__c").alias("__pc"))
    above = F.coalesce(F.sum("__pc").over(Window.partitionBy(*keys).orderBy(F.col("__part").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.join(sums.select(*keys, "__part", above.alias("__above")), [*keys, "__part"])
    at_least = F.sum("__c").over(Window.partitionBy(*keys, "__part").orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)) + F.col("__above")
    return per.withColumn("p_value", (at_least + 1.0) / (F.col("__n") + 1.0)).filter("__q > 0").select(*keys, score, "p_value")


def p_values(rows: DataFrame, normal: DataFrame, keys: list[str], epsilon: float = 0.1, score: str = "score") -> DataFrame:
    """``rows`` with p_value: by the fitted log-normal where a key has one, else by counting. Negative scores count as 0."""
    c = calibrate(normal, keys, epsilon, score).select(*keys, "mu", "sigma")
    known = rows.join(c, keys)
    fitted = known.filter("sigma is not null").withColumn("p_value", p_value(F.col(score), F.col("mu"), F.col("sigma"))).drop("mu", "sigma")
    counted = known.filter("sigma is null").drop("mu", "sigma").withColumn("__s", F.greatest(F.col(score), F.lit(0.0)))
    few = normal.join(c.filter("sigma is null").select(*keys), keys, "left_semi").withColumn("__s", F.col(score))
    by_count = empirical_p_value(counted, few, keys, "__s")
    return fitted.unionByName(counted.join(by_count, [*keys, "__s"]).drop("__s"))


def rates(rows: DataFrame, taus: DataFrame, keys: list[str]) -> DataFrame:
    """False alarms among normals and recall among defects, by threshold row."""
    hit = (F.col("score") > F.col("threshold")).cast("double")
    by = [c for c in taus.columns if c in (*keys, "epsilon", "threshold")]
    joined = rows.select(*keys, "score", "defect").join(taus.select(*by), keys) if keys else rows.select("score", "defect").crossJoin(F.broadcast(taus.select(*by)))  # a few operating points
    return joined.groupBy(*by).agg(F.avg(F.when(F.col("defect") == 0, hit)).alias("fpr"), F.avg(F.when(F.col("defect") == 1, hit)).alias("recall"))


def auroc(rows: DataFrame, keys: list[str], score: str = "score", label: str = "defect", splits: int = 64) -> DataFrame:
    """Area under the ROC curve with average ranks on ties; NaN where a class is empty.

    Counts per distinct score combine before the shuffle; the running count is taken inside ranges of scores and carried over
    by the ranges' sums, so no group is sorted in one task."""
    key = keys or ["__all"]
    rows = rows if keys else rows.withColumn("__all", F.lit(0))
    per = rows.groupBy(*key, score).agg(F.count_if(F.col(label) == 1).alias("__p"), F.count_if(F.col(label) == 0).alias("__n"))
    per = in_ranges(per, key, F.col(score), splits)
    sums = per.groupBy(*key, "__part").agg(F.sum("__n").alias("__pn"))
    carried = F.coalesce(F.sum("__pn").over(Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.join(sums.select(*key, "__part", carried.alias("__carry")), [*key, "__part"])
    below = F.coalesce(F.sum("__n").over(Window.partitionBy(*key, "__part").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("__carry")
    wins = per.select(*key, "__p", "__n", (F.col("__p") * (below + 0.5 * F.col("__n"))).alias("__w"))
    out = wins.groupBy(*key).agg(F.sum("__p").alias("n_pos"), F.sum("__n").alias("n_neg"), F.sum("__w").alias("w"))
    return out.select(*keys, "n_pos", "n_neg", F.when((F.col("n_pos") == 0) | (F.col("n_neg") == 0), float("nan")).otherwise(F.try_divide("w", F.col("n_pos").cast("double") * F.col("n_neg"))).alias("auroc"))


def in_order(rows: DataFrame, key: str, name: str, ts: str = "ts", tie: str = "event_id", splits: int = 64) -> DataFrame:
    """``rows`` numbered from 1 per key in order of time, then tie. Approximate quantiles of the time cut a key's history into ranges, numbered each
    on its own and carried over by their counts."""
    placed = in_ranges(rows, [key], F.unix_micros(F.col(ts).cast("timestamp")), splits)
    counts = placed.groupBy(key, "__part").agg(F.count(F.lit(1)).alias("__c"))
    before = F.coalesce(F.sum("__c").over(Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.join(counts.select(key, "__part", before.alias("__before")), [key, "__part"])
    here = F.row_number().over(Window.partitionBy(key, "__part").orderBy(ts, tie))
    return placed.withColumn(name, here + F.col("__before")).drop("__part", "__before")


def in_blocks(rows: DataFrame, key: str, number: str, window: int, block: int = 10_000) -> DataFrame:
    """``rows`` with __block and __carried: blocks of neighbouring numbers, each led by copies of the ``window`` - 1 rows before it, so that sliding
    windows need one block alone."""
    at = F.col(number) - 1
    own = rows.withColumns({"__block": F.floor(at / block), "__carried": F.lit(False)})
    tail = rows.filter(at % block > block - window).withColumns({"__block": F.floor(at / block) + 1, "__carried": F.lit(True)})
    return own.unionByName(tail)


def drift(rows: DataFrame, key: str, window: int = 200, least: int = 30, factor: float = 3.0, floor: float = 0.05, block: int = 10_000) -> DataFrame:
    """Per observation (key, ts, event_id, score, tau, eps) the rate over tau among the last ``window`` and whether it is too high. A key's history is
    worked in blocks."""
    w = Window.partitionBy(key, "__block").orderBy("__rn").rowsBetween(-(window - 1), 0)
    out = in_blocks(in_order(rows, key, "__rn"), key, "__rn", window, block)
    out = out.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("rate", F.avg((F.col("score") > F.col("tau")).cast("double")).over(w)).withColumn("eps_ref", F.max("eps").over(w))
    out = out.filter(~F.col("__carried")).drop("__rn", "__block", "__carried")
    return out.withColumn("drifting", (F.col("n") >= least) & (F.col("rate") > F.greatest(factor * F.col("eps_ref"), F.col("eps_ref") + floor)))


def latency(rows: DataFrame, key: str, value: str, window: int = 20, block: int = 10_000, digits: int = 1) -> DataFrame:
    """Sliding mean of the last ``window`` values, count so far and last value, per observation; in blocks as ``drift``."""
    w = Window.partitionBy(key, "__block").orderBy("seen").rowsBetween(-(window - 1), 0)
    out = in_blocks(in_order(rows, key, "seen"), key, "seen", window, block)
    out = out.withColumn("mean_last", F.round(F.avg(value).over(w), digits)).filter(~F.col("__carried")).drop("__block", "__carried")
    return out.withColumn("last", F.col(value))


def fusion_stage(n_cal: Column) -> Column:
    """1 without or with under 10 calibration samples, 2 under 50, else 3."""
    return F.when(n_cal.isNull() | (n_cal < 10), 1).when(n_cal < 50, 2).otherwise(3)


def staged_fusion(ng: Column, n_cal: dict[str, Column], mode: str = "staged") -> dict[str, Column]:
    """Verdict columns from the array of sources that say NG and each calibrated source's sample count (null or 0: absent)."""
    present = F.array_compact(F.array(*[F.when(F.coalesce(n_cal[s], F.lit(0)) > 0, n_cal[s]) for s in CALIBRATED]))
    smallest = F.array_min(present)
    stage = fusion_stage(smallest)
    cal = F.size(F.array_intersect(ng, F.array(*map(F.lit, CALIBRATED))))
    uncal = F.size(F.array_intersect(ng, F.array(*map(F.lit, UNCALIBRATED))))
    none, alone = cal + uncal == 0, F.size(present) < 2
    simple = F.lit(mode == "or") | (stage == 1)
    confirmed = (cal >= 2) | ((cal == 1) & (uncal > 0))
    return {
        "verdict": F.when(none, "OK").when(simple | alone | confirmed, "NG").otherwise("REVIEW"),
        "stage": stage,
        "n_cal": smallest,
        "fallback_or": ~none & ~simple & alone,
        "review_required": ~none & ~simple & ~alone & ~confirmed,
    }


def union_view(flags: DataFrame) -> DataFrame:
    """One row per image from (image_id, source, score, tau): NG sources in report order, the highest probability among those
    sources that give one."""
    order = F.array(*map(F.lit, SOURCES))
    ng = F.array_intersect(order, F.collect_set(F.when(F.col("score") > F.col("tau"), F.col("source"))))
    return flags.groupBy("image_id").agg(ng.alias("ng_sources"), F.max(F.when(F.col("source").isin(*UNCALIBRATED), F.col("score"))).alias("max_score"))


def size_filter(boxes: DataFrame, keys: list[str], min_px: float = 0, max_px: float = float("inf"), min_mm2: float = 0, max_mm2: float = 0, px_per_mm: float = 0) -> DataFrame:
    """Boxes with a flag ``kept``; limits in square millimetres tighten those in pixels."""
    if px_per_mm > 0:
        min_px = max(min_px, min_mm2 * px_per_mm**2) if min_mm2 > 0 else min_px
        max_px = min(max_px, max_mm2 * px_per_mm**2) if max_mm2 > 0 else max_px
    return boxes.withColumn("area", geometry.area(geometry.box())).withColumn("kept", F.col("area").between(min_px, max_px))


def overlapping(a: DataFrame, b: DataFrame, least: float = 0.1, cell: float = 128.0) -> DataFrame:
    """Pairs of boxes of one frame whose overlap exceeds ``least``. Boxes meet in the cells of a grid that they lie in, each pair in the one cell that holds
    the corner of its overlap; the sides are compared before the ratio."""
    ba, bb = geometry.box("a_"), geometry.box("b_")

    def placed(rows: DataFrame, side: str, box) -> DataFrame:
        named = rows.select(F.col("frame_id").alias(f"{side}_frame"), *[F.col(c).alias(f"{side}_{c}") for c in rows.columns if c != "frame_id"])
        cells = lambda low, high: F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell)))
        return named.withColumn(f"{side}_cx", cells(box[0], box[2])).withColumn(f"{side}_cy", cells(box[1], box[3]))

    left, right = placed(a, "a", ba), placed(b, "b", bb)
    meet = (F.col("a_frame") == F.col("b_frame")) & (F.col("a_cx") == F.col("b_cx")) & (F.col("a_cy") == F.col("b_cy"))
    once = (F.floor(F.greatest(ba[0], bb[0]) / cell) == F.col("a_cx")) & (F.floor(F.greatest(ba[1], bb[1]) / cell) == F.col("a_cy"))
    touch = (ba[0] < bb[2]) & (bb[0] < ba[2]) & (ba[1] < bb[3]) & (bb[1] < ba[3])
    pairs = left.join(right, meet).filter(touch & once).withColumn("iou", geometry.iou(ba, bb)).withColumnRenamed("a_frame", "frame_id")
    return pairs.filter(F.col("iou") > least).drop("b_frame", "a_cx", "a_cy", "b_cx", "b_cy")


def fuse_depth(depth: DataFrame, flat: DataFrame, mode: str = "or", ids: tuple[str, ...] = ("frame_id", "det_id")) -> tuple[DataFrame, DataFrame]:
    """(defects, verdict per frame) from depth regions and 2D detections (frame_id, det_id, x1 .. y2, score, label). ``ids`` name a detection: its number within the frame,
    or ``det_id`` alone where that holds over all frames."""
    pairs = overlapping(depth, flat)
    confirmed = pairs.select("frame_id", F.col("a_det_id").alias("det_id")).select(*ids).distinct().withColumn("ok", F.lit(True))
    matched = pairs.select("frame_id", F.col("b_det_id").alias("det_id")).select(*ids).distinct()
    d = depth.join(confirmed, list(ids), "left")
    solid = d.select("frame_id", "det_id", F.when(F.col("ok"), "3D+2D").otherwise("3D").alias("source"), F.when(F.col("ok"), 0.95).otherwise(0.7).alias("confidence"))
    rest = flat.join(matched, list(ids), "left_anti").select("frame_id", "det_id", F.lit("2D").alias("source"), F.col("score").alias("confidence"))
    seen = depth.select("frame_id", F.lit(1).alias("d"), F.lit(0).alias("f")).unionByName(flat.select("frame_id", F.lit(0).alias("d"), F.lit(1).alias("f")))
    seen = seen.groupBy("frame_id").agg(F.max("d").alias("d"), F.max("f").alias("f"))
    test = {"or": F.greatest("d", "f"), "and": F.least("d", "f"), "depth_only": F.col("d")}[mode]
    return solid.unionByName(rest), seen.select("frame_id", F.when(test == 1, "NG").otherwise("OK").alias("verdict"))


def select_rois(candidates: DataFrame, key: str, max_rois: int = 3, merge: float = 0.6) -> DataFrame:
    """Greedy choice of regions per image, best score first, dropping those that a chosen one covers by ``merge`` or more.
    Candidates: key, roi_id, x, y, w, h, score. The choice folds over an image's sorted candidates, which are few."""
    fields = ["roi_id", "x", "y", "w", "h", "score"]
    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema.fields}
    item = "struct<" + ",".join(f"{c}:{kinds[c]}" for c in fields) + ">"

    def covered(a, b):
        wide = F.greatest(F.lit(0.0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
        high = F.greatest(F.lit(0.0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
        return wide * high / F.greatest(F.lit(1.0), a["w"] * a["h"])

    step = lambda kept, r: F.when((F.size(kept) >= max_rois) | F.exists(kept, lambda k: covered(r, k) >= merge), kept).otherwise(F.concat(kept, F.array(r)))
    usable = candidates.filter((F.col("w") >= 4) & (F.col("h") >= 4))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("roi_id").alias("i"), F.struct(*fields).alias("r"))))
    rows = usable.groupBy(key).agg(F.transform(ranked, lambda v: v["r"]).alias("all"))
    rows = rows.select(key, F.posexplode(F.aggregate("all", F.array().cast(f"array<{item}>"), step)).alias("rank", "r"))
    return rows.select(key, "r.*", (F.col("rank") + 1).alias("rank"))


def top_mean(rows: DataFrame, key: str, value: str, k: Column) -> DataFrame:
    """Mean of the k largest values per key, k being a column over n: the k-th largest value is a rank, what lies above it is summed where it lies."""
    cut = kth_smallest(rows, [key], value, F.col("n") - k + 1).select(key, k.cast("long").alias("__k"), F.col(value).alias("__cut"))
    above = F.col(value) > F.col("__cut")
    sums = rows.join(cut, key).groupBy(key).agg(F.coalesce(F.sum(F.when(above, F.col(value))), F.lit(0.0)).alias("__s"), F.count_if(above).alias("__c"), F.max("__k").alias("__k"), F.max("__cut").alias("__cut"))
    return sums.select(key, ((F.col("__s") + (F.col("__k") - F.col("__c")) * F.col("__cut")) / F.col("__k")).alias("top_mean"))


def quantile(rows: DataFrame, keys: list[str], value: str, q: float, name: str) -> DataFrame:
    """(keys, name): the q-quantile per key, interpolated between the two ranks around it; no group is sorted in one task."""
    at = F.lit(q) * (F.col("n") - 1)
    found = _ranked(rows, keys, value, [F.floor(at) + 1, F.ceil(at) + 1], 64)
    held = lambda k: F.max(F.when((F.col(k) > F.col("__seen") - F.col("__m")) & (F.col(k) <= F.col("__seen")), F.col(value)))
    ends = found.groupBy(*keys, "n").agg(held("__rank0").alias("__low"), held("__rank1").alias("__high"))
    return ends.select(*keys, (F.col("__low") + (at - F.floor(at)) * (F.col("__high") - F.col("__low"))).alias(name))


def min_max(rows: DataFrame, value: str, keys: list[str], name: str) -> DataFrame:
    """Value scaled to 0..1 per key; a flat group gives 0."""
    edge = rows.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    joined = rows.join(edge, keys) if keys else rows.crossJoin(edge)  # edge: one row
    span = F.col("__hi") - F.col("__lo")
    return joined.withColumn(name, F.when(span > 1e-12, (F.col(value) - F.col("__lo")) / F.when(span > 1e-12, span)).otherwise(0.0)).drop("__lo", "__hi")


def capture(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Defects caught by both, by only one, or missed; flags a.hit and b.hit joined by key."""
    j = a.select(key, F.col("hit").alias("ha")).join(b.select(key, F.col("hit").alias("hb")), key)
    return j.agg(F.count_if(F.col("ha") & F.col("hb")).alias("both"), F.count_if(F.col("ha") & ~F.col("hb")).alias("only_a"), F.count_if(~F.col("ha") & F.col("hb")).alias("only_b"), F.count_if(~F.col("ha") & ~F.col("hb")).alias("missed"))


def modal_shape(rows: DataFrame, shape: list[str], order: str) -> DataFrame:
    """Rows of the most frequent shape; of tied shapes the one seen first."""
    groups = rows.groupBy(*shape).agg(F.count(F.lit(1)).alias("c"), F.min(order).alias("first"))
    best = groups.orderBy(F.col("c").desc(), "first").limit(1).select(*shape)
    return rows.join(F.broadcast(best), shape)  # one row


def nearest_share(rows: DataFrame, share: float, least: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Keys of the ``share`` of the rows (``least`` of them at least) nearest the mean of all vectors; ties go to the least key. The cut is a
    rank, found without a sort of all rows."""
    mean = rows.select(F.posexplode(vector).alias("i", "v")).groupBy("i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    mean = saved(mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("mean")), "mean")  # sums of doubles differ by their order: one mean for all steps
    d = rows.crossJoin(F.broadcast(mean)).select(key, scores.squared_distance(vector, "mean").alias("d2"), F.lit(0).alias("all"))  # one row
    k = F.greatest(F.lit(least), F.floor(F.col("n") * share))
    cut = kth_smallest(d, ["all"], "d2", F.least(k, F.col("n"))).select(F.col("d2").alias("cut"), k.alias("k"))
    near = d.crossJoin(F.broadcast(cut))  # one row
    # Of the rows tied at the cut those of least key stay: again a rank, over the tied keys.
    before = near.filter("d2 < cut").agg(F.count(F.lit(1)).alias("before"))
    tied = near.filter("d2 = cut").crossJoin(F.broadcast(before)).select(key, "all", (F.col("k") - F.col("before")).alias("room"))  # one row
    last = kth_smallest(tied, ["all", "room"], key, F.least(F.col("room"), F.col("n"))).select("all", F.col(key).alias("last"))
    return near.filter("d2 < cut").select(key).unionByName(tied.join(last, "all").filter(F.col(key) <= F.col("last")).select(key))


def robust_by_component(rows: DataFrame, score: str = "nll") -> DataFrame:
    """Scores centred and scaled by the median and 1.4826 MAD of their component; components of under five use the overall median, unscaled."""
    counts = rows.groupBy("component").agg(F.count(F.lit(1)).alias("c"))
    med = counts.join(quantile(rows, ["component"], score, 0.5, "med"), "component")
    spread = rows.join(med, "component").select("component", F.abs(F.col(score) - F.col("med")).alias("off"))
    mad = quantile(spread, ["component"], "off", 0.5, "mad").withColumn("mad", 1.4826 * F.col("mad"))
    overall = quantile(rows.select(score, F.lit(0).alias("all")), ["all"], score, 0.5, "all_med").select("all_med")
    j = rows.join(med.join(mad, "component"), "component").crossJoin(F.broadcast(overall))  # one row
    few = F.col("c") < 5
    return j.withColumn("normalised", (F.col(score) - F.when(few, F.col("all_med")).otherwise(F.col("med"))) / F.when(few | (F.col("mad") < 1e-9), 1.0).otherwise(F.col("mad"))).drop("c", "med", "mad", "all_med")


def fusion_acceptance(rows: DataFrame, drop: float = 0.3) -> DataFrame:
    """The acceptance figures of a fusion against the plain union, one row. rows: defect, any_ng (some source says NG), verdict. Recall counts NG and REVIEW; false alarms
    count NG alone. Accepted where recall is no lower than the union's, false alarms are at least ``drop`` fewer and no defect that the union catches passes as OK."""
    bad, good = F.col("defect") == 1, F.col("defect") == 0
    share = lambda of, test: F.avg(F.when(of, test.cast("double")))
    ng, kept = F.col("verdict") == "NG", F.col("verdict").isin("NG", "REVIEW")
    r = rows.agg(
        share(good, F.col("any_ng")).alias("base_fpr"),
        share(bad, F.col("any_ng")).alias("base_recall"),
        share(good, ng).alias("fpr_ng"),
        share(good, F.col("verdict") == "REVIEW").alias("fpr_review"),
        share(bad, ng).alias("recall_ng"),
        share(bad, kept).alias("recall_effective"),
        F.count_if(bad & F.col("any_ng") & (F.col("verdict") == "OK")).alias("leaked"),
    )
    r = r.withColumn("fpr_drop", F.when(F.col("base_fpr") > 0, (F.col("base_fpr") - F.col("fpr_ng")) / F.col("base_fpr")).otherwise(0.0))
    passed = (F.col("recall_effective") >= F.col("base_recall") - 1e-9) & (F.col("fpr_drop") >= drop) & (F.col("leaked") == 0)
    return r.withColumn("passed", F.coalesce(passed, F.lit(False)))


def gate(name: str, value: Column, least: Column) -> Column:
    """An acceptance gate as a struct: a missing value fails."""
    return F.struct(F.lit(name).alias("gate"), value.alias("value"), F.coalesce(value >= least, F.lit(False)).alias("passed"))
