"""Connected regions of pixel maps, heat-map candidates for closer inspection, and depth regions over a fitted plane.

A map is a table of pixels (map_id, x, y, value). Set pixels become runs of neighbours in a pixel row; closing a mask is done on runs (growing
them, and growing what lies between them), touching runs of adjacent rows are edges, and labels spread over the edges until each component bears its least
run. So the rows that move are runs, not pixels, a row of a map is the largest group in one task, and the rounds of spreading grow with the logarithm of a region's
length. Rounds are written to the shared folder.

Pixels without a finite value are not set. Repeated pixels count with their greatest value. Maps without set pixels have no regions; an empty table gives an empty result.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import geometry
from millrace.storage import drop_saved, saved

from . import inspection

#: The half widths, by distance in rows, of a round 5 x 5 mask; and the names of the two kinds of depth regions.
ROUND_5 = {-2: 0, -1: 2, 0: 2, 1: 2, 2: 0}
RAISED, SUNKEN = "凸起", "凹坑"


def runs_of(pixels: DataFrame) -> DataFrame:
    """(map_id, y, x1, x2) of set pixels (map_id, x, y): neighbours in a pixel row."""
    row = Window.partitionBy("map_id", "y").orderBy("x")
    numbered = pixels.select("map_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).distinct().withColumn("g", F.col("x") - F.row_number().over(row))
    return numbered.groupBy("map_id", "y", "g").agg(F.min("x").alias("x1"), F.max("x").alias("x2")).drop("g")


def _merged(runs: DataFrame) -> DataFrame:
    """Overlapping and touching runs of a row as one."""
    row = Window.partitionBy("map_id", "y").orderBy("x1", "x2")
    reach = F.max("x2").over(row.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("x1") > reach + 1), 1).otherwise(0)
    marked = runs.withColumn("new", new).withColumn("g", F.sum("new").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("map_id", "y", "g").agg(F.min("x1").alias("x1"), F.max("x2").alias("x2")).drop("g")


def _grown(runs: DataFrame, sizes: DataFrame, mask: dict[int, int]) -> DataFrame:
    """Every pixel that the mask, put on some set pixel, covers; inside the map. sizes: map_id, w, h."""
    steps = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(r).alias("r")) for dy, r in mask.items()])).alias("s")
    moved = runs.join(sizes, "map_id").select("map_id", "w", "h", "y", "x1", "x2", steps)
    moved = moved.select("map_id", (F.col("y") + F.col("s.dy")).alias("y"), F.greatest(F.col("x1") - F.col("s.r"), F.lit(0)).alias("x1"), F.least(F.col("x2") + F.col("s.r"), F.col("w") - 1).alias("x2"), "h")
    return _merged(moved.filter("y >= 0 and y < h").drop("h"))


def _between(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """The pixels of the maps that lie in no run, as runs."""
    rows = sizes.select("map_id", "w", F.explode(F.sequence(F.lit(0).cast("long"), F.col("h") - 1)).alias("y"))
    ends = rows.select("map_id", "y", F.lit(-1).cast("long").alias("x1"), F.lit(-1).cast("long").alias("x2")).unionByName(rows.select("map_id", "y", F.col("w").alias("x1"), F.col("w").alias("x2")))
    following = F.lead("x1").over(Window.partitionBy("map_id", "y").orderBy("x1"))
    gaps = runs.unionByName(ends).select("map_id", "y", (F.col("x2") + 1).alias("x1"), (following - 1).alias("x2"))
    return gaps.filter("x2 >= x1")


def closed(runs: DataFrame, sizes: DataFrame, mask: dict[int, int] = ROUND_5) -> DataFrame:
    """The mask grown and then shrunk again: holes and gaps narrower than ``mask`` close. What lies outside a map neither sets nor clears pixels. The
    mask is symmetric."""
    sizes = sizes.select("map_id", F.col("w").cast("long").alias("w"), F.col("h").cast("long").alias("h"))
    return _between(_grown(_between(_grown(runs, sizes, mask), sizes), sizes, mask), sizes)


def labelled(runs: DataFrame) -> DataFrame:
    """``runs`` with label (y, x1 of a run of the component, the least one): runs that touch, diagonally too, are one component."""
    named = saved(runs.select("map_id", "y", "x1", "x2", F.struct("y", "x1").alias("run")), "runs")
    below = named.select("map_id", (F.col("y") - 1).alias("y"), F.col("x1").alias("b1"), F.col("x2").alias("b2"), F.col("run").alias("b"))
    touch = named.join(below, ["map_id", "y"]).filter((F.col("b1") <= F.col("x2") + 1) & (F.col("b2") >= F.col("x1") - 1)).select("map_id", F.col("run").alias("a"), "b")
    edges = saved(touch, "edges")
    labels = saved(named.select("map_id", "run", F.col("run").alias("label")), "labels")
    both = edges.unionByName(edges.select("map_id", F.col("b").alias("a"), F.col("a").alias("b")))
    while True:
        # Each run, and the run whose name it bears, take the least label around them; then each takes the label of its label's run.
        of_b = labels.select("map_id", F.col("run").alias("b"), F.col("label").alias("seen"))
        least = both.join(of_b, ["map_id", "b"]).groupBy("map_id", F.col("a").alias("run")).agg(F.min("seen").alias("seen"))
        near = labels.join(least, ["map_id", "run"], "left").select("map_id", "run", "label", F.least("label", F.coalesce("seen", "label")).alias("best"))
        hooked = near.select("map_id", F.col("label").alias("run"), "best").unionByName(near.select("map_id", "run", "best")).groupBy("map_id", "run").agg(F.min("best").alias("best"))
        jump = hooked.select("map_id", F.col("run").alias("best"), F.col("best").alias("further"))
        new = saved(labels.join(hooked, ["map_id", "run"]).join(jump, ["map_id", "best"]).select("map_id", "run", F.col("further").alias("label"), (F.col("further") != F.col("label")).alias("moved")), "labels")
        drop_saved(labels)
        settled = new.filter("moved").isEmpty()
        labels = new.drop("moved")
        labels._millrace_path = new._millrace_path
        if settled:
            break
    drop_saved(edges)
    out = named.join(labels, ["map_id", "run"]).select("map_id", "y", "x1", "x2", "label")
    return out


def boxes_of(runs: DataFrame) -> DataFrame:
    """One row per component (map_id, label): x, y, w, h and area."""
    wide = F.sum(F.col("x2") - F.col("x1") + 1)
    rows = runs.groupBy("map_id", "label").agg(F.min("x1").alias("x"), F.min("y").alias("y"), (F.max("x2") - F.min("x1") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"), wide.alias("area"))
    return rows


def _in_runs(pixels: DataFrame, runs: DataFrame, *keep: str) -> DataFrame:
    """Pixels (map_id, x, y, ...) that lie in a run, with the run's columns ``keep``. Both meet in their pixel row."""
    r = runs.select(F.col("map_id").alias("r_map"), F.col("y").alias("r_y"), "x1", "x2", *keep)
    here = (F.col("map_id") == F.col("r_map")) & (F.col("y") == F.col("r_y")) & F.col("x").between(F.col("x1"), F.col("x2"))
    return pixels.join(r, here).drop("r_map", "r_y", "x1", "x2")


def heat_rois(pixels: DataFrame, rel_thresh: float = 0.45, min_area: float = 0.0005) -> DataFrame:
    """Candidates (map_id, roi_id, x, y, w, h, score) of heat maps (map_id, x, y, value): components of the pixels at ``rel_thresh`` or more between a map's
    least and greatest value, closed, of at least ``min_area`` of the map. The score is the mean of the scaled values of all set pixels in a
    candidate's box, those of other components too. Flat maps have none."""
    pixels = pixels.filter(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("map_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).agg(F.max("value").alias("value"))
    per = pixels.groupBy("map_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), (F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h")).filter("hi - lo >= 1e-9")
    scaled = pixels.join(per, "map_id").select("map_id", "x", "y", ((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("norm"))
    mask = labelled(closed(runs_of(scaled.filter(F.col("norm") >= rel_thresh)), per))
    large = boxes_of(mask).join(per.select("map_id", F.col("w").alias("mw"), F.col("h").alias("mh")), "map_id").filter(F.col("area") >= min_area * F.col("mw") * F.col("mh"))
    # A candidate's box, row by row, meets the set pixels of that row.
    box_rows = large.select("map_id", "label", F.explode(F.sequence("y", F.col("y") + F.col("h") - 1)).alias("y"), F.col("x").alias("x1"), (F.col("x") + F.col("w") - 1).alias("x2"))
    set_pixels = _in_runs(scaled, mask)
    scores = _in_runs(set_pixels, box_rows, "label").groupBy("map_id", "label").agg(F.avg("norm").alias("score"))
    out = large.join(scores, ["map_id", "label"])
    return out.select("map_id", (F.col("label.y") * F.col("mw") + F.col("label.x1")).alias("roi_id"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")], "score", "mw", "mh")


def select_map_rois(pixels: DataFrame, detections: DataFrame, max_rois: int = 3, min_area: float = 0.0005, pad: float = 0.25, rel_thresh: float = 0.45, merge: float = 0.6) -> DataFrame:
    """The regions to look at closely, per map: heat-map candidates and detected boxes (map_id, roi_id, x1, y1, x2, y2, score), padded, best score first, without those
    that a better one covers. Columns map_id, roi_id, x, y, w, h, score, rank."""
    heat = heat_rois(pixels, rel_thresh, min_area)
    size = pixels.groupBy("map_id").agg((F.max("x") + 1).alias("mw"), (F.max("y") + 1).alias("mh")).filter("mw >= 8 and mh >= 8")
    whole = lambda c: F.bround(c).cast("double")
    found = detections.filter("x2 > x1 and y2 > y1").select("map_id", (F.lit(1 << 40) + F.col("roi_id")).alias("roi_id"), whole("x1").alias("x"), whole("y1").alias("y"), whole(F.col("x2") - F.col("x1")).alias("w"), whole(F.col("y2") - F.col("y1")).alias("h"), F.coalesce("score", F.lit(1.0)).alias("score"))
    both = heat.drop("mw", "mh").unionByName(found).join(size, "map_id")
    return inspection.select_rois(both.withColumns(geometry.padded("x", "y", "w", "h", F.col("mw"), F.col("mh"), pad)), "map_id", max_rois, merge)


# --- depth


def _slopes(points: DataFrame) -> DataFrame:
    """Least-squares planes value = a x + b y + c per map from second moments; with pixels in one line the plane is level across it."""
    cov = lambda u, v: F.covar_pop(F.col(u).cast("double"), F.col(v).cast("double"))
    m = points.groupBy("map_id").agg(F.count(F.lit(1)).alias("n"), cov("x", "x").alias("xx"), cov("y", "y").alias("yy"), cov("x", "y").alias("xy"), cov("x", "value").alias("xz"), cov("y", "value").alias("yz"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("value").alias("mz"))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    full = det > 1e-9 * F.greatest(F.col("xx") * F.col("yy"), F.lit(1e-300))
    both = F.col("xx") + F.col("yy")  # in one line: the slope along it
    a = F.when(full, (F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")) / F.when(full, det)).when(both > 0, F.col("xz") / F.when(both > 0, both)).otherwise(0.0)
    b = F.when(full, (F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy")) / F.when(full, det)).when(both > 0, F.col("yz") / F.when(both > 0, both)).otherwise(0.0)
    return m.withColumns({"a": a, "b": b}).select("map_id", "n", "a", "b", (F.col("mz") - F.col("a") * F.col("mx") - F.col("b") * F.col("my")).alias("c"))


def _over(points: DataFrame, planes: DataFrame, name: str) -> DataFrame:
    level = F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c")
    return points.join(planes.select("map_id", "a", "b", "c"), "map_id").withColumn(name, F.col("value") - level).drop("a", "b", "c")


def deviations(pixels: DataFrame, method: str = "plane") -> DataFrame:
    """Depth pixels (map_id, x, y, value) with their deviation from the map's base: a plane (fitted by least squares, and again to the pixels within 2.5 times
    1.4826 median absolute deviations of the median residual), the ``median``, or the 30th ``percentile``. Pixels without a finite depth deviate by 0.

    Planes come from sums of products, medians from counted ranges of residuals; a map is in no single task."""
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    points = pixels.filter(finite)
    if method != "plane":
        base = inspection.quantile(points, ["map_id"], "value", {"median": 0.5, "percentile": 0.3}[method], "base")
        out = points.join(base, "map_id").withColumn("deviation", F.col("value") - F.col("base")).drop("base")
    else:
        first = _over(points, _slopes(points), "r")
        middle = inspection.quantile(first, ["map_id"], "r", 0.5, "mid")
        off = first.join(middle, "map_id").withColumn("off", F.abs(F.col("r") - F.col("mid")))
        spread = inspection.quantile(off, ["map_id"], "off", 0.5, "mad")
        inner = off.join(spread, "map_id").filter(F.col("off") < 2.5 * 1.4826 * (F.col("mad") + 1e-6))
        again = _slopes(inner.select("map_id", "x", "y", "value")).filter("n >= 3")
        kept = _slopes(points).join(again, "map_id", "left_anti")
        out = _over(points, again.unionByName(kept), "deviation")
    return out.unionByName(pixels.filter(~finite | F.col("value").isNull()).withColumn("deviation", F.lit(0.0)))


def depth_regions(points: DataFrame, threshold: float = 0.5, least: int = 30) -> DataFrame:
    """Components of the pixels that deviate by more than ``threshold``, of ``least`` pixels or more: map_id, det_id (0: the highest peak), x1, y1, x2, y2, area_px,
    peak_mm, abs_peak_mm, polarity, cx, cy. Of equal peaks the first in reading order counts; of equal regions the first."""
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    hot = points.filter(finite & (F.abs("deviation") > threshold)).groupBy("map_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).agg(F.max_by("deviation", F.abs("deviation")).alias("deviation"))
    inside = _in_runs(hot, labelled(runs_of(hot)), "label")
    per = inside.groupBy("map_id", "label").agg(
        *[f(c).alias(n) for f, c, n in ((F.min, "x", "x1"), (F.min, "y", "y1"), (F.max, "x", "x2"), (F.max, "y", "y2"))],
        F.count(F.lit(1)).alias("area_px"),
        F.max_by("deviation", F.struct(F.abs("deviation"), -F.col("y"), -F.col("x"))).alias("peak_mm"),
        F.avg("x").alias("cx"),
        F.avg("y").alias("cy"),
    )
    rank = F.row_number().over(Window.partitionBy("map_id").orderBy(F.abs("peak_mm").desc(), "label"))  # regions of a map, which are few
    rows = per.filter(F.col("area_px") >= least).withColumn("det_id", rank - 1)
    polarity = F.when(F.col("peak_mm") > 0, RAISED).otherwise(SUNKEN)
    return rows.select("map_id", "det_id", "x1", "y1", (F.col("x2") + 1).alias("x2"), (F.col("y2") + 1).alias("y2"), "area_px", "peak_mm", F.abs("peak_mm").alias("abs_peak_mm"), polarity.alias("polarity"), "cx", "cy")


def grid_of_vectors(vectors: DataFrame, side: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Maps (map_id, x, y, value) of ``side`` neighbouring vectors each: a vector is a pixel row."""
    k = F.col(key).cast("long")
    rows = vectors.filter(k.isNotNull()).select(F.expr(f"`{key}` div {side}").cast("long").alias("map_id"), F.pmod(k, F.lit(side)).alias("y"), F.posexplode(vector).alias("x", "value"))
    return rows.select("map_id", F.col("x").cast("long").alias("x"), "y", F.col("value").cast("double").alias("value"))


