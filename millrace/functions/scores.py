"""Score functions as columns: normal distribution, confidences, vector distances, image state."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the rational approximation 7.1.26 of the error function (Abramowitz and Stegun).
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_cdf(z: Column) -> Column:
    """Phi(z), off by less than 1e-7."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = 1.0 / (1.0 + ERF_P * x)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    upper = 1.0 - 0.5 * poly * F.exp(-x * x)
    return F.when(z >= 0, upper).otherwise(1.0 - upper)


def squared_distance(a, b) -> Column:
    """Of two arrays of equal length."""
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x)


def dual_path_score(confidence: Column, lines: Column, most: Column, full: int = 1) -> Column:
    """Confidence (out of ``full``) and share of lines, weighed 7 to 3. Tied scores must be equal in their last bit too: the weight comes before the division, and that of
    the lines, which are whole numbers, is multiplied as a decimal."""
    return 0.7 * confidence / full + (F.lit(Decimal("0.3")) * lines).cast("double") / F.greatest(most, F.lit(1))


def image_quality(sharpness: Column, brightness: Column) -> Column:
    """Names of what is wrong with an image."""
    return F.array_compact(F.array(F.when(sharpness < 100, "blurred"), F.when(brightness < 20, "underexposed"), F.when(brightness > 240, "overexposed")))


def photometric_class(delta: Column, width: Column, height: Column) -> Column:
    """dark / bright / flat, with _line for shapes at least three times as long as wide."""
    polarity = F.when(delta <= -8, "dark").when(delta >= 8, "bright").otherwise("flat")
    aspect = F.greatest(width, height) / F.greatest(F.least(width, height), F.lit(1.0))
    return F.concat(polarity, F.when(aspect >= 3, F.lit("_line")).otherwise(F.lit("")))


def scene(phone: Column, megapixels: Column, sharpness: Column, white: Column, handwriting: Column) -> tuple[Column, Column]:
    """(scene, share): additive rule points; the largest share wins if it is 0.7 or more, else camera. Ties go to document, then camera."""
    point = lambda test, n: F.when(test, n).otherwise(0.0)
    camera = point(phone, 2.0) + F.when((megapixels > 8) & phone, 1.5).when(megapixels > 8, 0.5).otherwise(0.0) + point(sharpness < 100, 1.5)
    document = point(sharpness > 500, 1.5) + point(white > 0.7, 1.0)
    hand = F.when(handwriting > 0.5, 2.0 * handwriting).otherwise(0.0)
    top, total = F.greatest(document, camera, hand), document + camera + hand
    share = F.when(total > 0, top / F.when(total > 0, total)).otherwise(0.0)
    best = F.when(document == top, "document").when(camera == top, "camera").otherwise("handwriting")
    return F.when(share < 0.7, "camera").otherwise(best), share


#: The engine of each scene, and the one that stands in.
SCENE_ENGINES = {"document": "ppocr", "handwriting": "hunyuan", "camera": "rapidocr"}
FALLBACK_ENGINE = "rapidocr"


def scene_engine(scene: Column, ready: dict[str, Column]) -> Column:
    """The engine of a scene if it is ready (engines not named are), else the one that stands in."""
    out = F.lit(FALLBACK_ENGINE)
    for kind, engine in SCENE_ENGINES.items():
        out = F.when((scene == kind) & ready.get(engine, F.lit(True)), engine).otherwise(out)
    return out


def extraction_tier(confidence: Column, complete: Column, local: Column, enough: float = 0.6) -> Column:
    """Rules where they are sure and complete, else the local model if there is one, else the remote one."""
    return F.when((confidence >= enough) & complete, "regex").when(local, "local").otherwise("cloud")
