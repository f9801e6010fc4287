"""Column functions over numbers: confidences, boxes, image quality, delays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions import fixed_values as V


def confidence_level(score: Column) -> Column:
    level = F.when(score.isNull(), F.lit(None).cast("string"))
    for cut, name in V.CONFIDENCE_LEVELS:
        level = level.when(score >= cut, name)
    return level.otherwise("Low")


def to_percent(value: Column) -> Column:
    """0 to 1 becomes 0 to 100; exactly 1 counts as 100 percent."""
    return F.when((value >= 0) & (value <= 1), value * 100).otherwise(value)


def to_unit(value: Column) -> Column:
    return F.round(F.when(value > 1, value / 100).otherwise(value), 4)


def mean_of(*values: Column) -> Column:
    """Mean of the values that are present, or null."""
    present = F.array_compact(F.array(*values))
    return F.when(F.size(present) > 0, F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.size(present))


def detection_result(confidence: Column, threshold: float = 0.25) -> Column:
    return F.when(F.coalesce(confidence, F.lit(-1.0)) >= threshold * 100, "OK").otherwise("NG")


def quality_scores(laplacian: Column, gray: Column, width: Column, height: Column, colored: Column, visible: Column, min_colored: float = 0.01) -> dict[str, Column]:
    """Scores from image statistics, 0 to 100, and whether the page is colored."""
    blur = F.least(F.lit(100.0), F.greatest(F.lit(0.0), laplacian * 2))
    bright = 100 - F.abs(128 - gray) / 1.28
    resolution = F.least(F.lit(100.0), width * height / (1920 * 1080) * 100)
    ratio = colored / F.greatest(visible, F.lit(1))
    return {
        "blur_score": F.round(blur, 2),
        "brightness_score": F.round(bright, 2),
        "resolution_score": F.round(resolution, 2),
        "page_readability_score": F.round(F.least(F.lit(100.0), blur * 0.5 + bright * 0.3 + resolution * 0.2), 2),
        "colored_pixel_ratio": F.round(ratio, 4),
        "is_colored": ratio >= min_colored,
    }


def box_area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.get(b, 2) - F.get(b, 0)) * F.greatest(F.lit(0.0), F.get(b, 3) - F.get(b, 1))


def iou(a: Column, b: Column) -> Column:
    wide = F.greatest(F.lit(0.0), F.least(F.get(a, 2), F.get(b, 2)) - F.greatest(F.get(a, 0), F.get(b, 0)))
    high = F.greatest(F.lit(0.0), F.least(F.get(a, 3), F.get(b, 3)) - F.greatest(F.get(a, 1), F.get(b, 1)))
    union = box_area(a) + box_area(b) - wide * high
    return F.when(union != 0, wide * high / union).otherwise(0.0)


def _sides(b: Column) -> list[Column]:
    return [F.get(b, i) for i in range(4)]


def spatially_related(label: Column, value: Column) -> Column:
    """value stands on label's row to its right, or below it."""
    (lx1, ly1, lx2, ly2), (vx1, vy1, vx2, vy2) = _sides(label), _sides(value)
    row = F.abs(((ly1 + ly2) - (vy1 + vy2)) / 2) <= F.greatest(F.lit(20.0), (ly2 - ly1) * 1.5)
    below = (vy1 >= ly2) & (F.abs(((lx1 + lx2) - (vx1 + vx2)) / 2) <= F.greatest(F.lit(80.0), (lx2 - lx1) * 1.5))
    return F.coalesce((row & (vx1 >= lx1)) | below, F.lit(False))


def context_related(label: Column, value: Column) -> Column:
    """Same row with a small gap; a missing box counts as related."""
    (lx1, ly1, lx2, ly2), (vx1, vy1, vx2, vy2) = _sides(label), _sides(value)
    row = F.abs(((ly1 + ly2) - (vy1 + vy2)) / 2) <= F.greatest(F.lit(20.0), F.greatest(ly2 - ly1, vy2 - vy1) * 1.5)
    gap = F.greatest(vx1 - lx2, lx1 - vx2, F.lit(0.0))
    return F.coalesce(row & (gap <= F.greatest(F.lit(120.0), 2 * F.greatest(lx2 - lx1, vx2 - vx1))), F.lit(True))


def y_aligned(a: Column, b: Column, tolerance: float = 60) -> Column:
    return F.coalesce((F.abs(F.get(a, 1) - F.get(b, 1)) <= tolerance) | (F.abs(F.get(a, 3) - F.get(b, 3)) <= tolerance), F.lit(True))


def backoff_seconds(attempt: Column, cap: int | None = None) -> Column:
    delay = F.lit(30) * F.pow(F.lit(2), attempt - 1)
    return (F.least(F.lit(cap).cast("double"), delay) if cap else delay).cast("long")


def quad_box(points: Column) -> Column:
    """The box around the corner points of a quadrilateral, array<array<double>>; null where a point lacks a coordinate."""
    side = lambda i: F.transform(points, lambda p: F.get(p, F.lit(i)))
    whole = (F.size(points) > 0) & F.forall(points, lambda p: F.coalesce(F.get(p, F.lit(0)).isNotNull() & F.get(p, F.lit(1)).isNotNull(), F.lit(False)))
    return F.when(whole, F.array(F.array_min(side(0)), F.array_min(side(1)), F.array_max(side(0)), F.array_max(side(1))))


def field_blend(text: Column, pattern: Column, layout: Column, form: Column) -> Column:
    """Confidence of a field from its text's, its pattern's, its layout's and its format's; null ones count as 0."""
    parts = (text, pattern, layout, form)
    return sum((F.coalesce(c.cast("double"), F.lit(0.0)) * w for c, w in zip(parts, V.FIELD_BLEND_WEIGHTS)), F.lit(0.0))
