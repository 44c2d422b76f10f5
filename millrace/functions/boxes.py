"""Boxes (struct x1, y1, x2, y2, confidence, ...) and regions of interest as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<x1:double,y1:double,x2:double,y2:double,confidence:double>"


def area(b: Column) -> Column:
    return F.greatest(b["x2"] - b["x1"], F.lit(0.0)) * F.greatest(b["y2"] - b["y1"], F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is empty."""
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0))
    h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def valid_box(b: Column) -> Column:
    return F.coalesce((b["x2"] > b["x1"]) & (b["y2"] > b["y1"]) & b["confidence"].between(0.0, 1.0), F.lit(False))


def in_order(boxes: Column) -> Column:
    """Largest confidence first, then largest area, then as given."""
    keyed = F.transform(boxes, lambda b, i: F.struct((-b["confidence"]).alias("c"), (-area(b)).alias("a"), i.alias("i"), b.alias("b")))
    return F.transform(F.array_sort(keyed), lambda s: s["b"])


def non_maximum_suppression(boxes: Column, threshold: float, box_type: str = BOX) -> Column:
    """Greedy: a box stays if its overlap with every kept box is under the threshold."""
    empty = F.array().cast(f"array<{box_type}>")
    return F.aggregate(in_order(boxes), empty, lambda kept, b: F.when(F.forall(kept, lambda k: iou(k, b) < threshold), F.concat(kept, F.array(b))).otherwise(kept))


def best_overlaps(truth: Column, predicted: Column) -> Column:
    """For each true box its largest overlap with a predicted one, 0 without any."""
    return F.transform(truth, lambda t: F.coalesce(F.array_max(F.transform(predicted, lambda p: iou(t, p))), F.lit(0.0)))


def keep_boxes(boxes: Column, min_confidence: float = 0.0, min_area: float = 0.0, limit: int | None = None) -> Column:
    out = F.filter(boxes, lambda b: (b["confidence"] >= min_confidence) & (area(b) >= min_area))
    return F.slice(out, 1, limit) if limit else out


def padded_bounds(b: Column, width: Column, height: Column, ratio: float) -> Column:
    """Whole-pixel bounds padded by a share of the box's size and clamped to the frame."""
    px, py = (b["x2"] - b["x1"]) * ratio, (b["y2"] - b["y1"]) * ratio
    return F.struct(
        F.greatest(F.lit(0), F.floor(b["x1"] - px)).cast("int").alias("left"),
        F.greatest(F.lit(0), F.floor(b["y1"] - py)).cast("int").alias("top"),
        F.least(width, F.ceil(b["x2"] + px)).cast("int").alias("right"),
        F.least(height, F.ceil(b["y2"] + py)).cast("int").alias("bottom"),
    )


def center_bounds(width: Column, height: Column, scale: float) -> Column:
    """A centred region; sizes round half to even, as the data's producer does."""
    w, h = F.greatest(F.lit(1), F.rint(width * scale).cast("int")), F.greatest(F.lit(1), F.rint(height * scale).cast("int"))
    left, top = F.floor((width - w) / 2).cast("int"), F.floor((height - h) / 2).cast("int")
    return F.struct(left.alias("left"), top.alias("top"), (left + w).alias("right"), (top + h).alias("bottom"))


def route(present: Column, valid: Column, same_frame: Column, boxes: Column, stable: Column, short_side: Column, min_short_side: int) -> tuple[Column, Column]:
    """(mode, reason): the crop is used only if every condition holds; the first that fails is the reason."""
    checks = (
        (~present, "missing_observation"),
        (~valid, "invalid_observation"),
        (~same_frame, "mismatched_observation"),
        (F.size(boxes) == 0, "detector_miss"),
        (~stable, "unstable_detector_box"),
        (short_side < min_short_side, "rejected_detector_box_short_side_pixels"),
    )
    reason = None
    for bad, name in checks:
        bad = F.coalesce(bad, F.lit(True))
        reason = F.when(bad, name) if reason is None else reason.when(bad, name)
    reason = reason.otherwise("accepted_detector_box")
    return F.when(reason == "accepted_detector_box", "detector_crop").otherwise("centre_fallback"), reason


def from_center_form(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Pixel corners of a box given by centre and size as shares of the frame."""
    return F.struct(((cx - w / 2) * width).alias("x1"), ((cy - h / 2) * height).alias("y1"), ((cx + w / 2) * width).alias("x2"), ((cy + h / 2) * height).alias("y2"))


def center_form_line(label: Column, b: Column, width: Column, height: Column) -> Column:
    """The text line `class cx cy w h` with six decimals."""
    return F.format_string("%d %.6f %.6f %.6f %.6f", label, (b["x1"] + b["x2"]) / 2 / width, (b["y1"] + b["y2"]) / 2 / height, (b["x2"] - b["x1"]) / width, (b["y2"] - b["y1"]) / height)


def project_corners(b: Column, h: list[list[float]], width: Column, height: Column) -> Column:
    """Axis-aligned hull of a box's corners under a 3 x 3 homography, clamped to the frame."""
    def at(x: Column, y: Column) -> tuple[Column, Column]:
        w = F.lit(h[2][0]) * x + F.lit(h[2][1]) * y + F.lit(h[2][2])
        return (F.lit(h[0][0]) * x + F.lit(h[0][1]) * y + F.lit(h[0][2])) / w, (F.lit(h[1][0]) * x + F.lit(h[1][1]) * y + F.lit(h[1][2])) / w

    xs, ys = zip(*[at(b[x], b[y]) for x in ("x1", "x2") for y in ("y1", "y2")], strict=True)
    zero = F.lit(0.0)
    return F.struct(F.greatest(zero, F.least(*xs)).alias("x1"), F.greatest(zero, F.least(*ys)).alias("y1"), F.least(width, F.greatest(*xs)).alias("x2"), F.least(height, F.greatest(*ys)).alias("y2"))
