"""Probability vectors (array<double>) as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-12


def total(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, x: a + x)


def softmax(x: Column) -> Column:
    shifted = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(shifted, lambda v: v / total(shifted))


def temperature_scale(p: Column, t: Column | float) -> Column:
    """log of the clipped vector over T, through softmax; also at T = 1."""
    t = F.lit(float(t)) if isinstance(t, (int, float)) else t
    return softmax(F.transform(p, lambda v: F.log(F.greatest(v, F.lit(FLOOR))) / t))


def invalid_vector(p: Column, size: int | None = None) -> Column:
    """True for a vector with a null, non-finite or negative entry, a sum of zero, or the wrong size."""
    bad = F.exists(p, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(math.inf)) | (v < 0)) | (total(p) <= 0)
    return F.coalesce(bad | (F.size(p) != size) if size is not None else bad, F.lit(True))


def normalize_then_scale(p: Column, t: Column | float = 1.0, pad: int = 0) -> Column:
    """Divide by the sum first, then temperature; null for invalid vectors; `pad` zero slots follow."""
    out = temperature_scale(F.transform(p, lambda v: v / total(p)), t)
    return F.when(~invalid_vector(p), F.concat(out, F.array(*[F.lit(0.0)] * pad)) if pad else out)


def argmax(p: Column) -> Column:
    """Zero-based index of the largest entry, the lowest of equals."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def top_k(p: Column, labels: Sequence[str], k: int) -> Column:
    """array<struct<label, p>>, largest first, label order breaking ties."""
    names = F.array(*[F.lit(x) for x in labels])
    pairs = F.transform(p, lambda v, i: F.struct((-v).alias("neg"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda s: F.struct(F.get(names, s["i"]).alias("label"), (-s["neg"]).alias("p")))


def margin(p: Column) -> Column:
    ordered = F.sort_array(p, asc=False)
    return F.get(ordered, F.lit(0)) - F.get(ordered, F.lit(1))


def entropy(p: Column) -> Column:
    return -F.aggregate(p, F.lit(0.0), lambda a, v: a + F.when(v > 0, v * F.log(v)).otherwise(0.0))


def permute(p: Column, order: Sequence[int]) -> Column:
    """Entry i of the result is entry order[i] of p."""
    return F.array(*[F.get(p, F.lit(i)) for i in order])


def index_mapping(names: Sequence[str], labels: Sequence[str]) -> list[int]:
    """Where each label stands among a model's names; exactly one place each, and no other names."""
    if len(names) != len(labels) or set(names) != set(labels):
        raise ValueError(f"model names {list(names)} are not the labels {list(labels)}")
    return [list(names).index(x) for x in labels]


def exactly_one(names: Sequence[str], target: str) -> int:
    found = [i for i, x in enumerate(names) if x == target]
    if len(found) != 1:
        raise ValueError(f"{target!r} stands {len(found)} times among the names")
    return found[0]


def weighted_mean(vectors: Sequence[Column], weights: Sequence[float]) -> Column:
    """Sum of weighted vectors over the weights' sum."""
    scale = float(sum(weights))
    out = F.transform(vectors[0], lambda v: v * F.lit(weights[0] / scale))
    for v, w in zip(vectors[1:], weights[1:], strict=True):
        out = F.zip_with(out, v, _add_scaled(w / scale))
    return out


def _add_scaled(w: float):
    return lambda a, b: a + b * F.lit(w)


def fuse_views(original: Column, center: Column, crop: Column, weighted: bool = True) -> Column:
    """Views of one image: with a crop .6/.2/.2 (crop, original, center) or equal shares, else .7/.3 or halves."""
    with_crop = weighted_mean([crop, original, center], [0.6, 0.2, 0.2] if weighted else [1, 1, 1])
    without = weighted_mean([original, center], [0.7, 0.3] if weighted else [1, 1])
    return F.when(crop.isNotNull(), with_crop).otherwise(without)


def target_only(p: Column, targets: int) -> Column:
    """The first `targets` slots renormalised, the reject slot zero; null where they sum to zero."""
    head = F.slice(p, 1, targets)
    return F.when(total(head) > 0, F.concat(F.transform(head, lambda v: v / total(head)), F.array(F.lit(0.0))))
