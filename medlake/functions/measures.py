"""Numeric expressions: bands, boxes, image plans and clinical endpoints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def band(x: Column, edges: list[float]) -> Column:
    """Number of ``edges`` at or below x: 0 below the first."""
    out = F.when(x >= edges[-1], len(edges))
    for i in range(len(edges) - 1, 0, -1):
        out = out.when(x >= edges[i - 1], i)
    return out.when(x < edges[0], 0)


def band_ceiling(x: Column, step: float = 0.05, low: float = 0.7, high: float = 1.0) -> Column:
    """The upper edge of x's band, clipped."""
    return F.least(F.greatest(F.ceil(F.round(x / step, 9)) * step, F.lit(low)), F.lit(high))


def box_iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of boxes (x0, y0, x1, y1); null where both are empty."""
    side = lambda i: F.greatest(F.least(a[i + 2], b[i + 2]) - F.greatest(a[i], b[i]), F.lit(0.0))
    area = lambda q: (q[2] - q[0]) * (q[3] - q[1])
    both = side(0) * side(1)
    return both / F.nullif(area(a) + area(b) - both, F.lit(0.0))


def hu_to_byte(hu: Column, bound: float = 1000.0) -> Column:
    """Clipped intensities mapped to 0..255 and truncated."""
    clipped = F.greatest(F.least(hu, F.lit(bound)), F.lit(-bound))
    return F.floor((clipped / bound + 1) / 2 * 255).cast("int")


def byte_to_hu(b: Column, bound: float = 1000.0) -> Column:
    return (b / 255.0 * 2 - 1) * bound


def resize_plan(sizes: list[Column], target: list[int]) -> Column:
    """Struct of scale, half-even rounded sizes and the padding before each axis."""
    scale = F.least(*(F.lit(float(t)) / s for t, s in zip(target, sizes)))
    new = [F.bround(s * scale, 0).cast("int") for s in sizes]
    pad = [F.floor((F.lit(t) - n) / 2).cast("int") for t, n in zip(target, new)]
    return F.struct(scale.alias("scale"), *(n.alias(f"size{i}") for i, n in enumerate(new)), *(p.alias(f"pad{i}") for i, p in enumerate(pad)))


def survival_endpoint(dead: Column, days: Column, horizon: int = 730) -> Column:
    """1 for a death within the horizon, 0 for survival beyond it, null if censored before."""
    return F.when((dead == 1) & (days <= horizon), 1).when(days > horizon, 0)


def endpoint(value: Column, positive: list[str], negative: list[str]) -> Column:
    """1, 0 or null by value sets."""
    return F.when(value.isin(positive), 1).when(value.isin(negative), 0)
