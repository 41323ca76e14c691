"""Duration fitting, loudness, cost and geometry expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def drift(actual_ms: Column, target_ms: Column) -> Column:
    return F.abs(actual_ms - target_ms) / target_ms


def fitting_action(actual_ms: Column, target_ms: Column, attempts: Column) -> Column:
    d = drift(actual_ms, target_ms)
    return (
        F.when((actual_ms <= 0) | (target_ms <= 0), "INVALID")
        .when(d <= 0.08, "STRETCH")
        .when(attempts >= 3, "NEEDS_REVIEW")
        .when(d <= 0.20, "SPEED")
        .otherwise("REWRITE")
    )


def fit_decision(actual_ms: Column, target_ms: Column) -> Column:
    d = drift(actual_ms, target_ms)
    return (
        F.when((actual_ms <= 0) | (target_ms <= 0), "INVALID")
        .when(d > 0.20, "REWRITE").when(d <= 0.08, "STRETCH").otherwise("SPEED")
    )


def speed_factor(actual_ms: Column, target_ms: Column, *, elastic: bool = False) -> Column:
    """Playback factor of an accepted fit; ``elastic`` clamps it to 0.90-1.45."""
    factor = actual_ms / target_ms
    if elastic:
        factor = F.least(F.greatest(factor, F.lit(0.90)), F.lit(1.45))
    return F.when(drift(actual_ms, target_ms) <= 0.20, factor)


def slot_factor(actual_ms: Column, slot_ms: Column) -> Column:
    return F.greatest(F.lit(1.0), actual_ms / slot_ms)


def tempo_chain(factor: Column) -> Column:
    """Factors in [0.5, 2] whose product is ``factor``: whole doublings or halvings, then the rest."""
    doublings = F.greatest(F.lit(0), F.ceil(F.log2(factor)) - 1).cast("int")
    halvings = F.greatest(F.lit(0), F.ceil(-F.log2(factor)) - 1).cast("int")
    rest = factor / F.pow(F.lit(2.0), doublings) * F.pow(F.lit(2.0), halvings)
    return F.concat(
        F.array_repeat(F.lit(2.0), doublings), F.array_repeat(F.lit(0.5), halvings), F.array(rest)
    )


def dbfs(peak: Column) -> Column:
    return F.when(peak > 0, 20 * F.log10(peak / 32768))


def rms_threshold(dbfs_level: float) -> float:
    return 32768 * 10 ** (dbfs_level / 20)


def rounded(x: Column, digits: int) -> Column:
    """Half-even rounding of the exact binary value.

    ``bround`` rounds the shortest decimal form, which turns near-ties into ties. Here the error of
    ``x * 10**digits`` is computed exactly (split product), and it decides where the product is a tie.
    """
    scale = 10.0**digits

    def halves(v):
        big = v * 134217729.0
        high = big - (big - v)
        return high, v - high

    product = x * scale
    (xh, xl), (sh, sl) = halves(x), halves(scale)
    error = ((xh * sh - product) + xh * sl + xl * sh) + xl * sl
    near = F.rint(product)
    gap = product - near
    fixed = F.when((gap == 0.5) & (error > 0), near + 1).when((gap == -0.5) & (error < 0), near - 1).otherwise(near)
    return fixed / scale


def projected_cost(elapsed_ms: Column, remaining_ms: Column, api: Column, rate: int = 6000) -> Column:
    return (elapsed_ms + remaining_ms).cast("long") * F.lit(rate) / F.lit(3_600_000) + api


def budget_policy(total: Column, target: int = 5000, warning: int = 6500, hard: int = 8000) -> Column:
    return (
        F.when(total > hard, "REQUIRE_CONTINUE").when(total > warning, "NO_AUTO_PROPAINTER")
        .when(total > target, "REDUCE_FALLBACK").otherwise("NORMAL")
    )


def roi_in_frame(x: Column, y: Column, w: Column, h: Column, *, slack: float = 0.0) -> Column:
    """Normalized region inside the frame; the stored contract allows 1e-6 of slack, a crop none."""
    ok = (x >= 0) & (y >= 0) & (w > 0) & (h > 0) & (x + w <= 1 + slack) & (y + h <= 1 + slack)
    if slack:
        ok = ok & (x < 1) & (y < 1) & (w <= 1) & (h <= 1)
    return F.coalesce(ok, F.lit(False))


def roi_pixels(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Outward-rounded pixel bounds, clamped to the frame; null when empty."""
    def clamp(v: Column, top: Column) -> Column:
        return F.greatest(F.lit(0), F.least(top, v.cast("long")))

    box = F.struct(
        clamp(F.floor(x * width), width).alias("left"), clamp(F.floor(y * height), height).alias("top"),
        clamp(F.ceil((x + w) * width), width).alias("right"), clamp(F.ceil((y + h) * height), height).alias("bottom"),
    )
    return F.when((box["right"] > box["left"]) & (box["bottom"] > box["top"]), box)


def crop_pixels(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Inward-truncated crop ``left, top, width, height``; null when empty or outside."""
    box = F.struct(
        (x * width).cast("long").alias("left"), (y * height).cast("long").alias("top"),
        (w * width).cast("long").alias("width"), (h * height).cast("long").alias("height"),
    )
    ok = (box["width"] > 0) & (box["height"] > 0) & (box["left"] + box["width"] <= width) & (box["top"] + box["height"] <= height)
    return F.when(ok, box)


def _aligned_axis(lo: Column, size: Column, context: Column, limit: Column) -> tuple[Column, Column, Column]:
    """Grow one axis by the context, then to a multiple of 8, using room before the start first."""
    first = F.greatest(F.lit(0), lo - context)
    stop = F.least(limit, lo + size + context)
    span = stop - first
    aligned = (F.floor((span + 7) / 8) * 8).cast("long")
    spare = aligned - span
    back = F.least(first, spare)
    return first - back, F.least(limit, stop + spare - back) - (first - back), aligned


def crop_geometry(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, context: Column) -> Column:
    """Context-expanded, 8-aligned crop as a struct with ``reason`` (null when usable)."""
    rl, rt = (x * width).cast("long"), (y * height).cast("long")
    rw, rh = (w * width).cast("long"), (h * height).cast("long")
    left, cw, aw = _aligned_axis(rl, rw, context, width)
    top, ch, ah = _aligned_axis(rt, rh, context, height)
    reason = (
        F.when((width <= 0) | (height <= 0) | (context < 64) | (context > 128), "INVALID_GEOMETRY")
        .when((rw <= 0) | (rh <= 0), "ROI_BELOW_ONE_PIXEL")
        .when((cw != aw) | (ch != ah), "UNALIGNED_AT_SOURCE_BOUNDS")
        .when((cw == width) & (ch == height), "FULL_FRAME_PROHIBITED")
        .when((cw > 720) | (ch > 480) | (cw * ch > 720 * 480), "CROP_LIMIT_EXCEEDED")
    )
    return F.struct(
        left.alias("left"), top.alias("top"), cw.alias("width"), ch.alias("height"),
        (rl - left).alias("mask_left"), (rt - top).alias("mask_top"), reason.alias("reason"),
    )


def roi_equal(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    same = F.lit(True)
    for key in ("x", "y", "w", "h"):
        same = same & (F.abs(a[key] - b[key]) <= tolerance)
    return F.coalesce(same, F.lit(False))


def bounding_box(points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.struct(
        F.array_min(xs).alias("left"), F.array_max(xs).alias("right"),
        F.array_min(ys).alias("top"), F.array_max(ys).alias("bottom"),
    )
