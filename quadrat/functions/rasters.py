"""Column functions on rasters and masks held as arrays, row by row, and on complex numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrat.functions.geometry import let


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, v: s + v)


def binarize(pixels: Column, threshold: float | Column) -> Column:
    """1 where a pixel exceeds the threshold."""
    return F.transform(pixels, lambda v: (v > threshold).cast("int"))


def overlap(a: Column, b: Column, threshold: float | Column) -> Column:
    """``struct<inter, uni>`` of two rasters above a threshold."""
    both = _sum(F.zip_with(a, b, lambda s, t: ((s > threshold) & (t > threshold)).cast("double")))
    any_ = _sum(F.zip_with(a, b, lambda s, t: ((s > threshold) | (t > threshold)).cast("double")))
    return F.struct(both.alias("inter"), any_.alias("uni"))


def pixel_iou(a: Column, b: Column, threshold: float | Column) -> Column:
    """IoU above a threshold; 1 if both are empty."""
    o = overlap(a, b, threshold)
    return F.when(o["uni"] == 0, 1.0).otherwise(F.try_divide(o["inter"], o["uni"]))


def dice_loss(pred: Column, truth: Column) -> Column:
    """``1 - (2 sum(p y) + 1) / (sum(y) + sum(p) + 1 + 1e-7)``."""
    both = _sum(F.zip_with(pred, truth, lambda p, y: p * y))
    return 1 - (2 * both + 1) / (_sum(truth) + _sum(pred) + 1 + 1e-7)


def tversky(pred: Column, truth: Column, alpha: float = 0.01, beta: float = 0.99, eps: float = 1e-6) -> Column:
    """Tversky index: false positives weigh ``alpha``, false negatives ``beta``."""
    hit = _sum(F.zip_with(pred, truth, lambda p, y: p * y))
    false = _sum(F.zip_with(pred, truth, lambda p, y: p * (1 - y)))
    lost = _sum(F.zip_with(pred, truth, lambda p, y: (1 - p) * y))
    return (hit + eps) / (hit + alpha * false + beta * lost + eps)


def focal_tversky(pred: Column, truth: Column, gamma: float = 0.25, alpha: float = 0.01, beta: float = 0.99) -> Column:
    """``(1 - tversky) ** gamma``."""
    return F.pow(F.greatest(1 - tversky(pred, truth, alpha, beta), F.lit(0.0)), F.lit(gamma))


def cross_entropy(logits: Column, label: Column, smoothing: float = 0.0) -> Column:
    """Cross entropy of one sample, with label smoothing if asked."""
    top = F.array_max(logits)
    norm = top + F.log(_sum(F.transform(logits, lambda v: F.exp(v - top))))
    own = norm - F.get(logits, label)
    mean = norm - _sum(logits) / F.size(logits)
    return (1 - smoothing) * own + smoothing * mean


def at(pixels: Column, row: Column, col: Column, height: int, width: int, replicate: bool) -> Column:
    """A pixel; beyond the border the nearest one, or 0."""
    inside = (row >= 0) & (row < height) & (col >= 0) & (col < width)
    r = F.greatest(F.lit(0), F.least(F.lit(height - 1), row))
    c = F.greatest(F.lit(0), F.least(F.lit(width - 1), col))
    v = F.get(pixels, (r * width + c).cast("int"))
    return v if replicate else F.when(inside, v).otherwise(0.0)


def stencil(pixels: Column, kernel: list[list[float]], height: int, width: int, replicate: bool = True) -> Column:
    """Correlation with a 3 x 3 kernel."""

    def one(i: Column) -> Column:
        r, c = F.floor(i / width).cast("int"), i % width
        terms = [at(pixels, r + dr - 1, c + dc - 1, height, width, replicate) * k for dr, line in enumerate(kernel) for dc, k in enumerate(line) if k]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        return total

    return F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), one)


#: Gradient kernels along x, scaled so that the weights' magnitudes sum to 1 (fixed values).
GRADIENTS = {
    "sobel": [[-1 / 8, 0, 1 / 8], [-2 / 8, 0, 2 / 8], [-1 / 8, 0, 1 / 8]],
    "diff": [[0, 0, 0], [-1 / 2, 0, 1 / 2], [0, 0, 0]],
    "scharr": [[-47 / 512, 0, 47 / 512], [-162 / 512, 0, 162 / 512], [-47 / 512, 0, 47 / 512]],
}
LAPLACIAN = [[0.5 / 12, 1 / 12, 0.5 / 12], [1 / 12, -6 / 12, 1 / 12], [0.5 / 12, 1 / 12, 0.5 / 12]]


def gradient(pixels: Column, height: int, width: int, mode: str = "scharr") -> Column:
    """``struct<gx, gy>`` with the nearest pixel beyond the border."""
    kernel = GRADIENTS[mode]
    turned = [[kernel[c][r] for c in range(3)] for r in range(3)]
    return F.struct(stencil(pixels, kernel, height, width).alias("gx"), stencil(pixels, turned, height, width).alias("gy"))


def laplacian(pixels: Column, height: int, width: int) -> Column:
    """Magnitude of the Laplacian, with 0 beyond the border."""
    return F.transform(stencil(pixels, LAPLACIAN, height, width, replicate=False), lambda v: F.abs(v))


def bilinear(pixels: Column, x: Column, y: Column, height: int, width: int) -> Column:
    """Bilinear sample: corner indices are clamped, weights come from the unclamped position."""
    x0, y0 = F.floor(x), F.floor(y)
    value = lambda r, c: at(pixels, r, c, height, width, True)
    return (
        value(y0, x0) * ((x0 + 1) - x) * ((y0 + 1) - y)
        + value(y0 + 1, x0) * ((x0 + 1) - x) * (y - y0)
        + value(y0, x0 + 1) * (x - x0) * ((y0 + 1) - y)
        + value(y0 + 1, x0 + 1) * (x - x0) * (y - y0)
    )


def clear_frame(pixels: Column, height: int, width: int, frame: int = 3) -> Column:
    """0 in a frame along the border."""

    def one(v: Column, i: Column) -> Column:
        r, c = F.floor(i / width), i % width
        return F.when((r < frame) | (r >= height - frame) | (c < frame) | (c >= width - frame), F.lit(0).cast("double")).otherwise(v)

    return F.transform(pixels, one)


def denormalize(pixels: Column, mean: Column, std: Column) -> Column:
    """``v * std + mean``."""
    return F.transform(pixels, lambda v: v * std + mean)


def normalize(pixels: Column, mean: Column, std: Column) -> Column:
    """``(v - mean) / std``; NULL for a deviation of 0."""
    return F.transform(pixels, lambda v: F.try_divide(v - mean, std))


def flipped(pixels: Column, width: int) -> Column:
    """The raster mirrored left to right."""
    rows = F.sequence(F.lit(0), (F.size(pixels) / width).cast("int") - 1)
    return F.flatten(F.transform(rows, lambda r: F.reverse(F.slice(pixels, r * width + 1, F.lit(width)))))


def pixel_frequency(mask: Column, freq: Column) -> Column:
    """Frequency of each pixel's class: that of its class where the mask is set, else that of the background.

    ``mask`` is a raster of one class, ``freq`` the frequency of that class.
    """
    return F.transform(mask, lambda v: F.when(v > 0, freq).otherwise(1 - freq))


def valid_crop(mask: Column, freq: Column, size: Column | None = None) -> Column:
    """Whether no pixel of a crop has a class (or background) of frequency 0, nor an object of size 0.

    A class that no pixel of the crop has may have the frequency 0.
    """
    good = ~F.exists(pixel_frequency(mask, freq), lambda f: f == 0)
    return good if size is None else good & (F.array_min(size) > 0)


def pixel_weight(freq: Column, distance: Column, size: Column, height: int, width: int, w0: float = 50.0, sigma: float = 10.0) -> Column:
    """Loss weight of a pixel: rarity of its class plus closeness to two objects, larger for small ones.

    ``distance`` is a share of height + width, as masks hold it.  NULL where the frequency of the
    pixel's class or the size is 0.
    """
    far = distance * float(height + width)
    near = w0 * F.exp(-(far * far) / (sigma * sigma))
    return (F.try_divide(F.lit(1.0), freq) + near) * (1 + F.try_divide(F.lit(1.0), size * (math.sqrt(height * width) / 2)))


# Complex numbers: struct<re double, im double>.


def cx(re: Column, im: Column) -> Column:
    """A complex number."""
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def cx_mul(a: Column, b: Column) -> Column:
    """Product."""

    def product(p: Column) -> Column:
        a, b = p["a"], p["b"]
        return cx(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])

    return let(F.struct(a.alias("a"), b.alias("b")), product)


def cx_add(a: Column, b: Column) -> Column:
    """Sum."""
    return let(F.struct(a.alias("a"), b.alias("b")), lambda p: cx(p["a"]["re"] + p["b"]["re"], p["a"]["im"] + p["b"]["im"]))


def cx_scale(a: Column, k: float | Column) -> Column:
    """Multiple."""
    return let(a, lambda a: cx(a["re"] * k, a["im"] * k))


def cx_abs(a: Column) -> Column:
    """Magnitude."""
    return F.hypot(a["re"], a["im"])


def cx_abs2(a: Column) -> Column:
    """Squared magnitude."""
    return let(a, lambda a: a["re"] * a["re"] + a["im"] * a["im"])


def cx_arg(a: Column) -> Column:
    """Angle."""
    return F.atan2(a["im"], a["re"])


def cx_sqrt(a: Column) -> Column:
    """Principal root, by magnitude and angle."""

    def root(a: Column) -> Column:
        size, angle = F.sqrt(cx_abs(a)), cx_arg(a) / 2
        return cx(size * F.cos(angle), size * F.sin(angle))

    return let(a, root)


def crossfield_coefficients(u: Column, v: Column) -> Column:
    """``c0 = u^2 v^2`` and ``c2 = -(u^2 + v^2)`` of the frame field's directions."""
    squares = F.struct(cx_mul(u, u).alias("uu"), cx_mul(v, v).alias("vv"))
    return let(squares, lambda s: F.struct(cx_mul(s["uu"], s["vv"]).alias("c0"), cx_scale(cx_add(s["uu"], s["vv"]), -1.0).alias("c2")))


def crossfield_directions(c0: Column, c2: Column) -> Column:
    """Directions ``u`` and ``v`` from the coefficients, by the quadratic in ``z^2``."""

    def solved(p: Column) -> Column:
        uu = cx_scale(cx_add(p["c2"], p["root"]), -0.5)
        vv = cx_scale(cx_add(p["c2"], cx_scale(p["root"], -1.0)), -0.5)
        return F.struct(cx_sqrt(uu).alias("u"), cx_sqrt(vv).alias("v"))

    root = cx_sqrt(cx_add(cx_mul(c2, c2), cx_scale(c0, -4.0)))
    return let(F.struct(c2.alias("c2"), root.alias("root")), solved)


def align_error(c0: Column, c2: Column, z: Column) -> Column:
    """``|z^4 + c2 z^2 + c0|^2``: 0 where ``z`` follows the frame field."""
    return let(cx_mul(z, z), lambda zz: cx_abs2(cx_add(cx_add(cx_mul(zz, zz), cx_mul(c2, zz)), c0)))


def crossfield_from_angle(angle: Column) -> Column:
    """Coefficients of a frame field with directions at ``angle`` and at a right angle to it."""
    u = cx(F.cos(angle), F.sin(angle))
    v = cx(F.cos(angle + math.pi / 2), F.sin(angle + math.pi / 2))
    return crossfield_coefficients(u, v)


def frame_field(pixels: Column, height: int, width: int) -> Column:
    """Real and imaginary parts of c0 and of c2, one raster each: directions along and across the gradient, 0 where there is none."""
    slopes = let(gradient(pixels, height, width), lambda g: F.arrays_zip(g["gx"].alias("gx"), g["gy"].alias("gy")))
    none = cx(F.lit(0.0), F.lit(0.0))
    flat = F.struct(none.alias("c0"), none.alias("c2"))
    field = F.transform(slopes, lambda s: F.when((s["gx"] == 0) & (s["gy"] == 0), flat).otherwise(crossfield_from_angle(F.atan2(s["gy"], s["gx"]))))
    part = lambda f, k, p: F.transform(f, lambda c: c[k][p])
    return let(field, lambda f: F.concat(*[part(f, k, p) for k in ("c0", "c2") for p in ("re", "im")]))
