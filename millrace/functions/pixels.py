"""Gray images as row-major arrays of numbers: blur, contrast, frames, panels, perspective and resampling as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def motion_blur(pixels: Column, width: Column | int, length: int) -> Column:
    """Each pixel becomes the mean of itself and the up to length - 1 pixels left of it in its row."""
    w = F.lit(width) if isinstance(width, int) else width

    def at(_: Column, i: Column) -> Column:
        back = F.least(i % w, F.lit(length - 1)).cast("int")
        return F.aggregate(F.slice(pixels, (i - back + 1).cast("int"), back + 1), F.lit(0.0), lambda a, v: a + v) / (back + 1)

    return F.transform(pixels, at)


def contrast(pixels: Column, gain: float, offset: float) -> Column:
    """gain * value + offset, kept within 0 and 255."""
    return F.transform(pixels, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(255.0), v * gain + offset)))


def framed(pixels: Column, width: int, height: int, border: int, value: float) -> Column:
    """The image inside a border of one value."""
    wide = width + 2 * border
    inside = lambda x, y: (x >= border) & (x < border + width) & (y >= border) & (y < border + height)

    def at(i: Column) -> Column:
        x, y = i % wide, F.floor(i / wide)
        return F.when(inside(x, y), F.get(pixels, ((y - border) * width + x - border).cast("int"))).otherwise(F.lit(value))

    return F.transform(F.sequence(F.lit(0), F.lit(wide * (height + 2 * border) - 1)), at)


def composite(background: Column, width: int, panel: Column, panel_width: int, panel_height: int, left: Column, top: Column) -> Column:
    """The panel laid over the background at (left, top); what reaches over the edge is cut."""
    def at(v: Column, i: Column) -> Column:
        x, y = i % width - left, F.floor(i / width) - top
        inside = (x >= 0) & (x < panel_width) & (y >= 0) & (y < panel_height)
        return F.when(inside, F.get(panel, (y * panel_width + x).cast("int"))).otherwise(v)

    return F.transform(background, at)


def corner_quad(width: Column, height: Column, shift: Column) -> Column:
    """Corners of a panel seen at a slant: the right edge is `shift` (a share of the height) shorter at both ends."""
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((F.lit(0.0), F.lit(0.0)), (width, height * shift), (width, height * (1 - shift)), (F.lit(0.0), height))])


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def quad_homography(width: Column, height: Column, quad: Column) -> Column:
    """Nine numbers, row by row, of the perspective that maps the corners (0, 0), (w, 0), (w, h), (0, h) to a quad's (array of structs x, y).

    Solved in closed form: the eight unknowns of the unit square's perspective, then scaled to the rectangle. Null where three corners lie on a line.
    """
    def solve(q: Column) -> Column:
        p = [F.get(q, F.lit(i)) for i in range(4)]
        x, y = [c["x"] for c in p], [c["y"] for c in p]
        dx1, dx2, sx = x[1] - x[2], x[3] - x[2], x[0] - x[1] + x[2] - x[3]
        dy1, dy2, sy = y[1] - y[2], y[3] - y[2], y[0] - y[1] + y[2] - y[3]
        det = dx1 * dy2 - dx2 * dy1
        slant = F.when(det != 0, F.struct(((sx * dy2 - dx2 * sy) / det).alias("g"), ((dx1 * sy - sx * dy1) / det).alias("h")))

        def rows(s: Column) -> Column:
            g, h = s["g"], s["h"]
            unit = [x[1] - x[0] + g * x[1], x[3] - x[0] + h * x[3], x[0], y[1] - y[0] + g * y[1], y[3] - y[0] + h * y[3], y[0], g, h, F.lit(1.0)]
            return F.when(s.isNotNull(), F.array(*[v / (width, height, F.lit(1.0))[i % 3] for i, v in enumerate(unit)]))

        return bound(slant, rows)

    return bound(quad, solve)


def inverse_homography(m: Column) -> Column:
    """The perspective back, up to scale; null where there is none."""
    def solve(m: Column) -> Column:
        a, b, c, d, e, f, g, h, i = (F.get(m, F.lit(k)) for k in range(9))
        det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
        return F.when(det != 0, F.array(e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d))

    return bound(m, solve)


def mapped(m: Column, x: Column, y: Column) -> Column:
    """struct(x, y) of a point under a perspective."""
    def at(m: Column) -> Column:
        k = [F.get(m, F.lit(j)) for j in range(9)]
        w = k[6] * x + k[7] * y + k[8]
        return F.struct(((k[0] * x + k[1] * y + k[2]) / w).alias("x"), ((k[3] * x + k[4] * y + k[5]) / w).alias("y"))

    return bound(m, at)


def bilinear(pixels: Column, width: int, height: int, point: Column) -> Column:
    """struct(value, cover) of an image at a point (struct x, y) between pixels; outside of it values and cover are 0."""
    def at(p: Column) -> Column:
        left, top, fx, fy = p["left"], p["top"], p["fx"], p["fy"]
        value, cover = F.lit(0.0), F.lit(0.0)
        for dx, dy, weight in ((0, 0, (1 - fx) * (1 - fy)), (1, 0, fx * (1 - fy)), (0, 1, (1 - fx) * fy), (1, 1, fx * fy)):
            px, py = left + dx, top + dy
            inside = (px >= 0) & (px < width) & (py >= 0) & (py < height)
            value = value + F.when(inside, weight * F.get(pixels, (py * width + px).cast("int"))).otherwise(0.0)
            cover = cover + F.when(inside, weight).otherwise(0.0)
        return F.struct(value.alias("value"), cover.alias("cover"))

    split = lambda p: F.struct(F.floor(p["x"]).alias("left"), F.floor(p["y"]).alias("top"), (p["x"] - F.floor(p["x"])).alias("fx"), (p["y"] - F.floor(p["y"])).alias("fy"))
    return bound(bound(point, split), at)


def panel_composite(background: Column, width: int, panel: Column, panel_width: int, panel_height: int, back: Column) -> Column:
    """The background with a panel seen in perspective: each pixel is looked up in the panel through `back`, from background to panel, and mixed by the panel's cover.

    The warped value has zeros beyond the panel's edge and is mixed by its cover once more, so edges are a little darker, as with a warped image and a warped mask.
    """
    def laid(m: Column) -> Column:
        def at(v: Column, i: Column) -> Column:
            seen = bilinear(panel, panel_width, panel_height, mapped(m, (i % width).cast("double"), F.floor(i / width).cast("double")))
            return bound(seen, lambda s: s["value"] * s["cover"] + v * (1 - s["cover"]))

        return F.transform(background, at)

    return bound(back, laid)


def fitted(width: Column, height: Column, most_width: int, most_height: int) -> tuple[Column, Column]:
    """Size of an image scaled to fit a frame, sides rounded half to even, at least one pixel each."""
    scale = F.least(F.lit(float(most_width)) / width, F.lit(float(most_height)) / height)
    side = lambda v: F.greatest(F.lit(1), F.rint(v * scale).cast("int"))
    return side(width), side(height)


def resized_bilinear(pixels: Column, width: int, height: int, to_width: Column, to_height: Column) -> Column:
    """The image at another size: each pixel's centre is looked up between the four around it, edges repeated."""
    def at(i: Column) -> Column:
        x = F.greatest(F.lit(0.0), F.least(F.lit(width - 1.0), (i % to_width + 0.5) * width / to_width - 0.5))
        y = F.greatest(F.lit(0.0), F.least(F.lit(height - 1.0), (F.floor(i / to_width) + 0.5) * height / to_height - 0.5))
        return bilinear(pixels, width, height, F.struct(x.alias("x"), y.alias("y")))["value"]

    return F.transform(F.sequence(F.lit(0), to_width * to_height - 1), at)


def stable_noise(key: Column, seed: str, n: Column, spread: float) -> Column:
    """n numbers within -spread and spread that depend on seed, key and place alone."""
    part = lambda i: F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), key.cast("string"), i.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: (part(i) / 4294967295.0 * 2 - 1) * spread)
