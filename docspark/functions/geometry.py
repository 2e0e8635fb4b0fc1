"""Column functions over numbers: boxes, rotations, matrices, output sizes. Native expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DEFAULT_DPI = 150.0
MAX_PIXELS, MAX_DIMENSION = 4_000_000, 10_000
MAX_SPAN = 1000


def normalize_rotation(degrees: Column) -> Column:
    return F.pmod(degrees, F.lit(360))


def valid_rotation(degrees: Column) -> Column:
    return F.pmod(degrees, F.lit(90)) == 0


def normalize_rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(F.least(x0, x1).alias("x0"), F.least(y0, y1).alias("y0"), F.greatest(x0, x1).alias("x1"), F.greatest(y0, y1).alias("y1"))


def clamp_span(span: Column) -> Column:
    """1 to 1000; a negative span says nothing."""
    return F.when(span < 0, 1).otherwise(F.least(F.greatest(span, F.lit(1)), F.lit(MAX_SPAN)))


def image_bbox(m: dict[str, Column]) -> Column:
    """The unit square through the matrix a..f."""
    xs = [m["e"], m["e"] + m["a"], m["e"] + m["c"], m["e"] + m["a"] + m["c"]]
    ys = [m["f"], m["f"] + m["b"], m["f"] + m["d"], m["f"] + m["b"] + m["d"]]
    return F.struct(F.least(*xs).alias("x0"), F.least(*ys).alias("y0"), F.greatest(*xs).alias("x1"), F.greatest(*ys).alias("y1"))


def vertical_scale(c: Column, d: Column) -> Column:
    return F.sqrt(c * c + d * d)


def multiply(m: dict[str, Column], n: dict[str, Column]) -> dict[str, Column]:
    """m then n, for row vectors."""
    return {
        "a": m["a"] * n["a"] + m["b"] * n["c"], "b": m["a"] * n["b"] + m["b"] * n["d"], "c": m["c"] * n["a"] + m["d"] * n["c"],
        "d": m["c"] * n["b"] + m["d"] * n["d"], "e": m["e"] * n["a"] + m["f"] * n["c"] + n["e"], "f": m["e"] * n["b"] + m["f"] * n["d"] + n["f"],
    }


def output_dimensions(w: Column, h: Column, *, width: Column | None = None, height: Column | None = None, dpi: Column | None = None, scale: Column | None = None, max_pixels: int = MAX_PIXELS, max_dimension: int = MAX_DIMENSION) -> Column:
    """Struct (width, height, error): both sides given, one side, dpi, scale, else 150 dpi; error 'budget_exceeded' beyond the limits."""
    none = F.lit(None).cast("double")
    width, height, dpi, scale = (none if c is None else c.cast("double") for c in (width, height, dpi, scale))
    w, h = F.greatest(w.cast("double"), F.lit(1.0)), F.greatest(h.cast("double"), F.lit(1.0))
    factor = F.coalesce(dpi / 72.0, scale, F.lit(DEFAULT_DPI / 72.0))
    out_w = F.coalesce(width, height * w / h, w * factor)
    out_h = F.coalesce(height, width * h / w, h * factor)
    px = lambda c: F.greatest(F.round(c), F.lit(1.0)).cast("bigint")
    big = (px(out_w) > max_dimension) | (px(out_h) > max_dimension) | (px(out_w) * px(out_h) > max_pixels)
    return F.struct(px(out_w).alias("width"), px(out_h).alias("height"), F.when(big, "budget_exceeded").alias("error"))


def crop_pixels(rect: dict[str, Column], page_w: Column, page_h: Column, width: Column, height: Column) -> Column:
    """A rectangle in points to pixels of a page image, from the top left: floored and ceiled outwards, clamped to the image."""
    sx, sy = width / F.greatest(page_w, F.lit(1.0)), height / F.greatest(page_h, F.lit(1.0))
    clamp = lambda v, most: F.least(F.greatest(v.cast("bigint"), F.lit(0)), most.cast("bigint"))
    left, right = clamp(F.floor(F.least(rect["x0"], rect["x1"]) * sx), width), clamp(F.ceil(F.greatest(rect["x0"], rect["x1"]) * sx), width)
    top, bottom = clamp(F.floor(height - F.greatest(rect["y0"], rect["y1"]) * sy), height), clamp(F.ceil(height - F.least(rect["y0"], rect["y1"]) * sy), height)
    extent = lambda a, b: F.greatest(b - a, F.lit(0)).cast("bigint")
    return F.struct(left.alias("left"), top.alias("top"), extent(left, right).alias("width"), extent(top, bottom).alias("height"))


def segment(x0: Column, y0: Column, x1: Column, y1: Column, off: float = 0.5) -> Column:
    """An axis-aligned segment as a rule struct (vertical, pos, lo, hi); null if it is slanted or short."""
    dx, dy = F.abs(x1 - x0), F.abs(y1 - y0)
    make = lambda vertical, pos, a, b: F.struct(F.lit(vertical).alias("vertical"), pos.alias("pos"), F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
    return F.when((dx <= off) & (dy > off), make(True, (x0 + x1) / 2, y0, y1)).when((dy <= off) & (dx > off), make(False, (y0 + y1) / 2, x0, x1))
