"""Projection, camera, level curve and view planning, as column expressions over tables of bounds, cameras or zooms."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismgraph.functions.codes import tolerance_code
from prismgraph.schema import SCALE

# Metres a projected degree, half span at zoom 1, zoom limits, end of the mapped zooms, the curve's share and
# exponent, widest road in pixels, height of the reference screen, farthest zoom, response of the camera.
METRES_PER_DEGREE = 111319.49079327357
HALF_SPAN = 1500000.0
LEAST_ZOOM, LARGEST_ZOOM, LAST_ZOOM = 0.01, 1048576.0, 1000.0
LEVEL_SHARE, EXPONENT = 8.0 / 9.0, 1.35
WIDEST_ROAD, REFERENCE_HEIGHT, RESPONSE = 32.0, 2160, 14.0
CATCH_ALL, LAST_OCTAVE = 4, 31


def fit_projection(nodes: DataFrame) -> DataFrame:
    """One row: centre, longitude scale and norm of the bounds of lat and lon, and metres a unit."""
    c = F.col
    b = nodes.agg(F.min("lat").alias("lat0"), F.max("lat").alias("lat1"), F.min("lon").alias("lon0"), F.max("lon").alias("lon1"))
    b = b.select("*", ((c("lat0") + c("lat1")) / 2).alias("centre_lat"), ((c("lon0") + c("lon1")) / 2).alias("centre_lon"))
    b = b.withColumn("lon_scale", F.cos(F.radians("centre_lat")))
    half = F.greatest((c("lon1") - c("lon0")) / 2 * c("lon_scale"), (c("lat1") - c("lat0")) / 2, F.lit(1e-12))
    return b.withColumn("norm", 0.95 / half).withColumn("metres_per_unit", metres_per_unit(c("norm")))


def metres_per_unit(norm: Column) -> Column:
    return METRES_PER_DEGREE / F.greatest(norm, F.lit(1e-12))


def project(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Map units, of a row that has the projection's columns."""
    c = F.col
    return (lon - c("centre_lon")) * c("lon_scale") * c("norm"), (lat - c("centre_lat")) * c("norm")


def fixed(v: Column) -> Column:
    """Fixed-point units, half away from zero."""
    return F.round(v * SCALE).cast("long")


def fit_zoom(metres: float) -> float:
    return float(np.float32(min(max(HALF_SPAN / max(metres, 1e-12), LEAST_ZOOM), LARGEST_ZOOM)))


@dataclass(frozen=True)
class Curve:
    """Zoom to continuous level: a share of the range at the overview, falling to the finest at the last mapped zoom. In 32-bit floats."""

    overview: float
    lo: int
    hi: int

    @property
    def end(self) -> np.float32:
        return max(np.float32(LAST_ZOOM), np.float32(self.overview) * np.float32(1.0001))

    def level(self, zoom: float) -> float:
        f, one = np.float32, np.float32(1)
        z = min(max(f(zoom), f(self.overview)), self.end)
        part = min(max(np.log2(z / f(self.overview)) / np.log2(self.end / f(self.overview)), f(0)), one)
        level = f(self.lo) + f(LEVEL_SHARE) * (one - np.power(part, f(EXPONENT))) * f(self.hi - self.lo)
        return float(min(max(level, f(self.lo)), f(self.hi)))

    def column(self, zoom: Column) -> Column:
        """The same as an expression, in 64-bit floats."""
        end, over = float(self.end), float(np.float32(self.overview))
        part = F.log2(F.greatest(F.lit(over), F.least(F.lit(end), zoom)) / over) / math.log2(end / over)
        level = self.lo + LEVEL_SHARE * (1 - F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), part)), EXPONENT)) * (self.hi - self.lo)
        return F.greatest(F.lit(float(self.lo)), F.least(F.lit(float(self.hi)), level))

    def crossings(self) -> list[float]:
        """For k from -1 to the highest level, the least zoom at which the level is below k + 0.5; by bisection over octaves."""
        out = []
        for k in range(-1, self.hi + 1):
            if self.level(self.overview) < k + 0.5:
                out.append(0.0)
            elif self.level(LARGEST_ZOOM) >= k + 0.5:
                out.append(math.inf)
            else:
                near, far = math.log2(self.overview), math.log2(LARGEST_ZOOM)
                for _ in range(64):
                    middle = (near + far) / 2
                    near, far = (near, middle) if self.level(2.0**middle) < k + 0.5 else (middle, far)
                out.append(2.0**far)
        return out


def placed(curve: Curve, metres: float, lo: Column, hi: Column, error: Column, parent: Column) -> tuple[Column, Column]:
    """(layer, octave): in which quality and at which zoom an interval of levels is first needed on the reference screen.

    At zoom z a tolerance of q pixels needs it if error <= q * pixel(z) < parent; layer 0 is one pixel, 1 two, and so on.
    """
    at = F.array(*map(F.lit, curve.crossings()))
    first, last = F.element_at(at, hi.cast("int") + 2), F.element_at(at, lo.cast("int") + 1)
    over = curve.overview
    scale = float(np.float32(over * metres / HALF_SPAN))
    pixel = 2.0 * over / (scale * REFERENCE_HEIGHT)
    endless = F.lit(math.inf)
    octave = lambda z: F.greatest(F.lit(0), F.least(F.lit(LAST_OCTAVE), F.floor(F.log2(F.greatest(z, F.lit(over)) / over)).cast("int")))
    low = error * first / pixel
    high = F.when((parent == endless) | (last == endless), endless).otherwise(parent * last / pixel)
    some = (first < last) & (low < high)
    fine = F.when((low <= 1) & (high > 1), 0).when(low > 1, F.least(F.lit(CATCH_ALL), F.ceil(F.log2(low)).cast("int"))).otherwise(CATCH_ALL)
    layer = F.when(some, fine).otherwise(CATCH_ALL)
    reached = F.when((layer < CATCH_ALL) & (parent != endless), F.greatest(first, F.pow(F.lit(2.0), layer) * pixel / parent)).otherwise(first)
    return layer.cast("int"), F.when(~(first < last), 0).when(~(low < high), octave(first)).otherwise(octave(reached)).cast("int")


def plan_views(cameras: DataFrame, curve: Curve, metres: float, farther: Column | float = 0.0) -> DataFrame:
    """Adds to cameras (x, y, zoom, width, height, pixels) the query box, level, tolerance and pixel codes, and the view's rectangle.

    farther: octaves by which level and tolerance are taken from farther away, while the box stays.
    """
    c = F.col
    far = F.pow(F.lit(2.0), farther if isinstance(farther, Column) else F.lit(float(farther)))
    f32 = lambda v: v.cast("float")
    v = cameras.withColumn("half_y", 1 / F.greatest((c("zoom") * metres / HALF_SPAN).cast("float").cast("double"), F.lit(1e-12)))
    v = v.withColumns({"half_x": c("half_y") * c("width") / c("height"), "pixel": 2 * c("half_y") / c("height")})
    margin = WIDEST_ROAD / 2 * c("pixel")
    level = F.round(curve.column((c("zoom") / far).cast("float").cast("double"))).cast("int")
    return v.withColumns({
        "min_x": f32(c("x") - c("half_x") - margin), "min_y": f32(c("y") - c("half_y") - margin), "max_x": f32(c("x") + c("half_x") + margin), "max_y": f32(c("y") + c("half_y") + margin),
        "level": F.greatest(F.lit(0), F.least(F.lit(curve.hi), level)),
        "tolerance": tolerance_code(F.greatest(c("pixels"), F.lit(0.01)).cast("float").cast("double") * c("pixel") * far),
        "pixel_code": tolerance_code(c("pixel")),
        "left": c("x") - c("half_x"), "bottom": c("y") - c("half_y"), "right": c("x") + c("half_x"), "top": c("y") + c("half_y"),
    })


def cull_box() -> list[Column]:
    """The query box in fixed units, rounded inward and two units more."""
    edge = lambda v, up: F.greatest(F.lit(-(1 << 30)), F.least(F.lit(1 << 30), (F.ceil(F.col(v).cast("double") * SCALE) + 2) if up else (F.floor(F.col(v).cast("double") * SCALE) - 2))).cast("int")
    return [edge("min_x", True).alias("cull_min_x"), edge("min_y", True).alias("cull_min_y"), edge("max_x", False).alias("cull_max_x"), edge("max_y", False).alias("cull_max_y")]


def ring(margin: float = 0.5) -> list[Column]:
    """The box of the prefetch ring: the view grown by a share of itself on each side."""
    c = F.col
    x, y, hx, hy = (c("left") + c("right")) / 2, (c("bottom") + c("top")) / 2, (c("right") - c("left")) / 2, (c("top") - c("bottom")) / 2
    k = 1 + 2 * margin
    return [(x - hx * k).cast("float").alias("ring_min_x"), (y - hy * k).cast("float").alias("ring_min_y"), (x + hx * k).cast("float").alias("ring_max_x"), (y + hy * k).cast("float").alias("ring_max_y")]


def threshold(mode: str, tolerance: Column) -> Column:
    """What an expansion compares errors with: nothing is expanded, all is, or what exceeds the tolerance."""
    return {"none": F.lit(65534), "full": F.lit(0), "adaptive": tolerance}[mode]
