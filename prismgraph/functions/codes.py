"""Scalar functions as column expressions: error codes, bounds, bands, Morton keys, levels and shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prismgraph.schema import BANDS, BIAS, CODES_PER_TOLERANCE_STEP, LARGEST_CODE, NO_ERROR_LIMIT, SCALE, STEPS_PER_OCTAVE, TOLERANCE_STEPS


def log2(c: Column) -> Column:
    """Base-2 logarithm, exact at powers of two (the built-in one is a ratio of natural logarithms)."""
    raw = F.log2(c)
    return F.when(F.abs(raw - F.round(raw)) < 1e-12, F.round(raw)).otherwise(raw)


def error_code(e: Column) -> Column:
    """Errors round up: a code never stands for less than its error."""
    code = F.ceil((log2(e.cast("double")) + BIAS) * STEPS_PER_OCTAVE)
    return F.when(~(e > 0) | e.isNull(), 0).when(e == float("inf"), NO_ERROR_LIMIT).otherwise(F.greatest(F.lit(1), F.least(F.lit(LARGEST_CODE), code))).cast("int")


def tolerance_code(t: Column) -> Column:
    """Tolerances round down."""
    code = F.floor((log2(t.cast("double")) + BIAS) * STEPS_PER_OCTAVE)
    return F.when(~(t > 0) | t.isNull(), 0).when(t == float("inf"), LARGEST_CODE).otherwise(F.greatest(F.lit(0), F.least(F.lit(LARGEST_CODE), code))).cast("int")


def decode(code: Column) -> Column:
    return F.when(code == 0, F.lit(0.0)).when(code == NO_ERROR_LIMIT, F.lit(float("inf"))).otherwise(F.pow(F.lit(2.0), code / STEPS_PER_OCTAVE - BIAS))


def bound(code: Column) -> Column:
    """An error's bound in fixed-point units, rounded up, at most 2^30 - 1."""
    return F.when(code == 0, F.lit(0).cast("long")).otherwise(F.least(F.lit((1 << 30) - 1).cast("double"), F.ceil(decode(code) * SCALE).cast("double")).cast("long"))


def level_band(level: Column, lo: Column, hi: Column) -> Column:
    return F.floor((level - lo) * BANDS / (hi - lo + 1)).cast("int")


def band_code(code: Column) -> Column:
    return F.shiftright(code, 8)


def in_range(level, lo: Column, hi: Column) -> Column:
    return F.coalesce(F.lit(level).between(lo, hi), F.lit(False))


def overlap(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    return F.coalesce((a_lo <= b_hi) & (b_lo <= a_hi), F.lit(False))


def _spread(v: Column) -> Column:
    """The 16 low bits of v in the even bits."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def interleaved(x: Column, y: Column, box: tuple[int, int, int, int]) -> Column:
    """Morton code: 16 bits of each coordinate's share of the box, x in the even bits."""
    x0, y0, x1, y1 = box
    cell = lambda v, lo, hi: F.greatest(F.lit(0.0), F.least(F.lit(65535.0), (v - float(lo)) * (65535.0 / max(1.0, float(hi) - lo)))).cast("long")
    return _spread(cell(x, x0, x1)).bitwiseOR(F.shiftleft(_spread(cell(y, y0, y1)), 1))


def record_key(layer: Column, octave: Column, code: Column) -> Column:
    return F.shiftleft(layer.cast("long"), 37).bitwiseOR(F.shiftleft(octave.cast("long"), 32)).bitwiseOR(code)


def style_index(kind: Column) -> Column:
    return F.when(kind.between(0, 62), kind).otherwise(63).cast("int")


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, 100.0 * part / whole).otherwise(0.0)


def first_step(code: Column, base: int) -> Column:
    """The first tolerance step whose threshold reaches a code."""
    return F.greatest(F.lit(0), F.least(F.lit(TOLERANCE_STEPS), F.ceil((code - base) / CODES_PER_TOLERANCE_STEP))).cast("int")


def step_pixels(step: Column) -> Column:
    return F.pow(F.lit(2.0), step / 4)


def nearest_step(pixels: Column) -> Column:
    """The step nearest to a tolerance in pixels."""
    return F.greatest(F.lit(0), F.least(F.lit(TOLERANCE_STEPS - 1), F.round(4 * log2(F.greatest(pixels.cast("double"), F.lit(1e-3)))))).cast("int")


def step_of_threshold(threshold: Column, pixel_code: Column) -> Column:
    return F.round((threshold - pixel_code) / CODES_PER_TOLERANCE_STEP).cast("int")


def class_depth(index: Column, classes: Column) -> Column:
    """Depth of a style class: those listed first lie on top."""
    return (index + 1) / (classes + 1)


def hex_colour(text: Column) -> Column:
    """#RRGGBB or #RRGGBBAA as four numbers in 0..1; null if malformed."""
    part = lambda i: F.conv(F.substring(text, i, 2), 16, 10).cast("double") / 255
    return F.when(text.rlike("^#([0-9a-fA-F]{6}|[0-9a-fA-F]{8})$"), F.array(part(2), part(4), part(6), F.when(F.length(text) == 9, part(8)).otherwise(1.0)))
