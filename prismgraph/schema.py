"""Fixed values of the data model and the tables' schemas."""

from __future__ import annotations

# Fixed-point scale, code steps an octave and bias, page and group sizes, bands, tolerance steps.
SCALE = 1 << 29
STEPS_PER_OCTAVE = 1024
BIAS = 40
PAGE_RECORDS = 256
GROUP_PAGES = 64
BANDS = 16
TOLERANCE_STEPS = 13
CODES_PER_TOLERANCE_STEP = 256
NO_ERROR_LIMIT = 0xFFFF
LARGEST_CODE = 65534

NODES = "node long, osm_id long, lat double, lon double, elevation float, level int"
EDGES = "edge long, source long, target long, weight long, type int, max_speed int, child_a long, child_b long"
RANGES = "edge long, birth int, death int"
