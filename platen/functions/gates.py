"""Validation predicates as columns: result codes instead of exceptions, so that rejected rows stay in the table.

A null argument fails like a zero would, except where a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Result codes and their names.
RESULTS = {0: "IMG_SUCCESS", 1: "IMG_ERR_NOMEM", 2: "IMG_ERR_FORMAT", 3: "IMG_ERR_SECURITY", 4: "IMG_ERR_IO", 5: "IMG_ERR_HW_UNSUP", 6: "IMG_ERR_INTERNAL"}
SUCCESS, NOMEM, FORMAT, SECURITY, INTERNAL = 0, 1, 2, 3, 6
MAX_SIDE, MAX_RATIO, MAX_BYTES, POOL_BYTES, U32_MAX = 16384, 400, 1 << 32, 32 << 20, 0xFFFFFFFF
JOB_ABI = 2


def _n(x: Column | int) -> Column:
    return F.coalesce((x if isinstance(x, Column) else F.lit(x)).cast("long"), F.lit(0).cast("long"))


def request_gate(width: Column | int, height: Column | int, file_size: Column) -> Column:
    """Sides within bounds, a file that isn't empty, and no more pixels than its size can hold."""
    w, h, size = _n(width), _n(height), _n(file_size)
    pixels = w * h
    bad = (w == 0) | (h == 0) | (w > MAX_SIDE) | (h > MAX_SIDE) | (pixels > MAX_SIDE * MAX_SIDE) | (size == 0)
    return F.when(bad, SECURITY).when(pixels > size * MAX_RATIO, SECURITY).when(pixels * 4 > F.lit(MAX_BYTES), SECURITY).otherwise(SUCCESS)


def header_gate(width: Column, height: Column, channels: Column) -> Column:
    w, h, c = _n(width), _n(height), _n(channels)
    return F.when((w == 0) | (h == 0), FORMAT).when((w > MAX_SIDE) | (h > MAX_SIDE), SECURITY).when((c == 0) | (c > 4), FORMAT).otherwise(SUCCESS)


def rgb24_stride(width: Column, stride: Column) -> Column:
    return F.when(_n(stride) == 0, _n(width) * 3).otherwise(_n(stride))


def rgb24_contract(width: Column, height: Column, stride: Column, size: Column) -> Column:
    """Stride 0 stands for 3 bytes a pixel; the data must be exactly stride * height bytes, then the request gate."""
    w, h, s = _n(width), _n(height), rgb24_stride(width, stride)
    gate = request_gate(width, height, size)
    return F.when((w == 0) | (h == 0), SECURITY).when(s < w * 3, SECURITY).when(s * h != _n(size), SECURITY).otherwise(gate)


def encoded_file_gate(size: Column) -> Column:
    return request_gate(MAX_SIDE, MAX_SIDE, size)


def raw_process_gate(size: Column) -> Column:
    return request_gate(4096, 4096, size)


def abi_gate(version: Column) -> Column:
    return F.when(_n(version) == JOB_ABI, SUCCESS).otherwise(INTERNAL)


def grid_sanity(cols: Column, rows: Column, gap: Column, cell_w: Column, cell_h: Column) -> Column:
    c, r = _n(cols), _n(rows)
    steps = (_n(gap) + _n(cell_w) > U32_MAX) | (_n(gap) + _n(cell_h) > U32_MAX)
    return F.when((c == 0) | (r == 0) | (c * r > U32_MAX) | steps, SECURITY).otherwise(SUCCESS)


def capacity_gate(width: Column, height: Column, limit: int = POOL_BYTES) -> Column:
    return F.when(_n(width) * _n(height) * 3 > limit, NOMEM).otherwise(SUCCESS)


def resize_gate(src_w: Column, src_h: Column, channels: Column, new_w: Column, new_h: Column) -> Column:
    return F.when((_n(new_w) == 0) | (_n(new_h) == 0), SECURITY).when((_n(src_w) == 0) | (_n(src_h) == 0) | (_n(channels) < 3), FORMAT).otherwise(SUCCESS)


def result_name(code: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in RESULTS.items() for x in kv))
    return F.coalesce(names[code.cast("int")], F.lit("IMG_ERR_UNKNOWN"))


def parse_u32(text: Column) -> Column:
    """Digits only and at most 2**32 - 1, else null."""
    value = F.when(text.rlike("^[0-9]{1,18}$"), text).try_cast("long")
    return F.when(value <= F.lit(U32_MAX), value)


def parse_float(text: Column) -> Column:
    """A plain decimal without a sign, else null."""
    return F.when(text.rlike(r"^([0-9]+([.][0-9]*)?|[.][0-9]+)$"), text).try_cast("float")


def parse_mode(text: Column) -> Column:
    return F.when(text == "fit", 0).when(text == "fill", 1)


def parse_format(text: Column) -> Column:
    return F.when(text == "encoded", 0).when(text == "raw-rgb24", 1)


def crop_gate(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Whether a crop window lies in the frame; a crop that doesn't is no operation."""
    return (x + w <= width) & (y + h <= height)


def output_kind(path: Column) -> Column:
    """'pdf' for the extension pdf in any case, else 'raster'."""
    tail = F.lower(F.substring_index(path, ".", -1))
    return F.when(F.contains(path, F.lit(".")) & (tail == "pdf"), "pdf").otherwise("raster")


def bg_signature(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r.cast("long"), 16) + F.shiftleft(g.cast("long"), 8) + b.cast("long")
