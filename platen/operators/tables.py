"""Table functions for SQL users: cells of a sheet and rectangles of a cell, as rows in a LATERAL join.

They mirror ``geometry.cell_grid``, ``border_rects`` and ``crop_mark_rects``, and like
these they are expressions and generators: SQL functions, which Spark writes into the
query that calls them, so that their rows are made in the scan's own stage.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from platen.operators import geometry

CELLS = ("cols", "rows", "gap", "start_x", "start_y", "cell_w", "cell_h")
RECTS = ("x", "y", "w", "h", "border_px", "crop_mark_px", "crop_thickness", "crop_offset_px")


def _parameters(names: tuple[str, ...]) -> str:
    return ", ".join(f"{n} BIGINT" for n in names)


def _given(names: tuple[str, ...]) -> str:
    return " AND ".join(f"{n} IS NOT NULL" for n in names)


def _cells() -> str:
    """cells(cols, rows, gap, start_x, start_y, cell_w, cell_h): row-major; none where a value is null."""
    return f"""FUNCTION cells({_parameters(CELLS)}) RETURNS TABLE (cell_idx BIGINT, row BIGINT, col BIGINT, x BIGINT, y BIGINT, w BIGINT, h BIGINT)
RETURN SELECT k, k div cols, k % cols, start_x + k % cols * (cell_w + gap), start_y + k div cols * (cell_h + gap), cell_w, cell_h
FROM explode(CASE WHEN {_given(CELLS)} AND cols > 0 AND rows > 0 THEN sequence(0L, cols * rows - 1) END) AS c(k)"""


def _rects() -> str:
    """rects(x, y, w, h, border_px, crop_mark_px, crop_thickness, crop_offset_px): the border's and the crop marks' rectangles of one cell."""
    b, length, thick, off = "border_px", "crop_mark_px", "if(crop_thickness = 0, 1L, crop_thickness)", "crop_offset_px"
    border = [("x", "y", "w", b), ("x", f"y + h - {b}", "w", b), ("x", "y", b, "h"), (f"x + w - {b}", "y", b, "h")]
    marks = []
    for corner in range(4):
        right, low = corner % 2, corner // 2
        # Outwards from the corner: where a mark of this size starts.
        at = lambda start, size, far, mark: f"{start} + {size} + {off}" if far else f"{start} - {off} - {mark}"
        marks += [(at("x", "w", right, mw), at("y", "h", low, mh), mw, mh) for mw, mh in ((length, thick), (thick, length))]
    made = {layer: [f"named_struct('layer', {layer}, 'part', {k}, 'x', {x}, 'y', {y}, 'w', {w}, 'h', {h})" for k, (x, y, w, h) in enumerate(boxes)] for layer, boxes in ((geometry.BORDER, border), (geometry.MARK, marks))}
    array = lambda *layers: f"array({', '.join(r for k in layers for r in made[k])})"
    chosen = f"WHEN {b} > 0 AND {length} > 0 THEN {array(geometry.BORDER, geometry.MARK)} WHEN {b} > 0 THEN {array(geometry.BORDER)} WHEN {length} > 0 THEN {array(geometry.MARK)}"
    return f"""FUNCTION rects({_parameters(RECTS)}) RETURNS TABLE (layer INT, part INT, x BIGINT, y BIGINT, w BIGINT, h BIGINT)
RETURN SELECT r.* FROM inline(CASE WHEN NOT ({_given(RECTS)}) THEN NULL {chosen} END) AS r(layer, part, rx, ry, rw, rh)"""


def register_tables(spark: SparkSession) -> None:
    """Makes ``cells`` and ``rects`` known to the session's SQL."""
    for function in (_cells(), _rects()):
        spark.sql(f"CREATE OR REPLACE TEMPORARY {function}")
