"""Sheet geometry: pages, grids, cells, scale windows, resample axes and decoration rectangles.

All of it is column expressions and generators, narrow from the jobs on: a
million jobs plan without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platen.functions import gates
from platen.functions.numbers import A4_CM, cm_to_px, clamp, f32, fdiv, idiv, trunc

BORDER, BLEED, MARK = 2, 3, 4  # layers above background (0) and tiles (1)


def page_size(df: DataFrame) -> DataFrame:
    return df.withColumns({"page_w": cm_to_px(F.lit(A4_CM[0]), F.col("dpi")), "page_h": cm_to_px(F.lit(A4_CM[1]), F.col("dpi"))})


def grid_geometry(jobs: DataFrame) -> DataFrame:
    """jobs -> the same with page_w, page_h, cell_w, cell_h, start_x, start_y, bg_sig.

    The photo keeps its size if the grid fits; else both sides shrink by the
    smaller ratio. No cell is under one pixel. Jobs without columns or rows have
    null cells.
    """
    df = page_size(jobs)
    ask = lambda side: cm_to_px(F.col(f"photo_{side}_cm"), F.col("dpi"))
    n = {"w": F.nullif(F.col("cols"), F.lit(0)), "h": F.nullif(F.col("rows"), F.lit(0))}
    gaps = {s: F.greatest(n[s] - 1, F.lit(0)) * F.col("gap") for s in "wh"}
    avail = {s: F.greatest(F.col(f"page_{s}") - 2 * F.col("padding") - gaps[s], F.lit(1)) for s in "wh"}
    df = df.withColumns({f"_ask_{s}": ask(s) for s in "wh"} | {f"_max_{s}": idiv(avail[s], n[s]) for s in "wh"} | {"_gaps_w": gaps["w"]})
    ratio = {s: F.when(F.col(f"_max_{s}") > 0, fdiv(F.col(f"_max_{s}"), F.col(f"_ask_{s}"))).otherwise(f32(1.0)) for s in "wh"}
    df = df.withColumn("_scale", F.when((F.col("_ask_w") > F.col("_max_w")) | (F.col("_ask_h") > F.col("_max_h")), F.least(ratio["w"], ratio["h"])))
    cell = {f"cell_{s}": F.greatest(F.when(F.col("_scale").isNull(), F.col(f"_ask_{s}")).otherwise(trunc(f32(F.col(f"_ask_{s}")) * F.col("_scale"))), F.lit(1)) for s in "wh"}
    cell = {k: F.when(n["w"].isNotNull() & n["h"].isNotNull(), v) for k, v in cell.items()}
    df = df.withColumns(cell)
    grid_w = F.col("cols") * F.col("cell_w") + F.col("_gaps_w")
    df = df.withColumns(
        {
            "start_x": F.when(F.col("page_w") > grid_w, idiv(F.col("page_w") - grid_w, 2)).otherwise(F.col("padding")),
            "start_y": F.col("padding"),
            "bg_sig": gates.bg_signature(F.col("bg_r"), F.col("bg_g"), F.col("bg_b")),
        }
    )
    return df.drop("_ask_w", "_ask_h", "_max_w", "_max_h", "_gaps_w", "_scale")


def sane_sheets(jobs: DataFrame) -> DataFrame:
    """The sheets of the jobs that may be rendered: of the right version, with a sane grid; mode is an int.

    The generator keeps the gate from being moved into the geometry, whose expressions
    the optimizer would repeat over and over.
    """
    sheets = grid_geometry(jobs.where(gates.abi_gate(F.col("abi_version")) == gates.SUCCESS).where("cols > 0 and rows > 0")).withColumn("mode", F.col("mode").cast("int"))
    sheets = sheets.select(F.inline(F.array(F.struct(*sheets.columns))))
    return sheets.where(gates.grid_sanity(F.col("cols"), F.col("rows"), F.col("gap"), F.col("cell_w"), F.col("cell_h")) == gates.SUCCESS)


def cell_grid(sheets: DataFrame) -> DataFrame:
    """sheets -> cells in row-major order, with the sheet's columns; also those that leave the page."""
    last = lambda c: F.greatest(F.col(c) - 1, F.lit(0))
    full = sheets.where("cols > 0 and rows > 0")
    cells = full.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), last("rows")))).withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), last("cols"))))
    return cells.withColumns(
        {
            "cell_idx": F.col("row") * F.col("cols") + F.col("col"),
            "x": F.col("start_x") + F.col("col") * (F.col("cell_w") + F.col("gap")),
            "y": F.col("start_y") + F.col("row") * (F.col("cell_h") + F.col("gap")),
            "w": F.col("cell_w"),
            "h": F.col("cell_h"),
        }
    )


def placed_cells(cells: DataFrame) -> DataFrame:
    """Cells that lie on the page."""
    return cells.where("x + w <= page_w and y + h <= page_h")


def sheet_coverage(sheets: DataFrame) -> DataFrame:
    """(job_id, cells, placed, coverage): by counting columns and rows that fit, without generating cells."""

    def fit(side: str, count: str, start: str) -> Column:
        room = F.col(f"page_{side}") - F.col(start) - F.col(f"cell_{side}")
        return F.when(room < 0, 0).otherwise(F.least(F.col(count), idiv(F.greatest(room, F.lit(0)), F.col(f"cell_{side}") + F.col("gap")) + 1))

    placed = fit("w", "cols", "start_x") * fit("h", "rows", "start_y")
    return sheets.select("job_id", (F.col("cols") * F.col("rows")).alias("cells"), placed.alias("placed"), ((placed * F.col("cell_w") * F.col("cell_h")) / (F.col("page_w") * F.col("page_h"))).alias("coverage"))


def _scaled(side: str, scale: Column) -> Column:
    return trunc(f32(F.col(f"src_{side}")) * scale)


def fill_window(df: DataFrame) -> DataFrame:
    """(src_w, src_h, cell_w, cell_h) -> scaled size that covers the cell, and the centred crop in it."""
    scale = F.greatest(fdiv(F.col("cell_w"), F.col("src_w")), fdiv(F.col("cell_h"), F.col("src_h")))
    df = df.withColumns({f"scaled_{s}": F.greatest(_scaled(s, scale), F.col(f"cell_{s}")) for s in "wh"})
    return df.withColumns({"off_x": idiv(F.col("scaled_w") - F.col("cell_w"), 2), "off_y": idiv(F.col("scaled_h") - F.col("cell_h"), 2)})


def fit_letterbox(df: DataFrame) -> DataFrame:
    """(src_w, src_h, cell_w, cell_h) -> scaled size that fits the cell, and its centred place."""
    scale = F.least(fdiv(F.col("cell_w"), F.col("src_w")), fdiv(F.col("cell_h"), F.col("src_h")))
    df = df.withColumns({f"scaled_{s}": clamp(_scaled(s, scale), 1, F.col(f"cell_{s}")) for s in "wh"})
    return df.withColumns({"off_x": idiv(F.col("cell_w") - F.col("scaled_w"), 2), "off_y": idiv(F.col("cell_h") - F.col("scaled_h"), 2)})


def axis_table(sizes: DataFrame) -> DataFrame:
    """(frame_id, width, height, new_w, new_h) -> (frame_id, axis, dst, i0, i1, w): 16.16 sampling places."""
    each = sizes.select("frame_id", F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(s).cast("long").alias("src"), F.col(d).cast("long").alias("size")) for a, s, d in (("x", "width", "new_w"), ("y", "height", "new_h"))))).alias("a"))
    each = each.select("frame_id", "a.*").where("src > 0 and size > 0")
    step = F.when((F.col("src") <= 1) | (F.col("size") <= 1), 0).otherwise(idiv(F.shiftleft(F.col("src") - 1, 16), F.greatest(F.col("size") - 1, F.lit(1))))
    at = each.withColumn("step", step).withColumn("dst", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1))).withColumn("pos", F.col("dst") * F.col("step"))
    first = F.shiftright("pos", 16)
    return at.select("frame_id", "axis", "dst", first.alias("i0"), F.least(first + 1, F.col("src") - 1).alias("i1"), F.col("pos").bitwiseAND(F.lit(0xFFFF)).alias("w"))


def _rects(cells: DataFrame, layer: int, boxes: list[tuple[Column, Column, Column, Column]]) -> DataFrame:
    made = F.array(*(F.struct(F.lit(k).alias("part"), x.alias("rx"), y.alias("ry"), w.alias("rw"), h.alias("rh")) for k, (x, y, w, h) in enumerate(boxes)))
    out = cells.select("job_id", F.lit(layer).alias("layer"), "cell_idx", F.explode(made).alias("r"))
    return out.select("job_id", "layer", "cell_idx", F.col("r.part").alias("part"), F.col("r.rx").alias("x"), F.col("r.ry").alias("y"), F.col("r.rw").alias("w"), F.col("r.rh").alias("h"))


def border_boxes() -> list[tuple[Column, Column, Column, Column]]:
    """Of a cell (x, y, w, h, border_px): top, bottom, left, right."""
    x, y, w, h, b = (F.col(c) for c in ("x", "y", "w", "h", "border_px"))
    return [(x, y, w, b), (x, y + h - b, w, b), (x, y, b, h), (x + w - b, y, b, h)]


def border_rects(cells: DataFrame) -> DataFrame:
    """Four rectangles inside each cell: top, bottom, left, right."""
    return _rects(cells.where("border_px > 0"), BORDER, border_boxes())


def mark_boxes() -> list[tuple[Column, Column, Column, Column]]:
    """Of a cell: at each corner (top-left, top-right, bottom-left, bottom-right) one across and one down, outside it."""
    off, length = F.col("crop_offset_px"), F.col("crop_mark_px")
    thick = F.when(F.col("crop_thickness") == 0, 1).otherwise(F.col("crop_thickness"))
    left, right = F.col("x") - off, F.col("x") + F.col("w") + off
    top, bottom = F.col("y") - off, F.col("y") + F.col("h") + off
    boxes = []
    for across_y, down_y in ((top - thick, top - length), (bottom, bottom)):
        boxes += [(left - length, across_y, length, thick), (left - thick, down_y, thick, length), (right, across_y, length, thick), (right, down_y, thick, length)]
    return boxes


def crop_mark_rects(cells: DataFrame) -> DataFrame:
    """Eight rectangles outside each cell, see ``mark_boxes``."""
    return _rects(cells.where("crop_mark_px > 0"), MARK, mark_boxes())


def clip_rects(rects: DataFrame) -> DataFrame:
    """Rectangles (with page_w and page_h beside them) cut to the page; empty ones go."""
    x0, y0 = F.greatest("x", F.lit(0)), F.greatest("y", F.lit(0))
    x1, y1 = F.least(F.col("x") + F.col("w"), "page_w"), F.least(F.col("y") + F.col("h"), "page_h")
    return rects.select(*(c for c in rects.columns if c not in "xywh"), x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h")).where("w > 0 and h > 0")


def bleed_map(cells: DataFrame) -> DataFrame:
    """(job_id, cell_idx, axis, dst, src, bleed_exceeds_gap): where each line of the bleed comes from.

    The source of (x, y) is the nearest pixel of the cell, so the two axes are
    independent and a map of lines stands for the map of pixels.
    """
    cells = cells.where("bleed_px > 0")
    axes = F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).alias("at"), F.col(s).alias("size"), F.col(p).alias("page")) for a, s, p in (("x", "w", "page_w"), ("y", "h", "page_h"))))
    each = cells.select("job_id", "cell_idx", "bleed_px", (F.col("bleed_px") > F.col("gap")).alias("bleed_exceeds_gap"), F.explode(axes).alias("a")).select("*", "a.*")
    each = each.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("bleed_px"))))
    each = each.withColumn("d", F.explode(F.array(F.col("at") - F.col("k"), F.col("at") + F.col("size") - 1 + F.col("k"))))
    return each.where("d >= 0 and d < page").select("job_id", "cell_idx", "axis", F.col("d").alias("dst"), clamp(F.col("d"), F.col("at"), F.col("at") + F.col("size") - 1).alias("src"), "bleed_exceeds_gap")


def pdf_points(px: Column, dpi: Column) -> Column:
    """Pixels as points (1/72 inch) with two decimals, in 32-bit float steps."""
    return F.round(fdiv(f32(px) * f32(72.0), f32(dpi)).cast("double"), 2)


def halve_dims(df: DataFrame) -> DataFrame:
    return df.withColumns({"width": idiv(F.col("width"), 2), "height": idiv(F.col("height"), 2)})
