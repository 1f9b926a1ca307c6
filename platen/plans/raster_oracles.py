"""The queries of tiles and layered sheets in DuckDB's SQL: windows of frames byte by byte, and layers by their highest code on each pixel."""

from __future__ import annotations

from platen.operators.geometry import BLEED, BORDER, MARK
from platen.operators.layers import BACKGROUND, TILE
from platen.plans.catalog import PROOF_DPI, THUMB_DPI, THUMB_LINES
from platen.plans.fixtures import oracle as T
from platen.plans.oracles import cells, f, lines, sheets


def step(src: str, size: str) -> str:
    return f"CASE WHEN {src} > 1 AND {size} > 1 THEN (({src} - 1) << 16) // ({size} - 1) ELSE 0 END"


def tile_pixels(keys: str, frames: str = T("frames")) -> str:
    """(frame_id, cell_w, cell_h, mode, bg) -> the tile's pixels; only the bytes that a pixel is made of are taken from the frame."""
    both = ("w", "width"), ("h", "height")
    scale = ", ".join(f"CAST({f(f'cell_{s}')} / {f(side)} AS FLOAT)" for s, side in both)
    size = {s: f"CAST(trunc({f(side)} * s) AS BIGINT)" for s, side in both}
    sized = ", ".join(f"CASE WHEN mode = 1 THEN greatest({size[s]}, cell_{s}) ELSE least(greatest({size[s]}, 1), cell_{s}) END AS n{s}" for s in "wh")
    place = lambda at, s: f"CASE WHEN mode = 1 THEN {at} + (n{s} - cell_{s}) // 2 ELSE {at} - (cell_{s} - n{s}) // 2 END"
    byte = lambda y, x: f"CAST('0x' || hex(data[{y} * stride + {x} * 3 + c + 1:{y} * stride + {x} * 3 + c + 1]) AS BIGINT)"
    return f"""(SELECT frame_id, cell_w, cell_h, mode, bg, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(c AS INT) AS c, CAST(CASE WHEN dx >= 0 AND dy >= 0 AND dx < nw AND dy < nh
  THEN (({byte('y0', 'x0')} * (65536 - fx) + {byte('y0', 'x1')} * fx) * (65536 - fy) + ({byte('y1', 'x0')} * (65536 - fx) + {byte('y1', 'x1')} * fx) * fy + 2147483648) >> 32
  ELSE (bg >> (16 - 8 * c)) & 255 END AS INT) AS v
 FROM (SELECT *, (dx * kx) >> 16 AS x0, (dy * ky) >> 16 AS y0, least(((dx * kx) >> 16) + 1, width - 1) AS x1, least(((dy * ky) >> 16) + 1, height - 1) AS y1, (dx * kx) & 65535 AS fx, (dy * ky) & 65535 AS fy
 FROM (SELECT *, {place('x', 'w')} AS dx, {place('y', 'h')} AS dy, {step('width', 'nw')} AS kx, {step('height', 'nh')} AS ky, unnest([0, 1, 2]) AS c
 FROM (SELECT *, unnest(range(0, cell_w)) AS x FROM (SELECT *, unnest(range(0, cell_h)) AS y FROM (SELECT *, {sized}
 FROM (SELECT k.*, width, height, stride, data, CASE WHEN mode = 1 THEN greatest({scale}) ELSE least({scale}) END AS s FROM {keys} k JOIN {frames} fr USING (frame_id))))))))"""


def small_tiles(mode: int, bg: str) -> str:
    return tile_pixels(f"(SELECT frame_id, 6 AS cell_w, 4 + frame_id % 3 AS cell_h, {mode} AS mode, {bg} AS bg FROM {T('frames')})")


def scaled(jobs: str, dpi: int, up: tuple[str, ...] = ()) -> str:
    down = [f"{c} * {dpi} // dpi AS {c}" for c in ("gap", "padding")]
    return f"(SELECT * REPLACE ({', '.join([*down, *(f'({c} * {dpi} + dpi - 1) // dpi AS {c}' for c in up)])}, CAST({dpi} AS BIGINT) AS dpi) FROM {T(jobs)})"


DECORATIONS = ("border_px", "bleed_px", "crop_mark_px", "crop_thickness", "crop_offset_px")


def thumbs(jobs: str) -> str:
    return f"(SELECT * FROM {scaled(jobs, THUMB_DPI, DECORATIONS)} WHERE abi_version = 2)"


def covered(jobs: str, layers: tuple[int, ...]) -> str:
    """(job_id, y, x, layer, cell_idx) of every pixel of the layers' rectangles that is on the page."""
    t, o, n, b, e = "CASE WHEN crop_thickness = 0 THEN 1 ELSE crop_thickness END", "crop_offset_px", "crop_mark_px", "border_px", "bleed_px"
    corners = [(f"x - {o} - {{}}", f"y - {o} - {{}}"), (f"x - {o} - {{}}", f"y + h + {o}"), (f"x + w + {o}", f"y - {o} - {{}}"), (f"x + w + {o}", f"y + h + {o}")]
    rects = {
        TILE: ("true", [("x", "y", "w", "h")]),
        BORDER: (f"{b} > 0", [("x", "y", "w", b), ("x", f"y + h - {b}", "w", b), ("x", "y", b, "h"), (f"x + w - {b}", "y", b, "h")]),
        BLEED: (f"{e} > 0", [(f"x - {e}", f"y - {e}", f"w + 2 * {e}", f"h + 2 * {e}")]),
        MARK: (f"{n} > 0", [(cx.format(a), cy.format(d), a, d) for cx, cy in corners for a, d in ((n, t), (t, n))]),
    }
    on_page = f"SELECT * FROM {cells(thumbs(jobs))} WHERE x + w <= page_w AND y + h <= page_h"
    # The bleed's rectangle has the cell in its middle; that isn't bleed.
    parts = [f"SELECT job_id, {k} AS layer, cell_idx, page_w, page_h, x, y, w, h, {rx} AS rx, {ry} AS ry, {rw} AS rw, {rh} AS rh FROM p WHERE {rects[k][0]}" for k in layers for rx, ry, rw, rh in rects[k][1]]
    return f"""(WITH p AS MATERIALIZED ({on_page}) SELECT DISTINCT job_id, py AS y, px AS x, layer, cell_idx
 FROM (SELECT *, unnest(range(greatest(rx, 0), least(rx + rw, page_w))) AS px FROM (SELECT *, unnest(range(greatest(ry, 0), least(ry + rh, page_h))) AS py FROM ({' UNION ALL '.join(parts)})))
 WHERE layer <> {BLEED} OR px < x OR px >= x + w OR py < y OR py >= y + h)"""


def by_lines(jobs: str, layer: int) -> str:
    return f"SELECT job_id, y, count(*) AS n, CAST(sum(x + 1) AS BIGINT) AS digest FROM (SELECT DISTINCT job_id, y, x FROM {covered(jobs, (layer,))}) GROUP BY job_id, y"


#: Of the pixel of a cell that is nearest to (x, y): its column and row, and its place (-1: it lies in the border).
SOURCE_X = "least(greatest(x - start_x - (cell_idx % cols) * (cell_w + gap), 0), cell_w - 1)"
SOURCE_Y = "least(greatest(y - start_y - (cell_idx // cols) * (cell_h + gap), 0), cell_h - 1)"
PLACE = "CASE WHEN border_px > 0 AND (sx < border_px OR sy < border_px OR sx >= cell_w - border_px OR sy >= cell_h - border_px) THEN -1 ELSE sy * cell_w + sx END"


def bleed() -> str:
    top = f"(SELECT job_id, y, x, max(cell_idx) AS cell_idx FROM {covered('jobs', (BLEED,))} GROUP BY ALL)"
    return f"""SELECT job_id, y, count(*) AS n, CAST(sum((x + 1) * (cell_idx + 1)) AS BIGINT) AS owners, CAST(sum((x + 1) * (place + 2)) AS BIGINT) AS digest
 FROM (SELECT *, {PLACE} AS place FROM (SELECT t.*, cell_w, cell_h, border_px, {SOURCE_X} AS sx, {SOURCE_Y} AS sy FROM {top} t JOIN {sheets('s', thumbs('jobs'))} USING (job_id))) GROUP BY job_id, y"""


#: Documents' bytes as raw frames of other widths and strides; those that break the raw contract are no frames.
RAW = """(SELECT frame_id, width, height, 3 AS channels, st AS stride, data
 FROM (SELECT *, CASE WHEN frame_id % 6 = 5 THEN raw ELSE raw || unhex(repeat('00', CAST(height * st - octet_length(raw) AS INT))) END AS data
 FROM (SELECT *, (octet_length(raw) + st - 1) // st AS height
 FROM (SELECT doc_id AS frame_id, encode(text) AS raw, 4 + doc_id % 5 AS width, CASE WHEN doc_id % 3 = 0 THEN (4 + doc_id % 5) * 3 ELSE 12 + doc_id % 7 * 2 END AS st FROM documents WHERE text IS NOT NULL)))
 WHERE height > 0 AND height <= 16384 AND st >= width * 3 AND octet_length(data) = st * height AND width * height <= octet_length(data) * 400)"""


def painted(frames: str) -> str:
    """CTEs whose last, ``coloured``, has every pixel of the thumbnails as six hex digits; a sheet without a frame has background and marks only."""
    plan = sheets("", thumbs("framed_jobs"))
    pages = f"SELECT job_id, py AS y, px AS x, {BACKGROUND} AS layer, 0 AS cell_idx FROM (SELECT *, unnest(range(0, page_w)) AS px FROM (SELECT *, unnest(range(0, page_h)) AS py FROM s))"
    bg = "CASE WHEN mode = 0 THEN bg_sig ELSE -1 END"
    plain = "lpad(hex(bg_sig), 6, '0')"
    colour = f"CASE WHEN layer = {MARK} THEN '000000' WHEN layer = {BACKGROUND} OR tiled IS NULL THEN {plain} WHEN layer = {BORDER} OR l.place = -1 THEN '000000' ELSE rgb END"
    return f"""WITH s AS MATERIALIZED (SELECT *, {bg} AS bg FROM {plan} LEFT JOIN (SELECT DISTINCT frame_id, true AS tiled FROM {frames}) USING (frame_id)),
top AS (SELECT job_id, y, x, max(layer * 1000000 + cell_idx) AS code FROM ({pages} UNION ALL SELECT * FROM {covered('framed_jobs', (TILE, BORDER, BLEED, MARK))}) GROUP BY ALL),
tiles AS (SELECT frame_id, cell_w, cell_h, mode, bg, y * cell_w + x AS place, string_agg(lpad(hex(v), 2, '0'), '' ORDER BY c) AS rgb FROM {tile_pixels('(SELECT DISTINCT frame_id, cell_w, cell_h, mode, bg FROM s)', frames)} GROUP BY ALL),
looked AS (SELECT *, CASE WHEN layer IN ({TILE}, {BLEED}) THEN {PLACE} END AS place FROM (SELECT *, {SOURCE_X} AS sx, {SOURCE_Y} AS sy FROM (SELECT top.job_id, y, x, code // 1000000 AS layer, code % 1000000 AS cell_idx, s.* EXCLUDE (job_id) FROM top JOIN s USING (job_id)))),
coloured AS (SELECT l.job_id, l.y, l.x, page_w, page_h, {colour} AS rgb FROM looked l LEFT JOIN tiles t ON t.frame_id = l.frame_id AND t.cell_w = l.cell_w AND t.cell_h = l.cell_h AND t.mode = l.mode AND t.bg = l.bg AND t.place = l.place)"""


def compose(frames: str = T("frames")) -> str:
    return f"""{painted(frames)}
SELECT job_id, y // {THUMB_LINES} AS band, y // {THUMB_LINES} * {THUMB_LINES} AS y0, page_w AS width, CAST(least({THUMB_LINES}, page_h - y // {THUMB_LINES} * {THUMB_LINES}) AS INT) AS h, sha256(unhex(string_agg(rgb, '' ORDER BY y, x))) AS digest FROM coloured GROUP BY ALL"""


def pdf_export() -> str:
    return f"{painted(T('frames'))} SELECT job_id, page_w AS width, page_h AS height, page_w * page_h * 3 AS n_bytes, sha256(unhex(string_agg(rgb, '' ORDER BY y, x))) AS image_sha256 FROM coloured GROUP BY ALL"


def tile_digests() -> str:
    keys = f"(SELECT DISTINCT frame_id, cell_w, cell_h, mode, CASE WHEN mode = 0 THEN bg_sig ELSE -1 END AS bg FROM {sheets('', scaled('framed_jobs', PROOF_DPI))})"
    return f"SELECT frame_id, cell_w, cell_h, mode, bg, sha256(unhex(string_agg(lpad(hex(v), 2, '0'), '' ORDER BY y, x, c))) AS digest FROM {tile_pixels(keys)} GROUP BY ALL"


ORACLES = {
    "tile_fill": lines(small_tiles(1, "-1")),
    "tile_fit": lines(small_tiles(0, "frame_id * 4099 % 16777216")),
    "tile_digests": tile_digests(),
    "sheet_border": by_lines("jobs", BORDER),
    "sheet_marks": by_lines("jobs", MARK),
    "sheet_bleed": bleed(),
    "sheet_compose": compose(),
    "job_rgb24": compose(RAW),
    "pdf_export": pdf_export(),
}
