"""The queries of the print domain in DuckDB's SQL, written apart from the operators.

Helpers spell out what repeats; they are text, not plans.
"""

from __future__ import annotations

from platen.operators.metrics import BUCKETS
from platen.plans.catalog import PROOF_DPI, RATE  # noqa: F401
from platen.plans.fixtures import oracle as T


def f(x: str) -> str:
    return f"CAST({x} AS FLOAT)"


def px(cm: str, dpi: str = "dpi") -> str:
    return f"CAST(trunc(CAST({f(cm)} * {f(dpi)} / {f('2.54')} AS FLOAT) + {f('0.5')}) AS BIGINT)"


REQUEST = "CASE WHEN {w} = 0 OR {h} = 0 OR {w} > 16384 OR {h} > 16384 OR {s} = 0 THEN 3 WHEN {w} * {h} > {s} * 400 THEN 3 ELSE 0 END"
NAMES = "CASE {c} WHEN 0 THEN 'IMG_SUCCESS' WHEN 1 THEN 'IMG_ERR_NOMEM' WHEN 2 THEN 'IMG_ERR_FORMAT' WHEN 3 THEN 'IMG_ERR_SECURITY' WHEN 4 THEN 'IMG_ERR_IO' WHEN 5 THEN 'IMG_ERR_HW_UNSUP' WHEN 6 THEN 'IMG_ERR_INTERNAL' ELSE 'IMG_ERR_UNKNOWN' END"
U32 = "CASE WHEN regexp_full_match({c}, '[0-9]{{1,18}}') AND TRY_CAST({c} AS BIGINT) <= 4294967295 THEN TRY_CAST({c} AS BIGINT) END"
FLOAT = "CASE WHEN regexp_full_match({c}, '([0-9]+([.][0-9]*)?|[.][0-9]+)') THEN TRY_CAST({c} AS FLOAT) END"


def u32(c: str) -> str:
    return U32.format(c=c)


def sheets(source: str = "", jobs: str | None = None) -> str:
    """The grid of each job, step by step."""
    jobs = jobs or T("jobs")
    return f"""(SELECT *, CASE WHEN page_w > cols * cell_w + gaps_w THEN (page_w - cols * cell_w - gaps_w) // 2 ELSE padding END AS start_x, padding AS start_y, bg_r * 65536 + bg_g * 256 + bg_b AS bg_sig
 FROM (SELECT *, greatest(CASE WHEN s IS NULL THEN ask_w ELSE CAST(trunc({f('ask_w')} * s) AS BIGINT) END, 1) AS cell_w, greatest(CASE WHEN s IS NULL THEN ask_h ELSE CAST(trunc({f('ask_h')} * s) AS BIGINT) END, 1) AS cell_h
 FROM (SELECT *, CASE WHEN ask_w > max_w OR ask_h > max_h THEN least(CASE WHEN max_w > 0 THEN CAST({f('max_w')} / {f('ask_w')} AS FLOAT) ELSE {f('1')} END, CASE WHEN max_h > 0 THEN CAST({f('max_h')} / {f('ask_h')} AS FLOAT) ELSE {f('1')} END) END AS s
 FROM (SELECT *, greatest(page_w - 2 * padding - gaps_w, 1) // cols AS max_w, greatest(page_h - 2 * padding - gaps_h, 1) // rows AS max_h
 FROM (SELECT *, {px('21.0')} AS page_w, {px('29.7')} AS page_h, {px('photo_w_cm')} AS ask_w, {px('photo_h_cm')} AS ask_h, (cols - 1) * gap AS gaps_w, (rows - 1) * gap AS gaps_h FROM {jobs}))))) {source}"""


def cells(jobs: str | None = None) -> str:
    return f"""(SELECT *, "row" * cols + col AS cell_idx, start_x + col * (cell_w + gap) AS x, start_y + "row" * (cell_h + gap) AS y, cell_w AS w, cell_h AS h
 FROM (SELECT *, unnest(range(0, cols)) AS col FROM (SELECT *, unnest(range(0, rows)) AS "row" FROM {sheets(jobs=jobs)})))"""


def placed() -> str:
    return f"(SELECT * FROM {cells()} WHERE x + w <= page_w AND y + h <= page_h)"


TEMPLATES = """(VALUES (1, 'passport-45x35', '4.5 x 3.5 cm, 6x6 grid, border 2px, bleed 1px, crop 5px', CAST(4.5 AS FLOAT), CAST(3.5 AS FLOAT)), (2, 'passport-38x35', '3.8 x 3.5 cm, 6x6 grid, border 2px, bleed 1px, crop 5px', CAST(3.8 AS FLOAT), CAST(3.5 AS FLOAT)),
 (3, 'printready-6x6', '6x6 print sheet, border 2px, bleed 1px, crop 5px', NULL, NULL)) t(t_id, name, description, t_w, t_h)"""
PRESET = "CASE preset WHEN 'passport-45x35' THEN 1 WHEN 'passport-45x35-printready' THEN 1 WHEN 'passport-38x35' THEN 2 WHEN 'passport-38x35-printready' THEN 2 WHEN 'printready-6x6' THEN 3 END"
SHEET = {"cols": 6, "rows": 6, "gap": 15, "padding": 20, "border_px": 2, "bleed_px": 1, "crop_mark_px": 5, "crop_thickness": 10, "crop_offset_px": 5, "mode": 1}


def templated(columns: str = "*") -> str:
    layout = ", ".join(f"CASE WHEN t_id IS NULL THEN {c} ELSE {v} END AS {c}" for c, v in SHEET.items())
    return f"(SELECT * REPLACE (coalesce(t_id, 0) AS template_id, coalesce(t_w, photo_w_cm) AS photo_w_cm, coalesce(t_h, photo_h_cm) AS photo_h_cm, {layout}, CASE WHEN t_id IS NULL THEN bg_r ELSE 255 END AS bg_r, CASE WHEN t_id IS NULL THEN bg_g ELSE 255 END AS bg_g) FROM {T('jobs')} j LEFT JOIN {TEMPLATES} ON template_id = t_id)"


SIZES = f"(SELECT frame_id, width, height, 6 AS new_w, greatest(1, height // 2) AS new_h FROM {T('frames')})"


def axis(which: str, src: str, size: str, sizes: str = SIZES) -> str:
    return f"""(SELECT frame_id, '{which}' AS axis, dst, (dst * step) >> 16 AS i0, least(((dst * step) >> 16) + 1, {src} - 1) AS i1, (dst * step) & 65535 AS w
 FROM (SELECT *, CASE WHEN {src} <= 1 OR {size} <= 1 THEN 0 ELSE (({src} - 1) * 65536) // ({size} - 1) END AS step, unnest(range(0, {size})) AS dst FROM {sizes}))"""


AX, AY = axis("x", "width", "new_w"), axis("y", "height", "new_h")
DIGEST = "count(*) AS n, CAST(sum(v * (x * 3 + c + 1)) AS BIGINT) AS digest"


def lines(pixels: str) -> str:
    return f"SELECT frame_id, y, {DIGEST} FROM {pixels} GROUP BY frame_id, y"


def bilinear(ax: str = AX, ay: str = AY) -> str:
    return f"""(SELECT ax.frame_id, CAST(ay.dst AS INT) AS y, CAST(ax.dst AS INT) AS x, p.c,
 CAST(((p.v * (65536 - ax.w) + q.v * ax.w) * (65536 - ay.w) + (r.v * (65536 - ax.w) + s.v * ax.w) * ay.w + 2147483648) >> 32 AS INT) AS v
 FROM {ax} ax JOIN {ay} ay USING (frame_id)
 JOIN {T('pixels')} p ON p.frame_id = ax.frame_id AND p.x = ax.i0 AND p.y = ay.i0
 JOIN {T('pixels')} q ON q.frame_id = ax.frame_id AND q.x = ax.i1 AND q.y = ay.i0 AND q.c = p.c
 JOIN {T('pixels')} r ON r.frame_id = ax.frame_id AND r.x = ax.i0 AND r.y = ay.i1 AND r.c = p.c
 JOIN {T('pixels')} s ON s.frame_id = ax.frame_id AND s.x = ax.i1 AND s.y = ay.i1 AND s.c = p.c)"""


BILINEAR = bilinear()


def tile_sizes(pick: str) -> str:
    """Each frame's scaled size for its tile, and the tile's place: 'greatest' covers the cell, 'least' fits in it."""
    scale = f"{pick}(CAST({f('cell_w')} / {f('width')} AS FLOAT), CAST({f('cell_h')} / {f('height')} AS FLOAT))"
    bound = (lambda size, cell: f"greatest({size}, {cell})") if pick == "greatest" else (lambda size, cell: f"least(greatest({size}, 1), {cell})")
    scaled = lambda side: bound(f"CAST(trunc({f(side)} * {scale}) AS BIGINT)", "cell_w" if side == "width" else "cell_h")
    return f"(SELECT *, {scaled('width')} AS new_w, {scaled('height')} AS new_h FROM (SELECT frame_id, width, height, 6 AS cell_w, 4 + frame_id % 3 AS cell_h FROM {T('frames')}))"


def tile(pick: str) -> str:
    sizes = tile_sizes(pick)
    scaled = bilinear(axis("x", "width", "new_w", sizes), axis("y", "height", "new_h", sizes))
    if pick == "greatest":
        return f"""(SELECT frame_id, CAST(y - (new_h - cell_h) // 2 AS INT) AS y, CAST(x - (new_w - cell_w) // 2 AS INT) AS x, c, v FROM {scaled} JOIN {sizes} USING (frame_id)
 WHERE y >= (new_h - cell_h) // 2 AND y < (new_h - cell_h) // 2 + cell_h AND x >= (new_w - cell_w) // 2 AND x < (new_w - cell_w) // 2 + cell_w)"""
    return f"""(SELECT k.frame_id, CAST(k.y AS INT) AS y, k.x, k.c, coalesce(b.v, (k.frame_id * 4099 % 16777216 // CAST(65536 / power(256, k.c) AS BIGINT)) % 256) AS v
 FROM (SELECT *, unnest([0, 1, 2]) AS c FROM (SELECT *, unnest(range(0, cell_w)) AS x FROM (SELECT *, unnest(range(0, cell_h)) AS y FROM {sizes}))) k
 LEFT JOIN {scaled} b ON b.frame_id = k.frame_id AND b.c = k.c AND b.y = k.y - (cell_h - new_h) // 2 AND b.x = k.x - (cell_w - new_w) // 2)"""


def pixel(v: str) -> str:
    return lines(f"(SELECT * REPLACE (CAST({v} AS INT) AS v) FROM {T('pixels')})")


OPS = T("pipeline_ops")
SAFE = "count(*) BETWEEN 1 AND 32 AND bool_and(op_code BETWEEN 1 AND 4095)"
KNOWN = "(VALUES (1, 'resize'), (3, 'grayscale'), (16, 'resize_h'), (17, 'resize_v')) k(code, op_name)"
FUSED = """(SELECT pipeline_id, bool_or(op_code = 3) AS has_gray, bool_or(op_code = 4) AS has_bright, bool_or(op_code = 1) AS has_resize,
 arg_max(brightness, op_index) FILTER (op_code = 4) AS brightness, arg_max(new_w, op_index) FILTER (op_code = 1) AS new_w, arg_max(new_h, op_index) FILTER (op_code = 1) AS new_h FROM {ops} GROUP BY pipeline_id)""".format(ops=OPS)


def stats(source: str, by: str) -> str:
    pick = lambda p: f"max(ns) FILTER (r = CAST(floor({p} * (n - 1) + 0.5) AS BIGINT))"
    return f"""(SELECT {by}, any_value(n) AS n, CAST(trunc(CAST(sum(ns) AS DOUBLE) / any_value(n)) AS BIGINT) AS avg_ns, {pick(0.5)} AS p50_ns, {pick(0.95)} AS p95_ns, {pick(0.99)} AS p99_ns, min(ns) AS min_ns, max(ns) AS max_ns
 FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY ns) - 1 AS r, count(*) OVER (PARTITION BY {by}) AS n FROM {source}) GROUP BY {by})"""


def with_rate(source: str, by: str) -> str:
    return f"SELECT *, round(CASE WHEN avg_ns > 0 THEN 1e9 / avg_ns ELSE 0 END, 6) AS throughput FROM {stats(source, by)}"


SAMPLES, LIFE, HTTP = T("latency_samples"), T("lifecycle"), T("http_requests")
CORES = f"(SELECT core_id, count(*) AS requests, CAST(sum(ns) AS BIGINT) AS cycles, max(ns) AS max_ns, min(ns) AS min_ns FROM {SAMPLES} GROUP BY core_id)"
ROLLUP = f"(SELECT CAST(sum(requests) AS BIGINT) AS total, CAST(CASE WHEN sum(requests) > 0 THEN sum(cycles) // sum(requests) ELSE 0 END AS BIGINT) AS avg_ns, max(max_ns) AS max_ns FROM {CORES})"
SOURCES = sheets("", f"(SELECT *, 8 + frame_id % 4000 AS src_w, 8 + job_id % 3000 AS src_h FROM {T('jobs')})")
SX, SY = f"CAST({f('cell_w')} / {f('src_w')} AS FLOAT)", f"CAST({f('cell_h')} / {f('src_h')} AS FLOAT)"
SIGNED = ["template_id", "abi_version", "CAST(round(CAST(photo_w_cm AS DOUBLE) * 1000) AS BIGINT)", "CAST(round(CAST(photo_h_cm AS DOUBLE) * 1000) AS BIGINT)", "dpi", "cols", "rows", "gap", "padding", "border_px", "bleed_px", "crop_mark_px", "crop_thickness", "crop_offset_px", "mode", "bg_sig", "cell_w", "cell_h"]
SIGNATURE = f"list_reduce([{', '.join(f'CAST({v} AS BIGINT)' for v in ['frame_id & 4294967295', *SIGNED])}], lambda a, v: xor(a, (v + 2654435769 + (a << 6) + (a >> 2)) & 4294967295))"
MARK_X = "x - crop_offset_px - crop_mark_px"
MARKS = """(SELECT *, unnest([
 {part: 0, rx: x - o - l, ry: y - o - t, rw: l, rh: t}, {part: 1, rx: x - o - t, ry: y - o - l, rw: t, rh: l}, {part: 2, rx: x + w + o, ry: y - o - t, rw: l, rh: t}, {part: 3, rx: x + w + o, ry: y - o - l, rw: t, rh: l},
 {part: 4, rx: x - o - l, ry: y + h + o, rw: l, rh: t}, {part: 5, rx: x - o - t, ry: y + h + o, rw: t, rh: l}, {part: 6, rx: x + w + o, ry: y + h + o, rw: l, rh: t}, {part: 7, rx: x + w + o, ry: y + h + o, rw: t, rh: l}]) AS r
 FROM (SELECT *, crop_offset_px AS o, crop_mark_px AS l, CASE WHEN crop_thickness = 0 THEN 1 ELSE crop_thickness END AS t FROM """ + placed() + """ WHERE crop_mark_px > 0))"""
BORDERS = """(SELECT *, unnest([{part: 0, rx: x, ry: y, rw: w, rh: b}, {part: 1, rx: x, ry: y + h - b, rw: w, rh: b}, {part: 2, rx: x, ry: y, rw: b, rh: h}, {part: 3, rx: x + w - b, ry: y, rw: b, rh: h}]) AS r
 FROM (SELECT *, border_px AS b FROM """ + placed() + """ WHERE border_px > 0))"""
AREAS = "SELECT job_id, CAST(r.part AS INT) AS part, count(*) AS rects, CAST(sum(r.rx) AS BIGINT) AS x, CAST(sum(r.ry) AS BIGINT) AS y, CAST(sum(r.rw * r.rh) AS BIGINT) AS area FROM {0} GROUP BY ALL"
R_SIZE = "CASE WHEN req_id % 2 = 0 THEN st * height ELSE file_size END"
SERVICE_ROUND = "round({0}, 6) AS {0}"

ORACLES = {
    "request_gate": f"SELECT req_id, c AS result, {NAMES.format(c='c')} AS result_name FROM (SELECT req_id, {REQUEST.format(w='width', h='height', s='file_size')} AS c FROM {T('image_requests')})",
    "header_gate": f"SELECT req_id, CASE WHEN width = 0 OR height = 0 THEN 2 WHEN width > 16384 OR height > 16384 THEN 3 WHEN channels = 0 OR channels > 4 THEN 2 ELSE 0 END AS result FROM {T('image_requests')}",
    "encoded_file_gate": f"SELECT req_id, CASE WHEN file_size >= 671089 THEN 0 ELSE 3 END AS result FROM {T('image_requests')}",
    "raw_process_gate": f"SELECT req_id, CASE WHEN file_size >= 41944 THEN 0 ELSE 3 END AS result FROM {T('image_requests')}",
    "rgb24_contract": f"SELECT req_id, CASE WHEN width = 0 OR height = 0 OR st < 3 * width OR st * height <> sz THEN 3 ELSE {REQUEST.format(w='width', h='height', s='sz')} END AS result FROM (SELECT *, {R_SIZE} AS sz FROM (SELECT *, CASE WHEN channels < 3 OR width = 0 THEN width * 3 ELSE width * channels END AS st FROM {T('image_requests')}))",
    "capacity_admission": f"SELECT CASE WHEN width * height * 3 > 33554432 THEN 1 ELSE 0 END AS result, count(*) AS requests, max(width * height * 3) AS max_bytes FROM {T('image_requests')} GROUP BY 1",
    "resize_admission": f"SELECT req_id, CASE WHEN width % 7 = 0 OR height % 5 = 0 THEN 3 WHEN width = 0 OR height = 0 OR channels < 3 THEN 2 ELSE 0 END AS result FROM {T('image_requests')}",
    "option_text_parse": f"SELECT job_id, {u32('opt_cols')} AS cols, {u32('opt_gap')} AS gap, {FLOAT.format(c='opt_width')} AS width_cm, CASE opt_mode WHEN 'fit' THEN 0 WHEN 'fill' THEN 1 END AS mode, CASE input_format WHEN 'encoded' THEN 0 WHEN 'raw-rgb24' THEN 1 END AS input_format FROM {T('job_options')}",
    "option_cross_check": f"""SELECT job_id, CASE WHEN (opt_cols IS NOT NULL AND {u32('opt_cols')} IS NULL) OR (opt_gap IS NOT NULL AND {u32('opt_gap')} IS NULL) OR (opt_width IS NOT NULL AND {FLOAT.format(c='opt_width')} IS NULL) OR opt_mode NOT IN ('fit', 'fill')
 OR (input_width IS NOT NULL AND {u32('input_width')} IS NULL) OR (input_stride IS NOT NULL AND {u32('input_stride')} IS NULL) THEN 'bad_value' WHEN input_format NOT IN ('encoded', 'raw-rgb24') THEN 'bad_format'
 WHEN input_format = 'raw-rgb24' AND coalesce(CAST(input_width AS BIGINT), 0) = 0 THEN 'raw_needs_dimensions' WHEN input_format = 'raw-rgb24' AND CAST(input_stride AS BIGINT) <> 0 AND CAST(input_stride AS BIGINT) < 3 * CAST(input_width AS BIGINT) THEN 'stride_too_small'
 WHEN input_format = 'encoded' AND (input_width IS NOT NULL OR input_stride IS NOT NULL) THEN 'dimensions_without_raw' END AS error FROM {T('job_options')}""",
    "grid_sanity": f"SELECT job_id, CASE WHEN cols = 0 OR rows = 0 OR gap + cell_w > 4294967295 OR gap + cell_h > 4294967295 THEN 3 ELSE 0 END AS result FROM {sheets()}",
    "abi_gate": f"SELECT CASE WHEN abi_version = 2 THEN 0 ELSE 6 END AS result, count(*) AS jobs FROM {T('jobs')} GROUP BY 1",
    "api_key_accept": f"SELECT request_id, client FROM {HTTP} WHERE api_key IN ('test-key-123')",
    "api_key_reject": f"SELECT request_id, client FROM {HTTP} WHERE api_key NOT IN ('test-key-123')",
    "job_defaults": f"SELECT job_id, coalesce({u32('opt_cols')}, 2) AS cols, coalesce({u32('opt_gap')}, 15) AS gap, CAST(3 AS BIGINT) AS rows, CAST(300 AS BIGINT) AS dpi, CAST(20 AS BIGINT) AS padding, CAST(10 AS BIGINT) AS bleed_px, CAST(20 AS BIGINT) AS crop_mark_px, CAST(4.5 AS FLOAT) AS photo_w_cm FROM {T('job_options')}",
    "template_apply": f"SELECT job_id, CAST(template_id AS INT) AS template_id, photo_w_cm, photo_h_cm, dpi, CAST(cols AS BIGINT) AS cols, CAST(rows AS BIGINT) AS rows, CAST(gap AS BIGINT) AS gap, CAST(padding AS BIGINT) AS padding, CAST(border_px AS BIGINT) AS border_px, CAST(bleed_px AS BIGINT) AS bleed_px, CAST(crop_mark_px AS BIGINT) AS crop_mark_px, CAST(crop_thickness AS BIGINT) AS crop_thickness, CAST(crop_offset_px AS BIGINT) AS crop_offset_px, CAST(mode AS INT) AS mode, CAST(bg_r AS INT) AS bg_r FROM {templated()}",
    "template_lookup": f"SELECT job_id, preset, CAST({PRESET} AS INT) AS template_id FROM {T('job_options')}",
    "template_describe": f"SELECT template_id, coalesce(name, 'custom') AS name, coalesce(description, 'user-defined layout') AS description, count(*) AS jobs FROM {T('jobs')} LEFT JOIN {TEMPLATES} ON template_id = t_id GROUP BY ALL",
    "override_merge": f"""SELECT job_id, coalesce(p, 0) AS template_id, coalesce({u32('opt_cols')}, CASE WHEN p IS NULL THEN 2 ELSE 6 END) AS cols, CAST(CASE WHEN p IS NULL THEN 3 ELSE 6 END AS BIGINT) AS rows, coalesce({u32('opt_gap')}, 15) AS gap,
 coalesce({FLOAT.format(c='opt_width')}, CAST(CASE p WHEN 2 THEN 3.8 ELSE 4.5 END AS FLOAT)) AS photo_w_cm, CAST(3.5 AS FLOAT) AS photo_h_cm, CAST(CASE WHEN p IS NULL THEN 10 ELSE 1 END AS BIGINT) AS bleed_px, CAST(CASE opt_mode WHEN 'fit' THEN 0 ELSE 1 END AS BIGINT) AS mode FROM (SELECT *, {PRESET} AS p FROM {T('job_options')})""",
    "registry_resolve": f"SELECT job_id, CAST(job_id % 6 AS INT) AS template_id, CASE WHEN job_id % 6 <= 3 THEN 0 ELSE 2 END AS result FROM {T('jobs')}",
    "service_payload": f"SELECT job_id, coalesce({u32('opt_cols')}, 6) AS cols, CAST(6 AS BIGINT) AS rows, coalesce({u32('opt_gap')}, 15) AS gap, coalesce({FLOAT.format(c='opt_width')}, CAST(4.5 AS FLOAT)) AS photo_w_cm, CAST(0 AS BIGINT) AS bleed_px, CAST(15 AS BIGINT) AS crop_mark_px FROM {T('job_options')}",
    "output_routing": f"SELECT output_path, CASE WHEN lower(output_path) LIKE '%.pdf' THEN 'pdf' ELSE 'raster' END AS kind, count(*) AS jobs FROM {T('job_options')} GROUP BY ALL",
    "render_signature": f"SELECT job_id, {SIGNATURE} AS signature FROM {sheets()}",
    "render_dedupe": f"SELECT frame_id, cell_w, cell_h, mode, CAST(CASE WHEN mode = 0 THEN bg_sig ELSE -1 END AS BIGINT) AS bg, count(*) AS jobs, min(job_id) AS first_job FROM {sheets()} GROUP BY ALL",
    "job_paths": f"SELECT job_id, '/data/uploads/' || job_id || '_photo-' || coalesce(preset, 'none') || '.jpg' AS input_path, '/data/outputs/' || job_id || '.png' AS output_path FROM {T('job_options')}",
    "job_status_lookup": f"SELECT j.job_id, s.status FROM {T('jobs')} j LEFT JOIN (SELECT job_id, status FROM {LIFE} QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) = 1) s USING (job_id)",
    "cm_to_px_sizes": f"SELECT job_id, {px('photo_w_cm')} AS w, {px('photo_h_cm')} AS h FROM {T('jobs')}",
    "grid_geometry": f"SELECT job_id, page_w, page_h, cell_w, cell_h, start_x, start_y FROM {sheets()}",
    "cell_grid": f'SELECT job_id, cell_idx, "row", col, x, y, w, h FROM {cells()}',
    "placed_cells": f"SELECT job_id, count(*) AS placed, max(x + w) AS \"right\", max(y + h) AS bottom FROM {placed()} GROUP BY job_id",
    "sheet_coverage": f"SELECT s.job_id, s.cols * s.rows AS cells, coalesce(p.n, 0) AS placed, round(coalesce(p.n, 0) * s.cell_w * s.cell_h / (s.page_w * s.page_h), 9) AS coverage FROM {sheets('s')} LEFT JOIN (SELECT job_id, count(*) AS n FROM {placed()} GROUP BY 1) p USING (job_id)",
    "template_coverage": f"""SELECT CAST(template_id AS INT) AS template_id, count(*) AS jobs, CAST(sum(n) AS BIGINT) AS placed, max(cell_w) AS max_cell_w, max(cell_h) AS max_cell_h, round(avg(n * cell_w * cell_h / (page_w * page_h)), 9) AS coverage
 FROM (SELECT job_id, template_id, cell_w, cell_h, page_w, page_h, count(*) FILTER (x + w <= page_w AND y + h <= page_h) AS n FROM {cells(templated())} GROUP BY ALL) GROUP BY 1""",
    "fill_window": f"SELECT job_id, scaled_w, scaled_h, (scaled_w - cell_w) // 2 AS off_x, (scaled_h - cell_h) // 2 AS off_y FROM (SELECT *, greatest(CAST(trunc({f('src_w')} * greatest({SX}, {SY})) AS BIGINT), cell_w) AS scaled_w, greatest(CAST(trunc({f('src_h')} * greatest({SX}, {SY})) AS BIGINT), cell_h) AS scaled_h FROM {SOURCES})",
    "fit_letterbox": f"SELECT job_id, scaled_w, scaled_h, (cell_w - scaled_w) // 2 AS off_x, (cell_h - scaled_h) // 2 AS off_y FROM (SELECT *, greatest(least(CAST(trunc({f('src_w')} * least({SX}, {SY})) AS BIGINT), cell_w), 1) AS scaled_w, greatest(least(CAST(trunc({f('src_h')} * least({SX}, {SY})) AS BIGINT), cell_h), 1) AS scaled_h FROM {SOURCES})",
    "axis_tables": f"SELECT frame_id, axis, count(*) AS places, CAST(sum(i0 * (dst + 1)) AS BIGINT) AS first_sum, CAST(max(i1) AS BIGINT) AS \"last\", CAST(sum(w) AS BIGINT) AS weight_sum FROM (SELECT * FROM {AX} UNION ALL SELECT * FROM {AY}) GROUP BY ALL",
    "border_rects": AREAS.format(BORDERS),
    "crop_mark_rects": AREAS.format(MARKS),
    "clip_rects": f"SELECT job_id, count(*) AS rects, CAST(sum(cw * ch) AS BIGINT) AS area, min(cx) AS \"left\" FROM (SELECT job_id, greatest(r.rx, 0) AS cx, least(r.rx + r.rw, page_w) - greatest(r.rx, 0) AS cw, least(r.ry + r.rh, page_h) - greatest(r.ry, 0) AS ch FROM {MARKS}) WHERE cw > 0 AND ch > 0 GROUP BY job_id",
    "bleed_map": f"""SELECT job_id, axis, count(*) AS lines, CAST(sum(dst) AS BIGINT) AS dst_sum, CAST(sum(CASE WHEN dst < lo THEN lo WHEN dst > hi THEN hi ELSE dst END) AS BIGINT) AS src_sum, bool_or(bleed_px > gap) AS exceeds
 FROM (SELECT *, unnest(range(lo - bleed_px, lo) || range(hi + 1, hi + 1 + bleed_px)) AS dst FROM (SELECT *, 'x' AS axis, x AS lo, x + w - 1 AS hi, page_w AS page FROM {placed()} UNION ALL SELECT *, 'y', y, y + h - 1, page_h FROM {placed()}) WHERE bleed_px > 0) WHERE dst >= 0 AND dst < page GROUP BY ALL""",
    "pdf_points": f"SELECT dpi, round(CAST(CAST({f(px('21.0'))} * {f('72')} / {f('dpi')} AS FLOAT) AS DOUBLE), 2) AS w_pt, round(CAST(CAST({f(px('29.7'))} * {f('72')} / {f('dpi')} AS FLOAT) AS DOUBLE), 2) AS h_pt, count(*) AS jobs FROM {T('jobs')} GROUP BY ALL",
    "bg_signature": f"SELECT job_id, CAST(bg_r * 65536 + bg_g * 256 + bg_b AS BIGINT) AS bg_sig FROM {T('jobs')}",
    "crop_admission": f"SELECT req_id, req_id % 9000 + req_id % 8000 <= width AND file_size % 9000 + file_size % 7000 <= height AS ok FROM {T('image_requests')}",
    "halve_dims": f"SELECT req_id, width // 2 AS width, height // 2 AS height FROM {T('image_requests')}",
    "pipeline_safety": f"SELECT pipeline_id, {SAFE} AS ok FROM {OPS} GROUP BY 1",
    "pipeline_append_limit": f"SELECT pipeline_id, op_index, rank() OVER (PARTITION BY pipeline_id ORDER BY op_index) <= 4 AS accepted FROM {OPS}",
    "resolve_strict": f"SELECT pipeline_id, count(*) AS ops, count(code) AS resolved, CASE WHEN NOT ({SAFE}) THEN 3 WHEN count(*) <> count(code) THEN 2 ELSE 0 END AS result FROM {OPS} LEFT JOIN {KNOWN} ON op_code = code GROUP BY 1",
    "resolve_lenient": f"SELECT pipeline_id, op_index, op_code, op_name FROM {OPS} JOIN {KNOWN} ON op_code = code",
    "pipeline_signature": f"SELECT pipeline_id, CAST(bit_or(CASE op_code WHEN 3 THEN 1 WHEN 4 THEN 2 WHEN 1 THEN 4 ELSE 0 END) AS INT) AS signature FROM {OPS} GROUP BY 1",
    "fuse_params": f"SELECT * FROM {FUSED}",
    "named_pipelines": f"""SELECT pipeline, CAST(code AS BIGINT) AS code, CAST(op_index AS BIGINT) AS op_index, op, CAST(CASE WHEN op = 'crop' THEN 6 ELSE a END AS BIGINT) AS a, CAST(CASE op WHEN 'resize' THEN 4096 WHEN 'crop' THEN crop_rows END AS BIGINT) AS b, coalesce(u.n, 0) AS used_by
 FROM (VALUES ('photo_6x6', 4096, 6), ('photo_6x3', 4097, 3), ('photo_6x1', 4098, 1), ('passport_45x35', 4099, 6), ('printready_6x6', 4100, 6)) p(pipeline, code, crop_rows), (VALUES (1, 'resize', 4096), (2, 'crop', 6), (3, 'border', 2), (4, 'padding', 20)) o(op_index, op, a)
 LEFT JOIN (SELECT op_code, count(DISTINCT pipeline_id) AS n FROM {OPS} GROUP BY 1) u ON u.op_code = code""",
    "resize_bilinear": lines(BILINEAR),
    "resize_bilinear_batch": lines(BILINEAR),
    "cells_table_function": f'SELECT job_id, cell_idx, "row", col, x, y, w, h FROM {cells()}',
    "resize_h": lines(f"(SELECT p.* REPLACE (CAST(a.dst AS INT) AS x) FROM {T('pixels')} p JOIN {AX} a ON a.frame_id = p.frame_id AND a.i0 = p.x)"),
    "resize_v": lines(f"(SELECT p.* REPLACE (CAST(a.dst AS INT) AS y) FROM {T('pixels')} p JOIN {AY} a ON a.frame_id = p.frame_id AND a.i0 = p.y)"),
    "grayscale": lines(f"(SELECT frame_id, y, x, unnest([0, 1, 2]) AS c, v FROM (SELECT frame_id, y, x, CAST(sum(v * CASE c WHEN 0 THEN 77 WHEN 1 THEN 150 ELSE 29 END) AS BIGINT) >> 8 AS v FROM {T('pixels')} GROUP BY ALL))"),
    "uniform_gray": pixel("(v * 77) >> 8"),
    "brightness": pixel("least(v + frame_id % 300, 255)"),
    "normalise": pixel("v >> 1"),
    "fused_chain": lines(f"(SELECT p.* REPLACE (CAST(CASE WHEN has_bright THEN least(CASE WHEN has_gray THEN (v * 77) >> 8 ELSE v END + coalesce(brightness, 0), 255) WHEN has_gray THEN (v * 77) >> 8 ELSE v END AS INT) AS v) FROM {T('pixels')} p JOIN {FUSED} q ON pipeline_id = frame_id)"),
    "crop": lines(f"""(SELECT frame_id, CASE WHEN ok THEN y - cy ELSE y END AS y, CASE WHEN ok THEN x - 1 ELSE x END AS x, c, v FROM (SELECT *, 1 + cw <= 8 AND cy + 3 <= height AS ok FROM (SELECT p.*, CAST(p.frame_id % 5 AS INT) AS cy, 2 + p.frame_id % 8 AS cw, height FROM {T('pixels')} p JOIN {T('frames')} q USING (frame_id)))
 WHERE NOT ok OR (x >= 1 AND x < 1 + cw AND y >= cy AND y < cy + 3))"""),
    "planar": lines(T("pixels")),
    "pixel_lines": pixel("least(((v * 77) >> 8) + 40, 255) >> 1"),
    "roundtrip_export": f"SELECT frame_id, sha256(encode('P6' || chr(10) || width || ' ' || height || chr(10) || '255' || chr(10)) || data) AS file_sha256, TRUE AS same FROM {T('frames')}",
    "core_metrics": f"SELECT * FROM {CORES}",
    "metrics_rollup": f"SELECT * FROM {ROLLUP}",
    "prometheus_text": f"SELECT CAST(0 AS BIGINT) AS line_no, 'img_requests_total ' || total AS line FROM {ROLLUP} UNION ALL SELECT 1, 'img_latency_avg ' || avg_ns FROM {ROLLUP} UNION ALL SELECT 2, 'img_latency_max ' || max_ns FROM {ROLLUP}",
    "latency_stats": with_rate(SAMPLES, "stage"),
    "sweep_stats": with_rate(SAMPLES, "quality, subsamp"),
    "decoder_stats": f"""SELECT stage, any_value(n) AS n, CAST(sum(ns) // any_value(n) AS BIGINT) AS avg_ns, max(ns) FILTER (r = n * 50 // 100) AS p50_ns, max(ns) FILTER (r = n * 99 // 100) AS p99_ns, min(ns) AS min_ns, max(ns) AS max_ns
 FROM (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY ns) - 1 AS r, count(*) OVER (PARTITION BY stage) AS n FROM {SAMPLES}) GROUP BY stage""",
    "run_report": f"SELECT count(*) AS runs, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed, round(avg(ns) FILTER (success), 3) AS avg_ns, round(count(*) FILTER (success) / 60.0, 6) AS throughput FROM {SAMPLES}",
    "scorecard": f"""SELECT stage, "check", round(measured, 6) AS measured, CASE WHEN ("check" = 'throughput' AND measured >= 100000) OR ("check" <> 'throughput' AND measured <= 2) THEN 'PASS' ELSE 'FAIL' END AS verdict
 FROM (SELECT stage, 'avg_ms' AS "check", avg_ns / 1e6 AS measured FROM {stats(SAMPLES, 'stage')} UNION ALL SELECT stage, 'p99_ms', p99_ns / 1e6 FROM {stats(SAMPLES, 'stage')} UNION ALL SELECT stage, 'throughput', CASE WHEN avg_ns > 0 THEN 1e9 / avg_ns ELSE 0 END FROM {stats(SAMPLES, 'stage')})""",
    "time_share": f"""SELECT round(d, 6) AS decode_ms, round(r, 6) AS render_ms, round(greatest(c - d - r, 0), 6) AS other_ms, round(d / w * 100, 6) AS decode_pct, round(r / w * 100, 6) AS render_pct, round(greatest(c - d - r, 0) / w * 100, 6) AS other_pct
 FROM (SELECT *, CASE WHEN c > 0 THEN c ELSE 1.0 END AS w FROM (SELECT coalesce(max(avg_ns) FILTER (stage = 'decode'), 0) / 1e6 AS d, coalesce(max(avg_ns) FILTER (stage = 'render'), 0) / 1e6 AS r, coalesce(max(avg_ns) FILTER (stage = 'cold'), 0) / 1e6 AS c FROM {stats(SAMPLES, 'stage')}))""",
    "request_counts": f"SELECT method, endpoint, count(*) AS requests FROM {HTTP} GROUP BY ALL",
    "latency_histogram": " UNION ALL ".join(f"SELECT method, '{b}' AS le, count(*) FILTER (latency_s <= {b}) AS observations FROM {HTTP} GROUP BY method" for b in BUCKETS) + f" UNION ALL SELECT method, '+Inf', count(latency_s) FROM {HTTP} GROUP BY method",
    "attempts_vs_success": f"SELECT count(*) FILTER (status = 'processing') AS attempts, count(*) FILTER (status = 'completed') AS successes, count(*) FILTER (status = 'queued') AS enqueued, count(*) FILTER (status = 'failed') AS failures FROM {LIFE}",
    "span_durations": with_rate(f"(SELECT name, end_ns - start_ns AS ns FROM {T('spans')})", "name"),
    "binlog_summary": f"SELECT CASE event_id WHEN 1 THEN 'LATENCY' WHEN 2 THEN 'ERROR' ELSE 'UNKNOWN' END AS event, count(*) AS entries, CAST(sum(arg0) AS BIGINT) AS arg0_sum, max(arg0) AS arg0_max, count(DISTINCT cpu) AS cpus FROM {T('binlog')} GROUP BY 1",
    "binlog_decode": f"SELECT ts, CASE event_id WHEN 1 THEN '[LAT] ' || arg0 || ' cycles count=' || arg1 || ' extra=' || arg2 WHEN 2 THEN '[ERR] code=' || arg0 ELSE '[UNK] event=' || event_id END AS line FROM {T('binlog')}",
    "status_latest": f"SELECT job_id, arg_max(status, event_id) FILTER (ts = m) AS status, max(ts) AS updated_at, count(*) AS updates FROM (SELECT *, max(ts) OVER (PARTITION BY job_id) AS m FROM {LIFE}) GROUP BY job_id",
    "retry_policy": f"SELECT event_id, job_id, attempt, attempt > 3 AS final, CASE WHEN attempt <= 3 THEN ts + INTERVAL 5 SECOND END AS due FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS attempt FROM {LIFE} WHERE status = 'retrying')",
    "rate_limit": f"SELECT request_id, row_number() OVER (PARTITION BY client, date_trunc('minute', ts) ORDER BY ts, request_id) <= {RATE} AS accepted FROM {HTTP}",
    "scrape_windows": f"SELECT time_bucket(INTERVAL 5 SECOND, ts, TIMESTAMP '1970-01-01') AS scraped_at, count(*) AS requests, max(latency_s) AS max_latency_s FROM {HTTP} GROUP BY 1",
    "trace_join": f"SELECT h.trace_id, count(*) AS pairs, CAST(sum(s.end_ns - s.start_ns) AS BIGINT) AS ns FROM {HTTP} h JOIN {T('spans')} s USING (trace_id) GROUP BY 1",
    "log_gate": f"SELECT line_id, level, substr(message, 1, 255) AS message FROM {T('logs')} WHERE level IN ('INFO', 'ERROR')",
}

#: Too slow over whole tables (16 s on the smallest); tests hold the queries against them there.
SLOW = {"tile_fill": lines(tile("greatest")), "tile_fit": lines(tile("least"))}
