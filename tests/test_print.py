"""Print domain: golden geometry, two ways to the same pixels, properties, sources, sinks and streams."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from platen.functions import gates
from platen.operators import bands, geometry, jobs, metrics, pipelines, pixels, tables
from platen.plans.catalog import QUERIES
from platen.plans.oracles import ORACLES, SLOW
from platen.sources import readers, sinks
from platen.streaming import service

# Fixed values: (w cm, h cm, cols, rows, gap, padding, dpi), cell, origin, placed, last placed cell.
GOLDEN = [
    ((4.5, 3.5, 2, 3, 15, 20, 300), (531, 413), (701, 20), 6, (1247, 876)),
    ((4.5, 3.5, 6, 6, 15, 20, 300), (394, 306), (20, 20), 36, (2065, 1625)),
    ((3.8, 3.5, 6, 6, 15, 20, 300), (394, 362), (20, 20), 36, (2065, 1905)),
    ((4.5, 3.5, 3, 2, 15, 20, 300), (531, 413), (428, 20), 6, (1520, 448)),
    ((3.5, 3.0, 6, 2, 15, 20, 300), (394, 337), (20, 20), 12, (2065, 372)),
    ((4.5, 3.5, 6, 3, 20, 20, 300), (390, 303), (20, 20), 18, (2070, 666)),
    ((4.5, 3.5, 10, 20, 15, 20, 300), (204, 159), (152, 20), 200, (2123, 3326)),
    ((4.5, 3.5, 2, 3, 15, 20, 72), (128, 99), (162, 20), 6, (305, 248)),
    ((4.5, 3.5, 300, 2, 15, 20, 300), (531, 413), (20, 20), 8, None),
]
JOB = "job_id long, frame_id long, abi_version int, template_id int, photo_w_cm float, photo_h_cm float, dpi long, cols long, rows long, gap long, padding long, border_px long, bleed_px long, crop_mark_px long, crop_thickness long, crop_offset_px long, mode int, bg_r int, bg_g int, bg_b int"


def job(k, w=4.5, h=3.5, cols=2, rows=3, gap=15, padding=20, dpi=300, border=2, bleed=1, mark=5, thick=1, offset=2, mode=1, frame=1):
    return (k, frame, 2, 0, w, h, dpi, cols, rows, gap, padding, border, bleed, mark, thick, offset, mode, 10, 200, 255)


@pytest.fixture(scope="module")
def golden(spark):
    return spark.createDataFrame([job(k, *g[0]) for k, g in enumerate(GOLDEN)], JOB)


def test_golden_geometry(golden):
    sheets = geometry.grid_geometry(golden)
    rows = {r.job_id: r for r in sheets.collect()}
    placed = {r.job_id: r for r in geometry.placed_cells(geometry.cell_grid(sheets)).groupBy("job_id").agg(F.count("*").alias("n"), F.max("x").alias("x"), F.max("y").alias("y")).collect()}
    covered = {r.job_id: r for r in geometry.sheet_coverage(sheets).collect()}
    for k, (_, cell, origin, n, last) in enumerate(GOLDEN):
        assert ((rows[k].cell_w, rows[k].cell_h), (rows[k].start_x, rows[k].start_y)) == (cell, origin)
        assert placed[k].n == covered[k].placed == n
        assert last is None or (placed[k].x, placed[k].y) == last


def test_golden_tile_windows(spark):
    df = spark.createDataFrame([(4096, 4096), (1920, 1080), (640, 480)], "src_w long, src_h long").withColumns({"cell_w": F.lit(394), "cell_h": F.lit(306)})
    assert [tuple(r)[4:] for r in geometry.fill_window(df).collect()] == [(394, 394, 0, 44), (544, 306, 75, 0), (408, 306, 7, 0)]
    assert [tuple(r)[4:] for r in geometry.fit_letterbox(df).collect()] == [(306, 306, 44, 0), (394, 221, 0, 42), (394, 295, 0, 5)]


def test_gates(spark):
    df = spark.createDataFrame([(0, 1, 1), (1, 1, 0), (16385, 1, 10**9), (16384, 16384, 671088), (16384, 16384, 671089), (None, 4, 4)], "w long, h long, s long")
    assert [r[0] for r in df.select(gates.request_gate(F.col("w"), F.col("h"), F.col("s"))).collect()] == [3, 3, 3, 3, 0, 3]
    text = spark.createDataFrame([(t,) for t in ("0", "4294967295", "4294967296", "-1", "", "1x", None, "3.5")], "t string")
    assert [r[0] for r in text.select(gates.parse_u32(F.col("t"))).collect()] == [0, 4294967295, None, None, None, None, None, None]
    assert [r[0] for r in text.select(gates.output_kind(F.lit("a.PDF")), gates.output_kind(F.lit("pdf"))).limit(1).collect()] == ["pdf"]
    assert text.select(gates.capacity_gate(F.lit(2811), F.lit(3976)), gates.result_name(F.lit(9))).first()[:] == (gates.SUCCESS, "IMG_ERR_UNKNOWN")


def paint(row, tile):
    """A sheet pixel by pixel: background, tiles, border, bleed (clamped, later cells win), marks."""
    page = np.empty((row.page_h, row.page_w, 3), np.uint8)
    page[:] = (row.bg_r, row.bg_g, row.bg_b)
    w, h, b, d = row.cell_w, row.cell_h, row.border_px, row.bleed_px
    cells = [(row.start_x + c * (w + row.gap), row.start_y + r * (h + row.gap)) for r in range(row.rows) for c in range(row.cols)]
    cells = [(x, y) for x, y in cells if x + w <= row.page_w and y + h <= row.page_h]
    for x, y in cells:
        page[y : y + h, x : x + w] = tile
        if b:
            for yy in range(h):
                for xx in range(w):
                    if min(xx, yy, w - 1 - xx, h - 1 - yy) < b:
                        page[y + yy, x + xx] = 0
    before = page.copy()
    for x, y in cells:
        for yy in range(max(y - d, 0), min(y + h + d, row.page_h)):
            for xx in range(max(x - d, 0), min(x + w + d, row.page_w)):
                if not (x <= xx < x + w and y <= yy < y + h):
                    page[yy, xx] = before[min(max(yy, y), y + h - 1), min(max(xx, x), x + w - 1)]
    if row.crop_mark_px:
        t, o, n = row.crop_thickness or 1, row.crop_offset_px, row.crop_mark_px
        for x, y in cells:
            for left in (True, False):
                for top in (True, False):
                    ax, ay = (x - o - n if left else x + w + o), (y - o - t if top else y + h + o)
                    bx, by = (x - o - t if left else x + w + o), (y - o - n if top else y + h + o)
                    for x0, y0, ww, hh in ((ax, ay, n, t), (bx, by, t, n)):
                        page[max(y0, 0) : max(y0 + hh, 0), max(x0, 0) : max(x0 + ww, 0)] = 0
    return page


@pytest.fixture(scope="module")
def frames(spark):
    r = np.random.default_rng(1)
    rows = [(k, w, h, 3, 3 * w + pad, bytearray(r.integers(0, 256, h * (3 * w + pad), dtype=np.uint8).tobytes())) for k, (w, h, pad) in enumerate([(8, 8, 0), (5, 9, 2), (1, 1, 0), (16, 3, 4)])]
    return spark.createDataFrame(rows, pixels.FRAMES)


def test_bands_equal_painted_sheets(spark, frames):
    made = spark.createDataFrame(
        [
            job(1, 2.1, 2.9, 3, 4, 2, 1, 10, 1, 1, 2, 1, 1, 1, 0),
            job(2, 5.0, 2.0, 6, 9, 1, 3, 10, 0, 3, 1, 0, 0, 0, 1),
            job(3, 3.0, 3.0, 9, 9, 4, 0, 20, 2, 2, 4, 2, 3, 0, 3),
            job(4, 2.0, 2.0, 2, 2, 0, 5, 25, 30, 0, 0, 0, 0, 1, 2),
            job(5, 2.5, 2.5, 40, 2, 3, 2, 12, 1, 2, 3, 0, 1, 1, 0),
        ],
        JOB,
    )
    sheets = {r.job_id: r for r in geometry.grid_geometry(made).collect()}
    raw = {r.frame_id: pixels.as_array(bytes(r.data), r.width, r.height, r.stride) for r in frames.collect()}
    parts = {}
    for r in bands.render_jobs(frames, made, lines=16).collect():
        parts.setdefault(r.job_id, {})[r.band] = np.frombuffer(bytes(r.data), np.uint8).reshape(r.h, r.width, 3)
    assert set(parts) == set(sheets)
    for k, row in sheets.items():
        tile = bands.tile_array(raw[row.frame_id], row.cell_w, row.cell_h, row.mode, row.bg_sig)
        whole = np.concatenate([parts[k][b] for b in sorted(parts[k])])
        assert whole.shape == (row.page_h, row.page_w, 3) and (whole == paint(row, tile)).all(), k


def test_resize_both_ways(frames):
    sizes = frames.select("frame_id", "width", "height", F.lit(7).alias("new_w"), F.lit(5).alias("new_h"))
    key = lambda df: sorted(map(tuple, df.select("frame_id", "y", "x", "c", "v").collect()))
    rows = pixels.frames_to_pixels(frames)
    assert key(pixels.resize_bilinear(rows, sizes)) == key(pixels.frames_to_pixels(pixels.resize_frames(frames, sizes)))
    assert key(pixels.to_interleaved(pixels.to_planar(rows.where("frame_id = 0")), 8)) == key(rows.where("frame_id = 0"))


def test_pipelines_and_custom_operations(spark, frames):
    ops = spark.createDataFrame([(0, 1, 3, 0, 4, 4), (0, 2, 1, 0, 4, 4), (1, 1, 200, 9, 0, 0), (2, 1, 2, 0, 0, 0), (3, 1, 3, 0, 0, 0), (3, 2, 2, 0, 0, 0)], "pipeline_id long, op_index long, op_code long, brightness long, new_w long, new_h long")
    pipelines.register_op("invert", 200, lambda image, p: 255 - image)
    pipelines.register_op("too far", 300, lambda image, p: image)
    try:
        out = {r.frame_id: r for r in pixels.run_pipeline(frames, ops).collect()}
        loose = {r.frame_id: r for r in pixels.run_pipeline(frames, ops, lenient=True).collect()}
        known = {r.op_code for r in pipelines.registry_table(spark).collect()}
    finally:
        pipelines.REGISTRY.clear()
    raw = {r.frame_id: pixels.as_array(bytes(r.data), r.width, r.height, r.stride) for r in frames.collect()}
    assert known == {1, 3, 16, 17, 200}
    assert bytes(out[0].data) == pixels.resize_array(pixels.luma_array(raw[0]), 4, 4).tobytes()
    assert bytes(out[1].data) == (255 - raw[1]).tobytes()
    assert bytes(out[2].data) == raw[2].tobytes() and bytes(out[3].data) == raw[3].tobytes()
    assert bytes(loose[3].data) == pixels.luma_array(raw[3]).tobytes()


def test_batch_functions_get_batches(spark, frames):
    def both(images, p):
        return [np.full_like(image, len(images)) for image in images]

    ops = [(k, 1, 201, 5, 0, 0) for k in range(3)] + [(3, 1, 201, 6, 0, 0), (0, 2, 3, 0, 0, 0), (1, 2, 202, 0, 0, 0)]
    table = spark.createDataFrame(ops, "pipeline_id long, op_index long, op_code long, brightness long, new_w long, new_h long")
    pipelines.register_op("count", 201, lambda image, p: image, both)
    pipelines.register_op("one", 202, lambda image, p: image + 1)
    try:
        together = {r.frame_id: bytes(r.data)[0] for r in pixels.run_pipeline(frames.coalesce(1), table.coalesce(1), lenient=True).coalesce(1).collect()}
        alone = {r.frame_id: bytes(r.data) for r in pixels.run_pipeline(frames, table).where("frame_id = 2").collect()}
        steps = [[{"op_index": i, "op_code": c, "brightness": b} for q, i, c, b, _, _ in ops if q == k] for k in range(4)]
        made = pixels.run_together([np.zeros((1, 1, 3), np.uint8)] * 4, steps)
    finally:
        pipelines.REGISTRY.clear()
    assert [int(m[0, 0, 0]) for m in made] == [3, 4, 3, 1]
    assert together[3] == 1 and together[2] in (1, 2, 3)  # as many as met in an Arrow batch
    raw = frames.where("frame_id = 2").first()
    assert alone[2] == bytes(raw.data)


def test_table_functions(spark, golden):
    sheets = geometry.grid_geometry(golden)
    cells = geometry.placed_cells(geometry.cell_grid(sheets)).where("job_id < 3")
    tables.register_tables(spark)
    made = spark.sql("SELECT s.job_id, c.* FROM {s} s, LATERAL cells(s.cols, s.rows, s.gap, s.start_x, s.start_y, s.cell_w, s.cell_h) c", s=sheets)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, geometry.cell_grid(sheets).select("job_id", "cell_idx", "row", "col", "x", "y", "w", "h").collect()))
    made = spark.sql("SELECT s.job_id, s.cell_idx, r.* FROM {s} s, LATERAL rects(s.x, s.y, s.w, s.h, s.border_px, s.crop_mark_px, s.crop_thickness, s.crop_offset_px) r", s=cells)
    wanted = geometry.border_rects(cells).unionByName(geometry.crop_mark_rects(cells)).select("job_id", "cell_idx", "layer", "part", "x", "y", "w", "h")
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, wanted.collect()))
    nothing = sheets.limit(1).withColumn("gap", F.lit(None).cast("long"))
    assert spark.sql("SELECT c.* FROM {s} s, LATERAL cells(s.cols, s.rows, s.gap, s.start_x, s.start_y, s.cell_w, s.cell_h) c", s=nothing).count() == 0


def test_table_functions_are_made_in_the_query(spark, golden):
    """No Python, no join; nulls and empty grids have no rows."""
    tables.register_tables(spark)
    for call, names in (("cells", tables.CELLS), ("rects", tables.RECTS)):
        rows = spark.createDataFrame([(k, *(None if k == i else 0 if (k, i) == (9, 0) else 3 for i in range(len(names)))) for k in range(11)], "k long, " + ", ".join(f"{n} long" for n in names))
        made = spark.sql(f"SELECT s.k, c.* FROM {{s}} s, LATERAL {call}({', '.join('s.' + n for n in names)}) c", s=rows)
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Generate" in plan and not any(w in plan for w in ("Python", "UDTF", "Arrow", "Join"))
        kept = {r.k for r in made.collect()}
        assert kept == (set(range(len(names), 11)) - ({9} if call == "cells" else set()))


def test_templates(spark):
    catalog = jobs.templates(spark)
    named = jobs.lookup_template(spark.createDataFrame([("passport-45x35",), ("passport-38x35-printready",), ("none",)], "preset string"), catalog, "preset")
    assert sorted((r.preset, r.template_id) for r in named.collect()) == [("none", None), ("passport-38x35-printready", 2), ("passport-45x35", 1)]


def test_latency_rules(spark):
    samples = spark.createDataFrame([("a", n) for n in (5, 1, 9, 9, 3, 7)] + [("b", 4)], "stage string, ns long")
    rows = {r.stage: r for r in metrics.latency_stats(samples, ["stage"]).collect()}
    assert (rows["a"].p50_ns, rows["a"].p95_ns, rows["a"].p99_ns, rows["a"].avg_ns) == (7, 9, 9, 5) and rows["b"].p50_ns == 4
    assert {r.stage: (r.p50_ns, r.p99_ns) for r in metrics.decoder_stats(samples, ["stage"]).collect()} == {"a": (7, 9), "b": (4, 4)}


def png(width, height, rgb):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + rgb[y * width * 3 : (y + 1) * width * 3] for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_sources(spark, tmp_path):
    rgb = bytes(range(4 * 3 * 3))
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.png").write_bytes(png(4, 3, rgb))
    frame = readers.read_photos(spark, str(tmp_path / "p")).first()
    assert (frame.width, frame.height, frame.stride, bytes(frame.data)) == (4, 3, 12, rgb)
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.bin").write_bytes(struct.pack("<QIIQQQ", 5, 1, 2, 7, 8, 9) + struct.pack("<QIIQQQ", 6, 2, 3, 2**40, 0, 0) + b"short")
    (tmp_path / "b" / "y.bin").write_bytes(b"")
    log = readers.parse_binlog(readers.read_files(spark, str(tmp_path / "b")))
    assert sorted(map(tuple, log.collect())) == [(5, 1, 2, 7, 8, 9), (6, 2, 3, 2**40, 0, 0)]
    data = spark.createDataFrame([(1, bytearray(rgb)), (2, bytearray(rgb))], "frame_id long, content binary")
    dims = spark.createDataFrame([(1, 4, 3, 0), (2, 4, 4, 0)], "frame_id long, width long, height long, stride long")
    assert [r.frame_id for r in readers.read_rgb24(data, dims).collect()] == [1]
    request = json.dumps({"job_id": "j", "input_path": "in", "output_path": "out", "params": {"cols": 6, "rows": 2, "width": 4.5}})
    row = readers.parse_job_requests(spark.createDataFrame([(request,)], "value string"), "value").first()
    assert (row.job_id, row.cols, row.rows, row.gap, row.photo_w_cm) == ("j", 6, 2, None, 4.5)


def test_sinks(spark, frames):
    made = spark.createDataFrame([job(1, 2.1, 2.9, 3, 4, 2, 1, 10, frame=0)], JOB)
    out = bands.render_jobs(frames, made)
    sheet = geometry.grid_geometry(made).first()
    ppm = bytes(sinks.export_sheets(out).first().bytes)
    assert ppm.startswith(b"P6\n%d %d\n255\n" % (sheet.page_w, sheet.page_h))
    pdf = bytes(sinks.export_pdf(out, made).first().bytes)
    start = int(pdf.split(b"startxref\n")[1].split(b"\n")[0])
    assert pdf.startswith(b"%PDF-1.4") and pdf[start:].startswith(b"xref\n0 6") and pdf.count(b" obj\n") == 5
    assert zlib.decompress(pdf.split(b"stream\n")[3].split(b"\nendstream")[0]) == ppm.split(b"255\n", 1)[1]
    now = spark.createDataFrame([("a", "queued", None), ("b", "queued", "x")], "job_id string, status string, logs string")
    new = spark.createDataFrame([("a", "processing", None, 1), ("a", None, "log", 2), ("c", "failed", None, 3)], "job_id string, status string, logs string, ts long")
    assert sorted(map(tuple, sinks.upsert_jobs(now, new).collect()), key=str) == [("a", "processing", "log"), ("b", "queued", "x"), ("c", "failed", None)]


def test_streams(spark, frames, tmp_path):
    drop = tmp_path / "requests"
    drop.mkdir()
    for k in range(3):
        (drop / f"{k}.json").write_text(json.dumps({"job_id": f"{k}", "input_path": "i", "output_path": "o", "params": {"cols": 2, "rows": 2}}) + "\n")
    service.start_intake(readers.job_stream(spark, str(drop)), str(tmp_path / "jobs"), str(tmp_path / "messages"), str(tmp_path / "c1"), once=True).awaitTermination()
    assert sorted((r.job_id, r.status) for r in spark.read.parquet(str(tmp_path / "jobs")).collect()) == [("0", "queued"), ("1", "queued"), ("2", "queued")]
    assert {r.rows for r in spark.read.parquet(str(tmp_path / "messages")).collect()} == {2}

    jobs_in = spark.createDataFrame([job(1, 2.1, 2.9, 3, 4, 2, 1, 10, frame=0), job(2, 2.1, 2.9, 0, 4, 2, 1, 10, frame=0)], JOB)
    jobs_in.write.parquet(str(tmp_path / "queue"))
    service.start_worker(spark.readStream.schema(jobs_in.schema).parquet(str(tmp_path / "queue")), frames, str(tmp_path / "out"), str(tmp_path / "c2"), once=True).awaitTermination()
    assert sorted((r.job_id, r.status) for r in spark.read.parquet(str(tmp_path / "out/states")).collect()) == [(1, "completed"), (1, "processing"), (2, "failed"), (2, "processing")]
    key = lambda df: sorted((r.job_id, r.band, bytes(r.data)) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out/bands"))) == key(bands.render_jobs(frames, jobs_in))

    states = tmp_path / "states"
    states.mkdir()
    for k, status in enumerate(("queued", "processing", "completed")):
        (states / f"{k}.json").write_text(json.dumps({"event_id": k, "job_id": "a", "status": status, "ts": f"2026-01-01T00:00:0{k}Z"}) + "\n")
    service.start_status(readers.status_stream(spark, str(states)), str(tmp_path / "table"), str(tmp_path / "c3"), once=True).awaitTermination()
    last = max((tmp_path / "table").iterdir(), key=lambda p: int(p.name.split("=")[1]))
    assert [(r.job_id, r.status) for r in spark.read.parquet(str(last)).collect()] == [("a", "completed")]

    lines = tmp_path / "lines"
    lines.mkdir()
    (lines / "l.json").write_text("".join(json.dumps({"time": "2026-01-01 00:00:00", "level": level, "message": "m" * 300, "trace_id": "t"}) + "\n" for level in ("INFO", "DEBUG", "ERROR")) + "not json\n")
    service.start_log_index(spark.readStream.format("text").load(str(lines)), str(tmp_path / "index"), str(tmp_path / "c4"), once=True).awaitTermination()
    assert sorted((r.level, len(r.message)) for r in spark.read.parquet(str(tmp_path / "index")).collect()) == [("ERROR", 255), ("INFO", 255)]


def test_status_table_by_buckets(spark, tmp_path):
    """Batches write only the buckets they touch; the table is the last version of each bucket."""
    states, table = tmp_path / "states", tmp_path / "table"
    states.mkdir()
    run = lambda: service.start_status(readers.status_stream(spark, str(states)), str(table), str(tmp_path / "c"), once=True, buckets=8).awaitTermination()
    write = lambda k, rows: (states / f"{k}.json").write_text("".join(json.dumps({"event_id": 100 * k + n, "job_id": j, "status": s, "ts": f"2026-01-01T00:00:0{k}Z"}) + "\n" for n, (j, s) in enumerate(rows)))
    jobs = [f"job{n}" for n in range(40)]
    write(0, [(j, "queued") for j in jobs])
    run()
    write(1, [("job3", "processing"), ("new", "queued")])
    run()
    write(2, [("job3", "completed")])
    run()
    found = {r.job_id: r.status for r in service.read_status(spark, str(table)).collect()}
    assert found == {j: "queued" for j in jobs} | {"job3": "completed", "new": "queued"}
    assert service.read_status(spark, str(table)).count() == 41
    assert {r.job_id: r.status for r in service.read_status(spark, str(table), 2).collect()}["job3"] == "processing"
    assert [len(list((table / f"version={k}").glob("bucket=*"))) for k in (0, 2)] == [8, 1]


def test_intake_feeds_worker(spark, tmp_path):
    """A photo, two requests for it (one of them twice, in two batches), bands, sheets and PDF."""
    photos, drop = tmp_path / "photos", tmp_path / "requests"
    photos.mkdir()
    drop.mkdir()
    rgb = np.random.default_rng(2).integers(0, 256, 6 * 5 * 3, dtype=np.uint8).tobytes()
    (photos / "a.png").write_bytes(png(6, 5, rgb))
    origin = spark.read.format("image").load(str(photos)).select("image.origin").first()[0]
    frames = readers.read_photos(spark, str(photos))

    def run(*ids):
        for k in ids:
            (drop / f"{k}-{len(list(drop.iterdir()))}.json").write_text(json.dumps({"job_id": k, "input_path": origin, "output_path": "o", "params": {"cols": 2, "rows": 3, "dpi": 10, "gap": 1, "padding": 1, "crop_mark": 1, "bleed": 1}}) + "\n")
        service.start_intake(readers.job_stream(spark, str(drop)), str(tmp_path / "jobs"), str(tmp_path / "messages"), str(tmp_path / "c1"), once=True).awaitTermination()

    run("x")
    run("x", "y")
    messages = spark.read.parquet(str(tmp_path / "messages"))
    assert sorted(r.job_id for r in messages.collect()) == ["x", "y"]
    stream = spark.readStream.schema(messages.schema).parquet(str(tmp_path / "messages"))
    service.start_worker(stream, frames, str(tmp_path / "out"), str(tmp_path / "c2"), once=True).awaitTermination()
    states = spark.read.parquet(str(tmp_path / "out/states"))
    assert sorted((r.job_id, r.status) for r in states.collect()) == [(k, s) for k in "xy" for s in ("completed", "processing")]
    made = spark.read.parquet(str(tmp_path / "out/bands"))
    sheet = geometry.grid_geometry(messages).first()
    tile = bands.tile_array(np.frombuffer(rgb, np.uint8).reshape(5, 6, 3), sheet.cell_w, sheet.cell_h, 1, -1)
    page = paint(sheet, tile).tobytes()
    assert {r.job_id: bytes(r.bytes).split(b"255\n", 1)[1] == page for r in sinks.export_sheets(made).collect()} == {"x": True, "y": True}
    assert sorted(r.job_id for r in sinks.export_pdf(made, messages).collect()) == ["x", "y"]


def test_rate_limit_stream(spark, tmp_path):
    rows = [(k, "ab"[k % 2], f"2026-01-01 00:0{k // 8}:{10 + k}") for k in range(16)]
    table = spark.createDataFrame(rows, "request_id long, client string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    for part in (table.where("request_id % 8 < 5"), table.where("request_id % 8 >= 5")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        limited = service.rate_limited(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")), 3)
        limited.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    wanted = metrics.rate_limit(table, 3).select("client", "request_id", "accepted")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))


@pytest.mark.parametrize("name", ["template_coverage", "override_merge", "render_signature", "crop_mark_rects", "fuse_params", "grayscale", "decoder_stats", "retry_policy", "tile_fill", "tile_fit", "cells_table_function"])
def test_queries_against_sql(spark, sf_dir, name):
    import duckdb

    db = duckdb.connect()
    for t in ("orders", "lineitem", "events", "documents", "conversations"):
        db.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    spark_rows = QUERIES[name](spark, sf_dir)
    columns = sorted(spark_rows.columns)
    found = db.sql((ORACLES | SLOW)[name])
    order = [found.columns.index(c) for c in columns]
    show = lambda v: None if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    a = sorted((tuple(show(r[i]) for i in order) for r in found.fetchall()), key=str)
    b = sorted((tuple(show(v) for v in r) for r in spark_rows.select(*columns).collect()), key=str)
    assert a == b
