"""Tiles by windows, sheets by layers and by bands against painting, splittable sources, PDF files band by band."""

import hashlib
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from platen.operators import bands, geometry, jobs as job_ops, layers, pixels
from platen.plans import catalog
from platen.plans.fixtures import fixture, framed_jobs
from platen.sources import binary, readers, sheet_files
from tests.test_print import JOB, job, paint


@pytest.fixture(scope="module")
def frames(spark):
    r = np.random.default_rng(7)
    sizes = [(8, 8, 0), (5, 9, 2), (1, 1, 0), (16, 3, 4), (8, 700, 0), (300, 2, 1)]
    return spark.createDataFrame([(k, w, h, 3, 3 * w + pad, bytearray(r.integers(0, 256, h * (3 * w + pad), dtype=np.uint8).tobytes())) for k, (w, h, pad) in enumerate(sizes)], pixels.FRAMES)


def random_jobs(n, seed):
    """Small pages with wide and narrow bleed, borders thicker than a cell, marks that overlap; job 0 has no frame."""
    r = np.random.default_rng(seed)
    k = lambda a, z: int(r.integers(a, z))
    return [job(i, k(4, 60) / 10, k(4, 60) / 10, k(1, 7), k(1, 9), k(0, 4), k(0, 5), k(3, 9), k(0, 4), k(0, 9), k(0, 6), k(0, 4), k(0, 5), k(0, 2), 99 if i == 0 else k(0, 6)) for i in range(n)]


def pages(rows):
    parts = {}
    for r in rows:
        parts.setdefault(r.job_id, {})[r.band] = np.frombuffer(bytes(r.data), np.uint8).reshape(r.h, r.width, 3)
    return {k: np.concatenate([p[b] for b in sorted(p)]) for k, p in parts.items()}


def test_layers_and_bands_equal_painting(spark, frames):
    made = spark.createDataFrame(random_jobs(40, 3), JOB)
    sheets = {r.job_id: r for r in geometry.grid_geometry(made).collect()}
    raw = {r.frame_id: pixels.as_array(bytes(r.data), r.width, r.height, r.stride) for r in frames.collect()}
    dealt = layers.dealt_sheets(made)
    by_layers = pages(layers.compose(dealt, bands.make_tiles(frames, job_ops.dedupe_tiles(dealt)), 8).collect())
    by_bands = pages(bands.render_jobs(frames, made, lines=8).collect())
    assert set(by_layers) == set(by_bands) == set(sheets)
    assert sum(s.bleed_px > s.gap for s in sheets.values()) > 10
    for k, row in sheets.items():
        assert (by_layers[k] == by_bands[k]).all(), k
        if k:
            tile = bands.tile_array(raw[row.frame_id], row.cell_w, row.cell_h, row.mode, row.bg_sig)
            assert (by_bands[k] == paint(row, tile)).all(), k
    plain, marks = by_bands[0], {(0, 0, 0), (10, 200, 255)}
    assert set(map(tuple, plain.reshape(-1, 3).tolist())) <= marks  # without a frame: background and marks


def test_sheets_wider_than_a_step(spark, frames, monkeypatch):
    made = spark.createDataFrame([job(1, 2.1, 2.9, 3, 4, 2, 1, 20, frame=4), job(2, 4.0, 3.0, 2, 2, 5, 9, 25, bleed=8, frame=3)], JOB)
    whole = bands.Layout
    want = pages(bands.render_jobs(frames, made, lines=16).collect())
    for row in geometry.grid_geometry(made).collect():
        own = whole(row.page_w, row.page_h, row.start_x, row.start_y, row.cols, row.rows, row.cell_w, row.cell_h, row.gap, row.border_px, row.bleed_px, row.crop_mark_px, row.crop_thickness or 1, row.crop_offset_px)
        pieces = np.concatenate([own.places(y, min(7, row.page_h - y)) for y in range(0, row.page_h, 7)])
        assert (pieces == own.places(0, row.page_h)).all() and want[row.job_id].shape == (row.page_h, row.page_w, 3)


def test_digests_are_taken_where_bands_are_made(spark, frames):
    made = spark.createDataFrame(random_jobs(30, 11), JOB).withColumn("note", F.concat(F.lit("n"), "job_id"))
    data = bands.render_jobs(frames, made, lines=8).withColumn("digest", F.sha2("data", 256)).withColumn("note", F.concat(F.lit("n"), "job_id"))
    own = bands.render_jobs(frames, made, lines=8, digests=True, beside=("note",))
    assert own.columns == ["job_id", "band", "y0", "width", "h", "digest", "note"]
    key = lambda df: sorted(map(tuple, df.select(own.columns).collect()))
    assert key(own) == key(data)


def test_layers_by_lines_equal_a_row_for_each_pixel(spark):
    sheets = layers.dealt_sheets(spark.createDataFrame(random_jobs(60, 13), JOB))
    key = lambda df: sorted(map(tuple, df.collect()))
    for layer in (geometry.BORDER, geometry.MARK):
        top = layers.top_layers(layers.layer_rects(sheets, {layer}))
        assert key(layers.covered_lines(sheets, layer)) == key(top.groupBy("job_id", "y").agg(F.count("*").alias("n"), F.sum(F.col("x") + 1).alias("digest")))
    place, cell = F.col("place") + 2, F.col("cell_idx") + 1
    want = layers.bleed_pixels(sheets).groupBy("job_id", "y").agg(F.count("*").alias("n"), F.sum((F.col("x") + 1) * cell).alias("owners"), F.sum((F.col("x") + 1) * place).alias("digest"))
    assert key(layers.bleed_lines(sheets)) == key(want)
    for rows in (layers.covered_lines(sheets, geometry.BORDER), layers.bleed_lines(sheets)):
        assert "Aggregate" not in rows._jdf.queryExecution().executedPlan().toString()  # no pixel becomes a row


def test_many_sheets_are_laid_out_together():
    r = np.random.default_rng(5)
    k = lambda a, z: r.integers(a, z, 40)
    args = [k(0, 6), k(0, 6), k(0, 5), k(0, 6), k(1, 9), k(1, 9), k(0, 4), k(0, 4), k(0, 9), k(0, 6), k(1, 4), k(0, 5)]
    many, n = bands.Layouts(37, 41, *args), args[4] * args[5]
    colours, first = r.integers(0, 1 << 24, int((n + bands.PIXELS).sum())).astype(np.uint32), np.cumsum(n + bands.PIXELS) - n - bands.PIXELS
    found = many.bytes(8, 25, colours, first).reshape(40, 25, 37, 3)
    for i in range(40):
        places = bands.Layout(37, 41, *(int(a[i]) for a in args)).places(8, 25)
        assert (found[i] == (colours[places + first[i]][..., None] >> np.array([0, 8, 16]) & 255)).all()


@pytest.mark.parametrize("size", [(8, 700, 17, 13), (300, 2, 40, 9), (5, 9, 5, 9), (1, 1, 6, 4), (16, 3, 1, 1), (7, 50, 90, 3)])
def test_a_tile_is_the_window_of_the_scaled_frame(size):
    w, h, cell_w, cell_h = size
    image = np.random.default_rng(1).integers(0, 256, (h, w, 3), dtype=np.uint8)
    s = max(np.float32(cell_w) / np.float32(w), np.float32(cell_h) / np.float32(h))
    sw, sh = max(int(np.float32(w) * s), cell_w), max(int(np.float32(h) * s), cell_h)
    x, y = (sw - cell_w) // 2, (sh - cell_h) // 2
    assert (bands.tile_array(image, cell_w, cell_h, 1, 0) == pixels.resize_array(image, sw, sh)[y : y + cell_h, x : x + cell_w]).all()


def test_tiles_take_only_their_source_lines(spark, frames):
    keys = [(k, w, h, mode, -1 if mode else 0x0AC8FF) for k in range(6) for w, h in ((17, 13), (3, 40), (1, 1)) for mode in (0, 1)]
    table = spark.createDataFrame(keys, "frame_id long, cell_w long, cell_h long, mode int, bg long")
    raw = {r.frame_id: pixels.as_array(bytes(r.data), r.width, r.height, r.stride) for r in frames.collect()}
    for r in bands.make_tiles(frames, table).collect():
        assert bytes(r.tile) == bands.tile_array(raw[r.frame_id], r.cell_w, r.cell_h, r.mode, r.bg).tobytes()
    cut = bands.tile_windows(frames, table).where("mode = 1 and src_h = 700 and cell_w = 17").first()
    assert cut.n_lines < 12 and len(cut.data) == cut.n_lines * cut.stride


def test_every_job_has_a_frame(spark, sf_dir):
    given, framed, frames = (fixture(spark, sf_dir, n) for n in ("jobs", "framed_jobs", "frames"))
    assert framed.count() == given.count() and framed.join(frames, "frame_id", "left_anti").isEmpty() and framed.columns == given.columns
    jobs = spark.createDataFrame([(k, k) for k in range(7)], "job_id long, frame_id long")
    found = framed_jobs(jobs, spark.createDataFrame([(i,) for i in (-5000, 3, 9000)], "frame_id long")).collect()
    assert sorted((r.job_id, r.frame_id) for r in found) == [(k, (-5000, 3, 9000)[k % 3]) for k in range(7)]
    assert framed_jobs(jobs, spark.createDataFrame([], "frame_id long")).isEmpty()


@pytest.mark.parametrize("name", ["tile_fill", "tile_fit", "tile_digests", "sheet_border", "sheet_marks", "sheet_bleed", "sheet_compose", "job_rgb24", "pdf_export"])
def test_raster_queries_against_sql(spark, sf_dir, name):
    import duckdb

    from platen.plans.raster_oracles import ORACLES

    with duckdb.connect() as db:
        for t in ("orders", "documents"):
            db.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
        rows = catalog.QUERIES[name](spark, sf_dir)
        want = db.sql(f"select {', '.join(rows.columns)} from ({ORACLES[name]})").fetchall()
    assert sorted(want) == sorted(map(tuple, rows.collect()))


def test_thumbnails_by_layers_equal_thumbnails_by_bands(spark, sf_dir):
    t, f = fixture(spark, sf_dir, "framed_jobs"), fixture(spark, sf_dir, "frames")
    painted = bands.render_jobs(f, catalog._thumbs(t), catalog.THUMB_LINES).select("job_id", "band", "y0", "width", "h", F.sha2("data", 256).alias("digest"))
    assert catalog.QUERIES["sheet_compose"](spark, sf_dir).exceptAll(painted).isEmpty()


# Sources.


def test_binlog_in_many_partitions(spark, tmp_path):
    r = np.random.default_rng(5)
    for name, n, rest in (("a.bin", 1000, b""), ("b.bin", 7, b"short"), ("c.bin", 0, b"tiny"), ("_skipped", 3, b"")):
        entries = np.zeros(n, binary.ENTRY)
        for c in ("ts", "arg0", "arg1", "arg2"):
            entries[c] = r.integers(-(2**62), 2**62, n)
        entries["event_id"], entries["cpu"] = r.integers(0, 9, n), r.integers(0, 128, n)
        (tmp_path / name).write_bytes(entries.tobytes() + rest)
    split = binary.read_binlog(spark, str(tmp_path), split=4000)
    whole = readers.parse_binlog(readers.read_files(spark, str(tmp_path)).where("path not like '%skipped'"))
    assert split.rdd.getNumPartitions() == 11 and split.count() == 1007
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, whole.collect()))
    some = binary.read_binlog(spark, str(tmp_path / "a.bin"), "arg1 long, cpu int")
    assert some.columns == ["arg1", "cpu"] and sorted(map(tuple, some.collect())) == sorted((x.arg1, x.cpu) for x in whole.limit(10**6).collect() if (x.arg1, x.cpu) in set(map(tuple, some.collect())))
    empty = tmp_path / "none"
    empty.mkdir()
    assert binary.read_binlog(spark, str(empty)).count() == 0
    with pytest.raises(Exception, match="nowhere"):
        binary.read_binlog(spark, str(tmp_path / "nowhere")).count()
    with pytest.raises(Exception, match="not in the log"):
        binary.read_binlog(spark, str(tmp_path), "other long").count()


def test_raw_frame_by_lines(spark, tmp_path):
    data = np.random.default_rng(2).integers(0, 256, 50 * 37, dtype=np.uint8).tobytes()
    (tmp_path / "f.rgb").write_bytes(data + b"rest")
    found = binary.read_rgb24_lines(spark, str(tmp_path / "f.rgb"), 12, 37, split=37 * 8)
    assert found.rdd.getNumPartitions() == 7
    assert b"".join(bytes(r.data) for r in sorted(found.collect(), key=lambda r: r.y0)) == data
    with pytest.raises(Exception, match="three bytes a pixel"):
        binary.read_rgb24_lines(spark, str(tmp_path / "f.rgb"), 13, 37).count()


# PDF.


def parsed(pdf):
    """(objects by number, the image's pixels) of a file, read by its table of places."""
    start = int(pdf.rsplit(b"startxref\n", 1)[1].split(b"\n")[0])
    table = pdf[start:].split(b"\n")
    assert table[0] == b"xref" and table[2] == b"0000000000 65535 f " and pdf.endswith(b"%%EOF\n")
    objects = {}
    for k in range(1, int(table[1].split()[1])):
        at = int(table[2 + k][:10])
        assert pdf[at:].startswith(b"%d 0 obj\n" % k)
        objects[k] = pdf[at : pdf.index(b"\nendobj\n", at)]
    head, stream = objects[sheet_files.IMAGE].split(b"\nstream\n", 1)
    n = int(objects[sheet_files.LENGTH].split(b"\n")[1])
    assert stream[n:] == b"\nendstream"
    return objects, zlib.decompress(stream[:n])


@pytest.mark.parametrize("chunk", [100, 1 << 20])
def test_pdf_band_by_band(spark, frames, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(sheet_files, "CHUNK", chunk)
    made = spark.createDataFrame(random_jobs(6, 5), JOB)
    out = bands.render_jobs(frames, made, lines=8)
    sheets = {k: p.tobytes() for k, p in pages(out.collect()).items()}
    chunks = {}
    for r in sorted(sheet_files.pdf_chunks(out, made).collect(), key=lambda r: (r.job_id, r.part)):
        chunks[r.job_id] = chunks.get(r.job_id, b"") + bytes(r.bytes)
    sizes = {r.job_id: r for r in geometry.page_size(made).collect()}
    for k, pdf in chunks.items():
        objects, image = parsed(pdf)
        assert image == sheets[k] and b"/Width %d /Height %d" % (sizes[k].page_w, sizes[k].page_h) in objects[sheet_files.IMAGE]
    read = {r.job_id: (r.n_bytes, r.image_sha256) for r in sheet_files.pdf_images(sheet_files.pdf_chunks(out, made)).collect()}
    assert read == {k: (len(p), hashlib.sha256(p).hexdigest()) for k, p in sheets.items()} and set(chunks) == set(sheets)
    sheet_files.write_pdf(out, made, str(tmp_path / "out"))
    sheet_files.write_pdf(out.where("job_id < 2"), made.where("job_id < 2").withColumn("job_id", F.col("job_id") + 100), str(tmp_path / "none"))
    assert {r.file: bytes(r.content) for r in sheet_files.read_pdf(spark, str(tmp_path / "out")).collect()} == {f"{k}.pdf": v for k, v in chunks.items()}


@pytest.mark.parametrize("chunk", [100, 1 << 20])
def test_pdf_where_sheets_are_rendered(spark, frames, monkeypatch, chunk):
    monkeypatch.setattr(sheet_files, "CHUNK", chunk)
    made = spark.createDataFrame(random_jobs(12, 6), JOB)
    out = bands.render_jobs(frames, sheet_files.with_size(made), lines=8, beside=sheet_files.SIZE)
    straight = sheet_files.pdf_chunks(out)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(straight) == key(sheet_files.pdf_chunks(bands.render_jobs(frames, made, lines=8), made))
    read = sheet_files.pdf_images(straight, ordered=True)
    assert key(read) == key(sheet_files.pdf_images(straight)) and read.count() == 12
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (read, out)]
    assert "Repartition" not in plans[0] and plans[0].count("Join") == plans[1].count("Join")  # neither bands nor files are dealt out again


def test_pdf_writer_leaves_nothing_of_a_failed_job(tmp_path):
    writer = sheet_files.SheetWriter(str(tmp_path))
    batch = pa.RecordBatch.from_pylist([{"job_id": k, "width": 1, "height": 2, "w_pt": 1.0, "h_pt": 2.0, "data": b"abc"} for k in (1, 1, 2, 2)])
    done = writer.write(iter([batch.slice(0, 3), batch.slice(3)]))
    assert done.files == ["1.pdf", "2.pdf"] and parsed((tmp_path / done.folder / "1.pdf").read_bytes())[1] == b"abcabc"
    lost = writer.write(iter([batch]))  # an attempt that was run again: in no manifest
    writer.commit([done, None])
    manifest = [json.loads(p.read_text()) for p in tmp_path.glob("_manifest-*")]
    assert manifest == [[done.folder]] and lost.folder != done.folder
    failing = sheet_files.SheetWriter(str(tmp_path))
    gone = failing.write(iter([batch]))
    failing.abort([gone])
    assert not (tmp_path / gone.folder).exists() and (tmp_path / done.folder).exists()
    assert struct.calcsize("<qiiqqq") == binary.ENTRY.itemsize


# Whole frames as bytes against a row for each byte.


@pytest.mark.parametrize("name", ["resize_x", "resize_y", "fused", "crop", "planar"])
def test_frames_as_bytes_equal_pixels_as_rows(spark, frames, name):
    p = pixels.frames_to_pixels(frames)
    sizes = frames.select("frame_id", "width", "height", (F.col("frame_id") + 2).cast("int").alias("new_w"), (9 - F.col("frame_id")).cast("int").alias("new_h"))
    params = spark.createDataFrame([(k, k % 2 == 0, k % 3 == 0, None if k == 3 else 90 * k) for k in range(6)], "frame_id long, has_gray boolean, has_bright boolean, brightness long")
    windows = frames.select("frame_id", F.lit(1).alias("cx"), F.lit(0).alias("cy"), (F.col("frame_id") + 1).cast("int").alias("cw"), F.lit(2).alias("ch"), "width", "height")
    forms = {
        "resize_x": lambda: (pixels.resize_nearest(p, geometry.axis_table(sizes), "x"), pixels.nearest_frames(frames, sizes, "x")),
        "resize_y": lambda: (pixels.resize_nearest(p, geometry.axis_table(sizes), "y"), pixels.nearest_frames(frames, sizes, "y")),
        "fused": lambda: (pixels.fused_chain(p, params), pixels.fused_frames(frames, params)),
        "crop": lambda: (pixels.crop(p, windows), pixels.crop_frames(frames, windows)),
        "planar": lambda: (p, pixels.frames_of_planes(pixels.planes_of(frames))),
    }
    rows, whole = forms[name]()
    key = lambda df: sorted(map(tuple, df.select("frame_id", "y", "x", "c", "v").collect()))
    assert key(rows) == key(pixels.frames_to_pixels(whole))


def test_resize_line_by_line(spark, frames):
    sizes = frames.select("frame_id", "width", "height", (F.col("frame_id") * 5 + 1).cast("int").alias("new_w"), F.expr("greatest(1, height div 2)").alias("new_h"))
    key = lambda df: sorted(map(tuple, df.select("frame_id", "y", "x", "c", "v").collect()))
    found = pixels.resize_lines(frames, sizes)
    assert key(found) == key(pixels.resize_bilinear(pixels.frames_to_pixels(frames), sizes))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # frames meet their sizes; no pixel is joined


def test_small_tiles_are_made_together(spark, frames, monkeypatch):
    keys = [(k, w, h, mode, -1 if mode else 0x0AC8FF) for k in range(6) for w, h in ((17, 13), (3, 40), (1, 1)) for mode in (0, 1)]
    table = spark.createDataFrame(keys, "frame_id long, cell_w long, cell_h long, mode int, bg long")
    key = lambda df: sorted(map(tuple, df.collect()))
    together = key(bands.make_tiles(frames, table))
    monkeypatch.setattr(bands, "SMALL", 0)  # one by one
    alone = key(bands.make_tiles(frames, table))
    monkeypatch.setattr(bands, "SMALL", 130)
    monkeypatch.setattr(bands, "TOGETHER", 200)
    assert together == alone == key(bands.make_tiles(frames, table)) and len(alone) == len(keys)


def test_a_frame_is_moved_once_for_many_tiles(spark, frames, monkeypatch):
    keys = [(k, w, h, mode, -1 if mode else 4099 * w) for k in range(6) for w in range(1, 9) for h in (2, 13) for mode in (0, 1)] + [(3, w, 1, 0, 5) for w in range(9, 99)] + [(None, 3, 3, 1, -1), (99, 3, 3, 1, -1)]
    table = spark.createDataFrame(keys, "frame_id long, cell_w long, cell_h long, mode int, bg long")
    key = lambda df: sorted(map(tuple, df.collect()))
    lists = bands.framed_tiles(frames, table).select("frame_id", "tiles", "data").collect()
    assert len(lists) == 6 and sum(len(r.tiles) for r in lists) == len(keys) - 2
    whole = key(bands.make_tiles(frames, table))
    monkeypatch.setattr(bands, "MANY", 40)  # frame 3 has over 40 tiles and is dealt out
    dealt = bands.framed_tiles(frames, table).select("frame_id", "tiles").collect()
    assert sum(r.frame_id == 3 for r in dealt) > 1 and max(len(r.tiles) for r in dealt) < 80 and len({r.frame_id for r in dealt}) == 6
    monkeypatch.setattr(bands, "MOST", 7)
    assert key(bands.make_tiles(frames, table)) == whole and len(whole) == len(keys) - 2
    own = bands.make_tiles(frames, table, digests=True)
    assert key(own) == sorted((*r[:-1], hashlib.sha256(bytes(r[-1])).hexdigest()) for r in whole)


def test_windows_are_those_of_the_relational_form(spark, frames):
    keys = [(k, w, h, mode, -1) for k in range(6) for w, h in ((17, 13), (3, 40), (1, 1), (90, 7)) for mode in (0, 1)]
    rows = bands.tile_windows(frames, spark.createDataFrame(keys, "frame_id long, cell_w long, cell_h long, mode int, bg long")).collect()
    found = bands.windows({c: np.array([r[c] for r in rows]) for c in ("src_w", "src_h", "cell_w", "cell_h", "mode")})
    for c in ("scaled_w", "scaled_h", "off_x", "off_y"):
        assert found[c].tolist() == [r[c] for r in rows], c
    assert found["last"].tolist() == [r["first"] + r["n_lines"] - 1 for r in rows] and len(rows) == len(keys)


def test_a_short_frame_is_an_error(spark):
    short = spark.createDataFrame([(1, 2, 9, 3, 6, bytearray(50))], pixels.FRAMES)
    for size in (4, 99):
        with pytest.raises(Exception, match="fewer bytes"):
            bands.make_tiles(short, spark.createDataFrame([(1, size, size, 0, 0)], "frame_id long, cell_w long, cell_h long, mode int, bg long")).collect()


def test_texts_are_read_once_for_the_ids_of_frames(spark, sf_dir):
    framed = fixture(spark, sf_dir, "framed_jobs")
    framed.collect()
    plan = framed._jdf.queryExecution().executedPlan()
    final = plan.toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan.toString() and final.count("FileScan parquet [doc_id") <= 1


def test_sums_of_lines_go_by_parts(spark, frames, monkeypatch):
    whole = sorted(map(tuple, pixels.line_digests(frames.coalesce(1)).collect()))
    monkeypatch.setattr(pixels, "ROWS", 8)
    parts = pixels.line_digests(frames.coalesce(1))
    assert sorted(map(tuple, parts.collect())) == whole and len(whole) == sum(r.height for r in frames.collect())
    run = {}
    stub = type("Frames", (), {"where": lambda self, _: self, "select": lambda self, *_: self, "mapInArrow": lambda self, f, _: run.update(f=f)})()
    pixels.line_digests(stub)
    rows = [{"frame_id": r.frame_id, "width": r.width, "height": r.height, "stride": r.stride, "data": bytes(r.data)} for r in frames.collect()]
    found = list(run["f"](iter([pa.RecordBatch.from_pylist(rows)])))
    assert len(found) > 2 and sum(b.num_rows for b in found) == len(whole)
