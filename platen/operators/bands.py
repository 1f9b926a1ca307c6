"""Sheet composition by bands: rows of 64 lines, so no task ever holds more than a few of them.

Tiles are rendered once for each (frame, cell size, mode, background), each from
the source lines that it shows, and joined once to the sheets that show them. A
sheet is laid out as places in its tile: background, cells, border, bleed and crop
marks are painted as numbers, for many sheets of one page size at a time, and the sheets
take their pixels by them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platen.operators import geometry, jobs as job_ops
from platen.operators.pixels import as_array, axis_places, resample, resize_array

LINES = 64
BANDS = "job_id {}, band long, y0 long, width long, h int, data binary"  # by the type of the jobs' ids
TILES = "frame_id long, cell_w long, cell_h long, mode int, bg long, tile binary"
SHEET = ("page_w", "page_h", "gap", "border_px", "bleed_px", "crop_mark_px", "crop_thickness", "crop_offset_px")
#: Bytes of an output batch; pixels that are laid out at a time, of many sheets or of one (bands of a wider one go one by one).
OUT, AREA = 1 << 23, 1 << 18
#: Pixels of a tile that is made together with others; of all that are made at a time, about.
SMALL, TOGETHER = 1 << 12, 1 << 18
#: Tiles of a frame that travel with it, about; whose windows are computed at a time, about.
MANY, MOST = 1 << 10, 1 << 16


def tile_array(image: np.ndarray, cell_w: int, cell_h: int, mode: int, bg: int) -> np.ndarray:
    """A photo for a cell: filled and centre-cropped (mode 1), or fitted on the background (mode 0). 32-bit float steps."""
    h, w = image.shape[:2]
    sx, sy = np.float32(cell_w) / np.float32(w), np.float32(cell_h) / np.float32(h)
    if mode == 1:
        s = max(sx, sy)
        sw, sh = max(int(np.float32(w) * s), cell_w), max(int(np.float32(h) * s), cell_h)
        return resample(image, axis_places(w, sw, (sw - cell_w) // 2, cell_w), axis_places(h, sh, (sh - cell_h) // 2, cell_h))
    s = min(sx, sy)
    sw, sh = (min(max(int(np.float32(a) * s), 1), c) for a, c in ((w, cell_w), (h, cell_h)))
    return letterboxed(resize_array(image, sw, sh), cell_w, cell_h, (cell_w - sw) // 2, (cell_h - sh) // 2, bg)


def letterboxed(image: np.ndarray, cell_w: int, cell_h: int, x: int, y: int, bg: int) -> np.ndarray:
    if image.shape[:2] == (cell_h, cell_w):
        return image
    out = np.empty((cell_h, cell_w, 3), np.uint8)
    out[:] = (bg >> 16 & 255, bg >> 8 & 255, bg & 255)
    out[y : y + image.shape[0], x : x + image.shape[1]] = image
    return out


def tile_windows(frames: DataFrame, tiles: DataFrame) -> DataFrame:
    """Tile keys over frames -> scaled size, the window of it that the tile shows, and the source lines ``first``.. of that window alone.

    The relational form of ``windows``. A filled tile (mode 1) shows the centre of the
    scaled photo, a fitted one all of it.
    """
    size = {"src_w": F.col("width").cast("long"), "src_h": F.col("height").cast("long")}
    joined = tiles.join(frames.where("width > 0 and height > 0 and data is not null"), "frame_id").withColumns(size)
    names = ("scaled_w", "scaled_h", "off_x", "off_y")
    filled = geometry.fill_window(joined).withColumn("_fill", F.struct(*names)).drop(*names)
    both = geometry.fit_letterbox(filled).withColumn("_fit", F.struct(*names)).drop(*names)
    fills = F.col("mode") == 1
    chosen = both.select(*joined.columns, F.when(fills, F.col("_fill")).otherwise(F.col("_fit")).alias("_w")).select(*joined.columns, "_w.*")
    step = F.when((F.col("src_h") > 1) & (F.col("scaled_h") > 1), F.call_function("div", F.shiftleft(F.col("src_h") - 1, 16), F.col("scaled_h") - 1)).otherwise(0)
    top, bottom = (F.col("off_y"), F.col("off_y") + F.col("cell_h") - 1)
    first = F.when(fills, F.shiftright(top * step, 16)).otherwise(0).cast("long")
    last = F.when(fills, F.least(F.shiftright(bottom * step, 16) + 1, F.col("src_h") - 1)).otherwise(F.col("src_h") - 1)
    cut = chosen.withColumns({"first": first, "n_lines": last - first + 1})
    lines = F.expr("substring(data, cast(first * stride + 1 as int), cast(n_lines * stride as int))")
    return cut.select("frame_id", "cell_w", "cell_h", "mode", "bg", "src_w", "src_h", "stride", *names, "first", "n_lines", lines.alias("data"))


def each(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of n entries: of each entry its group and its number in it."""
    group = np.repeat(np.arange(len(n)), n)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)


def framed_tiles(frames: DataFrame, tiles: DataFrame) -> DataFrame:
    """Frames with the keys of their tiles as a list, so that a frame is moved once and not with each of its tiles.

    A frame of over MANY tiles is dealt out: it is there once for about each MANY of
    them, so neither a list nor a task has to hold all tiles of a frame.
    """
    keys = tiles.where("frame_id is not null").select("frame_id", F.struct("cell_w", "cell_h", "mode", "bg").alias("tile"))
    busy = keys.groupBy("frame_id").agg(F.expr(f"count(*) div {MANY} + 1").alias("_parts")).where("_parts > 1")

    def dealt(df: DataFrame, part: Column) -> DataFrame:
        return df.join(F.broadcast(busy), "frame_id", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1))).withColumn("_part", part).drop("_parts")

    lists = dealt(keys, F.pmod(F.xxhash64("tile"), F.col("_parts"))).repartition("frame_id", "_part").groupBy("frame_id", "_part").agg(F.collect_list("tile").alias("tiles"))
    given = frames.where("width > 0 and height > 0 and data is not null").select("frame_id", F.col("width").cast("long").alias("src_w"), F.col("height").cast("long").alias("src_h"), F.col("stride").cast("long").alias("stride"), "data")
    parts = dealt(given, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    return parts.join(lists, ["frame_id", "_part"]).select("frame_id", "src_w", "src_h", "stride", "tiles", "data")


def windows(t: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """src_w, src_h, cell_w, cell_h and mode of tiles -> the same with the scaled size, the window's place and ``last``, the last source line that is needed. 32-bit float steps, as in ``tile_array``."""
    fills, ratio = t["mode"] == 1, {s: t[f"cell_{s}"].astype(np.float32) / t[f"src_{s}"].astype(np.float32) for s in "wh"}
    scale, out = np.where(fills, np.maximum(ratio["w"], ratio["h"]), np.minimum(ratio["w"], ratio["h"])), dict(t)
    for side, off in (("w", "off_x"), ("h", "off_y")):
        cell, size = t[f"cell_{side}"], (t[f"src_{side}"].astype(np.float32) * scale).astype(np.int64)
        out[f"scaled_{side}"] = np.where(fills, np.maximum(size, cell), np.clip(size, 1, cell))
        out[off] = np.abs(out[f"scaled_{side}"] - cell) // 2
    out["last"] = np.where(fills, np.minimum(((out["off_y"] + t["cell_h"] - 1) * steps(t["src_h"], out["scaled_h"]) >> 16) + 1, t["src_h"] - 1), t["src_h"] - 1)
    return out


def steps(src: np.ndarray, scaled: np.ndarray) -> np.ndarray:
    """The distance of neighbouring source places in 16.16."""
    return np.where((src > 1) & (scaled > 1), (src - 1 << 16) // np.maximum(scaled - 1, 1), 0)


#: Columns by which tiles take their pixels from the same places of their source lines.
ACROSS = ("mode", "src_w", "scaled_w", "cell_w", "off_x")


@lru_cache(1024)
def across(src: int, scaled: int, start: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the source bytes that ``size`` scaled columns are made of: their places in a line and the number of the same colour's next one; of each byte made: the first one's number and the next one's share."""
    x0, x1, fx = axis_places(src, scaled, start, size)
    used, at = np.unique(np.concatenate([x0, x1]), return_inverse=True)
    after = np.arange(len(used))
    after[at[:size]] = at[size:]
    rgb = lambda v: (v[:, None] * 3 + np.arange(3)).reshape(-1)
    return rgb(used), rgb(after), rgb(at[:size]), np.repeat(fx / 65536, 3)[:, None]


def taken(data: np.ndarray, lines: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """(lines, columns) of the lines that start there; neighbouring columns are copied as one."""
    if columns[-1] - columns[0] < len(columns):
        n = len(columns)
        return np.ndarray(len(data) - n + 1, f"V{n}", data, strides=(1,))[lines + columns[0]].view(np.uint8).reshape(-1, n)
    return data[lines[:, None] + columns]


def many_tiles(t: dict[str, np.ndarray], data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``tile_array`` of the tiles of ``windows``, all of them at a time: their bytes one after another, and where each starts. offsets: where the frame of each starts.

    Neighbours that are alike ``ACROSS`` are one array, some lines at a time: the two
    source lines are mixed first, then the columns. All steps are multiples of 2^-32
    under 2^9, so 64-bit floats are exact.
    """
    fills = t["mode"] == 1
    # Of each shown line: its tile, its number in it, where its two source lines start and the second one's weight.
    tile, k = each(n := np.where(fills, t["cell_h"], t["scaled_h"]))
    at = (k + np.where(fills, t["off_y"], 0)[tile]) * steps(t["src_h"], t["scaled_h"])[tile]
    near, fy = at >> 16, (at & 0xFFFF).astype(np.int32)
    upper = offsets[tile] + near * t["stride"][tile]
    lower = upper + np.where(near + 1 < t["src_h"][tile], t["stride"][tile], 0)
    first, upto = (np.concatenate([[0], np.cumsum(v)]) for v in (t["cell_w"] * t["cell_h"] * 3, n))
    top = np.cumsum(t["cell_h"]) - t["cell_h"]
    to = (top + np.where(fills, 0, t["off_y"]))[tile] + k
    out = np.empty(first[-1], np.uint8)
    cuts = np.flatnonzero(np.any([np.diff(t[c]) != 0 for c in ACROSS], axis=0)) + 1
    for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(n)], strict=True):
        fill, src_w, scaled_w, cell_w, off_x = (int(t[c][a]) for c in ACROSS)
        x, off, wide = (0, off_x, cell_w) if fill == 1 else (off_x, 0, scaled_w)
        columns, after, left, weight = across(src_w, scaled_w, off, wide)
        tiles = out[first[a] : first[z]].reshape(-1, cell_w * 3)
        if fill != 1:
            bg = (t["bg"][a:z, None] >> np.array([16, 8, 0]) & 255).astype(np.uint8)
            tiles.reshape(-1, 3)[:] = np.repeat(bg, cell_w * t["cell_h"][a:z], axis=0)
        many = max(1, TOGETHER // (24 * wide))
        for start in range(upto[a], upto[z], many):
            lines = np.s_[start : min(start + many, upto[z])]
            down = fy[lines][:, None]
            mixed = taken(data, upper[lines], columns) * (65536 - down) + taken(data, lower[lines], columns) * down
            mixed = mixed.T * 2.0**-16
            shown = (mixed[after] - mixed)[left]
            shown *= weight
            shown += (mixed + 0.5)[left]
            tiles[to[lines] - top[a], x * 3 : (x + wide) * 3] = shown.astype(np.uint8).T
    return out, first


def make_tiles(frames: DataFrame, tiles: DataFrame, digests: bool = False) -> DataFrame:
    """(frame_id, cell_w, cell_h, mode, bg) keys and frames -> rendered tiles: small ones many at a time, others one by one.

    digests: instead of a tile its SHA-256 (``digest``, lowercase hex), taken where the tile is made.
    """
    kinds = {"frame_id": pa.int64(), "cell_w": pa.int64(), "cell_h": pa.int64(), "mode": pa.int32(), "bg": pa.int64()}

    def one(t: dict, data: np.ndarray) -> bytes:
        image = as_array(data, t["src_w"], t["last"] + 1, t["stride"])
        if t["mode"] != 1:
            return letterboxed(resize_array(image, t["scaled_w"], t["scaled_h"]), t["cell_w"], t["cell_h"], t["off_x"], t["off_y"], t["bg"]).tobytes()
        across = axis_places(t["src_w"], t["scaled_w"], t["off_x"], t["cell_w"])
        return resample(image, across, axis_places(t["src_h"], t["scaled_h"], t["off_y"], t["cell_h"])).tobytes()

    def rows(t: dict, data, first: np.ndarray) -> pa.RecordBatch:
        if digests:
            view, cuts = memoryview(data), first.tolist()
            made = pa.array([hashlib.sha256(view[a:z]).hexdigest() for a, z in zip(cuts, cuts[1:], strict=False)], pa.string())
        else:
            made = pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(first.astype(np.int32)), pa.py_buffer(data)])
        return pa.RecordBatch.from_arrays([*(pa.array(t[c], kind) for c, kind in kinds.items()), made], names=[*kinds, "digest" if digests else "tile"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.diff(batch.column("tiles").offsets.to_numpy())
            upto = np.cumsum(n) // MOST
            for start, end in zip(*(np.searchsorted(upto, np.unique(upto), side) for side in ("left", "right")), strict=True):
                yield from some(batch.slice(start, end - start))

    def some(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists, held = batch.column("tiles"), batch.column("data")
        keys, n = lists.flatten(), np.diff(lists.offsets.to_numpy())
        offsets = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1].astype(np.int64)
        data = np.frombuffer(held.buffers()[2], np.uint8)
        t = {c: batch.column(c).to_numpy().repeat(n) for c in ("frame_id", "src_w", "src_h", "stride")}
        t = windows(t | {c: keys.field(c).to_numpy().astype(np.int64) for c in ("cell_w", "cell_h", "mode", "bg")})
        t["at"], long = offsets[:-1].repeat(n), np.diff(offsets).repeat(n)
        if (long < (t["last"] + 1) * t["stride"]).any():
            raise ValueError("a frame has fewer bytes than its lines")
        order = np.lexsort([t[c] for c in ACROSS])  # tiles that are alike stand together
        t, size = {c: v[order] for c, v in t.items()}, (t["cell_w"] * t["cell_h"])[order]
        few = {c: v[size <= SMALL] for c, v in t.items()}
        upto = np.cumsum(size[size <= SMALL]) // TOGETHER
        for start, end in zip(*(np.searchsorted(upto, np.unique(upto), side) for side in ("left", "right")), strict=True):
            part = {c: v[start:end] for c, v in few.items()}
            yield rows(part, *many_tiles(part, data, part["at"]))
        for k in np.flatnonzero(size > SMALL).tolist():
            made = one({c: int(v[k]) for c, v in t.items()}, data[t["at"][k] :])
            yield rows({c: v[k : k + 1] for c, v in t.items()}, made, np.array([0, len(made)]))

    return framed_tiles(frames, tiles).mapInArrow(run, TILES.replace("tile binary", "digest string") if digests else TILES)


class Axis:
    """One axis of sheets with pages of equal size: for each of its lines, the cell row (or column) whose pixels it shows; an array (sheets, lines) each.

    Cells and their bleed reach over equal ranges at equal steps, so the last range
    that holds a line and the one before it follow from the line's place.
    """

    def __init__(self, page: int, start, n, size, gap, bleed):
        start, n, size, gap, bleed = (np.asarray(v, np.int32).reshape(-1, 1) for v in (start, n, size, gap, bleed))
        self.page, self.start, self.n, self.size, self.step = page, start, n, size, size + gap
        self.at = np.arange(page, dtype=np.int32)[None, :]
        self.last = np.maximum(np.minimum((self.at - (start - bleed)) // self.step, n - 1), -1)
        place = self.at - start - self.last * self.step
        self.held = (self.last >= 0) & (place < size + bleed)
        self.own = self.held & (place >= 0) & (place < size)  # the last range's cell itself, not its bleed
        # The range before holds such a line too, by its bleed, and so shows its cell's last line.
        self.more = self.own & (self.last > 0) & (place < bleed - gap)
        self.source = np.minimum(np.maximum(place, 0), size - 1)

    def covered(self, ranges: list[tuple]) -> np.ndarray:
        """Which lines lie in one of the ranges, taken from each cell's start: of ranges at equal steps the last one that starts before a line decides."""
        out = np.zeros((len(self.start), self.page), bool)
        for a, z in ranges:
            a, z = (np.asarray(v, np.int32).reshape(-1, 1) for v in (a, z))
            place = self.at - self.start - a
            k = np.minimum(place // self.step, self.n - 1)
            out |= (k >= 0) & (place - k * self.step < z - a)
        return out

    def edge(self, border: np.ndarray) -> np.ndarray:
        """Which lines show a line of their cell that is border."""
        return (border > 0) & ((self.source < border) | (self.source >= self.size - border))


BACKGROUND, BLACK, PIXELS = range(3)
#: Below every place.
NONE = -(1 << 30)


class Layouts:
    """Where each pixel of sheets (whose pages have one size) comes from: BACKGROUND, BLACK, or PIXELS + its place in the cell.

    Layers in order: cells, their border, bleed (the nearest pixel of the bordered
    cell; of overlapping bleeds the later cell's, which also covers other cells) and
    crop marks. Bleed doesn't cover its own cell, so where a pixel's last cell is its
    own one the bleed of the column before, else of the row before, is on top. Each
    value is an array, one entry for each sheet; sheets without a tile have marks only.
    """

    def __init__(self, page_w: int, page_h: int, start_x, start_y, cols, rows, cell_w, cell_h, gap, border, bleed, mark, thick, off, tiled=True):
        self.x, self.y = Axis(page_w, start_x, cols, cell_w, gap, bleed), Axis(page_h, start_y, rows, cell_h, gap, bleed)
        column = lambda v: np.asarray(v, np.int32).reshape(-1, 1)
        self.border, mark, thick, off = (column(v) for v in (border, mark, thick, off))
        self.tiled = np.broadcast_to(np.asarray(tiled, bool).reshape(-1, 1), self.x.start.shape)
        long = lambda size: [(-off - mark, -off), (size + off, size + off + mark)]
        short = lambda size: [(-off - thick, -off), (size + off, size + off + thick)]
        given = mark > 0
        self.marks = [(self.y.covered(short(self.y.size)) & given, self.x.covered(long(self.x.size))), (self.y.covered(long(self.y.size)) & given, self.x.covered(short(self.x.size)))]

    def kinds(self, top: int, lines: int) -> np.ndarray:
        """(sheets, lines) from line ``top`` on: a number for each line; lines with equal numbers are of one sheet and show the same."""
        y, part = self.y, np.s_[:, top : top + lines]
        kind = np.arange(len(y.start))[:, None] * (int(y.size.max()) + 1) + np.where(y.held[part], y.source[part] + 1, 0)
        for flag in (y.own, y.more, *(rows for rows, _ in self.marks)):
            kind = kind * 2 + flag[part]
        return kind

    def shown(self, sheet: np.ndarray, line: np.ndarray) -> np.ndarray:
        """(n, page_w): the places of n lines, given by their sheets and their numbers."""
        x, y, border = self.x, self.y, self.border
        of = lambda v: v[sheet, line][:, None]
        down = of(np.where(y.edge(border), NONE, PIXELS + y.source * x.size).astype(np.int32))
        across = np.where(x.edge(border), NONE, x.source).astype(np.int32)
        out = np.maximum(down + across[sheet], BLACK)
        out *= of(y.held & self.tiled) & x.held[sheet]
        if x.more.any():
            right = np.where(border > 0, NONE, x.size - 1).astype(np.int32)
            np.copyto(out, np.maximum(down + right[sheet], BLACK), where=of(y.own & self.tiled) & x.more[sheet])
        some = np.flatnonzero(of(y.more & self.tiled))
        if len(some):
            low = np.where(border > 0, NONE, PIXELS + (y.size - 1) * x.size).astype(np.int32)
            out[some] = np.where((x.own & ~x.more)[sheet[some]], np.maximum(low + across, BLACK)[sheet[some]], out[some])
        for rows, columns in self.marks:
            some = np.flatnonzero(of(rows))
            out[some] = np.where(columns[sheet[some]], BLACK, out[some])
        return out

    def places(self, top: int, lines: int) -> np.ndarray:
        """(sheets, lines, page_w) of the sheets from line ``top`` on."""
        sheet, line = np.indices((len(self.y.start), lines)).reshape(2, -1)
        return self.shown(sheet, top + line).reshape(-1, lines, self.x.page)

    def bytes(self, top: int, lines: int, colours: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The sheets' pixels from line ``top`` on, one sheet after another, by their ``palettes``; lines that repeat are made once."""
        _, at, again = np.unique(self.kinds(top, lines), return_index=True, return_inverse=True)
        sheet, line = np.divmod(at, lines)
        made = packed(colours[self.shown(sheet, top + line) + first[sheet][:, None]]).reshape(len(at), -1)
        return made[again.reshape(-1)].reshape(-1)


class Layout(Layouts):
    """One sheet's layout; ``places`` is (lines, page_w)."""

    def places(self, top: int, lines: int) -> np.ndarray:
        return super().places(top, lines)[0]


def palettes(tiles: pa.Array, bg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The colours of sheets by place, one sheet after another, as 32-bit numbers whose low three bytes are red, green and blue; and where each sheet's start."""
    n = pc.fill_null(pc.binary_length(tiles), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 3
    first = np.concatenate([[0], np.cumsum(n + PIXELS)])
    out = np.empty(first[-1], np.uint32)
    out[first[:-1] + BACKGROUND] = (bg >> 16 & 255) | (bg >> 8 & 255) << 8 | (bg & 255) << 16
    out[first[:-1] + BLACK] = 0
    some = tiles.drop_null()
    if len(some):
        offsets = np.frombuffer(some.buffers()[1], np.int32)[some.offset : some.offset + len(some) + 1]
        rgb = np.frombuffer(some.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, 3).astype(np.uint32)
        out[np.arange(len(rgb)) + np.repeat(PIXELS * np.arange(1, len(n) + 1), n)] = rgb[:, 0] | rgb[:, 1] << 8 | rgb[:, 2] << 16
    return out, first[:-1]


def packed(colours: np.ndarray) -> np.ndarray:
    """32-bit colours as three bytes each: four of them in three words."""
    flat = colours.reshape(-1)
    n = flat.size
    if n % 4:
        flat = np.concatenate([flat, np.zeros(4 - n % 4, np.uint32)])
    a, b, c, d = flat.reshape(-1, 4).T
    out = np.empty((len(a), 3), "<u4")
    out[:, 0] = a | b << 24
    out[:, 1] = b >> 8 | c << 16
    out[:, 2] = c >> 16 | d << 8
    return out.reshape(-1).view(np.uint8)[: n * 3]


def sheet_plan(sheets: DataFrame, beside: tuple[str, ...] = ()) -> DataFrame:
    """Sheets -> job_id, the tile's key and all that lays a sheet out, and the columns ``beside``; n_cols and n_rows: the columns and rows of cells that are on the page; a thickness of 0 is 1. Narrow."""

    def fit(n: str, start: str, cell: str, page: str):
        room = F.col(page) - F.col(start) - F.col(cell)
        return F.when(room < 0, 0).otherwise(F.least(n, F.call_function("div", room, F.col(cell) + F.col("gap")) + 1))

    placed = {"n_cols": fit("cols", "start_x", "cell_w", "page_w"), "n_rows": fit("rows", "start_y", "cell_h", "page_h")}
    bg = F.when(F.col("mode") == 0, F.col("bg_sig")).otherwise(F.lit(-1).cast("long"))
    thick = F.coalesce(F.nullif("crop_thickness", F.lit(0)), F.lit(1))
    return sheets.withColumns(placed | {"bg": bg, "crop_thickness": thick}).select("job_id", "frame_id", "cell_w", "cell_h", "mode", "bg", "bg_sig", "start_x", "start_y", "n_cols", "n_rows", *SHEET, *(c for c in beside if c not in SHEET))


GEOMETRY = ["page_w", "page_h", "start_x", "start_y", "n_cols", "n_rows", "cell_w", "cell_h", "gap", "border_px", "bleed_px", "crop_mark_px", "crop_thickness", "crop_offset_px"]


def alike(batch: pa.RecordBatch, area: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """(rows, page_w, page_h): the rows of sheets whose pages have one size, as many as have ``area`` pixels together, one at least."""
    size = np.stack([batch.column(c).to_numpy() for c in ("page_w", "page_h")])
    sizes, kind = np.unique(size, axis=1, return_inverse=True)
    for k, (width, height) in enumerate(sizes.T.tolist()):
        rows = np.flatnonzero(kind.reshape(-1) == k)
        step = max(1, area // max(1, width * height))
        for at in range(0, len(rows), step):
            yield rows[at : at + step], width, height


def compose_bands(sheets: DataFrame, tiles: DataFrame, lines: int = LINES, digests: bool = False, beside: tuple[str, ...] = (), layouts: type[Layouts] = Layouts) -> DataFrame:
    """Sheets with frame_id and tiles -> bands. A sheet without a tile has its background and marks only.

    digests: instead of a band's data its SHA-256 (``digest``, lowercase hex), taken
    where the band is made, so that no pixel leaves its task. beside: columns of the
    sheets that their bands carry as well. The bands of a sheet come one after another.
    """
    joined = sheet_plan(sheets, beside).join(tiles, ["frame_id", "cell_w", "cell_h", "mode", "bg"], "left")
    joined = joined.withColumn("border_px", F.when(F.col("tile").isNull(), 0).otherwise(F.col("border_px")))  # a sheet without a tile has no border

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = _Bands(batch.select(["job_id", *beside]), digests)
            values = [batch.column(c).to_numpy() for c in GEOMETRY[2:]]
            tile, bg = batch.column("tile"), batch.column("bg_sig").to_numpy()
            tiled = tile.is_valid().to_numpy(zero_copy_only=False)
            for rows, width, height in alike(batch, AREA):
                own = layouts(width, height, *(v[rows] for v in values), tiled[rows])
                colours, first = palettes(tile.take(pa.array(rows)), bg[rows])
                # Many small pages at a time, or one page by stretches.
                step = height if width * height <= AREA else max(1, AREA // max(1, width * lines)) * lines
                for top in range(0, height, step):
                    part = min(step, height - top)
                    made.add(rows, top, part, width, lines, own.bytes(top, part, colours, first))
                    if made.size >= OUT:
                        yield made.batch()
            if made.rows:
                yield made.batch()

    kinds = dict(sheets.dtypes)
    schema = BANDS.format(kinds["job_id"]).replace("data binary", "digest string" if digests else "data binary") + "".join(f", {c} {kinds[c]}" for c in beside)
    return joined.select("job_id", *GEOMETRY, "bg_sig", *beside, "tile").mapInArrow(run, schema)


class _Bands:
    """Bands gathered for an output batch; a stretch of lines is cut into bands by offsets alone. ids: the sheets' own columns."""

    def __init__(self, ids: pa.RecordBatch, digests: bool):
        self.ids, self.digests = ids, digests
        self.clear()

    def clear(self) -> None:
        self.size, self.data, self.rows = 0, [], []

    def add(self, sheets: np.ndarray, top: int, n: int, width: int, lines: int, data: np.ndarray) -> None:
        y = np.arange(top, top + n, lines)
        h = np.minimum(lines, top + n - y)
        rows = np.stack([np.repeat(sheets, len(y)), *(np.tile(v, len(sheets)) for v in (y // lines, y, np.full(len(y), width), h))])
        if self.digests:
            cuts = np.concatenate([[0], np.cumsum(rows[3] * rows[4] * 3)]).tolist()
            view = memoryview(data)
            self.data += [hashlib.sha256(view[a:z]).hexdigest() for a, z in zip(cuts, cuts[1:], strict=False)]
            self.size += 100 * len(h) * len(sheets)
        else:
            self.data.append(data)
            self.size += len(data)
        self.rows.append(rows)

    def batch(self) -> pa.RecordBatch:
        k, band, y0, width, h = np.concatenate(self.rows, axis=1)
        if self.digests:
            data = pa.array(self.data, pa.string())
        else:
            cuts = np.concatenate([[0], np.cumsum(width * h * 3)]).astype(np.int32)
            data = pa.Array.from_buffers(pa.binary(), len(k), [None, pa.py_buffer(cuts), pa.py_buffer(np.concatenate(self.data))])
        ids, *beside = (c.take(pa.array(k)) for c in self.ids.columns)
        names = ["job_id", "band", "y0", "width", "h", "digest" if self.digests else "data", *self.ids.schema.names[1:]]
        out = pa.RecordBatch.from_arrays([ids, pa.array(band), pa.array(y0), pa.array(width), pa.array(h.astype(np.int32)), data, *beside], names=names)
        self.clear()
        return out


def render_jobs(frames: DataFrame, jobs: DataFrame, lines: int = LINES, digests: bool = False, beside: tuple[str, ...] = ()) -> DataFrame:
    """Jobs (of the right version, with a sane grid) over their frames -> bands: plan, render each tile once, compose (see ``compose_bands``)."""
    sheets = geometry.sane_sheets(jobs)
    return compose_bands(sheets, make_tiles(frames, job_ops.dedupe_tiles(sheets)), lines, digests, beside)
