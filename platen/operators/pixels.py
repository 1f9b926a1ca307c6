"""Pixel operators on rows (frame_id, y, x, c, v) and, for whole frames, in Arrow batches of bytes.

Point operators are column expressions that Catalyst folds into one projection.
Resampling is an equi-join with axis tables; for frames that are kept as bytes,
``resize_frames`` does the same arithmetic in numpy, frame by frame.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platen.functions import gates
from platen.operators import geometry, pipelines

FRAMES = "frame_id long, width int, height int, channels int, stride int, data binary"
LUMA = (77, 150, 29)
HALF, SHIFT = 1 << 31, 32
#: Operations of a pipeline.
MOST = 32
#: Pixel rows of an Arrow batch; frames of a step.
ROWS, TOGETHER = 1 << 16, 256


def _pixel_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole lines at a time, about ROWS rows in a batch."""
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())

    def rows(parts: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*parts, strict=True), kinds, strict=True)], names=["frame_id", "y", "x", "c", "v"])

    parts, held = [], 0
    for batch in batches:
        frames = [batch.column(c).to_pylist() for c in ("frame_id", "width", "height", "stride")]
        for frame_id, width, height, stride, data in zip(*frames, batch.column("data"), strict=True):
            image = np.frombuffer(data.as_buffer(), np.uint8)
            step = max(1, ROWS // (width * 3))
            for y in range(0, min(height, -(-len(image) // stride)), step):
                at = (np.arange(y, min(height, y + step))[:, None] * stride + np.arange(width * 3)).ravel()
                at = at[at < len(image)]
                within = at % stride
                parts.append((np.full(len(at), frame_id), at // stride, within // 3, within % 3, image[at]))
                held += len(at)
                if held >= ROWS:
                    yield rows(parts)
                    parts, held = [], 0
    if parts:
        yield rows(parts)


def frames_to_pixels(frames: DataFrame) -> DataFrame:
    """One row for each byte of each pixel; padding beyond 3 bytes a pixel is passed over, and so are frames without data."""
    some = frames.where("width > 0 and height > 0 and data is not null")
    return some.select("frame_id", "width", "height", "stride", "data").mapInArrow(_pixel_rows, "frame_id long, y int, x int, c int, v int")


def resize_bilinear(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each target pixel from its four neighbours, rounded once: axis tables meet the pixels in equi-joins."""
    axis = geometry.axis_table(sizes)
    ax = axis.where("axis = 'x'").select("frame_id", F.col("dst").alias("x"), F.col("i0").alias("x0"), F.col("i1").alias("x1"), F.col("w").alias("fx"))
    ay = axis.where("axis = 'y'").select("frame_id", F.col("dst").alias("y"), F.col("i0").alias("y0"), F.col("i1").alias("y1"), F.col("w").alias("fy"))
    # One gather along x for both columns, then along y: every source row is read once.
    corner = F.explode(F.array(F.struct(F.col("x0").alias("sx"), (65536 - F.col("fx")).alias("wx")), F.struct(F.col("x1").alias("sx"), F.col("fx").alias("wx"))))
    across = ax.select("frame_id", "x", corner.alias("k")).select("frame_id", "x", "k.*")
    line = F.explode(F.array(F.struct(F.col("y0").alias("sy"), (65536 - F.col("fy")).alias("wy")), F.struct(F.col("y1").alias("sy"), F.col("fy").alias("wy"))))
    down = ay.select("frame_id", "y", line.alias("k")).select("frame_id", "y", "k.*")
    p = pixels.select("frame_id", F.col("y").cast("long").alias("sy"), F.col("x").cast("long").alias("sx"), "c", "v")
    rows = p.join(across, ["frame_id", "sx"]).groupBy("frame_id", "sy", "x", "c").agg(F.sum(F.col("v") * F.col("wx")).alias("h"))
    out = rows.join(down, ["frame_id", "sy"]).groupBy("frame_id", "y", "x", "c").agg(F.sum(F.col("h") * F.col("wy")).alias("t"))
    return out.select("frame_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "c", F.shiftright(F.col("t") + F.lit(HALF), SHIFT).cast("int").alias("v"))


def resize_nearest(pixels: DataFrame, axis: DataFrame, along: str) -> DataFrame:
    """Copies the pixel at the axis table's first index, along 'x' or 'y'."""
    places = axis.where(F.col("axis") == along).select(F.col("frame_id").alias("_frame"), F.col("dst").alias("_dst"), F.col("i0").alias("_src"))
    joined = pixels.join(places, (F.col("frame_id") == F.col("_frame")) & (F.col(along) == F.col("_src")))
    return joined.select(*(F.col("_dst").cast("int").alias(c) if c == along else F.col(c) for c in ("frame_id", "y", "x", "c", "v")))


def grayscale(pixels: DataFrame) -> DataFrame:
    """BT.601 luma in all three channels."""
    weight = F.when(F.col("c") == 0, LUMA[0]).when(F.col("c") == 1, LUMA[1]).otherwise(LUMA[2])
    luma = pixels.groupBy("frame_id", "y", "x").agg(F.shiftright(F.sum(F.col("v") * weight), 8).cast("int").alias("v"))
    return luma.select("frame_id", "y", "x", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("c"), "v")


def uniform_gray(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("v", F.shiftright(F.col("v") * 77, 8))


def brightness(pixels: DataFrame, amount) -> DataFrame:
    return pixels.withColumn("v", F.least(F.col("v") + amount, F.lit(255)).cast("int"))


def normalise(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("v", F.shiftright("v", 1))


def fused_chain(pixels: DataFrame, params: DataFrame) -> DataFrame:
    """Gray, then brightness, by each frame's fused parameters (frame_id, has_gray, has_bright, brightness); one projection."""
    joined = pixels.join(params.select("frame_id", "has_gray", "has_bright", "brightness"), "frame_id")
    gray = F.when(F.col("has_gray"), F.shiftright(F.col("v") * 77, 8)).otherwise(F.col("v"))
    bright = F.when(F.col("has_bright"), F.least(gray + F.coalesce("brightness", F.lit(0)), F.lit(255))).otherwise(gray)
    return joined.select("frame_id", "y", "x", "c", bright.cast("int").alias("v"))


def crop(pixels: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows (frame_id, cx, cy, cw, ch, width, height); one that leaves its frame changes nothing."""
    joined = pixels.join(windows, "frame_id")
    ok = gates.crop_gate(F.col("cx"), F.col("cy"), F.col("cw"), F.col("ch"), F.col("width"), F.col("height"))
    inside = (F.col("x") >= F.col("cx")) & (F.col("x") < F.col("cx") + F.col("cw")) & (F.col("y") >= F.col("cy")) & (F.col("y") < F.col("cy") + F.col("ch"))
    kept = joined.where(~ok | inside)
    return kept.select("frame_id", F.when(ok, F.col("y") - F.col("cy")).otherwise(F.col("y")).cast("int").alias("y"), F.when(ok, F.col("x") - F.col("cx")).otherwise(F.col("x")).cast("int").alias("x"), "c", "v")


def to_planar(pixels: DataFrame) -> DataFrame:
    """(frame_id, c, data array<short>): each channel's values in row order; a channel is as large as its frame."""
    entry = F.struct("y", "x", F.col("v").cast("short").alias("v"))
    return pixels.groupBy("frame_id", "c").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["v"]).alias("data"))


def to_interleaved(planar: DataFrame, width) -> DataFrame:
    flat = planar.select("frame_id", "c", F.posexplode("data").alias("i", "v"), (width if not isinstance(width, int) else F.lit(width)).alias("w"))
    return flat.select("frame_id", F.expr("i div w").cast("int").alias("y"), (F.col("i") % F.col("w")).cast("int").alias("x"), "c", F.col("v").cast("int").alias("v"))


# Frames as bytes.


def axis_places(src: int, dst: int, start: int = 0, size: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both source places of each of the dst places (or of ``size`` of them from ``start`` on) and the second one's weight in 16.16."""
    step = ((src - 1) << 16) // (dst - 1) if src > 1 and dst > 1 else 0
    pos = np.arange(start, dst if size is None else start + size, dtype=np.int64) * step
    first = pos >> 16
    return first, np.minimum(first + 1, src - 1), pos & 0xFFFF


Places = tuple[np.ndarray, np.ndarray, np.ndarray]


def resample(image: np.ndarray, across: Places, down: Places) -> np.ndarray:
    """The pixels at the places of both axes, by the rule of ``resize_bilinear``; only lines and columns that they name are read."""
    x0, x1, fx = across
    y0, y1, fy = down
    lines, at = np.unique(np.concatenate([y0, y1]), return_inverse=True)
    v = image[lines].astype(np.int64) if len(lines) < len(image) else image.astype(np.int64)
    y0, y1 = (at[: len(y0)], at[len(y0) :]) if len(lines) < len(image) else (y0, y1)
    fx, fy = fx[None, :, None], fy[:, None, None]
    rows = v[:, x0] * (65536 - fx) + v[:, x1] * fx
    return ((rows[y0] * (65536 - fy) + rows[y1] * fy + HALF) >> SHIFT).astype(np.uint8)


def resize_array(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """The same rule as ``resize_bilinear`` on a (height, width, 3) array."""
    return resample(image, axis_places(image.shape[1], width), axis_places(image.shape[0], height))


def as_array(data: bytes, width: int, height: int, stride: int) -> np.ndarray:
    rows = np.frombuffer(data, np.uint8, count=height * stride).reshape(height, stride)
    return rows[:, : width * 3].reshape(height, width, 3)


def _each_frame(frames: DataFrame, extra: list[str], change) -> DataFrame:
    """Runs a function (array, row of extra columns) -> array over all frames, in place of their pixels."""
    return _each_batch(frames, extra, lambda images, rows: [change(image, r) for image, r in zip(images, rows, strict=True)])


def _each_batch(frames: DataFrame, extra: list[str], change) -> DataFrame:
    """Runs a function (arrays, rows of extra columns) -> arrays over up to TOGETHER frames at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                rows = batch.slice(at, TOGETHER).to_pylist()
                made = change([as_array(r["data"], r["width"], r["height"], r["stride"]) for r in rows], rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["frame_id"] for r in rows], pa.int64()),
                        pa.array([m.shape[1] for m in made], pa.int32()),
                        pa.array([m.shape[0] for m in made], pa.int32()),
                        pa.array([3] * len(made), pa.int32()),
                        pa.array([m.shape[1] * 3 for m in made], pa.int32()),
                        pa.array([m.tobytes() for m in made], pa.binary()),
                    ],
                    names=["frame_id", "width", "height", "channels", "stride", "data"],
                )

    return frames.select("frame_id", "width", "height", "stride", "data", *extra).mapInArrow(run, FRAMES)


def resize_frames(frames: DataFrame, sizes: DataFrame) -> DataFrame:
    """frames with (frame_id, new_w, new_h) -> resized frames; frames of zero size go."""
    joined = frames.where("width > 0 and height > 0").join(sizes.where("new_w > 0 and new_h > 0").select("frame_id", "new_w", "new_h"), "frame_id")
    return _each_frame(joined, ["new_w", "new_h"], lambda image, r: resize_array(image, r["new_w"], r["new_h"]))


def resize_lines(frames: DataFrame, sizes: DataFrame) -> DataFrame:
    """``resize_bilinear`` line by line: (frame_id, y, x, c, v) of frames with (frame_id, new_w, new_h).

    Each target line is a row with its two source lines, which are cut from the frame in
    the JVM; nothing but the frames and their sizes is shuffled, and no task opens a frame.
    """
    joined = frames.where("width > 0 and height > 0 and data is not null").join(sizes.where("new_w > 0 and new_h > 0").select("frame_id", "new_w", "new_h"), "frame_id")
    sized = {"width": F.col("width").cast("int"), "stride": F.col("stride").cast("int"), "src": F.col("height").cast("long"), "size": F.col("new_h").cast("long"), "new_w": F.col("new_w").cast("int")}
    lines = joined.withColumns(sized).select("frame_id", "width", "stride", "src", "size", "new_w", "data", F.explode(F.sequence(F.lit(0).cast("long"), F.col("new_h").cast("long") - 1)).alias("y"))
    step = F.when((F.col("src") > 1) & (F.col("size") > 1), F.call_function("div", F.shiftleft(F.col("src") - 1, 16), F.greatest(F.col("size") - 1, F.lit(1)))).otherwise(0)
    pos = F.col("y") * step
    cut = lambda at: F.substring("data", (at * F.col("stride") + 1).cast("int"), F.col("width") * 3)
    near = F.shiftright(pos, 16)
    pairs = lines.select("frame_id", F.col("y").cast("int").alias("y"), "width", "new_w", pos.bitwiseAND(F.lit(0xFFFF)).alias("fy"), cut(near).alias("upper"), cut(F.least(near + 1, F.col("src") - 1)).alias("lower"))

    def line(column: pa.Array, at: np.ndarray, width: int) -> np.ndarray:
        return np.frombuffer(b"".join(column.take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), width, 3).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, kind = np.unique(np.stack([batch.column(c).to_numpy() for c in ("width", "new_w")]), axis=1, return_inverse=True)
            for k, (width, new_w) in enumerate(kinds.T.tolist()):
                same = np.flatnonzero(kind.reshape(-1) == k)
                x0, x1, fx = axis_places(width, new_w)
                fx, step = fx[None, :, None], max(1, ROWS // (new_w * 3))
                for start in range(0, len(same), step):
                    at = same[start : start + step]
                    upper, lower = (v[:, x0] * (65536 - fx) + v[:, x1] * fx for v in (line(batch.column(c), at, width) for c in ("upper", "lower")))
                    fy = batch.column("fy").to_numpy()[at][:, None, None]
                    v = (upper * (65536 - fy) + lower * fy + HALF) >> SHIFT
                    _, x, c = np.indices(v.shape, np.int32).reshape(3, -1)
                    each = [np.repeat(batch.column(name).to_numpy()[at], new_w * 3) for name in ("frame_id", "y")]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, each), pa.array(x), pa.array(c), pa.array(v.reshape(-1).astype(np.int32))], names=["frame_id", "y", "x", "c", "v"])

    return pairs.mapInArrow(run, "frame_id long, y int, x int, c int, v int")


def point_frames(frames: DataFrame, name: str, amount=0) -> DataFrame:
    """A point operator (grayscale, uniform_gray, brightness, normalise) on whole frames, by the rule of its relational form. amount: what brightness adds, a column or a number."""
    change = {
        "grayscale": lambda image, r: luma_array(image),
        "uniform_gray": lambda image, r: (image.astype(np.int32) * LUMA[0] >> 8).astype(np.uint8),
        "brightness": lambda image, r: np.minimum(image.astype(np.int32) + r["amount"], 255).astype(np.uint8),
        "normalise": lambda image, r: image >> 1,
    }[name]
    whole = frames.where("width > 0 and height > 0 and data is not null").select("frame_id", "width", "height", "stride", "data", (F.lit(amount) if isinstance(amount, int) else amount).alias("amount"))
    return _each_frame(whole, ["amount"], change)


def nearest_frames(frames: DataFrame, sizes: DataFrame, along: str) -> DataFrame:
    """``resize_nearest`` on whole frames, along 'x' or 'y'; sizes: (frame_id, new_w, new_h)."""
    joined = frames.where("width > 0 and height > 0 and data is not null").join(sizes.where("new_w > 0 and new_h > 0").select("frame_id", "new_w", "new_h"), "frame_id")
    if along == "x":
        return _each_frame(joined, ["new_w"], lambda image, r: image[:, axis_places(image.shape[1], r["new_w"])[0]])
    return _each_frame(joined, ["new_h"], lambda image, r: image[axis_places(image.shape[0], r["new_h"])[0]])


def fused_frames(frames: DataFrame, params: DataFrame) -> DataFrame:
    """``fused_chain`` on whole frames."""
    joined = frames.where("width > 0 and height > 0 and data is not null").join(params.select("frame_id", "has_gray", "has_bright", F.coalesce("brightness", F.lit(0)).alias("brightness")), "frame_id")

    def change(image: np.ndarray, r: dict) -> np.ndarray:
        image = image.astype(np.int32) * LUMA[0] >> 8 if r["has_gray"] else image.astype(np.int32)
        return (np.minimum(image + r["brightness"], 255) if r["has_bright"] else image).astype(np.uint8)

    return _each_frame(joined, ["has_gray", "has_bright", "brightness"], change)


def crop_frames(frames: DataFrame, windows: DataFrame) -> DataFrame:
    """``crop`` on whole frames; windows: (frame_id, cx, cy, cw, ch)."""
    joined = frames.where("width > 0 and height > 0 and data is not null").join(windows.select("frame_id", "cx", "cy", "cw", "ch"), "frame_id")
    joined = joined.withColumn("ok", gates.crop_gate(F.col("cx"), F.col("cy"), F.col("cw"), F.col("ch"), F.col("width"), F.col("height")))
    return _each_frame(joined, ["cx", "cy", "cw", "ch", "ok"], lambda image, r: image[r["cy"] : r["cy"] + r["ch"], r["cx"] : r["cx"] + r["cw"]] if r["ok"] else image)


PLANES = "frame_id long, c int, width int, height int, data binary"


def planes_of(frames: DataFrame) -> DataFrame:
    """Frames -> a row of bytes for each channel, as ``to_planar``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for frame_id, width, height, stride, data in zip(*(batch.column(c).to_pylist() for c in ("frame_id", "width", "height", "stride")), batch.column("data"), strict=True):
                image = as_array(data.as_buffer(), width, height, stride)
                rows = [{"frame_id": frame_id, "c": c, "width": width, "height": height, "data": image[:, :, c].tobytes()} for c in range(3)]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("frame_id", pa.int64()), ("c", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("data", pa.binary())]))

    some = frames.where("width > 0 and height > 0 and data is not null")
    return some.select("frame_id", "width", "height", "stride", "data").mapInArrow(run, PLANES)


def frames_of_planes(planes: DataFrame) -> DataFrame:
    """``planes_of`` back to frames; one that lacks a channel goes."""
    whole = planes.groupBy("frame_id", "width", "height").agg(F.sort_array(F.collect_list(F.struct("c", "data"))).alias("planes")).where("size(planes) = 3")  # three rows
    flat = whole.select("frame_id", "width", "height", (F.col("width") * 3).alias("stride"), F.concat(*(F.col("planes")[c]["data"] for c in range(3))).alias("data"))

    def change(image: np.ndarray, r: dict) -> np.ndarray:
        return np.moveaxis(np.ascontiguousarray(image).reshape(3, r["height"], r["width"]), 0, 2)

    return _each_frame(flat, [], change)


def line_digests(frames: DataFrame) -> DataFrame:
    """(frame_id, y, n, digest): the bytes of each line of pixels, and their sum weighted by place (from 1). A task holds the sums of about ROWS lines, or of one frame."""

    def sums(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes = [batch.column(c).to_pylist() for c in ("width", "height", "stride")]
        sums = [as_array(data.as_buffer(), w, h, s).reshape(h, w * 3) @ np.arange(1, w * 3 + 1) for w, h, s, data in zip(*sizes, batch.column("data"), strict=True)]
        heights = [len(x) for x in sums]
        columns = [
            np.repeat(batch.column("frame_id").to_numpy(), heights),
            np.concatenate([np.arange(h) for h in heights]),
            np.repeat(np.array(sizes[0], np.int64) * 3, heights),
            np.concatenate(sums),
        ]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["frame_id", "y", "n", "digest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.cumsum(batch.column("height").to_numpy().astype(np.int64)) // ROWS
            starts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
            for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                yield sums(batch.slice(start, end - start))

    some = frames.where("width > 0 and height > 0 and data is not null")
    return some.select("frame_id", "width", "height", "stride", "data").mapInArrow(run, "frame_id long, y int, n long, digest long")


def luma_array(image: np.ndarray) -> np.ndarray:
    y = (image.astype(np.int32) @ np.array(LUMA, np.int32)) >> 8
    return np.repeat(y[..., None], 3, axis=2).astype(np.uint8)


def run_operation(image: np.ndarray, code: int, params: dict) -> np.ndarray:
    """One operation on a frame: a registered function if there is one, else the built-in."""
    own = pipelines.REGISTRY.get(code)
    if own is not None:
        return own.single(image, params) if own.single else own.batch([image], params)[0]
    if code == pipelines.GRAYSCALE:
        return luma_array(image)
    width = params["new_w"] if code in (pipelines.RESIZE, pipelines.RESIZE_H) else image.shape[1]
    height = params["new_h"] if code in (pipelines.RESIZE, pipelines.RESIZE_V) else image.shape[0]
    if code == pipelines.RESIZE:
        return resize_array(image, width, height)
    return image[axis_places(image.shape[0], height)[0]][:, axis_places(image.shape[1], width)[0]]


def run_together(images: list[np.ndarray], steps: list[list[dict]]) -> list[np.ndarray]:
    """Frames through their operations in turn; a batch function gets all frames whose next operation is its own, with the same parameters, in one call."""
    images = list(images)
    for k in range(max(map(len, steps), default=0)):
        groups: dict[tuple, list[int]] = {}
        for i, own in enumerate(steps):
            if k < len(own):
                groups.setdefault(tuple(sorted((n, v) for n, v in own[k].items() if n != "op_index")), []).append(i)
        for members in groups.values():
            params = steps[members[0]][k]
            own = pipelines.REGISTRY.get(params["op_code"])
            if own is not None and own.batch:
                made = own.batch([images[i] for i in members], params)
            else:
                made = [run_operation(images[i], params["op_code"], params) for i in members]
            for i, image in zip(members, made, strict=True):
                images[i] = image
    return images


def run_pipeline(frames: DataFrame, ops: DataFrame, lenient: bool = False) -> DataFrame:
    """frames with (pipeline_id = frame_id, op_index, op_code, brightness, new_w, new_h) -> frames after all their operations.

    A pipeline with an operation that doesn't resolve leaves its frame as it is,
    or (lenient) skips that operation. A pipeline of more than MOST operations leaves
    its frame as it is in both modes. One by one, an operation's frame function is
    preferred; lenient pipelines go in batches, where its batch function is.
    """
    known = F.broadcast(pipelines.registry_table(frames.sparkSession).select(F.col("op_code").alias("_code")))
    step = F.when(F.col("_code").isNotNull(), F.struct("op_index", "op_code", "brightness", "new_w", "new_h"))
    sane = F.bool_and(F.col("op_code").between(1, pipelines.MAX_CODE))
    # One pass over the operations: of each pipeline its known ones in order, and whether all of them are known and sane.
    lists = ops.join(known, ops["op_code"] == known["_code"], "left").groupBy("pipeline_id").agg(F.sort_array(F.collect_list(step)).alias("steps"), F.count("*").alias("ops"), (sane & (F.count("*") == F.count("_code"))).alias("whole"))
    lists = lists.where((F.col("ops") <= MOST) & (F.lit(lenient) | F.col("whole"))).select("pipeline_id", "steps")
    joined = frames.where("width > 0 and height > 0").join(lists, F.col("frame_id") == F.col("pipeline_id"), "left").drop("pipeline_id")
    registry = dict(pipelines.REGISTRY)

    def change(images, rows):
        pipelines.REGISTRY.update(registry)
        steps = [r["steps"] or [] for r in rows]
        if lenient:
            return run_together(images, steps)
        out = []
        for image, own in zip(images, steps, strict=True):
            for step in own:
                image = run_operation(image, step["op_code"], step)
            out.append(image)
        return out

    return _each_batch(joined, ["steps"], change)
