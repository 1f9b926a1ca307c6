"""Sinks: bands, sheets as files' bytes, PDF, job records, metrics text and the log index."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platen.operators import geometry

EXPORT = "job_id {}, bytes binary"  # by the type of the jobs' ids


def write_bands(bands: DataFrame, path: str, mode: str = "errorifexists") -> None:
    bands.write.mode(mode).parquet(path)


def _gathered(pdf: pd.DataFrame) -> tuple[int, int, bytes]:
    pdf = pdf.sort_values("band")
    return int(pdf["width"].iloc[0]), int(pdf["h"].sum()), b"".join(pdf["data"])


def export_sheets(bands: DataFrame) -> DataFrame:
    """(job_id, bytes): each sheet as a binary PPM. A group is one sheet, at most a few dozen megabytes at print resolution."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        width, height, data = _gathered(pdf)
        return pd.DataFrame({"job_id": [pdf["job_id"].iloc[0]], "bytes": [b"P6\n%d %d\n255\n" % (width, height) + data]})

    return bands.groupBy("job_id").applyInPandas(one, EXPORT.format(dict(bands.dtypes)["job_id"]))


def export_frames(frames: DataFrame) -> DataFrame:
    """(frame_id, bytes): each frame (without padding at its lines' ends) as a binary PPM."""
    head = F.concat(F.lit("P6\n"), F.col("width").cast("string"), F.lit(" "), F.col("height").cast("string"), F.lit("\n255\n")).cast("binary")
    packed = frames.where("width > 0 and height > 0 and data is not null and stride = width * 3")
    return packed.select("frame_id", F.concat(head, "data").alias("bytes"))


def frames_from_ppm(files: DataFrame) -> DataFrame:
    """(frame_id, bytes) -> frames; what isn't such a PPM goes."""
    head = F.split(F.substring("bytes", 1, 40).cast("string"), "\n")
    size = F.split(head[1], " ")
    read = files.where(F.substring("bytes", 1, 3) == F.lit(b"P6\n")).select("frame_id", size[0].try_cast("int").alias("width"), size[1].try_cast("int").alias("height"), (F.length(head[1]) + 8).alias("_at"), "bytes")
    whole = read.where(F.octet_length("bytes") - F.col("_at") == F.col("width") * F.col("height") * 3)
    return whole.select("frame_id", "width", "height", F.lit(3).alias("channels"), (F.col("width") * 3).alias("stride"), F.expr("substring(bytes, _at + 1)").alias("data"))


class Ref(int):
    """The number of a PDF object that another one names."""


def pdf_value(x: object) -> str:
    """A Python value in PDF's syntax: dicts, lists, references, numbers and names (strings)."""
    if isinstance(x, dict):
        return "<<" + " ".join(f"/{k} {pdf_value(v)}" for k, v in x.items()) + ">>"
    if isinstance(x, list):
        return "[" + " ".join(map(pdf_value, x)) + "]"
    if isinstance(x, Ref):
        return f"{int(x)} 0 R"
    return f"{x:.2f}" if isinstance(x, float) else f"/{x}" if isinstance(x, str) else str(x)


def pdf_file(objects: list[tuple[dict, bytes | None]]) -> bytes:
    """Objects (dictionary, stream or None), the first of them the root, as a file with its table of places."""
    parts, places = [b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n"], []
    for k, (entries, stream) in enumerate(objects, 1):
        places.append(sum(map(len, parts)))
        if stream is not None:
            entries = entries | {"Length": len(stream)}
        body = pdf_value(entries).encode() + (b"" if stream is None else b"\nstream\n" + stream + b"\nendstream")
        parts.append(b"%d 0 obj\n%s\nendobj\n" % (k, body))
    table = ["0000000000 65535 f ", *(f"{p:010d} 00000 n " for p in places)]
    end = ["xref", f"0 {len(table)}", *table, "trailer", pdf_value({"Size": len(table), "Root": Ref(1)}), "startxref", str(sum(map(len, parts))), "%%EOF", ""]
    return b"".join(parts) + "\n".join(end).encode()


def pdf_bytes(width: int, height: int, rgb: bytes, w_pt: float, h_pt: float) -> bytes:
    """A PDF of one page that the image fills; the image is deflated."""
    page = {"Type": "Page", "Parent": Ref(2), "MediaBox": [0, 0, float(w_pt), float(h_pt)], "Contents": Ref(4), "Resources": {"XObject": {"Sheet": Ref(5)}}}
    image = {"Type": "XObject", "Subtype": "Image", "Width": width, "Height": height, "ColorSpace": "DeviceRGB", "BitsPerComponent": 8, "Filter": "FlateDecode"}
    drawing = f"{w_pt:.2f} 0 0 {h_pt:.2f} 0 0 cm /Sheet Do".encode()
    return pdf_file([({"Type": "Catalog", "Pages": Ref(2)}, None), ({"Type": "Pages", "Kids": [Ref(3)], "Count": 1}, None), (page, None), ({}, drawing), (image, zlib.compress(rgb, 6))])


def export_pdf(bands: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job_id, bytes): each sheet as a PDF page of its size in points."""
    sized = geometry.page_size(jobs).select("job_id", geometry.pdf_points(F.col("page_w"), F.col("dpi")).alias("w_pt"), geometry.pdf_points(F.col("page_h"), F.col("dpi")).alias("h_pt"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        width, height, data = _gathered(pdf)
        return pd.DataFrame({"job_id": [pdf["job_id"].iloc[0]], "bytes": [pdf_bytes(width, height, data, float(pdf["w_pt"].iloc[0]), float(pdf["h_pt"].iloc[0]))]})

    return bands.join(sized, "job_id").groupBy("job_id").applyInPandas(one, EXPORT.format(dict(bands.dtypes)["job_id"]))


def upsert_jobs(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Job records after updates: only what an update gives overwrites; the last update of a job that gives a column wins."""
    keys = [c for c in current.columns if c != "job_id"]
    given = [c for c in updates.columns if c in keys]
    order = F.struct("ts", "event_id") if "event_id" in updates.columns else F.col("ts")
    last = updates.groupBy("job_id").agg(*(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(f"_{c}") for c in given))
    joined = current.join(last, "job_id", "full_outer")
    return joined.select("job_id", *(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in given else F.col(c) for c in keys))


def write_log_index(logs: DataFrame, path: str, mode: str = "append") -> None:
    """Logs as Parquet by day and level."""
    dated = logs.withColumn("day", F.to_date("time"))
    dated.write.mode(mode).partitionBy("day", "level").parquet(path)
