"""Sheets as PDF files, written band by band: no task holds more of a sheet than one band.

Bands are dealt out by job and sorted within their partitions, or come as they were
rendered, then each one is deflated as it comes. ``pdf_chunks`` gives the files' bytes as rows, in order;
``write_pdf`` writes files by a data source of its own, whose commit is one manifest:
what a failed task or job has left behind is in no manifest, so nobody reads it.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_type

from platen.operators import geometry
from platen.sources.binary import opened
from platen.sources.sinks import Ref, pdf_value

#: Bytes of a chunk, about; rows of an output batch.
CHUNK, ROWS = 1 << 20, 4096
#: What a band carries of its page beside its width.
SIZE = ("height", "w_pt", "h_pt")
CATALOG, PAGES, PAGE, DRAWING, IMAGE, LENGTH = range(1, 7)


@lru_cache(maxsize=1024)
def opening(width: int, height: int, w_pt: float, h_pt: float) -> tuple[bytes, dict[int, int]]:
    """A PDF of one page that an image fills, up to the image's data, and where its objects start: alike for sheets of one size."""
    drawing = f"{w_pt:.2f} 0 0 {h_pt:.2f} 0 0 cm /Sheet Do".encode()
    image = {"Type": "XObject", "Subtype": "Image", "Width": width, "Height": height, "ColorSpace": "DeviceRGB", "BitsPerComponent": 8, "Filter": "FlateDecode", "Length": Ref(LENGTH)}
    page = {"Type": "Page", "Parent": Ref(PAGES), "MediaBox": [0, 0, float(w_pt), float(h_pt)], "Contents": Ref(DRAWING), "Resources": {"XObject": {"Sheet": Ref(IMAGE)}}}
    head, places = b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n", {}
    for number, value, rest in (
        (CATALOG, {"Type": "Catalog", "Pages": Ref(PAGES)}, b"\nendobj\n"),
        (PAGES, {"Type": "Pages", "Kids": [Ref(PAGE)], "Count": 1}, b"\nendobj\n"),
        (PAGE, page, b"\nendobj\n"),
        (DRAWING, {"Length": len(drawing)}, b"\nstream\n" + drawing + b"\nendstream\nendobj\n"),
        (IMAGE, image, b"\nstream\n"),
    ):
        places[number] = len(head)
        head += b"%d 0 obj\n%s%s" % (number, pdf_value(value).encode(), rest)
    return head, places


class PdfStream:
    """A PDF of one page that an image fills, as bytes in order; the image comes line by line and its length is told after it."""

    def __init__(self, width: int, height: int, w_pt: float, h_pt: float):
        self.code = zlib.compressobj(6)
        self.head, places = opening(width, height, w_pt, h_pt)
        self.places, self.size = dict(places), len(self.head)
        self.before = self.size

    def _told(self, data: bytes) -> bytes:
        self.size += len(data)
        return data

    def add(self, rgb: bytes) -> bytes:
        return self._told(self.code.compress(rgb))

    def end(self) -> bytes:
        last = self._told(self.code.flush())
        n = self.size - self.before
        closing = self._told(b"\nendstream\nendobj\n")
        self.places[LENGTH] = self.size
        closing += self._told(b"%d 0 obj\n%d\nendobj\n" % (LENGTH, n))
        table = ["0000000000 65535 f ", *(f"{self.places[k]:010d} 00000 n " for k in sorted(self.places))]
        tail = ["xref", f"0 {len(table)}", *table, "trailer", pdf_value({"Size": len(table), "Root": Ref(CATALOG)}), "startxref", str(self.size), "%%EOF", ""]
        return last + closing + "\n".join(tail).encode()


def in_order(bands: DataFrame, jobs: DataFrame) -> DataFrame:
    """Bands with their sheet's size in pixels and points, dealt out by job and sorted by band."""
    joined = bands.join(with_size(jobs).select("job_id", *SIZE), "job_id").select("job_id", "band", "width", *SIZE, "data")
    return joined.repartition("job_id").sortWithinPartitions("job_id", "band")


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, bytes, bool]]:
    """(job_id, bytes, whether the file ends with them) of the files of a partition, in order."""
    job = pdf = None
    for batch in batches:
        values = [batch.column(c).to_pylist() for c in ("job_id", "width", "height", "w_pt", "h_pt")]
        for (own, *size), data in zip(zip(*values, strict=True), batch.column("data"), strict=True):
            if pdf is None or own != job:
                if pdf is not None:
                    yield job, pdf.end(), True
                job, pdf = own, PdfStream(*size)
                yield job, pdf.head, False
            yield job, pdf.add(data.as_buffer()), False
    if pdf is not None:
        yield job, pdf.end(), True


def _gathered(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches of up to ROWS of them or CHUNK bytes (of their last value)."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if len(held) >= ROWS or size >= CHUNK:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def with_size(jobs: DataFrame) -> DataFrame:
    """Jobs with their page's size in pixels and points, as SIZE names it: for bands that carry it."""
    sized = geometry.page_size(jobs)
    points = {c: geometry.pdf_points(F.col(p), F.col("dpi")) for c, p in (("w_pt", "page_w"), ("h_pt", "page_h"))}
    return sized.withColumns({"height": F.col("page_h")} | points)


def pdf_chunks(bands: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """(job_id, part, bytes): each sheet's PDF in parts of about CHUNK bytes, from 0 on. Jobs without bands have none.

    Without jobs the bands carry SIZE and come as they were rendered, those of a sheet
    one after another: files are written in the tasks that render them, nothing is dealt
    out.
    """
    kind = dict(bands.dtypes)["job_id"]
    schema = pa.schema([("job_id", to_arrow_type(bands.schema["job_id"].dataType)), ("part", pa.int64()), ("bytes", pa.binary())])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        part, held, size = 0, [], 0
        for job, data, ends in _files(batches):
            held.append(data)
            size += len(data)
            if ends or size >= CHUNK:
                yield job, part, b"".join(held)
                part, held, size = (0 if ends else part + 1), [], 0

    ordered = bands.select("job_id", "band", "width", *SIZE, "data") if jobs is None else in_order(bands, jobs)
    return ordered.mapInArrow(lambda batches: _gathered(parts(batches), schema), f"job_id {kind}, part long, bytes binary")


def pdf_images(chunks: DataFrame, ordered: bool = False) -> DataFrame:
    """(job_id, part, bytes) -> (job_id, width, height, n_bytes, image_sha256): the files read back part by part, the image's pixels as inflated. ordered: the parts come as ``pdf_chunks`` gives them."""
    import hashlib
    import re

    kind = dict(chunks.dtypes)["job_id"]
    schema = pa.schema([("job_id", to_arrow_type(chunks.schema["job_id"].dataType)), *((c, pa.int64()) for c in ("width", "height", "n_bytes")), ("image_sha256", pa.string())])
    start = re.compile(rb"/Subtype /Image /Width (\d+) /Height (\d+) .*?\nstream\n", re.S)

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        job = reader = None

        def row() -> tuple:
            width, height, _, digest, n = reader
            return job, width, height, n, digest.hexdigest()

        for batch in batches:
            for own, part, data in zip(*(batch.column(c).to_pylist() for c in ("job_id", "part", "bytes")), strict=True):
                if part == 0:
                    if reader is not None:
                        yield row()
                    found = start.search(data)
                    job, reader, at = own, [int(found[1]), int(found[2]), zlib.decompressobj(), hashlib.sha256(), 0], found.end()
                else:
                    at = 0
                pixels = reader[2].decompress(data[at:]) if not reader[2].eof else b""
                reader[3].update(pixels)
                reader[4] += len(pixels)
        if reader is not None:
            yield row()

    parts = chunks if ordered else chunks.repartition("job_id").sortWithinPartitions("job_id", "part")
    return parts.mapInArrow(lambda batches: _gathered(images(batches), schema), f"job_id {kind}, width long, height long, n_bytes long, image_sha256 string")


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: list[str] = field(default_factory=list)


class SheetFiles(DataSource):
    """``sheet_pdf``: option path."""

    @classmethod
    def name(cls) -> str:
        return "sheet_pdf"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return SheetWriter(self.options["path"])


class SheetWriter(DataSourceArrowWriter):
    """Each task has a folder of its own; the driver names those of a finished job in a manifest."""

    def __init__(self, path: str):
        self.path, self.run = path.rstrip("/"), uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, base = opened(self.path)
        done = Written(f"part-{self.run}-{uuid.uuid4().hex}")
        out = None
        for job, data, ends in _files(iterator):
            if out is None:
                if not done.files:
                    system.create_dir(f"{base}/{done.folder}", recursive=True)
                done.files.append(f"{quote(str(job), safe='')}.pdf")
                out = system.open_output_stream(f"{base}/{done.folder}/{done.files[-1]}")
            out.write(data)
            if ends:
                out.close()
                out = None
        return done

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, base = opened(self.path)
        system.create_dir(base, recursive=True)
        folders = sorted(m.folder for m in messages if m is not None and m.files)
        with system.open_output_stream(f"{base}/_manifest-{self.run}.json") as out:
            out.write(json.dumps(folders).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, base = opened(self.path)
        if system.get_file_info(base).type == fs.FileType.Directory:
            for info in system.get_file_info(fs.FileSelector(base)):
                if info.base_name.startswith(f"part-{self.run}-"):
                    system.delete_dir(info.path)


def write_pdf(bands: DataFrame, jobs: DataFrame, path: str) -> None:
    """A PDF for each sheet below the path, which executors and driver share."""
    bands.sparkSession.dataSource.register(SheetFiles)
    in_order(bands, jobs).write.format("sheet_pdf").option("path", path).mode("append").save()


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of the sheets that a manifest names."""
    system, base = opened(path)
    folders: set[str] = set()
    for info in system.get_file_info(fs.FileSelector(base)):
        if info.base_name.startswith("_manifest-"):
            with system.open_input_stream(info.path) as f:
                folders |= set(json.loads(f.read()))
    found = spark.read.format("binaryFile").load([f"{path.rstrip('/')}/{f}" for f in sorted(folders)])
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
