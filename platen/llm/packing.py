"""Texts as they travel through a shuffle: compressed harder than Spark's own codec does."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platen.llm.textbytes import STEP


@F.arrow_udf(T.BinaryType())
def packed(texts: pa.Array) -> pa.Array:
    code = zstandard.ZstdCompressor(level=1)
    return pa.array([None if t is None else code.compress(t.as_py().encode()) for t in map(_valid, texts)], pa.binary())


def _valid(x: pa.Scalar) -> pa.Scalar | None:
    return x if x.is_valid else None


def unpacked(batch: pa.RecordBatch, column: str = "text", step: int = STEP) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``step`` bytes of text, with the column as texts again."""
    place, data = batch.schema.get_field_index(column), batch.column(column)
    texts, held, start = [], 0, 0
    for k in range(batch.num_rows + 1):
        if k == batch.num_rows or held >= step:
            if texts:
                part = batch.slice(start, len(texts))
                yield part.set_column(place, column, pa.array(texts, pa.large_string()))
            texts, held, start = [], 0, k
        if k < batch.num_rows:
            texts.append(zstandard.decompress(data[k].as_py()).decode() if data[k].is_valid else None)
            held += len(texts[-1] or "")
