"""Media columns: bytes stored as WAV, read back by the wave module and fingerprinted.

``store_wav`` writes each text's padded bytes as a mono WAV of 8-bit samples.
``fingerprint_wav`` reads the stored bytes, takes a short-time Fourier transform,
keeps the strongest bin of every time-frequency tile and stores the pairs of
near peaks as two arrays of one length: the time code and the pair's hash.

Defined results: null and empty texts are one block of 64 zero bytes; media that
are null or no readable WAV give nulls; equal texts give equal values; columns
beyond ``doc_id`` and ``text`` are not read, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platen.llm import textbytes as tb
from platen.llm.shared import small_batches

RATE, BLOCK = 8000, 64
#: Samples of a frame, samples from frame to frame, frames of a tile, bins of a tile.
FRAME, HOP, TILE_T, TILE_F = 256, 128, 8, 32
#: An anchor is paired with the peaks of so many tile columns, its own included.
ZONE = 3
#: Frames transformed at a time; a multiple of TILE_T.
FRAMES = 8192

STORED = "doc_id long, n_bytes long, media binary"
PRINTED = "doc_id long, payload_bytes long, payload_sha256 string, tail_crc32 long, fp_time array<int>, fp_hash array<int>"


def wav_of(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def samples_of(media: bytes | None) -> bytes | None:
    """The samples of a stored WAV, or None if it can't be read."""
    try:
        with wave.open(io.BytesIO(media or b""), "rb") as w:
            return w.readframes(w.getnframes())
    except (wave.Error, EOFError):
        return None


def padded(data: bytes) -> bytes:
    return data.ljust(max(1, -(-len(data) // BLOCK)) * BLOCK, b"\0")


def peaks_of(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Time (in tiles) and bin of the strongest bin of each tile that isn't silent, by time and then bin."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - np.float32(128)
    count = max(1, -(-(len(x) - FRAME) // HOP) + 1)
    count = -(-count // TILE_T) * TILE_T
    x = np.pad(x, (0, max(0, (count - 1) * HOP + FRAME - len(x))))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP][:count]
    window = np.hanning(FRAME).astype(np.float32)
    times, bins = [], []
    for at in range(0, count, FRAMES):
        part = np.fft.rfft(frames[at : at + FRAMES] * window, axis=1)[:, 1:]
        power = np.log1p(part.real**2 + part.imag**2).astype(np.float32)
        tiles = power.reshape(-1, TILE_T, FRAME // 2 // TILE_F, TILE_F).transpose(0, 2, 1, 3).reshape(-1, FRAME // 2 // TILE_F, TILE_T * TILE_F)
        best = tiles.argmax(axis=2)
        t, band = np.nonzero(tiles.max(axis=2) > 0)
        times.append(t + at // TILE_T)
        bins.append(band * TILE_F + best[t, band] % TILE_F + 1)
    return np.concatenate(times), np.concatenate(bins)


def pairs_of(times: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time codes and hashes of each peak with the later ones of its zone (a tile column has FRAME/2/TILE_F peaks at most)."""
    codes, hashes = [], []
    for step in range(1, ZONE * (FRAME // 2 // TILE_F)):
        a, b = slice(None, -step), slice(step, None)
        gap = times[b] - times[a]
        near = gap < ZONE
        codes.append(times[a][near])
        hashes.append((bins[a][near] << 16) | (bins[b][near] << 8) | gap[near])
    if not codes:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    codes, hashes = np.concatenate(codes), np.concatenate(hashes)
    order = np.lexsort((hashes, codes))
    return codes[order].astype(np.int32), hashes[order].astype(np.int32)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, _, _ in tb.slices(batch):
            data = [(t or "").encode() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(d) for d in data], pa.int64()), pa.array([wav_of(padded(d)) for d in data], pa.binary())],
                names=["doc_id", "n_bytes", "media"],
            )


def _lists(parts: list[np.ndarray | None]) -> pa.Array:
    full = [np.zeros(0, np.int32) if p is None else p for p in parts]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in full])]).astype(np.int32)
    mask = pa.array([p is None for p in parts], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(full), pa.int32()), mask=mask)


def _print(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "payload_bytes", "payload_sha256", "tail_crc32", "fp_time", "fp_hash"]
    for batch in batches:
        for part, _, _ in tb.slices(batch, "media"):
            read = [samples_of(m) for m in part.column("media").to_pylist()]
            prints = [(None, None) if s is None else pairs_of(*peaks_of(s)) for s in read]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([None if s is None else len(s) for s in read], pa.int64()),
                    pa.array([None if s is None else hashlib.sha256(s).hexdigest() for s in read], pa.string()),
                    pa.array([None if s is None else zlib.crc32(s[-BLOCK:]) for s in read], pa.int64()),
                    _lists([p[0] for p in prints]),
                    _lists([p[1] for p in prints]),
                ],
                names=names,
            )


def store_wav(docs: DataFrame) -> DataFrame:
    """documents -> (doc_id, n_bytes, media): one WAV for each row."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_store, STORED)


def fingerprint_wav(stored: DataFrame) -> DataFrame:
    """(doc_id, media, ...) -> (doc_id, payload_bytes, payload_sha256, tail_crc32, fp_time, fp_hash), read from the stored bytes."""
    return stored.select("doc_id", "media").mapInArrow(_print, PRINTED)


def media_columns(docs: DataFrame) -> DataFrame:
    """documents -> (doc_id, n_bytes, media, payload_*, tail_crc32, fp_time, fp_hash); narrow, one pass, no shuffle."""

    small_batches(docs.sparkSession)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stored in _store(batches):
            at = 0
            for printed in _print(iter([stored])):  # stored bytes are longer than texts, so these may be several slices
                part = stored.slice(at, printed.num_rows)
                at += printed.num_rows
                yield pa.RecordBatch.from_arrays([*part.columns, *printed.columns[1:]], names=[*stored.schema.names, *printed.schema.names[1:]])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(both, STORED + PRINTED.removeprefix("doc_id long"))
