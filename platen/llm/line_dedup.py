"""Line dedup by a deletion-neighbourhood join, within edit distance 1.

A line (``MIN_CHARS`` code points or more) goes if an earlier line of the corpus
is within the bound, and with ``short`` a shorter line with a word in it goes if an
earlier line equals it; earlier means a smaller (doc_id, line number), and lines are
judged on the input. What is left keeps its order.

1. Equal lines: the smallest position of each (128-bit) line hash.
2. A line within one edit of another agrees with it outside one of three
   segments. So each line is keyed by what remains without each segment, in the
   segments of its own length and of a line one longer; a line whose keys are all
   its own has no neighbour and emits nothing further.
3. The others emit the deletion variants of the segments that a live key leaves
   open, as hashed keys. Lines that meet in a variant differ by a substitution at
   that place, or by the deleted character; the earliest of the meeting lines is
   each one's partner, so a key makes one pair for a line and never all pairs.
4. Pairs are verified by edit distance over the lines' texts.

Defined results: null texts stay null; empty lines and short lines without a word
stay, all short lines stay without ``short``; a repeated line of MIN_CHARS or more
goes also if it has no word (a rule of dashes, blanks); rows with a
null doc_id are left alone; rows that repeat a doc_id are judged line by line at
their own positions, so equal rows stay equal; an empty table gives an empty
result; all columns of the input are returned, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platen.llm import textbytes as tb
from platen.llm.packing import packed
from platen.llm.shared import small_batches, stored, unused

_U = np.uint64

MIN_CHARS = 20
SEGMENTS = 3
#: Lines that a task remembers while it looks for repeats.
SEEN = 1 << 19


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def line_hash(data: bytes) -> tuple[int, int]:
    both = xxhash.xxh3_128_intdigest(data)
    return _signed(both >> 64), _signed(both & (1 << 64) - 1)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _sums(codes: np.ndarray) -> np.ndarray:
    """S with S[e] - S[s] = P**s * hash(codes[s:e])."""
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(tb.mix(codes.astype(np.uint64) + _U(1)) * tb.powers(len(codes))[0], out=total[1:])
    return total


def segment_keys(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, from, to), each lines x 2 * SEGMENTS: the line without its characters from..to, as a key.

    The first SEGMENTS: the line among lines of its length and as the longer of two.
    The others: as the shorter of two, where the segment lacks a character.
    """
    total = _sums(codes)
    inverse = tb.powers(len(total))[1]
    size = ends - starts
    keys, low, high = [], [], []
    for shift in (0, 1):
        cuts = [(size + shift) * k // SEGMENTS for k in range(SEGMENTS + 1)]
        for k in range(SEGMENTS):
            a, z = starts + cuts[k], starts + cuts[k + 1] - shift
            head = (total[a] - total[starts]) * inverse[starts]
            tail = (total[ends] - total[z]) * inverse[z]
            place = (size + shift).astype(np.uint64) * _U(2 * SEGMENTS) + _U(k)
            keys.append(tb.mix(tb.mix(head + tb.mix(place)) + tail))
            low.append(a)
            high.append(z)
    return np.stack(keys, axis=1), np.stack(low, axis=1), np.stack(high, axis=1)


def variants(line: str, live: set[int]) -> tuple[np.ndarray, np.ndarray]:
    """(variant keys, roles). Role 0: by substitution at one place; 1: without one character; 2: as it is, the shorter line of a pair."""
    codes = _codes(line)
    keys, low, high = (x[0] for x in segment_keys(codes, np.array([0]), np.array([len(codes)])))
    out, roles = [], []
    for k in range(2 * SEGMENTS):
        key = keys[k : k + 1]
        if int(key.view(np.int64)[0]) not in live:
            continue
        middle = codes[low[k] : high[k]]
        total = _sums(middle)
        if k >= SEGMENTS:
            out.append(tb.mix(total[-1:] ^ tb.mix(key + _U(1))))
            roles.append(np.full(1, 2, np.int8))
            continue
        rest = total[:-1] + (total[-1] - total[1:]) * tb.powers(2)[1][1]
        at = np.arange(len(middle), dtype=np.uint64)
        out.append(tb.mix(rest ^ tb.mix(key + _U(2) + at)))
        roles.append(np.zeros(len(rest), np.int8))
        own = np.ones(len(middle), bool)
        own[1:] = middle[1:] != middle[:-1]  # a run gives one text
        out.append(tb.mix(rest[own] ^ tb.mix(key + _U(1))))
        roles.append(np.ones(int(own.sum()), np.int8))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int8)
    return np.concatenate(out).view(np.int64), np.concatenate(roles)


def _has_word(line: str) -> bool:
    return any(map(str.isalnum, line))


def _lines(batches: Iterator[pa.RecordBatch], short: bool = False) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            h, g, ids, numbers = [], [], [], []
            part = batch.slice(at, 512)
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                if doc is None or not text:
                    continue
                for k, line in enumerate(text.split("\n")):
                    if len(line) >= MIN_CHARS or (short and _has_word(line)):
                        x, y = line_hash(line.encode())
                        h.append(x)
                        g.append(y)
                        ids.append(doc)
                        numbers.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(g, pa.int64()), pa.array(ids, pa.int64()), pa.array(numbers, pa.int32())], names=["h", "g", "doc_id", "line_no"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, h): the segment keys of each line, once for a line among SEEN of a partition."""
    seen: set[int] = set()
    for batch in batches:
        for part, _, _ in tb.slices(batch, step=1 << 19):
            if len(seen) > SEEN:
                seen.clear()
            lines, hashes = [], []
            for text in part.column("text").to_pylist():
                for line in (text or "").split("\n"):
                    if len(line) >= MIN_CHARS:
                        h = line_hash(line.encode())[0]
                        if h not in seen:
                            seen.add(h)
                            lines.append(line)
                            hashes.append(h)
            ends = np.cumsum(np.array([len(x) for x in lines], np.int64))
            keys = segment_keys(_codes("".join(lines)), ends - np.diff(ends, prepend=0), ends)[0]
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(np.array(hashes, np.int64), 2 * SEGMENTS))], names=["key", "h"])


def _picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, g, doc_id, line_no, line, live): the wanted lines of each text."""
    for batch in batches:
        for row in range(batch.num_rows):
            want = batch.column("want")[row].as_py()
            lines = zstandard.decompress(batch.column("text")[row].as_py()).decode().split("\n")
            found = []
            for w in want:
                # rows may repeat a doc_id with another text
                if w["line_no"] < len(lines) and line_hash(lines[w["line_no"]].encode()) == (w["h"], w["g"]):
                    found.append((w, lines[w["line_no"]]))
            n = len(found)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([w["h"] for w, _ in found], pa.int64()),
                    pa.array([w["g"] for w, _ in found], pa.int64()),
                    pa.array([batch.column("doc_id")[row].as_py()] * n, pa.int64()),
                    pa.array([w["line_no"] for w, _ in found], pa.int32()),
                    pa.array([line for _, line in found], pa.string()),
                    pa.array([w["live"] for w, _ in found], pa.list_(pa.int64())),
                ],
                names=["h", "g", "doc_id", "line_no", "line", "live"],
            )


def _varied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            rows = batch.slice(at, 64).to_pylist()
            each = [variants(r["line"], set(r["live"])) for r in rows]
            sizes = [len(v) for v, _ in each]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([v for v, _ in each])),
                    pa.array(np.concatenate([r for _, r in each])),
                    pa.array(np.repeat(np.array([r["doc_id"] for r in rows], np.int64), sizes)),
                    pa.array(np.repeat(np.array([r["line_no"] for r in rows], np.int32), sizes)),
                ],
                names=["variant", "role", "doc_id", "line_no"],
            )


@F.arrow_udf(T.StringType())
def without_lines(texts: pa.Array, gone: pa.Array) -> pa.Array:
    """Unpacked texts without the lines that ``gone`` names by number and hash."""

    def one(data: pa.Scalar, lines: pa.Scalar) -> str | None:
        if not data.is_valid:
            return None
        text = zstandard.decompress(data.as_py()).decode()
        if not lines.is_valid:
            return text
        out = {(x["line_no"], x["h"], x["g"]) for x in lines.as_py()}
        numbers = {x[0] for x in out}
        return "\n".join(line for k, line in enumerate(text.split("\n")) if k not in numbers or (k, *line_hash(line.encode())) not in out)

    return pa.array([one(d, g) for d, g in zip(texts, gone, strict=True)], pa.string())


def near_lines(docs: DataFrame, first: DataFrame) -> DataFrame:
    """(h, g) of the distinct lines with an earlier line one edit away.

    first: (h, g, at struct<doc_id, line_no>), the distinct lines.
    """
    keyed = docs.select("text").mapInArrow(_keyed, "key long, h long")
    live = keyed.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a != b").select("key")
    open_lines = keyed.join(live.hint("shuffle_hash"), "key").groupBy("h").agg(F.collect_set("key").alias("live"))  # six at most
    wanted = first.join(open_lines, "h").select(F.col("at.doc_id").alias("doc_id"), F.struct(F.col("at.line_no").alias("line_no"), "h", "g", "live").alias("w"))
    wanted = wanted.groupBy("doc_id").agg(F.collect_list("w").alias("want"))  # lines of one document
    texts = docs.where("text is not null").select("doc_id", packed("text").alias("text")).join(wanted, "doc_id")
    lines = stored(texts.mapInArrow(_picked, "h long, g long, doc_id long, line_no int, line string, live array<long>").dropDuplicates(["h", "g"]), "lines")

    varied = stored(lines.select("line", "live", "doc_id", "line_no").mapInArrow(_varied, "variant long, role byte, doc_id long, line_no int"), "varied")
    at = F.struct("doc_id", "line_no")
    # Of a variant: the earliest line by substitution, the earliest longer line and the shorter line.
    meets = varied.groupBy("variant").agg(
        F.count("*").alias("n"),
        F.min(F.when(F.col("role") == 0, at)).alias("same"),
        F.min(F.when(F.col("role") == 1, at)).alias("longer"),
        F.min(F.when(F.col("role") == 2, at)).alias("shorter"),
    )
    meets = meets.where("n > 1 and (same is not null or (longer is not null and shorter is not null))").drop("n")
    partner = F.when(F.col("role") == 0, F.col("same")).when(F.col("role") == 1, F.col("shorter")).otherwise(F.col("longer"))
    pairs = varied.join(meets, "variant").select(at.alias("at"), partner.alias("partner")).where("partner < at").distinct()
    text_of = lambda name: lines.select(at.alias(name), F.col("line").alias(f"{name}_line"), *(["h", "g"] if name == "at" else []))
    verified = pairs.join(text_of("at"), "at").join(text_of("partner"), "partner").where(F.levenshtein("at_line", "partner_line", 1) == 1)
    return verified.select("h", "g").distinct()


def repeated_lines(docs: DataFrame, short: bool = False) -> DataFrame:
    """documents -> (doc_id, line_no, h, g) of the lines that go."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    lines = docs.mapInArrow(partial(_lines, short=short), "h long, g long, doc_id long, line_no int")
    first = stored(lines.groupBy("h", "g").agg(F.min(F.struct("doc_id", "line_no")).alias("at")), "first")
    near = stored(near_lines(docs, first).withColumn("near", F.lit(True)), "near")
    marked = first.join(near, ["h", "g"], "left")
    found = lines.join(marked, ["h", "g"]).where((F.struct("doc_id", "line_no") > F.col("at")) | F.coalesce("near", F.lit(False)))
    return found.select("doc_id", "line_no", "h", "g")


def dedup_lines(docs: DataFrame, short: bool = False, removed: str = "lines_removed") -> DataFrame:
    """documents -> the same columns and ``removed`` (long; a column of that name is replaced), with the repeated lines taken out of ``text``; with ``short`` exact repeats of short lines too."""
    small_batches(docs.sparkSession)
    docs = docs.select(*(docs[c] for c in docs.columns if c.lower() != removed.lower()))
    lines, doc = unused("gone_lines", docs), unused("gone_doc", docs)
    gone = repeated_lines(docs, short).groupBy("doc_id").agg(F.collect_set(F.struct("line_no", "h", "g")).alias(lines)).withColumnRenamed("doc_id", doc)
    joined = docs.select(*(packed("text").alias("text") if c == "text" else docs[c] for c in docs.columns)).join(gone, F.col("doc_id").cast("long") == F.col(doc), "left")
    fresh = [without_lines("text", lines).alias("text") if c == "text" else F.col(c) for c in docs.columns]
    return joined.select(*fresh, F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(removed))
