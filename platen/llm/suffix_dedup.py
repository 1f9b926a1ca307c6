"""Suffix-array dedup: bytes of repeated passages, by bounded interval expansion on a BWT.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts in a
document with a smaller doc_id. The corpus is cut so that equal strings meet:

1. Each string of LENGTH bytes is named by the smallest hash of its SEED-byte
   substrings. A run of strings of one name is a fragment: the bytes that they
   cover. Equal strings have equal names, so a match never crosses two names.
   Fragments with the same bytes (64-bit name and 64-bit content hash) are
   collapsed to the smallest doc_id before the shuffle and again after it; the
   others of them lie in a smaller document as a whole. Only hashes and positions
   are shuffled here, and the texts are cut into fragments once.
2. Names that one document alone has are dropped. Where a name has several
   different fragments, their bytes are fetched and dealt out by name.
3. A task takes blocks of fragments. A string reaches HALF bytes or more to the
   left of its seed or to the right of it, so a fragment that shares neither side
   with another document's has no match and leaves. The others are indexed: suffix
   array (sorted as deep as needed), Burrows-Wheeler transform, and a
   breadth-first backward extension of intervals. Round l extends the intervals of
   all strings of length l by each character and thereby marks the places where the
   common prefix is exactly l long; it stops after LENGTH rounds, when what is
   unmarked has a common prefix of LENGTH or more. The smallest doc_id of such an
   interval decides its strings.
4. A name with more than HOT different fragments is no block: its strings are
   compared by 128-bit hashes, whose smallest doc_id is taken before the shuffle.
5. Removed ranges are gathered by document and cut out of the bytes.

Defined results: null and empty texts have no bytes; texts under LENGTH bytes stay
whole; strings that repeat within one doc_id alone stay; rows that repeat a doc_id
are one document for the comparison, each cut by the ranges of its own text, and a
null doc_id is left alone; an empty table gives an empty result; only ``doc_id``
and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platen.llm import textbytes as tb
from platen.llm.packing import packed
from platen.llm.shared import small_batches, stored, versioned

LENGTH, SEED = 50, 16
#: What a string has on one side of its seed at least.
HALF = (LENGTH - SEED) // 2
#: Strings of a fragment at most; bytes of text in a vectorised step; fragments collapsed at a time before the shuffle.
RUN, STEP, COLLAPSE = 64, 1 << 18, 1 << 20
#: Bytes of fragments in one index; a name's fragments stay together.
BLOCK = 1 << 20
#: Different fragments of a name that an index takes.
HOT = 4096
_U = np.uint64
_BREAK = 0xFF  # no byte of UTF-8
#: A place is version * 2**32 + start; a row's ``at`` is place * 128 + strings of the fragment.
_START = (1 << 32) - 1
_A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)
RANGE = "doc_id long, version int, a long, z long"


def _eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number."""
    out = np.empty(len(buf) - 7, np.uint64)
    for k in range(min(8, len(out))):
        out[k::8] = buf[k : k + (len(buf) - k) // 8 * 8].view("<u8")
    return out


def _seeds(eight: np.ndarray) -> np.ndarray:
    """A hash of the SEED bytes from each place on."""
    return tb.mix(eight[:-8] * _A + eight[8:] * _B)


def _names(buf: np.ndarray) -> np.ndarray:
    """For each start of LENGTH bytes, the smallest hash of the SEED-byte substrings."""
    low = _seeds(_eights(buf))
    span, want = 1, LENGTH - SEED + 1
    while 2 * span <= want:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    return np.minimum(low[: len(low) - (want - span)], low[want - span :]) if want > span else low


def fragments(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, name, content hash, start in the text, strings) of all fragments."""
    if len(buf) < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    names = _names(buf)
    new = np.ones(len(names), bool)
    new[1:] = names[1:] != names[:-1]
    new[offsets[:-1][offsets[:-1] < len(names)]] = True
    heads = np.flatnonzero(new)
    runs = np.diff(np.append(heads, len(names)))
    if runs.max() > RUN:  # long runs are cut into several fragments
        parts = -(-runs // RUN)
        heads = np.repeat(heads, parts) + RUN * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    text = np.searchsorted(offsets, heads, side="right") - 1
    ends = np.minimum(np.append(heads[1:], len(names)), offsets[text + 1] - LENGTH + 1)
    valid = ends > heads
    text, heads, count = text[valid], heads[valid], (ends - heads)[valid]
    total = tb.prefix_hash(buf)
    return text, names[heads], tb.span_hash(total, heads, heads + count + LENGTH - 1), heads - offsets[text], count


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Steps of whole texts; a longer text comes in parts that overlap by LENGTH - 1 bytes, with the part's start."""
    for part, buf, offsets in tb.slices(batch, step=STEP):
        if part.num_rows > 1 or len(buf) <= 2 * STEP:
            yield part, buf, offsets, np.zeros(part.num_rows, np.int64)
            continue
        for a in range(0, len(buf) - LENGTH + 1, STEP):
            z = min(len(buf), a + STEP + LENGTH - 1)
            yield part, buf[a:z], np.array([0, z - a]), np.array([a])


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(name, content, doc_id, place, strings) in portions of about COLLAPSE fragments; equal fragments stand together."""

    def portion(rows):
        name, content, doc, place, count = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.argsort(name ^ tb.mix(content))
        return name[order], content[order], doc[order], place[order], count[order]

    rows, held = [], 0
    for batch in batches:
        for part, buf, offsets, base in _pieces(batch):
            text, name, content, start, count = fragments(buf, offsets)
            ids = part.column("doc_id")
            known, doc = ids.is_valid().to_numpy(zero_copy_only=False)[text], ids.fill_null(0).to_numpy(zero_copy_only=False)[text]
            place = start + base[text]
            if "version" in part.schema.names:
                place = place + (part.column("version").to_numpy(zero_copy_only=False).astype(np.int64)[text] << 32)
            rows.append(tuple(x[known] for x in (name, content, doc, place, count)))
            held += len(name)
            if held >= COLLAPSE:
                yield portion(rows)
                rows, held = [], 0
    if rows:
        yield portion(rows)


def _least(name: np.ndarray, content: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each fragment of a portion, the smallest doc_id that has it."""
    if not len(name):
        return doc
    heads = np.flatnonzero(np.append(True, (name[1:] != name[:-1]) | (content[1:] != content[:-1])))
    return np.repeat(np.minimum.reduceat(doc, heads), np.diff(np.append(heads, len(doc))))


def _merged(doc: np.ndarray, a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of each document, those that touch joined."""
    order = np.lexsort((a, doc))
    doc, a, z = doc[order], a[order], z[order]
    if not len(doc):
        return doc, a, z
    # The reach so far within the document: documents are lifted apart so that one running maximum serves all.
    rank = np.cumsum(np.append(0, doc[1:] != doc[:-1]))
    lift = rank * (int(z.max()) + 1)
    reach = np.maximum.accumulate(z + lift)
    new = np.append(True, (doc[1:] != doc[:-1]) | (a[1:] + lift[1:] > reach[:-1]))
    heads = np.flatnonzero(new)
    return doc[heads], a[heads], np.maximum.reduceat(z, heads)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, content, doc_id, at): of equal fragments of a portion, those of the smallest doc_id.

    The others' bytes lie in a smaller document: they come as ranges, as rows
    without content whose ``at`` is place * 2**31 + bytes (of one version: others
    keep one row for a fragment), which ride along in the same shuffle.
    """
    for name, content, doc, place, count in _anchored(batches):
        own = (doc == _least(name, content, doc)) | (place >> 32 > 0)
        d, a, z = _merged(doc[~own], place[~own], (place + count + LENGTH - 1)[~own])
        names = tb.mix(d.astype(np.uint64) ^ tb.mix(a.astype(np.uint64)))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([name[own], names]).view(np.int64)),
                pa.concat_arrays([pa.array(content[own].view(np.int64)), pa.nulls(len(d), pa.int64())]),
                pa.array(np.concatenate([doc[own], d])),
                pa.array(np.concatenate([(place * 128 + count)[own], (a << 31) + (z - a)])),
            ],
            names=["name", "content", "doc_id", "at"],
        )


def bounded_suffix_array(buf: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` bytes (or more), by doubling."""
    n = len(buf)
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(np.append(buf, np.full(7, _BREAK, np.uint8)), 8)).view(">u8").ravel().astype(np.uint64)
    order, sorted_to = np.argsort(eight), 8
    key = eight
    while True:
        ranked = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.append(True, ranked[1:] != ranked[:-1])).astype(np.uint64)
        if sorted_to >= depth:
            return order
        behind = np.zeros(n, np.uint64)
        behind[: max(0, n - sorted_to)] = rank[sorted_to:]
        key = (rank << _U(32)) | behind
        order = np.argsort(key)
        sorted_to *= 2


def expand_intervals(bwt: np.ndarray, limit: int = LENGTH) -> np.ndarray:
    """marked[i]: the suffixes i - 1 and i share fewer than ``limit`` bytes.

    Breadth first, from the interval of the empty string: an interval is extended
    backward by each character before it, and goes on only if the end of the new
    interval was not marked yet; so an end is marked in the round of its common
    prefix, and each end carries one interval.
    """
    n = len(bwt)
    marked = np.zeros(n + 1, bool)
    marked[0] = True
    place = np.argsort(bwt, kind="stable")  # occurrences by character and position
    step = np.empty(n, np.int64)  # where the suffix one character longer stands
    step[place] = np.arange(n)
    chars = bwt[place]
    same = chars[1:] == chars[:-1]
    following, preceding = np.full(n, n, np.int64), np.full(n, -1, np.int64)
    following[place[:-1][same]] = place[1:][same]
    preceding[place[1:][same]] = place[:-1][same]
    low, high = np.array([0]), np.array([n])
    for _ in range(limit):
        if not len(low):
            break
        size = high - low
        member = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
        last = following[member] >= np.repeat(high, size)
        first = preceding[member] < np.repeat(low, size)
        new_low, new_high = np.sort(step[member[first]]), np.sort(step[member[last]]) + 1
        fresh = ~marked[new_high]
        low, high = new_low[fresh], new_high[fresh]
        marked[high] = True
    return marked[:n]


def _gone(buf: np.ndarray, sizes: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """For each byte of the fragments (each followed by a break), whether its string also starts in a fragment of a smaller doc_id."""
    begin = np.cumsum(sizes + 1) - sizes - 1
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    start = np.arange(len(buf)) - begin[owner] + length <= sizes[owner]
    order = bounded_suffix_array(buf, length)
    group = np.cumsum(expand_intervals(buf[order - 1], length)) - 1
    doc = np.where(start[order], docs[owner[order]], np.iinfo(np.int64).max)
    least = np.minimum.reduceat(doc, np.flatnonzero(np.append(True, group[1:] != group[:-1])))
    gone = np.zeros(len(buf), bool)
    gone[order] = start[order] & (least[group] < doc)
    return gone


def repeated_strings(texts: list[bytes], docs: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each fragment, which of its strings also start in a fragment of a smaller doc_id of this block."""
    sizes = np.array([len(t) for t in texts])
    gone = _gone(np.frombuffer(bytes([_BREAK]).join(texts) + bytes([_BREAK]), np.uint8), sizes, docs, length)
    begin = np.cumsum(sizes + 1) - sizes - 1
    return [gone[b : b + max(0, s - length + 1)] for b, s in zip(begin.tolist(), sizes.tolist(), strict=True)]


def may_match(buf: np.ndarray, sizes: np.ndarray, names: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Which fragments share a seed and HALF bytes on one side of it with a fragment of another document.

    buf: the fragments, each followed by a break; all places of a seed within its fragment count.
    """
    begin = np.cumsum(sizes + 1) - sizes - 1
    eight = _eights(buf)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    at = np.flatnonzero(_seeds(eight) == names[owner[: len(eight) - 8]])
    own = owner[at]
    out = np.zeros(len(sizes), bool)
    for side, first in ((-1, at - HALF), (1, at + SEED)):
        fits = (first >= begin[own]) & (first + HALF <= (begin + sizes)[own])
        x, frag = first[fits], own[fits]
        key = tb.mix(names[frag] + eight[x] * _A + eight[x + 8] * _B + eight[x + HALF - 8] * _C + _U(side + 1))
        order = np.argsort(key)
        key, frag = key[order], frag[order]
        if not len(key):
            continue
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        d = docs[frag]
        apart = np.minimum.reduceat(d, heads) != np.maximum.reduceat(d, heads)
        out[frag[np.repeat(apart, np.diff(np.append(heads, len(key))))]] = True
    return out


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, other, doc_id, at, data): the wanted fragments of each document; of a hot name its strings, by the two halves of a hash, without data."""
    names = ["name", "other", "doc_id", "at", "data"]
    for batch in batches:
        rows, held = [], 0
        for row in range(batch.num_rows):
            data = zstandard.decompress(batch.column("text")[row].as_py())
            want = batch.column("want")[row].values
            doc, version = batch.column("doc_id")[row].as_py(), batch.column("version")[row].as_py()
            name, at = want.field("name").to_numpy(), want.field("at").to_numpy()
            hot = want.field("hot").to_numpy(zero_copy_only=False)
            start, count = (at >> 7) & _START, at & 127
            cold = ~hot
            parts = [data[s : s + c + LENGTH - 1] for s, c in zip(start[cold].tolist(), count[cold].tolist(), strict=True)]
            rows.append((name[cold], np.zeros(len(parts), np.int64), np.full(len(parts), doc), at[cold], parts))
            held += sum(map(len, parts))
            if hot.any():
                first = np.unique(np.concatenate([np.arange(s, s + c) for s, c in zip(start[hot].tolist(), count[hot].tolist(), strict=True)]))
                buf = np.frombuffer(data, np.uint8)
                total, again = tb.prefix_hash(buf), tb.prefix_hash(buf ^ np.uint8(0x5A))
                h, g = (tb.span_hash(t, first, first + LENGTH).view(np.int64) for t in (total, again))
                rows.append((h, g, np.full(len(first), doc), ((version << 32) + first) * 128 + 1, [None] * len(first)))
                held += 40 * len(first)
            if held >= STEP or row == batch.num_rows - 1:
                columns = [pa.array(np.concatenate(c)) for c in list(zip(*rows, strict=True))[:4]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([p for r in rows for p in r[4]], pa.binary())], names=names)
                rows, held = [], 0


def _ranges(batch: pa.Table) -> pa.RecordBatch:
    """(doc_id, version, a, z) of the repeated strings of whole names' fragments."""
    data = batch.column("data").combine_chunks().cast(pa.large_binary())
    buf, offsets = tb.buffer_of(data)
    sizes = np.diff(offsets)
    name, docs, at = (batch.column(c).to_numpy() for c in ("name", "doc_id", "at"))

    def lined(pick: np.ndarray) -> np.ndarray:
        out = np.full(int(sizes[pick].sum()) + len(pick), _BREAK, np.uint8)
        mine = np.repeat(np.arange(len(pick)), sizes[pick])
        where = np.arange(len(mine)) + mine
        out[where] = buf[np.arange(len(mine)) + np.repeat(offsets[pick] - (np.cumsum(sizes[pick]) - sizes[pick]), sizes[pick])]
        return out

    pick = np.arange(len(sizes))
    pick = np.flatnonzero(may_match(lined(pick), sizes, name.view(np.uint64), docs))
    if not len(pick):
        return pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64())], names=["doc_id", "version", "a", "z"])
    gone = _gone(lined(pick), sizes[pick], docs[pick], LENGTH)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
    begin = np.cumsum(sizes[pick] + 1) - sizes[pick] - 1
    frag = np.searchsorted(begin, edge[::2], side="right") - 1
    place = at[pick][frag] >> 7
    start = (place & _START) - begin[frag]
    return pa.RecordBatch.from_arrays(
        [pa.array(docs[pick][frag]), pa.array((place >> 32).astype(np.int32)), pa.array(start + edge[::2]), pa.array(start + edge[1::2] + LENGTH - 1)], names=["doc_id", "version", "a", "z"]
    )


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges from fragments sorted by name, in blocks of whole names."""
    rows, held, last = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        name, head = batch.column("name").to_numpy(), 0
        if held + batch.nbytes >= BLOCK:
            # A block ends before the last name of what came so far, which may go on.
            head = int(np.searchsorted(name, name[-1]))
            whole = [*rows, batch.slice(0, head)] if head else rows if last != name[-1] else []
            if whole:
                yield _ranges(pa.Table.from_batches(whole))
                rows, held = [], 0
            else:
                head = 0
        rows.append(batch.slice(head))
        held += rows[-1].nbytes
        last = name[-1]
    if rows:
        yield _ranges(pa.Table.from_batches(rows))


def _taken_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("a", pa.int64()), ("z", pa.int64())])
    for batch in batches:
        texts, gones = batch.column("text"), batch.column("gone")
        sizes, cuts, kept, held, first = [], [], [], 0, 0
        for row in range(batch.num_rows):
            data = zstandard.decompress(texts[row].as_py()) if texts[row].is_valid else b""
            a, z = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if gones[row].is_valid:
                found = gones[row].values
                _, a, z = _merged(np.zeros(len(found), np.int64), found.field("a").to_numpy(), found.field("z").to_numpy())
                z = np.minimum(z, len(data))
            left, at = [], 0
            for x, y in zip(a.tolist(), z.tolist(), strict=True):
                left.append(data[at:x])
                at = y
            left.append(data[at:])
            sizes.append(len(data))
            cuts.append((a, z))
            kept.append(b"".join(left))
            held += len(data)
            if held >= STEP or row == batch.num_rows - 1:
                bounds = np.concatenate([[0], np.cumsum([len(a) for a, _ in cuts])]).astype(np.int32)
                spans = pa.StructArray.from_arrays([pa.array(np.concatenate([c[k] for c in cuts])) for k in (0, 1)], fields=list(kind))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, row + 1 - first), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), spans), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "spans", "kept"],
                )
                sizes, cuts, kept, held, first = [], [], [], 0, row + 1


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(doc_id, version, text) -> (doc_id, version, a, z): ranges of bytes, which may overlap, that together are what goes."""
    placed = docs.mapInArrow(_placed, "name long, content long, doc_id long, at long")
    by_name, by_content = Window.partitionBy("name"), Window.partitionBy("name", "content")
    # A portion sends one row of equal fragments, so a passage of any number of documents is a few rows of a name.
    live = placed.select("*", F.min("doc_id").over(by_name).alias("x"), F.max("doc_id").over(by_name).alias("y")).where("x != y or content is null")
    several = F.min("content").over(by_name) != F.max("content").over(by_name)
    hot = F.count("content").over(by_name) > HOT
    live = live.select("name", "doc_id", "at", F.when(F.col("content").isNotNull(), F.min("doc_id").over(by_content)).alias("least"), several.alias("several"), hot.alias("hot"))
    mixed = F.coalesce(F.col("several") & (F.col("doc_id") == F.col("least")), F.lit(False))
    live = stored(live.select("name", "doc_id", "at", "least", mixed.alias("mixed"), "hot"), "live")

    place = F.shiftrightunsigned("at", 7)
    version, start = F.shiftrightunsigned("at", 39).cast("int").alias("version"), place.bitwiseAND(F.lit(_START))
    later = live.where("doc_id > least").select("doc_id", version, start.alias("a"), (start + F.col("at") % 128 + LENGTH - 1).alias("z"))
    a = F.shiftrightunsigned("at", 31)
    whole = live.where("least is null").select("doc_id", F.lit(0).alias("version"), a.alias("a"), (a + F.col("at").bitwiseAND(F.lit((1 << 31) - 1))).alias("z"))
    wanted = live.where("mixed").groupBy("doc_id", version).agg(F.collect_list(F.struct("name", "at", "hot")).alias("want"))  # fragments of one text
    texts = docs.where("text is not null and doc_id is not null").select("doc_id", "version", packed("text").alias("text"))
    cut = texts.join(wanted, ["doc_id", "version"]).select("doc_id", "version", "text", "want").mapInArrow(_cut_out, "name long, other long, doc_id long, at long, data binary")
    cut = stored(cut, "cut")
    matched = cut.where("data is not null").select("name", "doc_id", "at", "data").repartition("name").sortWithinPartitions("name").mapInArrow(_indexed, RANGE)
    strings = cut.where("data is null")
    least = strings.groupBy("name", "other").agg(F.min("doc_id").alias("least"))
    beaten = strings.join(least, ["name", "other"]).where("doc_id > least").select("doc_id", version, start.alias("a"), (start + LENGTH).alias("z"))
    return whole.unionByName(later).unionByName(matched).unionByName(beaten)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """documents -> (doc_id, n_bytes, spans array<struct<a, z>>, kept binary): the maximal removed runs and the bytes that stay."""
    small_batches(docs.sparkSession)
    docs = versioned(docs.select(F.col("doc_id").cast("long"), "text"))
    gone = repeated_ranges(docs).groupBy("doc_id", "version").agg(F.collect_list(F.struct("a", "z")).alias("gone"))  # ranges of one text
    joined = docs.select("doc_id", "version", packed("text").alias("text")).join(gone, ["doc_id", "version"], "left").select("doc_id", "text", "gone")
    return joined.mapInArrow(_taken_out, "doc_id long, n_bytes long, spans array<struct<a: long, z: long>>, kept binary")
