"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash of the vocabulary resolves a pre-token that is a
vocabulary entry as a whole. Tier two: any other pre-token is merged by a heap of
(rank, position) over a doubly linked list of its bytes, so a long run of
characters costs n log n. Both sit behind a bounded memo of chunks, because most
chunks of a corpus repeat.

Defined results: null and empty texts have no ids and decode to no bytes; texts
of any length are encoded whole; equal texts give equal ids; only ``doc_id`` and
``text`` are read, so further columns with clashing names do no harm.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platen.llm import textbytes as tb
from platen.llm.shared import small_batches

#: Characters of the keys of a worker's memos before they start anew (about 200 MB with their ids); the memos are emptied at the end of a task.
MEMO = 10 << 20
#: Bytes of text that are encoded at a time, and ids that are decoded at a time.
STEP, IDS = 1 << 19, 1 << 18
_EMPTY = -1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class PerfectHash:
    """A minimal perfect hash from byte strings to their values: n slots for n keys.

    A bucket's displacement moves all its keys to free slots; a bucket of one key
    names its slot directly. A key that isn't in the set is told by comparing bytes.
    """

    def __init__(self, items: dict[bytes, int]):
        keys, n = list(items), max(1, len(items))
        self.n, self.m = n, max(1, n // 3)
        self.moves, self.keys, self.values = [0] * self.m, [b""] * n, [_EMPTY] * n
        buckets: dict[int, list[bytes]] = {}
        for key in keys:
            buckets.setdefault(xxhash.xxh64_intdigest(key) % self.m, []).append(key)
        taken = bytearray(n)
        free = None
        for at, members in sorted(buckets.items(), key=lambda kv: -len(kv[1])):
            if len(members) > 1:
                move = 0
                while True:
                    slots = {xxhash.xxh64_intdigest(key, move + 1) % n for key in members}
                    if len(slots) == len(members) and not any(taken[s] for s in slots):
                        break
                    move += 1
                self.moves[at] = move
            else:
                free = free if free is not None else iter([s for s in range(n) if not taken[s]])
                slot = next(free)
                self.moves[at] = -slot - 1
            for key in members:
                slot = self._slot(key)
                taken[slot], self.keys[slot], self.values[slot] = 1, key, items[key]

    def _slot(self, key: bytes) -> int:
        move = self.moves[xxhash.xxh64_intdigest(key) % self.m]
        return -move - 1 if move < 0 else xxhash.xxh64_intdigest(key, move + 1) % self.n

    def get(self, key: bytes) -> int:
        slot = self._slot(key)
        return self.values[slot] if self.keys[slot] == key else _EMPTY


def merge_bytes(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token by repeated merging of the adjacent pair of lowest rank, leftmost first."""
    n = len(data)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        rank = ranks.get(data[i : i + 2])
        if rank is not None:
            heap.append((rank, i, i + 1, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, mid, end = heapq.heappop(heap)
        if after[i] != mid or mid >= n or after[mid] != end:
            continue  # one of its parts has been merged meanwhile
        after[i], after[mid] = end, _EMPTY
        if end < n:
            before[end] = i
            rank = ranks.get(data[i : after[end]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end, after[end]))
        left = before[i]
        if left >= 0:
            rank = ranks.get(data[left:end])
            if rank is not None:
                heapq.heappush(heap, (rank, left, i, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[data[i : after[i]]])
        i = after[i]
    return out


class Encoder:
    #: White space beside white space or at either end; elsewhere a space starts a match and a newline is one.
    JOINED = re.compile(r"\s\s|\A\s|\s\Z")

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.hash = PerfectHash(self.ranks)
        self.find = regex.compile(pattern).findall
        # The memo of chunks holds for the pattern of which it is known that single spaces and newlines start a match.
        self.by_chunk = pattern == public_tokenizers.PATTERN
        self.words: dict[str, tuple[int, ...]] = {}
        self.held = 0
        self.newline = tuple(self.token("\n"))

        class Memo(dict):
            def __init__(memo, lead: str):  # noqa: N805
                memo.lead = lead

            def __missing__(memo, part: str) -> tuple[int, ...]:  # noqa: N805
                # Letters after the lead are one match, remembered here only.
                ids = self.ids_of(memo.lead + part) if part.isalpha() else tuple(chain.from_iterable(map(self.token, self.find(memo.lead + part))))
                if len(part) <= 64:
                    memo[part] = ids
                    self.held += len(part) + 4
                return ids

        self.first, self.rest = Memo(""), Memo(" ")

    def token(self, word: str) -> tuple[int, ...]:
        """Ids of one match of the pattern."""
        ids = self.words.get(word)
        if ids is None:
            ids = self.ids_of(word)
            if len(word) <= 64:
                self.words[word] = ids
                self.held += len(word) + 4
        return ids

    def ids_of(self, word: str) -> tuple[int, ...]:
        data = word.encode()
        rank = self.hash.get(data)
        return (rank,) if rank != _EMPTY else tuple(merge_bytes(data, self.ranks))

    def forget(self) -> None:
        for memo in (self.first, self.rest, self.words):
            memo.clear()
        self.held = 0

    def encode(self, text: str) -> array:
        """Ids of a text. Where single spaces or newlines stand between other characters no match spans them, so the parts go by the memo."""
        if self.held > MEMO:
            self.forget()
        if not self.by_chunk or self.JOINED.search(text):
            return array("i", chain.from_iterable(map(self.token, self.find(text))))
        out = array("i")
        for k, line in enumerate(text.split("\n") if text else ()):
            if k:
                out.extend(self.newline)
            head, *parts = line.split(" ")
            out.extend(self.first[head])
            out.extend(chain.from_iterable(map(self.rest.__getitem__, parts)))
        return out


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for a worker process; the vocabulary file is read where the task runs."""
    return Encoder(path, pattern)


@lru_cache(maxsize=4)
def _pieces(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ranks = read_ranks(path)
    top = max(ranks.values(), default=-1) + 1
    by_id = [b""] * top
    for token, rank in ranks.items():
        by_id[rank] = token
    lengths = np.array([len(t) for t in by_id], np.int64)
    return np.frombuffer(b"".join(by_id), np.uint8), np.cumsum(lengths) - lengths, lengths


def decode_ids(ids: np.ndarray, path: str) -> np.ndarray:
    """The bytes of all ids, one after another; an id outside the vocabulary is an error."""
    blob, starts, lengths = _pieces(path)
    wrong = (ids < 0) | (ids >= len(lengths))
    if wrong.any():
        raise ValueError(f"no such token: {ids[wrong][0]}")
    each = lengths[ids]
    ends = np.cumsum(each)
    where = np.arange(int(ends[-1]) if len(ends) else 0)
    where += np.repeat(starts[ids] - (ends - each), each)
    return blob[where]


def bpe_encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """documents -> (doc_id, ids array<int>); narrow, in bounded slices."""

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path, pattern)
        try:
            for batch in batches:
                for part, _, _ in tb.slices(batch, step=STEP):
                    values, ends = array("i"), [0]
                    for text in part.column("text").to_pylist():
                        values.extend(code.encode(text or ""))
                        ends.append(len(values))
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(values, np.int32)))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], names=["doc_id", "ids"])
        finally:
            code.forget()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, ids, decoded binary); null ids decode to no bytes. Ids outside the vocabulary are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(batch.column("ids").value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + IDS, side="right")))
                part, at = batch.slice(at, to - at), to
                ids = part.column("ids").fill_null([])
                flat = ids.flatten().to_numpy(zero_copy_only=False)
                counts = ids.value_lengths().to_numpy(zero_copy_only=False)
                data = decode_ids(flat, path)
                sizes = np.concatenate([[0], np.cumsum(_pieces(path)[2][flat])])[np.concatenate([[0], np.cumsum(counts)])]
                decoded = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(sizes.astype(np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), decoded], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
