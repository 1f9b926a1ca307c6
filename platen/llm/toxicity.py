"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Training takes at most ``EXAMPLES`` labelled rows, half of each label, those with
the smallest hashes of their ids (all of them where there are fewer). The space
is all terms of the examples; their document frequencies are counted over all
documents, and a term's idf is raised by how far its share of examples differs
between the labels ((1 + the root of its chi-square) to the power STRENGTH), so no
term is without weight and the many that don't go with a label do not drown the
others. Vectors and their cosines are those of this space: terms outside it have no
part in a text's length. Each document is compared with all examples through a
block-max inverted index: a block's bound is the sum over the query's terms of
weight times the term's largest weight in the block. The block of the highest bound
is read first, then all blocks that may hold an example as near as the k-th that it
gave, so the neighbours are exact. Prose shares its frequent terms with every block,
so on such texts few bounds fall below that and most blocks are read.

The neighbours' votes are weighted by their cosine; leave-one-out votes of the
examples, reweighted to the labels' true shares, fit the calibration.

The model that is broadcast is bounded by the terms of EXAMPLES texts, not by the corpus.

Defined results: null and empty texts, and texts without a term of any example,
have no neighbours and get the calibrated score of an even absence of votes;
ties between neighbours go to the smaller doc_id; rows are scored one by one, so
repeated rows score alike; with no labelled rows of one label all scores are the
share of label 1 (0 without any); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platen.llm import textbytes as tb
from platen.llm.shared import small_batches, stored

EXAMPLES, NEIGHBOURS, BLOCK = 4096, 24, 512
#: A term of one example in LONG or more has its postings as a row; texts that are compared together.
LONG, TOGETHER = 16, 128
THRESHOLD = 0.7
#: Chosen by cross-validation of rows that may be learned from (sf0.1: 1, 1.5 and 2 give recall 0.85, 0.89 and 0.88 at 0.7).
STRENGTH = 1.5
_LETTER = np.ones(256, bool)
_LETTER[:128] = False
_LETTER[[*range(97, 123)]] = True


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def terms_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms (runs of letters, A-Z as a-z) and the texts' bounds in them."""
    low = tb.LOWER[buf]
    inside = _LETTER[low]
    plain = np.where(inside, low, np.uint8(32))
    starts, ends, bounds = tb.word_spans(plain, offsets)
    return tb.span_hash(tb.prefix_hash(plain), starts, ends), bounds


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, buf, offsets in tb.slices(batch):
            hashes, bounds = terms_of(buf, offsets)
            each = [np.unique(hashes[a:z], return_counts=True) for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
            cut = pa.array(np.concatenate([[0], np.cumsum([len(t) for t, _ in each])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cut, pa.array(np.concatenate([x[i] for x in each]).astype(np.int64) if i else np.concatenate([x[0] for x in each]).view(np.int64))) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), *lists], names=["doc_id", "toxic", "terms", "counts"])


def examples(docs: DataFrame, labels: DataFrame, limit: int = EXAMPLES) -> DataFrame:
    """(doc_id, toxic, terms, counts) of at most ``limit`` labelled documents that aren't held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = known.join(docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    chosen = None
    for label in (0, 1):
        own = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit // 2)
        chosen = own if chosen is None else chosen.unionByName(own)
    chosen = stored(chosen, "examples")  # at most ``limit`` rows of two numbers, so the join may broadcast them
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", F.col("toxic").cast("long").alias("toxic"))
    # Of the texts of a repeated doc_id, the one of the smallest hash.
    return texts.agg(F.min_by("text", F.xxhash64("text")).alias("text")).mapInArrow(_counted, "doc_id long, toxic long, terms array<long>, counts array<long>")


def without_copies(rows: list, bands: int = 16, width: int = 8) -> list:
    """The examples but near copies of earlier ones (by min-hash bands of their terms): a copied text must not vouch for its terms again."""
    salts = np.random.default_rng(11).integers(1, 2**63, (bands * width, 1), dtype=np.uint64)
    seen, out = set(), []
    for r in rows:
        terms = np.array(r["terms"], np.int64).view(np.uint64)
        if not len(terms):
            continue
        least = np.full(bands * width, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(terms), 4096):
            least = np.minimum(least, tb.mix(terms[at : at + 4096][None, :] ^ salts).min(axis=1))
        keys = [(b, part.tobytes()) for b, part in enumerate(least.reshape(bands, width))]
        if not any(k in seen for k in keys):
            out.append(r)
        seen.update(keys)
    return out


def space(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of all terms of the examples, and by how much each counts: (1 + the root of the chi-square of its presence with the label) ** STRENGTH."""
    terms = np.unique(np.concatenate([np.asarray(r["terms"], np.int64) for r in rows] or [np.zeros(0, np.int64)]).view(np.uint64))
    rows = without_copies(sorted(rows, key=lambda r: r["doc_id"]))
    if not rows:
        return terms, np.ones(len(terms))
    sets = [np.array(r["terms"], np.int64).view(np.uint64) for r in rows]
    label = np.repeat([r["toxic"] for r in rows], [len(s) for s in sets])
    place = np.searchsorted(terms, np.concatenate(sets))
    a = np.bincount(place, weights=label, minlength=len(terms))
    df = np.bincount(place, minlength=len(terms))
    n, ones = len(rows), sum(r["toxic"] for r in rows)
    expected = df * ones / n
    with np.errstate(divide="ignore", invalid="ignore"):
        x = (a - expected) ** 2 * float(n) ** 3 / (df * (n - df) * float(ones * (n - ones)))
    return terms, (1 + np.sqrt(np.nan_to_num(x, nan=0.0, posinf=0.0))) ** STRENGTH


class Lookup:
    """Places of hashes among sorted distinct hashes: their leading bits say where to look."""

    def __init__(self, known: np.ndarray):
        self.known = np.append(known, np.uint64(0))
        self.shift = np.uint64(64 - max(1, min(22, len(known).bit_length() + 2)))
        bucket = known >> self.shift
        self.first = np.searchsorted(bucket, np.arange((1 << 64 - int(self.shift)) + 1, dtype=np.uint64)).astype(np.int32)
        self.most = int(np.diff(self.first).max()) if len(known) else 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 for those that are not known."""
        bucket = (hashes >> self.shift).astype(np.int64)
        at, end = self.first[bucket], self.first[bucket + 1]
        out = np.full(len(hashes), -1, np.int64)
        for _ in range(self.most):
            hit = (self.known[at] == hashes) & (at < end)
            out[hit] = at[hit]
            at = np.minimum(at + 1, end)
        return out


def counted_terms(lookup: Lookup, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, times) of the known terms of the texts, by text and place."""
    at = lookup.find(hashes)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    key, times = np.unique((text * len(lookup.known) + at)[at >= 0], return_counts=True)
    return key // len(lookup.known), key % len(lookup.known), times


def document_frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """How many of all documents have each term, and how many documents there are. At most len(terms) + 1 numbers leave a partition."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Lookup(shared.value)
        total = np.zeros(len(known.known), np.int64)
        for batch in batches:
            for _, buf, offsets in tb.slices(batch):
                hashes, bounds = terms_of(buf, offsets)
                total[-1] += len(bounds) - 1
                total += np.bincount(counted_terms(known, hashes, bounds)[1], minlength=len(total))
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(total[slots])], names=["slot", "n"])

    rows = docs.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(terms) + 1, np.int64)
    out[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return out[:-1], int(out[-1])


@dataclass
class Index:
    """A block-max inverted index of unit vectors over the space."""

    terms: np.ndarray  # sorted hashes
    idf: np.ndarray  # times the term's strength
    ids: np.ndarray  # doc_id of each example; examples of one leading term stand together
    toxic: np.ndarray
    starts: np.ndarray  # of each (term, block)'s postings, row by row
    slots: np.ndarray  # example of each posting
    weights: np.ndarray
    highest: np.ndarray  # (term, block): the largest weight
    slope: float = 1.0
    offset: float = 0.0

    @property
    def blocks(self) -> int:
        return self.highest.shape[1]

    @cached_property
    def lookup(self) -> Lookup:
        return Lookup(self.terms)

    @cached_property
    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """Long posting lists as rows of weights, and the row of each term (-1: a short list)."""
        size = self.starts[self.blocks :: self.blocks] - self.starts[: -1 : self.blocks]
        long = np.flatnonzero(size * LONG >= len(self.ids)) if self.blocks else np.zeros(0, np.int64)
        row = np.full(len(self.terms), -1, np.int32)
        row[long] = np.arange(len(long))
        full = np.zeros((len(long), self.blocks * BLOCK))
        for k, t in enumerate(long.tolist()):
            a, z = self.starts[t * self.blocks], self.starts[(t + 1) * self.blocks]
            full[k, self.slots[a:z]] = self.weights[a:z]
        return full, row

    def vectors(self, text: np.ndarray, slots: np.ndarray, times: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit TF-IDF weights, (1 + log tf) * idf, of n texts' terms: (bounds, slots, weights)."""
        weights = (1 + np.log(times)) * self.idf[slots]
        norm = np.sqrt(np.bincount(text, weights=weights * weights, minlength=n))
        return np.searchsorted(text, np.arange(n + 1)), slots, weights / norm[text]

    def vector(self, hashes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Terms of the space and their weights in one text's unit vector."""
        if counts is not None:
            hashes = np.repeat(hashes, counts)
        found = counted_terms(self.lookup, hashes, np.array([0, len(hashes)]))
        return self.vectors(*found, 1)[1:]

    def nearest(self, slots: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """``nearest_of_many`` for one vector."""
        return self.nearest_of_many(np.array([0, len(slots)]), slots, weights, k)[0]

    def nearest_of_many(self, bounds: np.ndarray, slots: np.ndarray, weights: np.ndarray, k: int, leave: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each vector: the k examples of highest cosine above 0 (ties: smaller doc_id) but its ``leave``, and their cosines.

        The block of the highest bound is read first; then those that may hold an
        example as near as the k-th that it gave.
        """
        n = len(bounds) - 1
        none = (np.zeros(0, np.int64), np.zeros(0))
        if not len(slots) or not self.blocks:
            return [none] * n
        text = np.repeat(np.arange(n), np.diff(bounds))
        bound = np.stack([np.bincount(text, weights=weights * self.highest[slots, b], minlength=n) for b in range(self.blocks)], axis=1)
        cosines = np.full((n, self.blocks * BLOCK), -1.0)
        best = bound.argmax(axis=1)
        self._read(cosines, bounds, slots, weights, np.arange(n), best)
        if leave is not None:
            mine = np.flatnonzero(leave // BLOCK == best)
            cosines[mine, leave[mine]] = -1.0
        own = np.take_along_axis(cosines.reshape(n, self.blocks, BLOCK), best[:, None, None], axis=1)[:, 0]
        worst = np.partition(own, BLOCK - k, axis=1)[:, BLOCK - k] if k <= BLOCK else np.zeros(n)
        open_ = (bound > 0) & (bound >= np.maximum(worst, 0)[:, None] - 1e-9)
        open_[np.arange(n), best] = False
        self._read(cosines, bounds, slots, weights, *np.nonzero(open_))
        if leave is not None:
            cosines[np.arange(n), leave] = -1.0
        last = max(0, cosines.shape[1] - k)
        floor = np.maximum(np.partition(cosines, last, axis=1)[:, last] - 2e-9, 0)
        out = []
        for row, least in zip(cosines, floor.tolist(), strict=True):
            found = np.flatnonzero(row > least) if least else np.flatnonzero(row > 0)
            found = found[np.lexsort((self.ids[found], -np.round(row[found], 9)))[:k]]
            out.append((found, row[found]))
        return out

    def _read(self, cosines: np.ndarray, bounds: np.ndarray, slots: np.ndarray, weights: np.ndarray, texts: np.ndarray, blocks: np.ndarray) -> None:
        """Fills in the cosines of the texts with the examples of a block each."""
        full, row = self.rows
        long = row[slots] >= 0
        for block in np.unique(blocks).tolist():
            mine = texts[blocks == block]
            size = bounds[mine + 1] - bounds[mine]
            at = np.repeat(bounds[mine] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            of = np.repeat(np.arange(len(mine)), size)
            dense = np.zeros((len(mine), len(full)))
            pick = long[at]
            dense[of[pick], row[slots[at[pick]]]] = weights[at[pick]]
            found = dense @ full[:, block * BLOCK : (block + 1) * BLOCK]
            of, at = of[~pick], at[~pick]
            cell = slots[at] * self.blocks + block
            size = self.starts[cell + 1] - self.starts[cell]
            post = np.repeat(self.starts[cell] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            place = np.repeat(of * BLOCK - block * BLOCK, size) + self.slots[post]
            found += np.bincount(place, weights=np.repeat(weights[at], size) * self.weights[post], minlength=len(mine) * BLOCK).reshape(found.shape)
            cosines[mine, block * BLOCK : (block + 1) * BLOCK] = found

    def vote(self, found: np.ndarray, cosines: np.ndarray) -> float:
        """Between -1 and 1: the neighbours' labels weighted by cosine, drawn to 0 where they are few."""
        return float(((2 * self.toxic[found] - 1) * cosines).sum() / (cosines.sum() + 0.5)) if len(found) else 0.0

    def score(self, vote: float) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.slope * vote + self.offset))))


def build_index(rows: list, terms: np.ndarray, strength: np.ndarray, df: np.ndarray, n: int, share: float, k: int = NEIGHBOURS) -> Index:
    blocks = -(-len(rows) // BLOCK)
    index = Index(terms, (np.log((1 + n) / (1 + df)) + 1) * strength, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros((len(terms), blocks)))
    made = [(index.vector(np.array(r["terms"], np.int64).view(np.uint64), np.array(r["counts"], np.int64)), r) for r in rows]
    # By leading term, so that a term's large weights fall into few blocks and the others' bounds are low.
    made.sort(key=lambda x: (int(x[0][0][x[0][1].argmax()]) if len(x[0][0]) else -1, x[1]["doc_id"]))
    vectors, rows = [v for v, _ in made], [r for _, r in made]
    index.ids, toxic = np.array([r["doc_id"] for r in rows], np.int64), np.array([r["toxic"] for r in rows], np.int64)
    index.toxic = toxic
    term = np.concatenate([v[0] for v in vectors] or [np.zeros(0, np.int64)])
    slot = np.repeat(np.arange(len(rows)), [len(v[0]) for v in vectors])
    weight = np.concatenate([v[1] for v in vectors] or [np.zeros(0)])
    cell = term * max(1, blocks) + slot // BLOCK
    order = np.argsort(cell, kind="stable")
    index.slots, index.weights = slot[order].astype(np.int32), weight[order]
    index.starts = np.searchsorted(cell[order], np.arange(len(terms) * max(1, blocks) + 1)).astype(np.int32)  # at most the terms of EXAMPLES texts
    np.maximum.at(index.highest, (term, slot // BLOCK), weight)
    index.highest = np.where(index.highest > 0, np.nextafter(index.highest.astype(np.float32), np.float32(2)), np.float32(0))  # a bound, so rounded up
    if not len(rows) or toxic.min() == toxic.max():
        index.slope, index.offset = 0.0, math.log(max(share, 1e-9)) - math.log(max(1 - share, 1e-9))
        return index
    votes = []
    for a in range(0, len(vectors), TOGETHER):
        part = vectors[a : a + TOGETHER]
        found = index.nearest_of_many(np.cumsum([0, *(len(v[0]) for v in part)]), np.concatenate([v[0] for v in part]), np.concatenate([v[1] for v in part]), k, leave=np.arange(a, a + len(part)))
        votes += [index.vote(*f) for f in found]
    votes = np.array(votes)
    weights = np.where(toxic == 1, share / toxic.mean(), (1 - share) / (1 - toxic.mean()))
    index.slope, index.offset = _calibrate(votes, toxic, weights)
    return index


def _calibrate(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Weighted logistic fit of y on x by Newton steps, with a slight ridge."""
    beta = np.zeros(2)
    a = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -40, 40)))
        step = np.linalg.solve((a * (weights * p * (1 - p))[:, None]).T @ a + np.eye(2) * 1e-2, a.T @ (weights * (y - p)) - beta * 1e-2)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return float(max(beta[0], 0.0)), float(beta[1])


def _gathered(chosen: DataFrame) -> list[dict]:
    """The examples (``limit`` at most) as arrays, without an object for each term."""
    table = chosen.toArrow().combine_chunks()
    column = {c: table.column(c).combine_chunks() for c in table.column_names}
    cuts = np.concatenate([[0], np.cumsum(column["terms"].value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    flat = {c: column[c].flatten().to_numpy(zero_copy_only=False) for c in ("terms", "counts")}
    ids, toxic = column["doc_id"].to_pylist(), column["toxic"].to_pylist()
    return [{"doc_id": ids[k], "toxic": toxic[k], **{c: v[cuts[k] : cuts[k + 1]] for c, v in flat.items()}} for k in range(len(ids))]


def fit(docs: DataFrame, labels: DataFrame, limit: int = EXAMPLES) -> Index:
    """Trains on the bounded sample; the frequencies and the labels' shares are counted over all rows."""
    rows = _gathered(examples(docs, labels, limit))
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).agg(F.avg("toxic").alias("share")).first()["share"] or 0.0
    terms, strength = space(rows)
    df, n = document_frequencies(docs, terms)
    return build_index(rows, terms, strength, df, n, float(known))


def score(docs: DataFrame, index: Index, k: int = NEIGHBOURS) -> DataFrame:
    """documents -> (doc_id, score, n_neighbours, evidence array<struct<doc_id, cosine, toxic>>); narrow, one pass."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for piece, buf, offsets in tb.slices(batch):
                hashes, limits = terms_of(buf, offsets)
                for a in range(0, piece.num_rows, TOGETHER):
                    part, cut = piece.slice(a, TOGETHER), limits[a : a + TOGETHER + 1]
                    found = counted_terms(own.lookup, hashes[cut[0] : cut[-1]], cut - cut[0])
                    near = own.nearest_of_many(*own.vectors(*found, part.num_rows), k)
                    scores = [own.score(own.vote(*f)) for f in near]
                    evidence = [[{"doc_id": int(own.ids[f]), "cosine": float(c), "toxic": int(own.toxic[f])} for f, c in zip(x[:5], y[:5], strict=True)] for x, y in near]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), pa.array(scores, pa.float64()), pa.array([len(x) for x, _ in near], pa.int64()), pa.array(evidence, pa.list_(kind))], names=["doc_id", "score", "n_neighbours", "evidence"]
                    )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, n_neighbours long, evidence array<struct<doc_id: long, cosine: double, toxic: long>>")
