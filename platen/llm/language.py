"""Language identification by the nearest of several clustered centroids per language.

A text is the runs of its letters (Unicode categories L and M, in lower case),
with one space around each; its n-grams of 1 to ``N`` code points are hashed to
``SLOTS`` slots. A vector has (1 + log tf) * idf per slot and unit length; idf is
counted over every row that may be learned from. A language's sampled texts are
clustered by spherical k-means; a text takes the language of the centroid of the
highest cosine. It is rejected where that cosine is below the centroid's reach:
what all but ``OUTSIDE`` of the language's validation texts have, less ``SLACK``
for short texts. A row learns where its crc32(doc_id as text) mod 3 is not 1.

Training takes at most ``EXAMPLES`` different texts of a language (those of the
smallest hashes): three quarters are clustered, the rest gives reaches and the
temperature of the scores. All else covers all rows. The model is one vector for
each centroid, so it is bounded by languages * CENTROIDS * SLOTS numbers; beyond
``CELLS`` of them the slots are halved until it fits.

Defined results: a text that is null or without a letter has no nearest language
(null; ``lang`` is ``und``), score 0 and is rejected; a null or held-out doc_id,
a null text and a null lang don't learn; equal texts get equal results, repeated
rows one each; ties go to the language that is smaller in code-point order; with
nothing to learn from every row is ``und``; an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from platen.llm import textbytes as tb
from platen.llm.shared import small_batches, stored

N, SLOTS, CENTROIDS, EXAMPLES = 4, 1 << 14, 4, 512
#: Numbers in the broadcast centroids, at most (4 bytes each).
CELLS = 1 << 26
#: Languages whose sizes are broadcast, at most.
LANGUAGES = 1 << 14
OUTSIDE, SLACK, ROUNDS = 0.01, 0.5, 12
UNKNOWN = "und"
#: Texts that are compared together; code points of a text that are hashed together.
TOGETHER, PIECE = 64, 1 << 18


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: itself in lower case, or a space where it is no letter or mark; and whether it is a letter."""
    fold, letter = np.full(0x110000, 32, np.uint32), np.zeros(0x110000, bool)
    for k in range(0x110000):
        kind = unicodedata.category(chr(k))[0]
        if kind in "LM":
            low = chr(k).lower()
            fold[k] = ord(low) if len(low) == 1 else k
            letter[k] = kind == "L"
    return fold, letter


def folded(codes: np.ndarray) -> tuple[np.ndarray, bool]:
    """The text's letters in lower case with single spaces between and around its runs; whether it has a letter."""
    fold, letter = _letters()
    out = np.concatenate([[np.uint32(32)], fold[codes], [np.uint32(32)]])
    keep = out != 32
    keep[1:] |= out[:-1] != 32
    keep[0] = True
    return out[keep], bool(letter[codes].any())


def gram_slots(codes: np.ndarray, slots: int) -> Iterator[np.ndarray]:
    """The slots of all n-grams of a folded text, some at a time; a lone space is no n-gram."""
    shift = np.uint32(33 - slots.bit_length())
    for at in range(0, len(codes), PIECE):
        part = codes[at : at + PIECE + N - 1].astype(np.uint32)
        own = min(PIECE, len(codes) - at)
        h, found = np.zeros(len(part), np.uint32), []
        for n in range(1, N + 1):
            size = min(own, len(part) - n + 1)
            if size <= 0:
                break
            h = (h[:size] + part[n - 1 : n - 1 + size] + np.uint32(n)) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            slot = (h * np.uint32(0x85EBCA77)) >> shift
            found.append(slot[part[:size] != 32] if n == 1 else slot)
        yield np.concatenate(found)


def counts_of(texts: pa.Array, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """(texts x slots) counts of n-grams, and which texts have a letter. Null texts are empty."""
    out, lettered = np.zeros((len(texts), slots), np.float32), np.zeros(len(texts), bool)
    buf, bounds = tb.buffer_of(texts)
    for k in range(len(texts)):
        text = buf[bounds[k] : bounds[k + 1]].tobytes().decode()
        codes, lettered[k] = folded(np.frombuffer(text.encode("utf-32-le"), "<u4"))
        for found in gram_slots(codes, slots):
            out[k] += np.bincount(found, minlength=slots)
    return out, lettered


def unit_vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of (1 + log tf) * idf, of length 1 (or 0)."""
    out = np.zeros_like(counts)
    np.log(counts, out=out, where=counts > 0)
    out += counts > 0
    out *= idf
    size = np.sqrt(np.einsum("ij,ij->i", out, out))
    return out / np.where(size > 0, size, 1)[:, None]


def clustered(vectors: np.ndarray, k: int = CENTROIDS) -> np.ndarray:
    """At most k unit centroids by spherical k-means; the first is nearest the mean, the next are each farthest from those before."""
    mean = vectors.sum(axis=0)
    seeds = [int((vectors @ mean).argmax())]
    near = vectors @ vectors[seeds[0]]
    while len(seeds) < min(k, len(vectors)) and near.min() < 1 - 1e-6:
        seeds.append(int(near.argmin()))
        near = np.maximum(near, vectors @ vectors[seeds[-1]])
    centres, before = vectors[seeds], None
    for _ in range(ROUNDS):
        own = (vectors @ centres.T).argmax(axis=1)
        if before is not None and (own == before).all():
            break
        before = own
        for c in range(len(centres)):
            total = vectors[own == c].sum(axis=0)
            size = np.linalg.norm(total)
            if size > 0:
                centres[c] = total / size
    return centres


@dataclass
class Centroids:
    """The model: unit centroids, each with its language and reach."""

    languages: list[str]  # in code-point order
    vectors: np.ndarray  # centroids x slots
    owner: np.ndarray  # language of each centroid, ascending
    reach: np.ndarray  # of each language: the cosine below which a text is rejected
    idf: np.ndarray
    temperature: float = 16.0

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language, its cosine, its share of the scores) for each row of counts."""
        cosines = unit_vectors(counts, self.idf) @ self.vectors.T
        best = np.maximum.reduceat(cosines, np.searchsorted(self.owner, np.arange(len(self.languages))), axis=1)
        first = np.round(best, 6).argmax(axis=1)
        top = best[np.arange(len(best)), first]
        return first, top, _share(best, first, self.temperature)


def _share(best: np.ndarray, of: np.ndarray, temperature: float) -> np.ndarray:
    """Softmax of the languages' cosines."""
    power = np.exp(temperature * (best - best.max(axis=1, keepdims=True)))
    return power[np.arange(len(best)), of] / power.sum(axis=1)


def _calibrated(best: np.ndarray, label: np.ndarray) -> float:
    """The temperature (a power of 2) under which the validation texts' own languages are likeliest."""
    tried = [float(1 << k) for k in range(9)]
    return min(tried, key=lambda t: -np.log(np.maximum(_share(best, label, t), 1e-9)).sum())


def examples(learn: DataFrame, limit: int = EXAMPLES) -> DataFrame:
    """(lang, text, held) of at most ``limit`` different texts of each language; held texts (a quarter) are for validation.

    Only hashes below a bound are gathered, about twice the limit of each language, so no group grows with the table.
    """
    key = F.xxhash64("text")
    sizes = stored(learn.groupBy("lang").agg(F.approx_count_distinct(key).alias("n_texts")), "sizes")
    if sizes.limit(LANGUAGES + 1).count() <= LANGUAGES:
        sizes = F.broadcast(sizes)  # a row for each language; else texts would be shuffled by language
    place = (F.shiftrightunsigned(key, 11) / float(1 << 53)).alias("place")
    few = learn.join(sizes, "lang").select("lang", "text", place, (2.0 * limit / F.greatest("n_texts", F.lit(1))).alias("bound")).where("place <= bound")
    once = few.groupBy("lang", "place").agg(F.min("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place"))
    return once.withColumn("rank", rank).where(F.col("rank") <= limit).select("lang", "text", (F.col("rank") % 4 == 0).alias("held"))


def document_frequencies(learn: DataFrame, slots: int) -> tuple[np.ndarray, int]:
    """How many rows have each slot, and how many rows there are; at most slots + 1 numbers leave a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots + 1, np.int64)
        for batch in batches:
            for part, _, _ in tb.slices(batch):
                for at in range(0, part.num_rows, TOGETHER):
                    counts, _ = counts_of(tb.text_array(part.column("text").slice(at, TOGETHER)), slots)
                    total[:-1] += (counts > 0).sum(axis=0)
                    total[-1] += len(counts)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["slot", "n"])

    rows = learn.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(slots + 1, np.int64)
    out[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return out[:-1], int(out[-1])


def fit(docs: DataFrame, limit: int = EXAMPLES, centroids: int = CENTROIDS) -> Centroids:
    """Learns from (doc_id, text, lang); see the module's text for what is sampled and what is counted over all rows."""
    small_batches(docs.sparkSession)
    learn = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("lang").cast("string").alias("lang"), "text")
    sample = stored(examples(learn, limit), "languages")
    n_languages = sample.select("lang").distinct().count()
    slots = SLOTS
    while slots > 256 and n_languages * centroids * slots > CELLS:
        slots //= 2
    df, n = document_frequencies(learn, slots)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        counts, lettered = counts_of(tb.text_array(pa.array(group["text"], pa.large_string())), slots)
        vectors = unit_vectors(counts[lettered], shared.value)
        found = [v.astype("<f4").tobytes() for v in clustered(vectors, centroids)] if len(vectors) else [None]
        return pd.DataFrame({"lang": [group["lang"].iloc[0]] * len(found), "vector": found})

    # A group is at most ``limit`` texts; what comes back is ``centroids`` vectors of each language.
    made = sample.where("not held").groupBy("lang").applyInPandas(cluster, "lang string, vector binary").where("vector is not null").toPandas()
    made = made.assign(key=made["lang"].map(lambda x: x.encode())).sort_values(["key", "vector"])
    languages = sorted(set(made["lang"]), key=str.encode)
    owner = np.searchsorted(np.array([x.encode() for x in languages], object), made["key"].to_numpy()) if languages else np.zeros(0, np.int64)
    vectors = np.frombuffer(b"".join(made["vector"]), "<f4").reshape(-1, slots)
    model = Centroids(languages, vectors, owner, np.zeros(len(languages)), idf)
    return _validated(model, sample.where("held")) if languages else model


def _validated(model: Centroids, held: DataFrame) -> Centroids:
    """The reaches and the temperature, from the cosines (one per language) of the validation texts."""
    shared = held.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        firsts = np.searchsorted(own.owner, np.arange(len(own.languages)))
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                counts, lettered = counts_of(tb.text_array(part.column("text")), len(own.idf))
                best = np.maximum.reduceat(unit_vectors(counts, own.idf) @ own.vectors.T, firsts, axis=1)
                mine = np.array([own.languages.index(x) if x in own.languages else -1 for x in part.column("lang").to_pylist()], np.int64)
                keep = lettered & (mine >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(mine[keep]), pa.array(list(best[keep]), pa.list_(pa.float32()))], names=["label", "best"])

    rows = held.select("lang", "text").mapInArrow(run, "label long, best array<float>").toPandas()
    if len(rows):
        best, label = np.stack(rows["best"].to_numpy()), rows["label"].to_numpy()
        model.temperature = _calibrated(best, label)
        own = best[np.arange(len(best)), label]
        for k in np.unique(label).tolist():
            model.reach[k] = SLACK * np.quantile(own[label == k], OUTSIDE)
    return model


def identify(docs: DataFrame, model: Centroids) -> DataFrame:
    """documents -> (doc_id, lang, nearest, cosine, score, rejected); narrow, one pass over whole texts.

    ``nearest`` is the language of the nearest centroid, ``lang`` the same but ``und`` where it is rejected.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = {"doc_id": pa.int64(), "lang": pa.string(), "nearest": pa.string(), "cosine": pa.float64(), "score": pa.float64(), "rejected": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for piece, _, _ in tb.slices(batch):
                for at in range(0, piece.num_rows, TOGETHER):
                    part = piece.slice(at, TOGETHER)
                    counts, known = counts_of(tb.text_array(part.column("text")), len(own.idf))
                    if own.languages:
                        first, cosine, score = own.nearest(counts)
                    else:
                        known, first, cosine, score = (np.zeros(len(counts), t) for t in (bool, np.int64, float, float))
                    rejected = ~known | (cosine < own.reach[first]) if own.languages else ~known
                    nearest = [own.languages[k] if ok else None for k, ok in zip(first.tolist(), known.tolist(), strict=True)]
                    lang = [UNKNOWN if bad else name for name, bad in zip(nearest, rejected.tolist(), strict=True)]
                    values = [part.column("doc_id"), lang, nearest, np.where(known, cosine, 0.0), np.where(known, score, 0.0), rejected]
                    yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(values, columns.values(), strict=True)], names=list(columns))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang string, nearest string, cosine double, score double, rejected boolean")
