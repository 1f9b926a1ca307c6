"""Token counts through a digest cache.

A row of the cache is (content_digest, tokenizer_digest, n_tokens). The content
digest is taken over normalised bytes. For a tokenizer whose file says that it
drops white space and letter case (``WordCounter.serves``), runs of ASCII white
space become one space and A-Z small letters, so equal normalised content has
equal counts; a text that spells a special token (in any case) is digested as it
is. For every other .json and .model the content is the text itself. The tokenizer
digest is that of the vocabulary file, so a new version misses all that an older
one stored.

``count_tokens`` looks the digests up, encodes only the distinct misses, appends
them to the cache (Parquet, in the shared folder) and joins the counts back.

Defined results: null texts are empty texts of 0 tokens; repeated rows and ids
keep one result row for each input row; an empty table appends nothing; columns
other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platen.llm import textbytes as tb
from platen.llm.shared import small_batches, stored

CACHE = "content_digest binary, tokenizer_digest string, n_tokens long"
#: Words that a worker remembers before it starts anew; they are forgotten at the end of a task.
MEMO = 200_000
#: Bytes of text that are looked at together.
STEP = 1 << 20
#: Digests that a task remembers while it looks for repeats.
SEEN = 1 << 20
#: A digest with more than one row in so many is hot; the partitions that its rows are dealt over.
HOT, SALTS = 1000, 64

# What a tokenizer file says if its counts do not depend on white space and letter case.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class TextCounter:
    """Counts the tokens of whole texts by the library: tokenizers for .json, sentencepiece for .model."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_file=path)
            self.count = lambda text: len(library.encode(text, num_threads=1))
        else:
            library = _library(path)
            self.count = lambda text: len(library.encode(text, add_special_tokens=False).ids)

    def digest(self, text: str) -> bytes:
        return hashlib.blake2b(text.encode(), digest_size=16, person=b"as is").digest()

    def counts(self, texts: list[str]) -> list[int]:
        return list(map(self.count, texts))

    def forget(self) -> None:
        pass


def _library(path: str):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_padding()
    library.no_truncation()
    return library


class WordCounter:
    """Counts the tokens of texts by the library, word by word.

    No match of the pre-tokenizer holds white space and the normaliser works
    within words, so a text's count is the sum over its words; distinct words
    are encoded together, as words of one pre-split input, and remembered.
    """

    def __init__(self, path: str):
        self.tokenizer = _library(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"].lower().encode() for t in spec["added_tokens"]]
        self.memo: dict[bytes, int] = {}

    @staticmethod
    def serves(path: str) -> bool:
        """Whether the file is of the one kind that this way of counting holds for."""
        if not path.endswith(".json"):
            return False
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        normal, split = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        steps = split.get("pretokenizers", [])
        words = steps[:1] == [SPLIT] and [s["type"] for s in steps[1:]] == ["ByteLevel"] and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
        special = all(t["special"] and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) and t["content"].startswith("<|") for t in spec["added_tokens"])
        return normal.get("normalizers") == NORMALIZERS and words and special and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")

    def forget(self) -> None:
        self.memo.clear()

    def content(self, text: str) -> tuple[bytes, bool]:
        """Normalised bytes, and whether a special token's spelling makes the text count as it stands."""
        data = text.encode()
        small = b" ".join(data.lower().split())
        if b"<|" in small and any(s in small for s in self.special):
            return data, True
        return small, False

    def digest(self, text: str) -> bytes:
        data, plain = self.content(text)
        return hashlib.blake2b(data, digest_size=16, person=b"as is" if plain else b"normal").digest()

    def learn(self, words: set[bytes]) -> None:
        """Adds the counts of new words to the memo. Closing commas and full stops after a letter are tokens apart from it."""
        core = {w: w.rstrip(b".,") for w in words}
        tails = {w: w[len(c) :] for w, c in core.items() if len(c) < len(w) and c[-1:].isalpha()}
        wanted = list({c if w in tails else w for w, c in core.items()} - self.memo.keys() | set(tails.values()) - self.memo.keys())
        for at in range(0, len(wanted), 4096):
            part = wanted[at : at + 4096]
            ids = self.tokenizer.encode([w.decode() for w in part], is_pretokenized=True, add_special_tokens=False).word_ids
            counts = np.bincount(np.array([i for i in ids if i is not None], np.int64), minlength=len(part))
            self.memo.update(zip(part, counts.tolist(), strict=True))
        for w, tail in tails.items():
            self.memo[w] = self.memo[core[w]] + self.memo[tail]

    def counts(self, texts: list[str]) -> list[int]:
        if len(self.memo) > MEMO:
            self.memo.clear()
        contents = [self.content(t) for t in texts]
        split = [[] if plain else data.split(b" ") for data, plain in contents]
        self.learn(set().union(*split) - self.memo.keys() - {b""})
        self.memo[b""] = 0
        return [
            len(self.tokenizer.encode(text, add_special_tokens=False).ids) if plain else sum(map(self.memo.__getitem__, words))
            for text, words, (_, plain) in zip(texts, split, contents, strict=True)
        ]


@lru_cache(maxsize=2)
def counter(path: str) -> WordCounter | TextCounter:
    return WordCounter(path) if WordCounter.serves(path) else TextCounter(path)


def _keys(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = counter(path)
        for batch in batches:
            for part, _, _ in tb.slices(batch, step=STEP):
                texts = [t or "" for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([code.digest(t) for t in texts], pa.binary())],
                    names=["doc_id", "n_bytes", "content_digest"],
                )

    return run


def _distinct_texts(path: str):
    """One row for each digest of a partition (or of SEEN different ones), so that a text that fills a third of the table is a few rows of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, seen = counter(path), set()
        for batch in batches:
            for part, _, _ in tb.slices(batch, step=STEP):
                if len(seen) > SEEN:
                    seen.clear()
                keys, texts = [], []
                for text in part.column("text").to_pylist():
                    key = code.digest(text or "")
                    if key not in seen:
                        seen.add(key)
                        keys.append(key)
                        texts.append(text or "")
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(texts, pa.string())], names=["content_digest", "text"])

    return run


def _encode(path: str, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, last = counter(path), None
        try:
            for batch in batches:
                for part, _, _ in tb.slices(batch, step=STEP):
                    keys = part.column("content_digest").to_pylist()
                    new = [i for i, key in enumerate(keys) if key != (keys[i - 1] if i else last)]  # equal digests stand together
                    last = keys[-1]
                    part = part.take(pa.array(new, pa.int64()))
                    counts = code.counts(part.column("text").to_pylist())
                    yield pa.RecordBatch.from_arrays(
                        [part.column("content_digest"), pa.array([version] * len(new), pa.string()), pa.array(counts, pa.int64())], names=["content_digest", "tokenizer_digest", "n_tokens"]
                    )
        finally:
            code.forget()

    return run


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The cache, or no rows where nothing has been stored yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(cache)


def _counted(keys: DataFrame, counts: DataFrame) -> DataFrame:
    """keys with the n_tokens of their digests.

    The rows of a digest that has over 1/``HOT`` of all rows (there are fewer than
    ``HOT`` such digests) are dealt over ``SALTS`` partitions, with a copy of its count in each.
    """
    every = keys.count()
    hot = F.broadcast(keys.groupBy("content_digest").agg(F.count("*").alias("many")).where(F.col("many") * HOT > every).select("content_digest", F.lit(True).alias("hot")))
    place = F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.lit(SALTS)).cast("int")
    dealt = keys.withColumn("place", place).join(hot, "content_digest", "left").withColumn("salt", F.when(F.col("hot"), F.col("place")).otherwise(0))
    copies = counts.join(hot, "content_digest", "left").withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.drop("hot").join(copies.drop("hot"), ["content_digest", "salt"])


def count_tokens(docs: DataFrame, tokenizer_path: str, cache: str) -> DataFrame:
    """documents -> (doc_id, n_bytes, content_digest, tokenizer_digest, n_tokens).

    The text of a digest is shuffled once, and only if it is a miss; the final
    join carries digests and numbers (``_counted``).
    """
    small_batches(docs.sparkSession)
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer_path)
    texts = docs.select("text").mapInArrow(_distinct_texts(tokenizer_path), "content_digest binary, text string")
    known = read_cache(spark, cache).where(F.col("tokenizer_digest") == version)
    # Equal digests meet in one partition, where the encoder takes the first of each.
    misses = texts.join(known, "content_digest", "left_anti").repartition("content_digest").sortWithinPartitions("content_digest")
    misses.mapInArrow(_encode(tokenizer_path, version), CACHE).write.mode("append").parquet(cache)
    counts = read_cache(spark, cache).where(F.col("tokenizer_digest") == version).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    keys = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_keys(tokenizer_path), "doc_id long, n_bytes long, content_digest binary")
    return _counted(stored(keys, "token-keys"), counts).select("doc_id", "n_bytes", "content_digest", F.lit(version).alias("tokenizer_digest"), "n_tokens")
