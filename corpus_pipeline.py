"""The corpus pipeline: quality rules, line dedup, near-duplicate join, mixing and BPE, one after another.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept; what it returns is written as Parquet and reread. All but the last return
the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platen.llm import bpe, line_dedup, mixing, ngram_join, quality
from platen.llm.shared import stored, unused


def _like(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars as the text is now."""
    return found.select(*(F.char_length("text").cast("long").alias(c) if c == "n_chars" else found[c] for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the label model believes are good; those it rejects go, row by row. Null and empty texts fail the base rules."""
    return _like(quality.keep_good(docs), docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document of which nothing is left goes too. Null texts and rows without a doc_id stay as they are."""
    removed = unused("lines_removed", docs)
    left = F.col("text").isNull() | (F.col(removed) == 0) | (F.trim("text") != "")
    return _like(line_dedup.dedup_lines(docs, short=True, removed=removed).where(left), docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8) stays. Texts without words and rows without a doc_id are in no group."""
    return _like(ngram_join.keep_one(docs, n=5, percent=80), docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at rates that bring sources, languages and topics to their target weights; a row for each draw. Null sources and languages count as ''."""
    return _like(mixing.sample(docs), docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): the ids of each text and the digest of the bytes that they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    decoded = bpe.bpe_decode(bpe.bpe_encode(docs, path, public_tokenizers.PATTERN), path)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("mixing", mixing_stage),
    ("byte_bpe", byte_bpe),
]

#: Expectation-maximisation and edit distance joins are beyond SQL here; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
