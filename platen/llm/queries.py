"""The registered queries of this subpackage: thin, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platen.llm import bpe, language, line_dedup, media, mixing, ngram_join, quality, repair, secrets, spelling, suffix_dedup, token_counts, toxicity
from platen.llm.shared import shared_path

TOKEN_LIMIT = 2048
#: Session setting: the folder of the token counts that outlive a query; where it is unset, a run starts with an empty cache of its own.
TOKEN_CACHE = "spark.platen.tokenCache"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), n=4, percent=85)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "length", F.sha2("finding", 256).alias("finding_sha256"), "probability", "secret")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_quality(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("quality").alias("posterior"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), spark.conf.get(TOKEN_CACHE, None) or shared_path(spark, "token-counts"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn once at most, as its SQL twin states; the targets are met by ``op5_mixing_copies``."""
    mixed = mixing.mix_once(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"), "sampled")


def op5_mixing_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("rate", 6).alias("rate"), "copies")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    decoded = bpe.bpe_decode(bpe.bpe_encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    deduped = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), short=True)
    return deduped.select("doc_id", "lines_removed", F.octet_length("text").cast("long").alias("kept_bytes"), F.sha2("text", 256).alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        F.transform("evidence", lambda e: e["doc_id"]).alias("evidence"),
    )


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    printed = media.media_columns(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.concat_ws("|", F.array_join(F.col("fp_time").cast("array<string>"), ","), F.array_join(F.col("fp_hash").cast("array<string>"), ",")), 256)
    return printed.select(
        "doc_id",
        "n_bytes",
        "payload_bytes",
        "payload_sha256",
        "tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.size("fp_hash").cast("string"), F.lit(":"), digest).alias("feature"),
    )


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(docs))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), F.coalesce("nearest", F.lit(language.UNKNOWN)).alias("lang_pred"), "score", "rejected")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spelling.counted(spelling.misspelt(spelling.occurrences(table(spark, sf_dir, "documents")))))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_structure(repair.damaged(table(spark, sf_dir, "conversations")), copies="copies")


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_secret_scan, op3_quality_rules, op4_token_counts, op5_mixing, op5_mixing_copies, op6_byte_bpe, op7_suffix_dedup, op8_line_dedup, op9_toxicity, op10_media_columns, op11_language_id, op12_spelling_variants, op13_conversation_repair)}
ORACLES: dict[str, str] = {
    "op12_spelling_variants": spelling.spelling_sql(),
    "op5_mixing": mixing.sql() + "\nSELECT doc_id, source, lang, topic, n_tokens, round(probability, 6) AS probability, sampled FROM mixed",
}
