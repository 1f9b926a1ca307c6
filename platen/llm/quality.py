"""Quality rules under weak supervision.

Each rule votes good (1) or bad (-1) on a document, or abstains (0).
Expectation-maximisation over the votes of all documents estimates how often
each rule is right on good and on bad documents; the posterior probability that
a document is good then decides, in place of "all rules must pass".

The EM works on the counts of distinct vote patterns, which Spark aggregates:
with k rules there are at most 3**k patterns whatever the size of the corpus
(k = 7: 2,187), and that table alone reaches the driver.

Defined results: null and empty texts have zeros in all features and fail the
base rules; ties in the posterior (0.5) are kept; an empty table gives an empty
result; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platen.llm import textbytes as tb
from platen.llm.shared import cut, small_batches, unused

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_lines", "n_stops", "n_pipes")
SCHEMA = "doc_id long, " + ", ".join(f"{f} long" for f in FEATURES)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
WINDOW = 8

BASE_FAILED = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"

# Frequent function words of the four languages.
STOPS = (
    "the of and to in is that for it as was on are with by at be this "
    "der die das und in zu den von mit sich des auf für ist nicht ein eine als "
    "de la le et les des en un une du que est pour dans "
    "el los las y por con para del se una no es"
).split()

# Rules that vote "bad" in one condition, "good" in another and else abstain.
RULES: dict[str, tuple[str, str]] = {
    "length": ("n_words < 30", "n_words between 60 and 20000"),
    "word_length": ("word_chars > 11 * n_words or word_chars < 2 * n_words", "word_chars between 3 * n_words and 9 * n_words"),
    "symbols": ("10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    "repeated_words": ("100 * n_repeat_words > 20 * n_words", "100 * n_repeat_words <= 5 * n_words"),
    "repeated_lines": ("10 * n_dup_lines > 3 * n_lines", "20 * n_dup_lines <= n_lines"),
    "capitals": ("10 * n_upper > 4 * word_chars", "10 * n_upper <= word_chars"),
    "function_words": ("100 * n_stops < 2 * n_words", "100 * n_stops >= 6 * n_words"),
}


def _sums(hits: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(hits, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _stop_hashes() -> np.ndarray:
    words = [w.encode() for w in STOPS]
    buf = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return np.unique(tb.span_hash(tb.prefix_hash(buf), np.concatenate([[0], ends[:-1]]), ends))


def repeated_words(hashes: np.ndarray, bounds: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Words of each text that stand in a window of words found twice or more in it; the first window counts too."""
    runs = tb.window_hash(hashes, window)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    if not len(runs):
        return np.zeros(len(bounds) - 1, np.int64)
    whole = np.flatnonzero(doc[: len(runs)] == doc[window - 1 :])
    keys = runs[whole] ^ tb.mix(doc[whole].astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    steps = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(steps, whole[twice], 1)
    np.add.at(steps, whole[twice] + window, -1)
    return _sums(np.cumsum(steps[:-1]) > 0, bounds)


def _duplicate_lines(text: str) -> tuple[int, int]:
    seen, again, lines = set(), 0, text.split("\n")
    for line in lines:
        if line in seen:
            again += 1
        elif line.strip(" \t\n\x0b\x0c\r"):
            seen.add(line)
    return again, len(lines)


def _described(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
    """Slices of the batch and the FEATURES of their texts."""
    stops = _stop_hashes()
    for part, buf, offsets in tb.slices(batch):
        starts, ends, bounds = tb.word_spans(buf, offsets)
        exact = tb.span_hash(tb.prefix_hash(buf), starts, ends)
        small = tb.span_hash(tb.prefix_hash(tb.LOWER[buf]), starts, ends)
        found = stops[np.minimum(np.searchsorted(stops, small), len(stops) - 1)] == small
        lines = [_duplicate_lines(t or "") for t in part.column("text").to_pylist()]
        columns = {
            "n_words": np.diff(bounds),
            "word_chars": _sums(~tb.SPACE[buf] & ((buf & 0xC0) != 0x80), offsets),
            "n_symbols": _sums(_SYMBOL[buf], offsets),
            "n_dup_lines": np.array([x[0] for x in lines], np.int64),
            "n_repeat_words": repeated_words(exact, bounds),
            "n_upper": _sums(_UPPER[buf], offsets),
            "n_digits": _sums(_DIGIT[buf], offsets),
            "n_lines": np.array([x[1] for x in lines], np.int64),
            "n_stops": _sums(found, bounds),
            "n_pipes": _sums(buf == ord("|"), offsets),
        }
        yield part, [pa.array(columns[f], pa.int64()) for f in FEATURES]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, columns in _described(batch):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", *FEATURES])


def features(docs: DataFrame) -> DataFrame:
    """documents -> (doc_id, FEATURES); narrow, one pass over the texts."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_features, SCHEMA)


def base_failed() -> Column:
    return F.expr(BASE_FAILED)


def vote(bad: str, good: str) -> Column:
    return F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0)


def fit_label_model(patterns: list[tuple[tuple[int, ...], int]], prior: float = 0.8, rounds: int = 100, tolerance: float = 1e-9) -> dict:
    """EM over (votes, count): the share of good documents and, for each rule and class, the odds of each vote.

    Starts from rules that are right more often than not; counts are smoothed by one
    vote each, so that a rule that never fires has no say. A rule whose bad votes are
    found likelier on good documents ends with no weight instead of a turned one.
    """
    votes = np.array([p for p, _ in patterns], np.int64)
    weight = np.array([n for _, n in patterns], np.float64)
    rules = votes.shape[1] if len(patterns) else 0
    bad = (votes == -1).sum(axis=1) if rules else np.zeros(0)
    good = (votes == 1).sum(axis=1) if rules else np.zeros(0)
    q = np.clip(0.5 + 0.5 * (good - 2.0 * bad) / max(1, rules), 0.02, 0.98)
    table = np.zeros((2, rules, 3))
    last = -math.inf
    for _ in range(rounds if rules else 0):
        share = ((q * weight).sum() + 8 * prior) / (weight.sum() + 8)
        for label, p in ((1, q), (0, 1 - q)):
            for v in (-1, 0, 1):
                table[label, :, v + 1] = ((votes == v) * (p * weight)[:, None]).sum(axis=0) + 1
            table[label] /= table[label].sum(axis=1, keepdims=True)
        odds = np.log(table[1]) - np.log(table[0])
        odds[:, 0] = np.minimum(odds[:, 0], 0)
        odds[:, 2] = np.maximum(odds[:, 2], 0)
        odds[:, 1] = 0
        logit = math.log(share) - math.log(1 - share) + odds[np.arange(rules), votes + 1].sum(axis=1)
        q = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        now = float((weight * np.abs(logit)).sum())
        if abs(now - last) <= tolerance * max(1.0, abs(now)):
            break
        last = now
    else:
        if not rules:
            return {"share": prior, "odds": []}
    return {"share": float(share), "odds": odds.tolist()}


def fit(found: DataFrame, rules: dict[str, tuple[str, str]]) -> dict:
    """The label model of documents with FEATURES, from the counts of their vote patterns (at most 3 ** len(rules) rows)."""
    names = [f"vote_{n}" for n in rules]
    counts = found.select(*(vote(*r).alias(n) for n, r in zip(names, rules.values(), strict=True))).groupBy(*names).count().collect()
    return fit_label_model(sorted((tuple(r[n] for n in names), r["count"]) for r in counts))


def posterior(model: dict, votes: list[Column]) -> Column:
    """The probability that a document is good, as a native expression over its votes."""
    logit = F.lit(math.log(model["share"]) - math.log(1 - model["share"]))
    for cast, odds in zip(votes, model["odds"], strict=False):
        logit = logit + F.when(cast == -1, F.lit(odds[0])).when(cast == 1, F.lit(odds[2])).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-logit))


@F.arrow_udf(T.StructType([T.StructField(f, T.LongType()) for f in FEATURES]))
def measured(texts: pa.Array) -> pa.Array:
    """The FEATURES of each text, as a column."""
    parts = [pa.StructArray.from_arrays(columns, names=list(FEATURES)) for _, columns in _described(pa.record_batch([texts], names=["text"]))]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([(f, pa.int64()) for f in FEATURES]))


def keep_good(docs: DataFrame, rules: dict[str, tuple[str, str]] | None = None, threshold: float = 0.5) -> DataFrame:
    """The rows that ``judge_quality`` keeps, with all their columns; each row by its own text, whatever its doc_id.

    The texts are read twice, for the EM and for the verdict, and never shuffled.
    """
    small_batches(docs.sparkSession)
    rules = RULES if rules is None else rules
    model = fit(features(docs), rules)
    mine = unused("quality_features", docs)
    columns = lambda sql: re.sub(r"\bn_\w+|\bword_chars\b", lambda m: f"`{mine}`.{m.group()}", sql)
    good = posterior(model, [vote(*map(columns, r)) for r in rules.values()]) >= threshold
    judged = docs.withColumn(mine, measured("text")).where(~F.expr(columns(BASE_FAILED)) & good)
    return judged.select(*(F.col(f"`{c}`") for c in docs.columns))


def judge_quality(docs: DataFrame, rules: dict[str, tuple[str, str]] | None = None, threshold: float = 0.5) -> DataFrame:
    """documents -> (doc_id, FEATURES, vote_<rule>..., base_failed, quality, kept).

    The features (a few dozen bytes a document) are cut off by a checkpoint in the
    shared folder, so the texts are read once for both the EM and the result.
    """
    small_batches(docs.sparkSession)
    rules = RULES if rules is None else rules
    found = cut(features(docs))
    voted = found.select("*", *(vote(*r).alias(f"vote_{n}") for n, r in rules.items()), base_failed().alias("base_failed"))
    model = fit(found, rules)
    return voted.withColumn("quality", posterior(model, [F.col(f"vote_{n}") for n in rules])).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
