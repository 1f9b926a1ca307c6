"""Secret scans: pattern candidates, and a random forest that removes false positives.

``candidates`` finds runs that may be secrets in whole texts and describes each by
length, character transitions, dictionary coverage, its path (how much its source
is code, and the file name or address before it) and the neighbouring words. ``fit_forest`` trains
Spark's random forest on labelled findings; ``scan`` keeps what it believes.

Labelled findings are a table (doc_id, start, label). Where none is given,
``label_findings`` makes one by rules of high precision (check digits, key formats,
assignments to a secret's name); it leaves out what they don't decide. Some of that
evidence is among the features too, so such labels teach the forest to extend the
rules to undecided candidates, not to know better.

Defined results: null and empty texts have no candidates (``start`` counts bytes, ``length``
characters); of overlapping matches,
what is given to a secret's name or a password of an address goes before a run, and the leftmost,
longest of each kind counts; each input row is scanned by itself, so repeated rows
repeat their findings; with findings of one label only (or none), every candidate
gets that label's probability (0 without any); an empty table gives an empty
result; columns other than ``doc_id``, ``source`` and ``text`` are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platen.llm import textbytes as tb
from platen.llm.shared import small_batches, stored

#: Candidates: what is given to a secret's name (assigned, said, passed as a flag, enclosed in a tag), follows a bearer's mark or stands as the password of an
#: address, whatever its characters: without blanks from four bytes on, in quotes with blanks too from eight bytes on; else a run of RUN_LENGTH or more, dotted parts together.
RUN_LENGTH = 14
_ENDINGS = (b"token", b"secret", b"password", b"passwd", b"passphrase", b"pass", b"pwd", b"credential", b"credentials", b"key")
NAME = re.compile(rb"[a-z0-9_.-]*(?:token|secret|passw(?:or)?d|passphrase|pwd|credentials?|(?:api|access|private|auth|secret)[_-]?key|[a-z0-9][_-]key|(?<![a-z])pass)\Z")
SIGN = re.compile(rb":=|=>|[=:]|[ \t](?:is|was)[ \t]")
VALUE = re.compile(rb"[ \t]*(?:\"([^\"\r\n]{8,128})\"|'([^'\r\n]{8,128})'|`([^`\r\n]{8,128})`|[\"'`]?([^\s\"'`]{4,}))")
FLAG = re.compile(rb"(?<![A-Za-z0-9-])--?((?:[A-Za-z0-9]+-)*(?:password|passwd|passphrase|pass|pwd|token|secret|key))[ \t]+(?=[^\s-])", re.IGNORECASE)
TAG = re.compile(rb"<([A-Za-z0-9_.:-]*(?:password|passwd|passphrase|pwd|token|secret|key))>([^<\s]{4,})</", re.IGNORECASE)
BEARER = re.compile(rb"[Bb](?:earer|EARER)[ \t]+([^\s\"'`<>]{4,})")
ADDRESS = re.compile(rb"://[^\s:/@]*:([^\s\"'<>]+)@")
PLAINLY = [((b"://",), ADDRESS, 1), ((b"earer", b"EARER"), BEARER, 1), ((b"</",), TAG, 2)]
RUN = re.compile(rb"(?<![A-Za-z0-9+/_=\-])[A-Za-z0-9+/_=\-](?:\.?[A-Za-z0-9+/_=\-]){%d,}" % (RUN_LENGTH - 1))
#: Words that the dictionary may have, and the sign of code in a source.
PLAIN = re.compile(rb"[a-z]{3,}")
CODE = re.compile(rb"\w ?[=:] ?[\"'`]")
#: Different words and sources that a task counts before it hands them on.
COUNTED = 200_000
#: Words of the dictionary: the most frequent ones of the corpus.
DICTIONARY = 4096
#: Labelled findings that a forest is trained on at most, half of each label.
TRAIN = 20_000
TREES, DEPTH = 30, 8
THRESHOLD = 0.5
#: Bytes of text before and after a candidate that are its neighbourhood.
AROUND = 48

# Words beside secrets and words beside harmless identifiers.
SECRET_WORDS = ("token", "secret", "password", "passwd", "pwd", "api", "apikey", "key", "auth", "bearer", "credential", "access", "private")
HARMLESS_WORDS = ("sha", "sha1", "sha256", "md5", "commit", "checksum", "digest", "uuid", "id", "isbn", "version", "example", "test", "phone", "tel", "card", "http", "https", "www")
FEATURES = (
    "length", "digits", "uppers", "lowers", "symbols", "entropy", "to_digit", "to_letter", "case_changes", "same_kind", "repeats", "hex_only", "digits_only",
    "coverage", "longest_word", "quoted", "assigned", "after_secret_word", "after_harmless_word", "before_letters", "path_depth", "in_address", "of_source",
)
SCHEMA = "doc_id long, start long, finding string, before string, after string, " + ", ".join(f"f_{f} double" for f in FEATURES)

_WORD = re.compile(rb"[A-Za-z][A-Za-z0-9]*")
_SECRET = frozenset(w.encode() for w in SECRET_WORDS)
_HARMLESS = frozenset(w.encode() for w in HARMLESS_WORDS)
_GIVEN = re.compile(rb"(?:[=:]>?|[ \t](?:is|was)|[Bb]earer|(?:^|\s)--?[A-Za-z0-9-]+|>)\s*[\"'`]?$")
_KIND = np.zeros(256, np.int8)
_KIND[48:58], _KIND[65:91], _KIND[97:123] = 1, 2, 3
_HEX = frozenset(b"0123456789abcdefABCDEF")


class Words:
    """The dictionary as an automaton, and which share of a text its words cover."""

    def __init__(self, words: list[str]):
        self.find = ahocorasick.Automaton()
        for w in words:
            self.find.add_word(w, len(w))
        self.any = bool(words)
        if words:
            self.find.make_automaton()

    def coverage(self, run: bytes) -> tuple[float, int]:
        """The share of characters that words cover, and the longest word."""
        if not self.any:
            return 0.0, 0
        covered, longest, reach = 0, 0, []
        for end, size in self.find.iter(run.lower().decode("latin-1")):
            longest = max(longest, size)
            a, z = end + 1 - size, end + 1
            while reach and reach[-1][0] >= a:  # words come by their ends
                covered -= reach[-1][1] - reach[-1][0]
                reach.pop()
            a = max(a, reach[-1][1]) if reach else a
            reach.append((a, z))
            covered += z - a
        return covered / len(run), longest


def describe(run: bytes, before: bytes, after: bytes, source: float, words: Words) -> list[float]:
    kinds = _KIND[np.frombuffer(run, np.uint8)]
    n = len(run)
    share = np.bincount(kinds, minlength=4) / n
    counts = np.unique(np.frombuffer(run, np.uint8), return_counts=True)[1] / n
    a, b = kinds[:-1], kinds[1:]
    steps = max(1, n - 1)
    coverage, longest = words.coverage(run)
    beside = [w.lower() for w in _WORD.findall(before)[-3:]]
    path = re.split(rb"\s", before)[-1]
    return [
        n,
        share[1],
        share[2],
        share[3],
        share[0],
        -float((counts * np.log2(counts)).sum()),
        float(((a > 1) & (b == 1)).sum()) / steps,
        float(((a == 1) & (b > 1)).sum()) / steps,
        float(((a == 2) & (b == 3) | (a == 3) & (b == 2)).sum()) / steps,
        float((a == b).sum()) / steps,
        1.0 - len(counts) / n,
        float(set(run) <= _HEX),
        float(share[1] == 1.0),
        coverage,
        longest,
        float(before[-1:] in (b'"', b"'", b"`") and after[:1] == before[-1:]),
        float(bool(_GIVEN.search(before))),
        float(any(w in _SECRET for w in beside)),
        float(any(w in _HARMLESS for w in beside)),
        float(sum(65 <= (c & 0xDF) <= 90 for c in before)) / AROUND,
        path.count(b"/") + path.count(b"."),
        float(b"://" in path or b"@" in path or after[:1] == b"@"),
        source,
    ]


def _value(data: bytes, at: int) -> tuple[int, int] | None:
    m = VALUE.match(data, at)
    return m.span(m.lastindex) if m else None


def spans_of(data: bytes) -> list[tuple[int, int]]:
    """Candidates of a text, in order: given values and passwords of addresses, and the runs outside them and outside the names that they are given to."""
    marked, names = set(), []
    for signs, pattern, group in PLAINLY:
        if any(x in data for x in signs):  # most texts have none, and looking for bytes is quick
            marked |= {m.span(group) for m in pattern.finditer(data)}
    for sign in SIGN.finditer(data):
        low = max(0, sign.start() - 64)
        name = data[low : sign.start()].rstrip(b" \t\"'`]").lower()
        if name.endswith(_ENDINGS) and (m := NAME.search(name)) and (value := _value(data, sign.end())):
            marked.add(value)
            names.append((low + m.start(), low + m.end()))
    for flag in FLAG.finditer(data) if b" -" in data or b"\n-" in data or data[:1] == b"-" else ():
        if value := _value(data, flag.end()):
            marked.add(value)
    marked = sorted(marked, key=lambda s: (s[0], -s[1]))
    first, end = [], 0
    for a, z in marked:
        if a >= end:
            first.append((a, z))
            end = z
    out, k = list(first), 0
    taken = sorted(first + names)
    for m in RUN.finditer(data):
        a, z = m.span()
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k == len(taken) or taken[k][0] >= z:
            out.append((a, z))
    return sorted(out)


def _found(batches: Iterator[pa.RecordBatch], words: list[str], sources: dict[str, float]) -> Iterator[pa.RecordBatch]:
    known = Words(words)
    for batch in batches:
        for part, _, _ in tb.slices(batch):
            rows: list[tuple] = []
            for doc, source, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "source", "text")), strict=True):
                data = (text or "").encode()
                for a, z in spans_of(data):
                    before, after = data[max(0, a - AROUND) : a], data[z : z + AROUND]
                    rows.append((doc, a, data[a:z], before, after, describe(data[a:z], before, after, sources.get(source or "", 0.0), known)))
            text = lambda k: pa.array([r[k].decode("utf-8", "ignore") for r in rows], pa.string())  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), text(2), text(3), text(4), *(pa.array([float(r[5][k]) for r in rows], pa.float64()) for k in range(len(FEATURES)))],
                names=["doc_id", "start", "finding", "before", "after", *(f"f_{f}" for f in FEATURES)],
            )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, source, n, code): how many documents have a word; how many a source has, and how many of them look like code."""

    def rows(words: dict[bytes, int], sources: dict[str, list[int]]) -> pa.RecordBatch:
        words = {w.decode(): n for w, n in words.items() if len(w) <= 12}
        return pa.RecordBatch.from_arrays(
            [
                pa.array([*words, *[None] * len(sources)], pa.string()),
                pa.array([*[None] * len(words), *sources], pa.string()),
                pa.array([*words.values(), *(x[0] for x in sources.values())], pa.int64()),
                pa.array([*[0] * len(words), *(x[1] for x in sources.values())], pa.int64()),
            ],
            names=["word", "source", "n", "code"],
        )

    words, sources = Counter(), {}
    for batch in batches:
        for part, _, _ in tb.slices(batch):
            for source, text in zip(part.column("source").to_pylist(), part.column("text").to_pylist(), strict=True):
                data = (text or "").encode()
                words.update(set(PLAIN.findall(data.lower())))
                own = sources.setdefault(source or "", [0, 0])
                own[0] += 1
                own[1] += CODE.search(data) is not None
            if len(words) + len(sources) > COUNTED:
                yield rows(words, sources)
                words, sources = Counter(), {}
    yield rows(words, sources)


def corpus_counts(docs: DataFrame, size: int = DICTIONARY) -> tuple[list[str], dict[str, float]]:
    """The dictionary, and how much each source is code, counted over all documents.

    The dictionary: the ``size`` most frequent words of 3 to 12 letters a-z, by the
    documents that have them. Of the ``size`` largest sources, the share of documents
    in which something quoted is assigned. Ties go in the order of letters.
    """
    counted = stored(docs.select("source", "text").mapInArrow(_counted, "word string, source string, n long, code long").groupBy("word", "source").agg(F.sum("n").alias("n"), F.sum("code").alias("code")), "counts")
    words = counted.where("word is not null and n > 1").orderBy(F.desc("n"), "word").limit(size).collect()  # ``size`` rows
    sources = counted.where("word is null").orderBy(F.desc("n"), "source").limit(size).collect()  # ``size`` rows
    return [r["word"] for r in words], {r["source"]: r["code"] / r["n"] for r in sources}


def candidates(docs: DataFrame) -> DataFrame:
    """documents -> (doc_id, start in bytes, finding, before, after, f_*); whole texts. The dictionary and the sources' shares are counted over all documents first."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string").alias("source"), "text")
    words, sources = corpus_counts(docs)
    return docs.mapInArrow(partial(_found, words=words, sources=sources), SCHEMA)


def luhn(digits: Column) -> Column:
    """Whether a run of digits has a valid check digit (payment cards)."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, k: F.when(k % 2 == 0, d.try_cast("int")).otherwise(F.when(d.try_cast("int") > 4, 2 * d.try_cast("int") - 9).otherwise(2 * d.try_cast("int"))))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def label_findings(found: DataFrame) -> DataFrame:
    """(doc_id, start, label): 1 for key formats, passwords in addresses and long random values assigned to a secret's name, 0 for cards, addresses, numbers and words; others have none."""
    run, before = F.col("finding"), F.lower("before")
    known = run.rlike(r"^(AKIA|ASIA)[0-9A-Z]{16}$") | run.rlike(r"^(ghp|gho|ghs|xox[abp]|sk|pk)[_-][0-9A-Za-z-]{16,}$") | run.rlike(r"^ey[A-Za-z0-9_-]{20,}$")
    named = before.rlike(r"(token|secret|passw(or)?d|passphrase|pwd|[a-z0-9]_?key|credentials?)[\"'`\]]?\s*(:=|=>|[=:]|\s(is|was)\s)\s*[\"'`]?$")
    password = before.rlike(r"://[^\s:/@]*:$") & F.startswith("after", F.lit("@"))
    good = known | password | (named & (F.col("f_entropy") > 3.0) & (F.col("f_length") >= 16))
    number = run.rlike("^[0-9]+$")
    bad = (number & (F.coalesce(luhn(F.when(number, run)), F.lit(False)) | (F.length(run) < 17))) | ((F.col("f_in_address") > 0) & ~password) | (F.col("f_coverage") > 0.5) | (F.col("f_after_harmless_word") > 0) | run.rlike(r"^[0-9+\-]+$")
    label = F.when(good != bad, good.cast("int"))
    return found.select("doc_id", "start", label.alias("label")).where("label is not null")


def fit_forest(found: DataFrame, labelled: DataFrame, limit: int = TRAIN, seed: int = 5):
    """A forest on at most ``limit`` labelled findings (half of each label, by the hash of their place), or the one label's probability."""
    labelled = labelled.groupBy("doc_id", "start").agg(F.max(F.col("label").cast("int")).alias("label"))
    chosen = None
    for label in (0, 1):
        own = labelled.where(F.col("label") == label).orderBy(F.xxhash64("doc_id", "start"), "doc_id", "start").limit(limit // 2)
        chosen = own if chosen is None else chosen.unionByName(own)
    rows = found.join(F.broadcast(stored(chosen, "labelled")), ["doc_id", "start"]).dropDuplicates(["doc_id", "start"])
    rows = stored(rows.select(F.col("label").cast("double").alias("label"), *(f"f_{f}" for f in FEATURES)), "training")
    shares = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # two rows
    if len(shares) < 2:
        return max(shares, default=0.0)
    # Sorted, so that the trees do not depend on how rows came to their partitions.
    rows = _assembled(rows.coalesce(1).sortWithinPartitions(*(f"f_{f}" for f in FEATURES)))
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, featureSubsetStrategy="sqrt", cacheNodeIds=False).fit(rows)


def _assembled(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[f"f_{f}" for f in FEATURES], outputCol="features").transform(df)


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """documents -> (doc_id, start, length, finding, before, after, probability, secret): all candidates, those believed marked."""
    small_batches(docs.sparkSession)
    found = stored(candidates(docs), "findings")
    forest = fit_forest(found, label_findings(found) if labelled is None else labelled)
    if isinstance(forest, float):
        scored = found.withColumn("probability", F.lit(forest))
    else:
        scored = forest.transform(_assembled(found)).withColumn("probability", F.round(vector_to_array("probability")[1], 6))
    return scored.select("doc_id", "start", F.length("finding").cast("long").alias("length"), "finding", "before", "after", "probability", (F.col("probability") >= threshold).alias("secret"))


def entropy_of(text: str) -> float:
    """Bits per character, as the feature has it (for tests)."""
    return -sum(p * math.log2(p) for p in (text.count(c) / len(text) for c in set(text)))
