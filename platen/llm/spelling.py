"""Spelling variant grouping: asymmetric q-chunks find all pairs of words at one edit.

Of two words at one inserted, deleted or replaced code point, the shorter (either,
where they are as long) gives two disjoint chunks, its halves; the other gives its
positional grams of the chunks' lengths. One edit leaves a chunk whole, and its
place in the longer word is the same or, behind the edit, one further: so a gram
joins a chunk only within a shift of one, and of all grams only those at such
places can join anything. The half that holds the edit is split once more by the
same rule and its kept part goes into the key too. A key thus holds three quarters
of a word, and a frequent half, prefix or suffix doesn't bring all its words
together. Joined pairs are verified by their edit distance.

Everything is Spark's own functions. Occurrences are counted before the shuffle;
keys are 64-bit hashes, so a collision costs a verification and no result.

Defined results: words are the runs that ``counted`` is given, of ``MIN_CHARS``
code points or more that occur ``MIN_COUNT`` times or more; null and empty texts
have none; repeated rows count again; ties of n go to the word that is smaller in
code-point order; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platen.llm.shared import forget, stored

MIN_CHARS, MIN_COUNT, RATIO = 7, 2, 10
RUNS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def occurrences(docs: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """documents -> (doc_id, word): each run of letters of ``least`` code points or more, A-Z as a-z."""
    runs = F.regexp_extract_all("text", F.lit(RUNS), F.lit(0))
    return docs.select("doc_id", F.explode(F.filter(runs, lambda x: F.char_length(x) >= least)).alias("run")).select("doc_id", F.translate("run", UPPER, LOWER).alias("word"))


def misspelt(words: DataFrame, every: int = 31) -> DataFrame:
    """(doc_id, word) -> the same, where one code point is gone from each word whose crc32 with its doc_id ``every`` divides. A null doc_id is written as nothing."""
    hashed = words.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary")))
    at = (F.col("h") % F.char_length("word")).cast("int")
    short = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))
    return hashed.select("doc_id", F.when(F.col("h") % every == 0, short).otherwise(F.col("word")).alias("word"))


def counted(words: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word) -> (word, n)."""
    return words.where(F.char_length("word") >= min_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _keys(word: Column, size: Column, mark: int, shift: int = 0) -> list[Column]:
    """The four keys of a word with chunks as of a word of ``size`` code points.

    Two for each half that may hold the edit: the other half is a whole chunk, and
    of the two parts of this one either that before or that behind the edit. What
    stands behind the edit is ``shift`` further on.
    """
    half = F.floor(size / 2).cast("int")
    keys = []
    for which, (start, end) in enumerate(((F.lit(0), half), (half, size))):
        chunk = F.substring(word, F.lit(1), half) if which else F.substring(word, half + 1 + shift, size - half)
        middle = start + F.floor((end - start) / 2).cast("int")
        before, behind = F.substring(word, start + 1, middle - start), F.substring(word, middle + 1 + shift, end - middle)
        keys += [F.xxhash64(F.lit(4 * mark + 2 * which + k), size, chunk, part) for k, part in enumerate((before, behind))]
    return keys


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n) of different words -> (a, b, n_a, n_b): both directions of each pair of words at one edit."""
    size = F.char_length("word")

    def keyed(name: str, size: Column, mark: int, shift: int = 0) -> DataFrame:
        return words.select(F.explode(F.array(*_keys(F.col("word"), size, mark, shift))).alias("key"), F.col("word").alias(name), F.col("n").alias(f"n_{name}"))

    same = keyed("a", size, 0).join(keyed("b", size, 0), "key").where("a < b")
    longer = keyed("a", size, 1).join(keyed("b", size - 1, 1, 1), "key")
    once = same.unionByName(longer).where(F.levenshtein("a", "b", 1) == 1).select("a", "b", "n_a", "n_b").distinct()
    return once.unionByName(once.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n_b").alias("n_a"), F.col("n_a").alias("n_b")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root): the end of each word's chain of forms, by doubling steps.

    A form's count is a multiple of its word's, so chains are short and have an end.
    """
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        after = stored(moved, "roots")
        forget(now)
        now = after
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n) of different words -> (word, n, form, root, n_near, form_n); see ``near_pairs``.

    A word's form is its near word of largest n, where that is ``ratio`` times its own or more.
    """
    words = stored(words, "words")
    best = F.min_by(F.struct("n_b", "b"), F.struct(-F.col("n_b"), "b"))
    near = near_pairs(words).groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    out = stored(words.join(near, "word", "left").withColumn("best", F.when(F.col("best.n_b") >= ratio * F.col("n"), F.col("best"))), "variants")
    found = roots(out.where("best is not null").select("word", F.col("best.b").alias("form")))
    return out.join(found, "word", "left").select(
        "word", "n", F.col("best.b").alias("form"), F.coalesce("root", "word").alias("root"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.n_b").alias("form_n")
    )


def spelling_sql(every: int = 31) -> str:
    """DuckDB's SQL for the whole: words at one edit by all deletions of a code point, crc32 bit by bit."""
    return f"""
WITH runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{LOWER}') AS run FROM documents
), long_runs AS (
  SELECT doc_id, run, count(*) AS times, CAST(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run) AS BLOB) AS bytes FROM runs WHERE length(run) >= {MIN_CHARS} GROUP BY doc_id, run
), steps AS (
  SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
), coded AS (
  SELECT doc_id, run, times, list_transform(range(1, 1 + octet_length(bytes)), lambda k: CAST(('0x' || substr(hex(bytes), 2 * k - 1, 2)) AS BIGINT)) AS codes FROM long_runs
), hashed AS (
  SELECT run, times, xor(list_reduce([4294967295] || codes, lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) AS h FROM coded, steps
), damaged AS (
  SELECT CASE WHEN h % {every} = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, times FROM hashed
), words AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM damaged WHERE length(word) >= {MIN_CHARS} GROUP BY word HAVING sum(times) >= {MIN_COUNT}
), less AS (
  SELECT word, n, i, substr(word, 1, CAST(i AS INT) - 1) || substr(word, CAST(i AS INT) + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT a.word AS a, b.word AS b, b.n AS n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
), near AS (
  SELECT a, count(*) AS n_near, max(n) AS top FROM pairs GROUP BY a
), forms AS (
  SELECT w.word, w.n, coalesce(max(near.n_near), 0) AS n_near, CASE WHEN max(top) >= {RATIO} * w.n THEN min(p.b) END AS form, CASE WHEN max(top) >= {RATIO} * w.n THEN max(top) END AS form_n
  FROM words w LEFT JOIN near ON near.a = w.word LEFT JOIN pairs p ON p.a = w.word AND p.n = near.top GROUP BY w.word, w.n
), chain AS (
  WITH RECURSIVE c(word, link, depth) AS (
    SELECT word, word, 0 FROM forms UNION ALL SELECT c.word, f.form, depth + 1 FROM c JOIN forms f ON f.word = c.link WHERE f.form IS NOT NULL
  ) SELECT word, arg_max(link, depth) AS root FROM c GROUP BY word
)
SELECT f.word, f.n, f.form, chain.root, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM forms f JOIN chain ON chain.word = f.word
"""
