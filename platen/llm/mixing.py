"""Mixing sources to target weights by iterative proportional fitting; DataFrame functions only.

The token counts of the cells (source, language, topic) are raked to target
shares of each of the three marginals in turn, until they agree within a tolerance.
A document's rate is that of its cell: the raked weight over the cell's tokens,
scaled so that the expected sample has the wanted share of all tokens. A document
of a scarce cell has a rate above 1 and is drawn more than once: as often as the
rate's whole part says, and once more with its fraction as the probability. So the
expected sample meets both the targets and the share. The draw is a hash of doc_id
and seed, so it repeats in any partitioning.

``mix_once`` draws no document twice: probabilities end at 1, what full cells can't
give is spread over the others, and the targets are missed where they ask for more
than a cell has. It is the form that ``sql`` states.

The texts are read once. The table of cells (one row for each combination that
occurs) is all that the rounds work on; documents meet it in one equi-join, where
Spark splits a source that holds a large share of them.

Defined results: null sources and languages count as ''; null and empty texts
have no tokens (a cell without tokens keeps its documents at probability 1);
a null doc_id is drawn as ''; repeated rows are drawn alike; an empty table gives
an empty result; the operator reads and names its own columns only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platen.llm.shared import stored

MARGINALS = ("source", "lang", "topic")
# What a text must contain to be of a topic; the first that fits wins.
TOPICS = {"license": ("License", "Copyright"), "table": (" | ",), "config": (' = "', "://"), "contact": ("@",), "noise": ("%%%", "$$$", "!!")}
OTHER = "prose"
ROUNDS, CAP_ROUNDS = 8, 6
#: Targets that are not given: a value's share of tokens to this power, normalised.
TEMPER = 0.7
SHARE, SEED = 0.9, 17
#: Rounds of raking that make up one job.
JOB = 2
#: ``mix`` rakes until totals are in proportion to their targets within this, or for so many rounds (targets that contradict each other).
TOLERANCE, MOST_ROUNDS = 1e-4, 64


def topic_of(text: Column) -> Column:
    found = None
    for name, marks in TOPICS.items():
        hit = F.lit(False)
        for mark in marks:
            hit = hit | F.contains(text, F.lit(mark))
        found = F.when(hit, name) if found is None else found.when(hit, name)
    return F.coalesce(found.otherwise(OTHER), F.lit(OTHER))


def token_weight(text: Column) -> Column:
    """Words of a text, as the measure of its tokens."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f\x0b]+")), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) drawn by the document's id."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def attributes(docs: DataFrame, *others: str) -> DataFrame:
    """documents -> (doc_id, source, lang, topic, n_tokens) and the other columns named."""
    return docs.select("doc_id", *others, *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("source", "lang")), topic_of(F.col("text")).alias("topic"), token_weight(F.col("text")).alias("n_tokens"))


def target_shares(cells: DataFrame, marginal: str, targets: dict[str, float] | None) -> DataFrame:
    """(marginal, share): the given shares of the values that occur, or tempered ones."""
    values = cells.groupBy(marginal).agg(F.sum("tokens").cast("double").alias("tokens"))
    if targets is None:
        raw = F.pow("tokens", F.lit(TEMPER))
    else:
        raw = F.lit(None).cast("double")
        for value, share in targets.items():
            raw = F.when(F.col(marginal) == value, F.lit(float(share))).otherwise(raw)
        raw = F.coalesce(raw, F.lit(0.0))
    return values.select(marginal, raw.alias(f"{marginal}_share"))


def spread(raked: DataFrame) -> float:
    """By how much the ratio of a value's weight to its target differs within a marginal, at most."""
    ratio = lambda m: F.sum("weight").over(Window.partitionBy(m)) / F.nullif(F.col(f"{m}_share"), F.lit(0.0))
    row = raked.select(*(ratio(m).alias(m) for m in MARGINALS)).agg(*(F.max(m) / F.nullif(F.min(m), F.lit(0.0)) - 1 for m in MARGINALS)).first()
    return max((x for x in row if x is not None), default=0.0)


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS, tolerance: float | None = None) -> DataFrame:
    """(source, lang, topic, tokens) -> the same and weight, whose sums over each marginal are in proportion to its targets; ends early within the tolerance."""
    targets = targets or {}
    for marginal in MARGINALS:
        cells = cells.join(target_shares(cells, marginal, targets.get(marginal)), marginal)
    cells = cells.withColumn("weight", F.col("tokens").cast("double"))
    for done in range(1, rounds + 1):
        for marginal in MARGINALS:
            total = F.sum("weight").over(Window.partitionBy(marginal))
            cells = cells.withColumn("weight", F.coalesce(F.col("weight") * F.col(f"{marginal}_share") / F.nullif(total, F.lit(0.0)), F.lit(0.0)))
        if done % JOB == 0 or done == rounds:
            cells = stored(cells, "raked")
            if tolerance is not None and spread(cells) <= tolerance:
                break
    return cells


def scale_of(raked: DataFrame, share: float, rounds: int = CAP_ROUNDS) -> float:
    """The factor from weights to expected tokens; what full cells can't give is spread over the others."""
    budget = None
    scale = 0.0
    for _ in range(rounds):
        full = F.col("weight") * F.lit(scale) >= F.col("tokens")
        row = raked.agg(F.sum("tokens").alias("all"), F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("free")).first()
        if budget is None:
            budget = share * (row["all"] or 0)
            row = {"full": 0, "free": raked.agg(F.sum("weight")).first()[0]}
        if not row["free"]:
            break
        scale = (budget - row["full"]) / row["free"]
    return scale


def rates_of(attributed: DataFrame, targets: dict[str, dict[str, float]] | None, share: float) -> DataFrame:
    """(source, lang, topic, rate): the expected draws of a document of the cell."""
    cells = attributed.groupBy(*MARGINALS).agg(F.sum("n_tokens").alias("tokens"))
    raked = rake(cells, targets, MOST_ROUNDS, TOLERANCE)
    row = raked.agg(F.sum("tokens").alias("all"), F.sum("weight").alias("weight")).first()
    scale = share * row["all"] / row["weight"] if row["weight"] else 0.0
    return raked.select(*MARGINALS, F.when(F.col("tokens") > 0, F.col("weight") * F.lit(scale) / F.col("tokens")).otherwise(1.0).alias("rate"))


def draws(doc_id: Column, rate: Column, seed: int) -> Column:
    """How often a document is drawn."""
    return F.floor(rate).cast("int") + (uniform(doc_id, seed) < rate - F.floor(rate)).cast("int")


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """documents -> (doc_id, source, lang, topic, n_tokens, rate, probability, copies, sampled), one row for each input row."""
    found = stored(attributes(docs), "attributes")
    rated = found.join(rates_of(found, targets, share), list(MARGINALS)).withColumn("copies", draws(F.col("doc_id"), F.col("rate"), seed))
    return rated.select("doc_id", *MARGINALS, "n_tokens", "rate", F.least(F.lit(1.0), "rate").alias("probability"), "copies", (F.col("copies") > 0).alias("sampled"))


def mix_once(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """documents -> (doc_id, source, lang, topic, n_tokens, probability, sampled), one row for each input row, none drawn twice."""
    found = stored(attributes(docs), "attributes")
    cells = found.groupBy(*MARGINALS).agg(F.sum("n_tokens").alias("tokens"))
    raked = rake(cells, targets)
    scale = scale_of(raked, share)
    rate = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("weight") * F.lit(scale) / F.col("tokens"))).otherwise(1.0)
    rates = raked.select(*MARGINALS, rate.alias("probability"))
    return found.join(rates, list(MARGINALS)).select("doc_id", *MARGINALS, "n_tokens", "probability", (uniform(F.col("doc_id"), seed) < F.col("probability")).alias("sampled"))


def sample(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """The drawn documents, with all their columns; a row for each draw."""
    rates = rates_of(stored(attributes(docs).drop("doc_id"), "attributes"), targets, share)
    own = attributes(docs.select("doc_id", "source", "lang", "text", F.struct(*(docs[c] for c in docs.columns)).alias("_row")), "_row")
    drawn = own.join(rates, list(MARGINALS)).select("_row", F.explode(F.array_repeat(F.lit(0), draws(F.col("doc_id"), F.col("rate"), seed))))
    return drawn.select("_row.*")


def sql(documents: str = "documents", share: float = SHARE, seed: int = SEED) -> str:
    """The same query in DuckDB's SQL, as named steps (WITH ...) that end in the step ``mixed``."""
    case = " ".join("WHEN " + " OR ".join(f"contains(text, '{m}')" for m in marks) + f" THEN '{name}'" for name, marks in TOPICS.items())
    steps = [
        f"found AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, CASE {case} ELSE '{OTHER}' END AS topic, "
        f"CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0b]+')), 0) AS BIGINT) AS n_tokens FROM {documents})",
        "cells AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM found GROUP BY ALL)",
    ]
    for m in MARGINALS:
        steps.append(f"t_{m} AS (SELECT {m}, pow(CAST(sum(tokens) AS DOUBLE), {TEMPER}) AS {m}_share FROM cells GROUP BY {m})")
    steps.append("r0 AS MATERIALIZED (SELECT *, CAST(tokens AS DOUBLE) AS weight FROM cells JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic))")
    k = 0
    for _ in range(ROUNDS):
        for m in MARGINALS:
            steps.append(f"r{k + 1} AS MATERIALIZED (SELECT * REPLACE (coalesce(weight * {m}_share / nullif(sum(weight) OVER (PARTITION BY {m}), 0), 0) AS weight) FROM r{k})")
            k += 1
    steps.append(f"s1 AS MATERIALIZED (SELECT {share} * sum(tokens) AS budget, {share} * sum(tokens) / sum(weight) AS scale FROM r{k})")
    for i in range(1, CAP_ROUNDS):
        full = f"weight * (SELECT scale FROM s{i}) >= tokens"
        steps.append(
            f"s{i + 1} AS MATERIALIZED (SELECT (SELECT budget FROM s{i}) AS budget, coalesce(((SELECT budget FROM s{i}) - sum(CASE WHEN {full} THEN tokens ELSE 0 END)) "
            f"/ nullif(sum(CASE WHEN {full} THEN 0 ELSE weight END), 0), (SELECT scale FROM s{i})) AS scale FROM r{k})"
        )
    steps.append(
        f"mixed AS (SELECT doc_id, source, lang, topic, n_tokens, probability, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{seed}'), 1, 8) AS BIGINT) / 4294967296.0 < probability AS sampled "
        f"FROM (SELECT f.*, CASE WHEN tokens > 0 THEN least(1.0, weight * (SELECT scale FROM s{CAP_ROUNDS}) / tokens) ELSE 1.0 END AS probability FROM found f JOIN r{k} USING (source, lang, topic)))"
    )
    return "WITH " + ",\n".join(steps)
