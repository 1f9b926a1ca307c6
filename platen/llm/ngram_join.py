"""N-gram Jaccard join with several global token orders.

A document is the set of its distinct n-word shingles (64-bit hashes). Two sets
with J >= t share at least ``need = ceil(t * size)`` shingles, so under any global
order they share a shingle among the first ``size - need + 1`` of each: the
prefix. Candidates must pass this under three different orders before they are
verified.

Steps, none of which brings a group together or makes all pairs of one:

1. Equal sets are one node, named by 64 bits of the set's digest.
2. Filter: under a random order the prefix is lengthened by 5 % of the set, so a
   linked document has that many more shared shingles in it. Shingles of one
   document only are dead; a document with too few live ones is linked with
   nothing. Only the others (the near copies) are carried on, with whole sets.
3. Their shingles are counted; those of one node alone come first in the orders.
   A node whose dead shingles already exceed what a partner may lack is dropped.
4. Each node is verified against the one pivot (the node with the fewest dead
   shingles) that it meets most often in prefixes. Then all pairs that share a
   prefix shingle and lie in different components are verified, so no link
   between components is lost; links inside one change nothing. The nodes of a busy
   shingle meet by their prefixes under the second order instead, and those of a
   busy shingle there under the third: a linked pair shares one under each.

Defined results: null, empty and white-space texts have no shingles and are a
component of their own (for a null doc_id, null); with fewer than n words the
whole sequence is the one shingle; there is one result row for each input row;
rows that repeat a doc_id with different sets are different nodes; a null doc_id
has the component of an equal set, if any, and makes no links; an empty
table gives an empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platen.llm import textbytes as tb
from platen.llm.components import components
from platen.llm.packing import packed, unpacked
from platen.llm.shared import forget, small_batches, stored, unused

#: Nodes of different components that a shingle may pair; those of a busier one are met again under the next order.
MANY = 128
ORDERS = ("first", "second", "third")


def need_of(size: Column, percent: int) -> Column:
    """Shingles that a set shares with any partner: ceil(percent/100 * size)."""
    return F.floor((size * percent + 99) / 100).cast("long")


def overlap_of(a: Column, b: Column, percent: int) -> Column:
    """Shingles that sets of these sizes share if they link: ceil(t / (1 + t) * (a + b))."""
    return F.ceil((a + b) * percent / F.lit(100 + percent) - 1e-9).cast("long")


def _lengthened(n: np.ndarray | int, percent: int):
    """Length of the lengthened prefix and the live shingles that it must hold."""
    prefix = n - (n * percent + 99) // 100 + 1
    longer = np.minimum(n, prefix + n // 20)
    return longer, longer - prefix + 1


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; A-Z count as a-z."""
    low = tb.LOWER[buf]
    starts, ends, bounds = tb.word_spans(low, offsets)
    words = tb.span_hash(tb.prefix_hash(low), starts, ends)
    runs = tb.window_hash(words, n)
    out = []
    for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if z - a >= n:
            out.append(np.unique(runs[a : z - n + 1]))
        elif z > a:
            out.append(tb.window_hash(words[a:z], z - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _node(tokens: np.ndarray) -> int:
    """The name of a set."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _keys(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in tb.slices(batch):
                sets = shingle_sets(buf, offsets, n)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_node(s) for s in sets], pa.int64())], names=["doc_id", "key", "n", "node"]
                )

    return run


def _prefixes(n: int, percent: int):
    """(token, node): the lengthened prefix under the order of hashes; each set once in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = set()
            for part, buf, offsets in tb.slices(batch):
                tokens, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for doc, s in zip(part.column("doc_id").to_pylist(), shingle_sets(buf, offsets, n), strict=True):
                    node = _node(s)
                    if doc is None or not len(s) or node in seen:
                        continue
                    seen.add(node)
                    head = s[: _lengthened(len(s), percent)[0]]
                    tokens.append(head)
                    ids.append(np.full(len(head), node, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(ids))], names=["token", "node"])

    return run


def _whole_sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(node, tokens) of the texts that are their node's (rows may repeat a doc_id with another text)."""
    for batch in batches:
        for part in unpacked(batch):
            buf, offsets = tb.buffer_of(tb.text_array(part.column("text")))
            found = [(node, s) for node, s in zip(part.column("node").to_pylist(), shingle_sets(buf, offsets, n), strict=True) if _node(s) == node]
            tokens = np.concatenate([np.zeros(0, np.uint64), *(s for _, s in found)]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s) for _, s in found])]).astype(np.int32)), pa.array(tokens))
            yield pa.RecordBatch.from_arrays([pa.array([node for node, _ in found], pa.int64()), lists], names=["node", "tokens"])


def candidates_for_join(docs: DataFrame, keys: DataFrame, n: int, percent: int) -> DataFrame:
    """Step 2: (node, n, tokens) of the nodes that may have a link."""
    prefixes = docs.select("doc_id", "text").mapInArrow(_prefixes(n, percent), "token long, node long")
    live = prefixes.groupBy("token").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x != y").select("token")
    # A node that several batches hold counts its hits several times, which only weakens the filter.
    hits = prefixes.join(live.hint("shuffle_hash"), "token").groupBy("node").agg(F.count("*").alias("hits"))
    size = F.col("n")
    prefix = size - need_of(size, percent) + 1
    longer = F.least(size, prefix + F.floor(size / 20))
    nodes = keys.where("doc_id is not null and n > 0").groupBy("node").agg(F.min("n").alias("n"), F.min("doc_id").alias("doc_id"))
    able = hits.join(nodes, "node").where(F.col("hits") >= longer - prefix + 1).select("node", "doc_id")
    texts = docs.where("text is not null").select("doc_id", packed("text").alias("text")).join(able, "doc_id").select("node", "text")
    sets = texts.mapInArrow(partial(_whole_sets, n=n), "node long, tokens array<long>")
    return sets.select("node", F.size("tokens").cast("long").alias("n"), "tokens").dropDuplicates(["node"])


def ordered(sets: DataFrame, percent: int) -> DataFrame:
    """Step 3: (node, n, tokens, live, first, second, third): the live shingles, and the live part of the prefix under each order.

    The orders: rarest first; rarest first by powers of two, then by a second
    hash; a third hash alone. Dead shingles stand before all others in each.
    """
    single = sets.select("node", F.explode("tokens").alias("token"))
    df = single.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    entry = F.struct(F.col("df").cast("int").alias("df"), "token")
    nodes = single.join(df, "token").groupBy("node").agg(F.array_sort(F.collect_list(entry)).alias("e")).join(sets.select("node", "n"), "node")
    left = F.size("e").cast("long") - need_of(F.col("n"), percent) + 1

    def head(key) -> Column:
        return F.slice(F.transform(F.array_sort(F.transform("e", key)), lambda x: x["token"]), F.lit(1), F.col("left").cast("int"))

    return (
        nodes.withColumn("left", left)
        .where("left > 0")
        .select(
            "node",
            "n",
            F.size("e").cast("long").alias("live"),
            F.transform("e", lambda x: x["token"]).alias("tokens"),
            F.slice(F.transform("e", lambda x: x["token"]), F.lit(1), F.col("left").cast("int")).alias("first"),
            head(lambda x: F.struct(F.floor(F.log2(x["df"])).alias("c"), F.xxhash64(x["token"]).alias("h"), x["token"].alias("token"))).alias("second"),
            head(lambda x: F.struct(F.xxhash64(x["token"], F.lit(3)).alias("h"), x["token"].alias("token"))).alias("third"),
        )
    )


def verify(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b) -> those that share prefix shingles under each order, and then link."""
    side = lambda s: nodes.select(*(F.col(c).alias(f"{s}_{c}") for c in ("node", "n", "tokens", *ORDERS)))
    both = pairs.join(side("a"), F.col("a") == F.col("a_node")).join(side("b"), F.col("b") == F.col("b_node"))
    for order in ORDERS:
        both = both.where(F.arrays_overlap(f"a_{order}", f"b_{order}"))
    shared = F.size(F.array_intersect("a_tokens", "b_tokens")).cast("long")
    return both.select("a", "b", "a_n", "b_n", shared.alias("shared")).where(100 * F.col("shared") >= percent * (F.col("a_n") + F.col("b_n") - F.col("shared"))).select("a", "b")


def link_nodes(nodes: DataFrame, percent: int) -> DataFrame:
    """Step 4: links (a, b) that join all nodes of a component."""
    posts = nodes.select("node", "n", "live", F.explode("first").alias("token"))
    best = F.struct((F.col("live") / F.col("n")).alias("whole"), (-F.col("node")).alias("less"), F.col("node").alias("pivot"), F.col("n").alias("pivot_n"), F.col("live").alias("pivot_live"))
    pivots = posts.groupBy("token").agg(F.max(best).alias("p")).select("token", "p.pivot", "p.pivot_n", "p.pivot_live")
    fits = overlap_of(F.col("n"), F.col("pivot_n"), percent) <= F.least("live", "pivot_live")
    met = posts.join(pivots, "token").where((F.col("node") != F.col("pivot")) & fits).groupBy("node", "pivot").agg(F.count("*").alias("times"))
    stars = met.groupBy("node").agg(F.max_by("pivot", F.struct("times", -F.col("pivot"))).alias("pivot"))
    found = stored(verify(stars.select(F.col("node").alias("a"), F.col("pivot").alias("b")), nodes, percent), "stars")

    labels = components(found)
    placed = nodes.join(labels, nodes["node"] == labels["vertex"], "left").select(*ORDERS, nodes["node"], "n", "live", F.coalesce("component", "node").alias("component"))
    return found.unionByName(verify(stored(_apart_pairs(placed, percent), "pairs"), nodes, percent))


def _apart_pairs(placed: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the nodes that share a prefix shingle, lie in different components and can share enough.

    A shingle of up to MANY nodes pairs them. The nodes of a busier one are met again
    by their prefixes under the next order, in which a pair must share a shingle too.
    """
    made = None
    for order in ORDERS:
        posts = placed.select("node", "n", "live", "component", F.col(order).alias("head"), F.explode(order).alias("token"))
        apart = posts.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("many")).where("x != y").select("token", "many")
        posts = stored(posts.join(apart, "token"), "open")
        last = order == ORDERS[-1]
        pairs = _pairs(posts if last else posts.where(F.col("many") <= MANY), percent)
        made = pairs if made is None else made.unionByName(pairs)
        if not last:
            busy = stored(posts.where(F.col("many") > MANY).select("node").distinct(), "busy")
            if busy.isEmpty():
                break
            placed = placed.join(busy, "node", "left_semi")
    return made.distinct()


def _pairs(posts: DataFrame, percent: int) -> DataFrame:
    """The pairs of posts, each made at the first shingle that both prefixes have."""
    a, b = (posts.select("token", *(F.col(c).alias(f"{side}_{c}") for c in ("node", "n", "live", "component", "head"))) for side in "ab")
    able = overlap_of(F.col("a_n"), F.col("b_n"), percent) <= F.least("a_live", "b_live")
    once = F.get(F.array_intersect("a_head", "b_head"), F.lit(0)) == F.col("token")
    met = a.join(b, "token").where((F.col("a_node") < F.col("b_node")) & (F.col("a_component") != F.col("b_component")) & able & once)
    return met.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """documents -> (doc_id, n_shingles, component_id), one row for each input row.

    component_id is the smallest doc_id reachable by links of J >= percent/100
    between sets of n-word shingles.
    """
    return _grouped(docs, n, percent).drop("key")


def _grouped(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """``near_duplicates`` with ``key``, the hash of the row's text."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("key"))
    keys = stored(docs.mapInArrow(_keys(n), "doc_id long, key long, n long, node long"), "keys")
    sets = stored(candidates_for_join(docs, keys, n, percent), "sets")
    nodes = stored(ordered(sets, percent), "nodes")
    forget(sets)
    parts = components(link_nodes(nodes, percent))
    same = keys.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    placed = same.join(parts, F.col("node") == F.col("vertex"), "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = keys.where("n > 0").join(placed.drop("doc_id").join(least, "component"), "node").select("doc_id", "key", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(keys.where("n = 0").select("doc_id", "key", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stand for their group (smallest doc_id), with all their columns.

    Rows are judged by doc_id and text: of two rows of one doc_id, one may stay and
    the other, another text, may go. Rows of a null doc_id stay.
    """
    gone = _grouped(docs, n, percent).where("doc_id != component_id").select("doc_id", "key").distinct()
    doc, key = unused("copy_doc", docs), unused("copy_key", docs)
    gone = gone.select(F.col("doc_id").alias(doc), F.col("key").alias(key))
    return docs.join(gone, (docs["doc_id"].cast("long") == F.col(doc)) & (F.xxhash64(docs["text"]) == F.col(key)), "left_anti")
