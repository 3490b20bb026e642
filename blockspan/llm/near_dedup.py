"""Near duplicates by Order MinHash and banded alignment (operator 5).

1. A text becomes its words (numbers), their shingles of ``k`` words, and for each of a
   family of hash functions a bucket key: the smallest occurrence-labelled shingles, in
   text order (``order_minhash``). Texts of the same words are one *node* from here on.
2. In the buckets of each node's first keys, all are held against one of them, the leader:
   both their sets of shingles and the alignment of their sequences (``sequences``) must
   reach the threshold. That joins most of
   a large group of near copies at a cost of its size. Then, in every bucket whose nodes
   aren't yet of one component, each node outside the bucket's largest component is held
   against all of the bucket that are not of its own, linked ones too: small buckets within
   a task, larger ones in blocks, so many nodes a round. A pair is passed over only if its
   ends are of one component, or if they share too few shingles for the threshold. So no
   link gets lost that the buckets hold, whatever their size.
3. Links make components; a class is named by the least id in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .order_minhash import sketches
from .runtime import keep, settle
from .sequences import alignment_similarity, shingles, words

#: Nodes of a block, and blocks of nodes a round that are held against all blocks of their bucket.
SMALL, TURN = 256, 8
#: Keys of a node whose buckets are held against their leaders first.
FIRST = 8


def _node(w: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(w.tobytes()) - (1 << 63) if len(w) else None


def _signatures(batches: Iterator[pa.RecordBatch], k: int, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, keys, seen = [], [], set()
        for text in batch["text"].to_pylist():
            w = words(text)
            nodes.append(node := _node(w))
            # A copy met before in this batch has the same keys; they come from there.
            keys.append([] if node is None or node in seen else sketches(shingles(w, k), threshold).view(np.int64))
            seen.add(node)
        yield pa.RecordBatch.from_arrays([batch["id"], pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["id", "node", "keys"])


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [words(t) for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(map(_node, found), pa.int64()), pa.array([w.tobytes() for w in found])], ["node", "words"])


def _shingles(data: bytes, k: int) -> np.ndarray:
    return shingles(np.frombuffer(data, np.uint32), k)


def alike(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether two sequences of shingles reach the threshold, as sets and aligned."""
    x, y = np.unique(a), np.unique(b)
    if min(len(x), len(y)) < threshold * max(len(x), len(y)):
        return False
    shared = len(x) + len(y) - len(np.union1d(x, y))
    return shared >= threshold * (len(x) + len(y) - shared) and alignment_similarity(a, b, threshold) >= threshold


def _aligned(batches: Iterator[pa.RecordBatch], k: int, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch["a_words"].to_pylist(), batch["b_words"].to_pylist()
        ok = [alike(_shingles(x, k), _shingles(y, k), threshold) for x, y in zip(a, b, strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _across(pdf: pd.DataFrame, k: int, threshold: float) -> pd.DataFrame:
    """Links of a block: each leading node against all members, until they are of one component."""
    pdf = pdf.sort_values("copied")
    nodes, labels, found = pdf["node"].tolist(), pdf["label"].tolist(), [_shingles(x, k) for x in pdf["words"]]
    lead, n = pdf["lead"].to_numpy(bool), int((~pdf["copied"].to_numpy(bool)).sum())
    if not n:
        return pd.DataFrame([], columns=["a", "b"], dtype="int64")
    root, links = {x: x for x in labels}, []

    def top(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    sets = [np.unique(x) for x in found]
    sizes = np.array([len(x) for x in sets])
    begin = np.r_[0, np.cumsum(sizes)]
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    own, of_members = np.zeros(len(codes), np.int32), codes[: begin[n]]
    for i in np.flatnonzero(lead).tolist():
        own[codes[begin[i] : begin[i + 1]]] = 1
        shared = np.add.reduceat(own[of_members], begin[:n])
        own[codes[begin[i] : begin[i + 1]]] = 0
        # Of sets that are alike, the sequences are aligned.
        for j in np.flatnonzero(shared >= threshold * (sizes[:n] + sizes[i] - shared)).tolist():
            if top(labels[i]) != top(labels[j]) and alignment_similarity(found[i], found[j], threshold) >= threshold:
                root[top(labels[i])] = top(labels[j])
                links.append((nodes[j], nodes[i]))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _union(links: list[DataFrame]) -> DataFrame:
    edges = links[0]
    for more in links[1:]:
        edges = edges.unionByName(more)
    return edges


def _labelled(rows: DataFrame, links: list[DataFrame]) -> DataFrame:
    labels = components(_union(links))
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def links_within_buckets(nodes: DataFrame, sequences: DataFrame, k: int, threshold: float, small: int = SMALL) -> list[DataFrame]:
    """Links of the nodes that share a bucket; enough of them to connect what is linked."""
    first, second = (sequences.select(F.col("node").alias(c), F.col("words").alias(f"{c}_words")) for c in "ab")
    own_keys = keep(nodes.select("node", "keys"))
    rows = own_keys.select("node", F.explode(F.slice("keys", 1, FIRST)).alias("key"))
    leaders = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("leader")).where("n > 1")
    pairs = rows.join(leaders.select("key", "leader"), "key").where("node <> leader")
    pairs = pairs.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    linked = pairs.join(first, "a").join(second, "b").mapInArrow(lambda it: _aligned(it, k, threshold), "a long, b long")
    links = [settle(linked)]
    rows = settle(_labelled(own_keys, links)).select("node", "label", F.explode("keys").alias("key"), F.lit(False).alias("done"))
    nth = 0
    while True:
        # Buckets of more than one component; of those with the same nodes, one.
        rows = settle(rows.join(rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high"), "key", "left_semi"))
        parts = rows.groupBy("key", "label").agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(node))").alias("print"))
        buckets = parts.groupBy("key").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.sum("n").alias("n"), F.expr("bit_xor(print)").alias("print"))
        buckets = buckets.groupBy("n", "print").agg(F.min(F.struct("key", "main")).alias("b")).select("b.*", "n")
        # Each pair of two components has an end outside the largest one: such nodes lead, once.
        outside = rows.join(buckets, "key").where("not done and label <> main")
        buckets = settle(outside.groupBy("key").agg(F.max("main").alias("main"), F.max("n").alias("n"), F.count("*").alias("left"), F.min("node").alias("next")))
        if buckets.isEmpty():
            return links
        blocks, turns = F.ceil(F.col("n") / small).cast("long"), F.ceil(F.col("left") / (TURN * small)).cast("long")
        turn = (F.pmod(F.xxhash64("node", F.lit(nth)), turns) == 0) | (F.col("node") == F.col("next"))
        placed = rows.join(buckets, "key").select(
            "key", "node", "label", "done", (~F.col("done") & (F.col("label") != F.col("main")) & turn).alias("lead"),
            blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).alias("block"),
        )
        placed = settle(placed)
        members = placed.select("key", "block", "node", "label", "lead", F.lit(False).alias("copied"))
        others = F.array_remove(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), F.col("block"))
        copies = placed.where("lead and blocks > 1").select("key", F.explode(others).alias("block"), "node", "label", "lead", F.lit(True).alias("copied"))
        held = members.unionByName(copies).join(sequences, "node")
        links.append(settle(held.groupBy("key", "block").applyInPandas(lambda pdf: _across(pdf, k, threshold), "a long, b long")))
        more = buckets.where(F.col("left") > TURN * small).select("key")
        if more.isEmpty():
            return links
        rows = placed.join(more, "key", "left_semi").select("node", "key", (F.col("done") | F.col("lead")).alias("done"))
        rows, nth = settle(_labelled(rows, links)).select("node", "label", "key", "done"), nth + 1


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8, small: int = SMALL
) -> DataFrame:
    """A row for each row of ``df``: its id and ``class_id``, the least id of its class.

    Two texts are linked if their sets of shingles of ``k`` words have a Jaccard similarity
    of ``threshold`` and the alignment of the sequences, m aligned of n_a and n_b, has
    m / (n_a + n_b - m) >= ``threshold``, a shingle counting as often as it occurs. So a
    text isn't like seven of it in a row, nor like another that has nothing in common with
    it but a line said very often. A class is what links connect. Texts with the same words are in one class. A text without a word (null
    and empty ones too) is alone in its class; a null id is in a class with an id if the
    class has one, else ``class_id`` is null; repeated rows share their class. Other columns
    are not read. An empty table gives an empty table. Candidates come from hashing: a pair
    at the threshold sharp is missed with a probability of about 0.005 at most (see
    ``families``), one clearly above it much more seldom.
    """
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = df.schema[id_col].dataType.simpleString()
    signed = keep(source.mapInArrow(lambda it: _signatures(it, k, threshold), f"id {kind}, node long, keys array<long>"))
    nodes = signed.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.max("keys").alias("keys"), F.count("*").alias("n"))
    nodes = keep(nodes)
    shared = nodes.select("node", "id", F.explode("keys").alias("key"))
    shared = shared.join(shared.groupBy("key").count().where("count > 1"), "key", "left_semi").select("node", "id").distinct()
    shared = keep(shared)
    # By id the texts are found; by node, those of them that are meant.
    wanted = source.join(shared.select(F.col("id").alias("wanted")).distinct(), F.col("id").eqNullSafe(F.col("wanted")), "left_semi")
    sequences = wanted.mapInArrow(_sequences, "node long, words binary").join(shared.select("node"), "node", "left_semi")
    sequences = keep(sequences.dropDuplicates(["node"]))
    links = links_within_buckets(nodes.join(shared.select("node"), "node", "left_semi"), sequences, k, threshold, small)
    labels = components(_union(links))
    named = labels.join(nodes.select("node", "id"), "node").groupBy("label").agg(F.min("id").alias("class_id"))
    classes = nodes.select("node", "id", "n").join(labels.join(named, "label").select("node", "class_id"), "node", "left")
    classes = keep(classes.select("node", "n", F.coalesce("class_id", "id").alias("class_id")))
    return _members(signed.select("id", "node"), classes).withColumnRenamed("id", id_col)


def _members(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Each row with the class of its node. Nodes of very many rows are few (at most 1000
    can have a thousandth of all rows), so their classes go to the rows; the others meet
    by shuffle, where none of them is a burden to one task."""
    most = max(100, (classes.agg(F.sum("n")).first()[0] or 0) // 1000)
    hot = F.broadcast(classes.where(F.col("n") > most).select("node", "class_id"))
    few = classes.where(F.col("n") <= most).select("node", "class_id")
    alone = rows.where("node is null").select("id", F.col("id").alias("class_id"))
    rows = rows.where("node is not null")
    common = rows.join(hot, "node").select("id", "class_id")
    return alone.unionByName(common).unionByName(rows.join(hot, "node", "left_anti").join(few, "node").select("id", "class_id"))
