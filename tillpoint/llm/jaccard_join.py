"""Similarity self-join of documents on word n-grams by chosen paths.

Every text's set of hashed n-grams gets a signature of minimum hashes, whose
(coordinate, value) pairs are the tokens that similar sets share.  Each run
starts at its own root and recursively splits the sets on sampled tokens: a
set goes to the children that a hash of the node picks, on average
``1/threshold`` of them.  Nodes with one set end; small nodes are compared by
brute force; larger ones are split again.  What is still large after
``MAX_DEPTH`` shared tokens is linked to the node's first set.  Runs are repeated until a
pair at the threshold is missed with probability below ``1 - RECALL``, all
depths and the brute force's filter counted (``plan``).

The links found form candidate clusters.  Inside a cluster the whole n-gram
sets are compared exactly, block by block, so every reported link is exact and
a pair that all runs missed is still found if anything joins its cluster.

Sets that are equal are one class member from the first step on, so copies
cost nothing, and no pair is ever written out: each comparison reports counts
per set and a spanning forest."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpoint.llm.common import as_frame, col, free_name, growing, materialize, text_slices
from tillpoint.llm.text import hash_words, mix, odd, split_words, window_hashes
from tillpoint.operators.components import components

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.999999
SIGNATURE = 128
SMALL = 64
MAX_DEPTH = 6
BLOCK = 256
BLOCK_GRAMS = 1 << 20

_A = odd(SIGNATURE, 101).astype(np.uint32) | np.uint32(1)
_B = mix(odd(SIGNATURE, 202)).astype(np.uint32)


def ngram_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-grams of each text; a text of fewer
    words, but not none, is one n-gram."""
    w = split_words(texts)
    words = hash_words(w)
    grams = window_hashes(words, n)
    sets = []
    for a, b in zip(w.docs[:-1].tolist(), w.docs[1:].tolist()):
        if b - a >= n:
            sets.append(np.unique(grams[a:b - n + 1]))
        elif b > a:
            sets.append(window_hashes(words[a:b], b - a))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def set_id(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SIGNATURE minimum hashes of each non-empty set, as int32."""
    sizes = np.array([len(s) for s in sets])
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    out = np.empty((len(sets), SIGNATURE), np.uint32)
    for k in range(SIGNATURE):
        h = flat * _A[k] + _B[k]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        out[:, k] = np.minimum.reduceat(h, first)
    return out.view(np.int32)


def _sign(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_slices(batch.column("text")):
                sets = ngram_sets(texts, n)
                some = [i for i, s in enumerate(sets) if len(s)]
                sign = np.zeros((len(sets), SIGNATURE), "<i4")
                if some:
                    sign[some] = signatures([sets[i] for i in some])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(texts)), batch.column("key").slice(first, len(texts)),
                     pa.array([set_id(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([s.tobytes() for s in sign], pa.binary()),
                     pa.array([s.tobytes() for s in sign.astype(np.int8)], pa.binary())],
                    names=["doc_id", "key", "id", "grams", "sign", "short"])
    return run


def plan(threshold: float, recall: float) -> tuple[int, int, int]:
    """(least number of places in which a brute-forced pair's signatures agree,
    runs of all sets, runs of the sets that large nodes hold): a pair at the
    threshold is missed with probability ``1 - recall`` at most.

    All runs read the same signatures, so the pairs of each number of agreeing
    places (binomial) have their own miss.  A pair that shares a node at some
    depth only shares one at the next by ``_children``; in the worst case all
    its nodes stay large down to MAX_DEPTH.  A quarter of the misses is the
    filter's, a quarter the first level's, a half the large nodes'."""
    alike = np.arange(SIGNATURE + 1)
    pairs = np.array([math.comb(SIGNATURE, k) * threshold ** k * (1 - threshold) ** (SIGNATURE - k) for k in alike.tolist()])
    least = int((np.cumsum(pairs) <= (1 - recall) / 4).sum())
    extra = min(1.0, 1 / threshold - 1)

    def runs(depth: int, share: float) -> int:
        miss = np.zeros(SIGNATURE + 1)
        for _ in range(depth):
            pick = 1 - alike / SIGNATURE * (1 - miss)
            miss = (1 - extra) * pick + extra * pick ** 2
        n = 1
        while (pairs * miss ** n)[least:].sum() > share * (1 - recall):
            n += 1
        return n

    first = runs(1, 0.25)
    return least, first, max(first, runs(MAX_DEPTH, 0.5))


def _rooted(sets: DataFrame, runs: range) -> DataFrame:
    return sets.select("num", "sign").withColumn("node", F.explode(F.sequence(F.lit(runs.start).cast("long"), F.lit(runs.stop - 1).cast("long"))))


def _children(rows: DataFrame, threshold: float) -> DataFrame:
    """Rows (node, num, sign) -> the same with the children each set goes to.

    The node's hash picks the coordinates, so sets that agree there meet
    again; the number of picks is 1/threshold on average.  A pick leads to a
    node of its own, so no set is in a node twice."""
    extra = int((1 / threshold - 1) * (1 << 20))
    picks = F.when(F.pmod(F.xxhash64(F.col("node"), F.lit("more")), F.lit(1 << 20)) < extra, F.lit(2)).otherwise(F.lit(1))
    rows = rows.select("num", "sign", "node", F.explode(F.sequence(F.lit(1), picks)).alias("pick"))
    at = F.pmod(F.xxhash64("node", "pick"), F.lit(SIGNATURE)).cast("int")
    value = F.substring(F.col("sign"), at * 4 + 1, F.lit(4))
    return rows.select(F.xxhash64("node", "pick", at, value).alias("node"), "num", "sign")


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches sorted by ``key`` -> tables that end where a group ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        start = int(np.searchsorted(keys, keys[-1]))
        if start:
            yield pa.Table.from_batches([*held, batch.slice(0, start)])
            held = []
        elif held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Disjoint sets; the root of a set is its smallest member."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x, y) -> None:
        x, y = sorted((self.root(x), self.root(y)))
        if x != y:
            self.up[y] = x


def _brute_force(least: int):
    """Compare the low bytes of all signatures inside each node (of at most
    SMALL sets); unequal values share one in 256 of them, which only adds candidates."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, "node"):
            node = rows.column("node").to_numpy()
            ids = rows.column("num").to_pylist()
            sign = np.frombuffer(b"".join(rows.column("short").to_pylist()), np.int8).reshape(len(ids), SIGNATURE)
            forest = Forest()
            for step in range(1, SMALL):
                i = np.flatnonzero(node[:-step] == node[step:]) if step < len(ids) else node[:0]
                if not len(i):
                    break
                for part in np.array_split(i, len(i) // 20_000 + 1):
                    alike = (sign[part] == sign[part + step]).sum(axis=1) >= least
                    for k in part[alike].tolist():
                        forest.join(ids[k], ids[k + step])
            edges = [(forest.root(x), x) for x in forest.up]
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()),
                                              pa.array([e[1] for e in edges], pa.int64())], names=["a", "b"])
    return run


def _sized(nodes: DataFrame, read="true") -> DataFrame:
    """Rows (node, num, depth) of nodes with more than one set, with the
    node's size and first set; only of nodes that ``read`` holds for."""
    nodes = materialize(nodes, "nodes")
    sizes = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("num").alias("first"), F.min("depth").alias("depth"))
    sizes = sizes.filter("size > 1").filter(read).drop("depth")
    return materialize(nodes.join(growing(materialize(sizes, "sizes")), "node"), "sized")


def candidate_clusters(sets: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Distinct sets (num, sign, short) -> rows (id, root) of those in a
    cluster, by num.

    All sets are split once; the sets of large nodes get further runs and are
    split on, to all further depths in one pass (the nodes below a small one are compared once
    more than need be)."""
    spark = sets.sparkSession
    least, runs, more = plan(threshold, recall)
    first = _sized(_children(_rooted(sets, range(runs)), threshold).select("node", "num", F.lit(1).alias("depth")))
    held = first.filter(F.col("size") > SMALL).select("num").distinct()
    held = materialize(sets.select("num", "sign").join(growing(held), "num"), "held")
    if more > runs:
        first = first.unionByName(_sized(_children(_rooted(held, range(runs, more)), threshold).select("node", "num", F.lit(1).alias("depth"))))
    large = first.filter(F.col("size") > SMALL).select("num", "node")
    level = materialize(large.join(growing(held), "num"), "large")
    levels = []
    for depth in range(2, MAX_DEPTH + 1):
        level = _children(level, threshold)
        levels.append(level.select("node", "num", F.lit(depth).alias("depth")))
    # A large node's sets are read again at the last depth only.
    deeper = _sized(reduce(DataFrame.unionByName, levels), f"size <= {SMALL} or depth = {MAX_DEPTH}")
    small = first.unionByName(deeper).filter(F.col("size") <= SMALL).join(growing(sets.select("num", "short")), "num")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = small.select("node", "num", "short").repartition(parts, "node").sortWithinPartitions("node", "num")
    compared = ordered.mapInArrow(_brute_force(least), "a long, b long")
    whole = deeper.filter((F.col("size") > SMALL) & (F.col("depth") == MAX_DEPTH)).select(F.col("first").alias("a"), F.col("num").alias("b"))
    return materialize(components(compared.unionByName(whole)), "clusters")


def _compare(threshold: float):
    """Exact comparison of the sets of one cluster in two blocks."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        grams = [np.frombuffer(g, np.uint64) for g in rows["grams"]]
        sizes = np.array([len(g) for g in grams])
        ids, often = rows["num"].tolist(), rows["often"].to_numpy()
        block = rows["block"].to_numpy()
        same = int(rows["lo"].iloc[0]) == int(rows["hi"].iloc[0])
        _, code, count = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(grams)), sizes)
        shared = count[code] > 1
        code, owner = code[shared], owner[shared]
        common = np.zeros((len(grams), len(grams)), np.float32)
        if len(code):
            _, code = np.unique(code, return_inverse=True)
            order = np.argsort(code, kind="stable")
            code, owner = code[order], owner[order]
            width = 4096
            cuts = np.searchsorted(code, np.arange(0, int(code[-1]) + 1, width))
            for a, b in zip(cuts, np.append(cuts[1:], len(code))):
                part = np.zeros((len(grams), width), np.float32)
                part[owner[a:b], code[a:b] % width] = 1
                common += part @ part.T
        union = sizes[:, None] + sizes[None, :] - common
        linked = common >= threshold * union - 1e-9
        np.fill_diagonal(linked, False)
        if not same:
            linked &= block[:, None] != block[None, :]
        links = linked.astype(np.int64) @ often.astype(np.int64)
        out = [(i, None, int(n)) for i, n in zip(ids, links) if n]
        forest = Forest()
        for i, j in zip(*np.nonzero(np.triu(linked))):
            forest.join(ids[i], ids[j])
        out += [(forest.root(x), x, 0) for x in forest.up]
        return pd.DataFrame(out, columns=["a", "b", "links"]).astype({"a": "int64", "b": "Int64", "links": "int64"})
    return run


def _grams(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_slices(batch.column("text")):
                sets = ngram_sets(texts, n)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(first, len(texts)) for c in ("num", "id", "root", "blocks", "often")],
                     pa.array([s.tobytes() for s in sets], pa.binary()),
                     pa.array([set_id(s) for s in sets], pa.binary())],
                    names=["num", "id", "root", "blocks", "often", "grams", "found"])
    return run


def _key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return as_frame(docs, doc_id=id_col, text=text_col).withColumn("key", _key(F.col("doc_id"), F.col("text")))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM,
                 threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per input row: ``doc_id, key, class_id, class_docs, n_links,
    class_set``.

    Two texts are linked if the Jaccard similarity of their n-gram sets is at
    least ``threshold``; a class is a connected component of links.  class_id
    is the smallest id in the class (of its non-null ids), class_docs its
    number of rows, n_links the number of other rows that the row is linked to,
    copies included.  ``key`` is a hash of id and text, ``class_set`` names the
    class where ids are null or repeat (null for a text without n-grams).

    Null and empty texts, and others without a word, have no n-grams: they
    link to nothing and each is a class of its own.  A text of fewer than
    ``ngram`` words is one n-gram.  Null ids keep their rows; repeated rows are
    rows that link to each other.  An empty table gives an empty result."""
    keyed = _keyed(docs, id_col, text_col)
    id_type = keyed.schema["doc_id"].dataType.simpleString()
    rows = materialize(keyed.mapInArrow(_sign(ngram), f"doc_id {id_type}, key long, id binary, grams long, sign binary, short binary"), "signed")
    sets = rows.filter("grams > 0").groupBy("id").agg(
        F.count(F.lit(1)).alias("often"), F.first("sign").alias("sign"), F.first("short").alias("short"),
        F.min("key").alias("key"), F.first("grams").alias("grams"))
    # From here on a set is a number, fixed by writing it.
    sets = materialize(sets.withColumn("num", F.monotonically_increasing_id()), "sets")
    clusters = candidate_clusters(sets.select("num", "sign", "short"), threshold, recall).withColumnRenamed("id", "num")
    inside = materialize(clusters.join(growing(sets.select("num", "id", "often", "key", "grams")), "num"), "inside")
    # Blocks hold at most about BLOCK sets and BLOCK_GRAMS n-grams.
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)), F.ceil(F.sum("grams") / F.lit(BLOCK_GRAMS))).cast("int")
    sizes = materialize(inside.groupBy("root").agg(blocks.alias("blocks")), "sizes")
    members = materialize(inside.drop("grams").join(growing(sizes), "root"), "members")
    # One text of each member, read again; rows that only share the key drop out by their set.
    texts = keyed.select("key", "text").join(growing(members), "key").select("num", "id", "root", "blocks", "often", "text")
    full = texts.mapInArrow(_grams(ngram), "num long, id binary, root long, blocks int, often long, grams binary, found binary")
    full = materialize(full.filter("id = found").select("num", "root", "blocks", "often", "grams").dropDuplicates(["num"]), "grams")
    full = full.withColumn("block", F.pmod(F.xxhash64("num"), F.col("blocks")).cast("int"))
    pairs = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "root", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "num", "often", "grams")
    compared = materialize(pairs.groupBy("root", "lo", "hi").applyInPandas(_compare(threshold), "a long, b long, links long"), "compared")
    links = compared.filter("b is null").groupBy(F.col("a").alias("num")).agg(F.sum("links").alias("links"))
    joined = components(compared.filter("b is not null").select("a", "b")).withColumnRenamed("id", "num")
    of = (sets.select("num", "id", "often").join(growing(joined), "num", "left").join(growing(links), "num", "left")
          .select("id", F.coalesce("root", "num").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("often") - 1).alias("n_links")))
    of = materialize(of, "classes")
    placed = materialize(rows.select("doc_id", "key", "id", "grams").filter("grams > 0").join(growing(of), "id"), "placed")
    classes = placed.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_docs"),
                                         F.lower(F.hex(F.min("id"))).alias("class_set"))
    out = placed.join(growing(materialize(classes, "class")), "root").select(
        "doc_id", "key", "class_id", "class_docs", "n_links", "class_set")
    alone = rows.filter("grams = 0").select("doc_id", "key", F.col("doc_id").alias("class_id"),
                                           F.lit(1).cast("long").alias("class_docs"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("string").alias("class_set"))
    return out.unionByName(alone)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without all but one row of each class (the smallest id; a null
    id only where the class has no other), with all columns as they are.

    Of rows that agree in id and text, and stay, one is kept.  Rows are
    followed by their id and a hash of id and text, so only rows of one id
    could be taken for each other."""
    found = materialize(jaccard_join(docs, id_col, text_col, **options), "joined").filter("class_docs > 1")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    stay = materialize(found.groupBy("class_set").agg(least.alias("first")).select(
        "class_set", F.col("first.doc_id").alias("stay_id"), F.col("first.key").alias("stay_key")), "stay")
    stays = F.col("doc_id").eqNullSafe(F.col("stay_id")) & (F.col("key") == F.col("stay_key"))
    act = (found.groupBy("doc_id", "key", "class_set").agg(F.count(F.lit(1)).alias("rows")).join(growing(stay), "class_set")
           .withColumn("drop", ~stays).filter("drop or rows > 1"))
    act = materialize(act.groupBy("doc_id", "key").agg(F.min("drop").alias("drop")), "act")
    key, drop, seen, seen_id = (free_name(docs, c) for c in ("key", "drop", "seen", "seen_id"))
    marked = docs.withColumn(key, _key(col(id_col), col(text_col)))
    of = act.select(F.col("doc_id").alias(seen_id), F.col("key").alias(seen), F.col("drop").alias(drop))
    same = (col(key) == col(seen)) & col(id_col).eqNullSafe(col(seen_id))
    out = marked.join(growing(of.select(seen, seen_id)), same, "left_anti").select(*[col(c) for c in docs.columns])
    if act.filter("not drop").limit(1).count():
        one = marked.join(growing(of.filter(~col(drop))), same, "left_semi")
        first = F.first(F.struct(*[col(c) for c in docs.columns])).alias(drop)
        out = out.unionByName(one.groupBy(col(key), col(id_col)).agg(first).select(f"{drop}.*"))
    return out
