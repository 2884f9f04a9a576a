"""Hard-negative mining over an inverted multi-index.

The two halves of the vectors have a codebook each (k-means on a bounded
sample); a row's cell is its pair of codewords, so k codewords a half make k * k
cells.  For a query q, a row of cell (i, j) scores at most

  u1(i) + u2(j),   u(i) = q_half . c_i + |q_half| * r_i

with r_i the largest distance of any row to codeword i.  Each anchor sorts both
halves' bounds and visits cells by falling sums from a heap (multi-sequence
search); it stops when what it has found beats the bound of the next cell,
so results are exact.

Rows are stored in blocks of about BLOCK rows: neighbouring small cells share
a block, a large cell is split by a hash of the id.  A round lets every
unfinished anchor visit cells until their rows reach its budget; anchors (in
chunks of neighbours) and blocks that they visit meet in one group, scored
by a matrix product, and each group passes on a bounded list for each
anchor.  Budgets grow by GROWTH, so a round that certifies nothing costs a
fraction of the next."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillpoint.llm.common import as_frame, col, growing, materialize

SCALE = 256
EVERY = 100
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
SAMPLE, ITERATIONS = 20_000, 12
MOST_WORDS = 256
BLOCK = 4096
# Blocks whose anchors are searched together, and anchors scored at once.
CHUNK, SLICE = 24, 256
BUDGET, GROWTH = 8192, 8
SEED = 17
# Sums of products of whole numbers below this are exact in doubles.
EXACT = 2 ** 52


def whole_numbers(rows, dim: int) -> np.ndarray:
    """floor(SCALE * x) of each component, as doubles; short vectors end in zeros."""
    out = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return np.floor(SCALE * out)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` and ``b``."""
    most = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    ints = [np.array([[int(x) for x in r] for r in m], dtype=object).reshape(m.shape) for m in (a, b)]
    return (ints[0] @ ints[1].T).astype(np.int64)


def codebook(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means codewords; fewer rows than ``k`` are their own."""
    k = min(k, len(x))
    rng = np.random.default_rng(seed)
    words = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ITERATIONS):
        near = _nearest(x, words)[0]
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(words)
        np.add.at(total, near, x)
        # An empty codeword stays where it is.
        words = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], words)
    return words


def _nearest(x: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest codeword of each row, and the distance (computed as a difference)."""
    near = np.argmin((words ** 2).sum(axis=1)[None, :] - 2 * x @ words.T, axis=1)
    return near, np.sqrt(((x - words[near]) ** 2).sum(axis=1))


def walk(q: np.ndarray, model: dict, rows: int) -> Iterator[tuple[int, float, int]]:
    """Non-empty cells by falling bound: (cell, bound, rows before it)."""
    cut = q.size // 2
    sides = []
    for half, words, radius in ((q[:cut], model["words"][0], model["radius"][0]), (q[cut:], model["words"][1], model["radius"][1])):
        bound = words @ half + np.linalg.norm(half) * radius
        # Rounding must not make a bound too small.
        bound += 1e-9 * (np.abs(words) @ np.abs(half) + np.linalg.norm(half) * radius) + 1e-9
        order = np.argsort(-bound, kind="stable")
        sides.append((order.tolist(), bound[order].tolist()))
    (left, u), (right, v) = sides
    count, width = model["count"], len(right)
    heap, seen, before = [(-(u[0] + v[0]), 0, 0)], {(0, 0)}, 0
    while heap:
        bound, i, j = heapq.heappop(heap)
        cell = left[i] * width + right[j]
        if count[cell]:
            yield cell, -bound, before
            before += count[cell]
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(left) and b < width and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (-(u[a] + v[b]), a, b))


def _index(rows: DataFrame, dim: int) -> tuple[DataFrame, dict]:
    """The rows with their ``block``, and what a search needs: codebooks,
    radii, rows and blocks of each cell (at most MOST_WORDS^2 numbers)."""
    n = rows.count()
    k = max(2, min(MOST_WORDS, math.ceil(n ** 0.25)))
    sample = rows.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(SAMPLE).select("vec").collect()
    x = whole_numbers([r[0] for r in sample], dim) if sample else np.zeros((1, dim))
    cut = dim // 2
    words = [codebook(x[:, :cut], k, SEED), codebook(x[:, cut:], k, SEED + 1)]
    width = len(words[1])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole_numbers(batch.column("vec").to_numpy(zero_copy_only=False), dim)
            (a, d), (b, e) = _nearest(x[:, :cut], words[0]), _nearest(x[:, cut:], words[1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(a * width + b, pa.int32()), pa.array(d), pa.array(e)], names=[*batch.schema.names, "cell", "d1", "d2"])

    vec = rows.schema["vec"].dataType.simpleString()
    placed = materialize(rows.mapInArrow(assign, f"id long, label long, vec {vec}, cell int, d1 double, d2 double"), "cells")
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d1").alias("d1"), F.max("d2").alias("d2")).collect()
    size = len(words[0]) * width
    model = {"words": words, "radius": [np.zeros(len(w)) for w in words], "count": [0] * size, "first": [0] * size, "blocks": [1] * size}
    block, held = 0, 0
    for r in sorted(cells, key=lambda r: r["cell"]):
        for side, (word, d) in enumerate(((r["cell"] // width, r["d1"]), (r["cell"] % width, r["d2"]))):
            model["radius"][side][word] = max(model["radius"][side][word], d)
        if held and held + r["n"] > BLOCK:
            block, held = block + 1, 0
        own = max(1, math.ceil(r["n"] / BLOCK))
        model["count"][r["cell"]], model["first"][r["cell"]], model["blocks"][r["cell"]] = r["n"], block, own
        block, held = (block + own, 0) if own > 1 else (block, held + r["n"])
    lookup = rows.sparkSession.createDataFrame(
        [(r["cell"], model["first"][r["cell"]], model["blocks"][r["cell"]]) for r in cells], "cell int, first int, blocks int")
    placed = placed.join(F.broadcast(lookup), "cell").select(
        "id", "label", "vec", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("blocks"))).cast("int").alias("block"))
    return materialize(placed, "index"), model


def _search(anchors: DataFrame, index: DataFrame, model: dict, dim: int, pick, merge, done: Column, out: str) -> DataFrame:
    """Rounds of visits until every anchor is certified.

    ``anchors``: (anchor, chunk, label, vec, wanted).  ``pick``: scored group -> rows of the schema
    ``out`` (which begins with the anchor).  ``merge``: all rows found -> the best.
    ``done``: whether an anchor's best rows beat ``bound``."""
    spark = index.sparkSession
    best, active, before, budget = None, anchors, 0, BUDGET
    total = sum(model["count"])

    def visits(low: int, high: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, bounds = [], []
                for q in whole_numbers(batch.column("vec").to_numpy(zero_copy_only=False), dim):
                    old, new, bound = set(), set(), -math.inf
                    for cell, limit, passed in walk(q, model, high):
                        if passed >= high:
                            bound = limit
                            break
                        (old if passed < low else new).update(range(model["first"][cell], model["first"][cell] + model["blocks"][cell]))
                    rows.append(sorted(new - old))
                    bounds.append(bound)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.int32())), pa.array(bounds, pa.float64())],
                                                 names=[*batch.schema.names, "visited", "bound"])
        return run

    def score(key, mine: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", kind="stable")
        x, found = whole_numbers(rows["vec"].to_numpy(), dim), []
        for at in range(0, len(mine), SLICE):
            part = mine.iloc[at:at + SLICE]
            found += pick(part, rows["id"].to_numpy(), rows["label"].to_numpy(), scores(whole_numbers(part["vec"].to_numpy(), dim), x))
        return pd.DataFrame(found, columns=names).astype("int64")

    names = [c.split()[0] for c in out.split(", ")]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema.fields)
    while True:
        walked = materialize(active.mapInArrow(visits(before, budget), f"{kinds}, visited array<int>, bound double"), "visits")
        asked = walked.withColumn("block", F.explode("visited")).drop("visited", "bound")
        pairs = materialize(asked.select("block", "chunk").distinct(), "pairs")
        met = index.join(growing(pairs), "block")
        found = asked.groupBy("block", "chunk").cogroup(met.groupBy("block", "chunk")).applyInPandas(score, out)
        best = materialize(merge(found if best is None else best.unionByName(found)), "best")
        before, budget = budget, budget * GROWTH
        if before >= total:
            return best
        state = best.groupBy("anchor").agg(F.collect_list(F.struct(*names[1:])).alias("best"))
        left = walked.join(growing(state), "anchor", "left").filter(~F.coalesce(done, F.col("bound") == -math.inf))
        active = materialize(left.select(*anchors.columns), "active")
        if not active.limit(1).count():
            return best


def _first(order: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` largest allowed values, ties by place."""
    at = np.flatnonzero(allowed)
    if len(at) > k:
        least = np.partition(order[at], len(at) - k)[len(at) - k]
        at = at[order[at] >= least]
    return at[np.argsort(-order[at], kind="stable")[:k]]


def _pick_positives(part: pd.DataFrame, ids: np.ndarray, labels: np.ndarray, s: np.ndarray) -> list[tuple]:
    return [(anchor, int(ids[k]), int(row[k])) for anchor, label, row in zip(part["anchor"], part["label"], s)
            for k in _first(row, (labels == label) & (ids != anchor), POSITIVES)]


def _window(low: int, high: int):
    def pick(part: pd.DataFrame, ids: np.ndarray, labels: np.ndarray, s: np.ndarray) -> list[tuple]:
        out = []
        for anchor, label, wanted, row in zip(part["anchor"], part["label"], part["wanted"], s):
            for p in map(int, wanted):
                # Whole numbers between the two shares of the positive's score.
                inside = (row >= -(-low * p // 100)) & (row <= high * p // 100) & (labels != label)
                out += [(anchor, p, int(ids[k]), int(row[k])) for k in _first(row, inside, NEGATIVES)]
        return out
    return pick


def _best(keys: list[str], k: int):
    by = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return lambda found: found.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= k).drop("place")


def mine(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding",
         every: int = EVERY, low: int = LOW, high: int = HIGH) -> DataFrame:
    """Rows ``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score``, see ``op13``: anchors are rows whose id is divisible by
    ``every``, their positives the POSITIVES best other rows of their label, the negatives
    the NEGATIVES best rows of other labels that score ``low`` to ``high`` percent of the positive.

    Scores are inner products of floor(256 x); higher first, ties by smaller id.  Rows
    with a null id, label, vector or component, or one that is not finite, take no part.
    Of rows that share an id, the least label and vector counts once.  Shorter vectors
    count as if they ended in zeros; empty ones score 0.  Scores must fit 64 bits.  Rows
    without a positive, or a positive without a negative, give no row; so does an empty
    table.  Other columns are not read."""
    rows = as_frame(vectors, id=id_col, label=label_col, vec=vec_col).withColumns(
        {"id": F.col("id").cast("long"), "label": F.col("label").cast("long")}).filter(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull())
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    rows = rows.filter(~odd).groupBy("id").agg(F.min(F.struct("label", "vec")).alias("x")).select("id", "x.label", "x.vec")
    rows = materialize(rows, "vectors")
    dim = max(2, rows.agg(F.max(F.size("vec"))).first()[0] or 0)
    index, model = _index(rows, dim)
    anchors = index.filter(F.col("id") % every == 0).select(
        F.col("id").alias("anchor"), F.floor(F.col("block") / CHUNK).cast("int").alias("chunk"), "label", "vec")
    anchors = materialize(anchors, "anchors")
    # The best POSITIVES are known once the last of them beats the next cell.
    certain = (F.size("best") >= POSITIVES) & (F.array_min(F.transform("best", lambda b: b["score"])) > F.col("bound"))
    positives = _search(anchors, index, model, dim, _pick_positives, _best(["anchor"], POSITIVES), certain, "anchor long, id long, score long")
    wanted = positives.groupBy("anchor").agg(F.array_sort(F.collect_set("score")).alias("wanted"))
    asking = materialize(anchors.join(growing(wanted), "anchor"), "asking")
    # A window is certain if the next cell is below it, or below the last of all its negatives.
    known = F.coalesce(F.col("best"), F.array().cast("array<struct<p:bigint,id:bigint,score:bigint>>"))
    certain = F.forall("wanted", lambda p: (100 * F.col("bound") < low * p) | (p < 0) | (
        (F.size(F.filter(known, lambda b: b["p"] == p)) >= NEGATIVES)
        & (F.array_min(F.transform(F.filter(known, lambda b: b["p"] == p), lambda b: b["score"])) > F.col("bound"))))
    found = _search(asking, index, model, dim, _window(low, high), _best(["anchor", "p"], NEGATIVES), certain,
                    "anchor long, p long, id long, score long")
    place = Window.partitionBy("anchor", "p").orderBy(F.col("score").desc(), "id")
    found = found.withColumn("rank", F.row_number().over(place)).select(
        "anchor", F.col("p").alias("positive_score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    own = positives.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return own.join(growing(found), ["anchor", "positive_score"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


NEGATIVES_SQL = f"""
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM rows AS a JOIN rows AS b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
QUALIFY rank <= {NEGATIVES}"""
