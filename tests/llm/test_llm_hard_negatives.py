"""Hard negatives against a brute-force search."""

import math
import random

import numpy as np
import pytest

from tillpoint.llm import hard_negatives

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, every, low=30, high=90):
    kept = {}
    for i, label, vec in rows:
        if i is None or label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        kept[i] = min(kept.get(i, (label, vec)), (label, vec))
    q = {i: (label, [math.floor(256 * float(np.float32(x))) for x in vec]) for i, (label, vec) in kept.items()}
    out = []
    for a, (label, x) in q.items():
        if a % every:
            continue
        scored = sorted((-sum(s * t for s, t in zip(x, y)), i, other) for i, (other, y) in q.items() if i != a)
        for s, p, _ in [r for r in scored if r[2] == label][:5]:
            found = [(i, -t) for t, i, other in scored if other != label and low * -s <= 100 * -t <= high * -s][:10]
            out += [(a, p, rank, i, -s, t) for rank, (i, t) in enumerate(found, 1)]
    return sorted(out)


def vectors(seed, n=260, dim=6, spread=0.15):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    rows = [(i, rng.randrange(3), [rng.gauss(c, spread) for c in rng.choice(centres)]) for i in range(n)]
    hot = [1.0] + [0.25] * (dim - 1)
    rows += [(1000 + i, rng.randrange(3), hot) for i in range(n // 2)]
    rows += [(1000, 0, hot), (1001, 1, [0.5] * dim), (1002, None, hot), (None, 1, hot), (1004, 2, None), (1005, 2, []), (1010, 2, [1.0, 2.0]),
             (1006, 1, [math.nan] * dim), (1007, 1, [math.inf] + [0.0] * (dim - 1)), (1008, 1, [None] * dim), (1020, 0, [0.0] * dim)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,budget,block", [(1, 8192, 4096), (2, 40, 32), (3, 7, 10)])
def test_hard_negatives_match_brute_force(spark, monkeypatch, seed, budget, block):
    monkeypatch.setattr(hard_negatives, "BUDGET", budget)
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "CHUNK", 3)
    data = vectors(seed)
    got = hard_negatives.mine(spark.createDataFrame(data, SCHEMA).repartition(3), every=10).collect()
    want = brute(data, 10)
    assert sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got) == want
    assert len(want) > 200


def test_cells_come_in_the_order_of_their_bounds_and_hold():
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.normal(size=(400, 8)))
    words = [hard_negatives.codebook(x[:, :4], 5, 1), hard_negatives.codebook(x[:, 4:], 5, 2)]
    (a, d), (b, e) = (hard_negatives._nearest(h, w) for h, w in zip((x[:, :4], x[:, 4:]), words))
    cell = a * 5 + b
    model = {"words": words, "radius": [np.array([v[c == k].max(initial=0) for k in range(5)]) for v, c in ((d, a), (e, b))],
             "count": np.bincount(cell, minlength=25).tolist()}
    for q in x[:20]:
        order = list(hard_negatives.walk(q, model, 0))
        assert [o[1] for o in order] == sorted((o[1] for o in order), reverse=True)
        assert {o[0] for o in order} == set(cell.tolist())
        for c, bound, _ in order:
            assert (x[cell == c] @ q).max() <= bound


def test_scores_are_exact_for_large_components():
    a = np.floor(256 * np.array([[2.0 ** 20 + 1, -3.0], [1.0, 2.0 ** 21]]))
    want = [[sum(int(s) * int(t) for s, t in zip(x, y)) for y in a] for x in a]
    assert hard_negatives.scores(a, a).tolist() == want


def test_hard_negatives_of_odd_tables(spark):
    schema = "key long, label long, v array<double>, rank int, anchor string, block int"
    docs = spark.createDataFrame([(0, 1, [1.0, 0.0], 1, "x", 1), (1, 1, [1.0, 0.0], 1, "x", 1), (2, 2, [0.5, 3.0], 1, "x", 1), (3, 2, [1.0, 0.0], 1, None, 2)], schema)
    got = hard_negatives.mine(docs, id_col="key", vec_col="v").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2, 65536, 32768)]
    assert hard_negatives.mine(docs.limit(0), id_col="key", vec_col="v").count() == 0
    assert hard_negatives.mine(docs.filter("key = 0"), id_col="key", vec_col="v").count() == 0
