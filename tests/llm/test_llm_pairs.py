"""Duplicate finders against brute force: exact, near, suffix and line dedup."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillpoint.llm import block_naming, jaccard_join, line_dedup, suffix_dedup, suffix_sort
from tillpoint.operators import components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema)


def words_text(rng, n):
    return " ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, empty, null and repeated rows, a long text."""
    rng = random.Random(5)
    base = [words_text(rng, rng.randint(3, 150)) for _ in range(25)]
    rows = list(enumerate(base))
    nxt = len(rows)

    def add(text):
        nonlocal nxt
        rows.append((nxt, text))
        nxt += 1
    for k in range(12):
        add(base[k % 3])
    for k in range(30):
        w = base[5 + k % 4].split()
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(len(w))] = "x" + str(rng.randrange(100))
        add(" ".join(w))
    passage = words_text(rng, 120)
    for k in range(6):
        add(words_text(rng, 20) + "\n" + passage + "\n" + words_text(rng, 20))
    add("And " * 300)
    add("é" * 700 + " ünd")
    add(words_text(rng, 9000))
    add(passage.upper())
    for t in ("", "", None, None, "  \n ", "one", "one", "ONE two"):
        add(t)
    rows += [rows[0], rows[30], (None, base[4]), (None, base[4]), (None, None)]
    return rows


def test_exact_duplicates_match_brute_force(spark, corpus):
    got = block_naming.exact_duplicates(frame(spark, corpus), block_bytes=64).collect()
    groups = collections.defaultdict(list)
    for i, t in corpus:
        groups[t or ""].append(i)
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    assert len(got) == len(corpus)
    kept = collections.Counter()
    for r in got:
        ids = groups[sha[r.text_sha256]]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    # Blocks larger than every text give the same answer.
    again = block_naming.exact_duplicates(frame(spark, corpus), block_bytes=1 << 20)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, again.collect())) == sorted(map(key, got))


def test_exact_duplicates_of_empty_table_and_clashing_columns(spark):
    assert block_naming.exact_duplicates(frame(spark, [])).collect() == []
    odd = spark.createDataFrame([(1, "a", 5, "z"), (2, "a", 6, "z")], "doc_id long, text string, uid long, block string")
    assert [(r.doc_id, r.keep_id, r.kept) for r in block_naming.exact_duplicates(odd).orderBy("doc_id").collect()] == [(1, 2, False), (2, 2, True)]


def brute_links(corpus, threshold=0.8):
    sets = []
    for _, t in corpus:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    links, up = [0] * len(sets), list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(sets[a] & sets[b])
        if both and both >= threshold * (len(sets[a]) + len(sets[b]) - both):
            links[a] += 1
            links[b] += 1
            up[root(b)] = root(a)
    return links, [root(i) for i in range(len(sets))]


def test_jaccard_join_matches_brute_force(spark, corpus):
    links, roots = brute_links(corpus)
    size = collections.Counter(roots)
    want = collections.Counter()
    for (i, _), n, r in zip(corpus, links, roots):
        ids = [corpus[k][0] for k in range(len(corpus)) if roots[k] == r and corpus[k][0] is not None]
        want[(i, min(ids, default=None) if size[r] > 1 else i, size[r], n)] += 1
    got = collections.Counter((r.doc_id, r.class_id, r.class_docs, r.n_links) for r in jaccard_join.jaccard_join(frame(spark, corpus)).collect())
    assert got == want


def test_jaccard_join_large_nodes_are_split(spark, monkeypatch):
    """More near copies than a node may hold for brute force, in several blocks."""
    monkeypatch.setattr(jaccard_join, "SMALL", 8)
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    rng = random.Random(9)
    base = words_text(rng, 200).split()
    rows = []
    for i in range(90):
        w = list(base)
        w[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(90 + i, words_text(rng, 60)) for i in range(20)]
    links, roots = brute_links(rows)
    got = {r.doc_id: r for r in jaccard_join.jaccard_join(frame(spark, rows)).collect()}
    assert [got[i].n_links for i in range(110)] == links
    assert len({got[i].class_id for i in range(110)}) == len(set(roots))


def signed(spark, signs):
    rows = [(i, s.astype("<i4").tobytes(), s.astype(np.int8).tobytes()) for i, s in enumerate(signs)]
    return spark.createDataFrame(rows, "num long, sign binary, short binary")


def test_jaccard_filter_keeps_pairs_whose_signatures_agree_less_by_chance(spark):
    """80 of 128 places: of the pairs at 0.8, one in 700,000 agrees in fewer."""
    signs = []
    for p in range(60):
        # Low bytes of different sets never agree.
        a = np.arange(128) * 256 * 512 + 256 * 4 * p
        b = a.copy()
        b[80:] += 257
        signs += [a, b]
    found = {r["id"]: r["root"] for r in jaccard_join.candidate_clusters(signed(spark, signs)).collect()}
    assert all(found.get(2 * p) == found.get(2 * p + 1) == 2 * p for p in range(60))


def test_jaccard_runs_reach_the_declared_recall(spark, monkeypatch):
    """Simulated pairs at 0.8 whose nodes all stay large: every depth counts."""
    rng = np.random.default_rng(3)
    recall, pairs = 0.99, 20_000
    least, first, runs = jaccard_join.plan(0.8, recall)
    alike = rng.binomial(128, 0.8, pairs)
    found = np.zeros(pairs, bool)
    for _ in range(runs):
        nodes = np.ones(pairs, np.int64)
        for _ in range(jaccard_join.MAX_DEPTH):
            nodes = rng.binomial(nodes + rng.binomial(nodes, 0.25), alike / 128)
        found |= nodes > 0
    assert (found & (alike >= least)).mean() >= recall
    # The runs are made: nodes are counted by their run at the first level.
    roots = []
    made = jaccard_join._rooted
    monkeypatch.setattr(jaccard_join, "_rooted", lambda sets, runs: roots.extend(runs) or made(sets, runs))
    jaccard_join.candidate_clusters(signed(spark, [np.arange(128) * 256] * 2), 0.8, recall)
    assert roots == list(range(runs)) and runs > first


def test_jaccard_isolated_pairs_inside_large_nodes(spark, monkeypatch):
    """Pairs at about 0.8 that share half of their places with all others."""
    monkeypatch.setattr(jaccard_join, "SMALL", 8)
    rng = np.random.default_rng(4)
    common, signs = np.arange(128) * 1000, []
    for p in range(150):
        a = np.where(np.arange(128) < 64, common, rng.integers(1, 1 << 30, 128))
        b = np.where((np.arange(128) >= 64) & (rng.random(128) < 0.4), rng.integers(1, 1 << 30, 128), a)
        signs += [a, b]
    found = {r["id"]: r["root"] for r in jaccard_join.candidate_clusters(signed(spark, signs)).collect()}
    assert all(2 * p in found and found[2 * p] == found.get(2 * p + 1) for p in range(150))


def test_keep_one_leaves_one_row_per_class(spark, corpus):
    _, roots = brute_links(corpus)
    docs = frame(spark, corpus).withColumn("key", F.lit(7)).withColumn("drop", F.lit("x"))
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert len(rows) == len(set(roots))
    assert all(r["key"] == 7 and r["drop"] == "x" for r in rows)
    assert jaccard_join.keep_one(frame(spark, [])).collect() == []


def test_keep_one_with_a_weak_key(spark, monkeypatch):
    """Rows whose keys collide are told apart by their ids."""
    monkeypatch.setattr(jaccard_join, "_key", lambda doc_id, text: F.coalesce(F.length(text), F.lit(0)).cast("long") * 0)
    rng = random.Random(12)
    texts = [" ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(30)) for _ in range(20)]
    rows = [(k, texts[k % 20]) for k in range(30)] + [(30, None), (31, ""), (32, texts[0] + " more"), (33, texts[19]), (33, texts[19])]
    kept = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [*range(20), 30, 31]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x
    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    got = {r.id: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_suffix_order_and_common_prefixes():
    rng = random.Random(1)
    for _ in range(300):
        n, k = rng.randint(1, 60), rng.choice([1, 2, 3, 5])
        data = np.array([rng.randint(0, k) for _ in range(n)], np.uint16)
        order = suffix_sort.suffix_order(data, 1000)
        assert order.tolist() == sorted(range(n), key=lambda i: data[i:].tolist())
        for a, b, x in zip(order[:-1], order[1:], suffix_sort.common_prefixes(data, order[:-1], order[1:], 7)):
            same = 0
            while same < 7 and max(a, b) + same < n and data[a + same] == data[b + same]:
                same += 1
            assert same == x


def brute_repeats(corpus, length):
    raw = [(t or "").encode() for _, t in corpus]
    count = collections.Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        cover = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                cover[i] += 1
                cover[i + length if i + length <= len(b) else len(b)] -= 1
        on = np.cumsum(cover)[:-1] > 0
        out.append((len(b), int(on.sum()), int((np.diff(np.concatenate([[0], on.astype(int)])) == 1).sum()),
                    bytes(c for c, x in zip(b, on) if not x)))
    return out


@pytest.mark.parametrize("length,probe,limit", [(60, 20, 4096), (60, 20, 2), (400, 128, 4096)])
def test_suffix_dedup_matches_brute_force(spark, corpus, length, probe, limit):
    want = collections.Counter((i, *r) for (i, _), r in zip(corpus, brute_repeats(corpus, length)))
    got = suffix_dedup.remove_repeats(frame(spark, corpus), length=length, probe=probe, bucket_segments=limit).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == want


def test_suffix_dedup_of_empty_table_and_clashing_columns(spark):
    assert suffix_dedup.remove_repeats(frame(spark, [])).collect() == []
    odd = spark.createDataFrame([(1, "a" * 500, 5), (2, "b", 6)], "doc_id long, text string, bucket long")
    assert {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(odd).collect()} == {1: 500, 2: 0}


def test_long_text_is_cut_in_overlapping_chunks(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 500)
    rng = random.Random(3)
    data = np.frombuffer(words_text(rng, 700).encode(), np.uint8)
    power = suffix_dedup._powers(500 + 60)
    bucket, segment, first, count, moves = suffix_dedup.runs(data, 60, 20, power)
    assert first[0] == 0 and (first[1:] == first[:-1] + count[:-1]).all() and first[-1] + count[-1] == len(data) - 59


@pytest.mark.parametrize("min_words", [None, 1, 10])
def test_line_dedup_matches_brute_force(spark, corpus, monkeypatch, min_words):
    monkeypatch.setattr(line_dedup, "HELD_UNITS", 5)
    options = {} if min_words is None else {"min_words": min_words}
    lines = [(i, (t or "").split("\n")) for i, t in corpus]
    order = sorted(range(len(corpus)), key=lambda k: (corpus[k][0] is None, corpus[k][0] or 0))
    seen, want = {}, collections.Counter()
    for k in order:
        i, mine = lines[k]
        kept, units, removed = [], 0, 0
        for n, line in enumerate(mine):
            norm = tuple(line.encode().lower().split())
            if len(norm) < (min_words or line_dedup.MIN_WORDS):
                kept.append(line)
                continue
            units += 1
            # Rows that agree in id and text are one document.
            if seen.setdefault(norm, (i, corpus[k][1], n)) != (i, corpus[k][1], n):
                removed += 1
            else:
                kept.append(line)
        want[(i, units, removed, "\n".join(kept))] += 1
    got = line_dedup.dedup_lines(frame(spark, corpus), **options).collect()
    assert collections.Counter((r.doc_id, r.units, len(r.removed), r.kept) for r in got) == want
    raw = {(r.doc_id, r.kept): r for r in got}
    for i, t in corpus:
        for r in (r for r in raw.values() if r.doc_id == i):
            for s in r.removed:
                assert b"\n" not in (t or "").encode()[s.lo:s.hi]
    assert line_dedup.dedup_lines(frame(spark, []), **options).collect() == []


def test_line_dedup_stands_colliding_hashes(spark, corpus, monkeypatch):
    rows = [(i, t) for i, t in corpus if i is not None and sum(j == i for j, _ in corpus) == 1]
    found = lambda: sorted(map(tuple, line_dedup.dedup_lines(frame(spark, rows)).collect()))
    want = found()
    monkeypatch.setattr(line_dedup, "text_key", lambda *columns: F.lit(7).cast("long"))
    assert found() == want and any(r[2] for r in want)
