"""Phrase collocations against a brute-force count."""

import collections
import random
import re

import pytest

from tillpoint.llm import collocations

SCHEMA = "doc_id long, text string, lang string"


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(rows, support, share, first):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            w = tuple(x for x in re.split(r"[\x20\x09]+", piece) if x)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, w[i:i + k]] += 1
    frequent = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= support}
    out = collections.defaultdict(list)
    for (lang, w), a in frequent.items():
        if any(o == lang and len(x) > len(w) and w in (x[:2], x[1:]) and 100 * b >= share * a for (o, x), b in frequent.items()):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items()
                  for rank, (s, a, p, left, right) in enumerate(sorted(found)[:first], 1))


def rows(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "Cé", "d(x)", "世界", "\x1f", "w" * 90, "w" * 89 + "x"] + [f"v{i}" for i in range(12)]

    def text(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", " - "]) for _ in range(n))
    out = [(i, text(rng.choice([0, 1, 5, 60])), rng.choice(["en", "de", None, "und", "en"])) for i in range(60)]
    # No stop in a very long piece, hot phrases, repeated rows, nulls and blanks.
    return out + [(100, " ".join(rng.choices(vocabulary[:5], k=3000)), "en"), (101, "in the end " * 400, "de"), (None, None, None), (5, " \t ", "fr"),
                  (7, "x y z", "pt"), (7, "x y z", "pt")]


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"run_words": 50, "step": 97}), (3, {"support": 2, "first": 7, "step": 300})])
def test_collocations_match_brute_force(spark, seed, options):
    data = rows(seed)
    docs = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = collocations.collocations(docs, **options).collect()
    want = brute(data, options.get("support", 10), 50, options.get("first", 2000))
    assert sorted(map(tuple, got)) == want and len(want) > 20


def test_scores_are_exact_beyond_64_bits(spark):
    big = 10 ** 12
    row = spark.createDataFrame([(big, big + 1, big + 3)], "a long, l long, r long")
    assert row.select(collocations._score("a", "l", "r")).first()[0] == 1_000_000 * big * big // ((big + 1) * (big + 3))


def test_collocations_of_odd_tables(spark):
    schema = "n long, body string, tongue string, phrase string, rank int, id int"
    docs = spark.createDataFrame([(1, "Ab cd. " * 10, None, "x", 1, 1), (None, None, "de", None, None, None)], schema)
    got = collocations.collocations(docs, text_col="body", lang_col="tongue").collect()
    assert [tuple(r) for r in got] == [("und", 1, "ab cd", 10, 10, 10, 20, 1_000_000)]
    assert collocations.collocations(docs.limit(0), text_col="body", lang_col="tongue").count() == 0


def test_counts_are_shuffled_without_their_hash(spark):
    """What tells phrases apart in the sort is taken after the shuffle, which holds the counts alone."""
    rows = spark.createDataFrame([(k, k % 7, k % 5, 1) for k in range(100)], "place long, a long, b long, c long")
    found = collocations._frequent(rows, ["a", "b"], 3)
    lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
    below = lines[next(i for i, line in enumerate(lines) if "Exchange" in line):]
    assert len([line for line in lines if "Exchange" in line]) == 1 and "xxhash64" not in "".join(below)
    assert sorted(map(tuple, found.collect())) == sorted((k, k % 7, k % 5, k % 35, 3) for k in range(100) if k % 35 < 30)
