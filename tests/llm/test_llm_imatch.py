"""I-Match fingerprints against a brute-force version."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tillpoint.llm import imatch, queries
from tillpoint.llm.text import hash_words, split_words

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def terms(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return set(WORD.findall(lowered))


def brute(rows, low, high):
    """(edited text, near_edited, near_next) of the rows, in order of id."""
    rows = sorted(rows)
    df = collections.Counter(t for _, text in rows for t in terms(text))
    least, most = max(2, math.ceil(low * len(rows))), int(high * len(rows))
    lex = {t for t, n in df.items() if least <= n <= max(least, most)}
    words = sorted({t for _, text in rows for t in terms(text)})
    hashes = hash_words(split_words(pa.array(words, pa.large_string())))
    flags = dict(zip(words, imatch.subsets(hashes)))

    def subsets(text):
        kept = terms(text)
        mine = kept & lex
        if not mine:
            return [frozenset(kept)] * (len(imatch.LEVELS) * imatch.PER_LEVEL + 1)
        return [frozenset(t for t in mine if flags[t][s]) for s in range(len(imatch.LEVELS) * imatch.PER_LEVEL + 1)]

    def alike(a, b):
        pairs = [(x, y) for x, y in zip(a, b) if x or y][:imatch.PER_LEVEL]
        return sum(x == y for x, y in pairs) / len(pairs) if pairs else 1.0

    out = []
    for i, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        changed = text[:len(text) - half] + after[:half]
        # Words that only the edited text has are in no document, so in no lexicon.
        for t in terms(changed) - flags.keys():
            flags[t] = imatch.subsets(hash_words(split_words(pa.array([t], pa.large_string()))))[0]
        own = subsets(text)
        out.append((doc, changed, alike(own, subsets(changed)), alike(own, subsets(after)), frozenset(own[-1]), tuple(own)))
    return out


def test_fingerprints_match_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdeéü", k=4)) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 20, 200]))) + rng.choice(["", ".", " x", "\n"])) for i in range(120)]
    rows += [(200, rows[4][1]), (201, rows[4][1]), (202, None), (203, ""), (204, "zzz " * 3), (205, "word " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = imatch.fingerprints(docs, low=0.01, high=0.3).orderBy("doc_id").collect()
    want = brute(rows, 0.01, 0.3)
    assert [r.doc_id for r in got] == [w[0] for w in want]
    by_mark = collections.defaultdict(set)
    for r, (doc, changed, near_edited, near_next, _, own), (_, text) in zip(got, want, sorted(rows)):
        assert r.n_chars == len(text or "") and bytes(r.sha) == hashlib.sha256(changed.encode()).digest()
        assert (r.near_edited, r.near_next) == (near_edited, near_next), doc
        by_mark[bytes(r.mark)].add(own)
    assert all(len(s) == 1 for s in by_mark.values()) and len(by_mark) == len({w[5] for w in want})


def test_fingerprints_of_odd_tables(spark):
    schema = "id string, text string, near_next int, role string"
    docs = spark.createDataFrame([(None, None, 1, "x"), (None, None, 1, "x"), ("b", "one two", 2, None), ("b", "one two", 2, None), ("a", "three", 3, "y")], schema)
    got = imatch.fingerprints(docs, id_col="id").orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == [None, None, "a", "b", "b"]
    assert got[0].near_next == 1.0 and got[3].near_next + got[4].near_next == 1.0
    assert got[3].mark == got[4].mark != got[2].mark
    assert imatch.fingerprints(docs.limit(0), id_col="id").count() == 0
    one = imatch.fingerprints(docs.filter("id = 'a'"), id_col="id").collect()
    assert len(one) == 1 and bytes(one[0].sha) == hashlib.sha256(b"thr" + b"th").digest() and one[0].near_next == 1.0


def test_query_tells_edited_texts_from_strangers(spark):
    got = queries.op11_imatch(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id)
    assert got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()
    assert got.near_edited.mean() > got.near_next.mean() + 0.1
    both = got.merge(docs, on="doc_id")
    assert both.groupby("text").fingerprint.nunique().max() == 1
    assert (both.fingerprint.str.len() == both.edited_fingerprint.str.len()).all()
