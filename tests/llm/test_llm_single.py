"""Operators on single rows, against brute force or an exact round trip."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillpoint.llm import chat_hmm, decontaminate, mixing, quality_mil, queries, token_files, warc_revisit

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, source string"


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    return public.path(token_files.TOKENIZER), Tokenizer.from_file(public.path(token_files.TOKENIZER))


ODD = [(5, "Hello, World! it's 42", "a"), (1, "", "a"), (2, None, None), (9, "é" * 50 + " <|endoftext|> İstanbul ΣΑΣ x\u0085y\x1cz", "b"),
       (3, "tab\tand\x0bvertical\r\nline  <|startoftext|>", "b"), (3, "tab\tand", "a"), (3, "tab\tand", "a"), (None, "no id", None),
       (7, "word " * 30_000, "c"), (8, "x" * 20_000, "c")]


def test_token_files_round_trip(spark, tokenizer):
    path, tok = tokenizer
    docs = spark.createDataFrame(ODD, SCHEMA).withColumn("start", F.lit(1)).withColumn("shard", F.lit("x"))
    got = sorted(token_files.token_table(docs, path).collect(), key=lambda r: r.start)
    want = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    assert len(got) == len(want)
    for g, (i, t, _) in zip(got, want):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_token_files_formats(spark, tokenizer, scratch):
    path, tok = tokenizer
    docs = spark.createDataFrame([(i, f"text number {i}", "s") for i in range(40)], SCHEMA)
    manifest = token_files.write_tokens(docs, f"{scratch}/t", path, dtype="uint32", shards=4)
    rows = manifest.orderBy("shard").collect()
    assert [r.base for r in rows] == [0, *itertools.accumulate(r.tokens for r in rows)][:-1]
    for r in rows:
        flat = np.memmap(f"{scratch}/t/{r['name']}.bin", dtype="<u4", mode="r")
        offsets = np.memmap(f"{scratch}/t/{r['name']}.idx", dtype="<i8", mode="r")
        assert len(flat) == r.tokens == offsets[-1] and len(offsets) == r.docs + 1
    whole = token_files.Encoder(path, pieces=False)
    import pyarrow as pa
    texts = pa.array([t or "" for _, t, _ in ODD], pa.large_string())
    for a, b in zip(whole.encode(texts), token_files.Encoder(path).encode(texts)):
        assert a.tolist() == b.tolist()
    assert token_files.token_table(docs.limit(0), path).collect() == []


def test_token_pieces_compose_before_lower_casing(tokenizer):
    import pyarrow as pa
    path, tok = tokenizer
    marks = ["\u0308", "\u030a", "\u030c", "\u0331", "\u0344", "\u0327\u030c", "\u0591\u0308", "\u0301"]
    texts = [c + m + t for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for m in marks for t in ("", ".x", "E and The", " J")]
    texts += ["THE J\u030can, DON'T.", "The plain TEXT, A=\u0338B", "T\u00fcr H\u00c4\u0308 W\u00e9"]
    ids, counts = token_files.Encoder(path).encode(pa.array(texts, pa.large_string()))
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def brute_hits(docs, items, window=10):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = WORD.findall(low(t))
        n = min(window, len(w))
        for k in range(len(w) - n + 1):
            if n:
                windows[tuple(w[k:k + n])].add(i)
    out = []
    for t in docs:
        w, hit, found = WORD.findall(low(t)), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    found |= windows[tuple(w[k:k + n])]
                    hit.update(range(k, k + n))
        out.append((len(w), len(hit), sorted(str(i) for i in found if i is not None)))
    return out


@pytest.mark.parametrize("block", [100_000, 7])
def test_decontamination_matches_brute_force(spark, block):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("ab cd ef GH ij, kl. mn é9 op".split()) for _ in range(n))
    items = [(1, text(25)), (2, text(12)), (3, "Short Item"), (4, ""), (5, None), (None, text(14)), (2, text(11)), (10, "... !!")]
    docs = [text(rng.randint(0, 60)) for _ in range(30)] + [None, "", "..", "short, ITEM", items[0][1], items[5][1].upper(),
                                                            text(3000) + " " + items[1][1] + text(50), "w" * 9000]
    frame = spark.createDataFrame([(i, t, 3, "k") for i, t in enumerate(docs)], "doc_id long, text string, n_hit long, Hit_Items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got, names = decontaminate.scan(frame, bench, block_windows=block)
    rows = {r["doc_id"]: r for r in got.collect()}
    want = brute_hits(docs, items)
    for i, (n, hit, found) in enumerate(want):
        assert (rows[i][names["n_words"]], rows[i][names["n_hit"]], rows[i][names["hit_items"]]) == (n, hit, found)
        assert rows[i]["Hit_Items"] == "k"
    clean = decontaminate.clean_documents(frame, bench)
    assert clean.columns == frame.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, (_, hit, _) in enumerate(want) if not hit}
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(frame, bench).collect()}
    for i, (n, hit, _) in enumerate(want):
        assert len(WORD.findall(cut[i] or "")) <= n - hit and (hit or cut[i] == docs[i])
    none = decontaminate.scan(frame, bench.limit(0))[0]
    assert none.agg(F.sum(names["n_hit"])).first()[0] == 0
    assert decontaminate.scan(frame.limit(0), bench)[0].collect() == []


def targets(sizes):
    """Share again until no target is above twice its source's size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    capped = {}
    while True:
        pool = 1.5 * sum(sizes.values()) - sum(capped.values())
        free = [s for s in order if s not in capped]
        share = {s: pool * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: 2.0 * sizes[s] for s in free if share[s] >= 2 * sizes[s]}
        if not over:
            return capped | share
        capped |= over


def test_mixing_targets_match_repeated_sharing(spark):
    rng = random.Random(8)
    for k in range(6):
        sizes = {s: rng.choice([0, 1, 5, 40, 1000, 9000]) for s in [None, "a", "é", "b", "c", "Z"][:k + 1]}
        rows = [(s, n) for s, n in sizes.items()]
        got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
        assert {s: round(t, 6) for s, t in got.items()} == {s: round(t, 6) for s, t in targets(sizes).items()}


def test_mix_takes_documents_near_their_targets(spark):
    rows = [(i, "w " * (i % 50), ["a", "b", None, "c"][i % 4]) for i in range(4000)] + [(None, "x y", "a"), (1, None, "b"), (1, None, "b")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("copies", F.lit("mine")).withColumn("rate", F.lit(0))
    planned, names = mixing.plan_mix(docs)
    plan = planned.collect()
    assert len(plan) == len(rows)
    taken, target = collections.Counter(), {}
    for r in plan:
        assert r["copies"] == "mine" and r[names["copies"]] <= 2
        taken[r["source"]] += r[names["copies"]] * r[names["size"]]
        target[r["source"]] = r[names["target"]]
    assert all(abs(taken[s] - t) < 0.05 * t for s, t in target.items())
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    count = collections.Counter((r.doc_id, r.text, r.source) for r in mixed.collect())
    assert count == collections.Counter(x for r in plan for x in [(r["doc_id"], r["text"], r["source"])] * r[names["copies"]])
    assert mixing.mix(docs.limit(0)).collect() == []


def test_mixing_plan_has_no_python(spark):
    plan = queries.op7_mixing(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_quality_gradients_match_differences():
    rng = np.random.default_rng(0)
    model = {"W": rng.normal(0, 1, (quality_mil.FEATURES, 4)), "b": rng.normal(0, 1, 4), "U": rng.normal(0, 1, (4, 3)),
             "V": rng.normal(0, 1, (4, 3)), "w": rng.normal(0, 1, 3), "c": rng.normal(0, 1, 4), "d": rng.normal(0, 1, 1)}
    f, first = rng.random((7, quality_mil.FEATURES)), np.array([0, 3, 4, 7])
    label, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        s = quality_mil.forward(model, f, first)["score"]
        return -(weight * (label * np.log(s) + (1 - label) * np.log(1 - s))).sum() / weight.sum()
    for k, g in quality_mil._gradients(model, f, first, label, weight).items():
        at = tuple(0 for _ in g.shape)
        keep = model[k][at]
        model[k][at] = keep + 1e-5
        up = loss()
        model[k][at] = keep - 1e-5
        down = loss()
        model[k][at] = keep
        assert abs((up - down) / 2e-5 - g[at]) < 1e-5, k


def test_quality_learns_and_scores_whole_texts(spark):
    rows = queries.op5_quality(spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.95 * len(held)


def test_quality_is_fitted_on_all_passages(spark, monkeypatch):
    held = quality_mil.held_out("id")
    ids = [r.id for r in spark.range(60).filter(~held).collect()]
    docs = spark.createDataFrame([(i, "ab " * (400 * k), "s") for k, i in enumerate(ids)], SCHEMA)
    bags = []
    monkeypatch.setattr(quality_mil, "train", lambda found, labels: bags.extend(found))
    quality_mil.fit(docs, spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, quality int"))
    assert sorted(map(len, bags)) == [max(1, -(-1200 * k // quality_mil.PASSAGE_BYTES)) for k in range(len(ids))]
    assert max(map(len, bags)) > 32


def test_quality_odd_rows(spark):
    rng = random.Random(6)
    good = lambda n: " ".join(rng.choice(["and", "the", "tion", "eronwh"]) for _ in range(n))
    bad = lambda n: " ".join(rng.choice(["AND!!", "XX%%%", "||"]) for _ in range(n))
    rows = [(i, good(60) if i % 2 else bad(60), "s") for i in range(400)]
    labels = [(i, i % 2) for i in range(400)] + [(0, 1), (None, 1), (3, None), (5, 7)]
    more = [(1000, None, "s"), (1001, "", "s"), (None, good(50), "s"), (None, good(50), None), (1002, good(40_000), "s"),
            (1003, good(600) + bad(600), "s"), (1004, bad(40_000), "s")]
    docs = spark.createDataFrame(rows + more, SCHEMA).withColumn("score", F.lit("mine"))
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    scored, name, _ = quality_mil.score(docs, quality_mil.fit(docs, lab))
    got = {r["doc_id"]: r[name] for r in scored.collect()}
    assert len(got) and got[1000] == got[1001] and got[1002] > 0.5 > got[1004]
    kept = quality_mil.keep_good(docs, lab)
    assert kept.columns == docs.columns and {r.score for r in kept.collect()} == {"mine"}
    assert quality_mil.keep_good(docs.limit(0), lab).collect() == []
    # Without labels every text scores one half.
    flat, name, _ = quality_mil.score(docs, quality_mil.fit(docs, lab.limit(0)))
    assert {round(r[name], 6) for r in flat.collect()} == {0.5}


def record(i, url, time, kind, etag=None, modified=None, digest=None, headers=None):
    return (i, url, time, kind, etag, modified, digest, headers)


RECORD = "record_id long, url string, time long, kind string, etag string, last_modified long, digest string, headers map<string,string>"


def test_revisits_of_hand_made_records(spark):
    rows = [
        record(1, "http://a.org/x?b=2&a=1#top", 10, "response", '"e1"', 5, "d1", {"Content-Length": "9", "Date": "1", "X": "1"}),
        record(2, "https://WWW.a.org:443/x/?a=1&b=2&ref=z", 20, "response", 'W/"e2"', 6, "d2", {"Date": "2"}),
        record(10, "http://a.org/x?a=1&b=2", 20, "revisit", '"e1"', None, None, {"date": "9", "content-length": "0"}),
        record(11, "http://a.org/x?a=1&b=2", 21, "revisit", '"e2"', 999, None, None),
        record(12, "http://a.org/x?a=1&b=2", 22, "revisit", None, 5, "d2", {}),
        record(13, "http://a.org/x?a=1&b=2", 22, "revisit", None, None, "d2", {}),
        record(14, "http://a.org/x?a=1&b=2", 23, "revisit", None, None, None, {}),
        record(15, "http://a.org/y", 30, "revisit", '"e1"', None, None, {}),
        record(16, None, 30, "revisit", '"e1"', None, None, {}),
        record(17, "http://a.org/x?a=1&b=2", None, "revisit", '"e1"', None, None, {}),
        record(18, "http://a.org/x?a=1&b=2", 10, "revisit", '"e1"', None, None, {}),
        record(19, "http://a.org/x", 1, "other"),
        record(None, "http://a.org/x?a=1&b=2", 50, "revisit", '"e2"', None, None, {}),
    ]
    frame = spark.createDataFrame(rows, RECORD).withColumn("target", F.lit(0)).withColumn("part", F.lit(1))
    got = {r.record_id: r for r in warc_revisit.resolve_revisits(frame).collect()}
    assert {k: (r.target, r.outcome, r.validator) for k, r in got.items() if k} == {
        10: (1, "resolved", "etag"), 11: (2, "resolved", "etag"), 12: (2, "mismatch", "last_modified"), 13: (2, "resolved", "digest"),
        14: (2, "unverified", None), 15: (None, "missing", None), 16: (None, "missing", None), 17: (None, "missing", None), 18: (None, "missing", None)}
    assert got[10].headers == {"content-length": "9", "date": "9", "x": "1"} and got[10].digest == "d1"
    assert got[12].headers is None
    payloads = spark.createDataFrame([(1, "one"), (2, "two")], "target long, payload string")
    assert {r.record_id: r.payload for r in warc_revisit.restore(warc_revisit.resolve_revisits(frame), payloads).collect()}[11] == "two"
    assert warc_revisit.resolve_revisits(frame.limit(0)).collect() == []


def test_latest_earlier_of_a_hot_url(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["hot", "hot", "hot", "b", "c", "d"]), rng.randrange(400), rng.random() < 0.05) for i in range(2000)]
    got = {r.record_id: r.target for r in warc_revisit.latest_earlier(spark.createDataFrame(rows, "record_id long, url string, time long, full boolean")).collect()}
    full = [r for r in rows if r[3]]
    for i, url, time, is_full in rows:
        if not is_full:
            best = max(((t, k) for k, u, t, _ in full if u == url and t < time), default=(None, None))
            assert got[i] == best[1]


def brute_path(obs, m):
    begin, move, emit = m
    best = max(itertools.product(range(chat_hmm.STATES), repeat=len(obs)), key=lambda p: begin[p[0]] + emit[p[0], obs[0]] + sum(
        move[a, b] + emit[b, o] for a, b, o in zip(p[:-1], p[1:], obs[1:])))
    return list(best)


def test_viterbi_in_pieces_matches_enumeration():
    rng = np.random.default_rng(1)
    for _ in range(20):
        model = chat_hmm.Model(rng.random(chat_hmm.STATES) * 9, rng.random((chat_hmm.STATES,) * 2) * 9, rng.random((chat_hmm.STATES, chat_hmm.SYMBOLS)) * 9)
        m = (model.begin, model.move, model.emit)
        obs = rng.integers(0, chat_hmm.SYMBOLS, 5).tolist()
        want = brute_path(obs, m)
        assert chat_hmm.viterbi(obs, m, None, None) == want
        for cuts in ([2], [1, 4], [1, 2, 3, 4]):
            parts = [obs[a:b] for a, b in zip([0, *cuts], [*cuts, 5])]
            around = chat_hmm.borders([chat_hmm.matrix(p, m) for p in parts])
            assert [s for p, (i, o) in zip(parts, around) for s in chat_hmm.viterbi(p, m, i, o)] == want


def test_chat_roles_are_recovered(spark):
    rows = queries.op8_chat_format(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").count()
    held = [r for r in rows if r.held_out and r.recovered]
    assert sum(r.role == r.recovered for r in held) >= 0.95 * len(held)
    text = "".join(r.rendered for r in sorted(rows, key=lambda r: (r.conv_id, r.turn)) if r.conv_id == rows[0].conv_id)
    assert text.startswith(chat_hmm.START) and text.endswith(chat_hmm.END + "\n")
    assert text.count(chat_hmm.START) == text.count(chat_hmm.END)


@pytest.mark.parametrize("name", [1, None, "a"])
def test_chat_counts_do_not_depend_on_partitions(spark, name):
    turns = [(name, k, chat_hmm.ROLES[1 + k % 2], "so\nmore" if k % 3 else "User: why?") for k in range(400)]
    turns += [(None if name else 0, k, "system", "x") for k in range(3)] if not isinstance(name, str) else []
    rows = spark.createDataFrame(turns, f"conv_id {'string' if isinstance(name, str) else 'long'}, turn long, role string, raw string")
    begin, move, last = np.zeros(chat_hmm.STATES), np.zeros((chat_hmm.STATES,) * 2), {}
    for c, _, role, raw in turns:
        for i in range(len(chat_hmm.symbols(raw))):
            state = chat_hmm.ROLES.index(role) * 2 + (i > 0)
            if c in last:
                move[last[c], state] += 1
            else:
                begin[state] += 1
            last[c] = state
    want = chat_hmm.Model(begin, move, np.zeros((chat_hmm.STATES, chat_hmm.SYMBOLS)))
    model = chat_hmm.fit(rows)
    assert np.allclose(model.begin, want.begin) and np.allclose(model.move, want.move)


def test_chat_odd_rows_and_a_long_transcript(spark):
    turns = [(1, k, "user" if k % 2 == 0 else "assistant", ("User: why?" if k % 2 == 0 else "Assistant: because.\nmore") if k % 5 else "so") for k in range(3000)]
    odd = [(None, 0, "user", "Q: hi"), (None, None, "assistant", "A: yo"), (2, 0, None, None), (2, 1, "user", ""), (2, 1, "user", "\n \n"),
           (3, 0, "user", "Human: x"), (3, 0, "user", "Human: x"), (4, 0, "robot", "### Response:\nok " + "long " * 5000)]
    rows = spark.createDataFrame(turns + odd, "conv_id long, turn long, role string, raw string").withColumn("states", F.lit(1))
    model = chat_hmm.fit(rows)
    got = chat_hmm.format_chats(rows, model).collect()
    assert len(got) == len(turns) + len(odd)
    by = collections.defaultdict(list)
    for r in got:
        by[(r.conv_id, r.turn)].append(r)
    # The whole transcript at once, in one piece.
    m = (model.begin, model.move, model.emit)
    want = [chat_hmm.ROLES[s // 2] for s in chat_hmm.viterbi([o for *_, t in turns for o in chat_hmm.symbols(t)], m, None, None)]
    assert [x for k in range(3000) for x in by[(1, k)][0].roles] == want
    assert by[(2, 0)][0].roles is None and by[(2, 0)][0].rendered == ""
    assert len(by[(3, 0)]) == 2 and by[(3, 0)][0] == by[(3, 0)][1]
    assert chat_hmm.format_chats(rows.limit(0), model).collect() == []


def test_digest_of_items(spark):
    rows = queries.op10_decontaminate(spark, SF).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert all((r.items_sha256 == empty) == (r.n_items == 0) and r.contaminated == (r.n_hit > 0) for r in rows)
    assert decontaminate.items_digest(["1", "20"]) == hashlib.sha256(b"1,20").hexdigest()


def test_rows_without_ids_are_mixed_by_their_texts(spark):
    rows = [(None, f"word{i} and more", "a") for i in range(600)] + [(i, "other words", "b") for i in range(600)]
    docs = spark.createDataFrame(rows, SCHEMA)
    planned, names = mixing.plan_mix(docs, weights=(1, 3), budget=1.0)
    taken = planned.groupBy("source").agg(F.sum(F.col(names["copies"]) * F.col(names["size"])).alias("n"), F.min(names["target"]).alias("t"))
    assert all(abs(r.n - r.t) < 0.15 * r.t for r in taken.collect())


def test_repeated_revisits_are_answered_once_each(spark):
    schema = "record_id long, url string, time long, kind string, etag string, last_modified long, digest string, headers map<string,string>, extra int"
    rows = [(1, "http://a.org/", 5, "response", "x", None, "d1", {"A": "1"}, 0), (1, "http://a.org/", 5, "response", "x", None, "d2", {"A": "2"}, 0)]
    rows += [(2, "http://a.org/", 9, "revisit", "x", None, None, None, 1)] * 2 + [(None, "http://a.org/", 9, "revisit", "y", None, None, None, 2)] * 2
    got = warc_revisit.resolve_revisits(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.record_id or 0, r.target, r.outcome, r.digest) for r in got) == [
        (0, 1, "mismatch", None), (0, 1, "mismatch", None), (2, 1, "resolved", "d1"), (2, 1, "resolved", "d1")]


def test_scores_match_plain_loops_whole_and_in_pieces(spark, monkeypatch):
    import math
    rng = random.Random(4)
    texts = ["", "a", "short one", " ".join("".join(rng.choices("abcdefé .!", k=6)) for _ in range(700)), "x" * 5000, "\u4e16" * 3000]
    model = quality_mil.train([quality_mil.passages(quality_mil.pa.array([t], quality_mil.pa.large_string()))[0] for t in texts], np.array([0, 1, 0, 1, 0, 1], np.float32))

    def plain(text):
        raw, size = text.encode(), quality_mil.PASSAGE_BYTES
        encoded = []
        for k in range(max(1, -(-len(raw) // size))):
            count = [0.0] * quality_mil.FEATURES
            for i in range(k * size, min((k + 1) * size, len(raw) - 2)):
                for base, width, code in ((0, quality_mil.SHAPES, lambda c: int(quality_mil.SHAPE[c])), (quality_mil.SHAPES, quality_mil.GRAMS, int)):
                    tri = 0
                    for c, m in zip(raw[i:i + 3], (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)):
                        tri ^= code(c) * m & 0xFFFFFFFF
                    tri ^= tri >> 15
                    tri = tri * 0x2C1B3C6D & 0xFFFFFFFF
                    count[base + (tri >> 24) % width] += 1
            total = max(sum(count) / 2, 1)
            f = [math.sqrt(c / total) for c in count]
            h = [math.tanh(sum(x * w for x, w in zip(f, column)) + b) for column, b in zip(model["W"].T, model["b"])]
            act = lambda m, fn: [fn(sum(x * w for x, w in zip(h, column))) for column in m.T]
            gate, value = act(model["U"], lambda x: 1 / (1 + math.exp(-x))), act(model["V"], math.tanh)
            encoded.append((h, sum(g * v * w for g, v, w in zip(gate, value, model["w"]))))
        weights = [math.exp(e) for _, e in encoded]
        z = [sum(w * h[i] for w, (h, _) in zip(weights, encoded)) / sum(weights) for i in range(quality_mil.HIDDEN)]
        return 1 / (1 + math.exp(-sum(a * b for a, b in zip(z, model["c"])) - model["d"][0])), max(range(len(weights)), key=weights.__getitem__)

    want = {t: plain(t) for t in texts}
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for piece in (quality_mil.PIECE_BYTES, 1024):
        monkeypatch.setattr(quality_mil, "PIECE_BYTES", piece)
        scored, name, best = quality_mil.score(docs, model)
        for r in scored.collect():
            assert abs(r[name] - want[r.text][0]) < 1e-4
            assert r[best] == want[r.text][1] * quality_mil.PASSAGE_BYTES or len(set(r.text)) == 1


def test_benchmark_beyond_one_broadcast_matches_the_broadcast_scan(spark):
    rng = random.Random(6)
    text = lambda n: " ".join(f"w{rng.randint(0, 400)}" for _ in range(n))
    items = [(k, text(rng.choice([3, 9, 10, 40]))) for k in range(80)] + [(None, text(15)), (7, None)]
    planted = [text(20) + " " + items[k][1].upper() + ", " + text(5) for k in range(0, 80, 3)]
    docs = planted + planted[:1] * 200 + [text(rng.randint(0, 60)) for _ in range(100)] + [None, "", items[80][1], " ".join(t for _, t in items if t) * 20]
    frame = spark.createDataFrame([(k % 290, t, 1, "x", "y") for k, t in enumerate(docs)], "doc_id long, text string, key int, spans string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = {}
    for block in (100_000, 50):
        found, names = decontaminate.scan(frame, bench, block_windows=block)
        got = found.select("doc_id", "text", "key", "spans", "items", *names.values()).collect()
        rows[block] = sorted(map(str, got))
        assert sum(r[names["n_hit"]] > 0 for r in got) >= len(planted) + 200
    assert rows[50] == rows[100_000] and len(rows[50]) == len(docs)
