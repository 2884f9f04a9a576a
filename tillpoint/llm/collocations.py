"""Phrase collocation mining by SETM: relations of phrase occurrences, extended
one word at a time.

The first relation, R1, holds every word occurrence, sorted by piece and position.  It
is written once, in runs of RUN_WORDS words: a row per run and language with the
words as numbers into the run's own word list; 0 ends a piece.  Then, for each length k:

1. group-count: each run counts its distinct phrases of Rk; the counts of all
   runs are summed per phrase.
2. semi-join: phrases that reach the support get a number, and each run
   gets back which of its phrases those are.
3. merge-join: of the occurrences that stay, those at adjacent positions of
   one piece join to an occurrence one word longer.

A phrase is known by the numbers of its two parts one word shorter, so all
keys are exact.  What is shuffled are distinct phrases per run, never single
occurrences; no list of phrases is broadcast."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillpoint.llm.common import as_frame, growing, materialize, text_slices
from tillpoint.llm.text import LOWER, Words, hash_words

SUPPORT = 10
LONGEST = 3
# A candidate goes if a longer one that holds it is at least this share (percent) as frequent.
SHARE = 50
FIRST = 2000
RUN_WORDS = 1 << 21
STEP_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09]] = True
_STOP = np.zeros(256, bool)
_STOP[[*b".,;:!?", *range(0x0A, 0x0E)]] = True


def cut_words(texts: pa.Array) -> tuple[Words, np.ndarray]:
    """The words of all texts, and for each word the piece it is in."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    data, offsets = LOWER[data], offsets - offsets[0]
    stop = _STOP[data]
    inside = ~(stop | _SPACE[data])
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    piece = np.cumsum(stop | edge[:-1])[starts] if len(starts) else np.zeros(0, np.int64)
    return Words(data, starts, ends, np.searchsorted(starts, offsets)), piece


class _Run:
    """The words of one language that a task holds."""

    def __init__(self):
        self.codes, self.words, self.size = [], {}, 0

    def add(self, w: Words, chosen: np.ndarray, piece: np.ndarray, lead: int) -> None:
        """Number the chosen words; the first ``lead`` were counted before."""
        _, first, back = np.unique(hash_words(w)[chosen], return_index=True, return_inverse=True)
        number = np.array([self.words.setdefault(w.of(i), len(self.words) + 1) for i in chosen[first].tolist()], np.int32)
        code = number[back]
        code[:lead] *= -1
        ends = np.flatnonzero(piece[chosen[1:]] != piece[chosen[:-1]]) + 1
        self.codes.append(np.append(np.insert(code, ends, 0), np.int32(0)))
        self.size += len(code)

    def row(self, lang: str, run: int) -> pa.RecordBatch:
        codes = np.concatenate(self.codes)
        counts = np.bincount(codes[codes > 0], minlength=len(self.words) + 1)[1:]
        return pa.RecordBatch.from_arrays(
            [pa.array([lang], pa.string()), pa.array([run], pa.int64()), pa.array([codes.tobytes()], pa.binary()),
             pa.array([list(self.words)], pa.list_(pa.binary())), pa.array([counts], pa.list_(pa.int64()))],
            names=["lang", "run", "codes", "words", "counts"])


def _parts(texts: pa.Array, first: int, step: int) -> Iterator[tuple[Words, np.ndarray, np.ndarray, int]]:
    """(words, their pieces, the row each is in, leading words counted before)
    of texts; a text longer than ``step`` is cut between words, and
    each part begins with the LONGEST - 1 words before it in its piece."""
    if len(texts) > 1 or not len(texts) or len(texts[0].as_buffer()) <= step:
        w, piece = cut_words(texts)
        yield w, piece, first + np.repeat(np.arange(len(texts)), np.diff(w.docs)), 0
        return
    raw, at, carry = texts[0].as_buffer(), 0, []
    raw = np.frombuffer(raw, np.uint8)
    while at < len(raw):
        stop = min(at + step, len(raw))
        while stop < len(raw):
            # After the last space or stop of the part, or of a longer one.
            gap = np.flatnonzero(_SPACE[raw[at:stop]] | _STOP[raw[at:stop]])
            if len(gap):
                stop = at + int(gap[-1]) + 1
                break
            stop = min(stop + step, len(raw))
        part = b" ".join([*carry, raw[at:stop].tobytes()])
        w, piece = cut_words(pa.array([part], pa.large_binary()))
        yield w, piece, np.full(len(piece), first), len(carry)
        ended = np.flatnonzero(_STOP[w.data])
        open_words = np.flatnonzero(w.starts > (ended[-1] if len(ended) else -1))[1 - LONGEST:]
        carry = [w.of(i) for i in open_words.tolist()]
        at = stop


def occurrences(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", run_words: int = RUN_WORDS,
                step: int = STEP_BYTES) -> DataFrame:
    """R1: rows (lang, run, codes, words, counts), see above.  ``codes`` are
    32-bit numbers of words; negative ones repeat words at the end of
    another run's piece that goes on here."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Run] = {}
        number = TaskContext.get().partitionId() << 16

        def passed(lang):
            nonlocal number
            number += 1
            return held.pop(lang).row(lang, number)

        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for start, texts in text_slices(batch.column("text"), step):
                for w, piece, row, lead in _parts(texts, start, step):
                    names, which = np.unique(langs[row].astype(str), return_inverse=True) if len(row) else ([], row)
                    for k, lang in enumerate(names):
                        held.setdefault(str(lang), _Run()).add(w, np.flatnonzero(which == k), piece, lead)
                    while sum(r.size for r in held.values()) > run_words:
                        yield passed(max(held, key=lambda x: held[x].size))
        for lang in list(held):
            yield passed(lang)

    rows = as_frame(docs, lang=lang_col, text=text_col).select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    return rows.mapInArrow(run, "lang string, run long, codes binary, words array<binary>, counts array<long>")


def numbers(codes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place, the run's own number of the phrase of ``length`` words
    that starts there (from 1; 0: none), and whether it counts here."""
    of, whole = np.abs(codes).astype(np.int64), codes != 0
    for _ in range(length - 1):
        whole = whole[:-1] & whole[1:]
        pair = (of[:-1] << 32) | of[1:]
        _, back = np.unique(pair[whole], return_inverse=True)
        of = np.zeros(len(pair), np.int64)
        of[whole] = back + 1
        whole = of > 0
    return of, whole & (codes[length - 1:] > 0)


def _extend(length: int):
    """Runs with their kept phrases of ``length`` words -> rows (place, a, b,
    c): each distinct phrase one word longer, the numbers of its two parts, its count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                codes = np.frombuffer(batch.column("codes")[i].as_buffer(), np.int32)
                kept = batch.column("kept")[i].values
                of, _ = numbers(codes, length)
                ids = np.full(int(of.max()) + 1, -1, np.int64)
                ids[kept.field("code").to_numpy()] = kept.field("id").to_numpy()
                longer, counted = numbers(codes, length + 1)
                a, b = ids[of[:-1]], ids[of[1:]]
                joined = np.flatnonzero((longer > 0) & (a >= 0) & (b >= 0))
                code, first, back = np.unique(longer[joined], return_index=True, return_inverse=True)
                c = np.bincount(back, weights=counted[joined], minlength=len(code)).astype(np.int64)
                run_no = batch.column("run")[i].as_py() << 24
                for at in range(0, len(code), 1 << 17):
                    cut = slice(at, at + (1 << 17))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(run_no + code[cut]), pa.array(a[joined[first[cut]]]), pa.array(b[joined[first[cut]]]), pa.array(c[cut])],
                        names=["place", "a", "b", "c"])
    return run


def _frequent(counts: DataFrame, keys: list[str], support: int) -> DataFrame:
    """Rows (place, *keys, c) of runs -> those of phrases that reach the
    support, with the phrase's number ``id`` (its smallest place) and count ``f``."""
    # Sorted by one number first: it tells most phrases apart.  It is taken after the
    # shuffle: no bytes of it compress.
    by = Window.partitionBy("spread", *keys)
    found = counts.repartition(*keys).withColumn("spread", F.xxhash64(*keys)).withColumn("f", F.sum("c").over(by)).withColumn("id", F.min("place").over(by))
    return found.filter(F.col("f") >= support).select("place", *keys, "id", "f")


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", support: int = SUPPORT,
            run_words: int = RUN_WORDS, step: int = STEP_BYTES) -> tuple[DataFrame, list[DataFrame]]:
    """(rows (lang, n) of word totals, for each length the frequent phrases):
    (id, lang, word, f) for words, (id, a, b, f) for longer ones, ``a`` and ``b`` being the
    numbers of the phrase without its last and without its first word."""
    runs = materialize(occurrences(docs, text_col, lang_col, run_words, step), "runs", "zstd")
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y)
    totals = materialize(runs.groupBy("lang").agg(F.sum(total).alias("n")), "totals")
    words = runs.select("lang", "run", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x"))
    rows = words.select((F.shiftleft("run", 24) + F.col("at") + 1).alias("place"), "lang", F.col("x.words").cast("string").alias("word"),
                        F.col("x.counts").alias("c"))
    keys, found = ["lang", "word"], []
    for length in range(1, LONGEST + 1):
        kept = materialize(_frequent(rows, keys, support), f"kept{length}", "zstd")
        found.append(kept.filter("place = id").select("id", *keys, "f"))
        if length == LONGEST:
            return totals, found
        lists = kept.groupBy(F.shiftright("place", 24).alias("run")).agg(
            F.collect_list(F.struct((F.col("place") % (1 << 24)).cast("int").alias("code"), "id")).alias("kept"))
        rows = runs.select("run", "codes").join(growing(lists), "run").mapInArrow(_extend(length), "place long, a long, b long, c long")
        keys = ["a", "b"]


def _score(a, left, right):
    """floor(1,000,000 a a / (left right)), exactly."""
    a, left, right = (F.col(x).cast("decimal(15,0)") for x in (a, left, right))
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * a * a, left * right)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", support: int = SUPPORT,
                 share: int = SHARE, first: int = FIRST, run_words: int = RUN_WORDS, step: int = STEP_BYTES) -> DataFrame:
    """The ``first`` best phrases of two or three words of each language:
    ``lang, rank, phrase, a, l, r, n, score``.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line breaks, and
    those into words at spaces and tabs.  a: occurrences of the phrase within
    pieces (``support`` at least); l, r: those of its two parts at the cut that
    scores lowest (ties: the shorter first part); score: floor(1,000,000 a a / (l r)); n: words of the language.  A phrase
    goes if a longer one of ``support`` that holds it has ``share`` percent of its occurrences or more.  Ranked by score, a
    (descending) and phrase (ascending by bytes).

    Null texts count as empty, a null language as ``und``.  Very long texts are
    cut between words without losing a phrase.  Each row counts, repeated rows
    too.  Other columns are not read; an empty table gives an empty result.
    Counts must stay under 10^15."""
    totals, (words, two, three) = phrases(docs, text_col, lang_col, support, run_words, step)
    a, b = (words.select(F.col("id").alias(k), *((F.col("lang"),) if k == "a" else ()), F.col("word").alias(f"word_{k}"), F.col("f").alias(f"f_{k}")) for k in "ab")
    two = two.join(growing(a), "a").join(growing(b), "b").select(
        "id", "lang", F.concat_ws(" ", "word_a", "word_b").alias("phrase"), "word_b", "f", "f_a", "f_b")
    two = materialize(two, "two")
    left = two.select(F.col("id").alias("a"), "lang", F.col("phrase").alias("start"), F.col("f").alias("l2"), F.col("f_a").alias("l1"))
    right = two.select(F.col("id").alias("b"), F.col("word_b").alias("end"), F.col("f").alias("r1"), F.col("f_b").alias("r2"))
    three = materialize(three, "three")
    long = three.join(growing(left), "a").join(growing(right), "b").select(
        "lang", F.concat_ws(" ", "start", "end").alias("phrase"), F.col("f").alias("a"), "l1", "r1", "l2", "r2")
    long = long.withColumn("s1", _score("a", "l1", "r1")).withColumn("s2", _score("a", "l2", "r2"))
    early = F.col("s1") <= F.col("s2")
    long = long.select("lang", "phrase", "a", F.when(early, F.col("l1")).otherwise(F.col("l2")).alias("l"),
                       F.when(early, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"))
    inside = three.select(F.explode(F.array("a", "b")).alias("id"), F.col("f").alias("within")).groupBy("id").agg(F.max("within").alias("within"))
    short = two.join(growing(inside), "id", "left").filter(F.col("within").isNull() | (100 * F.col("within") < share * F.col("f"))).select(
        "lang", "phrase", F.col("f").alias("a"), F.col("f_a").alias("l"), F.col("f_b").alias("r"), _score("f", "f_a", "f_b").alias("score"))
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = short.unionByName(long).withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


COLLOCATIONS_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
sentences AS (
  SELECT lang, row_number() OVER () AS p, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM pieces),
words AS (SELECT lang, p, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM sentences),
next AS (
  SELECT lang, word AS w1, lead(word, 1) OVER piece AS w2, lead(word, 2) OVER piece AS w3
  FROM words WINDOW piece AS (PARTITION BY p ORDER BY i)),
grams AS (
  SELECT lang, 1 AS k, w1 AS phrase, count(*) AS f FROM next GROUP BY ALL
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM next WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM next WHERE w3 IS NOT NULL GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE k = 1 GROUP BY lang),
cuts AS (
  SELECT g.lang, g.phrase, g.k, g.f AS a, c, array_to_string(string_split(g.phrase, ' ')[1:c], ' ') AS first,
         array_to_string(string_split(g.phrase, ' ')[c + 1:], ' ') AS rest
  FROM grams AS g, (VALUES (1), (2)) AS cut(c) WHERE g.k >= 2 AND g.f >= {SUPPORT} AND c < g.k),
scored AS (
  SELECT x.lang, x.phrase, x.k, x.a, x.c, l.f AS l, r.f AS r,
         CAST((1000000 * CAST(x.a AS HUGEINT) * x.a) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM cuts AS x JOIN grams AS l ON l.lang = x.lang AND l.phrase = x.first JOIN grams AS r ON r.lang = x.lang AND r.phrase = x.rest),
lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inner_phrases AS (
  SELECT lang, part, max(a) AS within FROM (
    SELECT lang, a, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS part
    FROM lowest WHERE k = 3) GROUP BY lang, part),
kept AS (
  SELECT x.* FROM lowest AS x LEFT JOIN inner_phrases AS p ON p.lang = x.lang AND p.part = x.phrase
  WHERE p.within IS NULL OR 100 * p.within < {SHARE} * x.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY k.score DESC, k.a DESC, k.phrase) AS rank,
       k.phrase, k.a, k.l, k.r, t.n, k.score
FROM kept AS k JOIN totals AS t ON t.lang = k.lang
QUALIFY rank <= {FIRST}"""
