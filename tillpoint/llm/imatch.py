"""Document fingerprints by I-Match with randomised lexicons.

The lexicon is the terms of mid-range inverse document frequency: those that
stand in at least LOW and at most HIGH of the documents.  It cannot hold more
than (distinct terms of an average document) / LOW terms, however many
documents there are, so it is broadcast.  A document keeps its distinct
lexicon terms, sorted; the digest of that list is its classic I-Match hash.
Random subsets of the lexicon give further digests: PER_LEVEL subsets take
each term with probability 2^-b, for each b of LEVELS, so that documents of a few
terms and of many thousands both have subsets that a part of their terms
decides.

Likeness of two fingerprints: of the first PER_LEVEL subsets, sparsest first, in which
either has a term, the share whose digests agree.  A sparse subset holds one
term of the two documents, mostly, so this estimates the Jaccard similarity of their lexicon terms."""

from __future__ import annotations

import bisect
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.llm.common import as_frame, process_store, text_slices
from tillpoint.llm.text import hash_words, mix, odd, split_words

LOW, HIGH = 1 / 2000, 1 / 20
LEVELS = (2, 4, 6, 8, 10, 12)
PER_LEVEL = 12
# Term counts a task holds before it passes them on.
HELD_TERMS = 1 << 20
# Text in a step of a task.
STEP_BYTES = 1 << 20


def count_terms(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (term, docs): each term's hash and the documents it stands in,
    summed up per task before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]

        def rows(t, c):
            return pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(c, pa.int64())], names=["term", "docs"])

        def summed():
            t, back = np.unique(np.concatenate(terms), return_inverse=True)
            c = np.zeros(len(t), np.int64)
            np.add.at(c, back, np.concatenate(counts))
            return t, c

        held = 0
        for batch in batches:
            for _, texts in text_slices(batch.column("text"), STEP_BYTES):
                w = split_words(texts)
                found = [np.unique(h) for h in np.split(hash_words(w), w.docs[1:-1])]
                t, c = np.unique(np.concatenate(found), return_counts=True)
                terms.append(t)
                counts.append(c)
                held += len(t)
                if held > HELD_TERMS:
                    t, c = summed()
                    if 2 * len(t) > HELD_TERMS:
                        yield rows(t, c)
                        t, c = t[:0], c[:0]
                    terms, counts, held = [t], [c], len(t)
        yield rows(*summed())

    counted = as_frame(docs, text=text_col).mapInArrow(run, "term long, docs long")
    return counted.groupBy("term").agg(F.sum("docs").alias("docs"))


def lexicon(docs: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH) -> np.ndarray:
    """The sorted hashes of the terms that stand in ``low`` to ``high`` of all
    rows of ``docs``, and in two at least."""
    n = docs.count()
    least, most = max(2, int(np.ceil(low * n))), int(high * n)
    chosen = count_terms(docs, text_col).filter(F.col("docs").between(least, max(least, most))).select("term")
    return np.sort(np.array([r[0] for r in chosen.collect()], np.int64).view(np.uint64))


def subsets(terms: np.ndarray) -> np.ndarray:
    """For each term, a row of flags: in which randomised lexicons it is,
    sparsest first; the last is the whole lexicon."""
    out = np.ones((len(terms), len(LEVELS) * PER_LEVEL + 1), bool)
    salts = odd(out.shape[1] - 1, 311)
    for s, salt in enumerate(salts):
        bits = LEVELS[::-1][s // PER_LEVEL]
        out[:, s] = mix(terms ^ salt) >> np.uint64(64 - bits) == 0
    return out


def digests(texts: pa.Array, lex: np.ndarray, member: np.ndarray) -> np.ndarray:
    """A row of digests for each text, one for each column of ``member``: 0
    where the text has no term of that lexicon."""
    w = split_words(texts)
    n, words = len(texts), hash_words(w)
    owner = np.repeat(np.arange(n), np.diff(w.docs))
    place = np.minimum(np.searchsorted(lex, words), max(len(lex) - 1, 0))
    inside = lex[place] == words if len(lex) else np.zeros(len(words), bool)
    # A text without a lexicon term is told by all its terms, all in every subset.
    bare = np.bincount(owner[inside], minlength=n)[owner] == 0
    width = member.shape[1]
    out = np.zeros((n, width), np.uint64)
    for keep, every in ((inside, False), (bare, True)):
        # Distinct terms in sorted order, text by text.
        code = words[keep] if every else place[keep].astype(np.uint64)
        order = np.lexsort((code, owner[keep]))
        code, of = code[order], owner[keep][order]
        first = np.ones(len(code), bool)
        first[1:] = (code[1:] != code[:-1]) | (of[1:] != of[:-1])
        code, of = code[first], of[first]
        value = mix(code if every else lex[code.astype(np.int64)]) if len(code) else code
        flags = None if every else member[code.astype(np.int64)]
        for s in range(width):
            mine = np.arange(len(of)) if every else np.flatnonzero(flags[:, s])
            if not len(mine):
                continue
            start = np.searchsorted(of[mine], np.arange(n + 1))
            rank = (np.arange(len(mine)) - start[of[mine]]).astype(np.uint64)
            total = np.concatenate([[np.uint64(0)], np.cumsum(mix(value[mine] + rank * np.uint64(0x9E3779B97F4A7C15)))])
            some = start[1:] > start[:-1]
            out[some, s] = np.maximum(mix(total[start[1:]] - total[start[:-1]])[some], 1 << 40)
    return out


def packed(d: np.ndarray) -> list[bytes]:
    """Fingerprints: 24 bits of each subset's digest, sparsest first, then the
    64 bits of the whole lexicon's; zeros where there is no term."""
    short = (d[:, :-1] >> np.uint64(40)).astype(">u4").view(np.uint8).reshape(len(d), -1, 4)[:, :, 1:].reshape(len(d), -1)
    whole = np.ascontiguousarray(d[:, -1]).astype(">u8").view(np.uint8).reshape(len(d), 8)
    return [row.tobytes() for row in np.concatenate([short, whole], axis=1)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, how alike two arrays of digests are (0 to 1); two texts
    without a word are alike."""
    a, b = a >> np.uint64(40), b >> np.uint64(40)
    some = (a != 0) | (b != 0)
    asked = some & (np.cumsum(some, axis=1) <= PER_LEVEL)
    n = asked.sum(axis=1)
    return np.where(n == 0, 1.0, (asked & (a == b)).sum(axis=1) / np.maximum(n, 1))


def edited(text: str, after: str) -> str:
    """``text`` with its last half replaced by as much of ``after``'s start."""
    half = len(text) // 2
    return text[:len(text) - half] + after[:half]


_OUT = ("doc_id {kind}, n_chars long, sha binary, mark binary, edited_mark binary, near_edited double, near_next double")


def _marks(rows: list, lex: np.ndarray, member: np.ndarray, names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    """Finished rows (doc_id, text, next text)."""
    def coded(texts):
        return digests(pa.array(texts, pa.large_string()), lex, member)

    changed = [edited(t, after) for _, t, after in rows]
    # Each row's next text is the text of the row after it.
    texts = [t for _, t, _ in rows]
    own, edit = coded([*texts, rows[-1][2]]), coded(changed)
    own, follow = own[:-1], own[1:]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], kind), pa.array([len(t) for t in texts], pa.int64()),
         pa.array([hashlib.sha256(t.encode()).digest() for t in changed], pa.binary()),
         pa.array(packed(own), pa.binary()), pa.array(packed(edit), pa.binary()),
         pa.array(likeness(own, edit)), pa.array(likeness(own, follow))], names=names)


def _followed(keyed: DataFrame) -> DataFrame:
    """The rows (doc_id, text), dealt to ranges and sorted.  The first row of
    each range also stands, as ``last``, at the end of the range before, and
    that of the first range at the end of the last.

    The ranges come from the narrow rows of ids and text hashes; one border of
    each comes to the driver."""
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = [F.col("doc_id").asc_nulls_first(), F.col("hash").asc()]
    keyed = keyed.withColumn("hash", F.xxhash64("text"))
    narrow = keyed.select("doc_id", "hash").repartitionByRange(parts, *place).withColumn("part", F.spark_partition_id())
    least = narrow.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("there"), "doc_id", "hash")).alias("least"))
    borders = sorted((r[0][1:] if r[0][1] is not None else (r[0][2],) for r in least.select("least").collect()), key=lambda b: (len(b), b))

    @F.arrow_udf("int")
    def part_of(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        """The range of each row; -1 less that, if the row is its range's first."""
        keys = [(len(b), b) for b in borders]
        out = []
        for i, h in zip(ids.to_pylist(), hashes.to_pylist()):
            key = (1, (h,)) if i is None else (2, (i, h))
            k = bisect.bisect_right(keys, key) - 1
            out.append(-k - 1 if keys[k] == key else k)
        return pa.array(out, pa.int32())

    n = max(len(borders), 1)
    code = F.col("code")
    own = F.struct(F.when(code < 0, -code - 1).otherwise(code).alias("part"), F.lit(False).alias("last"))
    before = F.struct(F.pmod(-code - 2, F.lit(n)).alias("part"), F.lit(True).alias("last"))
    dealt = keyed.withColumn("code", part_of("doc_id", "hash")).withColumn(
        "to", F.explode(F.when(code < 0, F.array(own, before)).otherwise(F.array(own))))
    ranged = dealt.select("doc_id", "text", "hash", "to.part", "to.last").repartitionById(n, "part")
    return ranged.sortWithinPartitions("last", *place).select("doc_id", "text", "last")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 low: float = LOW, high: float = HIGH) -> DataFrame:
    """One row per input row: ``doc_id, n_chars`` (code points), ``mark`` (the
    fingerprint, see ``packed``), and the same of the row's edited text (the
    last half replaced by the start of the next row's): ``sha`` (its SHA-256),
    ``edited_mark``; ``near_edited`` and ``near_next``, the likeness of the
    row's fingerprint to the edited text's and to the next row's.

    Rows are followed in ascending order of id, nulls first; rows of one id by a hash
    of the text; the first row comes after the last.  Null texts count as empty; texts
    without a word have an empty fingerprint, and two of them are alike; equal
    texts have equal fingerprints.  A text without a lexicon term is told by all its
    terms.  Very long texts are handled one by one, whole.  Rows equal in id and text
    have equal results but for near_next and the edited text of the last; they share a
    range, so no table should hold very many of one.  A single row is its own next
    row; an empty table gives an empty result.  Other columns are not read.

    The texts are shuffled once, into ranges of ids."""
    lex = lexicon(docs, text_col, low, high)
    shared, job = docs.sparkSession.sparkContext.broadcast(lex), uuid.uuid4().hex
    keyed = as_frame(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = _OUT.format(kind=keyed.schema["doc_id"].dataType.simpleString())
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = process_store()
        if store.get("imatch", (None,))[0] != job:
            store["imatch"] = (job, subsets(shared.value))
        lex, member = shared.value, store["imatch"][1]
        before, ended, ready, size, id_type = None, False, [], 0, None
        for batch in batches:
            id_type = batch.column("doc_id").type
            ids, last = batch.column("doc_id").to_pylist(), batch.column("last").to_pylist()
            for start, texts in text_slices(batch.column("text"), STEP_BYTES):
                for at, text in enumerate(texts.to_pylist(), start):
                    if ended:
                        continue
                    if before is not None:
                        ready.append((*before, text))
                        size += len(before[1])
                    before, ended = (ids[at], text), last[at]
                    if size > STEP_BYTES:
                        yield _marks(ready, lex, member, names, id_type)
                        ready, size = [], 0
        if ready:
            yield _marks(ready, lex, member, names, id_type)

    return _followed(keyed).mapInArrow(run, schema)
