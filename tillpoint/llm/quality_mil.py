"""Quality classifier: attention-based multiple-instance learning.

A text is a bag of passages.  Every passage of PASSAGE_BYTES bytes is encoded
from its hashed character trigrams; a gated attention gives each passage a
weight (softmax over the text's passages), and the weighted passage encoding
is scored:

  h = tanh(f W + b)     e = (tanh(h V) * sigmoid(h U)) w     a = softmax(e)
  score = sigmoid((sum a h) c + d)

Only document labels are given; which passages decide is learned.  The model
is fitted on a bounded sample: at most SAMPLE_PER_CLASS labelled texts of each
class, all passages of each.  Scoring reads every passage of every text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillpoint.llm.common import as_frame, col, free_name, text_slices

PASSAGE_BYTES = 512
# Bytes of text whose passages are held at once (about 40 times as much memory).
PIECE_BYTES = 1 << 20
SAMPLE_PER_CLASS = 1500
THRESHOLD = 0.3
SHAPES, GRAMS = 256, 256
FEATURES = SHAPES + GRAMS
HIDDEN, ATTENTION = 24, 12
EPOCHS, BATCH, RATE = 30, 64, 0.01
SEED = 11

# Character classes: every ASCII sign is its own, letters and digits are not.
SHAPE = np.arange(256, dtype=np.uint32)
SHAPE[97:123], SHAPE[65:91], SHAPE[48:58], SHAPE[128:] = 97, 65, 48, 128


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, first passage of each text and one more); an
    empty text is one empty passage."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    size = np.diff(offsets)
    first = np.concatenate([[0], np.cumsum(np.maximum(1, -(-size // PASSAGE_BYTES)))])
    count = np.zeros((first[-1], FEATURES), np.float32)
    if len(data) > 2:
        owner = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(data)) - offsets[owner]
        inner = np.flatnonzero(place < size[owner] - 2)
        row = (first[owner] + place // PASSAGE_BYTES)[inner] * FEATURES
        for base, width, code in ((0, SHAPES, SHAPE[data]), (SHAPES, GRAMS, data.astype(np.uint32))):
            tri = (code[inner] * np.uint32(0x9E3779B1)) ^ (code[inner + 1] * np.uint32(0x85EBCA77)) ^ (code[inner + 2] * np.uint32(0xC2B2AE3D))
            tri ^= tri >> np.uint32(15)
            tri *= np.uint32(0x2C1B3C6D)
            bucket = (tri >> np.uint32(24)).astype(np.int64) % width
            count += np.bincount(row + base + bucket, minlength=count.size).reshape(count.shape)
    total = np.maximum(count.sum(axis=1, keepdims=True) / 2, 1)
    return np.sqrt(count / total), first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def forward(model: dict, f: np.ndarray, first: np.ndarray) -> dict:
    h = np.tanh(f @ model["W"] + model["b"])
    gate, value = _sigmoid(h @ model["U"]), np.tanh(h @ model["V"])
    e = (gate * value) @ model["w"]
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    e = np.exp(e - np.maximum.reduceat(e, first[:-1])[owner])
    a = e / np.add.reduceat(e, first[:-1])[owner]
    z = np.add.reduceat(a[:, None] * h, first[:-1])
    return {"h": h, "gate": gate, "value": value, "a": a, "z": z, "owner": owner,
            "score": _sigmoid(z @ model["c"] + model["d"][0])}


def score_in_pieces(model: dict, text: pa.Array, piece: int) -> tuple[float, int]:
    """(score, passage of the largest attention) of one text, ``piece`` bytes
    (a multiple of PASSAGE_BYTES) at a time: the softmax is carried as the largest
    value, the sum of weights and the weighted sum of encodings so far."""
    raw = np.frombuffer(text[0].as_buffer(), np.uint8)
    most, total, z, top = -np.inf, 0.0, 0.0, 0
    for at in range(0, max(len(raw), 1), piece):
        # The last trigrams of a piece reach two bytes into the next.
        f, _ = passages(pa.array([raw[at:at + piece + 2].tobytes()], pa.large_binary()))
        f = f[:max(1, -(-min(piece, len(raw) - at) // PASSAGE_BYTES))]
        h = np.tanh(f @ model["W"] + model["b"])
        e = (_sigmoid(h @ model["U"]) * np.tanh(h @ model["V"])) @ model["w"]
        if e.max() > most:
            keep = np.exp(most - e.max())
            most, total, z, top = e.max(), total * keep, z * keep, at // PASSAGE_BYTES + int(np.argmax(e))
        a = np.exp(e - most)
        total, z = total + a.sum(), z + a @ h
    return float(_sigmoid(z / total @ model["c"] + model["d"][0])), top


def _gradients(model: dict, f: np.ndarray, first: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict:
    o = forward(model, f, first)
    dlogit = (o["score"] - label) * weight / weight.sum()
    dz = dlogit[:, None] * model["c"]
    da = (dz[o["owner"]] * o["h"]).sum(axis=1)
    de = o["a"] * (da - np.add.reduceat(o["a"] * da, first[:-1])[o["owner"]])
    dgv = de[:, None] * model["w"]
    dgate, dvalue = dgv * o["value"] * o["gate"] * (1 - o["gate"]), dgv * o["gate"] * (1 - o["value"] ** 2)
    dh = o["a"][:, None] * dz[o["owner"]] + dgate @ model["U"].T + dvalue @ model["V"].T
    dh *= 1 - o["h"] ** 2
    return {"W": f.T @ dh, "b": dh.sum(axis=0), "U": o["h"].T @ dgate, "V": o["h"].T @ dvalue,
            "w": (o["gate"] * o["value"]).T @ de, "c": o["z"].T @ dlogit, "d": np.array([dlogit.sum()])}


def train(bags: list[np.ndarray], labels: np.ndarray) -> dict:
    """Fit by Adam on mini-batches of texts, both classes weighing the same.
    Without both classes, the score is the constant share of label 1 (0.5
    without labels)."""
    rng = np.random.default_rng(SEED)
    model = {"W": rng.normal(0, 1, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN),
             "U": rng.normal(0, 0.3, (HIDDEN, ATTENTION)), "V": rng.normal(0, 0.3, (HIDDEN, ATTENTION)),
             "w": rng.normal(0, 0.3, ATTENTION), "c": rng.normal(0, 0.3, HIDDEN), "d": np.zeros(1)}
    model = {k: v.astype(np.float32) for k, v in model.items()}
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.5
        model["c"][:] = 0
        model["d"][0] = np.log(np.clip(share, 0.01, 0.99) / (1 - np.clip(share, 0.01, 0.99)))
        return model
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            pick = order[at:at + BATCH]
            first = np.concatenate([[0], np.cumsum([len(bags[i]) for i in pick])])
            grads = _gradients(model, np.concatenate([bags[i] for i in pick]).astype(np.float32), first, labels[pick], weight[pick])
            step += 1
            for k, g in grads.items():
                g = g + 1e-4 * model[k]
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                model[k] -= (RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return model


def held_out(id_col: str = "doc_id"):
    """Rows that no label is learned from: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_id: str = "doc_id", label_col: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> dict:
    """Fit on the ``per_class`` labelled ids of each class that come first by
    a hash, with all their passages, which the driver holds at about twice the
    size of their texts.  Labels other than 0 and 1, null ids and ids whose labels differ
    are left out; of repeated ids one text is used."""
    known = as_frame(labels, id=label_id, label=label_col).filter(~held_out("id") & F.col("label").isin(0, 1))
    known = known.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other")
    texts = as_frame(docs, id=id_col, text=text_col)
    known = known.join(texts.select("id").distinct(), "id", "left_semi")
    order = F.xxhash64("id", F.lit(SEED))
    chosen = known.filter("label = 0").orderBy(order, "id").limit(per_class).unionByName(
        known.filter("label = 1").orderBy(order, "id").limit(per_class))
    chosen = chosen.select("id", F.col("label").cast("int").alias("label"))
    # At most 2 * per_class rows.
    sample = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("label").alias("label"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_slices(batch.column("text"), PIECE_BYTES):
                f, first = passages(texts)
                bags = [f[a:b].astype(np.float16).tobytes() for a, b in zip(first[:-1], first[1:])]
                part = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([part.column("place"), part.column("label"), pa.array(bags, pa.binary())],
                                                 names=["place", "label", "bag"])

    coded = sample.select(F.xxhash64("id").alias("place"), "label", "text").mapInArrow(encode, "place long, label int, bag binary")
    rows = sorted(coded.collect(), key=lambda r: r["place"])
    bags = [np.frombuffer(r["bag"], np.float16).reshape(-1, FEATURES) for r in rows]
    return train(bags, np.array([r["label"] for r in rows], dtype=np.float32))


def score(docs: DataFrame, model: dict, text_col: str = "text") -> tuple[DataFrame, str, str]:
    """``docs`` with its score (0 to 1) and the byte offset of the passage
    with the largest attention; also the names these columns got."""
    name, best = free_name(docs, "score"), free_name(docs, "top_passage")
    at = docs.columns.index(text_col)
    labels = [*docs.columns, name, best]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch.column(at), PIECE_BYTES):
                part = batch.slice(start, len(texts))
                if len(texts) == 1 and len(texts[0].as_buffer()) > PIECE_BYTES:
                    value, place = score_in_pieces(shared.value, texts, PIECE_BYTES)
                    values, top = np.array([value]), [place * PASSAGE_BYTES]
                else:
                    f, first = passages(texts)
                    out = forward(shared.value, f, first)
                    values = out["score"].astype(np.float64)
                    top = [int(np.argmax(out["a"][a:b])) * PASSAGE_BYTES for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values), pa.array(top, pa.int64())], names=labels)

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType()), T.StructField(best, T.LongType())])
    return docs.mapInArrow(run, schema), name, best


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, unchanged.

    Null and empty texts are scored as one empty passage; equal texts score
    the same; very long texts are encoded PIECE_BYTES at a time; an empty table gives an empty result."""
    scored, name, _ = score(docs, fit(docs, labels, id_col, text_col), text_col)
    return scored.filter(col(name) >= threshold).select(*[col(c) for c in docs.columns])
