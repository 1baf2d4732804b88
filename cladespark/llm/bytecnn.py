"""Byte-level convolutional network in numpy for document quality.

A document's bytes are cut into overlapping chunks that cover all of it. Learned byte
vectors go through learned filters of eight bytes at every fourth byte; each chunk keeps
each filter's maximum. The mean and the maximum over a document's chunks are combined
into one probability.

It is fitted on a bounded sample of labelled rows (SAMPLE, half of each label where there
are enough, those with the smallest hashes of their ids), on whole texts of at most
MAX_BYTES; of rows that repeat a doc_id it takes the least text. Scores are of whole texts
of any length.

Null text is an empty text; an empty text's features are zero, so its score is the
model's prior. Without both labels in the training rows every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .shared import remainder, sized
from .words import slices

#: Labelled texts that the network is fitted on, at most. Chunk length and step, byte vector, filters, epochs.
SAMPLE, CHUNK, STEP, DEPTH, FILTERS, EPOCHS = 1200, 512, 504, 8, 32, 10
_WIDTH, _STRIDE = 8, 4
#: Bytes of a text that the network is fitted on, at most, so that the sample's size is bounded.
MAX_BYTES = 1 << 16
#: Bytes that are scored at once.
_RUN = 1 << 19


def chunked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks (bytes + 1, 0 as padding) of documents in one buffer, and each chunk's document."""
    size = np.diff(offsets)
    per = np.where(size > 0, np.maximum(1, -(-(size - (CHUNK - STEP)) // STEP)), 0)
    doc = np.repeat(np.arange(len(size)), per)
    k = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    at = offsets[:-1][doc] + k * STEP
    padded = np.concatenate((data.astype(np.int16) + 1, np.zeros(CHUNK, np.int16)))
    place = at[:, None] + np.arange(CHUNK)
    return np.where(place < offsets[1:][doc][:, None], padded[np.minimum(place, len(padded) - 1)], 0), doc


def _responses(x: np.ndarray, p: dict) -> np.ndarray:
    """Filters' values at each place of each chunk: (chunks, places, filters)."""
    v = p["E"][x].reshape(len(x), CHUNK // _STRIDE, _STRIDE * DEPTH)
    half = _STRIDE * DEPTH
    return v[:, :-1] @ p["W"][:half] + v[:, 1:] @ p["W"][half:] + p["b"]


def pooled(x: np.ndarray, doc: np.ndarray, n: int, p: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum and maximum over each document's chunks of the chunks' pooled filters, and its number of chunks."""
    total, top, many = np.zeros((n, FILTERS), np.float32), np.zeros((n, FILTERS), np.float32), np.zeros(n, np.int64)
    if len(x):
        peak = np.concatenate([np.maximum(_responses(x[i : i + 128], p).max(1), 0) for i in range(0, len(x), 128)])
        first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        many[doc[first]] = np.diff(np.concatenate((first, [len(doc)])))
        total[doc[first]] = np.add.reduceat(peak, first, axis=0)
        top[doc[first]] = np.maximum.reduceat(peak, first, axis=0)
    return total, top, many


def _combined(total: np.ndarray, top: np.ndarray, many: np.ndarray) -> np.ndarray:
    return np.hstack([total / np.maximum(many, 1)[:, None], top]).astype(np.float32)


def features(x: np.ndarray, doc: np.ndarray, n: int, p: dict) -> np.ndarray:
    """Mean and maximum over each document's chunks of the chunks' pooled filters: (n, 2 * FILTERS)."""
    return _combined(*pooled(x, doc, n, p))


def long_features(data: np.ndarray, p: dict, limit: int) -> np.ndarray:
    """features() of one text by runs of chunks of about limit bytes, so that memory doesn't grow with the text."""
    step = max(1, limit // STEP) * STEP
    total, top, many = np.zeros((1, FILTERS)), np.zeros((1, FILTERS), np.float32), np.zeros(1, np.int64)
    for lo in range(0, max(1, len(data) - (CHUNK - STEP)), step):
        part = data[lo : lo + step + CHUNK - STEP]
        t, m, k = pooled(*chunked(part, np.array([0, len(part)])), 1, p)
        total, top, many = total + t, np.maximum(top, m), many + k
    return _combined(total, top, many)


def train(texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> dict:
    """Fit by Adam on the logistic loss, a few documents at a time."""
    rng = np.random.default_rng(seed)
    p = {"E": rng.normal(0, 0.5, (257, DEPTH)), "W": rng.normal(0, 0.12, (_WIDTH * DEPTH, FILTERS)), "b": np.zeros(FILTERS), "u": rng.normal(0, 0.1, 2 * FILTERS), "c": np.zeros(1)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    p["E"][0] = 0
    m, s, t = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    order = np.arange(len(texts))
    for _ in range(epochs):
        rng.shuffle(order)
        for lo in range(0, len(order), 16):
            ids = order[lo : lo + 16]
            raw = [np.frombuffer(texts[i], np.uint8) for i in ids]
            x, doc = chunked(np.concatenate(raw) if raw else np.zeros(0, np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))))
            if not len(x):
                continue
            peak, arg = [], []
            for i in range(0, len(x), 128):
                r = _responses(x[i : i + 128], p)
                a = r.argmax(1)
                arg.append(a)
                peak.append(np.take_along_axis(r, a[:, None], 1)[:, 0])
            arg, peak = np.concatenate(arg), np.concatenate(peak)
            on = peak > 0
            pooled = np.where(on, peak, 0)
            n = len(ids)
            many = np.maximum(np.bincount(doc, minlength=n), 1)
            mean = np.zeros((n, FILTERS), np.float32)
            np.add.at(mean, doc, pooled)
            mean /= many[:, None]
            top = np.zeros((n, FILTERS), np.float32)
            np.maximum.at(top, doc, pooled)
            h = np.hstack([mean, top])
            z = h @ p["u"] + p["c"]
            d = (1 / (1 + np.exp(-z)) - y[ids]).astype(np.float32) / n
            g = {"u": h.T @ d + 1e-4 * p["u"], "c": d.sum(keepdims=True)}
            dh = d[:, None] * p["u"]
            dp = np.where(on, dh[doc, :FILTERS] / many[doc][:, None] + np.where(pooled == top[doc], dh[doc, FILTERS:], 0), 0)
            ci, fi = np.nonzero(dp)
            place = arg[ci, fi][:, None] * _STRIDE + np.arange(_WIDTH)
            codes = x[ci[:, None], place]
            win = p["E"][codes].reshape(len(ci), -1)
            w = dp[ci, fi][:, None]
            g["W"], g["b"], g["E"] = np.zeros_like(p["W"]), dp.sum(0), np.zeros_like(p["E"])
            np.add.at(g["W"].T, fi, w * win)
            back = (w * p["W"].T[fi]).reshape(-1, DEPTH)
            np.add.at(g["E"], codes.ravel(), back)
            g["E"][0] = 0
            t += 1
            for k in p:
                m[k] += 0.1 * (g[k] - m[k])
                s[k] += 0.001 * (g[k] ** 2 - s[k])
                p[k] -= (0.004 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return p


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS) -> dict | None:
    """The network, from texts of docs and labels (doc_id, label 0 or 1); None without both labels."""
    known = labels.where("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("label").cast("int")).alias("label")).withColumn("h", F.xxhash64("doc_id"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    half = sample // 2
    edge = {k: float(min(1.0, (1.2 * half + 20) / n)) * 2**64 - 2**63 for k, n in counts.items()}
    some = known.where(F.col("h").cast("double") <= F.when(F.col("label") == 1, F.lit(edge[1])).otherwise(F.lit(edge[0])))
    got = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= MAX_BYTES)
    got = got.join(sized(some), "doc_id").groupBy("doc_id", "label", "h").agg(F.min("text").alias("text")).collect()
    got.sort(key=lambda r: (r["h"], r["text"]))
    keep = [r for k in (0, 1) for r in [x for x in got if x["label"] == k][:half]]
    if len({r["label"] for r in keep}) < 2:
        return None
    return train([r["text"].encode() for r in keep], np.array([r["label"] for r in keep], np.float32), epochs)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = model.value
        for batch in batches:
            z = np.zeros(len(batch))
            if p is not None:
                for s in slices(batch.column("text"), _RUN):
                    f = long_features(s.data, p, _RUN) if len(s.data) > _RUN else features(*chunked(s.data, s.offsets), s.hi - s.lo, p)
                    z[s.lo : s.hi] = f @ p["u"] + p["c"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))))], names=["doc_id", "score"])

    return run


def classify(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, score (0 to 1) and predicted of each row of docs, by a network fitted on train_docs with labels (doc_id, label)."""
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(train_docs, labels, sample, epochs))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(_score(model), f"doc_id {kind}, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all of docs, learned from labelled rows outside the held-out fold."""
    held = remainder("doc_id", 3, 1)
    known = labels.where(~held).select("doc_id", F.col("quality").alias("label"))
    return classify(docs, docs.where(~held), known).select("doc_id", held.alias("held_out"), "score", "predicted")
