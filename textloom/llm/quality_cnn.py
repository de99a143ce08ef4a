"""Quality classifier: a byte-level convolutional network in numpy (operator 5).

A text's bytes are read by F learned filters of eight bytes at every fourth byte. A filter is a table with a weight for each
byte value at each of its places, so a convolution is eight table look-ups and sums. Places form chunks of 512 bytes that
overlap by half and cover the whole text; a chunk keeps each filter's largest activation, and the document the mean and the
largest over its chunks. A logistic unit makes one probability of these 2 F numbers.

Training runs on the driver, on at most ``sample`` labelled documents of at most ``most_bytes`` bytes, the first in the order
of a hash of their doc_id: the model's data has a fixed bound, whatever the corpus. Scoring covers every document whole, in
batches inside tasks.

Defined results: null and empty texts are scored as one chunk of zero bytes; labels that are null or without a text are not
learned; several labels of a doc_id that disagree are not learned; without both classes among the labels the score is the
share of label 1, or 0.5 without labels; repeated rows get equal scores; other columns pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import free_names, slices, texts_of

WIDTH, STRIDE = 8, 4
HOP = 64  # places of half a chunk


def _layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts, each followed by zeros up to whole half chunks, and the half chunks of each text."""
    unit = HOP * STRIDE
    halves = np.array([max(2, -(-(len(t) + WIDTH - STRIDE) // unit)) for t in texts], np.int64)
    data = b"".join(t + bytes(n * unit - len(t)) for t, n in zip(texts, halves.tolist())) + bytes(WIDTH)
    return np.frombuffer(data, np.uint8), halves


def _conv(model: dict, raw: np.ndarray, places: int) -> np.ndarray:
    table = model["table"]
    out = np.repeat(model["bias"][None, :], places, axis=0)
    for k in range(WIDTH):
        out += table[k].take(raw[k : k + places * STRIDE : STRIDE], axis=0)
    return out


def _chunks(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First half of every chunk, and the chunks' bounds by text."""
    first = np.r_[0, np.cumsum(halves)]
    is_last = np.zeros(first[-1], bool)
    is_last[first[1:] - 1] = True
    return np.flatnonzero(~is_last), np.r_[0, np.cumsum(halves - 1)]


def features(model: dict, texts: list[bytes]) -> np.ndarray:
    raw, halves = _layout(texts)
    total = int(halves.sum())
    best = np.empty((total, model["bias"].shape[0]), np.float32)
    step = 512  # half chunks at a time, so that activations stay in cache
    for a in range(0, total, step):
        n = min(step, total - a)
        act = _conv(model, raw[a * HOP * STRIDE :], n * HOP)
        best[a : a + n] = act.reshape(n, HOP, -1).max(axis=1)
    chunk, bounds = _chunks(halves)
    pooled = np.maximum(np.maximum(best[chunk], best[chunk + 1]), 0)
    mean = np.add.reduceat(pooled, bounds[:-1], axis=0) / np.diff(bounds)[:, None]
    return np.hstack([mean, np.maximum.reduceat(pooled, bounds[:-1], axis=0)])


def scores(model: dict, texts: list[bytes]) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    if model.get("constant") is not None:
        return np.full(len(texts), model["constant"])
    z = features(model, texts) @ model["weights"] + model["offset"]
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def train(texts: list[bytes], labels: np.ndarray, filters: int = 16, epochs: int = 8, seed: int = 3, rate: float = 0.01) -> dict:
    labels = np.asarray(labels, np.float32)
    if len(labels) == 0 or labels.min() == labels.max():
        return {"constant": float(labels.mean()) if len(labels) else 0.5}
    rng = np.random.default_rng(seed)
    model = {
        "table": rng.normal(0, 0.1, (WIDTH, 256, filters)).astype(np.float32),
        "bias": np.zeros(filters, np.float32),
        "weights": rng.normal(0, 0.1, 2 * filters).astype(np.float32),
        "offset": np.float32(np.log(labels.mean() / (1 - labels.mean()))),
    }
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in model.items()}
    t = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), 32):
            pick = order[a : a + 32]
            raw, halves = _layout([texts[i] for i in pick])
            y = labels[pick]
            total = int(halves.sum())
            act = _conv(model, raw, total * HOP).reshape(total, HOP, filters)
            where = act.argmax(axis=1)
            best = np.take_along_axis(act, where[:, None, :], axis=1)[:, 0, :]
            chunk, bounds = _chunks(halves)
            later = best[chunk + 1] > best[chunk]
            top = np.where(later, best[chunk + 1], best[chunk])
            half = np.where(later, (chunk + 1)[:, None], chunk[:, None])
            pooled = np.maximum(top, 0)
            n = np.diff(bounds)
            mean = np.add.reduceat(pooled, bounds[:-1], axis=0) / n[:, None]
            most = np.maximum.reduceat(pooled, bounds[:-1], axis=0)
            x = np.hstack([mean, most])
            p = 1 / (1 + np.exp(-np.clip(x @ model["weights"] + model["offset"], -30, 30)))
            dz = ((p - y) / len(pick)).astype(np.float32)
            dx = dz[:, None] * model["weights"][None, :]
            owner = np.repeat(np.arange(len(pick)), n)
            dp = dx[owner, :filters] / n[owner][:, None] + dx[owner, filters:] * (pooled == most[owner])
            dp *= top > 0
            place = half * HOP + where[half, np.arange(filters)[None, :]]
            table = np.zeros_like(model["table"])
            f = np.broadcast_to(np.arange(filters), place.shape)
            for k in range(WIDTH):
                flat = raw[place * STRIDE + k].astype(np.int64) * filters + f
                table[k] = np.bincount(flat.ravel(), dp.ravel(), 256 * filters).reshape(256, filters)
            grads = {"table": table, "bias": dp.sum(axis=0), "weights": x.T @ dz + 1e-4 * model["weights"], "offset": dz.sum()}
            t += 1
            for name, g in grads.items():  # Adam
                m, v = moments[name]
                m += 0.1 * (g - m) if np.ndim(m) else 0
                v += 0.001 * (np.square(g) - v) if np.ndim(v) else 0
                if not np.ndim(m):
                    m, v = m + 0.1 * (g - m), v + 0.001 * (g * g - v)
                    moments[name] = [m, v]
                pace = rate * (0.5 if epoch * 2 >= epochs else 1)
                model[name] = (model[name] - pace * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000, most_bytes: int = 1 << 16, **how) -> dict:
    """A model from labelled documents: ``docs`` (doc_id, text) and ``labels`` (doc_id, quality), joined on doc_id."""
    one = (
        labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("q"))
        .groupBy("doc_id").agg(F.min("q").alias("q"), F.max("q").alias("q2")).where("q = q2").select("doc_id", "q")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    chosen = (
        docs.where(F.col("text").isNotNull() & (F.octet_length("text") <= most_bytes)).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(F.broadcast(one), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample).collect()
    )
    return train([r.text.encode() for r in chosen], np.array([r.q for r in chosen]), **how)


def _score(shared, names: list[str], names_out: list[str]):
    def run(batches):
        for batch in batches:
            for part in slices(batch, 4 << 20):
                s = scores(shared.value, texts_of(part.column("text")))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(s, pa.float64())], names=names_out)

    return run


def score_quality(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with ``__qc_score``, the probability of label 1, as last column (with an underscore more for every column of ``docs``
    that is in its way)."""
    schema = T.StructType([*docs.schema.fields, T.StructField(*free_names(docs.columns, "__qc_score"), T.DoubleType())])
    return docs.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model), docs.columns, schema.names), schema)


def remainder(col: Column) -> Column:
    return F.crc32(col.cast("string").cast("binary")) % 5


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False))
    model = fit(docs.where(~held_out), labels.where(~held_out))
    s = F.col("__qc_score")
    return score_quality(docs, model).select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), s.alias("score"), (s >= 0.3).cast("int").alias("predicted"))
