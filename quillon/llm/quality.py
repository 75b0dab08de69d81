"""Operator 8, quality classifier: a byte-level convolutional network in numpy.

Network. A document's UTF-8 bytes are cut in segments of ``STRIDE`` bytes; a chunk is two adjacent
segments, so chunks of ``2 * STRIDE`` bytes overlap by half and together cover the whole document.
Learned filters of WIDTH bytes slide over every byte. A filter's response is max-pooled in a chunk;
the largest, the mean and the smallest chunk response of each filter are then combined by a logistic
layer into the probability that the document is good. Scoring looks bytes up in pairs: the filters
are folded in tables of 65,536 rows, so a position costs WIDTH / 2 row reads.

Defined results: a null text has a null probability and is not kept; an empty text is scored as one
zero segment; there is no limit on length. Repeated rows and ties get equal scores. With labels of
fewer than two classes the probability is the share of good labels (0.5 without labels).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.bytetext import buffers, slices

WIDTH, FILTERS, STRIDE = 4, 16, 128
#: The fit uses at most so many labelled documents (those with the smallest hash of doc_id), none longer than MAX_BYTES.
MAX_DOCS, MAX_BYTES, EPOCHS, BATCH = 3000, 16384, 10, 48


@dataclass
class Model:
    filters: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray  # FILTERS
    head: np.ndarray  # 3 * FILTERS + 1
    prior: float | None = None

    def tables(self) -> tuple[np.ndarray, ...]:
        f = self.filters.astype(np.float32)
        return tuple((f[j][:, None, :] + f[j + 1][None, :, :]).reshape(65536, FILTERS) for j in range(0, WIDTH, 2))


def _layout(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments of each document, with room for WIDTH - 1 zero bytes at its end, and the first segment of each."""
    segments = (lengths + WIDTH - 2) // STRIDE + 1
    return segments, np.concatenate([[0], np.cumsum(segments)])


def _padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.diff(offsets)
    segments, first = _layout(lengths)
    out = np.zeros(int(first[-1]) * STRIDE + WIDTH, np.uint8)
    out[np.arange(len(data)) + np.repeat(first[:-1] * STRIDE - offsets[:-1], lengths)] = data
    return out, first


def _pairs(padded: np.ndarray) -> np.ndarray:
    return padded[:-1].astype(np.int32) * 256 + padded[1:]


def _chunks(segment_max: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Chunk maxima: a segment and the next of the same document (the last one alone)."""
    chunk = segment_max.copy()
    if len(chunk) > 1:
        np.maximum(chunk[:-1], segment_max[1:], out=chunk[:-1])
    last = first[1:] - 1
    chunk[last] = segment_max[last]
    many = first[1:] - first[:-1] > 1
    chunk[last[many]] = np.maximum(segment_max[last[many]], segment_max[last[many] - 1])
    return chunk


def _features(chunk: np.ndarray, first: np.ndarray) -> np.ndarray:
    at = first[:-1]
    mean = np.add.reduceat(chunk, at, axis=0) / np.diff(first)[:, None]
    return np.concatenate([np.maximum.reduceat(chunk, at, axis=0), mean, np.minimum.reduceat(chunk, at, axis=0)], axis=1)


def _segment_max(pairs: np.ndarray, first: np.ndarray, tables: tuple[np.ndarray, ...], bias: np.ndarray, block: int = 64) -> np.ndarray:
    n, last = int(first[-1]), first[1:] - 1
    out = np.empty((n, FILTERS), np.float32)
    for lo in range(0, n, block):
        hi = min(n, lo + block)
        a, b = lo * STRIDE, hi * STRIDE
        x = tables[0].take(pairs[a:b], axis=0)
        for j, t in enumerate(tables[1:], 1):
            x += t.take(pairs[a + 2 * j : b + 2 * j], axis=0)
        x = x.reshape(hi - lo, STRIDE, FILTERS)
        x[last[np.searchsorted(last, lo) : np.searchsorted(last, hi)] - lo, 1 - WIDTH :] = -np.inf  # these would read the next document
        x.max(axis=1, out=out[lo:hi])
    out += bias.astype(np.float32)
    return np.maximum(out, 0, out=out)


def probabilities(model: Model, raw: np.ndarray, offsets: np.ndarray, tables: tuple[np.ndarray, ...] | None = None) -> np.ndarray:
    out = np.zeros(len(offsets) - 1)
    if model.prior is not None:
        return out + model.prior
    tables = tables or model.tables()
    for lo, hi, data, own in slices(raw, offsets):
        padded, first = _padded(data, own)
        chunk = _chunks(_segment_max(_pairs(padded), first, tables, model.bias), first)
        z = _features(chunk, first) @ model.head[:-1] + model.head[-1]
        out[lo:hi] = np.round(1 / (1 + np.exp(-np.clip(z, -40, 40))), 9)  # equal texts get equal values, whatever the batch
    return out


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Adam on the log loss, classes weighted alike; gradients flow only through the positions that won a maximum."""
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels, float)
    f = rng.normal(0, 0.25, (WIDTH, 256, FILTERS))
    model = Model(f, np.zeros(FILTERS), np.zeros(3 * FILTERS + 1))
    if len(labels) == 0 or labels.min() == labels.max():
        model.prior = float(labels.mean()) if len(labels) else 0.5
        return model
    model.head[:-1] = rng.normal(0, 0.1, 3 * FILTERS)
    weight = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    params = [model.filters, model.bias, model.head]
    first_moment, second_moment, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - 0.8 * epoch / epochs)
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            own = np.concatenate([[0], np.cumsum([len(texts[i]) for i in rows])])
            padded, first = _padded(np.frombuffer(b"".join(texts[i] for i in rows), np.uint8), own)
            n = int(first[-1])
            flat, tables = _pairs(padded), model.tables()
            x = tables[0].take(flat[: n * STRIDE], axis=0)
            for j, t in enumerate(tables[1:], 1):
                x += t.take(flat[2 * j : n * STRIDE + 2 * j], axis=0)
            x = x.reshape(n, STRIDE, FILTERS)
            x[first[1:] - 1, 1 - WIDTH :] = -np.inf
            where = x.argmax(axis=1)
            top = np.take_along_axis(x, where[:, None, :], axis=1)[:, 0] + model.bias
            segment = np.maximum(top, 0)
            chunk = _chunks(segment, first)
            features = _features(chunk, first)
            p = 1 / (1 + np.exp(-np.clip(features @ model.head[:-1] + model.head[-1], -40, 40)))
            dz = (p - labels[rows]) * weight[rows] / len(rows)
            grad_head = np.concatenate([features.T @ dz + 1e-4 * model.head[:-1], [dz.sum()]])
            df = dz[:, None] * model.head[:-1]
            doc = np.repeat(np.arange(len(rows)), np.diff(first))
            F3 = FILTERS
            dchunk = (df[:, F3 : 2 * F3] / np.diff(first)[:, None])[doc]
            for part, best in ((0, features[:, :F3]), (2, features[:, 2 * F3 :])):
                hit = chunk == best[doc]
                share = np.add.reduceat(hit, first[:-1], axis=0, dtype=float)
                dchunk += hit * (df[:, part * F3 : (part + 1) * F3] / np.maximum(share, 1))[doc]
            dsegment = np.zeros_like(segment)
            index = np.arange(n)
            partner = np.minimum(index + 1, n - 1)
            last = first[1:] - 1
            partner[last] = np.where(np.diff(first) > 1, last - 1, last)
            own_wins = segment >= segment[partner]
            dsegment += dchunk * own_wins
            np.add.at(dsegment, partner, dchunk * ~own_wins)
            dsegment *= top > 0
            grad_filters = np.zeros_like(model.filters)
            base = (index * STRIDE)[:, None] + where
            k = np.broadcast_to(np.arange(FILTERS), base.shape)
            for j in range(WIDTH):
                grad_filters[j] = np.bincount((padded[base + j].astype(np.int64) * FILTERS + k).ravel(), dsegment.ravel(), 256 * FILTERS).reshape(256, FILTERS)
            step += 1
            for i, g in enumerate((grad_filters, dsegment.sum(axis=0), grad_head)):
                first_moment[i] = 0.9 * first_moment[i] + 0.1 * g
                second_moment[i] = 0.99 * second_moment[i] + 0.01 * g * g
                params[i] -= rate * (first_moment[i] / (1 - 0.9**step)) / (np.sqrt(second_moment[i] / (1 - 0.99**step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> Model:
    """Fits on at most ``max_docs`` labelled documents of at most ``max_bytes`` bytes, chosen by the hash of their id."""
    lab = labels.select(F.col(id_col).alias("__i"), F.col(label_col).cast("double").alias("__y")).where("__i is not null and __y is not null")
    picked = lab.select("__i", "__y", F.xxhash64("__i").alias("__h")).orderBy("__h", "__i").limit(2 * max_docs)
    rows = (
        docs.select(F.col(id_col).alias("__i"), F.col(text_col).alias("__t")).where(F.col("__t").isNotNull() & (F.octet_length("__t") <= max_bytes))
        .join(F.broadcast(picked), "__i").orderBy("__h", "__i").limit(max_docs).select("__t", "__y").toArrow()
    )
    raw, offsets, _ = buffers(rows["__t"])
    return fit([raw[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])], rows["__y"].to_numpy())


def scorer(model: Model):
    """An Arrow UDF from text to probability."""
    cache: list = []

    @F.arrow_udf("double")
    def quality(text: pa.Array) -> pa.Array:
        if not cache:
            cache.append(model.tables())
        raw, offsets, valid = buffers(text)
        return pa.array(probabilities(model, raw, offsets, cache[0]), mask=~valid)

    return quality


def score(docs: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, probability, keep) of every row."""
    p: Column = scorer(model)(F.col(text_col).cast("string"))
    return docs.select(F.col(id_col).alias("doc_id"), p.alias("probability")).select("doc_id", "probability", F.coalesce(F.col("probability") >= threshold, F.lit(False)).alias("keep"))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose probability is at least the threshold."""
    return docs.where(scorer(model)(F.col(text_col).cast("string")) >= threshold)
