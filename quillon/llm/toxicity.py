"""Operator 5, toxicity: multiple-instance learning with noisy-or.

A document is a bag of sentences (words between . ! ? or line feeds). A sentence's score is the
logistic of a linear model over hashed features of its words: the word, and its first four and five
bytes. The document's probability is the noisy-or of its sentences, 1 - prod(1 - p). Only documents
carry labels; the likelihood's gradient reaches the sentences in proportion to their own scores, so
training itself finds the sentences that make a document toxic. These are then reported.

Defined results: rows with a null id, or without words (null or empty text), are not reported;
repeated rows give repeated results; with labels of fewer than two classes every probability is the
share of toxic labels, and no sentence is located. Texts are read whole, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.bytetext import Hasher, U, buffers, fold, slices, words

BUCKETS = 1 << 20
#: Features of fewer training documents than min_docs() stay at weight 0, so that rare words aren't learned by heart: this
#: many, or a share of the toxic documents if that is less, and two at least.
MIN_DOCS, MIN_SHARE = 12, 0.05
RATE, L1 = 0.5, 3e-4
#: The fit uses at most so many labelled documents (those with the smallest hash of doc_id), none longer than MAX_BYTES,
#: and of a class that has fewer than MIN_CLASS among them so many more that it has these, as far as there are any.
MIN_CLASS = 600
MAX_DOCS, MAX_BYTES, EPOCHS, BATCH = 6000, 16384, 30, 64
THRESHOLD, SENTENCE_THRESHOLD = 0.5, 0.3
_ENDS = np.zeros(256, bool)
_ENDS[[46, 33, 63, 10]] = True


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    prior: float | None = None


@dataclass
class Bags:
    """Sentences of a slice: features by word, the first word of each sentence, its document and its span."""

    features: np.ndarray  # words x 3
    first: np.ndarray  # sentences + 1, in words
    doc: np.ndarray  # of each sentence
    start: np.ndarray
    end: np.ndarray


def bags(data: np.ndarray, offsets: np.ndarray) -> Bags:
    folded = fold(data)
    starts, ends, doc = words(folded, offsets)
    if not len(starts):
        z = np.zeros(0, np.int64)
        return Bags(np.zeros((0, 3), np.int64), np.zeros(1, np.int64), z, z, z)
    h = Hasher(folded)
    kinds = [h.spans(starts, ends) if k is None else h.spans(starts, np.minimum(starts + k, ends)) + U(k) * (ends - starts > k).astype(U) for k in (None, 4, 5)]
    features = np.stack([(x & U(BUCKETS - 1)).astype(np.int64) for x in kinds], axis=1)
    stops = np.concatenate([[0], np.cumsum(_ENDS[data])])
    new = np.ones(len(starts), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (stops[starts[1:]] > stops[ends[:-1]])
    first = np.concatenate([np.flatnonzero(new), [len(starts)]])
    # A word counts once in a sentence, however often it is repeated.
    sentence = np.cumsum(new) - 1
    order = np.lexsort((kinds[0], sentence))
    again = np.zeros(len(starts), bool)
    again[order[1:]] = (kinds[0][order[1:]] == kinds[0][order[:-1]]) & (sentence[order[1:]] == sentence[order[:-1]])
    once = np.concatenate([[0], np.cumsum(~again)])
    return Bags(features[~again], once[first], doc[first[:-1]], starts[first[:-1]], ends[first[1:] - 1])


def _scores(model: Model, b: Bags) -> tuple[np.ndarray, np.ndarray]:
    """(z, softplus(z)) of each sentence."""
    z = model.bias + np.add.reduceat(model.weights[b.features].sum(axis=1), b.first[:-1])
    return z, np.logaddexp(0, z)


def min_docs(toxic: int) -> int:
    return min(MIN_DOCS, max(2, int(np.ceil(MIN_SHARE * toxic))))


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 5, weight: float = 3.0) -> Model:
    """Adagrad on the negative log-likelihood of the noisy-or; toxic documents count ``weight`` times."""
    labels = np.asarray(labels, float)
    model = Model(np.zeros(BUCKETS), -4.0)
    if len(labels) == 0 or labels.min() == labels.max():
        model.prior = float(labels.mean()) if len(labels) else 0.0
        return model
    rng = np.random.default_rng(seed)
    own = [bags(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in texts]
    usable = np.array([i for i, b in enumerate(own) if len(b.doc)])
    docs_with = np.bincount(np.concatenate([np.unique(own[i].features) for i in usable]), minlength=BUCKETS) if len(usable) else np.zeros(BUCKETS, int)
    known = np.flatnonzero(docs_with >= min_docs(int((labels > 0).sum())))
    place = np.zeros(BUCKETS, np.int64)
    place[known] = np.arange(1, len(known) + 1)
    for b in own:
        b.features = place[b.features]
    small = Model(np.zeros(len(known) + 1), model.bias)
    seen, seen_bias = np.full(len(known) + 1, 0.1), 10.0
    for _ in range(epochs):
        order = rng.permutation(usable)
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            features = np.concatenate([own[i].features for i in rows])
            n_words = np.array([len(own[i].features) for i in rows])
            n_sent = np.array([len(own[i].doc) for i in rows])
            shift = np.cumsum(n_words) - n_words
            first = np.concatenate([own[i].first[:-1] + s for i, s in zip(rows, shift)] + [[len(features)]])
            bag = np.repeat(np.arange(len(rows)), n_sent)
            z, soft = _scores(small, Bags(features, first, bag, bag, bag))
            total = np.bincount(bag, soft, len(rows))
            y = labels[rows]
            slope = np.where(y > 0, -weight / np.maximum(np.expm1(np.minimum(total, 50)), 1e-6), 1.0)
            slope = np.clip(slope, -50, 50)
            dz = slope[bag] / (1 + np.exp(-np.clip(z, -40, 40))) / len(rows)
            grad = np.bincount(features.ravel(), np.repeat(np.repeat(dz, np.diff(first)), 3), len(small.weights))
            grad += L1 * np.sign(small.weights)
            grad[0] = 0
            seen += grad * grad
            small.weights -= RATE * grad / np.sqrt(seen)
            g = dz.sum()
            seen_bias += g * g
            small.bias -= RATE * g / np.sqrt(seen_bias)
    model.weights[known], model.bias = small.weights[1:], small.bias
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES, min_class: int = MIN_CLASS) -> Model:
    """Fits on at most ``max_docs`` labelled documents of at most ``max_bytes`` bytes, chosen by the hash of their id, and
    ``min_class`` of each class: where toxic documents are rare, their share of the fit is larger than that of the labels."""
    lab = labels.select(F.col(id_col).alias("__i"), F.col(label_col).cast("double").alias("__y")).where("__i is not null and __y is not null")
    texts = docs.select(F.col(id_col).alias("__i"), F.col(text_col).alias("__t")).where(F.col("__t").isNotNull() & (F.octet_length("__t") <= max_bytes))

    def sample(lab: DataFrame, most: int) -> pa.Table:
        picked = lab.select("__i", "__y", F.xxhash64("__i").alias("__h")).orderBy("__h", "__i").limit(2 * most)
        return texts.join(F.broadcast(picked), "__i").orderBy("__h", "__i").limit(most).select("__i", "__t", "__y").toArrow()

    rows = sample(lab, max_docs)
    parts, known = [rows], set(rows["__i"].to_pylist())
    toxic = int((rows["__y"].to_numpy() > 0).sum())
    for has, where in ((toxic, "__y > 0"), (len(rows) - toxic, "__y <= 0")):
        if has < min_class:
            more = sample(lab.where(where), min_class)
            new = np.array([i not in known for i in more["__i"].to_pylist()], bool)
            parts.append(more.filter(pa.array(new, pa.bool_())))
    rows = pa.concat_tables(parts)
    raw, offsets, _ = buffers(rows["__t"])
    return fit([raw[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])], rows["__y"].to_numpy())


def offending(docs: DataFrame, model: Model, threshold: float = THRESHOLD, sentence_threshold: float = SENTENCE_THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, probability, sentence_no, sentence_score, sentence) of the documents at or above ``threshold``: their
    sentences at or above ``sentence_threshold``, and always the worst one (the first of equals)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            raw, offsets, _ = buffers(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for lo, hi, data, own in slices(raw, offsets):
                b = bags(data, own)
                if not len(b.doc):
                    continue
                if m.prior is not None:
                    continue
                z, soft = _scores(m, b)
                p = 1 - np.exp(-np.bincount(b.doc, soft, hi - lo))
                first = np.flatnonzero(np.concatenate([[True], b.doc[1:] != b.doc[:-1]]))
                best = np.full(hi - lo, -np.inf)
                best[b.doc[first]] = np.maximum.reduceat(z, first)
                top = np.zeros(len(z), bool)
                at = np.flatnonzero(z == best[b.doc])
                top[at[np.concatenate([[True], b.doc[at][1:] != b.doc[at][:-1]])]] = True
                score = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
                hit = np.flatnonzero((p[b.doc] >= threshold) & (top | (score >= sentence_threshold)))
                number = np.arange(len(z)) - np.repeat(first, np.diff(np.concatenate([first, [len(z)]])))
                if len(hit):
                    text = [data[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(b.start[hit], b.end[hit])]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids[lo + b.doc[hit]].astype(np.int64)), "probability": pa.array(p[b.doc[hit]]), "sentence_no": pa.array(number[hit].astype(np.int32)), "sentence_score": pa.array(score[hit]), "sentence": pa.array(text, pa.string())})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    return rows.mapInArrow(run, "doc_id long, probability double, sentence_no int, sentence_score double, sentence string")
