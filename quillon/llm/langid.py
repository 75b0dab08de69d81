"""Operator 3, language identification as multilingual mixture inference.

Each language has a model of hashed byte trigrams of words (with one byte of context on either side).
A document is a mixture: each word was drawn from one of its languages, with the likelihood of its
trigrams. Expectation-maximisation estimates the languages' proportions in each document. The set of
languages is selected by penalised likelihood: sets grow in the order of the proportions under all
languages, each is refitted, and the one with the largest log-likelihood less
``penalty * ln(words)`` for every language beyond the first is taken.

Defined results: a null or empty text, or one without words, has a null language, no languages and 0
words; a null id is kept; repeated rows get equal results; ties go to the language first in the
alphabet. Texts are read whole. Without labelled text, no language is known and all are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.bytetext import U, buffers, fold, mix, slices, words

BUCKETS = 1 << 16
#: The fit uses at most so many documents of each language (those with the smallest hash of doc_id), none longer than MAX_BYTES.
MAX_DOCS, MAX_BYTES = 400, 16384
STEPS, PENALTY = 12, 3.0
_SCHEMA = "doc_id long, language string, languages string, shares array<double>, words long"


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray  # BUCKETS x languages


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of the trigram around each byte, word starts, ends, documents); bytes beside a word count as spaces."""
    folded = fold(data)
    starts, ends, doc = words(folded, offsets)
    inside = np.zeros(len(folded) + 2, np.int64)
    mark = np.zeros(len(folded) + 1, np.int8)
    mark[starts] += 1
    np.add.at(mark, ends, -1)
    inside[1:-1] = np.where(np.cumsum(mark[:-1]) > 0, folded, 32)
    inside[0] = inside[-1] = 32
    left, right = inside[:-2].copy(), inside[2:].copy()
    left[starts], right[ends - 1] = 32, 32
    key = (left << 16) | (inside[1:-1] << 8) | right
    return (mix(key.astype(U)) >> U(48)).astype(np.int64), starts, ends, doc


def fit(texts: list[bytes], languages: list[str]) -> Model:
    names = sorted(set(languages))
    counts = np.zeros((BUCKETS, len(names)))
    for text, language in zip(texts, languages):
        key, starts, ends, _ = trigrams(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        inside = np.zeros(len(key) + 1, np.int64)
        np.add.at(inside, starts, 1)
        np.add.at(inside, ends, -1)
        counts[:, names.index(language)] += np.bincount(key[np.cumsum(inside[:-1]) > 0], minlength=BUCKETS)
    return Model(names, np.log((counts + 0.1) / (counts.sum(axis=0) + 0.1 * BUCKETS)))


def _mixture(like: np.ndarray, at: np.ndarray, which: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each document under the languages ``which`` allows it (documents x languages);
    like: the words' likelihoods, scaled to at most 1; at: the documents' first words."""
    share = which / which.sum(axis=1, keepdims=True)
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    for _ in range(steps):
        r = share[doc] * like
        r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-300)
        share = np.add.reduceat(r, at[:-1], axis=0) / n[:, None]
    total = np.log(np.maximum((share[doc] * like).sum(axis=1), 1e-300))
    return share, np.add.reduceat(total, at[:-1])


def infer(model: Model, data: np.ndarray, offsets: np.ndarray, steps: int = STEPS, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents with words, their numbers of words, their shares; 0 for languages not selected)."""
    key, starts, ends, doc = trigrams(data, offsets)
    k = len(model.languages)
    if not len(starts) or not k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, k))
    sums = np.zeros((len(key) + 1, k))
    np.cumsum(model.logp[key], axis=0, out=sums[1:])
    score = sums[ends] - sums[starts]
    top = score.max(axis=1)
    like = np.exp(np.maximum(score - top[:, None], -700))
    docs, first, n = np.unique(doc, return_index=True, return_counts=True)
    at = np.concatenate([first, [len(doc)]])
    share, value = _mixture(like, at, np.ones((len(docs), k)), steps)
    order = np.argsort(-share, axis=1, kind="stable")
    single = np.add.reduceat(np.log(np.maximum(like, 1e-300)), first, axis=0)
    rows = np.arange(len(docs))
    best = np.zeros((len(docs), k))
    best[rows, order[:, 0]] = 1
    best_value = single[rows, order[:, 0]]
    cost = penalty * np.log(np.maximum(n, 2))
    # The full mixture is at least as likely as any of its subsets: only documents where it could pay are refitted.
    open_ = np.flatnonzero(value + 1e-6 * n - cost > best_value)
    for size in range(2, k + 1):
        if not len(open_):
            break
        which = np.zeros((len(open_), k))
        np.put_along_axis(which, order[open_][:, :size], 1, axis=1)
        picked = np.concatenate([np.arange(a, b) for a, b in zip(at[open_], at[open_ + 1])])
        share, v = _mixture(like[picked], np.concatenate([[0], np.cumsum(n[open_])]), which, steps)
        v -= (size - 1) * cost[open_]
        better = v > best_value[open_]
        best[open_[better]], best_value[open_[better]] = share[better], v[better]
    return docs, n, best


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> Model:
    """Fits on at most ``max_docs`` labelled documents of each language, chosen by the hash of their id."""
    from pyspark.sql import Window

    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")).where(F.col("t").isNotNull() & F.col("l").isNotNull() & (F.octet_length("t") <= max_bytes))
    ids = rows.select("i", "l", F.xxhash64("i").alias("h")).withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h", "i"))).where(F.col("r") <= max_docs).select("i", "l")
    picked = rows.join(F.broadcast(ids), ["i", "l"]).select("t", "l").orderBy("l", "t").toArrow()
    raw, offsets, _ = buffers(picked["t"])
    return fit([raw[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])], picked["l"].to_pylist())


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", steps: int = STEPS, penalty: float = PENALTY) -> DataFrame:
    """(doc_id, language, languages, shares, words) of every row: the main language, the selected set with the largest share first, and their shares."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array(m.languages, object)
        for batch in batches:
            raw, offsets, _ = buffers(batch.column("text"))
            for lo, hi, data, own in slices(raw, offsets, 1 << 19):
                found, n, share = infer(m, data, own, steps, penalty)
                count = np.zeros(hi - lo, np.int64)
                count[found] = n
                order = np.argsort(-share, axis=1, kind="stable")
                language, languages, shares = [None] * (hi - lo), [""] * (hi - lo), [[] for _ in range(hi - lo)]
                size = (share > 0).sum(axis=1)
                for i, d in enumerate(found):
                    o = order[i, : size[i]]
                    language[d], languages[d], shares[d] = names[o[0]], ",".join(names[o]), np.round(share[i, o], 6).tolist()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(language, pa.string()), pa.array(languages, pa.string()), pa.array(shares, pa.list_(pa.float64())), pa.array(count)], ["doc_id", "language", "languages", "shares", "words"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _SCHEMA)
