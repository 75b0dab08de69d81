"""Operator 10, n-gram Jaccard join: which documents' sets of word n-grams overlap.

A document's set holds the 44-bit hashes of its word n-grams (see bytetext for words; a document of fewer
words than n has one gram, all its words). The result is exact but for collisions of these hashes, and of the
64-bit ids of whole sets:

1. A sketch counts in how many documents each gram occurs, over the whole corpus, and so gives all
   grams one global order, rare ones first. It has a counter for every few grams, up to MAX_SKETCH
   (a byte each, broadcast); collisions and full counters only make the order worse, never the result.
2. Two sets that reach the threshold share a gram among the first few of that order (prefix filter).
   These prefixes are dealt to tiles by gram. Within a tile, documents are sorted by size, and a
   document only meets the band of sizes that can reach the threshold. A pair meets at many grams and
   is passed on at few: where both have the same marked gram (the least hash among their index grams)
   only there, else where it may meet first, at a gram before which both have different grams.
3. Candidate pairs are grouped in blocks, by the smallest neighbour of their documents, so that a
   group of similar documents shares blocks. Pairs across groups and in small groups, many of them
   false, must first pass a bound from hashed bitmap signatures, whose length follows the set's size:
   of A, at most |A| - bits(A and not B) grams can be in B.
4. Each block receives its sets once (a large group is cut in a grid of blocks), bounds the overlaps
   by bit counts and intersects the sorted sets of the pairs that are left exactly: one set's grams, as
   ranks in the block's vocabulary, are marked and looked up for all its partners together.
5. Groups of near copies grow with the corpus, and their pairs as the square. Where min-hash bands show such a group,
   the grams of most of a sample of it are its centre C. By the triangle inequality A and B make a pair for certain if
   |A ^ C| + |B ^ C| <= (1 - t) / (1 + t) (|A| + |B|): if their slacks sum to 0 or more. Such pairs are counted by
   sorting the slacks, never listed; all others go through steps 2 to 4. Bands, centres and their limits decide only
   which pairs are spared the comparison, never the result.

Documents with equal sets are one set for all of this, so a group of thousands of copies costs one.
``duplicate_classes`` has a row for every document: the class it is in (documents connected by pairs; its smallest id)
and with how many others it makes a pair. A block passes on, of all its pairs, only each set's number of links
and the smallest set that it is connected with, so the pairs of a large group of near copies never leave their task.
``jaccard_pairs`` has the pairs themselves, between the smallest ids of groups of equal sets, and each copy with that id.

Defined results: rows with a null id are in no result; documents without words (null or empty text) are a class
of their own without links; a repeated row is no pair with itself; an id that has several texts is in the class of
each of them, which so become one, and has the links of all; texts of any length are read whole; empty tables give
empty results; columns other than id and text don't count.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.bytetext import Hasher, U, buffers, fold, mix, slices, words
from quillon.llm.scratch import fresh, written

N, THRESHOLD = 2, 0.65
#: Bytes of text for one counter of the frequency sketch, the least and most counters (powers of two), and how many travel in one row.
SKETCH_SHARE, MIN_SKETCH, MAX_SKETCH, SEGMENT = 32, 1 << 16, 1 << 26, 1 << 17
#: At least so many tiles, for parallelism.
MIN_TILES = 32
#: Pairs that share a label from which on a group counts as dense: its sets go to one block anyway.
DENSE = 64
#: Groups of equal sets that hold more than this share of all documents are joined by broadcast; there are at most 1 / share.
HOT_SHARE = 1 / 4096
#: Postings that a tile, documents that a block, and pairs that a block of one group are meant to hold.
TILE_POSTINGS, BLOCK_DOCS, GRID_PAIRS = 1_200_000, 1000, 400_000
#: Min-hash bands of a set and rows of a band; distinct sets of one band that make a centre, the most centres, their sample, and their grams altogether.
BANDS, BAND_ROWS, CENTRE_SETS, MAX_CENTRES, CENTRE_SAMPLE, CENTRE_GRAMS = 4, 3, 64, 1024, 48, 2_000_000
_GRAM_BITS, _LEVEL_BITS, _DOC_BITS = 44, 7, 13
_GRAM = U((1 << _GRAM_BITS) - 1)
_SLICE = 1 << 19


def gram_keys(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, 44-bit gram) of every n-gram of a slice, repeats included."""
    folded = fold(data)
    starts, ends, doc = words(folded, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, U)
    h = Hasher(folded).spans(starts, ends)
    count = np.bincount(doc, minlength=len(offsets) - 1)
    out_doc, out = [], []
    if len(h) >= n:
        g = h[: len(h) - n + 1].copy()
        for j in range(1, n):
            g = mix(g * U(0x9E3779B97F4A7C15) + h[j : len(h) - n + 1 + j])
        whole = doc[: len(g)] == doc[n - 1 :]
        out_doc.append(doc[: len(g)][whole])
        out.append(g[whole])
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        first = np.concatenate([[0], np.cumsum(count)])[short]
        g = h[first].copy()
        for j in range(1, n - 1):
            more = count[short] > j
            g[more] = mix(g[more] * U(0x9E3779B97F4A7C15) + h[first[more] + j])
        out_doc.append(short)
        out.append(mix(g + count[short].astype(U)))
    return np.concatenate(out_doc), np.concatenate(out) & _GRAM


def sets(data: np.ndarray, offsets: np.ndarray, n: int, levels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, gram) without repeats, sorted by document, then by the global order (by gram without levels)."""
    doc, g = gram_keys(data, offsets, n)
    key = doc.astype(U) << U(_GRAM_BITS + _LEVEL_BITS)
    if levels is not None:
        key |= levels[(g & U(len(levels) - 1)).astype(np.int64)].astype(U) << U(_GRAM_BITS)
    key = np.sort(key | g)
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key >> U(_GRAM_BITS + _LEVEL_BITS)).astype(np.int64), key & _GRAM


def _bounds(doc: np.ndarray, docs: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=docs))])


def _set_ids(g: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set (0 for empty sets)."""
    sid = np.zeros(len(at) - 1, U)
    has = np.flatnonzero(np.diff(at) > 0)
    if len(has):
        h = mix(g + U(0x51ED2701))
        sid[has] = mix(np.add.reduceat(h, at[has]) ^ mix(np.bitwise_xor.reduceat(mix(h), at[has])))
    return sid


def band_keys(g: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each set that isn't empty one key for each band: similar sets often share one."""
    first = at[:-1][np.diff(at) > 0]
    h, out = mix(g + U(0x3C6EF372)), np.zeros((len(first), BANDS), U)
    for k in range(BANDS * BAND_ROWS if len(first) else 0):
        low = np.minimum.reduceat(h * U(0x9E3779B97F4A7C15 * (2 * k + 1) & 0xFFFFFFFFFFFFFFFF), first)
        out[:, k // BAND_ROWS] = mix(out[:, k // BAND_ROWS] * U(0x9E3779B97F4A7C15) + low + U(k))
    return out


def slack(size: np.ndarray, away: np.ndarray, threshold: float) -> np.ndarray:
    """16 times what a set's distance from its centre leaves of its share of the distance allowed in a pair, rounded down."""
    return np.floor((1 - threshold) / (1 + threshold) * size * 16 - 1e-6).astype(np.int64) - 16 * away


class Centres:
    """Centres of groups of near copies, by the keys of bands."""

    def __init__(self, keys: np.ndarray, which: np.ndarray, sets: list[np.ndarray]):
        order = np.argsort(keys)
        self.keys, self.which, self.sets = keys[order], which[order], sets

    def nearest(self, g: np.ndarray, at: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(centre from 1 on, slack) of each set; 0, 0 for sets that have none near."""
        size = np.diff(at)
        centre, left = np.zeros(len(size), np.uint16), np.zeros(len(size), np.int64)
        has, keys = np.flatnonzero(size > 0), band_keys(g, at)
        if not len(has) or not len(self.keys):
            return centre, left
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        row, band = np.nonzero(self.keys[place] == keys)
        best: dict[int, tuple[int, int]] = {}
        for d, c in sorted(set(zip(has[row].tolist(), self.which[place[row, band]].tolist()))):
            x, own = self.sets[c], g[at[d] : at[d + 1]]
            i = np.minimum(np.searchsorted(x, own), len(x) - 1)
            best[d] = min(best.get(d, (1 << 60, 0)), (len(own) + len(x) - 2 * int((x[i] == own).sum()), c))
        for d, (away, c) in best.items():
            if away <= 2 * (1 - threshold) / (1 + threshold) * size[d]:
                centre[d], left[d] = c + 1, slack(size[d], away, threshold)
        return centre, left


def find_centres(own: DataFrame, known: DataFrame, n: int, least: int) -> Centres | None:
    """Centres of the largest groups of at least so many distinct sets that share a band."""
    banded = known.groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys")).select("doc_id", F.explode("keys").alias("key"))
    banded = written(banded, "join-bands")
    hot = banded.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") >= least).orderBy(F.desc("c"), "key").limit(MAX_CENTRES)
    hot = written(hot, "join-hot")
    count = {r["key"]: r["c"] for r in hot.collect()}
    if not count:
        return None
    order = Window.partitionBy("key").orderBy(F.xxhash64("doc_id"), "doc_id")
    sample = banded.join(F.broadcast(hot.select("key")), "key").withColumn("i", F.row_number().over(order)).where(F.col("i") <= CENTRE_SAMPLE).select("key", "doc_id")
    sample = written(sample, "join-sample")
    most = CENTRE_GRAMS // len(count)

    def centre(rows: pd.DataFrame) -> pd.DataFrame:
        batch = pa.RecordBatch.from_pydict({"text": pa.array(list(rows["text"]), pa.string())})
        held = [sets(data, offsets, n)[1] for _, _, _, data, offsets in _each([batch])]
        g, c = np.unique(np.concatenate(held), return_counts=True)
        g = g[2 * c > len(rows)]
        return pd.DataFrame({"key": [rows["key"].iloc[0]], "g": [_packed(g)]})[: int(0 < len(g) <= most)]

    got = own.join(F.broadcast(sample), "doc_id").groupBy("key").applyInPandas(centre, "key long, g binary").collect()
    # Bands of one group have about the same centre, and must have one and the same for their pairs to be counted.
    at: dict[int, list[int]] = {}
    kept: list[np.ndarray] = []
    keys, which = [], []
    for key, blob in sorted(got, key=lambda r: (-count[r[0]], r[0])):
        g = _unpacked(bytes(blob))
        met = Counter(k for x in g.tolist() for k in at.get(x, ()))
        c, o = max(met.items(), key=lambda x: (x[1], -x[0]), default=(0, 0))
        if not o or o < 0.6 * (len(g) + len(kept[c]) - o):
            c = len(kept)
            kept.append(g)
            for x in g.tolist():
                at.setdefault(x, []).append(c)
        keys.append(key)
        which.append(c)
    return Centres(np.array(keys, np.int64).view(U), np.array(which, np.int64), kept) if keys else None


def certain_links(rows: pd.DataFrame) -> pd.DataFrame:
    """(u, v, links) of the sets of one centre: with how many documents each makes a pair for certain, and the set of the most slack, which is one of them."""
    left, docs, rep = (rows[x].to_numpy() for x in ("slack", "docs", "rep"))
    order = np.argsort(left, kind="stable")
    left, docs, rep = left[order], docs[order], rep[order]
    after = np.concatenate([np.cumsum(docs[::-1])[::-1], [0]])
    links = after[np.searchsorted(left, -left, side="left")] - np.where(left >= 0, docs, 0)
    has = links > 0
    return pd.DataFrame({"u": rep[has], "v": np.full(int(has.sum()), rep[-1]), "links": links[has].astype(np.int64)})


def _packed(g: np.ndarray) -> bytes:
    return (g & U(0xFFFFFFFF)).astype(np.uint32).tobytes() + (g >> U(32)).astype(np.uint16).tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    n = len(b) // 6
    return np.frombuffer(b, np.uint32, n).astype(U) | (np.frombuffer(b, np.uint16, n, 4 * n).astype(U) << U(32))


def _each(batches: Iterator[pa.RecordBatch], column: str = "text"):
    for batch in batches:
        raw, offsets, valid = buffers(batch.column(column))
        for lo, hi, data, own in slices(raw, offsets, _SLICE):
            yield batch, lo, hi, data, own


def _sparse(counts: np.ndarray) -> bytes:
    """A segment of small counters, most of them 0: gaps between the others and their counts, entropy-coded."""
    at = np.flatnonzero(counts)
    gaps = np.diff(at, prepend=-1) - 1
    far = gaps >= 255
    coder = zlib.compressobj(1, zlib.DEFLATED, 15, 9, zlib.Z_HUFFMAN_ONLY)
    head = np.array([len(at), far.sum()], np.uint32).tobytes()
    body = coder.compress(np.minimum(gaps, 255).astype(np.uint8).tobytes() + gaps[far].astype(np.uint32).tobytes())
    more = zlib.compressobj(1, zlib.DEFLATED, 15, 9, zlib.Z_HUFFMAN_ONLY)
    tail = more.compress((counts[at] - 1).astype(np.uint8).tobytes()) + more.flush()
    body += coder.flush()
    return head + np.uint32(len(body)).tobytes() + body + tail


def _add_sparse(total: np.ndarray, blob: bytes) -> None:
    n, m, size = (int(x) for x in np.frombuffer(blob, np.uint32, 3))
    body = zlib.decompress(blob[12 : 12 + size])
    gaps = np.frombuffer(body, np.uint8, n).astype(np.int64)
    gaps[gaps == 255] = np.frombuffer(body, np.uint32, m, n)
    total[np.cumsum(gaps + 1) - 1] += np.frombuffer(zlib.decompress(blob[12 + size :]), np.uint8).astype(np.int64) + 1


def frequency_levels(docs: DataFrame, n: int, sketch: int) -> np.ndarray:
    """For each counter of the sketch six times the binary logarithm of its count, over all documents; ``sketch`` bytes."""
    segment = min(SEGMENT, sketch)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(sketch, np.uint8), [], 0

        def add() -> None:
            at, times = np.unique(np.concatenate(held), return_counts=True)
            total[at] = np.minimum(255, total[at] + times).astype(np.uint8)

        for _, _, _, data, own in _each(batches):
            _, g = sets(data, own, n)
            held.append((g & U(sketch - 1)).astype(np.uint32))
            size += len(g)
            if size > 1 << 20:
                add()
                held, size = [], 0
        if held:
            add()
        for s in range(sketch // segment):
            part = total[s * segment : (s + 1) * segment]
            if part.any():
                yield pa.RecordBatch.from_pydict({"s": pa.array([s], pa.int32()), "c": pa.array([_sparse(part)], pa.binary())})

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(segment, np.int64)
        for c in rows["c"]:
            _add_sparse(total, c)
        level = np.minimum((1 << _LEVEL_BITS) - 1, (6 * np.log2(1 + total)).astype(np.int64)).astype(np.uint8)
        return pd.DataFrame({"s": [int(rows["s"].iloc[0])], "c": [level.tobytes()]})

    out = np.zeros(sketch, np.uint8)
    for s, c in docs.mapInArrow(count, "s int, c binary").groupBy("s").applyInPandas(merge, "s int, c binary").collect():
        out[s * segment : (s + 1) * segment] = np.frombuffer(c, np.uint8)
    return out


def _prefix(size: np.ndarray, share: float) -> np.ndarray:
    return (size - np.ceil(share * size - 1e-9) + 1).astype(np.int64)


_RECORD = (("sid", U), ("before", np.uint32), ("mark", np.uint32), ("size", np.uint32), ("centre", np.uint16), ("slack", np.int32), ("count", np.uint16))


def _mark_value(tile: np.ndarray, gram: np.ndarray) -> np.ndarray:
    return (mix((tile << U(32)) | gram) >> U(32)).astype(np.uint32)


def _emit(n: int, threshold: float, tiles: int, levels, centres=None):
    """Prefix postings of a partition, one blob for each tile. A blob has a record for every document (set id, size,
    number of grams, the gram that precedes its first one anywhere, the mark, its centre and slack) and then the grams, 31 bits and
    whether an index gram. Tile -1 - x has the set ids, centres and slacks of sets that have a centre."""

    def flush(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        tile, *fields, count, gram = (np.concatenate(x) for x in zip(*held))
        first = np.cumsum(count, dtype=np.int64) - count
        order = np.argsort(tile, kind="stable")
        tile, first, count = tile[order], first[order], count[order]
        fields = [*(x[order] for x in fields), count]
        to = np.cumsum(count, dtype=np.int64)
        gram = gram[np.repeat(first - (to - count), count) + np.arange(len(gram))]
        cut = np.concatenate([[0], np.flatnonzero(tile[1:] != tile[:-1]) + 1, [len(tile)]])
        at = np.concatenate([[0], to])
        blobs = [np.uint32(y - x).tobytes() + b"".join(f[x:y].tobytes() for f in fields) + gram[at[x] : at[y]].tobytes() for x, y in zip(cut[:-1], cut[1:])]
        return pa.RecordBatch.from_pydict({"tile": pa.array([int(tile[x]) for x in cut[:-1]], pa.int32()), "p": pa.array(blobs, pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, held_size = levels.value, [], 0
        for _, _, _, data, own in _each(batches):
            doc, g = sets(data, own, n, table)
            if not len(g):
                continue
            at = _bounds(doc, len(own) - 1)
            sid, size = _set_ids(g, at), np.diff(at)
            centre, left = centres.value.nearest(g, at, threshold) if centres else (np.zeros(len(size), np.uint16), np.zeros(len(size), np.int64))
            near = np.flatnonzero(centre)
            if len(near):
                blob = np.concatenate([sid[near], centre[near].astype(U), left[near].view(U)]).tobytes()
                yield pa.RecordBatch.from_pydict({"tile": pa.array([-1 - int(sid[near[0]] % U(64))], pa.int32()), "p": pa.array([blob], pa.binary())})
            take = np.where(size > 0, _prefix(size, threshold), 0)
            index = np.where(size > 0, _prefix(size, 2 * threshold / (1 + threshold)), 0)
            rank = np.arange(len(g)) - at[doc]
            before = np.zeros(len(g), np.uint32)
            before[1:] = (g[:-1] & U(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)
            before[rank == 0] = 0
            value = _mark_value(g % U(tiles), (g // U(tiles)) & U(0x7FFFFFFF))
            value[rank >= index[doc]] = 0xFFFFFFFF
            mark = np.zeros(len(size), np.uint32)
            has = np.flatnonzero(size > 0)
            mark[has] = np.minimum.reduceat(value, at[has])
            use = np.flatnonzero(rank < take[doc])
            tile = (g[use] % U(tiles)).astype(np.int32)
            order = np.argsort(tile, kind="stable")
            use, tile = use[order], tile[order]
            d = doc[use]
            gram = (((g[use] // U(tiles)) & U(0x7FFFFFFF)) << U(1)).astype(np.uint32) | (rank[use] < index[d]).astype(np.uint32)
            new = np.ones(len(use), bool)
            new[1:] = (tile[1:] != tile[:-1]) | (d[1:] != d[:-1])
            inside = np.arange(len(use)) - np.maximum.accumulate(np.where(new, np.arange(len(use)), 0))
            head = np.flatnonzero(new | (inside % 65535 == 0))
            r = d[head]
            held.append((tile[head], sid[r], before[use[head]], mark[r], size[r].astype(np.uint32), centre[r], left[r].astype(np.int32), np.diff(np.concatenate([head, [len(use)]])).astype(np.uint16), gram))
            held_size += len(use)
            if held_size > 300_000:
                yield flush(held)
                held, held_size = [], 0
        if held:
            yield flush(held)

    return run


def _decoded(blobs) -> tuple[np.ndarray, ...]:
    """(gram, is an index gram, set id, size, predecessor, mark, centre, slack) of every posting. The predecessor is the document's gram before
    in the tile, or for its first the one before anywhere; 0 if there is none. Both kinds differ in their high bits."""
    parts: list[list[np.ndarray]] = [[] for _ in range(8)]
    for b in blobs:
        n, at = int(np.frombuffer(b, np.uint32, 1)[0]), 4
        fields = []
        for _, t in _RECORD:
            fields.append(np.frombuffer(b, t, n, at))
            at += np.dtype(t).itemsize * n
        sid, before, mark, size, centre, left, count = fields
        packed = np.frombuffer(b, np.uint32, -1, at)
        gram = packed >> np.uint32(1)
        previous = np.empty(len(gram), U)
        previous[1:] = gram[:-1].astype(U) | U(1 << 41)
        previous[np.cumsum(count, dtype=np.int64) - count] = np.where(before > 0, before.astype(U) | U(1 << 40), U(0))
        for held, x in zip(parts, (gram, (packed & np.uint32(1)).astype(bool), np.repeat(sid, count), np.repeat(size, count), previous, np.repeat(mark, count), np.repeat(centre, count), np.repeat(left, count))):
            held.append(x)
    return tuple(np.concatenate(x) for x in parts)


def _unique_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _runs(gram: np.ndarray, lo: np.ndarray, centre: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, ...]:
    """(i, start, number, place): posting i is to meet the postings place[start : start + number]. Postings of one gram meet within
    their bands of sizes; those of one centre only where their slacks leave it open, whatever their sizes."""
    every = np.arange(len(gram))
    if not centre.any():
        return every, lo, np.maximum(every - lo, 0), every
    # Few grams have postings with a centre; only these need the rest.
    heads = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    special = np.repeat(np.logical_or.reduceat(centre > 0, heads), np.diff(np.concatenate([heads, [len(gram)]])))
    plain, special = np.flatnonzero(~special & (every > lo)), np.flatnonzero(special)
    i, start, many, place = _centred_runs(gram[special], np.searchsorted(special, lo[special]), centre[special], left[special])
    use = many > 0
    i, start, many = special[i[use]], start[use] + len(every), many[use]
    return np.concatenate([plain, i]), np.concatenate([lo[plain], start]), np.concatenate([(plain - lo[plain]), many]), np.concatenate([every, special[place]])


def _centred_runs(gram: np.ndarray, lo: np.ndarray, centre: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, ...]:
    every = np.arange(len(gram))
    by = np.lexsort((every, centre, gram))
    new = np.ones(len(by), bool)
    new[1:] = (gram[by][1:] != gram[by][:-1]) | (centre[by][1:] != centre[by][:-1])
    part = np.empty(len(by), np.int64)
    part[by] = np.cumsum(new) - 1
    heads = by[new]
    # The parts of a posting's gram are numbered one after another.
    first, last = np.searchsorted(gram[heads], gram, side="left"), np.searchsorted(gram[heads], gram, side="right")
    n = last - first
    i = np.repeat(every, n)
    p = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(i))
    meets = (p != part[i]) | (centre[i] == 0)
    i, p = i[meets], p[meets]
    key, m = part[by] * (len(by) + 1) + by, len(by) + 1
    start = np.searchsorted(key, p * m + lo[i])
    many = np.maximum(np.searchsorted(key, p * m + i) - start, 0)
    # Within a part of one centre, by slack: each posting and those before it that its slack doesn't make up for.
    order = np.lexsort((left, part))
    values, level = np.unique(np.concatenate([left, -left]), return_inverse=True)
    key = part[order] * (len(values) + 1) + level[: len(left)][order]
    head = np.searchsorted(part[order], part[order])
    open_to = np.minimum(np.searchsorted(key, part[order] * (len(values) + 1) + level[len(left) :][order]), every)
    own = centre[order] > 0
    return np.concatenate([i, order[own]]), np.concatenate([start, len(by) + head[own]]), np.concatenate([many, np.maximum(open_to - head, 0)[own]]), np.concatenate([by, order])


def tile_pairs(blobs, tile: int, threshold: float, step: int = 400_000) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs (smaller set id, larger set id) of a tile's postings. Within a gram, documents are sorted by size,
    and each meets the band of shorter ones that can reach the threshold at their index grams. A pair of equal marks counts
    at the marked gram only; of others, a pair whose predecessors are equal has met at these. Pairs that are certain by their
    centre aren't candidates, and aren't looked at."""
    gram, index, sid, size, before, mark, centre, left = _decoded(blobs)
    order = np.lexsort((sid, size, gram))
    gram, sid, size = gram[order], sid[order], size[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (sid[1:] != sid[:-1])
    order = order[new]
    gram, sid, size, index, before, mark, centre, left = gram[new].astype(U), sid[new], size[new].astype(U), index[order], before[order], mark[order], centre[order], left[order]
    marked = _mark_value(U(tile), gram) == mark
    gram <<= U(32)
    lo = np.searchsorted(gram | size, gram | np.ceil(threshold * size - 1e-9).astype(U), side="left")
    one, start, many, place = _runs(gram >> U(32), lo, centre, left)
    ends = np.cumsum(many)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    at = 0
    while at < len(one):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + step, side="right")))
        m = many[at:to]
        if m.sum():
            i = np.repeat(one[at:to], m)
            j = place[np.repeat(start[at:to] - (np.cumsum(m) - m), m) + np.arange(len(i))]
            i, j = np.maximum(i, j), np.minimum(i, j)
            ok = (j >= lo[i]) & index[j] & np.where(mark[i] == mark[j], marked[i], (before[i] != before[j]) | (before[i] == 0)) & (sid[i] != sid[j])
            i, j = i[ok], j[ok]
            if len(i):
                x, y = sid[i], sid[j]
                found.append(_unique_pairs(np.minimum(x, y), np.maximum(x, y)))
        at = to
    if not found:
        return np.zeros(0, U), np.zeros(0, U)
    return _unique_pairs(*(np.concatenate(x) for x in zip(*found)))


def _signature_bits(size: np.ndarray) -> np.ndarray:
    """A power of two between 1.1 and 2.2 times the size, 64 at least."""
    return 1 << np.maximum(6, np.ceil(np.log2(1.1 * np.maximum(size, 1))).astype(np.int64))


def signatures(g: np.ndarray, at: np.ndarray) -> list[bytes]:
    """The hashed bitmap of each set."""
    size = np.diff(at)
    words = _signature_bits(size) >> 6
    first = np.concatenate([[0], np.cumsum(words)])
    flat = np.zeros(int(first[-1]), U)
    doc = np.repeat(np.arange(len(size)), size)
    h = (mix(g) >> U(20)).astype(np.int64) & ((words[doc] << 6) - 1)
    np.bitwise_or.at(flat, first[doc] + (h >> 6), U(1) << (h & 63).astype(U))
    return [flat[x:y].tobytes() for x, y in zip(first[:-1], first[1:])]


def _folded(blobs: list[bytes], words: int) -> np.ndarray:
    """Bitmaps of at least ``words`` words, all of one length, folded to that many: the bitmap they would have had."""
    x = np.frombuffer(b"".join(blobs), U).reshape(len(blobs), -1)
    while x.shape[1] > words:
        half = x.shape[1] // 2
        x = x[:, :half] | x[:, half:]
    return x


class _Picked:
    """sig[at[i]] for each i, without copies."""

    def __init__(self, sig: list[bytes], at: np.ndarray):
        self.sig, self.at = sig, at

    def __getitem__(self, i: int) -> bytes:
        return self.sig[self.at[i]]


def may_reach(sig_a: list[bytes] | _Picked, sig_b: list[bytes] | _Picked, size_a: np.ndarray, size_b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the signatures leave room for the overlap that the threshold needs; false only if they prove it out of reach."""
    need = np.ceil(threshold / (1 + threshold) * (size_a + size_b) - 1e-9)
    wa, wb = (_signature_bits(x) >> 6 for x in (size_a, size_b))
    out = np.zeros(len(need), bool)
    kinds = wa * (1 << 32) + wb
    for kind in np.unique(kinds):
        rows = np.flatnonzero(kinds == kind)
        for lo in range(0, len(rows), 8192):
            r = rows[lo : lo + 8192]
            w = int(min(wa[r[0]], wb[r[0]]))
            a, b = _folded([sig_a[i] for i in r], w), _folded([sig_b[i] for i in r], w)
            only_a = np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64)
            only_b = np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64)
            out[r] = np.minimum(size_a[r] - only_a, size_b[r] - only_b) >= need[r]
    return out


def overlaps(arrays: list[np.ndarray], a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (a[i], b[i]) of positions in ``arrays`` (sorted, distinct grams) those that reach the threshold, as
    (i, overlap). Grams become ranks of the block's sorted vocabulary, and one set's ranks are marked for all its partners."""
    size = np.array([len(x) for x in arrays], np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    need = np.ceil(threshold / (1 + threshold) * (size[a] + size[b]) - 1e-9).astype(np.int64)
    vocabulary, rank = np.unique(np.concatenate(arrays), return_inverse=True)
    mark = np.zeros(len(vocabulary), bool)
    sig = signatures(np.concatenate(arrays), at)
    able = np.flatnonzero(may_reach(_Picked(sig, a), _Picked(sig, b), size[a], size[b], threshold))
    out = np.zeros(len(a), np.int64)
    order = able[np.argsort(a[able], kind="stable")]
    cut = np.concatenate([[0], np.flatnonzero(a[order][1:] != a[order][:-1]) + 1, [len(order)]]) if len(order) else np.zeros(1, np.int64)
    for s, e in zip(cut[:-1], cut[1:]):
        x = a[order[s]]
        own = rank[at[x] : at[x + 1]]
        mark[own] = True
        for s2 in range(s, e, 2048):
            others = b[order[s2 : min(e, s2 + 2048)]]
            n = size[others]
            first = np.cumsum(n) - n
            where = np.repeat(at[others] - first, n) + np.arange(int(n.sum()))
            out[order[s2 : min(e, s2 + 2048)]] = np.add.reduceat(mark[rank[where]], first, dtype=np.int64)
        mark[own] = False
    good = np.flatnonzero(out >= need)
    return good, out[good]


def _small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """The table, written, and marked for broadcast if it has at most so many rows."""
    df = written(df, "join-groups")
    return F.broadcast(df) if df.count() <= most else df


def _with_group(known: DataFrame, groups: DataFrame, columns: list[str]) -> DataFrame:
    """known with columns of its group. The few large groups are joined by broadcast, so that no task has one of them alone."""
    total = groups.agg(F.sum("docs")).first()[0] or 0
    groups = groups.select("sid", "docs", *columns)
    hot = F.broadcast(groups.where(F.col("docs") > total * HOT_SHARE).select("sid", *columns))
    rest = groups.where(F.col("docs") <= total * HOT_SHARE).select("sid", *columns)
    return known.join(hot, "sid").unionByName(known.join(hot.select("sid"), "sid", "left_anti").join(rest, "sid"))


def jaccard_pairs(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, **kw) -> DataFrame:
    """(doc_a, doc_b, jaccard), doc_a < doc_b; see the module for copies."""
    known, groups, near = _near(docs, threshold, n, True, **kw)
    copies = _with_group(known.select("doc_id", "sid"), groups, ["rep"]).where("doc_id != rep").select(F.col("rep").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard")).distinct()
    return near.unionByName(copies)


def duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """(doc_id, class_id, links) of every document with an id: the smallest id of its class, and the number of other documents that it makes a pair with."""
    known, groups, near = _near(docs, threshold, n, False, id_col=id_col, text_col=text_col, **kw)
    near = written(near, "join-near")
    rows = written(_with_group(known.select("doc_id", "sid"), groups, ["rep"]), "join-members")
    # An id with several texts ties their groups together.
    several = rows.groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("most"), F.collect_set("rep").alias("v")).where("u != most").select("u", F.explode("v").alias("v"))
    classes = components(near.select("u", "v").unionByName(several), "u", "v")
    links = near.groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("near"))
    groups = groups.join(links, "rep", "left").join(classes.select(F.col("node").alias("rep"), "least"), "rep", "left")
    groups = written(groups.select("sid", "docs", F.coalesce("least", "rep").alias("class_id"), (F.coalesce("near", F.lit(0)) + F.col("docs") - 1).alias("links")), "join-classes")
    found = _with_group(rows.select("doc_id", "sid").distinct(), groups, ["class_id", "links"])
    bare = docs.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("links"))
    out = found.select("doc_id", "class_id", "links").unionByName(bare).groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("links").alias("links"))
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "links")


def _block_components(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each of ids the smallest that it is connected with by pairs (a, b) of positions."""
    least = ids.copy()
    while True:
        low = np.minimum(least[a], least[b])
        new = least.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if (new == least).all():
            return least
        least = new


def _near(docs: DataFrame, threshold: float, n: int, pairs_out: bool, sketch: int | None = None, id_col: str = "doc_id", text_col: str = "text", tile_postings: int = TILE_POSTINGS, block_docs: int = BLOCK_DOCS, grid_pairs: int = GRID_PAIRS, centre_sets: int = CENTRE_SETS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with their sets (doc_id, sid), the sets (sid, rep, size, docs), and between sets either the pairs
    (doc_a, doc_b, jaccard) or for each block and set (u, v, links): the smallest id connected in the block, and how many documents make a pair with it there."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    texts = own.select("text")
    if sketch is None:
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        sketch = min(MAX_SKETCH, max(MIN_SKETCH, 1 << int(size // SKETCH_SHARE).bit_length()))
    levels = spark.sparkContext.broadcast(frequency_levels(texts, n, sketch))

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, hi, data, offsets in _each(batches):
            doc, g = sets(data, offsets, n)
            at = _bounds(doc, hi - lo)
            sid, size = _set_ids(g, at), np.diff(at)
            has = size > 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo).filter(pa.array(has)), pa.array(sid[has].view(np.int64)), pa.array(size[has].astype(np.int64)), pa.array(list(compress(signatures(g, at), has)), pa.binary()), pa.array(list(band_keys(g, at).view(np.int64)), pa.list_(pa.int64()))], ["doc_id", "sid", "size", "sig", "keys"])

    known = written(own.mapInArrow(ids, "doc_id long, sid long, size long, sig binary, keys array<long>"), "join-ids")
    grams = known.agg(F.sum("size")).first()[0] or 0
    # Repeated rows count once: ids are few bytes, so a set's are made distinct before they are counted.
    groups = written(known.groupBy("sid", "doc_id").agg(F.max("size").alias("size")).groupBy("sid").agg(F.min("doc_id").alias("rep"), F.max("size").alias("size"), F.count("*").alias("docs")), "join-sets")
    tiles = max(MIN_TILES, -(-int(grams * (1 - threshold)) // tile_postings))

    # The pairs themselves are listed all.
    centres = None if pairs_out else find_centres(own, known, n, centre_sets)
    centres = centres and spark.sparkContext.broadcast(centres)

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        tile = int(rows["tile"].iloc[0])
        if tile < 0:
            a, c, b = np.concatenate([np.frombuffer(x, U).reshape(3, -1) for x in rows["p"]], axis=1)
        else:
            a, b = tile_pairs(rows["p"], tile, threshold)
            c = np.zeros(len(a), U)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64), "centre": c.astype(np.int64)})

    postings = texts.mapInArrow(_emit(n, threshold, tiles, levels, centres), "tile int, p binary")
    # Several tiles a task, so that a pair that meets in many tiles is mostly made one before it is shuffled.
    postings = postings.repartition(max(8, tiles // 4), "tile")
    met = written(postings.groupBy("tile").applyInPandas(meet, "a long, b long, centre long").distinct(), "join-met")
    near = met.where("centre > 0").select(F.col("a").alias("sid"), F.col("b").alias("slack"), "centre")
    met = met.where("centre = 0").select("a", "b")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = [batch.column(x) for x in ("sig_a", "sig_b", "size_a", "size_b")]
                ok = may_reach(columns[0].to_pylist(), columns[1].to_pylist(), columns[2].to_numpy(), columns[3].to_numpy(), threshold)
                yield batch.select(["a", "b", "l"]).filter(pa.array(ok))

    # The smallest neighbour is a label that similar documents share; pairs go to the block of their smaller label.
    label = met.unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l"))
    label = written(label.select(F.col("a").alias("x"), "l"), "join-labels")
    blocks = max(1, -(-label.count() // block_docs))
    labelled = met.join(label.select(F.col("x").alias("a"), F.col("l").alias("la")), "a").join(label.select(F.col("x").alias("b"), F.col("l").alias("lb")), "b")
    labelled = written(labelled.select("a", "b", F.least("la", "lb").alias("l"), (F.col("la") == F.col("lb")).alias("same")), "join-labelled")
    signed = known.groupBy("sid").agg(F.first("sig").alias("sig"), F.max("size").alias("size"))
    side = lambda x: signed.select(F.col("sid").alias(x), F.col("size").alias(f"size_{x}"), F.col("sig").alias(f"sig_{x}"))
    dense = labelled.where("same").groupBy("l").agg(F.count("*").alias("c")).where(F.col("c") >= DENSE).select("l", F.lit(True).alias("dense"))
    dense = _small(dense)
    labelled = written(labelled.join(dense, "l", "left").select("a", "b", "l", (F.col("same") & F.col("dense").isNotNull()).alias("same")), "join-grouped")
    across = labelled.where("not same").select("a", "b", "l").join(side("a"), "a").join(side("b"), "b").mapInArrow(bound, "a long, b long, l long")
    pairs = written(labelled.where("same").select("a", "b", "l").unionByName(across), "join-bounded")
    large = pairs.groupBy("l").agg(F.count("*").alias("c")).where(F.col("c") > grid_pairs).select("l", F.ceil(F.sqrt(F.col("c") / grid_pairs)).cast("long").alias("g"))
    large = _small(large)
    cell = lambda x: F.pmod(F.xxhash64(x), F.coalesce("g", F.lit(1)))
    pairs = pairs.join(large, "l", "left").select(F.pmod(F.xxhash64("l", cell("a"), cell("b")), F.lit(blocks)).cast("int").alias("k"), "a", "b")

    # Sets travel to the blocks that ask for them, from one document each; a bitmap spares most other documents the work.
    wanted = pairs.select("k", F.explode(F.array("a", "b")).alias("sid")).distinct()
    wanted = written(wanted.join(groups.select("sid", "rep", "docs"), "sid"), "join-wanted")
    asked = wanted.select("sid").distinct().count()
    bits = 1 << min(26, max(20, (8 * asked).bit_length()))
    needed = wanted.select(F.pmod(F.xxhash64("rep"), F.lit(bits)).alias("bit")).distinct()
    filled = np.zeros(bits // 64, U)
    for w, v in needed.groupBy(F.expr("bit div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("v")).collect():
        filled[w] = U(v & 0xFFFFFFFFFFFFFFFF)
    filled = spark.sparkContext.broadcast(filled)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column("bit").to_numpy(zero_copy_only=False)
            hit = (filled.value[bit >> 6] >> (bit & 63).astype(U)) & U(1)
            batch = batch.filter(pa.array(hit.astype(bool)))
            ids = batch.column("doc_id")
            for _, lo, hi, data, offsets in _each([batch]):
                doc, g = sets(data, offsets, n)
                at = _bounds(doc, hi - lo)
                sid = _set_ids(g, at)
                has = np.flatnonzero(np.diff(at) > 0)
                yield pa.RecordBatch.from_arrays([pa.array(sid[has].view(np.int64)), ids.slice(lo, hi - lo).take(pa.array(has)), pa.array([_packed(g[at[i] : at[i + 1]]) for i in has], pa.binary())], ["sid", "doc_id", "g"])

    found = own.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("bit")).mapInArrow(gather, "sid long, doc_id long, g binary")
    found = found.withColumnRenamed("doc_id", "rep")
    sent = wanted.join(found, ["sid", "rep"]).select(F.col("k").alias("block"), "sid", "rep", "docs", "g")
    shape = "doc_a long, doc_b long, jaccard double" if pairs_out else "u long, v long, links long"

    def verify(p: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        s = s.drop_duplicates("sid")  # rows may repeat
        if not len(p) or not len(s):
            return pd.DataFrame({x.split()[0]: pd.Series([], dtype="float64" if "double" in x else "int64") for x in shape.split(", ")})
        place = pd.Series(np.arange(len(s)), index=s["sid"].to_numpy())
        a, b = place.loc[p["a"]].to_numpy(), place.loc[p["b"]].to_numpy()
        arrays = [_unpacked(x) for x in s["g"]]
        i, overlap = overlaps(arrays, a, b, threshold)
        a, b, ids = a[i], b[i], s["rep"].to_numpy()
        if pairs_out:
            size = np.array([len(x) for x in arrays])
            value = np.round(overlap / (size[a] + size[b] - overlap), 9)
            return pd.DataFrame({"doc_a": np.minimum(ids[a], ids[b]), "doc_b": np.maximum(ids[a], ids[b]), "jaccard": value})[ids[a] != ids[b]]
        docs = s["docs"].to_numpy()
        links = np.bincount(a, docs[b], len(ids)) + np.bincount(b, docs[a], len(ids))
        least, has = _block_components(a, b, ids), np.flatnonzero(links > 0)
        return pd.DataFrame({"u": ids[has], "v": least[has], "links": links[has].astype(np.int64)})

    out = pairs.groupBy("k").cogroup(sent.groupBy("block")).applyInPandas(verify, shape)
    if centres:
        out = out.unionByName(near.join(groups.select("sid", "rep", "docs"), "sid").groupBy("centre").applyInPandas(certain_links, shape))
    return known, groups, out


def components(pairs: DataFrame, a: str = "doc_a", b: str = "doc_b") -> DataFrame:
    """(node, least): the smallest node that each node is connected with, by alternating star contraction."""
    edges = written(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "join-edges")
    while True:
        # Large star: every larger neighbour moves to the smallest neighbour (or the node itself).
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # Small star: every smaller neighbour, and the node, move to the smallest of them.
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        following = written(small, "join-edges")
        if following.exceptAll(edges).isEmpty() and edges.exceptAll(following).isEmpty():
            return following.select(F.col("u").alias("node"), F.col("v").alias("least"))
        edges = following


def keep_one(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without the documents whose class (of ``duplicate_classes``) has a smaller id; rows with a null id stay."""
    (name,) = fresh(docs.columns, "gone")
    gone = classes.where("doc_id != class_id").select(F.col("doc_id").alias(name))
    return docs.join(gone, F.col(id_col).cast("long") == F.col(name), "left_anti")


def oracle(threshold: float = THRESHOLD, n: int = N, documents: str = "documents") -> str:
    """DuckDB SQL for duplicate_classes(), for tables with one text for each id."""
    word = "regexp_extract_all(lower(text), '[^\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+')"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, {word} AS w FROM {documents} WHERE doc_id IS NOT NULL AND text IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < {n} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n - 1}], ' ')) END) AS g FROM w WHERE len(w) > 0),
s AS (SELECT doc_id, count(*) AS size, md5(string_agg(g, '|' ORDER BY g)) AS sid FROM g GROUP BY doc_id),
r AS (SELECT sid, min(doc_id) AS rep, any_value(size) AS size FROM s GROUP BY sid),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id WHERE x.doc_id IN (SELECT rep FROM r) AND y.doc_id IN (SELECT rep FROM r) GROUP BY ALL),
p AS (SELECT a, b FROM o JOIN r x ON x.rep = a JOIN r y ON y.rep = b WHERE o.n >= ceil({threshold} / (1 + {threshold}) * (x.size + y.size) - 1e-9)),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
reach AS (SELECT rep AS a, rep AS b FROM r UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
c AS (SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY a),
k AS (SELECT sid, count(*) AS docs FROM s GROUP BY sid),
l AS (SELECT e.a AS rep, sum(k.docs) AS near FROM e JOIN r ON r.rep = e.b JOIN k USING (sid) GROUP BY e.a),
f AS (SELECT s.doc_id, c.class_id, (k.docs - 1 + coalesce(l.near, 0))::BIGINT AS links FROM s JOIN k USING (sid) JOIN r USING (sid) JOIN c USING (rep) LEFT JOIN l USING (rep))
SELECT d.doc_id, coalesce(f.class_id, d.doc_id) AS class_id, coalesce(f.links, 0) AS links FROM (SELECT DISTINCT doc_id FROM {documents} WHERE doc_id IS NOT NULL) d LEFT JOIN f USING (doc_id)
"""
