import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import ngram_join as J


def grams(text, n):
    w = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").lower())
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset()


def brute(rows, threshold, n):
    sets = {}
    for i, t in rows:
        if i is not None and grams(t, n):
            sets.setdefault(grams(t, n), set()).add(i)
    reps = {min(v): s for s, v in sets.items()}
    out = {(min(v), x): 1.0 for v in sets.values() for x in v if x != min(v)}
    ids = sorted(reps)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            o = len(reps[a] & reps[b])
            u = len(reps[a] | reps[b])
            if o / u >= threshold - 1e-12:
                out[a, b] = round(o / u, 9)
    return out


def brute_classes(rows, threshold, n):
    """(doc_id, class, links): every pair of rows of different ids is compared."""
    rows = sorted({(i, t) for i, t in rows if i is not None}, key=str)
    sets = [(i, grams(t, n)) for i, t in rows]
    parent, links = {i: i for i, _ in rows}, dict.fromkeys((i for i, _ in rows), 0)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, s) in enumerate(sets):
        for j, t in sets[k + 1 :]:
            if i != j and s and t and len(s & t) / len(s | t) >= threshold - 1e-12:
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [(i, root(i), links[i]) for i in parent]


def near(text, rate, seed):
    r = random.Random(seed)
    return " ".join(f"w{r.randint(0, 10**6)}" if r.random() < rate else w for w in text.split(" "))


@pytest.mark.parametrize(("n", "threshold"), [(2, 0.65), (1, 0.8), (3, 0.5)])
def test_equals_brute_force(spark, make_docs, prose, n, threshold):
    rows = []
    for g in range(12):
        base = prose(g, words=20 + 17 * g)
        rows += [(100 * g + j, base if j < 3 else near(base, 0.03 * j, 100 * g + j)) for j in range(9)]
    shared = prose(99, words=60)
    rows += [(5000 + i, prose(500 + i, words=80) + " " + shared) for i in range(25)]
    rows += [(9000, None), (9001, ""), (9002, " .,! "), (9003, "one"), (9004, "One"), (9005, "one two"), (None, rows[0][1]), rows[0], (9006, "word " * 100_000), (9007, prose(7, 30_000)), (9008, prose(7, 30_000) + " more")]
    got = {(r["doc_a"], r["doc_b"]): r["jaccard"] for r in J.jaccard_pairs(make_docs(rows), threshold, n, tile_postings=700, block_docs=8, grid_pairs=20).collect()}
    assert got == brute(rows, threshold, n)
    got = [tuple(r) for r in J.duplicate_classes(make_docs(rows), threshold, n, tile_postings=700, block_docs=8, grid_pairs=20).collect()]
    assert sorted(got) == sorted(brute_classes(rows, threshold, n))


def test_nested_sets_beyond_16_bits(spark, make_docs):
    """Of two large sets the longer may have the smaller set id; it must still be the shorter one whose index grams count.
    The sketch has few collisions, so that the grams of the longer set alone come first."""
    rows, longer_first = [], False
    for k in range(4):
        words = [f"w{k}x{i}" for i in range(100_000)]
        rows += [(2 * k, " ".join(words[:70_000])), (2 * k + 1, " ".join(words))]
        sid = []
        for _, t in rows[-2:]:
            data = np.frombuffer(t.encode(), np.uint8)
            doc, g = J.sets(data, np.array([0, len(data)]), 2)
            sid.append(J._set_ids(g, J._bounds(doc, 1))[0])
        longer_first |= bool(sid[1] < sid[0])
    assert longer_first
    got = {(r["doc_a"], r["doc_b"]): r["jaccard"] for r in J.jaccard_pairs(make_docs(rows), sketch=1 << 22).collect()}
    assert got == brute(rows, J.THRESHOLD, J.N) and len(got) == 4


def test_certain_pairs_of_near_copies_are_counted_and_not_listed(spark, make_docs, prose, monkeypatch):
    """Two groups of near copies, of which some are at the threshold's edge, copies of copies and documents alone."""
    rows = []
    for g in range(2):
        base = prose(g, words=150)
        rows += [(1000 * g + j, near(base, (0.0, 0.01, 0.03, 0.05, 0.09, 0.14)[j % 6], 1000 * g + j)) for j in range(120)]
        rows += [(1000 * g + 500 + j, rows[-1 - 7 * j][1]) for j in range(8)]
        rows += [(1000 * g + 600 + j, " ".join(base.split(" ")[: 100 + 4 * j])) for j in range(12)]
    rows += [(5000 + j, prose(50 + j, words=80)) for j in range(30)]
    seen, written = {}, J.written

    def noted(df, name):
        seen[name] = written(df, name)
        return seen[name]

    monkeypatch.setattr(J, "written", noted)
    got = [tuple(r) for r in J.duplicate_classes(make_docs(rows), J.THRESHOLD, 2).collect()]
    expected = brute_classes(rows, J.THRESHOLD, 2)
    assert sorted(got) == sorted(expected)
    assert seen["join-met"].count() < 0.25 * sum(x[2] for x in expected)


def test_runs_leave_out_certain_pairs_only():
    rng = np.random.default_rng(3)
    for _ in range(20):
        gram = np.sort(rng.integers(0, 6, 80)).astype(np.uint64)
        first = np.searchsorted(gram, gram)
        lo = np.minimum(first + rng.integers(0, 5, 80), np.arange(80))
        centre = rng.integers(0, 3, 80).astype(np.uint16)
        left = np.where(centre > 0, rng.integers(-9, 9, 80), 0)
        one, start, many, place = J._runs(gram, lo, centre, left)
        met = [tuple(sorted((int(i), int(j)))) for i, s, m in zip(one, start, many) for j in place[s : s + m]]
        met = [(j, i) for j, i in met if j >= lo[i]]
        assert len(met) == len(set(met))
        assert set(met) == {(j, i) for i in range(80) for j in range(lo[i], i) if centre[i] != centre[j] or centre[i] == 0 or left[i] + left[j] < 0}


def test_empty(spark, make_docs):
    for rows in ([], [(1, None)], [(1, "alone here")]):
        assert J.jaccard_pairs(make_docs(rows)).count() == 0


def test_classes_of_copies_and_of_ids_with_several_texts(spark, make_docs, prose):
    rows = [(i, prose(1)) for i in range(50, 0, -1)] + [(60, near(prose(1), 0.03, 1)), (61, prose(2)), (62, prose(3)), (62, prose(4)), (63, prose(3)), (64, prose(4)), (50, prose(1)), (70, None), (71, ""), (None, prose(1))]
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in J.duplicate_classes(make_docs(rows)).collect()}
    assert got == {**{i: (1, 50) for i in range(1, 51)}, 60: (1, 50), 61: (61, 0), 62: (62, 2), 63: (62, 1), 64: (62, 1), 70: (70, 0), 71: (71, 0)}
    docs = make_docs(rows).withColumn("gone", F.lit(1)).withColumn("gone_", F.lit(1))
    kept = J.keep_one(docs, J.duplicate_classes(docs))
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "61", "62", "62", "70", "71", "None"]
    assert J.duplicate_classes(make_docs([])).count() == 0


def test_components_and_keep_one(spark, make_docs):
    edges = [(1, 2), (2, 3), (4, 9), (9, 7), (7, 8), (20, 21), *[(100 + i, 101 + i) for i in range(30)]]
    pairs = spark.createDataFrame(edges, "doc_a long, doc_b long")
    got = {r["node"]: r["least"] for r in J.components(pairs).collect()}
    assert got == {2: 1, 3: 1, 9: 4, 7: 4, 8: 4, 21: 20, **{101 + i: 100 for i in range(30)}}
    docs = make_docs([(i, "t") for i in (1, 2, 3, 5, None, 8)])
    kept = J.keep_one(docs, J.components(pairs).select(F.col("node").alias("doc_id"), F.col("least").alias("class_id")))
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.orderBy("doc_id").collect()] == [None, 1, 5]


def test_overlaps_bound_is_safe():
    rng = np.random.default_rng(1)
    arrays = [np.unique(rng.integers(0, 3000, rng.integers(1, 900)).astype(np.uint64)) for _ in range(60)]
    a, b = (x.ravel() for x in np.meshgrid(np.arange(60), np.arange(60)))
    i, o = J.overlaps(arrays, a, b, 0.2)
    found = {(a[x], b[x]): y for x, y in zip(i, o)}
    for x in range(60):
        for y in range(60):
            c = len(np.intersect1d(arrays[x], arrays[y]))
            assert ((x, y) in found) == (c >= np.ceil(0.2 / 1.2 * (len(arrays[x]) + len(arrays[y])) - 1e-9))
            assert found.get((x, y), c) == c
    at = np.concatenate([[0], np.cumsum([len(x) for x in arrays])])
    sig = J.signatures(np.concatenate(arrays), at)
    size = np.diff(at)
    for t in (0.2, 0.65):
        ok = J.may_reach([sig[x] for x in a], [sig[x] for x in b], size[a], size[b], t)
        true = np.array([len(np.intersect1d(arrays[x], arrays[y])) >= np.ceil(t / (1 + t) * (size[x] + size[y]) - 1e-9) for x, y in zip(a, b)])
        assert ok[true].all() and (t < 0.5 or ok.mean() < 0.2)


def test_sparse_counters():
    rng = np.random.default_rng(2)
    for density in (0.0005, 0.1, 0.9):
        c = np.where(rng.random(5000) < density, rng.integers(1, 256, 5000), 0).astype(np.uint8)
        c[7] = 255
        total = np.zeros(5000, np.int64)
        J._add_sparse(total, J._sparse(c))
        J._add_sparse(total, J._sparse(c))
        assert (total == 2 * c.astype(np.int64)).all()
