"""Layouts and sizes of larger tables, in small: empty splits, many blocks, many chunks."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.operators import bm25, filters, graph, ivf, maxsim, topk
from quillon.plans import planner
from quillon.sources import store


def frame(spark, v, kind="long"):
    return spark.createDataFrame([(i if kind == "long" else str(i), x.tolist()) for i, x in enumerate(v)], f"id {kind}, vector array<double>")


@pytest.fixture(scope="module")
def shipped(spark):
    from quillon.session import ship

    ship(spark)
    return spark


def test_training_with_empty_partitions(shipped):
    v = np.random.default_rng(3).standard_normal((60, 8))
    df = frame(shipped, v)
    split = df.where("id < 2").repartition(6, "id").unionByName(df.where("id >= 2"))
    c = ivf.train(split, 4, rounds=1, seed_order=F.col("id"))
    at = (v @ v[:4].T).argmax(axis=1)
    assert np.allclose(c, [v[at == i].mean(axis=0) for i in range(4)])


def brute(metric, q, v, ids, k):
    """(query, id, score) by sorting all pairs."""
    s = q @ v.T
    if metric == "l2":
        s = np.sqrt(((q[:, None] - v[None]) ** 2).sum(axis=2))
    if metric == "cosine":
        size = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None]
        s = np.divide(s, size, out=np.zeros_like(s), where=size > 0)
    s = np.round(s, 6) + 0.0
    order = np.lexsort((np.broadcast_to(topk.place_of(ids), s.shape), s if metric == "l2" else -s), axis=1)[:, :k]
    return [(i, ids[int(j)].as_py(), round(float(s[i, j]), 6)) for i in range(len(q)) for j in order[i]]


@pytest.mark.parametrize("metric", ["ip", "cosine", "l2"])
@pytest.mark.parametrize("case", ["random", "ties", "few", "zero", "rising"])
def test_best_of_blocks(metric, case, monkeypatch):
    for name, value in (("TILE", 7), ("STRIP", 50), ("CANDIDATES", 64)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(1)
    v, q = rng.standard_normal((400, 6)), rng.standard_normal((30, 6))
    if case == "ties":
        v, q = np.sign(v), np.sign(q)
    elif case == "few":
        v = v[:3]
    elif case == "zero":
        v[::3], q[::4] = 0, 0
    elif case == "rising":
        v = v * np.arange(1, 401)[:, None]
    own = rng.permutation(len(v))
    for ids in (pa.array(own), pa.array([f"x{i}" for i in own])):
        for blocks, k in ((1, 1), (1, 10), (3, 10)):
            best = topk.Best(metric, topk.directed(metric, q), k, 6)
            for p in np.array_split(np.arange(len(v)), blocks):
                best.add(ids.take(pa.array(p)), topk.directed(metric, v[p]))
            r, found, s, _ = best.found()
            assert [(a, b, round(c, 6)) for a, b, c in zip(r.tolist(), found.to_pylist(), s.tolist())] == brute(metric, q, v, ids, k)


def test_memory_of_many_queries():
    rng = np.random.default_rng(2)
    q, v = rng.standard_normal((20_000, 8)), rng.standard_normal((10_000, 8))
    tracemalloc.start()
    try:
        topk.block_best("ip", v, pa.array(np.arange(len(v))), q, 5, 6)
        assert tracemalloc.get_traced_memory()[1] < 100e6  # all pairs have 1,600 MB
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("vectors, queries", [(300, 200), (300, 20)])
def test_search_in_blocks(shipped, vectors, queries, monkeypatch):
    """Vectors broadcast and queries dealt, and the other way round, in several blocks each."""
    monkeypatch.setattr(topk, "SMALL_PAIRS", 1000)
    rng = np.random.default_rng(4)
    v = np.round(rng.standard_normal((vectors, 4)), 1)  # with ties
    df = frame(shipped, v, "string")
    q = frame(shipped, v[:queries]).select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    got = topk.search_blocks(df, q, 6, "l2", broadcast_bytes=2000, offset=2).collect()
    want = brute("l2", v[:queries], v, pa.array([str(i) for i in range(vectors)]), 8)
    assert sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 6)) for r in got) == sorted((a, i % 8 + 1, b, c) for i, (a, b, c) in enumerate(want) if i % 8 >= 2)


@pytest.mark.parametrize("vectors, queries, block", [(300, 200, 2000), (300, 200, 1 << 20), (300, 20, 300)])
@pytest.mark.parametrize("oversample", [None, 2])
def test_maxsim_in_blocks(shipped, vectors, queries, block, oversample, monkeypatch):
    """Documents larger than a block and smaller ones, broadcast or scanned."""
    monkeypatch.setattr(topk, "EXPRESSION_PAIRS", 10)
    all_pairs = maxsim._all_pairs
    monkeypatch.setattr(maxsim, "_all_pairs", lambda *a: all_pairs(*a, broadcast_bytes=block))
    rng = np.random.default_rng(5)
    v = rng.standard_normal((vectors, 4))
    doc = np.where(np.arange(vectors) < 150, 0, np.arange(vectors) // 10)
    asked = np.arange(queries) % 3
    own = shipped.createDataFrame([(i, int(doc[i]), v[i].tolist()) for i in range(vectors)], "id long, doc_id long, vector array<double>")
    q = shipped.createDataFrame([(int(asked[i]), i, v[i].tolist()) for i in range(queries)], "query_id long, token_idx long, query_vector array<double>")
    got = {(r["query_id"], r["rank"]): (r["doc_id"], round(r["score"], 6)) for r in maxsim.maxsim(own, q, 3, oversample=oversample, token_id="id", query_id="query_id").collect()}
    s = v[:queries] @ v.T
    want = {}
    for a in range(3):
        rows = s[asked == a]
        near = np.lexsort((np.broadcast_to(np.arange(vectors), rows.shape), -np.round(rows, 6)), axis=1)[:, :6]
        found = sorted(set(doc[near].ravel().tolist()) if oversample else set(doc.tolist()))
        best = sorted((-round(float(rows[:, doc == x].max(axis=1).sum()), 6), x) for x in found)[:3]
        want |= {(a, i + 1): (x, -t) for i, (t, x) in enumerate(best)}
    assert got == want


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_facets_parse_once_and_keep_their_form(spark):
    texts = ['{"a": 1}', '{"a": 1.0}', '{"a": "1"}', '{"a": null}', '{"a": true}', '{"a": [1, {"b": 2}]}', '{"a": {"c": 1}}', "{}", None, "not json", '{"a": ""}']
    df = spark.createDataFrame([(t,) for t in texts], "metadata string")
    out = filters.facet(df, "a")
    old = df.select(filters.field_text("metadata", "a").alias("value")).where("value is not null").groupBy("value").count()
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in old.collect()}
    parses = lambda df: plan(df.select("*")).lower().count("parsejson")
    assert 0 < parses(filters.facet(df, "a")) <= 2 < parses(df.select(filters.field_text("metadata", "a").alias("value")))


def test_texts_are_split_once(spark):
    texts = ["", "...", " A b, a! ", "b b b c", "c", None, "-x-", "Éa é"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, document string")
    asked = spark.createDataFrame([(0, "a B"), (1, "é nothing x"), (2, "")], "query_id int, query_text string")
    index = bm25.Bm25.build(docs)
    plain = bm25.Bm25(index.table, index.stats, "id")
    got, want = index.search_many(asked, 5, digits=6), plain.search_many(asked, 5, digits=6)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count()
    assert "document" not in plan(got)  # what was found is kept; the texts aren't read again


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_graph_in_blocks_is_the_joined_one(shipped, metric, monkeypatch):
    v = np.round(np.random.default_rng(6).standard_normal((120, 4)), 2)
    df = frame(shipped, v, "string")
    q = df.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))

    def made():
        edges = graph.build(df, 6, 1, metric)
        walked = graph.search(df, edges, q, 5, beam=8, hops=2, metric=metric)
        return [sorted((*r[:2], round(r[2], 6), *r[3:]) for r in x.collect()) for x in (edges.select("node", "neighbor", "score"), walked.select("query_id", "id", "score", "rank"))]

    monkeypatch.setattr(graph, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(graph, "ROWS", 50)
    blocked = made()
    monkeypatch.setattr(graph, "BLOCK_NODES", 0)
    assert blocked == made() and len(blocked[0]) == 720 and len(blocked[1]) == 600


def test_large_batches_are_numbered_by_keys_and_postings_dealt(shipped, tmp_path, monkeypatch):
    """No window over rows with their documents; postings of a bucket in several tasks, searched as before."""
    texts = [f"w{i % 7} w{i % 5} common" for i in range(40)]
    frames = []
    numbered = store.Collection._numbered

    def kept(self, rows, count, path):
        frames.append(out := numbered(self, rows, count, path))
        return out

    monkeypatch.setattr(store.Collection, "_numbered", kept)
    found = []
    for name, few in (("plain", False), ("dealt", True)):
        if few:
            monkeypatch.setattr(planner, "BUCKET_DOCUMENTS", 10)
            monkeypatch.setattr(planner, "TASK_DOCUMENTS", 8)
        c = store.Collection.open(shipped, str(tmp_path / name), 1)
        c.insert([f"d{i}" for i in range(40)], [[1.0]] * 40, None, texts)
        windows = [x for x in frames[-1]._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in x]
        s = planner.Searcher(c)
        s.create_text_index()
        q = shipped.createDataFrame([(0, "w3 common")], "query_id int, query_text string")
        found.append(sorted(map(tuple, s.text_search(q, 10, digits=6).collect())))
        rows = {r["id"]: r["seq"] for r in c.rows().collect()}
        assert windows and rows == {f"d{i}": i for i in range(40)}
        below = frames[-1]._jdf.queryExecution().optimizedPlan().toString().split("Window [")[1]
        assert "document" not in below.split("Relation")[0]
    assert found[0] == found[1] and len(found[0]) == 10
