import datetime
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.plans.planner import Searcher
from quillon.sources import store
from quillon.sources.importers import adapt, detect, import_table
from quillon.sources.store import Catalog, Collection
from quillon.streaming.ingest import stream_upserts


@pytest.fixture
def coll(spark, tmp_path):
    return Collection.open(spark, f"file://{tmp_path}/c", 4, "cosine")


def ids(df):
    return [r["id"] for r in df.collect()]


def test_lifecycle(spark, coll, tmp_path):
    v = [[1, 0, 0, 0], [0, 1, 0, 0], [1, 1, 0, 0], [-1, 0, 0, 0]]
    assert coll.insert(["a", "b", "c", "d"], v, [{"n": 1}, {"n": 2}, None, {"t": "x", "u": None}], ["da", None, "dc", "dd"]) == 4
    with pytest.raises(ValueError, match="id exists"):
        coll.insert(["e", "a"], v[:2])
    with pytest.raises(ValueError, match="id exists"):
        coll.insert(["e", "e"], v[:2])
    assert not coll.contains("e") and coll.count() == 4  # nothing of a failed batch is written
    with pytest.raises(ValueError, match="doesn't exist"):
        coll.update(["zz"], v[:1])
    assert coll.upsert(["a", "e", "e"], [v[1], v[0], v[2]], [{"n": 9}, {"n": 5}, {"n": 6}]) == 2
    assert coll.get("a") == {"id": "a", "metadata": {"n": 9}, "document": None} and coll.get("e")["metadata"] == {"n": 6} and coll.get("zz") is None
    assert ids(coll.list_all()) == ["b", "c", "d", "a", "e"]
    assert ids(coll.list_ids({"n": {"$gte": 2}}, limit=2, offset=1)) == ["a", "e"]
    assert [(r["pos"], r["id"], r["found"]) for r in coll.get_many(["e", "q", "b", "e"]).collect()] == [(0, "e", True), (1, "q", False), (2, "b", True), (3, "e", True)]
    assert {r["value"]: r["count"] for r in coll.facet("u").collect()} == {"null": 1}
    coll.update_metadata("b", {"n": 7}, "new")
    assert coll.get("b") == {"id": "b", "metadata": {"n": 7}, "document": "new"}
    with pytest.raises(KeyError):
        coll.update_metadata("zz", {"a": 1})
    coll.snapshot(f"file://{tmp_path}/snap")
    assert coll.delete(["a", "unknown"]) == 1 and coll.delete_where({"n": {"$exists": False}}) == 2 and coll.count() == 2
    before = sorted(map(tuple, coll.rows().select("id", "metadata", "seq").collect()))
    coll.compact()
    assert len(coll.manifest["parts"]) == 1 and sorted(map(tuple, coll.rows().select("id", "metadata", "seq").collect())) == before
    assert coll.vacuum() > 0 and coll.count() == 2
    again = Collection.open(spark, coll.path)
    assert again.count() == 2 and again.metric == "cosine"
    again.restore(f"file://{tmp_path}/snap")
    assert sorted(ids(again.list_all())) == ["a", "b", "c", "d", "e"] and again.stats()["vector_count"] == 5
    for bad in ({"dimension": 5}, {"metric": "l2"}):
        with pytest.raises(ValueError):
            Collection.open(spark, coll.path, **bad)


def test_bad_rows_and_reports(spark, coll):
    nan = float("nan")
    with pytest.raises(ValueError, match="finite"):
        coll.insert(["a"], [[1, 2, 3, nan]])
    with pytest.raises(ValueError, match="4 elements"):
        coll.insert(["a"], [[1, 2, 3]])
    with pytest.raises(ValueError, match="invalid id"):
        coll.insert(["x" * 70_000], [[1, 2, 3, 4]])
    batch = coll.frame(["a", "b", "a", "c"], [[1, 2, 3, 4], [1, 2], [1, 2, 3, 4], [0, 0, 0, 1]])
    failed = coll.write(batch, "insert", report=True).orderBy("pos").collect()
    assert [(r["pos"], r["id"]) for r in failed] == [(1, "b"), (2, "a")] and coll.count() == 2
    with pytest.raises(ValueError):
        coll.list_ids(limit=-1)
    # A manifest cut short by a crash is not a version.
    coll.files.create(f"{coll.path}/manifests/999999999999.json", '{"version":')
    assert Collection.open(spark, coll.path).count() == 2


def test_normalized(spark, tmp_path):
    c = Collection.open(spark, f"file://{tmp_path}/n", 2, "ip", normalize=True)
    c.insert(["a"], [[3, 4]])
    assert np.allclose(c.rows().first()["vector"], [0.6, 0.8])
    with pytest.raises(ValueError, match="no length"):
        c.insert(["b"], [[0, 0]])


@pytest.mark.parametrize("metric", ["ip", "cosine", "l2"])
def test_search_metrics(spark, tmp_path, metric):
    c = Collection.open(spark, f"file://{tmp_path}/{metric}", 4, metric)
    v = {"v1": [1, 0, 0, 0], "v2": [0, 1, 0, 0], "v3": [1, 1, 0, 0], "v4": [-1, 0, 0, 0], "zero": [0, 0, 0, 0]}
    c.insert(list(v), list(v.values()), [{"i": i} for i in range(len(v))])
    q = np.array([1, 0.25, 0, 0])
    x = {k: np.array(a, float) for k, a in v.items()}
    exact = {"ip": lambda a: q @ a, "cosine": lambda a: 0.0 if not a.any() else q @ a / np.linalg.norm(q) / np.linalg.norm(a), "l2": lambda a: np.linalg.norm(q - a)}[metric]
    want = sorted(x, key=lambda k: (exact(x[k]) if metric == "l2" else -exact(x[k]), k))
    s = Searcher(c)
    got = s.search(q, 5).collect()
    assert [r["id"] for r in got] == want and np.allclose([r["score"] for r in got], [exact(x[k]) for k in want], atol=1e-6)
    assert ids(s.search(q, 2, offset=1)) == want[1:3] and ids(s.search(q, 9, filt={"i": {"$gt": 2}})) == [k for k in want if k in ("v4", "zero")]
    assert s.search(q, 1, include=["id", "score"]).columns == ["id", "score"]
    for bad in (dict(k=0), dict(include=["vector"]), dict(rerank_factor=0), dict(rerank_factor=101), dict(filt={"a": {"$x": 1}})):
        with pytest.raises(ValueError):
            s.search(q, **bad)
    with pytest.raises(ValueError):
        s.search([1, 2])


def test_index_and_hybrid(spark, tmp_path):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((400, 16))
    v /= np.linalg.norm(v, axis=1)[:, None]
    c = Collection.open(spark, f"file://{tmp_path}/h", 16, "ip")
    c.insert([f"d{i:03}" for i in range(400)], v, None, [f"common words number{i}" if i != 7 else "a rareword here" for i in range(400)])
    s = Searcher(c)
    s.create_index(8, rounds=4)
    exact = ids(s.search(v[0], 10, use_ann=False))
    assert ids(s.search(v[0], 10, nprobe=8)) == exact and ids(s.search(v[0], 10, nprobe=99)) == exact
    assert len(set(ids(s.search(v[0], 10, nprobe=3))) & set(exact)) >= 4
    c.upsert(["fresh", exact[1]], [v[0] * 2, -v[0]])
    found = ids(s.search(v[0], 10, nprobe=8))
    assert found[0] == "fresh" and exact[1] not in found  # rows written or changed after the build count
    assert c.manifest["index"]["nprobe"] >= 3 and s.strategy(None, None, None, None) == "exact" and s.strategy(None, 4, None, None) == "ivf" and s.strategy(None, None, True, {"text": "x"}) == "hybrid"
    top = ids(s.search(v[0], 5, hybrid={"text": "rareword"}))
    assert "d007" in top
    s.create_text_index()
    assert ids(s.search(v[0], 5, hybrid={"text": "rareword"})) == ids(Searcher(Collection.open(spark, c.path)).search(v[0], 5, hybrid={"text": "rareword"})) and "d007" in top
    # A keyword weight of 1 leaves the keyword list alone.
    assert ids(s.search(v[0], 1, hybrid={"text": "rareword", "weight": 1.0})) == ["d007"]
    both = s.search_batch([v[0], v[1]], 3, hybrid={"texts": ["rareword", ""]}).collect()
    assert {r["query_id"] for r in both} == {0, 1}
    assert ids(s.search(v[0], 3, hybrid={"text": ""})) == ids(s.search(v[0], 3))
    for bad in ({}, {"text": "a", "weight": 2}, {"text": "a", "rrf_k": 0}, {"text": "a", "oversample": 0}, {"text": "a", "x": 1}):
        with pytest.raises(ValueError):
            s.search(v[0], hybrid=bad)


def test_catalog_and_import(spark, tmp_path):
    cat = Catalog(spark, f"file://{tmp_path}/root")
    cat.create("one", 2, tenant="t", database="d")
    cat.create("two", 2)
    assert cat.list() == ["two"] and cat.list("t", "d") == ["one"] and cat.exists("one", tenant="t", database="d") and not cat.exists("one")
    with pytest.raises(ValueError):
        cat.create("two", 2)
    with pytest.raises(ValueError):
        cat.create("../x", 2)
    assert cat.get("two").dimension == 2 and cat.delete("two") and not cat.delete("two")
    with pytest.raises(KeyError):
        cat.get("two")
    df = spark.createDataFrame([([1.0, 2.0], "k1", "body", 3, None), ([3.0, 4.0], "k2", None, None, "z")], "emb array<double>, key string, text string, n int, tag string")
    assert detect(df.schema) == {"vector": "emb", "id": "key", "document": "text"}
    c = import_table(df, f"file://{tmp_path}/imp", "cosine")
    assert c.get("k1") == {"id": "k1", "metadata": {"n": 3}, "document": "body"}
    assert adapt(spark.createDataFrame([([1.0],)], "vector array<float>")).first()["id"].startswith("row_")
    with pytest.raises(ValueError):
        detect(spark.createDataFrame([("a",)], "x string").schema)


def test_stream(spark, tmp_path):
    c = Collection.open(spark, f"file://{tmp_path}/s", 2)
    src = f"{tmp_path}/in"
    schema = "id string, vector array<float>, metadata string, document string, at long"
    spark.createDataFrame([("a", [1.0, 0.0], json.dumps({"v": 1}), None, 1), ("a", [2.0, 0.0], json.dumps({"v": 2}), None, 2), ("b", [0.0, 1.0], "{}", None, 1)], schema).coalesce(1).write.parquet(src)
    for _ in range(2):
        q = stream_upserts(spark.readStream.schema(schema).parquet(src), c, f"{tmp_path}/cp", "at")
        q.awaitTermination()
        spark.createDataFrame([("b", [0.0, 5.0], json.dumps({"v": 3}), "doc", 9)], schema).coalesce(1).write.mode("append").parquet(src)
    c.refresh()
    assert c.count() == 2 and c.get("a")["metadata"] == {"v": 2} and c.get("b")["metadata"] == {"v": 3}


def test_order_of_batches(spark, tmp_path, monkeypatch):
    """pos of any kind orders a batch, and every batch comes after the one before; numbers stay dense."""
    c = Collection.open(spark, f"file://{tmp_path}/o", 1)
    batch = lambda rows, kind: spark.createDataFrame(rows, f"pos {kind}, id string, vector array<float>")
    c.write(batch([(10, "a", [1.0])], "long"))
    c.write(batch([(-5, "a", [2.0]), (-9, "a", [3.0])], "long"))
    assert c.rows().first()["vector"] == [2.0]
    at = lambda us: datetime.datetime(2024, 1, 1, 0, 0, 0, us)
    c.write(batch([(at(900), "a", [4.0]), (at(100), "a", [5.0]), (at(500), "b", [6.0])], "timestamp"))
    assert {r["id"]: r["vector"][0] for r in c.rows().collect()} == {"a": 4.0, "b": 6.0}
    before = c.manifest["next_seq"]
    for _ in range(3):
        c.write(c.rows().select(F.col("seq").alias("pos"), "id", "vector"), "update")
    assert c.manifest["next_seq"] == before + 6
    monkeypatch.setattr(store, "NUMBER_ROWS", 3)
    c.write(batch([(i, f"n{i:03}", [float(i)]) for i in range(200)], "long").repartition(5))
    assert c.manifest["next_seq"] == before + 206 and ids(c.list_ids(offset=2)) == [f"n{i:03}" for i in range(200)]


@pytest.mark.parametrize("metric", ["ip", "cosine", "l2"])
def test_quantised_graph_and_text_indexes(spark, tmp_path, metric):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((600, 32))
    v /= np.linalg.norm(v, axis=1)[:, None]
    c = Collection.open(spark, f"file://{tmp_path}/q", 32, metric, rerank=True)
    c.insert([f"d{i:03}" for i in range(500)], v[:500], [{"i": i} for i in range(500)], [f"word{i % 7} all" for i in range(500)])
    s = Searcher(c)
    recall = lambda got, want: len(set(ids(got)) & set(want)) / len(want)
    exact = [ids(s.search(v[i], 10, quantised=False)) for i in range(3)]
    assert s.strategy(None, None, None, None) == "quantised" and s.strategy(None, None, None, None, False) == "exact"
    assert np.mean([recall(s.search(v[i], 10), exact[i]) for i in range(3)]) >= 0.95
    assert np.mean([recall(s.search(v[i], 10, quantised=True, rerank_factor=0), exact[i]) for i in range(3)]) >= 0.7
    assert np.mean([recall(s.search(v[i], 10, prefilter=True), exact[i]) for i in range(3)]) >= 0.8
    assert all(r["metadata"]["i"] >= 400 if isinstance(r["metadata"], dict) else json.loads(r["metadata"])["i"] >= 400 for r in s.search(v[0], 10, {"i": {"$gte": 400}}).collect())
    # The candidates' scan reads codes, not vectors.
    plan = s.dense(s._queries([v[0]]), 10, strategy="quantised")._jdf.queryExecution().executedPlan().toString()
    assert "vector" not in plan.split("ReadSchema")[1]
    if metric != "ip":
        return
    s.create_graph(8, 3)
    assert np.mean([recall(s.search(v[i], 10, beam=64), exact[i]) for i in range(3)]) >= 0.9
    c.insert([f"e{i:03}" for i in range(500, 600)], v[500:], [{"i": i} for i in range(500, 600)], ["late all"] * 100)
    c.delete([exact[0][1]])
    want = ids(s.search(v[0], 10, quantised=False))
    assert exact[0][1] not in want and recall(s.search(v[0], 10, beam=64), want) >= 0.9
    s.update_graph()
    assert c.manifest["graph"]["next_seq"] == c.manifest["next_seq"] and recall(s.search(v[0], 10, beam=64), want) >= 0.9
    asked = spark.createDataFrame([(0, "late word3"), (1, "all")], "query_id int, query_text string")
    plain = sorted(map(tuple, s.text_search(asked, 30, {"i": {"$gte": 3}}, 6).collect()))
    s.create_text_index()
    assert sorted(map(tuple, s.text_search(asked, 30, {"i": {"$gte": 3}}, 6).collect())) == plain
    c.upsert(["d010", "new"], v[:2], None, ["late late", "word3"])
    c.delete(["d003"])
    built = sorted(map(tuple, s.text_search(asked, 30, None, 6).collect()))
    c.manifest["text"] = None
    assert sorted(map(tuple, s.text_search(asked, 30, None, 6).collect())) == built
