import asyncio

import numpy as np
import pytest

from quillon.sources.facades import Async, Client, Connection, MultiVectorStore, TextStore
from quillon.sources.store import Collection


def embed(texts):
    """Counts of a few letters, as unit vectors."""
    out = []
    for t in texts:
        v = np.array([t.count(c) + 0.1 for c in "abcd"])
        out.append((v / np.linalg.norm(v)).tolist())
    return out


def test_client(spark, tmp_path):
    c = Client(spark, f"file://{tmp_path}/docs")
    d = c.create_collection("x", {"space": "cosine"}, embed)
    assert d.count() == 0 and d.get()["ids"] == []
    d.add(["1", "2", "3"], documents=["aaa", "bbb", "ccc"], metadatas=[{"n": 1, "l": [1]}, {"n": 2}, {"n": 3}])
    with pytest.raises(ValueError):
        c.create_collection("x")
    assert c.list_collections() == ["x"] and c.count_collections() == 1 and c.heartbeat() > 0
    assert d.get(["3", "1", "q"])["ids"] == ["3", "1"] and d.get([])["ids"] == [] and d.get(where={"n": {"$gt": 1}}, limit=1, offset=1)["ids"] == ["3"]
    assert d.get(["1"])["metadatas"] == [{"n": 1, "l": "[1]"}]
    q = d.query(query_texts=["b", "c"], n_results=1)
    assert q["ids"] == [["2"], ["3"]] and q["documents"] == [["bbb"], ["ccc"]]
    d.update(["1"], metadatas=[{"n": 9}])
    d.upsert(["4"], embeddings=[[0, 0, 0, 1]], documents=["ddd"])
    assert d.get(["1"])["metadatas"] == [{"n": 9}] and d.delete(where={"n": 2}) == 1 and d.count() == 3 and len(d.peek(2)["ids"]) == 2
    with pytest.raises(NotImplementedError):
        d.query(query_texts=["a"], where_document={"$contains": "a"})
    d.modify("y")
    assert c.list_collections() == ["y"] and c.get_collection("y").count() == 3
    c.delete_collection("y")
    with pytest.raises(ValueError):
        c.delete_collection("y")
    c.reset()


def test_tables(spark, tmp_path):
    con = Connection(spark, f"file://{tmp_path}/tables")
    t = con.create_table("t", [{"id": "a", "vector": [1, 0], "text": "A", "n": 1}, {"id": "b", "vector": [0, 1], "n": 2, "k": None}, {"id": "c", "vector": [1, 1], "n": 3, "deep": {"x": [1]}}])
    assert con.table_names() == ["t"] and t.count_rows() == 3 and t.count_rows("n >= 2") == 2 and t.count_rows("n = 2") == 1 and t.count_rows("id = 'a'") == 1
    hits = t.search([1, 0.5]).limit(2).to_list()
    assert [h["id"] for h in hits] == ["c", "a"] and hits[0]["_distance"] == 1.5
    assert [h["id"] for h in t.search([1, 0.5]).where("id IN ('a', 'b')").limit(1).select(["id"]).to_list()] == ["a"]
    assert [h["id"] for h in t.search().where("n < 3").to_list()] == ["a", "b"]
    assert t.merge_insert([{"id": "b", "vector": [2, 2], "n": 7}]) == 1 and t.count_rows("n = 7") == 1
    assert t.update("id = 'c'", {"n": 8, "text": "new"}) == 1
    assert t.collection.get("c") == {"id": "c", "metadata": {"n": 8, "deep": {"x": [1]}}, "document": "new"}
    assert t.delete("n > 7") == 1 and len(t.to_pandas()) == 2 and t.to_arrow().num_rows == 2 and t.head(1).count() == 1
    t.add([{"vector": [3, 3]}])
    assert t.collection.contains("2")
    t.optimize()
    t.add([{"id": "z", "vector": [0, 0]}], mode="overwrite")
    assert t.count_rows() == 1
    with pytest.raises(NotImplementedError):
        t.search([1, 0]).where("a = 1 OR b = 2")
    con.create_table("t", dimension=3, mode="overwrite")
    assert con.open_table("t").count_rows() == 0
    con.drop_table("t")
    assert con.table_names() == []


def test_text_store(spark, tmp_path):
    s = TextStore.from_texts(spark, f"file://{tmp_path}/texts", ["aab", "bbc", "ccd"], embed, [{"i": 0}, {"i": 1}, {"i": 2}], ["x", "y", "z"])
    hits = s.search("a", 2)
    assert hits[0]["id"] == "x" and 0 <= hits[1]["relevance"] <= hits[0]["relevance"] <= 1
    assert [h["id"] for h in s.search("a", 3, {"i": {"$gt": 0}})][0] == "y" and s.query_batch(["a", "d"], 1)[1][0]["id"] == "z"
    assert s.as_retriever(1)("c")[0]["text"] in ("ccd", "bbc") and s.get_by_ids(["z", "q"])[0]["text"] == "ccd"
    assert s.search("ccd", 1, hybrid={"text": "ccd", "weight": 1.0})[0]["id"] == "z"
    plain = TextStore(s.collection)
    assert [h["id"] for h in plain.search("BC")] == ["y"]
    assert len(s.add_texts(["dd"])) == 1 and s.delete(["x"]) == 1
    s.clear()
    assert s.collection.count() == 0


def test_multi_vector(spark, tmp_path):
    rng = np.random.default_rng(1)
    t = rng.standard_normal((6, 8))
    m = MultiVectorStore(Collection.open(spark, f"file://{tmp_path}/mv", 8, "ip"))
    m.insert("multi", [t[0], t[1], t[2], t[3]], {"a": 1}, "doc")
    m.insert("partial", [t[0], t[3] * 0.1])
    m.insert("partial", [t[0], t[3] * 0.1, t[4] * 0.1])
    want = {"multi": sum(max(q @ d for d in t[:4]) for q in t[:3]), "partial": sum(max(q @ d for d in (t[0], t[3] * 0.1, t[4] * 0.1)) for q in t[:3])}
    got = dict(m.search(t[:3], 2))
    assert all(abs(got[k] - np.float32(want[k])) < 1e-3 for k in want) and m.search(t[:3], 1, oversample=2)[0][0] == max(want, key=want.get)
    assert m.ids() == ["multi", "partial"] and m.get("multi") == {"id": "multi", "vectors": 4, "metadata": {"a": 1}, "document": "doc"} and m.get("partial")["vectors"] == 3
    assert m.delete("multi") == 4 and m.get("multi") is None


def test_async(spark, tmp_path):
    async def run():
        async with Async(Collection.open(spark, f"file://{tmp_path}/as", 2)) as c:
            await c.insert(["a", "b"], [[1, 0], [0, 1]])
            n, has = await asyncio.gather(c.count(), c.contains("b"))
            return n, has, c.dimension

    assert asyncio.run(run()) == (2, True, 2)
