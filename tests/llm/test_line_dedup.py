import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm.cuckoo import Cuckoo
from quillon.llm.line_dedup import LineStore

A, B, C = "the first line of some length here", "another line that is long enough", "a third line, also long enough to count"


def brute(docs):
    seen, out = set(), {}
    for i, t in sorted(((i, t) for i, t in docs if i is not None and t is not None), key=lambda x: x[0]):
        kept = []
        for line in t.split("\n"):
            k = line.strip(" \t\r\v\f").lower()
            if k and k in seen:
                continue
            seen.add(k)
            kept.append(line)
        out[i] = "\n".join(kept)
    return out


def result(store, docs):
    return {r["doc_id"]: r["text"] for r in store.dedup(docs.select("doc_id", "text")).collect() if r["doc_id"] is not None}


def test_edges(spark, make_docs, prose):
    rows = [(1, f"{A}\nshort\n\nx\n{B}"), (2, f"  {A.upper()} \t\r\nshort\n\n  X\r\nyz\n{C}\n{C}"), (3, None), (4, ""), (None, f"{A}\n{B}"), (5, "\n".join([C] * 5000)), (6, prose(1) + "\n" + "word " * 200_000)]
    docs = make_docs(rows)
    store = LineStore.empty(spark).insert(docs)
    got = result(store, docs)
    want = brute(rows)
    assert {k: v for k, v in got.items() if v is not None} == want and got[3] is None
    assert got[4] == "" and got[5] == "" and got[2] == f"\nyz\n{C}"
    nulls = [r for r in store.dedup(docs.select("doc_id", "text")).collect() if r["doc_id"] is None]
    assert nulls[0]["text"] == f"{A}\n{B}" and nulls[0]["removed"] == 0
    # Repeated rows keep the same lines.
    twice = make_docs([rows[0], rows[0]])
    assert {r["text"] for r in LineStore.empty(spark).insert(twice).dedup(twice.select("doc_id", "text")).collect()} == {rows[0][1]}
    empty = make_docs([])
    assert LineStore.empty(spark).insert(empty).dedup(empty).count() == 0


def test_insertions_and_deletions_are_reversible(spark, make_docs):
    first = [(10, f"{A}\n{B}"), (11, f"{B}\n{C}")]
    second = [(1, f"{A}\nnothing new but this longer line"), (2, f"{C}\n{B}")]
    one = LineStore.empty(spark).insert(make_docs(first))
    both = one.insert(make_docs(second))
    # An earlier batch owns its lines, whatever the ids.
    assert result(both, make_docs(second)) == {1: "nothing new but this longer line", 2: ""}
    assert result(both, make_docs(first)) == result(one, make_docs(first))
    back = both.delete(make_docs(second).select("doc_id"))
    counts = lambda s: sorted(map(tuple, s.counts().collect()))
    assert counts(back) == counts(one) and result(back, make_docs(first)) == result(one, make_docs(first))
    # Deleting the owner passes its lines on, and filters hold exactly the keys whose count isn't zero.
    passed = both.delete(make_docs(first).select("doc_id"))
    assert result(passed, make_docs(second)) == {1: second[0][1], 2: second[1][1]}
    for s in (one, both, back, passed):
        keys = {r["h2"] for r in s.counts().collect()}
        held = sum(r["held"] for r in s.filters.collect())
        assert held == len(keys)
        filters = [Cuckoo.from_bytes(bytes(r["table"])) for r in s.filters.collect()]
        h = np.array(sorted(keys), np.int64).view(np.uint64)
        assert np.logical_or.reduce([f.contains(h) for f in filters]).all()


def test_rows_of_one_id_and_clashing_names(spark, make_docs):
    rows = [(1, f"{A}\nonly here"), (2, f"{A}\nfirst text of two"), (2, f"a different text\nits unique line 1\n{B}"), (3, f"{B}\n{A}")]
    docs = make_docs(rows)
    out = LineStore.empty(spark).insert(docs).dedup(docs)
    assert {"removed", "removed_"} <= set(out.columns) and out.columns[: len(docs.columns)] == docs.columns
    assert sorted(r["text"] for r in out.collect()) == sorted([rows[0][1], "first text of two", rows[2][1], ""])
    assert {r["removed"] for r in out.collect()} == {"x"} and sorted(r["removed_"] for r in out.collect()) == [0, 0, 1, 2]


def test_document_of_half_a_million_lines(spark, make_docs):
    a = "\n".join(f"line {i}" for i in range(500_000))
    b = "\n".join(f"line {i}" if i % 2 else f"own {i}" for i in range(500_000))
    docs = make_docs([(1, a), (2, b)])
    assert result(LineStore.empty(spark).insert(docs), docs) == {1: a, 2: "\n".join(f"own {i}" for i in range(0, 500_000, 2))}


def test_full_filter_is_rebuilt(spark, make_docs):
    store = LineStore.empty(spark).insert(make_docs([(0, A)]))
    many = make_docs([(1, "\n".join(f"a generated line with number {i}" for i in range(500)))])
    store = store.insert(many)
    assert store.filters.agg({"held": "sum"}).first()[0] == 501
    assert not store.filters.where("table is null").count()
    small = LineStore.empty(spark, keys_per_shard=100).insert(make_docs([(0, A)]))
    assert small.shards == 1
    grown = small.insert(many)
    assert grown.shards == 6 and grown.filters.agg({"held": "sum"}).first()[0] == 501 and grown.filters.count() == 6
    assert result(grown, many) == result(store, many)


@settings(max_examples=25, deadline=None)
@given(st.sets(st.integers(0, 2**63 - 1), min_size=1, max_size=400), st.integers(0, 10**6))
def test_cuckoo(items, seed):
    h = np.array(sorted(items), np.uint64)
    f = Cuckoo.sized(len(h))
    assert f.insert(h) and f.contains(h).all() and f.held == len(h)
    other = np.random.default_rng(seed).integers(0, 2**63, 2000).astype(np.uint64)
    assert f.contains(other).mean() < 0.05
    half = h[::2]
    f.delete(half)
    assert f.held == len(h) - len(half) and f.contains(h[1::2]).all()
    assert (Cuckoo.from_bytes(f.to_bytes()).table == f.table).all()
