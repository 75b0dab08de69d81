import json
from types import SimpleNamespace as Clause

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.operators import filters as M

SCALAR = st.one_of(st.none(), st.booleans(), st.integers(-3, 3), st.sampled_from([0.0, 1.0, 2.5, -1.5]), st.sampled_from(["", "a", "ab", "1", "é"]))
VALUE = st.one_of(SCALAR, st.lists(SCALAR, max_size=2), st.dictionaries(st.sampled_from("xy"), SCALAR, max_size=2))
META = st.dictionaries(st.sampled_from("abc"), VALUE, max_size=3)
OP = st.one_of(
    st.tuples(st.sampled_from(["$eq", "$ne"]), VALUE), st.tuples(st.sampled_from(["$gt", "$gte", "$lt", "$lte"]), SCALAR), st.tuples(st.sampled_from(["$in", "$nin"]), st.one_of(st.lists(VALUE, max_size=3), SCALAR)),
    st.tuples(st.just("$exists"), st.one_of(st.booleans(), st.just(1))), st.tuples(st.just("$contains"), st.sampled_from(["a", "", 1])),
)
LEAF = st.dictionaries(st.sampled_from(["a", "b", "c", "a.x", "b.y", "a.x.z"]), st.one_of(SCALAR, st.lists(SCALAR, max_size=2), st.dictionaries(OP.map(lambda o: o[0]), st.none(), max_size=0), OP.map(lambda o: {o[0]: o[1]})), max_size=2)
FILTER = st.recursive(LEAF, lambda f: st.one_of(st.fixed_dictionaries({"$and": st.lists(f, max_size=2)}), st.fixed_dictionaries({"$or": st.lists(f, max_size=2)})), max_leaves=4)


def test_compiled_equals_evaluated(spark):
    """Random filters over random objects: one Spark job compares all of them."""
    metas, filts = [], []

    @settings(max_examples=60, deadline=None, database=None, derandomize=True)
    @given(META)
    def some_metas(m):
        metas.append(m)

    @settings(max_examples=50, deadline=None, database=None, derandomize=True)
    @given(FILTER)
    def some_filters(f):
        filts.append(f)

    some_metas()
    some_filters()
    df = spark.createDataFrame([(i, json.dumps(m)) for i, m in enumerate(metas)], "i int, metadata string")
    for lo in range(0, len(filts), 10):
        part = filts[lo : lo + 10]
        for r in df.select("i", *[M.compile_filter(f, "metadata").alias(f"f{k}") for k, f in enumerate(part)]).collect():
            for k, f in enumerate(part):
                assert r[f"f{k}"] == M.matches(metas[r["i"]], f), (metas[r["i"]], f)


def test_fixed_cases(spark):
    rows = [("doc1", {"year": 2020, "topic": "ml"}), ("doc2", {"year": 2021, "topic": "nlp"}), ("doc3", {"year": 2023, "topic": "ml"}), ("doc4", {"year": 2024, "topic": "cv"}), ("nested", {"profile": {"region": "us-west"}, "score": 95}), ("bare", {"score": 80})]
    df = spark.createDataFrame([(i, json.dumps(m)) for i, m in rows], "id string, metadata string")
    run = lambda f: sorted(r["id"] for r in df.where(M.compile_filter(f)).collect())
    assert run({"topic": {"$eq": "ml"}}) == ["doc1", "doc3"]
    assert run({"year": {"$gte": 2023}}) == ["doc3", "doc4"]
    assert run({"$and": [{"topic": "ml"}, {"year": {"$gte": 2022}}]}) == ["doc3"]
    assert run({"$or": [{"topic": "cv"}, {"year": {"$lt": 2021}}]}) == ["doc1", "doc4"]
    assert run({"profile.region": "us-west"}) == ["nested"]
    assert len(run({"profile.region": {"$ne": "us-west"}})) == 5
    assert run({"year": {"$contains": "2"}}) == [] and run({"year": {"$gt": "2020"}}) == []
    assert len(run({})) == 6 and len(run(None)) == 6
    nulls = spark.createDataFrame([("a", None), ("b", "not json")], "id string, metadata string")
    assert nulls.where(M.compile_filter({"x": {"$exists": False}})).count() == 2


def test_validation_and_translators():
    for bad in ({"$nor": []}, {"a": {"$regex": "x"}}, {"$and": [{"a": {"$foo": 1}}]}):
        with pytest.raises(ValueError):
            M.validate(bad)
    deep = {"a": 1}
    for _ in range(70):
        deep = {"$and": [deep]}
    with pytest.raises(ValueError):
        M.validate(deep)
    assert M.parse_where("id IN ('a', 'b')") == {"id": {"$in": ["a", "b"]}}
    assert M.parse_where("f != 'x y'") == {"f": {"$ne": "x y"}} and M.parse_where("n = 42") == {"n": {"$in": [42, 42.0]}} and M.parse_where("n >= -1.5") == {"n": {"$gte": -1.5}}
    with pytest.raises(ValueError):
        M.parse_where("id IN ('a', )")
    for bad in ("a = 1 AND b = 2", "a LIKE 'x'", ""):
        with pytest.raises(NotImplementedError):
            M.parse_where(bad)
    c = lambda k, o, v: Clause(key=k, operator=o, value=v)
    assert M.from_clauses(Clause(filters=[c("a", "==", 1), c("b", "not in", [2])], condition="or")) == {"$or": [{"a": {"$eq": 1}}, {"b": {"$nin": [2]}}]}
    assert M.from_clauses(c("a", None, 1)) == {"a": {"$eq": 1}} and M.from_clauses(None) is None and M.from_clauses(Clause(filters=[])) is None
    with pytest.raises(ValueError):
        M.from_clauses(c("a", "~", 1))
    assert M.from_dict({"a": 1}) == {"a": 1}
    with pytest.raises(ValueError):
        M.from_dict([1])
