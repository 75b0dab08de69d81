import math

import pytest

from quillon.llm import mixing as M


def docs_of(make_docs, counts, words=10):
    rows, i = [], 0
    for source, n in counts.items():
        for _ in range(n):
            rows.append((i, " ".join(["w"] * words), "en", source))
            i += 1
    return make_docs(rows)


def test_repetition_limit_and_budget(spark, make_docs):
    docs = docs_of(make_docs, {"big": 300, "mid": 60, "small": 20})
    out = M.mix(docs, budget_ratio=1.0, max_repeats=2.0, block_tokens=300, mix_block_tokens=500).toPandas()
    total = 3800
    tokens = out.groupby("source").tokens.sum()
    assert tokens["small"] <= 2.0 * 200 + 1e-6 and tokens["small"] > 1.9 * 200
    assert total - 60 <= tokens.sum() <= total
    for (source, epoch), g in out.groupby(["source", "epoch"]):
        assert g.doc_id.is_unique  # an epoch is a permutation
        if epoch < out[out.source == source].epoch.max():
            assert len(g) == {"big": 300, "mid": 60, "small": 20}[source]
    for source, g in out.groupby("source"):
        g = g.sort_values("start")
        assert (g.start.to_numpy()[1:] == (g.start + g.tokens).to_numpy()[:-1]).all()  # the stream has no gaps
        share = g.groupby("mix_block").tokens.sum() / g.tokens.sum()
        assert abs(share - 1 / (out.mix_block.max() + 1)).max() < 0.1
    # A second run draws the same.
    again = M.mix(docs, max_repeats=2.0, block_tokens=300, mix_block_tokens=500).toPandas()
    assert sorted(map(tuple, again.values.tolist())) == sorted(map(tuple, out.values.tolist()))


@pytest.mark.parametrize("target", [0.5, 0.9])
def test_target_entropy(spark, make_docs, target):
    totals = spark.createDataFrame([("a", 900), ("b", 60), ("c", 40)], "source string, total long")
    w = [r["weight"] for r in M.weights(totals, entropy=target, max_repeats=None).collect()]
    assert abs(sum(w) - 1) < 1e-6
    assert abs(-sum(x * math.log(x) for x in w) - target * math.log(3)) < 1e-4


def test_edges(spark, make_docs, prose):
    assert M.mix(make_docs([])).count() == 0
    assert M.mix(make_docs([(1, None), (2, "")])).count() == 0
    rows = [(1, "one two", "en", None), (None, "three four five", "en", "a"), (2, None, "en", "a"), (3, "", "en", "b"), (4, "w " * 300_000, "en", "a"), (1, "one two", "en", None)]
    out = M.mix(make_docs(rows), max_repeats=50.0).toPandas()
    assert set(out.source) <= {"(none)", "a"} and out.tokens.max() <= 300_000


def test_targets_out_of_reach_are_errors(spark, make_docs):
    docs = docs_of(make_docs, {"x": 3})
    for how in (dict(budget_ratio=3.0, max_repeats=2.0), dict(max_repeats=None), dict(entropy=1.5), dict(entropy=-0.1)):
        with pytest.raises(ValueError):
            M.mix(docs, **how)


@pytest.mark.parametrize("how", [{}, {"entropy": 0.8, "max_repeats": None}, {"entropy": 0.95, "max_repeats": None, "budget_ratio": 1.0}])
def test_sql_with_uneven_sources(spark, duck, make_docs, monkeypatch, how):
    monkeypatch.setattr(M, "PART_BLOCKS", 3)
    docs = docs_of(make_docs, {"x": 70, "y": 9, "z": 2}, 7)
    duck.register("uneven", docs.select("doc_id", "text", "source").toArrow())
    args = dict(budget_ratio=1.3, max_repeats=3.0, block_tokens=60, mix_block_tokens=100) | how
    got = M.mix(docs, **args)
    rel = duck.sql(M.oracle(documents="uneven", **args))
    order = sorted(got.columns)
    assert sorted(map(str, (tuple(r[c] for c in order) for r in got.collect()))) == sorted(map(str, rel.select(", ".join(order)).fetchall()))
