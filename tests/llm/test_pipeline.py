"""Each stage of the pipeline on its own input, against brute force, and the whole on the smallest tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from quillon.llm import decontamination, mixing, quality
from tests_llm_support import jaccard_brute


@pytest.fixture(scope="module")
def rows(prose):
    from test_ngram_join import near

    base = [prose(i, 150) for i in range(12)]
    out = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(base)]
    out += [(100 + i, near(base[i], 0.03, i), "en", "s0") for i in range(4)]
    out += [(200, base[0], "en", "s1"), (201, base[1] + "\n" + base[2].split("\n")[3], "de", None)]
    return out + [(300, None, None, None), (301, "", "en", "s2"), (None, base[5], "en", "s0"), (302, "a", "en", "s1"), (1, base[1], "en", "s1"), (303, prose(77, 20_000), "fr", "s2")]


def test_names_and_order():
    assert [n for n, _ in P.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights"]


def ids(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in df.select("doc_id").collect())


def test_quality_stage(spark, make_docs, rows, sf):
    docs = make_docs(rows)
    kept = P.quality_classifier(spark, docs, sf)
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    p = {r["doc_id"]: r["probability"] for r in quality.score(docs, model).collect()}
    assert kept.columns == docs.columns
    assert set(ids(kept)) == {(-1 if i is None else i) for i, x in p.items() if x is not None and x >= P.QUALITY_THRESHOLD}


def test_line_stage(spark, make_docs, rows, sf):
    from test_line_dedup import brute

    docs = make_docs(rows)
    out = P.line_deduplication(spark, docs, sf)
    assert out.columns == docs.columns
    want = brute([(r[0], r[1]) for r in dict.fromkeys(rows)])
    before = {r[0]: r[1] for r in rows}
    got = {r["doc_id"]: r for r in out.collect()}
    for i, text in want.items():
        if before[i].strip() and not text.strip():
            assert i not in got
        else:
            assert got[i]["text"] == text and got[i]["n_chars"] == len(text)
    assert 200 not in got and 300 in got and None in got


def test_line_stage_keeps_what_is_left_and_clashing_names(spark, make_docs, prose, sf):
    a = prose(5)
    docs = make_docs([(1, a), (2, a + "\nshort"), (3, a + "\n\n"), (4, "\n")]).withColumns({c: F.lit(7) for c in ("__removed", "removed_", "lost_id", "lost_lines")})
    out = P.line_deduplication(spark, docs, sf)
    assert out.columns == docs.columns
    assert {r["doc_id"]: (r["text"], r["n_chars"], r["__removed"], r["removed"]) for r in out.collect()} == {1: (a, len(a), 7, "x"), 2: ("short", 5, 7, "x"), 4: ("\n", 1, 7, "x")}


def test_join_stage(spark, make_docs, rows, sf):
    docs = make_docs(rows)
    kept = P.ngram_jaccard_join(spark, docs, sf)
    gone = jaccard_brute([(r[0], r[1]) for r in rows])
    assert kept.columns == docs.columns and set(ids(kept)) == {(-1 if r[0] is None else r[0]) for r in rows} - gone and gone >= {100, 101, 102, 103, 200}


def test_decontamination_stage(spark, make_docs, rows, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first()["text"]
    docs = make_docs([*rows, (900, rows[0][1] + " " + item + " " + rows[3][1])])
    kept = P.benchmark_decontamination(spark, docs, sf)
    assert kept.columns == docs.columns and ids(kept) == ids(make_docs(rows))


@pytest.mark.parametrize("stage", range(5))
def test_empty(spark, make_docs, sf, stage):
    assert P.STAGES[stage][1](spark, make_docs([]), sf).count() == 0


def brute_pipeline(spark, sf):
    """The ids that each stage leaves, and the texts, stage by stage from plain Python versions; the network's scores and the
    leaks (which have SQL of their own) are taken as they are."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    table = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    score = {r["doc_id"]: r["probability"] for r in quality.score(docs, quality.train(docs, table("labels"))).collect()}
    text = {r["doc_id"]: (r["text"], r["source"]) for r in docs.collect() if score[r["doc_id"]] >= P.QUALITY_THRESHOLD}
    from test_line_dedup import brute

    cut = brute([(i, t) for i, (t, _) in text.items()])
    text = {i: (cut[i], s) for i, (t, s) in text.items() if cut[i].strip() or not t.strip()}
    gone = jaccard_brute([(i, t) for i, (t, _) in text.items()])
    text = {i: x for i, x in text.items() if i not in gone}
    left = spark.createDataFrame([(i, t) for i, (t, _) in text.items()], "doc_id long, text string")
    leaked = {r["doc_id"] for r in decontamination.leaks(left, table("benchmark")).collect()}
    return {i: x for i, x in text.items() if i not in leaked}


def test_run(spark, sf, duck):
    out = P.run(spark, sf)
    text = brute_pipeline(spark, sf)
    duck.register("left_over", spark.createDataFrame([(i, t, s) for i, (t, s) in text.items()], "doc_id long, text string, source string").toArrow())
    rel = duck.sql(mixing.oracle(documents="left_over"))
    order = sorted(out.columns)
    want = sorted(map(str, rel.select(", ".join(order)).fetchall()))
    assert len(want) > 50 and sorted(map(str, (tuple(r[c] for c in order) for r in out.collect()))) == want
    assert {r["doc_id"] for r in out.collect()} <= set(text)
